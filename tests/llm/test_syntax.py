import json
import random
import re

import pytest

from factloom.llm import validity
from factloom.llm.syntax import jsontext, php, yamltext
from factloom.llm.syntax.gll import Grammar

B = {d: 1 << i for i, d in enumerate(php.DIALECTS)}
ALL = sum(B.values())


def ok(text, template=False):
    return php.check(text.encode("latin-1"), template)[0]


def test_ambiguous_and_left_recursive_grammars():
    g = Grammar("s : s s | A | ;", "s", ("d",))
    a = g.terminals["A"]
    assert all(g.parse([a] * n)[0] for n in range(8))
    g = Grammar("e : e PLUS e | X ; ", "e", ("d",))
    x, p = g.terminals["X"], g.terminals["PLUS"]
    assert g.parse([x, p, x, p, x, p, x])[0] and not g.parse([x, p])[0] and not g.parse([p])[0] and not g.parse([])[0]


def test_dialects_run_together():
    g = Grammar("s : {a} A B | {b} A C | {a b} A D ;", "s", ("a", "b"))
    t = g.terminals
    assert [g.parse([t["A"], t[x]])[0] for x in "BCD"] == [1, 2, 3]


@pytest.mark.parametrize(
    ("text", "mask"),
    [
        ("<?php $x{0};", B["7.4"]), ("<?php $a ? $b : $c ? $d : $e;", B["7.4"]), ("<?php enum A { case B; }", B["8.1"] | B["8.2"]), ("<?php readonly class A {}", B["8.2"]), ("<?php f(a: 1);", ALL - B["7.4"]),
        ("<?php $f = strlen(...);", B["8.1"] | B["8.2"]), ("<?php $a?->b;", ALL - B["7.4"]), ("<?php class A { function __construct(private int $x) {} }", ALL - B["7.4"]), ("<?php function f(): A&B {}", B["8.1"] | B["8.2"]),
    ],
)
def test_dialects_of_php(text, mask):
    assert ok(text) == mask


@pytest.mark.parametrize(
    "text",
    [
        "<?php", "<?php ", "<?= 1 ?>", "<?php /* } */ // {\n# [\n$a = '}';", "<?php $a = <<<X\n <<<<<<< HEAD\n X;", "<?php ?> <<<<<<< HEAD {{{", "<?php __halt_compiler(); {{{ '", "<?php if ($a): ?>x<?php elseif ($b): else: endif ?>",
        "<?php switch (1): ?>\n<?php case 1: break; endswitch;", "<?php use A\\{B, C as D, function e}; namespace\\f();", "<?php \xe9chec(); // \xff", "\r\n<?php\rclass A\r{\r}\r", "<?PHP echo 1;", "<?php label: goto label; a: { }",
        "<?php [$a, , [$b]] = $c; list('k' => $d) = $e; foreach ($f as [$g, $h]) {}", "<?php $a = new class(1) extends B implements C { use D { x as protected; } };", "<?php abstract class A { abstract function f(); const B = 1, C = 2; var $d; }",
        "<?php try { } catch (A | B $e) { } finally { }", "<?php function &f(array &...$x): ?int { yield $a => $b; return; }", "<?php echo \"{$a->b[1]} $c[d] ${e} $f->g \\{$h\";", "<?php $a = static fn&(int|string $x = 1): static => $x ?? throw new E;",
        "<?php declare(strict_types=1); print `ls $x`; exit; die(1);", "<?php if (1) a(); else if (2) b(); else c();", "<?php A::$b[1]::C; A::{$x}(); $a::class; (clone $x)->y; !$z = 1; @$w['a']['b'] .= 'c';", "<?php for (;;): endfor; while (1): endwhile; do ; while (0);",
    ],
)
def test_valid_php(text):
    assert ok(text) & B["8.1"]


@pytest.mark.parametrize(
    "text",
    [
        "<?php class A {", "<?php function f() { return [1, 2; }", "<?php $a = 'x", "<?php $a = \"{$b\";", "<?php $a = <<<X\n y", "<?php /* x", "<?php if ($a):", "<?php class A { }\n=======\n", "<?php class A { <<<<<<< HEAD\n }", "<?php foreach ($a) {}",
        "<?php 1 = 2;", "<?php f(1,,2);", "<?php class { }", "<?php } ", "<?php echo;", "<?php $a->;", "<?php else {}", "<?php class A { foo(); }", "<?php $x = fn($y);", "no tag", "\x89PNG\x00", "const a = require('b');", "<?php $a = (1;", "<?php \"$a[\";",
    ],
)
def test_invalid_php(text):
    assert not ok(text) & B["8.1"]


@pytest.mark.parametrize(
    "text",
    ["foreach ($a as 1) {}", "unset(1);", "($a) = 1;", "$a = &1;", "$a = &new B;", "$a == $b == $c;", "$a < $b < $c;", "$x instanceof 1;", "08;", "f() + 1 = 2;", "$a < $b == $c < $d == $e;", "[1, 2] .= 3;", "array(1) = $a;", "$a <=> $b != $c;", "$a == !$b === $c;"],
)
def test_more_invalid_php(text):
    assert not ok("<?php " + text) & B["8.1"]


@pytest.mark.parametrize(
    "text",
    [
        "foreach ($a as &$b) {} foreach (f() as list($k, [$v])) {} foreach ($a as $b->c['d'] => $e) {}", "unset($a, $b[1], $c->d, A::$e);", "$a = &$b->c(); $d = & f($x);", "$a == $b && $c == $d; $a < $b == $c < $d;", "$a == $b = $c == $d;", "!$x instanceof A;", "$x instanceof $y->z && $x instanceof static;",
        "07_1 + 0.8 + 0e9 + 0x1F8 + 00;", "[$a, $b] = [$b, $a]; ['k' => $c] = $d; list(, $e) = f();", "'a'[0]; [1, 2][1]; ('f')(); array(1)[0];", "$a == print $b == $c; $x ?? throw new E; $f = fn($x) => $x == 1;", "$a = $b = $c ?: $d; $i++ + ++$j; -$a ** 2; @$x[1]--;",
        "while (($row = next($x)) !== null) {} if (!$a = f()) {} $x = (int) $a == 1;",
    ],
)
def test_more_valid_php(text):
    assert ok("<?php " + text) & B["8.1"]


def test_templates_need_no_tag():
    assert ok("plain { text", True) and ok("", True) and ok("") and not ok("<?php foreach ($a as $b): ?>x", True)


def test_json_against_the_library():
    rnd = random.Random(2)
    base = json.dumps({"a": [1, -2.5e3, "x\u00e9\\n", None, True], "b": {"c": {}}, "d": []}, indent=1)
    for _ in range(400):
        k = rnd.randrange(len(base) + 1)
        text = base[:k] + rnd.choice(["", ",", "}", "]", '"', "0", "\x01", " ", "NaN", "'"]) + base[k + rnd.randrange(3) :]
        try:
            json.loads(text, parse_constant=lambda x: 1 / 0)
            want = True
        except (ValueError, ZeroDivisionError):
            want = False
        assert bool(jsontext.check(text.encode())[0]) == want, text
    assert not jsontext.check(b"")[0] and not jsontext.check(b'"\xff"')[0] and jsontext.check(b"[" * 3000 + b"]" * 3000)[0]


def test_yaml_against_a_library():
    yaml = pytest.importorskip("yaml")
    rnd = random.Random(3)
    base = "# c\nrules:\n  - id: a.b\n    m: \"x [y\"\n    n: {e: f, r: [1, 2]}\n  - 'q': |\n      <<<<<<< x\n      y\n    ? k\n    z: [b]\n    y: c\n---\n- >-\n  t\n- u v\n- plain text\n  goes on\n"
    for _ in range(600):
        k = rnd.randrange(len(base) + 1)
        text = base[:k] + rnd.choice(["", "- ", "\n", "  ", '"', "[", "}", "#", ", ", "=======\n", "'"]) + base[k + rnd.randrange(4) :]
        if re.search(r"(?m)(?:^|[-\[,{?])\s*:(?:\s|$)", text):
            continue  # an empty key is valid by the specification, but not for this library
        try:
            list(yaml.parse(text))
            want = True
        except yaml.YAMLError:
            want = False
        assert bool(yamltext.check(text.encode())[0]) == want, text


def test_flags(spark):
    rows = [
        (1, 1, "a.php", b"<?php f("), (1, 1, "a.php", b"<?php f("), (2, 1, "b.PHP", b""), (3, 1, "c.json", b""), (4, 1, "d.class.php", b"x"), (5, 1, "e.txt", b"("), (6, None, None, b"("), (7, 1, "f.yml", b"a: [1"), (8, 1, "g.tpl", b"x"), (9, 2, "h.inc", None),
        (10, 2, "i.module", b"<?php " + b"$a = 1; " * 40_000),
    ]
    odd = spark.createDataFrame([(None, 1, "a.php", bytearray(b"<?php (")), (None, 1, "b.php", bytearray(b"<?php 1;")), (None, 1, "a.php", bytearray(b"<?php ("))], "file_id bigint, repo_id int, file_path string, content binary")
    assert sorted(r.valid for r in validity.flags(odd).collect()) == [False, False, True]
    f = spark.createDataFrame([(*r[:3], None if r[3] is None else bytearray(r[3]), 1) for r in rows], "file_id bigint, repo_id int, file_path string, content binary, valid int")
    got = {r.file_id: r.valid for r in validity.flags(f).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: None, 6: None, 7: False, 8: True, 9: None, 10: True}
    total = [r for r in validity.rates(validity.flags(f)).collect() if r.level == 3]
    assert (total[0].files, total[0].invalid) == (8, 4) or total[0].invalid == 4
    assert validity.flags(f.limit(0)).count() == 0
    log = spark.createDataFrame([(1, "./A.PHP", "Parse ", "m"), (2, "h.inc", "rules", None), (None, None, None, None)], "repo_id int, file_path string, phase string, message string")
    told = {r.file_id: r.told for r in validity.with_log(validity.flags(f), log).collect()}
    assert told == {1: True, 3: False, 4: False, 7: False}
