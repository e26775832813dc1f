from factloom.code import analysis
from factloom.code.facts import File, extract
from factloom.code.phpast import parse
from factloom.functions.phplex import LexError, tokens
from factloom.plans.relational import category


def files(spark, texts):
    rows = [(i + 1, 1, f"src/f{i}.php", bytearray(t.encode())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_id bigint, repo_id int, file_path string, content binary")


def test_lexer_modes():
    kinds = [t.kind for t in tokens("a<?= $x ?>b<?php $y = <<<T\n  {$a['k']} $b[0] ${c}\n  T . \"q {$d->e()} \"; __halt_compiler(); junk { '")]
    assert kinds[0] == "html" and kinds.count("PART") == 3 and kinds[-1] == "HALT"
    for bad in ("<?php 'a", '<?php "a', "<?php /* a", "<?php <<<A\nb", '<?php "{$a"'):
        try:
            tokens(bad)
            raise AssertionError(bad)
        except LexError:
            pass


def test_parser_recovers():
    tree, errors = parse("<?php $a = ; function f() { return 1; } class C { public function m() { } x } $b = 2;")
    kinds = [n.kind for n in tree.walk()]
    assert errors and "function" in kinds and "class" in kinds and kinds.count("assign") == 1


def test_deep_nesting_is_an_error_and_not_a_crash():
    for text in ("<?php $a = " + "(" * 5000 + "1" + ")" * 5000 + ";", "<?php " + "if (1) {" * 3000 + "}" * 3000):
        assert File(1, text.encode()).row()["errors"]


def test_facts(spark):
    c = analysis.Code(extract(files(spark, ["<?php namespace N; use A\\B as C; abstract class X extends C implements \\D { use T; private ?int $p = 1; function __construct(private string $q) {} static function s(int $a, ...$r): void {} } function g() {}", "", "<?php broken ("])))
    (x,) = c.rows("classes").collect()
    assert (x.name, x.parent, x.interfaces, x.traits, x.abstract) == ("N\\X", "A\\B", ["D"], ["N\\T"], True)
    assert {r.name for r in c.rows("properties").collect()} == {"p", "q"}
    assert {(r.name, r.kind, r.static) for r in c.rows("functions").collect()} == {("__construct", "method", False), ("s", "method", True), ("N\\g", "function", False)}
    assert {r.file_id for r in c.errors().collect()} == {3}


def test_ambiguous_function_is_unresolved_but_for_its_own_file(spark):
    c = analysis.Code(extract(files(spark, ["<?php function f() {} f();", "<?php function f() {}", "<?php f();"])))
    calls = {r.id: r.file_id for r in c.calls.collect()}
    assert {calls[r.call_id] for r in c.targets().collect()} == {1}


def test_chains_and_rules(spark):
    text = "<?php class A { private $h; function __destruct() { $this->run(); } function run() { $this->h->go(); } } class B { function go() { unlink($this->f); } function __wakeup() { unserialize($x, ['a' => 1]); } }"
    c = analysis.Code(extract(files(spark, [text])))
    chains = {(r.entry, r.sink, r.length, r.level) for r in c.chains(c.call_graph(category)).collect()}
    assert chains == {("1:a::__destruct", "1:SINK::unlink", 4, "LOW"), ("1:b::__wakeup", "1:SINK::unserialize", 2, "HIGH")}
    good, bad = analysis.check_rules([*analysis.RULES, {"id": "loom.magic.sink", "severity": "LOW", "callees": [], "patterns": ["x"], "message": ""}, {"id": "z", "regex": "a"}])
    assert len(good) == len(analysis.RULES) and [b[0] for b in bad] == ["loom.magic.sink", "z"]
    assert {r.rule_id for r in c.matches(good).collect()} == {"loom.unserialize.options", "loom.magic.sink"}


def test_dispatch_edges_sites_includes_sessions_and_stores(spark):
    texts = [
        "<?php namespace N; class A { function run() { $this->go(); } function go() {} } class B extends A { function go() { eval($this->x); } } function f(A $a) { $a->go(); }",
        "<?php unserialize($a, ['allowed_classes' => ['N\\\\A', \\B::class]]); unserialize($b, ['allowed_classes' => false]); unserialize($c); unserialize($d, $e);",
        "<?php include __DIR__ . '/../src/./f0.php'; require 'src/f1.php'; include $x;",
        "<?php $_SESSION['cart'] = unserialize($x); function g() { $_SESSION['cart']->go(); $db->query('SELECT a, t.b FROM items WHERE 1'); $db->exec(\"INSERT INTO items (a, c) VALUES (1, 2)\"); }",
    ]
    c = analysis.Code(extract(files(spark, texts)))
    edges = {(r.src[2:], r.dst[2:], r.edge_type) for r in c.call_graph(category).collect()}
    assert {("n\\a::run", "n\\a::go", "direct"), ("n\\a::run", "n\\b::go", "override"), ("n\\f", "n\\a::go", "typed_many"), ("n\\f", "n\\b::go", "typed_many"), ("n\\b::go", "SINK::eval", "sink")} <= edges
    assert [r.policy for r in c.sites().where("file_id = 2").orderBy("call_id").collect()] == ["allowlist", "deny", "allow", "unknown"]
    assert c.sites().where("policy = 'allowlist'").first().classes == ["n\\a", "b"]
    inc = {r.target: r.target_id for r in c.includes().collect()}
    assert inc == {"src/f0.php": 1, "src/f1.php": 2, None: None}
    (d,) = c.session_dispatch().collect()
    assert (d.key, d.callee, d.stores, d.classes, d.truncated) == ("cart", "go", 1, ["n\\a", "n\\b"], False)
    assert {(r.table, r.column, r.access) for r in c.stored_columns().collect()} == {("items", "a", "read"), ("items", "b", "read"), ("items", "a", "write"), ("items", "c", "write")}
    cov = {r.file_id: (r.calls, r.resolved) for r in c.coverage().collect()}
    assert cov[1] == (3, 2)  # a receiver with a declared class is resolved


def test_chains_of_seven_links_and_a_mark_where_depth_stops_one(spark):
    steps = lambda name, n: f"class {name} {{ function __destruct() {{ $this->m1(); }} " + "".join(f"function m{k}() {{ {f'$this->m{k + 1}()' if k < n else 'unlink($x)'}; }} " for k in range(1, n + 1)) + "}"
    both = "class C { function __destruct() { unlink($x); $this->m1(); } " + "".join(f"function m{k}() {{ {f'$this->m{k + 1}()' if k < 7 else 'unlink($x)'}; }} " for k in range(1, 8)) + "}"
    c = analysis.Code(extract(files(spark, ["<?php " + steps("A", 6) + steps("B", 7) + both])))
    edges = c.call_graph(category)
    assert {(r.entry, r.length, r.complete) for r in c.chains(edges).collect()} == {("1:a::__destruct", 8, True), ("1:c::__destruct", 2, False)}
    assert {(r.entry, r.length, r.complete) for r in c.chains(edges, 7).collect()} == {("1:a::__destruct", 8, True), ("1:b::__destruct", 9, True), ("1:c::__destruct", 2, True), ("1:c::__destruct", 9, True)}


def test_edges_of_text_conversions_and_member_reads(spark):
    texts = [
        "<?php namespace N; use M\\T as Text; class A { private Text $t; private ?P $p; private int $i; function __destruct() { $x = 'a' . $this->t . $this->i; } function __wakeup() { return $this->p->name; } function f() { $this->p->go(); $g = function () { return 'a' . $this->t; }; } }"
        " class P { function __get($n) { unlink($n); } } class Q extends P { function __get($n) { eval($n); } } function show(\\M\\T $v, $w) { return (string) $v . (string) $w; }",
        "<?php namespace M; class Base { function __toString() { unlink($this->f); return ''; } } class T extends Base { }",
    ]
    c = analysis.Code(extract(files(spark, texts)))
    edges = c.call_graph(category)
    got = {(r.src[2:], r.dst[2:], r.edge_type, r.confidence) for r in edges.where("edge_type IN ('magic_get', 'magic_tostring')").collect()}
    to, get = ("m\\base::__tostring", "magic_tostring", 0.9), [(f"n\\{c}::__get", "magic_get", 0.7) for c in "pq"]
    assert got == {("n\\a::__destruct", *to), ("n\\show", *to), *(("n\\a::" + m, *g) for m in ("__wakeup", "f") for g in get)}
    assert {(r.entry[2:], r.sink[2:], r.level) for r in c.chains(edges).collect()} == {("n\\a::__destruct", "SINK::unlink", "HIGH"), ("n\\a::__wakeup", "SINK::unlink", "MEDIUM"), ("n\\a::__wakeup", "SINK::eval", "MEDIUM")}


def test_calls_longer_than_500_characters_are_whole(spark):
    from factloom.code import structural

    pad = "".join(f"'N\\C{k}',\n" for k in range(80))
    columns = ", ".join(f"t.c{k}\n" for k in range(150))
    c = analysis.Code(extract(files(spark, [f"<?php unserialize($a, ['allowed_classes' => [{pad} 'N\\Last']]);", f"<?php unserialize($a, ['x' => [{pad}], 'allowed_classes' => true]);", f"<?php $db->query('SELECT {columns} FROM items WHERE 1');"])))
    assert {(r.file_id, r.rule_id) for r in c.matches(analysis.check_rules(analysis.RULES)[0]).collect()} == {(1, "loom.unserialize.options"), (2, "loom.unserialize.options")}
    assert {r.file_id for r in structural.calls_matching(c.calls, "unserialize($DATA, ...)").collect()} == {1, 2}
    sites = {r.file_id: r for r in c.sites().collect()}
    assert (sites[1].policy, len(sites[1].classes), sites[1].classes[-1], sites[2].policy) == ("allowlist", 81, "n\\last", "allow")
    assert {(r.table, r.column) for r in c.stored_columns().collect()} == {("items", f"c{k}") for k in range(150)}


def test_loops_run_until_nothing_new_comes_in(spark):
    names = [f"$v{k}" for k in range(40)]
    body = " ".join(f"{a} = {b};" for a, b in zip(names[1:][::-1], names[:-1][::-1])) + " $v0 = $_GET['x'];"
    texts = [f"<?php while ($n--) {{ {body} }} unserialize($v39);", f"<?php do {{ {body} }} while ($n--); unserialize($v39);", f"<?php foreach ($l as $n) {{ while ($n--) {{ {body} }} }} unserialize($v39); unserialize($v40);"]
    got = [(r.file_id, r.disposition) for r in analysis.Code(extract(files(spark, texts))).inventory(category).orderBy("file_id", "col").collect()]
    assert got == [(1, "proven_route"), (2, "proven_route"), (3, "proven_route"), (3, "no_modeled_source")]


def test_coverage_of_a_finding_and_sinks_of_a_dispatch(spark):
    from factloom.plans.code import finding_coverage_of

    texts = [
        "<?php function go($x) { unserialize($x); a(); missing(); } go($_GET['x']); $q->other();",
        "<?php function a() { b(); trim('x'); } function unused() { lost(); }",
        "<?php function b() { $o->m(); a(); } broken (",
        "<?php $_SESSION['cart'] = unserialize($x); $_SESSION['cart']->run(); class R { function run() { $this->s(); } function s() { unlink($x); } } class S { function run() { unserialize($x); } }",
    ]
    c = analysis.Code(extract(files(spark, texts)))
    (r,) = finding_coverage_of(c).collect()
    assert (r.file_id, r.scopes, r.files, r.fallback_files, r.unresolved_truncated) == (1, 4, ["src/f0.php", "src/f1.php", "src/f2.php"], ["src/f2.php"], False)
    assert (r.unresolved, [(x.path, x.callee) for x in r.unresolved_calls]) == (3, [("src/f0.php", "missing"), ("src/f0.php", "other"), ("src/f2.php", "m")])
    e = c.call_graph(category)
    assert [(d.classes, d.sinks, d.deeper) for d in c.dispatch_sinks(c.session_dispatch(), e, category).collect()] == [(["r", "s"], ["unlink"], False)]
    assert [(d.sinks, d.deeper) for d in c.dispatch_sinks(c.session_dispatch(), e, category, 1).collect()] == [([], True)]


def test_method_inherited_over_more_than_32_levels_and_a_cycle(spark):
    text = "<?php class C0 { function m() {} } " + " ".join(f"class C{k} extends C{k - 1} {{ }}" for k in range(1, 36)) + " C35::m(); class X extends Y { } class Y extends X { } X::m();"
    c = analysis.Code(extract(files(spark, [text])))
    assert [r.how for r in c.targets().collect()] == ["static"]
