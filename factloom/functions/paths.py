"""Paths, versions and field lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory names that mark code that is not production code (fixed values).
TESTS = ("test", "tests", "testing", "phpunit", "spec")
EXAMPLES = ("example", "examples", "demo", "demos", "sample", "samples")
EXTENSIONS = (".php", ".php3", ".php4", ".php5", ".php7", ".php8", ".inc", ".phtml", ".module", ".install", ".theme", ".profile", ".engine", ".ctp", ".tpl", ".class.php")


def segments(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(path), r"\\", "/"), "/"), lambda s: s != "")


def has_extension(path: Column, extensions=EXTENSIONS) -> Column:
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(F.lower(path), F.lit(e))
    return out


def outside(path: Column, excluded) -> Column:
    """True unless a directory of the path (not its last part) is excluded."""
    s = segments(path)
    return ~F.coalesce(F.arrays_overlap(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(*[F.lit(x) for x in excluded])), F.lit(False))


def scope(path: Column) -> Column:
    """external, tests, examples, vendor or production."""
    s = segments(path)
    any_of = lambda names: F.arrays_overlap(s, F.array(*[F.lit(x) for x in names]))
    return F.when(path.isNull(), "external").when(any_of(TESTS), "tests").when(any_of(EXAMPLES), "examples").when(any_of(("vendor",)), "vendor").otherwise("production")


def glob_match(path: Column, pattern: Column) -> Column:
    """Segment by segment: as many segments, each matching with ``*`` for any run of characters."""
    p, g = F.split(path, "/"), F.split(pattern, "/")
    rx = lambda x: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(x, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    return (F.size(p) == F.size(g)) & F.forall(F.arrays_zip(p.alias("p"), g.alias("g")), lambda z: F.regexp(z["p"], rx(z["g"])))


def version(text: Column, width: int = 4) -> Column:
    """Numeric parts of a version padded with zeros; null if the text is no version."""
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    return F.when(text.rlike(r"^\d+(\.\d+)*$"), F.slice(F.concat(parts, F.array_repeat(F.lit(0), width)), 1, width))


def widen(fields: Column, depth: int = 4) -> Column:
    """A field path of more than ``depth`` parts keeps the first ones and a wildcard (null)."""
    return F.when(F.size(fields) <= depth, fields).otherwise(F.concat(F.slice(fields, 1, depth - 1), F.array(F.lit(None).cast("string"))))


def truncate(trace: Column, most: int = 32) -> Column:
    """A trace of more than ``most`` parts keeps its first and its last ones."""
    return F.when(F.size(trace) <= most, trace).otherwise(F.concat(F.slice(trace, 1, 1), F.slice(trace, -(most - 1), most - 1)))


def fields_match(a: Column, b: Column) -> Column:
    """Field paths agree up to the shorter, a null part matching any."""
    n = F.least(F.size(a), F.size(b))
    return F.forall(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.isNull() | y.isNull() | (x == y)), lambda m: m)


def identity(*columns: Column, length: int = 16) -> Column:
    """Hex id over a canonical text of the columns; null and empty differ."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256), 1, length)
