"""One CodeLocation written as text in four notations, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.json import let
from factloom.functions.text import letters_digits

#: The fields of a CodeLocation, by the letters of their names.
FIELDS = ("filepath", "startline", "startcol", "endline", "endcol")
_LETTERS = r"[^\p{L}]"


def _pairs(parts: Column, sep: str) -> Column:
    """Entries of ``key<sep>value`` texts; the value is what follows the first separator."""
    at = lambda x: F.locate(sep, x)
    return F.transform(F.filter(parts, lambda x: at(x) > 0), lambda x: F.struct(F.substring(x, F.lit(1), at(x) - 1).alias("key"), F.substring(x, at(x) + 1, F.length(x)).alias("value")))


def entries(raw: Column) -> Column:
    """array<struct<key, value>> of a text; null if the text is in none of the notations."""
    return let(F.regexp_replace(raw, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}]+$", ""), _entries)


def _entries(s: Column) -> Column:
    obj = F.map_entries(F.from_json(s, "map<string,string>"))
    tag = F.transform(
        F.regexp_extract_all(s, F.lit(r"""([\w.\-]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1)),
        lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), _entities(F.regexp_extract(x, r"""(?s)=\s*["'](.*)["']$""", 1)).alias("value")),
    )
    return (
        F.when(s.startswith("{"), obj)
        .when(s.startswith("<"), tag)
        .when(s.rlike(r"^[\p{L}_\- .]+=") & ~s.rlike(r"^[\p{L}_\- .]+:"), _pairs(F.split(s, ";"), "="))
        .when(s.rlike(r"^[\p{L}_\- .]+:"), _pairs(F.split(s, r"\s\|\s|\|"), ":"))
    )


def _entities(c: Column) -> Column:
    """Character references of XML as characters."""
    return let(c, lambda x: F.when(F.contains(x, F.lit("&")), _unescaped(x)).otherwise(x))


def _unescaped(c: Column) -> Column:
    code = lambda n: F.decode(F.unhex(F.lpad(n, 8, "0")), "UTF-32")
    c = F.aggregate(F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(\d{1,7});"), F.lit(1))), c, lambda a, d: F.replace(a, F.concat(F.lit("&#"), d, F.lit(";")), code(F.hex(d.cast("long")))))
    c = F.aggregate(F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#[xX]([0-9a-fA-F]{1,6});"), F.lit(1))), c, lambda a, d: F.replace(F.replace(a, F.concat(F.lit("&#x"), d, F.lit(";")), code(d)), F.concat(F.lit("&#X"), d, F.lit(";")), code(d)))
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    return c


def _number(c: Column) -> Column:
    def other(c: Column) -> Column:
        t = F.lower(F.regexp_replace(c, r"[\s\p{Z}]+", ""))
        n = t.try_cast("decimal(38,9)").cast("string")
        return F.coalesce(F.regexp_replace(F.regexp_replace(n, r"(\.\d*?)0+$", "$1"), r"\.$", ""), t)

    # most are plain digits
    return let(c, lambda x: F.when(x.rlike("^[1-9][0-9]{0,17}$"), x).otherwise(other(x)))


def key(scan: Column, raw: Column) -> Column:
    """Canonical key text of a record: scan and the five values; absent, null and empty are alike.

    file_path goes by its letters and digits, the others as numbers. Of a key that occurs twice the last value that is
    not empty counts. A text in none of the notations has its own letters and digits as key, apart from all others.
    """
    def of(es: Column) -> Column:
        def value(name: str) -> Column:
            own = F.filter(es, lambda e: (e["k"] == name) & e["v"].isNotNull() & (e["v"] != ""))
            return F.try_element_at(F.transform(own, lambda e: e["v"]), F.lit(-1))

        parts = [F.coalesce(scan.cast("string"), F.lit("")), F.coalesce(letters_digits(value(FIELDS[0])), F.lit(""))]
        parts += [F.coalesce(_number(value(f)), F.lit("")) for f in FIELDS[1:]]
        odd = F.concat(F.coalesce(scan.cast("string"), F.lit("")), F.lit("\x01?\x01"), letters_digits(raw))
        blank = F.coalesce(F.regexp_replace(raw, r"[\s\p{Z}]", ""), F.lit("")) == ""
        return F.when(es.isNotNull() | blank, F.concat_ws("\x01", *parts)).otherwise(odd)

    # the text is read once, the entries are looked at five times
    return let(F.transform(entries(raw), lambda e: F.struct(F.lower(F.regexp_replace(e["key"], _LETTERS, "")).alias("k"), e["value"].alias("v"))), of)
