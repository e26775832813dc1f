"""JSON texts as variants, JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAPS = 4


def let(c: Column, f) -> Column:
    """``f`` of ``c``, with ``c`` evaluated once however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def _one(c: Column) -> Column:
    arr = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return let(arr, lambda a: F.when(F.size(a) == 1, a[0]))


def _bare(c: Column, wraps: int) -> Column:
    if not wraps:
        return c
    return let(c, lambda v: F.when(F.schema_of_variant(v) == "STRING", _bare(_one(F.try_variant_get(v, "$", "string")), wraps - 1)).otherwise(v))


def parsed(text: Column, wraps: int = WRAPS) -> Column:
    """The variant of a complete JSON text, else null.

    JSON inside a JSON string is unwrapped, up to ``wraps`` times. Text after the value makes it incomplete (the text is
    parsed as the only element of an array), as does an object that repeats a key.
    """
    return _bare(_one(text), wraps)


def is_object(v):
    return F.schema_of_variant(v).startswith("OBJECT")


def shape(df, column: str) -> str | None:
    """The type of all objects in a variant column as DDL, from one aggregation; a field of several kinds is left as text. None if there are none."""
    found = df.where(is_object(F.col(column))).agg(F.schema_of_variant_agg(column).alias("s")).first().s
    return _ddl(found) if found and found.startswith("OBJECT") else None


_TOKEN = re.compile(r"`(?:[^`]|``)*`|[<>,:]|[^<>,:`]+")


def _ddl(text: str) -> str:
    """A variant's schema as DDL: OBJECT is a struct, VOID and VARIANT are text, keys are quoted."""
    tokens = [t.strip() for t in _TOKEN.findall(re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", text))]
    tokens = [t for t in tokens if t]
    at = 0

    def kind() -> str:
        nonlocal at
        word = tokens[at]
        at += 1
        if word == "ARRAY":
            at += 1
            inner = kind()
            at += 1
            return f"array<{inner}>"
        if word != "OBJECT":
            return "string" if word in ("VOID", "VARIANT") else word.lower()
        fields = []
        if at < len(tokens) and tokens[at] == "<":
            at += 1
            while tokens[at] != ">":
                name = tokens[at]
                at += 2
                fields.append((name if name.startswith("`") else f"`{name}`") + ":" + kind())
                if tokens[at] == ",":
                    at += 1
            at += 1
        return f"struct<{','.join(fields)}>" if fields else "string"

    return kind()
