"""Answers of a reviewer that should contain one JSON object, read with tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(text: Column) -> Column:
    """The text from the first opening to the last closing brace, without fences and prose around it."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def confidence(text: Column) -> Column:
    """A number in [0, 1] from ``0.85``, ``"0.85"``, ``85`` or ``"85%"``; null otherwise."""
    t = F.trim(text)
    n = F.regexp_replace(t, "%$", "").try_cast("double")
    n = F.when(t.endswith("%") | (n > 1), n / 100).otherwise(n)
    return F.when(n.between(0, 1), n)


def flag(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


def string_list(text: Column) -> Column:
    """An array of strings; a scalar becomes a list of one, null an empty list."""
    arr = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.startswith("["), arr).otherwise(F.array(text))
