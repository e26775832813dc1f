"""Text normal forms as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_name(c: Column) -> Column:
    """Class name without letter case, surrounding white space and leading backslashes; a run of backslashes is one. Empty becomes null."""
    c = F.regexp_replace(c, r"^[\s\p{Z}\\]+|[\s\p{Z}]+$", "")
    c = F.lower(F.regexp_replace(c, r"\\{2,}", r"\\"))
    return F.when(c != "", c)


def letters_digits(c: Column) -> Column:
    """The letters and digits of a text, lower case, in order."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
