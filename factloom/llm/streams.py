"""Copies over a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import location


def first_copies(records: DataFrame, at: str, late: str) -> DataFrame:
    """The first record of each canonical location within a watermark; state is dropped once the watermark has passed."""
    keyed = records.withColumn("key", location.key(F.col("scan_id"), F.col("raw")))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["key"])
