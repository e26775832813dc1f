"""Copies hidden by formatting: exact canonical keys, grouped in two levels where a key is hot.

Hot keys are found exactly by partial counts: rows are counted by hash bucket (a few thousand counters per task), then by
key hash inside the buckets that reach the threshold. A key is hot if it holds a ``parts``-th of the rows and ``FLOOR`` rows
at least, so there are at most ``parts`` hot hashes, and what is broadcast of them (hashes, digests, least ids) has a fixed
size a key. Rows of hot keys are spread over salts and reduced salt by salt, then key by key; the others go through one
shuffle by key. Two keys of one hash only take the same way; rows are grouped by the whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.store import Scratch

PARTS, BUCKETS, SALTS = 1000, 8192, 64
#: A key of fewer rows than this is not hot, however small the table; one task takes it without trouble.
FLOOR = 100


def hot_hashes(keyed: DataFrame, parts: int = PARTS, floor: int = FLOOR) -> list[int]:
    """Hashes of the keys of ``keyed(key, h, id)`` with at least max(``floor``, a ``parts``-th) of the rows; at most ``parts``."""
    bucket = F.pmod("h", F.lit(BUCKETS))
    by = keyed.where("key IS NOT NULL").groupBy(bucket.alias("b")).count().collect()  # BUCKETS integers at most
    least = max(floor, -(-sum(r["count"] for r in by) // parts))
    big = [r.b for r in by if r["count"] >= least]
    if not big:
        return []
    rows = keyed.where(F.col("key").isNotNull() & bucket.isin(big)).groupBy("h").count().where(F.col("count") >= least).select("h")
    return [r.h for r in rows.collect()]


def copies(keyed: DataFrame, parts: int = PARTS, floor: int = FLOOR, salts: int = SALTS) -> DataFrame:
    """Of ``keyed(key, id)``: (first_id, id, hot) for every distinct id, first_id the smallest id of the same key.

    Rows with a null key are each their own first. Ids that are null are left out. Repeated (key, id) rows count once.
    ``hot`` tells which way a row went. Keys are computed once and written to the shared folder.
    """
    store = Scratch(keyed.sparkSession, "copies")
    keyed = store.cut(keyed.where("id IS NOT NULL").select("key", F.xxhash64("key").alias("h"), "id"))
    hot = keyed.sparkSession.createDataFrame([(h,) for h in hot_hashes(keyed, parts, floor)], "h bigint")
    yes, no = F.lit(True).alias("hot"), F.lit(False).alias("hot")
    lone = keyed.where("key IS NULL").select(F.col("id").alias("first_id"), "id", no).distinct()
    held = keyed.where("key IS NOT NULL")
    # in order of the ids the first is the least, and a repeated row follows its like
    by = W.partitionBy("key").orderBy("id")
    cold = held.join(F.broadcast(hot), "h", "left_anti").select("id", F.first("id").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("first_id"), F.lag("id").over(by).alias("before"))
    cold = cold.where("before IS NULL OR before <> id").select("first_id", "id", no)
    warm = held.join(F.broadcast(hot), "h", "left_semi").select(F.sha2("key", 256).alias("digest"), "id", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    each = warm.groupBy("digest", "salt", "id").agg(F.lit(1).alias("one"))
    least = warm.groupBy("digest", "salt").agg(F.min("id").alias("m")).groupBy("digest").agg(F.min("m").alias("first_id"))
    return cold.unionAll(each.join(F.broadcast(least), "digest").select("first_id", "id", yes)).unionAll(lone)


def counts(keyed: DataFrame, parts: int = PARTS, floor: int = FLOOR, salts: int = SALTS) -> DataFrame:
    """Of ``keyed(key, id)``: (first_id, copies), one row per key, by the same two ways."""
    return copies(keyed, parts, floor, salts).groupBy("first_id").agg(F.count("*").alias("copies"))
