"""Reaching writes: what an ordered scan of writes and reads of one storage sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_before(df: DataFrame, keys: list[str], order: list[str], is_write: Column, value: Column, name: str = "reaching") -> DataFrame:
    """For each row the value of the last write before it; null if there is none."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_write, value), ignorenulls=True).over(w))


def may_writes(df: DataFrame, keys: list[str], order: list[str], strong: Column, weak: Column) -> DataFrame:
    """Weak writes that are still visible at the end: those after the last strong write of their key."""
    at = F.struct(*order)
    last = df.where(strong).groupBy(*keys).agg(F.max(at).alias("_last"))
    return df.where(weak).join(last, keys, "left").where(F.col("_last").isNull() | (at > F.col("_last"))).drop("_last")


def interval_owner(points: DataFrame, scopes: DataFrame, keys: list[str], at: str, start: str, scope_id: str) -> DataFrame:
    """The latest scope that starts at or before each point, by one pass over points and starts sorted together."""
    p = points.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)).withColumn("_scope", F.lit(None).cast(scopes.schema[scope_id].dataType))
    s = scopes.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(scope_id).alias("_scope"))
    both = p.unionByName(s, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("_at", "_kind", "_scope").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(scope_id, F.last("_scope", ignorenulls=True).over(w)).where("_kind = 1").drop("_at", "_kind", "_scope")


def suppress(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, slack: int, bucket: int = 64) -> DataFrame:
    """Points in no span widened by ``slack``: an anti join on buckets of the range, so that each point meets near spans only."""
    s = spans.select(*keys, F.col(start).alias("_s"), (F.col(end) + slack).alias("_e")).where("_s <= _e")
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket), F.floor(F.col("_e") / bucket)))).distinct()
    p = points.withColumn("_b", F.floor(F.col(at) / bucket)).alias("p")
    on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_b"]] + [F.col(f"p.{at}") >= F.col("s._s"), F.col(f"p.{at}") <= F.col("s._e")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return p.join(s.alias("s"), cond, "left_anti").drop("_b")


def innermost(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans that hold no other span of their key. In order of start, longest first, a span holds another exactly if a
    later span ends within it, so a running minimum of the ends that follow decides; the order is reversed, so that it grows."""
    w = W.partitionBy(*keys).orderBy(F.col(start).desc(), F.col(end)).rowsBetween(W.unboundedPreceding, -1)
    return spans.dropDuplicates([*keys, start, end]).withColumn("_m", F.min(end).over(w)).where(F.col("_m").isNull() | (F.col("_m") > F.col(end))).drop("_m")
