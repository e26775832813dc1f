"""Best rows per key, with the flags that tell what a cap left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key. A rank filter above the window lets Spark keep k rows a key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def top_k_flagged(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """As ``top_k``, with ``total`` rows of the key and whether the cap cut any."""
    total = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return top_k(df, keys, order, k).join(total, keys).withColumn("truncated", F.col("total") > k)


def representatives(df: DataFrame, keys: list[str], kind: list[str], order: list[Column], k: int) -> DataFrame:
    """At most ``k`` rows a key: the best of every kind first, then the best of the rest."""
    w = W.partitionBy(*keys, *kind).orderBy(*order)
    lead = df.withColumn("_later", (F.row_number().over(w) > 1).cast("int"))
    return top_k(lead, keys, [F.col("_later"), *order], k).drop("_later")


def best(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row a key, the one with the least ``order``; partial aggregation before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in columns if c not in keys])
