"""Tables of an input folder, and shared scratch tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a local one only on a local master.

    A folder of one machine would lose the tables with it, so a cluster without the setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


class Scratch:
    """Written tables in the shared folder. ``drop`` deletes those that nothing reads any more; the rest goes with the session."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        root, fs = self._hadoop(self.root)
        fs.deleteOnExit(root)

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a reader of the copy, free of the earlier plan."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def cut_counting(self, df: DataFrame, *which: Column) -> tuple[DataFrame, list[int]]:
        """As ``cut``, with the number of rows for which each of ``which`` holds, counted by the same job."""
        seen = Observation()
        out = self.cut(df.observe(seen, *[F.count_if(w).alias(f"n{i}") for i, w in enumerate(which)]))
        return out, [seen.get.get(f"n{i}") or 0 for i in range(len(which))]

    def union(self, frames: list[DataFrame]) -> DataFrame:
        """One scan over several written tables of the same schema."""
        return self.spark.read.schema(frames[0].schema).parquet(*[self._paths[id(f)] for f in frames])

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path:
                p, fs = self._hadoop(path)
                fs.delete(p, True)


def spread(df: DataFrame, key: str, per_core: int = 3) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core, for work that costs far more than a shuffle of its rows.

    A large input already has them and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= per_core * cores:
        return df
    return df.repartition(per_core * cores, key)


def once(df: DataFrame, key: str, few: int = 100_000) -> DataFrame:
    """One row per ``key``; of several the smallest, field by field. Null keys stay as they are.

    Only keys are shuffled to find the repeated ones. If those are at most ``few`` (counted first), their rows alone are
    reduced and the wide rows of all others stay where they are; else all rows are reduced by key.
    """
    rest = [c for c in df.columns if c != key]
    again = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    n = again.limit(few + 1).count()
    if not n:
        return df

    def least(d: DataFrame) -> DataFrame:
        return d.groupBy(key).agg(F.min(F.struct(*rest)).alias("v")).select(*[F.col(f"v.{c}") if c != key else F.col(key) for c in df.columns])

    if n > few:
        return least(df.where(F.col(key).isNotNull())).unionByName(df.where(F.col(key).isNull()))
    again = F.broadcast(again)
    return df.join(again, key, "left_anti").select(df.columns).unionByName(least(df.join(again, key, "left_semi").select(df.columns)))
