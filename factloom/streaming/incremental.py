"""Operators over streams: files as they arrive, and counts of errors within windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.code.facts import SCHEMA, _arrow_schema, _extract


def facts_stream(files: DataFrame) -> DataFrame:
    """Facts of a stream of files(file_id, repo_id, file_path, content); parsing keeps no state."""
    f = files.select(F.col("file_id").cast("bigint"), F.col("repo_id").cast("int"), F.col("file_path").alias("path"), "content")
    return f.mapInArrow(_extract(_arrow_schema()), SCHEMA)


def error_counts(errors: DataFrame, at: str, window: str, late: str) -> DataFrame:
    """Errors per phase and window of event time; late rows are counted until the watermark."""
    phase = F.lower(F.trim("phase"))
    return errors.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), phase.alias("phase")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "phase", "n")


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in memory (tests and small results)."""
    q: StreamingQuery = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of Parquet files with the schema that they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
