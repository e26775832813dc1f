"""Problem 5: sinks that two systems do not agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import compare
from factloom.store import table

FIELDS = ["file_path", "start_line", "start_col", "sink_name", "sink_argument", "disposition"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "sink_inventory"), table(spark, sf_dir, "sink_inventory_copy")
    return compare.differences(a, b, "sink_id", FIELDS).select(F.col("key").alias("sink_id"), "difference")


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each kind of difference."""
    return p5_found(spark, sf_dir).groupBy("difference").agg(F.count("*").alias("sinks"))


def p5_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence totals by the bitmaps of both systems."""
    a, b = table(spark, sf_dir, "sink_inventory"), table(spark, sf_dir, "sink_inventory_copy")
    p = compare.presence(a, b, "sink_id")
    return p.agg(F.sum("ordinals").alias("keys"), *[F.sum(c).alias(c) for c in ("only_in_first", "only_in_second", "in_both")])


QUERIES = {"p5_found": p5_found, "p5_summary": p5_summary, "p5_presence": p5_presence}

_ONE = "SELECT sink_id, {0} FROM {1} GROUP BY sink_id"
_COLS = ", ".join(f"max({f}) AS {f}" for f in FIELDS)
_FOUND = f"""WITH a AS (SELECT sink_id, {_COLS} FROM sink_inventory GROUP BY 1), b AS (SELECT sink_id, {_COLS} FROM sink_inventory_copy GROUP BY 1)
SELECT sink_id, 'only_in_first' AS difference FROM a WHERE sink_id NOT IN (SELECT sink_id FROM b)
UNION ALL SELECT sink_id, 'only_in_second' FROM b WHERE sink_id NOT IN (SELECT sink_id FROM a)
""" + "".join(f"UNION ALL SELECT a.sink_id, '{f}' FROM a JOIN b USING (sink_id) WHERE a.{f} IS DISTINCT FROM b.{f}\n" for f in FIELDS)
ORACLE = {
    "p5_found": _FOUND,
    "p5_summary": f"SELECT difference, count(*) AS sinks FROM ({_FOUND}) GROUP BY 1",
    "p5_presence": """WITH k AS (SELECT sink_id, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT sink_id, 1 AS s FROM sink_inventory UNION ALL SELECT sink_id, 2 FROM sink_inventory_copy) GROUP BY 1)
SELECT count(*) AS keys, count(*) FILTER (a AND NOT b) AS only_in_first, count(*) FILTER (b AND NOT a) AS only_in_second, count(*) FILTER (a AND b) AS in_both FROM k""",
}
