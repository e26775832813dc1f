"""Problem 2: one record per distinct location of a scan, with its copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import canonical, location
from factloom.store import table


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "location_record")
    return t.select(location.key(F.col("scan_id"), F.col("raw")).alias("key"), F.col("record_id").alias("id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copies(keyed(spark, sf_dir)).where("first_id <> id").select("first_id", F.col("id").alias("record_id"))


def p2_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, copies): the representative of each distinct location and the number of its records."""
    return canonical.counts(keyed(spark, sf_dir)).select(F.col("first_id").alias("record_id"), "copies")


def p2_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that went through the salts, by their key's representative: keys that hold a thousandth of the records."""
    hot = canonical.copies(keyed(spark, sf_dir)).where("hot")
    return hot.groupBy("first_id").agg(F.count("*").alias("copies"))


QUERIES = {"p2_found": p2_found, "p2_distinct": p2_distinct, "p2_hot": p2_hot}

_PATH = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_KEYED = rf"""
r AS (SELECT DISTINCT record_id, scan_id, trim(raw, e' \t\n\r ') AS s FROM location_record WHERE record_id IS NOT NULL),
kv AS (
  SELECT record_id, j.key AS k, json_extract_string(j.value, '$') AS v, row_number() OVER () AS o FROM (SELECT * FROM r WHERE starts_with(s, '{{')) x, json_each(x.s) j
  UNION ALL SELECT record_id, regexp_extract(a, '^([^=]*)=', 1), regexp_extract(a, '^[^=]*=\s*"(.*)"$', 1, 's'), 0 FROM (SELECT record_id, unnest(regexp_extract_all(s, '[\w.\-]+\s*=\s*"[^"]*"')) AS a FROM r WHERE starts_with(s, '<'))
  UNION ALL SELECT record_id, regexp_extract(a, '^([^=]*)=', 1), regexp_extract(a, '^[^=]*=(.*)$', 1, 's'), 0 FROM (SELECT record_id, unnest(string_split(s, ';')) AS a FROM r WHERE regexp_matches(s, '^[\p{{L}}_\- .]+='))
  UNION ALL SELECT record_id, regexp_extract(a, '^([^:]*):', 1), regexp_extract(a, '^[^:]*:(.*)$', 1, 's'), 0 FROM (SELECT record_id, unnest(string_split(s, '|')) AS a FROM r WHERE regexp_matches(s, '^[\p{{L}}_\- .]+:'))),
f AS (SELECT record_id, lower(regexp_replace(k, '[^\p{{L}}]', '', 'g')) AS k, v FROM kv WHERE v IS NOT NULL AND v <> ''),
c AS (SELECT r.record_id, r.scan_id,
  coalesce(max({_PATH.format('v')}) FILTER (k = 'filepath'), '') AS a,
  coalesce(max(try_cast(trim(v) AS BIGINT)) FILTER (k = 'startline'), -1) AS b, coalesce(max(try_cast(trim(v) AS BIGINT)) FILTER (k = 'startcol'), -1) AS d,
  coalesce(max(try_cast(trim(v) AS BIGINT)) FILTER (k = 'endline'), -1) AS e, coalesce(max(try_cast(trim(v) AS BIGINT)) FILTER (k = 'endcol'), -1) AS g
  FROM r LEFT JOIN f USING (record_id) GROUP BY 1, 2),
m AS (SELECT record_id, min(record_id) OVER (PARTITION BY scan_id, a, b, d, e, g) AS first_id FROM c)
"""
ORACLE = {
    "p2_found": f"WITH {_KEYED} SELECT first_id, record_id FROM m WHERE first_id <> record_id",
    "p2_hot": f"WITH {_KEYED} SELECT first_id, count(*) AS copies FROM m GROUP BY 1 HAVING count(*) >= greatest(100, ceil((SELECT count(*) FROM location_record WHERE record_id IS NOT NULL) / 1000.0))",
    "p2_distinct": f"WITH {_KEYED} SELECT first_id AS record_id, count(*) AS copies FROM m GROUP BY 1",
}
