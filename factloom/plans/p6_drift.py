"""Problem 6: analysis and metadata whose fields drift from report file to report file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import drift
from factloom.store import Scratch, once, table

#: Arrays of objects, by key.
ARRAYS = ("sites",)
#: Values of fields that a record does not hold.
DEFAULTS = {"analysis": {"library_mode": False, "summary_rounds": 0}, "metadata": {"flow_evidence_truncated": False, "analysis_status": "unknown"}}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "scan_result").select(F.lit("analysis").alias("record_kind"), F.col("scan_id").alias("record_id"), "exporter", "file_seq", F.col("analysis").alias("text"))
    f = table(spark, sf_dir, "finding").select(F.lit("metadata").alias("record_kind"), F.col("finding_id").alias("record_id"), "exporter", "file_seq", F.col("metadata").alias("text"))
    return s.unionAll(f)


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: the steps read it several times, and the texts are parsed only here."""
    return Scratch(spark, "p6").cut(drift.versions(records(spark, sf_dir), ARRAYS))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(_versions(spark, sf_dir)).select("record_kind", "exporter", F.col("file_seq").cast("int").alias("file_seq"), "field_path", "change_kind")


def p6_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with its new path and types."""
    return drift.changes(_versions(spark, sf_dir))


def p6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.fingerprints(_versions(spark, sf_dir))


def _conformed(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = once(records(spark, sf_dir).where(F.col("record_kind") == kind), "record_id")
        fields = _versions(spark, sf_dir)
        named = Scratch(spark, "p6n").cut(drift.names(fields, drift.changes(fields)))
        return drift.conform(rows, named, kind, drift.schema_of(fields, named, kind), DEFAULTS[kind], ARRAYS)

    query.__doc__ = f"The consistent table of {kind} records; its columns are the fields of all files."
    return query


QUERIES = {"p6_found": p6_found, "p6_steps": p6_steps, "p6_fingerprints": p6_fingerprints, "p6_analysis": _conformed("analysis"), "p6_metadata": _conformed("metadata")}

_SQL = """WITH RECURSIVE raw AS (
  SELECT 'analysis' AS record_kind, exporter, file_seq, analysis AS t FROM scan_result UNION ALL SELECT 'metadata', exporter, file_seq, metadata FROM finding),
doc AS (SELECT record_kind, exporter, file_seq, CASE WHEN json_type(a) = 'VARCHAR' THEN CASE WHEN json_valid(a->>'$') THEN (a->>'$')::JSON END ELSE a END AS j
  FROM (SELECT record_kind, exporter, file_seq, CASE WHEN json_valid(t) THEN t::JSON END AS a FROM raw)),
node AS (
  SELECT record_kind, exporter, file_seq, '' AS prefix, j, false AS last FROM doc WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT n.record_kind, n.exporter, n.file_seq, CASE WHEN json_type(e.value) = 'OBJECT' THEN n.prefix || e.key || '.' ELSE n.prefix || e.key END,
    e.value, json_type(e.value) <> 'OBJECT' FROM node n, json_each(n.j) e WHERE NOT n.last AND json_type(e.value) <> 'NULL'),
leaf AS (
  SELECT record_kind, exporter, file_seq, prefix AS path, CASE json_type(j) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END AS type
  FROM node WHERE last AND prefix <> 'sites' AND prefix NOT LIKE '%.sites'
  UNION ALL SELECT n.record_kind, n.exporter, n.file_seq, n.prefix || '[].' || f.key, CASE json_type(f.value) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END
  FROM node n, json_each(n.j) e, json_each(e.value) f WHERE n.last AND (n.prefix = 'sites' OR n.prefix LIKE '%.sites') AND json_type(e.value) = 'OBJECT' AND json_type(f.value) <> 'NULL'),
field AS (SELECT record_kind, exporter, file_seq, path, string_agg(DISTINCT type, '|' ORDER BY type) AS type FROM leaf GROUP BY ALL),
ord AS (SELECT *, lead(file_seq) OVER (PARTITION BY record_kind, exporter ORDER BY file_seq) AS nxt FROM (SELECT DISTINCT record_kind, exporter, file_seq FROM raw)),
old AS (SELECT f.record_kind, f.exporter, o.nxt AS file_seq, f.path, f.type FROM field f JOIN ord o USING (record_kind, exporter, file_seq) WHERE o.nxt IS NOT NULL),
new AS (SELECT f.* FROM field f JOIN ord o ON f.record_kind = o.record_kind AND f.exporter = o.exporter AND f.file_seq = o.nxt),
met AS (SELECT record_kind, exporter, file_seq, path, old.type AS ot, new.type AS nt FROM old FULL JOIN new USING (record_kind, exporter, file_seq, path) WHERE old.type IS DISTINCT FROM new.type),
mv AS (SELECT *, regexp_extract(path, '^(.*)\\.[^.]*$', 1) AS parent, coalesce(ot, nt) AS type FROM met WHERE ot IS NULL OR nt IS NULL),
g AS (SELECT *, count(ot) OVER w AS gone, count(nt) OVER w AS came FROM mv WINDOW w AS (PARTITION BY record_kind, exporter, file_seq, parent, type))
"""
_CHANGES = """SELECT record_kind, exporter, CAST(file_seq AS INT) AS file_seq, path AS field_path, 'retyped' AS change_kind FROM met WHERE ot IS NOT NULL AND nt IS NOT NULL
UNION ALL SELECT record_kind, exporter, CAST(file_seq AS INT), path, CASE WHEN gone = 1 AND came = 1 THEN 'renamed' WHEN ot IS NOT NULL THEN 'removed' ELSE 'added' END FROM g WHERE NOT (gone = 1 AND came = 1 AND nt IS NOT NULL)"""
_STEPS = """SELECT record_kind, exporter, file_seq, path AS field_path, 'retyped' AS change_kind, NULL AS new_path, ot AS old_type, nt AS new_type FROM met WHERE ot IS NOT NULL AND nt IS NOT NULL
UNION ALL SELECT record_kind, exporter, file_seq, max(path) FILTER (ot IS NOT NULL), 'renamed', max(path) FILTER (nt IS NOT NULL), type, type FROM g WHERE gone = 1 AND came = 1 GROUP BY record_kind, exporter, file_seq, parent, type
UNION ALL SELECT record_kind, exporter, file_seq, path, CASE WHEN ot IS NOT NULL THEN 'removed' ELSE 'added' END, NULL, ot, nt FROM g WHERE NOT (gone = 1 AND came = 1)"""
_PRINTS = """SELECT o.record_kind, o.exporter, o.file_seq, count(f.path) AS fields, sha256(coalesce(string_agg(f.path || ':' || f.type, e'\n' ORDER BY f.path || ':' || f.type), '')) AS fingerprint
FROM ord o LEFT JOIN field f USING (record_kind, exporter, file_seq) WHERE o.exporter IS NOT NULL AND o.file_seq IS NOT NULL GROUP BY 1, 2, 3"""
ORACLE = {"p6_found": _SQL + _CHANGES, "p6_steps": _SQL + _STEPS, "p6_fingerprints": _SQL + _PRINTS}
