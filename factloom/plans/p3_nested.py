"""Problem 3: chains, steps, properties, trace steps and analysis parts as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import json
from factloom.operators.shred import shred
from factloom.store import table

SITE = {"file": "string", "line": "string", "column": "string", "sink_name": "string", "sink_argument": "string"}


def scans(raw: DataFrame) -> DataFrame:
    """scan_result with the variant of analysis given a declared shape; what a site or part has else stays as JSON text."""
    site = lambda x: F.when(json.is_object(x), F.struct(*[F.try_variant_get(x, f"$.{k}", t).alias(k) for k, t in SITE.items()], F.to_json(x).alias("json")))

    def shape(doc):
        sites = F.try_variant_get(doc, "$.object_payload_exclusion.sites", "array<variant>")
        parts = F.transform(F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("part"), F.to_json(e["value"]).alias("json")))
        return F.struct(F.when(json.is_object(doc), parts).alias("parts"), F.struct(F.transform(sites, site).alias("sites")).alias("object_payload_exclusion"))

    return raw.select("scan_id", "repo_id", "report_file", "target_path", "summary", "gadget_chains", json.let(json.parsed(F.col("analysis")), shape).alias("analysis"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All flat tables of both kinds of record. Redelivered rows give the same keys twice; the queries keep one."""
    finding = table(spark, sf_dir, "finding").select("finding_id", "scan_id", "rule_id", "location", "dataflow_trace")
    return shred({"scan": (scans(table(spark, sf_dir, "scan_result")), "scan_id"), "finding": (finding, "finding_id")})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child_kind, owner_id, outer_pos, inner_pos) of every non-null nested object; only keys are shuffled."""
    t = tables(spark, sf_dir)

    def rows(kind: str, name: str, outer, inner):
        return t[name].select(F.lit(kind).alias("child_kind"), "owner_id", outer.cast("int").alias("outer_pos"), inner.cast("int").alias("inner_pos"))

    pos = F.col("pos")
    found = rows("gadget_step", "scan.gadget_chains.steps", pos[0], pos[1])
    found = found.unionAll(rows("trace_step", "finding.dataflow_trace", F.lit(0), pos[0]))
    found = found.unionAll(rows("exclusion_site", "scan.analysis.object_payload_exclusion.sites", F.lit(0), pos[0]))
    return found.distinct()


def _table(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = tables(spark, sf_dir)[name]
        return df.dropDuplicates(["root", "owner_id", "parent", "field", "pos"])

    query.__doc__ = f"The flat table {name}."
    return query


def analysis_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Flat tables of the JSON in ``analysis`` with the shape that its documents have, found by one aggregation over all of them."""
    docs = table(spark, sf_dir, "scan_result").select("scan_id", json.parsed(F.col("analysis")).alias("v")).where(json.is_object(F.col("v")))
    ddl = json.shape(docs, "v")
    if ddl is None or not ddl.startswith("struct"):
        return {}
    return shred({"analysis": (docs.select("scan_id", F.from_json(F.to_json("v"), ddl).alias("s")).select("scan_id", "s.*"), "scan_id")})


def p3_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per analysis document, all objects that occur once inlined (names joined by dots)."""
    t = analysis_tables(spark, sf_dir)
    return t["analysis"].dropDuplicates(["owner_id"]) if t else spark.createDataFrame([], "root string, owner_id bigint")


def p3_analysis_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of ``object_payload_exclusion.sites``, with all fields that any of them has."""
    t = analysis_tables(spark, sf_dir).get("analysis.object_payload_exclusion.sites")
    return t.dropDuplicates(["owner_id", "pos"]) if t is not None else spark.createDataFrame([], "root string, owner_id bigint, pos array<int>")


QUERIES = {
    "p3_analysis": p3_analysis,
    "p3_analysis_sites": p3_analysis_sites,
    "p3_found": p3_found,
    "p3_chains": _table("scan.gadget_chains"),
    "p3_steps": _table("scan.gadget_chains.steps"),
    "p3_properties": _table("scan.gadget_chains.steps.controllable_properties"),
    "p3_trace_steps": _table("finding.dataflow_trace"),
    "p3_locations": _table("shared.location"),
    "p3_analysis_parts": _table("scan.analysis.parts"),
}

_DOC = """doc AS (SELECT DISTINCT scan_id, CASE WHEN json_type(a) = 'VARCHAR' THEN CASE WHEN json_valid(a->>'$') THEN (a->>'$')::JSON END ELSE a END AS j
  FROM (SELECT scan_id, CASE WHEN json_valid(analysis) THEN analysis::JSON END AS a FROM scan_result))"""
_CHAIN = """c AS (SELECT DISTINCT scan_id, i - 1 AS o, gadget_chains[i] AS c FROM scan_result, unnest(range(1, len(gadget_chains) + 1)) t(i)),
s AS (SELECT scan_id, o, i - 1 AS n, c.steps[i] AS s FROM c, unnest(range(1, len(c.steps) + 1)) t(i))"""
_TRACE = "d AS (SELECT DISTINCT finding_id, i - 1 AS n, dataflow_trace[i] AS s FROM finding, unnest(range(1, len(dataflow_trace) + 1)) t(i))"
ORACLE = {
    "p3_found": f"""WITH {_DOC}, {_CHAIN}, {_TRACE}
SELECT 'gadget_step' AS child_kind, scan_id AS owner_id, CAST(o AS INT) AS outer_pos, CAST(n AS INT) AS inner_pos FROM s WHERE s IS NOT NULL
UNION ALL SELECT 'trace_step', finding_id, 0, CAST(n AS INT) FROM d WHERE s IS NOT NULL
UNION ALL SELECT 'exclusion_site', scan_id, 0, CAST(i AS INT) FROM doc, unnest(range(0, CAST(json_array_length(j, '$.object_payload_exclusion.sites') AS BIGINT))) t(i)
WHERE json_type(j, '$.object_payload_exclusion.sites[' || i || ']') = 'OBJECT'""",
    "p3_chains": f"""WITH {_CHAIN} SELECT 'scan' AS root, scan_id AS owner_id, 'scan' AS parent, 'gadget_chains' AS field, [CAST(o AS INT)] AS pos, c.chain_id AS chain_id, c.entry_class AS entry_class,
c.entry_method AS entry_method, c.sink_function AS sink_function, c.sink_type AS sink_type, c.length AS length, c.confidence AS confidence, c.severity AS severity FROM c WHERE c IS NOT NULL""",
    "p3_steps": f"""WITH {_CHAIN} SELECT 'scan' AS root, scan_id AS owner_id, 'scan.gadget_chains' AS parent, 'steps' AS field, [CAST(o AS INT), CAST(n AS INT)] AS pos, s.step_number AS step_number, s.class_name AS class_name,
s.method_name AS method_name, s.step_type AS step_type, s.target_class AS target_class, s.target_method AS target_method, s.code_snippet AS code_snippet FROM s WHERE s IS NOT NULL""",
    "p3_properties": f"""WITH {_CHAIN} SELECT 'scan' AS root, scan_id AS owner_id, 'scan.gadget_chains.steps' AS parent, 'controllable_properties' AS field, [CAST(o AS INT), CAST(n AS INT), CAST(i - 1 AS INT)] AS pos, s.controllable_properties[i] AS value
FROM s, unnest(range(1, len(s.controllable_properties) + 1)) t(i) WHERE s.controllable_properties[i] IS NOT NULL""",
    "p3_trace_steps": f"""WITH {_TRACE} SELECT 'finding' AS root, finding_id AS owner_id, 'finding' AS parent, 'dataflow_trace' AS field, [CAST(n AS INT)] AS pos, s.code_snippet AS code_snippet, s.description AS description, s.variable_name AS variable_name FROM d WHERE s IS NOT NULL""",
    "p3_locations": f"""WITH {_CHAIN}, {_TRACE}, l AS (
SELECT 'scan' AS root, scan_id AS owner_id, 'scan.gadget_chains.steps' AS parent, 'location' AS field, [CAST(o AS INT), CAST(n AS INT)] AS pos, s.location AS l FROM s
UNION ALL SELECT 'finding', finding_id, 'finding.dataflow_trace', 'location', [CAST(n AS INT)], s.location FROM d
UNION ALL SELECT DISTINCT 'finding', finding_id, 'finding', 'location', CAST([] AS INT[]), location FROM finding)
SELECT root, owner_id, parent, field, pos, l.file_path AS file_path, l.start_line AS start_line, l.start_col AS start_col, l.end_line AS end_line, l.end_col AS end_col FROM l WHERE l IS NOT NULL""",
}
