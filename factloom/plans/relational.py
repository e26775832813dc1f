"""Queries of the generic operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import paths, pattern, verdict
from factloom.functions.text import class_name
from factloom.operators import asof, graph, ranking
from factloom.store import once, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
MAGIC = ("__destruct", "__wakeup", "__unserialize", "__toString", "__call", "__get")
#: Function names by category, in order of priority; a name in two categories has the first (fixed values).
CATEGORIES = {
    "RCE": "eval assert system exec passthru shell_exec popen proc_open pcntl_exec create_function",
    "DYNAMIC_INVOCATION": "call_user_func call_user_func_array forward_static_call forward_static_call_array",
    "FILE_WRITE": "file_put_contents fwrite fputs touch",
    "FILE_DELETE": "unlink rmdir",
    "FILE_READ_INCLUDE": "file_get_contents readfile file fopen show_source highlight_file include include_once require require_once",
    "DESERIALIZATION": "unserialize",
    "PHAR_TRIGGER": "file_exists is_file is_dir is_readable is_writable is_executable filectime filemtime fileatime filesize stat lstat exif_read_data exif_thumbnail exif_imagetype md5_file sha1_file hash_file hash_hmac_file getimagesize get_meta_tags simplexml_load_file copy rename",
}
SEVERITY = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _case(column, values: dict, default=None):
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def category(name):
    """Category of a function name by the priority list."""
    out = F.lit(None).cast("string")
    for k, v in reversed(list(CATEGORIES.items())):
        out = F.when(F.lower(name).isin(*v.split()), k).otherwise(out)
    return out


def _sql_case(column: str, values: dict) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


def _findings(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Findings once each; ``metadata`` only where asked for."""
    return once(table(spark, sf_dir, "finding").select("finding_id", "scan_id", "rule_id", "vuln_type", "severity", "confidence", F.col("location.file_path").alias("path"), F.col("location.start_line").alias("line"), F.col("location.start_col").alias("col"), *more), "finding_id")


_F = "f AS (SELECT DISTINCT finding_id, scan_id, rule_id, vuln_type, severity, confidence, location.file_path AS path, location.start_line AS line, location.start_col AS col FROM finding)"
_RANK = _sql_case("severity", SEVERITY)


# -- sources and scalar functions ------------------------------------------------------------------------------------
@query("""SELECT file_id, lower(regexp_extract(file_path, '\\.[^./]*$')) AS extension FROM (SELECT DISTINCT file_id, file_path FROM source_file)
WHERE regexp_matches(lower(file_path), '\\.(php|inc|module|phtml|tpl)$') AND NOT list_has_any(list_slice(string_split(lower(file_path), '/'), 1, -2), ['tests', 'packages'])""")
def q_discover_files(spark, sf_dir):
    """Discovery: extension allow-list, directories pruned at every level."""
    t = table(spark, sf_dir, "source_file").select("file_id", "file_path").distinct()
    keep = paths.has_extension(F.col("file_path")) & paths.outside(F.col("file_path"), ("tests", "packages"))
    return t.where(keep).select("file_id", F.lower(F.regexp_extract("file_path", r"\.[^./]*$", 0)).alias("extension"))


@query("""SELECT file_id, 'resource_limit' AS phase, 'larger than 2000 bytes' AS message FROM (SELECT DISTINCT file_id, octet_length(content) AS n FROM source_file) WHERE n > 2000
UNION ALL SELECT error_id, phase, message FROM (SELECT DISTINCT error_id, phase, message FROM scan_error) WHERE phase = 'discovery'""")
def q_size_gate(spark, sf_dir):
    """Files over the limit are skipped and reported, beside the errors of discovery."""
    t = table(spark, sf_dir, "source_file").select("file_id", F.octet_length("content").alias("n")).distinct().where("n > 2000")
    e = table(spark, sf_dir, "scan_error").where("phase = 'discovery'").select("error_id", "phase", "message").distinct()
    return t.select("file_id", F.lit("resource_limit").alias("phase"), F.lit("larger than 2000 bytes").alias("message")).unionAll(e)


@query("""SELECT sink_id, CASE WHEN file_path IS NULL THEN 'external' WHEN list_has_any(s, ['test','tests','testing','phpunit','spec']) THEN 'tests' WHEN list_has_any(s, ['example','examples','demo','demos','sample','samples']) THEN 'examples'
WHEN list_contains(s, 'vendor') THEN 'vendor' ELSE 'production' END AS scope FROM (SELECT DISTINCT sink_id, file_path, string_split(replace(lower(file_path), '\\', '/'), '/') AS s FROM sink_inventory)""")
def q_source_scope(spark, sf_dir):
    t = table(spark, sf_dir, "sink_inventory").select("sink_id", "file_path").distinct()
    return t.select("sink_id", paths.scope(F.col("file_path")).alias("scope"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, e'\n') AS s FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, min(n) AS hit FROM l WHERE contains(line, 'unserialize(') GROUP BY 1)
SELECT h.doc_id, h.hit AS line, string_agg(CASE WHEN l.n = h.hit THEN '> ' ELSE '  ' END || lpad(CAST(l.n AS VARCHAR), 4, ' ') || ' | ' || l.line, e'\n' ORDER BY l.n) AS snippet FROM h JOIN l ON l.doc_id = h.doc_id AND l.n BETWEEN h.hit - 2 AND h.hit + 2 GROUP BY 1, 2""")
def q_line_snippet(spark, sf_dir):
    """The first hit of a text with two lines of context, inside the row: no lines table is shuffled."""
    lines = F.split("text", "\n", -1)
    t = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("unserialize("))).select("doc_id", lines.alias("ls"))
    hit = F.array_position(F.transform("ls", lambda x: F.contains(x, F.lit("unserialize("))), True)
    t = t.withColumn("hit", hit)
    at = F.sequence(F.greatest(F.col("hit") - 2, F.lit(1).cast("bigint")), F.least(F.col("hit") + 2, F.size("ls").cast("bigint")))
    row = F.transform(at, lambda n: F.concat(F.when(n == F.col("hit"), "> ").otherwise("  "), F.lpad(n.cast("string"), 4, " "), F.lit(" | "), F.element_at("ls", n.cast("int"))))
    return t.select("doc_id", F.col("hit").alias("line"), F.array_join(row, "\n").alias("snippet"))


@query("""SELECT scan_id, tool_version, list_slice(list_concat(list_transform(string_split(tool_version, '.'), lambda x: CAST(x AS INT)), [0, 0, 0, 0]), 1, 4) >= [0, 6, 0, 0] AS at_least FROM (SELECT DISTINCT scan_id, tool_version FROM scan_result)
WHERE regexp_matches(tool_version, '^\\d+(\\.\\d+)*$')""")
def q_version_gate(spark, sf_dir):
    t = table(spark, sf_dir, "scan_result").select("scan_id", "tool_version").distinct()
    v = paths.version(F.col("tool_version"))
    return t.where(v.isNotNull()).select("scan_id", "tool_version", (v >= paths.version(F.lit("0.6"))).alias("at_least"))


@query("""WITH d AS (SELECT DISTINCT finding_id, i - 1 AS n, dataflow_trace[i].code_snippet AS s FROM finding, unnest(range(1, len(dataflow_trace) + 1)) t(i) WHERE dataflow_trace[i] IS NOT NULL)
SELECT finding_id, CAST(n AS INT) AS step, regexp_extract(s, '^\\$(\\w+) = (\\w+)\\(\\$(\\w+)\\);$', 2) AS callee, '$' || regexp_extract(s, '^\\$(\\w+) = (\\w+)\\(\\$(\\w+)\\);$', 3) || ' reaches ' || regexp_extract(s, '^\\$(\\w+) = (\\w+)\\(\\$(\\w+)\\);$', 2) AS message
FROM d WHERE regexp_matches(s, '^\\$(\\w+) = (\\w+)\\(\\$(\\w+)\\);$') AND regexp_extract(s, '^\\$(\\w+) = ', 1) = regexp_extract(s, '\\(\\$(\\w+)\\);$', 1)""")
def q_pattern_bindings(spark, sf_dir):
    """A pattern that uses a metavariable twice, its bindings, and the message made from them."""
    t = table(spark, sf_dir, "finding").select("finding_id", F.posexplode("dataflow_trace").alias("step", "s")).select("finding_id", "step", F.col("s.code_snippet").alias("c")).where("c IS NOT NULL").distinct()
    b = pattern.bindings(F.col("c"), "$X = $FUNC($X);")
    return t.select("finding_id", "step", b.alias("b")).where("b IS NOT NULL").select("finding_id", "step", F.col("b")["$FUNC"].alias("callee"), pattern.message(F.lit("$X reaches $FUNC"), F.col("b")).alias("message"))


@query("""SELECT sink_name, CASE WHEN sink_name IS NULL THEN NULL """ + "".join(f"WHEN lower(sink_name) IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}' " for k, v in CATEGORIES.items()) + """END AS category, count(DISTINCT sink_id) AS sinks FROM sink_inventory GROUP BY 1""")
def q_sink_category(spark, sf_dir):
    t = table(spark, sf_dir, "sink_inventory").groupBy("sink_name").agg(F.count_distinct("sink_id").alias("sinks"))
    return t.select("sink_name", category(F.col("sink_name")).alias("category"), "sinks")


@query("""WITH p AS (SELECT DISTINCT class_id, string_split(full_name, '\\') AS f FROM class_symbol WHERE full_name IS NOT NULL)
SELECT class_id, CASE WHEN len(f) <= 3 THEN f ELSE list_concat(list_slice(f, 1, 2), [NULL]) END AS widened, CASE WHEN len(f) <= 3 THEN f ELSE list_concat(list_slice(f, 1, 1), list_slice(f, -2, -1)) END AS trace FROM p""")
def q_widen_fields(spark, sf_dir):
    t = table(spark, sf_dir, "class_symbol").where("full_name IS NOT NULL").select("class_id", F.split("full_name", r"\\").alias("f")).distinct()
    return t.select("class_id", paths.widen(F.col("f"), 3).alias("widened"), paths.truncate(F.col("f"), 3).alias("trace"))


@query("""SELECT finding_id, sha2 AS route_id FROM (SELECT DISTINCT finding_id, substr(sha256(concat_ws(chr(31), coalesce('=' || scan_id, '-'), coalesce('=' || rule_id, '-'), coalesce('=' || location.file_path, '-'), coalesce('=' || location.start_line, '-'))), 1, 16) AS sha2 FROM finding)""")
def q_route_ids(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.select("finding_id", paths.identity(F.col("scan_id"), F.col("rule_id"), F.col("path"), F.col("line")).alias("route_id"))


@query("""WITH t AS (SELECT DISTINCT finding_id, metadata AS m FROM finding WHERE metadata IS NOT NULL),
j AS (SELECT finding_id, CASE WHEN json_valid(s) THEN s::JSON END AS o FROM (SELECT finding_id, nullif(regexp_extract('Verdict: ```json' || m || '``` done', '(\\{.*\\})', 1, 's'), '') AS s FROM t))
SELECT finding_id, json_extract_string(o, '$.sink_name') AS sink_name, CASE WHEN lower(json_extract_string(o, '$.flow_evidence_truncated')) IN ('true', 'yes', '1') THEN true WHEN lower(json_extract_string(o, '$.flow_evidence_truncated')) IN ('false', 'no', '0') THEN false END AS truncated FROM j WHERE o IS NOT NULL""")
def q_json_verdict(spark, sf_dir):
    """The one JSON object in a reviewer's answer with fence and prose around it, with scalars in several spellings."""
    t = once(table(spark, sf_dir, "finding").select("finding_id", "metadata"), "finding_id").where("metadata IS NOT NULL")
    obj = verdict.json_object(F.concat(F.lit("Verdict: ```json"), "metadata", F.lit("``` done")))
    v = t.select("finding_id", F.try_parse_json(obj).alias("v")).where("v IS NOT NULL")
    return v.select("finding_id", F.try_variant_get("v", "$.sink_name", "string").alias("sink_name"), verdict.flag(F.try_variant_get("v", "$.flow_evidence_truncated", "string")).alias("truncated"))


# -- joins ------------------------------------------------------------------------------------------------------------
_NAME = r"nullif(lower(regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}\\]+|[\s\p{{Z}}]+$', '', 'g'), '\\{{2,}}', '\\', 'g')), '')"
_CLS = f"""c AS (SELECT DISTINCT class_id, repo_id, {_NAME.format('full_name')} AS fq, lower(name) AS short, {_NAME.format('namespace')} AS ns, {_NAME.format('parent_class')} AS wanted, file_path FROM class_symbol),
byfq AS (SELECT repo_id, fq, min(class_id) AS hit FROM c GROUP BY 1, 2), byshort AS (SELECT repo_id, short, min(class_id) AS hit FROM c GROUP BY 1, 2 HAVING count(DISTINCT fq) = 1)"""


def _classes(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "class_symbol")
    return t.select("class_id", "repo_id", class_name(F.col("full_name")).alias("fq"), F.lower("name").alias("short"), class_name(F.col("namespace")).alias("ns"), class_name(F.col("parent_class")).alias("wanted"), "file_path").distinct()


@query(f"""WITH {_CLS} SELECT c.class_id, coalesce(a.hit, b.hit, s.hit) AS target, CASE WHEN a.hit IS NOT NULL THEN 'namespace' WHEN b.hit IS NOT NULL THEN 'absolute' WHEN s.hit IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS how
FROM c LEFT JOIN byfq a ON a.repo_id = c.repo_id AND a.fq = c.ns || '\\' || c.wanted LEFT JOIN byfq b ON b.repo_id = c.repo_id AND b.fq = c.wanted LEFT JOIN byshort s ON s.repo_id = c.repo_id AND s.short = c.wanted WHERE c.wanted IS NOT NULL""")
def q_ordered_resolution(spark, sf_dir):
    """Class names in order: in the namespace, absolute, as a short name that is not ambiguous; the first that is there wins."""
    c = _classes(spark, sf_dir)
    by_fq = c.groupBy("repo_id", F.col("fq").alias("key")).agg(F.min("class_id").alias("hit"))
    by_short = c.groupBy("repo_id", F.col("short").alias("key")).agg(F.min("class_id").alias("hit"), F.count_distinct("fq").alias("n")).where("n = 1").drop("n")
    out = c.where("wanted IS NOT NULL")
    for name, key, side in (("a", F.concat("ns", F.lit("\\"), "wanted"), by_fq), ("b", F.col("wanted"), by_fq), ("s", F.col("wanted"), by_short)):
        out = out.withColumn("key", key).join(side.withColumnRenamed("hit", name), ["repo_id", "key"], "left").drop("key")
    how = F.when(F.col("a").isNotNull(), "namespace").when(F.col("b").isNotNull(), "absolute").when(F.col("s").isNotNull(), "alias").otherwise("unresolved")
    return out.select("class_id", F.coalesce("a", "b", "s").alias("target"), how.alias("how"))


@query(f"""WITH {_CLS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, fq ORDER BY CASE WHEN list_has_any(string_split(lower(file_path), '/'), ['test','tests','testing','phpunit','spec']) THEN 1 ELSE 0 END, class_id DESC) AS rn, count(*) OVER (PARTITION BY repo_id, fq) AS definitions FROM c WHERE fq IS NOT NULL),
u AS (SELECT repo_id, short FROM c GROUP BY 1, 2 HAVING count(DISTINCT fq) = 1) SELECT r.class_id, r.repo_id, r.definitions, u.short AS alias FROM r LEFT JOIN u ON u.repo_id = r.repo_id AND u.short = r.short WHERE rn = 1""")
def q_definition_policy(spark, sf_dir):
    """One definition per name (production before tests, then the last), with its short alias while that is unambiguous."""
    c = _classes(spark, sf_dir)
    w = W.partitionBy("repo_id", "fq")
    test = (paths.scope(F.col("file_path")) == "tests").cast("int")
    r = c.where("fq IS NOT NULL").withColumn("definitions", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(test, F.col("class_id").desc()))).where("rn = 1")
    u = c.groupBy("repo_id", "short").agg(F.count_distinct("fq").alias("n")).where("n = 1").select("repo_id", "short", F.col("short").alias("alias"))
    return r.join(u, ["repo_id", "short"], "left").select("class_id", "repo_id", "definitions", "alias")


@query("""WITH i AS (SELECT DISTINCT sink_id, scan_id, file_path, start_line, sink_name FROM sink_inventory), f AS (SELECT scan_id, location.file_path AS file_path, count(DISTINCT finding_id) AS n, min(severity) AS severity FROM finding GROUP BY 1, 2)
SELECT i.sink_id, coalesce(f.n, 0) AS findings, CASE WHEN i.sink_name IS NULL THEN 'unknown_sink' WHEN f.n > 1 THEN 'several_routes' WHEN f.n = 1 THEN 'one_route' WHEN i.file_path IS NULL THEN 'no_location' ELSE 'no_route' END AS outcome
FROM i LEFT JOIN f ON f.scan_id = i.scan_id AND f.file_path = i.file_path""")
def q_inventory_disposition(spark, sf_dir):
    """Each inventoried sink with its findings and the first outcome that applies."""
    i = table(spark, sf_dir, "sink_inventory").select("sink_id", "scan_id", "file_path", "start_line", "sink_name").distinct()
    f = table(spark, sf_dir, "finding").groupBy("scan_id", F.col("location.file_path").alias("file_path")).agg(F.count_distinct("finding_id").alias("n"))
    out = F.when(F.col("sink_name").isNull(), "unknown_sink").when(F.col("n") > 1, "several_routes").when(F.col("n") == 1, "one_route").when(F.col("file_path").isNull(), "no_location").otherwise("no_route")
    return i.join(f, ["scan_id", "file_path"], "left").select("sink_id", F.coalesce("n", F.lit(0)).alias("findings"), out.alias("outcome"))


@query("""WITH c AS (SELECT DISTINCT class_id, repo_id, file_path, start_line FROM class_symbol WHERE start_line IS NOT NULL), s AS (SELECT DISTINCT sink_id, repo_id, file_path, start_line FROM sink_inventory WHERE start_line IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL)
SELECT s.sink_id, c.class_id FROM s ASOF LEFT JOIN (SELECT repo_id, start_line, max(class_id) AS class_id FROM c GROUP BY 1, 2) c ON s.repo_id = c.repo_id AND s.start_line >= c.start_line""")
def q_scope_lookup(spark, sf_dir):
    """The last class of the repository that starts at or before a line, the greatest id on a tie."""
    c = table(spark, sf_dir, "class_symbol").where("start_line IS NOT NULL").select("class_id", "repo_id", "start_line").distinct()
    s = table(spark, sf_dir, "sink_inventory").where("start_line IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL").select("sink_id", "repo_id", "start_line", "file_path").distinct()
    return asof.interval_owner(s, c, ["repo_id"], "start_line", "start_line", "class_id").select("sink_id", "class_id")


@query(f"""WITH {_F}, s AS (SELECT DISTINCT scan_id, start_line FROM sink_inventory WHERE start_line IS NOT NULL) SELECT finding_id FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.scan_id = f.scan_id AND f.line BETWEEN s.start_line AND s.start_line + 33)""")
def q_range_suppress(spark, sf_dir):
    """Findings in no span of an inventoried sink of their scan, the span widened by three lines."""
    s = table(spark, sf_dir, "sink_inventory").where("start_line IS NOT NULL").select("scan_id", F.col("start_line").alias("s"), (F.col("start_line") + 30).alias("e")).distinct()
    return asof.suppress(_findings(spark, sf_dir), s, ["scan_id"], "line", "s", "e", 3).select("finding_id")


@query("""WITH a(package, lo, hi, advisory) AS (VALUES ('fenzo/queue', '1.0', '2.0', 'A-1'), ('lomera/token', '0.1', '9.0', 'A-2'), ('pelloq/theme', '0.9.1', '1.0', 'A-3')),
p AS (SELECT DISTINCT scan_id, json_extract_string(analysis, '$.package_context.package') AS package, json_extract_string(analysis, '$.package_context.version') AS version FROM scan_result WHERE json_valid(analysis) AND json_type(analysis::JSON) = 'OBJECT'),
v AS (SELECT *, list_slice(list_concat(list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)), [0,0,0,0]), 1, 4) AS n FROM p WHERE regexp_matches(version, '^\\d+(\\.\\d+)*$')),
b AS (SELECT *, list_slice(list_concat(list_transform(string_split(lo, '.'), lambda x: CAST(x AS INT)), [0,0,0,0]), 1, 4) AS l, list_slice(list_concat(list_transform(string_split(hi, '.'), lambda x: CAST(x AS INT)), [0,0,0,0]), 1, 4) AS h FROM a)
SELECT scan_id, advisory FROM v JOIN b USING (package) WHERE v.n >= b.l AND v.n < b.h""")
def q_advisories(spark, sf_dir):
    """Packages of scans against a table of version ranges (three rows, so broadcast)."""
    a = spark.createDataFrame([("fenzo/queue", "1.0", "2.0", "A-1"), ("lomera/token", "0.1", "9.0", "A-2"), ("pelloq/theme", "0.9.1", "1.0", "A-3")], "package string, lo string, hi string, advisory string")
    v = table(spark, sf_dir, "scan_result").select("scan_id", F.try_parse_json("analysis").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT%'")
    p = v.select("scan_id", F.try_variant_get("v", "$.package_context.package", "string").alias("package"), paths.version(F.try_variant_get("v", "$.package_context.version", "string")).alias("n")).distinct()
    return p.join(F.broadcast(a), "package").where((F.col("n") >= paths.version(F.col("lo"))) & (F.col("n") < paths.version(F.col("hi")))).select("scan_id", "advisory")


@query("""WITH r AS (SELECT DISTINCT finding_id, exporter, file_seq FROM finding), w AS (SELECT DISTINCT scan_id, exporter, file_seq FROM scan_result),
m AS (SELECT finding_id, scan_id, row_number() OVER (PARTITION BY finding_id ORDER BY scan_id) AS rn, count(*) OVER (PARTITION BY finding_id) AS total FROM r JOIN w USING (exporter, file_seq)) SELECT finding_id, scan_id, rn AS rank, total, total > 4 AS truncated FROM m WHERE rn <= 4""")
def q_store_match(spark, sf_dir):
    """Reads against writes of the same report file, four a read, with the uncapped count."""
    r = table(spark, sf_dir, "finding").select("finding_id", "exporter", "file_seq").distinct()
    w = table(spark, sf_dir, "scan_result").select("scan_id", "exporter", "file_seq").distinct()
    best = ranking.top_k(w, ["exporter", "file_seq"], [F.col("scan_id")], 4)
    n = w.groupBy("exporter", "file_seq").agg(F.count("*").alias("total"))
    return r.join(best, ["exporter", "file_seq"]).join(n, ["exporter", "file_seq"]).select("finding_id", "scan_id", "rank", "total", (F.col("total") > 4).alias("truncated"))


# -- as-of ------------------------------------------------------------------------------------------------------------
@query("""SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reaching FROM events""")
def q_last_write(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return asof.last_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("signup", "purchase"), F.col("event_id")).select("event_id", "reaching")


@query("""WITH s AS (SELECT user_id, max((ts, event_id)) AS at FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT event_id FROM events e LEFT JOIN s USING (user_id) WHERE event_type = 'click' AND (s.at IS NULL OR (e.ts, e.event_id) > s.at)""")
def q_may_writes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return asof.may_writes(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "click").select("event_id")


@query("""WITH x AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gen FROM events)
SELECT user_id, coalesce(gen, -1) AS definition, count(*) AS uses FROM x WHERE event_type = 'view' GROUP BY 1, 2""")
def q_reaching_merge(spark, sf_dir):
    """Definitions that reach the uses of a scope, -1 for the value it came in with."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("gen", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'view'").groupBy("user_id", F.coalesce("gen", F.lit(-1)).alias("definition")).agg(F.count("*").alias("uses"))


# -- aggregation and ranking --------------------------------------------------------------------------------------------
@query("""SELECT rule_id, path, min_by(finding_id, (n, finding_id)) AS finding_id, min(n) AS steps FROM (SELECT DISTINCT finding_id, rule_id, location.file_path AS path, coalesce(len(dataflow_trace), 0) AS n FROM finding) GROUP BY 1, 2""")
def q_min_trace_merge(spark, sf_dir):
    """Per identity the finding of the shortest trace, the smallest id on a tie."""
    f = table(spark, sf_dir, "finding").select("finding_id", "rule_id", F.col("location.file_path").alias("path"), F.coalesce(F.size("dataflow_trace"), F.lit(0)).alias("n"))
    f = f.withColumn("steps", F.greatest("n", F.lit(0)).cast("bigint"))
    return ranking.best(f, ["rule_id", "path"], F.struct("steps", "finding_id"), ["finding_id", "steps"])


@query(f"""WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path, vuln_type ORDER BY coalesce({_RANK}, 0) DESC, line NULLS FIRST, col NULLS FIRST, finding_id) AS rn, count(*) OVER (PARTITION BY scan_id, path, vuln_type) AS merged FROM f)
SELECT finding_id, merged FROM r WHERE rn = 1""")
def q_finding_dedup(spark, sf_dir):
    """One finding per scan, file and kind: the most severe, then the first by place."""
    f = _findings(spark, sf_dir)
    order = F.struct(-F.coalesce(_case(F.col("severity"), SEVERITY), F.lit(0)), "line", "col", "finding_id")
    return f.groupBy("scan_id", "path", "vuln_type").agg(F.min_by("finding_id", order).alias("finding_id"), F.count("*").alias("merged")).select("finding_id", "merged")


@query("""WITH c AS (SELECT DISTINCT scan_id, i - 1 AS place, gadget_chains[i] AS c FROM scan_result, unnest(range(1, len(gadget_chains) + 1)) t(i) WHERE gadget_chains[i] IS NOT NULL),
b AS (SELECT scan_id, c.entry_class AS entry, c.sink_function AS sink, c.chain_id AS chain, min((coalesce(c.length, 999), place)) AS best FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entry, sink ORDER BY best, scan_id, chain NULLS FIRST) AS rn FROM b) SELECT scan_id, entry, sink, chain, CAST(rn AS INT) AS rank FROM r WHERE rn <= 2""")
def q_top2_routes(spark, sf_dir):
    """Chains: the best of each signature, then two per entry and sink."""
    c = table(spark, sf_dir, "scan_result").select("scan_id", F.posexplode("gadget_chains").alias("at", "c")).where("c IS NOT NULL")
    c = c.groupBy("scan_id", F.col("c.entry_class").alias("entry"), F.col("c.sink_function").alias("sink"), F.col("c.chain_id").alias("chain")).agg(F.min(F.struct(F.coalesce("c.length", F.lit(999)), "at")).alias("best"))
    return ranking.top_k(c, ["entry", "sink"], [F.col("best"), F.col("scan_id"), F.col("chain").asc_nulls_first()], 2).select("scan_id", "entry", "sink", "chain", "rank")


@query(f"""WITH {_F}, a AS (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY coalesce({_RANK}, 0) DESC, finding_id) > 1 AS later FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY later, coalesce({_RANK}, 0) DESC, finding_id) AS rn FROM a) SELECT scan_id, finding_id, CAST(rn AS INT) AS rank FROM r WHERE rn <= 3""")
def q_evidence_compact(spark, sf_dir):
    """Three findings a scan: the best of each rule first, then the rest."""
    order = [F.coalesce(_case(F.col("severity"), SEVERITY), F.lit(0)).desc(), F.col("finding_id")]
    return ranking.representatives(_findings(spark, sf_dir), ["scan_id"], ["rule_id"], order, 3).select("scan_id", "finding_id", "rank")


@query(f"""WITH {_F} SELECT scan_id, count(*) AS routes, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS severe, count(*) FILTER (confidence IS NULL) AS unsure, count(DISTINCT path) AS files, bool_and(severity = 'INFO') AS only_info, bool_or(vuln_type = 'POP_GADGET_CHAIN') AS has_chain FROM f GROUP BY 1""")
def q_route_summary(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.groupBy("scan_id").agg(F.count("*").alias("routes"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("severe"), F.count_if(F.col("confidence").isNull()).alias("unsure"), F.count_distinct("path").alias("files"), F.bool_and(F.col("severity") == "INFO").alias("only_info"), F.bool_or(F.col("vuln_type") == "POP_GADGET_CHAIN").alias("has_chain"))


@query("""SELECT repo_id, CASE WHEN bool_or(disposition = 'proven_route') THEN 'included' WHEN bool_or(disposition IN ('conditional_route', 'library_api')) THEN 'candidate' WHEN bool_and(coalesce(disposition IN ('unreachable', 'object_payload_excluded'), false)) THEN 'excluded' ELSE 'unknown' END AS status
FROM (SELECT DISTINCT sink_id, repo_id, disposition FROM sink_inventory) GROUP BY 1""")
def q_status_lattice(spark, sf_dir):
    t = table(spark, sf_dir, "sink_inventory").select("sink_id", "repo_id", "disposition").distinct()
    d = F.col("disposition")
    status = F.when(F.bool_or(d == "proven_route"), "included").when(F.bool_or(d.isin("conditional_route", "library_api")), "candidate").when(F.bool_and(F.coalesce(d.isin("unreachable", "object_payload_excluded"), F.lit(False))), "excluded").otherwise("unknown")
    return t.groupBy("repo_id").agg(status.alias("status"))


@query(f"""WITH {_F} SELECT scan_id, vuln_type, list_sort(list_distinct(list(rule_id))) AS triggers, count(DISTINCT path) AS files, CAST(max(coalesce({_RANK}, 0)) AS INT) AS worst FROM f GROUP BY 1, 2""")
def q_impact_groups(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.groupBy("scan_id", "vuln_type").agg(F.array_sort(F.collect_set("rule_id")).alias("triggers"), F.count_distinct("path").alias("files"), F.max(F.coalesce(_case(F.col("severity"), SEVERITY), F.lit(0))).alias("worst"))


@query(f"""WITH {_F} SELECT count(*) AS findings, {', '.join(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in SEVERITY)}, count(DISTINCT scan_id) AS scans, count(DISTINCT path) AS files, CAST(CASE WHEN bool_or(severity IN ('CRITICAL', 'HIGH')) THEN 1 ELSE 0 END AS INT) AS exit_status FROM f""")
def q_scan_summary(spark, sf_dir):
    """One row of counts, with the exit status of a run."""
    f = _findings(spark, sf_dir)
    by = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITY]
    return f.agg(F.count("*").alias("findings"), *by, F.count_distinct("scan_id").alias("scans"), F.count_distinct("path").alias("files"), F.max(F.col("severity").isin("CRITICAL", "HIGH").cast("int")).alias("exit_status"))


@query("""SELECT disposition, source_assumption, count(DISTINCT sink_id) AS sinks FROM sink_inventory GROUP BY 1, 2""")
def q_frequencies(spark, sf_dir):
    return table(spark, sf_dir, "sink_inventory").groupBy("disposition", "source_assumption").agg(F.count_distinct("sink_id").alias("sinks"))


_SITES = "SELECT file_path, start_line, sink_name FROM {0}"


@query(f"""SELECT 'gone' AS change, file_path, start_line, sink_name, count(*) AS n FROM ({_SITES.format('sink_inventory')} EXCEPT ALL {_SITES.format('sink_inventory_copy')}) GROUP BY ALL
UNION ALL SELECT 'new', file_path, start_line, sink_name, count(*) FROM ({_SITES.format('sink_inventory_copy')} EXCEPT ALL {_SITES.format('sink_inventory')}) GROUP BY ALL""")
def q_report_diff(spark, sf_dir):
    """Multiset difference of two reports, both ways, by one aggregation of signed counts."""
    cols = ["file_path", F.col("start_line").cast("bigint").alias("start_line"), "sink_name"]
    a = table(spark, sf_dir, "sink_inventory").select(*cols, F.lit(1).alias("d"))
    b = table(spark, sf_dir, "sink_inventory_copy").select(*cols, F.lit(-1).alias("d"))
    g = a.unionAll(b).groupBy("file_path", "start_line", "sink_name").agg(F.sum("d").alias("d")).where("d <> 0")
    return g.select(F.when(F.col("d") > 0, "gone").otherwise("new").alias("change"), "file_path", "start_line", "sink_name", F.abs("d").alias("n"))


@query("""WITH a AS (SELECT DISTINCT file_path, start_line FROM sink_inventory), b AS (SELECT DISTINCT file_path, start_line FROM sink_inventory_copy), j AS (SELECT a.file_path IS NOT NULL OR a.start_line IS NOT NULL AS x, 1 AS o FROM a)
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS agreed, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_first, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_second""")
def q_site_agreement(spark, sf_dir):
    """Sites that two tools agree on, by one grouping of presence flags."""
    cols = ["file_path", F.col("start_line").cast("bigint").alias("start_line")]
    a = table(spark, sf_dir, "sink_inventory").select(*cols, F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, sf_dir, "sink_inventory_copy").select(*cols, F.lit(0).alias("a"), F.lit(1).alias("b"))
    g = a.unionAll(b).groupBy("file_path", "start_line").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return g.agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("agreed"), F.count_if(F.expr("a = 1 AND b = 0")).alias("only_first"), F.count_if(F.expr("a = 0 AND b = 1")).alias("only_second"))


@query(f"""WITH {_F}, c AS (SELECT severity IN ('CRITICAL', 'HIGH') AS said, coalesce(confidence = 'HIGH', false) AS truth FROM f), n AS (SELECT count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM c)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall FROM n""")
def q_confusion(spark, sf_dir):
    """Confusion matrix with precision and recall; an empty denominator gives null."""
    c = _findings(spark, sf_dir).select(F.col("severity").isin("CRITICAL", "HIGH").alias("s"), F.coalesce(F.col("confidence") == "HIGH", F.lit(False)).alias("t"))
    n = c.agg(F.count_if(F.expr("s AND t")).alias("tp"), F.count_if(F.expr("s AND NOT t")).alias("fp"), F.count_if(F.expr("NOT s AND t")).alias("fn"), F.count_if(F.expr("NOT s AND NOT t")).alias("tn"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return n.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


# -- graphs ---------------------------------------------------------------------------------------------------------------
def _steps(spark, sf_dir) -> DataFrame:
    """Links between the classes of gadget steps."""
    s = table(spark, sf_dir, "scan_result").select(F.explode("gadget_chains").alias("c")).select(F.explode("c.steps").alias("s"))
    return s.select(F.col("s.class_name").alias("src"), F.col("s.target_class").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


_E = "e AS (SELECT DISTINCT s.class_name AS src, s.target_class AS dst FROM (SELECT unnest(c.steps) AS s FROM (SELECT unnest(gadget_chains) AS c FROM scan_result)) WHERE s.class_name <> s.target_class)"
_NODES = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_SINK = "'%\\\\%Store'"


@query(f"""WITH RECURSIVE {_E}, {_NODES}, b AS (SELECT node, 0 AS distance FROM n WHERE node LIKE '%Store' UNION SELECT e.src, b.distance + 1 FROM b JOIN e ON e.dst = b.node WHERE b.distance < 6) SELECT node, CAST(min(distance) AS INT) AS distance FROM b GROUP BY 1""")
def q_sink_distance(spark, sf_dir):
    """Links to the nearest class named like a store, up to six."""
    e = _steps(spark, sf_dir)
    n = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct().where("node LIKE '%Store'")
    return graph.distances(e, n, 6)


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT [src, dst] AS path, dst AS tip FROM e WHERE src LIKE '%Reader' AND src NOT LIKE '%Store' UNION ALL SELECT list_append(p.path, e.dst), e.dst FROM p JOIN e ON e.src = p.tip WHERE p.tip NOT LIKE '%Store' AND len(p.path) < 4 AND NOT list_contains(p.path, e.dst))
SELECT path, 0.7 AS confidence, true AS complete FROM p WHERE tip LIKE '%Store'""")
def q_simple_paths(spark, sf_dir):
    """Simple paths of at most three links from readers to stores, pruned by distance."""
    e = _steps(spark, sf_dir).withColumn("confidence", F.lit(0.7))
    n = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct()
    return graph.simple_paths(e, n.where("node LIKE '%Reader'"), n.where("node LIKE '%Store'"), 3)


@query(f"""WITH RECURSIVE {_E}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1""")
def q_alias_components(spark, sf_dir):
    return graph.components(_steps(spark, sf_dir))


@query(f"""WITH RECURSIVE {_E}, f AS (SELECT src AS node, split_part(src, '\\', 1) AS label, 0 AS hops FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, f.label, f.hops + 1 FROM f JOIN e ON e.src = f.node WHERE f.hops < 40) SELECT node, label, CAST(min(hops) AS INT) AS hops FROM f GROUP BY 1, 2""")
def q_label_propagation(spark, sf_dir):
    """Vendors of the entry classes, carried along all links to a fixpoint with the fewest links."""
    e = _steps(spark, sf_dir)
    start = e.select("src").distinct().join(e.select(F.col("dst").alias("src")), "src", "left_anti")
    return graph.propagate(start.select(F.col("src").alias("node"), F.substring_index("src", "\\", 1).alias("label")), e, ["label"])


# -- evidence -------------------------------------------------------------------------------------------------------------
#: Points of the review priority (fixed values).
IMPACT = {"CRITICAL": 35, "HIGH": 28, "MEDIUM": 20, "LOW": 10, "INFO": 4}
EVIDENCE = {"observed": 30, "modeled": 22, "unresolved": 14, "conditional": 10}
CONFIDENCE = {"HIGH": 15, "MEDIUM": 9, "LOW": 3}
SCOPE_COST = {"tests": 12, "vendor": 8, "examples": 8, "external": 8}
_META = """m AS (SELECT DISTINCT finding_id, severity, confidence, json_extract_string(metadata, '$.analysis_status') AS status, json_extract_string(metadata, '$.source_scope') AS scope, json_extract_string(metadata, '$.flow_evidence_truncated') AS cut FROM finding WHERE json_valid(metadata) AND json_type(metadata::JSON) = 'OBJECT')"""


def _metadata(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "finding").select("finding_id", "severity", "confidence", F.try_parse_json("metadata").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT%'")
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    return t.select("finding_id", "severity", "confidence", get("analysis_status").alias("status"), get("source_scope").alias("scope"), get("flow_evidence_truncated").alias("cut")).distinct()


@query(f"""WITH {_META}, p AS (SELECT finding_id, scope, coalesce({_sql_case('severity', IMPACT)}, 0) AS impact, coalesce({_sql_case('status', EVIDENCE)}, 2) AS evidence, coalesce({_sql_case('confidence', CONFIDENCE)}, 0) AS sure,
(CASE WHEN status = 'unresolved' THEN 10 ELSE 0 END) + (CASE WHEN cut = 'true' THEN 2 ELSE 0 END) + (CASE WHEN status IS NULL THEN 8 ELSE 0 END) AS cost, coalesce({_sql_case('scope', SCOPE_COST)}, 0) AS away, status FROM m),
s AS (SELECT *, least(100, greatest(0, impact + evidence + sure - least(cost, 18) - away - CASE WHEN cost > 0 THEN 5 ELSE 0 END)) AS raw FROM p),
t AS (SELECT *, least(raw, CASE WHEN status IS NULL THEN 29 ELSE 100 END, CASE WHEN status = 'unresolved' THEN 49 ELSE 100 END, CASE WHEN status = 'conditional' THEN 79 ELSE 100 END, CASE WHEN away > 0 THEN 59 ELSE 100 END) AS score FROM s)
SELECT finding_id, CAST(score AS INT) AS score, CASE WHEN score >= 80 THEN 'URGENT' WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM t""")
def q_priority_score(spark, sf_dir):
    """Additive points with a joint cap on limitations, caps by kind of evidence and scope, and bands."""
    m = _metadata(spark, sf_dir)
    pick = lambda c, v, d: F.coalesce(_case(F.col(c), v), F.lit(d))
    cost = F.when(F.col("status") == "unresolved", 10).otherwise(0) + F.when(F.col("cut") == "true", 2).otherwise(0) + F.when(F.col("status").isNull(), 8).otherwise(0)
    m = m.withColumns({"cost": cost, "away": pick("scope", SCOPE_COST, 0)})
    raw = pick("severity", IMPACT, 0) + pick("status", EVIDENCE, 2) + pick("confidence", CONFIDENCE, 0) - F.least("cost", F.lit(18)) - F.col("away") - F.when(F.col("cost") > 0, 5).otherwise(0)
    cap = lambda cond, n: F.when(cond, n).otherwise(100)
    score = F.least(F.least(F.lit(100), F.greatest(F.lit(0), raw)), cap(F.col("status").isNull(), 29), cap(F.col("status") == "unresolved", 49), cap(F.col("status") == "conditional", 79), cap(F.col("away") > 0, 59))
    band = F.when(F.col("score") >= 80, "URGENT").when(F.col("score") >= 60, "HIGH").when(F.col("score") >= 30, "MEDIUM").otherwise("LOW")
    return m.withColumn("score", score).select("finding_id", "score", band.alias("band"))


@query(f"""WITH {_META} SELECT finding_id, list_sort(list_filter([CASE WHEN status = 'unresolved' THEN 'unresolved_propagation' END, CASE WHEN cut = 'true' THEN 'displayed_flow_evidence_truncated' END, CASE WHEN scope <> 'production' THEN 'scope:' || scope END], lambda x: x IS NOT NULL)) AS limitations FROM m""")
def q_limitations(spark, sf_dir):
    m = _metadata(spark, sf_dir)
    parts = F.array(F.when(F.col("status") == "unresolved", "unresolved_propagation"), F.when(F.col("cut") == "true", "displayed_flow_evidence_truncated"), F.when(F.col("scope") != "production", F.concat(F.lit("scope:"), "scope")))
    return m.select("finding_id", F.array_sort(F.array_distinct(F.array_compact(parts))).alias("limitations"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CAST(rn AS INT) AS rank, total, total > 2 AS truncated FROM l WHERE rn <= 2""")
def q_capped_routes(spark, sf_dir):
    """Two lines an order with the flag that more were there."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return ranking.top_k_flagged(t, ["l_orderkey"], [F.col("l_quantity").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 2)


@query("""WITH e AS (SELECT user_id, date_diff('second', TIMESTAMP '2024-01-01', ts) // 60 AS s, date_diff('second', TIMESTAMP '2024-01-01', ts) // 60 + CAST(value AS INT) * 3 AS t FROM events WHERE event_type = 'view'), d AS (SELECT DISTINCT * FROM e)
SELECT a.user_id, a.s AS start, a.t AS "end" FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.user_id = a.user_id AND b.s >= a.s AND b.t <= a.t AND (b.s <> a.s OR b.t <> a.t))""")
def q_innermost_span(spark, sf_dir):
    """Spans of a user that hold no other one."""
    sec = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 60000000)
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", sec.alias("start"), (sec + F.rint("value").cast("int") * 3).alias("end"))
    return asof.innermost(e, ["user_id"], "start", "end")


@query(f"""WITH {_F} SELECT scan_id, to_json(list({{'ruleId': rule_id, 'level': CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END, 'line': line}} ORDER BY finding_id))::VARCHAR AS results FROM f GROUP BY 1""")
def q_sarif_results(spark, sf_dir):
    """The results of each scan as one JSON text with levels."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    f = _findings(spark, sf_dir).select("scan_id", F.struct("finding_id", F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), "line").alias("r")).alias("x"))
    g = f.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("r"))
    return g.select("scan_id", F.to_json("r", {"ignoreNullFields": "false"}).alias("results"))


@query(f"""WITH {_F} SELECT finding_id, row_number() OVER (PARTITION BY scan_id ORDER BY coalesce({_RANK}, 0) DESC, path NULLS FIRST, line NULLS FIRST, col NULLS FIRST, rule_id NULLS FIRST, finding_id) AS place FROM f""")
def q_finding_order(spark, sf_dir):
    """Places in the report order of a scan: severity, path, line, column, rule."""
    w = W.partitionBy("scan_id").orderBy(F.coalesce(_case(F.col("severity"), SEVERITY), F.lit(0)).desc(), "path", "line", "col", "rule_id", "finding_id")
    return _findings(spark, sf_dir).select("finding_id", F.row_number().over(w).alias("place"))
