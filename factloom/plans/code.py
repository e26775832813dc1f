"""Queries over PHP source: facts, flows, call graph, chains, rules and findings of ``source_file``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.code import analysis
from factloom.code.facts import SCALAR, SOURCE_CALLS, TRANSFORMS, extract
from factloom.functions import jsonread, paths
from factloom.plans.relational import CATEGORIES, category
from factloom.store import once, table


def php_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "source_file").select("file_id", "repo_id", "file_path", "content")
    return once(t.where(paths.has_extension(F.col("file_path"))), "file_id")


def code(spark: SparkSession, sf_dir: str) -> analysis.Code:
    return analysis.Code(extract(php_files(spark, sf_dir)))


def q_php_classes(spark, sf_dir):
    return code(spark, sf_dir).rows("classes").select("file_id", "name", "kind", "parent", "interfaces", "abstract", "start_line", "end_line")


def q_php_methods(spark, sf_dir):
    return code(spark, sf_dir).functions().select("file_id", "class", "name", "kind", "visibility", "static", F.size("params").alias("params"), "start_line", "end_line")


def q_php_imports(spark, sf_dir):
    return code(spark, sf_dir).rows("imports").select("file_id", "kind", "full", "alias")


def q_php_properties(spark, sf_dir):
    return code(spark, sf_dir).rows("properties").select("file_id", "class_id", "name", "type", "visibility", "static")


def q_php_calls(spark, sf_dir):
    return code(spark, sf_dir).calls.select("file_id", "how", "callee", "receiver", "class_name", F.size("args").alias("args"), category(F.col("callee")).alias("category"), "start_line", "text")


def q_php_parse_errors(spark, sf_dir):
    return code(spark, sf_dir).errors()


def q_php_resolution(spark, sf_dir):
    return code(spark, sf_dir).targets()


def q_php_inventory(spark, sf_dir):
    """Sink calls with their disposition."""
    i = code(spark, sf_dir).inventory(category)
    return i.select("file_id", "path", "line", "col", "sink_name", "category", "restricted", "disposition", "origin", "origin_line", "hops", "scope")


def findings_of(c: analysis.Code, library: bool = False, php_version: str | None = None) -> DataFrame:
    i = c.inventory(category, library, php_version).where("disposition IN ('proven_route', 'conditional_route', 'modeled_framework_request', 'persistent_data', 'conditional_library_api')")
    severe = F.when(F.col("scope") != "production", "MEDIUM").when(F.col("category") == "DESERIALIZATION", "CRITICAL").when(F.col("category") == "RCE", "HIGH").otherwise("MEDIUM")
    sure = F.when(F.col("kind").isin("library_parameter", "persistent_data"), "LOW").when(F.col("certain"), "HIGH").otherwise("MEDIUM")
    return i.select(paths.identity(F.col("path"), F.col("line"), F.col("col"), F.col("sink_name"), length=12).alias("finding_id"), "file_id", "path", "line", "col", "sink_name", "category", severe.alias("severity"), sure.alias("confidence"), "origin", "hops", "origins")


def q_php_findings(spark, sf_dir):
    """Routes from the request to a sink: the shortest of each site, with severity and confidence."""
    return findings_of(code(spark, sf_dir))


def q_php_call_graph(spark, sf_dir):
    return code(spark, sf_dir).call_graph(category)


def q_php_chains(spark, sf_dir):
    c = code(spark, sf_dir)
    return c.chains(c.call_graph(category))


def q_php_structural(spark, sf_dir):
    """Calls that decode request data with open options, matched by structure."""
    from factloom.code import structural

    c = structural.calls_matching(code(spark, sf_dir).calls, "unserialize($DATA, ...)", ("unserialize($X, ['allowed_classes' => false])",))
    return c.select("file_id", "start_line", "start_col", F.col("bindings")["$DATA"].alias("data"))


def q_php_review(spark, sf_dir, budget: int = 120):
    """Per finding the code around it (at most ``budget`` lines, centred on the sink, inside the file) and the question for a reviewer."""
    files = php_files(spark, sf_dir)
    c = analysis.Code(extract(files))
    f = findings_of(c).select("finding_id", "file_id", "path", "line", "sink_name", "origin")
    text = files.select("file_id", F.split(F.decode("content", "ISO-8859-1"), "\r\n|\n|\r").alias("ls"))
    j = f.join(text, "file_id")
    first = F.greatest(F.lit(1), F.least(F.col("line") - budget // 2, F.size("ls") - budget + 1))
    j = j.withColumn("first", first).withColumn("lines", F.slice("ls", F.col("first"), F.lit(budget)))
    shown = F.transform("lines", lambda x, i: F.concat(F.when(F.col("first") + i == F.col("line"), "> ").otherwise("  "), (F.col("first") + i).cast("string"), F.lit(": "), x))
    ask = F.format_string("Does %s reach %s in %s:%d with a class of the sender's choice? Answer with one JSON object.", "origin", "sink_name", "path", "line")
    return j.select("finding_id", "path", "line", F.col("first").alias("first_line"), F.array_join(shown, "\n").alias("code"), ask.alias("question"), (F.size("ls") > budget).alias("cut"))


def q_php_sites(spark, sf_dir):
    """Deserialization sites with the classes their options let through."""
    return code(spark, sf_dir).sites()


def q_php_chain_sites(spark, sf_dir):
    c = code(spark, sf_dir)
    return c.chain_sites(c.store.cut(c.chains(c.call_graph(category))))


def q_php_includes(spark, sf_dir):
    return code(spark, sf_dir).includes()


def q_php_session_dispatch(spark, sf_dir):
    c = code(spark, sf_dir)
    return c.dispatch_sinks(c.session_dispatch(), c.call_graph(category), category)


def q_php_stored_columns(spark, sf_dir):
    return code(spark, sf_dir).stored_columns()


def q_php_coverage(spark, sf_dir):
    return code(spark, sf_dir).coverage()


def finding_coverage_of(c: analysis.Code) -> DataFrame:
    modeled = sorted({*SCALAR, *TRANSFORMS, *SOURCE_CALLS, *analysis.DESERIALIZERS, *" ".join(CATEGORIES.values()).split(), "isset", "empty", "unset", "exit", "die"})
    i = c.inventory(category).where("disposition IN ('proven_route', 'conditional_route')")
    f = i.select(paths.identity(F.col("path"), F.col("line"), F.col("col"), F.col("sink_name"), length=12).alias("finding_id"), "file_id", "fn_id", "origin_id")
    return c.finding_coverage(f, modeled)


def q_php_finding_coverage(spark, sf_dir):
    """Per finding the files, files with errors and unknown calls in the functions that it depends on."""
    return finding_coverage_of(code(spark, sf_dir))


def q_php_routes(spark, sf_dir):
    """Route evidence of four kinds (request to sink, stored column, chain with a site, session dispatch) with status and what is missing."""
    c = code(spark, sf_dir)
    e = c.store.cut(c.call_graph(category))
    return c.route_evidence(c.inventory(category), c.chains(e), c.dispatch_sinks(c.session_dispatch(), e, category))


def q_php_assessed(spark, sf_dir):
    """Reached sinks with level of evidence, limitations and completeness."""
    c = code(spark, sf_dir)
    return c.assessed(c.inventory(category)).select("file_id", "path", "line", "col", "sink_name", "sink_argument", "level", "limitations", "detection", "completeness")


def q_php_flow_metrics(spark, sf_dir):
    """Scopes, statements, branches and dead statements per file."""
    return code(spark, sf_dir).flow_metrics()


def q_php_bootstraps(spark, sf_dir):
    """Entry points of each file and how many of them start a session."""
    return code(spark, sf_dir).bootstraps()


def q_php_reviews(spark, sf_dir):
    return code(spark, sf_dir).typed_reviews()


def q_php_rules(spark, sf_dir):
    """Matches of the review rules."""
    rules, _ = analysis.check_rules(analysis.RULES)
    return code(spark, sf_dir).matches(rules)


def q_php_sink_distance(spark, sf_dir):
    """Links from each function to its nearest sink in the call graph."""
    from factloom.operators import graph

    c = code(spark, sf_dir)
    e = c.store.cut(c.call_graph(category))
    return graph.distances(e, e.where("edge_type = 'sink'").select(F.col("dst").alias("node")).distinct())


def _read(batches):
    names = ["name", "type", "version"]
    kinds = [pa.int64(), pa.int32(), *[pa.string()] * 3, pa.list_(pa.struct([("prefix", pa.string()), ("folder", pa.string())]))]
    for b in batches:
        out = []
        for i, r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            d = jsonread.document(c.as_py())
            if d is not None:
                psr4 = jsonread.member(jsonread.member(d, "autoload"), "psr-4")
                folders = [{"prefix": k, "folder": jsonread.shown(v)} for k, v in psr4] if isinstance(psr4, jsonread.Pairs) else []
                out.append((i, r, *(jsonread.shown(jsonread.member(d, k)) for k in names), folders))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file_id", "repo_id", *names, "folders"])


def _manifests(spark, sf_dir) -> DataFrame:
    """Members of the manifests, one row per file. A file that is not UTF-8 or not one JSON object is no manifest."""
    t = table(spark, sf_dir, "source_file").where("lower(file_path) LIKE '%.json'").select(F.col("file_id").cast("bigint"), F.col("repo_id").cast("int"), "file_path", "content").distinct()
    return t.select("file_id", "repo_id", "content").mapInArrow(_read, "file_id bigint, repo_id int, name string, type string, version string, folders array<struct<prefix:string,folder:string>>")


def q_manifest(spark, sf_dir):
    """Package manifests: name, type, version, and whether the package is a library."""
    m = _manifests(spark, sf_dir).where("name IS NOT NULL").select("file_id", "name", "type", "version")
    return m.withColumn("library", F.coalesce(F.col("type").isin("library", "composer-plugin"), F.lit(False)))


def q_psr4(spark, sf_dir):
    """Classes at the path that an autoload prefix of a manifest of their repository expects."""
    m = _manifests(spark, sf_dir).select("repo_id", F.inline("folders")).distinct()
    m = m.withColumn("head", F.lower(F.substring_index("prefix", "\\", 1)))
    c = table(spark, sf_dir, "class_symbol").select("class_id", "repo_id", "full_name", "file_path").where("full_name IS NOT NULL AND file_path IS NOT NULL").distinct().withColumn("head", F.lower(F.substring_index("full_name", "\\", 1)))
    j = c.join(m, ["repo_id", "head"]).where(F.startswith(F.lower("full_name"), F.lower("prefix")))
    rest = F.concat(F.regexp_replace("folder", r"/+\z", ""), F.lit("/"), F.replace(F.substring("full_name", F.length("prefix") + 1, F.length("full_name")), F.lit("\\"), F.lit("/")), F.lit(".php"))
    return j.select("class_id", "prefix", rest.alias("expected"), (rest == F.col("file_path")).alias("matches"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_SRC = "s AS (SELECT DISTINCT file_id, repo_id, file_path, content FROM source_file WHERE lower(file_path) LIKE '%.json'), j AS (SELECT *, CASE WHEN json_valid(decode(content)) THEN decode(content)::JSON END AS v FROM s WHERE NOT contains(content::VARCHAR, '\\x00'))"
_PSR4 = """m AS (SELECT DISTINCT repo_id, e.key AS prefix, e.value->>'$' AS folder FROM j, json_each(j.v, '$.autoload."psr-4"') e WHERE json_type(j.v) = 'OBJECT'),
c AS (SELECT DISTINCT class_id, repo_id, full_name, file_path FROM class_symbol WHERE full_name IS NOT NULL AND file_path IS NOT NULL)"""
ORACLE = {
    "q_psr4": f"""WITH {_SRC}, {_PSR4} SELECT class_id, prefix, regexp_replace(folder, '/+$', '') || '/' || replace(substr(full_name, length(prefix) + 1), '\\', '/') || '.php' AS expected,
regexp_replace(folder, '/+$', '') || '/' || replace(substr(full_name, length(prefix) + 1), '\\', '/') || '.php' = file_path AS matches FROM c JOIN m USING (repo_id)
WHERE lower(split_part(full_name, '\\', 1)) = lower(split_part(prefix, '\\', 1)) AND starts_with(lower(full_name), lower(prefix))""",
    "q_manifest": f"WITH {_SRC} SELECT file_id, v->>'name' AS name, v->>'type' AS type, v->>'version' AS version, coalesce(v->>'type' IN ('library', 'composer-plugin'), false) AS library FROM j WHERE json_type(v) = 'OBJECT' AND v->>'name' IS NOT NULL",
}
