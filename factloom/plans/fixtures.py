"""Queries over the programs of ``code/fixtures.py``: what the pipeline finds in them.

The SQL of each is the list of rows worked out by hand for these programs, a golden test of the pipeline and no second
computation. ``sf_dir`` is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.code import analysis
from factloom.code import fixtures as fx
from factloom.code.facts import extract
from factloom.plans.relational import category


def _code(spark: SparkSession, cases: dict[str, dict[str, str]], **options) -> analysis.Code:
    rows, k = [], 0
    for repo, files in enumerate(cases.values(), 1):
        for path, text in files.items():
            k += 1
            rows.append((k, repo, path, bytearray(text.encode())))
    return analysis.Code(extract(spark.createDataFrame(rows, "file_id bigint, repo_id int, file_path string, content binary"), **options))


def _one(spark: SparkSession, files: dict[str, str] | str, **options) -> analysis.Code:
    return _code(spark, {"case": {"a.php": files} if isinstance(files, str) else files}, **options)


def q_fx_routes(spark, sf_dir) -> DataFrame:
    """Dispositions of deserializers, with the conditions that hold at them."""
    names = spark.createDataFrame([(i, n) for i, n in enumerate(fx.ROUTES, 1)], "repo_id int, case_name string")
    i = _code(spark, {k: {"a.php": t} for k, (t, _) in fx.ROUTES.items()}, php_version="8.1").inventory(category).where("category = 'DESERIALIZATION'")
    return i.join(F.broadcast(names), "repo_id").select("case_name", "line", "disposition", F.array_join("guards", " & ").alias("guards"))


def q_fx_library(spark, sf_dir) -> DataFrame:
    return _one(spark, fx.LIBRARY[0]).inventory(category, library=True).select("line", "disposition")


def q_fx_archives(spark, sf_dir) -> DataFrame:
    c = _one(spark, fx.ARCHIVES[0])
    keep = lambda v: c.inventory(category, php_version=v).where("category = 'PHAR_TRIGGER'").select("line", "disposition", F.lit(v).alias("version"))
    return keep("7.4").unionAll(keep("8.1"))


def _bare(c):
    return F.regexp_replace(c, r"^\d+:", "")


def q_fx_edges(spark, sf_dir) -> DataFrame:
    """Links between methods and to sinks."""
    e = _one(spark, fx.GADGETS).call_graph(category).where("src IS NOT NULL")
    return e.select(_bare(F.col("src")).alias("src"), _bare(F.col("dst")).alias("dst"), "edge_type", "confidence").where("dst NOT LIKE 'SINK::unserialize'").distinct()


def q_fx_chains(spark, sf_dir) -> DataFrame:
    c = _one(spark, fx.GADGETS)
    return c.chains(c.call_graph(category)).select(_bare(F.col("entry")).alias("entry"), _bare(F.col("sink")).alias("sink"), "length", "level", F.array_join("properties", ",").alias("properties"), "complete")


def q_fx_sites(spark, sf_dir) -> DataFrame:
    return _one(spark, fx.GADGETS).sites().select("line", "policy", F.coalesce(F.array_join("classes", ","), F.lit("")).alias("classes"))


def q_fx_loading(spark, sf_dir) -> DataFrame:
    """Entry points of files, those that start a session, and what the constants that guard a file say."""
    c = _one(spark, fx.WEB)
    b = c.bootstraps().join(c.entry_status(), "file_id").join(c.include_index().select(F.col("target_id").alias("file_id"), "always"), "file_id", "left").join(c.facts.select("file_id", "path"), "file_id")
    return b.select("path", "entries", "starting", "status", "always")


def q_fx_reached(spark, sf_dir) -> DataFrame:
    return _one(spark, fx.FLOW).reachable().select("line", "kind", "reachable")


def q_fx_dominators(spark, sf_dir) -> DataFrame:
    """Lines that control must pass, as pairs of lines."""
    c = _one(spark, fx.FLOW)
    line = c.flow_graph()[0].select("node", "line")
    d = c.dominators().join(line, "node").join(line.select(F.col("node").alias("dominator"), F.col("line").alias("before")), "dominator")
    return d.where("before <> line").select("before", "line").distinct()


def q_fx_reaching(spark, sf_dir) -> DataFrame:
    """Writes that lines 4, 10 and 14 may see; 0 is the value that came in."""
    c = _one(spark, fx.FLOW)
    line = c.flow_graph()[0].select("node", "line")
    r = c.reaching().join(line, "node").join(line.select(F.col("node").alias("definition"), F.col("line").alias("written")), "definition", "left")
    return r.where("(variable = 'x' AND line IN (4, 10, 14)) OR (variable = 'y' AND line = 14)").select("line", "variable", F.coalesce("written", F.lit(0)).alias("written")).distinct()


def q_fx_rules(spark, sf_dir) -> DataFrame:
    good, _ = analysis.check_rules(analysis.RULES)
    return _one(spark, fx.REVIEWED).matches(good).select("rule_id", "line")


def q_fx_reviews(spark, sf_dir) -> DataFrame:
    return _one(spark, fx.REVIEWED).typed_reviews().select("line", "review")


def q_fx_callbacks(spark, sf_dir) -> DataFrame:
    return _one(spark, fx.REVIEWED).serializable_callbacks().select("class", "method", "property", F.array_join("sinks", ",").alias("sinks"))


def q_fx_sessions(spark, sf_dir) -> DataFrame:
    c = _one(spark, fx.KEPT)
    d = c.dispatch_sinks(c.session_dispatch(), c.call_graph(category), category)
    return d.select("key", "callee", "stores", F.array_join("classes", ",").alias("classes"), F.array_join("sinks", ",").alias("sinks"), "deeper")


def q_fx_stored_columns(spark, sf_dir) -> DataFrame:
    return _one(spark, fx.KEPT).stored_columns().select("table", "column", "access", F.col("start_line").alias("line"))


def q_fx_resolution(spark, sf_dir) -> DataFrame:
    """Calls with the function or method that they mean."""
    c = _one(spark, fx.KEPT)
    t = c.targets().join(c.calls.select(F.col("id").alias("call_id"), "callee", "start_line"), "call_id").join(c.functions().select(F.col("id").alias("fn_id"), "class", "low"), "fn_id")
    return t.select("callee", F.col("start_line").alias("line"), "class", "low")


def q_fx_errors(spark, sf_dir) -> DataFrame:
    """Files that cannot be read to the end, and files that hold nothing but data."""
    c = _one(spark, {"a.php": "<?php function ok() {} function bad( {", "b.php": "<?php $a = ['k' => 1];", "c.php": "<?php $x{0}; class R { final readonly int $n; }", "d.php": "<?php " + "$a = 1; " * 40}, most_nodes=100)
    e = c.errors().groupBy("file_id").agg(F.min("line").alias("line"), F.max(F.startswith("message", F.lit("more than"))).alias("too_large"))
    return c.facts.select("file_id", "path", "data_only").join(e, "file_id", "left").select("path", "data_only", F.col("line").isNotNull().alias("failed"), F.coalesce("too_large", F.lit(False)).alias("too_large"))


def q_fx_contracts(spark, sf_dir) -> DataFrame:
    """Calls that only a table of fixed dispatches resolves."""
    c = _one(spark, fx.CONTRACTED[0])
    k = spark.createDataFrame(fx.CONTRACTED[1], "caller_class string, caller_method string, receiver string, callee string, target_class string, note string")
    f = c.functions().select(F.col("id").alias("fn_id"), "class", "low")
    return c.contract_targets(k).join(f, "fn_id").select("class", "low", "note")


def q_fx_assessed(spark, sf_dir) -> DataFrame:
    i = _one(spark, fx.ASSESSED[0]).inventory(category, library=True).where("category = 'DESERIALIZATION'")
    c = _one(spark, fx.ASSESSED[0])
    return c.assessed(i).select("line", "level", F.array_join("limitations", ",").alias("limitations"), "detection", "completeness")


def q_fx_route_kinds(spark, sf_dir) -> DataFrame:
    c = _one(spark, fx.KEPT)
    e = c.store.cut(c.call_graph(category))
    r = c.route_evidence(c.inventory(category), c.chains(e), c.dispatch_sinks(c.session_dispatch(), e, category))
    return r.select("kind", "status", "line", F.array_join("missing", ",").alias("missing"))


def q_fx_includes(spark, sf_dir) -> DataFrame:
    c = _one(spark, fx.WEB)
    return c.includes().join(c.facts.select("file_id", "path"), "file_id").select("path", "target", "anchored", F.col("target_id").isNotNull().alias("found"))


def q_fx_declarations(spark, sf_dir) -> DataFrame:
    """Classes, members, functions and imports of one program."""
    c = _one(spark, fx.DECLARED[0])
    classes = c.rows("classes").select("kind", "name", F.array_join(F.array_compact(F.concat(F.array("parent"), "interfaces", "traits")), "|").alias("detail"))
    props = c.rows("properties").select(F.lit("property").alias("kind"), "name", F.concat_ws(" ", "visibility", "type").alias("detail"))
    fns = c.rows("functions").select("kind", "name", F.concat_ws(" ", "visibility", F.size("params").cast("string")).alias("detail"))
    return classes.unionAll(props).unionAll(fns).unionAll(c.rows("imports").select(F.lit("import").alias("kind"), F.col("full").alias("name"), F.concat_ws(" ", "kind", "alias").alias("detail")))


def q_fx_calls(spark, sf_dir) -> DataFrame:
    """Calls, those that a fixed callback stands for included."""
    return _one(spark, fx.ROUTES["callbacks"][0]).calls.select(F.col("start_line").alias("line"), "how", "callee", "callback", "conditional")


def q_fx_outlines(spark, sf_dir) -> DataFrame:
    c = _one(spark, fx.GADGETS)
    return c.outline(c.store.cut(c.chains(c.call_graph(category)))).select("outline")


def q_fx_sink_distance(spark, sf_dir) -> DataFrame:
    from factloom.operators import graph

    c = _one(spark, fx.GADGETS)
    e = c.store.cut(c.call_graph(category))
    return graph.distances(e, e.where("edge_type = 'sink'").select(F.col("dst").alias("node")).distinct()).select(_bare(F.col("node")).alias("node"), "distance")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}


def _values(columns: str, rows: list[tuple]) -> str:
    def text(v) -> str:
        if v is None:
            return "NULL"
        return str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


ORACLE = {
    "q_fx_routes": _values("case_name, line, disposition, guards", [(k, *r) for k, (_, rows) in fx.ROUTES.items() for r in rows]),
    "q_fx_library": _values("line, disposition", fx.LIBRARY[1]),
    "q_fx_archives": _values("line, disposition, version", [r for n, a, b in fx.ARCHIVES[1] for r in ((n, a, "7.4"), (n, b, "8.1"))]),
    "q_fx_edges": _values("src, dst, edge_type, confidence", fx.EDGES),
    "q_fx_chains": _values("entry, sink, length, level, properties, complete", [(*r[:4], ",".join(r[4]), True) for r in fx.CHAINS]),
    "q_fx_sites": _values("line, policy, classes", fx.SITES),
    "q_fx_loading": _values("path, entries, starting, status, always", fx.LOADING),
    "q_fx_reached": _values("line, kind, reachable", fx.REACHED),
    "q_fx_dominators": _values("before, line", fx.DOMINATED),
    "q_fx_reaching": _values("line, variable, written", fx.REACHING),
    "q_fx_rules": _values("rule_id, line", fx.MATCHED),
    "q_fx_reviews": _values("line, review", fx.REVIEWS),
    "q_fx_callbacks": _values("class, method, property, sinks", [("job", "go", "task", "call_user_func")]),
    "q_fx_sessions": _values("key, callee, stores, classes, sinks, deeper", [("cart", "ship", 1, "basket,order", "unlink", False)]),
    "q_fx_stored_columns": _values('"table", "column", access, line', [("notes", "id", "read", 6), ("notes", "body", "read", 6), ("notes", "body", "write", 7), ("notes", "made", "write", 7)]),
    "q_fx_resolution": _values('callee, line, "class", low', [("pack", 3, "order", "pack")]),
    "q_fx_contracts": _values('"class", low, note', fx.CONTRACTED[2]),
    "q_fx_assessed": _values("line, level, limitations, detection, completeness", fx.ASSESSED[1]),
    "q_fx_route_kinds": _values("kind, status, line, missing", fx.ROUTE_KINDS),
    "q_fx_includes": _values("path, target, anchored, found", fx.INCLUDED),
    "q_fx_declarations": _values("kind, name, detail", fx.DECLARED[1]),
    "q_fx_calls": _values("line, how, callee, callback, conditional", fx.CALLED),
    "q_fx_outlines": _values("outline", [(x,) for x in fx.OUTLINES]),
    "q_fx_sink_distance": _values("node, distance", fx.DISTANCES),
    "q_fx_errors": _values("path, data_only, failed, too_large", [("a.php", False, True, False), ("b.php", True, False, False), ("c.php", False, False, False), ("d.php", True, True, True)]),
}
