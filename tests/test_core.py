"""Shredding, comparison and drift on small tables with odd rows."""

import json

from pyspark.sql import functions as F

from factloom.functions.json import parsed
from factloom.operators import compare, drift
from factloom.operators.shred import shred
from factloom.store import once


def test_json_unwraps_and_rejects(spark):
    texts = ['{"a":1}', json.dumps('{"a":1}'), json.dumps(json.dumps('{"a":1}')), '{"a":1', '{"a":1} x', '{"a":1},{"b":2}', "", None, "null", "[1", "{'a':1}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parsed(F.col("t")).cast("string").alias("v"))
    got = [r.v for r in df.orderBy("i").collect()]
    assert got[:3] == ['{"a":1}'] * 3 and got[3:] == [None] * 8


def test_shape_of_json_documents(spark):
    from factloom.functions import json as j

    texts = ['{"a": {"b": 1, "c d": [{"x": 1.5}, null, {"y": "t"}]}, "m": 1}', '{"a": {"b": 2}, "m": "s", "e": {}, "n": null}', "[1]", "{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", j.parsed(F.col("t")).alias("v"))
    ddl = j.shape(df, "v")
    rows = {r.i: r.s for r in df.select("i", F.from_json(F.to_json("v"), ddl).alias("s")).collect()}
    assert rows[0].a.b == 1 and [x and x.x for x in rows[0].a["c d"]] == [1.5, None, None] and rows[0].m == "1" and rows[1].m == "s" and rows[1].n is None
    assert j.shape(df.where("i > 1"), "v") is None


def test_shred_places_and_shared_types(spark):
    loc = "struct<f:string,l:int>"
    schema = f"id bigint, pos int, s struct<n:int,deep struct<m:int>>, steps array<struct<name:string,at:{loc},tags:array<string>>>, here {loc}"
    rows = [(1, 9, (2, (3,)), [None, ("a", ("x", 1), ["t", None]), ("b", None, None)], ("y", 2)), (2, None, None, [], None), (3, None, (None, None), None, None)]
    t = shred({"r": (spark.createDataFrame(rows, schema), "id")})
    assert set(t) == {"r", "r.steps", "r.steps.tags", "shared.at"} or set(t) == {"r", "r.steps", "r.steps.tags", "shared.here"}
    root = {x.owner_id: x for x in t["r"].collect()}
    assert root[1]["pos_"] == 9 and root[1]["s.deep.m"] == 3 and root[3]["s.n"] is None and len(root) == 3
    assert {(x.owner_id, tuple(x.pos), x.name) for x in t["r.steps"].collect()} == {(1, (1,), "a"), (1, (2,), "b")}
    assert {(tuple(x.pos), x.value) for x in t["r.steps.tags"].collect()} == {((1, 0), "t")}
    shared = t[next(k for k in t if k.startswith("shared"))]
    assert {(x.parent, tuple(x.pos), x.f) for x in shared.collect()} == {("r.steps", (1,), "x"), ("r", (), "y")}


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, None, 2), (3, "", 3), (4, "q", None), (None, "n", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 1, 0), (2, "", 2, 0), (3, "", 4, 0), (5, "z", 5, 0), (4, "q", None, 0)], "k bigint, s string, n bigint, key int")
    for size in (1, 2, 1000):
        got = {(r.key, r.difference) for r in compare.differences(a, b, "k", ["s", "n"], size).collect()}
        assert got == {(2, "s"), (3, "n"), (5, "only_in_second"), (None, "only_in_first")}
    nested = "k int, m map<string,int>, l array<string>, d double"
    x = spark.createDataFrame([(1, {"a": 1, "b": 2}, ["x"], float("nan")), (2, None, [], 0.0), (3, {}, None, None), (4, {"a": 1}, ["x", None], 1.0), (4, {"a": 0}, ["x"], 2.0)], nested)
    y = spark.createDataFrame([(1, {"b": 2, "a": 1}, ["x"], float("nan")), (2, {}, None, -0.0), (3, {}, None, float("nan")), (4, {"a": 1}, ["x", None], 2.0)], nested)
    assert {(r.key, r.difference) for r in compare.differences(x, y, "k", ["m", "l", "d"]).collect()} == {(2, "m"), (2, "l"), (3, "d"), (4, "l")}
    assert compare.differences(a.limit(0), b.limit(0), "k", ["s", "n"]).count() == 0
    p = compare.presence(a, b, "k", 2).agg(F.sum("ordinals"), F.sum("in_both")).first()
    assert tuple(p) == (6, 4)


def drift_rows(spark, docs):
    return spark.createDataFrame([("analysis", i, e, s, t if t is None or isinstance(t, str) else json.dumps(t)) for i, (e, s, t) in enumerate(docs)], "record_kind string, record_id bigint, exporter string, file_seq int, text string")


def test_drift_steps(spark):
    docs = [
        ("e", 1, {"a": 1, "p": {"x": "s", "y": 2}, "sites": [{"f": "q"}, None], "gone": True}), ("e", 1, {"a": None, "z": []}),
        ("e", 4, {"a": 1.5, "p": {"x2": "s", "y": 2}, "sites": [{"f": "q", "n": 1}], "z": [1], "new": "t"}), ("e", 4, "{broken"), ("e", 4, None),
        ("e", 5, json.dumps(json.dumps({"a": 1.5, "p": {"x2": "s", "y": 2}, "sites": [], "z": [], "new": "t"}))), ("f", 2, {"a": 1}), (None, 3, {"a": "x"}), ("f", None, {"a": "x"}), ("f", 9, {"a": 1, "b": 1, "c": 2}),
    ]
    got = {(r.exporter, r.file_seq, r.field_path, r.change_kind) for r in drift.changes(drift.versions(drift_rows(spark, docs), ("sites",))).collect()}
    assert got == {
        ("e", 4, "a", "retyped"), ("e", 4, "p.x", "renamed"), ("e", 4, "gone", "removed"), ("e", 4, "new", "added"), ("e", 4, "sites[].n", "added"),
        ("e", 5, "sites[].n", "removed"), ("e", 5, "sites[].f", "removed"), ("f", 9, "b", "added"), ("f", 9, "c", "added"),
    }


def test_drift_conform_follows_chained_renames(spark):
    docs = [("e", 1, {"n": 1}), ("e", 2, {"m": 2}), ("e", 3, {"k": 3}), ("e", 4, {"k": "x", "other": True, "sites": [{"q": 2}, {"q": 1}]}), ("g", 1, {"n": 5.5, "Extra": 1}), (None, 1, {"k": "z"}), ("e", 2, '{"m": NaN}'), ("e", 2, '{"m": 1, "m": 2}')]
    rows = drift_rows(spark, docs)
    fields = drift.versions(rows, ("sites",))
    named = drift.names(fields, drift.changes(fields))
    target = drift.schema_of(fields, named, "analysis")
    assert dict(target) == {"n": "string", "other": "boolean", "sites[].q": "array<bigint>", "Extra": "bigint"}
    got = {r.record_id: r for r in drift.conform(rows, named, "analysis", target, {"other": False}, ("sites",)).collect()}
    assert len(got) == len(docs) and [got[i].n for i in range(8)] == ["1", "2", "3", "x", "5.5", None, None, None]
    assert got[3].other and got[3].sites__q == [2, 1] and got[0].other is False and got[4]["Extra_"] == 1
    assert got[5].extra == {"k": ["z"]}  # of no file, so it keeps its name
    whole = drift.conform(rows, named, "analysis", [("n", "bigint")])
    assert {r.record_id: (r.n, r.extra) for r in whole.collect()}[3] == (None, {"n": ["x"], "other": ["true"], "sites[].q": ["2", "1"]})


def test_once(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 6), (2, None, 7), (None, "n", 8), (None, "n", 8)], "id bigint, t string, x int")
    want = {(1, "a", 6), (2, None, 7), (None, "n", 8)}
    for few in (0, 10):
        rows = [tuple(r) for r in once(df, "id", few).collect()]
        assert set(rows) == want and len(rows) == 4
    assert once(df.limit(0), "id").count() == 0
