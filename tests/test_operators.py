import random

from pyspark.sql import functions as F

from factloom.functions import paths, pattern, verdict
from factloom.operators import asof, graph, ranking


def test_patterns_bind_and_repeat(spark):
    rx, names = pattern.compile_pattern("$F($X, $X)")
    assert names == ["$F", "$X"]
    df = spark.createDataFrame([("copy($a, $a)",), ("copy($a, $b)",), (None,)], "t string")
    got = [r.b for r in df.select(pattern.bindings(F.col("t"), "$F($X, $X)").alias("b")).collect()]
    assert got == [{"$F": "copy", "$X": "$a"}, None, None]
    m = spark.range(1).select(pattern.message(F.lit("$A and $AB"), F.create_map(F.lit("$A"), F.lit("x"), F.lit("$AB"), F.lit("y"))).alias("m")).first().m
    assert m == "x and y"


def test_paths_and_versions(spark):
    df = spark.createDataFrame([("src/tests/A.php",), ("a\\vendor\\b.php",), ("x.php",), (None,)], "p string")
    assert [r.s for r in df.select(paths.scope(F.col("p")).alias("s")).collect()] == ["tests", "vendor", "production", "external"]
    v = spark.range(1).select(*[(paths.version(F.lit(a)) < paths.version(F.lit(b))).alias(f"c{i}") for i, (a, b) in enumerate([("7.4", "7.10"), ("8", "8.0"), ("x", "1")])]).first()
    assert tuple(v) == (True, False, None)
    g = spark.createDataFrame([("a/b/c.php", "a/*/c.*"), ("a/b/c.php", "a/*"), ("a/b", "a/c")], "p string, g string")
    assert [r.m for r in g.select(paths.glob_match(F.col("p"), F.col("g")).alias("m")).collect()] == [True, False, False]
    w = spark.range(1).select(paths.widen(F.array(*[F.lit(x) for x in "abcde"])).alias("w"), paths.truncate(F.array(*[F.lit(x) for x in "abcde"]), 3).alias("t")).first()
    assert w.w == ["a", "b", "c", None] and w.t == ["a", "d", "e"]


def test_verdict(spark):
    df = spark.createDataFrame([("85%",), ("0.5",), ("7",), ("x",), (None,), ("-3",)], "t string")
    assert [r.c for r in df.select(verdict.confidence(F.col("t")).alias("c")).collect()] == [0.85, 0.5, 0.07, None, None, None]
    d = spark.createDataFrame([('say ```json\n{"a": {"b": 1}}\n``` ok',), ("none",)], "t string")
    assert [r.o for r in d.select(verdict.json_object(F.col("t")).alias("o")).collect()] == ['{"a": {"b": 1}}', None]


def test_graph_against_brute_force(spark):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}", rnd.choice([0.4, 0.9])) for _ in range(40)]
    df = spark.createDataFrame([*edges, (None, "n1", 1.0)], "src string, dst string, confidence double")
    up = {}
    for a, b, c in edges:
        up.setdefault(a, {})
        up[a][b] = max(c, up[a].get(b, 0))
    ends = {"n1", "n2"}
    dist, level, k = {e: 0 for e in ends}, ends, 0
    while level:
        k += 1
        level = {a for a in up for b in up[a] if b in level and a not in dist}
        dist.update({a: k for a in level})
    t = spark.createDataFrame([(e,) for e in ends], "node string")
    assert {(r.node, r.distance) for r in graph.distances(df, t).collect()} == set(dist.items())

    def walk(path, conf):
        if path[-1] in ends and len(path) > 1:
            yield tuple(path), conf
            return
        if len(path) <= 4:
            for b, c in up.get(path[-1], {}).items():
                if b not in path:
                    yield from walk([*path, b], min(conf, c))

    starts = {"n5", "n6", "n7"}
    want = {x for s in starts for x in walk([s], 1.0)}
    got = graph.simple_paths(df, spark.createDataFrame([(s,) for s in starts], "node string"), t, 4)
    assert {(tuple(r.path), r.confidence) for r in got.collect()} == want
    comp = {}
    nodes = {x for a, b, _ in edges for x in (a, b)}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for a, b, _ in edges:
                for y in ((b,) if a == x else (a,) if b == x else ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        comp[n] = min(seen)
    assert {r.node: r.component for r in graph.components(df).collect()} == comp


def test_ranking_and_spans(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 4), (1, "b", 9), (1, "c", 8), (2, "a", 1)], "k int, kind string, v int")
    got = ranking.representatives(df, ["k"], ["kind"], [F.col("v")], 3)
    assert {(r.k, r.v) for r in got.collect()} == {(1, 4), (1, 8), (1, 9), (2, 1)}
    flagged = ranking.top_k_flagged(df, ["k"], [F.col("v")], 2)
    assert {(r.k, r.v, r.truncated) for r in flagged.collect()} == {(1, 4, True), (1, 5, True), (2, 1, False)}
    s = spark.createDataFrame([(1, 0, 10), (1, 2, 5), (1, 2, 3), (1, 6, 12), (1, 2, 3), (2, 0, 1)], "k int, s int, e int")
    assert {(r.k, r.s, r.e) for r in asof.innermost(s, ["k"], "s", "e").collect()} == {(1, 2, 3), (1, 6, 12), (2, 0, 1)}
    p = spark.createDataFrame([(1, 3), (1, 14), (1, 200), (2, 100)], "k int, at int")
    assert {(r.k, r.at) for r in asof.suppress(p, s, ["k"], "at", "s", "e", 1).collect()} == {(1, 14), (1, 200), (2, 100)}
    got = asof.interval_owner(p, s.select("k", "s", F.concat_ws("-", "s", "e").alias("id")), ["k"], "at", "s", "id")
    assert {(r.k, r.at, r.id) for r in got.collect()} == {(1, 3, "2-5"), (1, 14, "6-12"), (1, 200, "6-12"), (2, 100, "0-1")}


def test_scope_lookup_against_brute_force(spark, tmp_path):
    from factloom.plans.relational import q_scope_lookup

    rng = random.Random(3)
    classes = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(1, 400)])) for i in range(60)] + [(100, 3, 10)]
    sinks = [(i, rng.choice([1, 2, 3]), "a.php", rng.randrange(1, 400)) for i in range(120)] + [(200, 3, "a.php", 9), (201, 3, "a.php", 11)]
    spark.createDataFrame(classes, "class_id bigint, repo_id int, start_line int").write.parquet(f"{tmp_path}/class_symbol.parquet")
    spark.createDataFrame(sinks, "sink_id bigint, repo_id int, file_path string, start_line int").write.parquet(f"{tmp_path}/sink_inventory.parquet")
    want = {s: max(((at, c) for c, r, at in classes if r == repo and at is not None and at <= line), default=(0, None))[1] for s, repo, _, line in sinks}
    assert {r.sink_id: r.class_id for r in q_scope_lookup(spark, str(tmp_path)).collect()} == want
