import random

from factloom.operators import hierarchy
from factloom.store import Scratch


def brute(edges):
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e if x is not None}:
        seen, todo = set(), [n]
        while todo:
            for y in up.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[n] = seen
    return out


def check(spark, edges, gap):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    want = brute(edges)
    cyclic = {a for a, bs in want.items() if a in bs}
    into = {(a, None) for a, bs in want.items() if a in cyclic or bs & cyclic}
    if gap < 64:
        assert {(r.src, r.dst) for r in hierarchy.reach(df, gap=gap).collect()} == {(a, b) for a, bs in want.items() for b in bs} | into
    ends = spark.createDataFrame([(x,) for x in list(want)[::2]] or [(0,)], "id bigint")
    keep = {x.id for x in ends.collect()}
    assert {(r.src, r.dst) for r in hierarchy.reach(df, ends, gap).collect()} == {(a, b) for a, bs in want.items() for b in bs if b in keep} | into


def test_chain_cycle_diamond_and_nulls(spark):
    chain = [(i, i + 1) for i in range(40)]
    check(spark, chain + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 200), (300, 301), (300, 302), (301, 303), (302, 303), (None, 1), (1, None), (0, 1)], 3)


def test_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)]
    for gap in (2, 64):
        check(spark, edges, gap)


def test_no_edges(spark):
    assert hierarchy.reach(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_paths(spark):
    rows = [(i, i - 1 if i else None) for i in range(30)] + [(100, 101), (101, 100), (102, 100), (200, 200), (300, None)]
    got = {r.id: r for r in hierarchy.paths(spark.createDataFrame(rows, "id bigint, up bigint")).collect()}
    assert len(got) == len(rows)
    for i in range(30):
        assert got[i].root_id == 0 and got[i].depth == i and got[i].path == list(range(i + 1)) and not got[i].in_cycle
    for i in (100, 101, 102, 200):
        assert got[i].in_cycle and got[i].root_id is None and got[i].path is None
    assert got[300].depth == 0 and got[300].root_id == 300


def test_class_links(spark, tmp_path):
    from factloom.plans.p1_hierarchy import p1_found

    schema = "class_id bigint, repo_id int, full_name string, resolved_parent string, resolved_interfaces array<string>, traits string, nid bigint"
    rows = [
        (1, 1, "A\\B", None, None, None, 7), (2, 1, "\\a\\\\c ", "\\A\\b", [None, ""], None, 7), (3, 1, "A\\B", "", [], None, 7), (4, 2, "A\\D", "A\\B", None, None, 7),
        (5, 1, "L", "l", None, None, 7), (6, 1, "M", "L", ["A\\C"], None, 7), (6, 1, "M", "L", ["A\\C"], None, 7), (7, None, "x", "y", None, None, 7), (None, 1, "q", "L", None, None, 7), (8, 1, None, "M", None, None, 7),
    ]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/class_symbol.parquet")
    got = {(r.class_id, r.root_id) for r in p1_found(spark, str(tmp_path)).collect()}
    assert got == {(2, 1), (2, 3), (5, 0), (6, 0), (6, 1), (6, 3), (8, 0), (8, 1), (8, 3)}


def test_scratch_drop(spark):
    s = Scratch(spark, "t")
    a = s.cut(spark.range(3))
    b = s.cut(spark.range(4))
    assert s.union([a, b]).count() == 7
    s.drop(a, None)
