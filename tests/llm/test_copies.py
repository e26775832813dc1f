"""Canonical copies on small tables with odd rows."""

from pyspark.sql import functions as F

from factloom.llm import canonical, location, streams


def keys(spark, raws):
    df = spark.createDataFrame([(i, 5, r) for i, r in enumerate(raws)], "id int, scan int, raw string")
    return [r.k for r in df.select("id", location.key(F.col("scan"), F.col("raw")).alias("k")).orderBy("id").collect()]


def test_location_notations_agree(spark):
    ks = keys(spark, [
        '{"file_path":"src/\\u00dcber/A.php","start_line":1,"start_col":"2","end_line":3,"end_col":null}', "FilePath= SRC\\Über\\a.PHP ; start-line=01;startCol=2.0;end_line = 3",
        "file_path: .::src::ÜBER::A.php | start_line: 1 | start_col: 2 | end_line: 3 | end_col: ", '<loc startLine="1" file_path="`src/&#220;ber/A.php`" START_COL="2" end_line="3"/>',
        '\n {"end_line": 3, "x": {"y": 1}, "start_line": 1, "start_col": 2, "filepath": "(src/Über/A.php)", "start_line": 1}',
    ])
    assert len(set(ks)) == 1


def test_location_odd_texts(spark):
    ks = keys(spark, [None, "", "  ", "{}", '{"file_path": "a', "nothing", '{"file_path":"a"}', '{"file_path":"a","start_line":"x"}', "x" * 200_000])
    assert ks[0] == ks[1] == ks[2] == ks[3]
    assert len(set(ks[3:])) == 6


def test_copies_hot_and_cold_keys_agree(spark):
    rows = [(f"k{i % 7}" if i % 3 else "hot", i) for i in range(300)] + [("k1", 1), (None, 900), (None, 901), ("k1", None)]
    df = spark.createDataFrame(rows, "key string, id bigint")
    want = {}
    for k, i in rows:
        if k is not None and i is not None:
            want.setdefault(k, set()).add(i)
    expect = {(min(s), i) for s in want.values() for i in s} | {(900, 900), (901, 901)}
    for floor, ways in ((1, {True, False}), (50, {True, False}), (10_000, {False})):
        got = canonical.copies(df, parts=4, floor=floor, salts=3).collect()
        assert {(r.first_id, r.id) for r in got} == expect and len(got) == len(expect) and {r.hot for r in got} == ways
    assert {(r.first_id, r.copies) for r in canonical.counts(df, parts=4, floor=50).collect()} == {(min(s), len(s)) for s in want.values()} | {(900, 1), (901, 1)}
    assert canonical.copies(df.limit(0)).count() == 0


def test_stream_of_first_copies(spark, tmp_path):
    from factloom.streaming.incremental import drain, read_table_stream

    raws = ["file_path=a;start_line=1", "FILE-PATH: A | start_line: 01", "file_path=b"]
    rows = [(i, 5, r) for i, r in enumerate(raws)]
    spark.createDataFrame(rows, "record_id bigint, scan_id bigint, raw string").selectExpr("*", "timestamp'2026-01-01 00:00:00' AS received_at").write.parquet(f"{tmp_path}/t")
    got = drain(streams.first_copies(read_table_stream(spark, f"{tmp_path}/t"), "received_at", "1 hour"), "first_copies_q").collect()
    assert len(got) == 2 and {r.key for r in got} == {r.k for r in spark.createDataFrame(rows, "i bigint, s bigint, raw string").select(location.key(F.col("s"), F.col("raw")).alias("k")).collect()}
