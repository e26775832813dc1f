import json

from pyspark.sql import functions as F

from factloom import cli
from factloom.report import writers
from factloom.sources.files import discover, read_report
from factloom.streaming import incremental

ROWS = [("f1", 1, "a.php", 3, 1, "unserialize", "DESERIALIZATION", "CRITICAL", "HIGH", "$_GET['<x>']", 1, 1), ("f2", 2, "b.php", None, None, "unlink", "FILE_DELETE", "LOW", "LOW", None, 2, 1)]
SCHEMA = "finding_id string, file_id bigint, path string, line int, col int, sink_name string, category string, severity string, confidence string, origin string, hops int, origins bigint"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    writers.write_json(df, f"{tmp_path}/r.json", 1)
    doc = json.load(open(f"{tmp_path}/r.json"))
    assert doc["findings_truncated"] and doc["findings"][0]["finding_id"] == "f1" and doc["summary"]["critical"] == 1
    s = writers.sarif(df)
    assert s["version"] == "2.1.0" and [r["level"] for r in s["runs"][0]["results"]] == ["error", "note"]
    writers.write_html(df, f"{tmp_path}/r.html")
    assert "&lt;x&gt;" in open(f"{tmp_path}/r.html").read()
    writers.write_lines(df, f"{tmp_path}/lines")
    assert sorted(tuple(r) for r in read_report(spark, f"{tmp_path}/lines").collect()) == sorted(ROWS)
    assert writers.exit_status(df) == 1 and writers.exit_status(df.where("severity = 'LOW'")) == 0 and writers.exit_status(df, 1) == 2
    assert "unserialize" in writers.text(df) and not [p for p in tmp_path.iterdir() if p.name.startswith(".report")]
    empty = df.limit(0)
    assert writers.document(empty)["findings"] == [] and writers.sarif(empty)["runs"][0]["results"] == []


def test_discover_and_cli(spark, tmp_path, capsys):
    tree = tmp_path / "t"
    for name, text in (("src/a.PHP", "<?php unserialize($_GET['x']);"), ("node_modules/b.php", "<?php"), ("c.txt", "x"), ("big.php", "x" * 500)):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    files, errors = discover(spark, str(tree), most_bytes=400)
    assert [r.file_path for r in files.collect()] == ["src/a.PHP"]
    assert [(r.file_path, r.phase) for r in errors.collect()] == [("big.php", "resource_limit")]
    one, _ = discover(spark, str(tree / "src" / "a.PHP"))
    assert [r.file_path for r in one.collect()] == ["a.PHP"]
    none, missing = discover(spark, str(tmp_path / "nowhere"))
    assert none.count() == 0 and missing.count() == 1
    assert cli.main(["scan", str(tree), "--output", str(tmp_path / "o.sarif")]) == 1
    assert json.load(open(tmp_path / "o.sarif"))["runs"][0]["results"][0]["ruleId"] == "unserialize"
    assert cli.main(["verify-rules"]) == 0
    assert cli.main(["scan", str(tmp_path / "nowhere")]) == 2


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(" Parse", "2026-01-01 00:00:00"), ("parse", "2026-01-01 00:00:10"), ("rules", "2026-01-01 00:00:20")], "phase string, t string").withColumn("logged_at", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = incremental.read_table_stream(spark, f"{tmp_path}/in")
    got = incremental.drain(incremental.error_counts(s, "logged_at", "1 hour", "1 hour"), "errors_q", "complete")
    assert {(r.phase, r.n) for r in got.collect()} == {("parse", 2), ("rules", 1)}
    f = spark.createDataFrame([(1, 1, "a.php", bytearray(b"<?php class A {}"))], "file_id bigint, repo_id int, file_path string, content binary")
    f.write.parquet(f"{tmp_path}/files")
    facts = incremental.drain(incremental.facts_stream(incremental.read_table_stream(spark, f"{tmp_path}/files")), "facts")
    assert facts.first().classes[0].name == "A"


def test_documents_hold_all_findings_and_chains_go_to_output(spark, tmp_path):
    n = 5003
    df = spark.range(n).selectExpr("concat('f', id) AS finding_id", "id AS file_id", "'a.php' AS path", "CAST(id AS INT) AS line", "1 AS col", "'unlink' AS sink_name", "'FILE_DELETE' AS category", "'LOW' AS severity", "'LOW' AS confidence", "'$_GET' AS origin", "1 AS hops", "1L AS origins")
    for kind in ("json", "sarif", "html"):
        getattr(writers, f"write_{kind}")(df, f"{tmp_path}/all.{kind}")
    doc = json.load(open(f"{tmp_path}/all.json"))
    assert not doc["findings_truncated"] and [f["line"] for f in doc["findings"]] == list(range(n))
    assert len(json.load(open(f"{tmp_path}/all.sarif"))["runs"][0]["results"]) == n
    assert open(f"{tmp_path}/all.html").read().count("<tr>") == n + 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.php").write_text("<?php class A { function __destruct() { unlink($this->f); } }")
    assert cli.main(["find-gadgets", str(tmp_path / "t"), "--output", str(tmp_path / "chains.json")]) == 0
    assert [c["length"] for c in json.load(open(tmp_path / "chains.json"))] == [2]
