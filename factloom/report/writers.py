"""Writers of a report. Tables of any size go out in parallel; single documents are for reports that a person reads.

A single document has all findings in report order, streamed through the driver, or the first ``most`` with a flag if there were more.
"""

from __future__ import annotations

import html
import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
MOST = 5000


def in_order(findings: DataFrame) -> DataFrame:
    rank = F.lit(0)
    for k, v in RANK.items():
        rank = F.when(F.col("severity") == k, v).otherwise(rank)
    return findings.orderBy(rank.desc(), "path", "line", "col", "finding_id")


def summary(findings: DataFrame) -> dict:
    """Counts by severity, files, and the exit status of a run: 1 if anything is critical or high."""
    row = findings.agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in RANK]).first().asDict()
    return {**row, "exit_status": int(row["critical"] + row["high"] > 0)}


def exit_status(findings: DataFrame, errors: int = 0) -> int:
    return 2 if errors else summary(findings)["exit_status"]


def write_lines(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def write_csv(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").option("header", True).csv(path)


def _top(findings: DataFrame, most: int) -> tuple[list[dict], bool]:
    rows = [r.asDict() for r in in_order(findings).limit(most + 1).collect()]
    return rows[:most], len(rows) > most


def write_text(text: str | Iterable[str], path: str) -> None:
    """All or nothing: a temporary file beside the target, synced, then put in its place."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".report-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.writelines([text] if isinstance(text, str) else text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def document(findings: DataFrame, most: int = MOST) -> dict:
    rows, more = _top(findings, most)
    return {"summary": summary(findings), "findings": rows, "findings_truncated": more}


def _listed(head: str, rows: Iterable[str], tail: str) -> Iterable[str]:
    yield head
    for k, r in enumerate(rows):
        yield (",\n" if k else "\n") + r
    yield tail


def write_rows(df: DataFrame, path: str, head: str = "[", tail: str = "\n]\n") -> None:
    """The rows, in their order, as one JSON list."""
    write_text(_listed(head, (json.dumps(r.asDict(True), ensure_ascii=False) for r in df.toLocalIterator()), tail), path)


def write_json(findings: DataFrame, path: str, most: int | None = None) -> None:
    if most is not None:
        write_text(json.dumps(document(findings, most), ensure_ascii=False, indent=1), path)
        return
    write_rows(in_order(findings), path, '{"summary": ' + json.dumps(summary(findings)) + ', "findings": [', '\n], "findings_truncated": false}\n')


def _result(r: dict, at: dict[str, int]) -> dict:
    return {
        "ruleId": r["sink_name"], "ruleIndex": at[r["sink_name"]], "level": LEVELS.get(r["severity"], "note"), "message": {"text": f"{r['origin']} reaches {r['sink_name']}"}, "partialFingerprints": {"finding": r["finding_id"]},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": max(r["line"] or 1, 1), "startColumn": max(r["col"] or 1, 1)}}}],
    }


def sarif(findings: DataFrame, most: int = MOST) -> dict:
    """SARIF 2.1.0 with a rule per sink name."""
    rows, more = _top(findings, most)
    rules = sorted({r["sink_name"] for r in rows})
    at = {r: i for i, r in enumerate(rules)}
    results = [_result(r, at) for r in rows]
    run = {"tool": {"driver": {"name": "factloom", "rules": [{"id": r} for r in rules]}}, "results": results, "properties": {"truncated": more}}
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}


def write_sarif(findings: DataFrame, path: str, most: int | None = None) -> None:
    if most is not None:
        write_text(json.dumps(sarif(findings, most), ensure_ascii=False), path)
        return
    rules = sorted(r.sink_name for r in findings.select("sink_name").distinct().collect())
    at = {r: i for i, r in enumerate(rules)}
    empty = sarif(findings.limit(0))
    empty["runs"][0]["tool"]["driver"]["rules"] = [{"id": r} for r in rules]
    head, tail = json.dumps(empty, ensure_ascii=False).rsplit('"results": []', 1)
    rows = (json.dumps(_result(r.asDict(), at), ensure_ascii=False) for r in in_order(findings).toLocalIterator())
    write_text(_listed(head + '"results": [', rows, "]" + tail), path)


def write_html(findings: DataFrame, path: str, most: int | None = None) -> None:
    """A self-contained page; every value is escaped."""
    rows, more = _top(findings, most) if most is not None else ((r.asDict() for r in in_order(findings).toLocalIterator()), False)
    cols = ["severity", "confidence", "path", "line", "sink_name", "origin"]
    cell = lambda v: html.escape("" if v is None else str(v))
    body = ("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in cols) + "</tr>\n" for r in rows)
    head = "".join(f"<th>{c}</th>" for c in cols)
    counts = ", ".join(f"{k}: {v}" for k, v in summary(findings).items())
    write_text((x for part in ([f"<!doctype html><meta charset='utf-8'><title>Findings</title><p>{cell(counts)}{' (cut off)' if more else ''}</p><table><tr>{head}</tr>\n"], body, ["</table>\n"]) for x in part), path)


def text(findings: DataFrame, most: int = 200) -> str:
    rows, more = _top(findings, most)
    lines = [f"{r['severity']:<8} {r['path']}:{r['line']}:{r['col']} {r['origin']} -> {r['sink_name']}" for r in rows]
    return "\n".join([*lines, *(["..."] if more else []), ", ".join(f"{k}: {v}" for k, v in summary(findings).items())])


def recompact(findings: DataFrame, most: int = 32) -> DataFrame:
    """A saved report with at most ``most`` findings a sink and file, one of each origin first, and how many there were; nothing is scanned again."""
    from factloom.operators import ranking

    rank = F.lit(0)
    for k, v in RANK.items():
        rank = F.when(F.col("severity") == k, v).otherwise(rank)
    total = findings.groupBy("path", "sink_name").agg(F.count("*").alias("total"))
    kept = ranking.representatives(findings, ["path", "sink_name"], ["origin"], [rank.desc(), F.col("line"), F.col("finding_id")], most)
    return kept.join(total, ["path", "sink_name"]).withColumn("truncated", F.col("total") > most)
