"""Command line: scan a source tree, list its chains, or check the rules."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession

WRITERS = {"json": "write_json", "sarif": "write_sarif", "html": "write_html", "lines": "write_lines", "csv": "write_csv"}


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="factloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "find-gadgets"):
        s = sub.add_parser(name)
        s.add_argument("target")
        s.add_argument("--output")
        s.add_argument("--format", choices=sorted(WRITERS), help="by the extension of --output if not given")
        s.add_argument("--max-bytes", type=int, default=5_000_000)
        s.add_argument("--exclude", action="append", default=[])
        s.add_argument("--min-severity", choices=["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"], default="INFO")
        s.add_argument("--max-depth", type=int, default=6)
        s.add_argument("--php-version", type=_version, help="branches that this version does not take are not followed")
        s.add_argument("--library", action="store_true", help="parameters of public functions and methods are sources")
        s.add_argument("--max-nodes", type=int, help="files with more syntax nodes are reported and not read")
        s.add_argument("--max-paths", type=int, help="a level of more paths ends the search for chains, which is marked")
        s.add_argument("--rules-dir", action="append", default=[], help="folder of YAML rules, beside the built-in ones")
        s.add_argument("--no-builtin-rules", action="store_true")
        s.add_argument("--rules-output", help="matches of the rules, as lines of JSON")
    v = sub.add_parser("verify-rules")
    v.add_argument("folder", nargs="*")
    return p.parse_args(argv)


def _version(text: str) -> str:
    if not re.fullmatch(r"\d+\.\d+(\.\d+)?", text):
        raise argparse.ArgumentTypeError("a version is like 8.1 or 8.1.2")
    return text


def _texts(folders: list[str]) -> dict[str, str]:
    """Texts of all YAML files below the folders, by path."""
    from pathlib import Path

    return {str(p): p.read_text(encoding="utf-8") for f in folders for p in sorted(Path(f).rglob("*")) if p.suffix in (".yml", ".yaml")}


def main(argv: list[str] | None = None) -> int:
    from factloom.code import analysis

    o = options(argv)
    if o.command == "verify-rules":
        good, bad = analysis.read_rules(_texts(o.folder)) if o.folder else analysis.check_rules(analysis.RULES)
        for rid, why in bad:
            print(f"{rid}: {why}")
        print(f"{len(good)} rules, {len(bad)} not usable")
        return int(bool(bad))
    from factloom.code.facts import extract
    from factloom.plans.code import findings_of
    from factloom.plans.relational import category
    from factloom.report import writers
    from factloom.sources.files import EXCLUDED, discover

    spark = SparkSession.builder.appName("factloom").getOrCreate()
    files, errors = discover(spark, o.target, excluded=(*EXCLUDED, *o.exclude), most_bytes=o.max_bytes)
    code = analysis.Code(extract(files, o.php_version, o.max_nodes))
    if o.command == "find-gadgets":
        chains = code.store.cut(code.chains(code.call_graph(category), o.max_depth, o.max_paths)).orderBy("length", "chain_id")
        if o.output:
            writers.write_rows(chains, o.output)
        else:
            chains.show(200, False)
        return 0
    if o.rules_output:
        extra, bad = analysis.read_rules(_texts(o.rules_dir))
        for rid, why in bad:
            print(f"{rid}: {why}", file=sys.stderr)
        rules, _ = analysis.check_rules([*([] if o.no_builtin_rules else analysis.RULES), *extra])
        code.matches(analysis.rules_for(rules, o.php_version) if o.php_version else rules).write.mode("overwrite").json(o.rules_output)
    found = findings_of(code, o.library, o.php_version)
    keep = [s for s, r in writers.RANK.items() if r >= writers.RANK[o.min_severity]]
    found = code.store.cut(found.where(found.severity.isin(*keep)))
    if o.output:
        kind = o.format or {"sarif": "sarif", "html": "html", "csv": "csv", "jsonl": "lines"}.get(o.output.rsplit(".", 1)[-1], "json")
        getattr(writers, WRITERS[kind])(found, o.output)
    else:
        print(writers.text(found))
    told = errors.limit(101).collect()
    for e in told[:100]:
        print(f"{e.phase}: {e.file_path}: {e.message}", file=sys.stderr)
    if len(told) > 100:
        print("... more errors are in the table", file=sys.stderr)
    return writers.exit_status(found, 0 if errors.where("phase = 'discovery'").isEmpty() else 1)


if __name__ == "__main__":
    sys.exit(main())
