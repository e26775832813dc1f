"""Source files that do not parse, flagged per file by a generalised LL parser that runs all dialects of a language together.

A file is a case if no supported dialect of the language of its extension accepts it. A null content or an extension of
no known language is not judged (valid is null). An empty file is valid but for JSON. Redelivered rows count once; rows
without a file_id each count.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.syntax import jsontext, php, yamltext
from factloom.store import spread

#: Extension -> (language, template); the extension is what follows the last dot, in any letter case.
LANGUAGES = {
    "php": ("php", False), "inc": ("php", False), "module": ("php", False), "phtml": ("php", True), "tpl": ("php", True),
    "json": ("json", False), "yaml": ("yaml", False), "yml": ("yaml", False),
}
SUPPORTED = ("8.1", "json", "yaml")


def check(path: str | None, content: bytes | None) -> tuple[str | None, list[str] | None, str | None, int]:
    """(language, dialects that accept, what is wrong, line)."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].strip().lower()
    language, template = LANGUAGES.get(name.rsplit(".", 1)[-1] if "." in name else "", (None, False))
    if language is None or content is None:
        return language, None, None, 0
    if language == "php":
        ok, what, line = php.check(content, template)
        return language, [d for i, d in enumerate(php.DIALECTS) if ok >> i & 1], what, line
    ok, what, line = (jsontext if language == "json" else yamltext).check(content)
    return language, [language] if ok else [], what, line


_SCHEMA = "file_id bigint, repo_id int, file_path string, language string, valid boolean, dialects array<string>, phase string, message string, line int"


def _flags(supported: tuple[str, ...]):
    def run(batches):
        for b in batches:
            out = []
            for fid, repo, path, content in zip(*(c.to_pylist() for c in b.columns)):
                language, dialects, what, line = check(path, content)
                valid = None if dialects is None else any(d in supported for d in dialects)
                bad = valid is False
                out.append((fid, repo, path, language, valid, dialects, "parse" if bad else None, what if bad else None, line if bad else None))
            cols = list(zip(*out)) or [()] * 9
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def flags(files: DataFrame, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """A row per file of ``files(file_id, repo_id, file_path, content)``; contents do not leave the first stage but to fill idle cores."""
    f = spread(files.select(F.col("file_id").cast("bigint"), F.col("repo_id").cast("int"), "file_path", "content"), "file_id")
    # rows without an id are each a file of their own
    own = F.when(F.col("file_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    return f.mapInArrow(_flags(supported), _SCHEMA).withColumn("own", own).dropDuplicates(["file_id", "own"]).drop("own")


def rates(flagged: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language, with totals (null repo_id or language)."""
    g = flagged.where("valid IS NOT NULL").cube("repo_id", "language")
    return g.agg(F.grouping_id().alias("level"), F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


def _path(c):
    """A path in one notation, to meet the log's."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"\\+", "/")
    return F.regexp_replace(F.regexp_replace(c, r"/(?:\./)+|/{2,}", "/"), r"^(?:\./|/)+", "")


def with_log(flagged: DataFrame, errors: DataFrame) -> DataFrame:
    """Each flagged or logged file with what the scanner's own log says: ``told`` is true if it has a parse error of that file."""
    e = errors.where("file_path IS NOT NULL").select("repo_id", _path(F.col("file_path")).alias("p"), F.regexp_replace(F.lower(F.trim("phase")), r"[^a-z]", "").alias("phase"), "message")
    e = e.groupBy("repo_id", "p").agg(F.max(F.coalesce(F.col("phase").isin("parse", "syntax"), F.lit(False))).alias("told"), F.min("message").alias("log_message"))
    f = flagged.withColumn("p", _path(F.col("file_path")))
    return f.join(e, ["repo_id", "p"], "left").drop("p").withColumn("told", F.coalesce("told", F.lit(False))).where("valid = false OR told")
