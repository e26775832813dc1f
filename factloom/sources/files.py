"""Source trees as tables of files, and report tables back from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import paths

#: Directory names that are not searched, and the largest file that is read (defaults of a scan).
EXCLUDED = (".git", ".svn", "node_modules", "cache")
MOST_BYTES = 5_000_000


def discover(spark: SparkSession, root: str, extensions=paths.EXTENSIONS, excluded=EXCLUDED, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, errors) below a directory, or of one file.

    files: (file_id, repo_id, file_path, content, n_bytes); errors: (file_path, phase, message) for files over the limit
    and for a root that is not there. Names and sizes are tested before contents are read.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    errors = "file_path string, phase string, message string"
    if not fs.exists(p):
        files = spark.createDataFrame([], "file_id bigint, repo_id int, file_path string, content binary, n_bytes bigint")
        return files, spark.createDataFrame([(root, "discovery", "no such file or directory")], errors)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), f"^{base}/?", "")
    own = F.when(rel == "", F.substring_index("path", "/", -1)).otherwise(rel)
    t = raw.withColumn("file_path", own).where(paths.has_extension(F.col("file_path"), extensions) & paths.outside(F.col("file_path"), excluded))
    small = t.where(F.col("length") <= most_bytes) if most_bytes else t
    # paths of one hash, which are few, are told apart by their order; contents take no part in finding them
    h = F.xxhash64("file_path").bitwiseAND(F.lit((1 << 38) - 1))
    names = small.select("file_path", h.alias("h"))
    again = names.groupBy("h").count().where("count > 1").select("h")
    later = names.join(F.broadcast(again), "h", "left_semi").select("file_path", (F.row_number().over(W.partitionBy("h").orderBy("file_path")) - 1).alias("k")).where("k > 0")
    small = small.join(F.broadcast(later), "file_path", "left").withColumn("h", h)
    files = small.select((F.col("h") * 8 + F.coalesce("k", F.lit(0))).alias("file_id"), F.lit(1).alias("repo_id"), "file_path", "content", F.col("length").alias("n_bytes"))
    large = t.where(F.col("length") > (most_bytes or (1 << 62))).select("file_path", F.lit("resource_limit").alias("phase"), F.concat(F.lit("larger than "), F.lit(str(most_bytes)), F.lit(" bytes")).alias("message"))
    return files, large


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a saved report, one JSON object a line; the schema is declared, not inferred."""
    return spark.read.schema("finding_id string, file_id bigint, path string, line int, col int, sink_name string, category string, severity string, confidence string, origin string, hops int, origins bigint").json(path)
