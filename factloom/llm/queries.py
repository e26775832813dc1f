"""Queries of the operators for text corpora, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import copies, language, mixing, tokenize, validity
from factloom.store import once, table


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.flags(table(spark, sf_dir, "source_file"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).where("valid = false").select("file_id")


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its flag, phase, message, line, and the dialects that accept it."""
    return _flags(spark, sf_dir)


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.rates(_flags(spark, sf_dir))


def p4_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.with_log(_flags(spark, sf_dir), table(spark, sf_dir, "scan_error"))


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return once(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(_documents(spark, sf_dir, "text"))


def p7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per source and vocabulary."""
    docs = _documents(spark, sf_dir, "text", "source")
    one = lambda v: tokenize.sizes(docs, "doc_id", "text", ["source"], tokenize.vocabulary(v)).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens")).withColumn("vocabulary", F.lit(v))
    return one("byte_bpe_50k").unionByName(one("byte_bpe_multi_50k"))


def _mix(spark: SparkSession, sf_dir: str):
    sized = tokenize.sizes(_documents(spark, sf_dir, "text", "source"), "doc_id", "text", ["source"])
    return mixing.select(sized, table(spark, sf_dir, "mix_target"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the selection."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir, "text", "lang")
    return docs, language.segments(docs, language.fit(docs))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, segs = _segments(spark, sf_dir)
    cases = language.documents(docs, segs).where("is_case")
    return cases.select("doc_id", F.explode("langs").alias("lang"))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.documents(*_segments(spark, sf_dir))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)[1]


QUERIES = {
    **copies.QUERIES, "p4_found": p4_found, "p4_flags": p4_flags, "p4_rates": p4_rates, "p4_log": p4_log, "p7_ids": p7_ids, "p7_sizes": p7_sizes,
    "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_documents": p9_documents, "p9_segments": p9_segments,
}
#: The others cannot be told in SQL; their tests are brute force, exact round trips and held-out accuracy.
ORACLE: dict[str, str] = {**copies.ORACLE}
