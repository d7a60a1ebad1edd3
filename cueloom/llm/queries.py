"""Queries over the corpus tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, language_id, licenses, mixing, pieces, pii, quality, resampling, simhash, substring_dedup, suffix_dedup, token_counts
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below a directory of their source and language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out; predicts every document from its text alone."""
    docs = table(spark, sf_dir, "documents")
    # a null id counts as the empty text
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_licenses": op2_licenses,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_nearest": op6_nearest,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_pieces": op9_pieces,
    "op10_repeats": op10_repeats,
    "op11_codes": op11_codes,
    "op12_resampling": op12_resampling,
    "op13_passages": op13_passages,
}

ORACLES = {
    "op2_licenses": licenses.oracle("concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), doc_id::VARCHAR)"),
    "op5_mixing": mixing.ORACLE_SQL,
    "op8_quality": quality.ORACLE_SQL,
    "op11_codes": codes.oracle(),
    "op12_resampling": resampling.ORACLE_SQL,
    "op13_passages": substring_dedup.ORACLE_SQL,
}
