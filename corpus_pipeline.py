"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined results: a null or empty text has no word and goes with the quality rules, as does any text that they reject;
very long texts pass as any other; of tied and repeated rows of a group one stays; null ids, languages and
sources stay null; an empty table passes every stage and gives an empty result; further columns of docs pass the first
four stages, unless their names begin with two underscores, and the last keeps doc_id, lang and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import mixing, pieces, pii, quality, similar
from cueloom.llm.common import drop_folder, scratch_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash on five-word shingles, links checked and completed by a Jaccard similarity of 0.8; one text of each group stays."""
    return similar.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind; n_chars follows the text."""
    out = docs.withColumn("text", pii.redact(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.resampled(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [c for c in ("doc_id", "lang", "source", "text") if c in docs.columns]
    # executors have run four stages before, so a smaller block and memory
    return pieces.encode(docs.select(*keep), block=300_000, memory=60_000)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

#: Shingle sets and Viterbi encoding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, read = scratch_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if read:
            drop_folder(spark, read)
        read = f"{folder}/{name}"
    return docs
