"""Corpus pipeline: quality filter, exact dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it
again as the next stage's documents. All but the last return the columns of ``documents``, whatever other columns there are. Null and empty texts are
documents like any other, ids may repeat or be null, very long texts are read whole, and an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import exact_dedup, packing, quality, secret_scan, simhash
from siftline.llm.common import table, written
from siftline.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds to be good (probability of 0.5 or more) stay; a null text is scored as the empty one, repeated rows alike."""
    net = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, net, name="__sl_score").where("__sl_score >= 0.5").drop("__sl_score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, the smallest doc_id; null and empty texts are equal. Rows are told apart by id and text, so repeated ids cost no text."""
    return exact_dedup.drop_copies(docs, keep="smallest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles; candidates are complete) the smallest doc_id stays; texts without words are alike."""
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars counts the new text; no document goes, and null and empty texts stay as they are."""
    found = secret_scan.redact(docs, secret_scan.train(spark), n_secrets="__sl_secrets")
    changed = F.when(F.col("__sl_secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).drop("__sl_secrets")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a null or empty text is one piece with the end id."""
    return packing.pack(docs, tokenizer_path(), window=2048, end_id=1).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The classifier, near copies, the forest and packing are no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
