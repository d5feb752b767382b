"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents; other
columns pass through. Rows are never sampled; a stage works on all the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudgauge.llm import packing, privacy, quality, repeats, similar
from cloudgauge.llm.common import written

MIN_QUALITY = 0.3
MIN_REPEAT_BYTES = 256  # about forty words
MIN_REPEAT_WORDS = 51

NAMES = {"cell_id": "doc_id", "response_content": "text"}


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The documents with another text, and its length where that is a column."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; null texts are scored as
    empty ones. The classifier learns from the labels of the documents that are here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_attention_model(docs, labels, "quality", MIN_QUALITY, **NAMES)
    scored = quality.quality_scores(docs, model, "_quality_score", NAMES["response_content"])
    return scored.filter(F.col("_quality_score") >= MIN_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (brought together by SimHash and
    by least hashes, and confirmed: four fifths of all their five-word shingles in common): the one with the smallest id, nulls last, of rows that
    share it the one with the least text. Documents that are unlike stay, also if they
    have one id or none."""
    grouped = similar.similar_groups(docs, shingle_words=5, keep=docs.columns, **NAMES)
    first = Window.partitionBy("component_key").orderBy(F.asc_nulls_last("doc_id"), "text")
    return grouped.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every passage of `MIN_REPEAT_BYTES` bytes or `MIN_REPEAT_WORDS` words that
    occurs twice or more, all places of it; a letter that is cut in two goes too. All documents stay."""
    cleared = repeats.remove_repeats(docs, MIN_REPEAT_BYTES, keep=docs.columns, min_words=MIN_REPEAT_WORDS, **NAMES)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(repeats.whole_letters(F.col("kept")))
    return with_text(cleared, text).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    found = privacy.pii_spans(docs, keep=docs.columns, **NAMES)
    return with_text(found, privacy.redacted(F.col("text"), F.col("pii_spans"))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048, one row per piece of a document."""
    pieces = packing.pack_responses(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1, **NAMES)
    return pieces.select(
        F.col("cell_id").alias("doc_id"),
        F.col("piece_start").alias("start"),
        "length",
        "ids",
        F.col("answer_tokens").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]
# the classifier, the fingerprints and the tokens have no SQL; tests hold stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
