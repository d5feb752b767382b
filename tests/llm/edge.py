"""A small call log with everything that can go wrong in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLAIN = "The answer lists gains and bands, then a word about warmth.\nNothing else is said about it."
LONG_WORD = "x" * 30_000
NUMBERS = "7 " * 20_000
CLASHES = ("token_ids", "decoded", "spans", "pii_spans", "candidates", "base_spans", "fingerprint", "component_id",
           "n_shingles", "kept", "n_bytes", "text", "row", "value", "start", "end", "key", "node", "words", "language", "cell", "part")


def rows() -> list[tuple]:
    texts = [PLAIN, None, "", "   \n\t ", PLAIN, LONG_WORD, NUMBERS, "é" * 500, PLAIN + " More.", "one", "a b c", "\x00\x01 \x85   ünï 𝔘"]
    out = [(i, t, "m", "a", "p") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, "no id here", None, None, None), (None, None, None, None, None)]


def receipts(spark: SparkSession, empty: bool = False) -> DataFrame:
    df = spark.createDataFrame([] if empty else rows(), "cell_id long, response_content string, model string, arm string, profile string")
    for name in CLASHES:
        df = df.withColumn(name, df["arm"])
    return df
