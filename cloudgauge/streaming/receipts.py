"""A growing call log, folded as it arrives.

Two standing queries: the first valid answer of every cell, and cost per model and day.
What they know of earlier batches is keyed state in the state store of their checkpoint:
one record per cell, and one per model and window until the watermark has passed it. A
batch reads its own rows and the state of their keys, never earlier output. Both write one folder
per micro-batch, named by batch id, so a batch that is run again after a failure replaces
its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cloudgauge.functions.params import ANSWER_BOUNDS, PARAM_NAMES
from cloudgauge.operators.answers import validate_answer


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def valid_answers(log: DataFrame, content: str, keep: Sequence[str], params: Sequence[str] = PARAM_NAMES, bounds: dict = ANSWER_BOUNDS) -> DataFrame:
    """The rows logged as ok whose answer validates: (keep, params)."""
    ok = validate_answer(log.filter(F.col("status") == "ok"), content, params, bounds).filter(F.col("answer_status") == "ok")
    return ok.select(*keep, *[F.col("answer")[p].alias(p) for p in params])


def stream_compile_receipts(
    log: DataFrame,
    out: str,
    checkpoint: str,
    cell: str,
    order: str,
    fold: Callable[[DataFrame], DataFrame] | None = None,
    content: str = "response_content",
    keep: Sequence[str] = (),
) -> StreamingQuery:
    """A cell keeps its first valid answer in log order.

    The state of a cell is the answer with the least `order` so far; a batch writes the
    cells whose record it has changed, and `read_compiled` takes the newest of each. Rows
    may arrive in any order, also over restarts: an earlier row replaces a later one. Of
    rows with equal order the one with the least answer counts. `fold` replaces the check
    of single rows; it returns cell, order and what else is kept.
    """
    columns = list(dict.fromkeys([cell, order, *keep]))
    answers = fold(log) if fold else valid_answers(log, content, columns)
    rest = [c for c in answers.columns if c not in (cell, order)]
    firsts = answers.groupBy(cell).agg(F.min(F.struct(order, *rest)).alias("__first")).select(cell, "__first.*")
    return _batches(firsts, out, checkpoint)


def _batches(changed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        changed.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The row of the latest batch for every key."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("__v")).select(*keys, "__v.*")


def read_compiled(spark: SparkSession, out: str, cell: str, order: str) -> DataFrame:
    return _newest(spark, out, [cell])


def stream_cost(
    log: DataFrame,
    out: str,
    checkpoint: str,
    ts: str,
    model: str,
    tokens_in: Column,
    tokens_out: Column,
    window: str = "1 day",
    lateness: str = "2 days",
) -> StreamingQuery:
    """Calls and tokens per model and event-time window.

    Update mode hands every batch the windows it changed. A row is late, and left out, if
    its window ended at or before the largest event time of earlier batches less
    `lateness`; the state of such windows is dropped. `read_stream_cost` keeps the newest
    row per window, `late_rows` says how many were left out.
    """
    sums = (
        log.withWatermark(ts, lateness)
        .groupBy(F.window(ts, window).alias("w"), model)
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(F.coalesce(tokens_in, F.lit(0))).alias("tokens_in"),
            F.sum(F.coalesce(tokens_out, F.lit(0))).alias("tokens_out"),
        )
        .select(F.col("w.start").alias("window_start"), model, "calls", "tokens_in", "tokens_out")
    )
    return _batches(sums, out, checkpoint)


def read_stream_cost(spark: SparkSession, out: str, model: str) -> DataFrame:
    return _newest(spark, out, ["window_start", model])


def late_rows(arrived: DataFrame, costs: DataFrame, model: str) -> DataFrame:
    """Per model: rows of the log that arrived, were counted, and came too late."""
    there = arrived.groupBy(model).agg(F.count(F.lit(1)).alias("arrived"))
    counted = costs.groupBy(model).agg(F.sum("calls").alias("counted"))
    joined = there.join(counted, model, "left").fillna(0, subset=["counted"])
    return joined.withColumn("late", F.col("arrived") - F.col("counted"))
