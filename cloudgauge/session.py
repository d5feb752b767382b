"""Session settings and the shared scratch folder.

On a cluster the caller's session is used as it is; `local_session` is for tests,
the bench and notebooks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_FALLBACK: list[str] = []


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "cloudgauge", scratch: str | None = None) -> SparkSession:
    """A session on this machine; `scratch` names the folder for intermediate tables."""
    builder = SparkSession.builder if scratch is None else SparkSession.builder.config(CHECKPOINT_KEY, scratch)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _conf(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    if not value:
        value = spark.sparkContext.getConf().get(key, None)
    return value or None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names.

    Only a local master may fall back to a folder of this machine.
    """
    named = _conf(spark, CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    if not _LOCAL_FALLBACK:
        _LOCAL_FALLBACK.append(tempfile.mkdtemp(prefix="cloudgauge-"))
    return _LOCAL_FALLBACK[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused between runs."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing will read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() usable; keeps a folder that is already set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table of few files enough partitions for work that is heavy per row.

    A table with at least as many files as cores is left as it is: its scan is parallel
    already, and only small inputs pay for the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, *keys)


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def settle(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Write a per-label side table once and measure it: (table, small enough to broadcast).

    The optimizer sizes an aggregate by its input, so it would plan a shuffle of the big
    side for a table of a few rows. Beyond `limit` rows or `most_bytes` bytes (of the rows
    as JSON) the join stays a shuffle join. The table is computed here, while the query
    that asks for it is still being put together.
    """
    kept = settled(df)
    size = kept.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return kept, size["n"] <= limit and (size["bytes"] or 0) <= most_bytes


def settled(df: DataFrame) -> DataFrame:
    """The table computed and written now, for plans that would compute it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def attach(df: DataFrame, side: DataFrame, small: bool, on: list[str], how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(side) if small else side, on, how)
