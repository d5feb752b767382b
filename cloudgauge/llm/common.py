"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.session import scratch_path

CELL_ID = "cell_id"
RESPONSE = "response_content"


def key_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def text_or_empty(name: str) -> Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read again after a loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `written` that nothing will read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs whose results are written: Spark removes them
    once the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def chunks(values: Iterable[str], most_chars: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive runs of texts of about `most_chars` characters, so that the working
    memory of a batch depends on its longest text and not on its number of rows."""
    run: list[str] = []
    size = 0
    for value in values:
        run.append(value)
        size += len(value)
        if size >= most_chars:
            yield run
            run, size = [], 0
    if run:
        yield run


class Store:
    """What a worker has computed for strings, kept from task to task within bounds.

    When it holds more than `most` entries, and at the end of tasks, the `rest` that
    most runs have asked for stay; what was asked for long ago counts less each time.
    """

    def __init__(self, most: int = 400_000, rest: int = 150_000):
        self.entries: dict[str, bytes] = {}
        self.most, self.rest = most, rest
        self.times: Counter[str] = Counter()

    def asked_for(self, keys: Iterable[str]) -> None:
        self.times.update(keys)
        if len(self.entries) > self.most:
            self.shrink()

    def shrink(self) -> None:
        if len(self.entries) <= self.rest:
            return
        times = np.fromiter(self.times.values(), np.int64, len(self.times))
        least = int(np.partition(times, -self.rest)[-self.rest])
        room = self.rest - int((times > least).sum())  # for entries that were asked for just as often as the last
        kept = {k: n for k, n in self.times.items() if n > least}
        kept.update(islice(((k, n) for k, n in self.times.items() if n == least), room))
        self.entries = {k: self.entries[k] for k in kept}
        self.times = Counter({k: n // 2 for k, n in kept.items()})


def hand_back_memory() -> None:
    """Return what a worker has freed to the system. Workers are kept for later tasks, and
    Arrow's pool and the C library would keep it with them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(column: pa.Array, rows: int = 1024) -> Iterator[pa.Array]:
    """A batch in parts, so that what is made of it is handed on before the next part."""
    for low in range(0, len(column), rows):
        yield column.slice(low, rows)


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
