"""Sums of small vectors and matrices per group, the one heavy step of every model here.

Each task folds its rows into one vector per group; the partial vectors are then added
in two rounds, so that no single task ever adds up all partials of a hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

FLUSH_BYTES = 64 << 20
_FAN_IN = 256


def key_ddl(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def sum_vectors(df: DataFrame, by: list[str], fold: Callable[[tuple, pa.Table], np.ndarray], out: str = "sums") -> DataFrame:
    """(by, sums): `fold(key, rows)` turns the rows of one group into a flat vector; the
    vectors of a group are added over all tasks. Vectors of a group must agree in length.
    """
    names = list(by)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() // _FAN_IN
        held: dict[tuple, np.ndarray] = {}
        size = 0
        types = None

        def emit() -> pa.RecordBatch:
            keys = list(held)
            cols = {n: pa.array([k[i] for k in keys], types[n]) for i, n in enumerate(names)}
            cols["__part"] = pa.array([part] * len(keys), pa.int32())
            cols[out] = pa.array(list(held.values()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            types = {n: table.schema.field(n).type for n in names}
            for key, rows in _groups(table, names):
                v = fold(key, rows)
                if key in held:
                    held[key] += v
                else:
                    held[key] = v
                    size += v.nbytes
            if size > FLUSH_BYTES:
                yield emit()
                held.clear()
                size = 0
        if held:
            yield emit()

    keys = key_ddl(df, names)
    parts = df.mapInArrow(partial, f"{keys}, __part int, `{out}` array<double>")

    def add(table: pa.Table) -> pa.Table:
        total = np.asarray(table[out].combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
        head = table.slice(0, 1).drop_columns([out])
        return head.append_column(out, pa.array([total], pa.list_(pa.float64())))

    mid = parts.groupBy(*names, "__part").applyInArrow(add, parts.schema).drop("__part")
    return mid.groupBy(*names).applyInArrow(add, mid.schema)


def _groups(table: pa.Table, names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    if not names:
        yield (), table
        return
    codes = None
    for n in names:
        c = table[n].combine_chunks().dictionary_encode()
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        idx = c.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = idx if codes is None else codes * len(c.dictionary) + idx
    order = np.argsort(codes, kind="stable")
    bounds = np.nonzero(np.diff(codes[order]))[0] + 1
    for part in np.split(order, bounds):
        rows = table.take(pa.array(part))
        yield tuple(rows[n][0].as_py() for n in names), rows


def vectors(rows: pa.Table, col: str) -> np.ndarray:
    flat = rows[col].combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(rows.num_rows, -1)


def gram(x: np.ndarray) -> np.ndarray:
    """Flat Gram matrix of [1, x]: counts, sums and cross products in one vector."""
    ones = np.ones((len(x), 1))
    full = np.hstack([ones, x])
    return (full.T @ full).ravel()


def unpack_gram(flat: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, centred scatter) from a flat Gram matrix."""
    d = int(round(np.sqrt(len(flat))))
    g = np.asarray(flat).reshape(d, d)
    n = g[0, 0]
    mean = g[0, 1:] / n
    return n, mean, g[1:, 1:] - n * np.outer(mean, mean)
