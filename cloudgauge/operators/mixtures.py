"""Gaussian mixtures by relational EM, and work of rows under their group's model.

Rows are packed once into blocks of bounded size. The parameters of all models are a table
keyed (group, k, start); one step is one job for all groups, whatever their size: the
models of a group meet its blocks, tasks add up what a step needs, the sums meet the
models they belong to and become the next parameters. Finished models take no further
part. The driver sees one number a step, whether anything is unfinished.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cloudgauge.functions.hashing import hash_key
from cloudgauge.operators import moments
from cloudgauge.session import attach, scratch_path, settle

RIDGE = 1e-6
BLOCK_ROWS = 4096
_FAN_IN = 256


# --- rows in blocks ---------------------------------------------------------------------------


def in_blocks(rows: DataFrame, by: list[str], block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows with `__block`, and the number of blocks of each group: groups are cut by a
    hash of the row into blocks of about `block_rows` rows."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__blocks"))
    side, small = settle(sizes)
    hashed = [f.name for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    return attach(rows, side, small, by).withColumn("__block", F.pmod(F.xxhash64(*hashed), F.col("__blocks")).cast("int")), side


def with_models(
    rows: DataFrame, models: DataFrame, by: list[str], fn: Callable[[pa.Table, pa.Table], pa.Table], ddl: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """fn(rows of a block, models of its group) for every block: a model travels once per
    block, not with every row. Groups without a model are left out."""
    placed, sizes = in_blocks(rows, by, block_rows)
    blocks = sizes.select(*by, F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"))
    sent = models.join(blocks, by)
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])  # names of its own, if both come from one table
    columns = rows.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return fn(left.select(columns), right)

    keys = [*by, "__block"]
    out_schema = rows.sparkSession.createDataFrame([], ddl).schema
    empty = to_arrow_schema(out_schema).empty_table()
    return placed.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, ddl)


def row_ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def project(rows: DataFrame, model: DataFrame, by: list[str], vec: str = "vec", out: str = "scores") -> DataFrame:
    """Scores of rows under their group's components (`mean`, `components` of the model)."""

    def scores(block: pa.Table, models: pa.Table) -> pa.Table:
        x, mean = moments.vectors(block, vec), np.asarray(models["mean"][0].as_py())
        comps = np.asarray(models["components"][0].as_py()).reshape(-1, len(mean))
        return block.append_column(out, lists((x - mean) @ comps.T))

    slim = model.select(*by, "mean", "components")
    return with_models(rows, slim, by, scores, f"{row_ddl(rows)}, `{out}` array<double>")


def lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if values.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


# --- densities --------------------------------------------------------------------------------


class Model:
    """Shares, means and covariances of one mixture, and the logarithms they give rows."""

    def __init__(self, w: Sequence[float], m: Sequence, c: Sequence):
        self.w = np.asarray(w, np.float64)
        self.m = np.asarray(m, np.float64).reshape(len(self.w), -1)
        d = self.m.shape[1]
        self.c = np.asarray(c, np.float64).reshape(len(self.w), d, d)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(share * density) of every row under every component."""
        out = np.empty((len(x), len(self.w)))
        for j in range(len(self.w)):
            chol = np.linalg.cholesky(self.c[j])
            z = np.linalg.solve(chol, (x - self.m[j]).T)
            log_det = np.log(np.diag(chol)).sum()
            out[:, j] = math.log(max(self.w[j], 1e-300)) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + (z * z).sum(axis=0)) - log_det
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """What a step needs of these rows: log-likelihood, then of each component the
        weight, weighted sum and weighted cross products."""
        joint = self.log_joint(x)
        total = log_sum(joint)
        r = np.exp(joint - total[:, None])
        out = [[total.sum()]]
        for j in range(len(self.w)):
            wx = x * r[:, j : j + 1]
            out += [[r[:, j].sum()], wx.sum(axis=0), (wx.T @ x).ravel()]
        return np.concatenate([np.ravel(o) for o in out])

    def next(self, sums: np.ndarray, n: float) -> Model:
        d = self.m.shape[1]
        each = sums[1:].reshape(len(self.w), 1 + d + d * d)
        weight = np.maximum(each[:, 0], 1e-12)
        m = each[:, 1 : 1 + d] / weight[:, None]
        c = each[:, 1 + d :].reshape(-1, d, d) / weight[:, None, None] - m[:, :, None] * m[:, None, :]
        return Model(weight / n, m, (c + c.transpose(0, 2, 1)) / 2 + RIDGE * np.eye(d))


def log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


# --- fitting ----------------------------------------------------------------------------------

_PARAMS = "k int, start int, n long, w array<double>, m array<double>, c array<double>, ll double, n_steps int, done boolean, converged boolean"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _packed(rows: DataFrame, by: list[str], vec: str, block_rows: int) -> DataFrame:
    """One row per block: (by, x), the vectors of its rows in order of their ids."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["__id"]))
        x = moments.vectors(table, vec)
        return table.slice(0, 1).select(by).append_column("x", lists(x.reshape(1, -1)))

    placed, _ = in_blocks(rows, by, block_rows)
    return placed.groupBy(*by, "__block").applyInArrow(pack, f"{moments.key_ddl(rows, by)}, x array<double>")


def _first_models(rows: DataFrame, by: list[str], vec: str, ks: Sequence[int], starts: int, seed: int) -> DataFrame:
    """Before the first step: equal shares, the covariance of the group, and as means the
    first rows in hash order of each start."""
    sums = moments.sum_vectors(rows.select(*by, vec), by, lambda key, part: moments.gram(moments.vectors(part, vec)))
    drawn = rows.select(*by, "__id", vec, F.explode(F.array(*[F.lit(s) for s in range(starts)])).alias("start"))
    drawn = drawn.withColumn("__h", hash_key(seed, "start", "__id"))
    order = Window.partitionBy(*by, "start").orderBy("__h", "__id")
    seeds = drawn.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max(ks)).select(*by, "start", "nth", vec)

    def first(stats: pa.Table, means: pa.Table) -> pa.Table:
        n, mean, scatter = moments.unpack_gram(np.asarray(stats["sums"].combine_chunks().flatten()))
        cov = (scatter / n + RIDGE * np.eye(len(mean))).ravel().tolist()
        by_start: dict[int, list] = {}
        means = means.take(pc.sort_indices(means, [("start", "ascending"), ("nth", "ascending")]))
        for s, v in zip(means["start"].to_pylist(), means[vec].to_pylist(), strict=True):
            by_start.setdefault(s, []).append(v)
        key = [stats[c][0].as_py() for c in by]
        rows_ = []
        for k in ks:
            for s in range(starts if k > 1 else 1):
                chosen = [mean.tolist()] if k == 1 else by_start[s][:k]
                if len(chosen) == k:  # a group may have fewer rows
                    rows_.append([*key, k, s, int(round(n)), [1.0 / k] * k, sum(chosen, []), cov * k, -math.inf, 0, False, False])
        return pa.table([pa.array(list(col), f.type) for col, f in zip(zip(*rows_, strict=True), schema, strict=True)], schema)

    ddl = f"{moments.key_ddl(rows, by)}, {_PARAMS}"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
    return sums.groupBy(*by).cogroup(seeds.groupBy(*by)).applyInArrow(first, ddl)


def _step(blocks: DataFrame, params: DataFrame, small: bool, by: list[str], tol: float, max_iter: int) -> DataFrame:
    """The parameters after one more step of all models that are not done."""
    active = params.filter("NOT done")
    keys = [*by, "k", "start"]
    # at most as many models per group as there are starts
    models = active.groupBy(*by).agg(F.collect_list(F.struct("k", "start", "w", "m", "c")).alias("models"))
    met = attach(blocks, models, small, by)
    names = list(by)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() // _FAN_IN
        held: dict[tuple, np.ndarray] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in names]
            for row in batch.to_pylist():
                x = np.asarray(row["x"])
                for p in row["models"]:
                    own = Model(p["w"], p["m"], p["c"])
                    key, sums = (*(row[c] for c in names), p["k"], p["start"]), own.sums(x.reshape(-1, own.m.shape[1]))
                    held[key] = held[key] + sums if key in held else sums
        if held:
            columns = list(zip(*held, strict=True))
            kinds = [*types, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array([part] * len(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))],
                names=[*keys, "__part", "sums"],
            )

    ddl = moments.key_ddl(params, keys)
    partial = met.mapInArrow(expect, f"{ddl}, __part int, sums array<double>")

    def add(table: pa.Table) -> pa.Table:
        total = moments.vectors(table, "sums").sum(axis=0)
        return table.slice(0, 1).drop_columns(["sums"]).append_column("sums", lists(total.reshape(1, -1)))

    summed = partial.groupBy(*keys, "__part").applyInArrow(add, partial.schema)

    def maximise(sums: pa.Table, model: pa.Table) -> pa.Table:
        p = model.to_pylist()[0]
        total, own = moments.vectors(sums, "sums").sum(axis=0), Model(p["w"], p["m"], p["c"])
        ll = total[0] / p["n"]
        converged, steps = abs(ll - p["ll"]) < tol, p["n_steps"] + 1
        new = {**p, "ll": ll, "n_steps": steps, "converged": converged, "done": converged or steps >= max_iter}
        if not new["done"]:  # what is returned has the likelihood that it says
            nxt = own.next(total, p["n"])
            new |= {"w": nxt.w.tolist(), "m": nxt.m.ravel().tolist(), "c": nxt.c.ravel().tolist()}
        return pa.Table.from_pylist([new], model.schema)

    return summed.groupBy(*keys).cogroup(active.groupBy(*keys)).applyInArrow(maximise, params.schema).unionByName(params.filter("done"))


def gmm_select_by_bic(
    scores: DataFrame,
    by: list[str],
    id_col: str,
    vec: str = "scores",
    ks: Sequence[int] = (1, 2, 3, 4),
    starts: int = 3,
    max_iter: int = 100,
    tol: float = 1e-3,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Full-covariance mixtures for every group, number of components and start:
    (BIC table, best components).

    The first has by, k, n, log_likelihood, bic, n_steps, converged (the mean
    log-likelihood moved by less than `tol` in the last step; otherwise `max_iter` steps were made) and best:
    of each k the start with the least BIC, and of each group the best k. The second has
    by, mode (numbered by falling share), share, mean, cov (flat). Likelihoods are those of
    the components returned. A k above a group's number of rows is left out.
    """
    data = scores.select(*by, F.col(id_col).alias("__id"), vec)
    blocks = _stored(_packed(data, by, vec, block_rows), "mixture-blocks")
    params = _stored(_first_models(data, by, vec, ks, starts, seed), "mixture-params")
    _, small = settle(params)  # the size stays as it is from step to step
    while params.filter("NOT done").limit(1).count():
        params = _stored(_step(blocks, params, small, by, tol, max_iter), "mixture-params")
    d = F.size("m") / F.size("w")
    free = F.col("k") - 1 + F.col("k") * d + F.col("k") * d * (d + 1) / 2
    rated = params.withColumn("log_likelihood", F.col("ll") * F.col("n")).withColumn("bic", -2 * F.col("log_likelihood") + free * F.log("n"))
    # a group has as many rows here as there are models
    nth = F.row_number().over(Window.partitionBy(*by, "k").orderBy("bic", "start"))
    starts_best = rated.withColumn("__nth", nth).filter("__nth = 1")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("bic", "k"))
    judged = starts_best.withColumn("best", place == 1)
    bic = judged.select(*by, "k", "n", "log_likelihood", "bic", "n_steps", "converged", "best")
    width = F.expr("CAST(size(m) / size(w) AS INT)")
    own = lambda name, size: F.transform("w", lambda w, j: F.slice(name, j * size + 1, size))
    parts = judged.filter("best").select(*by, "w", own("m", width).alias("ms"), own("c", width * width).alias("cs"))
    ranked = F.array_sort(F.transform(F.arrays_zip("w", "ms", "cs"), lambda z, j: F.struct((-z["w"]).alias("minus"), j.alias("j"), z.alias("z"))))
    comps = parts.select(*by, F.posexplode(ranked).alias("mode", "r"))
    return bic, comps.select(*by, "mode", F.col("r.z.w").alias("share"), F.col("r.z.ms").alias("mean"), F.col("r.z.cs").alias("cov"))


def _model_of(comps: pa.Table) -> tuple[Model, np.ndarray]:
    rows = sorted(comps.to_pylist(), key=lambda r: r["mode"])
    return Model([r["share"] for r in rows], [r["mean"] for r in rows], [r["cov"] for r in rows]), np.array([r["mode"] for r in rows], np.int32)


def assign_modes(scores: DataFrame, comps: DataFrame, by: list[str], vec: str = "scores", out: str = "mode") -> DataFrame:
    """Most likely component of every row under its group's mixture (of equal ones the
    first), and `log_density`, the logarithm of the mixture's density there."""

    def pick(block: pa.Table, own: pa.Table) -> pa.Table:
        model, modes = _model_of(own)
        joint = model.log_joint(moments.vectors(block, vec))
        return block.append_column(out, pa.array(modes[joint.argmax(axis=1)])).append_column("log_density", pa.array(log_sum(joint)))

    slim = comps.select(*by, "mode", "share", "mean", "cov")
    return with_models(scores, slim, by, pick, f"{row_ddl(scores)}, `{out}` int, log_density double")
