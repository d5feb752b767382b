"""Structure of clouds: principal components, shares of modes, conditional variance.

Data passes are Spark jobs that return sums (see `moments`); numpy only solves the
resulting d-by-d problems, inside tasks, one group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.functions.hashing import hash_index, hash_key
from cloudgauge.operators import moments
from cloudgauge.operators.sampling import hash_permutation

# --- principal components ----------------------------------------------------------------


def pca_curves(
    df: DataFrame, by: list[str], vec: str = "vec", k: int | None = 10, variance: float | None = None
) -> DataFrame:
    """Centred principal components per group: (by, n, mean, components, explained, ratio).

    `components` is a flat k*d array. Either a fixed `k` or the smallest number of
    components reaching the `variance` share. Signs: the largest loading is positive.
    """
    sums = moments.sum_vectors(df.select(*by, vec), by, lambda key, rows: moments.gram(moments.vectors(rows, vec)))
    names = list(by)

    def solve(table: pa.Table) -> pa.Table:
        n, mean, scatter = moments.unpack_gram(np.asarray(table["sums"].combine_chunks().flatten()))
        values, vectors = np.linalg.eigh(scatter / max(n - 1.0, 1.0))
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
        total = values.sum() or 1.0
        keep = k
        if variance is not None:
            keep = int(np.searchsorted(np.cumsum(values) / total, variance - 1e-12) + 1)
        keep = max(1, min(keep, len(values)))
        values, vectors = values[:keep], vectors[:keep]
        signs = np.sign(vectors[np.arange(keep), np.abs(vectors).argmax(axis=1)])
        vectors = vectors * np.where(signs == 0, 1.0, signs)[:, None]
        wrap = lambda a: pa.array([np.asarray(a)], pa.list_(pa.float64()))
        return pa.table(
            {
                **{c: table[c] for c in names},
                "n": pa.array([int(round(n))], pa.int64()),
                "mean": wrap(mean),
                "components": wrap(vectors.ravel()),
                "explained": wrap(values),
                "ratio": wrap(values / total),
            }
        )

    schema = (
        f"{moments.key_ddl(df, names)}, n long, mean array<double>, components array<double>, "
        "explained array<double>, ratio array<double>"
    )
    return sums.groupBy(*names).applyInArrow(solve, schema)


# --- modes ------------------------------------------------------------------------------------


def mode_shares(assigned: DataFrame, by: list[str], mode: str = "mode") -> DataFrame:
    counts = assigned.groupBy(*by, mode).agg(F.count(F.lit(1)).alias("n"))
    # one row per mode: windows over the folded table only
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


# --- variance explained by features -----------------------------------------------------------


def zero_variance_drop(df: DataFrame, by: list[str], vec: str, eps: float = 1e-9) -> DataFrame:
    """(by, feature, sd, keep): population SD of every feature."""
    long = df.select(*by, F.posexplode(vec).alias("feature", "x"))
    return long.groupBy(*by, "feature").agg(F.stddev_pop("x").alias("sd")).withColumn("keep", F.col("sd") > eps)


def ridge_cv_r2(
    df: DataFrame, by: list[str], id_col: str, x: str, y: str, alpha: float = 10.0, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Variance-weighted out-of-fold R2 of a ridge from features to targets, per group.

    One pass sums the Gram matrix of [1, x, y] per fold. The training sums of a fold are
    the total minus its own, and its residual sum of squares follows from its own sums, so
    there is no second pass. Features are standardised with training moments; those
    without variance are left out; each target's R2 is floored at -1.
    """
    names = list(by)
    fold = hash_index(hash_key(f"{seed}:fold", id_col), F.lit(folds)).cast("int")
    cols = [*names, fold.alias("__fold"), x, y]
    data = df.select(*cols)

    def cross(key: tuple, rows: pa.Table) -> np.ndarray:
        a, b = moments.vectors(rows, x), moments.vectors(rows, y)
        return moments.gram(np.hstack([a, b]))

    sums = moments.sum_vectors(data, [*names, "__fold"], cross)
    width = data.select(*names, F.size(x).alias("__dx")).groupBy(*names).agg(F.max("__dx").alias("__dx"))
    joined = sums.join(width, names) if names else sums.join(F.broadcast(width))

    def solve(table: pa.Table) -> pa.Table:
        dx = table["__dx"][0].as_py()
        flats = np.asarray(table["sums"].combine_chunks().flatten()).reshape(table.num_rows, -1)
        d = int(round(np.sqrt(flats.shape[1])))
        grams = flats.reshape(-1, d, d)
        total = grams.sum(axis=0)
        n = total[0, 0]
        sse = np.zeros(d - 1 - dx)
        for g in grams:
            t = total - g
            nt, mean = t[0, 0], t[0, 1:] / t[0, 0]
            scatter = t[1:, 1:] - nt * np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(scatter)[:dx] / nt, 0.0))
            keep = np.nonzero(sd > 1e-9)[0]
            s = sd[keep]
            xx = scatter[np.ix_(keep, keep)] / np.outer(s, s)
            xy = scatter[np.ix_(keep, range(dx, d - 1))] / s[:, None]
            coef = np.linalg.solve(xx + alpha * np.eye(len(keep)), xy) / s[:, None]
            # residual = y - mean_y - (x - mean_x) coef, a linear map of [1, x, y]
            for j in range(d - 1 - dx):
                v = np.zeros(d)
                v[1 + dx + j] = 1.0
                v[1 + keep] = -coef[:, j]
                v[0] = -mean[dx + j] + mean[keep] @ coef[:, j]
                sse[j] += v @ g @ v
        my = total[0, 1 + dx :] / n
        sst = np.diag(total)[1 + dx :] - n * my * my
        r2 = np.maximum(-1.0, 1.0 - sse / np.where(sst > 0, sst, 1.0))
        var = sst / max(n - 1.0, 1.0)
        return pa.table(
            {
                **{c: table[c].slice(0, 1) for c in names},
                "n": pa.array([int(round(n))], pa.int64()),
                "r2": pa.array([float((r2 * var).sum() / var.sum())]),
                "r2_per_target": pa.array([r2], pa.list_(pa.float64())),
            }
        )

    keys = moments.key_ddl(df, names)
    return joined.groupBy(*names).applyInArrow(solve, f"{keys}, n long, r2 double, r2_per_target array<double>")


def permutation_null(
    df: DataFrame, by: list[str], id_col: str, x: str, y: str, seed: int = 42, **options
) -> DataFrame:
    """The same R2 with features handed to other rows of the group by hash order."""
    swap = hash_permutation(df, by, id_col, seed)
    feats = df.select(*[F.col(c).alias(c) for c in by], F.col(id_col).alias("partner_id"), F.col(x).alias("__px"))
    shuffled = (
        df.select(*by, id_col, y)
        .join(swap, [*by, id_col])
        .join(feats, [*by, "partner_id"])
        .select(*by, id_col, F.col("__px").alias(x), y)
    )
    return ridge_cv_r2(shuffled, by, id_col, x, y, seed=seed, **options)


def residual_dispersion(raw: Column, r2: Column) -> Column:
    """raw * sqrt(1 - R2), with a negative R2 explaining nothing (never above raw)."""
    return raw * F.sqrt(F.least(F.greatest(1.0 - r2, F.lit(0.0)), F.lit(1.0)))


def sd_ratio(df: DataFrame, by: list[str], before: str, after: str, eps: float = 1e-9) -> DataFrame:
    """Median over features of SD(after)/SD(before); features constant before are left out."""
    long = df.select(*by, F.posexplode(F.arrays_zip(F.col(before).alias("u"), F.col(after).alias("p"))).alias("feature", "z"))
    per = long.groupBy(*by, "feature").agg(F.stddev_pop("z.u").alias("su"), F.stddev_pop("z.p").alias("sp"))
    ratios = per.filter(F.col("su") > eps).select(*by, (F.col("sp") / F.col("su")).alias("ratio"))
    # one row per feature is left
    return ratios.groupBy(*by).agg(F.count(F.lit(1)).alias("n_features"), F.percentile("ratio", 0.5).alias("sd_ratio"))


def embedding_regressor(
    train: DataFrame, predict: DataFrame, id_col: str, x: str, y: str, alpha: float = 1.0, seeds: Sequence[int] = (0, 1, 2)
) -> DataFrame:
    """Multi-output ridge from embeddings to targets, refitted on one Poisson(1) hash
    bootstrap per seed: (predict columns, prediction array, seed_spread).

    The replicate weights come from row hashes; each seed's Gram matrix is summed in the
    same pass. `seed_spread` is the population SD over seeds, averaged over targets.
    """
    # cumulative Poisson(1) probabilities turn a uniform into a count
    cuts = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(12)])
    drawn = train.select(
        F.explode(F.array(*[F.lit(s) for s in seeds])).alias("__seed"), F.col(id_col).alias("__id"), x, y
    )
    u = hash_index(hash_key("boot", "__seed", "__id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    count = F.lit(0)
    for c in cuts:
        count = count + (u > F.lit(float(c))).cast("int")
    drawn = drawn.select("__seed", count.cast("double").alias("__w"), x, y)

    def cross(key: tuple, rows: pa.Table) -> np.ndarray:
        w = np.sqrt(rows["__w"].to_numpy())[:, None]
        full = np.hstack([np.ones((rows.num_rows, 1)), moments.vectors(rows, x), moments.vectors(rows, y)]) * w
        return (full.T @ full).ravel()

    sums = moments.sum_vectors(drawn, ["__seed"], cross).collect()
    width = train.select(F.size(x)).first()
    if width is None:
        raise ValueError("no rows to train on")
    dx = width[0]
    fits = []
    for r in sorted(sums, key=lambda r: r["__seed"]):
        d = int(round(math.sqrt(len(r["sums"]))))
        g = np.asarray(r["sums"]).reshape(d, d)
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        scatter = g[1:, 1:] - n * np.outer(mean, mean)
        coef = np.linalg.solve(scatter[:dx, :dx] + alpha * np.eye(dx), scatter[:dx, dx:])
        fits.append((coef, mean[dx:] - mean[:dx] @ coef))

    @F.pandas_udf("struct<prediction: array<double>, seed_spread: double>")
    def apply(v: pd.Series) -> pd.DataFrame:
        m = np.stack(v.to_numpy())
        stack = np.stack([m @ c + b for c, b in fits])
        return pd.DataFrame(
            {"prediction": list(stack.mean(axis=0)), "seed_spread": stack.std(axis=0).mean(axis=1)}
        )

    rest = [c for c in predict.columns if c != x]
    return predict.withColumn("__o", apply(x)).select(*rest, "__o.prediction", "__o.seed_spread")


def seed_spread(long: DataFrame, keys: list[str], seed: str, target: str, value: str) -> DataFrame:
    """Ensemble mean per target, and the SD over seeds averaged over targets."""
    per = long.groupBy(*keys, target).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return per.groupBy(*keys).agg(F.avg("m").alias("mean_prediction"), F.avg("s").alias("seed_spread"))


def mode_levels(assigned: DataFrame, by: list[str], mode: str, vec: str, bins: Column | None = None) -> DataFrame:
    """Mean level per mode over the given bins (all bins by default)."""
    long = assigned.select(*by, mode, F.posexplode(vec).alias("bin", "x"))
    if bins is not None:
        long = long.filter(bins)
    return long.groupBy(*by, mode).agg(F.avg("x").alias("level"))


def mode_table(assigned: DataFrame, by: list[str], unit: list[str], mode: str = "mode") -> DataFrame:
    """Counts per unit and mode, with every mode of the group shown."""
    seen = assigned.select(*by, mode).distinct()
    units = assigned.select(*by, *unit).distinct()
    counts = assigned.groupBy(*by, *unit, mode).agg(F.count(F.lit(1)).alias("observed"))
    return (
        units.join(seen, by)
        .join(counts, [*by, *unit, mode], "left")
        .fillna(0, subset=["observed"])
    )

