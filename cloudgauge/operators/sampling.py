"""Splits and samples driven by row hashes.

Every draw is a function of (seed, id), so a rerun task, another partition count or
another engine makes the same draw.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.functions.hashing import hash_index, hash_key, hash_slice
from cloudgauge.operators.ranks import _slice_offsets, ordered_row_number
from cloudgauge.session import attach, settle, settled


def hash_cut(
    df: DataFrame,
    by: list[str],
    id_col: str,
    take: Callable[[Column], Column],
    seed: int | str,
    flag: str,
    size: str | None = None,
) -> DataFrame:
    """Flag the first `take(n)` rows of each group in hash order, n being its size.

    Only counts per hash slice and the rows of the one slice that holds the cut move; the
    table itself is flagged in place against one threshold per group. `size` also adds n.
    """
    key = hash_key(seed, id_col)
    # three narrow columns, written once: the input is computed for them and for the flag
    keyed = settled(df.select(*by, F.col(id_col).alias("__id"), key.alias("__h"), hash_slice(key).alias("__slice")))
    offsets = _slice_offsets(keyed, by, "__slice", {"n": F.count(F.lit(1))}).withColumn(
        "__k", take(F.col("__all_n"))
    )
    here = Window.partitionBy(*by).orderBy("__slice")
    holds_cut = (F.col("__off_n") < F.col("__k")) & (F.col("__k") <= F.col("__next"))
    cut_at = F.struct(F.col("__slice"), (F.col("__k") - F.col("__off_n")).alias("__nth"))
    limits, small = settle(
        offsets.withColumn("__next", F.coalesce(F.lead("__off_n").over(here), F.col("__all_n")))
        .groupBy(*by)
        .agg(F.max("__all_n").alias("__size"), F.max(F.when(holds_cut, cut_at)).alias("__cut"))
    )
    cutting = limits.filter(F.col("__cut").isNotNull()).select(*by, "__cut.__slice", "__cut.__nth")
    nth = Window.partitionBy(*by).orderBy("__h", "__id")
    edge = (
        attach(keyed, cutting, small, [*by, "__slice"])
        .withColumn("__rn", F.row_number().over(nth))
        .filter("__rn = __nth")
        .select(*by, F.struct("__h", "__id").alias("__edge"))
    )
    per_group = limits.select(*by, "__size").join(edge, by, "left")
    mine = F.struct(key.alias("__h"), F.col(id_col).alias("__id"))
    out = attach(df, per_group, small, by, "left").withColumn(flag, F.coalesce(mine <= F.col("__edge"), F.lit(False)))
    return (out.withColumnRenamed("__size", size) if size else out.drop("__size")).drop("__edge")


def share_of(fraction: float) -> Callable[[Column], Column]:
    """round-half-even(fraction * n)."""
    return lambda n: F.bround(F.lit(fraction) * n, 0).cast("long")


def stratified_split(
    df: DataFrame, label: str, id_col: str, eval_fraction: float = 0.2, floor: int = 20, seed: int = 42, out: str = "split"
) -> DataFrame:
    """`eval`/`train` inside labels with at least `floor` rows, `tail_eval` for the rest."""
    cut = hash_cut(df, [label], id_col, share_of(eval_fraction), seed, "__eval", "__rows")
    side = (
        F.when(F.coalesce("__rows", F.lit(0)) < floor, "tail_eval").when(F.col("__eval"), "eval").otherwise("train")
    )
    return cut.withColumn(out, side).drop("__eval", "__rows")


def dev_slice(df: DataFrame, label: str, id_col: str, fraction: float = 0.1, seed: int | str = "42:dev") -> DataFrame:
    """Add `is_dev`: the given share of every label."""
    return hash_cut(df, [label], id_col, share_of(fraction), seed, "is_dev")


def split_half(df: DataFrame, by: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """Add `half`: `a` for the first floor(n/2) rows in hash order, else `b`."""
    cut = hash_cut(df, by, id_col, lambda n: F.floor(n / 2), seed, "__first")
    return cut.withColumn("half", F.when(F.col("__first"), "a").otherwise("b")).drop("__first")


def sample_labels(labels: DataFrame, label: str, n: int, seed: int = 42) -> DataFrame:
    """`n` of the distinct labels."""
    return labels.select(label).distinct().orderBy(hash_key(seed, label), label).limit(n)


def hash_rank(df: DataFrame, by: list[str], id_col: str, seed: int | str, rank: str = "pos", total: str = "n_pool") -> DataFrame:
    """Zero-based place in hash order within the group, and the group's size."""
    key = hash_key(seed, id_col)
    out = ordered_row_number(df, by, hash_slice(key), [key, F.col(id_col)], rank, total)
    return out.withColumn(rank, F.col(rank) - 1)


def sample_exemplars(
    targets: DataFrame, pool: DataFrame, label: str, pool_label: str, id_col: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Up to `k` pool rows for every target label, drawn without replacement.

    `targets` has (label, pool_label): where the label has no rows of its own, another
    label's pool stands in. The pool is put in hash order once and every target takes a
    run of `k` places from a start drawn for that target, so a pool shared by many
    targets is never multiplied by them.
    """
    ranked = hash_rank(pool, [pool_label], id_col, seed)
    sizes = pool.groupBy(pool_label).agg(F.count(F.lit(1)).alias("n_pool"))
    start = hash_index(hash_key(seed, label), F.col("n_pool"))
    picks = (
        targets.select(label, pool_label)
        .join(sizes, pool_label)
        .withColumn("pick", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n_pool")).cast("int") - 1)))
        .withColumn("pos", F.pmod(start + F.col("pick"), F.col("n_pool")))
        .drop("n_pool")
    )
    return picks.join(ranked.drop("n_pool"), [pool_label, "pos"]).drop("pos")


def raft_examples(
    rows: DataFrame, pool: DataFrame, label: str, id_col: str, payload: str, n_same: int = 3, n_other: int = 2, seed: int = 42
) -> DataFrame:
    """For every row, `n_same` pool rows of its label (never itself) and `n_other` of
    other labels, in hash order and without their labels: (id, label, examples array).

    The pool gets one global numbering, label by label in hash order; picks are numbers,
    fetched by one equi-join. A row starts at a place of its own and goes on by a stride
    of its own, so picks are distinct and rarely neighbours. Where there are fewer pool
    rows than asked for, all of them are picked, and none twice. Every row must have a
    label of the pool.
    """
    order_seed = f"{seed}:raft"
    ranked = hash_rank(pool.select(label, id_col, payload), [label], id_col, order_seed)
    sizes = pool.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    by_label = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    # one row per label: the only unpartitioned windows here
    starts = sizes.withColumn("__at", F.coalesce(F.sum("__n").over(by_label), F.lit(0))).withColumn(
        "__all", F.sum("__n").over(Window.partitionBy())
    )
    numbered = ranked.join(starts.select(label, "__at"), label).select(
        (F.col("__at") + F.col("pos")).alias("__g"), F.col(id_col).alias("__pick_id"), F.col(payload).alias("__payload")
    )
    me = (
        rows.select(label, id_col)
        .join(ranked.select(label, id_col, "pos"), [label, id_col], "left")
        .join(starts, label)
    )
    own = F.col("__n") - F.when(F.col("pos").isNull(), 0).otherwise(1)
    others = F.col("__all") - F.col("__n")

    def places(kind: str, available: Column, wanted: int) -> list[Column]:
        """Distinct numbers below `available`; null beyond it."""
        stride = 1 + hash_index(
            hash_key(f"{order_seed}:{kind}-stride", id_col), F.greatest(F.floor((available - 1) / max(wanted - 1, 1)), F.lit(1))
        )
        start = hash_index(hash_key(f"{order_seed}:{kind}", id_col), F.greatest(available, F.lit(1)))
        return [F.when(available > i, F.pmod(start + i * stride, F.greatest(available, F.lit(1)))) for i in range(wanted)]

    def same(step: Column) -> Column:
        # a pool row counts on from its own place, which it therefore never reaches
        place = F.when(F.col("pos").isNull(), step).otherwise(F.pmod(F.col("pos") + 1 + step, F.col("__n")))
        return F.col("__at") + place

    def other(v: Column) -> Column:
        return F.when(v < F.col("__at"), v).otherwise(v + F.col("__n"))

    picks = F.array_compact(
        F.array(*[same(v) for v in places("same", own, n_same)], *[other(v) for v in places("other", others, n_other)])
    )
    wanted = me.select(label, id_col, F.explode_outer(picks).alias("__g"))
    shuffled = hash_key(f"{order_seed}:order", id_col, "__pick_id")
    entry = F.struct(shuffled.alias("o"), F.col("__pick_id").alias("id"), F.col("__payload").alias("payload"))
    return (
        wanted.join(numbered, "__g", "left")
        .groupBy(label, id_col)
        .agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("__pick_id").isNotNull(), entry))), lambda e: e["payload"]).alias("examples"))
    )


def hash_permutation(df: DataFrame, by: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """(by, id, partner_id): a one-to-one reassignment of ids inside each group."""
    a = hash_rank(df.select(*by, id_col), by, id_col, f"{seed}:a").select(*by, "pos", id_col)
    b = hash_rank(df.select(*by, id_col), by, id_col, f"{seed}:b").select(
        *[F.col(c).alias(c) for c in by], "pos", F.col(id_col).alias("partner_id")
    )
    return a.join(b, [*by, "pos"]).drop("pos")


