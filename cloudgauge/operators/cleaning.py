"""Row rules, duplicates and label profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudgauge.functions import text
from cloudgauge.functions.params import FREQS, GAINS, PARAM_NAMES, RAW_GAIN_LIMIT
from cloudgauge.session import settled

Rule = tuple[str, Column]

# Label-count classes, lower bound first.
COUNT_BUCKETS = [(20, ">=20"), (10, "10-19"), (5, "5-9"), (2, "2-4"), (1, "singleton")]

PROFILE_CELLS = 1 << 18  # hash cells of all profiled columns
SUMMARY_ITEMS = 4096  # values a task's summary keeps track of
CANDIDATES = 64


def parse_numeric_block(df: DataFrame, cols: Sequence[str], ok: str = "parse_ok") -> DataFrame:
    """Text columns to doubles in place, with a flag that all of them parsed.

    The block is unfolded from one struct: the parse runs once per row, and filters on its
    results stay above it. As plain aliases every rule would repeat the parse, and the
    optimizer's constraint inference would try all combinations of the aliases.
    """
    rest = [c for c in df.columns if c not in cols]
    numbers = df.select(*rest, F.transform(F.array(*cols), text.to_number).alias("__n"))
    block = F.struct(*[F.get("__n", F.lit(i)).alias(c) for i, c in enumerate(cols)])
    parsed = numbers.select(*rest, F.inline(F.array(block)))
    good = F.lit(True)
    for c in cols:
        good = good & F.col(c).isNotNull()
    return parsed.withColumn(ok, good)


def out_of_range_gain(gains: Sequence[str] = GAINS, limit: float = RAW_GAIN_LIMIT) -> Column:
    bad = F.lit(False)
    for g in gains:
        bad = bad | (F.abs(F.col(g)) > limit)
    return bad


def non_positive_freq(freqs: Sequence[str] = FREQS) -> Column:
    bad = F.lit(False)
    for f in freqs:
        bad = bad | (F.col(f) <= 0.0)
    return bad


def filter_range(df: DataFrame, gains: Sequence[str] = GAINS, freqs: Sequence[str] = FREQS, limit: float = RAW_GAIN_LIMIT) -> DataFrame:
    return df.filter(~(out_of_range_gain(gains, limit) | non_positive_freq(freqs)))


def filter_blocklist(df: DataFrame, label: str, blocked: DataFrame) -> DataFrame:
    """Drop rows whose label is in the blocklist table (same column name)."""
    return df.join(blocked.select(label).distinct(), label, "left_anti")


def entry_rules(label: str, blocked: Column, bad_width: str = "bad_width", ok: str = "parse_ok") -> list[Rule]:
    """The fixed rule order for raw entries."""
    return [
        ("width", F.col(bad_width)),
        ("empty", F.length(label) == 0),
        ("parse", ~F.col(ok)),
        ("gain", out_of_range_gain()),
        ("freq", non_positive_freq()),
        ("blocklist", blocked),
    ]


def failure_reason(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that fails, null for a row that passes them all."""
    out = None
    for name, fails in rules:
        hit = F.coalesce(fails, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def drop_exact_duplicates(df: DataFrame, key: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key. Only one candidate per key and map task is
    shuffled, so a key that repeats in a third of the table costs no more than others."""
    first = Window.partitionBy("__key").orderBy(*order)
    return (
        df.withColumn("__key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
        .withColumn("__rn", F.row_number().over(first))
        .filter("__rn = 1")
        .drop("__rn", "__key")
    )


def settings_key(label: str, source: str, params: Sequence[str] = PARAM_NAMES, digits: int = 4) -> list[Column]:
    return [F.col(label), F.trim(source), *[F.bround(p, digits) for p in params]]


def cleaning_funnel(
    df: DataFrame,
    rules: Sequence[Rule],
    dedup_key: Sequence[Column] | None = None,
    order: Sequence[Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(survivors, counts). Counts list every rule, in order, zeros included.

    Counting folds the rows to (rule, key of a usable row): how many rows a rule took and
    how many keys are left come from the same pass.
    """
    spark = df.sparkSession
    marked = df.withColumn("__reason", failure_reason(rules))
    usable = marked.filter(F.col("__reason").isNull()).drop("__reason")
    names = [n for n, _ in rules]
    rule = F.coalesce("__reason", F.lit("usable")).alias("rule")
    clean = usable
    if dedup_key is not None:
        clean = drop_exact_duplicates(usable, dedup_key, order)
        key = F.when(F.col("__reason").isNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(dedup_key)]))
        folded = marked.groupBy(rule, key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
        per_reason = folded.groupBy("rule").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
        kept = F.when(F.col("rule") == "usable", F.struct(F.lit("kept").alias("rule"), F.col("n_keys").alias("n_rows")))
        per_reason = per_reason.select(F.inline(F.array_compact(F.array(F.struct("rule", "n_rows"), kept))))
        names += ["usable", "kept"]
    else:
        per_reason = marked.groupBy(rule).agg(F.count(F.lit(1)).alias("n_rows"))
        names += ["usable"]
    steps = spark.createDataFrame(list(enumerate(names)), "step int, rule string")
    counts = steps.join(F.broadcast(per_reason), "rule", "left").select(
        "step", "rule", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")
    )
    return clean, counts


# --- label profiles -----------------------------------------------------------------


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def surface_suspicious(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct().filter(text.is_suspicious(label))


def bucket_counts(spark: SparkSession, counts: DataFrame, n: str = "n") -> DataFrame:
    """How many labels fall in each count class; empty classes show as zero."""
    bucket = None
    for low, name in COUNT_BUCKETS:
        hit = F.col(n) >= low
        bucket = F.when(hit, name) if bucket is None else bucket.when(hit, name)
    have = counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_labels"))
    dims = spark.createDataFrame([(b,) for _, b in COUNT_BUCKETS], "bucket string")
    return dims.join(F.broadcast(have), "bucket", "left").select(
        "bucket", F.coalesce("n_labels", F.lit(0)).cast("long").alias("n_labels")
    )


def floor_partition(df: DataFrame, label: str, floor: int) -> DataFrame:
    """Labels and rows on each side of the floor."""
    side = F.when(F.col("n") >= floor, "above").otherwise("below").alias("side")
    return label_counts(df, label).groupBy(side).agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n_rows")
    )


def unpivot_params(df: DataFrame, keys: list[str], params: Sequence[str] = PARAM_NAMES) -> DataFrame:
    return df.select(*keys, *params).unpivot(keys, list(params), "param", "value")


def per_param_summary(df: DataFrame, label: str, params: Sequence[str] = PARAM_NAMES) -> DataFrame:
    """Mean, sample SD, minimum and maximum of every parameter per label.

    Aggregates wide and unpivots the few result rows, so rows are shuffled once and not
    once per parameter.
    """
    aggs = []
    for p in params:
        aggs += [
            F.struct(
                F.lit(p).alias("param"),
                F.avg(p).alias("mean"),
                F.stddev_samp(p).alias("sd"),
                F.min(p).alias("min"),
                F.max(p).alias("max"),
            ).alias(f"__{p}")
        ]
    wide = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return wide.select(label, "n", F.inline(F.array(*[f"__{p}" for p in params])))


def duplicate_report(df: DataFrame, key: Sequence[Column]) -> DataFrame:
    """One row: duplicate groups, redundant rows, and their share of all rows in percent."""
    packed = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])
    groups = df.groupBy(packed.alias("__key")).agg(F.count(F.lit(1)).alias("c"))
    return groups.agg(
        F.count_if(F.col("c") > 1).alias("n_groups"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_redundant"),
        (100.0 * F.sum(F.col("c") - 1) / F.greatest(F.sum("c"), F.lit(1))).alias("pct_redundant"),
    )


def _as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value) of the given columns as trimmed text, `<blank>` for empty."""
    shown = [F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("<blank>")).alias(c) for c in cols]
    return df.select(*shown).unpivot([], list(cols), "column_name", "value")


def top_values(df: DataFrame, cols: Sequence[str], top: int = 8, cells: int = PROFILE_CELLS) -> DataFrame:
    """Per column the `top` most frequent values and their exact counts (column_name, value,
    n, rank); ties go to the smaller value.

    A mergeable summary per task names candidates. A second pass counts these exactly and
    all other rows by hash cell, `cells` over all columns: no value is more frequent than
    its cell, so only cells that reach the last of the best candidates are open, and only
    values of open cells are counted one by one in a third pass, which is empty where
    nothing is open. What is shuffled are the summaries, the cells and the values of open
    cells; of a column that is near unique that may be every value. The input is read once
    a pass: settle it first if it is costly.
    """
    per_column = max(1024, cells // len(cols))
    values = _as_text(df, cols).withColumn("cell", F.pmod(F.xxhash64("value"), F.lit(per_column)))
    tracked = max(CANDIDATES, 2 * top)
    guess = values.groupBy("column_name").agg(F.expr(f"approx_top_k(value, {tracked}, {max(SUMMARY_ITEMS, tracked)})").alias("best"))
    # at most `tracked` values a column
    candidates = guess.select("column_name", F.explode("best.item").alias("value"), F.lit(True).alias("named"))
    told = values.join(F.broadcast(candidates), ["column_name", "value"], "left")
    named = F.when(F.col("named"), F.col("value")).alias("value")
    # at most `cells` + `tracked` rows a column
    counted = settled(told.groupBy("column_name", "cell", named).agg(F.count(F.lit(1)).alias("n")))
    known = counted.filter(F.col("value").isNotNull()).select("column_name", "value", "n")
    # the count of the last of the best candidates, null if there are fewer
    nth = F.try_element_at(F.sort_array(F.collect_list("n"), asc=False), F.lit(top))
    bar = known.groupBy("column_name").agg(nth.alias("bar"))
    rest = counted.filter(F.col("value").isNull()).join(F.broadcast(bar), "column_name", "left")
    open_cells = rest.filter(F.coalesce(F.col("n") >= F.col("bar"), F.lit(True))).select("column_name", "cell")
    others = told.filter(F.col("named").isNull()).join(F.broadcast(open_cells), ["column_name", "cell"], "left_semi")
    found = known.unionByName(others.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact number of distinct values per column (column_name, n_distinct), blanks as one."""
    return _as_text(df, cols).groupBy("column_name").agg(F.count_distinct("value").alias("n_distinct"))


def metadata_profile(df: DataFrame, cols: Sequence[str], top: int = 8) -> DataFrame:
    """Per column the distinct count and the most frequent values (`<blank>` for empty).

    Ties go to the smaller value.
    """
    return top_values(df, cols, top).join(F.broadcast(distinct_counts(df, cols)), "column_name")


def top_k(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k rows with the largest value, ties by key: sorted per task, merged once."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)


