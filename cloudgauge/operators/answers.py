"""Stored answers: pull out the settings object, check it, compile the call log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.functions.params import ANSWER_BOUNDS, PARAM_NAMES, kind
from cloudgauge.session import settled

FENCE = "```"


def answer_text(col: Column | str) -> Column:
    """From the first opening brace on: inside the first fenced segment that has one, or
    in the whole text. Null without a brace."""
    c = F.col(col) if isinstance(col, str) else col
    fenced = F.filter(F.split(c, FENCE), lambda seg: seg.contains("{"))
    body = F.when(c.contains(FENCE), F.coalesce(F.get(fenced, F.lit(0)), c)).otherwise(c)
    start = F.instr(body, "{")
    return F.when(start > 0, F.substring(body, start, F.length(body)))


def extract_answer_json(df: DataFrame, col: str, params: Sequence[str] = PARAM_NAMES) -> DataFrame:
    """Add `answer_keys` (sorted, null if the text is no object) and `answer`, a struct of
    doubles. The JSON reader stops behind the first object, so trailing text is ignored.
    """
    schema = ", ".join(f"`{p}` double" for p in params)
    body = answer_text(col)
    return (
        df.withColumn("__body", body)
        .withColumn("answer_keys", F.array_sort(F.array_distinct(F.json_object_keys("__body"))))
        .withColumn("answer", F.from_json("__body", schema))
        .drop("__body")
    )


def answer_reason(col: str, params: Sequence[str] = PARAM_NAMES, bounds: dict = ANSWER_BOUNDS) -> Column:
    """Why an extracted answer is not valid, null if it is."""
    names = F.array(*[F.lit(p) for p in sorted(params)])
    numbers, inside = F.lit(True), F.lit(True)
    for p in params:
        v = F.col("answer")[p]
        low, high = bounds[kind(p)]
        numbers = numbers & v.isNotNull()
        inside = inside & (v >= low) & (v <= high)
        if kind(p) == "freq":
            inside = inside & (v > 0)
    return (
        F.when(F.coalesce(F.length(F.trim(col)), F.lit(0)) == 0, "empty")
        .when(F.instr(F.col(col), "{") == 0, "no_object")
        .when(F.col("answer_keys").isNull(), "bad_json")
        .when(F.col("answer_keys") != names, "wrong_keys")
        .when(~numbers, "not_numbers")
        .when(~inside, "out_of_bounds")
    )


def validate_answer(df: DataFrame, col: str, params: Sequence[str] = PARAM_NAMES, bounds: dict = ANSWER_BOUNDS) -> DataFrame:
    """Extract and check: adds `answer_status` (ok/invalid), `reason` and the parsed `answer`
    (null unless ok)."""
    checked = extract_answer_json(df, col, params)
    verdict = F.struct(answer_reason(col, params, bounds).alias("reason"), F.col("answer").alias("__answer"))
    # unfolding the verdict keeps filters on it from being rewritten in terms of every
    # single field, which the optimizer's constraint inference cannot cope with
    checked = checked.select(*df.columns, F.inline(F.array(verdict)))
    ok = F.col("reason").isNull()
    return checked.select(
        *df.columns,
        "reason",
        F.when(ok, "ok").otherwise("invalid").alias("answer_status"),
        F.when(ok, F.col("__answer")).alias("answer"),
    )


def compile_first_ok(
    log: DataFrame, cell: str, order: str, content: str, keep: Sequence[str], params: Sequence[str] = PARAM_NAMES, bounds: dict = ANSWER_BOUNDS
) -> DataFrame:
    """First logged-ok answer of every cell that still validates: (cell, keep, params)."""
    ok = validate_answer(log.filter(F.col("status") == "ok"), content, params, bounds).filter(
        F.col("answer_status") == "ok"
    )
    first = Window.partitionBy(cell).orderBy(order)
    return (
        ok.withColumn("__rn", F.row_number().over(first))
        .filter("__rn = 1")
        .select(cell, *keep, *[F.col("answer")[p].alias(p) for p in params])
    )


def attempt_summary(log: DataFrame, cell: str, model: str, max_attempts: int = 3) -> DataFrame:
    """Per model: cells tried, ok, and failed after the allowed number of attempts."""
    cells = log.groupBy(model, cell).agg(
        F.count(F.lit(1)).alias("tries"), F.bool_or(F.col("status") == "ok").alias("ok")
    )
    return cells.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok") & (F.col("tries") >= max_attempts)).alias("n_failed"),
    )


def price_lookup(usage: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Attach `price_in`, `price_out` ($ per million); 0 for unknown models. The price
    list is small, and the optimizer broadcasts it after checking its size."""
    return usage.join(prices, model, "left").fillna({"price_in": 0.0, "price_out": 0.0})


def cost_rollup(log: DataFrame, prices: DataFrame, model: str, tokens_in: Column, tokens_out: Column) -> DataFrame:
    """Calls, tokens and dollars per model plus a grand total (model null); missing usage
    counts as zero."""
    per_model = log.groupBy(model).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce(tokens_in, F.lit(0))).alias("tokens_in"),
        F.sum(F.coalesce(tokens_out, F.lit(0))).alias("tokens_out"),
    )
    priced = price_lookup(per_model, prices, model).withColumn(
        "cost", F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")
    )
    return priced.rollup(model).agg(
        *[F.sum(c).alias(c) for c in ("calls", "tokens_in", "tokens_out", "cost")]
    )


# --- the answer grid -------------------------------------------------------------------


def grid_cross_join(base: DataFrame, dims: dict[str, Sequence], n_samples: int, greedy_temp: float, cloud_temp: float) -> DataFrame:
    """Expand every base row by the given value lists and by 1 greedy + n sampled cells.

    The lists are literals exploded in place: no join at all.
    """
    out = base
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    out = out.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_samples))))
    return out.withColumn(
        "temperature", F.when(F.col("sample_idx") == 0, F.lit(greedy_temp)).otherwise(F.lit(cloud_temp))
    )


def grid_union(sets: Sequence[tuple[DataFrame, dict[str, Sequence], int]], greedy_temp: float, cloud_temp: float) -> DataFrame:
    """All cells that are to be asked: several sets, each (base rows, dimensions, sampled
    cells per greedy one), as one table. A cell of two sets is asked once."""
    union = None
    for base, dims, n_samples in sets:
        cells = grid_cross_join(base, dims, n_samples, greedy_temp, cloud_temp)
        union = cells if union is None else union.unionByName(cells)
    return union.distinct()


def resume_anti_join(cells: DataFrame, log: DataFrame, cell: str) -> DataFrame:
    """Cells without an ok row in the log."""
    return cells.join(log.filter(F.col("status") == "ok").select(cell).distinct(), cell, "left_anti")


# --- templates ---------------------------------------------------------------------------


def settings_json(params: Sequence[str] = PARAM_NAMES, digits: int = 2) -> Column:
    """The settings as a JSON object in field order, rounded."""
    return F.to_json(F.struct(*[F.bround(p, digits).alias(p) for p in params]))


def exemplar_block(picks: DataFrame, by: list[str], payload: str, order: str) -> DataFrame:
    """(by, n_context, context): the picked rows' JSON, one line each, in a fixed order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).alias("p"))))
    return picks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_context"),
        F.array_join(F.transform(lines, lambda x: x["p"]), "\n").alias("context"),
    )


def fill_template(
    cells: DataFrame, templates: DataFrame, contexts: DataFrame | None, variant: str, label: str, on: Sequence[str] = ()
) -> DataFrame:
    """Add `prompt_text`: the variant's template with its placeholders replaced, behind
    the context block if there is one. `templates` has (variant, template, block)."""
    out = cells.join(templates, variant)
    if contexts is not None:
        out = out.join(contexts, list(on), "left")
        block = F.replace(
            F.replace(
                F.replace(F.col("block"), F.lit("{n}"), F.col("n_context").cast("string")),
                F.lit("{descriptor}"),
                F.col(label),
            ),
            F.lit("{context}"),
            F.col("context"),
        )
        prefix = F.when(F.col("context").isNotNull(), block).otherwise("")
    else:
        prefix = F.lit("")
    body = F.replace(F.col("template"), F.lit("{descriptor}"), F.col(label))
    return out.withColumn("prompt_text", F.concat(prefix, body)).drop("template", "block", "context", "n_context")


# --- probes -------------------------------------------------------------------------------


BITS_PER_HEAD = 16
PROBES = 3  # bits of one head; about 0.5 % of other windows meet all of them
FILTER_BYTES = 32 << 20
FILTER_TASKS = 16
_RUN_LETTERS = 1 << 15
_LADDER: list[np.ndarray] = []


def _ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept for the texts to come."""
    if not _LADDER or len(_LADDER[0]) <= n:
        size, base = max(1 << 12, 1 << (n + 1).bit_length()), 0x9E3779B97F4A7C15
        one = np.ones(1, np.uint64)  # a plain 1 would turn the powers into floats
        _LADDER[:] = [np.cumprod(np.concatenate([one, np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64))]
    return _LADDER[0], _LADDER[1]


def window_hashes(text: str, lengths: Sequence[int]) -> np.ndarray:
    """64-bit hashes of all windows of the given lengths (in characters) of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    powers, inverse = _ladder(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * inverse[:n], dtype=np.uint64)])
    out = []
    for size in lengths:
        if size <= n:
            value = (sums[size:] - sums[:-size]) * powers[size - 1 : n]
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size)
            out.append(value ^ (value >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def filter_shape(n_heads: int, most_bytes: int = FILTER_BYTES) -> tuple[int, int]:
    """(log2 of the bits of a filter, number of filters): 16 to 32 bits a head, cut by hash
    into filters of at most `most_bytes` bytes."""
    bits = max(1 << 12, 1 << (max(1, n_heads) * BITS_PER_HEAD - 1).bit_length())
    most = 1 << ((8 * most_bytes).bit_length() - 1)
    return min(bits, most).bit_length() - 1, max(1, bits // most)


def _places(value: np.ndarray, log_bits: int) -> Iterator[np.ndarray]:
    """The bits that belong to a hash, one array a probe."""
    mixed = value
    for _ in range(PROBES):
        yield mixed >> np.uint64(64 - log_bits)
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)


def passes_filter(value: np.ndarray, bits: np.ndarray, log_bits: int) -> np.ndarray:
    ok = np.ones(len(value), bool)
    for at in _places(value, log_bits):
        ok &= ((bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
    return ok


def filter_of(hashes: Iterator[np.ndarray], log_bits: int) -> np.ndarray:
    bits = np.zeros(1 << log_bits, bool)
    for value in hashes:
        for at in _places(value, log_bits):
            bits[at] = True
    return np.packbits(bits)


def passing_windows(texts: Sequence[str], lengths: Sequence[int], bits: np.ndarray, log_bits: int) -> list[np.ndarray]:
    """Per text the different window hashes that pass the filter, as signed numbers. Texts
    are hashed in runs, end to end, and windows over an end are left out."""
    out, low = [], 0
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    while low < len(texts):
        before = ends[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(ends, before + _RUN_LETTERS, "right")))
        joined, own = "".join(texts[low:high]), sizes[low:high]
        text, end = np.repeat(np.arange(high - low), own), np.repeat(ends[low:high] - before, own)
        found = []
        for size in lengths:
            value = window_hashes(joined, [size])
            start = np.flatnonzero(np.arange(len(value)) + size <= end[: len(value)])
            start = start[passes_filter(value[start], bits, log_bits)]
            found.append(np.stack([text[start].astype(np.uint64), value[start]]))
        every = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.uint64)
        cuts = np.searchsorted(every[0], np.arange(1, high - low, dtype=np.uint64))
        out += np.split(np.ascontiguousarray(every[1]).view(np.int64), cuts)
        low = high
    return out


def _part_of(value: np.ndarray, parts: int) -> np.ndarray:
    return (value % np.uint64(parts)).astype(np.int64)


def _windows_by_broadcast(responses: DataFrame, text: str, heads: DataFrame, lengths: list[int], log_bits: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_of((np.asarray(b.column(0)).view(np.uint64) for b in batches), log_bits)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    packed = np.zeros(1 << log_bits - 3, np.uint8)
    for row in heads.select("__hash").repartition(FILTER_TASKS, "__hash").mapInArrow(build, "bits binary").toLocalIterator():
        packed |= np.frombuffer(row["bits"], np.uint8)
    shared = responses.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("array<long>")
    def passing(column: pd.Series) -> pd.Series:
        return pd.Series(passing_windows([t or "" for t in column], lengths, shared.value, log_bits), dtype=object)

    return responses.select("*", F.explode(passing(F.col(text))).alias("__hash"))


def _windows_by_part(responses: DataFrame, id_col: str, text: str, heads: DataFrame, lengths: list[int], log_bits: int, parts: int) -> DataFrame:
    """The same with several filters: a text travels once to each of them."""
    spark = responses.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    id_type = responses.schema[id_col].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        bits = filter_of(iter([table["__hash"].to_numpy().view(np.uint64)]), log_bits)
        return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    part = F.pmod(F.conv(F.hex("__hash"), 16, 10).cast("decimal(20,0)"), F.lit(parts)).cast("int")
    filters = heads.select(part.alias("part"), "__hash").groupBy("part").applyInArrow(build, "part int, bits binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = filters.withColumn("salt", every(salts)).select("part", "salt", F.lit(None).cast(id_type).alias(id_col), F.lit(None).cast("string").alias(text), "bits")
    asked = responses.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")).withColumn("part", every(parts))
    asked = asked.select("part", "salt", id_col, text, F.lit(None).cast("binary").alias("bits"))
    dealt = sent.unionByName(asked).repartition(max(parts * salts, 1), "part", "salt").sortWithinPartitions("part", "salt", F.col("bits").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        for batch in batches:
            ids, texts, found = [], [], []
            for i, (p, s) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (p, s) != now:
                    now, bits = (p, s), None
                if (raw := batch.column(4)[i].as_py()) is not None:
                    bits = np.frombuffer(raw, np.uint8)
                elif bits is not None:  # a part without heads has no filter
                    own = batch.column(3)[i].as_py()
                    value = window_hashes(own or "", lengths)
                    value = value[_part_of(value, parts) == p]
                    value = np.unique(value[passes_filter(value, bits, log_bits)])
                    ids += [i] * len(value)
                    found.append(value.view(np.int64))
            at = pa.array(ids, pa.int64())
            hashes = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at), pa.array(hashes)], names=[id_col, text, "__hash"])

    return dealt.mapInArrow(run, f"`{id_col}` {id_type}, `{text}` string, __hash long")


def probe_verbatim(
    responses: DataFrame, id_col: str, text: str, passages: DataFrame, passage: str, width: int = 60, filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """Does the response hold the first `width` characters of one of the passages?

    Windows of a response are hashed where it lies and looked up in a filter of the
    passages' hashes, sized by their number, so that about one other window in 200 passes; only
    windows that pass are joined with the passages, and the text is compared in the end.
    A filter has at most `filter_bytes` bytes: more passages than fit are cut by hash, and
    the texts go to one filter after another. Blank passages count for nothing, shorter
    ones with their whole text.
    """
    heads = (
        passages.filter(F.trim(passage) != "").select(F.substring(passage, 1, width).alias("__head")).distinct()
    )

    @F.pandas_udf("long")
    def own_hash(column: pd.Series) -> pd.Series:
        return pd.Series([int(window_hashes(t, [len(t)]).view(np.int64)[0]) for t in column], dtype="int64")

    heads = settled(heads.select("__head", F.length("__head").alias("__len"), own_hash("__head").alias("__hash")))
    # no more lengths than `width`
    sizes = heads.groupBy("__len").count().collect()
    lengths = sorted(r[0] for r in sizes)
    log_bits, parts = filter_shape(sum(r[1] for r in sizes), filter_bytes)
    slim = responses.select(id_col, text)
    if parts == 1:
        windows = _windows_by_broadcast(slim, text, heads, lengths, log_bits)
    else:
        windows = _windows_by_part(slim, id_col, text, heads, lengths, log_bits, parts)
    found = (
        windows.join(heads, "__hash")
        .filter(F.contains(F.col(text), F.col("__head")))
        .select(id_col)
        .distinct()
        .withColumn("__hit", F.lit(True))
    )
    hit = F.coalesce("__hit", F.lit(False))
    return responses.join(found, id_col, "left").withColumn("verbatim", _verdict(hit, text, "verbatim_recall")).drop("__hit")


def probe_statistic(responses: DataFrame, text: str, truths: Sequence[Column], tolerance: float = 1.0, first: int = 4) -> DataFrame:
    """Is each truth met, within the tolerance, by one of the first numbers in the text?"""
    numbers = F.transform(
        F.slice(F.regexp_extract_all(F.col(text), F.lit(r"(-?\d+\.?\d*)"), F.lit(1)), 1, first), lambda x: x.cast("double")
    )
    hit = F.lit(True)
    for t in truths:
        hit = hit & F.exists("__numbers", _near(t, tolerance))
    return (
        responses.withColumn("__numbers", numbers)
        .withColumn("statistical", _verdict(hit, text, "statistical_recall"))
        .drop("__numbers")
    )


def _near(truth: Column, tolerance: float):
    return lambda x: F.abs(x - truth) <= tolerance


def _verdict(hit: Column, text: str, name: str) -> Column:
    declined = F.contains(F.upper(text), F.lit("CANNOT RECALL"))
    return F.when(hit, name).when(declined, "declined").otherwise("no_match")


def probe_keyword(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return c.contains("25") | F.lower(c).contains("columns")


def recall_verdicts(probed: DataFrame, model: str) -> DataFrame:
    """How many models recall verbatim, or statistically, at least once."""
    per_model = probed.groupBy(model).agg(
        F.bool_or(F.col("verbatim") == "verbatim_recall").alias("v"),
        F.bool_or(F.col("statistical") == "statistical_recall").alias("s"),
    )
    return per_model.agg(
        F.count(F.lit(1)).alias("n_models"), F.count_if("v").alias("n_verbatim"), F.count_if("s").alias("n_statistical")
    )
