"""Settings to frequency-response curves.

The magnitude of a second-order filter at angle w is written in phi = sin^2(w/2),

    |b0 + b1 z + b2 z^2|^2 = (b0+b1+b2)^2 - 4 (b0 b1 + 4 b0 b2 + b1 b2) phi + 16 b0 b2 phi^2,

which keeps its digits near zero frequency where the cos(w) form cancels. Coefficients
are columns of the settings row and the grid is a constant array, so the long form is one
generated stage: no join, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.functions.params import BANDS, Band

# Sample rate, shelf slope and measurement grid.
SAMPLE_RATE = 48000.0
SHELF_Q = 0.71
GRID_POINTS = 256
GRID_LOW_HZ = 20.0
GRID_HIGH_HZ = 20000.0

_RENDER_CELLS = 1 << 15  # a quarter megabyte an array
_DB = 10.0 / math.log(10.0)
COEFFICIENTS = ["b0", "b1", "b2", "a0", "a1", "a2"]


def grid_hz(points: int = GRID_POINTS) -> list[float]:
    ratio = GRID_HIGH_HZ / GRID_LOW_HZ
    return [GRID_LOW_HZ * ratio ** (i / (points - 1)) for i in range(points)]


def grid_phi(points: int = GRID_POINTS, fs: float = SAMPLE_RATE) -> list[float]:
    return [math.sin(math.pi * f / fs) ** 2 for f in grid_hz(points)]


def frequency_grid(spark: SparkSession, points: int = GRID_POINTS) -> DataFrame:
    """(bin, freq_hz, phi): the fixed measurement grid as a table."""
    rows = [(i, f, p) for i, (f, p) in enumerate(zip(grid_hz(points), grid_phi(points)))]
    return spark.createDataFrame(rows, "bin int, freq_hz double, phi double")


def filter_coefficients(
    shape: str, gain: Column, freq: Column, q: Column, fs: float = SAMPLE_RATE, sin=F.sin, cos=F.cos, sqrt=F.sqrt
) -> dict[str, Column]:
    """Cookbook coefficients of one filter; also works on numpy arrays with np.sin etc."""
    amp = 10.0 ** (gain / 40.0) if sin is not F.sin else F.pow(F.lit(10.0), gain / 40.0)
    w0 = 2.0 * math.pi * freq / fs
    return _from_angles(shape, amp, cos(w0), sin(w0) / (2.0 * q), sqrt)


def _from_angles(shape: str, amp, cw, alpha, sqrt) -> dict[str, Column]:
    if shape == "peaking":
        return {
            "b0": 1.0 + alpha * amp,
            "b1": -2.0 * cw,
            "b2": 1.0 - alpha * amp,
            "a0": 1.0 + alpha / amp,
            "a1": -2.0 * cw,
            "a2": 1.0 - alpha / amp,
        }
    # a high shelf is the low shelf mirrored in frequency: cos(w0) changes sign, and so
    # do the two odd coefficients
    flip = 1.0 if shape == "low_shelf" else -1.0
    c = cw * flip
    up, down = amp + 1.0, amp - 1.0
    slope = 2.0 * sqrt(amp) * alpha
    return {
        "b0": amp * (up - down * c + slope),
        "b1": 2.0 * flip * amp * (down - up * c),
        "b2": amp * (up - down * c - slope),
        "a0": up + down * c + slope,
        "a1": -2.0 * flip * (down + up * c),
        "a2": up + down * c - slope,
    }


def _band_q(band: Band, shelf_q: float) -> Column:
    return F.col(band.q) if band.q else F.lit(shelf_q)


def biquad_coefficients(
    df: DataFrame, keys: list[str], bands: Sequence[Band] = BANDS, fs: float = SAMPLE_RATE, shelf_q: float = SHELF_Q
) -> DataFrame:
    """(keys, filter, shape, b0..a2): one row per filter of the chain.

    The filters are unfolded first and their powers, sines and cosines are columns of their
    own, so each is computed once and the generated code stays small enough to be compiled.
    """
    settings = [
        F.struct(F.lit(i).alias("filter"), F.lit(b.shape).alias("shape"), F.col(b.gain).alias("__gain"), F.col(b.freq).alias("__freq"), _band_q(b, shelf_q).alias("__q"))
        for i, b in enumerate(bands)
    ]
    chain = df.select(*keys, F.inline(F.array(*settings)))
    w0 = 2.0 * math.pi * F.col("__freq") / fs
    amp = F.pow(F.lit(10.0), F.col("__gain") / 40.0)
    angles = chain.select(*keys, "filter", "shape", amp.alias("__amp"), F.cos(w0).alias("__cw"), (F.sin(w0) / (2.0 * F.col("__q"))).alias("__alpha"))
    co = {shape: _from_angles(shape, F.col("__amp"), F.col("__cw"), F.col("__alpha"), F.sqrt) for shape in {b.shape for b in bands}}

    def by_shape(name: str) -> Column:
        out = None
        for shape, of in co.items():
            here = F.col("shape") == shape
            out = F.when(here, of[name]) if out is None else out.when(here, of[name])
        return out

    return angles.select(*keys, "filter", "shape", *[by_shape(k).alias(k) for k in COEFFICIENTS])


def _quadratic(c0, c1, c2):
    """The three phi coefficients of one polynomial's squared magnitude."""
    total = c0 + c1 + c2
    return total * total, -4.0 * (c0 * c1 + 4.0 * c0 * c2 + c1 * c2), 16.0 * c0 * c2


def render_curves(
    df: DataFrame,
    keys: list[str],
    bands: Sequence[Band] = BANDS,
    points: int = GRID_POINTS,
    fs: float = SAMPLE_RATE,
    shelf_q: float = SHELF_Q,
) -> DataFrame:
    """Long form (keys, bin, db): the chain's response in dB at every grid point."""
    quads = []
    for i, b in enumerate(bands):
        co = filter_coefficients(b.shape, F.col(b.gain), F.col(b.freq), _band_q(b, shelf_q), fs)
        for side, names in (("n", ("b0", "b1", "b2")), ("d", ("a0", "a1", "a2"))):
            for power, c in enumerate(_quadratic(*[co[k] for k in names])):
                quads.append(c.alias(f"__{side}{i}_{power}"))
    coeffs = df.select(*keys, *quads)
    grid = F.array(*[F.lit(p) for p in grid_phi(points, fs)])
    wide = coeffs.select("*", F.posexplode(grid).alias("bin", "__phi"))
    phi = F.col("__phi")

    def product(side: str) -> Column:
        out = None
        for i in range(len(bands)):
            c0, c1, c2 = (F.col(f"__{side}{i}_{p}") for p in range(3))
            term = c0 + phi * (c1 + phi * c2)
            out = term if out is None else out * term
        return out

    return wide.select(*keys, "bin", (10.0 * F.log10(product("n") / product("d"))).alias("db"))


def curve_vector(
    bands: Sequence[Band] = BANDS, points: int = GRID_POINTS, fs: float = SAMPLE_RATE, shelf_q: float = SHELF_Q
) -> Column:
    """The same response as one array<double> column.

    Built-in array functions are interpreted per element, so the packed form is computed
    on Arrow batches; it spares the shuffle that collecting the long form would need.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def render(settings: pa.Array) -> pa.Array:
        out = np.empty((len(settings), points))
        chain = _chain(_columns(settings), bands, fs, shelf_q)
        for part, gain in _gains(chain, len(settings), np.asarray(grid_phi(points, fs))):
            np.multiply(np.log(gain, out=gain), _DB, out=out[part])
        offsets = pa.array(np.arange(len(settings) + 1, dtype=np.int32) * points)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return render(F.struct(*setting_names(bands)))


def setting_names(bands: Sequence[Band] = BANDS) -> list[str]:
    return [c for b in bands for c in ((b.gain, b.freq, b.q) if b.q else (b.gain, b.freq))]


def _columns(settings: pa.StructArray) -> dict[str, np.ndarray]:
    names = [settings.type.field(i).name for i in range(settings.type.num_fields)]
    return {n: c.to_numpy(zero_copy_only=False).astype(float) for n, c in zip(names, settings.flatten(), strict=True)}


def _chain(cols: dict[str, np.ndarray], bands: Sequence[Band], fs: float, shelf_q: float) -> list[tuple]:
    """Per filter both polynomials in phi, one row of coefficients per setting."""
    out = []
    for b in bands:
        q = cols[b.q][:, None] if b.q else shelf_q
        co = filter_coefficients(b.shape, cols[b.gain][:, None], cols[b.freq][:, None], q, fs, np.sin, np.cos, np.sqrt)
        out.append(tuple(np.hstack(_quadratic(*[co[k] for k in names])) for names in (("b0", "b1", "b2"), ("a0", "a1", "a2"))))
    return out


def _gains(chain: list[tuple], rows: int, phi: np.ndarray, start: int = 0) -> Iterator[tuple[slice, np.ndarray]]:
    """The chain's squared magnitude at `phi`, some rows at a time, which stay in cache."""
    step = max(1, _RENDER_CELLS // len(phi))
    powers = np.stack([np.ones_like(phi), phi, phi * phi])
    shape = (min(step, max(rows - start, 0)), len(phi))
    up, down, term = np.empty(shape), np.empty(shape), np.empty(shape)
    for low in range(start, rows, step):
        part = slice(low, min(low + step, rows))
        n, d, t = (x[: part.stop - low] for x in (up, down, term))
        for out, side in ((n, 0), (d, 1)):
            for i, polynomials in enumerate(chain):
                np.matmul(polynomials[side][part], powers, out=t if i else out)
                if i:
                    out *= t
        n /= d
        yield part, n


def folded_curves(
    df: DataFrame,
    by: list[str],
    bands: Sequence[Band] = BANDS,
    points: int = GRID_POINTS,
    fs: float = SAMPLE_RATE,
    shelf_q: float = SHELF_Q,
    groups: int = 2048,
) -> DataFrame:
    """What `render_curves` gives, folded per group and grid point where the settings lie:
    (by, bin, n, n_db, mean, sd, min_db, max_db), `n_db` the rows with a value, sd of the
    population. A task holds the sums of at most `groups` groups; curves are never rows."""
    names = setting_names(bands)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    sums = ["n_db", "s", "ss", "low", "high"]
    schema = f"{kinds}, n long, " + ", ".join(f"{c} array<double>" for c in sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi, held = np.asarray(grid_phi(points, fs)), {}

        def flush() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in held], arrow_types[i]) for i in range(len(by))]
            stacked = np.stack([v for _, v in held.values()])
            offsets = pa.array(np.arange(len(held) + 1, dtype=np.int32) * points)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(stacked[:, i]).ravel())) for i in range(len(sums))]
            n = pa.array([n for n, _ in held.values()], pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([*keys, n, *lists], names=[*by, "n", *sums])

        for batch in batches:
            if not batch.num_rows:
                continue
            arrow_types = [batch.schema.field(c).type for c in by]
            codes = pa.table({c: batch.column(c) for c in by}).append_column("__row", pa.array(np.arange(batch.num_rows)))
            rows_of = codes.group_by(by).aggregate([("__row", "list")])
            keys = list(zip(*[rows_of[c].to_pylist() for c in by], strict=True))
            lists = rows_of["__row_list"].combine_chunks()
            order, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))
            ordered = pa.table({c: batch.column(c) for c in names}).take(pa.array(order))
            absent = np.logical_or.reduce([c.is_null().to_numpy() for c in ordered.columns])
            cols = {c: ordered[c].to_numpy().astype(float) for c in names}
            chain = _chain(cols, bands, fs, shelf_q)
            first = 0
            for key, end in zip(keys, ends.tolist(), strict=True):
                if key not in held:
                    if len(held) >= groups:
                        yield flush()
                    held[key] = [0, np.array([np.zeros(points)] * 3 + [np.full(points, np.inf), np.full(points, -np.inf)])]
                own = held[key]
                own[0] += end - first
                _, total = own
                with np.errstate(all="ignore"):
                    for part, gain in _gains(chain, end, phi, first):
                        # as in SQL: no value for an absent setting, nor for a magnitude of zero or less
                        none = (gain <= 0) | absent[part, None]
                        db = np.log(gain, out=gain)
                        db *= _DB
                        if none.any():
                            total[0] += (~none).sum(axis=0)
                            total[3] = np.fmin(total[3], np.where(none, np.inf, db).min(axis=0))
                            total[4] = np.maximum(total[4], np.where(none, -np.inf, db).max(axis=0))
                            db[none] = 0.0
                        else:
                            total[0] += len(db)
                            total[3] = np.fmin(total[3], np.fmin.reduce(db, axis=0))
                            total[4] = np.maximum(total[4], db.max(axis=0))
                        total[1] += db.sum(axis=0)
                        total[2] += np.einsum("ij,ij->j", db, db)
                first = end
        if held:
            yield flush()

    parts = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(fold, schema)
    each = parts.select(*by, "n", F.posexplode(F.arrays_zip(*sums)).alias("bin", "__x"))
    n_db, mean = F.sum("__x.n_db"), F.sum("__x.s") / F.nullif(F.sum("__x.n_db"), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.sum("__x.ss") / F.nullif(n_db, F.lit(0.0)) - mean * mean, F.lit(0.0)))
    valued = n_db > 0
    return each.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"),
        n_db.cast("long").alias("n_db"),
        mean.alias("mean"),
        spread.alias("sd"),
        F.when(valued, F.min("__x.low")).alias("min_db"),
        F.when(valued, F.max("__x.high")).alias("max_db"),
    )


def region_vector(
    regions: Sequence[tuple[str, float, float]],
    bands: Sequence[Band] = BANDS,
    points: int = GRID_POINTS,
    fs: float = SAMPLE_RATE,
    shelf_q: float = SHELF_Q,
) -> Column:
    """The curve's mean level in each region (name, low and high frequency, low included),
    one array<double> column; null where the curve has no value. A grid point belongs to
    the first region that holds it."""
    hz = np.array(grid_hz(points))
    held = np.stack([(hz >= low - 1e-9) & (hz < high) for _, low, high in regions], axis=1)
    inside = (held & (np.cumsum(held, axis=1) == 1)).astype(float)
    share = inside / inside.sum(axis=0)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def level(settings: pa.Array) -> pa.Array:
        out = np.empty((len(settings), len(regions)))
        chain = _chain(_columns(settings), bands, fs, shelf_q)
        with np.errstate(all="ignore"):
            for part, gain in _gains(chain, len(settings), np.asarray(grid_phi(points, fs))):
                out[part] = np.log(gain, out=gain) @ (_DB * share)
        offsets = pa.array(np.arange(len(settings) + 1, dtype=np.int32) * len(regions))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), mask=~np.isfinite(out.ravel())))

    return level(F.struct(*setting_names(bands)))


CHECKS = ["flat", "peak", "low_shelf", "high_shelf", "cancellation"]


def settings_checks(bands: Sequence[Band] = BANDS, fs: float = SAMPLE_RATE, shelf_q: float = SHELF_Q) -> Column:
    """The checks of the renderer on a row's settings, a struct of booleans: without gains
    the curve is flat; one filter alone, with the row's gain (within 6 dB) at the frequency
    of the check, has that gain where it should and none far from there; negated gains
    cancel. The curves stay in the task, and where a check asks for some points of the grid
    only these are rendered."""
    hz, phi = grid_hz(), np.asarray(grid_phi(fs=fs))
    near = lambda f: min(range(len(hz)), key=lambda i: abs(hz[i] - f))
    gains = [b.gain for b in bands]
    # gain, fixed settings, (grid point, whether the gain is there, tolerance)
    alone = {
        "peak": ("band2_gain", {"band2_freq": 1000.0, "band2_q": 1.0}, [(near(1000.0), 1, 0.05), (0, 0, 0.1), (len(hz) - 1, 0, 0.1)]),
        "low_shelf": ("low_shelf_gain", {"low_shelf_freq": 100.0}, [(0, 1, 0.3), (near(10000.0), 0, 0.1)]),
        "high_shelf": ("high_shelf_gain", {"high_shelf_freq": 10000.0}, [(len(hz) - 1, 1, 0.5), (near(100.0), 0, 0.1)]),
    }

    def within(gain: np.ndarray, tolerance: float) -> np.ndarray:
        return (gain.min(axis=1) > 10 ** (-tolerance / 10)) & (gain.max(axis=1) < 10 ** (tolerance / 10))

    @F.arrow_udf(T.StructType([T.StructField(name, T.BooleanType()) for name in CHECKS]))
    def check(settings: pa.Array) -> pa.Array:
        rows, cols = len(settings), _columns(settings)
        silent = {**cols, **{g: np.zeros(rows) for g in gains}}
        fine = {name: np.zeros(rows, bool) for name in CHECKS}
        with np.errstate(all="ignore"):
            for part, gain in _gains(_chain(silent, bands, fs, shelf_q), rows, phi):
                fine["flat"][part] = within(gain, 0.01)
            for name, (own, fixed, points) in alone.items():
                scaled = np.fmax(-6.0, np.fmin(6.0, cols[own]))
                changed = {**silent, **{k: np.full(rows, v) for k, v in fixed.items()}, own: scaled}
                places, there, tolerance = (np.array(x) for x in zip(*points, strict=True))
                for part, gain in _gains(_chain(changed, bands, fs, shelf_q), rows, phi[places]):
                    fine[name][part] = (np.abs(_DB * np.log(gain) - scaled[part, None] * there) < tolerance).all(axis=1)
            down = {**cols, **{g: -cols[g] for g in gains}}
            both = (_gains(_chain(x, bands, fs, shelf_q), rows, phi) for x in (cols, down))
            for (part, up), (_, other) in zip(*both, strict=True):
                fine["cancellation"][part] = within(np.multiply(up, other, out=up), 0.05)
        return pa.StructArray.from_arrays([pa.array(fine[name]) for name in CHECKS], CHECKS)

    return check(F.struct(*setting_names(bands)))


def render_packed(df: DataFrame, out: str = "vec", **options) -> DataFrame:
    """Add the curve as an array column to every row."""
    return df.withColumn(out, curve_vector(**options))


def render_table_job(spark: SparkSession, src: str | list[str], dst: str, out: str = "response_db", **options) -> DataFrame:
    """Read a settings table (a path, or some of its files), add the curve to every record,
    write it, return it."""
    render_packed(spark.read.parquet(*([src] if isinstance(src, str) else src)), out, **options).write.mode("errorifexists").parquet(dst)
    return spark.read.parquet(dst)


def render_checks(spark: SparkSession) -> DataFrame:
    """The analytic checks of the renderer: (name, worst, tolerance, passed)."""
    # The flat check vector and the tolerances.
    flat = {
        "low_shelf_gain": 0.0,
        "low_shelf_freq": 100.0,
        "band1_gain": 0.0,
        "band1_freq": 250.0,
        "band1_q": 1.0,
        "band2_gain": 0.0,
        "band2_freq": 1000.0,
        "band2_q": 1.0,
        "band3_gain": 0.0,
        "band3_freq": 4000.0,
        "band3_q": 1.0,
        "high_shelf_gain": 0.0,
        "high_shelf_freq": 10000.0,
    }
    cases = {
        "flat": {},
        "peak": {"band2_gain": 6.0},
        "low_shelf": {"low_shelf_gain": 6.0},
        "high_shelf": {"high_shelf_gain": -6.0},
        "up": {"band1_gain": 6.0, "band1_freq": 500.0, "band1_q": 2.0},
        "down": {"band1_gain": -6.0, "band1_freq": 500.0, "band1_q": 2.0},
    }
    names = list(flat)
    rows = [(k, *[{**flat, **v}[n] for n in names]) for k, v in cases.items()]
    table = spark.createDataFrame(rows, ["case", *names])
    curves = render_curves(table, ["case"])
    hz = grid_hz()

    def near(f: float) -> int:
        return min(range(len(hz)), key=lambda i: abs(hz[i] - f))

    first, last = 0, len(hz) - 1
    # name, case, grid point or None for all, expected dB, tolerance
    points = [
        ("flat", "flat", None, 0.0, 0.01),
        ("peak_centre", "peak", near(1000.0), 6.0, 0.05),
        ("peak_low_end", "peak", first, 0.0, 0.1),
        ("peak_high_end", "peak", last, 0.0, 0.1),
        ("low_shelf_low_end", "low_shelf", first, 6.0, 0.3),
        ("low_shelf_10k", "low_shelf", near(10000.0), 0.0, 0.1),
        ("high_shelf_high_end", "high_shelf", last, -6.0, 0.5),
        ("high_shelf_100", "high_shelf", near(100.0), 0.0, 0.1),
    ]
    worst = None
    for name, case, at, want, tol in points:
        here = F.col("case") == case
        if at is not None:
            here = here & (F.col("bin") == at)
        part = curves.filter(here).agg(F.max(F.abs(F.col("db") - want)).alias("worst"))
        part = part.select(F.lit(name).alias("name"), "worst", F.lit(tol).alias("tolerance"))
        worst = part if worst is None else worst.unionByName(part)
    cancel = (
        curves.filter(F.col("case").isin("up", "down"))
        .groupBy("bin")
        .agg(F.abs(F.sum("db")).alias("s"))
        .agg(F.max("s").alias("worst"))
        .select(F.lit("cancellation").alias("name"), "worst", F.lit(0.05).alias("tolerance"))
    )
    ends = frequency_grid(spark).agg(
        F.greatest(
            F.abs(F.min("freq_hz") / GRID_LOW_HZ - 1.0),
            F.abs(F.max("freq_hz") / GRID_HIGH_HZ - 1.0),
            F.abs(F.count_distinct("freq_hz") - F.lit(float(GRID_POINTS))),
        ).alias("worst")
    ).select(F.lit("grid").alias("name"), "worst", F.lit(1e-6).alias("tolerance"))
    return worst.unionByName(cancel).unionByName(ends).withColumn("passed", F.col("worst") < F.col("tolerance"))
