"""The most frequent values of columns against counting all of them."""

import random
from collections import Counter

import pytest

from cloudgauge.operators import cleaning

COLUMNS = ["heavy", "tail", "unique", "few", "blank"]


def rows(n=6000):
    draw = random.Random(11)
    for i in range(n):
        heavy = int(draw.paretovariate(0.7))
        tail = f"hot {i % 7}" if i % 3 == 0 else f"t{i}"
        yield (f"h{min(heavy, 10**9)}", tail, i // 2 if i < 40 else i, draw.choice(["a", " a", "b", None]), " " if i % 2 else None)


def expected(data, top):
    out = {}
    for at, name in enumerate(COLUMNS):
        counts = Counter("<blank>" if r[at] is None or not str(r[at]).strip() else str(r[at]).strip() for r in data)
        best = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:top]
        out[name] = ([(v, n, i + 1) for i, (v, n) in enumerate(best)], len(counts))
    return out


@pytest.mark.parametrize(("items", "candidates", "top"), [(4096, 64, 8), (16, 64, 8), (16, 3, 1), (4096, 64, 40)])
def test_top_values_are_exact_whatever_the_summary_tells(spark, monkeypatch, items, candidates, top):
    monkeypatch.setattr(cleaning, "SUMMARY_ITEMS", items)
    monkeypatch.setattr(cleaning, "CANDIDATES", candidates)
    monkeypatch.setattr(cleaning, "PROFILE_CELLS", 1)
    data = list(rows())
    df = spark.createDataFrame(data, "heavy string, tail string, unique int, few string, blank string").repartition(5)
    plain, got = expected(data, top), {c: [] for c in COLUMNS}
    for r in cleaning.metadata_profile(df, COLUMNS, top).orderBy("rank").collect():
        got[r["column_name"]].append((r["value"], r["n"], r["rank"]))
        assert r["n_distinct"] == plain[r["column_name"]][1]
    assert got == {c: best for c, (best, _) in plain.items()}


def test_profile_of_nothing(spark):
    assert cleaning.metadata_profile(spark.createDataFrame([], "a string, b int"), ["a", "b"]).count() == 0
