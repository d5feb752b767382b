import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgauge.llm import negatives

SCHEMA = "id long, descriptor string, vec array<double>, key int, anchor_id int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, is_anchor, positives=5, kept=3, window=(50, 95), scale=256):
    good = [r for r in dict.fromkeys((i, d, None if v is None else tuple(v)) for i, d, v, *_ in rows) if r[0] is not None and r[1] is not None and r[2]]
    good = [r for r in good if all(x is not None and math.isfinite(x) and abs(x * scale) <= negatives.LARGEST for x in r[2])]
    if not good:
        return []
    sizes = [len(r[2]) for r in good]
    dim = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    good = [(i, d, [math.floor(scale * x) for x in v]) for i, d, v in good if len(v) == dim]
    out = []
    for own, label, anchor in good:
        if not is_anchor(own):
            continue
        scored = sorted((-sum(a * b for a, b in zip(anchor, v, strict=True)), i, d) for i, d, v in good if i != own)
        for minus, positive, _ in [s for s in scored if s[2] == label][:positives]:
            p = -minus
            fit = [s for s in scored if s[2] != label and window[0] * p <= -100 * s[0] <= window[1] * p][:kept]
            out += [(own, positive, n, s[1], p, -s[0]) for n, s in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.hard_negatives(df, F.col("id") % 3 == 0, **more).collect())


def table(n, dim, labels, seed=5, grid=None):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    vectors = centres[rng.integers(0, 6, n)] + 0.5 * rng.standard_normal((n, dim))
    if grid:
        vectors = np.round(vectors * grid) / grid
    return [(i, str(rng.integers(0, labels)), v.tolist()) for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("n", "dim", "grid"), [(300, 9, None), (200, 2, 1), (90, 1, 2), (40, 16, None)])
def test_equals_all_pairs_over_several_shards(spark, n, dim, grid):
    rows = table(n, dim, 4, grid=grid)  # a coarse grid makes ties
    want = plain(rows, lambda i: i % 3 == 0)
    assert want and found(spark, rows, shard_rows=37, pack_rows=11, codewords=5) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = table(60, 3, 3)
    rows += [(60, None, [1.0, 1.0, 1.0]), (None, "1", [1.0, 1.0, 1.0]), (63, "1", None), (66, "1", [1.0, None, 2.0]), (69, "2", [nan, 1.0, 1.0]), (72, "2", [1.0, inf, 1.0])]
    rows += [(75, "1", [1.0]), (78, "1", []), (81, "0", [0.0, 0.0, 0.0]), (84, "alone", [3.0, 1.0, 2.0]), (87, "0", [1e200, 1.0, 1.0])]
    rows += rows[:10] + [(3, "2", [0.5, 0.25, 1.0]), (90, "0", [1e5, 1e5, -1e5]), (93, "1", [1e5, 9e4, -1e5]), (96, "0", [1e5, 9.9e4, -9e4])]
    assert found(spark, rows) == plain(rows, lambda i: i % 3 == 0)


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, "a", [1.0]), (2, "b", None)]) == []


def test_many_equal_vectors_are_tied_by_id(spark):
    rows = [(i, str(i % 2), [1.0, 0.5]) for i in range(50)] + [(60 + i, str(i % 2), [0.9, 0.4]) for i in range(50)]
    assert found(spark, rows, shard_rows=9) == plain(rows, lambda i: i % 3 == 0)


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(2)
    first, second = rng.standard_normal(7), rng.standard_normal(5)
    walk = list(negatives.cells_by_bound(first, second))
    assert sorted((i, j) for _, i, j in walk) == [(i, j) for i in range(7) for j in range(5)]
    assert [b for b, _, _ in walk] == sorted((b for b, _, _ in walk), reverse=True)
    assert all(b == first[i] + second[j] for b, i, j in walk)


def test_clustered_curves_leave_cells_unvisited(monkeypatch):
    """Near copies of a few directions: the walk ends before it has looked at all rows."""
    rng = np.random.default_rng(4)
    vectors = (100 * (np.repeat(np.eye(8), 200, axis=0) + 0.01 * rng.standard_normal((1600, 8)))).astype(np.int64)
    books = negatives.fit_codebook(vectors[:, :4].astype(float), 8, 1), negatives.fit_codebook(vectors[:, 4:].astype(float), 8, 2)
    cells = negatives.nearest_codeword(vectors[:, :4], books[0]) * len(books[1]) + negatives.nearest_codeword(vectors[:, 4:], books[1])
    order = np.argsort(cells, kind="stable")
    shard = negatives.Shard(np.arange(1600)[order], ["x"] * 1600, vectors[order], cells[order], books)
    seen = []
    look = shard.look
    monkeypatch.setattr(shard, "look", lambda *a: (seen.append(sum(h - l for l, h in a[4])), look(*a)))
    wanted = negatives.Wanted(-np.inf, np.inf, 5)
    shard.search(-1, vectors[0], np.ones(1600, bool), [wanted])
    assert sum(seen) < 800
    best = np.lexsort((np.arange(1600), -(vectors @ vectors[0])))[:5]
    assert wanted.ids.tolist() == best.tolist()
