"""Near duplicates, components, repeated passages and suffix order against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgauge.llm import induced, repeats, simhash
from cloudgauge.llm.components import components
from tests.llm import brute, edge


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def as_receipts(spark, texts):
    return spark.createDataFrame(list(texts.items()), "cell_id long, response_content string")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sets_of(roots):
    out = defaultdict(set)
    for node, root in roots.items():
        out[root].add(node)
    return sorted(map(sorted, out.values()))


def test_groups_of_documents(spark, documents):
    texts = {**documents, **{10_000 + i: t for i, (_, t, *_) in enumerate(edge.rows())}}
    got = simhash.near_duplicate_groups(as_receipts(spark, texts), shingle_words=4).collect()
    prints = {k: brute.simhash(t, 4) for k, t in texts.items()}
    want = brute.groups(prints, 4)
    assert {r.cell_id: (r.fingerprint, r.component_id) for r in got} == {k: (signed(prints[k]), want[k]) for k in texts}


@pytest.fixture(scope="module")
def ball():
    """Fingerprints crowded around a few centres."""
    rng = random.Random(3)
    values = set()
    for _ in range(15):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(rng.randrange(10)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    return sorted(values)


@pytest.mark.parametrize(("max_bits", "chain", "parts", "block"), [(4, 2, 3, 8192), (4, 2, 3, 40), (3, 3, 4, 8192), (8, 3, 4, 500), (2, 1, 1, 8192)])
def test_all_links_are_found(spark, ball, max_bits, chain, parts, block):
    frame = spark.createDataFrame([(signed(x),) * 3 for x in ball], "node long, fingerprint long, beside long")
    links = simhash.link_fingerprints(frame, max_bits, chain, parts, block=block)
    roots = {r.node: r.root for r in components(links).collect()}
    want = brute.groups(dict(enumerate(ball)), max_bits)
    assert sets_of({signed(x): roots.get(signed(x), signed(x)) for x in ball}) == sets_of_values(ball, want)


def sets_of_values(values, roots):
    out = defaultdict(set)
    for i, root in roots.items():
        out[root].add(signed(values[i]))
    return sorted(map(sorted, out.values()))


def test_chain_keys_keep_every_close_pair():
    rng = random.Random(8)
    for max_bits, chain, parts in ((4, 2, 3), (8, 3, 4), (3, 2, 5)):
        masks = [m & (1 << 64) - 1 for _, m in simhash.key_masks(max_bits, chain, parts)]
        for _ in range(300):
            apart = sum(1 << b for b in rng.sample(range(64), rng.randrange(max_bits + 1)))
            assert any(not apart & m for m in masks)


def test_several_fingerprints_find_texts_that_share_four_fifths(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for i in range(60):
        words = [word() for _ in range(300)]
        changed = list(words)
        for at in rng.sample(range(300), 3):
            changed[at] = word()
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(changed)
    groups = simhash.near_duplicate_groups(as_receipts(spark, texts), 5, 8, 3, 4, ways=4, beside_bits=16, min_shingles=16)
    got = {r.cell_id: r.component_id for r in groups.collect()}
    assert all(got[2 * i] == 2 * i for i in range(60))
    assert sum(got[2 * i + 1] == 2 * i for i in range(60)) >= 57
    assert all(got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(60))


def test_group_edges(spark):
    keep = ["cell_id", "text", "node", "fingerprint"]
    got = simhash.near_duplicate_groups(edge.receipts(spark), keep=keep)
    assert got.columns == ["cell_id", "text", "node", "fingerprint", "n_shingles", "component_id"]
    rows = got.collect()
    assert len(rows) == len(edge.rows())
    assert {r.component_id for r in rows if r.fingerprint == 0} == {1}  # null, empty and blank texts
    assert simhash.near_duplicate_groups(edge.receipts(spark, empty=True)).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(150)] + [(900, 900 + i) for i in range(90)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def check_order(text, cap, order, shared):
    """All suffixes, by their first `cap` bytes, and what each shares with the one before."""
    raw = bytes(text)
    assert sorted(order) == list(range(len(raw)))
    starts = [raw[i : i + cap] for i in order]
    assert starts == sorted(starts)
    for i in range(1, len(order)):
        common = 0
        while common < min(cap, len(starts[i - 1]), len(starts[i])) and starts[i - 1][common] == starts[i][common]:
            common += 1
        assert shared[i] == common
    assert shared[0] == 0


@pytest.mark.parametrize(("batch", "doubling", "memory"), [(1 << 20, 1 << 23, 1 << 30), (7, 0, 1 << 30), (4, 3, 8)])
def test_induced_order(monkeypatch, tmp_path, batch, doubling, memory):
    """In one batch, and with tiny batches, recursion to the end and queues on disk."""
    monkeypatch.setattr(induced, "BATCH", batch)
    monkeypatch.setattr(induced, "DOUBLING_LIMIT", doubling)
    rng = random.Random(5)
    for trial in range(200):
        letters = rng.choice([1, 2, 3, 5, 200])
        text = np.array([rng.randrange(letters) for _ in range(rng.randrange(1, 100))], np.uint8)
        if trial % 3 == 0:
            text = np.concatenate([text, text, [255], text]).astype(np.uint8)
        cap = rng.choice([5, 40, 1000])
        order, shared = induced.suffix_order(text, cap, induced.Work(str(tmp_path), memory))
        check_order(text, cap, order.tolist(), shared.tolist())


def test_anchors_depend_on_the_window_only():
    rng = np.random.default_rng(2)
    for low in (b"ab", b"abcdefgh"):
        shared = bytes(rng.choice(list(low), 500).tolist())
        for min_bytes in (40, 400):
            gram = repeats.gram_bytes(min_bytes)
            found = []
            for _ in range(2):
                text = bytes(rng.choice(list(b"xyz"), 90).tolist()) + shared + bytes(rng.choice(list(b"xyz"), 33).tolist())
                place, value = repeats.anchors(np.frombuffer(text, np.uint8), min_bytes)
                own = set(zip((place - 90).tolist(), value.tolist(), strict=True))
                for start in range(0, 500 - min_bytes):  # each window of the shared part has an anchor
                    assert any(start <= at <= start + min_bytes - gram for at, _ in own)
                found.append({x for x in own if min_bytes <= x[0] <= 500 - 2 * min_bytes})
            assert found[0] == found[1]


@pytest.mark.parametrize("min_bytes", [400, 60])
def test_repeats_of_documents(spark, documents, min_bytes):
    check_repeats(spark, documents, min_bytes)


def test_repeats_of_periodic_and_crossing_texts(spark):
    rng = random.Random(12)
    part = ["".join(rng.choice("abcé ") for _ in range(70)) for _ in range(6)]
    texts = {i: "".join(rng.choice(part) if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(25)) for _ in range(9)) for i in range(60)}
    texts |= {100: "ab" * 200, 101: "a" * 500, 102: "b" + "a" * 300, 103: part[0][:49], 104: part[0][:50], 105: part[0][:51], 106: None, 107: ""}
    texts |= {200: texts[0], 201: texts[0], 202: texts[100]}
    check_repeats(spark, texts, 50)


def check_repeats(spark, texts, min_bytes):
    got = repeats.remove_repeats(as_receipts(spark, texts), min_bytes).collect()
    want = brute.without_repeats(texts, min_bytes)
    assert {r.cell_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_repeat_edges(spark):
    got = repeats.remove_repeats(edge.receipts(spark), 50, keep=["cell_id", "response_content", "text", "kept"])
    assert got.columns == ["cell_id", "response_content", "text", "n_bytes", "n_removed", "n_spans", "kept"]
    rows = got.collect()
    assert len(rows) == len(edge.rows())
    assert {r.n_removed for r in rows if r.cell_id in (0, 4)} == {len(edge.PLAIN)}
    assert repeats.remove_repeats(edge.receipts(spark, empty=True)).count() == 0
    cut = spark.createDataFrame([("aé".encode()[:2],), (b"ab",), (None,)], "kept binary")
    assert [r[0] for r in cut.select(repeats.whole_letters(F.col("kept"))).collect()] == ["a", "ab", None]


def test_shards_hold_codes_for_anchors(tmp_path):
    """A shard has eight bytes for an anchor's string, and finds the same windows."""
    codes = [repeats.anchor_code(n) for n in range(3000)]
    assert len(set(codes)) == 3000 and {len(c) for c in codes} == {repeats.CODE_BYTES}
    assert not set(b"".join(codes)) & set("".join(map(chr, range(0xD800))).encode())
    rng = random.Random(4)
    gram, reach = repeats.gram_bytes(400), 400 - repeats.gram_bytes(400)
    letters = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    left, right = letters(reach), letters(reach)
    # (anchor's number, how much agrees before and behind it, letters of the rest)
    kinds = [(0, 144, 100, b"cd"), (0, 144, 144, b"cd"), (0, 10, 100, b"ef"), (1, 144, 144, b"cd"), (2, 60, 90, b"cd"), (2, 60, 85, b"ef"), (2, 50, 144, b"gh")]
    flip = lambda raw, to: raw.translate(bytes.maketrans(b"ab", to))
    sides = [(flip(left[: reach - a], to) + left[reach - a :], n, right[:b] + flip(right[b:], to)) for n, a, b, to in kinds]
    parts = [a + codes[n] + b for a, n, b in sides]
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    ids, sizes = np.arange(len(parts)), np.array([len(p) for p in parts])
    many = np.array([False] * 6 + [True])
    got = repeats.shard_repeats(ids, 0 * ids, sizes, many, text, 400, induced.Work(str(tmp_path), 1 << 28))
    strings = [letters(gram) for _ in range(3)]
    whole = [a + strings[n] + b for a, n, b in sides]
    shared = [[s for s in range(reach + 1) if any(w[s : s + 400] in other for j, other in enumerate(whole) if j != i)] for i, w in enumerate(whole)]
    want = [[(s[0], s[-1] + 400)] if s else [] for s in shared]
    assert got == [*want[:6], [(0, 544)]] and want[0] == [(0, 500)] and not want[2] and not want[3] and want[4] == want[5] == [(84, 485)]


def test_spans_of_a_text_are_distinct(spark):
    """Copies and uniform contexts name one span often; it is kept once."""
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    both = letters(120)
    texts = [letters(40) + both + letters(30), letters(5) + both + letters(60)] + [both + "!"] * 5
    rows = spark.createDataFrame([(bytes([n]) if t != both + "!" else b"c", t.encode()) for n, t in enumerate(texts)], "text_id binary, text binary")
    found = {bytes(r.text_id): sorted((s.start, s.end) for s in r.spans) for r in repeats.repeated_spans(rows, 50).collect()}
    assert all(len(s) == len(set(s)) for s in found.values()) and (0, repeats.WHOLE) in found[b"c"]
    assert min(found[b"\0"])[0] == 40 and max(e for _, e in found[b"\0"]) == 160
