"""Encoding, decoding and packing against the tokenizers themselves."""

import base64
import random
import tracemalloc
import unicodedata
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudgauge.llm import bpe, common, packing
from tests.llm import edge

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(own: bpe.Encoder, texts: list[str]) -> list[list[int]]:
    return [np.frombuffer(b, "<i4").tolist() for b in own.encode(texts)]


def test_rank_queue_equals_tiktoken_on_random_texts(reference):
    rng = random.Random(3)
    alphabets = ["ab", "abcdefgh ", "aàéß日本語 \n", "0123456789.,'s ", "́x\U0001d518 \t"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["a" * 5000, "abab" * 3000, "".join(rng.choice("etaoin") for _ in range(50_000)), "<|endoftext|>", ""]
    assert ids_of(bpe.Encoder(RANKS, public_tokenizers.PATTERN), texts) == [reference.encode_ordinary(t) for t in texts]


def test_queue_pops_lowest_rank_with_positions_in_order():
    queue = bpe.RankQueue(200)
    for rank, at in ((300, 9), (5, 4), (300, 2), (50_000, 1)):
        queue.push(rank, at)
    assert [queue.pop() for _ in range(4)] == [(5, [4]), (300, [2, 9]), (50_000, [1]), None]


@pytest.mark.parametrize("at_once", [2, 24])
def test_buckets_merged_at_once_equal_tiktoken_whatever_the_ranks(tmp_path, monkeypatch, at_once):
    """Ranks in any order, so that merges overlap and tokens make lower ranks."""
    monkeypatch.setattr(bpe, "AT_ONCE", at_once)
    rng = random.Random(8)
    for trial in range(30):
        longer = list({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))).encode() for _ in range(60)})
        rng.shuffle(longer)
        ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + longer)}
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
        plain = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(200)] + ["a" * 40, "abc" * 20]
        assert ids_of(bpe.Encoder(str(path), r"\S+"), pieces) == [plain.encode_ordinary(p) for p in pieces]


def test_positions_of_a_bucket_wait_and_merge_together(monkeypatch):
    pushes = []
    monkeypatch.setattr(bpe.RankQueue, "push", lambda self, rank, at, push=bpe.RankQueue.push: (pushes.append(at), push(self, rank, at)))
    rng = random.Random(4)
    pieces = ["".join(rng.choice("etaoinshr") for _ in range(9)).encode() for _ in range(20_000)]
    bpe.merge_pieces(bpe.rank_table(RANKS), pieces)
    assert len(pushes) < 2 * len(pieces)


def test_an_id_without_a_token_is_an_error(spark):
    for wrong in (-1, 10**6):
        with pytest.raises(Exception, match="(?i)out of bounds|no token"):
            bpe.decode_responses(spark.createDataFrame([([wrong],)], "token_ids array<int>"), RANKS).collect()


def test_encode_and_decode_edges(spark, reference):
    encoded = bpe.encode_responses(edge.receipts(spark), RANKS, public_tokenizers.PATTERN)
    got = bpe.decode_responses(encoded, RANKS).select("response_content", "token_ids", "decoded").collect()
    assert len(got) == len(edge.rows())
    for r in got:
        assert r.token_ids == reference.encode_ordinary(r.response_content or "")
        assert bytes(r.decoded) == (r.response_content or "").encode()
    nothing = bpe.encode_responses(edge.receipts(spark, empty=True), RANKS, public_tokenizers.PATTERN)
    assert bpe.decode_responses(nothing, RANKS).count() == 0
    missing = spark.createDataFrame([(None,)], "token_ids array<int>")
    assert bytes(bpe.decode_responses(missing, RANKS).first()["decoded"]) == b""


def tokens(text):
    own = Tokenizer.from_file(WORDS)
    return [*own.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(pieces, texts, window):
    """Every id once, windows full and gapless."""
    by_cell, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_cell[p.cell_id].append((p.piece_start, np.frombuffer(p.ids, "<u4").tolist(), p.answer_tokens, p.continues, p.continued))
        by_window[p.sequence_id].append((p.offset, p.length))
    for own in by_window.values():
        own.sort()
        ends = np.cumsum([length for _, length in own])
        assert [o for o, _ in own] == [0, *ends[:-1]]
    assert sorted(by_window) == list(range(len(by_window)))
    assert all(sum(n for _, n in by_window[w]) == window for w in range(len(by_window) - 1))
    got = defaultdict(list)
    for cell, own in by_cell.items():
        for start, ids, n, continues, continued in own:
            assert continued == (start > 0) and continues == (start + len(ids) < n)
        starts = [s for s, *_ in own]
        for s in sorted(set(starts)):
            got[cell] += [ids for start, ids, *_ in own if start == s][:1]
        got[cell] = sum(got[cell], [])
    assert {c: got[c] for c in texts} == {c: tokens(t) for c, t in texts.items()}


@pytest.mark.parametrize("window", [7, 2048])
def test_packing_edges(spark, window):
    pieces = packing.pack_responses(edge.receipts(spark).filter("cell_id IS NOT NULL").dropDuplicates(["cell_id"]), WORDS, window).collect()
    check_packing(pieces, {c: t for c, t, *_ in edge.rows() if c is not None}, window)


def test_packing_counts_repeated_rows_and_null_ids(spark):
    pieces = packing.pack_responses(edge.receipts(spark), WORDS, 64)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(tokens(t)) for _, t, *_ in edge.rows())
    assert packing.pack_responses(edge.receipts(spark, empty=True), WORDS, 64).count() == 0


def test_chunked_tokens_equal_whole_texts():
    own = packing.ChunkTokenizer(WORDS)
    texts = ["It's... done, isn't it?!  He said: \"yes.\"", "a.b, c., d,. e_. f. \n g.́ h", "x,\ty\r\nz w. ", "3.14, 2.71. '.' , .", "É. ÀÉ, <|endoftext|>. ok", "end.", ". ", ", , . ."]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [tokens(t)[:-1] for t in texts]


def test_every_letter_before_a_stop_or_comma():
    """Letters that become a letter and a mark keep the stop that follows them."""
    own, whole = packing.ChunkTokenizer(WORDS), Tokenizer.from_file(WORDS)
    points = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co", "Lo")]
    points += [chr(i) for i in range(0x1_0000) if unicodedata.category(chr(i)) == "Lo" and (i % 17 == 0 or unicodedata.decomposition(chr(i)))]
    for low in range(0, len(points), 4000):
        texts = [f"a{c}. x {c}, y {c}.z e\u0301{c}. {c}" for c in points[low : low + 4000]]
        want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        got = [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)]
        assert got == want, [t for t, a, b in zip(texts, got, want, strict=True) if a != b][:5]


def test_lowered_words_share_their_ids():
    """A chunk is learned once whatever its case, and only where lowering leaves ids alone."""
    own = packing.ChunkTokenizer(WORDS)
    assert own.lowers and own.takes_words
    marks = "\u0300\u0301\u0307\u030a\u0327\u0331"
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    texts = ["The the THE. tHe, Élan ÉLAN élan", "", " ", "\n \n", "ß ẞ SS", "Σας ΣΑΣ", "İI iı \u212a", "a\u00a0B\u0085C", "x¬Y ¬ ¬"]
    texts += [f"{c}{m} {c}THE{m}. {c}{m}, x" for c in letters for m in marks] + [f"{c}A{c}, {c}{c}. A{c}" for c in letters]
    rng = random.Random(5)
    alphabet = "abAB.,'19 \n-ÉéßÿÀ×÷ªµ"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(500)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [tokens(t)[:-1] for t in texts[:9]] + [
        e.ids for e in Tokenizer.from_file(WORDS).encode_batch_fast(texts[9:], add_special_tokens=False)
    ]
    fresh = packing.ChunkTokenizer(WORDS)
    list(fresh.encode(["The the THE. tHe, Élan ÉLAN élan"]))
    assert len(fresh.known.entries) == 4  # the, élan, a stop, a comma


def test_runs_end_with_their_texts(monkeypatch):
    own = packing.ChunkTokenizer(WORDS)
    texts = ["one two. three", "", "four, five", "six " * 50, ""]
    whole = list(own.encode(texts))
    monkeypatch.setattr(packing, "RUN_CHARS", 5)
    assert list(packing.ChunkTokenizer(WORDS).encode(texts)) == whole
    end = b"\x01\0\0\0"
    assert own.blobs(texts, end).to_pylist() == [ids + end for ids in whole]


def test_a_worker_holds_little_besides_its_texts():
    own = packing.ChunkTokenizer(WORDS)
    texts = ["the quick brown fox, it jumps over 7 lazy dogs.\n" * 100] * 1_250
    list(own.encode(texts[:1]))
    tracemalloc.start()
    for _ in own.encode(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.known.most <= 300_000 and peak < 50e6


def test_special_strings_are_special_tokens():
    texts = ["<|endoftext|>", "a<|endoftext|>. b", "x <|startoftext|>, <|ENDOFTEXT|>. y", "<|endoftext|><|endoftext|> z", "<|endoftext|"]
    own = packing.ChunkTokenizer(WORDS)
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [tokens(t)[:-1] for t in texts]
    assert tokens(texts[0]) == [49407, 1]


def test_store_stays_within_its_bounds():
    store = common.Store(most=100, rest=40)
    for run in range(30):
        asked = {f"often{i}" for i in range(20)} | {f"{run}-{i}" for i in range(30)}
        store.entries.update((k, b"") for k in asked)
        store.asked_for(asked)
        assert len(store.entries) <= 100
    store.shrink()
    assert len(store.entries) == 40 and all(f"often{i}" in store.entries for i in range(20))
