"""Byte-level BPE with a rank queue: encoding answers to token ids and back.

Pre-tokens are merged lowest rank first. Positions of adjacent pairs wait in one bucket
per merge rank; which buckets hold anything is kept in a bitmap of two levels, so the next
rank is two find-first-set steps away however long the pre-token is. Entries are not
removed when a neighbour merges first: a popped position whose pair no longer has the
bucket's rank is stale and skipped. Many pre-tokens share a queue, so a bucket may hold
very many positions; these are merged at once.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloudgauge.llm.common import RESPONSE, Store, chunks, hand_back_memory, slices, strings, text_or_empty

WORD_BITS = 256  # ranks under one word of the lower bitmap
PAIR_SHIFT = 20
MERGE_BYTES = 1 << 19  # bytes of new pre-tokens that share one queue
RUN_CHARS = 1 << 22  # texts whose pre-tokens are told apart and looked up together
AT_ONCE = 24  # positions of a bucket from which on they are merged at once


class Partners:
    """The tokens that merge with each token on one side of it, and the ranks made."""

    def __init__(self, own: np.ndarray, other: np.ndarray, made: np.ndarray, tokens: int):
        order = np.argsort(own, kind="stable")
        self.other, self.made = other[order], made[order]
        self.ends = np.searchsorted(own[order], np.arange(tokens + 1)).tolist()
        self.found = np.full(tokens, -1, np.int32)
        # partners that make a lower rank, which has to go before the rest of the bucket
        self.urgent: dict[int, list[int]] = {}
        for token, partner in zip(own[made < own].tolist(), other[made < own].tolist(), strict=True):
            self.urgent.setdefault(token, []).append(partner)

    def ranks(self, own: int, others: np.ndarray) -> np.ndarray | None:
        """The rank made with each of the others, or -1; None if nothing merges here."""
        low, high = self.ends[own], self.ends[own + 1]
        if low == high:
            return None
        known = self.other[low:high]
        self.found[known] = self.made[low:high]
        made = self.found[others]
        self.found[known] = -1
        return made


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes with their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankTable:
    """Token bytes by rank, and the rank that each adjacent pair of tokens merges to."""

    def __init__(self, path: str):
        self.rank_of = rank_of = read_ranks(path)
        self.byte = np.array([rank_of[bytes([b])] for b in range(256)], np.int32)
        self.pair: dict[int, int] = {}
        for token, rank in rank_of.items():
            for cut in range(1, len(token)):
                left, right = rank_of.get(token[:cut]), rank_of.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left << PAIR_SHIFT | right] = rank
        most = max(rank_of.values())
        self.words = most // WORD_BITS + 1
        self.edge = most + 1  # stands before and behind each pre-token, and merges with nothing
        keys = np.fromiter(self.pair.keys(), np.int64, len(self.pair))
        made = np.fromiter(self.pair.values(), np.int32, len(self.pair))
        left, right = (keys >> PAIR_SHIFT).astype(np.int32), (keys & ((1 << PAIR_SHIFT) - 1)).astype(np.int32)
        self.behind = Partners(left, right, made, most + 2)
        self.ahead = Partners(right, left, made, most + 2)
        self.byte_pair = np.array([[self.pair.get(a << PAIR_SHIFT | b, -1) for b in self.byte.tolist()] for a in self.byte.tolist()], np.int32)


@lru_cache(maxsize=4)
def rank_table(path: str) -> RankTable:
    return RankTable(path)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """The bytes of each id; null where there is no token."""
    token = {rank: raw for raw, rank in read_ranks(path).items()}
    return pa.array([token.get(i) for i in range(max(token) + 1)], pa.large_binary())


class RankQueue:
    """Positions by merge rank under a two-level bitmap."""

    def __init__(self, words: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * words
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank // WORD_BITS
            self.low[word] |= 1 << rank % WORD_BITS
            self.top |= 1 << word
        else:
            bucket.append(position)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order].tolist()
        first = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        for rank, low, high in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ranks)], strict=True):
            self.push(rank, positions[low])
            if high - low > 1:
                self.buckets[rank] += positions[low + 1 : high]

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank that waits, with its positions from left to right."""
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        lowest = bits & -bits
        self.low[word] = bits ^ lowest
        if bits == lowest:
            self.top ^= 1 << word
        rank = word * WORD_BITS + lowest.bit_length() - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


def merge_pieces(table: RankTable, pieces: list[bytes]) -> list[bytes]:
    """Token ids of each pre-token, four little-endian bytes each. All of them share one
    queue: merges of different pre-tokens never touch, so taking them by rank together
    changes nothing."""
    edges = np.cumsum([0, *(len(piece) + 1 for piece in pieces)])
    raw = np.frombuffer(b"\0".join([b"", *pieces, b""]), np.uint8)
    n = len(raw)
    # scalars are read from arrays, many values at once through numpy views of them
    tokens, want = table.byte[raw], np.full(n, -1, np.int32)
    want[:-1] = table.byte_pair[raw[:-1], raw[1:]]  # the rank that a token and the next one merge to
    tokens[edges] = table.edge
    want[edges] = want[edges[1:] - 1] = -1
    token, rank_at = array("i", tokens.tobytes()), array("i", want.tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    views = tuple(np.frombuffer(x, x.typecode) for x in (token, rank_at, after, before))
    queue = RankQueue(table.words)
    waiting = np.flatnonzero(want >= 0)
    queue.push_all(want[waiting], waiting)
    pair, push = table.pair, queue.push
    while (lowest := queue.pop()) is not None:
        rank, positions = lowest
        if len(positions) >= AT_ONCE and merge_at_once(table, queue, rank, positions, *views):
            continue
        for done, at in enumerate(positions, 1):
            if rank_at[at] != rank:
                continue  # stale: a neighbour merged first
            right = after[at]
            beyond, left = after[right], before[at]
            token[at], token[right], rank_at[right] = rank, -1, -1
            after[at], before[beyond] = beyond, at
            behind = pair.get(rank << PAIR_SHIFT | token[beyond], -1)
            ahead = pair.get(token[left] << PAIR_SHIFT | rank, -1)
            rank_at[at], rank_at[left] = behind, ahead
            if behind >= 0:
                push(behind, at)
            if ahead >= 0:
                push(ahead, left)
            if 0 <= behind < rank or 0 <= ahead < rank:
                for rest in positions[done:]:  # a lower rank appeared: it goes before what is left of this bucket
                    push(rank, rest)
                break
    tokens = views[0]
    live = tokens >= 0
    live[edges] = False
    ids = tokens[live].astype("<i4").tobytes()
    ends = (4 * np.concatenate([[0], np.cumsum(live)])[edges]).tolist()
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def merge_at_once(
    table: RankTable,
    queue: RankQueue,
    rank: int,
    positions: list[int],
    token: np.ndarray,
    rank_at: np.ndarray,
    after: np.ndarray,
    before: np.ndarray,
) -> bool:
    """Merge all positions of a bucket. Nothing is done (False) if some of them overlap, as
    these have to go from left to right, or if a lower rank would appear on the way."""
    at = np.array(positions, np.int64)
    at = at[rank_at[at] == rank]  # the others are stale
    right = after[at]
    if (right[:-1] == at[1:]).any():
        return False
    beyond = after[right]
    for partners, near in ((table.behind, beyond), (table.ahead, before[at])):
        if lower := partners.urgent.get(rank):
            beside = token[near]
            if rank in lower or any((beside == x).any() for x in lower):
                return False
    token[at], token[right], rank_at[right] = rank, -1, -1
    after[at], before[beyond] = beyond, at
    left = before[at]
    made = []
    for partners, near, own in ((table.behind, beyond, at), (table.ahead, left, left)):
        ranks = partners.ranks(rank, token[near])
        rank_at[own] = -1 if ranks is None else ranks
        if ranks is not None:
            new = ranks >= 0
            if own is left:
                new[1:] &= left[1:] != at[:-1]  # merged here too: its pair is the one behind it
            made.append((ranks[new], own[new]))
    if made:
        queue.push_all(*made[0] if len(made) == 1 else map(np.concatenate, zip(*made, strict=True)))
    return True


class Encoder:
    """Encodes texts; ids of pre-tokens seen before are kept, up to a bounded number."""

    def __init__(self, path: str, pattern: str):
        self.table = rank_table(path)
        self.split = regex.compile(pattern).findall
        self.known = Store(most=300_000, rest=120_000)

    def learn(self, pieces: list[str]) -> None:
        known = self.known.entries
        batch: list[tuple[str, bytes]] = []
        size = 0

        def flush() -> None:
            known.update(zip([p for p, _ in batch], merge_pieces(self.table, [raw for _, raw in batch]), strict=True))
            batch.clear()

        for piece in pieces:
            raw = piece.encode()
            whole = self.table.rank_of.get(raw)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
                continue
            batch.append((piece, raw))
            size += len(raw)
            if size >= MERGE_BYTES:
                flush()
                size = 0
        flush()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, four little-endian bytes each."""
        for ends, ids in self.encode_runs(texts):
            raw = memoryview(ids)
            for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield raw[low:high].tobytes()

    def encode_runs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, pa.Buffer]]:
        """Ids of consecutive texts one after another, and the bytes at which they end.

        A run keeps a number for each pre-token; the strings only once.
        """
        known = self.known
        for run in chunks(texts, RUN_CHARS):
            numbers: dict[str, int] = defaultdict(count().__next__)
            places, counts = array("I"), [0]
            for text in run:
                places.extend(map(numbers.__getitem__, self.split(text)))
                counts.append(len(places))
            asked = [*numbers]
            del numbers
            self.learn([p for p in asked if p not in known.entries])
            ids = pa.array([*map(known.entries.__getitem__, asked)], pa.large_binary())
            starts, found = binary_parts(ids.take(pa.array(np.frombuffer(places, np.uint32))))
            yield starts[counts], found
            known.asked_for(asked)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def binary_parts(values: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """(offsets, bytes) of a large binary array without nulls that is no slice."""
    _, offsets, raw = values.buffers()
    ends = np.frombuffer(offsets, np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)
    return ends, raw if raw is not None else pa.py_buffer(b"")


def encode_responses(
    receipts: DataFrame, ranks_path: str, pattern: str, response_content: str = RESPONSE, token_ids: str = "token_ids"
) -> DataFrame:
    """The receipts with one more column, the token ids of each answer (array<int>).

    `ranks_path` is a rank file (base64 token and rank on a line) at the same place on
    every worker, `pattern` the expression whose matches are encoded one by one. Special
    tokens do not exist: their strings are ordinary text. A null or empty answer has no
    ids; a column that is called like `token_ids` is replaced. Other columns, repeated
    rows and an empty table pass through.
    """

    @arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(ranks_path, pattern)
        for column in batches:
            for part in slices(column):
                for ends, ids in own.encode_runs(strings(part)):
                    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]) // 4, [None, ids])
                    yield pa.ListArray.from_arrays(pa.array(ends // 4, pa.int32()), flat)
        own.known.shrink()
        hand_back_memory()

    return receipts.withColumn(token_ids, encoded(text_or_empty(response_content)))


def decode_responses(
    encoded: DataFrame, ranks_path: str, token_ids: str = "token_ids", decoded: str = "decoded"
) -> DataFrame:
    """The rows with one more column, the bytes that the ids stand for (binary).

    Null ids give empty bytes, an id without a token is an error.
    """

    @arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = token_bytes(ranks_path)
        for column in batches:
            for part in slices(column):
                texts = token.take(part.flatten())
                if texts.null_count:
                    raise ValueError("an id has no token")
                ends, raw = binary_parts(texts)
                starts = ends[np.cumsum([0, *part.value_lengths().fill_null(0).to_pylist()])]
                yield pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(starts.astype(np.int32)), raw])

    return encoded.withColumn(decoded, bytes_of(F.col(token_ids)))
