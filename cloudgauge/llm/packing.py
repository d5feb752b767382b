"""Concatenate and cut: answers as token windows of one length.

Tokens are laid end to end and cut every `window` tokens. Where an answer lies is a sum
over everything before it, found in two passes: each task adds up its own answers and
notes where they start within its partition, then the partition totals (one small row
each) are summed up and give every partition its place.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.llm.common import CELL_ID, RESPONSE, Store, chunks, hand_back_memory, key_type, slices, text_or_empty, written

ENCODE_AT_ONCE = 2_000  # what the tokenizer returns for a chunk is large while it lives
RUN_CHARS = 1 << 20  # texts cut and looked up together; what is made of a run is many times its size
OTHER, BLANK, MARK, WORD = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[32, 10]] = BLANK
KINDS[[*b".,"]] = MARK
KINDS[[c for c in range(128) if chr(c).isalnum()]] = WORD
LOWER_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> str:
    """The letter that byte-level models write for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


class ChunkTokenizer:
    """Ids of texts by a tokenizer that never joins across white space, nor letters or
    digits with marks.

    A text is cut at spaces and line feeds, and before a stop or comma that ends a word;
    the tokenizer sees each distinct chunk once, as long as the bounded store of chunks
    holds it. A word ends so only after an ASCII letter or digit: other characters may
    become a letter and a mark when the tokenizer composes and lowers them, and marks stay
    together. Strings of special tokens get what the tokenizer gives them.

    Texts are cut as bytes, many at once, and their chunks are told apart by Arrow, so that
    Python meets each distinct chunk of a run once. If the tokenizer lowers letters, texts
    of Latin-1 are lowered before, as no two of its letters compose. Chunks of its lower
    letters are words that go to the tokenizer's model as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a rare mark that is one token, to tell the chunks of a text apart
        marks = ((m, self.ids_of(m)) for m in "¬§¶†‡¤«»~")
        self.mark, self.mark_id = next(((m, ids[0]) for m, ids in marks if len(ids) == 1), (None, None))
        self.known = Store(most=300_000, rest=80_000)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.lowers = all(self.ids_of(f"{c}x{c}") == self.ids_of(f"{c}x{c}".lower()) for c in letters)
        self.letters = byte_letters()
        words = [f"{c}the{c}re{c}" for c in letters if LOWER_WORD.fullmatch(c)]
        whole = [np.array(self.ids_of(w), "<u4").tobytes() for w in words]
        self.takes_words = [*self.word_ids([w.encode() for w in words])] == whole

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word_ids(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of each word by the model alone, which takes the letters of bytes."""
        tokenize = self.tokenizer.model.tokenize
        for word in words:
            letters = word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters)
            yield array("I", [token.id for token in tokenize(letters)]).tobytes()

    def folded(self, text: str) -> bytes:
        """UTF-8 of a text, lowered where that leaves its ids alone."""
        if not self.lowers or any(s[:2] in text for s in self.special):
            return text.encode()
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return text.encode()
        return text.lower().encode()

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts one after another, number of chunks of each text)."""
        raw = [self.folded(text) for text in texts]
        code = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
        kind = KINDS[code]
        full = kind != BLANK
        edge = np.ones(len(code), bool)  # between each byte and the one before it
        edge[1:] = ~(full[1:] & full[:-1])
        edge[1:-1] |= (kind[1:-1] == MARK) & (kind[:-2] == WORD) & ~full[2:]
        starts = np.flatnonzero(full & edge)
        place = np.cumsum(full) - full  # of each byte once the blanks are left out
        offsets = np.append(place[starts], place[-1] + full[-1]).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(code[full])])
        ends = np.cumsum([len(r) + 1 for r in raw])
        return parts, np.diff(np.searchsorted(starts, ends), prepend=0)

    def learn(self, new: list[bytes]) -> None:
        """Words go to the model. Other chunks go to the tokenizer, many as one text with a
        mark after each. Should a chunk hold the mark itself, there are too many of them,
        and these chunks are encoded one by one."""
        texts = [c.decode() for c in new]
        plain = [self.takes_words and LOWER_WORD.fullmatch(t) is not None for t in texts]
        words, rest = [*compress(new, plain)], [t for t, p in zip(texts, plain, strict=True) if not p]
        self.known.entries.update(zip(words, self.word_ids(words), strict=True))
        for low in range(0, len(rest), ENCODE_AT_ONCE):
            part = rest[low : low + ENCODE_AT_ONCE]
            ends = []
            if self.mark is not None:
                joined = f" {self.mark} ".join([*part, ""])
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                ends = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            if len(ends) == len(part):
                raw, starts = ids.tobytes(), [0, *[e + 4 for e in ends]]
                self.known.entries.update((c.encode(), raw[i:j]) for c, i, j in zip(part, starts, ends, strict=False))
            else:
                each = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
                self.known.entries.update((c.encode(), np.array(e.ids, "<u4").tobytes()) for c, e in zip(part, each, strict=True))

    def blobs(self, texts: list[str], end: bytes = b"") -> pa.Array:
        """Ids of each text of a run and then `end`, four little-endian bytes each."""
        parts, counts = self.cut(texts)
        coded = parts.dictionary_encode()
        asked = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([c for c in asked if c not in self.known.entries])
        ids = pa.array([*map(self.known.entries.__getitem__, asked), end], pa.binary())
        index = np.insert(coded.indices.to_numpy(), np.cumsum(counts), len(asked))
        self.known.asked_for(asked)
        laid = ids.take(pa.array(index))
        _, offsets, data = laid.buffers()
        last = np.append(0, np.cumsum(counts + 1))
        bounds = np.frombuffer(offsets, np.int32)[: len(index) + 1][last]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), data])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, four little-endian bytes each."""
        for run in chunks(texts, RUN_CHARS):
            yield from self.blobs(run).to_pylist()


@lru_cache(maxsize=4)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def tokenize_in_place(
    receipts: DataFrame, tokenizer_path: str, end_id: int, cell_id: str = CELL_ID, response_content: str = RESPONSE
) -> DataFrame:
    """First pass: (cell_id, part, part_start, n_tokens, ids) with `part_start` the tokens
    of the same partition before this answer; ids are little-endian 32-bit numbers."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = chunk_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            low = 0
            texts = (text for part in slices(batch.column(1), 256) for text in part.to_pylist())
            for run in chunks(texts, RUN_CHARS):
                blobs = own.blobs(run, end)
                sizes = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[: len(run) + 1]).astype(np.int64) // 4
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(run)),
                        pa.array([part] * len(run), pa.int32()),
                        pa.array(starts),
                        pa.array(sizes),
                        blobs,
                    ],
                    names=["cell_id", "part", "part_start", "n_tokens", "ids"],
                )
                low += len(run)
        own.known.shrink()
        hand_back_memory()

    slim = receipts.select(F.col(cell_id).alias("cell_id"), text_or_empty(response_content).alias("text"))
    return slim.mapInArrow(run, f"cell_id {key_type(slim, 'cell_id')}, part int, part_start long, n_tokens long, ids binary")


def pack_responses(
    receipts: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    end_id: int = 1,
    cell_id: str = CELL_ID,
    response_content: str = RESPONSE,
) -> DataFrame:
    """Pieces of answers in windows of `window` tokens, one row per piece.

    Every answer gets its ids and then `end_id`, so a null or empty answer is one token.
    Columns: cell_id, piece_start (tokens of the answer before the piece), length, ids
    (binary, little-endian 32-bit), answer_tokens, sequence_id, offset (place in the
    window), continues (the answer goes on in the next window) and continued (it began in
    an earlier one): the boundary records. All windows but the last are full. Repeated
    rows are separate answers; other columns are not read.
    """
    tokens = written(tokenize_in_place(receipts, tokenizer_path, end_id, cell_id, response_content), "packing-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task of the first pass: bounded by what one Spark stage can hold
    places = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_at"))
    first, last = F.col("answer_at"), F.col("answer_at") + F.col("n_tokens") - 1
    placed = tokens.join(F.broadcast(places), "part").withColumn("answer_at", F.col("part_at") + F.col("part_start"))
    pieces = placed.withColumn(
        "sequence_id", F.explode(F.sequence(F.floor(first / window), F.floor(last / window)))
    )
    start = F.greatest(F.col("sequence_id") * window - first, F.lit(0))
    end = F.least((F.col("sequence_id") + 1) * window - first, F.col("n_tokens"))
    cut = pieces.withColumn("piece_start", start).withColumn("length", end - start)
    return cut.select(
        "cell_id",
        "piece_start",
        "length",
        F.expr("substring(ids, cast(4 * piece_start + 1 as int), cast(4 * length as int))").alias("ids"),
        F.col("n_tokens").alias("answer_tokens"),
        "sequence_id",
        (first + F.col("piece_start") - F.col("sequence_id") * window).alias("offset"),
        (F.col("piece_start") + F.col("length") < F.col("n_tokens")).alias("continues"),
        (F.col("piece_start") > 0).alias("continued"),
    )
