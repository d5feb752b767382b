"""Passages that occur twice or more, found by sorting suffixes, and their removal.

Where one string of `min_bytes` bytes occurs twice, both places have the same anchor: the
substring of `gram` bytes with the least hash in that window. So only anchors that are
found twice can lie in a repeated window, and all windows with an anchor lie in its
context, the `2 * min_bytes - gram` bytes around it. If all contexts of an anchor are
equal, they are repeated as they are. Otherwise one of each kind goes, with all others of
its anchor, to a shard whose suffixes are put in order (`induced`); neighbours with a
common prefix of `min_bytes` from different places are the repeated windows. A window of a
context holds all of its anchor, so a shard has a short code in the place of that string.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloudgauge.llm.common import CELL_ID, RESPONSE, discard, hand_back_memory, release_shuffles, slices, text_or_empty, written
from cloudgauge.llm.induced import SEPARATOR, Work, suffix_order

PLACE_BITS = 25
PIECE = 1 << 24  # bytes of a text hashed at once
SHARD_BYTES = 6 << 20
MOST_SHARDS = 20_000  # beyond, shards grow and their arrays become files
SHARD_MEMORY = 256 << 20  # larger arrays of a shard are files
WHOLE = 2**31 - 1
CODE_BYTES = 8  # of an anchor's string within a shard
CODE_DIGITS = bytes([0xC0, 0xC1, *range(0xF5, 0xFF)])  # no bytes of UTF-8


def gram_bytes(min_bytes: int) -> int:
    """A power of two, at most about two thirds of the window."""
    return 1 << max(0, int(min_bytes * 0.65).bit_length() - 1)


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes (a power of two) from each place."""
    value, size, power = text.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < gram:
        value = value[:-size] * np.uint64(power) + value[size:]
        power = power * power % (1 << 64)
        size *= 2
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


def window_minima(value: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, from running minima of blocks."""
    n = len(value)
    blocks = np.concatenate([value, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(text: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows of a text."""
    gram = gram_bytes(min_bytes)
    places, hashes = [], []
    for low in range(0, max(0, len(text) - min_bytes + 1), PIECE):
        value = gram_hashes(text[low : low + PIECE + min_bytes - 1], gram)
        # of equal hashes the leftmost: the place follows the upper bits
        by = (value >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(value), dtype=np.uint64)
        least = window_minima(by, min_bytes - gram + 1)
        at = np.unique((least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64))
        places.append(at + low)
        hashes.append(value[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, index = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[index]


def anchor_rows(texts: DataFrame, min_bytes: int) -> DataFrame:
    """(text_id, anchor, context, place, size): each anchor with the hash of its context,
    its place and the length of its text."""
    reach = min_bytes - gram_bytes(min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns, size = [], [], 0
            for text_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                raw = raw.as_py()
                place, anchor = anchors(np.frombuffer(raw, np.uint8), min_bytes)
                low, high = np.maximum(place - reach, 0), np.minimum(place + min_bytes, len(raw))
                digest = xxhash.xxh3_64_intdigest
                context = np.array([digest(raw[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.uint64)
                ids.append((text_id.as_py(), len(place)))
                columns.append((anchor.view(np.int64), context.view(np.int64), place.astype(np.int32), np.full(len(place), len(raw), np.int32)))
                size += len(place)
                if size > 1 << 16:
                    yield record(ids, columns)
                    ids, columns, size = [], [], 0
            if size:
                yield record(ids, columns)
        hand_back_memory()

    def record(ids: list, columns: list) -> pa.RecordBatch:
        repeated = pa.array([i for i, _ in ids], pa.binary()).take(pa.array(np.repeat(np.arange(len(ids)), [n for _, n in ids])))
        rest = [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([repeated, *rest], names=["text_id", "anchor", "context", "place", "size"])

    schema = "text_id binary, anchor long, context long, place int, size int"
    return texts.select("text_id", "text").mapInArrow(run, schema)


def anchor_code(number: int) -> bytes:
    """A number of an anchor's string in bytes that no text has."""
    digits = bytearray(CODE_BYTES)
    for i in range(CODE_BYTES):
        number, digit = divmod(number, len(CODE_DIGITS))
        digits[i] = CODE_DIGITS[digit]
    return bytes(digits)


def shard_repeats(
    ids: np.ndarray, lows: np.ndarray, sizes: np.ndarray, many: np.ndarray, text: np.ndarray, min_bytes: int, work: Work
) -> list[list[tuple[int, int]]]:
    """For each context of a shard the spans covered by repeated windows, relative to it.

    The contexts lie in `text` one after another, a separator after each, with codes for
    the strings of their anchors. `ids` number their texts, `lows` are their places there,
    `many` marks those that occur twice.
    """
    shorter = gram_bytes(min_bytes) - CODE_BYTES
    coded_bytes = min_bytes - shorter  # a window begins at or before the code and ends behind it
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    order, shared = suffix_order(text, coded_bytes, work)
    repeated = work.array(len(text), np.bool_)
    n, low, block = len(order), 0, 1 << 20
    while low < n:
        high = min(n, low + block)
        while high < n and shared[high] >= coded_bytes:  # not within a run
            high += 1
        joined = np.asarray(shared[low:high] >= coded_bytes)
        joined[:1] = False
        member = joined | np.append(joined[1:], False)
        rows = np.flatnonzero(member)
        if len(rows):
            run = np.cumsum(~joined)[rows]
            at = np.asarray(order[low:high])[rows].astype(np.int64)
            context = np.searchsorted(starts, at, "right") - 1
            offset = at - starts[context]
            fits = offset + coded_bytes <= sizes[context]
            run, at, context, offset = run[fits], at[fits], context[fits], offset[fits]
            if len(run):
                place = (ids[context] << 40) | (lows[context] + offset)
                first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                twice = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
                twice |= np.maximum.reduceat(many[context].astype(np.int8), first) > 0
                counts = np.diff(np.append(first, len(run)))
                repeated[at[np.repeat(twice, counts)]] = True
        low = high
    # all repeated windows of a context hold its anchor, so they are one span
    out = [[(0, size + shorter)] if often else [] for size, often in zip(sizes.tolist(), many.tolist(), strict=True)]
    hits = np.flatnonzero(repeated)
    context = np.searchsorted(starts, hits, "right") - 1
    first = np.flatnonzero(np.diff(context, prepend=-1))
    own = context[first]
    begin, end = hits[first] - starts[own], hits[np.append(first[1:], len(hits))[: len(first)] - 1] - starts[own] + min_bytes
    for c, low, high in zip(own.tolist(), begin.tolist(), end.tolist(), strict=True):
        out[c] = out[c] or [(low, high)]
    return out


def sort_shards(contexts: DataFrame, min_bytes: int, shards: int) -> DataFrame:
    """(anchor, context, spans) of contexts (anchor, context, text_id, low, many, at, bytes);
    `at` is the anchor's place in the context, and all contexts of an anchor share a shard."""
    gram = gram_bytes(min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
            path = os.path.join(folder, "text")
            seen: dict[tuple, None] = {}
            numbers: dict[bytes, int] = {}
            codes: dict[bytes, bytes] = {}
            ids, lows, sizes, many = [], [], [], []
            with open(path, "wb") as out:
                for batch in batches:
                    for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        anchor, context, text_id, low, often, at, raw = row
                        if (anchor, context) in seen:  # copies of the text it was taken from
                            continue
                        seen[anchor, context] = None
                        ids.append(numbers.setdefault(text_id, len(numbers)))
                        lows.append(low)
                        many.append(often)
                        own = raw[at : at + gram]
                        code = codes.get(own) or codes.setdefault(own, anchor_code(len(codes)))
                        coded = raw[:at] + code + raw[at + gram :]
                        sizes.append(len(coded))
                        out.write(coded + bytes([SEPARATOR]))
            del codes
            if not seen:
                return
            large = os.path.getsize(path) > SHARD_MEMORY
            text = np.memmap(path, np.uint8, "r") if large else np.fromfile(path, np.uint8)
            columns = [np.array(x, np.int64) for x in (ids, lows, sizes)]
            spans = shard_repeats(*columns, np.array(many, bool), text, min_bytes, Work(folder, SHARD_MEMORY))
            keys, kind = list(seen), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            for low in range(0, len(keys), 1 << 15):
                part = slice(low, low + (1 << 15))
                found = [[{"low": a, "high": b} for a, b in s] for s in spans[part]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in keys[part]], pa.int64()) for i in (0, 1)] + [pa.array(found, kind)],
                    names=["anchor", "context", "spans"],
                )
        del text, columns, spans, keys, seen
        hand_back_memory()

    schema = "anchor long, context long, spans array<struct<low:int,high:int>>"
    return contexts.repartition(shards, "anchor").mapInArrow(run, schema)


def take_contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts. A text that a task meets again (a copy) is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            for text_id, text, parts in zip(*batch.columns, strict=True):
                own = text_id.as_py()
                if own in met:
                    continue
                met.add(own)
                raw, parts = text.as_py(), parts.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p["anchor"] for p in parts], pa.int64()),
                        pa.array([p["context"] for p in parts], pa.int64()),
                        pa.array([own] * len(parts), pa.binary()),
                        pa.array([p["low"] for p in parts], pa.int32()),
                        pa.array([p["many"] for p in parts], pa.bool_()),
                        pa.array([p["at"] for p in parts], pa.int32()),
                        pa.array([raw[p["low"] : p["high"]] for p in parts], pa.binary()),
                    ],
                    names=["anchor", "context", "text_id", "low", "many", "at", "bytes"],
                )
        hand_back_memory()

    listed = wanted.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "context", "low", "high", "many", "at")).alias("parts"))
    schema = "anchor long, context long, text_id binary, low int, many boolean, at int, bytes binary"
    return texts.select("text_id", "text").join(listed, "text_id").mapInArrow(run, schema)


def repeated_anchors(texts: DataFrame, min_bytes: int) -> DataFrame:
    """(text_id, anchor, context, low, high, at, uniform) of anchors found twice or more:
    the bounds of the context, the anchor's place in it, and whether all contexts of the
    anchor are equal."""
    rows = written(anchor_rows(texts, min_bytes), "anchors")
    stats = rows.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("context").alias("first"), F.max("context").alias("last")
    )
    twice = stats.filter("n > 1").select("anchor", F.expr("first = last").alias("uniform"))
    low = F.greatest(F.col("place") - (min_bytes - gram_bytes(min_bytes)), F.lit(0))
    high = F.least(F.col("place") + min_bytes, F.col("size"))
    met = rows.filter(high - low >= min_bytes).join(twice, "anchor")
    out = written(
        met.select("text_id", "anchor", "context", low.alias("low"), high.alias("high"), (F.col("place") - low).alias("at"), "uniform"),
        "repeated-anchors",
    )
    discard(rows)
    return out


def repeated_spans(texts: DataFrame, min_bytes: int) -> DataFrame:
    """(text_id, spans) of all texts with repeated windows; spans overlap and may be longer
    than the text. `texts` has text_id (digest of the text) and text (binary)."""
    spark = texts.sparkSession
    found = repeated_anchors(texts, min_bytes)
    release_shuffles(spark)
    mixed = found.filter("NOT uniform")
    kinds = written(
        mixed.groupBy("anchor", "context")
        .agg(F.min(F.struct("text_id", "low", "high", "at")).alias("one"), (F.count("*") > 1).alias("many"))
        .select("anchor", "context", "one.*", "many"),
        "context-kinds",
    )
    coded = F.col("high") - F.col("low") + 1 + CODE_BYTES - gram_bytes(min_bytes)
    size = kinds.agg(F.coalesce(F.sum(coded), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-size // SHARD_BYTES)))
    judged = written(sort_shards(take_contexts(texts, kinds), min_bytes, shards), "sorted-contexts")
    release_shuffles(spark)
    # a text may hold one context in very many places, so it is met once and not once a place
    places = mixed.groupBy("text_id", "anchor", "context").agg(F.collect_list("low").alias("lows"))
    # spans are one number each until they are distinct: Spark compares structs pair by pair
    packed = lambda start, end: F.shiftleft(start.cast("long"), 32).bitwiseOR(end.cast("long"))
    shifted = lambda low: F.transform("spans", lambda s: packed(low + s["low"], low + s["high"]))
    from_mixed = places.join(judged.filter(F.size("spans") > 0), ["anchor", "context"]).select(
        "text_id", F.flatten(F.transform("lows", shifted)).alias("spans")
    )
    from_uniform = found.filter("uniform").select("text_id", F.array(packed(F.col("low"), F.col("high"))).alias("spans"))
    copied = texts.groupBy("text_id").agg(F.count("*").alias("n")).filter("n > 1")
    whole = copied.select("text_id", F.array(packed(F.lit(0), F.lit(WHOLE))).alias("spans"))
    spans = from_mixed.union(from_uniform).union(whole)
    distinct = spans.groupBy("text_id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("packed"))
    span = lambda p: F.struct(F.shiftright(p, 32).cast("int").alias("start"), p.bitwiseAND(F.lit(WHOLE)).cast("int").alias("end"))
    out = written(distinct.select("text_id", F.transform("packed", span).alias("spans")), "repeated-spans")
    release_shuffles(spark)
    return out


def short_passages(texts: DataFrame, words: int, below: int) -> DataFrame:
    """(text_id, spans) of the passages of `words` words in fewer than `below` bytes that
    occur twice or more, from the first letter of the first word to the last of the last.
    Equal bytes are told by 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                raw = raw.as_py()
                code = np.frombuffer(raw, np.uint8)
                blank = np.concatenate([[True], (code == 32) | ((code >= 9) & (code <= 13)), [True]])
                edges = np.flatnonzero(blank[1:] != blank[:-1])
                start, end = edges[0::2][: max(0, len(edges) // 2 - words + 1)], edges[1::2][words - 1 :]
                fits = end - start < below
                start, end = start[fits], end[fits]
                for low in range(0, len(start), 1 << 16):
                    a, b = start[low : low + (1 << 16)], end[low : low + (1 << 16)]
                    hashes = [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([text_id.as_py()] * len(a), pa.binary()), pa.array(hashes, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                        names=["text_id", "passage", "start", "end"],
                    )
        hand_back_memory()

    rows = written(texts.select("text_id", "text").mapInArrow(run, "text_id binary, passage binary, start int, end int"), "short-passages")
    twice = rows.groupBy("passage").count().filter("count > 1").select("passage")
    met = rows.join(twice, "passage").select("text_id", "start", "end").distinct()
    out = written(met.groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "short-passage-spans")
    discard(rows)
    release_shuffles(texts.sparkSession)
    return out


CLEARED = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def cleared(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """`without_spans` of each batch, a few rows at a time."""
    for texts, *rest in batches:
        for low in range(0, len(texts), 512):
            yield without_spans(texts.slice(low, 512), *[column.slice(low, 512) for column in rest])
    hand_back_memory()


def without_spans(texts: pa.Array, spans: pa.Array, least: pa.Array) -> pa.Array:
    rows = []
    for raw, own, min_bytes in zip(texts, spans, least, strict=True):
        raw, own, min_bytes = raw.as_py(), own.as_py() or [], min_bytes.as_py()
        n, at, kept, removed, runs = len(raw), 0, [], 0, 0
        for s in sorted((s["start"], min(s["end"], n)) for s in own):
            start, end = s
            if end - start < min_bytes:
                continue
            if start > at or (start == at == 0 and not runs):  # a new run
                kept.append(raw[at:start])
                runs += 1
                removed += end - start
                at = end
            elif end > at:
                removed += end - at
                at = end
        kept.append(raw[at:])
        rows.append((n, removed, runs, b"".join(kept)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.StructArray.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["n_bytes", "n_removed", "n_spans", "kept"]
    )


def remove_repeats(
    receipts: DataFrame,
    min_bytes: int = 400,
    keep: list[str] | None = None,
    min_words: int | None = None,
    cell_id: str = CELL_ID,
    response_content: str = RESPONSE,
) -> DataFrame:
    """The answers with n_bytes, n_removed, n_spans and kept (binary): what is left once
    every byte is removed that is covered by a string of `min_bytes` bytes starting
    anywhere else too, in the same answer or another.

    Texts are their UTF-8 bytes; strings never cross answers, and all are judged on the
    input, so both places of a repeat lose it. n_spans counts maximal removed runs. Null
    answers are empty and stay so, as do answers shorter than `min_bytes`. Copies of a
    text, repeated rows included, lose all of it. With `min_words`, strings of so many words
    (cut at ASCII blanks) go as well where they have fewer bytes. `keep` lists columns to return besides
    (default: cell_id); those called like a result are replaced.
    """
    own = ("n_bytes", "n_removed", "n_spans", "kept")
    keep = [c for c in (keep or [cell_id]) if c not in own]
    text = text_or_empty(response_content)
    rows = receipts.select(
        *[F.col(c).alias(f"_keep_{c}") for c in keep], F.unhex(F.md5(text)).alias("text_id"), text.cast("binary").alias("text")
    )
    long_enough = rows.filter(F.length("text") >= min_bytes).select("text_id", "text")
    spans = repeated_spans(long_enough, min_bytes)
    least = min_bytes
    if min_words is not None:
        least = min(min_bytes, 2 * min_words - 1)  # a letter a word, and a blank between two
        short = short_passages(rows.filter(F.length("text") >= least).select("text_id", "text"), min_words, min_bytes)
        both = spans.union(short).select("text_id", F.explode("spans").alias("s"))
        spans = both.groupBy("text_id").agg(F.collect_list("s").alias("spans"))
    joined = rows.join(spans, "text_id", "left")
    result = joined.withColumn("_result", arrow_udf(cleared, CLEARED)("text", "spans", F.lit(least)))
    return result.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], "_result.*")


def whole_letters(kept: Column) -> Column:
    """The text of bytes; letters that a cut has left incomplete are dropped."""

    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (part for column in batches for part in slices(column)):
            yield pa.array([None if x is None else x.decode("utf-8", "ignore") for x in part.to_pylist()], pa.string())
        hand_back_memory()

    return arrow_udf(text_of, "string")(kept)
