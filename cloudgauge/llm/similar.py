"""Near duplicates by the exact similarity of their sets of shingles.

Texts with equal sets are one node. Two nodes are candidates if their SimHash fingerprints
are within `SIMHASH_BITS` bits, linked as in `simhash`, or, as fingerprints miss some of
what is similar, if they share a key: one of
`BANDS` runs of `BAND` least hashes (of sets with a Jaccard similarity of 0.8 all but one in
2,000 pairs share one), or for small sets one of the least shingles, of which sets as
similar as that always share one. A sketch of 256 bits and the sizes rule out most of what
meets under a common key. Candidates are linked to groups, and within each group all pairs
are compared by their shingles; only those count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloudgauge.llm.common import CELL_ID, RESPONSE, hand_back_memory, release_shuffles, slices, strings, text_or_empty, written
from cloudgauge.llm.components import components
from cloudgauge.llm.simhash import BITS, SEED, join_labels, link_fingerprints, mixed

WAYS = 4
SIMHASH_BITS, CHAIN, PARTS = 4, 2, 3
BANDS, BAND = 20, 5
FEW = 75  # sets up to this size are found by their at most 16 least shingles
SKETCH_BITS = 80  # of 256; sets with Jaccard 0.8 differ in about 39, unlike ones in 128
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle_words: int) -> np.ndarray:
    """Hashes of the different shingles, ascending."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle_words:
        starts, ends = starts[: 1 - shingle_words], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """Keys of which sets with a Jaccard similarity of 0.8 share one."""
    n, found = len(shingles), []
    if n <= FEW * 5 // 4:  # what is like a set of up to FEW has at most a quarter more
        found.append(shingles[: n - -(-4 * n // 5) + 1])
    if n > FEW:
        least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
        folded = shingles ^ (shingles >> np.uint64(32))
        for low in range(0, n, 1024):
            least = np.minimum(least, (folded[low : low + 1024, None] * FACTORS).min(axis=0))
        bands = least.reshape(BANDS, BAND)
        found.append(np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64))
    return np.concatenate(found)


def sketch(shingles: np.ndarray) -> list[int]:
    """`WAYS` fingerprints of the set, as signed numbers."""
    votes = np.zeros((WAYS, BITS), np.int64)
    for low in range(0, len(shingles), 4096):
        for way in range(WAYS):
            part = mixed(shingles[low : low + 4096], way)
            votes[way] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(shingles), axis=1, bitorder="little").view("<i8").ravel().tolist()


def far_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) > SKETCH_BITS


def candidate_links(node: np.ndarray, prints: np.ndarray, n: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Labels (least place) of the sets that candidates within equal runs make; sizes `n`
    ascend within a run. Pairs that are joined already are not looked at again."""
    label, at, step = np.arange(len(node)), np.arange(max(0, len(node) - 1)), 1
    while True:
        at = at[at + step < len(node)]
        at = at[(run[at] == run[at + step]) & (4 * n[at + step] <= 5 * n[at])]
        if not len(at):
            return label
        i = at[label[at] != label[at + step]]
        i = i[~far_apart(prints[i], prints[i + step])]
        if len(i):
            label = join_labels(label, i, i + step)
        step += 1


def similar_links(sets: list[np.ndarray], prints: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Labels of what pairs of Jaccard similarity 0.8 or more connect; sizes ascend."""
    label = np.arange(len(sets))
    for i in range(len(sets) - 1):
        high = int(np.searchsorted(4 * n, 5 * n[i], "right"))
        near = np.flatnonzero((label[i + 1 : high] != label[i]) & ~far_apart(prints[i], prints[i + 1 : high])) + i + 1
        for j in near.tolist():
            if label[i] == label[j]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 9 * common >= 4 * (n[i] + n[j]):  # common / union >= 4 / 5
                a, b = label[i], label[j]
                label[label == max(a, b)] = min(a, b)
    return label


def linked_in_cells(keyed: DataFrame, block: int, links: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Links (u, v) of the rows (key, node, n, ...) that `links` labels, given the cell of
    each row. Keys of more than `block` rows are cut into blocks by hash, and every pair of
    blocks is a cell of its own, so no task holds an unbounded key."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    blocks = F.when(F.col("members") > block, F.ceil(2 * F.col("members") / block)).otherwise(F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")),
    )
    rest = [c for c in keyed.columns if c != "key"]
    placed = keyed.join(sizes.select("key", blocks.alias("blocks")), "key").select("key", *rest, F.explode(cells).alias("cell"))
    placed = placed.select("key", "cell.low", "cell.high", *rest)
    count = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(count, "key", "low", "high").sortWithinPartitions("key", "low", "high", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(part: pa.RecordBatch) -> pa.RecordBatch:
            where = np.column_stack([np.asarray(part.column(i)) for i in range(3)])
            cell = np.cumsum(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1)]))
            node, label = np.asarray(part.column("node")), links(cell, part)
            linked = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.column_stack([np.asarray(batch.column(i)) for i in range(3)])
            changes = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            if held and (where[0] != [held[-1].column(i)[-1].as_py() for i in range(3)]).any():
                yield record(pa.concat_batches(held))
                held = []
            if len(changes):
                cut = int(changes[-1])
                yield record(pa.concat_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield record(pa.concat_batches(held))
        hand_back_memory()

    return ordered.mapInArrow(run, "u long, v long").distinct()


def prints_of(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("prints").flatten()).view(np.uint64).reshape(-1, WAYS)


def similar_groups(
    receipts: DataFrame,
    shingle_words: int = 5,
    keep: list[str] | None = None,
    block: int = 8192,
    texts_block: int = 512,
    cell_id: str = CELL_ID,
    response_content: str = RESPONSE,
) -> DataFrame:
    """The answers with component_id, the smallest cell_id that links reach, its own
    included, and component_key, a number that tells groups apart also where ids repeat or
    are null. Linked are texts whose sets of shingles have a Jaccard similarity of 0.8 or
    more, of whatever length.

    A text is lower-cased (A-Z) and cut into words at ASCII blanks; with fewer words than
    `shingle_words` it is one shingle. Texts without words, null included, are alike. Null
    ids lose to any other. `keep` lists columns to return besides (default: cell_id); those
    called like a result are replaced. Repeated rows are kept.
    """
    spark = receipts.sparkSession
    keep = [c for c in (keep or [cell_id]) if c not in ("component_id", "component_key")]

    @arrow_udf("struct<node:bigint,n:bigint,prints:array<bigint>,keys:array<bigint>>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (part for column in batches for part in slices(column, 256)):
            sets = [shingle_set(text, shingle_words) for text in strings(part)]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([keys_of(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                ["node", "n", "prints", "keys"],
            )
        hand_back_memory()

    @arrow_udf("array<bigint>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (part for column in batches for part in slices(column, 256)):
            yield pa.array([shingle_set(text, shingle_words).view(np.int64) for text in strings(part)], pa.list_(pa.int64()))
        hand_back_memory()

    def candidates(cell: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        return candidate_links(np.asarray(part.column("node")), prints_of(part), np.asarray(part.column("n")), cell)

    def confirmed(cell: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        prints, n, column = prints_of(part), np.asarray(part.column("n")), part.column("shingles")
        flat, ends = np.asarray(column.flatten()), np.cumsum(n)
        label = np.arange(len(cell))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for low, high in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=True):
            sets = [flat[ends[i] - n[i] : ends[i]] for i in range(low, high)]
            label[low:high] = similar_links(sets, prints[low:high], n[low:high]) + low
        return label

    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    if response_content in keep:  # the text is written once
        texts, text = receipts.select(*kept, F.col(cell_id).alias("_id")), text_or_empty(f"_keep_{response_content}")
    else:
        texts, text = receipts.select(*kept, F.col(cell_id).alias("_id"), text_or_empty(response_content).alias("_text")), F.col("_text")
    rows = written(texts.withColumn("_set", described(text)).select(*texts.columns, "_set.*"), "shingle-sets")
    alike = rows.groupBy("node").agg(F.min("_id").alias("least"), *[F.min(c).alias(c) for c in ("n", "prints", "keys")])
    nodes = written(alike, "shingle-nodes")
    own = F.get("prints", F.lit(0))
    alike_prints = nodes.select("node", own.alias("fingerprint"), own.alias("beside"))
    near = written(link_fingerprints(alike_prints, SIMHASH_BITS, CHAIN, PARTS, block=block), "fingerprint-links")
    release_shuffles(spark)
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n", "prints")
    met = components(near.union(written(linked_in_cells(keyed, block, candidates), "candidate-links")))
    release_shuffles(spark)
    asked = nodes.join(met.withColumnRenamed("root", "key"), "node").select("key", "node", "n", "prints", "least")
    # the row of the least id stands for its node; a node without ids has few rows or one text
    one = rows.select(F.col("node").alias("_node"), "_id", text.alias("_text"))
    drawn = asked.join(one, (F.col("node") == F.col("_node")) & F.col("least").eqNullSafe(F.col("_id")))
    compared = written(
        drawn.groupBy("key", "node", "n", "prints").agg(F.min("_text").alias("_text")).select("key", "node", "n", "prints", shingles("_text").alias("shingles")),
        "candidate-sets",
    )
    release_shuffles(spark)
    roots = components(written(linked_in_cells(compared, texts_block, confirmed), "similar-links"))
    release_shuffles(spark)
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    member = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id", F.col("root").alias("component_key"))
    return rows.join(member, "node").select(*[F.col(f"_keep_{c}").alias(c) for c in keep], "component_id", "component_key")
