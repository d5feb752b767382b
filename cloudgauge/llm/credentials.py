"""Secrets in answers, told apart from examples that everybody copies.

Candidates are found text by text. Whether one looks live is a question to the whole log:
a documented example turns up with many owners in many repositories, a leaked credential
with one. So values are hashed, and for each hash the distinct repositories and owners
are counted over all answers.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloudgauge.llm.common import CELL_ID, RESPONSE, strings, text_or_empty, written

KINDS = ("assign", "access", "hex", "generic")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a whole run of hex digits, tried at its first digit only
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# a whole run of key characters with a digit in it
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}")
CANDIDATES = "array<struct<kind_no:int,start:int,end:int,value:binary,base:boolean>>"


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str, min_entropy: float) -> list[dict]:
    found: list[tuple[int, int, int, str, bool]] = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [(0, m.start(), m.end(), m[2], True) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0], True) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end(), m[0], True) for m in HEX.finditer(text)]
    base = sorted((start, end) for _, start, end, _, _ in found)
    at, reach = 0, 0
    for m in GENERIC.finditer(text):
        # base spans that begin before this run ends; the furthest end among them decides
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= min_entropy:
            found.append((3, m.start(), m.end(), m[0], False))
    return [
        {"kind_no": k, "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "base": base_}
        for k, a, b, v, base_ in found
    ]


def secret_spans(
    receipts: DataFrame,
    owner: str = "model",
    repository: str = "arm",
    max_owners: int = 1,
    max_repositories: int = 2,
    min_entropy: float = 3.0,
    cell_id: str = CELL_ID,
    response_content: str = RESPONSE,
) -> DataFrame:
    """One row per answer: cell_id and `spans`, an array sorted by start and kind of
    structs (start, kind_no, kind, end, base, owners, repositories, live).

    Kinds: an assignment to a secret's name, an access key id, a long hex string (the base
    rules; always reported) and a generic key-like run of high entropy outside of those,
    reported only if it looks live: no more than `max_owners` owners and
    `max_repositories` repositories have its value. `live` says the same of base spans.
    Positions are code points, the end exclusive. Null answers are empty; null owners or
    repositories count as none. Repeated rows are reported each, and count once. Columns
    other than the four named are not read.
    """

    @arrow_udf(CANDIDATES)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(
            pa.struct(
                [("kind_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("base", pa.bool_())]
            )
        )
        for column in batches:
            yield pa.array([candidates(text, min_entropy) for text in strings(column)], kind)

    slim = receipts.select(
        F.col(cell_id).alias("cell_id"),
        F.col(owner).alias("owner"),
        F.col(repository).alias("repository"),
        found(text_or_empty(response_content)).alias("candidates"),
    )
    # without the texts; the row number is fixed once the table is written
    rows = written(slim.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    each = rows.select("row", "owner", "repository", F.inline("candidates"))
    counted = (
        each.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("value")
        .agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    )
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    names = F.array(*[F.lit(k) for k in KINDS])
    judged = (
        each.join(counted, "value")
        .withColumn("live", live)
        .filter("base OR live")
        .withColumn("kind", names[F.col("kind_no")])
    )
    span = F.struct("start", "kind_no", "kind", "end", "base", "owners", "repositories", "live")
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("row", "cell_id").join(spans, "row", "left").select("cell_id", F.coalesce("spans", empty).alias("spans"))
