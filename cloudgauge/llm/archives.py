"""Logged responses as web archives, and back: segments put together, chunks decoded.

A response is an HTTP message with a chunked body, in a WARC record; a long one is cut
into a first record and continuation records. Responses with equal payloads are stored
once, others are records that point to the one stored. Archives are gzip files that
Spark's text writer makes: a record is a "line" that ends with a line break of its own.
Readers take them apart at the version line, which is not a place to trust (a payload may
hold one), so a record goes on until it has the length that its header states.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

from cloudgauge.llm.common import CELL_ID, RESPONSE, written
from cloudgauge.session import attach, settle

VERSION = b"WARC/1.1\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(run: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), str(number))}>"


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """A body in chunked transfer framing."""
    out = []
    for low in range(0, len(payload), chunk_bytes):
        part = payload[low : low + chunk_bytes]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken. Extensions of a size
    line and trailer fields are skipped."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        digits = body[at:end].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        size, at = int(digits, 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2
    return None


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP message: what follows its head, without chunk framing."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the last of its two closing line breaks."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"".join([VERSION, head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n"])


def write_archives(
    calls: DataFrame,
    folder: str,
    segment_bytes: int = 16_384,
    chunk_bytes: int = 4_096,
    least_revisit_bytes: int = 0,
    run_id: str | None = None,
    cell_id: str = CELL_ID,
    response_content: str = RESPONSE,
    target: str | None = None,
) -> None:
    """Write the responses of the calls to gzip archives in `folder`.

    Of calls with equal payloads of at least `least_revisit_bytes` bytes the one with the
    largest `cell_id` is stored (null ids come last; of rows with that id, one), the others
    are revisit records that refer to it; shorter payloads are always stored. A null
    response is an empty payload. `target`, if given, is the column with the address; line
    breaks in it and in ids are escaped. A block of over `segment_bytes` bytes becomes
    several records. Record ids come from `run_id` (a random one if none is given) and the
    place of the row in a table that is written first, so a task that runs again writes the
    same records. Every row is a record, repeated rows too; no rows give archives without
    records. Other columns are not read.
    """
    run_id = run_id or str(uuid.uuid4())
    captures = written(
        calls.select(
            F.monotonically_increasing_id().alias("place"),
            F.col(cell_id).alias("cell_id"),
            (F.col(target).cast("string") if target else F.lit(None).cast("string")).alias("target"),
            F.coalesce(F.col(response_content).cast("string"), F.lit("")).cast("binary").alias("payload"),
        ).withColumns({"same": F.sha2("payload", 256), "size": F.octet_length("payload")}),
        "archive-captures",
    )
    several = captures.filter(F.col("size") >= least_revisit_bytes).groupBy("same").agg(F.max(F.struct("cell_id", "place")).alias("stored"), F.count("*").alias("n"))
    stored, small = settle(several.filter(F.col("n") > 1).select("same", F.col("stored.place").alias("stored")))
    joined = attach(captures, stored, small, ["same"], "left")
    refers = F.when((F.col("size") >= least_revisit_bytes) & (F.col("stored") != F.col("place")), F.col("stored"))
    ready = joined.select("place", F.col("cell_id").cast("string").alias("cell_id"), "target", "payload", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for place, cell, address, payload, refers in zip(*(c.to_pylist() if i != 3 else c for i, c in enumerate(batch.columns)), strict=True):
                out += records_of(run_id, place, cell, address, payload.as_py(), refers, segment_bytes, chunk_bytes)
                size += len(payload.as_buffer() or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # bytes as they are: the writer does not look at what a string holds
    lines = ready.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(folder)


def records_of(run_id: str, place: int, cell: str | None, address: str | None, payload: bytes, refers: int | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one call."""
    own = urn(run_id, place)
    shared = [
        ("WARC-Record-ID", own),
        ("WARC-Target-URI", None if address is None else quote(address, safe=":/?#[]@!$&'()*+,;=~-._%")),
        ("Cell-ID", None if cell is None else quote(cell, safe=":/|,~-._")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers is not None:
        return [record([("WARC-Type", "revisit"), *shared, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", urn(run_id, refers))], HTTP_HEAD + b"\r\n")]
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), *shared], block)]
    out = [record([("WARC-Type", "response"), *shared, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    for number, low in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = low + segment_bytes >= len(block)
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(run_id), f'{place}/{number}')}>"),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", str(number)),
            ("WARC-Segment-Total-Length", str(len(block)) if last else None),
        ]
        out.append(record(fields, block[low : low + segment_bytes]))
    return out


RECORD = pa.struct(
    [
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("cell_id", pa.string()),
        ("target", pa.string()),
        ("stated_digest", pa.string()),
        ("refers_to_record", pa.string()),
        ("origin", pa.string()),
        ("number", pa.int64()),
        ("total", pa.int64()),
        ("block", pa.binary()),
        ("whole", pa.bool_()),
    ]
)
RECORD_DDL = (
    "record_type string, record_id string, cell_id string, target string, stated_digest string, refers_to_record string,"
    " origin string, number long, total long, block binary, whole boolean"
)


def whole_number(value: str | None) -> int | None:
    return int(value) if value is not None and value.isascii() and value.isdigit() and len(value) < 19 else None


def parsed(data: bytes) -> tuple[dict, int, int] | None:
    """(fields, where the block starts, its stated length) of a record without its version
    line; None without a complete head."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    last = None
    for line in data[:end].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:  # a folded line goes on
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            fields.setdefault(last, value.strip())
    length = whole_number(fields.get("content-length"))
    return None if length is None else (fields, end + 4, length)


def as_record(data: bytes) -> dict | None:
    found = parsed(data)
    if found is None:
        return None
    fields, at, length = found
    block, number, own = data[at : at + length], whole_number(fields.get("warc-segment-number")), fields.get("warc-record-id")
    digest = fields.get("warc-payload-digest", "")
    return {
        "record_type": fields.get("warc-type", "").lower(),
        "record_id": own,
        "cell_id": unquote(fields["cell-id"]) if "cell-id" in fields else None,
        "target": fields.get("warc-target-uri"),
        "stated_digest": digest[5:] if digest.lower().startswith("sha1:") else None,
        "refers_to_record": fields.get("warc-refers-to"),
        "origin": fields.get("warc-segment-origin-id", own) if number is not None else None,
        "number": number,
        "total": whole_number(fields.get("warc-segment-total-length")),
        "block": block,
        "whole": len(block) == length,
    }


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives (gzip or plain) in a folder: type, ids, what it says
    about segments, block, and whether the block has its stated length. What can't be read
    as a record is left out. A version line within a block does not end it, unless the
    archive is a plain file that Spark cuts just there; then the record is not whole.
    """
    pieces = spark.read.option("lineSep", VERSION.decode()).text(folder)
    placed = pieces.select(
        F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string")).alias("part"),
        F.col("value").cast("binary").alias("value"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held, missing = None, [], 0
        out: list[dict] = []
        size = 0

        def close() -> None:
            nonlocal held, missing, size
            if held and (row := as_record(VERSION.join(held))) is not None:
                out.append(row)
                size += len(row["block"])
            held, missing = [], 0

        def ready() -> pa.RecordBatch:
            nonlocal out, size
            made, out, size = pa.RecordBatch.from_struct_array(pa.array(out, RECORD)), [], 0
            return made

        for batch in batches:
            for part, value in zip(batch.column(0), batch.column(1), strict=True):
                part, value = part.as_py(), value.as_py()
                if part != open_:
                    close()
                    open_ = part
                if held and missing > 0:
                    held.append(value)
                    missing -= len(VERSION) + len(value)
                else:
                    close()
                    held = [value]
                    head = parsed(value)
                    missing = head[1] + head[2] - len(value) if head else 0
                if size > 4 << 20:
                    yield ready()
        close()
        yield ready()

    return placed.mapInArrow(run, RECORD_DDL)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The responses and revisits of the archives, segments put together: record_id,
    record_type, cell_id, target, refers_to_record, payload (binary; null for revisits and
    for broken responses), stated_digest (base32 SHA-1), complete.

    Segments are grouped by the id of their first record and ordered by number; of records
    with the same number one counts. A response is complete if the numbers run from 1
    without a gap, the last one states the length that all have together (a record without
    segments has no such length to meet), the chunk framing is sound, and the payload has the
    stated digest, if any. Continuations without a first record are left out. Records of
    other types are not returned; empty archives give no rows.
    """
    records = scan_archives(spark, folder)
    kinds = records.filter(F.col("record_type").isin("response", "revisit", "continuation"))
    single = kinds.filter(F.col("number").isNull() & (F.col("record_type") != "continuation"))
    parts = kinds.filter(F.col("number").isNotNull() & F.col("origin").isNotNull())
    segment = F.struct("number", "total", "whole", "block")
    head = ["record_type", "cell_id", "target", "stated_digest", "refers_to_record"]
    first = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in head]
    # the segments of one response: as large as the response itself
    grouped = parts.groupBy("origin").agg(*first, F.array_sort(F.collect_list(segment)).alias("segments")).filter(F.col("record_type").isNotNull())
    columns = ["record_id", *head, "block", "whole"]
    joined = grouped.withColumn("built", reassembled(F.col("segments"))).select(
        F.col("origin").alias("record_id"), *head, F.col("built.block").alias("block"), F.col("built.whole").alias("whole")
    )
    every = single.select(*columns).unionByName(joined.select(*columns))
    opened = every.withColumn("read", payloads(F.struct("record_type", "block", "whole", "stated_digest")))
    return opened.select("record_id", *head, F.col("read.payload").alias("payload"), F.col("read.complete").alias("complete"))


@arrow_udf(StructType([StructField("block", BinaryType()), StructField("whole", BooleanType())]))
def reassembled(segments: pa.Array) -> pa.Array:
    out = []
    for row in segments:
        by_number = {s["number"]: s for s in reversed(row.as_py())}
        numbers = sorted(by_number)
        block = b"".join(by_number[n]["block"] for n in numbers)
        last = by_number[numbers[-1]]
        sound = numbers == list(range(1, len(numbers) + 1)) and all(s["whole"] for s in by_number.values())
        out.append({"block": block, "whole": sound and last["total"] == len(block)})
    return pa.array(out, pa.struct([("block", pa.binary()), ("whole", pa.bool_())]))


@arrow_udf(StructType([StructField("payload", BinaryType()), StructField("complete", BooleanType())]))
def payloads(rows: pa.Array) -> pa.Array:
    out = []
    for row in rows:
        r = row.as_py()
        if r["record_type"] == "revisit":
            out.append({"payload": None, "complete": r["whole"]})
            continue
        payload = payload_of(r["block"]) if r["whole"] else None
        right = payload is not None and r["stated_digest"] in (None, base32_sha1(payload))
        out.append({"payload": payload if right else None, "complete": right})
    return pa.array(out, pa.struct([("payload", pa.binary()), ("complete", pa.bool_())]))


def resolve_revisits(responses: DataFrame) -> DataFrame:
    """What `read_archives` returns in terms of payloads: cell_id, payload_bytes,
    payload_digest, record_type, refers_to (the cell_id of the response that a revisit
    points to), complete.

    A revisit has the length of the response it points to; its digest is the one it states.
    It is complete if that response is, and has the same digest. Payloads themselves are
    not carried along.
    """
    digest = F.coalesce("stated_digest", base32(F.col("payload")))
    slim = written(
        responses.select("record_id", "record_type", "cell_id", "refers_to_record", digest.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "complete"),
        "archive-records",
    )
    stored = slim.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"),
        F.col("cell_id").alias("refers_to"),
        F.col("payload_bytes").alias("stored_bytes"),
        (F.col("complete")).alias("stored_complete"),
        F.col("payload_digest").alias("stored_digest"),
    )
    plain = slim.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("string"))
    again = slim.filter("record_type = 'revisit'").join(stored, "refers_to_record", "left")
    right = F.col("complete") & F.coalesce(F.col("stored_complete") & F.col("stored_digest").eqNullSafe(F.col("payload_digest")), F.lit(False))
    again = again.withColumns({"payload_bytes": F.col("stored_bytes"), "complete": right})
    columns = ["cell_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    return plain.select(*columns).unionByName(again.select(*columns))


@arrow_udf(StringType())
def base32(payload: pa.Array) -> pa.Array:
    return pa.array([None if x is None else base32_sha1(x) for x in payload.to_pylist()], pa.string())
