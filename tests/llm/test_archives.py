import base64
import gzip
import hashlib
import random

import pytest

from cloudgauge.llm import archives

SCHEMA = "cell_id string, response_content string, url string, record_type int"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, least=0):
    """(cell_id, bytes, digest, kind, refers to) of each row; of a repeated largest id one is stored."""
    largest = {}
    for at, (cell, text, *_) in enumerate(rows):
        key = (cell is not None, cell or "", at)
        largest[text or ""] = max(largest.get(text or "", key), key)
    out = []
    for at, (cell, text, *_) in enumerate(rows):
        raw, stored = (text or "").encode(), largest[text or ""]
        again = len(raw) >= least and stored[2] != at
        out.append((cell, len(raw), digest(raw), "revisit" if again else "response", stored[1] if again and stored[0] else None))
    return sorted(out, key=str)


def read(spark, folder):
    back = archives.resolve_revisits(archives.read_archives(spark, folder)).collect()
    assert all(r.complete for r in back)
    return sorted(((r.cell_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)


def odd_rows():
    rng = random.Random(4)
    long = "".join(rng.choice("abcé€😀<>\r\n ") for _ in range(70_000))
    texts = [None, "", "a", "WARC/1.1\r\nContent-Length: 9\r\n\r\n", "WARC/1.1\r\n" * 300, "\r\n\r\n0\r\n\r\n", long, long + "x", "x" * 4096, "é" * 8192]
    rows = [(f"m|{i}%\r\n:é", rng.choice(texts), "http://a/é b\r\nX: y" if i % 2 else None, 1) for i in range(60)]
    return rows + rows[:6] + [(None, "a", None, 1), (None, "only here", None, 1)]


@pytest.mark.parametrize(("segment", "chunk", "least"), [(16_384, 4_096, 0), (200, 64, 0), (1_000, 5_000, 2)])
def test_round_trip_of_odd_rows(spark, tmp_path, segment, chunk, least):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    archives.write_archives(df, f"{tmp_path}/a", segment, chunk, least, target="url")
    assert read(spark, f"{tmp_path}/a") == plain(rows, least)
    payloads = {r.payload_digest: bytes(r.payload) for r in archives.read_archives(spark, f"{tmp_path}/a").withColumnRenamed("stated_digest", "payload_digest").filter("payload is not null").collect()}
    assert set(payloads.values()) == {(t or "").encode() for _, t, *_ in rows}


def test_empty_table(spark, tmp_path):
    archives.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert read(spark, f"{tmp_path}/a") == []


def made(*records):
    return b"".join(archives.record(fields, block) + b"\r\n" for fields, block in records)


def segments(parts, total, origin="<urn:o>"):
    first = ([("WARC-Type", "response"), ("WARC-Record-ID", origin), ("WARC-Segment-Number", "1")], parts[0])
    rest = [
        ([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:{n}>"), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", str(total) if n == len(parts) else None)], p)
        for n, p in enumerate(parts[1:], 2)
    ]
    return [first, *rest]


HEAD = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n"


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, packed):
    body = HEAD + b"5;name=x\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: 1\r\n\r\n"
    parts = [body[:20], body[20:41], body[41:]]
    good = segments(parts, len(body))
    mixed = [good[2], good[0], good[1], good[1]]  # any order, one twice
    short = segments(parts, len(body) + 1, "<urn:short>")
    gap = segments(parts, len(body), "<urn:gap>")
    del gap[1]
    lost = segments(parts, len(body), "<urn:lost>")[1:]
    plain_one = ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:p>")], b"HTTP/1.0 200 OK\r\nContent-Type: a\r\n\r\nas it is")
    broken = ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:b>")], HEAD + b"9\r\nshort\r\n0\r\n\r\n")
    wrong = ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:w>"), ("WARC-Payload-Digest", "sha1:" + digest(b"other"))], HEAD + b"0\r\n\r\n")
    info = ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>")], b"software: x\r\n")
    again = ([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:r>"), ("WARC-Refers-To", "<urn:nowhere>")], b"")
    data = made(info, *mixed, *short, *gap, *lost, plain_one, broken, wrong, again)
    cut = archives.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:c>")], b"HTTP/1.0 200 OK\r\n\r\nlong enough")[:-12]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(gzip.compress(data[:300]) + gzip.compress(data[300:])) if packed else (tmp_path / "a" / "one.warc").write_bytes(data)
    (tmp_path / "a" / "two.warc").write_bytes(cut)
    (tmp_path / "a" / "three.warc").write_bytes(b"no record at all")
    rows = {r.record_id: (r.payload and bytes(r.payload), r.complete) for r in archives.read_archives(spark, f"{tmp_path}/a").collect()}
    assert rows == {
        "<urn:o>": (b"hello world", True),
        "<urn:short>": (None, False),
        "<urn:gap>": (None, False),
        "<urn:p>": (b"as it is", True),
        "<urn:b>": (None, False),
        "<urn:w>": (None, False),
        "<urn:c>": (None, False),
        "<urn:r>": (None, True),
    }
    resolved = {r.record_type: r for r in archives.resolve_revisits(archives.read_archives(spark, f"{tmp_path}/a")).collect()}
    assert not resolved["revisit"].complete and resolved["revisit"].refers_to is None


def test_query_equals_the_plain_version(spark, sf_dir):
    from cloudgauge.llm.queries import QUERIES

    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    want = {(cell, n, d, kind, ref) for cell, n, d, kind, ref in plain([(f"{i:09}", t) for i, t in rows])}
    got = {(f"{r.page_id:09}", r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else f"{r.refers_to:09}") for r in QUERIES["op12_segment_reassembly"](spark, sf_dir).collect()}
    assert got == want
