import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from cloudgauge.plans import tables
from cloudgauge.session import scratch_path
from cloudgauge.sources import files, locks
from cloudgauge.streaming import receipts as stream


def test_absent_file_is_an_empty_table(spark):
    schema = spark.createDataFrame([], "a long, b string").schema
    path = scratch_path(spark, "nothing")
    assert files.scan_json_lines(spark, path, schema, missing_ok=True).count() == 0
    good, bad = files.scan_tolerant_log(spark, path, schema)
    assert good.count() == 0 and bad.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_json_lines(spark, path, schema).count()


def test_fingerprint_sees_a_change(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    other = spark.createDataFrame([(1, "a"), (2, "")], "id int, v string")
    lock = locks.table_fingerprint(df, ["id", "v"]).withColumn("name", F.lit("t"))
    again = locks.table_fingerprint(df.repartition(3), ["id", "v"]).withColumn("name", F.lit("t"))
    changed = locks.table_fingerprint(other, ["id", "v"]).withColumn("name", F.lit("t"))
    locks.require_fingerprint(again, lock, "name", "digest_a")
    with pytest.raises(locks.FingerprintMismatch):
        locks.require_fingerprint(changed, lock, "name", "digest_a")


def test_file_fingerprint(spark):
    import hashlib

    path = scratch_path(spark, "text")
    spark.createDataFrame([("hello",)], "value string").coalesce(1).write.text(path)
    row = locks.file_fingerprints(spark, path + "/*.txt").first()
    assert row["sha256"] == hashlib.sha256(b"hello\n").hexdigest().upper()


def test_file_fingerprints_are_those_of_stored_bytes(spark, tmp_path):
    import gzip
    import hashlib
    import random

    large = random.Random(5).randbytes(1 << 20) * 20  # more than two chunks
    contents = {"large.bin": large, "empty": b"", "a b%20c+ü.txt": b"x\r\n\xff", "packed.gz": gzip.compress(b"y" * 1000)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: r["sha256"] for r in locks.file_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(c).hexdigest().upper() for n, c in contents.items()}


def test_file_fingerprints_read_content_only_in_chunks(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 3000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # what one row may hold
    try:
        assert locks.file_fingerprints(spark, str(tmp_path)).count() == 1
        assert len(locks.file_fingerprints(spark, str(tmp_path)).first()["sha256"]) == 64
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_stream_survives_out_of_order_files_and_reruns(spark, sf_dir):
    path = scratch_path(spark, "stream-test")
    log = tables.receipts(spark, sf_dir)
    # later rows arrive first
    log.filter("seq % 2 = 0").coalesce(1).write.parquet(f"{path}/in")
    read = stream.read_log_stream(spark, f"{path}/in", log.schema, max_files=1)

    def run():
        stream.stream_compile_receipts(
            read, f"{path}/out", f"{path}/checkpoint", "cell_id", "seq", keep=["model"]
        ).awaitTermination()

    run()
    log.filter("seq % 2 = 1").coalesce(1).write.mode("append").parquet(f"{path}/in")
    run()
    run()
    from cloudgauge.operators.answers import compile_first_ok

    want = compile_first_ok(log, "cell_id", "seq", "response_content", ["seq", "model"]).select("cell_id", "seq").collect()
    got = stream.read_compiled(spark, f"{path}/out", "cell_id", "seq").select("cell_id", "seq").collect()
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("split_bytes", [64, 1 << 20])
def test_row_numbers_are_those_of_a_csv_reader(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    columns = ["a", "b", "c"]
    want = []
    number = 0
    (tmp_path / "in").mkdir()
    for name in ("one", "three", "two"):
        rows = []
        for _ in range(120):
            kind = rng.randrange(12)
            field = lambda: rng.choice(["x", "", "5\" wide", 'say "hi"', "comma, here", "é", "two\nlines", '"', "\n\n", "y" * rng.randrange(40)])
            rows.append([] if kind == 0 else [field() for _ in range(2 if kind == 1 else 4 if kind == 2 else 3)])
        text = io.StringIO()
        writer = csv.writer(text, lineterminator="\n")
        for row in rows:
            if row and rng.random() < 0.2 and not any(c in "".join(row[1:]) for c in '",\n') and row[0] == '5" wide':
                text.write(",".join(row) + "\n")  # a quote within a field that is not quoted
            elif row:
                writer.writerow(row)
            else:
                text.write("\n")
        (tmp_path / "in" / f"{name}.csv").write_bytes(text.getvalue().encode() + (b"bad\xff,y,z\n" if name == "two" else b""))
        with open(tmp_path / "in" / f"{name}.csv", newline="", encoding="utf-8", errors="replace") as f:
            for row in csv.reader(f):
                if row:
                    want.append((f"safe-{number}", *(row if len(row) == 3 else [None] * 3), len(row) != 3))
                number += 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = files.scan_numbered_csv(spark, f"{tmp_path}/in", columns)
        rows = [(r.id, *([None] * 3 if r.bad_width else [r.a, r.b, r.c]), r.bad_width) for r in got.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(rows, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_appends_count_once(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/log", spark.range(5).withColumnRenamed("id", "seq")
    assert locks.scan_append_log(spark, path, df.schema).count() == 0
    assert locks.sink_append_log(df, path, "a/1")
    assert not locks.sink_append_log(df, path, "a/1")
    assert locks.sink_append_log(df.filter("false"), path, "nothing")
    with monkeypatch.context() as m:  # killed between the rows and the record
        m.setattr(locks, "quote", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            locks.sink_append_log(df, path, "b")
    df.write.json(f"{path}/data/attempt=killed")
    assert sorted(r.seq for r in locks.scan_append_log(spark, path, df.schema).collect()) == [0, 1, 2, 3, 4]
    assert locks.sink_append_log(df.withColumn("seq", df.seq + 10), path, "b")
    assert locks.scan_append_log(spark, path, df.schema).count() == 10
