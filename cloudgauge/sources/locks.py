"""Fingerprints of files and tables, and the sinks that record them."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 8 << 20
# Schemes of Hadoop paths, and what Arrow calls the same stores.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


class FingerprintMismatch(RuntimeError):
    pass


def row_digest(*cols: str) -> Column:
    """md5 over the columns as text, nulls marked, so that any engine can redo it."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def table_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: row count and an order-free sum over row digests (two 32-bit slices)."""
    d = row_digest(*cols)

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring(d, start, 8), 16, 10).cast("decimal(38,0)")).cast("string")

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), part(1).alias("digest_a"), part(9).alias("digest_b")
    )


def file_fingerprints(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """SHA-256 of each file by its name, or by its folder's, as the file is stored.

    Files of any size: the listing is dealt to tasks by size, and a task reads its files in
    chunks of `CHUNK` bytes. Where tasks cannot open the store themselves (its scheme is not
    in `STREAMED`), Spark's reader fetches the content, and a file must fit one row.
    """
    listed = spark.read.format("binaryFile").load(path)
    if _file_system(spark, path)[0].getScheme() in STREAMED:
        # only the listing is read here, not the content
        hashed = listed.select("path").mapInArrow(_streamed, "path string, sha256 string")
    else:
        hashed = listed.select("path", F.upper(F.sha2("content", 256)).alias("sha256"))
    # the scan passes over empty files, the listing that it goes by does not
    names = [(re.sub("^file:/+", "file:/", unquote(f)),) for f in listed.inputFiles()]
    every = spark.createDataFrame(names, "path string").join(hashed, "path", "left")
    return every.select(
        F.element_at(F.split("path", "/"), -2 if folders else -1).alias("name"),
        F.coalesce("sha256", F.upper(F.sha2(F.lit(b""), 256))).alias("sha256"),
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [streamed_sha256(where) for where in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.string())], names=["path", "sha256"])


def streamed_sha256(where: str) -> str:
    """Upper-case SHA-256 of the file at a Hadoop path (`scheme:/...`, not escaped)."""
    scheme, _, rest = where.partition(":")
    host, path = "", rest
    if rest.startswith("//"):
        host, _, path = rest[2:].partition("/")
        path = f"/{path}"
    store, inner = FileSystem.from_uri(f"{STREAMED[scheme]}://{host}{quote(path)}")
    digest = hashlib.sha256()
    # stored bytes, also of names that end like compressed files
    with store.open_input_stream(inner, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest().upper()


def verify_fingerprint(actual: DataFrame, manifest: DataFrame, key: str, value: str) -> DataFrame:
    """Every manifest entry against what is there: `ok`, `mismatch` or `missing`."""
    a = actual.select(key, F.col(value).alias("actual"))
    m = manifest.select(key, F.col(value).alias("expected"))
    return m.join(a, key, "left").select(
        key,
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("expected"), "ok")
        .otherwise("mismatch")
        .alias("verdict"),
    )


def require_fingerprint(actual: DataFrame, manifest: DataFrame, key: str, value: str) -> None:
    """Abort if any entry is missing or different."""
    bad = verify_fingerprint(actual, manifest, key, value).filter("verdict <> 'ok'").limit(5).collect()
    if bad:
        raise FingerprintMismatch(", ".join(f"{r[key]}: {r['verdict']}" for r in bad))


def sink_locked_table(df: DataFrame, path: str, manifest_path: str, name: str) -> DataFrame:
    """Write the table, append its fingerprint to the manifest, return that row.

    The fingerprint is taken from what was written, in one more scan of the output.
    """
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(path)
    cols = sorted(df.columns)
    row = table_fingerprint(spark.read.parquet(path), cols).select(F.lit(name).alias("name"), "*")
    row.write.mode("append").parquet(manifest_path)
    return spark.read.parquet(manifest_path).filter(F.col("name") == name)


def sink_append_log(df: DataFrame, path: str, batch: str) -> bool:
    """Append log rows as JSON lines, once per `batch`: False if that batch is there already.

    Rows are staged in a folder of this attempt; then one small file, which can be created
    only once, names the attempt that counts. An append that is killed before leaves rows
    that no reader sees, and a batch that is sent again, also by two drivers at a time,
    stays one copy. Concurrent writers of other batches do not meet. `scan_append_log` reads the log.
    """
    fs, commit = _file_system(df.sparkSession, f"{path}/commits/{quote(batch, safe='')}")
    if fs.exists(commit):
        return False
    attempt = uuid.uuid4().hex
    df.write.json(f"{path}/data/attempt={attempt}")
    try:
        out = fs.create(commit, False)
    except Py4JJavaError as e:
        if fs.exists(commit):  # another driver was first
            return False
        raise e
    out.write(bytearray((attempt + "\n").encode()))
    out.close()
    return True


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scan_append_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the appended batches that are committed; no log yet is an empty table."""
    fs, commits = _file_system(spark, f"{path}/commits")
    if not fs.exists(commits):
        return spark.createDataFrame([], schema)
    counted = spark.read.text(f"{path}/commits").select(F.col("value").alias("attempt")).filter("attempt <> ''")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])).json(f"{path}/data")
    return rows.join(counted, "attempt", "left_semi").drop("attempt")
