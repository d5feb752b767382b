"""Readers for the file kinds the study stages exchange."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from cloudgauge.functions.params import PARAM_NAMES
from cloudgauge.session import attach, settle, settled

CORRUPT = "_corrupt"

# Column positions of the raw entry file.
RAW_WIDTH = 25
RAW_COLUMNS = (
    ["entry_id", "descriptor", "ip", "unused3", "unused4"]
    + PARAM_NAMES
    + ["genre", "instrument", "location", "experience", "age", "nationality", "unused24"]
)
FEATURE_WIDTH = 80


def _text_struct(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_positional_csv(spark: SparkSession, path: str, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Headerless CSV of fixed width, all columns text, plus a `bad_width` flag.

    Blank lines are skipped and undecodable bytes become the replacement character.
    Rows that are too short or too long stay in the result, flagged.
    """
    schema = _text_struct(columns + [CORRUPT])
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        # the width of a row is only seen when all its columns are read
        .option("columnPruning", "false")
        .csv(path)
    )
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]
    return raw.select(*texts, F.col(CORRUPT).isNotNull().alias("bad_width"))


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after the line, given whether one was before it.
    A quote opens a field only as its first character, and a doubled one is a character."""
    if b'"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            at += 1
            if line[at : at + 1] == b'"':
                at += 1
                continue
            inside = False
        if inside is False and (at > 0 and line[at - 1 : at] != b"," or line[at : at + 1] != b'"'):
            at = line.find(b",", at) + 1  # to the next field
            if not at:
                return False
        if at < n and line[at : at + 1] == b'"':
            inside, at = True, at + 1
        elif at >= n:
            return False


def _numbered_lines(lines: DataFrame, totals: bool) -> DataFrame:
    """Per line of a split: its number there, and how many records begin before it and
    whether a field is open, both if the split begins outside quotes (0) and inside (1).
    With `totals`, the same at the end of each split."""
    ddl = "file string, block long, line long, begun0 long, begun1 long, open0 boolean, open1 boolean, after0 boolean, after1 boolean, value binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        state = [0, 0, 0, False, True]  # lines, records begun, fields open

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 10
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != now:
                    if totals and now:
                        out.append((*now, state[0], state[1], state[2], state[3], state[4], None, None, None))
                    now, state = (file, block), [0, 0, 0, False, True]
                n, begun0, begun1, open0, open1 = state
                after0, after1 = ends_inside(value, open0), ends_inside(value, open1)
                if not totals:
                    out.append((file, block, n, begun0, begun1, open0, open1, after0, after1, value))
                state = [n + 1, begun0 + (not open0), begun1 + (not open1), after0, after1]
            if not totals:
                yield emit()
        if totals and now:
            out.append((*now, *state, None, None, None))
        yield emit()

    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
    return lines.mapInArrow(run, ddl)


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): the records of CSV text files and their numbers from 0, over all files
    in order of their paths. Every record counts, also blank ones and those of a wrong
    width; a line feed within quotes does not end a record (it is a plain line feed in
    `value`). Each file begins outside quotes.

    Two passes over the splits, without moving lines: the first counts what begins in each split,
    sums over the splits before give each its first number, the second numbers the lines. Only records of
    several lines are brought together.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    ends = settled(_numbered_lines(text, totals=True))  # a row for each split
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # a split ends as it began, turned round, or in a state that does not depend on that
    turns = F.count_if(F.col("open0") & ~F.col("open1")).over(before)
    known = ends.withColumn("turns", F.coalesce(turns, F.lit(0))).withColumn("sure", F.when(F.col("open0") == F.col("open1"), F.struct("open0", "turns")))
    last = F.last("sure", ignorenulls=True).over(before)
    odd = (F.col("turns") - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    entered = known.withColumn("inside", F.coalesce(last["open0"], F.lit(False)) != odd)
    entered = entered.withColumn("begun", F.when(F.col("inside"), F.col("begun1")).otherwise(F.col("begun0")))
    per_file = entered.groupBy("file").agg(F.sum("begun").alias("n"))
    files_before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = entered.withColumn("first", F.coalesce(F.sum("begun").over(before), F.lit(0))).join(per_file.select("file", files_before.alias("ahead")), "file")
    side, small = settle(places.select("file", "block", "inside", (F.col("first") + F.col("ahead")).alias("first")))
    lines = attach(_numbered_lines(text, totals=False), side, small, ["file", "block"])
    chosen = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    opened, after = chosen("open"), chosen("after")
    # a line that begins inside quotes belongs to the record before it
    row = F.col("first") + chosen("begun") - F.when(opened, 1).otherwise(0)
    placed = lines.select(row.alias("row"), "file", "block", "line", (opened | after).alias("several"), F.make_valid_utf8(F.col("value").cast("string")).alias("value"))
    whole = placed.filter(~F.col("several")).select("row", "value")
    parts = F.array_sort(F.collect_list(F.struct("file", "block", "line", "value")))
    joined = placed.filter("several").groupBy("row").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(joined)


def scan_numbered_csv(spark: SparkSession, path: str, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """`scan_positional_csv` with row numbers: id (`safe-` and the number of the record
    among all records of the files, blank and wrong ones counted), the columns, bad_width.
    Blank records are counted and left out."""
    records = numbered_records(spark, path).filter("value <> ''")
    schema = _text_struct(columns + [CORRUPT])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "lineSep": "\u0001"}
    read = records.withColumn("r", F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), options))
    texts = [F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in columns]
    return read.select(F.concat(F.lit("safe-"), "row").alias("id"), *texts, F.col(f"r.{CORRUPT}").isNotNull().alias("bad_width"))


def scan_feature_csv(spark: SparkSession, path: str, width: int = FEATURE_WIDTH) -> DataFrame:
    """(entry_id, role, vec): rows that do not parse are skipped; the last row of a
    repeated (entry_id, role) wins."""
    names = [f"f{i}" for i in range(width)]
    schema = _text_struct(["entry_id", "role", *names, CORRUPT])
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", "false")
        .csv(path)
        .select(
            "*",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("__place"),
        )
    )
    return feature_rows(raw.filter(F.col(CORRUPT).isNull()), F.array(*names), F.col("__place"))


def feature_rows(df: DataFrame, texts: Column, position: Column) -> DataFrame:
    """Parse the text features and keep the last row per (entry_id, role)."""
    parsed = df.select(
        F.trim("entry_id").alias("entry_id"),
        F.trim("role").alias("role"),
        F.transform(texts, lambda x: F.trim(x).try_cast("double")).alias("vec"),
        position.alias("__at"),
    ).filter(F.forall("vec", lambda x: x.isNotNull()))
    last = Window.partitionBy("entry_id", "role").orderBy(F.desc("__at"))
    return (
        parsed.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn", "__at")
    )


def _empty_if_absent(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def scan_json_lines(
    spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False
) -> DataFrame:
    """One JSON object per line under a fixed schema; an absent file may mean no rows."""

    def read() -> DataFrame:
        return spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)

    return _empty_if_absent(spark, schema, read) if missing_ok else read()


def scan_mixed_rows(
    spark: SparkSession, path: str, schema: T.StructType, tag: str = "row_type", value: str = "energy"
) -> tuple[DataFrame, DataFrame]:
    """One file with two row kinds: (rows without the tag value, rows with it)."""
    both = scan_json_lines(spark, path, schema)
    return both.filter(~F.col(tag).eqNullSafe(F.lit(value))), both.filter(F.col(tag) == value)


def scan_tolerant_log(
    spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(readable rows, corrupt lines) of an append-only JSON log."""
    with_bad = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    lines = T.StructType([T.StructField("value", T.StringType())])

    def read() -> DataFrame:
        return spark.read.text(path)

    text = _empty_if_absent(spark, lines, read) if missing_ok else read()
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = (
        text.filter(F.trim("value") != "")
        .select(F.from_json("value", with_bad, options).alias("r"))
        .select("r.*")
    )
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))
    return good, bad
