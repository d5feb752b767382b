"""Repair of logged dialogues: the cheapest edits that give a dialogue its shape.

A dialogue is the rows of a cell by turn. Roles have to read: perhaps one system row, then
user and assistant by turns, ending with the assistant; or nothing. Every row is kept,
given another role or deleted, and rows may be put in. The costs of all ways to do so are
compared by a program over four states (nothing yet, after system, after user, after
assistant). What a state remembers of its way is the last node of a chain of edits; chains share
what they have in common, and each node knows its ancestors 1, 2, 4, ... edits before and a
rolling hash of all edits up to it. Of two ways of one cost the one that reads first wins:
the longest common prefix is searched by hash over the ancestors, checked by walking to
where both chains meet, and the next edit decides.

Long dialogues are cut into ranges of turns. A range becomes a small table, from which
state to which at what cost and by which edits; the tables of a dialogue are put together
in order, and each range then carries out its part of the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cloudgauge.llm.common import CELL_ID, RESPONSE, key_type, written

TURNS = 256  # of one range
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, UNFINISHED, REROLE = 2, 5, 5, 1
BASE, PRIME = 1_000_003, (1 << 61) - 1


class Edits:
    """The end of a chain of edits; shared with every chain that goes on from it."""

    __slots__ = ("ancestors", "hash", "letter", "length", "parent")

    def __init__(self, parent: Edits | None, letter: str):
        self.parent, self.letter = parent, letter
        if parent is None:
            self.length, self.hash, self.ancestors = 0, 0, ()
            return
        self.length = parent.length + 1
        self.hash = (parent.hash * BASE + ord(letter)) % PRIME
        ups, k = [parent], 0
        while k < len(ups[k].ancestors):
            ups.append(ups[k].ancestors[k])
            k += 1
        self.ancestors = tuple(ups)

    def first(self, length: int) -> Edits:
        """The node of the first `length` edits."""
        node, up = self, self.length - length
        while up:
            k = up.bit_length() - 1
            node, up = node.ancestors[k], up - (1 << k)
        return node

    def text(self) -> str:
        out, node = [], self
        while node.parent is not None:
            out.append(node.letter)
            node = node.parent
        return "".join(reversed(out))


def equal(a: Edits, b: Edits) -> bool:
    """Whether two chains of one length hold the same edits, by walking to where they meet."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.parent, b.parent
    return True


def reads_before(a: Edits, b: Edits) -> bool:
    """Whether the edits of a come before those of b."""
    short = min(a.length, b.length)
    x, y = a.first(short), b.first(short)
    if x.hash == y.hash and equal(x, y):
        return a.length < b.length
    # the last nodes that still differ
    for k in range(max(x.length.bit_length() - 1, 0), -1, -1):
        if k < len(x.ancestors) and x.ancestors[k].hash != y.ancestors[k].hash:
            x, y = x.ancestors[k], y.ancestors[k]
    if x.letter == y.letter or not equal(x.parent, y.parent):  # hashes misled: look edit by edit
        return a.text() < b.text()
    return x.letter < y.letter


Way = tuple[int, Edits]


def better(new: Way, old: Way | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and reads_before(new[1], old[1]))


def with_inserts(ways: list[Way | None]) -> list[Way | None]:
    """The ways, also those that put in a user row, an assistant row, or both, here."""
    ways = list(ways)
    for sources, state in (((START, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
        for source in sources:
            if ways[source] is None or (ways[state] is not None and ways[state][0] < ways[source][0] + INSERT):
                continue
            offer = (ways[source][0] + INSERT, Edits(ways[source][1], "I"))
            if better(offer, ways[state]):
                ways[state] = offer
    return ways


def after_row(ways: list[Way | None], initial: str, faulty: bool, unfinished: bool) -> list[Way | None]:
    """The ways after one more row; a faulty one has to go."""
    out: list[Way | None] = [None] * 4
    ways = with_inserts(ways)
    extra = UNFINISHED if unfinished else 0
    for state, way in enumerate(ways):
        if way is None:
            continue
        cost, edits = way
        offers = [(state, cost + DELETE, "D")]
        if not faulty:
            turns_to = ASSISTANT if state == USER else USER
            offers.append((turns_to, cost + REROLE + extra, "R"))
            if initial == "s" and state == START:
                offers.append((SYSTEM, cost + extra, "K"))
            elif initial == ("a" if turns_to == ASSISTANT else "u"):
                offers.append((turns_to, cost + extra, "K"))
        for to, price, letter in offers:
            if out[to] is not None and out[to][0] < price:
                continue
            offer = (price, Edits(edits, letter))
            if better(offer, out[to]):
                out[to] = offer
    return out


def from_state(state: int) -> list[Way | None]:
    ways: list[Way | None] = [None] * 4
    ways[state] = (0, Edits(None, ""))
    return ways


class Range:
    """The ways through one range of turns, from every state it may begin in."""

    def __init__(self, first: bool):
        self.ways = {s: from_state(s) for s in ((START,) if first else range(4))}
        self.seen: set[tuple[str, bytes]] = set()
        self.counts = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least_turn = self.most_turn = self.last_turn = None
        self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        held, key = text.rstrip(SPACE), (role, hashlib.sha256(text.encode()).digest())
        fault = "blank" if not held else "duplicate" if key in self.seen else "truncated" if held[-1] not in ".!?" else None
        self.seen.add(key)
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.counts["rows"] and self.last_initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        if not self.counts["rows"]:
            self.first_initial = initial
        if turn is not None and turn != self.last_turn:
            self.counts["turns"] += 1
            self.last_turn = self.most_turn = turn
            self.least_turn = turn if self.least_turn is None else self.least_turn
        self.counts["rows"] += 1
        self.last_initial = initial
        gone, unfinished = fault in ("blank", "duplicate"), fault == "truncated"
        self.ways = {s: after_row(ways, initial, gone, unfinished) for s, ways in self.ways.items()}

    def table(self) -> list[dict]:
        return [
            {"start": s, "end": e, "cost": way[0], "edits": way[1].text()}
            for s, ways in self.ways.items()
            for e, way in enumerate(ways)
            if way is not None
        ]


class Joined:
    """The end of a chain of ranges' edits: as `Edits`, a range at a time."""

    __slots__ = ("ancestors", "number", "parent", "piece", "state")

    def __init__(self, parent: Joined | None, piece: str, state: int):
        self.parent, self.piece, self.state = parent, piece, state
        self.number = 0 if parent is None else parent.number + 1
        ups, k = ([] if parent is None else [parent]), 0
        while ups and k < len(ups[k].ancestors):
            ups.append(ups[k].ancestors[k])
            k += 1
        self.ancestors = tuple(ups)


def after(a: Joined, b: Joined) -> tuple[str, str]:
    """What two chains of as many ranges hold after the last range they share."""
    x, y = a, b
    for k in range(len(x.ancestors) - 1, -1, -1):
        if k < len(x.ancestors) and x.ancestors[k] is not y.ancestors[k]:
            x, y = x.ancestors[k], y.ancestors[k]
    shared = x.parent if x is not y else x
    tails = []
    for node in (a, b):
        pieces = []
        while node is not shared:
            pieces.append(node.piece)
            node = node.parent
        tails.append("".join(reversed(pieces)))
    return tails[0], tails[1]


class Whole:
    """The ways through the ranges of a dialogue so far, and its counts."""

    def __init__(self) -> None:
        self.ways: list[tuple[int, Joined] | None] = [(0, Joined(None, "", START)), None, None, None]
        self.ranges: list[int] = []
        self.counts = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least_turn = self.most_turn = self.last_initial = None

    def add(self, row: dict) -> None:
        if self.counts["rows"] and self.last_initial + row["first_initial"] not in LEGAL:
            self.counts["illegal"] += 1
        for name in self.counts:
            self.counts[name] += row[name]
        self.last_initial = row["last_initial"]
        if row["least_turn"] is not None:
            self.least_turn = row["least_turn"] if self.least_turn is None else self.least_turn
            self.most_turn = row["most_turn"]
        self.ranges.append(row["range"])
        out: list[tuple[int, Joined] | None] = [None] * 4
        for step in row["ways"]:
            if (way := self.ways[step["start"]]) is not None:
                self.offer(out, step["end"], way[0] + step["cost"], way[1], step["edits"])
        self.ways = out

    @staticmethod
    def offer(out: list, state: int, cost: int, parent: Joined, piece: str) -> None:
        old = out[state]
        if old is None or cost <= old[0]:
            node = Joined(parent, piece, state)
            if old is None or cost < old[0]:
                out[state] = (cost, node)
            else:
                new_tail, old_tail = after(node, old[1])
                if new_tail < old_tail:
                    out[state] = (cost, node)

    def best(self) -> tuple[int, list[tuple[int, int, str]]]:
        """The cost of the cheapest edits, and of each range (range, state before, edits)."""
        ends: list = [None]
        rows = [(START, 0, ""), (ASSISTANT, 0, ""), (USER, INSERT, "I"), (START, 2 * INSERT, "II"), (SYSTEM, 2 * INSERT, "II")]
        for state, extra, letters in rows:
            if self.ways[state] is not None:
                self.offer(ends, 0, self.ways[state][0] + extra, self.ways[state][1], letters)
        cost, node = ends[0]
        closing, node, steps = node.piece, node.parent, []
        while node.parent is not None:
            steps.append((self.ranges[node.number - 1], node.parent.state, node.piece))
            node = node.parent
        steps.reverse()
        if steps:
            steps[-1] = (*steps[-1][:2], steps[-1][2] + closing)
        return cost, steps


def damage_turns(turns: DataFrame, cell_id: str = CELL_ID, turn: str = "turn", role: str = "role", response_content: str = RESPONSE) -> DataFrame:
    """The rows with the faults that logs have, by the remainder by 20 of the CRC-32 of
    `cell_id:turn` (nulls: one space): 0 drops a row, 1 empties its text, 2 takes out its
    stops, 3 repeats it, 4 makes its role user. A null role or text becomes one space."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(cell_id), F.lit(":"), blank(turn))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank(response_content), "[.!?]", "")).otherwise(blank(response_content))
    hit = turns.filter(kind != 0)
    changed = hit.select(*[c for c in hit.columns if c not in (role, response_content)], F.when(kind == 4, F.lit("user")).otherwise(blank(role)).alias(role), text.alias(response_content), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return changed.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*turns.columns)


COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[list]]]:
    """Runs of rows with the same first `keys` columns, each row as a list of values."""
    last, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != last:
                yield last, held
                held = []
            last = row[:keys]
            held.append(row)
            if len(held) >= 4096:  # long runs come in parts
                yield last, held
                held = []
    if held:
        yield last, held


def repair_turns(
    turns: DataFrame, range_turns: int = TURNS, cell_id: str = CELL_ID, turn: str = "turn", role: str = "role", response_content: str = RESPONSE
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the audit of each dialogue and the rows of the repaired ones.

    The first has cell_id, gaps (turn numbers missing between the least and the largest),
    blank, duplicate, truncated (rows by their first fault: no character but space; role and
    text as in an earlier row; last such character not a stop), illegal (neighbours whose
    role initials are not su, ua or au), cost, audit (the cheapest edits in order: Keep, Rerole,
    Delete, Insert; of several the one that reads first). Blank and duplicate rows are always
    deleted; a truncated row that stays costs 5 more. The second has cell_id, range, place,
    role and response_content, to be read by range and place; rows put in are empty.

    Rows go by turn (whole numbers, nulls first), then by role and text, in byte order.
    A null role or text is one space. Rows whose cell_id is null are one dialogue. Dialogues
    without rows do not appear; no rows give empty tables. Other columns are not read.

    A range of `range_turns` turn numbers is met in one task, so a dialogue of any length
    is spread; what is put together for a dialogue is the letters of its edits. A range
    remembers digests of its texts, not the texts. Rows of one dialogue and one turn
    are in one range, however many they are.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    nth = F.coalesce(F.floor(F.col("turn") / range_turns), F.lit(-(1 << 62)))
    rows = turns.select(
        F.col(cell_id).alias("cell_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(response_content).alias("text")
    ).withColumn("range", nth)
    rows = written(rows.select("cell_id", "range", "turn", "role", "text"), "dialogue-rows")
    kind, of_cell = key_type(rows, "cell_id"), to_arrow_type(rows.schema["cell_id"].dataType)
    # what ranges have to know of earlier ones: that there are any, and texts that were there
    spans = rows.groupBy("cell_id").agg(F.min("range").alias("from"), F.max("range").alias("to")).filter("`from` < `to`")
    spans = spans.select(F.col("cell_id").alias("long_id"), "from")
    of_long = rows.join(spans, F.col("cell_id").eqNullSafe(F.col("long_id"))).drop("long_id")
    digest = F.unhex(F.sha2("text", 256))
    texts = of_long.groupBy("cell_id", "role", digest.alias("digest"), "range").agg(F.first("from").alias("from"))
    again = F.row_number().over(Window.partitionBy("cell_id", "role", "digest").orderBy("range")) > 1
    known = texts.withColumn("again", again).filter("again").select("cell_id", "range", F.lit(1).alias("mark"), F.lit(None).cast("long").alias("turn"), "role", F.lit(None).cast("string").alias("text"), "digest")
    later = of_long.filter("range > `from`").select("cell_id", "range").distinct()
    later = later.select("cell_id", "range", F.lit(0).alias("mark"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"))
    plain = rows.select("cell_id", "range", F.lit(2).alias("mark"), "turn", "role", "text", F.lit(None).cast("binary").alias("digest"))
    met = later.unionByName(known).unionByName(plain)
    dealt = met.repartition("cell_id", "range").sortWithinPartitions("cell_id", "range", "mark", "turn", "role", "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, None, []
        for (cell, number), held in grouped_rows(batches, 2):
            if open_ is None or (cell, number) != now:
                if open_ is not None:
                    out.append(summary(now, open_))
                now, open_ = (cell, number), Range(first=held[0][2] != 0)
            for _, _, mark, turn_, role_, text, seen in held:
                if mark == 1:
                    open_.seen.add((role_, bytes(seen)))
                elif mark == 2:
                    open_.add(turn_, role_, text)
            if len(out) >= 1024:
                yield table_of(out, of_cell)
                out = []
        if open_ is not None:
            out.append(summary(now, open_))
        yield table_of(out, of_cell)

    judged_ddl = f"cell_id {kind}, range long, " + ", ".join(f"{c} long" for c in COUNTS)
    judged_ddl += ", least_turn long, most_turn long, first_initial string, last_initial string, ways array<struct<start:int,end:int,cost:long,edits:string>>"
    by_cell = dealt.mapInArrow(judge, judged_ddl).repartition("cell_id").sortWithinPartitions("cell_id", "range")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = [c.split()[0] for c in judged_ddl.split(", ")], []
        now, whole = None, None
        for (cell,), held in grouped_rows(batches, 1):
            if whole is None or cell != now:
                if whole is not None:
                    out += decisions(now, whole)
                now, whole = cell, Whole()
            for row in held:
                whole.add(dict(zip(names, row, strict=True)))
            if len(out) >= 4096:
                yield decided(out, of_cell)
                out = []
        if whole is not None:
            out += decisions(now, whole)
        yield decided(out, of_cell)

    decided_ddl = f"cell_id {kind}, range long, state int, audit string, " + ", ".join(f"{c} long" for c in SAID)
    plan = written(by_cell.mapInArrow(decide, decided_ddl), "dialogue-edits")
    audits = plan.filter("state is null").select("cell_id", *SAID[:-1], "cost", "audit")
    steps = plan.filter("state is not null").select("cell_id", "range", F.lit(0).alias("mark"), F.lit(None).cast("long").alias("turn"), F.col("state").cast("string").alias("role"), F.col("audit").alias("text"))
    own = rows.select("cell_id", "range", F.lit(2).alias("mark"), "turn", "role", "text")
    both = steps.unionByName(own).repartition("cell_id", "range").sortWithinPartitions("cell_id", "range", "mark", "turn", "role", "text")

    def carry_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, state, edits, at, now, size = [], 0, START, "", 0, None, 0

        def put(role_: str, text: str) -> None:
            nonlocal place, state, size
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role_[:1]]
            out.append((*now, place, role_, text))
            place, size = place + 1, size + len(text)

        def inserts() -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                put("assistant" if state == USER else "user", "")
                at += 1

        for (cell, number), held in grouped_rows(batches, 2):
            for row in held:
                _, _, mark, _, role_, text = row
                if mark == 0:
                    now, place, state, edits, at = (cell, number), 0, int(role_), text, 0
                    inserts()
                    continue
                letter, at = edits[at], at + 1
                if letter == "K":
                    put(role_, text)
                elif letter == "R":
                    put("assistant" if state == USER else "user", text)
                inserts()
                if size > 4 << 20:
                    yield rows_of(out, of_cell)
                    out, size = [], 0
        yield rows_of(out, of_cell)

    repaired = both.mapInArrow(carry_out, f"cell_id {kind}, range long, place long, role string, response_content string")
    return audits, repaired


SAID = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summary(key: tuple, own: Range) -> dict:
    ends = {"least_turn": own.least_turn, "most_turn": own.most_turn, "first_initial": own.first_initial, "last_initial": own.last_initial}
    return {"cell_id": key[0], "range": key[1]} | own.counts | ends | {"ways": own.table()}


def table_of(rows: list[dict], of_cell: pa.DataType) -> pa.RecordBatch:
    way = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    fields = [("cell_id", of_cell), ("range", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("least_turn", pa.int64()), ("most_turn", pa.int64())]
    fields += [("first_initial", pa.string()), ("last_initial", pa.string()), ("ways", pa.list_(way))]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def decisions(cell: object, whole: Whole) -> list[tuple]:
    """A row for each range, and one for the dialogue."""
    cost, steps = whole.best()
    c = whole.counts
    gaps = 0 if whole.least_turn is None else whole.most_turn - whole.least_turn + 1 - c["turns"]
    out = [(cell, number, state, edits, *[None] * len(SAID)) for number, state, edits in steps]
    return [*out, (cell, None, None, "".join(s[2] for s in steps), gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost)]


def decided(rows: list[tuple], of_cell: pa.DataType) -> pa.RecordBatch:
    fields = [("cell_id", of_cell), ("range", pa.int64()), ("state", pa.int32()), ("audit", pa.string()), *[(c, pa.int64()) for c in SAID]]
    return columns_of(rows, fields)


def rows_of(rows: list[tuple], of_cell: pa.DataType) -> pa.RecordBatch:
    return columns_of(rows, [("cell_id", of_cell), ("range", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("response_content", pa.string())])


def columns_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def dialogue_digests(repaired: DataFrame) -> DataFrame:
    """(cell_id, repaired_sha256) of each dialogue with a row: its `role:text` lines, joined
    by line feeds. A digest is made in order, so one task reads a dialogue, a row at a time."""
    kind, of_cell = key_type(repaired, "cell_id"), to_arrow_type(repaired.schema["cell_id"].dataType)
    ordered = repaired.repartition("cell_id").sortWithinPartitions("cell_id", "range", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for (cell,), held in grouped_rows(batches, 1):
            if digest is None or cell != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, gap = cell, hashlib.sha256(), b""
            for row in held:
                digest.update(gap + f"{row[3]}:{row[4]}".encode())
                gap = b"\n"
            if len(out) >= 4096:
                yield columns_of(out, [("cell_id", of_cell), ("repaired_sha256", pa.string())])
                out = []
        if digest is not None:
            out.append((now, digest.hexdigest()))
        yield columns_of(out, [("cell_id", of_cell), ("repaired_sha256", pa.string())])

    return ordered.mapInArrow(run, f"cell_id {kind}, repaired_sha256 string")

