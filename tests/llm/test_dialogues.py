import hashlib
import itertools
import random
import zlib

import pytest

from cloudgauge.llm import dialogues, queries
from cloudgauge.llm.dialogues import Edits, equal, reads_before

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Cost, edits and lines by comparing whole strings of edits; rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        held = text.strip(SPACE)
        faults.append("blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # by the last initial

    def inserted(best):
        best = dict(best)
        for _ in range(2):
            for last, (cost, edits, lines) in list(best.items()):
                new = "a" if last == "u" else "u"
                offer = (cost + 5, edits + "I", (*lines, ("assistant" if new == "a" else "user") + ":"))
                if new not in best or offer[:2] < best[new][:2]:
                    best[new] = offer
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for last, (cost, edits, lines) in inserted(best).items():
            offers = [(last, (cost + 2, edits + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                to = "a" if last == "u" else "u"
                offers.append((to, (cost + 1 + more, edits + "R", (*lines, ("assistant" if to == "a" else "user") + ":" + text))))
                if role[:1] == to or (role[:1] == "s" and last == ""):
                    offers.append((role[:1], (cost + more, edits + "K", (*lines, role + ":" + text))))
            for to, offer in offers:
                if to not in new or offer[:2] < new[to][:2]:
                    new[to] = offer
        best = new
    ends = [way for last, way in inserted(best).items() if last in ("", "a")]
    return min(ends, key=lambda w: w[:2]), faults


def plain(table):
    groups = {}
    for row in table:
        groups.setdefault(row[0], [])
    for row in damaged(table):
        groups[row[0]].append(row[1:])
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        (cost, audit, lines), faults = repaired(rows)
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answers(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_the_plain_version(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(queries.QUERIES["op13_audit_repair"](spark, sf_dir)) == plain(table)


SCHEMA = "conv_id long, turn long, role string, text string"


def odd_table(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", "  \t", "Why?", "Go on!", "and", None, "x " * 3000 + ".", "Éa."]
    roles = ["user", "assistant", "system", "tool", "", None, "usr"]
    out = [(c, rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for c in [None, 0, 1, 2, -5] for n in (1, 4, 30) for _ in range(n)]
    out += [(7, t, "assistant" if t % 2 else "user", f"{t // 3}.") for t in range(-40, 60)]
    return out + [out[3]] * 3 + [(9, 0, "user", "Hi.")] * 5


@pytest.mark.parametrize("range_turns", [1, 7, 256])
def test_odd_rows_in_ranges_of_any_length(spark, tmp_path, range_turns):
    table = odd_table()
    df = spark.createDataFrame([(*r, 1) for r in table], SCHEMA + ", range int")
    names = {"cell_id": "conv_id", "response_content": "text"}
    audits, rows = dialogues.repair_turns(dialogues.damage_turns(df, **names), range_turns, **names)
    digests = {r.cell_id: r.repaired_sha256 for r in dialogues.dialogue_digests(rows).collect()}
    got = {r.cell_id: (*(r[c] for c in COLUMNS[:-1]), digests.get(r.cell_id, hashlib.sha256(b"").hexdigest())) for r in audits.collect()}
    want = plain(table)
    there = {r[0] for r in damaged(table)}
    assert got == {k: v for k, v in want.items() if k in there}


def test_dialogues_without_rows_are_zeros(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert answers(queries.QUERIES["op13_audit_repair"](spark, str(tmp_path))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert answers(queries.QUERIES["op13_audit_repair"](spark, f"{tmp_path}/none")) == {}


def test_chains_read_in_the_order_of_their_letters():
    rng = random.Random(1)
    nodes = [Edits(None, "")]
    for _ in range(400):
        nodes.append(Edits(rng.choice(nodes[-30:]), rng.choice("DIKR")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert reads_before(a, b) == (a.text() < b.text())
        if a.length == b.length:
            assert equal(a, b) == (a.text() == b.text())


def test_equal_hashes_of_unlike_chains_are_found_out():
    root = Edits(None, "")
    a, b = Edits(Edits(root, "K"), "D"), Edits(Edits(root, "D"), "K")
    b.hash = a.hash
    b.parent.hash = a.parent.hash
    assert reads_before(b, a) and not reads_before(a, b)
