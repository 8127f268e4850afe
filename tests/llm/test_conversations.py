"""Conversation repair against all edits of small conversations, and against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from flowloom.llm import conversations, queries

SPACE = " \t\n\x0b\f\r"


def plain_rows(rows):
    """(turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2].encode()))


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def all_edits(rows, faults):
    """(cost, audit, lines) of every way to edit, with up to two inserted rows at each place."""
    inserted = [[], [("I", 2, "user", "")], [("I", 2, "assistant", "")], *([("I", 2, a, ""), ("I", 2, b, "")] for a, b in itertools.product(("user", "assistant"), repeat=2))]
    places = [inserted]
    for (_, role, text), fault in zip(rows, faults, strict=True):
        more = fault == "truncated"
        own = [[("D", 3, None, None)]]
        if fault not in ("blank", "duplicate"):
            own += [[("K", more, role, text)], *([("R", 2 + more, r, text)] for r in ("user", "assistant"))]
        places += [own, inserted]
    if len(places) > 5:  # a repeated row: one inserted row at each place is enough to be as cheap
        places = [p if p is not inserted else inserted[:3] for p in places]
    for ways in itertools.product(*places):
        steps = [s for w in ways for s in w]
        kept = [(r, t) for e, _, r, t in steps if e != "D"]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept)):
            yield sum(s[1] for s in steps), "".join(s[0] for s in steps), [f"{r}:{t}" for r, t in kept]


def plain_report(conv, rows):
    rows = plain_rows(rows)
    faults = plain_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = min(all_edits(rows, faults))
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_same_as_all_edits(spark):
    r = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        turn = r.choice((0, 0, 3, -2))
        for _ in range(r.randint(1, 3)):
            rows.append((conv, r.choice((turn, turn, turn, None)), r.choice(("user", "user", "assistant", "assistant", "system", "tool", "", "User", None)), r.choice(("Hi.", "What?", "no end", "no end \t", "é!\x0b", " \n", "", None, "a\nb.", "...")), "x"))
            turn += r.choice((1, 1, 1, 2, 0))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    want = [plain_report(conv, [x[:4] for x in rows if x[0] == conv]) for conv in {x[0] for x in rows}]
    got = conversations.repair_damaged(df.repartition(3))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert conversations.repair_damaged(df.where("false")).count() == 0


def drop_turn():
    return next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)


def test_nothing_left_and_repeated_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    gone = conversations.repair_damaged(spark.createDataFrame([(5, drop_turn(), "user", "Hi.")], kind)).collect()
    assert [tuple(r) for r in gone] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    rows = [(9, 1, "user", "Hi."), (9, 1, "user", "Hi."), (9, 2, "assistant", "Yes."), (9, 2, "assistant", "Yes.")]
    got = conversations.repair_damaged(spark.createDataFrame(rows, kind)).collect()
    assert [tuple(r) for r in got] == [plain_report(9, rows)]


@pytest.mark.parametrize("seed", range(12))
def test_windows_give_the_same_edits(seed):
    r = random.Random(seed)
    rows = [(k, r.choice(("user", "assistant", "assistant", "system", "", "x")), f"t{k}", r.choice((None, None, "truncated", "blank", "duplicate"))) for k in range(r.randint(1, 120))]
    if seed % 3 == 0:
        rows += [(k, "user", "", "blank") for k in range(200)] + rows[:50]
    whole = conversations.Repair(window=10_000)
    want = list(whole.steps(rows))
    for window, chars in ((1, 1 << 20), (7, 1 << 20), (64, 1 << 20), (50, 9)):
        parts = conversations.Repair(window, chars)
        assert list(parts.steps(rows)) == want
        assert (parts.cost, "".join(parts.audit)) == (whole.cost, "".join(whole.audit))


def test_rows_of_repaired_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "Well?"), (2, 0, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.repaired(conversations.faulted(conversations.undamaged(df))).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in got] == [(1, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (1, "R", "assistant", "Well?"), (2, "I", "user", ""), (2, "K", "assistant", "Yes.")]


def test_very_long_conversation_and_text(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"), F.expr("if(id = 7, repeat('long text ', 300000), concat('Text ', id, '.'))").alias("text"))
    (got,) = conversations.repair_damaged(df).collect()
    kinds = [zlib.crc32(f"1:{t}".encode()) % 20 for t in range(20_000)]
    assert got.blank == kinds.count(1)
    assert got.duplicate == kinds.count(3)
    assert len(got.audit.replace("I", "")) == 20_000 - kinds.count(0) + kinds.count(3)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_same_as_sql(spark, scale):
    data = f"/root/testdata/{scale}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    got = queries.QUERIES["op13_conversation_repair"](spark, data)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op13_conversation_repair']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
