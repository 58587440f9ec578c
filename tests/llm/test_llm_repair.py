"""Conversation repair against plain searches over edits and against SQL."""

import random
import zlib
from itertools import product

import pytest

from ragspark.llm import repair as R
from test_llm_mixing import by_sql

#: Places in (s?(ua)+)?: nothing, after s, after u, after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def valid(edits, codes):
    """Cost of an edit string over rows, None where it is not allowed."""
    at, i, cost = 0, 0, 0
    for e in edits:
        due = "a" if at == 2 else "u"
        if e == "I":
            at, cost = STEP[at, due], cost + 3
            continue
        if i == len(codes):
            return None
        symbol, mark = codes[i]
        i += 1
        if e == "D":
            cost += 4
            continue
        if mark == "x" or (e == "K" and (at, symbol) not in STEP):
            return None
        at = STEP[at, symbol if e == "K" else due]
        cost += (e == "R") * 3 + (mark == "t") * 3
    return cost if i == len(codes) and at in (0, 3) else None


def every_edit(codes):
    best = None
    for n in range(len(codes), len(codes) + 4):
        for edits in product("DIKR", repeat=n):
            cost = valid(edits, codes)
            if cost is not None and (best is None or (cost, "".join(edits)) < best):
                best = (cost, "".join(edits))
    return best


def test_every_edit_string_is_beaten():
    rng = random.Random(1)
    assert R.repaired("") == (0, "")
    for _ in range(40):
        codes = [(rng.choice("suua?"), rng.choice("---tx")) for _ in range(rng.randint(1, 4))]
        assert R.repaired("".join(a + b for a, b in codes)) == every_edit(codes), codes


def least_path(codes):
    """The same by dynamic programming over places, for longer rows."""
    def reach(now):
        for _ in range(3):
            for at, (cost, audit) in list(now.items()):
                to = STEP[at, "a" if at == 2 else "u"]
                if to not in now or (cost + 3, audit + "I") < now[to]:
                    now[to] = (cost + 3, audit + "I")
        return now

    now = reach({0: (0, "")})
    for symbol, mark in codes:
        new = {}
        for at, (cost, audit) in now.items():
            extra = 3 if mark == "t" else 0
            ways = [(at, cost + 4, "D")]
            if mark != "x":
                ways += [(STEP[at, symbol], cost + extra, "K")] if (at, symbol) in STEP else []
                ways += [(STEP[at, "a" if at == 2 else "u"], cost + 3 + extra, "R")]
            for to, c, e in ways:
                if to not in new or (c, audit + e) < new[to]:
                    new[to] = (c, audit + e)
        now = reach(new)
    return min(now[at] for at in (0, 3) if at in now)


@pytest.mark.parametrize("slack", [R.SLACK, None])
def test_long_conversations(slack):
    rng = random.Random(2)
    for n in (10, 63, 64, 65, 300, 700):
        for symbols, marks in (("suua?", "---tx"), ("ua", "--"), ("u", "x"), ("s", "-t"), ("a", "-")):
            codes = [(rng.choice(symbols), rng.choice(marks)) for _ in range(n)]
            parse = R.Repair(R.automaton(), slack)
            for s, m in codes:
                parse.feed(s, m == "x", m == "t")
            assert parse.result() == least_path(codes)


def test_stacks_stay_few():
    parse = R.Repair(R.automaton())
    for k in range(20_000):
        parse.feed("ua?s"[k * k % 4], k % 7 == 0, k % 5 == 0)
    assert len(parse.nodes) < 20 and len(parse.tops) < 20 and all(len(a) < 5_000 for *_, a in parse.tops.values())


def keep_turn(conv, wanted):
    """A turn number whose row suffers the damage ``wanted``, from 0 on."""
    return next(t for t in range(1000) if zlib.crc32(f"{conv}:{t}".encode()) % 20 == wanted)


@pytest.mark.parametrize("frame", ["table", "odd", "random", "none"])
def test_repair_equals_sql(spark, frame):
    schema = "conv_id long, turn long, role string, text string, cost int, audit string, copy int"
    if frame == "table":
        rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    elif frame == "random":
        rng = random.Random(3)
        rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(["a b.", "x", "", " \t", None, "a b.", "end! \n", f"{c} {t}?", "é."]), 1, "x", 2) for c in range(150) for t in range(rng.randint(1, 14))]
        rows = spark.createDataFrame(rows, schema)
    else:
        long = "word " * 40_000
        rows = [
            (1, None, "user", "hi.", 0, "", 0), (1, None, "user", "hi.", 0, "", 0), (1, None, "assistant", long, 0, "", 0), (None, 1, "user", "no id?", 0, "", 0), (None, None, None, None, 0, "", 0),
            (2, keep_turn(2, 0), "user", "gone.", 0, "", 0), (3, 5, "user", "a.", 0, "", 0), (3, 5, "user", "a.", 0, "", 0), (3, 2**62, "assistant", "b. ", 0, "", 0), (4, keep_turn(4, 3), "system", "twice", 0, "", 0), (5, 7, "", "", 0, "", 0),
        ] + [(6, t, "user" if t % 2 else "assistant", f"{t}.", 0, "", 0) for t in range(300)]
        rows = spark.createDataFrame(rows, schema)
        rows = rows.where("false") if frame == "none" else rows
    got = R.repair(R.damaged(rows)).collect()
    want = by_sql(rows.select("conv_id", "turn", "role", "text").toArrow(), R.SQL, "conversations")
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len(got) == rows.select("conv_id").distinct().count()
