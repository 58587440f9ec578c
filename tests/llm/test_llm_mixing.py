"""Mixing to target weights against quotients listed one by one."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ragspark.llm import mixing


def by_sql(rows, query, name="documents"):
    con = duckdb.connect()
    con.register("rows_in", rows)
    con.execute(f"create view {name} as select * from rows_in")
    return con.execute(query).fetchall()


def highest_quotients(votes, most, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        _, i = min((-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, given, most)) if g < m)
        given[i] += 1
    return given


@pytest.mark.parametrize("frame", ["docs", "odd", "none", "sources"])
def test_mix_equals_sql(request, spark, frame, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_PART", 20)
    monkeypatch.setattr(mixing, "ROWS_PER_DIGITS", 30)
    if frame == "sources":
        rows = [(d, "w " * (d * 7 % 300), ["a", "b", None, "", "é", "zz"][min(d % 11, 5)]) for d in range(400)] + [(900, "w " * 40_000, "a"), (901, "w " * 17_000, "zz")]
        rows = spark.createDataFrame(rows, "doc_id long, text string, source string")
    else:
        rows = request.getfixturevalue(frame)
    got = mixing.mixed(rows).collect()
    want = by_sql(rows.select("doc_id", "text", "source").toArrow(), mixing.SQL)
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len(got) == rows.count() and all(0 <= r.taken <= 2 * r.size for r in got)


def test_sums_come_near_the_targets(docs):
    out = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id")
    per = out.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("own"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(r.size == r.own and abs(r.taken - r.target) <= 4 * mixing.BLOCK and r.target <= 2 * r.size for r in per)
    assert abs(sum(r.target for r in per) - 1.5 * sum(r.size for r in per)) < 1e-3


def test_seats_are_the_highest_quotients(spark):
    cases = [([53, 24, 23], 7), ([1, 1, 1, 1], 2), ([1000, 1, 1], 5), ([10, 9, 8, 7, 6, 5], 31), ([5], 3), ([3, 0, 2], 4), ([6, 6], 0)]
    rows = [(g, i, v, s) for g, (votes, s) in enumerate(cases) for i, v in enumerate(votes)]
    frame = spark.createDataFrame(rows, "g int, i int, v long, s long")
    got = mixing.apportion(frame, ["g"], "v", F.lit(1000), F.col("s"), ["i"]).collect()
    for g, (votes, seats) in enumerate(cases):
        assert [r.quota for r in sorted(got, key=lambda r: r.i) if r.g == g] == highest_quotients(votes, [1000] * len(votes), seats)


def test_plan_has_no_python(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
