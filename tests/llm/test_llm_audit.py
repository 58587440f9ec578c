"""Source divergence against SQL over every term and pair."""

import random

import pytest
from pyspark.sql import functions as F

from ragspark.llm import audit
from test_llm_mixing import by_sql


@pytest.mark.parametrize("frame", ["docs", "odd", "none", "sources"])
def test_divergence_equals_sql(request, spark, frame, monkeypatch):
    query = audit.SQL
    if frame == "sources":
        monkeypatch.setattr(audit, "HELD_TERMS", 50)
        monkeypatch.setattr(audit, "ENTRIES", 40)
        monkeypatch.setattr(audit, "TEXTS_PER_TASK", 40)
        rng = random.Random(4)
        words = ["Alpha", "beta", "GAMMA", "délta", "ÉPSILON", "日本", "zeta9x", "a-b", "rare"]
        texts = [" ".join(rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 2, 0.05], k=rng.randint(0, 12))) for _ in range(120)] + [None, "", "!!", "beta " * 30_000]
        rows = [(d, rng.choice(texts), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s4", None, ""]), 0, 0, "x") for d in range(600)]
        rows += [(1, "beta gamma", "fr", "only", 0, 0, "x")] * 40 + [(2, None, "en", "bare", 0, 0, "x"), (3, "few words", "xx", "p", 0, 0, "x"), (4, "few words", "xx", "q", 0, 0, "x")]
        rows = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, p long, term string")
    else:
        rows = request.getfixturevalue(frame)
    if frame == "odd":
        monkeypatch.setattr(audit, "LEAST_DOCS", 2)
        query = query.replace(">= 30", ">= 2")
    got = audit.divergence(rows).collect()
    want = by_sql(rows.select("text", "lang", "source").toArrow(), query)
    assert sorted(map(tuple, got)) == sorted(want)
    assert frame == "none" or got


def test_texts_are_collapsed(spark):
    rows = spark.createDataFrame([(k, "same text", "en", f"s{k % 3}") for k in range(900)] + [(k, "same text", "de", "s0") for k in range(5)] + [(1, None, None, None), (2, "", "", "")], "doc_id long, text string, lang string, source string")
    out = {(r.lang, r.text): dict(zip(r.sources, r.copies)) for r in audit.collapsed(rows.repartition(7)).collect()}
    assert out == {("en", "same text"): {"s0": 300, "s1": 300, "s2": 300}, ("de", "same text"): {"s0": 5}, ("", ""): {"": 2}}
    assert audit.collapsed(rows).agg(F.count("*")).first()[0] == 3
