import random

import numpy as np
import pytest
from plans_text import plan
from pyspark.sql import functions as F

from ragspark.operators import inference, retrieval as R
from ragspark.plans import flows


def matrix(rng, n, dim=8):
    v = rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


@pytest.fixture(scope="module")
def data(spark):
    """Two rooms; one holds most chunks. Ragged token counts, repeated chunks (ties), an empty one."""
    rng = np.random.default_rng(3)
    docs = [("hot" if i % 5 else "cold", f"d{i:03d}", matrix(rng, 1 + i % 4)) for i in range(120)]
    docs += [("hot", "tie-b", docs[1][2]), ("hot", "tie-a", docs[1][2]), ("hot", "empty", [])]
    queries = [("hot" if i % 3 else "cold", f"q{i}", matrix(rng, 2 + i % 3)) for i in range(12)] + [("none", "qx", matrix(rng, 2))]
    queries.append(("hot", "same", docs[1][2]))
    kind = "array<array<float>>"
    return (
        spark.createDataFrame(queries, f"invoke_id string, query_id string, q_vectors {kind}"),
        spark.createDataFrame(docs, f"invoke_id string, doc_id string, vectors {kind}").repartition(5),
        queries, docs,
    )


def brute(queries, docs, k):
    out = set()
    for room, q, qv in queries:
        scored = []
        for r, d, dv in docs:
            if r == room:
                products = np.array(qv, dtype=np.float64) @ np.array(dv, dtype=np.float64).reshape(-1, 8).T
                scored.append((-round(float(products.max(axis=1).sum()), 6) if dv else 0.0, d))
        for rank, (s, d) in enumerate(sorted(scored)[:k], 1):
            out.add((room, q, d, round(-s, 6) + 0.0, rank))
    return out


def rows(df):
    return {(r["invoke_id"], r["query_id"], r["doc_id"], r["score"] + 0.0, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 6, 500])
def test_both_routes_are_exact(data, k):
    q, c, queries, docs = data
    want = brute(queries, docs, k)
    assert rows(R.top_hits(q, c, k)) == want
    assert rows(R.top_hits(q, c, k, max_query_rows=3, chunks_per_block=7, queries_per_block=2)) == want
    assert rows(R.top_hits(q, c, k, max_query_tokens=3, chunks_per_block=10_000, queries_per_block=10_000)) == want


def test_small_matrices_give_the_same(data, monkeypatch):
    q_tokens = np.random.default_rng(1).normal(size=(7, 4))
    d_tokens = np.random.default_rng(2).normal(size=(50, 4))
    q_starts, d_starts = np.array([0, 3, 3, 7]), np.array([0, 10, 10, 11, 40, 50])
    whole = R._scores(q_tokens, q_starts, d_tokens, d_starts)
    monkeypatch.setattr(R, "MATRIX_CELLS", 8)
    assert (R._scores(q_tokens, q_starts, d_tokens, d_starts) == whole).all()


def test_default_k(data):
    q, c, *_ = data
    assert rows(R.top_hits(q, c, 0)) == rows(R.top_hits(q, c)) == rows(R.top_hits(q, c, 6))


def test_jvm_maxsim_agrees(spark, data):
    q, c, queries, docs = data
    both = q.join(c, "invoke_id").select("query_id", "doc_id", R.maxsim(F.col("q_vectors"), F.col("vectors")).alias("s"))
    want = {(b, d): s for _, b, d, s, _ in brute(queries, docs, 10_000) if d != "empty"}
    got = {(r["query_id"], r["doc_id"]): r["s"] for r in both.collect() if r["doc_id"] != "empty"}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 1e-6 for p in want)


def hits(spark, scored):
    return spark.createDataFrame(
        [("r", "q", d, float(s), i + 1) for i, (d, s) in enumerate(scored)],
        "invoke_id string, query_id string, doc_id string, score double, rank int",
    )


def stored(spark, docs):
    return spark.createDataFrame([("r", *d) for d in docs], "invoke_id string, doc_id string, content string, source string, page int")


def test_evidence_rules(spark):
    long = "x" * 300
    h = hits(spark, [("a", 20), ("b", 17.0), ("c", 16.99), ("gone", 18), ("dup", 17.5), ("d", 17.2)])
    s = stored(spark, [("a", f" {long}1", "one.pdf", 1), ("b", "bb", "two.pdf", 2), ("c", "cc", "one.pdf", 3), ("dup", f"{long}2 ", "one.pdf", 4), ("d", "dd", "one.pdf", 1)])
    kept = {r["doc_id"] for r in R.evidence(h, s).collect()}
    assert kept == {"a", "b", "gone", "d"}  # 16.99 fails, dup repeats a's opening, unknown text stays
    assert {r["doc_id"] for r in R.evidence(h, s, file="one").collect()} == {"a", "d"}
    assert {r["doc_id"] for r in R.evidence(h, s, file="one.pdf and more").collect()} == {"a", "d"}
    gone = R.attach_metadata(h, s).where("doc_id = 'gone'").first()
    assert (gone["content"], gone["source"], gone["page"]) == ("", "unknown", 0)


def test_context_and_references(spark):
    h = R.evidence(hits(spark, [("a", 20), ("b", 19), ("c", 18)]), stored(spark, [("a", " A ", "f", 1), ("b", "B", "g", 2), ("c", "C", "f", 1)]))
    queries = spark.createDataFrame([("r", "q"), ("r", "none")], "invoke_id string, query_id string")
    got = {r["query_id"]: r for r in R.assemble_context(h, queries).collect()}
    assert got["q"]["context"] == (
        '<documents>\n<document source="f" page="1">\nA\n</document>\n<document source="g" page="2">\nB\n</document>\n'
        '<document source="f" page="1">\nC\n</document>\n</documents>'
    )
    assert [(r["source"], r["page"]) for r in got["q"]["references"]] == [("f", 1), ("g", 2)]
    assert got["none"]["context"] is None and got["none"]["references"] == []


def test_plan_scores_once_and_limits_early(spark, data):
    q, c, *_ = data
    text = c.select("invoke_id", "doc_id", F.lit("t").alias("content"), F.lit("s").alias("source"), F.lit(1).alias("page"))
    df = R.assemble_context(R.evidence(R.top_hits(q, c), text, 0.0), q)
    df.collect()
    final = plan(df)
    assert final.count("MapInArrow") == 1
    assert "WindowGroupLimit" in final
    assert "CartesianProduct" not in final and "NestedLoop" not in final


def test_search_from_text(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rng = random.Random(2)
    docs = [("r", f"c{i}", " ".join(rng.sample(words, 4)), f"f{i}", 1) for i in range(20)] + [("r", "hit", "zeta eta theta", "fz", 9)]
    chunks = spark.createDataFrame(docs, "invoke_id string, id string, content string, source string, page int")
    asked = spark.createDataFrame([("r", "q", "zeta theta")], "invoke_id string, query_id string, question string")
    row = flows.search_text(asked, chunks, k=1, min_score=1.9).first()
    assert [(r["source"], r["page"]) for r in row["references"]] == [("fz", 9)]


def test_encode_with_a_model_raises_and_keeps_raggedness(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "content string")

    def factory():
        return lambda texts: [[[1.0, 0.0]] * len(t.split()) for t in texts]

    out = inference.encode(df, factory=factory)
    assert sorted(len(r["vectors"]) for r in out.collect()) == [1, 2]

    def broken():
        def call(texts):
            raise RuntimeError("down")

        return call

    with pytest.raises(Exception):
        inference.encode(df, factory=broken).collect()
    assert {r["answer"] for r in inference.complete(df, "content", factory=broken).collect()} == {""}


def test_blocks_of_a_large_room_grow(spark):
    rows = spark.range(10_000).selectExpr("if(id < 100, 'small', 'large') as invoke_id")
    assert dict(R._blocks(rows, 4, 256, "n").collect()) == {"small": 15, "large": 39}
    assert dict(R._blocks(rows, 1024, 1024, "n").collect()) == {"small": 1, "large": 10}
