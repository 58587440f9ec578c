"""The stored vector index against the exact route."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plans_text import plan
from ragspark.operators import inference, packed, retrieval, vector_index
from ragspark.plans import flows


def test_packed_values():
    texts = [[[1, 2, 3], [4, 5, 6]], [], [[7, 8, 9]]]
    column = pa.array([b"x", *(packed.pack(t) for t in texts), None, packed.pack([[0, 1, 2]])], pa.binary())[1:]
    flat, starts = packed.matrices(column)
    assert starts.tolist() == [0, 2, 2, 3, 3, 4] and flat[2].tolist() == [7, 8, 9] and flat[3].tolist() == [0, 1, 2]
    assert packed.matrices(pa.array([], pa.binary()))[1].tolist() == [0] and len(packed.matrices(pa.array([None], pa.binary()))[0]) == 0


def gaussian(spark, n=600, dim=24):
    """Chunks of clustered vectors of an odd number of tokens each, and noisy copies of some as queries."""
    rng = np.random.default_rng(3)
    topics = rng.standard_normal((40, dim))
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    chunks = [(f"r{i % 3}", f"c{i}", bytearray(packed.pack(unit(topics[rng.integers(40, size=rng.integers(1, 30))] + 0.6 * rng.standard_normal(dim))))) for i in range(n)]
    chunks += [("r0", "empty", bytearray(packed.pack([]))), ("r0", "null", None)]
    queries = []
    for i in range(0, n, 7):
        own, _ = packed.matrices(pa.array([bytes(chunks[i][2])]))
        queries.append((chunks[i][0], f"q{i}", bytearray(packed.pack(unit(own[:8] + 0.1 * rng.standard_normal(dim))))))
    queries += [("r0", "none", bytearray(packed.pack([]))), ("nowhere", "q", queries[0][2])]
    return spark.createDataFrame(chunks, "invoke_id string, id string, vectors binary"), spark.createDataFrame(queries, "invoke_id string, query_id string, q_vectors binary")


def test_recall_against_exact(spark, monkeypatch):
    chunks, queries = gaussian(spark)
    book = vector_index.fit(chunks)
    table = vector_index.indexed(chunks, book).cache()
    exact = {(r.query_id, r.doc_id): r.score for r in retrieval.top_hits(queries, chunks.withColumnRenamed("id", "doc_id"), 5).where("query_id <> 'none'").collect()}
    assert exact
    for rows in (retrieval.QUERY_ROWS, 20):
        monkeypatch.setattr(retrieval, "QUERY_ROWS", rows)
        found = {(r.query_id, r.doc_id): r.score for r in vector_index.search(queries, table, book, 5, wide=10, near=4).where("query_id <> 'none'").collect()}
        both = set(found) & set(exact)
        assert len(both) >= 0.9 * len(exact) and len(found) == len(exact)
        assert all(abs(found[p] - exact[p]) < 1e-6 for p in both)


def test_codes_come_near_the_vectors(spark):
    chunks, _ = gaussian(spark, 200, 15)
    book = vector_index.fit(chunks, lists=64)
    row = vector_index.indexed(chunks, book).where("id = 'c5'").first()
    want, _ = packed.matrices(pa.array([bytes(row.vectors)]))
    got, starts = book.decode(pa.array([bytes(row.codes), None], pa.binary()))
    assert starts.tolist() == [0, len(want), len(want)] and np.abs(got - want).mean() < 0.05
    assert len(row.codes) == len(want) * 10


def test_index_is_stored_and_searched(spark, tmp_path):
    path = str(tmp_path / "index")
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    def rows(first, n):
        return spark.createDataFrame(
            [("r", f"id{i}", " ".join(rng.choices(words, k=30)), f"f{i}", i, 1) for i in range(first, first + n)],
            "invoke_id string, id string, content string, source string, page int, n long",
        ).withColumn("written_at", F.current_timestamp()).drop("n")

    flows.index_chunks(rows(0, 60), path, 0)
    flows.index_chunks(rows(60, 40).unionByName(rows(0, 1).withColumn("content", F.lit("needle haystack"))), path, 1)
    table, book = flows.load_index(spark, path)
    assert table.count() == 100 and len(book.centroids) > 10
    asked = spark.createDataFrame([("r", "q", "Needle, haystack!"), ("r", "blank", "--"), ("x", "q", "needle")], "invoke_id string, query_id string, question string")
    out = flows.search_index(spark, asked, path, k=2, min_score=1.9, room=None)
    got = {(r.invoke_id, r.query_id): [(x["source"], x["page"]) for x in r.references] for r in out.collect()}
    assert got == {("r", "q"): [("f0", 0)], ("r", "blank"): [], ("x", "q"): []}
    assert "MapInPandas" not in plan(out) and "_terms" not in plan(out)


def test_empty_index(spark, tmp_path):
    chunks = spark.createDataFrame([], "invoke_id string, id string, vectors binary")
    book = vector_index.fit(chunks)
    queries = inference.encode(spark.createDataFrame([("r", "q", "a b")], "invoke_id string, query_id string, t string"), "t", "q_vectors", True, None, True)
    assert vector_index.search(queries, vector_index.indexed(chunks, book), book).isEmpty()


def test_index_takes_less_disk_than_its_vectors(spark, tmp_path):
    """No step of building or searching the index, and none of the exact search, shuffles or stores all token vectors."""
    from ragspark.sources import store

    rng = random.Random(7)
    rows = [("r", f"id{i}", " ".join(f"w{rng.randrange(500)}" for _ in range(200)), "f", 1) for i in range(300)]
    chunks = spark.createDataFrame(rows, "invoke_id string, id string, content string, source string, page int").withColumn("written_at", F.current_timestamp())
    flows.index_chunks(chunks, str(tmp_path / "index"), 0)
    table, book = flows.load_index(spark, str(tmp_path / "index"))
    written = sum(p.stat().st_size for p in (tmp_path / "index").rglob("*.parquet"))
    assert "vectors" not in table.columns and written < 300 * 200 * 64 / 2
    assert "Exchange" not in plan(table.select("codes")).replace("BroadcastExchange", "")
    queries = inference.encode(spark.createDataFrame([("r", "q", rows[3][2])], "invoke_id string, query_id string, t string"), "t", "q_vectors", True, None, True)
    want = retrieval.top_hits(queries, inference.encode(store.latest_rows(chunks), as_packed=True).withColumnRenamed("id", "doc_id")).collect()
    assert sorted(vector_index.search(queries, table, book).collect()) == sorted(want) and want
    flows.index_chunks(chunks, str(tmp_path / "kept"), 0, keep_vectors=True)
    kept, book = flows.load_index(spark, str(tmp_path / "kept"))
    assert "vectors" in kept.columns and sorted(vector_index.search(queries, kept, book).collect()) == sorted(want)
