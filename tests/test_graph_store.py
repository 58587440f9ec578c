"""The stored graph: several batches, repeated and compacted ones, and streams equal one build."""

import json
import random

from pyspark.sql import functions as F

from ragspark.operators import graph as G
from ragspark.sources import graph_store


def facts(spark, n=120, rooms="xy"):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(12)]
    rows = []
    for i in range(n):
        named = [{"name": rng.choice(names), "type": f"T{i}", "description": f"d{i}"} for _ in range(rng.randrange(3))]
        linked = [{"source": rng.choice(names), "target": rng.choice(names), "type": rng.choice(["r 1", "r_2", "no-type"]), "description": f"e{i}"} for _ in range(rng.randrange(4))]
        rows.append((rooms[i % len(rooms)], f"f{i % 5}", i, json.dumps({"entities": named, "relationships": linked})))
    rows.append(("x", None, n, "broken"))
    found = spark.createDataFrame(rows, "invoke_id string, source string, chunk_no long, json string")
    return found.withColumn("graph", G.parse_graph(F.col("json"))).drop("json")


def content(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


ENTITY, EDGE = ("invoke_id", "name", "type", "description", "source"), ("invoke_id", "src", "type", "dst", "description", "source")


def test_batches_equal_one_build(spark, tmp_path):
    rows = facts(spark).cache()
    want = G.build_graph(rows)
    path = str(tmp_path / "graph")
    for batch in (0, 1, 1, 2, 3, 0):
        graph_store.append_facts(rows.where(F.floor(F.col("chunk_no") / 31) == batch), path, batch)
    for strict in (True, False):
        entities, edges = graph_store.load_graph(spark, path, strict)
        whole = G.build_graph(rows, strict_order=strict)
        assert content(entities, *ENTITY) == content(want[0], *ENTITY)
        assert content(edges, *EDGE) == content(whole[1], *EDGE) and edges.count() > 0
    assert content(graph_store.load_graph(spark, path)[1], *EDGE) != content(graph_store.load_graph(spark, path, False)[1], *EDGE)
    entities, edges = graph_store.load_graph(spark, path, only="x")
    assert content(edges, *EDGE) == content(want[1].where("invoke_id = 'x'"), *EDGE)
    assert content(entities, *ENTITY) == content(want[0].where("invoke_id = 'x'"), *ENTITY)
    assert spark.read.parquet(f"{path}/rejected").count() == want[2].count() > 0
    graph_store.compact_graph(spark, path, f"{path}-small")
    more = facts(spark, 20).withColumn("source", F.lit("late"))
    for target in (path, f"{path}-small"):
        graph_store.append_facts(more, target, 9)
    for k, columns in ((0, ENTITY), (1, EDGE)):
        assert content(graph_store.load_graph(spark, path)[k], *columns) == content(graph_store.load_graph(spark, f"{path}-small")[k], *columns)


def test_a_late_end_does_not_revive_an_edge(spark, tmp_path):
    path = str(tmp_path / "graph")

    def batch(number, names, links):
        row = ("r", "f", 1, json.dumps({"entities": [{"name": n, "type": "T", "description": ""} for n in names], "relationships": [{"source": a, "target": b, "type": "t", "description": str(number)} for a, b in links]}))
        rows = spark.createDataFrame([row], "invoke_id string, source string, chunk_no long, json string")
        graph_store.append_facts(rows.withColumn("graph", G.parse_graph(F.col("json"))), path, number)
        return [(r.src, r.dst, r.description) for r in graph_store.load_graph(spark, path)[1].collect()]

    assert batch(0, ["a"], [("a", "b")]) == []
    assert batch(1, ["b"], []) == []
    assert batch(2, [], [("a", "b")]) == [("a", "b", "2")]


def test_stream_equals_build(spark, tmp_path):
    rows = facts(spark, 60)
    for k in range(3):
        rows.where(F.floor(F.col("chunk_no") / 20) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in").drop("part")
    query = graph_store.stream_facts(stream, f"{tmp_path}/graph", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    want = G.build_graph(rows.where("chunk_no < 60"))
    assert content(graph_store.load_graph(spark, f"{tmp_path}/graph")[1], *EDGE) == content(want[1], *EDGE)


def test_missing_table(spark, tmp_path):
    entities, edges = graph_store.load_graph(spark, f"{tmp_path}/none")
    assert entities.isEmpty() and edges.isEmpty()
