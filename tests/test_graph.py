import json
import random

from plans_text import plan
from pyspark.sql import functions as F

from ragspark.operators import graph as G
from ragspark.plans import flows


def entity(name, kind="T", text="d"):
    return {"name": name, "type": kind, "description": text}


def relation(a, b, kind="rel", text="d"):
    return {"source": a, "target": b, "type": kind, "description": text}


def build(spark, responses, strict=True):
    rows = [("r", f"f{i}", i, json.dumps(j) if isinstance(j, dict) else j) for i, j in enumerate(responses)]
    df = spark.createDataFrame(rows, "invoke_id string, source string, chunk_no long, json string")
    return G.build_graph(df.withColumn("graph", G.parse_graph(F.col("json"))), strict_order=strict)


def test_merge_rules(spark):
    e, d, bad = build(
        spark,
        [
            {"entities": [entity("a", "X", "first"), entity("b")], "relationships": [relation("a", "b", "works at", "one")]},
            {"entities": [entity("a", "Y", "second")], "relationships": [relation("a", "b", "WORKS AT", "two"), relation("a", "a")]},
        ],
    )
    a = e.where("name = 'a'").first()
    assert (a["type"], a["description"], a["source"]) == ("X", "first", "f1")
    got = {(r["src"], r["type"], r["dst"], r["description"], r["source"]) for r in d.collect()}
    assert got == {("a", "WORKS_AT", "b", "two", "f1"), ("a", "REL", "a", "d", "f1")}
    assert bad.count() == 0


def test_relation_needs_earlier_ends(spark):
    early = {"entities": [entity("a")], "relationships": [relation("a", "later"), relation("a", "nobody")]}
    later = {"entities": [entity("later")], "relationships": []}
    assert build(spark, [early, later])[1].count() == 0
    assert build(spark, [early, later], strict=False)[1].count() == 1
    assert build(spark, [early, later, early])[1].count() == 1


def test_invalid_answers_are_empty_and_bad_types_rejected(spark):
    lacking = {"entities": [{"name": "a", "type": "T"}], "relationships": []}
    odd = {"entities": [entity("p"), entity("q")], "relationships": [relation("p", "q", "is-a"), relation("p", "q", "2nd"), relation("p", "q")]}
    e, d, bad = build(spark, ["{broken", lacking, "", odd, {"entities": [entity("z")]}])
    assert {r["name"] for r in e.collect()} == {"p", "q"}
    assert {r["type"] for r in d.collect()} == {"REL"}
    assert {r["type"] for r in bad.collect()} == {"IS-A", "2ND"}


def tables(spark, entities, questions):
    e = spark.createDataFrame(entities, "invoke_id string, name string, source string")
    q = spark.createDataFrame(questions, "invoke_id string, question_id string, question string")
    return e, q


def test_matches_equal_a_nested_loop(spark):
    rng = random.Random(4)
    text = lambda lo, hi: "".join(rng.choice("abé ") for _ in range(rng.randrange(lo, hi)))
    entities = {(room, n): f"f{i % 3}.pdf" for i, (room, n) in enumerate({(rng.choice("xy"), text(0, 9)) for _ in range(60)})}
    long = "abc " * 40
    entities[("x", long + "tail")] = "f1.pdf"
    entities[("x", "bc " + long[:70])] = "f0.pdf"
    questions = [("x" if i % 2 else "y", f"q{i}", text(0, 14)) for i in range(60)]
    questions += [("x", "long", "zz " + long + "tail zz"), ("x", "part", long[:90]), ("x", "twin", questions[1][2])]
    e, q = tables(spark, [(r, n, s) for (r, n), s in entities.items()], questions)
    for file in (None, "f1"):
        want = {
            (qid, n)
            for room, qid, t in questions
            for (r, n), s in entities.items()
            if r == room and (t in n or (n in t and (file is None or file in s)))
        }
        for bounds in ({}, {"automaton_chars": 60, "block_chars": 90}):
            found = G.match_entities(q, e, file, **bounds)
            rows = [(r["question_id"], r["name"]) for r in found.collect()]
            assert set(rows) == want and len(rows) == len(want)
            for unwanted in ("NestedLoop", "Cartesian", "sequence(1"):
                assert unwanted not in plan(found)


def test_empty_and_missing_texts(spark):
    e, q = tables(spark, [("r", "", "f"), ("r", None, "f"), ("r", "abc", None), (None, "abc", "f")], [("r", "q1", "xabcx"), ("r", "q2", ""), ("r", "q3", None), (None, "q4", "abc"), ("s", "q5", "abc")])
    for bounds in ({}, {"automaton_chars": 1, "block_chars": 1}):
        got = sorted((r.question_id, r.name) for r in G.match_entities(q, e, **bounds).collect())
        assert got == [("q1", ""), ("q1", "abc"), ("q2", ""), ("q2", "abc")]
        assert {r.name for r in G.match_entities(q, e, "f", **bounds).where("question_id = 'q1'").collect()} == {""}
    assert G.match_entities(q.where("false"), e).isEmpty() and G.match_entities(q, e.where("false"), automaton_chars=0).isEmpty()


def test_neighbours_limit_and_context(spark):
    e, q = tables(spark, [("r", "hub", "f"), ("r", "alone", "f"), ("r", "selfy", "g")], [("r", "q1", "hub and alone"), ("r", "q2", "selfy"), ("r", "q3", "none")])
    edges = [("r", "hub", "R", f"n{i:02d}", "d", "f") for i in range(30)] + [("r", "selfy", "S", "selfy", "me", "g"), ("r", "in", "I", "selfy", "x", "g")]
    d = spark.createDataFrame(edges, "invoke_id string, src string, type string, dst string, description string, source string")
    matched = G.match_entities(q, e)
    expanded = G.expand_neighbors(matched, d)
    assert expanded.where("name = 'selfy'").count() == 2
    assert expanded.where("name = 'alone'").count() == 1
    got = {r["question_id"]: r["graph_context"] for r in G.graph_search(q, e, d).collect()}
    lines = got["q1"].split("\n")
    assert len(lines) == 19  # the isolated entity takes one of the 20 places and is then left out
    assert lines[0] == "(hub) -[R]-> (n00): d (Source: f)"
    assert got["q2"] == "(selfy) -[I]-> (in): x (Source: g)\n(selfy) -[S]-> (selfy): me (Source: g)"
    assert got["q3"] == ""
    same = G.graph_context(G.limit_graph(expanded), q)
    assert {r["question_id"]: r["graph_context"] for r in same.collect()} == got


def test_expansion_of_a_hub_is_spread(spark, monkeypatch):
    monkeypatch.setattr(G, "EXPANDED_ROWS", 100, raising=False)
    matched = spark.createDataFrame([("r", f"q{i}", "hub", "f") for i in range(60)] + [("r", "q0", "alone", "f")], "invoke_id string, question_id string, name string, source string")
    edges = spark.createDataFrame([("r", "hub", "R", f"n{i:02d}", "d", "f") for i in range(40)], "invoke_id string, src string, type string, dst string, description string, source string")
    got = G.expand_neighbors(matched, edges)
    assert got.columns == ["invoke_id", "name", "question_id", "source", "type", "neighbor", "description"]
    assert got.count() == got.distinct().count() == 60 * 40 + 1 and got.where("neighbor is null").count() == 1
    most = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most <= 600
    few = sorted(map(str, G.limited_neighbors(matched, edges, 7).collect()))
    assert few == sorted(map(str, G.limit_graph(got, 7).collect())) and len(few) == 60 * 7


def test_graph_from_keywords(spark):
    rows = [("r", "f", i, "b, a, c") for i in range(3)]
    chunks = spark.createDataFrame(rows, "invoke_id string, source string, chunk_no long, keywords string")
    entities, edges, _ = flows.build_graph(chunks)
    assert {r["name"] for r in entities.collect()} == {"a", "b", "c"}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_graph_from_a_model_asks_once_per_text(spark, tmp_path):
    calls = str(tmp_path)

    def factory():
        import json as j
        import pathlib
        import uuid

        def answer(t):
            named = [{"name": n, "type": "T", "description": ""} for n in ("a", t)]
            return j.dumps({"entities": named, "relationships": [{"source": "a", "target": t, "type": "x", "description": ""}]})

        def call(texts):
            pathlib.Path(calls, uuid.uuid4().hex).write_text(str(len(texts)))
            return [answer(t) for t in texts]

        return call

    chunks = spark.createDataFrame([("r", "f", i, f"t{i}") for i in range(5)], "invoke_id string, source string, chunk_no long, content string")
    entities, edges, _ = flows.build_graph(chunks, factory)
    assert {r["dst"] for r in edges.collect()} == {f"t{i}" for i in range(5)}
    assert entities.count() == 6
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 5
