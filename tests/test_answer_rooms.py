"""The whole chain from stored messages to final texts, with models that show what they were asked."""

import json

from pyspark.sql import functions as F

from ragspark.operators import graph as G
from ragspark.plans import flows
from ragspark.sources import graph_store


def test_messages_to_final_texts(spark, tmp_path):
    def analyst():
        def call(prompts):
            out = []
            for p in prompts:
                if p.startswith("Summarise"):
                    out.append("summary of " + str(p.count("\n")) + " lines")
                elif "unclear" in p:
                    out.append(json.dumps({"is_clear": False, "clarification_message": "which one?"}))
                elif "two things" in p:
                    assert "summary of" in p
                    out.append(json.dumps({"is_clear": True, "rewritten_questions": ["zebra stripes", "Ada wrote what"]}))
                else:
                    out.append("")
            return out

        return call

    def model():
        return lambda prompts: [("MERGED " if p.startswith("Merge") else "ONE ") + " ".join(w for w in ("zebra", "lovelace", "Ada", "KNOWS") if w in p) for p in prompts]

    at = F.lit("2024-01-01").cast("timestamp")
    chunks = [("a", "c1", "zebra stripes are black", "zoo.md", 1), ("a", "c2", "nothing here", "other.md", 2), ("b", "c3", "lovelace engine notes", "eng.md", 3)]
    rows = spark.createDataFrame(chunks, "invoke_id string, id string, content string, source string, page int").withColumn("written_at", at)
    flows.index_chunks(rows, f"{tmp_path}/index", 0)
    found = json.dumps({"entities": [{"name": n, "type": "P", "description": ""} for n in ("Ada", "Byron")], "relationships": [{"source": "Ada", "target": "Byron", "type": "knows", "description": "d"}]})
    facts = spark.createDataFrame([("a", "f", 1, found)], "invoke_id string, source string, chunk_no long, json string")
    graph_store.append_facts(facts.withColumn("graph", G.parse_graph(F.col("json"))), f"{tmp_path}/graph", 0)
    messages = spark.createDataFrame(
        [("a", 1, "user", "hello"), ("a", 2, "assistant", "hi"), ("a", 3, "user", "two things please"), ("b", 1, "user", "lovelace engine"), ("c", 1, "user", "unclear"), ("d", 1, "user", "no such words")],
        "invoke_id string, seq long, role string, content string",
    )
    texts, references, waiting = flows.answer_rooms(spark, messages, f"{tmp_path}/index", f"{tmp_path}/graph", analyst, model, k=2, min_score=1.9)
    got = {r.thread_id: (r.n_answers, r.text) for r in texts.collect()}
    assert got["a"][0] == 2 and got["a"][1].startswith("MERGED ") and "zebra" in got["a"][1] and "Ada" in got["a"][1]
    assert got["b"] == (1, "ONE lovelace") and got["d"][0] == 1 and not got["d"][1].startswith("ONE") and set(got) == {"a", "b", "d"}
    assert {(r.thread_id, r.source, r.page) for r in references.collect()} == {("a", "zoo.md", 1), ("b", "eng.md", 3)}
    assert [(r.thread_id, r.clarification) for r in waiting.select("thread_id", "clarification").collect()] == [("c", "which one?")]
