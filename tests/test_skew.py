import random
from itertools import pairwise

from pyspark.sql import functions as F

from ragspark.operators import keywords, progress, skew, streamlog
from ragspark.sources import store


def test_salted_join_equals_the_plain_join(spark):
    rng = random.Random(0)
    left = spark.createDataFrame([(rng.choice(["hot"] * 5 + list("abc") + [None]), i) for i in range(500)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("a", 3), ("z", 4)], "k string, v int")
    hot = skew.hot_keys(skew.count_keys(left, ["k"]), ["k"], "_n", 20)
    assert hot.where("k = 'hot'").first()["_parts"] > 1
    for how in ("inner", "left"):
        got = skew.salted_join(left, right, ["k"], hot, how).collect()
        want = left.join(right, ["k"], how).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_carried_values_across_pieces(spark):
    rng = random.Random(3)
    rows = [(f, i, rng.choice([None, "p", "q"]), rng.randrange(9)) for f in ("hot", "b") for i in sorted(rng.sample(range(200), 80))]
    df = spark.createDataFrame(rows, "f string, i long, s string, v int").withColumn("piece", F.floor(F.col("i") / 7))
    got = {(r["f"], r["i"]): r for r in skew.with_carried(df, ["f"], "piece", "i", ["v"], ["s"]).collect()}
    assert len(got) == len(rows)
    for f in ("hot", "b"):
        mine = [r for r in rows if r[0] == f]
        first = got[(f, mine[0][1])]
        assert not first["has_prev"] and first["last_s"] is None
        seen = mine[0][2]
        for before, now in pairwise(mine):
            r = got[(f, now[1])]
            assert r["has_prev"] and r["prev_v"] == before[3] and r["last_s"] == seen
            seen = now[2] or seen


def test_keywords_with_hot_terms(spark):
    rows = [("r", str(i), f"common common word{i % 4} only{i}") for i in range(40)] + [("r", "blank", "..."), ("s", "x", "common")]
    df = spark.createDataFrame(rows, "invoke_id string, id string, text string")
    plain = {r["id"]: r["keywords"] for r in keywords.tfidf_keywords(df, 2).collect()}
    for bounds in ({"task_terms": 0}, {"task_terms": 0, "max_broadcast_rows": 0, "rows_per_task": 3}):
        assert plain == {r["id"]: r["keywords"] for r in keywords.tfidf_keywords(df, 2, **bounds).collect()}
    nowhere = df.limit(3).unionByName(df.limit(1).withColumns({"invoke_id": F.lit(None).cast("string"), "id": F.lit("null room")}))
    for bounds in ({}, {"task_terms": 0}):
        assert {r["id"]: r["keywords"] for r in keywords.tfidf_keywords(nowhere, 2, **bounds).collect()}["null room"] == ""
    assert plain["5"] == "only5, word1" and plain["blank"] == ""


def test_upsert_is_idempotent(spark):
    kind = "invoke_id string, id string, content string, written_at int"
    old = spark.createDataFrame([("r", "1", "a", 1), ("r", "2", "b", 1), ("s", "1", "c", 1)], kind)
    new = spark.createDataFrame([("r", "1", "x", 2), ("r", "1", "y", 3), ("r", "9", "z", 2)], kind)
    once = store.upsert(old, new)
    want = {("r", "1", "y"), ("r", "2", "b"), ("s", "1", "c"), ("r", "9", "z")}
    for df in (once, store.upsert(once, new)):
        assert {(r["invoke_id"], r["id"], r["content"]) for r in df.collect()} == want
        assert df.count() == 4
    assert store.upsert(old, new.limit(0)).count() == 3


def test_store_round_trip_and_room_pruning(spark, tmp_path):
    path = str(tmp_path / "chunks")
    kind = "invoke_id string, id string, content string, written_at int"
    assert store.load_rows(spark, path, schema=kind).count() == 0
    store.append_batch(spark.createDataFrame([("1", "a", "x", 1), ("2", "a", "y", 1)], kind), path, 0)
    store.append_batch(spark.createDataFrame([("1", "a", "z", 2)], kind), path, 1)
    store.append_batch(spark.createDataFrame([("1", "a", "z", 2)], kind), path, 1)  # a retried write
    odd = ("007", "1e3", "2024-01-01", "7")
    store.append_batch(spark.createDataFrame([(r, "r", t, n) for r in odd for t, n in ((r, 1), ("older", 0))], kind), path, 2)
    assert {(r["invoke_id"], r["content"]) for r in store.load_rows(spark, path).where("id = 'r'").collect()} == {(r, r) for r in odd}
    rows = store.load_rows(spark, path).where("id <> 'r'")
    assert {(r["invoke_id"], r["content"]) for r in rows.collect()} == {("1", "z"), ("2", "y")}
    one = store.load_rows(spark, path, only="1")
    text = one._jdf.queryExecution().toString()
    assert one.count() == 1 and "bucket" in text.split("PartitionFilters: [")[-1].split("]")[0]
    store.compact_rows(spark, path, f"{path}-small")
    assert store.load_rows(spark, f"{path}-small").where("id <> 'r'").exceptAll(rows).count() == 0
    kept, gone = store.delete_room(rows, "1")
    assert kept.count() == 1 and gone.count() == 1


def test_progress(spark):
    df = spark.createDataFrame([("f", i) for i in range(19)] + [("g", 0)], "source string, seq int")
    got = sorted((r["source"], r["batch"], r["done"], r["percent"]) for r in progress.batch_progress(df).collect())
    assert got == [("f", 0, 8, 68), ("f", 1, 16, 87), ("f", 2, 19, 95), ("g", 0, 1, 95)]


def test_deltas_stay_one_text(spark):
    rows = [("r", 65_530 + i, False, str(i % 10), None) for i in range(10)] + [("r", 65_540, True, None, None), ("r", 65_541, False, "late", None)]
    df = spark.createDataFrame(rows, "request_id string, seq long, done boolean, delta string, answer string")
    assert [r["text"] for r in streamlog.concat_deltas(df).collect()] == ["0123456789"]


def test_keywords_of_many_terms_are_scored_where_the_chunks_lie(spark):
    """A vocabulary of more than half a million terms: no chunk and no term of a chunk is shuffled."""
    from plans_text import plan

    words = F.transform(F.sequence(F.lit(0), F.lit(599)), lambda i: F.concat(F.lit("t"), (F.col("id") % 1000 * 600 + i).cast("string")))
    made = spark.range(2000).select(F.lit("r").alias("invoke_id"), F.col("id").cast("string").alias("id"), F.array_join(words, " ").alias("text"))
    odd = spark.createDataFrame([("r", "x", "zz zz Zz aa"), (None, "n", "a b"), ("s", "e", "--"), ("s", "o", "é 漢字 b")], "invoke_id string, id string, text string")
    out = keywords.tfidf_keywords(made.union(odd), 2)
    assert "Exchange" not in plan(out)
    got = {r["id"]: r["keywords"] for r in out.collect()}
    assert got["x"] == "zz, aa" and got["n"] == got["e"] == "" and got["o"] == "b, é" and got["5"] == "t3000, t3001" and len(got) == 2004
