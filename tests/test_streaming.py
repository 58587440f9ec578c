import json
import time

import pandas as pd
from pyspark.sql import functions as F

from ragspark.operators import memory, streamlog
from ragspark.sources import store
from ragspark.streaming import chatlog, history, ingest
from ragspark.streaming.progress import ProgressListener



def stamp():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def slices(df, path, n):
    for i in range(n):
        df.where(F.pmod(F.hash(*df.columns), F.lit(n)) == i).write.mode("append").parquet(path)


def source(spark, path, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_ingest_equals_batch_across_triggers_and_a_restart(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("lang").alias("invoke_id"), "source", F.col("text").alias("markdown")
    )
    base = str(tmp_path)
    slices(docs.where("invoke_id <> 'en'"), f"{base}/in", 2)

    def start(per_trigger):
        stream = source(spark, f"{base}/in", docs.schema, per_trigger)
        finish(ingest.stream_ingest(stream, f"{base}/table", f"{base}/checkpoint", f"{base}/progress", stamp()))

    start(1)
    slices(docs.where("invoke_id = 'en'").union(spark.createDataFrame([("en", "blank", " ")], docs.schema)), f"{base}/in", 2)
    start(5)
    got = store.load_rows(spark, f"{base}/table").select(*ingest.STORED)
    want = store.latest_rows(ingest.chunk_rows(docs, stamp()))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
    steps = spark.read.parquet(f"{base}/progress")
    assert steps.where("stage = 'done' AND percent = 100").count() == steps.count() >= 3


def test_history_equals_batch(spark, tmp_path):
    pairs = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.when(F.col("event_id") % 2 == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string")).alias("invoke_id"),
        F.col("event_id").alias("seq"), F.col("event_type").alias("user"),
        F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("props")).alias("assistant"), F.col("ts").alias("written_at"),
    )
    base = str(tmp_path)
    slices(pairs, f"{base}/in", 3)
    finish(history.stream_history(source(spark, f"{base}/in", pairs.schema), f"{base}/table", f"{base}/checkpoint"))
    got = history.read_history(spark, f"{base}/table")
    want = memory.trim_history(history.pairs_to_messages(pairs))
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    history.compact_history(spark, f"{base}/table", f"{base}/small")
    assert spark.read.parquet(f"{base}/small").count() == want.count()
    assert history.read_history(spark, f"{base}/table", F.lit("2030-01-01").cast("timestamp")).count() == 0


def test_chat_log_equals_batch(spark, tmp_path):
    rows = [(r, s, 'data: {"choices":[{"delta":{"content":"%s"}}]}' % (s % 10)) for r in ("a", "b") for s in range(30)]
    rows += [("a", 12, "data: [DONE]"), ("b", 5, "data: {broken"), ("b", 6, ": note")]
    lines = spark.createDataFrame(rows, "request_id string, seq long, line string")
    base = str(tmp_path)
    slices(lines, f"{base}/in", 3)
    finish(chatlog.stream_chat_log(source(spark, f"{base}/in", lines.schema), f"{base}/table", f"{base}/checkpoint"))
    got = {(r["request_id"], r["text"]) for r in chatlog.answers(spark, f"{base}/table").collect()}
    want = {(r["request_id"], r["text"]) for r in streamlog.concat_deltas(streamlog.decode_sse(lines)).collect()}
    assert got == want and ("a", "012345678901") in got


def test_progress_listener(spark, tmp_path):
    listener = ProgressListener(spark, f"{tmp_path}/events")
    spark.streams.addListener(listener)
    df = spark.range(5).withColumn("line", F.lit("data: [DONE]")).withColumnsRenamed({"id": "seq"}).withColumn("request_id", F.lit("x"))
    df.write.parquet(f"{tmp_path}/in")
    finish(chatlog.stream_chat_log(source(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/t", f"{tmp_path}/c"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for _ in range(100):
        if listener.last is not None:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert {r["stage"] for r in listener.events().collect()} == {"start", "batch", "done"}
    assert len(listener.events().inputFiles()) == 1


def test_room_memory_equals_batch(spark, tmp_path):
    """Rooms that stay, end, restart after a silence or are busy, over five micro-batches and a restart."""
    day = lambda d: F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(86_400.0) * d)
    rows = [("busy", s, s / 40, "x") for s in range(400)] + [("ends", 1, 0.5, "a"), ("ends", 2, 0.9, "b"), ("back", 3, 0.2, "old"), ("back", 4, 8.0, "new"), ("back", 5, 9.5, "newer"), ("mute", 6, 9.0, "")]
    pairs = spark.createDataFrame(rows, "invoke_id string, seq long, d double, assistant string").withColumns({"user": F.concat(F.lit("q"), F.col("seq").cast("string")), "written_at": day(F.col("d"))})
    base = str(tmp_path)
    kind = pairs.drop("d").schema

    def feed(part):
        pairs.where(F.floor(F.col("d") / 2) == part).drop("d").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def start():
        finish(history.stateful_history(source(spark, f"{base}/in", kind), f"{base}/table", f"{base}/checkpoint", ttl_days=2))

    before = spark.conf.get(history.STATE_STORE, None)
    for part in range(3):
        feed(part)
    start()
    early = {r.invoke_id for r in history.read_live_history(spark, f"{base}/table").collect()}
    for part in (3, 4):
        feed(part)
    start()
    assert spark.conf.get(history.STATE_STORE, None) == before
    got = history.read_live_history(spark, f"{base}/table", day(F.lit(10.0)), 2)
    want = memory.last_run(memory.trim_history(history.pairs_to_messages(pairs)), 2)
    newest = want.groupBy("invoke_id").agg(F.max("written_at").alias("_newest"))
    want = memory.live_rows(want.join(newest, "invoke_id"), day(F.lit(10.0)), 2, "_newest").select(*got.columns)
    assert got.count() == want.count() == 14 and got.exceptAll(want).isEmpty()
    assert early == {"busy"} and {r.invoke_id for r in history.read_live_history(spark, f"{base}/table").collect()} == {"busy", "back"}
    gone = spark.read.parquet(f"{base}/table").where("seq IS NULL")
    assert {r.invoke_id for r in gone.collect()} >= {"ends"}
    sizes = spark.read.parquet(f"{base}/table").groupBy("batch", "invoke_id").count()
    assert sizes.agg(F.max("count")).first()[0] <= 10


def test_tables_in_one_file_or_in_a_folder_are_streamed(spark, tmp_path):
    from ragspark.catalog import stores

    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    small.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = store.latest_rows(ingest.chunk_rows(small.select(F.col("lang").alias("invoke_id"), "source", F.col("text").alias("markdown")), stores.stamp(stores.FIRST)))
    got = stores.streamed_chunks(spark, str(tmp_path))
    assert got.count() == want.count() > 0 and got.exceptAll(want.select(*got.columns)).isEmpty()
    assert stores.streamed_chunks(spark, "/root/testdata/sf0.001").count() > got.count()


def test_a_room_is_one_value_in_and_out():
    """A call gets a room's state and gives it back, without questions to the state store in between."""
    class State:
        exists, hasTimedOut, get, end = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, ms):
            self.end = ms

    call, state, day = history.room_memory(3, 2), State(), history.DAY
    frame = lambda *rows: pd.DataFrame(rows, columns=["seq", "role", "content", "at"])
    shown = lambda *frames: [[(m["seq"], m["content"]) for m in json.loads(f["messages"][0]) if m] for f in call(("r",), iter(frames), state)]
    assert shown(frame((2, "user", "b", day), (1, "user", "a", 0)), frame((3, "user", None, day), (4, "user", "d", day))) == [[(2, "b"), (3, None), (4, "d")]]
    assert state.end == 3 * day // 1000
    assert shown(frame((5, "user", "e", 3 * day))) == [[(5, "e")]]
    state.hasTimedOut = True
    assert shown() == [[]] and not state.exists
