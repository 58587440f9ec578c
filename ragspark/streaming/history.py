"""Streaming conversation memory: append, trim, expire.

Two forms with one result. ``stream_history`` appends what every micro-batch brings, and readers trim: cheapest for logs that
are read rarely. ``stateful_history`` keeps the few live messages of every room as state, with a timer that ends a room's
state after its retention period: a micro-batch writes only the rooms that it touches, and readers never see old batches.
"""

import json

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.operators import memory

D = S.DEFAULTS


def pairs_to_messages(pairs):
    """Question/answer pairs (invoke_id, seq, user, assistant, written_at) as messages; empty answers are not kept."""
    both = F.array(
        F.struct(F.lit("user").alias("role"), F.col("user").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("assistant").alias("content")),
    )
    return pairs.where("assistant IS NOT NULL AND assistant <> ''").select(
        "invoke_id", "seq", "written_at", F.posexplode(both).alias("at", "m")
    ).select("invoke_id", (F.col("seq") * 2 + F.col("at")).alias("seq"), "m.role", "m.content", "written_at")


def stream_history(pairs, table, checkpoint, keep=2 * D.history_messages, trigger=None):
    """Start appending a stream of pairs to ``table``.

    Each micro-batch writes at most ``keep`` messages per room into its own folder (map tasks trim first, so a
    busy room costs no more than a quiet one); older messages are dropped when the table is read or compacted.
    """

    def write(batch, batch_id):
        trimmed = memory.trim_history(pairs_to_messages(batch), keep)
        trimmed.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_history(spark, table, as_of=None, keep=2 * D.history_messages, ttl_days=D.ttl_days):
    """Last ``keep`` messages of each room, no further back than its last silence of the retention period.

    A conversation that was silent for so long starts again from nothing, so what was said before never returns. With
    ``as_of``, rooms that have been silent since are left out.
    """
    kept = memory.last_run(memory.trim_history(spark.read.parquet(table).drop("batch"), keep), ttl_days)
    if as_of is None:
        return kept
    newest = F.max("written_at").over(W.partitionBy("invoke_id"))
    return memory.live_rows(kept.withColumn("_newest", newest), as_of, ttl_days, "_newest").drop("_newest")


def compact_history(spark, table, target, keep=2 * D.history_messages):
    """Rewrite the trimmed table into a new folder as batch 0."""
    read_history(spark, table, keep=keep).write.mode("overwrite").parquet(f"{target}/batch=0")


MESSAGES = "seq long, role string, content string, written_at timestamp"
ROOM = f"invoke_id string, {MESSAGES}"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A message within a room's state; times are microseconds.
STATE = "seq array<long>, role array<string>, content array<string>, at array<long>"
CHANGED = "invoke_id string, messages string"
DAY = 86_400_000_000


def remembered(messages, keep, ttl):
    """Of (seq, role, content, at) the newest ``keep``, in order, after their last silence of ``ttl`` or more."""
    kept = sorted(messages, key=lambda m: m[:2])[-keep:]
    for k in range(len(kept) - 1, 0, -1):
        if kept[k][3] >= kept[k - 1][3] + ttl:
            return kept[k:]
    return kept


def room_memory(keep, ttl_days):
    """The live messages of one room as its state: at most ``keep``, forgotten by a timer ``ttl_days`` after the last was written.

    Emits a room's messages as JSON whenever they change, and one without a value when they are forgotten. Rooms and their states go
    to Python and back in batches of many rooms.
    """
    ttl, names = int(ttl_days * DAY), ("seq", "role", "content", "at")

    def changed(key, messages):
        return pd.DataFrame({"invoke_id": [key[0]], "messages": [json.dumps(messages)]})

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            yield changed(key, [{}])
            return
        own = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            own = sorted(own + list(zip(*(frame[c].tolist() for c in names))), key=lambda m: m[:2])[-keep:]
        own = remembered(own, keep, ttl)
        state.update(tuple(map(list, zip(*own))))
        state.setTimeoutTimestamp((max(m[3] for m in own) + ttl) // 1000)
        yield changed(key, [dict(zip(names, m)) for m in own])

    return update


def stateful_history(pairs, table, checkpoint, keep=2 * D.history_messages, ttl_days=D.ttl_days, trigger=None):
    """Start keeping the live messages of every room of a stream of pairs; ``read_live_history`` shows them.

    Time is that of the messages. Rooms end when the newest message of the stream is the retention period ahead of the room's last and
    of the same length as lateness; messages that come still later are dropped. A micro-batch that is run again replaces its own folder.
    """
    spark = pairs.sparkSession
    late = pairs_to_messages(pairs.withWatermark("written_at", f"{int(ttl_days)} days"))
    rooms = late.withColumn("at", F.unix_micros("written_at")).groupBy("invoke_id").applyInPandasWithState(
        room_memory(keep, ttl_days), CHANGED, STATE, "update", "EventTimeTimeout"
    )
    one = F.explode(F.from_json("messages", "array<struct<seq:long,role:string,content:string,at:long>>")).alias("m")
    rooms = rooms.select("invoke_id", one).select("invoke_id", "m.seq", "m.role", "m.content", F.timestamp_micros("m.at").alias("written_at"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = rooms.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # a query takes its settings when it starts
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def read_live_history(spark, table, as_of=None, ttl_days=D.ttl_days):
    """Messages of the rooms as their state last stood; with ``as_of``, rooms that have been silent since are left out."""
    rows = spark.read.schema(f"{ROOM}, batch long").parquet(table)
    last = rows.groupBy("invoke_id").agg(F.max("batch").alias("batch"), F.max_by("written_at", F.struct("batch", "seq")).alias("_newest"))
    live = last if as_of is None else memory.live_rows(last, as_of, ttl_days, "_newest")
    return rows.join(live.select("invoke_id", "batch"), ["invoke_id", "batch"]).where("seq IS NOT NULL").drop("batch")
