"""Streaming response logs: decode each micro-batch and keep its records, fold them when read."""

from ragspark.operators import streamlog


def stream_chat_log(lines, table, checkpoint, trigger=None):
    """Start decoding a stream of lines (request_id, seq, line) into ``table``.

    A request may span micro-batches, so the records are stored decoded and folded by ``answers``.
    """

    def write(batch, batch_id):
        streamlog.decode_sse(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def answers(spark, table):
    """Text of each request from everything decoded so far."""
    return streamlog.concat_deltas(spark.read.parquet(table).drop("batch"))
