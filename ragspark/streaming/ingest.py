"""Streaming ingestion: new documents are chunked and appended to a stored table."""

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.operators import chunking
from ragspark.sources import store

D = S.DEFAULTS
STORED = ("invoke_id", "id", "content", "source", "page", "written_at")


def chunk_rows(docs, written_at=None):
    """Stored chunk rows of one batch of documents (invoke_id, source, markdown)."""
    made = chunking.identify_chunks(chunking.chunk_text(chunking.split_pages(docs)))
    return made.withColumn("written_at", F.current_timestamp() if written_at is None else written_at).select(*STORED)


def stream_ingest(stream, table, checkpoint, progress=None, written_at=None, trigger=None):
    """Start the ingestion of a stream of documents.

    A micro-batch writes its own folder, so a replay after a failure leaves the same table; reading it keeps the
    newest row of each chunk. ``progress`` is a folder that gets one row per batch. A document whose markdown
    is blank adds no chunk and stops nothing.
    """

    def write(batch, batch_id):
        store.append_batch(chunk_rows(batch, written_at), table, batch_id)
        if progress:
            written = batch.sparkSession.read.parquet(f"{table}/batch={batch_id}")
            written.agg(F.count(F.lit(1)).alias("n_chunks")).select(
                F.lit(batch_id).alias("batch_id"), F.lit(100).alias("percent"), F.lit("done").alias("stage"), "n_chunks"
            ).write.mode("overwrite").parquet(f"{progress}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
