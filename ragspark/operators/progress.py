"""Progress rows of batch runs."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.operators import skew
from ragspark.session import saved

D = S.DEFAULTS
# Percent and stage of the ingest and call-summary runs.
INGEST_STAGES = (
    (0, "start"), (5, "parse"), (10, "parsed"), (15, "keywords"), (20, "chunked"), (30, "index"), (90, "indexed"), (100, "done"),
)
SUMMARY_STAGES = (
    (0, "receiving"), (10, "receiving"), (15, "stt_start"), (25, "stt_processing"), (50, "stt_complete"),
    (55, "summary_start"), (70, "summary_processing"), (95, "summary_processing"), (100, "complete"),
)


def batch_progress(rows, key="source", position="seq", batch=D.graph_batch):
    """Percent after each batch of ``batch`` rows: 50 + int(done / total * 45).

    ``position`` counts a key's rows from 0, so the rows done after a batch follow from its number alone.
    """
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    batches = rows.groupBy(key, F.floor(F.col(position) / batch).alias("batch")).agg(F.count(F.lit(1)).alias("_n"))
    joined = skew.salted_join(
        batches, totals, [key], skew.hot_keys(totals, [key], "total"), spread=["batch"]
    )
    done = F.least((F.col("batch") + 1) * batch, F.col("total"))
    return joined.select(
        key, "batch", done.alias("done"), "total",
        (50 + F.floor(done / F.col("total") * 45)).cast("int").alias("percent"),
    )


EVENTS = "run_id string, step int, percent int, stage string, n_rows long, message string"


class Run:
    """The events of one run, told by its own jobs: a stage that has written rows carries their observed number.

    A run is a ``with`` block. Its events, one per stage and one for an error, are written as one batch when it ends, however it ends.
    """

    def __init__(self, spark, path, run_id, stages=INGEST_STAGES):
        self.spark, self.path, self.run_id = spark, path, run_id
        self.percent = {stage: percent for percent, stage in stages}
        self.events = []

    def reach(self, stage, n_rows=None, message=None):
        self.events.append((self.run_id, len(self.events), self.percent.get(stage, -1), stage, n_rows, message))

    def watched(self, write):
        """Calls ``write`` with a function that observes the rows passing through a frame; gives (result, their number).

        The frame should be the last one before rows are written, so that a repeated earlier stage counts nothing twice.
        """
        seen = Observation()
        result = write(lambda df: df.observe(seen, F.count(F.lit(1)).alias("rows")))
        return result, seen.get["rows"]

    def stored(self, before, after, df, name):
        """``df`` written to the shared folder between two stages, the second with the number of its rows."""
        self.reach(before)
        out, n = self.watched(lambda watch: saved(watch(df), name))
        self.reach(after, n)
        return out

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace):
        if error is not None:
            self.reach("error", message=str(error)[:1000])
        self.spark.createDataFrame(self.events, EVENTS).coalesce(1).write.mode("append").parquet(self.path)


def run_events(spark, path):
    return spark.read.schema(EVENTS).parquet(path)
