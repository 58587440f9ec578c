"""Progress of running streams as rows of a table."""

from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql.streaming import StreamingQueryListener

COLUMNS = "run_id string, percent int, stage string, message string"


class ProgressListener(StreamingQueryListener):
    """Rows (run_id, percent, stage, message) of each query's events in the table at ``path``.

    The callback only keeps an event. Another thread writes them, ``every`` at a time and whenever a query ends, as one file.
    """

    def __init__(self, spark, path, every=100):
        self.spark, self.path, self.every = spark, path, every
        self.held, self.lock, self.writer, self.last = [], Lock(), ThreadPoolExecutor(1), None

    def _add(self, *event, write=False):
        with self.lock:
            self.held.append(event)
            if write or len(self.held) >= self.every:
                rows, self.held = self.held, []
                self.last = self.writer.submit(self._write, rows)

    def _write(self, rows):
        self.spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event):
        self._add(str(event.runId), 0, "start", event.name or "")

    def onQueryProgress(self, event):
        p = event.progress
        self._add(str(p.runId), 50, "batch", f"batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        failed = event.exception is not None
        self._add(str(event.runId), -1 if failed else 100, "error" if failed else "done", event.exception or "", write=True)

    def events(self):
        """What has been written; waits for writes that have begun and raises their errors."""
        if self.last is not None:
            self.last.result()
        return self.spark.read.schema(COLUMNS).parquet(self.path)
