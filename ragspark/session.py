"""Session settings and the shared scratch folder."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(app="ragspark", cpus="*", partitions=8, memory="8g"):
    """A session for tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark, name):
    """A new folder below ``spark.checkpoint.dir``.

    The cluster names that setting. Only a local master may go without it and gets a temporary folder: elsewhere each
    executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df):
    """Use every core on an input of few files; an input with enough partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes that opening a file counts as where files are small: about what a task reads in the meantime.
OPEN_COST = 1 << 16
#: Rows that go to Python at once where they are whole texts or their vectors, fewer than Spark's default.
BATCH_ROWS = 2_000


def small_batches(spark):
    """Let Spark hand at most BATCH_ROWS rows to Python at once, in this session."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


@contextmanager
def small_files(spark):
    """Within it, tasks that read files take as many small ones as come to a split; Spark's default counts each as 4 MB at least, 32 a task."""
    setting = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(setting)
    if not before.isdigit() or int(before) > OPEN_COST:
        spark.conf.set(setting, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def saved(df, name, by=()):
    """Write ``df`` once to the shared folder and read it back; later uses neither recompute nor lose it."""
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
