"""Stored tables of rooms: upsert, load, delete.

A stored table is a folder of batches, each dealt into a fixed number of buckets by a hash of the room. Writing a batch
replaces a folder of the same batch number, so a retried write leaves the same data, and keeps the newest row of each
key; reading leaves out the rows that a later batch has rewritten. Room ids stay text.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark.operators import skew
from ragspark.session import saved

CHUNK_KEY = ("invoke_id", "id")
#: A property of the stored tables; readers and writers must agree.
BUCKETS = 64


def latest_rows(rows, key=CHUNK_KEY, newest="written_at", ties=()):
    return skew.latest(rows, list(key), F.desc(newest), *[F.desc(c) for c in ties])


def upsert(stored, new, key=CHUNK_KEY, newest="written_at", ties=()):
    """Stored rows without the new keys, plus the newest row of each new key.

    The stored side only meets the distinct new keys, which Spark broadcasts when they are few.
    """
    key = list(key)
    fresh = latest_rows(new, key, newest, ties)
    old = stored.join(new.select(*key).distinct(), key, "left_anti")
    return old.unionByName(fresh.select(*stored.columns))


def bucket_of(room):
    return F.pmod(F.xxhash64(room), F.lit(BUCKETS)).cast("int")


def append_batch(rows, path, batch, room="invoke_id", key=CHUNK_KEY, newest="written_at", watch=None, per_file=0):
    """Write the newest row of each key as one batch; a bucket is a folder, Spark splits large ones into files.

    ``watch`` may observe the rows as they are written (see ``progress.Run``). ``per_file`` bounds the rows of a file.
    """
    dealt = latest_rows(rows, key, newest).withColumn("bucket", bucket_of(F.col(room))).hint("rebalance", "bucket")
    dealt = watch(dealt) if watch else dealt
    write_batch(dealt, path, batch, per_file)


def write_batch(dealt, path, batch, per_file=0):
    """Write rows that are one of each key and have their ``bucket``, without a shuffle."""
    dealt.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("bucket").parquet(f"{path}/batch={int(batch)}")


def read_batch(spark, path, batch):
    """The rows of one batch as they were written, with their ``bucket``."""
    return spark.read.parquet(f"{path}/batch={int(batch)}")


def load_rows(spark, path, key=CHUNK_KEY, newest="written_at", room="invoke_id", schema=None, only=None):
    """Newest rows of a stored table; a missing table is empty if ``schema`` is given.

    ``only`` names one room and reads its bucket alone. Versions are ranked on keys and times; whole rows only meet the list
    of rewritten ones. That is stored first, so that its size is known: one that fits goes to every task.
    """
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    mine = F.lit(True) if only is None else F.col("bucket") == bucket_of(F.lit(only))
    if only is not None:
        rows = rows.where(mine & (F.col(room) == F.lit(only)))
    version = [*key, newest, "batch"]
    w = W.partitionBy(*key).orderBy(F.desc(newest), F.desc("batch"))
    ranked = rows.select(*version, "bucket").withColumn("_rn", F.row_number().over(w))
    old = saved(ranked.where("_rn > 1").drop("_rn"), "rewritten", ["bucket"]).where(mine)
    old = F.broadcast(old) if old.limit(skew.MAX_LOOKUP_ROWS + 1).count() <= skew.MAX_LOOKUP_ROWS else old
    same = [rows[c].eqNullSafe(old[c]) for c in version]
    return rows.join(old, same, "left_anti").drop("batch", "bucket")


def compact_rows(spark, path, target, key=CHUNK_KEY, newest="written_at", room="invoke_id"):
    """Rewrite the newest rows of a stored table as batch 0 of a new folder."""
    append_batch(load_rows(spark, path, key, newest, room), target, 0, room, key, newest)


def delete_room(stored, room, column="invoke_id"):
    """(remaining rows, removed rows) of one room, matched by equality."""
    mine = F.col(column) == F.lit(room)
    return stored.where(~mine | F.col(column).isNull()), stored.where(mine)


def write_results(summaries, path, fmt="parquet"):
    """Transcript, summary and duration in seconds to 2 decimals."""
    summaries.select(
        "transcript", "summary", F.round("duration_seconds", 2).alias("duration_seconds")
    ).write.mode("overwrite").format(fmt).save(path)
