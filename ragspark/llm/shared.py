"""Helpers that several operators of this package use."""

import pyarrow as pa
from pyspark.sql import functions as F

from ragspark.session import saved, small_batches

#: Most rows of narrow integers that a task gets as a broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark, folder, name):
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_mod(column, n):
    """crc32 of an id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def fits(df, rows=BROADCAST_ROWS):
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def narrow_join(left, right, on, how):
    """Join to narrow rows of a stored table: sent to every task if they are few, else shuffled."""
    return left.join(F.broadcast(right) if fits(right) else right, on, how)


def tasks_for(spark, size, each):
    """Partitions so that each holds about ``each`` of ``size`` things, at least Spark's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each))


def mapped(df, function, schema):
    """``mapInArrow`` with a function from a batch to an iterator of column lists."""
    def run(batches):
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def batch_of(schema, *columns):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


__all__ = ["BROADCAST_ROWS", "small_batches", "batch_of", "crc_mod", "fits", "mapped", "narrow_join", "saved", "table", "tasks_for"]
