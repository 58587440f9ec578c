"""Joins and ordered scans that keep working when one key holds a large share of the rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
MAX_LOOKUP_ROWS = 1_000_000


def hot_keys(counts, keys, n, rows_per_task=ROWS_PER_TASK):
    """Keys with more than ``rows_per_task`` rows and the number of parts each is to be cut into.

    At most ``total rows / rows_per_task`` keys can pass, which bounds what ``salted_join`` broadcasts.
    """
    return counts.where(F.col(n) > rows_per_task).select(
        *keys, F.ceil(F.col(n) / rows_per_task).cast("int").alias("_parts")
    )


def salted_join(left, right, keys, hot, how="inner", spread=None, tasks=None):
    """Equi-join with the rows of hot left keys spread over several tasks.

    Right rows of a hot key are repeated once per part, all other rows stay single, so the result equals the
    plain join. ``spread`` names the left columns whose hash picks the part (all columns by default). ``tasks`` fixes the
    number of tasks, for joins whose result is much larger than their inputs.
    """
    hot = F.broadcast(hot)
    chosen = [F.col(c) for c in (spread or left.columns)]
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*chosen), F.coalesce("_parts", F.lit(1))).cast("int")
    ).drop("_parts")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    ).drop("_parts")
    on = [*keys, "_salt"]
    if tasks:
        salted_left, salted_right = salted_left.repartition(tasks, *on), salted_right.repartition(tasks, *on)
    return salted_left.join(salted_right, on, how).drop("_salt")


def lookup_join(left, right, keys, hot, how="inner", spread=None, limit=MAX_LOOKUP_ROWS):
    """Join to a stored table of narrow rows: sent to every task if it has at most ``limit`` rows, else salted."""
    if right.count() <= limit:
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, hot, how, spread)


def count_keys(df, keys, n="_n"):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))


def latest(df, keys, *order):
    """One row per key: the first in ``order``. Spark limits each map task to one row per key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df, keys, n, *order, rank="rank"):
    """First ``n`` rows per key with their rank; map tasks keep at most ``n`` rows per key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def with_carried(df, keys, bucket, order, previous=(), last_set=()):
    """Ordered scan over each key in bounded pieces.

    ``bucket`` is a column that never decreases along ``order``; rows are windowed per (key, bucket) and only
    one summary row per bucket is windowed per key, so no task holds a whole key. Adds ``prev_<c>`` for the
    columns in ``previous`` (value on the preceding row, with ``has_prev``) and ``last_<c>`` for those in
    ``last_set`` (latest non-null value on an earlier row).
    """
    piece = [*keys, bucket]
    inside = W.partitionBy(*piece).orderBy(order)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy(bucket)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    tail = F.struct(F.lit(True).alias("has"), *[F.col(c).alias(c) for c in previous])

    summary = df.groupBy(*piece).agg(
        F.max_by(tail, F.col(order)).alias("_tail"),
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_set_{c}")
            for c in last_set
        ],
    )
    carried = summary.select(
        *piece,
        F.lag("_tail").over(across).alias("_from_tail"),
        *[F.last(f"_set_{c}", True).over(before).alias(f"_from_{c}") for c in last_set],
    )
    local = df.withColumns(
        {
            "_prev": F.lag(tail).over(inside),
            **{f"_near_{c}": F.last(c, True).over(earlier) for c in last_set},
        }
    )
    joined = local.join(carried, piece).withColumn("_prev", F.coalesce("_prev", "_from_tail"))
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.coalesce("_prev.has", F.lit(False)).alias("has_prev"),
        *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in previous],
        *[F.coalesce(f"_near_{c}", f"_from_{c}").alias(f"last_{c}") for c in last_set],
    )
