"""Conversation memory: windows over the newest messages of each room."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X
from ragspark.operators import skew

D = S.DEFAULTS


def history_window(messages, max_n=D.history_messages, max_chars=D.history_chars, key="invoke_id"):
    """Newest messages of each room that fit both limits, assistant turns skipped; the newest always stays.

    Only the newest ``max_n`` rows of a room leave a map task, so a room of any size costs the same.
    """
    recent = skew.first_n(messages.where("role <> 'assistant'"), [key], max_n, F.desc("seq"), rank="_rn")
    running = F.sum(F.length("content")).over(W.partitionBy(key).orderBy("_rn"))
    return recent.withColumn("_chars", running).where((F.col("_rn") == 1) | (F.col("_chars") <= max_chars)).drop(
        "_rn", "_chars"
    )


def trim_history(messages, keep=2 * D.history_messages, key="invoke_id", order="seq"):
    return skew.first_n(messages, [key], keep, F.desc(order)).drop("rank")


def last_run(trimmed, ttl_days=D.ttl_days, key="invoke_id", order="seq", written_at="written_at"):
    """Of the few newest messages of each room, those after the last silence of ``ttl_days`` or more."""
    w = W.partitionBy(key).orderBy(order)
    gap = F.col(written_at) >= F.lag(written_at).over(w) + F.expr(f"INTERVAL {int(ttl_days)} DAYS")
    marked = trimmed.withColumn("_first", F.when(gap, F.col(order)))
    start = F.max("_first").over(W.partitionBy(key))
    return marked.withColumn("_first", start).where(F.col("_first").isNull() | (F.col(order) >= F.col("_first"))).drop("_first")


def recent_summary_text(messages, n=D.recent_messages, chars=D.recent_chars, max_n=D.history_messages,
                        max_chars=D.history_chars, key="invoke_id"):
    """Prompt text of the last ``n`` windowed messages per room; a room without any has empty text.

    At most ``min(n, max_n)`` lines per room are collected.
    """
    shown = skew.first_n(history_window(messages, max_n, max_chars, key), [key], n, F.desc("seq"))
    line = X.history_line(F.col("role"), F.col("content"), chars)
    lines = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    text = shown.groupBy(key).agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("conversation"))
    return (
        messages.select(key).distinct().join(text, key, "left")
        .withColumn("conversation", F.coalesce("conversation", F.lit("")))
    )


def last_message(messages, role="user", key="invoke_id"):
    """Latest message of one role per room; combined on the map side."""
    own = F.when(F.col("role") == role, F.col("seq"))
    return messages.groupBy(key).agg(F.max_by("content", own).alias("content")).where("content IS NOT NULL")


def live_rows(df, as_of, ttl_days=D.ttl_days, written_at="written_at"):
    """Rows still visible at ``as_of``; a rewrite refreshes ``written_at``."""
    return df.where(F.col(written_at) > as_of - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))


def accumulate_or_reset(updates, key="invoke_id", order="seq", items="items"):
    """Items accumulated after the last empty update of each key, in order, one row per item.

    An empty (or null) update resets the list. The reset point is a map-side aggregate, so a long list is
    never gathered into one row.
    """
    reset = F.when(F.size(F.coalesce(F.col(items), F.array())) == 0, F.col(order))
    resets = updates.groupBy(key).agg(F.max(reset).alias("_reset"))
    counts = skew.count_keys(updates, [key])
    kept = skew.salted_join(updates, resets, [key], skew.hot_keys(counts, [key], "_n"), spread=[order])
    return kept.where(F.col("_reset").isNull() | (F.col(order) > F.col("_reset"))).select(
        key, order, F.posexplode(items).alias("pos", "item")
    )
