"""Chat logs to dated dialogue lines.

The transcript of a file is its ``line`` values in (row_seq, kind) order, one line per row: the rows of a run
follow each other, so joining their text and writing them one by one give the same file, and no task needs
more than a bounded piece of a file.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X
from ragspark.operators import skew
from ragspark.session import saved

ROWS_PER_PIECE = 65_536
PART_CHARS = 1_000_000
HEADER, MESSAGE = 0, 1


def clean_rows(log):
    """Cleaned rows with text: file, row_seq, talker, date, time, text, is_attachment."""
    stamp = X.strip(F.coalesce("formatted_date", F.lit("")))
    cleaned = log.select(
        "file", "row_seq",
        X.strip(F.coalesce("sTalkerName", F.lit(""))).alias("talker"),
        X.stamp_date(stamp).alias("date"),
        X.stamp_time(stamp).alias("time"),
        X.clean_content(F.col("sTalkerContent"), X.strip(F.col("sOriginalFileName"))).alias("c"),
    )
    return cleaned.select(
        "file", "row_seq", "talker", "date", "time", F.col("c.text").alias("text"),
        F.col("c.is_attachment").alias("is_attachment"),
    ).where(F.length("text") > 0)


def dialogue_rows(log, rows_per_piece=ROWS_PER_PIECE):
    """Kept rows with ``new_date`` and ``new_run`` marks."""
    rows = clean_rows(log).withColumns(
        {"_set": F.nullif(F.col("date"), F.lit("")), "_piece": F.floor(F.col("row_seq") / rows_per_piece)}
    )
    seen = skew.with_carried(
        rows, ["file"], "_piece", "row_seq", previous=["talker", "is_attachment"], last_set=["_set"]
    )
    new_date = F.col("_set").isNotNull() & ~F.col("_set").eqNullSafe(F.col("last__set"))
    same = (
        F.col("has_prev") & (F.col("talker") == F.col("prev_talker"))
        & ~F.col("is_attachment") & ~F.col("prev_is_attachment")
    )
    return seen.select(
        "file", "row_seq", "talker", "date", "time", "text", "is_attachment",
        new_date.alias("new_date"),
        (new_date & F.col("last__set").isNotNull()).alias("later_date"),
        (new_date | ~same).alias("new_run"),
    )


def _message_line():
    head = F.when(
        F.length("time") > 0, F.concat(F.lit("["), "time", F.lit("] "), "talker", F.lit(": "), "text")
    ).otherwise(F.concat("talker", F.lit(": "), "text"))
    return F.when(F.col("new_run"), head).otherwise(F.col("text"))


def dialogue_lines(log, rows_per_piece=ROWS_PER_PIECE):
    """Transcript lines (file, row_seq, kind, line): date headers (kind 0) and messages (kind 1).

    Messages without a talker are dropped as the reference drops their runs; their dates still show.
    """
    rows = dialogue_rows(log, rows_per_piece)
    rule = F.lit(S.DATE_RULE)
    header = F.concat(
        F.when(F.col("later_date"), F.lit("\n")).otherwise(F.lit("")), rule, F.lit(" "), "date", F.lit(" "), rule
    )
    nothing = F.lit(None).cast("string")
    both = F.array(
        F.struct(F.lit(HEADER).alias("kind"), F.when(F.col("new_date"), header).otherwise(nothing).alias("line")),
        F.struct(
            F.lit(MESSAGE).alias("kind"),
            F.when(F.length("talker") > 0, _message_line()).otherwise(nothing).alias("line"),
        ),
    )
    return rows.select("file", "row_seq", F.explode(both).alias("l")).select(
        "file", "row_seq", "l.kind", "l.line"
    ).where("line IS NOT NULL")


def dialogue_runs(log, rows_per_piece=ROWS_PER_PIECE):
    """Runs of one talker: first row, talker, time and the number of rows and characters.

    The marked rows are stored once, because placing them in runs reads them twice.
    """
    rows = saved(dialogue_rows(log, rows_per_piece), "dialogue").withColumns(
        {
            "_start": F.when(F.col("new_run"), F.col("row_seq")),
            "_piece": F.floor(F.col("row_seq") / rows_per_piece),
        }
    )
    placed = skew.with_carried(rows, ["file"], "_piece", "row_seq", last_set=["_start"])
    first = F.coalesce("_start", "last__start").alias("first_row")
    return (
        placed.select("file", first, "row_seq", "talker", "time", "text")
        .where(F.length("talker") > 0)
        .groupBy("file", "first_row")
        .agg(
            F.min_by("talker", "row_seq").alias("talker"),
            F.min_by("time", "row_seq").alias("time"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.length("text")).alias("n_chars"),
        )
    )


def run_texts(log, rows_per_piece=ROWS_PER_PIECE, part_chars=PART_CHARS):
    """Runs with their text, in parts: file, first_row, part (from 0), talker, time, text.

    A run's rows are joined by line ends; a row goes to the part in which its first character lies, counted in ``part_chars`` from the
    start of the run, so a part holds about so many characters and joining the parts gives the run. Places are counted per piece of
    a file and moved on by one sum per piece: no task holds a run or a file.
    """
    piece = ["file", "_piece"]
    rows = saved(dialogue_rows(log, rows_per_piece), "dialogue").withColumns(
        {"_piece": F.floor(F.col("row_seq") / rows_per_piece), "_n": F.length("text") + 1}
    )
    sums = rows.groupBy(*piece).agg(F.sum("_n").alias("_n"))
    earlier = W.partitionBy("file").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    moved = sums.select(*piece, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_moved"))
    inside = W.partitionBy(*piece).orderBy("row_seq").rowsBetween(W.unboundedPreceding, -1)
    place = F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_moved")
    counted = saved(rows.join(moved, piece).withColumn("_place", place).drop("_moved", "_n"), "places")
    starts = counted.withColumn("_run", F.when(F.col("new_run"), F.struct(F.col("row_seq").alias("row"), F.col("_place").alias("place"), "talker", "time")))
    placed = skew.with_carried(starts, ["file"], "_piece", "row_seq", last_set=["_run"]).withColumn("_run", F.coalesce("_run", "last__run"))
    part = F.floor((F.col("_place") - F.col("_run.place")) / part_chars).alias("part")
    parts = placed.where(F.length("talker") > 0).select("file", F.col("_run.row").alias("first_row"), part, F.col("_run.talker").alias("talker"), F.col("_run.time").alias("time"), "row_seq", "text")
    lines = F.array_sort(F.collect_list(F.struct("row_seq", "text")))
    return parts.groupBy("file", "first_row", "part", "talker", "time").agg(
        F.array_join(F.transform(lines, lambda r: r["text"]), "\n").alias("text")
    )
