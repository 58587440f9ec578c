"""Inputs shared by the registered queries, as DataFrames and as SQL."""

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.session import spread


HEAVY = ("documents", "lineitem", "pages")


def table(spark, folder, name):
    """One input table; those with much work per row are spread over the cores if they come in few files."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def quoted(s):
    return "'" + s.replace("'", "''") + "'"


WS = quoted(S.WHITESPACE)


def sql_strip(c):
    return f"trim({c}, {WS})"


def document_pages(spark, folder):
    """Each document is page 1 of its source file; the room is its language."""
    from ragspark.functions import text as X

    return table(spark, folder, "documents").select(
        F.col("lang").alias("invoke_id"), "source", "doc_id", F.lit(1).alias("page"),
        X.strip(F.col("text")).alias("text"),
    ).where(F.length("text") > 0)


def _window_end(t, s):
    w = f"substring({t}, {s} + 1, 1500)"
    last = f"length(regexp_extract({w}, '(?s)^(.*[ \\n])', 1)) - 1"
    return (
        f"CASE WHEN {s} + 1500 >= length({t}) THEN length({t})"
        f" WHEN {last} > 750 THEN {s} + {last} ELSE {s} + 1500 END"
    )


# chunk(invoke_id, source, doc_id, page, chunk_seq, text)
SQL_CHUNKS = f"""
WITH RECURSIVE sheet AS (
  SELECT lang AS invoke_id, source, doc_id, 1 AS page, {sql_strip('text')} AS t FROM documents),
walk(doc_id, n, s, e) AS (
  SELECT doc_id, 0, 0::BIGINT, ({_window_end('t', '0')})::BIGINT FROM sheet WHERE length(t) > 0
  UNION ALL
  SELECT w.doc_id, w.n + 1, w.e - 200, ({_window_end('p.t', '(w.e - 200)')})::BIGINT
  FROM walk w JOIN sheet p ON p.doc_id = w.doc_id WHERE w.e < length(p.t)),
chunk AS (
  SELECT invoke_id, source, doc_id, page, n AS chunk_seq,
         {sql_strip('substring(t, s + 1, e - s)')} AS text
  FROM walk JOIN sheet USING (doc_id) WHERE length({sql_strip('substring(t, s + 1, e - s)')}) > 0)
"""
SQL_ID = "source || '_' || page || '_' || substring(md5(text), 1, 12)"
