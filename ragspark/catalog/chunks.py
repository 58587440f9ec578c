"""Pages, chunks, ids, keywords."""

from pyspark.sql import functions as F

from ragspark.catalog import common as C
from ragspark.functions import text as X
from ragspark.operators import chunking, keywords
from ragspark.session import saved

QUERIES, ORACLE = {}, {}


def paged_documents(spark, folder):
    """Every line of a document becomes its own page, numbered by its position."""
    lines = F.split("text", "\n")
    marked = F.transform(
        lines, lambda t, i: F.concat(F.lit("\n--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), t)
    )
    return C.table(spark, folder, "documents").select(
        "doc_id", "source", F.concat(F.col("lang"), F.array_join(marked, "")).alias("markdown")
    )


SQL_PAGED = """
paged AS (
  SELECT doc_id, source, lang || array_to_string(list_transform(string_split(text, chr(10)),
    lambda t, i: chr(10) || '--- Page ' || i || ' ---' || chr(10) || t), '') AS markdown
  FROM documents)
"""


def split_pages(spark, folder):
    return chunking.split_pages(paged_documents(spark, folder)).drop("page_seq")


ORACLE["split_pages"] = f"""
WITH {SQL_PAGED},
cut AS (
  SELECT doc_id, source, unnest(list_prepend('1', regexp_extract_all(markdown, '\\n--- Page (\\d+) ---\\n', 1))) AS page,
         unnest(string_split_regex(markdown, '\\n--- Page \\d+ ---\\n')) AS text FROM paged)
SELECT doc_id, source, page::INT AS page, {C.sql_strip('text')} AS text FROM cut WHERE length({C.sql_strip('text')}) > 0
"""


def document_chunks(spark, folder):
    return chunking.chunk_text(C.document_pages(spark, folder))


ORACLE["chunk_text"] = C.SQL_CHUNKS + "SELECT * FROM chunk"


def chunk_ids(spark, folder):
    return chunking.identify_chunks(document_chunks(spark, folder)).select("doc_id", "chunk_seq", "id")


ORACLE["chunk_id"] = C.SQL_CHUNKS + f"SELECT doc_id, chunk_seq, {C.SQL_ID} AS id FROM chunk"


def formatted(spark, folder):
    worded = document_chunks(spark, folder).withColumn(
        "words", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("")
    )
    return chunking.identify_chunks(worded, "words").select("doc_id", "chunk_seq", "content")


ORACLE["format_chunk"] = C.SQL_CHUNKS + """
SELECT doc_id, chunk_seq, '[문서: ' || source || ' | 페이지: ' || page || ']' || chr(10) ||
  CASE WHEN doc_id % 2 = 0 THEN '[키워드: ' || text || ']' || chr(10) ELSE '' END
  || chr(10) || text AS content FROM chunk
"""


def prefixes(spark, folder):
    docs = C.table(spark, folder, "documents")
    return docs.select("doc_id", *[X.prefix(F.col("text"), n).alias(f"p{n}") for n in (200, 300, 1500, 2000)])


ORACLE["prefix"] = "SELECT doc_id, " + ", ".join(
    f"substring(text, 1, {n}) AS p{n}" for n in (200, 300, 1500, 2000)
) + " FROM documents"


def stats(spark, folder):
    return chunking.corpus_stats(document_chunks(spark, folder))


ORACLE["corpus_stats"] = C.SQL_CHUNKS + """
SELECT invoke_id, source, count(*) AS n_chunks, count(DISTINCT page) AS n_pages, sum(length(text))::BIGINT AS n_chars
FROM chunk GROUP BY ALL
"""


KEY = ("doc_id", "chunk_seq")


def keyed_chunks(spark, folder):
    return keywords.tfidf_keywords(saved(document_chunks(spark, folder), "chunks"), key=KEY)


def tfidf(spark, folder):
    return keyed_chunks(spark, folder).select("invoke_id", *KEY, "keywords")


# ranked(invoke_id, doc_id, chunk_seq, term, rn), keyed(chunk columns, keywords)
SQL_KEYWORDS = C.SQL_CHUNKS + """,
term AS (
  SELECT invoke_id, doc_id, chunk_seq,
    unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM chunk),
tf AS (SELECT invoke_id, doc_id, chunk_seq, term, count(*) AS tf FROM term GROUP BY ALL),
df AS (SELECT invoke_id, term, count(*) AS df FROM tf GROUP BY ALL),
total AS (SELECT invoke_id, count(*) AS size FROM chunk GROUP BY ALL),
ranked AS (
  SELECT invoke_id, doc_id, chunk_seq, term,
    row_number() OVER (PARTITION BY doc_id, chunk_seq ORDER BY round(tf * ln(size::DOUBLE / df), 9) DESC, term) AS rn
  FROM tf JOIN df USING (invoke_id, term) JOIN total USING (invoke_id)),
words AS (
  SELECT doc_id, chunk_seq, string_agg(term, ', ' ORDER BY rn) AS keywords FROM ranked WHERE rn <= 10 GROUP BY ALL),
keyed AS (
  SELECT chunk.*, coalesce(keywords, '') AS keywords FROM chunk LEFT JOIN words USING (doc_id, chunk_seq))
"""
ORACLE["tfidf_keywords"] = SQL_KEYWORDS + "SELECT invoke_id, doc_id, chunk_seq, keywords FROM keyed"


def facts(spark, folder):
    graph = keywords.cooccurrence_graph(keyed_chunks(spark, folder))
    return graph.select(*KEY, F.explode("graph.relationships").alias("r")).select(*KEY, "r.source", "r.target", "r.type")


ORACLE["extract_graph"] = SQL_KEYWORDS + """,
top AS (SELECT doc_id, chunk_seq, list(term) AS terms FROM ranked WHERE rn <= 10 GROUP BY ALL),
one AS (SELECT doc_id, chunk_seq, terms, unnest(terms) AS source FROM top)
SELECT doc_id, chunk_seq, source, unnest(list_filter(terms, lambda t: t > source)) AS target, 'CO_OCCURS' AS type FROM one
"""

QUERIES.update(
    split_pages=split_pages, chunk_text=document_chunks, chunk_id=chunk_ids, format_chunk=formatted,
    prefix=prefixes, corpus_stats=stats, tfidf_keywords=tfidf, extract_graph=facts,
)
