"""Multi-vector search: five vectors make a chunk, every chunk is also a query, the room is a label."""

from pyspark.sql import functions as F

from ragspark.catalog import common as C
from ragspark.functions import text as X
from ragspark.operators import chunking, inference, packed, vector_index
from ragspark.operators import retrieval as R
from ragspark.plans import flows
from ragspark.session import saved, shared_folder
from ragspark.sources import store

QUERIES, ORACLE = {}, {}
MIN_SCORE = 1.05
INDEX_SCORE = 20.0


def vectors(spark, folder):
    e = C.table(spark, folder, "embeddings")
    chunk = F.floor(F.col("vec_id") / 5).cast("string")
    tokens = e.select(chunk.alias("doc_id"), "vec_id", "embedding", "label")
    first = tokens.groupBy("doc_id").agg(F.min_by("label", "vec_id").cast("string").alias("invoke_id"))
    return R.token_matrix(tokens, ["doc_id"], "vec_id").join(first, "doc_id")


def query_side(chunks):
    return chunks.select("invoke_id", F.col("doc_id").alias("query_id"), F.col("vectors").alias("q_vectors"))


def texts(spark, folder, chunks=None):
    chunks = vectors(spark, folder) if chunks is None else chunks
    docs = C.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), "source",
        (F.col("doc_id") % 7).cast("int").alias("page"),
    )
    return chunks.select("invoke_id", "doc_id").join(docs, "doc_id")


SQL_HITS = """
WITH token AS (
  SELECT (vec_id // 5)::VARCHAR AS doc_id, vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
chunk AS (SELECT doc_id, arg_min(label, vec_id)::VARCHAR AS invoke_id FROM token GROUP BY ALL),
t AS (SELECT * FROM token JOIN chunk USING (doc_id)),
best AS (
  SELECT q.invoke_id, q.doc_id AS query_id, d.doc_id, q.vec_id, max(list_dot_product(q.v, d.v)) AS m
  FROM t q JOIN t d ON q.invoke_id = d.invoke_id GROUP BY ALL),
score AS (SELECT invoke_id, query_id, doc_id, round(sum(m), 6) AS score FROM best GROUP BY ALL),
hit AS (
  SELECT *, row_number() OVER (PARTITION BY invoke_id, query_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM score QUALIFY rank <= 6),
found AS (
  SELECT hit.*, coalesce(d.text, '') AS content, coalesce(d.source, 'unknown') AS source,
    coalesce((d.doc_id % 7)::INT, 0) AS page
  FROM hit LEFT JOIN documents d ON d.doc_id = hit.doc_id::BIGINT)
"""
SQL_PASSAGES = SQL_HITS + f""",
passed AS (
  SELECT *, {C.sql_strip('content')} AS body FROM found WHERE score >= 1.05 AND (FILTER)),
kept AS (
  SELECT * FROM passed
  QUALIFY row_number() OVER (PARTITION BY query_id, substring(body, 1, 300) ORDER BY rank) = 1)
"""


def open_passages(name=None):
    match = "true" if name is None else f"contains(source, '{name}') OR contains('{name}', source)"
    return SQL_PASSAGES.replace("FILTER", match)


SQL_CONTEXT = """
, made AS (
  SELECT query_id, '<documents>' || chr(10) || string_agg('<document source="' || source || '" page="' || page
    || '">' || chr(10) || body || chr(10) || '</document>', chr(10) ORDER BY rank) || chr(10) || '</documents>' AS context
  FROM kept GROUP BY ALL),
cited AS (SELECT query_id, source, page, min(rank) AS r FROM kept GROUP BY ALL),
refs AS (
  SELECT query_id, string_agg(source || '#' || page, ',' ORDER BY r) AS refs FROM cited GROUP BY ALL)
SELECT chunk.invoke_id, chunk.doc_id AS query_id, context, coalesce(refs, '') AS refs
FROM chunk LEFT JOIN made ON made.query_id = chunk.doc_id LEFT JOIN refs ON refs.query_id = chunk.doc_id
"""


def hits(spark, folder, chunks=None):
    chunks = vectors(spark, folder) if chunks is None else chunks
    return R.top_hits(query_side(chunks), chunks)


def flat_references(answered):
    refs = F.transform("references", lambda r: F.concat(r["source"], F.lit("#"), r["page"].cast("string")))
    return answered.withColumn("refs", F.array_join(refs, ",")).drop("references")


def search(spark, folder, file=None):
    chunks = vectors(spark, folder)
    kept = R.evidence(hits(spark, folder, chunks), texts(spark, folder, chunks), MIN_SCORE, file)
    return flat_references(R.assemble_context(kept, query_side(chunks)))


def search_blocks(spark, folder):
    """The same hits found by the block-wise route that serves query sets too large to send to every task."""
    chunks = vectors(spark, folder)
    return R.top_hits(query_side(chunks), chunks, max_query_rows=0, chunks_per_block=8, queries_per_block=4)


def maxsim_self(spark, folder):
    """Each chunk scored against itself with built-in array functions."""
    return vectors(spark, folder).select("doc_id", R.maxsim(F.col("vectors"), F.col("vectors")).alias("score"))


def document_chunks(spark, folder):
    """Chunk rows of all documents, as they are stored; a chunk's id is that of its text, so equal ones come once."""
    made = chunking.identify_chunks(chunking.chunk_text(C.document_pages(spark, folder)))
    return made.select("invoke_id", "id", "content", "source", "page", F.lit(0).cast("timestamp").alias("written_at"))


def encode(spark, folder):
    """The token vectors of every chunk of all documents, by one batch inference."""
    return packed.summed(inference.encode(document_chunks(spark, folder), as_packed=True).select("invoke_id", "id", "vectors"))


def asked(spark, folder):
    """Every benchmark passage is a question to one of the four rooms of documents, in turn."""
    room = F.element_at(F.array(*(F.lit(x) for x in ("en", "de", "es", "fr"))), (F.col("item_id") % 4 + 1).cast("int"))
    return C.table(spark, folder, "benchmark").select(
        room.alias("invoke_id"), F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question")
    )


def stored_index(spark, folder):
    path = shared_folder(spark, "index")
    flows.index_chunks(document_chunks(spark, folder), path, 0)
    return path


def indexed_hits(spark, folder):
    """Hits of the stored index: lists, codes, then exact scores."""
    table, book = flows.load_index(spark, stored_index(spark, folder))
    queries = saved(inference.encode(asked(spark, folder), "question", "q_vectors", True, None, True), "queries")
    return vector_index.search(queries, table, book)


def exact_hits(spark, folder):
    """The same hits by scoring every chunk of the room, as it is encoded; vectors are neither stored nor shuffled."""
    chunks = store.latest_rows(document_chunks(spark, folder)).select("invoke_id", F.col("id").alias("doc_id"), "content")
    queries = saved(inference.encode(asked(spark, folder), "question", "q_vectors", True, None, True), "queries")
    return R.top_hits(queries, inference.encode(chunks, as_packed=True).drop("content"))


def search_documents(spark, folder, file=None):
    """Questions to cited context over the stored chunks of all documents."""
    return flat_references(flows.search_index(spark, asked(spark, folder), stored_index(spark, folder), min_score=INDEX_SCORE, file=file))


def with_text(spark, folder):
    return R.attach_metadata(hits(spark, folder), texts(spark, folder))


def passages(spark, folder, file=None):
    return R.evidence(hits(spark, folder), texts(spark, folder), MIN_SCORE, file).select(
        "query_id", "rank", "source", "page"
    )


def threshold(spark, folder):
    return R.score_filter(hits(spark, folder), MIN_SCORE)


def filtered(spark, folder):
    return R.file_filter(with_text(spark, folder), "src1").select("query_id", "rank", "source")


def tags(spark, folder):
    return with_text(spark, folder).select(
        "query_id", "rank", X.document_tag(F.col("source"), F.col("page"), F.col("content")).alias("tag")
    )


def references(spark, folder):
    chunks = vectors(spark, folder)
    kept = R.evidence(hits(spark, folder, chunks), texts(spark, folder, chunks), MIN_SCORE)
    answered = R.assemble_context(kept, query_side(chunks))
    return answered.select("query_id", F.posexplode("references").alias("pos", "r")).select(
        "query_id", "pos", "r.source", "r.page"
    )


QUERIES.update(
    maxsim=maxsim_self, encode=encode, top_hits=hits, top_hits_in_blocks=search_blocks, attach_metadata=with_text,
    score_filter=threshold, file_filter=filtered, document_tag=tags, dedup_by_prefix=passages,
    collect_references=references, search=search,
    search_one_file=lambda spark, folder: search(spark, folder, "src1"),
    indexed_hits=indexed_hits, exact_hits=exact_hits, search_documents=search_documents,
    search_documents_one_file=lambda spark, folder: search_documents(spark, folder, "src1"),
)
HIT = "SELECT invoke_id, query_id, doc_id, score, rank FROM hit"
ORACLE.update(
    maxsim=SQL_HITS + "SELECT doc_id, score FROM score WHERE doc_id = query_id",
    top_hits=SQL_HITS + HIT,
    top_hits_in_blocks=SQL_HITS + HIT,
    attach_metadata=SQL_HITS + "SELECT * FROM found",
    score_filter=SQL_HITS + HIT + " WHERE score >= 1.05",
    file_filter=SQL_HITS + """SELECT query_id, rank, source FROM found
      WHERE contains(source, 'src1') OR contains('src1', source)""",
    document_tag=SQL_HITS + """SELECT query_id, rank, '<document source="' || source || '" page="' || page || '">'
      || chr(10) || content || chr(10) || '</document>' AS tag FROM found""",
    dedup_by_prefix=open_passages() + "SELECT query_id, rank, source, page FROM kept",
    collect_references=open_passages() + """, first AS (SELECT query_id, source, page, min(rank) AS r FROM kept GROUP BY ALL)
      SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY r) - 1)::INT AS pos, source, page FROM first""",
    search=open_passages() + SQL_CONTEXT,
    search_one_file=open_passages("src1") + SQL_CONTEXT,
)


# piece(invoke_id, id, content, source, page), one row per room and id; spot(invoke_id, id, term) with repeats
SQL_PIECES = C.SQL_CHUNKS + f""",
piece AS (
  SELECT DISTINCT invoke_id, {C.SQL_ID} AS id, source, page,
    '[문서: ' || source || ' | 페이지: ' || page || ']' || chr(10) || chr(10) || text AS content FROM chunk),
spot AS (SELECT invoke_id, id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS terms FROM piece)
"""
SQL_VECTOR = """list_transform(range(16), lambda i: ('0x' || substr(md5(term), 2 * i + 1, 2))::INT::DOUBLE - 127.5)"""
SQL_FOUND = SQL_PIECES + f""",
asked AS (
  SELECT item_id::VARCHAR AS query_id, ['en', 'de', 'es', 'fr'][item_id % 4 + 1] AS invoke_id,
    regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS terms FROM benchmark),
q_term AS (SELECT invoke_id, query_id, term, count(*) AS n FROM (SELECT *, unnest(terms) AS term FROM asked) GROUP BY ALL),
d_term AS (SELECT DISTINCT invoke_id, id, term FROM (SELECT *, unnest(terms) AS term FROM spot)),
raw AS (SELECT term, {SQL_VECTOR} AS v FROM (SELECT term FROM q_term UNION SELECT term FROM d_term)),
vector AS (
  SELECT term, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT)::DOUBLE[16] AS v FROM raw),
near AS (
  SELECT q.invoke_id, q.term AS q_term, d.term AS d_term, array_inner_product(a.v, b.v) AS s
  FROM (SELECT DISTINCT invoke_id, term FROM q_term) q JOIN (SELECT DISTINCT invoke_id, term FROM d_term) d ON q.invoke_id = d.invoke_id
  JOIN vector a ON a.term = q.term JOIN vector b ON b.term = d.term),
best AS (
  SELECT n.invoke_id, n.q_term, d.id, max(n.s) AS s FROM near n JOIN d_term d ON d.invoke_id = n.invoke_id AND d.term = n.d_term GROUP BY ALL),
score AS (
  SELECT q.invoke_id, q.query_id, b.id AS doc_id, round(sum(q.n * b.s), 6) AS score
  FROM q_term q JOIN best b ON b.invoke_id = q.invoke_id AND b.q_term = q.term GROUP BY ALL),
hit AS (
  SELECT *, row_number() OVER (PARTITION BY invoke_id, query_id ORDER BY score DESC, doc_id)::INT AS rank FROM score QUALIFY rank <= 6),
passed AS (
  SELECT hit.*, source, page, {C.sql_strip('content')} AS body FROM hit JOIN piece ON piece.invoke_id = hit.invoke_id AND piece.id = hit.doc_id
  WHERE score >= 20.0 AND (FILTER)),
kept AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY invoke_id, query_id, substring(body, 1, 300) ORDER BY rank) = 1)
"""
SQL_CITED = """
, made AS (
  SELECT invoke_id, query_id, '<documents>' || chr(10) || string_agg('<document source="' || source || '" page="' || page
    || '">' || chr(10) || body || chr(10) || '</document>', chr(10) ORDER BY rank) || chr(10) || '</documents>' AS context
  FROM kept GROUP BY ALL),
cited AS (SELECT invoke_id, query_id, source, page, min(rank) AS r FROM kept GROUP BY ALL),
refs AS (SELECT invoke_id, query_id, string_agg(source || '#' || page, ',' ORDER BY r) AS refs FROM cited GROUP BY ALL)
SELECT asked.invoke_id, asked.query_id, context, coalesce(refs, '') AS refs
FROM asked LEFT JOIN made USING (invoke_id, query_id) LEFT JOIN refs USING (invoke_id, query_id)
"""


def found_documents(name=None):
    match = "true" if name is None else f"contains(source, '{name}') OR contains('{name}', source)"
    return SQL_FOUND.replace("FILTER", match)


ORACLE.update(
    encode=SQL_PIECES.replace("SELECT DISTINCT invoke_id", "SELECT invoke_id") + f""",
      token AS (SELECT row_id, unnest(terms) AS term FROM (SELECT *, row_number() OVER () AS row_id FROM spot)),
      raw AS (SELECT term, {SQL_VECTOR} AS v FROM (SELECT DISTINCT term FROM token)),
      summed AS (SELECT term, list_sum(list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE)) AS s FROM raw),
      total AS (SELECT row_id, round(sum(s), 4) AS total FROM token JOIN summed USING (term) GROUP BY ALL)
      SELECT invoke_id, id, len(terms)::INT AS n_tokens, coalesce(total, 0) AS total
      FROM (SELECT *, row_number() OVER () AS row_id FROM spot) LEFT JOIN total USING (row_id)""",
    indexed_hits=found_documents() + HIT, exact_hits=found_documents() + HIT,
    search_documents=found_documents() + SQL_CITED, search_documents_one_file=found_documents("src1") + SQL_CITED,
)
