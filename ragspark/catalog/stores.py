"""Stored tables, streams, progress, templates."""

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.catalog import chunks as K
from ragspark.catalog import common as C
from ragspark.catalog import documents as J
from ragspark.functions import text as X
from ragspark.operators import chunking, parents, progress, retrieval, streamlog, templates
from ragspark.plans import flows
from ragspark.session import saved, shared_folder
from ragspark.sources import store
from ragspark.streaming import chatlog, history, ingest

QUERIES, ORACLE = {}, {}
FIRST, SECOND = "2024-01-01 00:00:00", "2024-01-05 00:00:00"
TTL = 2  # days, so that conversations of the events table expire
AS_OF = "2024-01-31"  # some rooms have been silent for so long by then


def stamp(s):
    return F.lit(s).cast("timestamp")


def stored_rows(spark, folder):
    return C.table(spark, folder, "documents").select(
        F.col("lang").alias("invoke_id"), F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("content"), "source", F.lit(1).alias("page"), stamp(FIRST).alias("written_at"),
    )


def new_rows(spark, folder):
    """Labelled documents rewritten, each twice: the version written a day later wins. Their ids also appear in a new room."""
    docs = C.table(spark, folder, "documents").join(C.table(spark, folder, "labels"), "doc_id")
    versions = F.explode(F.array(F.lit(0), F.lit(1))).alias("v")
    made = docs.select("doc_id", "lang", "source", "quality", versions)
    rows = made.select(
        F.col("lang").alias("invoke_id"), F.col("doc_id").cast("string").alias("id"),
        F.concat_ws(" ", F.lit("version"), F.col("v").cast("string"), F.col("quality").cast("string")).alias("content"), "source",
        F.lit(2).alias("page"), (stamp(SECOND) + F.make_dt_interval(days=F.col("v"))).alias("written_at"),
    )
    return rows.union(rows.withColumn("invoke_id", F.lit("new-room")))


def upserted(spark, folder):
    rows = store.upsert(stored_rows(spark, folder), new_rows(spark, folder))
    return rows.withColumn("written_at", F.col("written_at").cast("timestamp_ntz"))


SQL_STORE = f"""
WITH old AS (
  SELECT lang AS invoke_id, doc_id::VARCHAR AS id, text AS content, source, 1 AS page, TIMESTAMP '{FIRST}' AS written_at FROM documents),
fresh AS (
  SELECT room AS invoke_id, doc_id::VARCHAR AS id, 'version 1 ' || quality AS content, source, 2 AS page, TIMESTAMP '{SECOND}' + INTERVAL 1 DAY AS written_at
  FROM (SELECT d.doc_id, source, quality, unnest([lang, 'new-room']) AS room FROM documents d JOIN labels l ON l.doc_id = d.doc_id)),
merged AS (
  SELECT * FROM old WHERE (invoke_id, id) NOT IN (SELECT (invoke_id, id) FROM fresh) UNION ALL SELECT * FROM fresh)
"""


def stored_and_loaded(spark, folder):
    """Two written batches read back: the newest row of each key."""
    path = shared_folder(spark, "chunks")
    store.append_batch(stored_rows(spark, folder), path, 0)
    store.append_batch(new_rows(spark, folder), path, 1)
    return store.load_rows(spark, path).select("invoke_id", "id", "content", "source", "page")


def loaded_room(spark, folder):
    return stored_and_loaded(spark, folder).where("invoke_id = 'new-room'")


def rooms(df):
    return df.groupBy("invoke_id").agg(F.count(F.lit(1)).alias("n"))


def ingested(spark, folder):
    docs = C.table(spark, folder, "documents").select(
        F.col("lang").alias("invoke_id"), "source", "doc_id", F.col("text").alias("markdown")
    )
    made = flows.ingest(docs, stamp(FIRST))
    return made.select("invoke_id", "doc_id", "chunk_seq", "id", "content", "keywords")


def parent_rows(spark, folder):
    """Documents as parents; every ninth has no content and every tenth no id."""
    doc = F.col("doc_id")
    return C.table(spark, folder, "documents").select(
        F.col("lang").alias("invoke_id"), F.when(doc % 10 == 0, F.lit("")).otherwise(doc.cast("string")).alias("parent_id"),
        F.when(doc % 9 == 0, F.lit("")).otherwise(F.col("text")).alias("content"), stamp(FIRST).alias("written_at"),
    )


def saved_parents(spark, folder):
    new = parent_rows(spark, folder)
    again = new.withColumns({"content": F.concat(F.lit("2 "), "content"), "written_at": stamp(SECOND)})
    table, _ = parents.save_parents(parents.valid_parents(new), again.where("content <> '2 '"))
    return table.select("invoke_id", "parent_id", "content")


def loaded_parents(spark, folder):
    ids = F.array(*[(F.col("doc_id") + n).cast("string") for n in (0, 1, 0)], F.lit("missing"))
    requests = C.table(spark, folder, "labels").select(
        F.col("doc_id").alias("request_id"), F.lit("r").alias("invoke_id"), ids.alias("ids")
    )
    rows = C.table(spark, folder, "documents").select(
        F.lit("r").alias("invoke_id"), F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("content")
    )
    return parents.load_parents(requests, rows).select("request_id", "pos", "parent_id", "content")


def orphans(spark, folder):
    files = C.table(spark, folder, "documents").select(F.col("doc_id").alias("token"), "source")
    return parents.orphan_files(files, C.table(spark, folder, "labels").select(F.col("doc_id").alias("token")))


def metadata(spark, folder):
    kind = "source string, page int, keywords string"
    encoded = document_metadata(spark, folder)
    return encoded.withColumn("m", F.from_json("metadata", kind)).select("doc_id", "metadata", "m.source", "m.page", "m.keywords")


def document_metadata(spark, folder):
    return C.table(spark, folder, "documents").select(
        "doc_id",
        F.to_json(F.struct("source", F.lit(1).alias("page"), F.col("text").alias("keywords"))).alias("metadata"),
    )


def defaults(spark, folder):
    gone = F.col("doc_id") % 3 == 0
    return retrieval.metadata_defaults(
        C.table(spark, folder, "documents").select(
            "doc_id", F.when(~gone, F.col("lang")).alias("content"), F.when(~gone, F.col("source")).alias("source"),
            F.when(~gone, F.lit(4)).alias("page"),
        )
    )


def batches(spark, folder):
    rows = C.table(spark, folder, "documents").select("source", F.floor(F.col("doc_id") / 20).alias("seq"))
    return progress.batch_progress(rows)


def stages(spark, folder):
    """The events of one ingestion of all documents, with the rows that its jobs have written."""
    base = shared_folder(spark, "recorded")
    docs = C.table(spark, folder, "documents").select(F.col("lang").alias("invoke_id"), "source", F.col("text").alias("markdown"))
    flows.ingest_recorded(docs, f"{base}/chunks", 0, f"{base}/events", "documents", stamp(FIRST))
    return progress.run_events(spark, f"{base}/events").drop("message")


# --- templates: each document fills a memo and a report ---
MEMO = (
    "<s><hp:p a>{{TITLE}} to {{RECIPIENT}} via {{VIA}}</hp:p><hp:p b>old {{CONTENT}} old</hp:p><hp:p c>{{ATTACHMENT}}</hp:p></s>"
)
REPORT = "<s><hp:p>{{TITLE}}</hp:p><hp:p>{{CONTENT}}</hp:p><hp:p>mid</hp:p><hp:p>{{CONTENT_2}}</hp:p></s>"


def filled(spark, folder):
    docs = C.table(spark, folder, "documents")
    pairs = [("RECIPIENT", F.col("lang")), ("VIA", F.lit(None)), ("TITLE", F.col("source")), ("ATTACHMENT", F.col("n_chars"))]
    return docs.select("doc_id", X.fill_placeholders(F.concat(F.lit("{{TITLE}}{{VIA}} {{RECIPIENT}} "), "text"), pairs).alias("text"))


def memos(spark, folder):
    pairs = [("RECIPIENT", F.col("lang")), ("VIA", F.lit(None)), ("TITLE", F.col("source")), ("ATTACHMENT", F.col("n_chars"))]
    made = flows.bulk_memos(C.table(spark, folder, "documents"), F.lit(MEMO), pairs, F.split("text", "\n"))
    return made.select("doc_id", "document")


def item_columns():
    lines = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    items = F.transform(lines, lambda t, i: F.struct(t.alias("text"), (i % 2 + 1).alias("level")))
    return items, F.col("doc_id") % 4 == 0


def reports(spark, folder):
    items, attached = item_columns()
    made = flows.bulk_reports(C.table(spark, folder, "documents"), F.lit(REPORT), [("TITLE", F.col("source"))], items, attached)
    return made.select("doc_id", "document")


def marked(spark, folder):
    items, attached = item_columns()
    return C.table(spark, folder, "documents").select(
        "doc_id", F.posexplode(templates.marked_items(items, attached)).alias("pos", "i")
    ).select("doc_id", "pos", "i.text", "i.level")


# --- streams ---
def stream(spark, folder, name):
    """One input table as a stream. The pattern stands for its file as well as for the files of a folder of that name."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def run(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def streamed_chunks(spark, folder):
    base = shared_folder(spark, "stream-chunks")
    docs = stream(spark, folder, "documents").select(F.col("lang").alias("invoke_id"), "source", F.col("text").alias("markdown"))
    run(ingest.stream_ingest(docs, f"{base}/table", f"{base}/checkpoint", f"{base}/progress", stamp(FIRST)))
    return store.load_rows(spark, f"{base}/table").select("invoke_id", "id", "content", "source", "page")


def pairs_of(events):
    return events.select(
        F.col("user_id").cast("string").alias("invoke_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("user"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).alias("assistant"), F.col("ts").alias("written_at"),
    )


def streamed_history(spark, folder):
    base = shared_folder(spark, "stream-history")
    run(history.stream_history(pairs_of(stream(spark, folder, "events")), f"{base}/table", f"{base}/checkpoint"))
    return history.read_history(spark, f"{base}/table", stamp(AS_OF), ttl_days=TTL).select("invoke_id", "seq", "role", "content")


def remembered_rooms(spark, folder):
    """The same from state: the events come in four quarters of the time, and each is one micro-batch of a query that goes on."""
    base = shared_folder(spark, "room-memory")
    events = C.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    quarter = F.least(F.floor((F.col("ts").cast("double") - F.lit(span.a).cast("double")) / (F.lit(span.b).cast("double") - F.lit(span.a).cast("double")) * 4), F.lit(3))
    for k in range(4):
        events.where(quarter == k).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        run(history.stateful_history(pairs_of(source), f"{base}/table", f"{base}/checkpoint", ttl_days=TTL))
    return history.read_live_history(spark, f"{base}/table", stamp(AS_OF), ttl_days=TTL).select("invoke_id", "seq", "role", "content")


def lines_of(events):
    """Events as stream lines: errors end a response, every nineteenth line is broken, clicks are comments."""
    piece = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("props").alias("content")).alias("delta"))).alias("choices")))
    line = (
        F.when(F.col("event_id") % 19 == 0, F.lit('data: {"choices"'))
        .when(F.col("event_type") == "error", F.lit("data: [DONE]"))
        .when(F.col("event_type") == "click", F.concat(F.lit(": "), "props"))
        .otherwise(F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("data: ")).otherwise(F.lit("data:")), piece))
    )
    return events.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), line.alias("line"))


def streamed_log(spark, folder):
    base = shared_folder(spark, "stream-log")
    run(chatlog.stream_chat_log(lines_of(stream(spark, folder, "events")), f"{base}/table", f"{base}/checkpoint"))
    return chatlog.answers(spark, f"{base}/table")


def answer_lines(events):
    body = F.to_json(F.struct(F.lit("answer").alias("type"), F.col("props").alias("content")))
    return events.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("data: "), body)).otherwise(F.lit('data: {"type":"done"}')).alias("line"),
    )


SQL_LINES = """
WITH line AS (
  SELECT *, CASE WHEN event_id % 19 = 0 THEN 'broken' WHEN event_type = 'error' THEN 'done' WHEN event_type = 'click' THEN 'comment' ELSE 'delta' END AS kind
  FROM events),
ends AS (SELECT user_id, min(event_id) FILTER (WHERE kind = 'done') AS last FROM line GROUP BY ALL)
"""
SQL_DELTAS = SQL_LINES + """
SELECT user_id AS request_id, string_agg(props, '' ORDER BY event_id) AS text
FROM line JOIN ends USING (user_id) WHERE kind = 'delta' AND (last IS NULL OR event_id < last) GROUP BY ALL"""
SQL_STREAM_CHUNKS = C.SQL_CHUNKS + f"""
SELECT DISTINCT invoke_id, {C.SQL_ID} AS id, '[문서: ' || source || ' | 페이지: ' || page || ']' || chr(10) || chr(10) || text AS content, source, page FROM chunk"""

SQL_ROOMS = """
WITH pair AS (SELECT user_id::VARCHAR AS invoke_id, event_id, event_type, props, ts FROM events WHERE event_type <> 'error'),
m AS (SELECT invoke_id, event_id * 2 AS seq, 'user' AS role, event_type AS content FROM pair
  UNION ALL SELECT invoke_id, event_id * 2 + 1, 'assistant', props FROM pair),
gap AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY invoke_id ORDER BY event_id) + INTERVAL 2 DAY AS expired FROM pair),
run AS (SELECT invoke_id, coalesce(max(event_id) FILTER (WHERE expired), -1) AS first, arg_max(ts, event_id) AS last FROM gap GROUP BY ALL)
SELECT m.* FROM m JOIN run USING (invoke_id) WHERE seq >= first * 2 AND last > TIMESTAMP '2024-01-31' - INTERVAL 2 DAY
QUALIFY row_number() OVER (PARTITION BY invoke_id ORDER BY seq DESC) <= 10"""

LINE_OPEN, LINE_CLOSE = S.LINE_PARAGRAPH_OPEN, S.LINE_PARAGRAPH_CLOSE

QUERIES.update(
    ingest=ingested,
    upsert_chunks=upserted,
    load_chunks=stored_and_loaded,
    load_room=loaded_room,
    delete_room=lambda s, d: rooms(store.delete_room(stored_rows(s, d), "en")[0]),
    deleted_rows=lambda s, d: rooms(store.delete_room(stored_rows(s, d), "en")[1]),
    save_parents=saved_parents,
    delete_parents=lambda s, d: rooms(store.delete_room(parents.valid_parents(parent_rows(s, d)), "fr")[1]),
    load_parents=loaded_parents,
    orphan_files=orphans,
    metadata_round_trip=metadata,
    metadata_defaults=defaults,
    batch_progress=batches,
    stage_events=stages,
    fill_placeholders=filled,
    render_memo=memos,
    render_report=reports,
    last_item_mark=marked,
    decode_sse=lambda s, d: streamlog.decode_sse(lines_of(C.table(s, d, "events"))).select("request_id", "seq", "done", "delta"),
    concat_deltas=lambda s, d: streamlog.concat_deltas(saved(streamlog.decode_sse(lines_of(C.table(s, d, "events"))), "decoded")),
    last_answers=lambda s, d: streamlog.last_answers(streamlog.decode_sse(answer_lines(C.table(s, d, "events")))),
    stream_ingest=streamed_chunks,
    stream_history=streamed_history,
    stateful_history=remembered_rooms,
    stream_chat_log=streamed_log,
    doc_json_to_pages=lambda s, d: chunking.split_pages(flows.doc_json_to_markdown(J.pdf_documents(s, d))).drop("page_seq"),
)
ORACLE.update(
    ingest=K.SQL_KEYWORDS + f"""SELECT invoke_id, doc_id, chunk_seq, {C.SQL_ID} AS id, '[문서: ' || source || ' | 페이지: ' || page || ']' || chr(10) ||
  CASE WHEN keywords <> '' THEN '[키워드: ' || keywords || ']' || chr(10) ELSE '' END || chr(10) || text AS content, keywords FROM keyed""",
    upsert_chunks=SQL_STORE + "SELECT * FROM merged",
    load_chunks=SQL_STORE + "SELECT invoke_id, id, content, source, page FROM merged",
    load_room=SQL_STORE + "SELECT invoke_id, id, content, source, page FROM fresh WHERE invoke_id = 'new-room'",
    delete_room="SELECT lang AS invoke_id, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY ALL",
    deleted_rows="SELECT lang AS invoke_id, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY ALL",
    save_parents="""SELECT lang AS invoke_id, doc_id::VARCHAR AS parent_id, '2 ' || text AS content
FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 9 <> 0""",
    delete_parents="""SELECT lang AS invoke_id, count(*) AS n FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 9 <> 0 AND lang = 'fr' GROUP BY ALL""",
    load_parents="""
WITH want AS (SELECT doc_id AS request_id, unnest([0, 1, 2])::INT AS pos, unnest([doc_id, doc_id + 1, doc_id]) AS id FROM labels)
SELECT request_id, pos, id::VARCHAR AS parent_id, text AS content FROM want JOIN documents ON doc_id = id""",
    orphan_files="SELECT doc_id AS token, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    metadata_round_trip="""SELECT doc_id, to_json({'source': source, 'page': 1, 'keywords': text})::VARCHAR AS metadata,
  source, 1 AS page, text AS keywords FROM documents""",
    metadata_defaults="""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS content,
  CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 4 END AS page FROM documents""",
    batch_progress="""
WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq, count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, seq // 8 AS batch, max(seq) + 1 AS done, total, (50 + floor((max(seq) + 1) / total * 45))::INT AS percent FROM r GROUP BY source, seq // 8, total""",
    stage_events=C.SQL_CHUNKS + f""",
n AS (SELECT (SELECT count(*) FROM sheet WHERE length(t) > 0) AS pages, (SELECT count(*) FROM chunk) AS chunks,
  (SELECT count(*) FROM (SELECT DISTINCT invoke_id, {C.SQL_ID} FROM chunk)) AS written),
s AS (SELECT unnest(range(0, 8))::INT AS step, unnest([0, 5, 10, 15, 20, 30, 90, 100]) AS percent,
  unnest(['start', 'parse', 'parsed', 'keywords', 'chunked', 'index', 'indexed', 'done']) AS stage,
  unnest([NULL, NULL, pages, NULL, chunks, NULL, written, written]) AS n_rows FROM n)
SELECT 'documents' AS run_id, step, percent, stage, n_rows FROM s""",
    fill_placeholders="SELECT doc_id, source || ' ' || lang || ' ' || text AS text FROM documents",
    render_memo=f"""
SELECT doc_id, '<s><hp:p a>' || source || ' to ' || lang || ' via </hp:p>' || array_to_string(list_transform(string_split(text, chr(10)),
  lambda t: '{LINE_OPEN}' || t || '{LINE_CLOSE}'), '') || '<hp:p c>' || n_chars || '</hp:p></s>' AS document FROM documents""",
    last_item_mark="""
WITH i AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id % 5 <> 0),
e AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS t, generate_subscripts(ls, 1) AS k FROM i)
SELECT doc_id, (k - 1)::INT AS pos, t || CASE WHEN k = n AND doc_id % 4 <> 0 THEN '  끝.' ELSE '' END AS text, ((k - 1) % 2 + 1)::INT AS level FROM e
UNION ALL SELECT doc_id, 0, '끝.', 1 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 4 <> 0""",
    render_report="""
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k,
    len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 5 <> 0),
p AS (SELECT doc_id, string_agg('<hp:p id="0" paraPrIDRef="' || CASE WHEN k % 2 = 1 THEN '28" styleIDRef="2' ELSE '29" styleIDRef="1' END
    || '"><hp:run charPrIDRef="19"><hp:t>' || t || CASE WHEN k = n AND doc_id % 4 <> 0 THEN '  끝.' ELSE '' END || '</hp:t></hp:run></hp:p>', '' ORDER BY k) AS b
  FROM e GROUP BY ALL),
w AS (SELECT d.doc_id, source, CASE WHEN d.doc_id % 5 <> 0 THEN b WHEN d.doc_id % 4 = 0 THEN ''
    ELSE '<hp:p id="0" paraPrIDRef="28" styleIDRef="2"><hp:run charPrIDRef="19"><hp:t>끝.</hp:t></hp:run></hp:p>' END AS b FROM documents d LEFT JOIN p USING (doc_id))
SELECT doc_id, '<s><hp:p>' || source || '</hp:p>' || b || '<hp:p>mid</hp:p>' || b || '</s>' AS document FROM w""",
    decode_sse=SQL_LINES + """SELECT user_id AS request_id, event_id AS seq, kind = 'done' AS done, CASE WHEN kind = 'delta' THEN props END AS delta
FROM line WHERE kind IN ('done', 'delta')""",
    concat_deltas=SQL_DELTAS,
    stream_chat_log=SQL_DELTAS,
    last_answers="SELECT user_id AS request_id, arg_max(props, event_id) AS text FROM events WHERE event_type = 'view' GROUP BY ALL",
    stream_ingest=SQL_STREAM_CHUNKS,
    stream_history=SQL_ROOMS,
    stateful_history=SQL_ROOMS,
    doc_json_to_pages=f"""
WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::INT AS page FROM documents),
p AS (SELECT doc_id, page, t AS text FROM line UNION ALL SELECT doc_id, 1, '# ' || source FROM documents
  UNION ALL SELECT doc_id, 0, substring({J.SQL_LAST_PAGE}, 19) FROM documents)
SELECT doc_id, page, {C.sql_strip('text')} AS text FROM p WHERE {C.sql_strip('text')} <> ''""",
)
