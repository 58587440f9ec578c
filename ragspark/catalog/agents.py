"""Question analysis, fan-out and fan-in, prompts, payloads."""

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.catalog import common as C
from ragspark.catalog import talk
from ragspark.functions import text as X
from ragspark.operators import answers as A
from ragspark.operators import inference, memory
from ragspark.plans import flows
from ragspark.session import shared_folder
from ragspark.sources import store

QUERIES, ORACLE = {}, {}


def threads(spark, folder):
    """One thread per user turn with a model response of seven shapes: good, fenced, empty, broken, unclear (2), no list."""
    text = F.col("text")
    shape = (F.col("conv_id") + F.col("turn")) % 7
    asked = F.array(text, F.concat(F.lit("More: "), text))

    def js(clear, questions, message=None):
        fields = [F.lit(clear).alias("is_clear"), questions.alias("rewritten_questions")]
        if message:
            fields.append(F.lit(message).alias("clarification_message"))
        return F.to_json(F.struct(*fields))

    none = F.array().cast("array<string>")
    response = (
        F.when(shape == 0, js(True, asked))
        .when(shape == 1, F.concat(F.lit("```json\n"), js(True, asked), F.lit("\n```")))
        .when(shape == 2, F.lit(""))
        .when(shape == 3, F.substring(js(True, asked), 1, 30))
        .when(shape == 4, js(False, asked, "Which one?"))
        .when(shape == 5, js(False, none))
        .otherwise(js(True, none))
    )
    return C.table(spark, folder, "conversations").where("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("thread_id"),
        "conv_id", text.alias("original"), response.alias("response"),
    )


SQL_THREADS = f"""
WITH thread AS (
  SELECT conv_id || '-' || turn AS thread_id, conv_id, text AS original, (conv_id + turn) % 7 AS shape
  FROM conversations WHERE role = 'user'),
parsed AS (
  SELECT *, shape NOT IN (4, 5) AS is_clear,
    CASE WHEN shape IN (0, 1, 4) THEN [original, 'More: ' || original] ELSE [original] END AS questions,
    CASE WHEN shape = 4 THEN 'Which one?' WHEN shape = 5 THEN {C.quoted(S.PROMPT_CLARIFY)} END AS clarification,
    CASE WHEN shape <> 2 THEN shape IN (4, 5) END AS awaiting FROM thread),
question AS (
  SELECT thread_id, conv_id, original, (generate_subscripts(questions, 1) - 1)::INT AS idx, unnest(questions) AS question
  FROM parsed WHERE is_clear AND original <> ''),
evidence AS (
  SELECT *, CASE WHEN conv_id % 2 = 0 THEN '<documents>' || question || '</documents>' END AS context,
    CASE WHEN conv_id % 3 = 0 THEN '(a) -[B]-> (' || question || ')' ELSE '' END AS graph_context FROM question),
prompted AS (
  SELECT *, CASE WHEN graph_context <> '' THEN
      {C.quoted(S.PROMPT_CROSS).replace('{question}', "' || question || '").replace('{graph}', "' || graph_context || '")
       .replace('{context}', "' || coalesce(context, " + C.quoted(S.PROMPT_NO_PASSAGES) + ") || '")}
    WHEN context IS NOT NULL THEN {C.quoted(S.PROMPT_PLAIN).replace('{question}', "' || question || '").replace('{context}', "' || context || '")}
    END AS prompt FROM evidence),
answered AS (
  SELECT *, CASE WHEN prompt IS NULL THEN '''' || question || '''{S.NO_EVIDENCE_SUFFIX}' ELSE md5(prompt) END AS answer
  FROM prompted),
counted AS (SELECT thread_id, count(*) AS n FROM answered GROUP BY ALL),
final AS (
  SELECT t.thread_id, coalesce(n, 0) AS n_answers,
    CASE WHEN n IS NULL THEN '{S.NO_ANSWERS}' WHEN n = 1 THEN any_value(a.answer)
      ELSE 'Merge the answers below into one answer to: ' || t.original || chr(10) ||
        string_agg(chr(10) || '### 답변 ' || (a.idx + 1) || chr(10) || a.answer || chr(10), '' ORDER BY a.idx) END AS text
  FROM parsed t LEFT JOIN counted USING (thread_id) LEFT JOIN answered a ON a.thread_id = t.thread_id
  WHERE t.is_clear GROUP BY t.thread_id, t.original, n)
"""


def questions(spark, folder):
    return A.explode_questions(A.route(flows.analyze(threads(spark, folder)))[0])


def passages(asked):
    cited = F.array(
        F.struct(F.concat(F.lit("f"), (F.col("conv_id") % 5).cast("string")).alias("source"), F.lit(1).alias("page")),
        F.struct(F.lit("common").alias("source"), F.col("idx").alias("page")),
        F.struct(F.lit("common").alias("source"), F.lit(0).alias("page")),
    )
    return asked.where("conv_id % 2 = 0").select(
        "thread_id", "idx",
        F.concat(F.lit("<documents>"), F.col("question"), F.lit("</documents>")).alias("context"),
        cited.alias("references"),
    )


def relations(asked):
    return asked.where("conv_id % 3 = 0").select(
        "thread_id", "idx", F.concat(F.lit("(a) -[B]-> ("), F.col("question"), F.lit(")")).alias("graph_context")
    )


def answered(spark, folder):
    return flows.answer_questions(threads(spark, folder), passages, relations, inference.digest())


def evidence(spark, folder):
    asked = questions(spark, folder)
    found = A.hybrid_context(passages(asked), relations(asked))
    return asked.select("thread_id", "idx", "question").join(found, ["thread_id", "idx"], "left")


def chat(spark, folder):
    msgs = talk.messages(spark, folder)
    window = memory.history_window(msgs)
    line = F.struct("seq", F.struct("role", "content").alias("m"))
    history = window.groupBy("invoke_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["m"]).alias("history"))
    asked = memory.last_message(msgs).join(history, "invoke_id", "left")
    context = F.when(F.col("invoke_id") % 2 == 0, F.lit("<documents>x</documents>"))
    payload = A.chat_payload(F.col("content"), context, F.col("history"), "m1")
    return asked.select("invoke_id", payload.alias("payload"))


def call_responses(spark, folder):
    """Each conversation turn is a recognised call under one of three response keys; every eleventh is silent."""
    turn = C.table(spark, folder, "conversations")
    key = F.col("conv_id") % 3
    heard = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.lit("")).otherwise(F.col("text"))
    response = (
        F.when(key == 0, F.to_json(F.struct(heard.alias("transcription"))))
        .when(key == 1, F.to_json(F.struct(F.lit("").alias("transcription"), heard.alias("text"))))
        .otherwise(F.to_json(F.struct(heard.alias("transcript"))))
    )
    call_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turn.select(call_id.alias("call_id"), response.alias("response"))


SQL_CALLS = """
WITH call AS (
  SELECT conv_id || '-' || turn AS call_id, CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS transcript
  FROM conversations)
"""

def written_results(spark, folder):
    """Call summaries as a user keeps them: written to a table and read back."""
    path = shared_folder(spark, "results")
    store.write_results(flows.call_summaries(call_responses(spark, folder), model=inference.digest())[0], path)
    return spark.read.parquet(path)


QUERIES.update(
    parse_analysis=lambda s, d: flows.analyze(threads(s, d)).select(
        "thread_id", "is_clear", F.array_join("questions", "|").alias("questions"), "clarification", "awaiting"
    ),
    strip_code_fence=lambda s, d: threads(s, d).select("thread_id", X.strip_code_fence(F.col("response")).alias("body")),
    route=lambda s, d: A.route(flows.analyze(threads(s, d)))[1].select("thread_id", "clarification"),
    explode_questions=lambda s, d: questions(s, d).select("thread_id", "idx", "question"),
    explode_questions_capped=lambda s, d: A.explode_questions(A.route(flows.analyze(threads(s, d)))[0], limit=2).select("thread_id", "idx", "question"),
    transcribe=lambda s, d: inference.transcribe(
        C.table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    ).select("doc_id", "response"),
    write_results=written_results,
    hybrid_context=lambda s, d: evidence(s, d).drop("references"),
    choose_prompt=lambda s, d: evidence(s, d).select("thread_id", "idx", A.choose_prompt().alias("prompt")),
    no_evidence_answer=lambda s, d: evidence(s, d).where(~A.has_evidence()).select(
        "thread_id", "idx", X.no_evidence_answer(F.col("question")).alias("answer")
    ),
    answer_questions=lambda s, d: answered(s, d)[0],
    final_answers=lambda s, d: flows.merge_texts(answered(s, d)[0], inference.digest()),
    merge_references=lambda s, d: answered(s, d)[1],
    chat_payload=chat,
    transcript_of=lambda s, d: flows.call_summaries(call_responses(s, d))[0].select("call_id", "transcript"),
    call_failures=lambda s, d: flows.call_summaries(call_responses(s, d))[1],
    call_summaries=lambda s, d: flows.call_summaries(call_responses(s, d), model=inference.digest())[0].select(
        "call_id", "summary", "duration_seconds"
    ),
    summary_payload=lambda s, d: C.table(s, d, "documents").select(
        "doc_id", A.summary_payload(F.col("text"), "m1", extra=F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("payload")
    ),
)
SUMMARY_HEAD = f"{S.SUMMARY_SYSTEM}\n{S.SUMMARY_FORMAT}"
ORACLE.update(
    parse_analysis=SQL_THREADS + "SELECT thread_id, is_clear, array_to_string(questions, '|') AS questions, clarification, awaiting FROM parsed",
    route=SQL_THREADS + "SELECT thread_id, clarification FROM parsed WHERE NOT is_clear",
    explode_questions=SQL_THREADS + "SELECT thread_id, idx, question FROM question",
    explode_questions_capped=SQL_THREADS + "SELECT thread_id, idx, question FROM question WHERE idx < 2",
    transcribe="SELECT doc_id, text AS response FROM documents",
    write_results=SQL_CALLS + f"""SELECT transcript, 0.0::DOUBLE AS duration_seconds, md5(to_json({{'model': 'model', 'messages': [
  {{'role': 'system', 'content': {C.quoted(SUMMARY_HEAD)}}}, {{'role': 'user', 'content': {C.quoted(S.SUMMARY_LEAD_IN + chr(10) * 2)} || transcript}}],
  'max_tokens': 4096, 'temperature': 0.0::DOUBLE}})::VARCHAR) AS summary FROM call WHERE transcript <> ''""",
    hybrid_context=SQL_THREADS + "SELECT thread_id, idx, question, context, CASE WHEN context IS NULL AND graph_context = '' THEN NULL ELSE graph_context END AS graph_context FROM evidence",
    choose_prompt=SQL_THREADS + "SELECT thread_id, idx, prompt FROM prompted",
    no_evidence_answer=SQL_THREADS + "SELECT thread_id, idx, answer FROM answered WHERE prompt IS NULL",
    answer_questions=SQL_THREADS + "SELECT * FROM final",
    final_answers=SQL_THREADS + "SELECT thread_id, n_answers, CASE WHEN n_answers > 1 THEN md5(text) ELSE text END AS text FROM final",
    merge_references=SQL_THREADS + """, ref AS (
  SELECT thread_id, idx, 0 AS pos, 'f' || conv_id % 5 AS source, 1 AS page FROM evidence WHERE context IS NOT NULL
  UNION ALL SELECT thread_id, idx, 1, 'common', idx FROM evidence WHERE context IS NOT NULL
  UNION ALL SELECT thread_id, idx, 2, 'common', 0 FROM evidence WHERE context IS NOT NULL)
SELECT thread_id, source, page, idx, pos FROM ref
QUALIFY row_number() OVER (PARTITION BY thread_id, source, page ORDER BY idx, pos) = 1""",
    transcript_of=SQL_CALLS + "SELECT * FROM call WHERE transcript <> ''",
    call_failures=SQL_CALLS + "SELECT call_id, 'empty transcript' AS error FROM call WHERE transcript = ''",
    call_summaries=SQL_CALLS + f"""SELECT call_id, 0.0::DOUBLE AS duration_seconds, md5(to_json({{'model': 'model', 'messages': [
  {{'role': 'system', 'content': {C.quoted(SUMMARY_HEAD)}}}, {{'role': 'user', 'content': {C.quoted(S.SUMMARY_LEAD_IN + chr(10) * 2)} || transcript}}],
  'max_tokens': 4096, 'temperature': 0.0::DOUBLE}})::VARCHAR) AS summary FROM call WHERE transcript <> ''""",
    chat_payload=f"""
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER w AS rn, sum(length(text)) OVER w AS total FROM conversations
  WHERE role <> 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
h AS (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn) AS history FROM m WHERE rn = 1 OR (rn <= 5 AND total <= 2500) GROUP BY ALL),
q AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT q.conv_id AS invoke_id, to_json({{'model': 'm1', 'messages': list_concat(list_concat(
  [{{'role': 'system', 'content': {C.quoted(S.CHAT_SYSTEM)}}}], coalesce(history, [])), [{{'role': 'user', 'content':
  CASE WHEN q.conv_id % 2 = 0 THEN {C.quoted(S.CHAT_WITH_CONTEXT).replace('{question}', "' || text || '").replace('{context}', '<documents>x</documents>')}
  ELSE {C.quoted(S.CHAT_WITHOUT_CONTEXT).replace('{question}', "' || text || '")} END}}]),
  'max_tokens': 4096, 'temperature': 0.0::DOUBLE}})::VARCHAR AS payload FROM q LEFT JOIN h USING (conv_id)""",
    summary_payload=f"""
SELECT doc_id, to_json({{'model': 'm1', 'messages': [
  {{'role': 'system', 'content': {C.quoted(SUMMARY_HEAD)} || CASE WHEN doc_id % 2 = 0 THEN {C.quoted(chr(10) * 2 + S.SUMMARY_EXTRA_HEADING + chr(10))} || lang ELSE '' END}},
  {{'role': 'user', 'content': {C.quoted(S.SUMMARY_LEAD_IN + chr(10) * 2)} || text}}], 'max_tokens': 4096, 'temperature': 0.0::DOUBLE}})::VARCHAR AS payload
FROM documents""",
    strip_code_fence=SQL_THREADS + """, js AS (
  SELECT *, to_json([original, 'More: ' || original])::VARCHAR AS qs FROM parsed)
SELECT thread_id, CASE
  WHEN shape IN (0, 1) THEN '{"is_clear":true,"rewritten_questions":' || qs || '}'
  WHEN shape = 2 THEN '' WHEN shape = 3 THEN trim(substring('{"is_clear":true,"rewritten_questions":' || qs || '}', 1, 30))
  WHEN shape = 4 THEN '{"is_clear":false,"rewritten_questions":' || qs || ',"clarification_message":"Which one?"}'
  WHEN shape = 5 THEN '{"is_clear":false,"rewritten_questions":[]}' ELSE '{"is_clear":true,"rewritten_questions":[]}' END AS body FROM js""",
)
