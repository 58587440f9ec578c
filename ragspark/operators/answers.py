"""Question fan-out, prompts, and fan-in of the answers."""

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X

ANALYSIS_TYPE = "is_clear boolean, clarification_message string, rewritten_questions array<string>, reasoning string"


def parse_analysis(response, original, clarify=S.PROMPT_CLARIFY):
    """STRUCT<is_clear, questions, clarification, awaiting> of one model response.

    Empty and unreadable responses count as clear and keep the original question.
    """
    own = F.array(original)
    empty = F.length(F.coalesce(response, F.lit(""))) == 0
    body = X.strip_code_fence(F.coalesce(response, F.lit("")))

    def read(p):
        clear = F.coalesce(p["is_clear"], F.lit(True))
        asked = p["rewritten_questions"]
        questions = F.when(F.size(F.coalesce(asked, F.array().cast("array<string>"))) > 0, asked).otherwise(own)
        message = F.coalesce(p["clarification_message"], F.lit(clarify))
        return F.struct(
            clear.alias("is_clear"), questions.alias("questions"),
            F.when(~clear, message).alias("clarification"),
            F.when(~empty, ~clear).alias("awaiting"),
        )

    return X.let(F.from_json(body, ANALYSIS_TYPE), read)


def route(analyzed):
    """(searchable, waiting) rows; waiting rows need a clearer question."""
    clear = F.coalesce("is_clear", F.lit(False))
    return analyzed.where(clear), analyzed.where(~clear)


def explode_questions(analyzed, original="original", limit=None):
    """One row per question with its index; an empty first question yields none. ``limit`` caps the list."""
    empty = F.array().cast("array<string>")
    asked = F.when(F.size(F.coalesce("questions", empty)) > 0, F.col("questions")).otherwise(F.array(original))
    if limit:
        asked = F.slice(asked, 1, limit)
    usable = X.let(asked, lambda q: F.when(~X.is_null_or_empty(F.element_at(q, 1)), q).otherwise(empty))
    keep = [c for c in analyzed.columns if c != "questions"]
    return analyzed.select(*keep, F.posexplode(usable).alias("idx", "question"))


def hybrid_context(passages, relations):
    """One row per question with both contexts; either side may be missing."""
    return passages.join(relations, ["thread_id", "idx"], "full").withColumn(
        "graph_context", F.coalesce("graph_context", F.lit(""))
    )


def has_evidence():
    return ~(X.is_null_or_empty(F.col("context")) & X.is_null_or_empty(F.col("graph_context")))


def choose_prompt(plain=S.PROMPT_PLAIN, cross=S.PROMPT_CROSS, missing=S.PROMPT_NO_PASSAGES):
    """Prompt over ``question``, ``context``, ``graph_context``; null where there is no evidence at all."""
    with_graph = X.literal_template(
        cross, question=F.col("question"), graph=F.col("graph_context"),
        context=F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit(missing)),
    )
    without = X.literal_template(plain, question=F.col("question"), context=F.col("context"))
    return F.when(has_evidence(), F.when(~X.is_null_or_empty(F.col("graph_context")), with_graph).otherwise(without))


def combine_answers(threads, answers, prompt=S.PROMPT_MERGE):
    """Per thread: a fixed message (no answer), the answer itself (one), or the merging prompt (several).

    ``answers(thread_id, idx, answer)`` with ``idx`` counting from 0.
    """
    head, tail = prompt.split("{answers}")
    section = F.concat(
        F.lit("\n" + S.ANSWER_HEADING), (F.col("idx") + 1).cast("string"), F.lit("\n"), "answer", F.lit("\n")
    )
    ordered = F.array_sort(F.collect_list(F.struct("idx", section.alias("section"), "answer")))
    rows = answers.groupBy("thread_id").agg(ordered.alias("_rows"))
    sections = F.array_join(F.transform("_rows", lambda r: r["section"]), "")
    closing = X.literal_template(tail, question=F.col("original")) if tail else F.lit("")
    n = F.coalesce(F.size("_rows"), F.lit(0))
    text = (
        F.when(F.col("_rows").isNull(), F.lit(S.NO_ANSWERS))
        .when(n == 1, F.element_at("_rows", 1)["answer"])
        .otherwise(F.concat(X.literal_template(head, question=F.col("original")), sections, closing))
    )
    joined = threads.select("thread_id", "original").join(rows, "thread_id", "left")
    counted = F.when(F.col("_rows").isNull(), 0).otherwise(F.size("_rows")).cast("long")
    return joined.select("thread_id", counted.alias("n_answers"), text.alias("text"))


def merge_references(answers):
    """Distinct references of each thread with the place of their first use (answer index, position)."""
    used = answers.select("thread_id", "idx", F.posexplode("sources").alias("pos", "r"))
    first = F.min(F.struct("idx", "pos"))
    return (
        used.groupBy("thread_id", F.col("r.source").alias("source"), F.col("r.page").alias("page"))
        .agg(first.alias("_first")).select("thread_id", "source", "page", "_first.idx", "_first.pos")
    )


def chat_payload(question, context, history, model, max_tokens=4096, temperature=0.0, system=S.CHAT_SYSTEM,
                 with_context=S.CHAT_WITH_CONTEXT, without_context=S.CHAT_WITHOUT_CONTEXT):
    """Request JSON: system message, history ARRAY<STRUCT<role, content>>, then the question."""
    user = F.when(X.is_null_or_empty(context), X.literal_template(without_context, question=question)).otherwise(
        X.literal_template(with_context, question=question, context=context)
    )
    nothing = F.array().cast("array<struct<role:string,content:string>>")
    messages = F.concat(
        F.array(message("system", F.lit(system))), F.coalesce(history, nothing), F.array(message("user", user))
    )
    return request(messages, model, max_tokens, temperature)


def message(role, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def request(messages, model, max_tokens, temperature):
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"), messages.alias("messages"), F.lit(max_tokens).alias("max_tokens"),
            F.lit(float(temperature)).alias("temperature"),
        )
    )


def summary_payload(transcript, model, system=None, output_format=None, extra=None, max_tokens=4096,
                    temperature=0.0):
    """Request JSON for a call summary; null or empty overrides fall back to the defaults."""

    def chosen(value, default):
        return F.lit(default) if value is None else F.coalesce(F.nullif(value, F.lit("")), F.lit(default))

    instructions = F.concat(chosen(system, S.SUMMARY_SYSTEM), F.lit("\n"), chosen(output_format, S.SUMMARY_FORMAT))
    if extra is not None:
        added = F.concat(F.lit(f"\n\n{S.SUMMARY_EXTRA_HEADING}\n"), extra)
        instructions = F.concat(instructions, F.when(X.is_null_or_empty(extra), F.lit("")).otherwise(added))
    user = F.concat(F.lit(f"{S.SUMMARY_LEAD_IN}\n\n"), transcript)
    return request(F.array(message("system", instructions), message("user", user)), model, max_tokens, temperature)
