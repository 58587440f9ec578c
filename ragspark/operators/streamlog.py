"""Stored response streams: decode the lines and fold them into answers."""

from pyspark.sql import functions as F

from ragspark.functions import text as X
from ragspark.operators import skew

RECORD = "choices array<struct<delta:struct<content:string>>>, type string, content string"


def decode_line(line):
    """STRUCT<done, delta, answer> of one ``data:`` line, with or without a blank; null for other lines and unreadable JSON."""

    def read(data):
        done = data == "[DONE]"

        def fields(r):
            delta = F.get(r["choices"], 0)["delta"]["content"]
            answer = F.when(r["type"] == "answer", F.coalesce(r["content"], F.lit("")))
            decoded = F.struct(done.alias("done"), delta.alias("delta"), answer.alias("answer"))
            return F.when(done | delta.isNotNull() | answer.isNotNull(), decoded)

        return X.let(F.from_json(F.when(~done, data), RECORD), fields)

    body = F.btrim(F.substring(line, F.lit(6), F.length(line)))
    return F.when(line.startswith("data:"), X.let(body, read))


def decode_sse(lines, line="line"):
    keep = [c for c in lines.columns if c != line]
    # exploding a list of at most one record parses each line once however many fields are used
    record = F.array_compact(F.array(decode_line(F.col(line))))
    return lines.select(*keep, F.explode(record).alias("d")).select(*keep, "d.done", "d.delta", "d.answer")


def concat_deltas(decoded, key="request_id", order="seq"):
    """Text of each request up to its first end mark: one row, as an answer is one value."""
    marks = decoded.groupBy(key).agg(
        F.min(F.when(F.col("done"), F.col(order))).alias("_end"), F.count(F.lit(1)).alias("_n")
    )
    hot = skew.hot_keys(marks, [key], "_n")
    kept = skew.salted_join(decoded, marks.drop("_n"), [key], hot, spread=[order]).where(
        "delta IS NOT NULL AND delta <> ''"
    ).where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), "delta")))
    return kept.groupBy(key).agg(F.array_join(F.transform(pieces, lambda s: s["delta"]), "").alias("text"))


def last_answers(decoded, key="request_id", order="seq"):
    """Last answer record of each request; requests whose answer is empty are left out."""
    own = F.when(F.col("answer").isNotNull(), F.col(order))
    return decoded.groupBy(key).agg(F.max_by("answer", own).alias("text")).where("text <> ''")
