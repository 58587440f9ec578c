"""Deterministic keywords and graph facts, used where no model is configured."""

from heapq import nsmallest
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions import text as X
from ragspark.operators import skew
from ragspark.session import saved, small_batches

#: A dictionary of at most so many terms may be held by every task, twelve bytes a term.
TASK_TERMS = 12_000_000
#: Chunks that are scored at once.
ROWS_HELD = 512
# distinct terms of a full chunk, to turn chunk counts into row counts
TERMS_PER_CHUNK = 128


def terms_of(c):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def document_frequencies(chunks, scope, text):
    """(scope, term, df) of every term; the empty term carries the number of chunks of the scope."""
    seen = F.array_append(F.array_distinct(terms_of(F.col(text))), F.lit(""))
    return chunks.select(*scope, F.explode(seen).alias("term")).groupBy(*scope, "term").agg(
        F.count(F.lit(1)).alias("df")
    )


def _scored_in_tasks(chunks, counted, n, scope, text):
    """Chunks with their keywords, scored where they lie by a dictionary that every task holds; nothing is shuffled.

    The dictionary is two sorted arrays, the 64-bit hashes of (scope, term) and the counts: twelve bytes a term.
    """
    small_batches(chunks.sparkSession)
    sizes = {tuple(own): df for *own, df in counted.where("term = ''").select(*scope, "df").toLocalIterator()}
    held = counted.where("term <> '' AND df > 1").select(F.xxhash64(*scope, "term").alias("h"), F.col("df").cast("int").alias("df")).toArrow()
    hashes, counts = held.column("h").to_numpy(), held.column("df").to_numpy()
    order = np.argsort(hashes)
    sent = chunks.sparkSession.sparkContext.broadcast((sizes, hashes[order], counts[order]))
    schema = T.StructType([*(f for f in chunks.schema.fields if f.name != "keywords"), T.StructField("keywords", T.StringType())])
    names = schema.names[:-1]

    def run(batches):
        sizes, hashes, counts = sent.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS_HELD):
                own = b.slice(at, ROWS_HELD)
                scopes = list(zip(*(own.column(c).to_pylist() for c in scope)))
                size = np.array([sizes.get(s, 0) if None not in s else 0 for s in scopes], float)
                found = _best_terms(own.column("_terms"), own.column("_hashes"), size, hashes, counts, n)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(found, pa.string())], names=[*names, "keywords"])

    words = chunks.select(*names, terms_of(F.col(text)).alias("_terms"))
    return words.withColumn("_hashes", F.transform("_terms", lambda t: F.xxhash64(*scope, t))).mapInArrow(run, schema)


def _best_terms(terms, hashed, size, hashes, counts, n):
    """Per row the ``n`` best terms; only those whose weight comes near the n-th are weighed and compared as texts."""
    flat, h = terms.flatten(), hashed.flatten().to_numpy()
    row = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy())
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(row[order]) != 0) | (np.diff(h[order]) != 0)
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(h)))
    at, own, row = order[first], h[order[first]], row[order[first]]
    df = np.ones(len(own), np.int64)
    if len(hashes):
        different, back = np.unique(own, return_inverse=True)
        place = np.minimum(np.searchsorted(hashes, different), len(hashes) - 1)
        df = np.where(hashes[place] == different, counts[place], 1)[back]
    weight = tf * np.log(np.maximum(size[row], 1) / df)
    edge = np.searchsorted(row, np.arange(len(terms) + 1))
    found = []
    for k in range(len(terms)):
        a, z = edge[k], edge[k + 1]
        if a == z or not size[k]:
            found.append("")
            continue
        w = weight[a:z]
        near = np.arange(a, z) if z - a <= n else a + np.flatnonzero(w >= np.partition(w, len(w) - n)[len(w) - n] - 1e-8)
        words = flat.take(pa.array(at[near])).to_pylist()
        weighed = ((-round(t * log(size[k] / d), 9), word) for t, d, word in zip(tf[near].tolist(), df[near].tolist(), words))
        found.append(", ".join(word for _, word in nsmallest(n, weighed)))
    return found


def tfidf_keywords(chunks, n=10, scope=("invoke_id",), key=("id",), text="text",
                   max_broadcast_rows=skew.MAX_LOOKUP_ROWS, rows_per_task=skew.ROWS_PER_TASK, task_terms=TASK_TERMS):
    """Adds ``keywords``: the ``n`` terms with the largest tf * ln(N / df), ties by term, comma separated.

    The dictionary is written once, so its size is known: one that a task can hold is sent to every task, and chunks
    stay where they are. Chunks without a scope have none. A larger one is sent as a table, or joined by term with frequent terms spread over several tasks. Terms
    seen in one chunk only are left out of it, because a term that is not found has a df of 1.
    """
    scope, key = list(scope), list(key)
    on = [*scope, "term"]
    counted = saved(document_frequencies(chunks, scope, text), "terms")
    if counted.where("term = '' OR df > 1").count() <= task_terms:
        return _scored_in_tasks(chunks, counted, n, scope, text)
    size = counted.where("term = ''").select(*scope, F.col("df").alias("_size"))
    frequent = counted.where("term <> '' AND df > 1")

    words = chunks.select(*scope, *key, F.col(text).alias("_cut")).repartition(*scope, *key)
    tf = words.select(*scope, *key, F.explode(terms_of(F.col("_cut"))).alias("term")).groupBy(
        *scope, *key, "term"
    ).agg(F.count(F.lit(1)).alias("tf"))
    hot_terms = skew.hot_keys(frequent, on, "df", rows_per_task)
    found = skew.lookup_join(tf, frequent, on, hot_terms, "left", key, max_broadcast_rows)
    hot_scopes = skew.hot_keys(size, scope, "_size", max(1, rows_per_task // TERMS_PER_CHUNK))
    sized = skew.lookup_join(found, size, scope, hot_scopes, "inner", key, max_broadcast_rows)
    idf = F.ln(F.col("_size") / F.coalesce("df", F.lit(1)))
    weight = F.struct((-F.round(F.col("tf") * idf, 9)).alias("w"), F.col("term"))
    ranked = F.array_sort(F.collect_list(weight))
    best = sized.groupBy(*scope, *key).agg(
        F.array_join(F.transform(F.slice(ranked, 1, n), lambda s: s["term"]), ", ").alias("keywords")
    )
    return chunks.join(best, [*scope, *key], "left").withColumn("keywords", F.coalesce("keywords", F.lit("")))


def cooccurrence_graph(keyed, keywords="keywords", graph="graph"):
    """Entities are a chunk's keywords; every alphabetical pair of its few keywords is one relation."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.col(keywords), ", "), lambda w: F.length(w) > 0)))

    def facts(ws):
        entities = F.transform(
            ws,
            lambda w: F.struct(w.alias("name"), F.lit("Keyword").alias("type"), F.lit("").alias("description")),
        )
        pairs = F.flatten(
            F.transform(
                ws,
                lambda a: F.transform(
                    F.filter(ws, lambda b: b > a),
                    lambda b: F.struct(
                        a.alias("source"), b.alias("target"), F.lit("CO_OCCURS").alias("type"),
                        F.lit("").alias("description"),
                    ),
                ),
            )
        )
        return F.struct(entities.alias("entities"), pairs.alias("relationships"))

    return keyed.withColumn(graph, X.let(words, facts))
