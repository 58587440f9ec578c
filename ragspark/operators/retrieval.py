"""Late-interaction search: exact top-k scoring, then joins and filters on the few surviving hits."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X
from ragspark.operators import packed, skew

D = S.DEFAULTS
HIT_FIELDS = "invoke_id string, query_id string, doc_id string, score double"
HIT_ARROW = pa.schema(
    [("invoke_id", pa.string()), ("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())]
)
# Queries are sent to every task only below both limits; beyond them they are shuffled in blocks.
QUERY_ROWS = 4096
QUERY_TOKENS = 65_536
QUERY_BYTES = 64 << 20
CHUNKS_PER_BLOCK = 1024
QUERIES_PER_BLOCK = 256
# a room has at most about this many blocks a side before they grow to the sizes above
ROOM_BLOCKS = 16
# cells of the largest query-token by document-token matrix held at once
MATRIX_CELLS = 8_000_000


def token_matrix(tokens, keys, position, vector="embedding"):
    """Rows of token vectors to one ragged matrix per key, tokens in ``position`` order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(vector).alias("v"))))
    return tokens.groupBy(*keys).agg(F.transform(ordered, lambda t: t["v"]).alias("vectors"))


def maxsim(query, doc):
    """Sum over query tokens of the largest dot product with a document token, to 6 places."""

    def dot(a, b):
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    best = F.transform(query, lambda a: F.array_max(F.transform(doc, lambda b: dot(a, b))))
    return F.round(F.aggregate(best, F.lit(0.0), lambda s, v: s + v), 6)


def _matrices(column):
    """Token matrix of all rows stacked and the row each text starts at, from packed values or nested arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return packed.matrices(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False)
    count = int(starts[-1])
    return flat.reshape(count, -1) if count else flat.reshape(0, 0), starts


def _scores(q_tokens, q_starts, d_tokens, d_starts):
    """MaxSim of every query (rows) with every document (columns); empty ones score 0."""
    n_q, n_d = len(q_starts) - 1, len(d_starts) - 1
    out = np.zeros((n_q, n_d))
    has_q, has_d = np.diff(q_starts) > 0, np.diff(d_starts) > 0
    if not has_q.any() or not has_d.any():
        return out
    docs = np.flatnonzero(has_d)
    q_tokens = q_tokens.astype(np.float64)
    begins, ends = d_starts[docs], d_starts[docs + 1]
    widest = max(1, MATRIX_CELLS // max(1, len(q_tokens)))
    at = 0
    while at < len(docs):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + widest, side="right")))
        products = q_tokens @ d_tokens[begins[at] : ends[to - 1]].astype(np.float64).T
        best = np.maximum.reduceat(products, begins[at:to] - begins[at], axis=1)
        out[np.ix_(has_q, docs[at:to])] = np.add.reduceat(best, q_starts[:-1][has_q], axis=0)
        at = to
    return np.round(out, 6)


def _best(scores, ids, k):
    """Positions of the k best (score descending, id ascending) of one query."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= bar)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


class RunningTop:
    """Best k hits per query seen so far in one task."""

    def __init__(self, query_ids, k):
        self.query_ids, self.k = query_ids, k
        self.hits = [(np.empty(0), np.empty(0, dtype=object))] * len(query_ids)

    def add(self, scores, ids):
        for i, row in enumerate(scores):
            near = _best(row, ids, self.k)
            s = np.concatenate((self.hits[i][0], row[near]))
            d = np.concatenate((self.hits[i][1], ids[near]))
            top = _best(s, d, self.k)
            self.hits[i] = (s[top], d[top])

    def table(self, room):
        n = [len(s) for s, _ in self.hits]
        return pa.table(
            [
                pa.array([room] * sum(n), pa.string()),
                pa.array(np.repeat(self.query_ids, n).tolist(), pa.string()),
                pa.array([x for _, d in self.hits for x in d], pa.string()),
                pa.array([float(x) for s, _ in self.hits for x in s], pa.float64()),
            ],
            schema=HIT_ARROW,
        )


def _column(table, name):
    return np.array(table.column(name).to_pylist(), dtype=object)


def _search_tables(queries, chunks, room, k):
    top = RunningTop(_column(queries, "query_id"), k)
    top.add(
        _scores(*_matrices(queries.column("q_vectors")), *_matrices(chunks.column("vectors"))),
        _column(chunks, "doc_id"),
    )
    return top.table(room)


def _candidates_small(queries, chunks, k):
    """Queries travel to every task; chunks are not shuffled and leave at most k rows per query and task."""
    spark = chunks.sparkSession
    by_room = {}
    table = queries.toArrow()
    rooms = _column(table, "invoke_id")
    for room in set(rooms):
        part = table.filter(pa.array(rooms == room))
        by_room[room] = (_column(part, "query_id"), *_matrices(part.column("q_vectors")))
    sent = spark.sparkContext.broadcast(by_room)

    def score(batches):
        tops = {}
        for batch in batches:
            rooms = _column(batch, "invoke_id")
            for room in set(rooms):
                if room not in sent.value:
                    continue
                ids, q_tokens, q_starts = sent.value[room]
                part = batch.filter(pa.array(rooms == room))
                top = tops.setdefault(room, RunningTop(ids, k))
                top.add(_scores(q_tokens, q_starts, *_matrices(part.column("vectors"))), _column(part, "doc_id"))
        for room, top in tops.items():
            yield from top.table(room).to_batches()

    rooms = queries.select("invoke_id").distinct()
    mine = chunks.join(F.broadcast(rooms), "invoke_id", "left_semi")
    return mine.select("invoke_id", "doc_id", "vectors").mapInArrow(score, HIT_FIELDS)


def _blocks(df, size, most, name):
    """Number of blocks of each room: of ``size`` rows, in large rooms of up to ``most``."""
    rows = F.least(F.lit(max(size, most)), F.greatest(F.lit(size), F.ceil(F.col("_n") / ROOM_BLOCKS)))
    return skew.count_keys(df, ["invoke_id"]).select("invoke_id", F.ceil(F.col("_n") / rows).cast("int").alias(name))


def _candidates_blocks(queries, chunks, k, chunks_per_block, queries_per_block):
    """Queries and chunks meet in (room, query block, chunk block) groups of bounded size.

    Each side is repeated once per block of the other, so the blocks of a large room grow from the given sizes up to the
    module's before they become more.
    """

    counts = skew.count_keys(chunks, ["invoke_id"])
    asked = _blocks(queries, queries_per_block, QUERIES_PER_BLOCK, "nq")
    rooms = asked.join(_blocks(chunks, chunks_per_block, CHUNKS_PER_BLOCK, "nc"), "invoke_id")
    hot = skew.hot_keys(counts, ["invoke_id"], "_n")

    def placed(df, key, n_own, n_other, own, other):
        hashed = F.pmod(F.xxhash64(key), F.col(n_own)).cast("int")
        return skew.salted_join(df, rooms, ["invoke_id"], hot, spread=[key]).withColumns(
            {own: hashed, other: F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))}
        )

    q = placed(queries, "query_id", "nq", "nc", "qb", "cb").select(
        F.col("invoke_id").alias("q_room"), F.col("qb").alias("q_qb"), F.col("cb").alias("q_cb"),
        "query_id", "q_vectors",
    )
    c = placed(chunks, "doc_id", "nc", "nq", "cb", "qb").select("invoke_id", "qb", "cb", "doc_id", "vectors")
    q, c = q.groupBy("q_room", "q_qb", "q_cb"), c.groupBy("invoke_id", "qb", "cb")

    def score(key, left, right):
        if left.num_rows == 0 or right.num_rows == 0:
            return HIT_ARROW.empty_table()
        return _search_tables(left, right, key[0].as_py(), k)

    return q.cogroup(c).applyInArrow(score, HIT_FIELDS)


def top_hits(queries, chunks, k=None, max_query_rows=QUERY_ROWS, max_query_tokens=QUERY_TOKENS,
             chunks_per_block=CHUNKS_PER_BLOCK, queries_per_block=QUERIES_PER_BLOCK):
    """Exact top-k chunks of each query's room: (invoke_id, query_id, doc_id, score, rank).

    ``queries(invoke_id, query_id, q_vectors)``, ``chunks(invoke_id, doc_id, vectors)``. ``k`` of 0 or None is
    the default. Pairs are never materialised: each task passes on at most ``k`` rows per query.
    """
    k = k or D.top_k
    queries = queries.select("invoke_id", "query_id", "q_vectors")
    tokens = F.length("q_vectors") / 64 if dict(queries.dtypes)["q_vectors"] == "binary" else F.size("q_vectors")
    size = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")
    ).first()
    if size["n"] <= max_query_rows and size["tokens"] <= max_query_tokens:
        found = _candidates_small(queries, chunks, k)
    else:
        found = _candidates_blocks(queries, chunks, k, chunks_per_block, queries_per_block)
    # the joins after this need non-null ids; asking for them here lets every use of the hits share one scoring
    return rank_hits(found.where("invoke_id IS NOT NULL AND query_id IS NOT NULL AND doc_id IS NOT NULL"), k)


def rank_hits(scored, k=None):
    return skew.first_n(scored, ["invoke_id", "query_id"], k or D.top_k, F.desc("score"), F.asc("doc_id"))


def attach_metadata(hits, chunks):
    """Left join of hits to stored text; missing ones keep empty text, an unknown source and page 0.

    The wanted ids select the stored rows first, so stored text is never shuffled for a small set of hits.
    """
    key = ["invoke_id", "doc_id"]
    wanted = hits.select(*key).distinct()
    stored = chunks.select(*key, "content", "source", "page").join(wanted, key, "left_semi")
    return metadata_defaults(hits.join(stored, key, "left"))


def metadata_defaults(df):
    return df.withColumns(
        {
            "content": F.coalesce("content", F.lit("")),
            "source": F.coalesce("source", F.lit(S.UNKNOWN_SOURCE)),
            "page": F.coalesce("page", F.lit(0)),
        }
    )


def score_filter(hits, min_score=D.min_score):
    return hits.where(F.col("score") >= F.lit(float(min_score)))


def file_filter(hits, name=None):
    """Keep hits whose source contains the name or is contained in it; applied after the top-k."""
    return hits if not name else hits.where(X.file_matches(F.col("source"), F.lit(name)))


def dedup_by_prefix(hits, n=D.dedup_prefix):
    """First hit by rank of each identical stripped ``n``-character opening, per query."""
    key = ["invoke_id", "query_id", "_opening"]
    opened = hits.withColumn("_opening", X.prefix(X.strip(F.col("content")), n))
    return skew.latest(opened, key, "rank").drop("_opening")


def assemble_context(hits, queries):
    """Per query: the tagged passages in rank order and the ordered distinct references.

    At most k hits per query arrive here. Queries without hits keep a null context and no references.
    """
    tag = X.document_tag(F.col("source"), F.col("page"), X.strip(F.col("content")))
    ordered = F.array_sort(
        F.collect_list(F.struct("rank", tag.alias("tag"), F.struct("source", "page").alias("ref")))
    )
    per_query = hits.groupBy("invoke_id", "query_id").agg(ordered.alias("_hits"))
    joined = F.array_join(F.transform("_hits", lambda h: h["tag"]), "\n")
    context = F.when(
        F.size("_hits") > 0, F.concat(F.lit("<documents>\n"), joined, F.lit("\n</documents>"))
    )
    references = F.array_distinct(F.transform("_hits", lambda h: h["ref"]))
    nothing = F.array().cast("array<struct<source:string,page:int>>")
    return (
        queries.select("invoke_id", "query_id")
        .join(per_query, ["invoke_id", "query_id"], "left")
        .select(
            "invoke_id", "query_id", context.alias("context"),
            F.coalesce(references, nothing).alias("references"),
        )
    )


def evidence(hits, chunks, min_score=D.min_score, file=None, dedup=D.dedup_prefix):
    """Hits to usable passages: metadata, threshold, file filter, removal of repeated openings."""
    kept = file_filter(attach_metadata(score_filter(hits, min_score), chunks), file)
    return dedup_by_prefix(kept, dedup)
