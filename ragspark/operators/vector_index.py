"""A stored index of token vectors: centroid lists, compressed residuals, and exact scores of the few best.

A codebook of centroids is fitted to a bounded sample. Every stored chunk has, beside its text, the centroids
that its tokens are nearest to, and a code of each token: its centroid and, in four bits per number, what is left over. A search
reads these in turn, each time a narrower column set of fewer rows:

1. the lists: a query token knows its nearest centroids; a chunk gets for each token the best of those it has,
2. the codes of the ``WIDE`` * k best chunks of a query: scores with vectors put together from the codes,
3. the vectors of the ``NEAR`` * k best: exact scores, of which the k best are returned.

Vectors take many times the disk of their texts, so they are stored only on demand; without them the texts of the ``NEAR`` * k
best chunks of each query are encoded again, and nothing else but the queries. Queries go to the tasks in blocks of bounded size; chunks are not shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.operators import inference, packed, retrieval, skew
from ragspark.session import saved

D = S.DEFAULTS
#: Bounds of the codebook: tokens of the sample, centroids, and rounds of fitting.
SAMPLE_TOKENS, MAX_LISTS, ROUNDS = 65_536, 2_048, 6
#: Chunks that are encoded to draw the sample from.
SAMPLE_CHUNKS = 8_192
PROBES, WIDE, NEAR = 4, 128, 16
LEVELS = 16
PRODUCTS = 4_000_000


class Codebook:
    """Centroids, and per dimension the cuts between residual levels and the mean of each level."""

    def __init__(self, centroids, cuts, means):
        self.centroids, self.cuts, self.means = centroids, cuts, means
        self.half = (centroids.astype(np.float64) ** 2).sum(1) / 2

    def nearest(self, tokens, n=1):
        """The ``n`` nearest centroids of every token, nearest first."""
        out = np.empty((len(tokens), n), np.int64)
        if not n:
            return out
        step = max(1, PRODUCTS // len(self.centroids))
        for at in range(0, len(tokens), step):
            near = self.half - tokens[at : at + step].astype(np.float64) @ self.centroids.T
            if n == 1:
                out[at : at + step, 0] = near.argmin(1)
            else:
                best = np.argpartition(near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.argsort(near, axis=1)
                out[at : at + step] = np.take_along_axis(best, np.argsort(np.take_along_axis(near, best, 1), axis=1), 1)
        return out

    def code(self, tokens, centroid):
        """Bytes of every token: centroid (uint16) and two levels a byte."""
        rest = tokens - self.centroids[centroid]
        level = np.zeros(rest.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            level[:, j] = np.searchsorted(cuts, rest[:, j])
        if level.shape[1] % 2:
            level = np.pad(level, ((0, 0), (0, 1)))
        both = level[:, ::2] | (level[:, 1::2] << 4)
        return np.concatenate((centroid.astype("<u2").view(np.uint8).reshape(-1, 2), both), axis=1)

    def decode(self, column):
        """Approximate tokens of a column of codes and the row each chunk starts at."""
        dim = self.centroids.shape[1]
        width = 2 + (dim + 1) // 2
        column = column.cast(pa.large_binary())
        column = column.fill_null(b"") if column.null_count else column
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        rows = data.reshape(-1, width)
        level = np.stack((rows[:, 2:] & 15, rows[:, 2:] >> 4), axis=2).reshape(len(rows), -1)[:, :dim]
        rest = self.means[np.arange(dim)[None, :], level]
        return self.centroids[np.ascontiguousarray(rows[:, :2]).view("<u2")[:, 0].astype(np.int64)] + rest, (ends - ends[0]) // width


def fit(chunks, vectors="vectors", lists=None, share=1.0):
    """The codebook of chunks, from about SAMPLE_TOKENS of their tokens, chosen by a hash of chunk and place.

    ``share`` is the part of all chunks that is given. Without any token the codebook has no centroid; then all scores are 0.
    """
    total = chunks.agg(F.sum(F.length(vectors) - 4)).first()[0] or 0
    dim = chunks.where(F.length(vectors) > 4).select(vectors).first()
    if dim is None:
        return Codebook(np.zeros((0, 1), np.float32), np.zeros((1, LEVELS - 1)), np.zeros((1, LEVELS), np.float32))
    dim = int(np.frombuffer(dim[0], "<i4", 1)[0])
    tokens = total // (4 * dim)
    bar = np.uint64(min(1.0, SAMPLE_TOKENS / max(1, tokens)) * (2**64 - 2**12))

    def draw(batches):
        for b in batches:
            flat, starts = packed.matrices(b.column("v"))
            own = np.repeat(b.column("h").to_numpy().view(np.uint64), np.diff(starts))
            place = (np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.uint64)
            mixed = (own ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            kept = flat[mixed <= bar]
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in kept], pa.binary())], names=["v"])

    drawn = chunks.select(F.col(vectors).alias("v"), F.xxhash64("invoke_id", "id").alias("h")).mapInArrow(draw, "v binary")
    rows = sorted(r.v for r in drawn.toLocalIterator())
    sample = np.frombuffer(b"".join(rows), "<f4").reshape(-1, dim)
    different = np.unique(sample, axis=0)
    wanted = lists or 2 ** int(np.log2(4 * max(1.0, tokens / share) ** 0.5))
    n = max(1, min(MAX_LISTS, wanted, len(different)))
    rng = np.random.default_rng(17)
    book = Codebook(different[rng.permutation(len(different))[:n]], np.zeros((dim, LEVELS - 1)), np.zeros((dim, LEVELS), np.float32))
    for _ in range(ROUNDS):
        own = book.nearest(sample)[:, 0]
        count = np.bincount(own, minlength=n)
        sums = np.stack([np.bincount(own, weights=sample[:, j], minlength=n) for j in range(dim)], 1)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book.centroids).astype(np.float32)
        book = Codebook(centroids, book.cuts, book.means)
    rest = sample - book.centroids[book.nearest(sample)[:, 0]]
    cuts = np.quantile(rest, np.arange(1, LEVELS) / LEVELS, axis=0).T
    means = np.zeros((dim, LEVELS), np.float32)
    for j in range(dim):
        level = np.searchsorted(cuts[j], rest[:, j])
        count = np.bincount(level, minlength=LEVELS)
        middle = np.concatenate((cuts[j][:1], (cuts[j][1:] + cuts[j][:-1]) / 2, cuts[j][-1:]))
        means[j] = np.where(count > 0, np.bincount(level, weights=rest[:, j], minlength=LEVELS) / np.maximum(count, 1), middle)
    return Codebook(book.centroids, cuts, means)


def fit_texts(chunks, encoder=None, text="content"):
    """``fit`` for stored chunks without vectors: about SAMPLE_CHUNKS of them, chosen by a hash of their key, are encoded."""
    n = chunks.count()
    share = min(1.0, SAMPLE_CHUNKS / max(1, n))
    some = chunks if share == 1.0 else chunks.where(F.pmod(F.xxhash64("id", "invoke_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    made = saved(inference.encode(some.select("invoke_id", "id", text), text, "vectors", False, encoder, True), "sample")
    return fit(made, share=share)


def _distinct(flat):
    """Rows of the distinct tokens, and the number of each token among them; equal hashes of unequal tokens count as no repeats."""
    words = np.ascontiguousarray(flat, "<f4").view("<u4").astype(np.uint64)
    odd = np.random.default_rng(5).integers(1, 2**63, words.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    _, first, back = np.unique((words * odd).sum(1), return_index=True, return_inverse=True)
    if (words[first][back] != words).any():
        return np.arange(len(flat)), np.arange(len(flat))
    return first, back


def save_codebook(spark, book, path):
    row = (book.centroids.shape[1], book.centroids.astype("<f4").tobytes(), book.cuts.astype("<f8").tobytes(), book.means.astype("<f4").tobytes())
    spark.createDataFrame([row], "dim int, centroids binary, cuts binary, means binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_codebook(spark, path):
    row = spark.read.parquet(path).first()
    shaped = lambda raw, kind: np.frombuffer(raw, kind).reshape(-1, row.dim)
    return Codebook(
        shaped(row.centroids, "<f4"), np.frombuffer(row.cuts, "<f8").reshape(row.dim, -1), np.frombuffer(row.means, "<f4").reshape(row.dim, -1)
    )


def indexed(chunks, book, vectors="vectors"):
    """Adds ``lists`` (the distinct centroids, uint16) and ``codes`` to chunks with packed vectors."""
    names = [*chunks.columns, "lists", "codes"]

    def run(batches):
        for b in batches:
            flat, starts = packed.matrices(b.column(vectors))
            lists, codes = [b""] * b.num_rows, [b""] * b.num_rows
            if len(flat):
                first, back = _distinct(flat)
                own = book.nearest(flat[first])[:, 0]
                code, own = book.code(flat[first], own)[back], own[back]
                for k in range(b.num_rows):
                    lists[k] = np.unique(own[starts[k] : starts[k + 1]]).astype("<u2").tobytes()
                    codes[k] = code[starts[k] : starts[k + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.binary()), pa.array(codes, pa.binary())], names=names)

    return chunks.mapInArrow(run, chunks.withColumn("lists", F.lit(b"")).withColumn("codes", F.lit(b"")).schema)


class _Queries:
    """The queries of one block by room: ids, tokens, where each starts, and per centroid the tokens that probe it."""

    def __init__(self, rows):
        self.rooms = {}
        by_room = {}
        for r in sorted(rows, key=lambda r: (r.invoke_id, r.query_id)):
            by_room.setdefault(r.invoke_id, []).append(r)
        for room, own in by_room.items():
            tokens, starts = packed.matrices(pa.array([bytes(r.q_vectors) for r in own], pa.binary()))
            self.rooms[room] = (np.array([r.query_id for r in own], object), tokens, starts)

    def probed(self, book, probes):
        """Per room: ids, where each query starts, and the (token, score) pairs of every centroid with their ends."""
        out = {}
        for room, (ids, tokens, starts) in self.rooms.items():
            n = min(probes, len(book.centroids))
            centroid = book.nearest(tokens, n) if len(tokens) else np.zeros((0, n), np.int64)
            score = (tokens[:, None, :].astype(np.float64) * book.centroids[centroid]).sum(2) if centroid.size else np.zeros(centroid.shape)
            order = np.argsort(centroid, axis=None, kind="stable")
            ends = np.searchsorted(centroid.ravel()[order], np.arange(len(book.centroids) + 1))
            out[room] = ids, starts, len(tokens), order // max(n, 1), score.ravel()[order], ends
        return out


def _listed(queries, table, book, n, probes):
    """(invoke_id, query_id, doc_id, score): per task the ``n`` best chunks of every query by their lists."""
    sent = table.sparkSession.sparkContext.broadcast(queries.probed(book, probes))

    def run(batches):
        tops = {}
        for b in batches:
            rooms, ids, lists = (np.array(b.column(c).to_pylist(), object) for c in ("invoke_id", "id", "lists"))
            for room in set(rooms):
                if room not in sent.value:
                    continue
                names, starts, size, token, value, ends = sent.value[room]
                mine = np.flatnonzero(rooms == room)
                scores = np.zeros((len(names), len(mine)))
                has = np.diff(starts) > 0
                for k, row in enumerate(mine):
                    own = np.frombuffer(lists[row] or b"", "<u2").astype(np.int64)
                    at = np.concatenate([np.arange(ends[c], ends[c + 1]) for c in own]) if len(own) else np.zeros(0, np.int64)
                    at = at[np.argsort(value[at], kind="stable")]
                    best = np.zeros(size)
                    best[token[at]] = value[at]
                    scores[has, k] = np.add.reduceat(best, starts[:-1][has]) if has.any() else 0.0
                tops.setdefault(room, retrieval.RunningTop(names, n)).add(scores, ids[mine])
        for room, top in tops.items():
            yield from top.table(room).to_batches()

    return table.select("invoke_id", "id", "lists").mapInArrow(run, retrieval.HIT_FIELDS)


def _scored(queries, hits, table, column, decode, encoder=None):
    """The hits with scores from ``decode`` of their chunks' ``column``; chunks without a hit are not read further.

    Where the table has no such column it is made from the texts of the chunks that are hit.
    """
    pairs = saved(hits.groupBy("invoke_id", F.col("doc_id").alias("id")).agg(F.collect_list("query_id").alias("asked")), "hits")
    few = pairs.limit(skew.MAX_LOOKUP_ROWS + 1).count() <= skew.MAX_LOOKUP_ROWS
    given = column in table.columns
    rows = table.select("invoke_id", "id", column if given else "content").join(F.broadcast(pairs) if few else pairs, ["invoke_id", "id"])
    if not given:
        rows = inference.encode(rows, "content", column, False, encoder, True)
    sent = table.sparkSession.sparkContext.broadcast(queries.rooms)

    def run(batches):
        number = {room: {q: k for k, q in enumerate(own[0])} for room, own in sent.value.items()}
        for b in batches:
            tokens, starts = decode(b.column(column))
            out = []
            for k, (room, doc, asked) in enumerate(zip(*(b.column(c).to_pylist() for c in ("invoke_id", "id", "asked")))):
                names, q_tokens, q_starts = sent.value[room]
                doc_tokens = tokens[starts[k] : starts[k + 1]].astype(np.float64)
                for q in asked:
                    at = number[room][q]
                    own = q_tokens[q_starts[at] : q_starts[at + 1]]
                    score = (own.astype(np.float64) @ doc_tokens.T).max(1).sum() if len(own) and len(doc_tokens) else 0.0
                    out.append((room, q, doc, round(float(score), 6)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), retrieval.HIT_ARROW.types)], schema=retrieval.HIT_ARROW)

    return rows.mapInArrow(run, retrieval.HIT_FIELDS)


def search(queries, table, book, k=None, probes=PROBES, wide=WIDE, near=NEAR, encoder=None):
    """The k best chunks of each query's room: (invoke_id, query_id, doc_id, score, rank), scores exact.

    ``queries(invoke_id, query_id, q_vectors)`` with packed vectors, one row per room and query. ``table`` has invoke_id, id,
    lists, codes, and vectors or the content from which ``encoder`` makes them. More queries than one task may hold are taken in blocks, each of which reads the lists once.
    """
    k = k or D.top_k
    queries = queries.select("invoke_id", "query_id", "q_vectors").where("invoke_id IS NOT NULL AND query_id IS NOT NULL")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("q_vectors")).alias("bytes")).first()
    blocks = max(1, -(-size.n // retrieval.QUERY_ROWS), -(-(size.bytes or 0) // retrieval.QUERY_BYTES))
    out = None
    for block in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        asked = _Queries(own.collect())
        room = F.col("invoke_id").isin(sorted(asked.rooms))
        mine = table.where(room)
        listed = retrieval.rank_hits(_listed(asked, mine, book, wide * k, probes), wide * k)
        coded = retrieval.rank_hits(_scored(asked, listed, mine, "codes", book.decode), near * k)
        exact = retrieval.rank_hits(_scored(asked, coded, mine, "vectors", packed.matrices, encoder), k)
        out = exact if out is None else out.unionByName(exact)
    return out
