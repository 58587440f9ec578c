"""Toxic passages by maximum-scoring segment search.

Tokens are runs of letters and digits (bytes from 128 on count as letters, A-Z folded). Numbers of
labelled documents that hold a token give log-odds under an informative Dirichlet prior, a fixed share of the counts of both classes together; tokens whose
log-odds are significant and large are the terms. Openings of five bytes count like tokens, so that a term's unseen
inflections score as well. A term scores its log-odds, any other token the log-likelihood ratio of not
meeting a term. A linear scan finds all disjoint maximal-scoring segments of a text. As scores are log-likelihood
ratios, the best segment of n harmless tokens follows an extreme-value law whose location grows with log n: what counts
is a segment's excess over log n. The excess of the best segment, plus that of every further one that is significant,
is turned into a probability by a logistic curve fitted to the labelled documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark.llm import words as T
from ragspark.llm.hashing import HashTable
from ragspark.llm.shared import crc_mod, fits, saved

#: Labels that go to every task; more are joined by a shuffle. All of them are learned from.
MAX_LABELLED = 200_000
#: Bound of the model: terms kept.
MAX_TERMS = 65_536
#: Slices of text whose counts a task sums before it hands them on.
SLICES_HELD = 4
PRIOR_SHARE = 0.05
MIN_Z = 3.0
MIN_COUNT = 3
MIN_ODDS = 1.5
OPENING = 5
CUT = 0.3
#: Evidence is kept within these bounds; a text without any term has the lowest.
LOWEST, HIGHEST, STEP = -12.0, 40.0, 0.25
HELD_OUT = (4, 2)


def segments(positions, scores, drift):
    """All maximal-scoring segments (first, last, score) of a sequence whose terms score ``scores`` at ascending
    ``positions`` and every other token ``-drift``; linear in the number of terms."""
    kept, total, last = [], 0.0, 0
    for p, s in zip(positions, scores):
        left = total - drift * (p - last)
        right = left + s
        total, last = right, p + 1
        if s <= 0:
            continue
        first = p
        # a candidate joins the nearest one that starts lower, if that ends lower too
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((first, p, left, right, j))
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, right - left) for a, b, left, right, _ in kept]


def _hashes(w):
    """The tokens' hashes and those of their openings."""
    n = len(w.data)
    up, down = T.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(T.FOLDED_CODE[w.data] * up[:n], out=total[1:])
    opening = (total[np.minimum(w.end, w.start + OPENING)] - total[w.start]) * down[w.start]
    return w.hash, T.mix(opening ^ np.uint64(0x5BF03635))


class Model:
    """Terms with their scores, the drift of other tokens and the logistic curve."""

    def __init__(self, keys, scores, drift):
        self.table, self.scores, self.drift = HashTable(keys), np.asarray(scores, np.float64), drift
        self.padded = np.append(self.scores, 0.0)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(np.asarray(keys, np.uint64) >> np.uint64(44)).astype(np.int64)] = True
        self.offset, self.slope = 0.0, 1.0

    def evidence(self, column):
        """Per row of a text column its evidence and its significant segments as (first, last, score) of token numbers."""
        n = len(column)
        x, found = np.full(n, LOWEST), [[] for _ in range(n)]
        for first, data, offsets in T.slices(column):
            w = T.Words(data, offsets, gap=T.NOT_LETTER)
            own, opening = _hashes(w)
            at = np.flatnonzero(self.maybe[(own >> np.uint64(44)).astype(np.int64)] | self.maybe[(opening >> np.uint64(44)).astype(np.int64)])
            score = np.zeros(len(at))
            for h in (own[at], opening[at]):
                row = self.table.find(h)
                score = np.maximum(score, np.where(row >= 0, self.padded[row], 0.0))
            at, score = at[score > 0], score[score > 0]
            edge = np.searchsorted(at, w.row)
            for r in np.flatnonzero(np.diff(edge)):
                a, b = edge[r], edge[r + 1]
                log_n = float(np.log(w.row[r + 1] - w.row[r]))
                own = segments((at[a:b] - w.row[r]).tolist(), score[a:b].tolist(), self.drift)
                best = max((s for *_, s in own), default=None)
                if best is None:
                    continue
                over = [(i, j, s) for i, j, s in own if s > log_n]
                more = sum(s - log_n for *_, s in over) - max(0.0, best - log_n)
                x[first + r] = min(HIGHEST, max(LOWEST, best - log_n + more))
                found[first + r] = over
        return x, found

    def score(self, x):
        return 1.0 / (1.0 + np.exp(-(self.offset + self.slope * np.asarray(x))))


def labelled(labels, column, keep=None):
    """(doc_id, y) of all rows with a label 0 or 1; rows of one document count once, as 1 if any of them does."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows if keep is None else rows.where(keep)
    return rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))


def join_labels(docs, rows, how="inner"):
    """Documents with the stored rows (doc_id, ...) of their labels, whatever the number of these."""
    return docs.join(F.broadcast(rows) if fits(rows, MAX_LABELLED) else rows, "doc_id", how)


def _counts(batches):
    schema = pa.schema([("h", pa.int64()), ("n1", pa.int64()), ("n0", pa.int64())])
    held = []

    def sums():
        own, n1, n0 = (np.concatenate(c) for c in zip(*held))
        h, back = np.unique(own, return_inverse=True)
        n1, n0 = (np.bincount(back, weights=c, minlength=len(h)).astype(np.int64) for c in (n1, n0))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n1), pa.array(n0)], schema=schema)

    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for first, data, offsets in T.slices(batch.column("text")):
            w = T.Words(data, offsets, gap=T.NOT_LETTER)
            row = w.row_of_word()
            both, row = np.concatenate(_hashes(w)), np.concatenate((row, row))
            _, once = np.unique(T.mix(both + T.mix(row.astype(np.uint64))), return_index=True)
            h, back = np.unique(both[once], return_inverse=True)
            label = y[first + row[once]]
            n = np.bincount(back, minlength=len(h))
            n1 = np.bincount(back, weights=label, minlength=len(h)).astype(np.int64)
            held.append((h, n1, n - n1))
            if len(held) == SLICES_HELD:
                yield sums()
    if held:
        yield sums()


def train(docs, labels, keep=None):
    """Model from the documents that ``labels`` (doc_id, toxic) marks, of those that ``keep`` admits."""
    marks = saved(labelled(labels, "toxic", keep), "labelled")
    marked = join_labels(docs.select("doc_id", "text"), marks).select("text", "y")
    counts = marked.mapInArrow(_counts, "h long, n1 long, n0 long").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = saved(counts, "tokens")
    per_label = dict(marks.groupBy("y").count().collect())
    t1, t0 = float(per_label.get(1, 0)), float(per_label.get(0, 0))
    odds = counts.select("*", F.lit(t1).alias("t1"), F.lit(t0).alias("t0"), F.expr(f"{PRIOR_SHARE} * (n1 + n0)").alias("a")).select(
        "h", "n1", "n0",
        F.expr("ln((n1 + a) / (t1 - n1 + 1)) - ln((n0 + a) / (t0 - n0 + 1))").alias("d"),
        F.expr("sqrt(1 / (n1 + a) + 1 / (n0 + a))").alias("sd"),
    )
    terms = odds.where(f"n1 >= {MIN_COUNT} and d / sd >= {MIN_Z} and d >= {MIN_ODDS}").orderBy(F.desc(F.expr("d / sd")), "h").limit(MAX_TERMS).toPandas()
    if terms.empty:
        return Model([], [], 0.0)
    words = counts.agg(F.sum("n1").alias("w1"), F.sum("n0").alias("w0")).first()
    in1, in0 = terms.n1.sum() / max(words.w1, 1), terms.n0.sum() / max(words.w0, 1)
    drift = np.log1p(-min(in0, 0.99)) - np.log1p(-min(in1, 0.99))
    model = Model(terms.h.to_numpy().view(np.uint64), terms.d, max(1e-3, float(drift)))

    def binned(batches):
        for b in batches:
            x, _ = model.evidence(b.column("text"))
            k = np.round((x - LOWEST) / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), b.column("y")], names=["k", "y"])

    bins = marked.mapInArrow(binned, "k int, y int").groupBy("k", "y").count().toPandas()
    model.offset, model.slope = logistic(LOWEST + STEP * bins.k.to_numpy(), bins.y.to_numpy(), bins["count"].to_numpy())
    return model


def logistic(x, y, weight, ridge=1e-3):
    """Offset and slope of a one-variable logistic curve by Newton steps on counted points."""
    b = np.zeros(2)
    z = np.stack([np.ones_like(x), x / 10.0], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1] / 10.0)


def toxicity(docs, model, doc_id="doc_id", text="text"):
    """Per row doc_id, score (0 to 1) and its significant passages as array<struct<first,last,score>> of token numbers.

    Null and empty texts have no passage and the lowest score. Repeated rows are scored each. Other columns are not read.
    """
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            x, found = model.evidence(b.column(1))
            spans = [[{"first": i, "last": j, "score": s} for i, j, s in own] for own in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x)), pa.array(spans, passage)], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, passages array<struct<first:long,last:long,score:double>>")


def accepted(docs, model, text="text"):
    """The rows of ``docs``, with all their columns, whose score is below the cut; nothing is shuffled."""
    def run(batches):
        for b in batches:
            x, _ = model.evidence(b.column(b.schema.get_field_index(text)))
            yield b.filter(pa.array(model.score(x) < CUT))

    return docs.mapInArrow(run, docs.schema)


def training_rows():
    """Condition on label rows: those outside the held-out quarter."""
    n, held = HELD_OUT
    return crc_mod(F.col("doc_id"), n) != held
