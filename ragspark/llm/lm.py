"""Language-model scores from a log-frequency Bloom filter.

Training documents give exact counts of tokens (words with A-Z folded, and one end per text) and of token pairs, by
shuffled sums. A count c is written down as its level 1 + floor(log c) to a base of ``GROWTH``; the filter holds every
n-gram once for each level from the lowest that is held up to its own, so a level is read back by probing 1, 2, 3 ... until
one is absent. The filter has a bounded size and goes to all workers; where more n-grams would be held than it can tell
apart, the smallest counts of pairs, then of tokens, stay out: the events that it then does not settle are joined with the
stored counts, so that every level is the same as with a filter without bound.

A token's probability interpolates that of the pair with that of the token, weighted by how often the context was seen;
weights are fitted by EM on all training documents with each event left out. Tokens are discounted absolutely, what this frees
is the probability of an unknown token. An event depends on three levels alone, so texts are read once and kept as counts of
these triples. The exact counts also give each text's smoothed unigram score: common tokens by a broadcast of bounded size,
all others by a join.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from ragspark.llm import words as T
from ragspark.llm.hashing import HashTable
from ragspark.llm.shared import BROADCAST_ROWS, crc_mod, saved

#: Bounds of the filter, and the bits it has for each n-gram and level.
MAX_BITS_LOG2, MIN_BITS_LOG2, BITS_EACH = 29, 20, 14
GROWTH = 1.5
BLOCK_LOG2 = 16
SEGMENT_LOG2 = 20
#: Pairs are held from this count on.
LEAST_PAIR = 2
HELD_OUT = (5, 1)
MAX_WORDS = 400_000
#: Levels lie below this; as a context the last one stands for the opening of a text.
LEVELS = 64
#: Tokens that a task counts at once before it hands its sums on.
COUNT_TOKENS = 1_000_000

END = np.uint64(0xA5A5_0001_5EED_0001)
OPEN = np.uint64(0xA5A5_0002_5EED_0002)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def level(c):
    return 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(GROWTH) + 1e-9).astype(np.int64)


LEVEL_SQL = f"cast(1 + floor(ln(c) / ln({GROWTH}D) + 1e-9D) as int)"


def sequence(w):
    """Tokens of all rows with their ends, the token before each, and the rows' offsets."""
    token = np.insert(w.hash, w.row[1:], END)
    rows = w.row + np.arange(len(w.row))
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[rows[:-1][rows[:-1] < len(token)]] = OPEN
    return token, before, rows


def pair(before, token):
    return T.mix(before * _PAIR + token)


def _count(batches):
    schema = pa.schema([("h", pa.int64()), ("n", pa.int8()), ("c", pa.int64())])
    def sums(tokens, pairs):
        for n, all_ in ((1, tokens), (2, pairs)):
            h, c = np.unique(np.concatenate(all_), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int8)), pa.array(c)], schema=schema)

    for b in batches:
        tokens, pairs, held = [], [], 0
        for _, data, offsets in T.slices(b.column(0)):
            token, before, _ = sequence(T.Words(data, offsets))
            tokens.append(token)
            pairs.append(pair(before, token))
            held += len(token)
            if held >= COUNT_TOKENS:
                yield from sums(tokens, pairs)
                tokens, pairs, held = [], [], 0
        if held:
            yield from sums(tokens, pairs)


class Filter:
    """2^``log2`` bits in blocks of 2^BLOCK_LOG2; an n-gram's bits for all levels lie in one block, four for a level."""

    def __init__(self, log2, data=None):
        self.log2, self.data = log2, data

    def places(self, h, levels):
        block = (h >> np.uint64(64 - (self.log2 - BLOCK_LOG2))).astype(np.int64) << BLOCK_LOG2
        x = T.mix(h + np.asarray(levels, np.uint64) * np.uint64(T.BASE))
        return [block + ((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]

    def segment(self, h):
        return h >> np.uint64(64 - (self.log2 - min(SEGMENT_LOG2, self.log2)))

    def levels(self, h):
        """The level of every n-gram, 0 where it is not held, by probes of 1, 2, 3 ..."""
        out, open_, k = np.zeros(len(h), np.int64), np.arange(len(h)), 0
        while len(open_):
            k += 1
            own = h[open_]
            hit = np.ones(len(own), bool)
            for at in self.places(own, np.full(len(own), k)):
                hit &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            open_ = open_[hit]
            out[open_] = k
        return out


def build(counts, log2):
    """The filter for rows (h, c), each segment's bits set in one task. Levels begin above ``below``, if there is this column."""
    shape = Filter(log2)
    size = 1 << min(SEGMENT_LOG2, log2)
    shift = log2 - min(SEGMENT_LOG2, log2)
    segment = F.lit(0) if not shift else F.shiftrightunsigned("h", 64 - shift).cast("int")

    def run(batches):
        segments = {}
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            q = level(b.column("c").to_numpy()) - b.column("below").to_numpy()
            for at in range(0, len(h), 1 << 16):
                own, n = h[at : at + (1 << 16)], q[at : at + (1 << 16)]
                many = np.repeat(own, n)
                k = np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n) + 1
                for place in shape.places(many, k):
                    where = place // size
                    for s in np.unique(where).tolist():
                        flags = segments.setdefault(s, np.zeros(size, bool))
                        flags[place[where == s] - s * size] = True
        for s, flags in segments.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(flags, bitorder="little").tobytes()])], names=["segment", "bits"])

    n = min(1 << shift, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    below = F.col("below") if "below" in counts.columns else F.lit(0)
    dealt = counts.select("h", "c", below.cast("long").alias("below"), segment.alias("s")).repartition(n, "s")
    shape.data = np.zeros(1 << (log2 - 3), np.uint8)
    for row in dealt.mapInArrow(run, "segment long, bits binary").toLocalIterator():
        own = np.frombuffer(row.bits, np.uint8)
        at = row.segment * (size >> 3)
        shape.data[at : at + len(own)] |= own
    return shape


class Model:
    """The filter, the lowest levels of tokens and pairs it holds, the mean count of each level, corpus totals, weights by
    context level, and the common tokens."""

    def __init__(self, filter_, lowest, token_mean, pair_mean, tokens, types, discount, texts, unknown):
        self.filter, self.lowest, self.token_mean, self.pair_mean = filter_, lowest, token_mean, pair_mean
        self.tokens, self.types, self.discount, self.texts, self.unknown = tokens, types, discount, texts, unknown
        self.weight = np.zeros(LEVELS)
        self.common, self.common_count = HashTable(), np.zeros(0, np.int64)
        self._forget()

    def _forget(self):
        self.cache, self.cached = HashTable(bits=16), np.zeros(1024, np.int8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "cached")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _levels(self, h, n):
        k = self.filter.levels(h)
        return np.where(k > 0, k + self.lowest[n] - 1, 0)

    def token_levels(self, h):
        if self.cache.n > MAX_WORDS:
            self._forget()
        at = self.cache.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = np.unique(h[missing])
            n = self.cache.n
            while n + len(new) > len(self.cached):
                self.cached = np.resize(self.cached, 2 * len(self.cached))
            self.cached[n : n + len(new)] = self._levels(new, 1)
            self.cache.add(new)
            at[missing] = self.cache.find(h[missing])
        return self.cached[at].astype(np.int64)

    def events(self, token, before):
        """Per event the levels of its token, its context and their pair, and whether the filter settles each of them."""
        own = self.token_levels(token)
        opening = before == OPEN
        context = np.empty_like(own)
        context[1:] = own[:-1]
        context[opening] = LEVELS - 1
        both = np.zeros_like(own)
        all_tokens = self.lowest[1] == 1
        possible = np.flatnonzero((own > 0) & (context > 0)) if all_tokens else np.arange(len(own))
        h, back = np.unique(pair(before, token)[possible], return_inverse=True)
        both[possible] = self._levels(T.mix(h ^ _PAIR), 2)[back]
        known = np.ones(len(own), bool) if all_tokens else own > 0
        settled = np.ones(len(own), bool)
        if self.lowest[2] > int(level(LEAST_PAIR)):
            settled[possible] = both[possible] > 0
        return own, context, both, known, settled

    def parts(self, code, leave_out=0):
        """For coded triples of levels the pair's share of its context, the token's probability, and the context's level."""
        own, context, both = code // LEVELS**2, code // LEVELS % LEVELS, code % LEVELS
        p = np.where(own > 0, np.maximum(self.token_mean[own] - leave_out - self.discount, 0.05) / self.tokens, self.unknown)
        opening = context == LEVELS - 1
        seen = np.where(opening, float(self.texts), self.token_mean[context])
        context = np.where(opening, int(level(self.texts)), context)
        c = np.where((own > 0) & (both > 0), self.pair_mean[both], 0.0)
        share = np.minimum(np.maximum(c - leave_out, 0.0) / np.maximum(seen - leave_out, 1.0), 1.0)
        return share, p, context

    def log10(self, code):
        share, p, context = self.parts(code)
        w = self.weight[context]
        return np.log10(w * share + (1 - w) * p)

    def fit(self, code, n):
        """EM for the weight of each context level, over the triples of all training events, each left out."""
        share, p, context = self.parts(code, leave_out=1)
        ratio = np.exp(np.clip(np.log(np.maximum(share, 1e-12) / p), -20, 20))
        for k in np.unique(context).tolist():
            x, own, w = ratio[context == k], n[context == k], 0.3
            for _ in range(50):
                w = float((own * w * x / (w * x + 1 - w)).sum() / own.sum())
            self.weight[k] = min(max(w, 0.0), 0.95)


def _means(histogram, n):
    out = np.zeros(LEVELS)
    for row in histogram:
        if row.n == n:
            out[row.level] = row.c / row.types
    return out


def train(docs, keep, text="text"):
    """(model without weights, exact counts of tokens and pairs) from the documents that ``keep`` admits."""
    chosen = docs.where(keep)
    counts = saved(chosen.select(text).mapInArrow(_count, "h long, n byte, c long").groupBy("n", "h").agg(F.sum("c").alias("c")).where(f"n = 1 or c >= {LEAST_PAIR}"), "counts", by=("n",))
    histogram = counts.groupBy("n", F.expr(LEVEL_SQL).alias("level")).agg(F.count("*").alias("types"), F.sum("c").alias("c"), F.sum(F.expr("cast(c = 1 as long)")).alias("ones"), F.sum(F.expr("cast(c = 2 as long)")).alias("twos")).collect()
    of = lambda n: [r for r in histogram if r.n == n]
    tokens, types = sum(r.c for r in of(1)), sum(r.types for r in of(1))
    n1, n2 = max(1, sum(r.ones for r in of(1))), max(1, sum(r.twos for r in of(1)))
    discount = n1 / (n1 + 2 * n2)
    texts = max(1, chosen.count())
    # lowest levels that are held: pairs give way first, then tokens, until the filter is not overfull
    room = (1 << MAX_BITS_LOG2) // BITS_EACH
    lowest = {1: 1, 2: int(level(LEAST_PAIR))}
    held = lambda n: sum(r.types * (r.level - lowest[n] + 1) for r in of(n) if r.level >= lowest[n])
    while held(1) + held(2) > room:
        lowest[2 if held(2) else 1] += 1
    log2 = min(MAX_BITS_LOG2, max(MIN_BITS_LOG2, int(np.ceil(np.log2(max(1, (held(1) + held(2)) * BITS_EACH))))))
    inside = counts.withColumn("level", F.expr(LEVEL_SQL)).where(f"(n = 1 and level >= {lowest[1]}) or (n = 2 and level >= {lowest[2]})")
    filter_ = build(_keyed(inside).withColumn("below", F.when(F.col("n") == 1, lowest[1] - 1).otherwise(lowest[2] - 1)), log2)
    model = Model(filter_, lowest, _means(histogram, 1), _means(histogram, 2), max(1, tokens), types, discount, texts, max(discount * types, 0.5) / max(1, tokens))
    # the common tokens: the highest counts of which there are not too many
    least, n = LEVELS, 0
    by_level = {r.level: r.types for r in of(1)}
    while least > 1 and n + by_level.get(least - 1, 0) <= BROADCAST_ROWS:
        least -= 1
        n += by_level.get(least, 0)
    common = counts.where("n = 1").where(F.expr(LEVEL_SQL) >= least).select("h", "c").toArrow()
    model.common = HashTable(common.column("h").to_numpy().view(np.uint64))
    model.common_count = np.append(common.column("c").to_numpy(), 0)
    return model, counts


def _keyed(rows):
    """(h, n, c) under the keys of the filter: pairs are scrambled once more, so that no pair is taken for a token."""
    def run(batches):
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            h = np.where(b.column("n").to_numpy() == 2, T.mix(h ^ _PAIR), h)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("n"), b.column("c")], names=["h", "n", "c"])

    return rows.select("h", "n", "c").mapInArrow(run, "h long, n byte, c long")


_READ = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("events", pa.binary()),
     ("kind", pa.string()), ("h", pa.int64()), ("token", pa.int64()), ("before", pa.int64()), ("own", pa.int8()), ("context", pa.int8())]
)
_READ_SQL = "rid long, doc_id long, held_out boolean, n long, known long, base double, events binary, kind string, h long, token long, before long, own byte, context byte"


def _packed(code, n):
    """Coded triples and how often each occurs, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([code, n]).astype(np.int32).tobytes())


def _unpacked(data):
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _read(docs, model):
    """Rows of three kinds, stored: 'text' (totals and settled events of one), 'rare' (a token that is not a common one), and
    'open' (an event that the filter does not settle; where a token's level is open too, that token)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = _base(model)

    def rows(kind, **columns):
        size = len(columns["rid"])
        given = {"kind": pa.array([kind] * size, pa.string()), **columns}
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in _READ], schema=_READ)

    def run(batches):
        for b in batches:
            m = shared.value
            rid, ids, held = b.column("rid").to_numpy(), b.column("doc_id"), b.column("held_out")
            for first, data, offsets in T.slices(b.column("text")):
                token, before, at_row = sequence(T.Words(data, offsets))
                n = len(offsets) - 1
                at = m.common.find(token)
                total = np.zeros((2, len(token) + 1))
                np.cumsum(at >= 0, out=total[0, 1:])
                np.cumsum(np.where(at >= 0, np.log10(m.common_count[at] + 0.5) - base, 0.0), out=total[1, 1:])
                common, own_base = total[:, at_row[1:]] - total[:, at_row[:-1]]
                own, context, both, known, settled = m.events(token, before)
                row = np.repeat(np.arange(n), np.diff(at_row))
                code = (own * LEVELS + context) * LEVELS + both
                key, times = np.unique(row[settled] * LEVELS**3 + code[settled], return_counts=True)
                cut = np.searchsorted(key, np.arange(n + 1) * LEVELS**3)
                events = [_packed(key[i:j] % LEVELS**3, times[i:j]) for i, j in zip(cut[:-1], cut[1:])]
                yield rows("text", rid=pa.array(rid[first : first + n]), doc_id=ids.slice(first, n), held_out=held.slice(first, n), n=pa.array(np.diff(at_row)),
                           known=pa.array(common.astype(np.int64)), base=pa.array(own_base), events=pa.array(events, pa.binary()))
                rare = np.flatnonzero(at < 0)
                yield rows("rare", rid=pa.array(rid[first + row[rare]]), h=pa.array(token[rare].view(np.int64)))
                left = np.flatnonzero(~settled)
                if len(left):
                    unseen = np.r_[True, ~known[:-1]] & (context != LEVELS - 1)
                    yield rows("open", rid=pa.array(rid[first + row[left]]), held_out=held.take(pa.array(first + row[left])),
                               h=pa.array(pair(before, token)[left].view(np.int64)), own=pa.array(own[left]), context=pa.array(context[left]),
                               token=pa.array(token[left].view(np.int64), mask=known[left]), before=pa.array(before[left].view(np.int64), mask=~unseen[left]))

    return saved(docs.mapInArrow(run, _READ_SQL), "read")


def _settle(open_, counts, all_tokens):
    """(rid, held_out, code, times): the levels that the filter left open, from the stored counts."""
    words = () if all_tokens else (("token", "own"), ("before", "context"))
    rows = open_.select("rid", "held_out", "h", *(key for key, _ in words), "own", "context")
    levels = lambda n: counts.where(f"n = {n}").select("h", F.expr(LEVEL_SQL).alias("level"))
    for key, column in words:
        found = rows.where(f"{key} is not null").join(levels(1).withColumnRenamed("h", key), key, "left")
        found = found.withColumn(column, F.coalesce("level", F.lit(0)).cast("byte")).select(*rows.columns)
        rows = rows.where(f"{key} is null").union(found)
    # frequent pairs are held, so no key of this join has many rows on the side of the counts or far above a level on the other
    rows = rows.join(levels(2), "h", "left")
    code = (F.col("own").cast("int") * LEVELS + F.col("context")) * LEVELS + F.coalesce("level", F.lit(0))
    return rows.groupBy("rid", "held_out", code.alias("code")).agg(F.count("*").alias("times"))


def _histogram(batches):
    for b in batches:
        sums = np.zeros(LEVELS**3, np.int64)
        for data in b.column("events").to_pylist():
            code, n = _unpacked(data)
            sums[code] += n
        code = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(sums[code])], names=["code", "times"])


def _base(model):
    return float(np.log10(model.tokens + 0.5 * (model.types + 1))) if model.types else float(np.log10(0.5))


_SCORED = "rid long, doc_id long, held_out boolean, n long, known long, base double, score double"


def score(docs, held_out, doc_id="doc_id", text="text"):
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Trains on the rows for which ``held_out`` (a condition on doc_id) is not true. Null and empty texts are one end token.
    Repeated rows count and are scored each; without any training row every token is unknown. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model, counts = train(docs, ~held_out)
    base = _base(model)
    read = _read(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out.alias("held_out"), "text"), model)
    texts, rare, open_ = (read.where(F.col("kind") == kind) for kind in ("text", "rare", "open"))
    all_settled = model.lowest == {1: 1, 2: int(level(LEAST_PAIR))}
    settled = None if all_settled else saved(_settle(open_, counts, model.lowest[1] == 1), "settled")
    seen = texts.where("not coalesce(held_out, false)").select("events").mapInArrow(_histogram, "code int, times long")
    if settled:
        seen = seen.union(settled.where("not coalesce(held_out, false)").select("code", "times"))
    seen = seen.groupBy("code").agg(F.sum("times").alias("n")).toPandas()
    model.fit(seen.code.to_numpy().astype(np.int64), seen.n.to_numpy().astype(np.int64))
    every = np.arange(LEVELS**3)
    value = spark.sparkContext.broadcast(model.log10(every))

    def run(batches):
        for b in batches:
            total = [float((value.value[code] * n).sum()) for code, n in map(_unpacked, b.column("events").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "doc_id", "held_out", "n", "known", "base")), pa.array(total, pa.float64())], names=["rid", "doc_id", "held_out", "n", "known", "base", "score"])

    out = texts.mapInArrow(run, _SCORED)
    tokens = counts.where("n = 1").select("h", "c")
    rest = rare.groupBy("rid", "h").agg(F.count("*").alias("times")).join(tokens, "h", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - base)).alias("rest"),
    )
    out = out.join(rest, "rid", "left")
    if settled:
        def valued(batches):
            for b in batches:
                own = value.value[b.column("code").to_numpy()] * b.column("times").to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(own)], names=["rid", "own"])

        late = settled.select("rid", "code", "times").mapInArrow(valued, "rid long, own double").groupBy("rid").agg(F.sum("own").alias("late"))
        out = out.join(late, "rid", "left").withColumn("score", F.col("score") + F.coalesce("late", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens if model.types else 0).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )


def held_out():
    """Condition on doc_id: the fifth of documents that are not learned from."""
    n, held = HELD_OUT
    return crc_mod(F.col("doc_id"), n) == held
