"""How far the sources of a language differ in their words, with identical texts collapsed.

Rows with one text per language become one row with the number of its copies in each source: first inside every batch, then by
a shuffle on (language, digest) and a sorted stream. Each such text is cut into terms once; a term's occurrences
and documents count once per copy in each source. Terms are summed per task before they are shuffled by (language, term), those of at
least ``LEAST_DOCS`` documents of the language are kept, and every group of language and source gets smoothed whole-number shares.

Distances of the sources of a language are sums over terms of |p - q|. Where a source lacks a term its share is one constant, so
only terms that it has are visited: the sum over all terms with both constants is corrected for the terms of one side, then for
terms that both have. Tasks give one number per pair of sources; no pair of rows leaves a task.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark.llm import words as T
from ragspark.llm.shared import narrow_join, saved, tasks_for

LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP = 50
#: Rows of text in one task of the shuffle, and terms that a task sums before it hands them on.
TEXTS_PER_TASK = 4_000
HELD_TERMS = 1_500_000
#: Terms of one task that counts those of a language.
TERMS_PER_TASK = 500_000
TERMS_PER_TEXT = 150
#: (term, source) entries that are compared at once.
ENTRIES = 200_000

NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

COPIES = "lang string, digest binary, text string, sources array<string>, copies array<long>"
COUNTS = "g long, term string, n int, docs int"


def _copies(batches):
    """Distinct (lang, text) of every batch with the copies in each source."""
    for b in batches:
        held = {}
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            key = lang, xxhash.xxh3_128_digest(text.encode())
            _, own = held.setdefault(key, (text, {}))
            own[source] = own.get(source, 0) + 1
        yield _texts((lang, digest, text, own) for (lang, digest), (text, own) in held.items())


def _texts(rows):
    lang, digest, text, own = zip(*rows) if (rows := list(rows)) else ((),) * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(digest, pa.binary()), pa.array(text, pa.string()), pa.array([list(o) for o in own], pa.list_(pa.string())), pa.array([list(o.values()) for o in own], pa.list_(pa.int64()))],
        names=["lang", "digest", "text", "sources", "copies"],
    )


def collapsed(docs, text="text", lang="lang", source="source"):
    """One row per language and text, sorted by them within its task: (lang, text, sources, copies)."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    parts = tasks_for(docs.sparkSession, named.count(), TEXTS_PER_TASK)
    dealt = named.mapInArrow(_copies, COPIES).repartition(parts, "lang", "digest").sortWithinPartitions("lang", "digest")

    def merge(batches):
        last = None
        for b in batches:
            done = []
            for lang_, digest, text_, sources, copies in zip(*(c.to_pylist() for c in b.columns)):
                if last is None or last[:2] != (lang_, digest):
                    if last is not None:
                        done.append(last)
                    last = (lang_, digest, text_, {})
                for s, n in zip(sources, copies):
                    last[3][s] = last[3].get(s, 0) + n
            if done:
                yield _texts(done)
        if last is not None:
            yield _texts([last])

    return dealt.mapInArrow(merge, COPIES)


class _Sums:
    """Occurrences and documents of every (group, term) that a task has met since it last handed them on."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, group, hashes, n, docs, terms):
        """Entries of one slice, which are summed at once: most terms of a slice recur in it."""
        order = np.lexsort((group, hashes))
        group, hashes = group[order], hashes[order]
        first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])])
        self.parts.append((group[first], hashes[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first), terms[order[first]]))
        self.held += len(first)

    def batches(self):
        if not self.held:
            return
        parts, self.parts, self.held = [np.concatenate(x) for x in zip(*self.parts)], [], 0
        self.add(*parts)
        ((group, _, n, docs, terms),) = self.parts
        out = [pa.array(group), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int32)), pa.array(docs.astype(np.int32))]
        table = pa.RecordBatch.from_arrays(out, names=["g", "term", "n", "docs"])
        for k in range(0, len(table), 50_000):
            yield table.slice(k, 50_000)
        self.parts, self.held = [], 0


def _counting(number):
    """Per (group, term) occurrences and documents, copies counted; ``number`` gives every (lang, source) its group."""

    def run(batches):
        sums = _Sums()
        for b in batches:
            langs, sources, copies = (b.column(c).to_pylist() for c in ("lang", "sources", "copies"))
            for first, data, offsets in T.slices(b.column("text")):
                w = T.Words(data, offsets, gap=NOT_TERM)
                if not len(w.hash):
                    continue
                # one entry per text and term: where it starts, and how often it occurs
                _, once, tf = np.unique(T.mix(w.hash + T.mix(w.row_of_word().astype(np.uint64))), return_index=True, return_counts=True)
                text, h = np.searchsorted(w.row, once, "right") - 1, w.hash[once]
                _, at, name = np.unique(h, return_index=True, return_inverse=True)
                names = np.empty(len(at), object)
                names[:] = [w.text(k).translate(_LOWER) for k in once[at].tolist()]
                # then one per text, term and source of the text
                rows = range(first, first + len(offsets) - 1)
                n_of = np.array([len(sources[k]) for k in rows], np.int64)
                groups = np.array([number[langs[k], s] for k in rows for s in sources[k]], np.int64)
                many = np.array([c for k in rows for c in copies[k]], np.int64)
                take = np.repeat(np.arange(len(text)), n_of[text])
                inner = np.arange(len(take)) - np.repeat(np.cumsum(n_of[text]) - n_of[text], n_of[text])
                where = (np.cumsum(n_of) - n_of)[text[take]] + inner
                sums.add(groups[where], h[take], many[where] * tf[take], many[where], names[name[take]])
                if sums.held >= HELD_TERMS:
                    yield from sums.batches()
        yield from sums.batches()

    return run


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _share(n, total, kinds):
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * kinds)), in whole numbers of any size."""
    return F.expr(f"cast(1 + (cast({UNIT} as decimal(20,0)) * ({n} + {SMOOTHING})) div cast({total} + {SMOOTHING} * {kinds} as decimal(38,0)) as bigint)")


def counts(docs, **columns):
    """(kept terms: lang, source, term, n; groups: lang, source, total, kinds), both stored.

    Groups are numbered on the driver: the result has a row for every two of a language, so their list is far smaller.
    ``total`` is the number of a group's occurrences of kept terms, ``kinds`` the number of kept terms of its language.
    """
    named = docs.select(*(F.coalesce(F.col(columns.get(c, c)), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    found = sorted(tuple(r) for r in named.toLocalIterator())
    langs = {lang: k for k, lang in enumerate(dict.fromkeys(lang for lang, _ in found))}
    number = {(lang, source): (langs[lang] << 32) + k for k, (lang, source) in enumerate(found)}
    names = F.broadcast(docs.sparkSession.createDataFrame([(g, *own) for own, g in number.items()], "g long, lang string, source string"))

    counted = collapsed(docs, **columns).mapInArrow(_counting(number), COUNTS).withColumn("l", F.shiftright("g", 32))
    parts = tasks_for(docs.sparkSession, docs.count() * TERMS_PER_TEXT, TERMS_PER_TASK)
    sums = counted.repartition(parts, "l", "term").groupBy("l", "term", "g").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = sums.groupBy("l", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("g", "n")).alias("own")).where(F.col("docs") >= LEAST_DOCS)
    kept = saved(whole.select("term", F.inline("own")).join(names, "g").select("lang", "source", "term", "n"), "kept")
    kinds = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.select("lang", "source").join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
    zero = F.lit(0).cast("long")
    return kept, saved(groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kinds", zero).alias("kinds")), "groups")


def _distances(shares, groups):
    """(lang, a, b, value) for a < b in the order of names, from rows (lang, term, entries array<(source, p)>).

    ``groups`` lists (lang, source, p of an absent term, kinds); the result has the square of its rows per language,
    which is why it may be held in every task.
    """
    names, zero, kinds = {}, {}, {}
    for lang, source, p, n in sorted(groups):
        names.setdefault(lang, []).append(source)
        zero.setdefault(lang, []).append(p)
        kinds[lang] = n
    number = {lang: {s: k for k, s in enumerate(own)} for lang, own in names.items()}

    def run(batches):
        held, sums = {}, {}

        def add(lang):
            entries = held.pop(lang)
            term = np.repeat(np.arange(len(entries)), [len(x) for x in entries])
            source = np.array([number[lang][s] for x in entries for s, _ in x], np.int64)
            p = np.array([v for x in entries for _, v in x], np.int64)
            base = np.array(zero[lang], np.int64)
            gap = np.abs(base[:, None] - base[None, :])
            total = sums.setdefault(lang, np.zeros((len(base), len(base)), np.int64))
            order = np.argsort(source, kind="stable")
            edge = np.searchsorted(source[order], np.arange(len(base) + 1))
            first = np.searchsorted(term, np.arange(len(entries) + 1))
            for i in range(len(base)):
                own = order[edge[i] : edge[i + 1]]
                if not len(own):
                    continue
                one = np.array([np.abs(p[own] - c).sum() for c in base.tolist()]) - len(own) * gap[i]
                total[i] += one
                total[:, i] += one
                # the other sources of the same terms
                size = first[term[own] + 1] - first[term[own]]
                mine = np.repeat(own, size)
                other = np.repeat(first[term[own]], size) + np.arange(len(mine)) - np.repeat(np.cumsum(size) - size, size)
                j = source[other]
                d = np.abs(p[mine] - p[other]) - np.abs(p[mine] - base[j]) - np.abs(base[i] - p[other]) + gap[i][j]
                np.add.at(total[i], j, d)

        for b in batches:
            for lang, entries in zip(b.column("lang").to_pylist(), b.column("entries").to_pylist()):
                own = held.setdefault(lang, [])
                own.append([(e["source"], e["p"]) for e in entries])
                if len(own) * len(names[lang]) >= ENTRIES:
                    add(lang)
        for lang in list(held):
            add(lang)
        for lang, total in sums.items():
            a, b = np.triu_indices(len(total), 1)
            own = np.array(names[lang], object)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(own[a], pa.string()), pa.array(own[b], pa.string()), pa.array(total[a, b])], names=["lang", "a", "b", "value"])

    sums = shares.mapInArrow(run, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs, **columns):
    """lang, source, part, item, value, rank: every other source by distance, and the group's 50 most raised terms.

    Null texts, languages and sources count as ''. Repeated rows count each. A group without terms is listed against
    the others; a language with one source has no pairs; without kept terms all distances are 0. Other columns are not read.
    """
    kept, groups = counts(docs, **columns)
    shared = narrow_join(kept, groups, ["lang", "source"], "inner").select("lang", "source", "term", "n", _share("n", "total", "kinds").alias("p"))
    listed = groups.select("lang", "source", _share("0", "total", "kinds").alias("p"), "kinds").where("kinds > 0")
    rows = [tuple(r) for r in listed.toLocalIterator()]
    entries = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p")).alias("entries"))
    found = _distances(entries, rows)
    base = listed.select("lang", F.col("source"), F.col("p"), "kinds")
    left, right = base.select("lang", F.col("source").alias("a"), F.col("p").alias("pa"), "kinds"), base.select("lang", F.col("source").alias("b"), F.col("p").alias("pb"))
    every = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    constant = every.join(left, ["lang", "a"], "left").join(right, ["lang", "b"], "left").select("lang", "a", "b", F.coalesce(F.col("kinds") * F.abs(F.col("pa") - F.col("pb")), F.lit(0).cast("long")).alias("constant"))
    half = saved(constant.join(found, ["lang", "a", "b"], "left").select("lang", "a", "b", (F.col("constant") + F.coalesce("value", F.lit(0))).alias("value")), "distances")
    pair = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("all_of_lang"), F.max("kinds").alias("kinds"))
    whole = saved(kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(of_lang, "lang").select("lang", "term", _share("n", "all_of_lang", "kinds").alias("q")), "shares")
    raised = shared.join(whole, ["lang", "term"]).where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = raised.select("*", rank).where(F.col("rank") <= TOP)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pair.select("*", rank), "pair").unionByName(shown(terms, "term"))


#: The same over every term and every pair of groups.
SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as terms
  from documents),
c as (select lang, source, term, count(*) as n from (select lang, source, unnest(terms) as term from d) group by lang, source, term),
k as (select lang, term from (select lang, unnest(list_distinct(terms)) as term from d) group by lang, term having count(*) >= 30),
g as (select distinct lang, source from d),
v as (select g.lang, count(k.term) as kinds from (select distinct lang from g) g left join k on k.lang = g.lang group by g.lang),
f as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k on k.lang = g.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (
  select f.lang, f.source, f.term, f.n, (1 + (1000000000::hugeint * (f.n + 5)) // (sum(f.n) over (partition by f.lang, f.source) + 5 * v.kinds))::bigint as p
  from f join v on v.lang = f.lang),
l as (select lang, term, sum(n) as n from f group by lang, term),
q as (
  select l.lang, l.term, (1 + (1000000000::hugeint * (l.n + 5)) // (sum(l.n) over (partition by l.lang) + 5 * v.kinds))::bigint as q
  from l join v on v.lang = l.lang),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source
    group by x.lang, x.source, y.source) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
raised as (select p.lang, p.source, p.term as item, p.p - q.q as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from raised)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""
