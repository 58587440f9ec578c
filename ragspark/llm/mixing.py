"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions alone.

Sizes are words. A source's target is its share of the mix by weight, at most ``MOST`` times its size; what a capped
source leaves over is shared by weight among the others. The mix consists of blocks of ``BLOCK`` words. Blocks are
allocated to sources, then within a source to shards of ``SHARD`` blocks, by the highest quotients votes / (2k + 1).
A source's documents stand in seeded order, one after another, so that a block is a run of words; in a shard of n blocks
with quota q each block is taken q div n times, and q mod n blocks, evenly spaced from a seeded start, once more.

Every order is cut into parts, ranked inside the part and moved on by the sums of the parts before, so that
neither a hot source nor a long list of sources is ranked in one task.
"""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark.llm.shared import narrow_join, saved, tasks_for

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 16
SHARD = 1024
SEED = 11
ROWS_PER_PART = 500_000
ROWS_PER_DIGITS = 2_000


def n_words(text="text"):
    """Runs of characters other than the six ASCII white-space characters; none in a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(*parts):
    """32 hexadecimal digits that depend on the seed and on ``parts``; nulls count as one space."""
    texts = [F.coalesce(F.col(p).cast("string"), F.lit(" ")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *texts).cast("binary"))


def in_order(df, group, order, sums=(), part=None):
    """Adds ``place``, a row's number from 1 in its group by ``order``, and ``before_<c>``, the sum of c over earlier rows.

    Rows are ranked within a part; a table of one row per part and group carries the sums on. ``part`` is a column that
    never falls along the order; without one, rows are dealt by range. ``df`` is read twice: it should be stored.
    """
    if part is not None:
        cut = df.withColumn("_part", part)
    else:
        parts = tasks_for(df.sparkSession, df.count(), ROWS_PER_PART)
        keys = [F.col(c) for c in group] + list(order)
        cut = saved(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ordered")
    inside = W.partitionBy("_part", *group).orderBy(*order)
    rows = cut.withColumn("_in", F.row_number().over(inside))
    for c in sums:
        rows = rows.withColumn(f"_in_{c}", F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    per = cut.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_of_{c}") for c in sums))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = per.select(
        "_part", *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_moved"),
        *(F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)).alias(f"_moved_{c}") for c in sums),
    )
    out = narrow_join(rows, saved(shift, "moved"), ["_part", *group], "inner")
    return out.select(
        *df.columns, (F.col("_in") + F.col("_moved")).alias("place"),
        *((F.coalesce(f"_in_{c}", F.lit(0)) + F.col(f"_moved_{c}")).alias(f"before_{c}") for c in sums),
    )


def targets(sources):
    """Adds ``weight`` and ``target`` to rows (name, none, source_size), one per source.

    With T words in all, the level x at which the sum of min(MOST * size, weight * x) is SHARE * T is the greatest of
    (SHARE * T - caps before) / (weights from here on) along the sources by cap / weight: it rises while sources are
    capped and falls behind the last of them.
    """
    named = saved(in_order(sources, [], [F.col("none"), F.col("name")]), "sources")
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = saved(named.select("name", "none", "source_size", weight.cast("long").alias("weight"), (MOST * F.col("source_size")).alias("cap")), "sources")
    total = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, weights = int(total.words or 0), int(total.weights or 0)
    by_ratio = in_order(weighed, [], [F.col("cap") / F.col("weight"), F.col("none"), F.col("name")], ("cap", "weight"))
    level = by_ratio.agg(F.max((F.lit(SHARE * words) - F.col("before_cap")) / (F.lit(weights) - F.col("before_weight")))).first()[0] or 0.0
    return weighed.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))))


def apportion(rows, group, votes, most, seats, tie):
    """Adds ``quota`` to every row: Sainte-Lague seats by ``votes`` within its group, at most ``most``.

    ``seats`` is a column, the same within a group, that its rows can hold together. With N rows and V votes in a group
    the seats up to votes * (seats - N / 2) / V are certain; from there to as far beyond ``seats`` quotients are listed,
    a few for each row, and the highest of them win, ties by the columns ``tie``.
    """
    per = saved(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.sum(votes).cast("double").alias("_votes")), "votes")
    v, half = F.col(votes).cast("double"), F.col("_rows") / 2
    share = lambda s: F.when(F.col("_votes") > 0, v * s / F.col("_votes")).otherwise(F.lit(0.0))
    sure = F.floor(share(F.greatest(F.lit(0.0), F.col("_seats") - half)) + 0.5) - 1
    joined = narrow_join(rows.withColumn("_seats", seats), per, group, "inner")
    listed = saved(joined.select(
        *rows.columns, F.col("_seats"), F.least(most, F.greatest(F.lit(0), sure)).cast("long").alias("_sure"),
        F.least(most, F.ceil(share(F.col("_seats") + half) + 0.5) + 2).cast("long").alias("_top"),
    ), "seats")
    open_ = listed.where("_top > _sure").select(*group, *tie, F.col(votes).alias("_v"), F.explode(F.sequence(F.col("_sure"), F.col("_top") - 1)).alias("_k"))
    quotients = saved(open_.withColumn("_quotient", F.col("_v") / (2 * F.col("_k") + 1)), "quotients")
    ranked = in_order(quotients, group, [F.col("_quotient").desc(), *(F.col(t) for t in tie)])
    sure_of = listed.groupBy(*group).agg(F.max("_seats").alias("_seats"), F.sum("_sure").alias("_given"))
    ranked = narrow_join(ranked, saved(sure_of, "given"), group, "inner")
    won = ranked.where("place <= _seats - _given").groupBy(*group, *tie).agg(F.count(F.lit(1)).alias("_won"))
    return narrow_join(listed, saved(won, "won"), [*group, *tie], "left").select(*rows.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def taken_before(word):
    """Words that a shard takes from those before ``word``, a word number of the source, in the shard of this row.

    Blocks of the shard are numbered from 0; with r = quota mod blocks and a start s, block b is taken once more where
    (b * r + s) div blocks steps up; every product stays far below the integers that a double holds exactly.
    """
    n, q = F.col("blocks"), F.col("quota")
    rest = F.pmod(q, n)
    inside = word - F.col("shard") * (SHARD * BLOCK)
    block, tail = F.floor(inside / BLOCK).cast("long"), F.pmod(inside, F.lit(BLOCK))
    steps = lambda b: F.floor(((b * rest + F.col("start")).cast("double")) / n).cast("long")
    return F.floor(q / n).cast("long") * inside + steps(block) * BLOCK + tail * (steps(block + 1) - steps(block))


def mixed(docs, doc_id="doc_id", text="text", source="source"):
    """doc_id, size, source_size, target and taken of every row; other columns are not read.

    Null texts have size 0; a null source is a source of its own, after all others and apart from ''. Repeated rows are
    documents of their own: rows alike in id, source and size may exchange what is taken from them. Reruns give the same
    rows. A source without words has the target 0. An empty table gives no row.
    """
    spark = docs.sparkSession
    sized = saved(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("name"), F.col(source).isNull().cast("int").alias("none"), n_words(text).alias("size"),
    ), "sizes")
    group = ["name", "none"]
    sources = saved(sized.groupBy(*group).agg(F.sum("size").alias("source_size")), "sources")
    aimed = saved(targets(sources), "targets")
    words = aimed.agg(F.sum("target")).first()[0] or 0.0
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    seats = F.lit(int(words / BLOCK + 0.5)).cast("long")
    shares = saved(apportion(aimed.select("*", blocks.alias("blocks"), F.lit(0).alias("mix")), ["mix"], "target", MOST * F.col("blocks"), seats, group), "shares")

    shards = shares.where("blocks > 0").select(*group, F.col("quota").alias("_q"), F.col("blocks").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / SHARD))).alias("shard"))
    shards = saved(shards.select(*group, "_q", "shard", F.least(F.lit(SHARD), F.col("_b") - F.col("shard") * SHARD).cast("long").alias("blocks")), "shards")
    shards = shards.withColumn("_h", seeded("name", "none", "shard"))
    given = apportion(saved(shards, "shards"), group, "blocks", MOST * F.col("blocks"), F.col("_q"), ["_h", "shard"])
    start = F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"), F.col("blocks"))
    given = saved(given.select(*group, "shard", "blocks", "quota", start.alias("start")), "quotas")

    with_words = saved(sized.where("size > 0").withColumn("_h", seeded("doc_id")), "seeded")
    # the first digits of the seeded order cut every source into parts of about ROWS_PER_DIGITS rows at most
    digits = math.ceil(math.log(max(2.0, with_words.count() / ROWS_PER_DIGITS), 16))
    laid = in_order(with_words, group, [F.col("_h"), F.col("doc_id"), F.col("size")], ("size",), F.substring("_h", 1, digits))
    first, last = F.col("before_size"), F.col("before_size") + F.col("size")
    span = SHARD * BLOCK
    pieces = laid.withColumn("_row", F.col("place")).withColumn("shard", F.explode(F.sequence(F.floor(first / span), F.floor((last - 1) / span))))
    joined = narrow_join(pieces, given, [*group, "shard"], "inner")
    lo, hi = F.greatest(first, F.col("shard") * span), F.least(last, (F.col("shard") + 1) * span)
    one = joined.withColumn("_part", taken_before(hi) - taken_before(lo))
    whole = one.where(F.floor(first / span) == F.floor((last - 1) / span)).select("doc_id", "size", *group, F.col("_part").alias("taken"))
    cut = one.where(F.floor(first / span) < F.floor((last - 1) / span)).groupBy(*group, "_row", "doc_id", "size").agg(F.sum("_part").alias("taken"))
    out = whole.unionByName(cut.select("doc_id", "size", *group, "taken")).unionByName(sized.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select("doc_id", "size", *group, "taken"))
    out = narrow_join(out, aimed.select(*group, "source_size", "target"), group, "inner")
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"))


#: The same mix by listing every quotient and every block.
SQL = r"""
with sized as (
  select doc_id, coalesce(source, '') as name, (source is null)::int as none,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sources as (select name, none, sum(size)::bigint as source_size from sized group by name, none),
weighed as (
  select name, none, source_size, 2 * source_size as cap,
    [5, 2, 1][(row_number() over (order by none, name) - 1) % 3 + 1] as weight from sources),
steps as (
  select coalesce(sum(cap) over o, 0) as caps, coalesce(sum(weight) over o, 0) as weights from weighed
  window o as (order by cap / weight, none, name rows between unbounded preceding and 1 preceding)),
levels as (select max((1.5 * (select sum(source_size) from weighed) - caps) / ((select sum(weight) from weighed) - weights)) as level from steps),
aimed as (
  select name, none, source_size, least(cap::double, weight * level) as target, ceil(source_size / 16)::bigint as blocks
  from weighed, levels),
seats as (
  select name, none, row_number() over (order by target / (2 * k + 1) desc, name, none) as place
  from (select name, none, target, unnest(range(2 * blocks)) as k from aimed)),
shares as (
  select name, none, count(*) as quota from seats
  where place <= floor((select sum(target) from aimed) / 16 + 0.5) group by name, none),
shards as (
  select *, least(1024, blocks - 1024 * shard) as n, md5('11:' || name || ':' || none || ':' || shard) as h
  from (select a.name, a.none, a.blocks, coalesce(s.quota, 0) as quota, unnest(range((a.blocks + 1023) // 1024)) as shard
        from aimed a left join shares s on a.name = s.name and a.none = s.none)),
shard_seats as (
  select name, none, shard, quota, row_number() over (partition by name, none order by n / (2 * k + 1) desc, h, shard) as place
  from (select name, none, shard, n, h, quota, unnest(range(2 * n)) as k from shards)),
given as (
  select s.name, s.none, s.shard, s.n, count(p.place) as quota, ('0x' || substr(s.h, 1, 8))::bigint % s.n as start
  from shards s left join shard_seats p on p.name = s.name and p.none = s.none and p.shard = s.shard and p.place <= p.quota
  group by s.name, s.none, s.shard, s.n, s.h),
laid as (
  select *, row_number() over () as row_id from (
    select *, coalesce(sum(size) over (partition by name, none order by md5('11:' || coalesce(doc_id::varchar, ' ')), doc_id nulls first, size
      rows between unbounded preceding and 1 preceding), 0)::bigint as first from sized)),
pieces as (select row_id, name, none, first, first + size as last, unnest(range(first // 16, (first + size + 15) // 16)) as block from laid where size > 0),
parts as (
  select p.row_id, (least(p.last, 16 * p.block + 16) - greatest(p.first, 16 * p.block)) * (
    g.quota // g.n + ((p.block % 1024 + 1) * (g.quota % g.n) + g.start) // g.n - ((p.block % 1024) * (g.quota % g.n) + g.start) // g.n) as taken
  from pieces p join given g on p.name = g.name and p.none = g.none and g.shard = p.block // 1024),
sums as (select row_id, sum(taken) as taken from parts group by row_id)
select l.doc_id, l.size, a.source_size, a.target, coalesce(s.taken, 0)::bigint as taken
from laid l join aimed a on a.name = l.name and a.none = l.none left join sums s on s.row_id = l.row_id
"""
