"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of five words (``[^\\x20\\x09-\\x0D]+``, A-Z folded). Its parity sketch has K
blocks of 2^64 bits, of which every shingle flips one bit of one block; a block is written down as the XOR of its odd
bits' numbers. Blocks in which two sketches differ are at most the shingles in which the sets differ, and a set of size
x in a pair with Jaccard similarity s >= 4/5 differs from its partner in at most d(x) = x (1 / s - 1) shingles. So at
least K - d(x) blocks of such a pair are equal, in the bands of sizes that both belong to.

Of its K blocks a document emits only some. Under any total order of block values that all documents share, a document
may leave out its first K - d(x) - 1 blocks: the last of the blocks that a pair has in common stays in both. Two orders are
used one after the other: blocks of few shingles go first (they tell little), then, among what is emitted, values that
many documents have. How many of these may go is derived from the band (``spare``), so that both ends of a pair agree on
it: d(x) + 1 + spare blocks are emitted, so at least spare + 1 are in common, and neither end drops more than spare of them
(a document in two bands drops the lower one's number). A document left without any block has no partner; so texts that merely
share some passages go out here. What still meets on a block value is verified with the exact sets.

Groups that meet are not expanded into pairs. First every member is verified against its group's first, and what is linked
is joined into components. Of groups that still hold two components, the small ones verify the pairs across these (a
bounded number for each member). Large ones that share documents are families of similar texts; a family is compared in
tiles of bounded size by matrix products of its texts' sets, and a tile returns an edge for each document that is linked,
never pairs. So every pair of different components that shares a block is compared, and the components are exact.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark.llm import words as T
from ragspark.llm.components import components
from ragspark.llm.shared import narrow_join, saved, tasks_for

SHINGLE = 5
NUMER, DENOM = 4, 5
#: A key that so many documents of one batch have is dealt out by document, not by key.
HOT_IN_BATCH = 16
#: Counts of a key above this are not told apart.
MANY = 1_000
#: Groups up to this size verify their pairs, larger ones are compared in tiles of about TILE documents a side.
SMALL = 24
TILE = 128
#: Shingles of a tile that are compared at once.
COLUMNS = 1 << 14
KEYS_PER_TASK = 1_000_000
#: Pairs whose texts a task holds at once while it verifies them.
PAIRS = 256

_ROW = pa.schema([("slot", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("kind", pa.int8())])
#: In both, n is the size of the document's set where the row tells sizes, else the number of keys that it drops.
_MET = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("often", pa.int32())])
NORMAL, HOT, MARKER, SIZE = 0, 1, 2, 3


def differing(n):
    """Most shingles in which a set of n differs from a partner at the threshold."""
    return n * (DENOM - NUMER) // NUMER


def spare(band):
    """Shared keys that a document may drop of those that it emits in a band, the same for all sizes in it."""
    return 3 * (1 << band) // 32 + 1


def blocks_in(band):
    low = 1 << band
    return low * 7 // 8 + 2


def bands_of(n):
    """Band t holds sizes from 2^t to below 2^(t+1), and above it those that a size in it can be paired with."""
    t = n.bit_length() - 1
    below = (1 << t) - 1
    return (t, t - 1) if t and NUMER * n <= DENOM * below else (t,)


def slack(n):
    """Keys that a set of n drops: no more than the spare ones of any of its bands."""
    return spare(bands_of(n)[-1])


def sketch(found, blocks):
    """Blocks of the parity sketch of a set of hashes, and how many of them each holds."""
    at = (((found >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
    out = np.zeros(blocks, np.uint64)
    np.bitwise_xor.at(out, at, found)
    return out, np.bincount(at, minlength=blocks).astype(np.uint64)


def block_keys(found):
    """Keys under which a set is emitted: for each band its blocks without those that may be left out."""
    n, keys = len(found), []
    for band in bands_of(n):
        blocks = blocks_in(band)
        value, held = sketch(found, blocks)
        place = T.mix(np.arange(blocks, dtype=np.uint64) + np.uint64((band + 1) << 40))
        key = T.mix(value ^ place)
        keep = min(blocks, differing(n) + 1 + spare(band))
        if keep < blocks:
            order = ((np.uint64(64) - np.minimum(held, np.uint64(64))) << np.uint64(57)) | (key >> np.uint64(7))
            key = key[np.argpartition(order, keep - 1)[:keep]]
        keys.append(key)
    return keys


def _emit(batch):
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for first, data, offsets in T.slices(batch.column(1)):
        w = T.Words(data, offsets)
        windows = w.windows(SHINGLE)
        keys, owner, sizes, drops = [], [], np.zeros(len(offsets) - 1, np.int32), np.zeros(len(offsets) - 1, np.int32)
        for r in range(len(offsets) - 1):
            found = T.shingles(w, r, windows, SHINGLE)
            sizes[r] = len(found)
            if len(found):
                own, drops[r] = block_keys(found), slack(len(found))
                keys += own
                owner.append(np.full(sum(map(len, own)), r, np.int64))
        rows = np.arange(len(sizes))
        yield _rows(T.mix(ids[first + rows].astype(np.uint64)), np.zeros(len(rows), np.uint64), ids[first + rows], sizes, SIZE)
        if not keys:
            continue
        key, owner = np.concatenate(keys), np.concatenate(owner)
        values, back, count = np.unique(key, return_inverse=True, return_counts=True)
        hot = count[back] >= HOT_IN_BATCH
        yield _rows(key[~hot], key[~hot], ids[first + owner[~hot]], drops[owner[~hot]], NORMAL)
        if hot.any():
            o = owner[hot]
            yield _rows(T.mix(ids[first + o].astype(np.uint64)), key[hot], ids[first + o], drops[o], HOT)
            marked = values[count >= HOT_IN_BATCH]
            yield _rows(marked, marked, np.zeros(len(marked), np.int64), np.zeros(len(marked), np.int32), MARKER)


def _rows(slot, key, ids, n, kind):
    return pa.RecordBatch.from_arrays(
        [pa.array(slot.view(np.int64)), pa.array(key.view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(np.full(len(key), kind, np.int8))],
        schema=_ROW,
    )


def _met(batches):
    """Of a partition dealt out by slot: rows whose key another document has, with the key's count, and the sizes."""
    keys, ids, sizes, marked = [], [], [], []

    def out(i, k, n, often):
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(n), pa.array(often.astype(np.int32))], schema=_MET)

    for b in batches:
        key, i, n, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "n", "kind"))
        for what, often in ((SIZE, 0), (HOT, MANY)):
            m = kind == what
            if m.any():
                yield out(i[m], key[m], n[m], np.full(m.sum(), often))
        marked.append(key[kind == MARKER])
        m = kind == NORMAL
        keys.append(key[m]), ids.append(i[m]), sizes.append(n[m])
    if not keys:
        return
    key, i, n = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes)
    del keys, ids, sizes
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    count = np.minimum(np.diff(edge), MANY)
    hot = np.unique(np.concatenate(marked))
    count[np.isin(key[edge[:-1]], hot)] = MANY
    often = np.repeat(count, np.diff(edge))
    m = often > 1
    i, n, key, often = i[order[m]], n[order[m]], key[m], often[m]
    for k in range(0, len(key), 1 << 17):
        s = slice(k, k + (1 << 17))
        yield out(i[s], key[s], n[s], often[s])
    del i, n, key, often
    pa.default_memory_pool().release_unused()


def _verify(batches):
    """Pairs whose sets are similar enough, counted on the whole sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for whole in batches:
        for at in range(0, len(whole), PAIRS):
            batch = whole.slice(at, PAIRS)
            m = pa.array([_similar(x, y) for x, y in zip(_sets(batch.column("text_a")), _sets(batch.column("text_b")))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(m), batch.column("b").filter(m)], schema=schema)


def _sets(column):
    for _, data, offsets in T.slices(column):
        w = T.Words(data, offsets)
        windows = w.windows(SHINGLE)
        for r in range(len(offsets) - 1):
            yield T.shingles(w, r, windows, SHINGLE)


def _similar(x, y):
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return len(both) > 0 and DENOM * common >= NUMER * (len(both) - common)


def verified(pairs, docs):
    """The links among candidate ``pairs`` (a, b) of a stored table; texts are fetched for their ends only."""
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    texts = saved(narrow_join(docs, wanted, "doc_id", "left_semi"), "texts")
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def jaccard_groups(docs, doc_id="doc_id", text="text"):
    """Per document its set's size and the smallest id reachable by links of similarity 0.8 or more.

    Columns doc_id, n_shingles long, component_id. Null and empty texts and texts without words have an empty set and
    stand alone; texts with fewer words than a shingle are one shingle. Rows that repeat an id must repeat the text;
    rows with a null id are left out. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    # texts that are the same byte for byte are handled once
    same = saved(docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("same"), F.octet_length("text").alias("size")), "same")
    first = same.groupBy("same").agg(F.min("doc_id").alias("rep"))
    size = same.agg(F.sum("size")).first()[0] or 0
    rows = docs.mapInArrow(lambda it: (r for b in it for r in _emit(b)), "slot long, key long, id long, n int, kind byte")
    met = saved(
        rows.repartition(tasks_for(spark, size // 12, KEYS_PER_TASK), "slot").mapInArrow(_met, "id long, key long, n int, often int"), "met"
    )
    sizes = met.where("often = 0").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles")).distinct()
    # leave out, per document, the values that most documents have
    ranked = met.where("often > 0").join(first.select(F.col("rep").alias("id")), "id", "left_semi").distinct()
    w = W.partitionBy("id").orderBy(F.desc("often"), F.desc("key"))
    groups = ranked.withColumn("rank", F.row_number().over(w)).where("rank > n")
    groups = saved(_shared(groups.select("key", "id")), "groups")
    links = saved(verified(saved(_to_first(groups), "pairs"), docs), "links")
    joined = saved(components(links), "joined")
    open_ = saved(_open(groups, joined), "open")
    across = saved(_across(open_.where(F.col("n") <= SMALL)), "pairs")
    links = links.unionByName(saved(verified(across, docs), "links"))
    links = links.unionByName(saved(_families(open_.where(F.col("n") > SMALL), docs), "links"))
    joined = saved(components(links), "joined")
    rep = same.select("doc_id", "same").join(first, "same").select("doc_id", "rep").distinct()
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "rep"))  # no words, no link
    out = rep.join(joined.withColumnRenamed("id", "rep"), "rep", "left").join(sizes, "doc_id")
    return docs.select("doc_id").join(out, "doc_id").select("doc_id", "n_shingles", own.alias("component_id"))


def _shared(groups):
    """Rows of keys that at least two documents have."""
    several = groups.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return groups.join(several, "key", "left_semi")


def _to_first(groups):
    """Each member with the first of its group, every pair once."""
    first = groups.groupBy("key").agg(F.min("id").alias("a"))
    return groups.join(first, "key").where("id > a").select("a", F.col("id").alias("b")).distinct()


def _open(groups, joined):
    """(key, id, c, n) of groups that hold several components, one key of those that have the same documents.

    The members' components are c, a group has n members. Its first member stays in: it was verified against all, but its
    component may be linked to others' through it alone."""
    labelled = groups.join(joined, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("c"))
    sums = labelled.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")
    )
    return labelled.join(sums.where("lo < hi").groupBy("n", "s").agg(F.min("key").alias("key")).select("key", "n"), "key")


def _across(open_):
    """Pairs of different components in small groups, every pair once."""
    other = open_.select("key", F.col("id").alias("b"), F.col("c").alias("d"))
    return open_.join(other, "key").where("id < b and c <> d").select(F.col("id").alias("a"), "b").distinct()


def _families(open_, docs):
    """Links, as edges, within the families of large groups."""
    first = open_.groupBy("key").agg(F.min("id").alias("a"))
    families = saved(components(open_.join(first, "key").select("a", F.col("id").alias("b"))), "families")
    parts = families.groupBy("component_id").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    sided = families.join(parts, "component_id").withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")))
    tiles = sided.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.col("component_id").alias("family"), "id", "side", (F.least("side", "other") * F.col("parts") + F.greatest("side", "other")).alias("tile"), F.expr("side = other").alias("within")
    )
    wanted = families.select(F.col("id").alias("doc_id"))
    texts = saved(narrow_join(docs, wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    rows = tiles.join(texts.withColumnRenamed("doc_id", "id"), "id").select("family", "tile", "id", "side", "within", "text")
    return rows.repartition("family", "tile").sortWithinPartitions("family", "tile").mapInArrow(_tiles, "a long, b long")


def _tiles(batches):
    """Batches sorted by (family, tile); the sets of one tile are held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    now, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "tile"))))
        rest = zip(keys, *(batch.column(c).to_pylist() for c in ("id", "side", "within")), _sets(batch.column("text")))
        for key, *row in rest:
            if key != now and held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _edges(held)], schema=schema)
                held = []
            now = key
            held.append(row)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _edges(held)], schema=schema)


def _edges(rows):
    """An edge for each document of a tile that is linked to a smaller one, to the smallest it reaches in the tile."""
    rows = sorted(rows, key=lambda r: r[0])
    ids, side, within = (np.array([r[k] for r in rows]) for k in range(3))
    n, size = len(rows), np.array([len(r[3]) for r in rows])
    owner = np.repeat(np.arange(n), size)
    values, at, often = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
    rank = np.cumsum(often > 1) - 1
    several = often[at] > 1
    owner, at = owner[several], rank[at[several]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((n, n), np.float32)
    for lo in range(0, int((often > 1).sum()), COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[a:b], at[a:b] - lo] = 1
        common += part @ part.T
    linked = DENOM * common >= NUMER * (size[:, None] + size[None, :] - common)
    linked &= (side[:, None] != side[None, :]) | within[:, None]
    a, b = np.nonzero(np.triu(linked, 1))
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return ids[label[moved]], ids[moved]
