"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are at most D^2 = 2 - 2c apart (squared). A random rotation spreads that distance over
the coordinates; the rotated vectors are cut into blocks of about ``BLOCK`` dimensions, each with a budget in proportion to
its dimensions. At least one block of a linked pair keeps its budget. Each block is joined by range: a vector is entered
in every cell of a grid over the block's first ``GRID`` dimensions that comes within half the budget's radius, so both
ends of such a pair are entered in the cell of their midpoint. A vector that has no other of its cell within the block's
budget goes out there, before any whole vector is moved. Only in the midpoint's cell, and only in the first block that keeps its budget, is a pair verified, with the whole
vectors in double precision, so that every pair counts once.

Equal vectors are joined first. A cell's vectors are compared in tiles of bounded size by matrix products; a tile returns a
number of links for each vector and one edge for each vector that is not the smallest of its group in the tile, never pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark.llm import words as T
from ragspark.llm.components import components
from ragspark.llm.shared import saved

COSINE = 0.98
BLOCK = 16
#: Dimensions of a block that the grid divides: more of them for more vectors of a label.
GRID = 12
TILE = 1024
#: Larger cells are not searched in one task; all their vectors go on to the tiles.
CELL = 4096
#: Larger groups than this are compared by matrix products, smaller ones row by row with their neighbours.
SMALL = 12
_EPS = 1e-9


def rotation(d):
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d):
    n = max(1, d // BLOCK)
    edges = np.linspace(0, d, n + 1).astype(int)
    return list(zip(edges[:-1], edges[1:]))


def budget(lo, hi, d):
    return (2 - 2 * COSINE + _EPS) * (hi - lo) / d


def cell_hash(block, cells):
    h = np.full(cells.shape[:-1], block + 1, np.uint64)
    for k in range(cells.shape[-1]):
        h = T.mix(h * np.uint64(T.BASE) + cells[..., k].astype(np.int64).view(np.uint64))
    return h


def near_cells(values, width, radius2):
    """The grid cell of a point and those around it that come within the radius."""
    home = np.floor(values / width)
    inside = values / width - home
    steps = sorted([((f * width) ** 2, k, -1) for k, f in enumerate(inside.tolist())] + [(((1 - f) * width) ** 2, k, 1) for k, f in enumerate(inside.tolist())])
    steps = [s for s in steps if s[0] <= radius2]
    found, stack = [home], [(0, radius2, home)]
    while stack:
        first, room, at = stack.pop()
        for i in range(first, len(steps)):
            cost, k, by = steps[i]
            if cost > room:
                break
            if at[k] != home[k]:
                continue
            moved = at.copy()
            moved[k] += by
            found.append(moved)
            stack.append((i + 1, room - cost, moved))
    return np.array(found)


def _unit(rows):
    x = rows / np.abs(rows).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lists(column, kind):
    """Rows of a list column by their length: yields (row numbers, matrix)."""
    n = np.array([len(v) for v in column], np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    start = np.cumsum(n) - n
    for d in np.unique(n).tolist():
        at = np.flatnonzero(n == d)
        yield at, flat[start[at][:, None] + np.arange(d)]


def _rotate(batches):
    for b in batches:
        out = [None] * len(b)
        for at, rows in _lists(b.column("embedding"), np.float64):
            y = _unit(rows) @ rotation(rows.shape[1]).T
            for i, v in zip(at.tolist(), y):
                out[i] = v
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, "turned"])


def _enter(batches):
    for b in batches:
        ids, labels = b.column("id"), b.column("label")
        rows, keys, parts = [], [], []
        for at, y in _lists(b.column("turned"), np.float64):
            d = y.shape[1]
            for j, (lo, hi) in enumerate(blocks_of(d)):
                for i, v in zip(at.tolist(), y[:, lo:hi]):
                    h = cell_hash(j * 100_000 + d, near_cells(v[:GRID], 2 / np.sqrt(d), budget(lo, hi, d) / 4 * (1 + _EPS)))
                    keys.append(h)
                    rows.append(np.full(len(h), i))
                    parts += [np.append(v, budget(lo, hi, d)).astype("<f4").tobytes()] * len(h)
        if rows:
            row, key = pa.array(np.concatenate(rows)), np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([ids.take(row), labels.take(row), pa.array(key.view(np.int64)), pa.array(parts, pa.binary())], names=["id", "label", "cell", "part"])


def _within(batches):
    """Of (label, cell, id, part), sorted by label and cell: the rows that have another of their cell within the budget.

    A cell that a batch breaks off is carried on to the next; it has at most CELL rows."""
    held = None
    for b in batches:
        b = pa.Table.from_batches([b])
        b = (pa.concat_tables([held, b]) if held is not None else b).combine_chunks()
        key = np.stack([b.column(c).to_numpy() for c in ("label", "cell")])
        edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        held = b.slice(int(edge[-1]))
        yield from _near(b.slice(0, int(edge[-1])))
    if held is not None:
        yield from _near(held)


def _near(t):
    n = len(t)
    if not n:
        return
    parts = t.column("part").to_pylist()
    key = np.stack([t.column(c).to_numpy() for c in ("label", "cell")])
    edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True])
    keep = np.zeros(n, bool)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if len({len(p) for p in parts[lo:hi]}) > 1:  # vectors of other lengths never share a cell but by a hash
            keep[lo:hi] = True
            continue
        x = np.frombuffer(b"".join(parts[lo:hi]), "<f4").reshape(hi - lo, -1).astype(np.float64)
        x, most = x[:, :-1], float(x[0, -1]) + 1e-5
        square = (x * x).sum(1)
        for at in range(0, hi - lo, 512):
            far = square[at : at + 512, None] + square - 2 * x[at : at + 512] @ x.T
            keep[lo + at : lo + at + len(far)] = (far <= most).sum(1) > 1
    t = t.select(["id", "label", "cell"]).filter(pa.array(keep))
    yield from t.combine_chunks().to_batches()


def _counted(cell, xa, xb, ya, yb):
    """Of vectors paired row by row: which are linked and are to be counted in this cell."""
    d = xa.shape[1]
    linked = (xa * xb).sum(1) >= COSINE
    out, open_ = np.zeros(len(linked), bool), np.flatnonzero(linked)
    for j, (lo, hi) in enumerate(blocks_of(d)):
        p, q = ya[open_, lo:hi], yb[open_, lo:hi]
        ok = ((p - q) ** 2).sum(1) <= budget(lo, hi, d)
        here = cell_hash(j * 100_000 + d, np.floor((p[ok] + q[ok])[:, :GRID] / 2 / (2 / np.sqrt(d)))) == cell[open_[ok]]
        out[open_[ok][here]] = True
        open_ = open_[~ok]
    return out


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _links(a, b, links):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(links, np.int64))], schema=_LINK)


def _tile(g):
    """Links of a group of more than a few vectors, by blocks of matrix products."""
    n = len(g["id"])
    x, y, side = g["x"], g["y"], g["side"]
    links, label = np.zeros(n, np.int64), np.arange(n)
    pairs = []
    for i in range(0, n, 256):
        close = np.argwhere(x[i : i + 256] @ x.T >= COSINE - 1e-9)
        a, b = close[:, 0] + i, close[:, 1]
        m = (a < b) & ((side[a] != side[b]) | g["within"])
        a, b = a[m], b[m]
        for k in range(0, len(a), 8192):
            p, q = a[k : k + 8192], b[k : k + 8192]
            ok = _counted(np.full(len(p), g["cell"], np.uint64), x[p], x[q], y[p], y[q])
            pairs.append((p[ok], q[ok]))
    a, b = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    np.add.at(links, a, g["many"][b])
    np.add.at(links, b, g["many"][a])
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (before == label).all():
            break
    own = np.flatnonzero(label != np.arange(n))
    some = np.flatnonzero(links)
    yield _links(g["id"][some], g["id"][some], links[some])
    yield _links(g["id"][own], g["id"][label[own]], np.zeros(len(own)))


def _compare(batches):
    """Batches sorted by (label, cell, tile); a group that a batch breaks off is carried on to the next."""
    held = None
    for b in batches:
        b = pa.Table.from_batches([b])
        b = pa.concat_tables([held, b]) if held is not None and len(held) else b
        key = np.stack([b.column(c).to_numpy() for c in ("label", "cell", "tile")])
        edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        held = b.slice(int(edge[-1])).combine_chunks()
        yield from _groups(b.slice(0, int(edge[-1])))
    if held is not None:
        yield from _groups(held)


def _groups(t):
    if not len(t):
        return
    t = t.combine_chunks()
    for at, raw in _lists(t.column("embedding").combine_chunks(), np.float64):
        own = t.take(pa.array(at))
        key = np.stack([own.column(c).to_numpy() for c in ("label", "cell", "tile")])
        ids, many, side, within = (own.column(c).to_numpy() for c in ("id", "many", "side", "within"))
        cell = key[1].view(np.uint64)
        y = own.column("turned").combine_chunks().flatten().to_numpy().reshape(len(at), -1)
        x = _unit(raw)
        edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True])
        size = np.diff(edge)
        group = np.repeat(np.arange(len(size)), size)
        small = (size <= SMALL)[group]
        for k in range(1, min(SMALL, len(group))):
            a = np.flatnonzero(small[: len(group) - k] & (group[: len(group) - k] == group[k:]))
            a = a[(side[a] != side[a + k]) | within[a]] if len(a) else a
            if len(a):
                a = a[_counted(cell[a], x[a], x[a + k], y[a], y[a + k])]
                b = a + k
                yield _links(np.r_[ids[a], ids[b], np.maximum(ids[a], ids[b])], np.r_[ids[a], ids[b], np.minimum(ids[a], ids[b])], np.r_[many[b], many[a], np.zeros(len(a), np.int64)])
        for s in np.flatnonzero(size > SMALL).tolist():
            span = slice(edge[s], edge[s + 1])
            order = np.argsort(ids[span])
            yield from _tile({"id": ids[span][order], "many": many[span][order], "side": side[span][order], "within": bool(within[edge[s]]), "cell": cell[edge[s]], "x": x[span][order], "y": y[span][order]})


def near_duplicates(vectors, vec_id="vec_id", embedding="embedding", label="label"):
    """Per row vec_id, n_links (other rows linked directly), component_id and kept.

    Only vectors of one label and one length are compared. A vector that is null, empty or zero, or holds a null or a
    value that is not finite, and one without a label, links with nothing. Rows with an equal vector and label are linked,
    whatever their ids; rows that repeat an id count as rows, each with the links of its own vector. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("embedding"))
    sound = (
        "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))"
    )
    valid = rows.where(sound)
    key = F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0).cast("float")).cast("string"))))
    same = saved(valid.select("vec_id", "label", key.alias("same")), "same")
    # one number per distinct vector of a label: an id may stand for several vectors
    groups = same.groupBy("label", "same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("many"))
    groups = saved(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    first = valid.withColumn("same", key).join(groups, ["label", "same", "vec_id"]).dropDuplicates(["id"])
    turned = saved(
        first.select("id", "label", "many", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
            _rotate, "id long, label long, many long, embedding array<double>, turned array<double>"), "turned"
    )
    cells = saved(turned.select("id", "label", "turned").mapInArrow(_enter, "id long, label long, cell long, part binary"), "cells")
    counts = cells.groupBy("label", "cell").agg(F.count("*").alias("n")).where("n > 1")
    several = cells.join(counts, ["label", "cell"])
    near = several.where(F.col("n") <= CELL).select("id", "label", "cell", "part").repartition("label", "cell").sortWithinPartitions("label", "cell")
    near = near.mapInArrow(_within, "id long, label long, cell long").unionByName(several.where(F.col("n") > CELL).select("id", "label", "cell"))
    near = saved(near, "near")
    shared = near.groupBy("label", "cell").agg(F.count("*").alias("n")).where("n > 1").select("label", "cell", F.ceil(F.col("n") / TILE).alias("parts"))
    entered = near.join(shared, ["label", "cell"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")))
    tiles = entered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "id", "label", "cell", "side", (F.least("side", "other") * F.col("parts") + F.greatest("side", "other")).alias("tile"), F.expr("side = other").alias("within")
    )
    members = tiles.join(turned, ["id", "label"]).select("label", "cell", "tile", "id", "side", "within", "many", "embedding", "turned")
    found = saved(
        members.repartition("label", "cell", "tile").sortWithinPartitions("label", "cell", "tile").mapInArrow(_compare, "a long, b long, links long"), "links"
    )
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = saved(components(found.where("a <> b").select("a", "b")), "joined")
    least = joined.join(groups.select("id", "vec_id"), "id").groupBy("component_id").agg(F.min("vec_id").alias("least"))
    joined = joined.join(least, "component_id").select("id", "least")
    own = groups.join(links, "id", "left").join(joined, "id", "left").select(
        "label", "same", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")
    )
    found = same.join(own, ["label", "same"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(F.expr(sound), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
