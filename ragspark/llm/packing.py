"""Vector best-fit packing of token sequences.

Every piece of a document has three sizes: its tokens, one document, and its attention cost (tokens squared); a sequence
has a capacity for each. As the sizes follow from the number of tokens alone, pieces of one length are alike, and the
whole corpus is described by how many pieces have each length. Best-fit decreasing runs over these at most
``CAPACITY`` classes: open sequences of the same content are one state with a count, a class goes to the state that
fits best under every constraint, and a step moves as many pieces as fit at once. The plan says for the i-th piece of a
length in which sequence and at which offset it lies; pieces are numbered within their length by Spark.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark.llm import tokens
from ragspark.llm.shared import saved

CAPACITY = 1024
END = 2
#: Pieces of one length are numbered in parts of about so many.
PART = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs, path, capacity=CAPACITY, doc_id="doc_id", text="text"):
    """Every document's pieces. Only documents above the capacity are cut, the first piece takes what is left over.

    Null and empty texts have the end id alone; repeated rows are pieces of their own; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for first, flat, rows in tokens.encoded(b.column(1), path, END):
                n = np.diff(rows)
                k = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                rest = n - capacity * (k - 1)
                start = np.where(piece == 0, 0, rest[row] + capacity * (piece - 1))
                length = np.where(piece == 0, rest[row], capacity)
                raw = memoryview(flat.astype("<u4").tobytes())
                at = 4 * (rows[row] + start)
                crc = [zlib.crc32(raw[a : a + z]) for a, z in zip(at.tolist(), (4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=schema
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def plan(counts, capacity=CAPACITY, max_docs=None, max_attention=None, rule="norm", weights=(1.0, 0.01, 0.1)):
    """Sequences for ``counts`` (length to number of pieces) as a list of (lengths in order, how many sequences).

    ``rule`` picks among the states that have room: "norm" the one with the smallest weighted norm of what would be left,
    "dot" the one whose room has the largest weighted dot product with the piece. All sizes are shares of the capacity.
    """
    full = np.array([capacity, max_docs or capacity, max_attention or capacity**2], float)
    weight, room, number, parts = np.asarray(weights), np.zeros((0, 3)), np.zeros(0, np.int64), []
    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        size, left = np.array([length, 1, length**2], float), int(counts[length])
        if (size > full).any():
            raise ValueError(f"a piece of {length} tokens fits into no sequence")
        while left:
            fits = np.flatnonzero((room >= size).all(1) & (number > 0))
            if len(fits):
                after = (room[fits] - size) / full
                score = -(weight * after**2).sum(1) if rule == "norm" else (weight * size / full * room[fits] / full).sum(1)
                i = fits[np.argmax(score)]
                base, have = room[i], int(number[i])
                content = parts[i]
            else:
                i, base, have, content = None, full, left, ()
            times = min(int((base // size).min()), left)
            used = min(have, left // times)
            if i is not None:
                number[i] -= used
            room = np.vstack([room, base - times * size])
            number = np.append(number, used)
            parts.append((*content, *[length] * times))
            left -= used * times
            open_ = (number > 0) | (np.arange(len(number)) >= len(number))
            if not open_.all() and len(number) > 4096:
                keep = np.flatnonzero(open_)
                room, number, parts = room[keep], number[keep], [parts[j] for j in keep]
    return [(p, int(n)) for p, n in zip(parts, number) if n]


def placed(counts, **limits):
    """Arrays (length, first index, first sequence, offset), sorted by length and index, of a plan."""
    rows, taken, sequence = [], {}, 0
    for lengths, n in plan(counts, **limits):
        offset = 0
        for x in lengths:
            rows.append((x, taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + n
            offset += x
        sequence += n
    return [np.array(c, np.int64) for c in zip(*sorted(rows))] if rows else [np.zeros(0, np.int64)] * 4


def pack(docs, path, capacity=CAPACITY, **limits):
    """Pieces of all documents with sequence_id and offset; sequences are filled from 0 without gaps."""
    stored = saved(pieces(docs, path, capacity), "pieces")
    classes = saved(stored.groupBy("length").agg(F.count("*").alias("n")), "classes")
    in_class = dict(classes.collect())
    parts = F.broadcast(classes.select("length", F.ceil(F.col("n") / PART).alias("parts")))
    stored = stored.join(parts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("parts")))
    counts = saved(stored.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    length, first, sequence, offset = placed(in_class, capacity=capacity, **limits)
    code = (length << 40) + first
    before = counts.select(
        "length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")
    )
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = stored.withColumn("own", own).join(F.broadcast(before), ["length", "salt"])

    def run(batches):
        for b in batches:
            n, k = b.column("length").to_numpy(), b.column("index").to_numpy()
            i = np.searchsorted(code, (n << 40) + k, "right") - 1
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[i] + k - first[i]), pa.array(offset[i])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("index"))
    return rows.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
