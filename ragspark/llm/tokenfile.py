"""Token ids as files of bit-plane or byte-plane chunks.

A file set is a table of chunks, written by Spark without further compression: documents are dealt out by ranges of
their id (shards) and sorted in each; a shard's ids are cut into blocks of ``CHUNK_IDS``. A block is transposed into the
planes of its 32-bit ids, so that the like parts of neighbouring ids lie together, and every plane is compressed with
zstandard by itself; planes without a set bit are empty. The chunk index stands beside the planes: the shard, the
chunk's number, its first id's place in the shard, and the documents that lie in it (id, running number in the shard,
ids in this chunk, whether they begin and end here). So every chunk is read by itself.
"""

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark.llm import tokens
from ragspark.llm.shared import saved, tasks_for
from ragspark.session import shared_folder

CHUNK_IDS = 1 << 16
END = 2
LEVEL = 3
SHARD_BYTES = 64 << 20

CHUNKS = (
    "shard int, chunk int, first_id long, n_ids int, width int, planes array<binary>,"
    " doc_id array<long>, ordinal array<long>, part array<int>, opens array<boolean>, closes array<boolean>"
)
_CHUNK = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32())]
    + [("planes", pa.list_(pa.binary())), ("doc_id", pa.list_(pa.int64())), ("ordinal", pa.list_(pa.int64()))]
    + [("part", pa.list_(pa.int32())), ("opens", pa.list_(pa.bool_())), ("closes", pa.list_(pa.bool_()))]
)


def to_planes(ids, width):
    """The planes of a block, lowest first: ``width`` 1 for 32 bit planes, 8 for four byte planes."""
    raw = np.ascontiguousarray(ids, "<u4")
    columns = raw.view(np.uint8).reshape(-1, 4)
    if width == 8:
        planes = [np.ascontiguousarray(columns[:, k]) for k in range(4)]
    else:
        bits = np.unpackbits(columns, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k]) for k in range(32)]
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes, n, width):
    unpack = zstandard.ZstdDecompressor().decompress
    if width == 8:
        columns = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                columns[:, k] = np.frombuffer(unpack(p), np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(unpack(p), np.uint8), count=n)
        columns = np.packbits(bits, axis=1, bitorder="little")
    return columns.reshape(-1).view("<u4")


def write(docs, folder, path, width=8, doc_id="doc_id", text="text"):
    """Encode every whole text (null: empty) and write the chunks to ``folder``.

    Rows with one id stay rows of their own, in the order of their texts' hashes. Rows without an id come first. Other
    columns are not read; an empty table gives an empty file set.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(tasks_for(docs.sparkSession, size, SHARD_BYTES), "doc_id")
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def run(batches):
        held, docs_of, state = [], [], {"n": 0, "first": 0, "chunk": 0, "ordinal": 0, "shard": 0}

        def flush(size):
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            block, rest = ids[:size], ids[size:]
            parts, left = [], size
            while docs_of and left:
                d = docs_of[0]
                take = min(left, d[2])
                parts.append((d[0], d[1], take, d[3], take == d[2]))
                left -= take
                if take == d[2]:
                    docs_of.pop(0)
                else:
                    docs_of[0] = (d[0], d[1], d[2] - take, False)
            held[:] = [rest] if len(rest) else []
            line = {"shard": state["shard"], "chunk": state["chunk"], "first_id": state["first"], "n_ids": size, "width": width, "planes": to_planes(block, width)}
            line |= dict(zip(("doc_id", "ordinal", "part", "opens", "closes"), map(list, zip(*parts))))
            state["chunk"] += 1
            state["first"] += size
            state["n"] -= size
            return pa.RecordBatch.from_pylist([line], schema=_CHUNK)

        for b in batches:
            if len(b):
                state["shard"] = b.column(0)[0].as_py()
            names = b.column(1).to_pylist()
            for first, ids, row in tokens.encoded(b.column(2), path, END):
                held.append(ids)
                state["n"] += len(ids)
                for r, n in enumerate(np.diff(row).tolist()):
                    docs_of.append((names[first + r], state["ordinal"], n, True))
                    state["ordinal"] += 1
                while state["n"] >= CHUNK_IDS:
                    yield flush(CHUNK_IDS)
        if state["n"]:
            yield flush(state["n"])

    ordered.mapInArrow(run, CHUNKS).write.option("compression", "uncompressed").parquet(folder)
    return folder


def chunks(spark, folder):
    return spark.read.schema(CHUNKS).parquet(folder)


def ids(spark, folder):
    """(shard, ordinal, at, doc_id, opens, closes, ids) of every part of a document that lies in one chunk."""
    schema = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for line in b.to_pylist():
                raw = from_planes(line["planes"], line["n_ids"], line["width"]).tobytes()
                n = np.array(line["part"], np.int64)
                end = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([line["shard"]] * len(n), pa.int32()), pa.array(line["ordinal"], pa.int64()), pa.array(line["first_id"] + end - n), pa.array(line["doc_id"], pa.int64()),
                     pa.array(line["opens"]), pa.array(line["closes"]), pa.array([raw[4 * a : 4 * z] for a, z in zip((end - n).tolist(), end.tolist())], pa.binary())], schema=schema
                )

    return chunks(spark, folder).mapInArrow(run, "shard int, ordinal long, at long, doc_id long, opens boolean, closes boolean, ids binary")


def _times(matrix, vector):
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def crc_after(crc, n):
    """What a crc32 becomes, to be XORed with the crc32 of the n bytes that follow."""
    matrix = [0xEDB88320, *(1 << k for k in range(31))]
    n *= 8
    while n:
        if n & 1:
            crc = _times(matrix, crc)
        matrix = [_times(matrix, row) for row in matrix]
        n >>= 1
    return crc


def summary(spark, folder):
    """Per document of a file set, from its files: doc_id, start, n_tokens, ids_crc32."""
    parts = saved(ids(spark, folder).select("shard", "ordinal", "at", "doc_id", "opens", "closes", (F.octet_length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc")), "parts")
    before = chunks(spark, folder).groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before")
    )
    whole = parts.where("opens and closes").select("shard", "doc_id", F.col("at").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = parts.where("not (opens and closes)").groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts")
    )

    def joined(batches):
        for b in batches:
            out = []
            for own in b.column("parts").to_pylist():
                crc = 0
                for p in own:
                    crc = crc_after(crc, 4 * p["n"]) ^ p["crc"]
                out.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("shard", "doc_id", "start", "n_tokens")] + [pa.array(out, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    cut = cut.mapInArrow(joined, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return whole.unionByName(cut).join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs, path, width=8):
    """Write all documents and return what the files say of them."""
    spark = docs.sparkSession
    return summary(spark, write(docs, shared_folder(spark, "token-ids"), path, width))
