"""Token vectors of a text as one binary value: their dimension (int32) and their numbers (float32), little-endian."""

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T


def pack(vectors):
    """The value for the vectors of one text, a sequence of equally long sequences."""
    rows = np.asarray(vectors, "<f4")
    dim = rows.shape[1] if rows.ndim == 2 else 0
    return np.int32(dim).astype("<i4").tobytes() + rows.tobytes()


def matrices(column):
    """All tokens of a column stacked (float32) and the row each text starts at; nulls have no tokens."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] // 4
    words = np.frombuffer(column.buffers()[2], "<f4") if ends[-1] > ends[0] else np.zeros(0, np.float32)
    heads = ends[:-1][np.diff(ends) > 0]
    full = ends[:-1][np.diff(ends) > 1]
    dim = int(words[full[:1]].view("<i4")[0]) if len(full) else 1
    if len(full) and (words[full].view("<i4") != dim).any():
        raise ValueError("vectors of different dimensions in one column")
    kept = np.ones(len(words), bool)
    kept[heads] = False
    sizes = np.maximum(np.diff(ends) - 1, 0) // dim
    return words[ends[0] : ends[-1]][kept[ends[0] : ends[-1]]].reshape(-1, dim), np.concatenate(([0], np.cumsum(sizes)))


def summed(df, vectors="vectors"):
    """``vectors`` replaced by the number of tokens and the sum of all numbers, to 4 places."""
    names = [c for c in df.columns if c != vectors]
    fields = [T.StructField("n_tokens", T.IntegerType()), T.StructField("total", T.DoubleType())]

    def run(batches):
        for b in batches:
            flat, starts = matrices(b.column(vectors))
            total = np.round([flat[a:z].astype(np.float64).sum() for a, z in zip(starts, starts[1:])], 4)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.diff(starts), pa.int32()), pa.array(total, pa.float64())], names=[*names, "n_tokens", "total"])

    return df.select(*names, vectors).mapInArrow(run, T.StructType([*df.select(*names).schema.fields, *fields]))
