"""One batch-inference operator; every model call is a function from a list of inputs to a list of outputs."""

import logging
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ragspark import settings as S
from ragspark.operators import packed
from ragspark.operators.keywords import terms_of
from ragspark.session import small_batches

D = S.DEFAULTS
#: Calls whose outputs a task holds before it hands them on.
CALLS_HELD = 4


def pieces(batches, rows):
    """Record batches cut to at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def infer(df, in_col, out_col, factory, out_type="string", batch_size=D.encode_batch_document, on_error="empty",
          empty=None):
    """Add ``out_col``: ``factory()`` is called once per task and gives the batch function.

    With ``on_error="empty"`` a failing batch yields ``empty`` for its rows, otherwise the error is raised. A
    batch function that returns too few values is padded with ``empty``. Outputs leave a task after every
    ``CALLS_HELD`` calls, whatever the number of rows that Spark hands over at once.
    """
    if isinstance(out_type, str):
        out_type = T._parse_datatype_string(out_type)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, out_type)])
    kind = to_arrow_type(out_type)
    small_batches(df.sparkSession)

    def run(frames):
        call = factory()
        for frame in pieces(frames, batch_size * CALLS_HELD):
            inputs, outputs = frame.column(in_col).to_pylist(), []
            for at in range(0, len(inputs), batch_size):
                batch = inputs[at : at + batch_size]
                try:
                    got = list(call(batch))
                except Exception:
                    if on_error != "empty":
                        raise
                    logging.getLogger(__name__).warning("a call for %d rows failed; %s is left empty", len(batch), out_col, exc_info=True)
                    got = []
                outputs += (got + [empty] * len(batch))[: len(batch)]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(outputs, kind)], names=[*frame.schema.names, out_col])

    return df.mapInArrow(run, schema)


def echo(chars=80):
    """Stand-in model: the opening of each prompt."""

    def factory():
        return lambda prompts: [p[:chars].strip() for p in prompts]

    return factory


def digest():
    """Stand-in model whose answer depends on all of its prompt: the prompt's MD5."""

    def factory():
        return lambda prompts: [md5(p.encode()).hexdigest() for p in prompts]

    return factory


def complete(df, payload, out_col="answer", factory=None):
    """Model text per payload, stripped; a failing call gives empty text."""
    return infer(df, payload, out_col, factory or echo(), "string", D.encode_batch_query, "empty", "")


def term_vector(term, dim=16):
    """The unit vector made of a term's MD5."""
    raw = np.frombuffer(md5(term.encode()).digest(), np.uint8)[:dim].astype(np.float64) - 127.5
    return (raw / np.sqrt((raw * raw).sum())).astype(np.float32)


def hashed(dim=16):
    """Stand-in encoder: a text is given as its terms, each of which has a unit vector."""

    def factory():
        known = {}

        def call(texts):
            if len(known) > 200_000:
                known.clear()
            for term in {t for terms in texts for t in terms or ()}.difference(known):
                known[term] = term_vector(term, dim)
            return [[known[t] for t in terms or ()] for terms in texts]

        return call

    return factory


def _hashed_packed(df, terms, out_col, batch_size, dim=16):
    """The hashed encoder's vectors as packed values: each distinct term of some rows is turned once, then taken by number."""
    small_batches(df.sparkSession)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != terms), T.StructField(out_col, T.BinaryType())])
    names = schema.names[:-1]

    def run(batches):
        known, head = {}, np.int32(dim).astype("<i4").tobytes()
        for b in pieces(batches, batch_size * CALLS_HELD):
            if len(known) > 100_000:
                known.clear()
            column = b.column(terms)
            coded = column.flatten().dictionary_encode()
            own = coded.dictionary.to_pylist()
            for term in own:
                if term not in known:
                    known[term] = term_vector(term, dim)
            vectors = np.array([known[t] for t in own], "<f4").reshape(-1, dim)
            flat = vectors[coded.indices.to_numpy()]
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            made = [head + flat[a:z].tobytes() if z > a else packed.pack([]) for a, z in zip(np.append(0, ends[:-1]), ends)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(made, pa.binary())], names=[*names, out_col])

    return df.mapInArrow(run, schema)


def _packed(factory):
    def made():
        call = factory()
        return lambda texts: [packed.pack(v) for v in call(texts)]

    return made


def encode(df, text="content", out_col="vectors", is_query=False, factory=None, as_packed=False):
    """Ragged token vectors per text; without a model the hashed ones. A failing model call is raised.

    ``as_packed`` gives them as one binary value per text (see ``packed``) instead of nested arrays.
    """
    size = D.encode_batch_query if is_query else D.encode_batch_document
    kind, empty = ("binary", packed.pack([])) if as_packed else ("array<array<float>>", [])
    if factory is None and as_packed:
        return _hashed_packed(df.withColumn("_terms", terms_of(F.col(text))), "_terms", out_col, size)
    own = factory or hashed()
    source = df.withColumn("_terms", terms_of(F.col(text))) if factory is None else df
    made = infer(source, text if factory else "_terms", out_col, _packed(own) if as_packed else own, kind, size, "raise", empty)
    return made.drop("_terms")


def extract_keywords(df, text="text", out_col="keywords", factory=None, chars=D.keyword_chars):
    """Keyword line per text from a model; see ``keywords.tfidf_keywords`` for the model-free form."""
    cut = df.withColumn("_cut", F.substring(text, 1, chars))
    return infer(cut, "_cut", out_col, factory, "string", D.encode_batch_document, "empty", "").drop("_cut")


def extract_graph(df, text="content", out_col="json", factory=None, chars=D.graph_chars, batch=D.graph_batch):
    """Extraction JSON per text from a model, to be read by ``graph.parse_graph``."""
    cut = df.withColumn("_cut", F.substring(text, 1, chars))
    return infer(cut, "_cut", out_col, factory, "string", batch, "empty", "").drop("_cut")


def transcribe(files, factory=None, content="content", out_col="response"):
    """Recognition response per audio file; the stand-in reads text files as they are."""

    def as_text():
        return lambda blobs: [bytes(b).decode("utf-8", "replace") for b in blobs]

    return infer(files, content, out_col, factory or as_text, "string", 1, "raise")
