"""Exact comparisons with the tokenizer libraries, and round trips."""

import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ragspark.llm import packing, sentences, tokenfile, tokens
from ragspark.session import shared_folder

WORD, BYTE, PIECE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def ids_of(path, texts, end=()):
    t = Tokenizer.from_file(path)
    return [np.array([*e.ids, *end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("width", [8, 1])
@pytest.mark.parametrize("frame", ["docs", "odd"])
def test_files_give_back_every_id(request, spark, monkeypatch, width, frame):
    monkeypatch.setattr(tokenfile, "CHUNK_IDS", 5000)
    rows = request.getfixturevalue(frame)
    rows = rows if frame == "docs" else rows.where("doc_id is not null and doc_id <> 9")
    folder = tokenfile.write(rows, shared_folder(spark, "ids"), WORD, width)
    got = sorted(map(tuple, tokenfile.summary(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    own = sorted((r.doc_id, r.text) for r in rows.collect()) if frame == "docs" else sorted(((r.doc_id, r.text) for r in rows.collect()), key=lambda r: r[0])
    ids = ids_of(WORD, [t for _, t in own], (2,))
    starts = [0, *accumulate(map(len, ids))]
    assert got == [(d, s, len(i), crc(i)) for (d, _), s, i in zip(own, starts, ids)]
    assert tokenfile.chunks(spark, folder).where("n_ids > 5000").isEmpty()


def test_repeated_rows_and_empty_tables_in_files(spark, odd, none):
    out = tokenfile.round_trip(odd, WORD)
    assert out.count() == odd.count() and out.where("doc_id = 9").count() == 2
    assert tokenfile.round_trip(none, WORD).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 7, 4097])
@pytest.mark.parametrize("width", [8, 1])
def test_planes(n, width):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (tokenfile.from_planes(tokenfile.to_planes(ids, width), n, width) == ids).all()


def test_crcs_are_joined():
    a, b = b"some bytes", b"and others, more of them"
    assert tokenfile.crc_after(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("frame", ["docs", "odd"])
def test_packing_is_whole_and_within_capacity(request, frame):
    rows = request.getfixturevalue(frame)
    got = packing.pack(rows, BYTE).toPandas()
    own = [(r.doc_id, r.text) for r in rows.collect()]
    ids = ids_of(BYTE, [t for _, t in own], (2,))
    want = sorted(
        (-1 if d is None else d, p, s, n, crc(i[s : s + n]))
        for (d, _), i in zip(own, ids)
        for p, (s, n) in enumerate(cuts(len(i)))
    )
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *accumulate(s.length)][:-1] and s.length.sum() <= 1024
    total = sum(map(len, ids))
    assert got.sequence_id.nunique() <= -(-total // 1024) * 1.02 + 3


def cuts(n, size=1024):
    first = n - size * (-(-n // size) - 1)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plans_keep_every_constraint(rule):
    rng = np.random.default_rng(3)
    counts = {int(x): int(c) for x, c in zip(rng.integers(1, 770, 60), rng.integers(1, 90, 60))}
    plan = packing.plan(counts, max_docs=3, max_attention=600_000, rule=rule)
    back = {}
    for lengths, n in plan:
        assert sum(lengths) <= 1024 and len(lengths) <= 3 and sum(x * x for x in lengths) <= 600_000
        for x in lengths:
            back[x] = back.get(x, 0) + n
    assert back == counts


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_added_tokens_are_the_librarys(path):
    texts = [
        "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|startoftext|>", "x\n<|endoftext|>\n\ny", "<|endof", "text|> <|endoftext", "|>",
        "don<|endoftext|>'t", "É<|startoftext|>É  <|endoftext|>  ", "<<|endoftext|>>", "<|endoftext|endoftext|>", "", None,
    ]
    column = pa.array(texts)
    got = [ids[a:z].tolist() for _, ids, rows in tokens.encoded(column, path, 2) for a, z in zip(rows[:-1], rows[1:])]
    assert got == [i.tolist() for i in ids_of(path, texts, (2,))]


@pytest.mark.parametrize("limits, most", [({}, (1024, 1024, 1024**2)), ({"max_docs": 3}, (1024, 3, 1024**2)), ({"max_attention": 30_000}, (1024, 1024, 30_000))])
def test_each_capacity_binds(limits, most):
    plan = packing.plan({100: 4000, 90: 500, 7: 300}, **limits)
    full = np.array([[sum(x), len(x), sum(y * y for y in x)] for x, _ in plan])
    own = [i for i, k in enumerate(("capacity", "max_docs", "max_attention")) if k in limits] or [0]
    assert (full <= most).all() and all((full[:, i] > 0.8 * most[i]).any() for i in own)
    free = np.array([[sum(x), len(x), sum(y * y for y in x)] for x, _ in packing.plan({100: 4000, 90: 500, 7: 300})])
    assert all((free[:, i] > most[i]).any() for i in own if i)


def test_hot_lengths_are_numbered_in_parts(docs, monkeypatch):
    monkeypatch.setattr(packing, "PART", 5)
    got = packing.pack(docs, BYTE).toPandas()
    assert len(got) == packing.pieces(docs, BYTE).count()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *accumulate(s.length)][:-1] and s.length.sum() <= 1024


def test_packing_of_nothing(none):
    assert packing.pack(none, BYTE).isEmpty()


@pytest.mark.parametrize("frame", ["docs", "odd"])
def test_sentencepiece_paths_are_the_librarys(request, frame):
    rows = request.getfixturevalue(frame).where("doc_id is not null").dropDuplicates(["doc_id"])
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    encoded = sentences.encode(rows, PIECE)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {d: library.encode(t) for d, t in texts.items()}
    back = {r.doc_id: r.text for r in sentences.decode(encoded, PIECE).collect()}
    assert back == {d: library.decode(library.encode(t)) for d, t in texts.items()}
    same = sentences.round_trip(rows, PIECE).collect()
    assert all(r.same and r.n_tokens == len(got[r.doc_id]) and r.ids_crc32 == crc(got[r.doc_id]) for r in same)


def test_sentencepiece_of_nothing(none):
    assert sentences.round_trip(none, PIECE).isEmpty()
