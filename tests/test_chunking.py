import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragspark.operators import chunking


def expected(text, size, overlap):
    """Brute-force windows of one page."""
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            cut = max(text.rfind(c, start, end) for c in " \n") - start
            if cut > size / 2:
                end = start + cut
        else:
            end = len(text)
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = end - overlap
    return out


def chunks(spark, texts, size=1500, overlap=200):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = chunking.chunk_text(df, size, overlap).orderBy("i", "chunk_seq").collect()
    out = [[] for _ in texts]
    for r in rows:
        out[r["i"]].append(r["text"])
    return out


def test_edges(spark):
    texts = [
        "a" * 1500, "a" * 1501, "b" * 750 + " " + "c" * 2000, "b" * 751 + " " + "c" * 2000,
        " " * 4000 + "x", "x" + " " * 3000 + "y", "", " \n ", "é\U0001f600 " * 900,
    ]
    assert chunks(spark, texts) == [expected(t, 1500, 200) for t in texts]


def test_pages_longer_than_a_block(spark):
    rng = random.Random(5)
    long = ["".join(rng.choice("abcdefgh \n\U0001f600é") for _ in range(n)) for n in (8191, 8192, 8193, 30_000, 100_000)]
    assert chunks(spark, long) == [expected(t, 1500, 200) for t in long]
    assert chunks(spark, long, 9000, 100) == [expected(t, 9000, 100) for t in long]


def test_overlap_must_leave_progress():
    with pytest.raises(ValueError):
        chunking.chunks_of(F.col("t"), 100, 60)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t", max_size=400), min_size=1, max_size=20))
def test_random_small_windows(spark, texts):
    assert chunks(spark, texts, 20, 5) == [expected(t, 20, 5) for t in texts]


def pages(spark, markdown):
    df = spark.createDataFrame([(markdown,)], "markdown string")
    return [(r["page"], r["text"]) for r in chunking.split_pages(df).orderBy("page_seq").collect()]


def test_pages(spark):
    assert pages(spark, "a\n--- Page 3 ---\nb\n--- Page 4 ---\n \n--- Page 5 ---\nc") == [(1, "a"), (3, "b"), (5, "c")]
    assert pages(spark, "x\n--- Slide 2 ---\ny") == [(1, "x\n--- Slide 2 ---\ny")]
    assert pages(spark, " \n ") == []
    assert pages(spark, "\n--- Page 1 ---\n\n--- Page 2 ---\nz") == [(2, "z")]


def test_ids_and_format(spark):
    df = spark.createDataFrame([("f.pdf", 2, "héllo", "k1, k2"), ("f.pdf", 2, "héllo", "")], "source string, page int, text string, k string")
    a, b = chunking.identify_chunks(df, "k").collect()
    assert a["id"] == b["id"] == "f.pdf_2_" + hashlib.md5("héllo".encode()).hexdigest()[:12]
    assert a["content"] == "[문서: f.pdf | 페이지: 2]\n[키워드: k1, k2]\n\nhéllo"
    assert b["content"] == "[문서: f.pdf | 페이지: 2]\n\nhéllo"


def test_no_shuffle_and_no_python(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "markdown string")
    done = chunking.chunk_text(chunking.split_pages(df))
    text = done._jdf.queryExecution().toString()
    assert "Exchange" not in text and "Python" not in text
