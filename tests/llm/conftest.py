import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [
        (1, None, None, None, 1), (2, "", "en", "a", 2), (3, " \n\t ", "en", None, 3), (4, "one two", None, "a", 4), (5, "One  TWO", "en", "a", 5),
        (6, long, "en", "a", 6), (7, long, "en", "a", 7), (8, long + " more", "fr", "b", 8), (9, "a b c d e f g h", "en", "a", 9),
        (9, "a b c d e f g h", "en", "a", 9), (10, "don't 'quote' é÷x ▁ 日本 　 <|endoftext|> #*$ x|y", "zz", "a", 10), (None, "no id here", "en", "a", 11),
        (11, "x\ny\nx\n\nx y z x y z", "en", "b", 12), (12, "A\x1cB\x85C\xa0D\x0bE\x0cF", "en", "b", 13),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "id", "h", "score", "length", "component_id", "kept", "shard"):
        frame = frame.withColumn(name, F.lit(7))
    return frame.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
