"""The training-data pipeline: toxicity, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return rows of ``documents``, with all
columns that came in; the last returns the packed pieces. A stage works on all rows that the one before kept.
"""

import public_tokenizers
from pyspark.sql import functions as F

from ragspark.llm import jaccard, packing, perplexity, toxicity
from ragspark.llm.shared import narrow_join, saved, small_batches, table

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score is below the cut."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.training_rows())
    return toxicity.accepted(docs, model)


def drop_low_quality(spark, docs, sf_dir):
    """Documents whose perplexity lies between the thresholds of their language; texts without words go."""
    return perplexity.accepted(docs, perplexity.classifier(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of linked documents the one with the smallest id; rows without an id stay."""
    small_batches(spark)
    groups = saved(jaccard.jaccard_groups(docs).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return narrow_join(docs, groups, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """All pieces of the documents that are left, each with its sequence and offset."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", F.col("text")), public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: The models, the sketches and the packing plan cannot be put into SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
