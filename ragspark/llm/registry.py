"""The registered queries of this package: one thin query per operator, and the pipeline."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from ragspark.llm import audit, embeddings, html, jaccard, lm, mixing, packing, perplexity, repair, rules, sentences, tokenfile, toxicity
from ragspark.llm.shared import crc_mod, table


def op1_sentencepiece(spark, folder):
    return sentences.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    return perplexity.quality(docs, perplexity.classifier(docs, table(spark, folder, "labels")))


def op3_html_extraction(spark, folder):
    pages = table(spark, folder, "pages")
    return html.extract(pages, html.train(pages, table(spark, folder, "documents")))


def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), toxicity.training_rows())
    n, held = toxicity.HELD_OUT
    return toxicity.toxicity(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), n) == held).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


def op7_quality_rules(spark, folder):
    return rules.judged(table(spark, folder, "documents"))


def op8_embedding_near_dedup(spark, folder):
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op10_lm_scoring(spark, folder):
    return lm.score(table(spark, folder, "documents"), lm.held_out())


def op9_jaccard_join(spark, folder):
    return jaccard.jaccard_groups(table(spark, folder, "documents"))


def op5_token_file(spark, folder):
    return tokenfile.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_source_mixing(spark, folder):
    return mixing.mixed(table(spark, folder, "documents"))


def op12_conversation_repair(spark, folder):
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


def op13_source_divergence(spark, folder):
    return audit.divergence(table(spark, folder, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_token_file": op5_token_file,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_source_mixing": op11_source_mixing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}

#: The others have no SQL; tests/llm compares them with brute force, round trips and held-out labels.
ORACLE = {"op11_source_mixing": mixing.SQL, "op12_conversation_repair": repair.SQL, "op13_source_divergence": audit.SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
