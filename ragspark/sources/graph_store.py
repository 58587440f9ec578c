"""The stored graph of rooms, kept as first and last sightings that batches of facts are merged into.

A batch writes one row per entity and per edge that it names: the first and the last sighting, with what each of them decides.
Both are aggregates that merge, so reading the table merges the batches, compacting it writes the merged rows, and a
batch that is written again replaces its own folder. Sightings are ordered by (batch, chunk, kind, place): a later batch is later.

Edges are kept before their ends are looked up. Which of them exist is decided when the graph is read, by the rule that
both ends were stored before the edge was last seen; so an end that comes in a later batch does not revive an edge that
was seen before it, and one that comes again does.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ragspark.operators import graph
from ragspark.session import saved
from ragspark.sources import store

ENTITY_KEY, EDGE_KEY = ("invoke_id", "name"), ("invoke_id", "src", "type", "dst")
ENTITY = "invoke_id string, name string, type string, description string, source string, first_seq {seq}, last_seq {seq}"
EDGE = "invoke_id string, src string, type string, dst string, description string, source string, last_seq {seq}"
SEQ = "struct<batch:long,chunk:long,kind:int,pos:int>"


def _seq(batch):
    return F.struct(F.lit(int(batch)).cast("long").alias("batch"), F.col("seq.chunk"), F.col("seq.kind"), F.col("seq.pos"))


def _entity_sightings(found, batch):
    return (
        found.withColumn("seq", _seq(batch)).groupBy(*ENTITY_KEY)
        .agg(
            F.min_by(F.struct("type", "description"), "seq").alias("_first"), F.max_by("source", "seq").alias("source"),
            F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        )
        .select(*ENTITY_KEY, "_first.type", "_first.description", "source", "first_seq", "last_seq")
    )


def merge_entity_sightings(rows):
    """One row per (room, name): type and description of the first sighting, source of the last."""
    return (
        rows.groupBy(*ENTITY_KEY)
        .agg(
            F.min_by(F.struct("type", "description"), "first_seq").alias("_first"), F.max_by("source", "last_seq").alias("source"),
            F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        )
        .select(*ENTITY_KEY, "_first.type", "_first.description", "source", "first_seq", "last_seq")
    )


def merge_edge_sightings(rows):
    """One row per (room, src, type, dst): description and source of the last sighting."""
    return (
        rows.groupBy(*EDGE_KEY)
        .agg(F.max_by(F.struct("description", "source"), "last_seq").alias("_last"), F.max("last_seq").alias("last_seq"))
        .select(*EDGE_KEY, "_last.description", "_last.source", "last_seq")
    )


def _write(rows, path):
    dealt = rows.withColumn("bucket", store.bucket_of(F.col("invoke_id"))).hint("rebalance", "bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def append_facts(extracted, path, batch, graph_col="graph", order="chunk_no"):
    """Merge one batch of chunks with an extracted ``graph`` into the table; unusable relations go to ``rejected``.

    ``extracted`` is read once for each of entities and relations: rows of a model's answers should be stored.
    """
    found, relations = graph.explode_graph(extracted, graph_col, order)
    usable, rejected = graph.split_relations(relations)
    _write(_entity_sightings(found, batch), f"{path}/entity/batch={int(batch)}")
    edges = graph.merge_edges(usable.withColumn("seq", _seq(batch)))
    _write(edges, f"{path}/edge/batch={int(batch)}")
    _write(rejected.withColumn("seq", _seq(batch)), f"{path}/rejected/batch={int(batch)}")


def _read(spark, path, columns, only):
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], columns.format(seq=SEQ))
    if only is not None:
        rows = rows.where((F.col("bucket") == store.bucket_of(F.lit(only))) & (F.col("invoke_id") == only))
    return rows.drop("batch", "bucket")


def load_entities(spark, path, only=None):
    """Merged entities; ``only`` names one room and reads its bucket alone."""
    return merge_entity_sightings(_read(spark, f"{path}/entity", ENTITY, only))


def load_graph(spark, path, strict_order=True, only=None):
    """(entities, edges) as one build over all batches in their order gives them."""
    entities = load_entities(spark, path, only)
    edges = merge_edge_sightings(_read(spark, f"{path}/edge", EDGE, only))
    return entities, graph.resolve_edges(edges, entities, strict_order)


def compact_graph(spark, path, target):
    """The merged sightings of all batches as batch 0 of a new folder; the numbers of later batches go on from the old ones."""
    _write(load_entities(spark, path), f"{target}/entity/batch=0")
    _write(merge_edge_sightings(_read(spark, f"{path}/edge", EDGE, None)), f"{target}/edge/batch=0")


def stream_facts(extracted, path, checkpoint, trigger=None):
    """Start merging a stream of chunks with an extracted ``graph``; a micro-batch is one batch of the table."""

    def write(rows, batch):
        append_facts(saved(rows, "facts"), path, batch)

    writer = extracted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
