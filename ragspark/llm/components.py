"""Connected components by alternating large-star and small-star rounds, each a join on the smallest neighbour."""

from pyspark.sql import functions as F

from ragspark.llm.shared import saved


def _stars(pairs, keep):
    """Join every node's neighbours with the smallest of them (or itself)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").where(keep)


def components(edges):
    """(id, component_id) of every end of ``edges`` (columns a, b): the smallest id reachable. Self links are ignored.

    Large star: neighbours larger than a node move to its smallest neighbour. Small star: neighbours not larger than a
    node, and the node itself, move to the smallest. Edges stop changing when all hang on their component's smallest
    id; every round is written to the shared folder, which cuts the lineage.
    """
    now = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        up = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _stars(up, "v <= u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return leaves.unionByName(leaves.select(F.col("component_id").alias("id"), "component_id").distinct())


def _mark(pairs):
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
