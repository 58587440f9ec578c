"""Parent chunks and file housekeeping."""

from pyspark.sql import functions as F

from ragspark.functions import text as X
from ragspark.operators import skew


def valid_parents(rows):
    """Rows with an id and content; the others are not stored."""
    return rows.where(~X.is_null_or_empty(F.col("parent_id")) & ~X.is_null_or_empty(F.col("content")))


def save_parents(stored, new):
    """(table after the save, rows accepted). The last write of an id wins; accepted rows count repeats."""
    from ragspark.sources.store import upsert

    accepted = valid_parents(new)
    return upsert(stored, accepted, ("invoke_id", "parent_id")), accepted


def load_parents(requests, parents):
    """Parents of each request's id list in the requested order; missing ids are skipped, repeats stay."""
    wanted = requests.select("request_id", "invoke_id", F.posexplode("ids").alias("pos", "parent_id"))
    keys = ["invoke_id", "parent_id"]
    hot = skew.hot_keys(skew.count_keys(wanted, keys), keys, "_n")
    needed = parents.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return skew.salted_join(wanted, needed, keys, hot, spread=["request_id", "pos"])


def orphan_files(files, live, key="token"):
    """Files whose token is no longer live."""
    return files.join(live.select(key).distinct(), key, "left_anti")
