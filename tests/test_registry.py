"""Registered queries against their SQL on the smallest tables; ``RAGSPARK_ALL=1`` runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ragspark.catalog import registry
from tools import check

FOLDER = "/root/testdata/sf0.001"
FAST = (
    "chunk_text split_pages corpus_stats top_hits search history_window trim_history dialogue_transcripts merge_entities"
    " resolve_edges answer_questions upsert_chunks sheet_grid_md cell_grid_md html_to_text render_report concat_deltas"
).split()
NAMES = sorted(registry.queries()) if os.environ.get("RAGSPARK_ALL") else FAST


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["invoke_id", "query_id", "context", "refs"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert check.rows_of(got) == check.rows_of(want)
    assert [check.kind(got.schema.field(n).type) for n in sorted(got.column_names)] == [
        check.kind(want.schema.field(n).type) for n in sorted(want.column_names)
    ]
