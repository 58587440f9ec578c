"""Chat logs cut into many splits equal the csv module over whole files."""

import csv
import io
import random
from pathlib import Path

import duckdb
import pytest

from ragspark.catalog import registry, talk
from ragspark.session import small_files
from ragspark.sources import files

HEAD = "sTalkerName,formatted_date,sTalkerContent,sOriginalFileName"


def by_csv(content):
    rows = list(csv.reader(io.StringIO(files.decoded(content), newline="")))
    at = [rows[0].index(c) for c in files.CHAT_COLUMNS]
    return [(n, *(r[k] if k < len(r) else "" for k in at)) for n, r in enumerate(rows[1:], 1) if r]


def test_line_states_follow_the_csv_module():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice('",ab\r') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            start = '"x' if inside else ""
            whole = list(io.StringIO(start + line + "\nMARK\n", newline=""))
            last = list(csv.reader(whole))[-1]
            assert files.ends_inside(line.encode(), inside) == (last != ["MARK"]), (line, inside)


@pytest.mark.parametrize("split", [120, 1 << 27])
def test_splits_do_not_matter(spark, tmp_path, split):
    csv.field_size_limit(2**31 - 1)
    rng = random.Random(2)
    pieces = ["a", '"q"', '"two\nlines"', '"say ""so"", then\n\nmore,"', 'a 5" disk', "", "가나다", '"가\n나"', "x,y", '""', '"\n"']
    texts = {}
    for name, end in (("one", "\n"), ("two", "\r\n"), ("한글", "\n")):
        rows = [HEAD] + [",".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["", "last,,row,"]
        texts[f"{name}.csv"] = end.join(rows) + end * rng.randrange(2)
    made = {n: t.encode("cp949" if n == "two.csv" else "utf-8-sig" if n == "one.csv" else "utf-8") for n, t in texts.items()}
    made["big field.csv"] = (HEAD + "\nA,," + '"' + "long, ""\n" * 120_000 + '",f\nB,,x,\n').encode() if split > 300 else (HEAD + "\nB,,x,\n").encode()
    made["head+only.csv"] = HEAD.encode()
    room = tmp_path / "x" / "data" / "x"
    room.mkdir(parents=True)
    for name, content in made.items():
        (room / name).write_bytes(content)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in keep:
            spark.conf.set(k, str(split))
        got = files.read_chat_csv(spark, str(room)).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want = {(name, *row) for name, content in made.items() for row in by_csv(content)}
    got_rows = set(map(tuple, got))
    assert not (got_rows - want) and not (want - got_rows), (sorted(got_rows - want)[:3], sorted(want - got_rows)[:3])
    assert len(got) == len(want)


def test_bad_files(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(HEAD.encode() + b"\n\xff\xff,,x,\n")
    with pytest.raises(Exception, match="neither UTF-8 nor CP949: bad.csv"):
        files.read_chat_csv(spark, str(tmp_path)).collect()
    (tmp_path / "bad.csv").write_bytes(b"\n" + HEAD.encode())
    with pytest.raises(Exception, match="missing columns sTalkerName"):
        files.read_chat_csv(spark, str(tmp_path)).collect()


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three rows of each of 600 users, one of whom is below zero and one unknown."""
    folder = tmp_path_factory.mktemp("events")
    user = "CASE id % 600 WHEN 0 THEN NULL WHEN 1 THEN -7 ELSE id % 600 END"
    rows = spark.range(1800).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 3600) AS ts", f"{user} AS user_id",
        "element_at(array('view', 'error', 'click'), cast(id % 7 % 3 + 1 AS int)) AS event_type", """concat('{"k": ', id % 5, '}') AS props""",
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("mounted", [True, False])
def test_written_logs_are_read_back(spark, events, monkeypatch, mounted):
    if not mounted:
        monkeypatch.setattr(files, "_local", lambda *_: None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["file_transcripts"]).fetchall()
    got = [tuple(r) for r in registry.queries()["file_transcripts"](spark, events).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[0] for r in got} >= {None, -7, 2, 599}


def test_logs_share_folders_and_tasks(spark, events):
    root = Path(files._local(spark, talk.written_log(spark, events)))
    assert len(list(root.rglob("*.csv"))) == 600
    assert len([p for p in root.rglob("*") if p.is_dir()]) == talk.LOG_FOLDERS
    assert not [p for p in root.rglob("*") if p.is_file() and p.suffix != ".csv"]
    setting = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(setting)
    with small_files(spark):
        assert spark.read.text(str(root)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    assert spark.conf.get(setting) == before
    spark.conf.set(setting, "120")
    try:
        with small_files(spark):
            assert spark.conf.get(setting) == "120"
    finally:
        spark.conf.set(setting, before)


def test_only_mounted_paths_are_opened(spark):
    assert [files._local(spark, p) for p in ("/a/b", "file:///a/b#c%20", "file:/a", "hdfs://a/b", "file://host/a", "a/b")] == ["/a/b", "/a/b#c%20", "/a", None, None, None]
