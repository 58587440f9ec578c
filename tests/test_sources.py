import os

import pytest
from pyspark.sql import functions as F

from ragspark.operators import inference, parents, progress
from ragspark.plans import flows
from ragspark.sources import files, store

HEAD = "sTalkerName,formatted_date,sTalkerContent,sOriginalFileName"


def test_chat_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("﻿" + HEAD + '\nA,2024-01-01 10:00,"two\nlines, ""quoted""",\n\nB,,x\n').encode())
    (tmp_path / "k.csv").write_bytes((HEAD + "\r\n가나,2024-01-01,다라,파일.txt\r\n").encode("cp949"))
    (tmp_path / "order.csv").write_text('"extra",sOriginalFileName,sTalkerContent,formatted_date,sTalkerName\ne,f,c,d,t')
    (tmp_path / "no.txt").write_text("not a csv")
    (tmp_path / "q.csv").write_text(HEAD + '\nA,,a 5" disk,x\nB,,\ue000\ue002 kept,y\nC,,last,z\n')
    rows = files.read_chat_csv(spark, str(tmp_path)).orderBy("file", "row_seq").collect()
    assert [tuple(r)[:1] + tuple(r)[2:] for r in rows] == [
        ("a.csv", "A", "2024-01-01 10:00", 'two\nlines, "quoted"', ""), ("a.csv", "B", "", "x", ""),
        ("k.csv", "가나", "2024-01-01", "다라", "파일.txt"), ("order.csv", "t", "d", "c", "f"),
        ("q.csv", "A", "", 'a 5" disk', "x"), ("q.csv", "B", "", "\ue000\ue002 kept", "y"), ("q.csv", "C", "", "last", "z"),
    ]
    lines = flows.dialogue_transcripts(spark, str(tmp_path)).where("file = 'a.csv'").orderBy("row_seq", "kind").collect()
    assert [r["line"] for r in lines] == ["===== 2024-01-01 =====", '[10:00] A: two\nlines, "quoted"', "B: x"]


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("sTalkerName,formatted_date\na,b\n")
    with pytest.raises(Exception, match="missing columns sTalkerContent, sOriginalFileName in bad.csv"):
        files.read_chat_csv(spark, str(tmp_path)).collect()


def test_corpus(spark, tmp_path):
    room = tmp_path / "room1"
    room.mkdir()
    (room / "a.MD").write_text("# hi")
    (room / "b.html").write_text("<p>x &amp; y</p><script>no</script>")
    (room / "blank.txt").write_text(" \n ")
    (room / "c.bin").write_bytes(b"\x00\xff")
    (room / "d.txt").write_bytes("가나".encode("cp949"))
    (room / "e.txt").write_bytes(b"\xff\xff\xff")
    got = {(r["invoke_id"], r["source"], r["ext"], r["markdown"]) for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {("room1", "a.MD", ".md", "# hi"), ("room1", "b.html", ".html", "x & y"), ("room1", "d.txt", ".txt", "가나")}
    gone = {(r["path"].split("/")[-1], r["reason"]) for r in files.rejected_files(spark, str(tmp_path)).collect()}
    assert gone == {("c.bin", "kind"), ("blank.txt", "blank"), ("e.txt", "encoding")}


def test_listing(spark, tmp_path):
    room = tmp_path / "r"
    (room / "sub").mkdir(parents=True)
    for name, t in (("new", 300), ("b", 100), ("a", 100)):
        (room / name).write_text(name)
        os.utime(room / name, (t, t))
    (room / "sub" / "deep").write_text("x")
    assert [r["name"] for r in files.list_room_files(spark, str(tmp_path), "r").collect()] == ["a", "b", "new"]
    assert files.list_room_files(spark, str(tmp_path), "none").count() == 0


def test_doc_json_files(spark, tmp_path):
    for folder, name, text in (
        ("a", "pdf_page_all.json", "{a-pdf}"), ("a", "word_page_all.json", '{\n "pages": []\n}'), ("a", "aa_page_all.json", "{x}"),
        ("b c+d", "z_page_all.json", "{z}"), ("b c+d", "y_page_all.json", "{y}"), ("e", "other.json", "{}"),
        ("r1/doc", "pdf_page_all.json", "{1}"), ("r2/doc", "word_page_all.json", "{2}"),
    ):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = {(r["doc_id"], r["json"]) for r in files.read_doc_json(spark, str(tmp_path)).collect()}
    assert got == {("a", '{\n "pages": []\n}'), ("b c+d", "{y}"), ("r1/doc", "{1}"), ("r2/doc", "{2}")}


def test_calls_from_files_to_results(spark, tmp_path):
    audio = tmp_path / "audio"
    audio.mkdir()
    (audio / "1.wav").write_text('{"text":"hello"}')
    (audio / "2.wav").write_text('{"text":""}')
    raw = spark.read.format("binaryFile").load(str(audio)).select(files.file_name(F.col("path")).alias("call_id"), "content")
    responses = inference.transcribe(raw).select("call_id", "response")
    done, failed = flows.call_summaries(responses, duration=F.lit(1.239))
    store.write_results(done, str(tmp_path / "out"), "json")
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row["transcript"] == "hello" and row["duration_seconds"] == 1.24 and row["summary"]
    assert [r["call_id"] for r in failed.collect()] == ["2.wav"]


def test_parents(spark):
    kind = "invoke_id string, parent_id string, content string, written_at int"
    new = spark.createDataFrame([("r", "p", "one", 1), ("r", "p", "two", 2), ("r", "", "x", 1), ("r", "q", "", 1), ("r", None, "x", 1)], kind)
    table, accepted = parents.save_parents(new.limit(0), new)
    assert accepted.count() == 2 and [r["content"] for r in table.collect()] == ["two"]
    asked = spark.createDataFrame([("a", "r", ["z", "p", "p"])], "request_id string, invoke_id string, ids array<string>")
    got = parents.load_parents(asked, table).orderBy("pos").collect()
    assert [(r["pos"], r["content"]) for r in got] == [(1, "two"), (2, "two")]


def test_infer_pads_and_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i int").coalesce(1)

    def factory():
        return lambda xs: [f"{x}/{len(xs)}" for x in xs][:-1]

    got = [r["o"] for r in inference.infer(df, "i", "o", factory, "string", 4, empty="pad").collect()]
    assert got == ["0/4", "1/4", "2/4", "pad", "4/4", "5/4", "6/4", "pad", "8/2", "pad"]


def test_vectors_are_stored_once_and_searched(spark, tmp_path):
    docs = spark.createDataFrame([("007", "f", "apples and pears"), ("007", "g", "trains and rails"), ("7", "h", "pears")], "invoke_id string, source string, markdown string")
    at = F.lit("2024-01-01").cast("timestamp")
    made = flows.ingest(docs, at, with_vectors=True)
    kept = made.select("invoke_id", "id", "content", "source", "page", "vectors", "written_at")
    store.append_batch(kept, str(tmp_path / "chunks"), 0)
    stored = store.load_rows(spark, str(tmp_path / "chunks"))
    asked = spark.createDataFrame([("007", "1", "pears"), ("007", "2", "rails")], "invoke_id string, query_id string, question string")
    got = flows.search_text(asked, stored, k=1, min_score=0.5)
    want = flows.search_text(asked, stored.drop("vectors"), k=1, min_score=0.5)
    assert got.count() == 2 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.orderBy("query_id").first()["references"][0]["source"] == "f"


def test_recorded_ingestion(spark, tmp_path):
    docs = spark.createDataFrame([("r", "a.md", "one two three"), ("r", "a.md", "one two three"), ("r", "b.md", " "), ("s", "c.md", "x\n--- Page 2 ---\ny")], "invoke_id string, source string, markdown string")
    at = F.lit("2024-01-01").cast("timestamp")
    events = str(tmp_path / "events")
    flows.ingest_recorded(docs, str(tmp_path / "chunks"), 0, events, "first", at)
    rows = progress.run_events(spark, events).orderBy("step").collect()
    assert [(r.stage, r.percent, r.n_rows) for r in rows] == [
        ("start", 0, None), ("parse", 5, None), ("parsed", 10, 4), ("keywords", 15, None), ("chunked", 20, 4), ("index", 30, None), ("indexed", 90, 3), ("done", 100, 3),
    ]
    got = store.load_rows(spark, str(tmp_path / "chunks"))
    want = store.latest_rows(flows.ingest(docs, at).select(*flows.STORED))
    assert got.count() == 3 and got.exceptAll(want).isEmpty()
    with pytest.raises(ValueError):
        flows.ingest_recorded(docs, str(tmp_path / "chunks"), 1, events, "second", at, 100, 90)
    rows = progress.run_events(spark, events).where("run_id = 'second'").orderBy("step").collect()
    assert [(r.stage, r.percent) for r in rows] == [("start", 0), ("parse", 5), ("parsed", 10), ("error", -1)] and "overlap" in rows[-1].message
