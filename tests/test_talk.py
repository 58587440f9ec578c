import random

from plans_text import plan
from pyspark.sql import functions as F

from ragspark.operators import dialogue, memory


def messages(spark, rows):
    return spark.createDataFrame(rows, "invoke_id string, seq long, role string, content string")


def window(history, n, chars):
    kept, used = [], 0
    for seq, role, text in reversed(history):
        if role == "assistant":
            continue
        if len(kept) == n or (kept and used + len(text) > chars):
            break
        kept.append(seq)
        used += len(text)
        if used > chars:
            break
    return sorted(kept)


def test_history_window_equals_the_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for room in range(120):
        history = [
            (i, rng.choice(["user", "assistant", "system"]), "x" * rng.choice([0, 5, 30, 100, 260]))
            for i in range(rng.randrange(0, 14))
        ]
        rows += [(str(room), *m) for m in history]
        want[str(room)] = window(history, 4, 250)
    got = {}
    for r in memory.history_window(messages(spark, rows), 4, 250).collect():
        got.setdefault(r["invoke_id"], []).append(r["seq"])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_exact_budget_and_long_newest(spark):
    rows = [("a", 1, "user", "x" * 1250), ("a", 2, "user", "y" * 1250), ("b", 1, "user", "z"), ("b", 2, "user", "w" * 3000)]
    got = {(r["invoke_id"], r["seq"]) for r in memory.history_window(messages(spark, rows)).collect()}
    assert got == {("a", 1), ("a", 2), ("b", 2)}


def test_map_side_limit(spark):
    df = memory.history_window(messages(spark, [("hot", i, "user", "m") for i in range(500)]).repartition(4))
    assert df.count() == 5
    df.collect()
    assert plan(df).count("WindowGroupLimit") == 2


def test_summary_text(spark):
    rows = [("a", 1, "user", "q" * 300), ("a", 2, "system", "s"), ("b", 1, "assistant", "only")]
    got = {r["invoke_id"]: r["conversation"] for r in memory.recent_summary_text(messages(spark, rows)).collect()}
    assert got == {"a": "사용자: " + "q" * 200 + "\nAI: s", "b": ""}


def test_accumulate_or_reset(spark):
    rows = [("k", 1, ["a"]), ("k", 2, []), ("k", 3, ["b", "c"]), ("k", 4, ["d"]), ("n", 1, ["z"]), ("e", 1, ["q"]), ("e", 2, None)]
    df = spark.createDataFrame(rows, "invoke_id string, seq long, items array<string>")
    got = sorted((r["invoke_id"], r["seq"], r["pos"], r["item"]) for r in memory.accumulate_or_reset(df).collect())
    assert got == [("k", 3, 0, "b"), ("k", 3, 1, "c"), ("k", 4, 0, "d"), ("n", 1, 0, "z")]


def transcript(rows):
    """Brute force: walk the rows of one file in order."""
    lines, day, block = [], None, None
    for talker, stamp, content, name in rows:
        text = content
        while "<FONT" in text and ">" in text[text.index("<FONT"):]:
            i = text.index("<FONT")
            text = text[:i] + text[text.index(">", i) + 1 :]
        attached = text.startswith("ATTACH://") and name != ""
        text = f"[첨부파일: {name}]" if attached else text.strip()
        if not text:
            continue
        bits = stamp.split(" ")
        if bits[0] and bits[0] != day:
            block = None
            if day is not None:
                lines.append("")
            lines.append(f"===== {bits[0]} =====")
            day = bits[0]
        if block is not None and block == (talker, False) and not attached:
            if talker:
                lines.append(text)
            continue
        block = (talker, attached)
        if talker:
            clock = bits[1] if len(bits) > 1 else ""
            lines.append((f"[{clock}] " if clock else "") + f"{talker}: {text}")
    return "\n".join(lines)


def log(spark, files):
    rows = [(f, i, *r) for f, rs in files.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(
        rows, "file string, row_seq long, sTalkerName string, formatted_date string, sTalkerContent string, sOriginalFileName string"
    )


def written(df):
    out = {}
    for r in df.orderBy("file", "row_seq", "kind").collect():
        out.setdefault(r["file"], []).append(r["line"])
    return {f: "\n".join(lines) for f, lines in out.items()}


def test_transcripts_equal_a_walk_over_the_rows(spark):
    rng = random.Random(7)
    files = {}
    for f in range(60):
        files[f"f{f}"] = [
            (
                rng.choice(["A", "A", "B", ""]),
                rng.choice(["2024-01-01 10:00", "2024-01-01 10:01", "2024-01-02 09:00", "2024-01-02", ""]),
                rng.choice(["hi", "<FONT x>yo</FONT>", "ATTACH://9", " ATTACH://9", "", "<FONT>", "two\nlines"]),
                rng.choice(["", "s.png"]),
            )
            for _ in range(rng.randrange(1, 40))
        ]
    want = {f: t for f, t in ((f, transcript(r)) for f, r in files.items()) if t}
    for piece in (3, 7, 65_536):
        assert written(dialogue.dialogue_lines(log(spark, files), piece)) == want


def test_same_talker_across_midnight(spark):
    rows = [("A", "2024-01-01 23:59", "x", ""), ("A", "2024-01-02 00:00", "y", ""), ("A", "", "z", "")]
    assert written(dialogue.dialogue_lines(log(spark, {"f": rows})))["f"] == (
        "===== 2024-01-01 =====\n[23:59] A: x\n\n===== 2024-01-02 =====\n[00:00] A: y\nz"
    )


def test_one_hot_file_is_windowed_in_pieces(spark):
    df = dialogue.dialogue_lines(log(spark, {"hot": [("A", "", "x", "")] * 300}), 50)
    assert df.count() == 300
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in tree.splitlines() if "Window [" in line]
    assert windows and all("_piece" in w for w in windows)


def test_live_rows(spark):
    df = spark.createDataFrame([("old", "2024-01-01 00:00:00"), ("edge", "2024-01-03 00:00:00"), ("new", "2024-01-04 00:00:00")], "id string, t string")
    df = df.withColumn("written_at", F.to_timestamp("t"))
    assert {r["id"] for r in memory.live_rows(df, F.lit("2024-01-10").cast("timestamp")).collect()} == {"new"}


def test_run_texts_in_parts(spark):
    rng = random.Random(8)
    rows = [("f", k, rng.choice(["a", "a", "a", "b", ""]), "" if k % 3 else f"2024-01-0{1 + k // 40} 10:0{k % 10}", "x" * rng.randrange(0, 30), "") for k in range(120)]
    log = spark.createDataFrame(rows, "file string, row_seq long, sTalkerName string, formatted_date string, sTalkerContent string, sOriginalFileName string")
    whole = {(r.first_row, r.talker, r.time): r.text for r in dialogue.run_texts(log, 7).collect()}
    assert sum(len(t) for t in whole.values()) == sum(r.n_chars + r.n_rows - 1 for r in dialogue.dialogue_runs(log, 7).collect())
    parts = {}
    for r in sorted(dialogue.run_texts(log, 7, 40).collect(), key=lambda r: (r.first_row, r.part)):
        assert len(r.text) < 40 + 30
        parts.setdefault((r.first_row, r.talker, r.time), []).append(r.text)
    assert {k: "\n".join(v) for k, v in parts.items()} == whole and any(len(v) > 1 for v in parts.values())
