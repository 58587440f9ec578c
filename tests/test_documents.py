import json
import random

from plans_text import plan
from pyspark.sql import functions as F

from ragspark.operators import docjson, grids
from ragspark.plans import flows


def frame(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id int, json string")


def markdown(df):
    return [r["markdown"] for r in df.orderBy("doc_id").collect()]


def para(*parts):
    return {"content": [p if isinstance(p, dict) else {"text": p} for p in parts]}


def cell(r, c, text, rowspan=1, colspan=1):
    return {"metrics": {"rowaddr": r, "coladdr": c, "rowspan": rowspan, "colspan": colspan}, "para": [para(text)]}


def test_sheets(spark):
    doc = {
        "docName": "book",
        "sheets": [
            {
                "sheetName": "one",
                "rows": [
                    {"row": 5, "cols": [{"col": 1, "value": "x|\ny"}, {"col": 1, "value": 7}]},
                    {"row": 2, "cols": [{"col": 0, "value": "a"}]},
                    {"row": 2, "cols": [{"col": 2, "value": "b"}]},
                ],
                "objects": {"tables": [{"displayName": "D", "csv": ""}, {"csv": "h"}]},
            },
            {"rows": []},
        ],
    }
    assert markdown(docjson.sheets_md(frame(spark, doc))) == [
        "# book\n\n\n## Sheet: one\n\n\n| a |  | b |\n| --- | --- | --- |\n|  | 7 |  |\n\n\n### D\n\n\n\n### Table\n\n\n| h |\n| --- |\n"
        "\n\n## Sheet: Sheet\n\n"
    ]


def test_slides_with_nested_groups(spark):
    shape = lambda t: {"type": "shape", "shape": {"para": [para(t)]}}
    group = lambda *items: {"type": "group", "group": {"shapes": list(items)}}
    doc = {
        "summary_info": {"docName": "deck"},
        "slide": [
            {
                "slide_number": 1, "note": "n",
                "contents": [
                    shape("a"), shape(" "),
                    group(shape("b"), group({"type": "table", "table": {"cells": [cell(0, 0, "p|q"), cell(0, 1, "r")]}}, shape("c"))),
                    {"type": "shape", "shape": {"col": [{"para": [para("l")]}, {"x": 1}, {"para": [para("m")]}]}},
                    {"type": "equation", "equation": {"rawMath": "e"}},
                ],
            },
            {"slide_number": 2},
            {"contents": []},
        ],
    }
    assert markdown(docjson.slides_md(frame(spark, doc))) == [
        "# deck\n\n\n--- Slide 1 ---\n\n> **Note:** n\n\na\n\nb\n\n\n| p\\|q | r |\n| --- | --- |\n\n\nc\n\nl\n\nm\n\n[Equation: e]"
        "\n\n--- Slide 2 ---\n\n\n--- Slide 0 ---\n\n"
    ]
    deep = {"slide": [{"contents": [group(group(group(shape("x"))))]}]}
    assert markdown(docjson.slides_md(frame(spark, deep)))[0].endswith("x")
    item = shape("deepest")
    for _ in range(10):
        item = group(item)
    both = markdown(docjson.slides_md(frame(spark, {"slide": [{"contents": [shape("first"), item, shape("last")]}]}, deep)))
    assert any("first\n\ndeepest\n\nlast" in m for m in both) and any(m.endswith("x") for m in both)


def test_word_with_frames(spark):
    doc = {
        "docName": "d", "metadata": {"coreProperties": {"title": "T"}},
        "frames": [
            {"ID": 1, "type": "shape", "para": [para("old")]},
            {"ID": 1, "type": "shape", "para": [para("box"), para("more")]},
            {"ID": 2, "type": "table", "cells": [cell(0, 0, {"objectID": 1})]},
            {"ID": 0, "type": "shape", "para": [para("never")]},
            {"ID": 3, "type": "group", "shapes": [{"type": "shape", "para": [para("g1")]}, {"type": "equation", "rawMath": {"format": "latex", "value": "x"}}]},
            {"ID": 4, "type": "chart", "name": "c"},
        ],
        "body": [
            {
                "pageInfo": {"pageNum": 7},
                "para": [
                    para("a", {"breakType": "softLineBreak"}, "b", {"breakType": "pageBreak"}), para(" "), {"no": 1},
                    para("see ", {"objectID": {"kind": "t", "tableID": 2}}), para({"objectID": 0}, {"objectID": 99}, {"objectID": 4}, "end"),
                    para({"objectID": 3}),
                ],
                "col": [{"colNum": 1, "para": [para("left")]}, {"colNum": 2}],
            },
            {"para": []},
        ],
    }
    assert markdown(docjson.word_body_md(frame(spark, doc, {"body": [], "docName": "plain"}, {"body": []}))) == [
        "# T\n\n\n--- Page 7 ---\n\na\nb\n\nsee \n| box<br><br>more |\n| --- |\n\n\nend\n\ng1\n\n$x$\n\n[Column 1]\n\nleft"
        "\n\n--- Page 0 ---\n\n",
        "# plain\n", "",
    ]


def test_frames_inside_frames(spark):
    chain = [{"ID": k, "type": "shape", "para": [para(f"f{k} ", {"objectID": k + 1})]} for k in range(1, 5)]
    doc = {"docName": "d", "frames": [*chain, {"ID": 5, "type": "shape", "para": [para("end")]}], "body": [{"para": [para({"objectID": 1})]}]}
    circle = {"docName": "c", "frames": [{"ID": 1, "type": "shape", "para": [para("p ", {"objectID": 2})]}, {"ID": 2, "type": "shape", "para": [para("q ", {"objectID": 1})]}], "body": [{"para": [para({"objectID": 1})]}]}
    got = markdown(docjson.word_body_md(frame(spark, doc, circle)))
    assert all(f"f{k}" in got[0] for k in range(1, 5)) and "end" in got[0] and "p" in got[1]


def test_pdf_and_kinds(spark):
    pdf = {"pages": [{"pageNum": 1, "contents": [{"type": "text", "content": {"text": "t"}}, {"type": "text", "content": {"text": ""}}, {"type": "image", "content": {}}]}]}
    both = {"sheets": [], "pages": []}
    df = frame(spark, pdf, both, {"other": 1}, {"body": [], "pages": [], "docName": "w"})
    got = {r["doc_id"]: r["markdown"] for r in flows.doc_json_to_markdown(df).collect()}
    assert got == {
        0: "# PDF Document\n\n\n\n--- Page 1 ---\n\n\nt", 1: "# Spreadsheet\n",
        2: "지원되지 않는 JSON 형식이거나 빈 문서입니다.", 3: "# w\n",
    }


def merged(cells):
    """Brute force over a dense grid."""
    place, filler, rows, cols = {}, set(), 0, 0
    for r, c, rs, cs, t in cells:
        place[r, c] = t
        filler |= {(r + i, c + j) for i in range(rs) for j in range(cs)}
    rows = max(r for r, _ in place.keys() | filler)
    cols = max(c for _, c in place.keys() | filler)
    return [[place.get((r, c), "") for c in range(cols + 1)] for r in range(rows + 1)]


def test_merged_cells_equal_a_dense_walk(spark):
    rng = random.Random(9)
    docs = {
        d: [(rng.randrange(4), rng.randrange(4), rng.randrange(0, 4), rng.randrange(0, 4), f"t{i}") for i in range(rng.randrange(1, 7))]
        for d in range(60)
    }
    rows = [(d, *c, i) for d, cs in docs.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "d int, row int, col int, rowspan int, colspan int, text string, seq int")
    got = {}
    for r in grids.cell_grid(df, ["d"]).orderBy("d", "row").collect():
        got.setdefault(r["d"], []).append(r["line"])
    for d, cells in docs.items():
        want = ["| " + " | ".join(r) + " |" for r in merged(cells)]
        want[0] += "\n| " + " | ".join(["---"] * len(merged(cells)[0])) + " |"
        assert got[d] == want


def test_csv_and_charts(spark):
    def one(c):
        return spark.range(1).select(c.alias("o")).first()["o"]

    assert one(grids.csv_to_md(F.lit(' a,"b"\n1,|\n'))) == "\n| a | b |\n| --- | --- |\n| 1 | \\| |\n"
    assert one(grids.csv_to_md(F.lit(""))) == ""
    chart = lambda s: one(docjson.chart_md(F.from_json(F.lit(json.dumps(s)), f"struct<{docjson.CHART}>")))
    assert chart({"name": "x"}) == ""
    assert chart({"chartData": {"title": "T", "markdown": "m"}}) == "\n### Chart: Chart\n\n**T**\n\nm"
    assert chart({"markdown": "o", "chartData": {"markdown": "i", "csv": "a"}}) == "\n### Chart: Chart\n\n\n| a |\n| --- |\n\no"
    eq = lambda s: one(docjson.equation_text(F.lit(s)))
    assert eq('{"format":"LaTeX","value":"v"}') == "$v$"
    assert eq('{"value":"v"}') == "[Equation: v]"
    assert eq('{"format":"latex"}') == "" and eq("") == "" and eq("plain") == "[Equation: plain]"


def test_document_json_to_chunks(spark):
    doc = {"body": [{"pageInfo": {"pageNum": 2}, "para": [para("hello world")]}, {"pageInfo": {"pageNum": 3}, "para": [para("bye")]}], "docName": "w"}
    rows = flows.doc_json_to_chunks(frame(spark, doc), F.current_timestamp()).collect()
    assert sorted((r["page"], r["text"]) for r in rows) == [(1, "# w"), (2, "hello world"), (3, "bye")]


def test_cells_are_shuffled_once_for_a_row(spark):
    rows = [(1, 0, 0, "a", 1), (1, 0, 0, "b", 2), (1, 0, 2, "c", 1), (1, 3, None, None, 1)]
    cells = spark.createDataFrame(rows, "k long, row int, col int, text string, seq int")
    got = grids._row_values(cells, ["k"])
    assert {r.row: r._values for r in got.collect()} == {0: {0: "b", 2: "c"}, 3: {}}
    assert sum(line.strip(" +-:").startswith("Exchange") for line in plan(got).splitlines()) == 1


def test_decks_and_word_documents_stay_in_their_row(spark):
    """Neither is shuffled, groups may be far deeper than one round opens, and a circle does not depend on other documents."""
    shape = lambda t: {"type": "shape", "shape": {"para": [para(t)]}}
    item, part = shape("deepest"), {"type": "shape", "para": [para("inmost")]}
    for k in range(2 * docjson.GROUP_LEVELS + 3):
        item = {"type": "group", "group": {"shapes": [shape(f"a{k}"), item, shape(f"z{k}")]}}
        part = {"type": "group", "shapes": [part, {"type": "shape", "para": [para(f"p{k}")]}]}
    deck = frame(spark, {"slide": [{"contents": [shape("first"), item, {"type": "group"}, shape("last")]}]})
    made = docjson.slides_md(deck)
    levels = range(2 * docjson.GROUP_LEVELS + 3)
    assert markdown(made)[0].split("\n\n")[2:] == ["first", *[f"a{k}" for k in reversed(levels)], "deepest", *[f"z{k}" for k in levels], "last"]
    circle = {"docName": "c", "frames": [{"ID": k, "type": "shape", "para": [para(f"{k} ", {"objectID": 3 - k})]} for k in (1, 2)], "body": [{"para": [para({"objectID": 1})]}]}
    deep = {"docName": "w", "frames": [{**part, "ID": 7}, *[{"ID": k, "type": "shape", "para": [para(str(k))]} for k in range(20, 30)]], "body": [{"para": [para({"objectID": 7})]}]}
    both = docjson.word_body_md(frame(spark, circle, deep))
    got = {m.split("\n")[0]: m for m in markdown(both)}
    assert got["# c"] == markdown(docjson.word_body_md(frame(spark, circle)))[0]
    assert got["# w"].split("\n\n")[2:] == ["inmost", *[f"p{k}" for k in levels]]
    assert "Exchange" not in plan(made) + plan(both)


def test_tables_in_a_row_equal_tables_of_rows(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(4), rng.randrange(5), rng.randrange(4), rng.randrange(3), rng.choice(["a|b", "c\nd", "", "e"]), n) for k in range(30) for n in range(rng.randrange(1, 12))]
    cells = spark.createDataFrame(rows, "k int, row int, col int, rowspan int, colspan int, text string, seq int")
    want = {r.k: r.table_md for r in grids.table_text(grids.cell_grid(cells, ["k"]), ["k"]).collect()}
    own = F.array_sort(F.collect_list(F.struct("seq", "row", "col", "rowspan", "colspan", "text")))
    got = {r.k: r.md for r in cells.groupBy("k").agg(own.alias("c")).select("k", grids.table_of(F.col("c")).alias("md")).collect()}
    assert got == want and len(got) == 30
