"""Structured document JSON to markdown.

Pages, decks and word-processor documents are rendered inside their row, so nothing of them is shuffled or stored;
workbooks are exploded to sheets and cells, rendered by joins and grouping, and put together again per document. A
document is one JSON value, which bounds every group here.
"""

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X
from ragspark.operators import grids, skew
from ragspark.session import saved

PARA = "array<struct<content:array<struct<text:string,objectID:string,breakType:string>>>>"
CHART = "name:string,chartData:struct<title:string,chartType:string,csv:string,markdown:string>,csv:string,markdown:string"
CELLS = f"array<struct<metrics:struct<rowaddr:int,coladdr:int,rowspan:int,colspan:int>,para:{PARA}>>"
#: Levels of groups that are read with a document; what lies deeper stays text and is opened in further rounds.
GROUP_LEVELS = 12


def _nested(fields, group, levels=GROUP_LEVELS):
    """Type of an item whose groups hold items of the same type, ``levels`` deep, and below that texts."""
    inner = "string"
    for _ in range(levels + 1):
        inner = f"struct<{fields},{group.format(inner)}>"
    return inner


ITEM = _nested(
    f"type:string,shape:struct<para:{PARA},col:array<struct<para:{PARA}>>>,table:struct<cells:{CELLS}>,"
    f"chart:struct<{CHART}>,equation:struct<rawMath:string>", "group:struct<shapes:array<{}>>",
)
FRAME = _nested(f"ID:string,type:string,cells:{CELLS},para:{PARA},rawMath:string,{CHART}", "shapes:array<{}>")
SHEETS = (
    "docName string, sheets array<struct<sheetName:string,rows:array<struct<row:string,cols:array<struct<col:string,"
    f"value:string>>>>,objects:struct<charts:array<struct<{CHART}>>,tables:array<struct<displayName:string,name:string,"
    "csv:string>>,equations:array<struct<rawMath:string>>>>>"
)
PAGES = (
    "docName string, pages array<struct<pageNum:string,contents:array<struct<type:string,content:struct<text:string,"
    f"html:string,rawMath:string,{CHART}>>>>>"
)
SLIDES = (
    "summary_info struct<docName:string>, slide array<struct<slide_number:string,note:string,"
    f"contents:array<{ITEM}>>>"
)
WORD = (
    "metadata struct<coreProperties:struct<title:string>>, docName string, body array<struct<"
    f"pageInfo:struct<pageNum:string>,para:{PARA},col:array<struct<colNum:string,para:{PARA}>>>>, frames array<{FRAME}>"
)
KINDS = ("sheets", "slide", "body", "pages")


def doc_kind(json):
    """First root key that names a document kind, else null."""
    roots = F.array(*map(F.lit, KINDS))
    return X.let(
        F.json_object_keys(json), lambda keys: F.get(F.filter(roots, lambda k: F.array_contains(keys, k)), 0)
    )


def tagged(docs):
    """Documents with their ``kind``; store them by it and each kind is read alone."""
    return docs.withColumn("kind", F.coalesce(doc_kind(F.col("json")), F.lit("other")))


def equation_text(raw):
    def render(p):
        value = p["value"]
        latex = F.lower(F.coalesce(p["format"], F.lit(""))) == "latex"
        of_object = (
            F.when(X.is_null_or_empty(value), F.lit(""))
            .when(latex, F.concat(F.lit("$"), value, F.lit("$")))
            .otherwise(F.concat(F.lit("[Equation: "), value, F.lit("]")))
        )
        of_text = F.when(X.is_null_or_empty(raw), F.lit("")).otherwise(F.concat(F.lit("[Equation: "), raw, F.lit("]")))
        return F.when(F.json_object_keys(raw).isNotNull(), of_object).otherwise(of_text)

    return X.let(F.from_json(raw, "format string, value string"), render)


def chart_md(c):
    """Heading, title, type, csv as a table, markdown; a heading alone is empty."""
    info = c["chartData"]
    csv = F.coalesce(c["csv"], info["csv"])
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("\n### Chart: "), F.coalesce(c["name"], F.lit("Chart")), F.lit("\n")),
            F.when(F.length(info["title"]) > 0, F.concat(F.lit("**"), info["title"], F.lit("**\n"))),
            F.when(F.length(info["chartType"]) > 0, F.concat(F.lit("Type: "), info["chartType"], F.lit("\n"))),
            F.when(csv.isNotNull(), grids.csv_to_md(csv)),
            F.coalesce(c["markdown"], info["markdown"]),
        )
    )
    return X.let(parts, lambda p: F.when(F.size(p) > 1, F.array_join(p, "\n")).otherwise(F.lit("")))


def reference_id(object_id):
    """Frame number of an object reference: the number itself or the first ``…ID`` member that is one; 0 is none."""
    members = F.map_entries(F.from_json(object_id, "map<string,string>"))
    ids = F.filter(members, lambda m: m["key"].endswith("ID") & m["value"].try_cast("int").isNotNull())
    found = F.coalesce(object_id.try_cast("int"), F.get(ids, 0)["value"].try_cast("int"))
    return F.nullif(found, F.lit(0))


def joined(df, keys, order, text, sep, out):
    """Ordered concatenation of a document's pieces."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda s: s["t"]), sep).alias(out))


def _none(kind):
    return F.array().cast(f"array<{kind}>")


# A piece of a paragraph is its text, or the place of the frame that stands there; a paragraph is its pieces.
PIECES = "struct<text:string,frame:int>"


def _pieces(p, ids):
    """Pieces of a paragraph; ``ids`` are the frame numbers of its document."""

    def piece(i):
        text = F.when(i["text"].isNotNull(), i["text"]).when(
            i["objectID"].isNull(), F.when(i["breakType"] == "softLineBreak", F.lit("\n")).otherwise(F.lit(""))
        )
        place = F.nullif(F.array_position(ids, reference_id(i["objectID"])), F.lit(0)).cast("int") - 1
        return F.struct(text.alias("text"), F.when(text.isNull(), place).alias("frame"))

    return F.coalesce(F.transform(p["content"], piece), _none(PIECES))


def _all_pieces(para, ids):
    return F.coalesce(F.transform(para, lambda p: _pieces(p, ids)), _none(f"array<{PIECES}>"))


def _shown(pieces, texts):
    """Text of a paragraph, with ``texts`` by place in its frames' places."""
    return F.array_join(F.transform(pieces, lambda i: F.coalesce(i["text"], F.get(texts, i["frame"]), F.lit(""))), "")


def _paragraphs(paras, texts):
    shown = F.filter(F.transform(paras, lambda p: _shown(p, texts)), lambda t: F.length(X.strip(t)) > 0)
    return F.array_join(shown, "\n\n")


def _cells(cells, ids):
    """Cells with their place, span and paragraphs."""

    def metric(c, name, default):
        return F.coalesce(c["metrics"][name], F.lit(default)).alias(name)

    return F.transform(cells, lambda c: F.struct(
        metric(c, "rowaddr", 0), metric(c, "coladdr", 0), metric(c, "rowspan", 1), metric(c, "colspan", 1),
        _all_pieces(c["para"], ids).alias("paras"),
    ))


def _table(cells, texts):
    """Markdown of a table of cells; none without cells."""

    def cell(c):
        text = F.array_join(F.transform(c["paras"], lambda p: X.strip(_shown(p, texts))), " ")
        return F.struct(c["rowaddr"].alias("row"), c["coladdr"].alias("col"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), text.alias("text"))

    return F.coalesce(grids.table_of(F.transform(cells, cell)), F.lit(""))


def opened(items, shapes, leaf, levels=GROUP_LEVELS):
    """Leaves of an array of (nested) items, in order; groups below ``levels`` stay as leaves with a ``rest`` of texts."""

    def each(i):
        is_group = i["type"].eqNullSafe(F.lit("group"))
        if not levels:
            rest = F.coalesce(shapes(i), _none("string"))
            return F.array(F.struct(*leaf(i), F.when(is_group, rest).alias("rest")))
        own = F.array(F.struct(*leaf(i), F.lit(None).cast("array<string>").alias("rest")))
        inner = opened(shapes(i), shapes, leaf, levels - 1)
        return F.when(~is_group, own).otherwise(F.coalesce(inner, F.slice(own, 1, 0)))

    return F.flatten(F.transform(items, each))


def opened_again(leaves, kind, shapes, leaf):
    """Leaves with what their ``rest`` holds in their places."""
    def each(i):
        inner = opened(F.transform(i["rest"], lambda r: F.from_json(r, kind)), shapes, leaf)
        return F.when(i["rest"].isNull(), F.array(i)).otherwise(inner)

    return F.flatten(F.transform(leaves, each))


def _unopened(leaves):
    return F.exists(leaves, lambda i: i["rest"].isNotNull())


#: A key of shapes, or an escape that may be one of its letters: a document has no more levels of groups than of these.
SHAPES_KEY = """["']shapes["']|\\\\u00[67]"""


def in_rounds(docs, read, unopened, again):
    """``read(docs)`` with groups of any depth opened.

    Only documents that may hold groups below ``GROUP_LEVELS`` are stored, once for every so many levels.
    """
    deep = F.coalesce(F.regexp_count("json", F.lit(SHAPES_KEY)) > GROUP_LEVELS, F.lit(False))
    rest = saved(read(docs.where(deep)), "groups")
    while not rest.where(unopened).isEmpty():
        rest = saved(again(rest), "groups")
    return read(docs.where(~deep)).union(rest)


def _of_kind(docs, kind):
    return (docs if "kind" in docs.columns else tagged(docs)).where(F.col("kind") == kind)


def _parsed(docs, kind, schema):
    return _of_kind(docs, kind).select("doc_id", F.from_json("json", schema).alias("d"))


def sheets_md(docs):
    """Spreadsheets: title; per sheet a heading, the grid, charts, embedded tables, equations."""
    d = _parsed(docs, "sheets", SHEETS)
    sheet = d.select("doc_id", F.posexplode("d.sheets").alias("sheet", "s"))
    rows = sheet.select("doc_id", "sheet", F.posexplode("s.rows").alias("r_at", "r"))
    cols = rows.select(
        "doc_id", "sheet", "r_at", F.coalesce(F.col("r.row").cast("int"), F.lit(0)).alias("row"),
        F.posexplode_outer("r.cols").alias("c_at", "c"),
    )
    cells = cols.select(
        "doc_id", "sheet", "row",
        F.when(F.col("c").isNotNull(), F.coalesce(F.col("c.col").cast("int"), F.lit(0))).alias("col"),
        F.col("c.value").alias("value"), F.struct("r_at", "c_at").alias("seq"),
    )
    key = ["doc_id", "sheet"]
    grid = grids.table_text(grids.sheet_grid(cells, key), key)

    def table(t):
        name = F.coalesce(t["displayName"], t["name"], F.lit("Table"))
        return F.array(F.concat(F.lit("\n### "), name, F.lit("\n")), grids.csv_to_md(t["csv"]))

    def nonempty(a):
        return F.filter(a, lambda t: F.length(t) > 0)

    none = F.array().cast("array<string>")
    o = F.col("s.objects")
    parts = F.concat(
        F.array(F.concat(F.lit("\n## Sheet: "), F.coalesce("s.sheetName", F.lit("Sheet")), F.lit("\n"))),
        F.when(F.col("s.rows").isNotNull(), F.array(F.coalesce("table_md", F.lit("")))).otherwise(none),
        F.coalesce(nonempty(F.transform(o["charts"], chart_md)), none),
        F.coalesce(
            F.flatten(F.transform(F.filter(o["tables"], lambda t: t["csv"].isNotNull()), table)), none
        ),
        F.coalesce(nonempty(F.transform(o["equations"], lambda e: equation_text(e["rawMath"]))), none),
    )
    body = sheet.join(grid, key, "left").select(
        "doc_id", "sheet", F.concat(F.lit("\n"), F.array_join(parts, "\n")).alias("part")
    )
    title = F.concat(F.lit("# "), F.coalesce("d.docName", F.lit(S.SPREADSHEET_TITLE)), F.lit("\n"))
    return d.join(joined(body, ["doc_id"], "sheet", "part", "", "body"), "doc_id", "left").select(
        "doc_id", F.concat(title, F.coalesce("body", F.lit(""))).alias("markdown")
    )


def pdf_pages_md(docs):
    """Paged documents: title, page markers, and text, table, chart and equation blocks."""
    d = _parsed(docs, "pages", PAGES)

    def block(c):
        o = c["content"]
        html = F.when(F.length(o["html"]) > 0, F.concat(F.lit("\n"), o["html"], F.lit("\n")))
        return (
            F.when(c["type"] == "text", o["text"]).when(c["type"] == "table", html)
            .when(c["type"] == "chart", chart_md(o)).when(c["type"] == "equation", equation_text(o["rawMath"]))
        )

    def page(p):
        marker = F.concat(F.lit("\n--- Page "), F.coalesce(p["pageNum"], F.lit("0")), F.lit(" ---\n"))
        blocks = F.filter(F.transform(p["contents"], block), lambda t: F.length(t) > 0)
        return F.concat(F.array(marker), F.coalesce(blocks, F.array().cast("array<string>")))

    title = F.concat(F.lit("# "), F.coalesce("d.docName", F.lit(S.PDF_TITLE)), F.lit("\n"))
    parts = F.concat(F.array(title), F.flatten(F.transform("d.pages", page)))
    return d.select("doc_id", F.array_join(F.coalesce(parts, F.array(title)), "\n\n").alias("markdown"))


def _slide_leaf(i):
    return [i[c].alias(c) for c in ("type", "shape", "table", "chart", "equation")]


def slides_md(docs):
    """Decks: title; per slide a marker, the note and the non-blank blocks of its (nested) items."""
    shapes = lambda i: i["group"]["shapes"]
    none, nothing = _none("int"), _none("string")

    def with_contents(slides, contents):
        return F.transform(slides, lambda s: F.struct(s["slide_number"].alias("slide_number"), s["note"].alias("note"), contents(s["contents"]).alias("contents"))).alias("slides")

    def read(chosen):
        return _parsed(chosen, "slide", SLIDES).select(
            "doc_id", F.col("d.summary_info.docName").alias("name"), with_contents(F.col("d.slide"), lambda c: opened(c, shapes, _slide_leaf))
        )

    def again(rows):
        return rows.select("doc_id", "name", with_contents(F.col("slides"), lambda c: opened_again(c, ITEM, shapes, _slide_leaf)))

    def paragraphs(para):
        return F.when(para.isNotNull(), _paragraphs(_all_pieces(para, none), nothing))

    def block(i):
        kind = i["type"]
        columns = F.transform(F.filter(i["shape"]["col"], lambda c: c["para"].isNotNull()), lambda c: paragraphs(c["para"]))
        return (
            F.when(kind == "shape", F.coalesce(paragraphs(i["shape"]["para"]), F.array_join(columns, "\n\n")))
            .when(kind == "table", _table(_cells(i["table"]["cells"], none), nothing))
            .when(kind == "chart", chart_md(i["chart"])).when(kind == "equation", equation_text(i["equation"]["rawMath"]))
        )

    def slide(s):
        marker = F.concat(F.lit("\n--- Slide "), F.coalesce(s["slide_number"], F.lit("0")), F.lit(" ---\n"))
        note = F.when(F.length(s["note"]) > 0, F.concat(F.lit("> **Note:** "), s["note"], F.lit("\n")))
        blocks = F.filter(F.transform(s["contents"], block), lambda t: F.length(X.strip(t)) > 0)
        parts = F.array_compact(F.array(marker, note, F.array_join(blocks, "\n\n")))
        return F.concat(F.lit("\n"), F.array_join(parts, "\n"))

    rows = in_rounds(docs, read, F.exists("slides", lambda s: _unopened(s["contents"])), again)
    title = F.concat(F.lit("# "), F.coalesce("name", F.lit(S.DECK_TITLE)), F.lit("\n"))
    body = F.array_join(F.transform("slides", slide), "")
    return rows.select("doc_id", F.concat(title, F.coalesce(body, F.lit(""))).alias("markdown"))


def _frame_leaf(i):
    return [i[c].alias(c) for c in ("type", "cells", "para", "rawMath", "name", "chartData", "csv", "markdown")]


def frame_texts(frames, ids):
    """Texts of a document's frames (leaves), in their order, frames inside frames resolved.

    ``ids`` are the frames' numbers. A round renders the frames whose text may still change, from the texts of the round before; a frame
    whose references are all settled is settled. A chain of references cannot be longer than a document has frames; one that goes
    in a circle is cut there.
    """

    def part(i):
        kind = i["type"]
        fixed = F.when(kind == "chart", chart_md(i)).when(kind == "equation", equation_text(i["rawMath"]))
        return F.struct(
            kind.alias("kind"), fixed.alias("fixed"), F.when(kind == "table", _cells(i["cells"], ids)).alias("cells"),
            F.when(kind == "shape", _all_pieces(i["para"], ids)).alias("paras"),
        )

    def places(paras):
        return F.filter(F.transform(F.flatten(paras), lambda i: i["frame"]), lambda n: n.isNotNull())

    def references(parts):
        def of_part(p):
            cells = F.flatten(F.transform(p["cells"], lambda c: places(c["paras"])))
            return F.concat(F.coalesce(places(p["paras"]), _none("int")), F.coalesce(cells, _none("int")))

        return F.array_distinct(F.flatten(F.transform(parts, of_part)))

    def shown(parts, texts):
        def of_part(p):
            return F.when(p["kind"] == "table", _table(p["cells"], texts)).when(p["kind"] == "shape", _paragraphs(p["paras"], texts)).otherwise(p["fixed"])

        return F.array_join(F.filter(F.transform(parts, of_part), lambda t: F.length(t) > 0), "\n\n")

    def resolved(made):
        def next_round(state, _):
            def each(f, n):
                settled = F.get(state["settled"], n)
                text = F.when(settled, F.get(state["texts"], n)).otherwise(shown(f["parts"], state["texts"]))
                return F.struct(text.alias("text"), (settled | F.forall(f["refs"], lambda r: F.get(state["settled"], r))).alias("settled"))

            def split(rows):
                return F.struct(F.transform(rows, lambda r: r["text"]).alias("texts"), F.transform(rows, lambda r: r["settled"]).alias("settled"))

            return F.when(F.forall(state["settled"], lambda x: x), state).otherwise(X.let(F.transform(made, each), split))

        start = F.struct(F.transform(made, lambda f: F.lit("")).alias("texts"), F.transform(made, lambda f: F.lit(False)).alias("settled"))
        return F.aggregate(F.sequence(F.lit(0), F.size(F.array_distinct(ids))), start, next_round, lambda state: state["texts"])

    made = F.transform(
        frames, lambda f: X.let(F.transform(f["leaves"], part), lambda parts: F.struct(parts.alias("parts"), references(parts).alias("refs")))
    )
    return X.let(made, resolved)


def word_body_md(docs):
    """Word-processor documents: title, page markers, paragraphs with their frames, labelled columns."""
    shapes = lambda i: i["shapes"]
    none = _none("string")

    def read(chosen):
        # only whole-number ids count; a document's last frame of an id comes first and is the one that is found
        numbered = F.reverse(F.filter("d.frames", lambda f: f["ID"].try_cast("int").isNotNull()))
        leaves = F.transform(numbered, lambda f: F.struct(f["ID"].try_cast("int").alias("id"), opened(F.array(f), shapes, _frame_leaf).alias("leaves")))
        name = F.coalesce(F.nullif(F.col("d.metadata.coreProperties.title"), F.lit("")), F.nullif(F.col("d.docName"), F.lit("")))
        return _parsed(chosen, "body", WORD).select("doc_id", name.alias("name"), F.col("d.body").alias("body"), leaves.alias("frames"))

    def again(rows):
        leaves = F.transform("frames", lambda f: F.struct(f["id"].alias("id"), opened_again(f["leaves"], FRAME, shapes, _frame_leaf).alias("leaves")))
        return rows.withColumn("frames", leaves)

    def pages(ids, texts):
        def paragraphs(para):
            return _paragraphs(_all_pieces(para, ids), texts)

        def column(c):
            label = F.concat(F.lit("\n[Column "), F.coalesce(c["colNum"], F.lit("0")), F.lit("]\n"))
            return F.array(label, paragraphs(c["para"]))

        def page(p):
            marker = F.concat(F.lit("\n--- Page "), F.coalesce(p["pageInfo"]["pageNum"], F.lit("0")), F.lit(" ---\n"))
            own = F.when(p["para"].isNotNull(), F.array(paragraphs(p["para"]))).otherwise(none)
            columns = F.flatten(F.transform(F.filter(p["col"], lambda c: c["para"].isNotNull()), column))
            return F.concat(F.array(marker), own, F.coalesce(columns, none))

        return F.flatten(F.transform("body", page))

    rows = in_rounds(docs, read, F.exists("frames", lambda f: _unopened(f["leaves"])), again)
    ids = F.coalesce(F.transform("frames", lambda f: f["id"]), _none("int"))
    body = X.let(ids, lambda i: X.let(F.coalesce(frame_texts(F.col("frames"), i), none), lambda texts: pages(i, texts)))
    title = F.when(F.col("name").isNotNull(), F.array(F.concat(F.lit("# "), "name", F.lit("\n")))).otherwise(none)
    return rows.select("doc_id", F.array_join(F.concat(title, F.coalesce(body, none)), "\n").alias("markdown"))


def to_markdown(docs):
    """Markdown of every document by its kind; unknown kinds get the fixed message.

    Every kind reads the documents by itself, so give it stored ``tagged`` documents.
    """
    other = _of_kind(docs, "other").select("doc_id", F.lit(S.UNSUPPORTED_DOCUMENT).alias("markdown"))
    return sheets_md(docs).union(pdf_pages_md(docs)).union(slides_md(docs)).union(word_body_md(docs)).union(other)
