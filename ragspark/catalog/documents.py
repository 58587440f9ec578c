"""Document JSON and cell tables to markdown, HTML to text, bullets."""

from pyspark.sql import functions as F

from ragspark.catalog import common as C
from ragspark.functions import text as X
from ragspark.operators import docjson, grids

QUERIES, ORACLE = {}, {}


def sheet_cells(spark, folder):
    """Each order is a sheet: line numbers are rows, three measures are columns 0, 1 and 3."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("col"), F.col(v).cast("string").alias("value"))
            for c, v in ((0, "l_partkey"), (1, "l_returnflag"), (3, "l_suppkey"))
        ]
    )
    return C.table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("row"), F.explode(cells).alias("c")
    ).select("l_orderkey", "row", "c.col", F.concat("c.value", F.lit("|x\ny")).alias("value"), F.col("c.col").alias("seq"))


# a line number can repeat within an order: the larger text is taken as the later cell in both forms
def sheet_grid(spark, folder):
    cells = sheet_cells(spark, folder).withColumn("seq", F.struct("value"))
    return grids.sheet_grid(cells, ["l_orderkey"])


SQL_CELLS = """
WITH cell AS (
  SELECT l_orderkey, l_linenumber AS r, max(l_partkey::VARCHAR || '|x' || chr(10) || 'y') AS a,
    max(l_returnflag || '|x' || chr(10) || 'y') AS b, max(l_suppkey::VARCHAR || '|x' || chr(10) || 'y') AS d
  FROM lineitem GROUP BY ALL),
first AS (SELECT l_orderkey, min(r) AS lo, max(r) AS hi FROM cell GROUP BY ALL)
"""


def merged_cells(spark, folder):
    """Each order is a table: line n stands at row n - 1, column (part mod 3), and spans 2 x 2."""
    return C.table(spark, folder, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("row"), (F.col("l_partkey") % 3).cast("int").alias("col"),
        F.lit(2).alias("rowspan"), F.lit(2).alias("colspan"),
        F.concat("l_returnflag", F.lit("|"), F.col("l_partkey").cast("string")).alias("text"),
        F.concat("l_returnflag", F.lit("|"), F.col("l_partkey").cast("string")).alias("seq"),
    )


def cell_grid(spark, folder):
    return grids.cell_grid(merged_cells(spark, folder), ["l_orderkey"])


def csv_tables(spark, folder):
    csv = F.concat(
        F.lit(' "name" , price|usd\n'), "p_name", F.lit(","), F.col("p_partkey").cast("string"), F.lit(', "'), "p_brand", F.lit('"\n')
    )
    return C.table(spark, folder, "part").select("p_partkey", csv.alias("csv"))


def pdf_documents(spark, folder):
    """Each document is one JSON value: one page per line, then a page with a table, a chart and an equation."""
    def content(kind, **fields):
        return F.struct(F.lit(kind).alias("type"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("content"))

    def raw(kind, body):
        return F.concat(F.lit('{"type":"' + kind + '","content":'), body, F.lit("}"))

    def line(t, i):
        body = F.to_json(F.struct(t.alias("text")))
        return F.concat(F.lit('{"pageNum":'), (i + 1).cast("string"), F.lit(',"contents":['), raw("text", body), F.lit("]}"))

    source = F.col("source")
    last = F.concat(
        F.lit('{"pageNum":0,"contents":['),
        raw("table", F.to_json(F.struct(F.concat(F.lit("<table>"), source, F.lit("</table>")).alias("html")))), F.lit(","),
        raw("chart", F.to_json(F.struct(source.alias("name"), F.lit("a,b\n1,2").alias("csv"), F.struct(F.lit("T").alias("title")).alias("chartData")))),
        F.lit(","), raw("equation", F.lit('{"rawMath":{"format":"LaTeX","value":"x^2"}}')), F.lit(","),
        raw("equation", F.lit('{"rawMath":"y=z"}')), F.lit("]}"),
    )
    pages = F.array_join(F.transform(F.split("text", "\n"), line), ",")
    return C.table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit('{"docName":"'), source, F.lit('","pages":['), pages, F.lit(","), last, F.lit("]}")).alias("json")
    )


def sheet_documents(spark, folder):
    """Each customer is a workbook: a sheet of one row of figures with a chart, a table and an equation."""
    body = F.concat(
        F.lit('{"docName":"'), "c_name", F.lit('","sheets":[{"sheetName":"'), "c_mktsegment",
        F.lit('","rows":[{"row":3,"cols":[{"col":0,"value":'), F.col("c_custkey").cast("string"),
        F.lit('},{"col":2,"value":"a|b"}]},{"row":1,"cols":[]}],"objects":{"charts":[{"name":"only"},{"chartData":{"chartType":"bar","csv":"h\\n1"}}],'
              '"tables":[{"name":"n1","csv":"p,q\\n1,2"},{"name":"nocsv"}],"equations":[{"rawMath":{"format":"omml","value":"e"}}]}},{"sheetName":"empty"}]}'),
    )
    return C.table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), body.alias("json"))


def _paragraph(*parts):
    """JSON of a paragraph of texts (columns) and references to frames (numbers)."""
    made = [F.to_json(F.struct(p.alias("text"))) if not isinstance(p, int) else F.lit(f'{{"objectID":{{"kind":"s","shapeID":{p}}}}}') for p in parts]
    return F.concat(F.lit('{"content":['), F.concat_ws(",", *made), F.lit("]}"))


def slide_documents(spark, folder):
    """Each document is a deck of one slide: its source, its text inside up to ten groups, and its language."""
    def shape(c):
        return F.concat(F.lit('{"type":"shape","shape":{"para":['), _paragraph(c), F.lit("]}}"))

    def grouped(inner, _):
        return F.concat(F.lit('{"type":"group","group":{"shapes":['), inner, F.lit("]}}"))

    depth = (F.col("doc_id") % 11).cast("int")
    levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    deep = F.aggregate(levels, shape(F.col("text")), grouped)
    return C.table(spark, folder, "documents").select("doc_id", F.concat(
        F.lit('{"summary_info":{"docName":"'), "source", F.lit('"},"slide":[{"slide_number":3,"note":"'), "lang",
        F.lit('","contents":['), shape(F.col("source")), F.lit(","), deep, F.lit(","), shape(F.col("lang")), F.lit("]}]}"),
    ).alias("json"))


def word_documents(spark, folder):
    """Each document is a page whose paragraph shows a frame, which shows the next of five, the last with the text."""
    def frame(number, content):
        return F.concat(F.lit(f'{{"ID":{number},"type":"shape","para":['), content, F.lit("]}"))

    chain = [frame(k, _paragraph(F.lit(f"f{k} "), k + 1)) for k in range(1, 5)] + [frame(5, _paragraph(F.col("text")))]
    return C.table(spark, folder, "documents").select("doc_id", F.concat(
        F.lit('{"docName":"'), "source", F.lit('","frames":['), F.concat_ws(",", *chain),
        F.lit('],"body":[{"pageInfo":{"pageNum":2},"para":['), _paragraph(F.concat("lang", F.lit(": ")), 1), F.lit("]}]}"),
    ).alias("json"))


QUERIES.update(
    slides_md=lambda s, d: docjson.slides_md(slide_documents(s, d)),
    word_body_md=lambda s, d: docjson.word_body_md(word_documents(s, d)),
    html_to_text=lambda s, d: C.table(s, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text")),
    validate_bullets=lambda s, d: C.table(s, d, "documents").select("doc_id", X.validate_bullets(F.col("text")).alias("text")),
    sheet_grid_md=sheet_grid,
    cell_grid_md=cell_grid,
    csv_to_md=lambda s, d: csv_tables(s, d).select("p_partkey", grids.csv_to_md(F.col("csv")).alias("md")),
    pdf_pages_md=lambda s, d: docjson.pdf_pages_md(pdf_documents(s, d)),
    sheets_md=lambda s, d: docjson.sheets_md(sheet_documents(s, d)),
    doc_kind=lambda s, d: pdf_documents(s, d).union(sheet_documents(s, d)).groupBy(
        docjson.doc_kind(F.col("json")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    chart_md=lambda s, d: C.table(s, d, "part").select(
        "p_partkey",
        docjson.chart_md(
            F.struct(
                F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(",1"))).alias("csv"),
                F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("markdown"),
                F.struct(F.lit("").alias("title"), F.when(F.col("p_partkey") % 5 == 0, F.lit("bar")).alias("chartType"),
                         F.lit("z").alias("csv"), F.lit(None).cast("string").alias("markdown")).alias("chartData"),
            )
        ).alias("md"),
    ),
    equation_text=lambda s, d: C.table(s, d, "part").select(
        "p_partkey",
        docjson.equation_text(
            F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))
            .when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(F.lit("LATEX").alias("format"), F.col("p_name").alias("value"))))
            .otherwise(F.to_json(F.struct(F.lit("omml").alias("format"), F.col("p_name").alias("value"))))
        ).alias("text"),
    ),
)

NL = "chr(10)"
SQL_LAST_PAGE = """chr(10) || '--- Page 0 ---' || chr(10) || chr(10) || chr(10) || chr(10) || '<table>' || source || '</table>' || chr(10)
  || chr(10) || chr(10) || chr(10) || '### Chart: ' || source || chr(10) || chr(10) || '**T**' || chr(10) || chr(10) || chr(10)
  || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || chr(10) || '$x^2$'
  || chr(10) || chr(10) || '[Equation: y=z]'"""
SQL_SHOWN = f"CASE WHEN {C.sql_strip('text')} = '' THEN '' ELSE text END"
ORACLE.update(
    slides_md=f"""SELECT doc_id, '# ' || source || chr(10) || chr(10) || chr(10) || '--- Slide 3 ---' || chr(10) || chr(10) || '> **Note:** ' || lang || chr(10) || chr(10)
  || source || chr(10) || chr(10) || CASE WHEN {SQL_SHOWN} = '' THEN '' ELSE text || chr(10) || chr(10) END || lang AS markdown FROM documents""",
    word_body_md=f"""SELECT doc_id, '# ' || source || chr(10) || chr(10) || chr(10) || '--- Page 2 ---' || chr(10) || chr(10)
  || lang || ': f1 f2 f3 f4 ' || {SQL_SHOWN} AS markdown FROM documents""",
    html_to_text=f"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|title)\\b[^>]*>', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t FROM c)
SELECT page_id, {C.sql_strip("regexp_replace(t, '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g')")} AS text FROM d""",
    validate_bullets=f"""
WITH l AS (
  SELECT doc_id, text, list_filter(list_transform(string_split_regex({C.sql_strip('text')}, '\\r\\n|[\\n\\r]'), lambda x: {C.sql_strip('x')}), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) = 0 THEN text WHEN starts_with(ls[1], '- ') THEN array_to_string(ls, chr(10))
  ELSE array_to_string(list_transform(ls, lambda x: CASE WHEN starts_with(x, '- ') THEN x ELSE '- ' || x END), chr(10)) END AS text FROM l""",
    sheet_grid_md=SQL_CELLS + """
SELECT l_orderkey, r AS row, replace(replace('| ' || replace(a, '|', '¦') || ' | ' || replace(b, '|', '¦') || ' |  | ' || replace(d, '|', '¦') || ' |', chr(10), '<br>'), '¦', '\\|')
  || CASE WHEN r = lo THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END AS line
FROM cell JOIN first USING (l_orderkey)""",
    cell_grid_md="""
WITH cell AS (
  SELECT l_orderkey, l_linenumber - 1 AS r, l_partkey % 3 AS c, max(l_returnflag || '\\|' || l_partkey) AS text FROM lineitem GROUP BY ALL),
size AS (SELECT l_orderkey, max(r) + 1 AS last, max(c) + 2 AS width FROM cell GROUP BY ALL),
place AS (
  SELECT l_orderkey, width, unnest(range(0, last + 1)) AS r FROM size),
wide AS (SELECT *, unnest(range(0, width)) AS c FROM place)
SELECT l_orderkey, wide.r::INT AS row, '| ' || string_agg(coalesce(text, ''), ' | ' ORDER BY c) || ' |' ||
  CASE WHEN wide.r = 0 THEN chr(10) || '|' || repeat(' --- |', any_value(width)) ELSE '' END AS line
FROM wide LEFT JOIN cell USING (l_orderkey, r, c) GROUP BY l_orderkey, wide.r""",
    csv_to_md="""SELECT p_partkey, chr(10) || '| name | price\\|usd |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | '
  || p_partkey || ' | ' || p_brand || ' |' || chr(10) AS md FROM part""",
    pdf_pages_md=f"""
WITH line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
page AS (
  SELECT doc_id, string_agg(chr(10) || '--- Page ' || i || ' ---' || chr(10) || CASE WHEN t = '' THEN '' ELSE chr(10) || chr(10) || t END,
    chr(10) || chr(10) ORDER BY i) AS body FROM line GROUP BY ALL)
SELECT doc_id, '# ' || source || chr(10) || chr(10) || chr(10) || body || chr(10) || chr(10) || {SQL_LAST_PAGE} AS markdown
FROM documents JOIN page USING (doc_id)""",
    sheets_md="""SELECT c_custkey AS doc_id, '# ' || c_name || chr(10) || chr(10) || chr(10) || '## Sheet: ' || c_mktsegment || chr(10) || chr(10)
  || chr(10) || '|  |  |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || c_custkey || ' |  | a\\|b |' || chr(10) || chr(10)
  || chr(10) || '### Chart: Chart' || chr(10) || chr(10) || 'Type: bar' || chr(10) || chr(10)
  || chr(10) || '| h |' || chr(10) || '| --- |' || chr(10) || '| 1 |' || chr(10) || chr(10)
  || chr(10) || '### n1' || chr(10) || chr(10) || chr(10) || '| p | q |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10)
  || '[Equation: e]' || chr(10) || chr(10) || '## Sheet: empty' || chr(10) AS markdown FROM customer""",
    doc_kind="SELECT 'pages' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'sheets', count(*) FROM customer",
    chart_md="""SELECT p_partkey, chr(10) || '### Chart: ' || p_name || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || 'Type: bar' || chr(10) ELSE '' END
  || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '| ' || p_brand || ' | 1 |' || chr(10) || '| --- | --- |' || chr(10)
    ELSE chr(10) || '| z |' || chr(10) || '| --- |' || chr(10) END
  || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || p_type ELSE '' END AS md FROM part""",
    equation_text="""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN '$' || p_name || '$' ELSE '[Equation: ' || p_name || ']' END AS text FROM part""",
)
