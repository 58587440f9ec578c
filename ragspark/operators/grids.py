"""Tables of cells to markdown lines."""

from pyspark.sql import functions as F

from ragspark.functions import text as X
from ragspark.operators import skew


def _row(values):
    return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))


def _rule(width):
    return _row(F.array_repeat(F.lit("---"), width))


def _lines(values, extents, keys, width, first):
    """Dense markdown line per (keys, row); the first line carries the rule under it."""
    cells = F.transform(
        F.sequence(F.lit(0), F.col(width) - 1), lambda c: F.coalesce(F.element_at("_values", c), F.lit(""))
    )
    line = _row(cells)
    joined = skew.salted_join(
        values, extents, keys, skew.hot_keys(extents, keys, "_n"), spread=["row"]
    )
    ruled = F.when(F.col("row") == F.col(first), F.concat(line, F.lit("\n"), _rule(F.col(width)))).otherwise(line)
    return joined.select(*keys, "row", ruled.alias("line"))


def _row_values(cells, keys):
    """One map of column to text per row; the last cell written to a place wins. Cells are dealt by row once, for both steps."""
    last = cells.repartition(*keys, "row").groupBy(*keys, "row", "col").agg(F.max_by("text", "seq").alias("text"))
    return last.groupBy(*keys, "row").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "text")))).alias("_values")
    )


def escape_value(c):
    """Sheet values: line ends first, then pipes."""
    return F.replace(F.replace(c, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def sheet_grid(cells, keys):
    """Markdown lines of sheets: rows ascending with gaps skipped, columns dense from 0.

    ``cells(keys, row, col, value, seq)``; a row without cells has one row with a null ``col``.
    """
    keys = list(keys)
    texts = cells.select(*keys, "row", "col", "seq", escape_value(F.coalesce("value", F.lit(""))).alias("text"))
    extents = texts.groupBy(*keys).agg(
        (F.coalesce(F.max("col"), F.lit(0)) + 1).alias("_width"), F.min("row").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )
    return _lines(_row_values(texts, keys), extents, keys, "_width", "_first")


def cell_grid(cells, keys):
    """Markdown lines of tables with merged cells: rows and columns dense, places under a span empty.

    ``cells(keys, row, col, rowspan, colspan, text, seq)``. A span only widens the extent: a real cell wins over
    the filler of a span wherever it stands, so the fillers need no rows of their own.
    """
    keys = list(keys)
    spans = (F.col("rowspan") >= 1) & (F.col("colspan") >= 1)
    last_row = F.when(spans, F.col("row") + F.col("rowspan") - 1).otherwise(F.col("row"))
    last_col = F.when(spans, F.col("col") + F.col("colspan") - 1).otherwise(F.col("col"))
    extents = cells.groupBy(*keys).agg(
        (F.max(last_col) + 1).alias("_width"), F.max(last_row).alias("_last"), F.count(F.lit(1)).alias("_n")
    ).withColumn("_first", F.lit(0))
    escaped = cells.withColumn("text", F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    every = extents.select(*keys, F.explode(F.sequence(F.lit(0), "_last")).alias("row"))
    values = every.join(_row_values(escaped.select(*keys, "row", "col", "seq", "text"), keys), [*keys, "row"], "left")
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    return _lines(values.withColumn("_values", F.coalesce("_values", empty)), extents, keys, "_width", "_first")


def table_of(cells):
    """Whole markdown table of an array of cells (row, col, rowspan, colspan, text), as ``cell_grid`` makes it; null without cells.

    For tables inside one document value. Fillers and cells are sorted by place, and the last of each place stays.
    """

    def end(at, span):
        return F.array_max(F.transform(cells, lambda c: F.when((c["rowspan"] >= 1) & (c["colspan"] >= 1), c[at] + c[span] - 1).otherwise(c[at])))

    def escaped(t):
        return F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))

    def table(size):
        width = size["width"]
        every = F.transform(F.sequence(F.lit(0), size["height"] * width - 1), lambda n: F.struct(n.alias("at"), F.lit(-1).alias("seq"), F.lit("").alias("text")))
        own = F.transform(
            F.filter(cells, lambda c: (c["row"] >= 0) & (c["col"] >= 0)),
            lambda c, n: F.struct((c["row"] * width + c["col"]).alias("at"), n.alias("seq"), escaped(c["text"]).alias("text")),
        )

        def line(texts, r):
            row = _row(F.slice(texts, r * width + 1, width))
            return F.when(r == 0, F.concat(row, F.lit("\n"), _rule(width))).otherwise(row)

        last = X.let(
            F.array_sort(F.concat(every, own)),
            lambda found: F.transform(F.filter(found, lambda c, n: ~c["at"].eqNullSafe(F.get(found, n + 1)["at"])), lambda c: c["text"]),
        )
        lines = X.let(last, lambda texts: F.transform(F.sequence(F.lit(0), size["height"] - 1), lambda r: line(texts, r)))
        return F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))

    size = F.struct(
        F.greatest(end("row", "rowspan") + 1, F.lit(1)).alias("height"), F.greatest(end("col", "colspan") + 1, F.lit(1)).alias("width")
    )
    return F.when(F.size(cells) > 0, X.let(size, table))


def table_text(lines, keys):
    """Whole markdown table per key, for tables that came out of one document value."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "line")))
    body = F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")
    return lines.groupBy(*keys).agg(F.concat(F.lit("\n"), body, F.lit("\n")).alias("table_md"))


def csv_to_md(csv):
    """Markdown of a simple comma-separated text; quotes are only stripped, as the reference does."""

    def row(r):
        return F.transform(
            F.split(r, ","), lambda c: F.replace(F.btrim(X.strip(c), F.lit('"')), F.lit("|"), F.lit("\\|"))
        )

    rows = F.transform(
        F.split(X.strip(csv), "\n"),
        lambda r, i: X.let(
            row(r),
            lambda cells: F.when(i == 0, F.concat(_row(cells), F.lit("\n"), _rule(F.size(cells)))).otherwise(_row(cells)),
        ),
    )
    table = F.concat(F.lit("\n"), F.array_join(rows, "\n"), F.lit("\n"))
    return F.when(F.coalesce(csv, F.lit("")) == "", F.lit("")).otherwise(table)
