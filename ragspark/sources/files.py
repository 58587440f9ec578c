"""File sources: corpora, chat logs, document JSON, listings."""

import csv
import io
import itertools
import os
import re
import uuid
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ragspark.functions import text as X
from ragspark.operators import skew
from ragspark.session import saved, small_files

# The columns of a chat log.
CHAT_COLUMNS = ("sTalkerName", "formatted_date", "sTalkerContent", "sOriginalFileName")


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def extension(name):
    return F.lower(X.strip(F.regexp_extract(name, r"[^.](\.[^./]*)$", 1)))


TEXT_FILES = (".md", ".txt", ".html", ".htm")


def _text(content):
    return pd.Series([None if c is None else decoded(bytes(c)) for c in content])


def _files(spark, path, room):
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = file_name(F.col("path"))
    folder = F.element_at(F.split("path", "/"), -2)
    return raw.select(
        (F.lit(room) if room is not None else folder).alias("invoke_id"), "path", name.alias("source"), extension(name).alias("ext"), "content"
    )


def read_corpus(spark, path, room=None):
    """One row per non-blank text file: invoke_id, source, ext, markdown.

    Markdown and text files are taken as they are, HTML is reduced to its text; UTF-8, else CP949. The room is the parent
    folder unless given. What cannot be read stands in ``rejected_files``.
    """
    decode = F.pandas_udf(_text, "string")
    named = _files(spark, path, room).where(F.col("ext").isin(*TEXT_FILES))
    named = named.select("invoke_id", "source", "ext", decode("content").alias("body")).where("body is not null")
    body = F.col("body")
    markdown = F.when(F.col("ext").isin(".html", ".htm"), X.html_to_text(body)).otherwise(body)
    return named.select("invoke_id", "source", "ext", markdown.alias("markdown")).where(~X.is_blank(F.col("markdown")))


def rejected_files(spark, path, room=None):
    """Files that ``read_corpus`` leaves out: invoke_id, path and the reason (kind, encoding or blank)."""
    decode = F.pandas_udf(_text, "string")
    kind = F.col("ext").isin(*TEXT_FILES)
    files = _files(spark, path, room).withColumn("body", decode(F.when(kind, F.col("content"))))
    plain = F.when(F.col("ext").isin(".html", ".htm"), X.html_to_text(F.col("body"))).otherwise(F.col("body"))
    reason = F.when(~kind, F.lit("kind")).when(F.col("body").isNull(), F.lit("encoding")).when(X.is_blank(plain), F.lit("blank"))
    return files.select("invoke_id", "path", reason.alias("reason")).where("reason is not null")


def list_room_files(spark, path, room):
    """Regular files of one room, oldest first, names breaking ties; empty for a missing room."""
    try:
        files = spark.read.format("binaryFile").load(f"{path}/{room}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string, modificationTime timestamp")
    return files.select(file_name(F.col("path")).alias("name"), "modificationTime").orderBy("modificationTime", "name")


def below(path, root):
    """A file's path below the folder that was read; ``root`` may hold patterns only if it is relative."""
    whole = urlsplit(root).path.rstrip("/")
    known = whole if whole.startswith("/") and not set("*?[{") & set(whole) else "/" + root.rstrip("/").split("/")[-1]
    return F.element_at(F.split(path, re.escape(known) + "/", 2), -1)


def decoded_uri(uri):
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def decoded(content):
    """Text of UTF-8 bytes (with or without BOM), else of CP949; None where neither fits."""
    for encoding in ("utf-8-sig", "cp949"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return None


def _local(spark, path):
    """A path as Python opens it, or None if it lies on no mounted file system."""
    if path.startswith("/"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + path
    found = re.fullmatch("file:(?://)?(/[^/].*)", path)
    return found and found[1]


def _write_files(root, head):
    """Writes (file, line) rows, sorted by file, below ``root``; gives the number of files begun in each batch."""

    def run(batches):
        name = out = passing = None
        folders = set()

        def close():
            out.close()
            os.replace(passing, f"{root}/{name}")

        for b in batches:
            begun = 0
            for file, rows in itertools.groupby(zip(*(c.to_pylist() for c in b.columns)), key=lambda r: r[0]):
                if file != name:
                    if out:
                        close()
                    name, begun = file, begun + 1
                    folder = os.path.dirname(f"{root}/{name}")
                    if folder not in folders:
                        os.makedirs(folder, exist_ok=True)
                        folders.add(folder)
                    passing = f"{folder}/_{uuid.uuid4().hex}"
                    out = open(passing, "wb")
                    out.write(f"{head}\n".encode())
                out.writelines(f"{line}\n".encode() for _, line in rows)
            yield pa.RecordBatch.from_pydict({"n": pa.array([begun], pa.int64())})
        if out:
            close()

    return run


def write_chat_csv(log, path):
    """Rows as CSV files below ``path``: ``file`` names the file of a row, ``row_seq`` its place there; every field is quoted.

    Tasks write a file as a stream under a passing name, which readers skip, and rename it when it is whole, so that a repeated task does no harm. Spark's
    own writer makes a folder per file: making and listing that costs as much as some thousand lines. It is left for paths that only Spark can open, where
    a file is the one in the folder ``file=<its name>``.
    """
    options = {"quoteAll": "true", "escape": '"', "lineSep": "\n"}
    ordered = log.repartition("file").sortWithinPartitions("file", F.col("row_seq").cast("long"))
    root = _local(log.sparkSession, path)
    if root is None:
        return ordered.write.partitionBy("file").options(header=True, **options).csv(path)
    fields = [c for c in log.columns if c != "file"]
    lines = ordered.select("file", F.to_csv(F.struct(*fields), options).alias("line"))
    os.makedirs(root, exist_ok=True)
    lines.mapInArrow(_write_files(root, ",".join(f'"{c}"' for c in fields)), "n long").agg(F.sum("n")).first()


# From the start of a field, or behind a quoted part: quoted parts, ends of fields, and plain parts up to the end of their field.
_OUTSIDE = re.compile(rb'(?:"[^"]*"|[,\r]|[^",\r][^,\r]*)*+')
_PIECE = ["file", "block"]
SCANNED = "file string, block long, line_no long, line binary, utf8 boolean, start0 boolean, start1 boolean, end0 boolean, end1 boolean"
FIELDS = "file string, block long, local long, fields array<string>"


def ends_inside(line, inside):
    """Whether a line of bytes that starts inside a quoted field, or outside, ends inside one.

    A quote opens a field only at its start; in CP949 no part of a character looks like a quote, comma or line end.
    """
    at = line.find(b'"') + 1 if inside else 0
    return inside and not at or _OUTSIDE.match(line, at).end() < len(line)


def _scan(batches):
    """Numbers the lines of every split and follows both cases: that it starts outside a quoted field, or inside."""
    piece, n, now = None, 0, (False, True)
    for b in batches:
        out = []
        for file, block, line, utf8 in zip(*(c.to_pylist() for c in b.columns)):
            if piece != (file, block):
                piece, n, now = (file, block), 0, (False, True)
                if block == 0 and line.startswith(b"\xef\xbb\xbf"):
                    line = line[3:]
            if b'"' in line:
                first = ends_inside(line, now[0])
                end = (first, first if now[0] == now[1] else ends_inside(line, now[1]))
            else:
                end = now
            out.append((file, block, n, line, utf8, *now, *end))
            n, now = n + 1, end
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.bool_()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in SCANNED.split(", ")])


def _placed(scanned):
    """Per split: whether it starts inside a quoted field, the first line that starts a record, the split before it
    in which one starts, and the file's encoding."""
    pieces = saved(
        scanned.groupBy(*_PIECE).agg(
            F.max_by(F.struct("end0", "end1"), "line_no").alias("end"), F.min(F.when(~F.col("start1"), F.col("line_no"))).alias("_first1"), F.min("utf8").alias("utf8"),
        ), "pieces",
    )
    to_here = W.partitionBy("file").orderBy("block")
    before = to_here.rowsBetween(W.unboundedPreceding, -1)
    # a split either fixes the state behind it, or swaps it, or leaves it: the last that fixes it and the swaps since decide
    swaps = F.sum((F.col("end.end0") & ~F.col("end.end1")).cast("long")).over(to_here)
    fixed = F.when(F.col("end.end0") == F.col("end.end1"), (F.col("end.end0").cast("long") + F.col("_swaps")) % 2)
    known = pieces.withColumn("_swaps", swaps).withColumn("_fixed", fixed)
    inside = (F.coalesce(F.last("_fixed", True).over(before), F.lit(0)) + F.coalesce(F.last("_swaps").over(before), F.lit(0))) % 2 == 1
    known = known.withColumn("inside", inside)
    first = F.when(F.col("inside"), F.col("_first1")).otherwise(F.lit(0))
    known = known.withColumn("first", first)
    owner = F.last(F.when(F.col("first").isNotNull(), F.col("block")), True).over(before)
    utf8 = F.min("utf8").over(W.partitionBy("file"))
    return known.select(*_PIECE, "first", owner.alias("owner"), utf8.alias("utf8"))


def _records(batches):
    """Records of lines that come sorted by file, split and place; a last row per split without fields counts them."""
    csv.field_size_limit(2**31 - 1)

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def text(lines, encoding, file):
        line = next(lines, None)
        while line is not None:
            after = next(lines, None)
            try:
                whole = line[-1].decode(encoding) + ("\n" if after is not None or not line[-1] else "")
            except UnicodeDecodeError:
                raise ValueError(f"neither UTF-8 nor CP949: {file}") from None
            yield from io.StringIO(whole, newline="")
            line = after

    def parsed():
        for (file, block, utf8), lines in itertools.groupby(rows(), key=lambda r: r[:3]):
            n = -1
            for n, fields in enumerate(csv.reader(text(lines, "utf-8" if utf8 else "cp949", file))):
                if fields:
                    yield file, block, n, fields
            yield file, block, n + 1, None

    found = parsed()
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    while part := list(itertools.islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=["file", "block", "local", "fields"])


def read_chat_csv(spark, path):
    """Rows of ``.csv`` chat logs with ``file`` (the path below ``path``) and ``row_seq``; UTF-8, else CP949.

    A file is read in splits by many tasks. A first pass follows quotes through the lines of each split, for both ways in which it may
    start; how each does start follows from one row per split. Lines of a record that begins in an earlier split go there, and
    each split's records are parsed in order as a stream, so that neither a file nor a long field limits anything. The
    first record of a file names its columns. Blank records are skipped but counted.
    """
    raw = spark.read.option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(path)
    lines = raw.select(below(decoded_uri(F.col("_metadata.file_path")), path).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"), F.is_valid_utf8("value"))
    with small_files(spark):
        scanned = saved(lines.mapInArrow(_scan, SCANNED), "lines")
    pieces = saved(_placed(scanned), "splits")
    few = skew.hot_keys(skew.count_keys(scanned, _PIECE), _PIECE, "_n")
    placed = skew.lookup_join(scanned.select(*_PIECE, "line_no", "line"), pieces, _PIECE, few, spread=["line_no"])
    own = F.when(F.col("line_no") >= F.col("first"), F.col("block")).otherwise(F.col("owner"))
    ordered = placed.withColumn("_own", own).repartition("file", "_own").sortWithinPartitions("file", "_own", "block", "line_no")
    records = saved(ordered.select("file", "_own", "utf8", "line").mapInArrow(_records, FIELDS), "records")

    counts = records.where("fields IS NULL").select(*_PIECE, "local")
    base = F.coalesce(F.sum("local").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = saved(counts.select(*_PIECE, base.alias("_base")), "starts")
    head = records.where("block = 0 AND local = 0").select("file", "fields")
    known = counts.select("file").distinct().join(head.where("fields IS NOT NULL"), "file", "left")
    wanted = F.array(*map(F.lit, CHAT_COLUMNS))
    absent = F.array_except(wanted, F.coalesce("fields", F.array().cast("array<string>")))
    wrong = F.raise_error(F.concat(F.lit("missing columns "), F.array_join(absent, ", "), F.lit(" in "), F.col("file"))).cast("array<int>")
    places = F.when(F.size(absent) > 0, wrong).otherwise(F.transform(wanted, lambda c: F.array_position("fields", c).cast("int")))
    heads = saved(known.select("file", places.alias("_at")), "headers")

    rows = records.where("fields IS NOT NULL AND NOT (block = 0 AND local = 0)")
    hot = skew.hot_keys(counts.groupBy("file").agg(F.sum("local").alias("_n")), ["file"], "_n")
    rows = skew.lookup_join(rows, heads, ["file"], hot, spread=["block", "local"])
    rows = skew.lookup_join(rows, starts, _PIECE, skew.hot_keys(counts, _PIECE, "local"), spread=["local"])
    columns = [F.coalesce(F.get("fields", F.get("_at", F.lit(k)) - 1), F.lit("")).alias(c) for k, c in enumerate(CHAT_COLUMNS)]
    return rows.select("file", (F.col("_base") + F.col("local")).alias("row_seq"), *columns)


# Converter output names in order of preference, then the pattern of any other.
DOC_JSON_NAMES = ("word_page_all.json", "pdf_page_all.json", "slide_page_all.json", "sheet_page_all.json")
DOC_JSON_PATTERN = "*_page_all.json"


def read_doc_json(spark, path):
    """Converted documents below ``path`` as (doc_id, json): one folder per document, its best-named output.

    A document is named by its folder's path below ``path``, so that rooms may hold folders of one name. The choice is
    made on file names alone; only the chosen files' text goes on.
    """
    options = {"pathGlobFilter": DOC_JSON_PATTERN, "recursiveFileLookup": "true"}
    known = F.array(*map(F.lit, DOC_JSON_NAMES))
    names = spark.read.format("binaryFile").options(**options).load(path).select(below(F.col("path"), path).alias("_file"))
    names = names.withColumn("doc_id", F.regexp_replace("_file", "/?[^/]*$", ""))
    place = F.array_position(known, file_name(F.col("_file")))
    order = F.when(place > 0, place).otherwise(len(DOC_JSON_NAMES) + 1)
    chosen = skew.latest(names.withColumn("_place", order), ["doc_id"], "_place", "_file").select("doc_id", "_file")
    texts = spark.read.options(**options).text(path, wholetext=True).select(
        F.input_file_name().alias("_uri"), F.col("value").alias("json")
    )
    file = below(decoded_uri(F.col("_uri")), path)
    return texts.select(file.alias("_file"), "json").join(chosen, "_file").select("doc_id", "json")
