"""Page splitting and overlapping chunks.

Both run inside the row that holds the document, so a corpus of any size needs no shuffle. Long pages are
first cut into overlapping blocks in one pass, which keeps the work linear in the length of the page.
"""

import math

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X

D = S.DEFAULTS
BLOCK = 8192


def pages_of(markdown):
    """ARRAY<STRUCT<page, text>>: text before the first marker is page 1; blank pages are dropped."""
    pieces = F.split(markdown, S.PAGE_MARKER)
    numbers = F.regexp_extract_all(markdown, F.lit(S.PAGE_MARKER), F.lit(1))
    numbered = F.arrays_zip(
        pieces.alias("text"), F.concat(F.array(F.lit("1")), numbers).alias("page")
    )
    pages = F.transform(
        numbered,
        lambda p: F.struct(
            p["page"].try_cast("int").alias("page"), X.strip(p["text"]).alias("text")
        ),
    )
    return F.filter(pages, lambda p: p["page"].isNotNull() & (F.length(p["text"]) > 0))


def split_pages(docs, markdown="markdown"):
    """One row per non-blank page with its position ``page_seq``; other columns are kept."""
    keep = [c for c in docs.columns if c != markdown]
    return docs.select(*keep, F.posexplode(pages_of(F.col(markdown))).alias("page_seq", "p")).select(
        *keep, "page_seq", F.col("p.page").alias("page"), F.col("p.text").alias("text")
    )


def chunks_of(page_text, size=D.chunk_size, overlap=D.chunk_overlap):
    """ARRAY<STRING> of the stripped chunks of one page, blanks included as empty strings.

    A window of ``size`` characters ends at its last blank or newline when that lies beyond half the window;
    the next window starts ``overlap`` characters before that end.
    """
    half = size * 0.5
    least_step = math.floor(half) + 1 - overlap
    if least_step < 1:
        raise ValueError("overlap must be smaller than half the chunk size")
    block = max(BLOCK, size)

    def piece(blocks, start, n):
        at = start.cast("int")
        return F.substring(F.get(blocks, F.floor(at / block).cast("int")), at % block + 1, n)

    def window_end(blocks, length, start):
        window = piece(blocks, start, F.lit(size))
        after_last = X.let(
            window,
            lambda w: F.least(*[F.length(F.substring_index(w, mark, -1)) for mark in (" ", "\n")]),
        )
        whole = start + size
        cut = X.let(
            size - 1 - after_last,
            lambda at: F.when(at > half, start + at).otherwise(whole),
        )
        return F.when(whole < length, cut).otherwise(length)

    def walk(p):
        blocks, length = p["blocks"], p["length"]
        steps = F.sequence(F.lit(1), F.ceil(length / least_step).cast("int") + 1)
        nothing = F.array().cast("array<struct<s:int,e:int>>")

        def step(acc, _):
            def advance(end):
                return F.struct(
                    F.when(end < length, end - overlap).otherwise(length).alias("start"),
                    F.concat(
                        acc["cuts"], F.array(F.struct(acc["start"].alias("s"), end.alias("e")))
                    ).alias("cuts"),
                )

            return F.when(
                acc["start"] < length, X.let(window_end(blocks, length, acc["start"]), advance)
            ).otherwise(acc)

        start = F.struct(F.lit(0).alias("start"), nothing.alias("cuts"))
        cuts = F.aggregate(steps, start, step, lambda acc: acc["cuts"])
        return F.transform(cuts, lambda c: X.strip(piece(blocks, c["s"], c["e"] - c["s"])))

    length = F.length(page_text)
    overlapping = F.regexp_extract_all(
        page_text, F.lit(f"(?s)(?=(.{{1,{block + size}}})).{{1,{block}}}"), F.lit(1)
    )
    blocks = F.when(length <= block, F.array(page_text)).otherwise(overlapping)
    return X.let(F.struct(blocks.alias("blocks"), length.alias("length")), walk)


def chunk_text(pages, size=D.chunk_size, overlap=D.chunk_overlap, text="text"):
    """One row per non-blank chunk with its position ``chunk_seq`` in the page."""
    keep = [c for c in pages.columns if c != text]
    return (
        pages.select(*keep, F.posexplode(chunks_of(F.col(text), size, overlap)).alias("chunk_seq", text))
        .where(F.length(text) > 0)
    )


def identify_chunks(chunks, keywords=None):
    """Add the content-hash id and the formatted content that is embedded and stored."""
    words = F.lit("") if keywords is None else F.coalesce(F.col(keywords), F.lit(""))
    return chunks.withColumns(
        {
            "id": X.chunk_id(F.col("source"), F.col("page"), F.col("text")),
            "content": X.format_chunk(F.col("source"), F.col("page"), words, F.col("text")),
        }
    )


def corpus_stats(chunks, *keys):
    keys = keys or ("invoke_id", "source")
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_distinct("page").alias("n_pages"),
        F.sum(F.length("text")).alias("n_chars"),
    )
