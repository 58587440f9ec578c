"""Quality rules whose thresholds follow the data.

Every text is measured once (words, their characters, symbols, repeated lines, words in repeated windows). Per language
and source, KLL quantile sketches of the derived rates are built in every task and merged; a rate may lie so many times
the spread of the group's middle beyond its quartiles. Thresholds are joined back to the measured rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark.llm import words as T
from ragspark.llm.shared import BROADCAST_ROWS, saved

WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Spreads beyond the quartile, and the least spread of each rate: what a group of clean texts may vary by.
SPREADS = 6.0
RATES = {"mean_chars": 0.25, "symbol_rate": 0.03, "dup_line_rate": 0.08, "repeat_rate": 0.05}
BOTH_SIDES = ("mean_chars",)
#: Groups with fewer texts use the sketch of their language, then of all.
LEAST_TEXTS = 100

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(w):
    """Per row how many of its words lie in a window that occurs in the row at least twice."""
    n = len(w.hash)
    h, row = w.windows(WINDOW), w.row_of_word()
    whole = np.arange(n) + WINDOW <= w.row[1:][row] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    key = T.mix(h[at] + T.mix(row[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n + WINDOW, np.int64)
    for k in range(WINDOW):
        inside[at[twice] + k] = 1
    total = np.zeros(n + 1, np.int64)
    np.cumsum(inside[:n], out=total[1:])
    return total[w.row[1:]] - total[w.row[:-1]]


def lines(data, offsets, w):
    """Per row its lines with a word, and how many of them equal an earlier line of the row."""
    n = len(data)
    end = np.unique(np.concatenate((np.flatnonzero(data == 10), offsets[1:])))
    start = np.concatenate(([0], end[:-1]))
    start = start + ((start < n) & (data[np.minimum(start, max(n - 1, 0))] == 10) & (start < end)) if n else start
    start = np.minimum(start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(w.start, start)
    has = (first < len(w.start)) & (np.append(w.start, n)[np.minimum(first, len(w.start))] < end)
    start, end, row = start[has], end[has], row[has]
    up, down = T.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(T.BYTE_CODE[data] * up[:n], out=total[1:])
    key = T.mix((total[end] - total[start]) * down[start] + T.mix(row.astype(np.uint64) + np.uint64(1)))
    _, once = np.unique(key, return_index=True)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    return count, count - np.bincount(row[once], minlength=rows)


def measure(column):
    """The six measures of every row of a text column, as arrays."""
    out = np.zeros((6, len(column)), np.int64)
    for first, data, offsets in T.slices(column):
        w = T.Words(data, offsets, folded=False)
        span = slice(first, first + len(offsets) - 1)
        out[0, span] = np.diff(w.row)
        follows = (data & 0xC0) == 0x80
        for k, mark in ((1, ~T.SPACE[data] & ~follows), (2, _SYMBOL[data])):
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(mark, out=total[1:])
            out[k, span] = total[offsets[1:]] - total[offsets[:-1]]
        out[3, span], out[4, span] = lines(data, offsets, w)
        out[5, span] = repeated_words(w)
    return out


def measured(docs, doc_id="doc_id", text="text", lang="lang", source="source"):
    """doc_id, lang, source, the measures, base_failed and the rates of every row; null and empty texts have no word."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *map(pa.array, measure(b.column(3)))], names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])

    rows = docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(lang), F.lit("")), F.coalesce(F.col(source), F.lit("")), F.col(text))
    rows = rows.mapInArrow(run, f"doc_id long, lang string, source string, {MEASURES}")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.select(
        "*", failed.alias("base_failed"), per("word_chars", "n_words").alias("mean_chars"), per("n_symbols", "n_words").alias("symbol_rate"),
        per("n_dup_lines", "n_lines").alias("dup_line_rate"), per("n_repeat_words", "n_words").alias("repeat_rate"),
    )


def thresholds(rows):
    """(lang, source, low and high bound of every rate), with a row for each language and one for all as fallbacks.

    One sketch per group and rate over all rows that pass the base rules; coarser groups merge the finer ones' sketches.
    """
    sketches = saved(
        rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(r).alias(r) for r in RATES)), "sketches"
    )
    bounds = []
    for by in (["lang", "source"], ["lang"], []):
        merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(r).alias(r) for r in RATES)).where(F.col("n") >= (LEAST_TEXTS if by else 1))
        columns = [F.col(k) for k in by] + [F.lit(None).cast("string").alias(k) for k in ("lang", "source")[len(by):]]
        for r, least in RATES.items():
            low, high = (F.kll_sketch_get_quantile_double(r, F.lit(q)) for q in (0.25, 0.75))
            spread = SPREADS * F.greatest(high - low, F.lit(least))
            columns += [(low - spread if r in BOTH_SIDES else F.lit(float("-inf"))).alias(f"{r}_low"), (high + spread).alias(f"{r}_high")]
        bounds.append(merged.select(*columns))
    return bounds


def judged(docs, **columns):
    """doc_id, n_words, the measures, base_failed and kept of every row; repeated rows are judged each.

    A group without enough texts takes its language's thresholds, then those of all texts; without any text that passes
    the base rules nothing is kept. Null languages and sources count as the empty name. Other columns are not read.
    """
    rows = saved(measured(docs, **columns), "measured")
    groups, langs, all_ = thresholds(rows)
    sent = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    named = lambda df, tag: df.select(*("lang source".split()), *(F.col(c).alias(f"{c}{tag}") for c in df.columns[2:]))
    groups, langs = saved(named(groups, "_0"), "bounds"), saved(named(langs, "_1").drop("source"), "bounds")
    whole = saved(named(all_, "_2").drop("lang", "source"), "bounds").collect()
    out = rows.join(sent(groups), ["lang", "source"], "left").join(sent(langs), "lang", "left")
    fine = F.lit(True)
    for r in RATES:
        for side in ("low", "high"):
            last = F.lit(whole[0][f"{r}_{side}_2"] if whole else None).cast("double")
            bound = F.coalesce(F.col(f"{r}_{side}_0"), F.col(f"{r}_{side}_1"), last)
            fine = fine & (F.col(r) >= bound if side == "low" else F.col(r) <= bound)
    kept = ~F.col("base_failed") & F.coalesce(fine, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lang", "source", *RATES)
