"""Bulk text from templates: placeholders and repeated paragraphs."""

from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X


def paragraph_lines(lines):
    """One styled paragraph per line of an ARRAY<STRING>."""
    return F.array_join(
        F.transform(lines, lambda t: F.concat(F.lit(S.LINE_PARAGRAPH_OPEN), t, F.lit(S.LINE_PARAGRAPH_CLOSE))), ""
    )


def marked_items(items, has_attachment):
    """ARRAY<STRUCT<text, level>> with the end mark on the last item, or alone if there are no items."""
    alone = F.array(F.struct(F.lit(S.END_MARK).alias("text"), F.lit(1).alias("level")))

    def mark(held):
        last = F.size(held) - 1
        marked = F.transform(
            held,
            lambda it, i: F.struct(
                F.when((i == last) & ~has_attachment, F.concat(it["text"], F.lit(S.LAST_ITEM_SUFFIX)))
                .otherwise(it["text"]).alias("text"),
                it["level"].cast("int").alias("level"),
            ),
        )
        return F.when((F.size(held) == 0) & ~has_attachment, alone).otherwise(marked)

    return X.let(items, mark)


def paragraph_items(items, has_attachment):
    """Styled paragraphs of marked items; level 1 has its own style."""

    def paragraph(it):
        top = F.coalesce(it["level"], F.lit(1)) == 1
        (para, style), (para_in, style_in) = S.ITEM_STYLE_TOP, S.ITEM_STYLE_NESTED
        return F.concat(
            F.lit('<hp:p id="0" paraPrIDRef="'), F.when(top, para).otherwise(para_in),
            F.lit('" styleIDRef="'), F.when(top, style).otherwise(style_in),
            F.lit('"><hp:run charPrIDRef="19"><hp:t>'), it["text"], F.lit(S.ITEM_PARAGRAPH_CLOSE),
        )

    return F.array_join(F.transform(marked_items(items, has_attachment), paragraph), "")


def replace_block(text, marker, block, open_tag=S.ITEM_PARAGRAPH_TAG, close_tag=S.PARAGRAPH_END_TAG):
    """Put ``block`` in place of the paragraph that encloses ``marker``; unchanged where there is none."""

    def cut(s):
        before = F.substring_index(s, marker, 1)
        head_length = F.length(before) - F.length(F.substring_index(before, open_tag, -1)) - len(open_tag)
        rest = F.substring(s, F.length(before) + 1, F.length(s))
        closing = F.instr(rest, close_tag)
        tail = F.substring(rest, closing + len(close_tag), F.length(rest))
        found = (F.instr(s, marker) > 0) & F.contains(before, F.lit(open_tag)) & (closing > 0)
        return F.when(found, F.concat(F.substring(s, F.lit(1), head_length), block, tail)).otherwise(s)

    return X.let(text, cut)


def render_memo(template, pairs, lines):
    """Placeholders, then one paragraph per line at the content marker."""
    filled = X.fill_placeholders(template, pairs)
    return replace_block(filled, "{{CONTENT}}", paragraph_lines(lines), S.LINE_PARAGRAPH_TAG)


def render_report(template, pairs, items, has_attachment):
    """Placeholders, then the same item block at both content markers."""
    filled = X.fill_placeholders(template, pairs)

    def place(block):
        return replace_block(replace_block(filled, "{{CONTENT}}", block), "{{CONTENT_2}}", block)

    return X.let(paragraph_items(items, has_attachment), place)
