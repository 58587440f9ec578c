"""String expressions: every function maps columns to a column and stays inside the JVM."""

from pyspark.sql import functions as F

from ragspark import settings as S

D = S.DEFAULTS


def let(value, body):
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(c):
    return F.btrim(c, F.lit(S.WHITESPACE))


def is_blank(c):
    return c.isNull() | (F.length(strip(c)) == 0)


def prefix(c, n):
    return F.substring(c, 1, n)


def literal_template(template, **values):
    """Fill ``{name}`` fields of a constant template with columns, in one pass."""
    parts, rest = [], template
    while rest:
        found = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, key = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[key])
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def chunk_id(source, page, text):
    return F.concat_ws("_", source, page.cast("string"), F.substring(F.md5(text.cast("binary")), 1, 12))


def format_chunk(source, page, keywords, text):
    head = F.concat(
        F.lit(f"[{S.CHUNK_HEADER_DOCUMENT}: "), source,
        F.lit(f" | {S.CHUNK_HEADER_PAGE}: "), page.cast("string"), F.lit("]\n"),
    )
    key_line = F.when(
        F.length(keywords) > 0, F.concat(F.lit(f"[{S.CHUNK_HEADER_KEYWORDS}: "), keywords, F.lit("]\n"))
    ).otherwise(F.lit(""))
    return F.concat(head, key_line, F.lit("\n"), text)


def clean_content(content, filename):
    """STRUCT<text, is_attachment>; opening FONT tags go, an attachment link becomes its label."""
    bare = F.regexp_replace(F.coalesce(content, F.lit("")), "<FONT[^>]*>", "")
    attached = bare.startswith(S.ATTACHMENT_SCHEME) & (F.length(F.coalesce(filename, F.lit(""))) > 0)
    label = F.concat(F.lit(f"[{S.ATTACHMENT_LABEL}: "), filename, F.lit("]"))
    return F.struct(
        strip(F.when(attached, label).otherwise(bare)).alias("text"),
        attached.alias("is_attachment"),
    )


def stamp_date(stamp):
    return F.split_part(stamp, F.lit(" "), F.lit(1))


def stamp_time(stamp):
    return F.split_part(stamp, F.lit(" "), F.lit(2))


def split_lines(c):
    """Pieces of ``c`` between line ends (CR LF, CR, LF and the other line ends of splitlines)."""
    return F.split(c, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]")


def validate_bullets(c):
    kept = F.filter(F.transform(split_lines(strip(c)), strip), lambda s: F.length(s) > 0)
    return let(
        kept,
        lambda ls: F.when(F.size(ls) == 0, c)
        .when(F.element_at(ls, 1).startswith("- "), F.array_join(ls, "\n"))
        .otherwise(
            F.array_join(
                F.transform(ls, lambda s: F.when(s.startswith("- "), s).otherwise(F.concat(F.lit("- "), s))),
                "\n",
            )
        ),
    )


def strip_code_fence(c):
    fence = "```"

    def close(body):
        cut = F.substring(body, F.lit(1), F.length(body) - 3)
        return F.when(body.endswith(fence), strip(cut)).otherwise(body)

    def open_(s):
        at = F.instr(s, "\n")
        body = F.when(at > 0, F.substring(s, at + 1, F.length(s))).otherwise(s)
        return F.when(s.startswith(fence), let(body, close)).otherwise(s)

    return let(strip(c), open_)


def normalize_rel_type(c):
    return F.upper(F.replace(c, F.lit(" "), F.lit("_")))


def history_line(role, content, chars=D.recent_chars):
    label = F.when(role == "user", F.lit(S.ROLE_LABEL_USER)).otherwise(F.lit(S.ROLE_LABEL_OTHER))
    return F.concat(label, F.lit(": "), prefix(content, chars))


def file_matches(source, name):
    """A null or empty name means no filter."""
    return is_null_or_empty(name) | F.contains(source, name) | F.contains(name, source)


def is_null_or_empty(c):
    return c.isNull() | (c == "")


def document_tag(source, page, content):
    return F.concat(
        F.lit('<document source="'), source, F.lit('" page="'), page.cast("string"), F.lit('">\n'),
        content, F.lit("\n</document>"),
    )


def edge_line(name, rel, neighbor, description, source):
    def text(c):
        return F.coalesce(c, F.lit("None"))

    return F.concat(
        F.lit("("), name, F.lit(") -["), text(rel), F.lit("]-> ("), text(neighbor), F.lit("): "),
        text(description), F.lit(" (Source: "), text(source), F.lit(")"),
    )


def transcript_of(a, b, c):
    """First non-empty of three response fields; the last one may be empty."""
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), c, F.lit(""))


def no_evidence_answer(question):
    return F.concat(F.lit("'"), question, F.lit("'" + S.NO_EVIDENCE_SUFFIX))


def fill_placeholders(text, pairs):
    """Replace ``{{KEY}}`` for each (KEY, column) pair in the given order; null becomes empty."""
    out = text
    for key, value in pairs:
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def html_to_text(c):
    """Visible text of a page: a stated replacement for a library converter."""
    out = F.regexp_replace(c, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|title)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, r"[ \t]*\n[ \t\n]*", "\n"))
