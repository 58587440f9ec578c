"""Entity-relationship graph as two tables, built and searched with joins."""

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

from ragspark import settings as S
from ragspark.functions import text as X
from ragspark.operators import skew
from ragspark.session import saved

D = S.DEFAULTS
GRAPH_TYPE = (
    "entities array<struct<name:string,type:string,description:string>>,"
    "relationships array<struct<source:string,target:string,type:string,description:string>>"
)
#: Characters of the texts of one automaton, some hundred bytes each, and of the texts that meet it at once.
AUTOMATON_CHARS, BLOCK_CHARS = 500_000, 8_000_000
#: Rows that one task makes of matched names and their edges.
EXPANDED_ROWS = 500_000


def parse_graph(c):
    """STRUCT<entities, relationships> of one response; anything but a complete valid answer is empty."""
    nothing = F.from_json(F.lit('{"entities":[],"relationships":[]}'), GRAPH_TYPE)

    def complete(g):
        entities = F.forall(
            g["entities"], lambda e: e["name"].isNotNull() & e["type"].isNotNull() & e["description"].isNotNull()
        )
        relations = F.forall(
            g["relationships"],
            lambda r: r["source"].isNotNull() & r["target"].isNotNull() & r["type"].isNotNull()
            & r["description"].isNotNull(),
        )
        return F.when(F.coalesce(entities & relations, F.lit(False)), g).otherwise(nothing)

    return X.let(F.from_json(c, GRAPH_TYPE), complete)


def explode_graph(extracted, graph="graph", order="chunk_no"):
    """(entities, relations) with ``seq`` in the order in which facts are stored: a chunk's entities first."""

    def seq(kind, at):
        return F.struct(
            F.col(order).cast("long").alias("chunk"), F.lit(kind).alias("kind"), F.col(at).alias("pos")
        ).alias("seq")

    source = F.coalesce("source", F.lit(S.UNKNOWN_SOURCE)).alias("file")
    entities = extracted.select("invoke_id", source, order, F.posexplode(f"{graph}.entities").alias("at", "e")).select(
        "invoke_id", "e.name", F.coalesce("e.type", F.lit("Thing")).alias("type"),
        F.coalesce("e.description", F.lit("")).alias("description"), F.col("file").alias("source"), seq(0, "at"),
    )
    relations = extracted.select(
        "invoke_id", source, order, F.posexplode(f"{graph}.relationships").alias("at", "r")
    ).select(
        "invoke_id", F.col("r.source").alias("src"), F.col("r.target").alias("dst"), "r.type",
        F.coalesce("r.description", F.lit("")).alias("description"), F.col("file").alias("source"), seq(1, "at"),
    )
    return entities, relations


def merge_entities(entities):
    """One row per (room, name): first type and description, last source, first sighting."""
    return (
        entities.groupBy("invoke_id", "name")
        .agg(
            F.min_by(F.struct("type", "description"), "seq").alias("_first"),
            F.max_by("source", "seq").alias("source"),
            F.min("seq").alias("first_seq"),
        )
        .select("invoke_id", "name", "_first.type", "_first.description", "source", "first_seq")
    )


def split_relations(relations):
    """(usable, rejected) relations with normalised types; a type must be a plain identifier."""
    typed = relations.withColumn("type", X.normalize_rel_type(F.col("type")))
    plain = F.coalesce(F.col("type").rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.lit(False))
    return typed.where(plain), typed.where(~plain)


def merge_edges(relations):
    """One row per (room, src, type, dst): description and source of the last sighting."""
    return (
        relations.groupBy("invoke_id", "src", "type", "dst")
        .agg(F.max_by(F.struct("description", "source"), "seq").alias("_last"), F.max("seq").alias("last_seq"))
        .select("invoke_id", "src", "type", "dst", "_last.description", "_last.source", "last_seq")
    )


def resolve_edges(edges, entities, strict_order=True, rows_per_task=skew.ROWS_PER_TASK):
    """Edges whose two ends exist and, unless ``strict_order`` is off, were stored before the edge was last seen.

    Relations are merged before this join: the last sighting decides an edge's properties, and whenever an
    earlier sighting finds its ends, so does the last one.
    """
    known = entities.select("invoke_id", "name", "first_seq")
    out = edges
    for end in ("src", "dst"):
        keys = ["invoke_id", end]
        ends = known.select("invoke_id", F.col("name").alias(end), F.col("first_seq").alias("_seen"))
        hot = skew.hot_keys(skew.count_keys(edges, keys), keys, "_n", rows_per_task)
        out = skew.salted_join(out, ends, keys, hot, spread=["src", "dst", "type"])
        if strict_order:
            out = out.where(F.col("_seen") < F.col("last_seq"))
        out = out.drop("_seen")
    return out.select(*edges.columns)


def _matcher(shorts):
    """From (text, extra) pairs a function that lists the pairs whose text a given text contains.

    One Aho-Corasick automaton: a text is read once, whatever the number of pairs. The empty text is in every text.
    """
    by_text = {}
    for text, extra in shorts:
        if text is not None:
            by_text.setdefault(text, []).append(extra)
    everywhere = [("", extra) for extra in by_text.pop("", [])]
    automaton = ahocorasick.Automaton()
    for text in by_text:
        automaton.add_word(text, text)
    if by_text:
        automaton.make_automaton()

    def found(text):
        inside = dict.fromkeys(t for _, t in automaton.iter(text)) if by_text else ()
        return everywhere + [(t, extra) for t in inside for extra in by_text[t]]

    return found


def _pairs(room, longs, found):
    """Columns room, long, long_extra, short, short_extra of all containments of one room."""
    out = [(long, extra, short, other) for long, extra in longs if long is not None for short, other in found(long)]
    columns = list(zip(*out)) if out else [()] * 4
    return pa.table([pa.array([room] * len(out), pa.string()), *(pa.array(c, pa.string()) for c in columns)], names=PAIRS)


PAIRS = ["invoke_id", "long", "long_extra", "short", "short_extra"]
PAIRS_SCHEMA = ", ".join(f"{c} string" for c in PAIRS)


def _rows(table, *names):
    return list(zip(*(table.column(c).to_pylist() for c in names)))


def contained(longs, shorts, automaton_chars=AUTOMATON_CHARS, block_chars=BLOCK_CHARS):
    """(invoke_id, long, long_extra, short, short_extra): within each room the short texts that long texts contain.

    Both sides are (invoke_id, text, extra). Short texts of at most ``automaton_chars`` characters in all go to every task, and
    long texts are not shuffled. Otherwise a room's short texts are cut into buckets and its long ones into blocks of about
    these sizes, and each bucket meets each block once, so that neither side of a room is ever in one task. Null texts
    contain nothing and are in nothing.
    """
    spark = longs.sparkSession
    shorts, longs = shorts.select("invoke_id", "text", "extra"), longs.select("invoke_id", "text", "extra")
    # each text also counts as a few characters: an automaton has nodes for every one of them
    sized = lambda df: df.agg(F.coalesce(F.sum(F.length("text") + 8), F.lit(0)).cast("long").alias("_chars"))
    if sized(shorts).first()[0] <= automaton_chars:
        by_room = {}
        for r in shorts.toLocalIterator():
            by_room.setdefault(r.invoke_id, []).append((r.text, r.extra))
        sent = spark.sparkContext.broadcast(by_room)

        def scan(batches):
            built = {}
            for b in batches:
                own = {}
                for room, *row in _rows(b, "invoke_id", "text", "extra"):
                    own.setdefault(room, []).append(row)
                for room, rows in own.items():
                    if room is None or room not in sent.value:
                        continue
                    if room not in built:
                        built[room] = _matcher(sent.value[room])
                    yield from _pairs(room, rows, built[room]).to_batches()

        return longs.mapInArrow(scan, PAIRS_SCHEMA)

    def cut(df, chars, name):
        return sized(df.groupBy("invoke_id")).select("invoke_id", F.ceil(F.col("_chars") / chars).cast("int").alias(name))

    sizes = cut(shorts, automaton_chars, "_ns").join(cut(longs, block_chars, "_nl"), "invoke_id")

    def placed(df, own, others, tags):
        mine, other = tags
        counts = skew.count_keys(df, ["invoke_id"])
        joined = skew.salted_join(df, sizes, ["invoke_id"], skew.hot_keys(counts, ["invoke_id"], "_n"), spread=["text"])
        return joined.withColumns({mine: F.pmod(F.xxhash64("text"), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(others) - 1))})

    def meet(key, left, right):
        return _pairs(key[0].as_py(), _rows(left, "text", "extra"), _matcher(_rows(right, "text", "extra")))

    columns = ["invoke_id", "_s", "_l", "text", "extra"]
    left = placed(longs, "_nl", "_ns", ("_l", "_s")).select(*columns).groupBy("invoke_id", "_s", "_l")
    right = placed(shorts, "_ns", "_nl", ("_s", "_l")).select(*(F.col(c).alias(c) for c in columns)).groupBy("invoke_id", "_s", "_l")
    return left.cogroup(right).applyInArrow(meet, PAIRS_SCHEMA)


def match_entities(questions, entities, file=None, automaton_chars=AUTOMATON_CHARS, block_chars=BLOCK_CHARS):
    """Entities whose name contains the question or is contained in it, per (invoke_id, question_id).

    Each distinct question text is read once by the automata of its room's names, and each name by those of the questions,
    so only true matches are produced. A file name restricts names found inside the question, not names that contain it.
    """
    asked = ["invoke_id", "question"]
    texts = questions.select("invoke_id", F.col("question").alias("text"), F.lit(None).cast("string").alias("extra")).distinct()
    names = entities.select("invoke_id", F.col("name").alias("text"), F.col("source").alias("extra"))
    inside = names.where((F.col("extra") == file) | F.contains("extra", F.lit(file))) if file else names
    around = contained(names, texts, automaton_chars, block_chars).select(
        "invoke_id", F.col("short").alias("question"), F.col("long").alias("name"), F.col("long_extra").alias("source")
    )
    within = contained(texts, inside, automaton_chars, block_chars).select(
        "invoke_id", F.col("long").alias("question"), F.col("short").alias("name"), F.col("short_extra").alias("source")
    )
    found = around.union(within).distinct()
    hot = skew.hot_keys(skew.count_keys(questions, asked), asked, "_n")
    return skew.salted_join(questions.select(*asked, "question_id"), found, asked, hot, spread=["question_id"]).select(
        "invoke_id", "question_id", "name", "source"
    )


def undirected(edges):
    """(invoke_id, name, type, neighbor, description) once per end; a self-loop appears once."""
    forward = edges.select("invoke_id", F.col("src").alias("name"), "type", F.col("dst").alias("neighbor"), "description")
    backward = edges.where("src <> dst").select("invoke_id", F.col("dst").alias("name"), "type", F.col("src").alias("neighbor"), "description")
    return forward.union(backward)


def expand_neighbors(matched, edges):
    """Left join of matched entities to their incident edges; an isolated entity keeps one empty row.

    The result has a row per question and edge of each name, many times the rows of both sides: the matches of a name are
    cut into parts of about ``EXPANDED_ROWS`` such rows, and there are as many tasks as they need. Matches are stored,
    because they are read twice.
    """
    key = ["invoke_id", "name"]
    matched, near = saved(matched, "matched"), undirected(edges)
    made = F.col("_l") * F.col("_r")
    sizes = skew.count_keys(matched, key, "_l").join(skew.count_keys(near, key, "_r"), key).withColumn("_n", made)
    parts = F.least("_l", F.ceil(F.col("_n") / EXPANDED_ROWS)).cast("int").alias("_parts")
    hot = saved(sizes.where(F.col("_n") > EXPANDED_ROWS).select(*key, parts), "hot-names")
    tasks = -(-int(sizes.agg(F.sum("_n")).first()[0] or 0) // EXPANDED_ROWS)
    least = int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return skew.salted_join(matched, near, key, hot, "left", ["question_id"], max(tasks, least)).select(
        "invoke_id", "name", "question_id", "source", *EDGE_ORDER
    )


EDGE_ORDER = ("type", "neighbor", "description")


def limit_graph(expanded, n=D.graph_limit):
    """First ``n`` rows per question by name, type, neighbour and description."""
    return skew.first_n(expanded, ["invoke_id", "question_id"], n, "name", *EDGE_ORDER)


def limited_neighbors(matched, edges, n=D.graph_limit):
    """``limit_graph(expand_neighbors(matched, edges), n)`` without the whole expansion.

    Every matched name yields a row, so only a question's first ``n`` names and a name's first ``n`` edges can
    reach the result; both are cut on the map side before they meet. The names are stored, because they are
    read twice and finding them is the costly part.
    """
    names = saved(skew.first_n(matched, ["invoke_id", "question_id"], n, "name").drop("rank"), "names")
    wanted = names.select("invoke_id", "name").distinct()
    near = skew.first_n(
        undirected(edges).join(wanted, ["invoke_id", "name"], "left_semi"), ["invoke_id", "name"], n, *EDGE_ORDER
    ).drop("rank")
    return limit_graph(names.join(near, ["invoke_id", "name"], "left"), n)


def graph_search(questions, entities, edges, file=None, n=D.graph_limit):
    """Graph context per question: up to ``n`` edge lines, empty text where nothing was found."""
    return graph_context(limited_neighbors(match_entities(questions, entities, file), edges, n), questions)


def graph_context(rows, questions):
    """Edge lines of at most ``n`` ranked rows per question; rows without a neighbour are left out here."""
    line = X.edge_line(F.col("name"), F.col("type"), F.col("neighbor"), F.col("description"), F.col("source"))
    shown = rows.where("neighbor IS NOT NULL AND neighbor <> ''")
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    text = shown.groupBy("invoke_id", "question_id").agg(
        F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("graph_context")
    )
    return (
        questions.select("invoke_id", "question_id")
        .join(text, ["invoke_id", "question_id"], "left")
        .withColumn("graph_context", F.coalesce("graph_context", F.lit("")))
    )


def build_graph(extracted, graph="graph", order="chunk_no", strict_order=True, keep=None):
    """(entities, edges, rejected relations) of chunks with an extracted ``graph`` struct.

    ``keep(df, name)`` may store a table and return the stored one, so that edges read stored entities.
    """
    keep = keep or (lambda df, name: df)
    found, relations = explode_graph(extracted, graph, order)
    entities = keep(merge_entities(found), "entity")
    usable, rejected = split_relations(relations)
    edges = keep(resolve_edges(merge_edges(usable), entities, strict_order), "edge")
    return entities, edges, rejected
