"""Entity graph: nations, regions and suppliers as extracted facts; questions that mention them."""

from pyspark.sql import functions as F

from ragspark.catalog import common as C
from ragspark.functions import text as X
from ragspark.operators import graph as G
from ragspark.session import saved, shared_folder
from ragspark.sources import graph_store

QUERIES, ORACLE = {}, {}


def responses(spark, folder):
    """One extraction response per supplier (naming its nation) and per nation (naming its region), as JSON.

    Every seventh supplier response is broken, every fifth lacks a field; nations come after their suppliers.
    """
    def entity(name, kind, text):
        return F.struct(name.alias("name"), F.lit(kind).alias("type"), text.alias("description"))

    def relation(a, b, kind, text):
        return F.struct(a.alias("source"), b.alias("target"), kind.alias("type"), text.alias("description"))

    nation = C.table(spark, folder, "nation").join(
        C.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    s = C.table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    note = F.concat(F.lit("from supplier "), key.cast("string"))
    good = F.to_json(
        F.struct(
            F.array(
                entity(F.col("s_name"), "Supplier", note), entity(F.col("n_name"), "Nation", note)
            ).alias("entities"),
            F.array(
                relation(F.col("s_name"), F.col("n_name"), F.lit("in nation"), note),
                relation(F.col("n_name"), F.col("r_name"), F.lit("in region"), note),
                relation(F.col("n_name"), F.col("n_name"), F.when(key % 3 == 0, "self-made").otherwise("self"), note),
            ).alias("relationships"),
        )
    )
    lacking = F.replace(good, F.lit('"type":"Nation",'), F.lit(""))
    by_supplier = s.select(
        key.alias("chunk_no"), F.concat(F.lit("file"), (key % 3).cast("string")).alias("source"),
        F.when(key % 7 == 0, F.substring(good, 1, 60)).when(key % 5 == 0, lacking).otherwise(good).alias("json"),
    )
    about = F.concat(F.lit("about "), F.col("n_name"))
    by_nation = nation.select(
        (F.col("n_nationkey") + 1_000_000_000).cast("long").alias("chunk_no"), F.lit("nations").alias("source"),
        F.to_json(
            F.struct(
                F.array(entity(F.col("r_name"), "Region", about), entity(F.col("n_name"), "Country", about)).alias("entities"),
                F.array(relation(F.col("n_name"), F.col("r_name"), F.lit("in region"), about)).alias("relationships"),
            )
        ).alias("json"),
    )
    return by_supplier.union(by_nation).select(F.lit("world").alias("invoke_id"), "*")


SQL_FACTS = """
WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (
  SELECT *, 'from supplier ' || s_suppkey AS note, 'file' || s_suppkey % 3 AS file
  FROM supplier JOIN n ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0),
ent AS (
  SELECT s_name AS name, 'Supplier' AS type, note AS description, file AS source, s_suppkey * 10 AS seq FROM s
  UNION ALL SELECT n_name, 'Nation', note, file, s_suppkey * 10 + 1 FROM s
  UNION ALL SELECT r_name, 'Region', 'about ' || n_name, 'nations', (n_nationkey + 1000000000::BIGINT) * 10 FROM n
  UNION ALL SELECT n_name, 'Country', 'about ' || n_name, 'nations', (n_nationkey + 1000000000::BIGINT) * 10 + 1 FROM n),
rel AS (
  SELECT s_name AS src, n_name AS dst, 'IN_NATION' AS type, note AS description, file AS source, s_suppkey * 10 + 5 AS seq FROM s
  UNION ALL SELECT n_name, r_name, 'IN_REGION', note, file, s_suppkey * 10 + 6 FROM s
  UNION ALL SELECT n_name, n_name, CASE WHEN s_suppkey % 3 = 0 THEN 'SELF-MADE' ELSE 'SELF' END, note, file, s_suppkey * 10 + 7 FROM s
  UNION ALL SELECT n_name, r_name, 'IN_REGION', 'about ' || n_name, 'nations', (n_nationkey + 1000000000::BIGINT) * 10 + 5 FROM n),
entity AS (
  SELECT name, arg_min(type, seq) AS type, arg_min(description, seq) AS description, arg_max(source, seq) AS source,
    min(seq) AS first_seq FROM ent GROUP BY name),
edge AS (
  SELECT r.src, r.type, r.dst, arg_max(r.description, r.seq) AS description, arg_max(r.source, r.seq) AS source
  FROM rel r JOIN entity a ON a.name = r.src AND a.first_seq < r.seq JOIN entity b ON b.name = r.dst AND b.first_seq < r.seq
  WHERE r.type <> 'SELF-MADE' GROUP BY ALL),
q AS (
  SELECT 'n' || n_nationkey AS question_id, n_name AS question FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name FROM region
  UNION ALL SELECT 'b' || item_id, text FROM benchmark
  UNION ALL SELECT 's' || s_suppkey, 'Where is ' || s_name || ', in ' || n_name || ' or elsewhere?'
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
matched AS (
  SELECT question_id, name, source FROM q, entity
  WHERE contains(name, question) OR (contains(question, name) AND (FILTER))),
both_ways AS (
  SELECT src AS name, type, dst AS neighbor, description FROM edge
  UNION ALL SELECT dst, type, src, description FROM edge WHERE src <> dst),
expanded AS (
  SELECT question_id, m.name, m.source, b.type, neighbor, description FROM matched m LEFT JOIN both_ways b ON b.name = m.name),
limited AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY name, type NULLS FIRST, neighbor NULLS FIRST,
    description NULLS FIRST)::INT AS rank FROM expanded QUALIFY rank <= 20)
"""
SQL_OPEN = SQL_FACTS.replace("FILTER", "true")
SQL_FILE = SQL_FACTS.replace("FILTER", "source = 'file1' OR contains(source, 'file1')")
SQL_GRAPH_CONTEXT = """
SELECT q.question_id, coalesce(text, '') AS graph_context FROM q LEFT JOIN (
  SELECT question_id, string_agg('(' || name || ') -[' || type || ']-> (' || neighbor || '): ' || description
    || ' (Source: ' || source || ')', chr(10) ORDER BY rank) AS text
  FROM limited WHERE neighbor IS NOT NULL GROUP BY ALL) t ON t.question_id = q.question_id
"""


def extracted(spark, folder):
    return responses(spark, folder).withColumn("graph", G.parse_graph(F.col("json"))).drop("json")


def graph(spark, folder):
    return G.build_graph(extracted(spark, folder))


def questions(spark, folder):
    n, r = C.table(spark, folder, "nation"), C.table(spark, folder, "region")
    s = C.table(spark, folder, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))

    def asked(df, letter, key, text):
        return df.select(
            F.lit("world").alias("invoke_id"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("question_id"),
            text.alias("question"),
        )

    where = F.concat(F.lit("Where is "), "s_name", F.lit(", in "), "n_name", F.lit(" or elsewhere?"))
    return (
        asked(n, "n", "n_nationkey", F.col("n_name"))
        .union(asked(r, "r", "r_regionkey", F.col("r_name")))
        .union(asked(C.table(spark, folder, "benchmark"), "b", "item_id", F.col("text")))
        .union(asked(s, "s", "s_suppkey", where))
    )


def stored(spark, folder):
    """Entity and edge tables as a user keeps them: built once, then searched."""
    entities, edges, _ = G.build_graph(extracted(spark, folder), keep=saved)
    return entities, edges


def matched(spark, folder, file=None):
    return G.match_entities(questions(spark, folder), saved(graph(spark, folder)[0], "entity"), file).drop("invoke_id")


def expanded(spark, folder):
    entities, edges = stored(spark, folder)
    return G.expand_neighbors(G.match_entities(questions(spark, folder), entities), edges).drop("invoke_id")


def limited(spark, folder):
    entities, edges = stored(spark, folder)
    found = G.match_entities(questions(spark, folder), entities)
    return G.limited_neighbors(found, edges).drop("invoke_id")


def context(spark, folder, file=None):
    entities, edges = stored(spark, folder)
    return G.graph_search(questions(spark, folder), entities, edges, file).drop("invoke_id")


def edges(spark, folder):
    return graph(spark, folder)[1].select("src", "type", "dst", "description", "source")


def stored_in_batches(spark, folder):
    """The responses in four batches of rising chunk numbers, the third written twice, merged into one stored graph."""
    path = shared_folder(spark, "graph")
    rows = saved(extracted(spark, folder), "extracted")
    last = rows.where("chunk_no < 1000000000").agg(F.max("chunk_no")).first()[0] or 0
    for batch in (0, 1, 2, 2, 3):
        part = F.least(F.floor(F.col("chunk_no") * 3 / F.lit(last + 1)), F.lit(3))
        graph_store.append_facts(rows.where(part == batch), path, batch)
    return graph_store.load_graph(spark, path)


def edges_in_batches(spark, folder):
    return stored_in_batches(spark, folder)[1].select("src", "type", "dst", "description", "source")


def entities_in_batches(spark, folder):
    return stored_in_batches(spark, folder)[0].select("name", "type", "description", "source")


def unresolved(spark, folder):
    usable, _ = G.split_relations(G.explode_graph(extracted(spark, folder))[1])
    return G.merge_edges(usable).select("src", "type", "dst", "description", "source")


QUERIES.update(
    parse_graph=lambda s, d: extracted(s, d).select(
        "chunk_no", F.size("graph.entities").alias("n_entities"), F.size("graph.relationships").alias("n_relations")
    ),
    explode_graph=lambda s, d: G.explode_graph(extracted(s, d))[0].select("name", "type", "description", "source"),
    normalize_rel_type=lambda s, d: C.table(s, d, "part").select(
        "p_partkey", X.normalize_rel_type(F.col("p_type")).alias("rel")
    ),
    rejected_relations=lambda s, d: graph(s, d)[2].select("src", "type", "dst", "source"),
    merge_entities=lambda s, d: graph(s, d)[0].drop("first_seq", "invoke_id"),
    merge_edges=unresolved,
    resolve_edges=edges,
    edges_in_batches=edges_in_batches,
    entities_in_batches=entities_in_batches,
    undirected_edges=lambda s, d: G.undirected(graph(s, d)[1]).drop("invoke_id"),
    match_entities=matched,
    match_entities_in_file=lambda s, d: matched(s, d, "file1"),
    expand_neighbors=expanded,
    limit_graph=limited,
    graph_search=context,
    graph_search_one_file=lambda s, d: context(s, d, "file1"),
    edge_line=lambda s, d: expanded(s, d).select(
        "question_id", X.edge_line(F.col("name"), F.col("type"), F.col("neighbor"), F.col("description"), F.col("source")).alias("line")
    ),
)
ORACLE.update(
    parse_graph="""
SELECT s_suppkey AS chunk_no, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 THEN 0 ELSE 2 END AS n_entities,
  CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 THEN 0 ELSE 3 END AS n_relations FROM supplier
UNION ALL SELECT n_nationkey + 1000000000::BIGINT, 2, 1 FROM nation""",
    explode_graph=SQL_OPEN + "SELECT name, type, description, source FROM ent",
    normalize_rel_type="SELECT p_partkey, upper(replace(p_type, ' ', '_')) AS rel FROM part",
    rejected_relations=SQL_OPEN + "SELECT src, type, dst, source FROM rel WHERE type = 'SELF-MADE'",
    merge_entities=SQL_OPEN + "SELECT name, type, description, source FROM entity",
    merge_edges=SQL_OPEN + """SELECT src, type, dst, arg_max(description, seq) AS description, arg_max(source, seq) AS source
FROM rel WHERE type <> 'SELF-MADE' GROUP BY ALL""",
    resolve_edges=SQL_OPEN + "SELECT src, type, dst, description, source FROM edge",
    edges_in_batches=SQL_OPEN + "SELECT src, type, dst, description, source FROM edge",
    entities_in_batches=SQL_OPEN + "SELECT name, type, description, source FROM entity",
    undirected_edges=SQL_OPEN + "SELECT * FROM both_ways",
    match_entities=SQL_OPEN + "SELECT question_id, name, source FROM matched",
    match_entities_in_file=SQL_FILE + "SELECT question_id, name, source FROM matched",
    expand_neighbors=SQL_OPEN + "SELECT * FROM expanded",
    limit_graph=SQL_OPEN + "SELECT * FROM limited",
    graph_search=SQL_OPEN + SQL_GRAPH_CONTEXT,
    graph_search_one_file=SQL_FILE + SQL_GRAPH_CONTEXT,
    edge_line=SQL_OPEN + """SELECT question_id, '(' || name || ') -[' || coalesce(type, 'None') || ']-> ('
  || coalesce(neighbor, 'None') || '): ' || coalesce(description, 'None') || ' (Source: ' || source || ')' AS line FROM expanded""",
)
