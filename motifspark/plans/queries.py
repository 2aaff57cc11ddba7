"""The registered queries of the engine over graph views of the relational tables, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import GraphDB
from ..operators import access, growth, matching
from ..sources import readers, writers
from ..storage import shared_folder
from . import views
from .mine import mine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The views in SQL: edges with their ends' labels (g, s, d, t, sl, dl), or steps of a path (g, id, a, b, c, d by lead).
TRADE = """
e AS (SELECT CAST(c_nationkey AS VARCHAR) g, 2 * c_custkey s, 2 * p_partkey + 1 d, l_returnflag t, c_mktsegment sl, p_brand dl
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
v AS (SELECT DISTINCT g, s v, sl l FROM e UNION SELECT DISTINCT g, d, dl FROM e)"""
ORDER = """
l AS (SELECT CAST(o_orderkey AS VARCHAR) g, o_orderpriority p, o_orderstatus st, 2 * l_partkey + 1 part, 2 * l_suppkey + 2 sup, p_brand b, l_returnflag t
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
STEPS = """
s AS (SELECT CAST(user_id AS VARCHAR) g, event_id id, event_type a, ts, lead(event_type) OVER w b, lead(event_type, 2) OVER w c, lead(event_type, 3) OVER w d, lead(ts) OVER w ts2
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
TYPES = STEPS + """,
k AS (SELECT event_type x, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) n FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT g, ka.n s, kb.n d, CASE WHEN CAST(ts AS DATE) = CAST(ts2 AS DATE) THEN 'same' ELSE 'later' END t, a sl, b dl FROM s JOIN k ka ON a = ka.x JOIN k kb ON b = kb.x),
v AS (SELECT DISTINCT g, n v, a l FROM s JOIN k ON a = x)"""
TURNS = """
s AS (SELECT CAST(conv_id AS VARCHAR) g, role a, lead(role) OVER w b, lead(role, 2) OVER w c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE[query.__name__] = "WITH " + sql.strip()
        return query

    return add


def _path(labels: Column, edges: Column, n: int) -> Column:
    """A directed path pattern as its labels from the first node on."""
    at = F.get(F.array_except(F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda x: x.cast("int")), F.transform(edges, lambda e: e["dst"])), F.lit(0))
    step = lambda at: F.get(F.filter(edges, lambda e: e["src"] == at), F.lit(0))["dst"]
    out = [F.get(F.get(labels, at), F.lit(0))]
    for _ in range(n - 1):
        at = step(at)
        out.append(F.get(F.get(labels, at), F.lit(0)))
    return F.concat_ws(">", *out)


def _paths(db: GraphDB, support: float, low: int, high: int, kind: str = "all") -> DataFrame:
    found = mine(db, support, low, high, pattern_type=kind).patterns
    path = F.coalesce(*(F.when(F.col("n_nodes") == n, _path(F.col("labels"), F.col("edges"), n)) for n in range(low, high + 1)))
    return found.select(path.alias("path"), "n_nodes", "support", "frequency")


def _paths_sql(graphs: str, share: float, n: int, source: str = "s") -> str:
    """SELECT of frequent paths of n nodes."""
    cols = "abcd"[:n]
    return f"""SELECT {" || '>' || ".join(cols)} AS path, CAST({n} AS INTEGER) AS n_nodes, count(DISTINCT g) AS support, count(*) AS frequency FROM {source}
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in cols)} GROUP BY {", ".join(cols)} HAVING count(DISTINCT g) >= greatest(1, floor({share} * (SELECT count(DISTINCT {graphs}) FROM {source})))"""


# --- node patterns, accessors, profiles


@registered(TRADE + """
SELECT l AS label, count(DISTINCT g) AS support, count(*) AS frequency FROM v GROUP BY l HAVING count(DISTINCT g) >= 13""")
def one_node_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.one_node(views.trade(spark, sf_dir), 13).select(F.array_join("labels", " ").alias("label"), "support", "frequency")


@registered(ORDER + """
SELECT DISTINCT * FROM (SELECT 'node' AS kind, unnest([p, st, b, 'supplier']) AS label FROM l UNION ALL SELECT 'edge', unnest([t, 'supplied_by']) FROM l)""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.vocabulary(views.order(spark, sf_dir))


@registered(TRADE + """
SELECT g AS graph_id, n AS node_id, t AS type, count(*) FILTER (WHERE w = 0) AS out_degree, count(*) FILTER (WHERE w = 1) AS in_degree
FROM (SELECT g, s n, t, 0 w FROM e UNION ALL SELECT g, d, t, 1 FROM e) GROUP BY ALL""")
def degree_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.degrees(views.trade(spark, sf_dir))


@registered(TRADE + """,
c AS (SELECT 'nodes' part, g, count(*) n FROM v GROUP BY g UNION ALL SELECT 'edges', g, count(*) FROM e GROUP BY g)
SELECT part, count(*) AS graphs, round(avg(n), 4) AS average, max(n) AS largest, min(n) AS smallest, round(stddev_samp(n), 4) AS deviation FROM c GROUP BY part""")
def graph_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.profile(views.trade(spark, sf_dir)).withColumns({"average": F.round("average", 4), "deviation": F.round("deviation", 4)})


@registered(TRADE + """,
n AS (SELECT g, s, d, t, row_number() OVER (PARTITION BY g, s, d, t) - 1 k FROM e)
SELECT g AS graph_id, s AS u, d AS v, string_agg(t || '#' || k, ',' ORDER BY t, k) AS bag FROM n GROUP BY ALL""")
def pair_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.trade(spark, sf_dir).directed_bags().select("graph_id", "u", "v", F.array_join("bag", ",").alias("bag"))


@registered(TYPES + """
SELECT g AS graph_id, n AS node_id, string_agg(DISTINCT CAST(m AS VARCHAR), ',' ORDER BY CAST(m AS VARCHAR)) AS neighbours
FROM (SELECT g, s n, d m FROM e UNION ALL SELECT g, d, s FROM e) GROUP BY ALL""")
def neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.neighbours(views.event_type(spark, sf_dir)).select("graph_id", "node_id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@registered(TRADE + """
SELECT g AS graph_id, CAST(row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS BIGINT) AS node_id, l AS label FROM v""")
def zero_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.zero_indexed(views.trade(spark, sf_dir)).nodes.select("graph_id", "node_id", F.array_join("labels", " ").alias("label"))


@registered(TYPES + """
SELECT g AS graph_id, s AS node_id, t AS type, count(*) AS loops FROM e WHERE s = d GROUP BY ALL""")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.self_loops(views.event_type(spark, sf_dir)).groupBy("graph_id", F.col("src").alias("node_id"), "type").agg(F.count("*").alias("loops"))


@registered(TYPES + """
SELECT g AS graph_id, s AS src, d AS dst, count(*) AS edges FROM e WHERE sl < 'q' AND dl < 'q' GROUP BY ALL""")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = views.event_type(spark, sf_dir).stored()
    return access.induced(db, db.nodes.where(F.get("labels", F.lit(0)) < "q").select("graph_id", "node_id")).edges.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("edges"))


@registered(TYPES + """,
n AS (SELECT DISTINCT g, s a, d b FROM e UNION SELECT g, d, s FROM e),
p AS (SELECT x.g, x.v a, y.v b FROM v x JOIN v y ON x.g = y.g AND x.v < y.v),
i AS (SELECT p.g, p.a, p.b, count(*) k FROM p JOIN n x ON x.g = p.g AND x.a = p.a JOIN n y ON y.g = p.g AND y.a = p.b AND y.b = x.b GROUP BY ALL),
z AS (SELECT g, a, count(*) k FROM n GROUP BY ALL)
SELECT p.g AS graph_id, p.a, p.b, round(coalesce(i.k, 0) / greatest(1, coalesce(x.k, 0) + coalesce(y.k, 0) - coalesce(i.k, 0)), 6) AS similarity
FROM p LEFT JOIN i ON i.g = p.g AND i.a = p.a AND i.b = p.b LEFT JOIN z x ON x.g = p.g AND x.a = p.a LEFT JOIN z y ON y.g = p.g AND y.a = p.b""")
def jaccard_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = views.event_type(spark, sf_dir).stored()
    a = db.nodes.select("graph_id", F.col("node_id").alias("a"))
    pairs = a.join(db.nodes.select("graph_id", F.col("node_id").alias("b")), "graph_id").where("a < b")
    return access.jaccard(db, pairs).withColumn("similarity", F.round("similarity", 6))


@registered(TRADE + """,
k AS (SELECT g, s, d, t, row_number() OVER (PARTITION BY g, s, d ORDER BY t) k, count(*) OVER (PARTITION BY g, s, d) m FROM e),
r AS (SELECT k.* FROM k WHERE (g, t) IN (SELECT (g, t) FROM k WHERE m > 1))
SELECT r.g AS graph_id, (SELECT max(v) FROM v WHERE v.g = r.g) + row_number() OVER (PARTITION BY r.g ORDER BY s, d, k) AS node_id, t AS label FROM r""")
def reify_multiedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = access.reified(views.trade(spark, sf_dir)).nodes.where(F.length(F.get("labels", F.lit(0))) == 1)
    return flags.select("graph_id", "node_id", F.get("labels", F.lit(0)).alias("label"))


@registered(TYPES + """,
p AS (SELECT g, least(s, d) u, greatest(s, d) v, t, s < d ahead FROM e WHERE s <> d)
SELECT g AS graph_id, u, p.v, ku.x AS label_u, kv.x AS label_v, coalesce(string_agg(DISTINCT t, ',' ORDER BY t) FILTER (WHERE NOT ahead), '') AS t_in, coalesce(string_agg(DISTINCT t, ',' ORDER BY t) FILTER (WHERE ahead), '') AS t_out
FROM p JOIN k ku ON ku.n = u JOIN k kv ON kv.n = p.v GROUP BY ALL""")
def pair_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = matching.pair_profile(views.event_type(spark, sf_dir).stored())
    return p.select("graph_id", "u", "v", *(F.array_join(c, ",").alias(n) for c, n in (("labels_u", "label_u"), ("labels_v", "label_v"), ("t_in", "t_in"), ("t_out", "t_out"))))


_PAIR = "SELECT g AS graph_id, s AS u, d AS v, string_agg({0}, ',' ORDER BY t) AS types FROM e GROUP BY ALL"


@registered(TYPES + _PAIR.format("DISTINCT t"))
def edge_type_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.edge_types(views.event_type(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


@registered(TYPES + _PAIR.format("t"))
def edge_type_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.edge_types(views.event_type(spark, sf_dir), repeated=True).withColumn("types", F.array_join("types", ","))


@registered(TRADE + """
SELECT g AS graph_id, s AS src, d AS dst, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS keys
FROM (SELECT *, row_number() OVER (PARTITION BY g, s, d ORDER BY t) - 1 k FROM e) WHERE t = 'R' GROUP BY ALL""")
def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.edge_keys(views.trade(spark, sf_dir), "R").withColumn("keys", F.array_join(F.transform("keys", lambda x: x.cast("string")), ","))


@registered(TYPES + """
SELECT e.g AS graph_id, s AS src, d AS dst, count(*) AS edges FROM e WHERE sl <> (SELECT min(x) FROM k) AND dl <> (SELECT min(x) FROM k) GROUP BY ALL""")
def listed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges but those at dummy nodes: the nodes of the first event type are made such."""
    db = views.event_type(spark, sf_dir).stored()
    dummy = db.nodes.withColumn("labels", F.when(F.col("node_id") == 0, F.array(F.lit(access.DUMMY))).otherwise(F.col("labels")))
    return access.listed_edges(GraphDB(dummy, db.edges, True)).groupBy("graph_id", "src", "dst").agg(F.count("*").alias("edges"))


@registered(TYPES + """
SELECT g AS graph_id, s AS node_id, string_agg(DISTINCT CAST(d AS VARCHAR), ',' ORDER BY CAST(d AS VARCHAR)) AS targets FROM e GROUP BY ALL""")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.adjacency(views.event_type(spark, sf_dir)).withColumn("targets", F.array_join(F.transform("targets", lambda x: x.cast("string")), ","))


@registered(TYPES + """
SELECT g AS graph_id, least(s, d) AS u, greatest(s, d) AS v, count(*) AS edges, count(*) FILTER (WHERE s < d) AS ahead FROM e GROUP BY ALL""")
def pair_edge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = access.pair_edges(views.event_type(spark, sf_dir))
    return pairs.select("graph_id", "u", "v", F.size("edges").cast("long").alias("edges"), F.size(F.filter("edges", lambda e: e["src"] < e["dst"])).cast("long").alias("ahead"))


@registered(TRADE + """
SELECT v.g AS graph_id, v.v AS node_id, count(e.g) AS degree FROM v LEFT JOIN (SELECT g, s n FROM e UNION ALL SELECT g, d FROM e) e ON e.g = v.g AND e.n = v.v GROUP BY ALL""")
def total_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.total_degrees(views.trade(spark, sf_dir, stored=True))


@registered(TURNS.replace("role a,", "role a, turn t, lead(turn) OVER w t2,") + """
SELECT g AS graph_id, t AS u, a AS label_u, t2 AS v, b AS label_v, 'reply' AS types FROM s WHERE b IS NOT NULL""")
def mapped_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = views.dialogue(spark, sf_dir).stored()
    found = access.mapped_graphs(db, matching.match(db, ([[], []], [(0, 1, "reply")])), [(0, 1)])
    node, e = (lambda k: F.get("nodes", F.lit(k))), F.get("edges", F.lit(0))
    return found.select("graph_id", e["u"].alias("u"), F.get(node(0)["labels"], F.lit(0)).alias("label_u"), e["v"].alias("v"), F.get(node(1)["labels"], F.lit(0)).alias("label_v"), F.array_join(e["types"], ",").alias("types"))


@registered(TURNS.replace("role a,", "role a, turn t, lead(turn) OVER w t2,") + """
SELECT g AS graph_id, t2 AS u, t AS v FROM s WHERE b IS NOT NULL""")
def wrong_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validator finds among all replies as they are and, of the same pattern, turned round."""
    db = views.dialogue(spark, sf_dir).stored()
    plain = db.edges.select(F.lit(1).cast("bigint").alias("pattern_id"), "graph_id", F.array("src", "dst").alias("node_map"))
    free = GraphDB(db.nodes.withColumn("labels", F.expr("cast(array() as array<string>)")), db.edges, True)
    pattern = spark.createDataFrame([(1, [[], []], [(0, 1, "reply")])], f"pattern_id bigint, labels array<array<string>>, edges {growth.EDGE_LIST}")
    found = access.invalid_embeddings(free, pattern, plain.unionAll(plain.withColumn("node_map", F.reverse("node_map"))))
    return found.select("graph_id", F.get("node_map", F.lit(0)).alias("u"), F.get("node_map", F.lit(1)).alias("v"))


# --- sources


def _round_trip(db: GraphDB) -> GraphDB:
    """The database written as text in the shared folder and read again."""
    spark = db.nodes.sparkSession
    path = f"{shared_folder(spark)}/graphs-{uuid.uuid4().hex}.data"
    writers.write_graphs(db, path)
    return readers.read_graph_db(spark, path, directed=True)


@registered(TRADE + """
SELECT g AS graph_id, s AS src, sl AS label_src, d AS dst, dl AS label_dst, t AS type, count(*) AS edges FROM e GROUP BY ALL""")
def data_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges with their ends' labels after the database was written as .data text and read again."""
    db = _round_trip(views.trade(spark, sf_dir, stored=True)).stored()
    found = db.edges
    for end in ("src", "dst"):
        found = found.join(db.nodes.select("graph_id", F.col("node_id").alias(end), F.get("labels", F.lit(0)).alias(f"label_{end}")), ["graph_id", end])
    return found.groupBy("graph_id", "src", "label_src", "dst", "label_dst", "type").agg(F.count("*").alias("edges"))


@registered(TRADE + """
SELECT g AS graph_id, s AS src, sl AS label_src, d AS dst, dl AS label_dst, t AS type, count(*) AS edges FROM e GROUP BY ALL""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_round_trip() by way of CSV folders, a node and an edge file or more for each graph."""
    db = views.trade(spark, sf_dir, stored=True)
    path = f"{shared_folder(spark)}/graphs-{uuid.uuid4().hex}"
    nodes = db.nodes.select("node_id", F.array_join("labels", ":").alias("labels"), "graph_id", F.lit("nodes").alias("role"))
    edges = db.edges.select("src", "dst", "type", "graph_id", F.lit("edges").alias("role"))
    for rows in (nodes, edges):
        rows.repartition("graph_id").write.mode("append").partitionBy("graph_id", "role").csv(path, header=True)
    again = readers.read_graph_db(spark, path, "csv", directed=True, nodes_dir="role=nodes", edges_dir="role=edges").stored()
    found = again.edges
    for end in ("src", "dst"):
        found = found.join(again.nodes.select("graph_id", F.col("node_id").alias(end), F.get("labels", F.lit(0)).alias(f"label_{end}")), ["graph_id", end])
    name = F.regexp_replace("graph_id", "^graph_id=", "").alias("graph_id")
    return found.groupBy(name, "src", "label_src", "dst", "label_dst", "type").agg(F.count("*").alias("edges"))


# --- mining

_BAGS = TRADE + """,
o AS (SELECT g, s, d, sl, dl, count(*) FILTER (WHERE t = 'A') a, count(*) FILTER (WHERE t = 'N') n, count(*) FILTER (WHERE t = 'R') r FROM e GROUP BY ALL),
c AS (SELECT DISTINCT sl, dl, a, n, r FROM o)
SELECT c.sl AS label_0, c.dl AS label_1, c.a, c.n, c.r, count(DISTINCT o.g) AS support, count(*) AS frequency
FROM c JOIN o ON c.sl = o.sl AND c.dl = o.dl AND c.a <= o.a AND c.n <= o.n AND c.r <= o.r GROUP BY ALL HAVING count(DISTINCT o.g) >= 2"""


def _bag_patterns(db: GraphDB) -> DataFrame:
    found = mine(db, 2, 2, 2).patterns
    count = lambda t: F.size(F.filter("edges", lambda e: e["type"] == t)).cast("long").alias(t.lower())
    names = F.transform("labels", lambda x: F.get(x, F.lit(0)))
    first = F.get("edges", F.lit(0))
    ends = (F.get(names, first["src"]), F.get(names, first["dst"]))
    if not db.directed:  # segments are spelt in capitals, brands aren't
        ends = (F.array_min(F.filter(names, lambda x: x == F.upper(x))), F.array_min(F.filter(names, lambda x: x != F.upper(x))))
    return found.select(ends[0].alias("label_0"), ends[1].alias("label_1"), count("A"), count("N"), count("R"), "support", "frequency")


@registered(_BAGS)
def two_node_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bag_patterns(views.trade(spark, sf_dir, stored=True))


@registered(_BAGS)
def two_node_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bag_patterns(views.trade(spark, sf_dir, directed=False, stored=True))


@registered(STEPS + _paths_sql("g", 0.4, 3))
def path3_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(views.event_path(spark, sf_dir).stored(), 0.4, 3, 3)


@registered(STEPS + _paths_sql("g", 0.1, 4))
def path4_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(views.event_path(spark, sf_dir).stored(), 0.1, 4, 4)


@registered(TURNS + _paths_sql("g", 0.2, 3))
def dialogue_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(views.dialogue(spark, sf_dir).stored(), 0.2, 3, 3)


@registered(STEPS + " UNION ALL ".join(_paths_sql("g", 0.4, n) for n in (1, 2, 3)))
def mine_all_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(views.event_path(spark, sf_dir).stored(), 0.4, 1, 3)


@registered(STEPS + f""",
p1 AS ({_paths_sql("g", 0.4, 1)}), p2 AS ({_paths_sql("g", 0.4, 2)}), p3 AS ({_paths_sql("g", 0.4, 3)})
SELECT * FROM p3 UNION ALL SELECT * FROM p2 WHERE NOT EXISTS (SELECT 1 FROM p3 WHERE starts_with(p3.path, p2.path || '>') OR ends_with(p3.path, '>' || p2.path))
UNION ALL SELECT * FROM p1 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE starts_with(p2.path, p1.path || '>') OR ends_with(p2.path, '>' || p1.path))""")
def mine_maximum_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(views.event_path(spark, sf_dir).stored(), 0.4, 1, 3, "maximum")


@registered(STEPS + """,
f AS (SELECT a, b FROM s WHERE b IS NOT NULL GROUP BY a, b HAVING count(DISTINCT g) >= greatest(1, floor(0.4 * (SELECT count(DISTINCT g) FROM s))))
SELECT s.a || '>' || s.b AS path, g AS graph_id, count(*) AS frequency FROM s JOIN f USING (a, b) GROUP BY ALL""")
def per_graph_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine(views.event_path(spark, sf_dir).stored(), 0.4, 2, 2)
    names = found.patterns.select("pattern_id", _path(F.col("labels"), F.col("edges"), 2).alias("path"))
    return growth.per_graph(found.embeddings).join(names, "pattern_id").select("path", "graph_id", "frequency")


@registered(STEPS + """
SELECT a AS label_0, b AS label_1, count(DISTINCT g) AS support, count(*) * CASE WHEN a = b THEN 2 ELSE 1 END AS frequency, count(*) AS n_occurrences
FROM (SELECT g, least(a, b) a, greatest(a, b) b FROM s WHERE b IS NOT NULL) GROUP BY a, b HAVING count(DISTINCT g) >= 2""")
def symmetric_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = views.event_path(spark, sf_dir).stored()
    found = mine(GraphDB(path.nodes, path.edges, False), 2, 2, 2).patterns
    names = F.array_sort(F.flatten("labels"))
    return found.select(F.get(names, F.lit(0)).alias("label_0"), F.get(names, F.lit(1)).alias("label_1"), "support", "frequency", "n_occurrences")


@registered(ORDER + """
SELECT p AS priority, st AS status, b AS brand, count(DISTINCT g) AS support, count(DISTINCT (g, part)) AS frequency FROM l WHERE t = 'R' GROUP BY ALL HAVING count(DISTINCT g) >= 2""")
def template_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine(views.order(spark, sf_dir, stored=True), 2, 2, 2, templates=[([[], []], [(0, 1, "R")])]).patterns
    head = F.get("labels", F.get("edges", F.lit(0))["src"])
    tail = F.get("labels", F.get("edges", F.lit(0))["dst"])
    return found.select(F.get(head, F.lit(0)).alias("priority"), F.get(head, F.lit(1)).alias("status"), F.get(tail, F.lit(0)).alias("brand"), "support", "frequency")


@registered(TYPES + """,
t AS (SELECT DISTINCT x.g, x.s n0, x.d n1, y.d n2 FROM e x JOIN e y ON x.g = y.g AND x.d = y.s WHERE x.t = 'same' AND y.t = 'same' AND x.s <> x.d AND y.s <> y.d AND x.s <> y.d),
p AS (SELECT t.g, n0, n1, n2, i, j, CASE i WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END u, CASE j WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END w FROM t, (VALUES (0), (1), (2)) a(i), (VALUES (0), (1), (2)) b(j)),
m AS (SELECT p.g, n0, n1, n2, i, j, count(*) - max(CASE WHEN j = i + 1 THEN 1 ELSE 0 END) k FROM p JOIN e ON e.g = p.g AND e.s = u AND e.d = w GROUP BY ALL)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS embeddings, CAST(sum(k) AS BIGINT) AS missing FROM m WHERE k > 0 GROUP BY i, j""")
def edge_extension_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = views.event_type(spark, sf_dir).stored()
    found = matching.match(db, ([[], [], []], [(0, 1, "same"), (1, 2, "same")]), symmetric=True).select(F.lit(1).cast("bigint").alias("pattern_id"), "graph_id", "node_map").distinct()
    pattern = spark.createDataFrame([(1, [(0, 1, "same"), (1, 2, "same")])], f"pattern_id bigint, edges {growth.EDGE_LIST}")
    missing = growth.missing_edges(db.directed_bags(), found, pattern, True)
    return missing.groupBy("i", "j").agg(F.count("*").alias("embeddings"), F.sum(F.size("bag")).alias("missing"))


_SHAPES = {
    "s1 AND k": ["'>' || a || '>next+skip'", "'next>' || b || '>next'", "'next+skip>' || c || '>'"],
    "s1": ["'>' || a || '>next'", "'next>' || b || '>next'", "'next>' || c || '>'"],
    "k": ["'>' || a || '>next+skip'", "'next>' || b || '>'", "'skip>' || c || '>'"],
    "s1 AND k AND true": ["'>' || a || '>skip'", "'>' || b || '>next'", "'next+skip>' || c || '>'"],
    "k1": ["'>' || a || '>next'", "'next>' || b || '>skip'", "'skip>' || d || '>'"],
    "k AND d IS NOT NULL": ["'>' || a || '>skip'", "'skip>' || c || '>next'", "'next>' || d || '>'"],
    "k AND k2": ["'>' || a || '>skip'", "'skip>' || c || '>skip'", "'skip>' || f || '>'"],
}


@registered("""
s AS (SELECT CAST(user_id AS VARCHAR) g, event_type a, lead(event_type) OVER w b, lead(event_type, 2) OVER w c, lead(event_type, 3) OVER w d, lead(event_type, 4) OVER w f,
             coalesce(CAST(ts AS DATE) = CAST(lead(ts, 2) OVER w AS DATE), false) k, lead(event_type, 2) OVER w IS NOT NULL s1,
             coalesce(CAST(lead(ts) OVER w AS DATE) = CAST(lead(ts, 3) OVER w AS DATE), false) k1, coalesce(CAST(lead(ts, 2) OVER w AS DATE) = CAST(lead(ts, 4) OVER w AS DATE), false) k2
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (""" + " UNION ALL ".join(f"SELECT g, array_to_string(list_sort([{', '.join(v)}]), '|') AS nodes, {3 if k == 's1 AND k' else 2} AS n_edges FROM s WHERE {k}" for k, v in _SHAPES.items()) + """)
SELECT nodes, CAST(n_edges AS INTEGER) AS n_edges, count(DISTINCT g) AS support, count(*) AS frequency, count(*) AS n_occurrences FROM r
GROUP BY ALL HAVING count(DISTINCT g) >= greatest(1, floor(0.2 * (SELECT count(DISTINCT g) FROM s)))""")
def closing_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of three nodes with their closing edges, each node written as the types of its edges in, its label, those out."""
    found = mine(views.event_skip(spark, sf_dir).stored(), 0.2, 3, 3).patterns
    types = lambda end, v: F.array_join(F.array_sort(F.transform(F.filter("edges", lambda e: e[end] == v), lambda e: e["type"])), "+")
    nodes = F.transform("labels", lambda x, v: F.concat(types("dst", v), F.lit(">"), F.get(x, F.lit(0)), F.lit(">"), types("src", v)))
    return found.select(F.array_join(F.array_sort(nodes), "|").alias("nodes"), "n_edges", "support", "frequency", "n_occurrences")


@registered()
def closing_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum patterns of up to three event types, with several edges between two nodes: joint edge extension and the rule for
    trees that gained edges, which depends on the order of growth, so SQL has no counterpart."""
    found = mine(views.event_type(spark, sf_dir).stored(), 0.9, 1, 3, pattern_type="maximum").patterns
    return found.select("code", "n_nodes", "n_edges", "support", "frequency", "n_occurrences")


@registered(TRADE + """
SELECT '[[["' || least(sl, dl) || '"],["' || greatest(sl, dl) || '"]],[' || string_agg(CASE WHEN sl < dl THEN '[0,1,"' ELSE '[1,0,"' END || t || '"]', ',' ORDER BY t) || ']]' AS code, CAST(2 AS BIGINT) AS drafts
FROM (SELECT DISTINCT sl, dl, unnest(list_sort(ts)) t, list_sort(ts) z, generate_subscripts(ts, 1) i FROM (SELECT sl, dl, list(t) ts FROM e GROUP BY g, s, d, sl, dl)) GROUP BY sl, dl, z""")
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every observed bag of edges between two labelled nodes."""
    db = views.trade(spark, sf_dir, stored=True)
    near = db.pair_bags().join(db.nodes.select("graph_id", F.col("node_id").alias("u"), F.col("labels").alias("own")), ["graph_id", "u"])
    drafts = near.select(F.array("own", "labels").alias("labels"), F.transform("bag", lambda x: F.struct(F.when(x.startswith("+"), 0).otherwise(1).alias("src"), F.when(x.startswith("+"), 1).otherwise(0).alias("dst"), F.regexp_replace(F.substring(x, 2, 1 << 30), r"#\d+$", "").alias("type"))).alias("edges")).distinct()
    return growth.coded(drafts, True).groupBy("code").agg(F.count("*").alias("drafts"))


@registered()
def pattern_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined patterns as text, with the graphs they are in."""
    return writers.format_patterns(mine(views.dialogue(spark, sf_dir).stored(), 0.5, 1, 2), with_frequencies=True)


# --- matching


@registered(TRADE + """
SELECT x.g AS graph_id, count(*) AS occurrences FROM e x JOIN e y ON x.g = y.g AND x.s = y.s AND x.d < y.d WHERE x.sl = 'BUILDING' AND x.t = 'R' AND y.t = 'R' GROUP BY x.g""")
def star_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(views.trade(spark, sf_dir, stored=True), ([["BUILDING"], [], []], [(0, 1, "R"), (0, 2, "R")]))
    return found.groupBy("graph_id").agg(F.count("*").alias("occurrences"))


@registered(ORDER + """
SELECT x.t AS type, x.b AS brand, count(*) AS occurrences FROM l x JOIN l y ON x.g = y.g AND x.part = y.part WHERE x.p = '1-URGENT' GROUP BY ALL""")
def wildcard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = views.order(spark, sf_dir, stored=True)
    found = matching.match(db, ([["1-URGENT"], [], ["supplier"]], [(0, 1, ""), (1, 2, "supplied_by")]), with_labels=True)
    brand = F.get(F.get("labels", F.lit(1)), F.lit(0))
    return found.groupBy(F.get("types", F.lit(0)).alias("type"), brand.alias("brand")).agg(F.count("*").alias("occurrences"))


@registered(ORDER + """
SELECT DISTINCT g AS graph_id, CAST(0 AS BIGINT) AS node_id FROM l WHERE p = '2-HIGH' AND st = 'F'""")
def label_containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(views.order(spark, sf_dir), ([["2-HIGH", "F"]], [])).select("graph_id", F.get("node_map", F.lit(0)).alias("node_id"))


@registered(TRADE + """,
n AS (SELECT g, s, d, count(*) k FROM e WHERE t = 'R' AND sl = 'BUILDING' GROUP BY ALL)
SELECT g AS graph_id, s AS customer, d AS part, CAST(k * (k - 1) // 2 AS BIGINT) AS occurrences FROM n WHERE k > 1""")
def parallel_edge_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(views.trade(spark, sf_dir, stored=True), ([["BUILDING"], []], [(0, 1, "R"), (0, 1, "R")]))
    return found.groupBy("graph_id", F.get("node_map", F.lit(0)).alias("customer"), F.get("node_map", F.lit(1)).alias("part")).agg(F.count("*").alias("occurrences"))


@registered(TYPES + """
SELECT x.g AS graph_id, x.s AS n0, x.d AS n1, y.d AS n2, count(*) AS occurrences FROM e x JOIN e y ON x.g = y.g AND x.d = y.s JOIN e z ON z.g = x.g AND z.s = y.d AND z.d = x.s
WHERE x.t = 'same' AND y.t = 'same' AND z.t = 'same' AND x.s < x.d AND x.s < y.d AND x.d <> y.d GROUP BY ALL""")
def cycle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(views.event_type(spark, sf_dir).stored(), ([[], [], []], [(0, 1, "same"), (1, 2, "same"), (2, 0, "same")]))
    return found.groupBy("graph_id", *(F.get("node_map", F.lit(k)).alias(f"n{k}") for k in range(3))).agg(F.count("*").alias("occurrences"))


@registered(TRADE + """
SELECT CAST(0 AS INTEGER) AS node, g AS graph_id, count(*) AS candidates FROM (SELECT g, s FROM e WHERE t = 'R' AND sl = 'BUILDING' GROUP BY g, s HAVING count(*) >= 2) GROUP BY g
UNION ALL SELECT i, g, count(DISTINCT d) FROM e, (VALUES (1), (2)) x(i) WHERE t = 'R' GROUP BY i, g""")
def degree_filter_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = matching.degree_domain(views.trade(spark, sf_dir, stored=True), ([["BUILDING"], [], []], [(0, 1, "R"), (0, 2, "R")]))
    return domain.groupBy("node", "graph_id").agg(F.count("*").alias("candidates"))


@registered(TYPES + """
SELECT CAST(0 AS INTEGER) AS q_i, CAST(1 AS INTEGER) AS q_j, g AS graph_id, s AS t_i, d AS t_j FROM e WHERE t = 'same' AND s <> d GROUP BY g, s, d""")
def pair_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pair_domain(views.event_type(spark, sf_dir).stored(), ([[], []], [(0, 1, "same")]))


@registered(ORDER + """
SELECT g AS graph_id FROM l GROUP BY g HAVING bool_or(p = '1-URGENT') AND bool_or(b = 'Brand#11') AND bool_or(t = 'R')""")
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.vocabulary_filter(views.order(spark, sf_dir, stored=True), ([["1-URGENT"], ["Brand#11"]], [(0, 1, "R")]))
