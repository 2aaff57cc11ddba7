"""Accessors, degrees, similarity, profiles and transforms of graph databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import NO_PROPS, GraphDB, with_keys

#: Nodes of this label are left out of edge listings.
DUMMY = "DUMMY"


def edge_types(db: GraphDB, repeated: bool = False) -> DataFrame:
    """(graph_id, u, v, types) of each pair with an edge from u to v: sorted non-empty types, distinct or with repetitions."""
    gather = F.collect_list if repeated else F.collect_set
    pairs = db.both_ways().where("way <> '-' AND type <> ''")
    return pairs.groupBy("graph_id", "u", "v").agg(F.array_sort(gather("type")).alias("types"))


def vocabulary(db: GraphDB, by_graph: bool = False) -> DataFrame:
    """(kind, label) of all node labels and edge types, of each graph with by_graph."""
    keys = ["graph_id"] if by_graph else []
    nodes = db.nodes.select(*keys, F.lit("node").alias("kind"), F.explode("labels").alias("label"))
    edges = db.edges.where("type <> ''").select(*keys, F.lit("edge").alias("kind"), F.col("type").alias("label"))
    return nodes.unionAll(edges).distinct()


def edge_keys(db: GraphDB, type: str | None = None) -> DataFrame:
    """(graph_id, src, dst, keys), of all edges or those of a type."""
    e = db.edges if type is None else db.edges.where(F.col("type") == type)
    return e.groupBy("graph_id", "src", "dst").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def listed_edges(db: GraphDB) -> DataFrame:
    """All edges but those at dummy nodes."""
    dummies = db.nodes.where(F.array_contains("labels", DUMMY)).select("graph_id", "node_id")
    out = db.edges
    for end in ("src", "dst"):
        out = out.join(dummies.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    return out.select(*db.edges.columns)


def neighbours(db: GraphDB) -> DataFrame:
    """(graph_id, node_id, neighbours): the sorted nodes that an edge joins to a node, direction aside."""
    return db.both_ways().groupBy("graph_id", F.col("u").alias("node_id")).agg(F.array_sort(F.collect_set("v")).alias("neighbours"))


def adjacency(db: GraphDB) -> DataFrame:
    """(graph_id, node_id, targets): the nodes that edges from a node lead to; without direction, its neighbours."""
    return db.both_ways().where("way <> '-'").groupBy("graph_id", F.col("u").alias("node_id")).agg(F.array_sort(F.collect_set("v")).alias("targets"))


def pair_edges(db: GraphDB) -> DataFrame:
    """(graph_id, u, v, edges) with u <= v: all edges between two nodes, whatever their direction."""
    e = F.struct("src", "dst", "key", "type")
    return db.edges.groupBy("graph_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.array_sort(F.collect_list(e)).alias("edges"))


def degrees(db: GraphDB) -> DataFrame:
    """(graph_id, node_id, type, in_degree, out_degree): without direction both count all edges of the type."""
    sides = db.both_ways()
    into, out = (F.col("way") == "-", F.col("way") == "+") if db.directed else (F.lit(True), F.lit(True))
    return sides.groupBy("graph_id", F.col("u").alias("node_id"), "type").agg(F.count(F.when(into, 1)).alias("in_degree"), F.count(F.when(out, 1)).alias("out_degree"))


def total_degrees(db: GraphDB) -> DataFrame:
    """(graph_id, node_id, degree); nodes without edges have 0, a loop counts once for each way."""
    own = db.both_ways().groupBy("graph_id", F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))
    return db.nodes.select("graph_id", "node_id").join(own, ["graph_id", "node_id"], "left").fillna(0, ["degree"])


def jaccard(db: GraphDB, pairs: DataFrame) -> DataFrame:
    """pairs (graph_id, a, b) with similarity: shared neighbours over all neighbours of both, 0 if there are none."""
    near = neighbours(db)
    for end in ("a", "b"):
        pairs = pairs.join(near.select("graph_id", F.col("node_id").alias(end), F.col("neighbours").alias(f"__{end}")), ["graph_id", end], "left")
    none = F.array().cast("array<bigint>")
    a, b = F.coalesce("__a", none), F.coalesce("__b", none)
    together = F.size(F.array_union(a, b))
    return pairs.withColumn("similarity", F.when(together == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / together)).drop("__a", "__b")


def contains_attributes(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The nodes or edges that have all of these properties."""
    for k, v in wanted.items():
        df = df.where(F.col("props")[k].eqNullSafe(F.lit(v)))
    return df


def add_nodes(db: GraphDB, nodes: DataFrame) -> GraphDB:
    """The database with more nodes (graph_id, node_id, labels, props), which replace those of the same id."""
    kept = db.nodes.join(nodes, ["graph_id", "node_id"], "left_anti")
    return GraphDB(kept.unionByName(nodes), db.edges, db.directed)


def add_edges(db: GraphDB, edges: DataFrame) -> GraphDB:
    """The database with more edges (graph_id, src, dst, type, props), behind those that it has; new ends become nodes."""
    whole = db.edges.select(*db.edges.columns, F.lit(0).alias("__new")).unionByName(edges.withColumns({"key": F.lit(0), "__new": F.lit(1)}))
    whole = with_keys(whole, "__new", "key", "type").drop("__new").select(*db.edges.columns)
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().join(db.nodes, ["graph_id", "node_id"], "left_anti")
    new = ends.select("graph_id", "node_id", F.expr("cast(array() as array<string>)").alias("labels"), F.expr(NO_PROPS).alias("props"))
    return GraphDB(db.nodes.unionByName(new), whole, db.directed)


def remove_nodes(db: GraphDB, gone: DataFrame) -> GraphDB:
    """The database without some nodes (graph_id, node_id) and their edges."""
    e = db.edges
    for end in ("src", "dst"):
        e = e.join(gone.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_anti")
    return GraphDB(db.nodes.join(gone, ["graph_id", "node_id"], "left_anti").select(*db.nodes.columns), e.select(*db.edges.columns), db.directed)


def remove_edges(db: GraphDB, gone: DataFrame) -> GraphDB:
    """The database without some edges (graph_id, src, dst, key)."""
    return GraphDB(db.nodes, db.edges.join(gone, ["graph_id", "src", "dst", "key"], "left_anti").select(*db.edges.columns), db.directed)


def set_attributes(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes or edges with properties of new (keys, props) laid over theirs."""
    both = df.join(new.withColumnRenamed("props", "__more"), keys, "left")
    kept = F.map_filter("props", lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("__more", F.expr(NO_PROPS))), k))
    return both.withColumn("props", F.map_concat(kept, F.coalesce("__more", F.expr(NO_PROPS)))).select(*df.columns)


def reverse_edges(db: GraphDB) -> DataFrame:
    """The edges turned round, for traversals that need both ways in one table."""
    return db.edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "key", "type", "props")


def zero_indexed(db: GraphDB) -> GraphDB:
    """Nodes numbered from 0 in each graph, in order of their ids."""
    place = db.nodes.select("graph_id", "node_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1).cast("bigint").alias("place"))
    nodes = db.nodes.join(place, ["graph_id", "node_id"]).select("graph_id", F.col("place").alias("node_id"), "labels", "props")
    edges = db.edges
    for end in ("src", "dst"):
        edges = edges.join(place.select("graph_id", F.col("node_id").alias(end), F.col("place").alias(f"new_{end}")), ["graph_id", end])
    return GraphDB(nodes, edges.select("graph_id", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "key", "type", "props"), db.directed)


def induced(db: GraphDB, chosen: DataFrame) -> GraphDB:
    """The subgraphs on chosen nodes (graph_id, node_id), with all edges between them."""
    e = db.edges
    for end in ("src", "dst"):
        e = e.join(chosen.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
    return GraphDB(db.nodes.join(chosen, ["graph_id", "node_id"], "left_semi").select(*db.nodes.columns), e.select(*db.edges.columns), db.directed)


def self_loops(db: GraphDB) -> DataFrame:
    return db.edges.where("src = dst")


def mapped_graphs(db: GraphDB, rows: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(graph_id, node_map, nodes, edges) of the different mappings in rows: nodes has id and labels of each mapped node in the
    map's order, edges all distinct types on each of the pairs of pattern nodes."""
    out, key = rows.select("graph_id", "node_map").distinct(), ["graph_id", "node_map"]
    at = out.select(*key, F.posexplode("node_map").alias("place", "node_id")).join(db.nodes.select("graph_id", "node_id", "labels"), ["graph_id", "node_id"])
    nodes = at.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id", "labels"))), lambda x: F.struct(x["node_id"], x["labels"])).alias("nodes"))
    if not pairs:
        return nodes.withColumn("edges", F.expr("cast(array() as array<struct<u:bigint,v:bigint,types:array<string>>>)"))
    ends = F.array(*(F.struct(F.get("node_map", F.lit(s)).alias("u"), F.get("node_map", F.lit(d)).alias("v")) for s, d in pairs))
    e = out.select(*key, F.explode(ends).alias("e")).select(*key, "e.u", "e.v").join(edge_types(db), ["graph_id", "u", "v"], "left")
    edges = e.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("u", "v", "types"))).alias("edges"))
    return nodes.join(edges, key)


def profile(db: GraphDB) -> DataFrame:
    """(part, graphs, average, largest, smallest, deviation) of the numbers of nodes and edges of a graph."""
    nodes = db.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    edges = nodes.select("graph_id").join(db.edges.groupBy("graph_id").agg(F.count("*").alias("n")), "graph_id", "left").fillna(0, ["n"])
    stats = (F.count("*").alias("graphs"), F.avg("n").alias("average"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.stddev_samp("n").alias("deviation"))
    return nodes.agg(F.lit("nodes").alias("part"), *stats).unionAll(edges.agg(F.lit("edges").alias("part"), *stats))


def reified(db: GraphDB, type: str = "_") -> GraphDB:
    """For miners that don't look at edge types: in each graph, every edge of a type that occurs among parallel edges becomes a
    node of that label, joined to the edge's ends by edges of a plain type. New ids follow the largest, by (src, dst, key)."""
    many = db.edges.withColumn("n", F.count("*").over(Window.partitionBy("graph_id", "src", "dst"))).where("n > 1").select("graph_id", "type").distinct()
    turned = db.edges.join(many, ["graph_id", "type"], "left_semi")
    rest = db.edges.join(many, ["graph_id", "type"], "left_anti").select(*db.edges.columns)
    top = db.nodes.groupBy("graph_id").agg(F.max("node_id").alias("top"))
    new = turned.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst", "key"))).join(top, "graph_id").withColumn("node_id", F.col("top") + F.col("place"))
    nodes = db.nodes.unionByName(new.select("graph_id", "node_id", F.array("type").alias("labels"), "props"))
    halves = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("node_id").alias("b")), F.struct(F.col("node_id").alias("a"), F.col("dst").alias("b"))))
    edges = new.select("graph_id", halves.alias("h")).select("graph_id", F.col("h.a").alias("src"), F.col("h.b").alias("dst"), F.lit(0).alias("key"), F.lit(type).alias("type"), F.expr(NO_PROPS).alias("props"))
    return GraphDB(nodes, rest.unionByName(edges), db.directed)


def invalid_embeddings(db: GraphDB, patterns: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The embeddings that don't hold: a node is mapped twice, its labels differ, or an edge of the pattern has no counterpart
    of its type and number. Empty for what mine() returns."""
    p, key = patterns.select("pattern_id", F.col("labels").alias("wanted"), "edges"), ["pattern_id", "graph_id", "node_map"]
    rows = embeddings.join(p, "pattern_id")
    twice = rows.where(F.size(F.array_distinct("node_map")) < F.size("node_map")).select(*key)
    ends = rows.select(*key, F.explode(F.arrays_zip(F.col("node_map").alias("node"), "wanted")).alias("x")).select(*key, F.col("x.node").alias("node_id"), F.col("x.wanted").alias("wanted"))
    wrong = ends.join(db.nodes.select("graph_id", "node_id", "labels"), ["graph_id", "node_id"], "left").where(~F.col("labels").eqNullSafe(F.col("wanted"))).select(*key)
    e = rows.select(*key, F.explode("edges").alias("e")).select(*key, F.get("node_map", F.col("e.src")).alias("u"), F.get("node_map", F.col("e.dst")).alias("v"), F.col("e.type").alias("type"))
    need = e.groupBy(*key, "u", "v", "type").agg(F.count("*").alias("n"))
    have = db.both_ways().where("way <> '-'").groupBy("graph_id", "u", "v", "type").agg(F.count("*").alias("held"))
    lacking = need.join(have, ["graph_id", "u", "v", "type"], "left").where(F.coalesce("held", F.lit(0)) < F.col("n")).select(*key)
    return embeddings.join(twice.unionAll(wrong).unionAll(lacking).distinct(), key, "left_semi")


def edge_map(db: GraphDB, patterns: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(pattern_id, graph_id, node_map, edge_map): for each pattern edge, in order, the (src, dst, key) it is mapped to: the k-th
    edge of a type between two nodes to the k-th such key."""
    p = patterns.select("pattern_id", F.posexplode("edges").alias("place", "e")).select("pattern_id", "place", F.col("e.src").alias("s"), F.col("e.dst").alias("d"), F.col("e.type").alias("type"))
    if not db.directed:
        p = p.withColumns({"s": F.least("s", "d"), "d": F.greatest("s", "d")})
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("pattern_id", "s", "d", "type").orderBy("place")))
    target = db.both_ways().where("way <> '-'") if db.directed else db.both_ways()
    own = target.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id", "u", "v", "type").orderBy("key")))
    rows = embeddings.join(p, "pattern_id").withColumns({"u": F.get("node_map", F.col("s")), "v": F.get("node_map", F.col("d"))})
    found = rows.join(own.select("graph_id", "u", "v", "type", "rank", "key"), ["graph_id", "u", "v", "type", "rank"])
    e = F.struct("place", F.col("u").alias("src"), F.col("v").alias("dst"), "key")
    mapped = found.groupBy("pattern_id", "graph_id", "node_map").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: F.struct(x["src"], x["dst"], x["key"])).alias("edge_map"))
    return embeddings.join(mapped, ["pattern_id", "graph_id", "node_map"], "left").select("pattern_id", "graph_id", "node_map", F.coalesce("edge_map", F.expr("cast(array() as array<struct<src:bigint,dst:bigint,key:int>>)")).alias("edge_map"))
