"""The data model: a database of labelled multigraphs as two tables.

nodes: graph_id, node_id, labels (sorted), props
edges: graph_id, src, dst, key (0.. within graph_id, src, dst), type ('' if the edge has none), props
Whether edges have a direction is a property of the database, not of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

NODES = "graph_id string, node_id bigint, labels array<string>, props map<string,string>"
EDGES = "graph_id string, src bigint, dst bigint, key int, type string, props map<string,string>"
NO_PROPS = "cast(map() as map<string,string>)"


@dataclass(frozen=True)
class GraphDB:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    def both_ways(self) -> DataFrame:
        """(graph_id, u, v, key, type, way): every edge from both of its ends; way is '+' along it and '-' against it, or
        '' if edges have no direction. A loop comes once for each way, or once."""
        e = self.edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), "key", "type", F.lit("+" if self.directed else "").alias("way"))
        back = self.edges.select("graph_id", F.col("dst").alias("u"), F.col("src").alias("v"), "key", "type", F.lit("-" if self.directed else "").alias("way"))
        return e.unionAll(back if self.directed else back.where("u <> v"))

    def pair_bags(self) -> DataFrame:
        """(graph_id, u, v, labels of v, bag): all edges between two different nodes as a numbered bag, from both ends."""
        pairs = self.both_ways().where("u <> v").groupBy("graph_id", "u", "v").agg(numbered(F.collect_list(F.concat("way", "type"))).alias("bag"))
        ends = self.nodes.select("graph_id", F.col("node_id").alias("v"), "labels")
        return pairs.join(ends, ["graph_id", "v"]).select("graph_id", "u", "v", "labels", "bag")

    def directed_bags(self) -> DataFrame:
        """(graph_id, u, v, bag): the edges from u to v, loops too; without direction, those between u and v, from both ends."""
        e = self.both_ways().where("way <> '-'")
        return e.groupBy("graph_id", "u", "v").agg(numbered(F.collect_list("type")).alias("bag"))

    def count(self) -> int:
        return self.nodes.select("graph_id").distinct().count()

    def stored(self) -> GraphDB:
        """The database as tables in the shared folder, for plans that read it more than once."""
        return GraphDB(written(self.nodes, "nodes"), written(self.edges, "edges"), self.directed)

    def persist(self) -> GraphDB:
        return GraphDB(self.nodes.persist(), self.edges.persist(), self.directed)


def numbered(types) -> F.Column:
    """A multiset as a sorted set: the k-th equal entry x becomes 'x#k', so that inclusion is inclusion of sets. Most pairs of
    nodes have one edge, for which nothing needs to be sorted."""
    ordered = F.sort_array(types)
    several = F.transform(ordered, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(ordered, x) + 1).cast("string")))
    return F.when(F.size(types) == 1, F.array(F.concat(F.get(types, F.lit(0)), F.lit("#0")))).otherwise(several)


def includes(larger, smaller) -> F.Column:
    return F.size(F.array_except(smaller, larger)) == 0


def with_keys(edges: DataFrame, *order) -> DataFrame:
    """Edges with their key: the place among the parallel edges, in the given order."""
    return edges.withColumn("key", F.row_number().over(Window.partitionBy("graph_id", "src", "dst").orderBy(*order)) - 1)


def graph_db(nodes: DataFrame, edges: DataFrame, directed: bool = False, complete: bool = False) -> GraphDB:
    """A database from tables that may lack key and props: labels are sorted, ends without a node row become nodes without
    labels (unless the node table is known to be complete), missing types become ''."""
    if "props" not in nodes.columns:
        nodes = nodes.withColumn("props", F.expr(NO_PROPS))
    if "props" not in edges.columns:
        edges = edges.withColumn("props", F.expr(NO_PROPS))
    edges = edges.withColumn("type", F.coalesce("type", F.lit("")))
    if "key" not in edges.columns:
        edges = with_keys(edges, "type")
    own = nodes.select(F.col("graph_id").cast("string"), F.col("node_id").cast("bigint"), F.array_sort(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"), "props")
    edges = edges.select(F.col("graph_id").cast("string"), F.col("src").cast("bigint"), F.col("dst").cast("bigint"), F.col("key").cast("int"), "type", "props")
    if complete:
        return GraphDB(own, edges, directed)
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    implied = ends.join(own, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id", F.expr("cast(array() as array<string>)").alias("labels"), F.expr(NO_PROPS).alias("props"))
    return GraphDB(own.unionByName(implied), edges, directed)
