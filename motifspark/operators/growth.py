"""Growing patterns: candidates for one more node or more edges, their support, and the embeddings of those that are kept.

patterns:   pattern_id, code, labels (of each node), edges (src, dst, type), n_nodes
embeddings: pattern_id, graph_id, node_map (target node of each pattern node)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import canonical
from ..graph import GraphDB, includes

EDGE_LIST = "array<struct<src:int,dst:int,type:string>>"
PATTERNS = f"pattern_id bigint, code string, labels array<array<string>>, edges {EDGE_LIST}, n_nodes int"


def one_node(db: GraphDB, least: int) -> DataFrame:
    """(labels, support, frequency) of nodes by their exact label list."""
    return db.nodes.groupBy("labels").agg(F.countDistinct("graph_id").alias("support"), F.count("*").alias("frequency")).where(F.col("support") >= least)


def coded(drafts: DataFrame, directed: bool) -> DataFrame:
    """drafts (labels, edges and other columns) with code and pattern_id. Drafts are a row for each candidate, not for each
    occurrence, and are coded in Arrow batches."""
    more = [f for f in drafts.schema.fields if f.name not in ("labels", "edges")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["code"] = [canonical([list(x) for x in labels], [(e["src"], e["dst"], e["type"]) for e in edges], directed)[0] for labels, edges in zip(pdf["labels"], pdf["edges"], strict=True)]
            yield pdf

    from pyspark.sql.types import StructType

    schema = StructType([drafts.schema["labels"], drafts.schema["edges"], *more]).add("code", "string")
    return drafts.select("labels", "edges", *(f.name for f in more)).mapInPandas(run, schema).withColumn("pattern_id", F.xxhash64("code"))


def neighbours(embeddings: DataFrame, bags: DataFrame) -> DataFrame:
    """(pattern_id, graph_id, node_map, p_node, v, labels, bag): every unmapped neighbour of every mapped node."""
    at = embeddings.select("pattern_id", "graph_id", "node_map", F.posexplode("node_map").alias("p_node", "u"))
    return at.join(bags, ["graph_id", "u"]).where(~F.array_contains("node_map", F.col("v"))).select("pattern_id", "graph_id", "node_map", "p_node", "v", "labels", "bag")


def including(bags: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """bags joined with the parts of the same keys that they include. A part meets only the bags that have its entry of the
    highest number, which are the fewest, so the bags of a key are not all compared with each other."""
    number = lambda x: F.regexp_extract(x, r"#(\d+)$", 1).cast("int")
    rarest = F.array_max(F.transform("part", lambda x: F.struct(number(x).alias("n"), x.alias("x"))))["x"]
    return bags.withColumn("entry", F.explode("bag")).join(parts.withColumn("entry", rarest), [*keys, "entry"]).where(includes(F.col("bag"), F.col("part"))).drop("entry")


def node_extensions(seen: DataFrame, least: int) -> DataFrame:
    """(pattern_id, p_node, labels, bag, support): the observed ways to add a node that enough graphs have, where a neighbour
    counts for its own bag of edges and for every observed bag that its own includes. seen: neighbours()."""
    keys = ["pattern_id", "p_node", "labels"]
    by_graph = seen.select(*keys, "bag", "graph_id").distinct()
    options = by_graph.select(*keys, F.col("bag").alias("part")).distinct()
    inside = including(by_graph, options, keys)
    return inside.groupBy(*keys, F.col("part").alias("bag")).agg(F.countDistinct("graph_id").alias("support")).where(F.col("support") >= least)


def _plain(types):
    """A numbered bag without its numbers."""
    return F.transform(types, lambda x: F.regexp_replace(x, r"#\d+$", ""))


def node_extended(patterns: DataFrame, extensions: DataFrame, directed: bool) -> DataFrame:
    """Drafts of patterns with one more node: labels, edges, and the extension they come from (parent, p_node, added, bag)."""
    new = F.col("n_nodes")
    p = F.col("p_node")

    def edge(x):
        name = F.substring(x, 2, 1 << 30) if directed else x
        ahead = F.struct(p.cast("int").alias("src"), new.cast("int").alias("dst"), name.alias("type"))
        if not directed:
            return ahead
        return F.when(x.startswith("+"), ahead).otherwise(F.struct(new.cast("int").alias("src"), p.cast("int").alias("dst"), name.alias("type")))

    found = extensions.select(F.col("pattern_id"), "p_node", F.col("labels").alias("added"), "bag").join(patterns.select("pattern_id", "labels", "edges", "n_nodes"), "pattern_id")
    return found.select(F.concat("labels", F.array("added")).alias("labels"), F.concat("edges", F.transform(_plain(F.col("bag")), edge)).alias("edges"), F.col("pattern_id").alias("parent"), "p_node", "added", "bag")


def node_grown(seen: DataFrame, chosen: DataFrame) -> DataFrame:
    """The embeddings of chosen drafts: (pattern_id, graph_id, node_map)."""
    drafts = chosen.select(F.col("pattern_id").alias("new_id"), F.col("parent").alias("pattern_id"), "p_node", F.col("added").alias("labels"), F.col("bag").alias("part"))
    return seen.join(drafts, ["pattern_id", "p_node", "labels"]).where(includes(F.col("bag"), F.col("part"))).select(F.col("new_id").alias("pattern_id"), "graph_id", F.array_append("node_map", F.col("v")).alias("node_map"))


def missing_edges(db_bags: DataFrame, embeddings: DataFrame, patterns: DataFrame, directed: bool) -> DataFrame:
    """(pattern_id, graph_id, node_map, i, j, bag): of every embedding of a pattern of three nodes or more, the target's edges
    from i to j that the pattern lacks, as a numbered multiset difference. With direction, loops count too; without, i < j."""
    large = embeddings.where(F.size("node_map") >= 3)
    ends = large.select("pattern_id", "graph_id", "node_map", F.posexplode("node_map").alias("i", "u"))
    found = ends.join(db_bags, ["graph_id", "u"]).withColumn("j", F.array_position("node_map", F.col("v")).cast("int") - 1).where("j >= 0" if directed else "i < j")
    end_a, end_b = (F.col("e.src"), F.col("e.dst")) if directed else (F.least("e.src", "e.dst"), F.greatest("e.src", "e.dst"))
    own = patterns.select("pattern_id", F.explode("edges").alias("e")).select("pattern_id", end_a.alias("i"), end_b.alias("j"), F.col("e.type").alias("type"))
    own = own.groupBy("pattern_id", "i", "j").agg(F.array_sort(F.collect_list("type")).alias("own"))
    joined = found.join(own, ["pattern_id", "i", "j"], "left")
    plain, mine = _plain(F.col("bag")), F.coalesce("own", F.array().cast("array<string>"))
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    # of the k-th entry of a type, those beyond the pattern's own remain, numbered anew
    rest = F.transform(F.filter(F.transform(F.col("bag"), lambda x: F.struct(F.regexp_replace(x, r"#\d+$", "").alias("t"), F.regexp_extract(x, r"#(\d+)$", 1).cast("int").alias("n"))), lambda s: s["n"] >= count(mine, s["t"])), lambda s: F.concat(s["t"], F.lit("#"), (s["n"] - count(mine, s["t"])).cast("string")))
    return joined.select("pattern_id", "graph_id", "node_map", "i", "j", rest.alias("bag")).where(F.size("bag") > 0)


def edge_extensions(missing: DataFrame, least: int) -> DataFrame:
    """(pattern_id, group, i, j, bag, covered): groups of edge bags to add together. The extensions that enough graphs have are
    grouped by the set of graphs that have them; a group takes, for each pair of nodes, the largest bag (then the first) whose
    graphs include the group's."""
    keys = ["pattern_id", "i", "j"]
    by_graph = missing.select(*keys, "bag", "graph_id").distinct()
    options = by_graph.select(*keys, F.col("bag").alias("part")).distinct()
    held = including(by_graph, options, keys).select(*keys, F.col("part").alias("bag"), "graph_id").distinct()
    h = F.xxhash64("graph_id")
    sets = held.groupBy(*keys, "bag").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s")).where(F.col("n") >= least)
    sets = sets.withColumn("group", F.struct("n", "x", "s"))
    one = sets.withColumn("k", F.row_number().over(Window.partitionBy("pattern_id", "group").orderBy("i", "j", "bag"))).where("k = 1").select("pattern_id", "group", "i", "j", "bag", F.col("n").alias("graphs"))
    members = held.join(one, [*keys, "bag"]).select("pattern_id", "group", "graphs", "graph_id")
    able = held.join(sets.select(*keys, "bag"), [*keys, "bag"], "left_semi")
    whole = members.join(able, ["pattern_id", "graph_id"]).groupBy("pattern_id", "group", "graphs", "i", "j", "bag").count().where("count = graphs")
    first = Window.partitionBy("pattern_id", "group", "i", "j").orderBy(F.desc(F.size("bag")), "bag")
    return whole.withColumn("k", F.row_number().over(first)).where("k = 1").select("pattern_id", "group", "i", "j", "bag")


def edge_extended(patterns: DataFrame, extensions: DataFrame) -> DataFrame:
    """Drafts of patterns with a group's edges: labels, edges, parent, group, additions."""
    made = F.transform(_plain(F.col("bag")), lambda t: F.struct(F.col("i").cast("int").alias("src"), F.col("j").cast("int").alias("dst"), t.alias("type")))
    groups = extensions.groupBy("pattern_id", "group").agg(F.array_sort(F.flatten(F.collect_list(made))).alias("more"), F.array_sort(F.collect_list(F.struct("i", "j", "bag"))).alias("additions"))
    return groups.join(patterns.select("pattern_id", "labels", "edges"), "pattern_id").select("labels", F.concat("edges", "more").alias("edges"), F.col("pattern_id").alias("parent"), "group", "additions")


def edge_grown(missing: DataFrame, chosen: DataFrame) -> DataFrame:
    """The embeddings that have all additions of a chosen draft: (pattern_id, graph_id, node_map)."""
    wanted = chosen.select(F.col("pattern_id").alias("new_id"), F.col("parent").alias("pattern_id"), F.size("additions").alias("n"), F.explode("additions").alias("a")).select("new_id", "pattern_id", "n", "a.i", "a.j", F.col("a.bag").alias("part"))
    held = missing.join(wanted, ["pattern_id", "i", "j"]).where(includes(F.col("bag"), F.col("part")))
    return held.groupBy("new_id", "graph_id", "node_map", "n").count().where("count = n").select(F.col("new_id").alias("pattern_id"), "graph_id", "node_map")


def counted(embeddings: DataFrame) -> DataFrame:
    """(pattern_id, support, frequency)."""
    by_graph = embeddings.groupBy("pattern_id", "graph_id").count()
    return by_graph.groupBy("pattern_id").agg(F.count("*").alias("support"), F.sum("count").alias("frequency"))


def per_graph(embeddings: DataFrame) -> DataFrame:
    """(pattern_id, graph_id, frequency)."""
    return embeddings.groupBy("pattern_id", "graph_id").agg(F.count("*").alias("frequency"))
