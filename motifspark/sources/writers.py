"""Databases and mined patterns as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import GraphDB
from ..operators import access
from ..plans.mine import Mined
from ..storage import shuffles_freed, written

RULE = "----------"


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def pattern_lines(labels: Column, edges: Column) -> Column:
    """A pattern's `v` and `e` records, one a line."""
    nodes = F.transform(labels, lambda x, k: _joined(F.lit("v"), k.cast("string"), F.array_join(x, " ")))
    lines = F.transform(edges, lambda e: _joined(F.lit("e"), e["src"].cast("string"), e["dst"].cast("string"), e["type"]))
    return F.array_join(F.transform(F.concat(nodes, lines), lambda x: F.rtrim(x)), "\n")


def graph_text(db: GraphDB) -> DataFrame:
    """(graph_id, value): each graph's records, to be written with df.select("value").write.text(). A graph is one row:
    write_graphs() is for large ones."""
    v = db.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", F.rtrim(_joined(F.lit("v"), F.col("node_id").cast("string"), F.array_join("labels", " "))).alias("line")))).alias("v"))
    e = db.edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "key", F.rtrim(_joined(F.lit("e"), F.col("src").cast("string"), F.col("dst").cast("string"), F.col("type"))).alias("line")))).alias("e"))
    head = F.concat(F.lit("t # "), F.col("graph_id"))
    lines = F.concat(F.array(head), F.transform("v", lambda x: x["line"]), F.coalesce(F.transform("e", lambda x: x["line"]), F.array().cast("array<string>")))
    return v.join(e, "graph_id", "left").select("graph_id", F.array_join(lines, "\n").alias("value"))


def graph_lines(db: GraphDB) -> DataFrame:
    """(value): the lines of graph_text(), in order, each record a row of its own. A graph's lines are in one partition, sorted
    there."""
    zero = F.lit(0).cast("bigint")
    line = lambda df, part, a, b, c, *words: df.select("graph_id", F.lit(part).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"), F.rtrim(_joined(*words)).alias("value"))
    graphs = db.nodes.select("graph_id").union(db.edges.select("graph_id")).distinct()
    v = line(db.nodes, 1, F.col("node_id"), zero, F.lit(0), F.lit("v"), F.col("node_id").cast("string"), F.array_join("labels", " "))
    e = line(db.edges, 2, F.col("src"), F.col("dst"), F.col("key"), F.lit("e"), F.col("src").cast("string"), F.col("dst").cast("string"), F.col("type"))
    rows = line(graphs, 0, zero, zero, F.lit(0), F.lit("t #"), F.col("graph_id")).union(v).union(e)
    return rows.repartition("graph_id").sortWithinPartitions("graph_id", "part", "a", "b", "c", "value").select("value")


def write_graphs(db: GraphDB, path: str) -> None:
    """graph_lines() as text files at path, to be read with read_data(); a graph is in one file."""
    with shuffles_freed(db.nodes.sparkSession):
        graph_lines(db).write.text(path)


def frequency_lines(embeddings: DataFrame) -> DataFrame:
    """(pattern_id, info): a line `graph count` for each graph that holds the pattern."""
    n = embeddings.groupBy("pattern_id", "graph_id").count()
    return n.groupBy("pattern_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("graph_id", "count"))), lambda x: _joined(x["graph_id"], x["count"].cast("string"))), "\n").alias("info"))


def mapping_lines(embeddings: DataFrame) -> DataFrame:
    """(pattern_id, info): for each graph its name, then a line of target node ids, in the pattern's order, for each mapping."""
    maps = F.transform(F.array_sort(F.collect_list("node_map")), lambda m: F.array_join(F.transform(m, lambda x: x.cast("string")), ","))
    n = embeddings.groupBy("pattern_id", "graph_id").agg(F.array_join(maps, "\n").alias("lines"))
    return n.groupBy("pattern_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("graph_id", "lines"))), lambda x: F.concat_ws("\n", x["graph_id"], x["lines"])), "\n").alias("info"))


def full_mappings(db: GraphDB, mined: Mined) -> DataFrame:
    """(pattern_id, graph_id, value): `({pattern node -> target node, ...}, {pattern edge -> target edge, ...})`."""
    rows = access.edge_map(db, mined.patterns, mined.embeddings).join(mined.patterns.select("pattern_id", "edges"), "pattern_id")
    nodes = F.array_join(F.transform("node_map", lambda x, k: F.concat(k.cast("string"), F.lit("->"), x.cast("string"))), ", ")
    triple = lambda a, b, c: F.concat(F.lit("("), F.concat_ws(", ", a.cast("string"), b.cast("string"), c), F.lit(")"))
    edges = F.array_join(F.zip_with("edges", "edge_map", lambda p, t: F.concat(triple(p["src"], p["dst"], p["type"]), F.lit("->"), triple(t["src"], t["dst"], t["key"].cast("string")))), ", ")
    return rows.select("pattern_id", "graph_id", F.concat(F.lit("({"), nodes, F.lit("}, {"), edges, F.lit("})")).alias("value"))


def numbered_patterns(patterns: DataFrame) -> DataFrame:
    """patterns with number, from 1 by size and code: counted in ranges, each in a task of its own."""
    dealt = patterns.repartitionByRange("n_nodes", "n_edges", "code").sortWithinPartitions("n_nodes", "n_edges", "code")
    rows = written(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered-patterns")
    rows = rows.withColumns({"range": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    sums = rows.groupBy("range").agg(F.count("*").alias("n"))  # one row for each range
    before = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return rows.join(before, "range").withColumn("number", F.col("before") + F.col("place") + 1).drop("at", "range", "place", "before")


def _head(number: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("t # "), number.cast("string")), pattern_lines(F.col("labels"), F.col("edges")), F.concat(F.lit("s "), F.col("support").cast("string")), F.concat(F.lit("f "), F.col("frequency").cast("string")))


def format_patterns(mined: Mined, with_frequencies: bool = False, show_mappings: bool = False) -> DataFrame:
    """(number, value): a block of text for each pattern, by size and code: records, `s` support, `f` frequency, on request the
    graphs it is in, and a rule. A block is one row: write_patterns() is for results whose mappings are many."""
    p = numbered_patterns(mined.patterns)
    info = F.lit("")
    if with_frequencies or show_mappings:
        p = p.join(mapping_lines(mined.embeddings) if show_mappings else frequency_lines(mined.embeddings), "pattern_id", "left")
        info = F.concat(F.lit("\n\ninfo:\n"), F.coalesce("info", F.lit("")))
    return p.select("number", F.concat(_head(F.col("number")), info, F.lit("\n" + RULE)).alias("value"))


def pattern_text(mined: Mined, with_frequencies: bool = False, show_mappings: bool = False) -> DataFrame:
    """(value): the lines of format_patterns(), in order, each graph and each mapping a row of its own. A pattern's lines are in
    one partition, sorted there."""
    p = numbered_patterns(mined.patterns)
    nothing = F.expr("cast(array() as array<bigint>)")
    line = lambda df, part, value, graph=F.lit(""), node_map=nothing: df.select("number", F.lit(part).alias("part"), graph.alias("graph"), node_map.alias("node_map"), value.alias("value"))
    parts = [line(p, 0, _head(F.col("number"))), line(p, 3, F.lit(RULE))]
    if with_frequencies or show_mappings:
        parts.append(line(p, 1, F.lit("\ninfo:")))
        found = mined.embeddings.join(p.select("pattern_id", "number"), "pattern_id")
        graphs = found.groupBy("number", "graph_id").agg(F.count("*").alias("n"))
        parts.append(line(graphs, 2, F.col("graph_id") if show_mappings else _joined(F.col("graph_id"), F.col("n").cast("string")), F.col("graph_id")))
        if show_mappings:
            parts.append(line(found, 2, F.array_join(F.transform("node_map", lambda x: x.cast("string")), ","), F.col("graph_id"), F.col("node_map")))
    return reduce(DataFrame.unionAll, parts).repartitionByRange("number").sortWithinPartitions("number", "part", "graph", "node_map").select("value")


def write_patterns(mined: Mined, path: str, with_frequencies: bool = False, show_mappings: bool = False) -> None:
    """pattern_text() as text files at path, which hold the lines in the files' order."""
    pattern_text(mined, with_frequencies, show_mappings).write.mode("overwrite").text(path)
