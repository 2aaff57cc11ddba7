"""Graph databases from text records (.data), CSV directories and JSON node-link files, as Spark reads them.

Text records: `t # <number> [<name>]` begins a graph, `v <id> [label ...]` is a node, `e <src> <dst> [type ...]` gives one
edge for each type, or one without a type. Other lines are ignored. A graph's name is the fourth token of its first line, or
else the third; of graphs with one name, and of nodes with one id, the last counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import GraphDB, graph_db, with_keys
from ..storage import written


def _records(text: DataFrame, multi_row: bool, separator: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of rows (graph_id, pos, line), pos being the order of a graph's records."""
    lines = text.withColumn("tokens", F.filter(F.split(F.trim(F.regexp_replace("line", r"\r$", "")), " "), lambda x: F.trim(x) != ""))
    kind = F.get("tokens", F.lit(0))
    number = lambda of, k: F.when(kind == of, F.get("tokens", F.lit(k)).cast("bigint"))  # noqa: E731  Spark may cast before it filters
    rest = F.slice("tokens", 3, F.greatest(F.size("tokens") - 2, F.lit(0)))
    nodes = lines.where(kind == "v").select("graph_id", number("v", 1).alias("node_id"), "pos", rest.alias("labels"))
    if multi_row:
        nodes = nodes.groupBy("graph_id", "node_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "labels"))), lambda x: x["labels"])).alias("labels"))
    else:
        nodes = nodes.groupBy("graph_id", "node_id").agg(F.max_by("labels", "pos").alias("labels"))
    if separator != " ":
        nodes = nodes.withColumn("labels", F.flatten(F.transform("labels", lambda x: F.split(x, F.lit("\\Q" + separator + "\\E")))))
    types = F.slice("tokens", 4, F.greatest(F.size("tokens") - 3, F.lit(0)))
    edges = lines.where(kind == "e").select("graph_id", number("e", 1).alias("src"), number("e", 2).alias("dst"), "pos", F.posexplode(F.when(F.size(types) == 0, F.array(F.lit(""))).otherwise(types)).alias("place", "type"))
    return nodes, with_keys(edges, "pos", "place").drop("pos", "place")


_LINES = "value string, pos bigint, head bigint, file string, block bigint"


def _with_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, file, block, id) of the lines of file blocks, in order, as rows of _LINES: pos orders the lines of a file, and
    head is the id of the last line before or at this one, in its block, that begins a graph. Only lines without one, and those
    that begin a graph, keep file and block."""
    place, seen, carried = None, 0, -1
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        value, file, block, ids = batch.columns
        at, blocks, ids = np.arange(n), block.to_numpy(), ids.to_numpy()
        first = np.ones(n, bool)
        first[0] = place != (file[0].as_py(), blocks[0])
        first[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        since = np.maximum.accumulate(np.where(first, at, -1))  # -1: the block goes on from the batch before
        begins = pc.starts_with(value, "t ").to_numpy(zero_copy_only=False)
        own = np.maximum.accumulate(np.where(begins, at, -1))
        head = np.where((own >= 0) & (own >= since), ids[own], np.where(since < 0, carried, -1))
        index = np.where(since < 0, at + seen, at - since)
        place, seen, carried = (file[n - 1].as_py(), blocks[-1]), index[-1] + 1, head[-1]
        named = pa.array(begins | (head < 0))
        # a block has at most one line more than bytes, so positions of different blocks differ
        columns = [value, pa.array(2 * blocks + index), pa.array(head, mask=head < 0), pc.if_else(named, file, None), pc.if_else(named, block, None)]
        yield pa.RecordBatch.from_arrays(columns, names=["value", "pos", "head", "file", "block"])


def _graph_lines(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, pos, line): the lines of the graphs that count. A line belongs to the last line before it that begins a graph,
    which may stand in an earlier block of its file: no row and no task holds a whole graph."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = written(raw.mapInArrow(_with_heads, _LINES), "text-lines")
    heads = written(lines.where(F.col("value").startswith("t ")), "text-heads")
    tokens = F.filter(F.split(F.regexp_replace(F.substring("value", 3, 1 << 30), r"\r$", ""), " "), lambda x: F.trim(x) != "")
    named = heads.withColumn("t", tokens).where(F.get("t", F.lit(0)) == "#").withColumn("graph_id", F.trim(F.coalesce(F.get("t", F.lit(2)), F.get("t", F.lit(1)))))
    last = named.withColumn("n", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("file"), F.desc("pos")))).where("n = 1")
    graphs = written(last.select("head", "graph_id"), "text-graphs")
    # of lines before the first graph that begins in their block: a row for each block
    open_ = lines.where("head IS NULL").select("file", "block").distinct()
    blocks = open_.join(heads.groupBy("file", "block").agg(F.max_by("head", "pos").alias("last")), ["file", "block"], "full")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = written(blocks.withColumn("before", before).where("before IS NOT NULL").select("file", "block", "before"), "text-blocks")
    rest = lines.where("head IS NULL").join(blocks, ["file", "block"]).select(F.col("before").alias("head"), "pos", "value")
    return lines.where("head IS NOT NULL").select("head", "pos", "value").union(rest).join(graphs, "head").select("graph_id", "pos", F.col("value").alias("line"))


def read_data(spark: SparkSession, path: str, directed: bool = False, multi_row: bool = False, label_separator: str = " ", multigraph: bool = True) -> GraphDB:
    """A text database. Files are read in blocks, so a graph may be larger than a task's memory."""
    nodes, edges = _records(_graph_lines(spark, path), multi_row, label_separator)
    db = graph_db(nodes, edges, directed)
    return db if multigraph else simple(db)


def simple(db: GraphDB) -> GraphDB:
    """Only the last of parallel edges."""
    w = Window.partitionBy("graph_id", "src", "dst").orderBy(F.desc("key"))
    last = db.edges.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").withColumn("key", F.lit(0))
    return GraphDB(db.nodes, last, db.directed)


def _csv_rows(spark: SparkSession, pattern: str, sep: str) -> DataFrame:
    """(graph_id, values, fields, order): each line of the CSV files, split, and by the names in its own file's first line."""
    text = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"))
    text = text.withColumn("value", F.regexp_replace("value", r"\r$", "")).where(F.trim("value") != "")
    heads = written(text.where("block = 0").groupBy("file").agg(F.min_by("value", "order").alias("head")), "csv-heads")
    width = heads.agg(F.max(F.size(F.split("head", F.lit("\\Q" + sep + "\\E"))))).first()[0] or 1
    split = lambda c: F.from_csv(c, ", ".join(f"c{k} string" for k in range(width)), {"sep": sep})
    values = lambda c: F.array(*(F.col(f"{c}.c{k}") for k in range(width)))
    heads = heads.withColumn("h", split(F.col("head"))).select("file", "head", values("h").alias("names"))
    body = F.col("value") != F.col("head")  # lines like the first are no data either
    rows = text.join(heads, "file").where(body).withColumn("v", F.when(body, split(F.col("value")))).withColumn("values", values("v"))
    named = F.filter(F.arrays_zip(F.col("names").alias("k"), F.col("values").alias("v")), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    return rows.select(F.element_at(F.split("file", "/"), -3).alias("graph_id"), "names", "values", F.map_from_entries(named).alias("fields"), "order")


def read_csv(spark: SparkSession, path: str, directed: bool = False, nodes_dir: str = "nodes", edges_dir: str = "edges", sep: str = ",", label_separator: str = ":", id_column: str = "node_id", labels_column: str = "labels", type_column: str = "type", multigraph: bool = True) -> GraphDB:
    """<path>/<graph>/<nodes_dir>/*.csv and <path>/<graph>/<edges_dir>/*.csv. Each file's columns are those of its own first
    line, so files may differ in them. The first two columns of an edge file are its ends; columns without a role are
    properties, by name."""
    rows = lambda role: _csv_rows(spark, f"{path.rstrip('/')}/*/{role}/*.csv", sep)
    n, e = rows(nodes_dir), rows(edges_dir)
    without = lambda *gone: F.map_filter("fields", lambda k, _: ~F.array_contains(F.array(*gone), k))
    labels = F.filter(F.split(F.coalesce(F.col("fields")[labels_column], F.lit("")), "\\Q" + label_separator + "\\E"), lambda x: x != "")
    nodes = n.select("graph_id", F.col("fields")[id_column].cast("bigint").alias("node_id"), labels.alias("labels"), without(F.lit(id_column), F.lit(labels_column)).alias("props"))
    end = lambda k: F.get("values", F.lit(k)).cast("bigint")
    props = without(F.coalesce(F.get("names", F.lit(0)), F.lit("")), F.coalesce(F.get("names", F.lit(1)), F.lit("")), F.lit(type_column))
    edges = e.select("graph_id", end(0).alias("src"), end(1).alias("dst"), F.coalesce(F.col("fields")[type_column], F.lit("")).alias("type"), props.alias("props"), "order")
    db = graph_db(nodes, with_keys(edges, "order").drop("order"), directed)
    return db if multigraph else simple(db)


def read_json(spark: SparkSession, path: str, directed: bool = False, multigraph: bool = True) -> GraphDB:
    """A directory of node-link files, one graph each, named like its file. Node ids that aren't integers are numbered by
    their order in the file; "labels" (a list) and "type" have their roles, other fields are properties."""
    files = spark.read.text(f"{path.rstrip('/')}/*.json", wholetext=True)
    doc = F.from_json("value", "nodes array<map<string,string>>, links array<map<string,string>>")
    graphs = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("graph_id"), doc.alias("d"))
    plain = graphs.select("graph_id", F.posexplode("d.nodes").alias("pos", "n"))
    whole = plain.groupBy("graph_id").agg(F.bool_and(F.col("n")["id"].try_cast("bigint").isNotNull()).alias("whole"))
    plain = plain.join(whole, "graph_id").withColumn("node_id", F.when(F.col("whole"), F.col("n")["id"].try_cast("bigint")).otherwise(F.col("pos").cast("bigint")))
    nodes = plain.select("graph_id", "node_id", F.coalesce(F.from_json(F.col("n")["labels"], "array<string>"), F.array().cast("array<string>")).alias("labels"), F.map_filter("n", lambda k, v: ~k.isin("id", "labels") & v.isNotNull()).alias("props"))
    ids = plain.select("graph_id", F.col("n")["id"].alias("id"), "node_id")
    links = graphs.select("graph_id", F.posexplode("d.links").alias("pos", "l"))
    edges = (
        links.join(ids.select("graph_id", F.col("id").alias("s"), F.col("node_id").alias("src")), ["graph_id"], "inner").where(F.col("l")["source"] == F.col("s"))
        .join(ids.select("graph_id", F.col("id").alias("t"), F.col("node_id").alias("dst")), ["graph_id"], "inner").where(F.col("l")["target"] == F.col("t"))
        .select("graph_id", "src", "dst", F.coalesce(F.col("l")["type"], F.lit("")).alias("type"), F.map_filter("l", lambda k, v: ~k.isin("source", "target", "type", "key") & v.isNotNull()).alias("props"), "pos")
    )
    db = graph_db(nodes, with_keys(edges, "pos").drop("pos"), directed)
    return db if multigraph else simple(db)


READERS: dict[str, Callable[..., GraphDB]] = {"data": read_data, "txt": read_data, "csv": read_csv, "json": read_json}


def read_graph_db(spark: SparkSession, path: str, format: str | None = None, config_dir: str | None = None, **options) -> GraphDB:
    """The reader for a format, which is the path's extension unless given. Options of the format's file in config_dir hold
    where none are given here."""
    kind = (format or path.rstrip("/").rpartition(".")[2]).lower()
    if kind not in READERS:
        raise ValueError(f"format not supported: {kind!r}; known: {', '.join(sorted(READERS))}")
    if config_dir is not None:
        options = configured(spark, config_dir, kind) | options
    return READERS[kind](spark, path, **options)


#: Names of options in config files, which must match: theirs and the readers'.
CONFIG_NAMES = {
    "is_mr": "multi_row", "sep_label": "label_separator", "is_directed": "directed", "is_multigraph": "multigraph",
    "sep_feat": "sep", "nodes_path": "nodes_dir", "edges_path": "edges_dir", "id_col_nm": "id_column", "label_col_nm": "labels_column",
}
_FLAGS = ("multi_row", "directed", "multigraph")


def configured(spark: SparkSession, config_dir: str, format: str) -> dict:
    """The reader's options in <config_dir>/<format>_conf.json, a file that any store of Spark's may hold."""
    text = spark.read.text(f"{config_dir.rstrip('/')}/{format.lower()}_conf.json", wholetext=True).first()[0]
    known = {CONFIG_NAMES[k]: v for k, v in json.loads(text).items() if k in CONFIG_NAMES and v != ""}
    return {k: bool(int(v)) if k in _FLAGS else v for k, v in known.items()}


def parse_patterns(text: str) -> list[tuple[list[list[str]], list[tuple[int, int, str]]]]:
    """Template graphs of a (small) text: (labels, edges) each, nodes renumbered from 0 in ascending order of their ids. Lines
    before any `t` line make a graph too."""
    graphs: list[tuple[dict[int, list[str]], list]] = []
    for line in text.splitlines():
        tokens = line.split()
        if tokens[:1] == ["t"] or (not graphs and tokens[:1] in (["v"], ["e"])):
            graphs.append(({}, []))
        if tokens[:1] == ["v"]:
            graphs[-1][0][int(tokens[1])] = sorted(tokens[2:])
        elif tokens[:1] == ["e"]:
            graphs[-1][1].extend((int(tokens[1]), int(tokens[2]), t) for t in tokens[3:] or [""])
    out = []
    for nodes, edges in graphs:
        for s, d, _ in edges:
            nodes.setdefault(s, [])
            nodes.setdefault(d, [])
        place = {v: k for k, v in enumerate(sorted(nodes))}
        out.append(([nodes[v] for v in sorted(nodes)], [(place[s], place[d], t) for s, d, t in edges]))
    return out


def read_templates(spark: SparkSession, path: str) -> list[tuple[list[list[str]], list[tuple[int, int, str]]]]:
    """Templates of a text file, which are few and small: they shape the plan, so the driver reads them."""
    return [g for (text,) in spark.read.text(path, wholetext=True).collect() for g in parse_patterns(text)]
