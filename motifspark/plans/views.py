"""Graph databases over the relational tables, only the columns that each needs being read."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import GraphDB, graph_db
from ..storage import written


#: Types that event_type() numbers in the plan.
MOST_TYPES = 1000


def _table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(lines, nodes, edges, directed: bool, stored: bool) -> GraphDB:
    """A database of the nodes and edges that two functions take from one table, which is written once if both are."""
    if stored:
        lines = written(lines, "view-lines")
    db = graph_db(nodes(lines), edges(lines), directed, complete=True)
    return db.stored() if stored else db


def trade(spark: SparkSession, sf_dir: str, directed: bool = True, stored: bool = False) -> GraphDB:
    """A graph for each nation: its customers (2k, by segment) and the parts they ordered (2k + 1, by brand), an edge for each
    line of an order, of its return flag."""
    t = lambda n: _table(spark, sf_dir, n)
    lines = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("c_nationkey").cast("string").alias("graph_id"), (2 * F.col("c_custkey")).alias("src"), (2 * F.col("p_partkey") + 1).alias("dst"), F.col("l_returnflag").alias("type"), F.col("c_mktsegment").alias("a"), F.col("p_brand").alias("b"))
    )
    ends = F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.array("a").alias("labels")), F.struct(F.col("dst").alias("node_id"), F.array("b").alias("labels"))))
    nodes = lambda x: x.select("graph_id", ends.alias("n")).select("graph_id", "n.node_id", "n.labels").distinct()
    return _shared(lines, nodes, lambda x: x.select("graph_id", "src", "dst", "type"), directed, stored)


def order(spark: SparkSession, sf_dir: str, stored: bool = False) -> GraphDB:
    """A graph for each order: the order (0, by priority and status), its parts (2k + 1, by brand) and their suppliers (2k + 2,
    'supplier'); edges from order to part by return flag and from part to supplier, 'supplied_by'."""
    t = lambda n: _table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    g, part, supplier = F.col("o_orderkey").cast("string").alias("graph_id"), 2 * F.col("l_partkey") + 1, 2 * F.col("l_suppkey") + 2
    zero = F.lit(0).cast("bigint")
    node = lambda v, labels: F.struct(v.alias("node_id"), labels.alias("labels"))
    edge = lambda s, d, k: F.struct(s.alias("src"), d.alias("dst"), k.alias("type"))
    n = F.explode(F.array(node(zero, F.array("o_orderpriority", "o_orderstatus")), node(part, F.array("p_brand")), node(supplier, F.array(F.lit("supplier")))))
    e = F.explode(F.array(edge(zero, part, F.col("l_returnflag")), edge(part, supplier, F.lit("supplied_by"))))
    lines = lines.select("o_orderkey", "l_partkey", "l_suppkey", "o_orderpriority", "o_orderstatus", "p_brand", "l_returnflag")
    return _shared(lines, lambda x: x.select(g, n.alias("n")).select("graph_id", "n.*").distinct(), lambda x: x.select(g, e.alias("e")).select("graph_id", "e.*"), True, stored)


def _steps(spark: SparkSession, sf_dir: str):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return e.withColumns({"next_id": F.lead("event_id").over(w), "next_type": F.lead("event_type").over(w), "next_ts": F.lead("ts").over(w)})


def event_path(spark: SparkSession, sf_dir: str) -> GraphDB:
    """A graph for each user: events by type, each with an edge 'next' to the user's next event."""
    s = _steps(spark, sf_dir)
    nodes = s.select(F.col("user_id").cast("string").alias("graph_id"), F.col("event_id").alias("node_id"), F.array("event_type").alias("labels"))
    edges = s.where("next_id IS NOT NULL").select(F.col("user_id").cast("string").alias("graph_id"), F.col("event_id").alias("src"), F.col("next_id").alias("dst"), F.lit("next").alias("type"))
    return graph_db(nodes, edges, True, complete=True)


def event_skip(spark: SparkSession, sf_dir: str) -> GraphDB:
    """event_path() with an edge 'skip' from each event to the one after the next, if both are on one day: triangles."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("graph_id"), "event_id", "event_type", "ts", *(x for k, n in ((1, "next"), (2, "skip")) for x in (F.lead("event_id", k).over(w).alias(n), F.lead("ts", k).over(w).alias(f"{n}_ts"))))
    nodes = s.select("graph_id", F.col("event_id").alias("node_id"), F.array("event_type").alias("labels"))
    skip = F.when(F.to_date("ts") == F.to_date("skip_ts"), F.col("skip"))
    e = F.explode(F.array(F.struct(F.col("next").alias("dst"), F.lit("next").alias("type")), F.struct(skip.alias("dst"), F.lit("skip").alias("type"))))
    edges = s.select("graph_id", F.col("event_id").alias("src"), e.alias("e")).select("graph_id", "src", "e.*").where("dst IS NOT NULL")
    return graph_db(nodes, edges, True, complete=True)


def event_type(spark: SparkSession, sf_dir: str) -> GraphDB:
    """A graph for each user: the event types, with an edge for each pair of consecutive events, by whether the day is one."""
    s = _steps(spark, sf_dir)
    names = [r[0] for r in s.select("event_type").distinct().limit(MOST_TYPES + 1).collect()]
    if len(names) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types")
    place = F.array(*map(F.lit, sorted(x for x in names if x is not None))).cast("array<string>")
    own = s.where("event_type IS NOT NULL").withColumn("src", F.array_position(place, F.col("event_type")) - 1)
    nodes = own.select(F.col("user_id").cast("string").alias("graph_id"), F.col("src").alias("node_id"), F.array("event_type").alias("labels")).distinct()
    edges = own.where("next_type IS NOT NULL").select(F.col("user_id").cast("string").alias("graph_id"), "src", (F.array_position(place, F.col("next_type")) - 1).alias("dst"), F.when(F.to_date("ts") == F.to_date("next_ts"), "same").otherwise("later").alias("type"))
    return graph_db(nodes, edges, True, complete=True)


def dialogue(spark: SparkSession, sf_dir: str) -> GraphDB:
    """A graph for each conversation: turns by role, each with an edge 'reply' to the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("graph_id"), "turn", "role", F.lead("turn").over(w).alias("next"))
    nodes = t.select("graph_id", F.col("turn").alias("node_id"), F.array("role").alias("labels"))
    return graph_db(nodes, t.where("next IS NOT NULL").select("graph_id", F.col("turn").alias("src"), F.col("next").alias("dst"), F.lit("reply").alias("type")), True, complete=True)
