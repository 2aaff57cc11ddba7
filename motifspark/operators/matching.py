"""Matching one small query graph against all graphs of a database, as a chain of joins: one edge table for each query edge, in
an order that keeps the bound part connected, with the label, injectivity and symmetry conditions in the joins.

A query is (labels, edges): label lists of nodes 0.. (a node must have at least these; none: any node) and (src, dst, type)
triples ('': any type).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import automorphisms, connected
from ..graph import GraphDB, includes

Query = tuple[list[list[str]], list[tuple[int, int, str]]]


def edge_order(query: Query, counts: dict[int, int] | None = None) -> list[int]:
    """Query edges, rarest first (by counts, the database's edges that fit each), each but the first with a bound end; of
    these, edges with both ends bound come before others."""
    _, edges = query
    left, order, bound = set(range(len(edges))), [], set()
    while left:
        size = lambda k: (counts or {}).get(k, 0)
        k = min(left, key=lambda k: (-sum(v in bound for v in set(edges[k][:2])) if bound else 0, size(k), k))
        order.append(k)
        bound |= set(edges[k][:2])
        left.discard(k)
    return order


def fitting_edges(db: GraphDB, query: Query, k: int) -> DataFrame:
    """(graph_id, s, d, key, type, turned) of database edges that query edge k may be mapped to, ends' labels not yet looked at.
    Without direction every edge comes from both ends; (turned, key) name it."""
    _, edges = query
    s, d, t = edges[k]
    e = db.edges.select("graph_id", F.col("src").alias("s"), F.col("dst").alias("d"), "key", "type", F.lit(0).alias("turned"))
    if not db.directed:
        e = e.unionAll(db.edges.where("src <> dst").select("graph_id", F.col("dst").alias("s"), F.col("src").alias("d"), "key", "type", F.lit(1).alias("turned")))
    if t:
        e = e.where(F.col("type") == t)
    return e.where("s = d") if s == d else e.where("s <> d")


def edge_counts(db: GraphDB, query: Query) -> dict[int, int]:
    """How many database edges fit each query edge by type and end labels, for edge_order(): a number for each query edge."""
    labels, edges = query
    out = {}
    for k, (s, d, _) in enumerate(edges):
        e = fitting_edges(db, query, k)
        for column, v in (("s", s), ("d", d)):
            if labels[v]:
                fit = db.nodes.where(includes(F.col("labels"), F.array(*map(F.lit, labels[v])))).select("graph_id", F.col("node_id").alias(column))
                e = e.join(fit, ["graph_id", column], "left_semi")
        out[k] = e.count()
    return out


def vocabulary_filter(db: GraphDB, query: Query) -> DataFrame:
    """(graph_id) of graphs that have every label and edge type of the query."""
    labels, edges = query
    wanted = sorted({x for l in labels for x in l})
    types = sorted({t for _, _, t in edges if t})
    graphs = db.nodes.select("graph_id").distinct()
    if wanted:
        have = db.nodes.select("graph_id", F.explode("labels").alias("x")).where(F.col("x").isin(wanted)).groupBy("graph_id").agg(F.countDistinct("x").alias("n"))
        graphs = graphs.join(have.where(F.col("n") == len(wanted)).select("graph_id"), "graph_id", "left_semi")
    if types:
        have = db.edges.where(F.col("type").isin(types)).groupBy("graph_id").agg(F.countDistinct("type").alias("n"))
        graphs = graphs.join(have.where(F.col("n") == len(types)).select("graph_id"), "graph_id", "left_semi")
    return graphs


def degree_domain(db: GraphDB, query: Query) -> DataFrame:
    """(node, graph_id, node_id): for each query node, the database nodes with its labels and, for every edge type of the
    query, at least its in- and out-degree. What match() finds lies within; it is a filter, not needed for results."""
    labels, edges = query
    real = db.both_ways().where("u <> v")
    degrees = real.groupBy("graph_id", F.col("u").alias("node_id"), "way", "type").count()
    out = None
    for v, wanted in enumerate(labels):
        nodes = db.nodes.where(includes(F.col("labels"), F.array(*map(F.lit, wanted)).cast("array<string>"))).select("graph_id", "node_id")
        need: dict[tuple, int] = {}
        for s, d, t in edges:
            if t and s != d:
                for end, way in ((s, "+"), (d, "-")):
                    if end == v:
                        key = (way if db.directed else "", t)
                        need[key] = need.get(key, 0) + 1
        for (way, t), n in sorted(need.items()):
            nodes = nodes.join(degrees.where((F.col("way") == way) & (F.col("type") == t) & (F.col("count") >= n)), ["graph_id", "node_id"], "left_semi")
        part = nodes.select(F.lit(v).alias("node"), "graph_id", "node_id")
        out = part if out is None else out.unionAll(part)
    return out


@dataclass(frozen=True)
class Parts:
    """The exchangeable parts of match(): what it may leave out before the joins, the order of the joins, and which mappings
    stand for those that the query's automorphisms turn them into. Filters change the plan only; the symmetry changes results."""

    #: (graph_id) of graphs that may hold the query; None: all may.
    graphs: Callable[[GraphDB, Query], DataFrame] | None = None
    #: (node, graph_id, node_id) of nodes that a query node may be mapped to; None: by labels alone.
    domain: Callable[[GraphDB, Query], DataFrame] | None = None
    #: The order in which the query's edges are joined.
    order: Callable[[GraphDB, Query], list[int]] = lambda db, query: edge_order(query)
    #: The automorphisms of which one mapping stays.
    symmetry: Callable[[list, list, bool], list[list[int]]] = automorphisms


#: Nothing but the joins: best for queries that most graphs hold.
PLAIN = Parts()
#: Graphs and nodes are filtered and rare edges come first: best for queries that few graphs hold.
SELECTIVE = Parts(vocabulary_filter, degree_domain, lambda db, query: edge_order(query, edge_counts(db, query)))


def match(db: GraphDB, query: Query, symmetric: bool = False, counts: dict[int, int] | None = None, parts: Parts = PLAIN, with_labels: bool = False) -> DataFrame:
    """(graph_id, node_map, keys, types): every way to map the query's nodes to different nodes and its edges to different
    edges; keys and types of the edges in the query's order. Of mappings that the query's automorphisms, or exchanges of equal
    parallel edges, turn into each other, one stays (the smallest), or with symmetric all. With with_labels also labels: the
    whole label list of each mapped node. counts: edge_counts() if known, for the order of the joins."""
    labels, edges = query
    n = len(labels)
    if not n or not connected(n, edges):
        raise ValueError("a query must have a node and be connected")
    if parts.graphs:
        may = parts.graphs(db, query)
        db = GraphDB(db.nodes.join(may, "graph_id", "left_semi"), db.edges.join(may, "graph_id", "left_semi"), db.directed)
    domain = parts.domain(db, query) if parts.domain else None
    array = lambda xs, kind: F.array(*xs).cast(f"array<{kind}>") if xs else F.expr(f"cast(array() as array<{kind}>)")
    wanted = lambda v: includes(F.col("labels"), array([F.lit(x) for x in labels[v]], "string"))
    ends = {}
    for v in range(n):
        if labels[v] or domain is not None or with_labels:
            fit = db.nodes.where(wanted(v)) if labels[v] else db.nodes
            if domain is not None:
                fit = fit.join(domain.where(F.col("node") == v).select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
            ends[v] = fit.select("graph_id", F.col("node_id").alias(f"n{v}"), *([F.col("labels").alias(f"l{v}")] if with_labels else []))
    whole = [F.array(*(F.col(f"l{v}") for v in range(n))).alias("labels")] if with_labels else []
    if not edges:
        found = ends.get(0, db.nodes.select("graph_id", F.col("node_id").alias("n0")))
        return found.select("graph_id", F.array("n0").alias("node_map"), array([], "int").alias("keys"), array([], "string").alias("types"), *whole)
    found, bound = None, set()
    for k in edge_order(query, counts) if counts else parts.order(db, query):
        s, d, t = edges[k]
        e = fitting_edges(db, query, k).select("graph_id", F.col("s").alias(f"n{s}"), *([F.col("d").alias(f"n{d}")] if s != d else []), F.col("key").alias(f"k{k}"), F.col("type").alias(f"t{k}"), F.col("turned").alias(f"w{k}"))
        new = sorted({s, d} - bound)
        if found is None:
            found = e
        else:
            found = found.join(e, ["graph_id", *(f"n{v}" for v in sorted({s, d} & bound))])
            for v in new:  # different nodes
                for u in sorted(bound):
                    found = found.where(F.col(f"n{v}") != F.col(f"n{u}"))
        for j in range(len(edges)):  # different edges; of parallel edges that are alike, keys ascend
            if j == k or f"k{j}" not in found.columns:
                continue
            a, b = (j, k) if j < k else (k, j)
            same = edges[a][:2] == edges[b][:2] or (not db.directed and edges[a][:2] == edges[b][1::-1])
            if same:
                place = lambda x: F.struct(F.col(f"w{x}") if edges[x][:2] == edges[a][:2] else 1 - F.col(f"w{x}"), F.col(f"k{x}"))  # noqa: E731, B023
                found = found.where(place(a) < place(b) if edges[a][2] == edges[b][2] and not symmetric else place(a) != place(b))
        for v in new:
            if v in ends:
                found = found.join(ends[v], ["graph_id", f"n{v}"])
        bound |= {s, d}
    if not symmetric:
        here = array([F.col(f"n{v}") for v in range(n)], "bigint")
        for image in parts.symmetry(labels, edges, db.directed):
            if image != list(range(n)):
                found = found.where(here <= array([F.col(f"n{image[v]}") for v in range(n)], "bigint"))
    return found.select("graph_id", array([F.col(f"n{v}") for v in range(n)], "bigint").alias("node_map"), array([F.col(f"k{k}") for k in range(len(edges))], "int").alias("keys"), array([F.col(f"t{k}") for k in range(len(edges))], "string").alias("types"), *whole)


def pair_profile(db: GraphDB) -> DataFrame:
    """(graph_id, u, v, labels_u, t_in, t_out, labels_v) of every pair u < v with an edge between: the types of edges from v to
    u and from u to v (without direction both hold all types)."""
    e = db.edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "type", (F.col("src") < F.col("dst")).alias("ahead"))
    types = lambda ahead: F.array_sort(F.collect_set(F.when(F.col("ahead") == ahead, F.col("type")) if db.directed else F.col("type")))
    pairs = e.groupBy("graph_id", "u", "v").agg(types(False).alias("t_in"), types(True).alias("t_out"))
    for v in ("u", "v"):
        pairs = pairs.join(db.nodes.select("graph_id", F.col("node_id").alias(v), F.col("labels").alias(f"labels_{v}")), ["graph_id", v])
    return pairs.select("graph_id", "u", "v", "labels_u", "t_in", "t_out", "labels_v")


def pair_domain(db: GraphDB, query: Query) -> DataFrame:
    """(q_i, q_j, graph_id, t_i, t_j): for each pair of query nodes q_i < q_j with edges between, the target pairs whose labels
    and types include the pair's."""
    labels, edges = query
    profile = pair_profile(db)
    turned = profile.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("labels_v").alias("labels_u"), F.col("t_out").alias("t_in"), F.col("t_in").alias("t_out"), F.col("labels_u").alias("labels_v"))
    both = profile.unionByName(turned)
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    out = None
    for i, j in combinations(range(len(labels)), 2):
        ahead = sorted({t for s, d, t in edges if t and (s, d) == (i, j)})
        back = sorted({t for s, d, t in edges if t and (s, d) == (j, i)})
        if not any({s, d} == {i, j} for s, d, _ in edges):
            continue
        if not db.directed:
            ahead = back = sorted({*ahead, *back})
        part = both.where(includes(F.col("labels_u"), text(labels[i])) & includes(F.col("labels_v"), text(labels[j])) & includes(F.col("t_out"), text(ahead)) & includes(F.col("t_in"), text(back)))
        part = part.select(F.lit(i).alias("q_i"), F.lit(j).alias("q_j"), "graph_id", F.col("u").alias("t_i"), F.col("v").alias("t_j"))
        out = part if out is None else out.unionAll(part)
    return out
