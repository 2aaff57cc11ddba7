"""Frequent-pattern mining, level by level.

A level holds the patterns of one size with all their embeddings, in tables in the shared folder. Support only falls as
patterns grow, so a level's frequent patterns give all candidates of the next; candidates get their canonical code before any
embedding is made, and of equal ones, only the first is grown. All patterns of a level grow in the same joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import automorphism_count, canonical, connected
from ..graph import GraphDB
from ..operators import growth, matching
from ..storage import written

RESULT = ["pattern_id", "code", "labels", "edges", "n_nodes", "n_edges", "support", "frequency", "n_occurrences"]


@dataclass(frozen=True)
class Mined:
    """patterns: one row each (RESULT); embeddings: pattern_id, graph_id, node_map (target node of each pattern node)."""

    patterns: DataFrame
    embeddings: DataFrame
    directed: bool


def parse_support(support: float, graphs: int, compat: bool = False) -> int:
    """Above 1, a number of graphs; up to 1, a share of them; at least one graph. With compat, numbers from 1 to 2 become a
    share of 1, all graphs."""
    if support <= 0:
        raise ValueError("support must be positive")
    if support > 1 and not (compat and int(support) == 1):
        return int(support)
    return max(1, int(min(support, 1.0) * graphs))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _deduped(drafts: DataFrame, seen: DataFrame | None, order: list[str]) -> DataFrame:
    """One draft for each code that isn't seen yet: the first by `order`, so results don't depend on scheduling."""
    w = Window.partitionBy("code").orderBy(*order)
    new = drafts.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return new if seen is None else new.join(seen.select("code"), "code", "left_anti")


def _finished(patterns: DataFrame, embeddings: DataFrame, directed: bool) -> DataFrame:
    """Patterns with support, frequency and n_occurrences. Automorphisms act freely on embeddings, so the occurrences are the
    embeddings divided by their number."""

    @F.pandas_udf("bigint")
    def automorphisms(labels: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([automorphism_count([list(x) for x in a], [(e["src"], e["dst"], e["type"]) for e in b], directed) for a, b in zip(labels, edges, strict=True)])

    found = patterns.join(growth.counted(embeddings), "pattern_id")
    return found.withColumns({"n_edges": F.size("edges"), "n_occurrences": (F.col("frequency") / automorphisms("labels", "edges")).cast("bigint")}).select(*RESULT)


def seeds(db: GraphDB, least: int, templates: list | None) -> tuple[DataFrame, DataFrame]:
    """The first patterns and their embeddings: single nodes, or what the templates match.

    A template with all labels seeds one pattern. One with nodes or edges without label seeds a pattern for each combination
    of labels and types it is matched with; roles are aligned by the canonical order."""
    if templates is None:
        found = growth.one_node(db, least).select("labels")
        drafts = found.select(F.array("labels").alias("labels"), F.expr(f"cast(array() as {growth.EDGE_LIST})").alias("edges"))
        patterns = written(growth.coded(drafts, db.directed).withColumn("n_nodes", F.lit(1)), "patterns")
        ends = patterns.select("pattern_id", F.get("labels", F.lit(0)).alias("labels"))
        return patterns, written(db.nodes.join(ends, "labels").select("pattern_id", "graph_id", F.array("node_id").alias("node_map")), "embeddings")
    pats, embs = [], []
    for labels, edges in templates:
        if not connected(len(labels), edges):
            raise ValueError("a template must be connected")
        n = len(labels)
        whole = all(labels) and all(t for _, _, t in edges)
        rows = matching.match(db, (labels, edges), symmetric=True, counts=matching.edge_counts(db, (labels, edges)) if len(edges) > 1 else None, with_labels=not whole)
        if whole:
            code, _ = canonical(labels, edges, db.directed)
            spark = db.nodes.sparkSession
            one = spark.createDataFrame([(labels, [{"src": s, "dst": d, "type": t} for s, d, t in edges], code)], f"labels array<array<string>>, edges {growth.EDGE_LIST}, code string").withColumn("pattern_id", F.xxhash64("code"))
            pats.append(one.withColumn("n_nodes", F.lit(n)))
            embs.append(rows.select(F.xxhash64(F.lit(code)).alias("pattern_id"), "graph_id", "node_map").distinct())
            continue
        ends = [(s, d) for s, d, _ in edges]
        kinds = F.array(*(F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst"), F.get("types", F.lit(k)).alias("type")) for k, (s, d) in enumerate(ends))) if ends else F.expr(f"cast(array() as {growth.EDGE_LIST})")
        images = written(rows.select("graph_id", "node_map", "labels", F.array_sort(kinds).alias("edges")).distinct(), "template-images")

        schema = f"labels array<array<string>>, edges {growth.EDGE_LIST}, code string, places array<int>"

        def aligned(batches, directed=db.directed):
            for pdf in batches:
                out = [canonical([list(x) for x in a], [(e["src"], e["dst"], e["type"]) for e in b], directed) for a, b in zip(pdf["labels"], pdf["edges"], strict=True)]
                yield pdf.assign(code=[c for c, _ in out], places=[o for _, o in out])

        kinds = written(images.select("labels", "edges").distinct().mapInPandas(aligned, schema), "template-kinds")
        by_code = kinds.groupBy("code").agg(F.min(F.struct("labels", "edges", "places")).alias("k"))
        back = lambda places: F.transform(F.sequence(F.lit(0), F.size(places) - 1), lambda v: F.array_position(places, v.cast("int")) - 1) if n else places
        place = back(F.col("k.places"))
        pats.append(by_code.select(F.transform("k.places", lambda v: F.get("k.labels", v)).alias("labels"), F.array_sort(F.transform("k.edges", lambda e: F.struct(F.get(place, e["src"]).cast("int").alias("src"), F.get(place, e["dst"]).cast("int").alias("dst"), e["type"].alias("type")))).alias("edges"), "code", F.xxhash64("code").alias("pattern_id"), F.lit(n).alias("n_nodes")))
        embs.append(images.join(kinds, ["labels", "edges"]).select(F.xxhash64("code").alias("pattern_id"), "graph_id", F.transform("places", lambda v: F.get("node_map", v)).alias("node_map")).distinct())
    columns = ["labels", "edges", "code", "pattern_id", "n_nodes"]
    embeddings = written(_union(embs).distinct(), "embeddings")
    enough = growth.counted(embeddings).where(F.col("support") >= least).select("pattern_id")
    patterns = _deduped(_union([p.select(*columns) for p in pats]), None, ["labels"]).join(enough, "pattern_id", "left_semi")
    return written(patterns, "patterns"), written(embeddings.join(enough, "pattern_id", "left_semi"), "embeddings")


def mine(db: GraphDB, support: float, min_nodes: int = 1, max_nodes: float = float("inf"), templates: list | None = None, pattern_type: str = "all", compat_support: bool = False) -> Mined:
    """All frequent patterns of min_nodes to max_nodes nodes ('all'), or those that no node can be added to ('maximum').

    In 'maximum', patterns of max_nodes nodes count as complete, and a tree that gained edges is left out unless more graphs
    hold it than all its extensions by edges together, and than one of those at least."""
    if pattern_type not in ("all", "maximum"):
        raise ValueError(f"pattern type must be 'all' or 'maximum', not {pattern_type!r}")
    maximum = pattern_type == "maximum"
    least = parse_support(support, db.count(), compat_support)
    patterns, embeddings = seeds(db, least, templates)
    columns = ["labels", "edges", "code", "pattern_id", "n_nodes"]
    patterns = patterns.select(*columns)
    bags = inner = None
    size = max((len(labels) for labels, _ in templates or []), default=1)  # of the level's largest patterns
    seen, kept, kept_embeddings = patterns.select("code"), [], []
    while not patterns.isEmpty():
        # templates may differ in size, so a level can hold patterns that may not grow any more
        open_ids = patterns.where(F.col("n_nodes") < F.lit(float(max_nodes))).select("pattern_id")
        grows = not open_ids.isEmpty()
        if grows:
            bags = bags or written(db.pair_bags(), "pair-bags")
            around = growth.neighbours(embeddings.join(open_ids, "pattern_id", "left_semi"), bags)
            extensions = written(growth.node_extensions(around, least), "extensions")
        if maximum and grows:
            final = patterns.join(extensions.select("pattern_id"), "pattern_id", "left_anti")
            kept.append(final)
            kept_embeddings.append(embeddings.join(final.select("pattern_id"), "pattern_id", "left_semi"))
        else:
            kept.append(patterns)
            kept_embeddings.append(embeddings)
        if not grows:
            break
        drafts = growth.coded(growth.node_extended(patterns, extensions, db.directed), db.directed)
        trees = written(_deduped(drafts, seen, ["parent", "p_node", "added", "bag"]).withColumn("n_nodes", F.size("labels")), "trees")
        if trees.isEmpty():
            break
        tree_embeddings = written(growth.node_grown(around, trees), "tree-embeddings")
        trees = trees.select(*columns)
        seen = _union([seen, trees.select("code")])
        next_patterns, next_embeddings = trees, tree_embeddings
        size += 1
        if size >= 3:  # smaller trees have no edges to add
            inner = inner or written(db.directed_bags(), "inner-bags")
            missing = written(growth.missing_edges(inner, tree_embeddings, trees, db.directed), "missing-edges")
            closing = written(growth.edge_extensions(missing, least), "edge-extensions")
        if size >= 3 and not closing.isEmpty():
            closed = growth.coded(growth.edge_extended(trees, closing), db.directed)
            closed = written(_deduped(closed, seen, ["parent", "group"]).withColumn("n_nodes", F.size("labels")), "closed")
            closed_embeddings = written(growth.edge_grown(missing, closed), "closed-embeddings")
            counts = growth.counted(closed_embeddings)
            enough = written(counts.where(F.col("support") >= least), "closed-support")
            if maximum:
                trees = _uncovered(trees, tree_embeddings, missing, closing, closed, counts)
                tree_embeddings = tree_embeddings.join(trees.select("pattern_id"), "pattern_id", "left_semi")
            seen = _union([seen, closed.select("code")])
            closed = closed.join(enough.select("pattern_id"), "pattern_id", "left_semi").select(*columns)
            closed_embeddings = closed_embeddings.join(enough.select("pattern_id"), "pattern_id", "left_semi")
            next_patterns, next_embeddings = _union([trees, closed]), _union([tree_embeddings, closed_embeddings])
            next_patterns, next_embeddings = written(next_patterns, "patterns"), written(next_embeddings, "embeddings")
        seen = written(seen, "codes")
        patterns, embeddings = next_patterns, next_embeddings
    codes = seen.agg(F.count_distinct("code").alias("codes"), F.count_distinct(F.xxhash64("code")).alias("ids")).first()
    if codes.codes != codes.ids:
        raise RuntimeError("two patterns have one id: their codes' hashes agree")
    fits = F.col("n_nodes").between(min_nodes, F.lit(float(max_nodes)))
    all_patterns = _union(kept).where(fits) if kept else patterns
    all_embeddings = _union(kept_embeddings) if kept_embeddings else embeddings
    all_embeddings = all_embeddings.join(all_patterns.select("pattern_id"), "pattern_id", "left_semi").select("pattern_id", "graph_id", "node_map")
    return Mined(_finished(all_patterns, all_embeddings, db.directed), all_embeddings, db.directed)


def _uncovered(trees: DataFrame, embeddings: DataFrame, missing: DataFrame, closing: DataFrame, closed: DataFrame, counts: DataFrame) -> DataFrame:
    """The trees that stay beside their extensions by edges."""
    first = closing.withColumn("k", F.row_number().over(Window.partitionBy("pattern_id", "group").orderBy("i", "j"))).where("k = 1").select("pattern_id", "i", "j", F.col("bag").alias("part"))
    covered = missing.join(first, ["pattern_id", "i", "j"]).where(growth.includes(F.col("bag"), F.col("part"))).groupBy("pattern_id").agg(F.countDistinct("graph_id").alias("covered"))
    smallest = closed.select("pattern_id", "parent").join(counts, "pattern_id", "left").groupBy(F.col("parent").alias("pattern_id")).agg(F.min(F.coalesce("support", F.lit(0))).alias("smallest"))
    own = growth.counted(embeddings).select("pattern_id", "support")
    judged = trees.join(own, "pattern_id").join(covered, "pattern_id", "left").join(smallest, "pattern_id", "left")
    return judged.where("covered IS NULL OR (support > covered AND support > smallest)").select(*trees.columns)
