"""Databases with planted patterns, for tests: small, and made on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import GraphDB, graph_db


def planted(spark: SparkSession, n_graphs: int, patterns: list[tuple], directed: bool = True) -> GraphDB:
    """n_graphs graphs. patterns: (labels, edges, times); a copy of the pattern is put into graph k times[k] times. Copies in a
    graph are chained by edges whose types occur once in the database, so nothing else becomes frequent."""
    nodes, edges, joints = [], [], 0
    for k in range(n_graphs):
        start, last = 0, None
        for labels, links, times in patterns:
            for _ in range(times[k]):
                nodes += [(f"g{k}", start + v, list(x)) for v, x in enumerate(labels)]
                edges += [(f"g{k}", start + s, start + d, t) for s, d, t in links]
                if last is not None:
                    edges.append((f"g{k}", last, start, f"joint{joints}"))
                    joints += 1
                last, start = start, start + len(labels)
    return graph_db(spark.createDataFrame(nodes, "graph_id string, node_id bigint, labels array<string>"), spark.createDataFrame(edges, "graph_id string, src bigint, dst bigint, type string"), directed)
