"""Checks mined patterns that were written with their mappings against the graphs: python -m motifspark.validate <output>
<graphs> <result> <directed>."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import GraphDB
from .operators import access
from .operators.growth import EDGE_LIST
from .sources.readers import parse_patterns, read_graph_db
from .sources.writers import RULE

_KIND = f"pattern_id bigint, labels array<array<string>>, edges {EDGE_LIST}, graph_id string, node_map array<bigint>"


def read_mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pattern_id, labels, edges) and (pattern_id, graph_id, node_map) of a text output with mappings; pattern_id is the
    pattern's number. Patterns of one node are left out: a line of one number may be a node's or a graph's."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for block in pdf["value"]:
                head, _, info = block.partition("\n\ninfo:\n")
                number = re.search(r"^t # (\d+)", head, re.M)
                if not number:
                    continue
                labels, edges = parse_patterns(head)[0]
                if len(labels) < 2:
                    continue
                mapping, graph = re.compile(rf"\d+(,\d+){{{len(labels) - 1}}}"), None
                for line in filter(None, info.split("\n")):
                    if mapping.fullmatch(line):
                        rows.append((int(number[1]), labels, [{"src": s, "dst": d, "type": t} for s, d, t in edges], graph, [int(x) for x in line.split(",")]))
                    else:
                        graph = line
            yield pd.DataFrame(rows, columns=["pattern_id", "labels", "edges", "graph_id", "node_map"])

    rows = spark.read.option("lineSep", RULE).text(path).mapInPandas(parse, _KIND)
    return rows.select("pattern_id", "labels", "edges").distinct(), rows.select("pattern_id", "graph_id", "node_map")


def wrong_mappings(db: GraphDB, patterns: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The mappings that don't hold, those into graphs that the database lacks included."""
    unknown = embeddings.join(db.nodes.select("graph_id").distinct(), "graph_id", "left_anti").select(*embeddings.columns)
    return access.invalid_embeddings(db, patterns, embeddings).select(*embeddings.columns).unionByName(unknown).distinct()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if len(args) != 4:
        print("usage: python -m motifspark.validate <output> <graphs> <result> <directed: true or false>")
        return 2
    output, graphs, result, directed = args
    spark = spark or SparkSession.builder.appName("motifspark").getOrCreate()
    patterns, embeddings = read_mappings(spark, output)
    wrong = wrong_mappings(read_graph_db(spark, graphs, directed=directed.lower() == "true"), patterns, embeddings).persist()
    n = wrong.count()
    lines = wrong.select(F.to_json(F.struct("pattern_id", "graph_id", "node_map")).alias("value"))
    (lines if n else spark.createDataFrame([("All mappings are correct.",)], "value string")).write.mode("overwrite").text(result)
    print(f"{n} wrong mappings; written to {result}")
    return 1 if n else 0


if __name__ == "__main__":
    sys.exit(main())
