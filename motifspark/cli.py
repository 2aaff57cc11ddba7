"""Command line: python -m motifspark <db_file> <support> [options]."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .api import Miner
from .sources.writers import format_patterns


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motifspark", description="Frequent patterns of a database of labelled multigraphs")
    p.add_argument("db_file")
    p.add_argument("support", type=float, help="up to 1: a share of the graphs; above: their number")
    p.add_argument("-l", "--min_nodes", type=int, default=1)
    p.add_argument("-u", "--max_nodes", type=float, default=float("inf"))
    p.add_argument("-n", "--num_nodes", type=int, help="exact number of nodes; overrides -l and -u")
    p.add_argument("-d", "--is_directed", "--directed", dest="directed", type=int, default=0, choices=(0, 1))
    p.add_argument("-m", "--show_mappings", type=int, default=0, choices=(0, 1))
    p.add_argument("-f", "--with_frequencies", type=int, default=0, choices=(0, 1))
    p.add_argument("-t", "--templates_file", "--templates_path", dest="templates_file")
    p.add_argument("-x", "--pattern_type", default="all", choices=("all", "maximum"))
    p.add_argument("-o", "--output_path")
    p.add_argument("-w", "--worker", "--workers", dest="workers", type=int, help="local cores, where no cluster is set")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    low, high = (a.num_nodes, a.num_nodes) if a.num_nodes else (a.min_nodes, a.max_nodes)
    print(f"database {a.db_file}, support {a.support:g}, nodes {low} to {high:g}, {'directed' if a.directed else 'undirected'}, {a.pattern_type} patterns")
    job = Miner(a.db_file, a.support, low, high, a.templates_file, bool(a.show_mappings), a.output_path, bool(a.directed), bool(a.with_frequencies), a.pattern_type, a.workers)
    spark = spark or job.session()
    began = time.time()
    try:
        found = job.mine(spark)
        for row in format_patterns(found, bool(a.with_frequencies), bool(a.show_mappings)).orderBy("number").toLocalIterator():
            print(row.value)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        raise
    print(f"{time.time() - began:.1f} s")
