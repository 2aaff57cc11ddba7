"""One call from a file of graphs to written patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .plans.mine import Mined, mine
from .sources.readers import read_graph_db, read_templates
from .sources.writers import write_patterns


@dataclass
class Miner:
    """A mining job by the names of its parameters. `workers` sets the local cores of a session made here; on a cluster, or where
    a session runs already, Spark's own settings hold."""

    db_file: str
    support: float
    min_nodes: int = 1
    max_nodes: float = float("inf")
    templates_file: str | None = None
    show_mappings: bool = False
    output_path: str | None = None
    directed_graph: bool = False
    with_frequencies: bool = False
    pattern_type: str = "all"
    workers: int | None = None

    def session(self) -> SparkSession:
        running = SparkSession.getActiveSession()
        if running is not None:
            return running
        builder = SparkSession.builder.appName("motifspark")
        return (builder.master(f"local[{max(1, int(self.workers))}]") if self.workers else builder).getOrCreate()

    def mine(self, spark: SparkSession | None = None) -> Mined:
        """The patterns found, which are also written if there is an output path."""
        spark = spark or self.session()
        db = read_graph_db(spark, self.db_file, directed=bool(self.directed_graph)).stored()
        templates = read_templates(spark, self.templates_file) if self.templates_file else None
        found = mine(db, self.support, self.min_nodes, self.max_nodes, templates, self.pattern_type)
        if self.output_path:
            write_patterns(found, self.output_path, bool(self.with_frequencies), bool(self.show_mappings))
        return found
