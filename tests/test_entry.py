"""The registered queries: each has the columns of its DuckDB equivalent, and all work without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest

ROOT, DATA = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "motifspark", tmp_path / "motifspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 25 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["pair_bags", "reify_multiedges", "jaccard_neighbours", "star_match", "cycle_match", "edge_extension_candidates", "two_node_patterns", "mine_maximum_k3", "closing_patterns", "canonical_codes", "wrong_embeddings", "csv_round_trip"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).to_arrow_table()
    columns = sorted(want.column_names)
    found = __spark_entry__.queries()[name](spark, DATA)
    assert sorted(found.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, zip(*(want[c].to_pylist() for c in columns), strict=True)))
