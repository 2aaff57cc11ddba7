"""Readers, writers, accessors and the command line on small files."""

from __future__ import annotations

import json
import re

import pytest

from motifspark import cli, validate
from motifspark.api import Miner
from motifspark.operators import access
from motifspark.plans.mine import mine
from motifspark.sources import writers
from motifspark.sources.readers import read_graph_db, read_templates

# Fixed input: the graphs of a toy database whose result is known.
TEXT = """
noise before
t # 0 G1
v 1 blue
v 2 yellow
v 3 red

v 4 purple
e 1 2 white
e 1 3 white
e 3 2 white
e 2 4 white
e 3 4 white
t # 1 G2
v 1 blue
v 2 yellow
v 3 red
v 4 purple
e 1 2 white
e 1 3 white
e 3 2 white
e 2 4 white
e 3 4 white
t # 2 G3
v 1 red
v 2 yellow
v 3 red
v 4 purple
e 3 2 white
e 2 4 white
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("graphs")


@pytest.fixture(scope="module")
def db(spark, folder):
    (folder / "db.data").write_text(TEXT)
    return read_graph_db(spark, str(folder / "db.data"), directed=True).persist()


def test_text_database(spark, folder, db):
    assert db.nodes.count() == 12 and db.edges.count() == 12 and db.count() == 3
    (folder / "odd.data").write_text("t # aa3\nv 0 x y\nv 0 b a\ne 0 7 has part\ne 7 0\ne 0 7 has\nt # 5 twice\nv 1 old\nt # 6 twice\nv 2 new\n")
    odd = read_graph_db(spark, str(folder / "odd.data"), directed=True)
    assert {(r.graph_id, r.node_id, tuple(r.labels)) for r in odd.nodes.collect()} == {("aa3", 0, ("a", "b")), ("aa3", 7, ()), ("twice", 2, ("new",))}
    assert {(r.src, r.dst, r.key, r.type) for r in odd.edges.collect()} == {(0, 7, 0, "has"), (0, 7, 1, "part"), (0, 7, 2, "has"), (7, 0, 0, "")}
    rows = read_graph_db(spark, str(folder / "odd.data"), directed=True, multi_row=True).nodes.where("graph_id = 'aa3' AND node_id = 0").first()
    assert rows.labels == ["a", "b", "x", "y"]
    assert read_graph_db(spark, str(folder / "odd.data"), multigraph=False).edges.count() == 2
    with pytest.raises(ValueError, match="not supported"):
        read_graph_db(spark, "x.gml")


def test_csv_and_json(spark, folder):
    for g in ("n1", "n2"):
        (folder / "csv" / g / "nodes").mkdir(parents=True)
        (folder / "csv" / g / "edges").mkdir()
        (folder / "csv" / g / "nodes" / "a.csv").write_text("node_id,labels,size\n0,A:B,10\n1,C,\n")
        (folder / "csv" / g / "edges" / "a.csv").write_text("source,target,type,w\n0,1,E,2\n0,1,E,3\n1,5,,4\n")
    db = read_graph_db(spark, str(folder / "csv"), format="csv", directed=True)
    assert db.nodes.count() == 6 and db.nodes.where("node_id = 0").first().labels == ["A", "B"] and db.nodes.where("node_id = 0").first().props == {"size": "10"}
    assert sorted((r.src, r.dst, r.key, r.type, r.props["w"]) for r in db.edges.where("graph_id = 'n1'").collect()) == [(0, 1, 0, "E", "2"), (0, 1, 1, "E", "3"), (1, 5, 0, "", "4")]
    assert access.contains_attributes(db.edges, {"w": "3"}).count() == 2
    (folder / "json").mkdir()
    (folder / "json" / "g.json").write_text(json.dumps({"nodes": [{"id": "A", "labels": ["x"], "p": 2}, {"id": "B"}], "links": [{"source": "A", "target": "B", "type": "t", "w": 3}]}))
    (folder / "json" / "h.json").write_text(json.dumps({"nodes": [{"id": 7, "labels": ["y", "x"]}], "links": []}))
    db = read_graph_db(spark, str(folder / "json"), format="json")
    assert {(r.graph_id, r.node_id, tuple(r.labels)) for r in db.nodes.collect()} == {("g", 0, ("x",)), ("g", 1, ()), ("h", 7, ("x", "y"))}
    assert [(r.src, r.dst, r.type, r.props) for r in db.edges.collect()] == [(0, 1, "t", {"w": "3"})]


def test_written_graphs_read_back(spark, folder, db):
    writers.graph_text(db).select("value").write.text(str(folder / "out.data"))
    again = read_graph_db(spark, str(folder / "out.data"), directed=True)
    assert again.nodes.drop("props").exceptAll(db.nodes.drop("props")).isEmpty() and again.edges.drop("props").exceptAll(db.edges.drop("props")).isEmpty()
    assert again.edges.count() == 12


def test_pattern_output(spark, folder, db):
    found = mine(db, 1, max_nodes=3)
    assert access.invalid_embeddings(db, found.patterns, found.embeddings).isEmpty()
    wrong = spark.createDataFrame([(found.patterns.where("n_nodes = 3").first().pattern_id, "G1", [1, 1, 2])], found.embeddings.schema)
    assert access.invalid_embeddings(db, found.patterns, wrong).count() == 1
    blocks = [r.value for r in writers.format_patterns(found, with_frequencies=True).orderBy("number").collect()]
    assert len(blocks) == 6 and "t # 2\nv 0 red\ns 3\nf 4\n\ninfo:\nG1 1\nG2 1\nG3 2\n----------" in blocks
    maps = [r.value for r in writers.format_patterns(found, show_mappings=True).orderBy("number").collect()]
    assert "G3\n1\n3\n" in maps[1]
    full = writers.full_mappings(db, found).join(found.patterns.where("n_nodes = 2").select("pattern_id"), "pattern_id").collect()
    assert all(re.fullmatch(r"\(\{0->\d, 1->\d\}, \{\(\d, \d, white\)->\(\d, \d, 0\)\}\)", r.value) for r in full) and len(full) == 6
    pairs = access.mapped_graphs(db, found.embeddings.join(found.patterns.where("n_nodes = 2"), "pattern_id"), [(0, 1), (1, 0)]).first()
    assert len(pairs.nodes) == 2 and len(pairs.edges) == 2


def test_command_line(spark, folder, db, capsys):
    cli.main([str(folder / "db.data"), "1", "-l", "2", "-u", "3", "-d", "1", "-f", "1"], spark)
    text = capsys.readouterr().out
    assert text.count("----------") == 3 and "s 3\nf 3\n" in text
    (folder / "t.txt").write_text("v 0 red\nv 1\ne 0 1 white\n")
    assert read_templates(spark, str(folder / "t.txt")) == [([["red"], []], [(0, 1, "white")])]
    cli.main([str(folder / "db.data"), "2", "-n", "2", "-d", "1", "-t", str(folder / "t.txt"), "-o", str(folder / "out")], spark)
    assert capsys.readouterr().out.count("t # ") == 2  # red to yellow, and in two graphs red to purple
    assert any("s 3" in p.read_text() for p in (folder / "out").glob("part-*"))


def test_csv_files_with_different_columns(spark, tmp_path):
    files = {
        "g1/nodes/a.csv": "node_id,labels,name\n1,A:B,zero\n2,B,one\n", "g1/nodes/b.csv": 'color,node_id,labels\nred,3,"C"\n',
        "g2/nodes/a.csv": "node_id,color,labels\n1,blue,A\n2,,\n", "g1/edges/a.csv": "from,to,weight,type\n1,2,9,t\n2,3,,u\n", "g2/edges/a.csv": "s,d,type,since\r\n2,1,v,1999\r\n",
    }
    for name, text in files.items():
        (tmp_path / "net" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "net" / name).write_bytes(text.encode())
    db = read_graph_db(spark, str(tmp_path / "net"), "csv", directed=True)
    assert {(r.graph_id, r.node_id): (r.labels, r.props) for r in db.nodes.collect()} == {
        ("g1", 1): (["A", "B"], {"name": "zero"}), ("g1", 2): (["B"], {"name": "one"}), ("g1", 3): (["C"], {"color": "red"}), ("g2", 1): (["A"], {"color": "blue"}), ("g2", 2): ([], {}),
    }
    assert sorted((r.graph_id, r.src, r.dst, r.type, r.props) for r in db.edges.collect()) == [("g1", 1, 2, "t", {"weight": "9"}), ("g1", 2, 3, "u", {}), ("g2", 2, 1, "v", {"since": "1999"})]


def test_options_from_config_files(spark, folder, db):
    (folder / "data_conf.json").write_text('{"file_path": "", "sep_label": " ", "is_mr": 0, "is_directed": 1, "is_multigraph": 1}')
    again = read_graph_db(spark, str(folder / "db.data"), config_dir=str(folder))
    assert again.directed and sorted(map(str, again.edges.collect())) == sorted(map(str, db.edges.collect()))
    assert not read_graph_db(spark, str(folder / "db.data"), config_dir=str(folder), directed=False).directed


def test_one_call_and_validation(spark, folder, tmp_path, capsys):
    out, result = str(tmp_path / "out"), str(tmp_path / "result")
    found = Miner(str(folder / "db.data"), 1, max_nodes=3, show_mappings=True, output_path=out, directed_graph=True).mine(spark)
    assert found.patterns.count() == 6
    assert validate.main([out, str(folder / "db.data"), result, "true"], spark) == 0 and "0 wrong" in capsys.readouterr().out
    assert validate.read_mappings(spark, out)[1].count() == found.embeddings.where("size(node_map) > 1").count() > 0
    text = "\n".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    (tmp_path / "bad.txt").write_text(re.sub(r"^(\d+),(\d+)$", r"\2,\1", text, flags=re.M))
    assert validate.main([str(tmp_path / "bad.txt"), str(folder / "db.data"), result, "true"], spark) == 1
    assert validate.main([out], spark) == 2


def test_long_flags():
    a = cli.parser().parse_args(["x", "2", "--is_directed", "1", "--worker", "3"])
    assert a.directed == 1 and a.workers == 3


def test_reified(spark, folder):
    (folder / "r.data").write_text("t # 0 G1\nv 0 a\nv 1 b\ne 0 1 x\ne 0 1 y\nt # 1 G2\nv 0 a\nv 1 b\ne 0 1 x\ne 0 1 y\n")
    db = access.reified(read_graph_db(spark, str(folder / "r.data"), directed=True))
    assert sorted((r.node_id, *r.labels) for r in db.nodes.where("graph_id = 'G1'").collect()) == [(0, "a"), (1, "b"), (2, "x"), (3, "y")]
    assert sorted((r.src, r.dst, r.type) for r in db.edges.where("graph_id = 'G2'").collect()) == [(0, 2, "_"), (0, 3, "_"), (2, 1, "_"), (3, 1, "_")]


def test_accessors(spark, db):
    types = {(r.graph_id, r.u, r.v): r.types for r in access.edge_types(db).collect()}
    assert types["G1", 1, 2] == ["white"] and ("G1", 2, 1) not in types
    assert {(r.kind, r.label) for r in access.vocabulary(db).collect()} == {("node", x) for x in ("blue", "yellow", "red", "purple")} | {("edge", "white")}
    near = {(r.graph_id, r.node_id): r.neighbours for r in access.neighbours(db).collect()}
    assert near["G1", 3] == [1, 2, 4] and ("G3", 1) not in near
    assert {(r.graph_id, r.node_id): r.targets for r in access.adjacency(db).collect()}["G1", 3] == [2, 4]
    assert {(r.graph_id, r.node_id): r.degree for r in access.total_degrees(db).collect()}["G3", 1] == 0
    gone = db.nodes.where("node_id = 2").select("graph_id", "node_id")
    less = access.remove_nodes(db, gone)
    assert less.nodes.count() == 9 and less.edges.count() == 4
    assert access.induced(db, gone).edges.count() == 0
    assert access.remove_edges(db, db.edges.where("src = 1").select("graph_id", "src", "dst", "key")).edges.count() == 8
    more = access.add_edges(db, spark.createDataFrame([("G1", 1, 2, "black", {}), ("G1", 2, 9, "", {})], "graph_id string, src bigint, dst bigint, type string, props map<string,string>"))
    assert more.edges.where("graph_id = 'G1' AND src = 1 AND dst = 2").count() == 2 and more.nodes.count() == 13
    assert access.edge_keys(more).where("size(keys) = 2").count() == 1 and access.edge_keys(more, "black").count() == 1
    assert access.pair_edges(more).where("size(edges) = 2").count() == 1
    named = access.add_nodes(db, spark.createDataFrame([("G1", 1, ["DUMMY"], {})], db.nodes.schema))
    assert named.nodes.count() == 12 and access.listed_edges(named).count() == 10
    props = access.set_attributes(db.nodes, spark.createDataFrame([("G1", 1, {"k": "v"})], "graph_id string, node_id bigint, props map<string,string>"), ["graph_id", "node_id"])
    assert access.contains_attributes(props, {"k": "v"}).count() == 1
    assert access.reverse_edges(db).where("src = 2 AND dst = 1").count() == 2
    assert sorted(r.node_id for r in access.zero_indexed(db).nodes.where("graph_id = 'G1'").collect()) == [0, 1, 2, 3]
    pairs = spark.createDataFrame([("G1", 2, 3), ("G3", 1, 2)], "graph_id string, a bigint, b bigint")
    assert sorted(r.similarity for r in access.jaccard(db, pairs).collect()) == [0.0, 0.5]
    profile = {r.part: (r.graphs, r.average, r.largest, r.smallest) for r in access.profile(db).collect()}
    assert profile == {"nodes": (3, 4.0, 4, 4), "edges": (3, 4.0, 5, 2)}


def test_graphs_larger_than_a_row(spark, folder, tmp_path):
    """Files are cut within graphs, and no record may be longer than 40 bytes: a graph is never one row."""
    graphs = {"g0": 60, "g1": 2, "g2": 300, "g3": 1, "old": 40}
    text = lambda g, n, w: f"t # 7 {g}\n" + "".join(f"v {k} l{k}\n" for k in range(n)) + "".join(f"e {k} {k - 1} {t}\n" for k in range(1, n) for t in (w, "b", "a"))
    (tmp_path / "many.data").mkdir()
    (tmp_path / "many.data" / "1.data").write_text("v 0 none\n" + "".join(text(g, n, "x") for g, n in graphs.items()) + "t x\nv 9 none\n")
    (tmp_path / "many.data" / "2.data").write_text("v 1 none\n" + text("old", 3, "y").replace("\n", "\r\n"))
    want = {(g, k, k - 1, key, t) for g, n in (graphs | {"old": 3}).items() for k in range(1, n) for key, t in enumerate(("y" if g == "old" else "x", "b", "a"))}
    conf = {"mapreduce.input.linerecordreader.line.maxlength": "40", "spark.sql.files.maxPartitionBytes": "500b", "spark.sql.files.openCostInBytes": "100b"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        db = read_graph_db(spark, str(tmp_path / "many.data"), directed=True).stored()
        assert {tuple(r) for r in db.edges.select("graph_id", "src", "dst", "key", "type").collect()} == want
        assert sorted((r.graph_id, r.node_id, r.labels) for r in db.nodes.collect()) == sorted((g, k, [f"l{k}"]) for g, n in (graphs | {"old": 3}).items() for k in range(n))
        writers.write_graphs(db, str(tmp_path / "again.data"))
        again = read_graph_db(spark, str(tmp_path / "again.data"), directed=True)
        assert sorted(map(str, again.edges.collect())) == sorted(map(str, db.edges.collect()))
        assert sorted(map(str, again.nodes.collect())) == sorted(map(str, db.nodes.collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
