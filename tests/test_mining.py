"""Mining and matching against brute force over small databases."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest

from motifspark.functions.canonical import automorphism_count, automorphisms, canonical
from motifspark.graph import GraphDB, graph_db
from motifspark.operators import matching
from motifspark.plans.mine import mine, parse_support
from motifspark.sources.readers import parse_patterns

NODE = "graph_id string, node_id bigint, labels array<string>"
EDGE = "graph_id string, src bigint, dst bigint, type string"


def db_of(spark, graphs, directed=True):
    """graphs: {name: (labels by node, edges)}"""
    nodes = [(g, v, l) for g, (labels, _) in graphs.items() for v, l in labels.items()]
    edges = [(g, *e) for g, (_, es) in graphs.items() for e in es]
    db = graph_db(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), directed)
    return GraphDB(db.nodes.cache(), db.edges.cache(), directed)


PATH = {
    g: ({1: ["red"] if g == "G3" else ["blue"], 2: ["yellow"], 3: ["red"], 4: ["purple"]}, [(3, 2, "w"), (2, 4, "w")] if g == "G3" else [(1, 2, "w"), (1, 3, "w"), (3, 2, "w"), (2, 4, "w"), (3, 4, "w")])
    for g in ("G1", "G2", "G3")
}


def random_graphs(seed, n_graphs=4, n=5, m=8, loops=True, types="xy"):
    r = random.Random(seed)
    out = {}
    for g in range(n_graphs):
        labels = {v: r.choice([["a"], ["a"], ["b"], ["a", "b"]]) for v in range(n)}
        edges = []
        for _ in range(m):
            s, d = r.randrange(n), r.randrange(n)
            if s != d or loops:
                edges.append((s, d, r.choice(types)))
        out[f"g{g}"] = (labels, edges)
    return out


def bag(edges, u, v, directed):
    return Counter(t for s, d, t in edges if (s, d) == (u, v) or (not directed and (d, s) == (u, v)))


def embeddings_of(pattern, graph, directed):
    """All injective maps with exact labels under which every pair's edges include the pattern's."""
    labels, edges = pattern
    target, target_edges = graph
    pairs = {(s, d) for s, d, _ in edges}
    found = []
    for image in itertools.permutations(target, len(labels)):
        if all(sorted(target[image[v]]) == sorted(labels[v]) for v in range(len(labels))) and all(not bag(edges, s, d, directed) - bag(target_edges, image[s], image[d], directed) for s, d in pairs):
            found.append(image)
    return found


def checked(mined, graphs, directed, least):
    """Every pattern's counts are recounted, and no two patterns are isomorphic."""
    rows = mined.patterns.collect()
    codes = set()
    for r in rows:
        pattern = [list(x) for x in r.labels], [(e.src, e.dst, e.type) for e in r.edges]
        code = canonical(*pattern, directed)[0]
        assert code == r.code and code not in codes
        codes.add(code)
        by_graph = {g: len(embeddings_of(pattern, x, directed)) for g, x in graphs.items()}
        assert r.support == sum(n > 0 for n in by_graph.values()) >= least
        assert r.frequency == sum(by_graph.values())
        assert r.n_occurrences * len(automorphisms(*pattern, directed)) == r.frequency
    return {r.code: r for r in rows}


def trees_by_brute_force(graphs, directed, least, size):
    """Codes of all frequent patterns grown by observed bags, node by node, without closing edges."""
    level, out = {}, set()
    for labels, _ in graphs.values():
        for l in labels.values():
            level[canonical([sorted(l)], [], directed)[0]] = ([sorted(l)], [])
    enough = lambda p: sum(bool(embeddings_of(p, x, directed)) for x in graphs.values()) >= least
    level = {c: p for c, p in level.items() if enough(p)}
    for _ in range(size - 1):
        out |= set(level)
        new = {}
        for labels, edges in level.values():
            for target, target_edges in graphs.values():
                for image in embeddings_of((labels, edges), (target, target_edges), directed):
                    for p, v in itertools.product(range(len(labels)), target):
                        if v in image:
                            continue
                        more = [(p, len(labels), t) for t in bag(target_edges, image[p], v, directed).elements()]
                        more += [(len(labels), p, t) for t in bag(target_edges, v, image[p], directed).elements()] if directed else []
                        if more:
                            q = [*labels, sorted(target[v])], [*edges, *more]
                            new.setdefault(canonical(*q, directed)[0], q)
        level = {c: p for c, p in new.items() if enough(p)}
    return out | set(level)


def test_golden_paths(spark):
    found = mine(db_of(spark, PATH), 1).patterns.collect()
    text = {(tuple(sorted(l[0] for l in r.labels)), tuple(sorted(f"{r.labels[e.src][0]}>{r.labels[e.dst][0]}" for e in r.edges))): (r.support, r.frequency) for r in found}
    assert text == {
        (("yellow",), ()): (3, 3), (("red",), ()): (3, 4), (("purple",), ()): (3, 3), (("purple", "yellow"), ("yellow>purple",)): (3, 3),
        (("red", "yellow"), ("red>yellow",)): (3, 3), (("purple", "red", "yellow"), ("red>yellow", "yellow>purple")): (3, 3),
    }


@pytest.mark.parametrize("seed,directed,types", [(1, True, "x"), (2, False, "xy")])
def test_mining_is_complete(spark, seed, directed, types):
    graphs = random_graphs(seed, 3, 4, 8, types=types)
    graphs["g1"] = graphs["g0"]  # whatever closes in one closes in two
    if not directed:  # loops are no edges of undirected patterns
        graphs = {g: (l, [e for e in es if e[0] != e[1]]) for g, (l, es) in graphs.items()}
    found = checked(mine(db_of(spark, graphs, directed), 2, max_nodes=3), graphs, directed, 2)
    assert trees_by_brute_force(graphs, directed, 2, 3) <= set(found)
    closed = [r for r in found.values() if r.n_nodes == 3 and len({tuple(sorted((e.src, e.dst))) for e in r.edges}) >= 3]
    assert closed


def test_closing_edges(spark):
    triangle = ({0: ["a"], 1: ["b"], 2: ["c"]}, [(0, 1, "x"), (1, 2, "x"), (2, 0, "x"), (2, 2, "l")])
    graphs = {"g0": triangle, "g1": triangle, "g2": (triangle[0], triangle[1][:2])}
    found = checked(mine(db_of(spark, graphs), 2, max_nodes=3), graphs, True, 2)
    assert max(r.n_edges for r in found.values()) == 4  # all edges that two graphs share are added together
    best = checked(mine(db_of(spark, graphs), 2, max_nodes=3, pattern_type="maximum"), graphs, True, 2)
    assert set(best) < set(found) and all(r.n_nodes == 3 for r in best.values())
    assert checked(mine(db_of(spark, graphs), 2, min_nodes=2, max_nodes=2), graphs, True, 2).keys() == {c for c, r in found.items() if r.n_nodes == 2}


def test_templates(spark):
    graphs = random_graphs(9, 5, 5, 9, loops=False)
    db = db_of(spark, graphs)
    labelled = ([["a"], ["b"]], [(0, 1, "x")])
    for query in (labelled, ([[], []], [(0, 1, "")]), ([["a"], [], []], [(0, 1, "x"), (0, 2, "")]), ([[], [], []], [(0, 1, "x"), (1, 2, "x"), (2, 0, "")]), ([["a"]], []), ([["a"], ["b"]], [(0, 1, "x"), (0, 1, "x")]), ([[], []], [(0, 1, ""), (0, 1, "")])):
        want = defaultdict(int)
        for g, (labels, edges) in graphs.items():
            for image in itertools.permutations(labels, len(query[0])):
                if all(set(query[0][v]) <= set(labels[image[v]]) for v in range(len(image))):
                    options = [[k for k, (s, d, t) in enumerate(edges) if (s, d) == (image[qs], image[qd]) and qt in ("", t)] for qs, qd, qt in query[1]]
                    want[g] += sum(len(set(c)) == len(c) for c in itertools.product(*options))
        rows = matching.match(db, query, symmetric=True).collect()
        assert Counter(r.graph_id for r in rows) == {g: n for g, n in want.items() if n}
        exchanges = len(automorphisms(*query, True))
        for _, n in Counter(query[1]).items():
            for k in range(2, n + 1):
                exchanges *= k
        assert matching.match(db, query).count() * exchanges == len(rows)
    mined = mine(db, 2, max_nodes=2, templates=[([[], []], [(0, 1, "x")])])
    free = {r.code: r for r in mine(db, 2, min_nodes=2, max_nodes=2).patterns.collect()}
    for r in mined.patterns.collect():
        assert len(r.edges) == 1 and r.edges[0].type == "x"
        assert r.code not in free or (free[r.code].support, free[r.code].frequency) == (r.support, r.frequency)
    grown = mine(db, 3, max_nodes=3, templates=[labelled])
    assert {r.n_nodes for r in grown.patterns.collect()} <= {2, 3}
    with pytest.raises(ValueError, match="connected"):
        matching.match(db, ([["a"], ["b"]], []))


def test_undirected_matching(spark):
    db = db_of(spark, {"g": ({0: ["a"], 1: ["a"], 2: ["a"]}, [(0, 1, "x"), (2, 1, "x"), (0, 1, "y")])}, directed=False)
    assert matching.match(db, ([[], []], [(0, 1, "x")])).count() == 2
    assert matching.match(db, ([[], []], [(0, 1, "")]), symmetric=True).count() == 6
    assert matching.match(db, ([[], [], []], [(0, 1, "x"), (1, 2, "x")])).count() == 1
    assert matching.match(db, ([[], []], [(0, 1, ""), (1, 0, "")])).count() == 1


def test_domains_hold_all_matches(spark):
    graphs = random_graphs(12, 4, 5, 10, loops=False)
    db = db_of(spark, graphs)
    query = ([["a"], [], []], [(0, 1, "x"), (1, 2, "y"), (0, 1, "y")])
    pairs = {tuple(r) for r in matching.pair_domain(db, query).collect()}
    nodes = {tuple(r) for r in matching.degree_domain(db, query).collect()}
    passed = {r.graph_id for r in matching.vocabulary_filter(db, query).collect()}
    for r in matching.match(db, query, symmetric=True).collect():
        assert r.graph_id in passed
        assert all((v, r.graph_id, r.node_map[v]) in nodes for v in range(3))
        assert all((i, j, r.graph_id, r.node_map[i], r.node_map[j]) in pairs for i, j in ((0, 1), (1, 2)))


@pytest.mark.parametrize("directed", [True, False])
def test_canonical_codes(directed):
    r = random.Random(4)
    for _ in range(150):
        n = r.randint(1, 6)
        labels = [r.choice([["a"], ["a", "b"], []]) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.choice("xy")) for _ in range(r.randint(0, 7))]
        code, order = canonical(labels, edges, directed)
        p = list(range(n))
        r.shuffle(p)
        moved = [None] * n
        for v in range(n):
            moved[p[v]] = labels[v]
        turned = [(p[s], p[d], t) if directed or r.random() < 0.5 else (p[d], p[s], t) for s, d, t in edges]
        r.shuffle(turned)
        assert canonical(moved, turned, directed)[0] == code and sorted(order) == list(range(n))
        image = [q for q in itertools.permutations(range(n)) if canonical_like(labels, edges, q, directed)]
        assert automorphism_count(labels, edges, directed) == len(image) == len(automorphisms(labels, edges, directed))
    assert canonical([["ab"]], [], True)[0] != canonical([["a", "b"]], [], True)[0]
    star = [["h"]] + [["l"]] * 9
    assert automorphism_count(star, [(0, k, "x") for k in range(1, 10)], True) == 362880 and canonical(star, [(0, k, "x") for k in range(1, 10)], True)[1][-1] >= 0


def canonical_like(labels, edges, q, directed):
    key = lambda es: Counter((s, d, t) if directed else (*sorted((s, d)), t) for s, d, t in es)
    return all(labels[v] == labels[q[v]] for v in range(len(q))) and key(edges) == key([(q[s], q[d], t) for s, d, t in edges])


def test_support():
    assert [parse_support(s, 20) for s in (0.5, 1, 1.1, 3, 0.01, 2.9)] == [10, 20, 1, 3, 1, 2]
    assert parse_support(1.1, 20, compat=True) == 20
    with pytest.raises(ValueError):
        parse_support(0, 5)


def test_pattern_text():
    assert parse_patterns("v 0 kind\nv 1\ne 1 0 G\n") == [([["kind"], []], [(1, 0, "G")])]
    assert parse_patterns("t # 1\nv 5 b a\nt # 2\ne 3 9\n") == [([["a", "b"]], []), ([[], []], [(0, 1, "")])]


def test_planted_pattern(spark):
    from motifspark.sources.generate import planted

    square = ([["a"], ["b"], ["c"], ["d"]], [(0, 1, "x"), (1, 2, "x"), (2, 3, "y"), (3, 0, "y")])
    db = planted(spark, 4, [(*square, [1, 2, 3, 4]), ([["e"], ["a"]], [(0, 1, "z")], [1, 1, 0, 0])])
    assert matching.match(db, square, counts=matching.edge_counts(db, square)).count() == 10
    found = {r.code: r for r in mine(db, 1, min_nodes=4, max_nodes=4).patterns.collect()}
    whole = found[canonical(*square, True)[0]]
    assert (whole.support, whole.frequency, whole.n_occurrences) == (4, 10, 10)


def test_orbits():
    from motifspark.functions.canonical import orbits

    assert orbits([["r"], ["l"], ["l"]], [(0, 1, "x"), (0, 2, "x")], True) == [[0], [1, 2]]
    assert orbits([["r"], ["l"], ["l"]], [(0, 1, "x"), (0, 2, "y")], True) == [[0], [1], [2]]


def test_edge_orbits_and_large_groups():
    from motifspark.functions.canonical import edge_orbits

    assert edge_orbits([["r"], ["l"], ["l"]], [(0, 1, "x"), (0, 2, "x"), (1, 2, "x")], False) == [[0, 1], [2]]
    assert edge_orbits([[]] * 4, [(0, 1, ""), (1, 2, ""), (2, 3, ""), (3, 0, "")], True) == [[0, 1, 2, 3]]
    arms = [(0, 2 * k + 1, "a") for k in range(10)] + [(2 * k + 1, 2 * k + 2, "b") for k in range(10)]
    assert automorphism_count([["x"]] * 21, arms, True) == 3628800  # counted by orbits, not one by one


@pytest.mark.parametrize("symmetric", [False, True])
def test_parts_of_the_matcher_find_the_same(spark, symmetric):
    r = random.Random(61)
    nodes = [(f"g{g}", v, [r.choice("AB")] if r.random() < 0.8 else []) for g in range(12) for v in range(6)]
    edges = [(f"g{g}", r.randrange(6), r.randrange(6), r.choice("xy")) for g in range(12) for _ in range(r.randint(2, 12))]
    for directed in (True, False):
        db = graph_db(spark.createDataFrame(nodes, "graph_id string, node_id bigint, labels array<string>"), spark.createDataFrame(edges, "graph_id string, src bigint, dst bigint, type string"), directed).stored()
        for query in (([["A"], [], ["B"]], [(0, 1, "x"), (1, 2, "y")]), ([[], []], [(0, 1, "x"), (0, 1, "x")]), ([["A"]], []), ([[], [], []], [(0, 1, "x"), (1, 2, "x"), (2, 0, "")])):
            rows = lambda parts: sorted(map(str, matching.match(db, query, symmetric, parts=parts, with_labels=True).collect()))  # noqa: E731, B023
            assert rows(matching.PLAIN) == rows(matching.SELECTIVE)
