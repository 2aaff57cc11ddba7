"""The pipeline's near-dedup stage against brute force over 5-word shingles."""

import random

import numpy as np

import corpus_pipeline
from motifspark.llm import similar, simhash
from tests.llm.test_corpus import SCHEMA, closed


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def edited(r, words, n):
    """The words with n of them replaced, far enough apart to spoil five shingles each."""
    out = list(words)
    for k in r.sample(range(5, len(words) - 5, 6), n):
        out[k] = f"e{r.randrange(10**9)}"
    return " ".join(out)


def test_near_dedup_equals_brute_force(spark):
    r = random.Random(13)
    fresh = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    line, texts = fresh(20), []
    for n in (60, 94, 94, 130, 300, 301):
        base = fresh(n)
        texts += [" ".join(base), " ".join(base), " ".join(base).upper()] + [edited(r, base, k) for k in range(1, 1 + n // 30) for _ in range(2)]
    hub = fresh(150)
    texts += [edited(r, hub, 3) for _ in range(40)]  # each is similar to some of the others only by way of the rest
    texts += [" ".join(fresh(30) + line + fresh(30)) for _ in range(30)] + ["one two", "One  two", "one two three", "", " \n", None]
    # shingles 1 to 100: unions of 100, of which 80 and 79 are shared
    ladder = fresh(104)
    texts += [" ".join(ladder), " ".join(ladder[:84]), " ".join(ladder[21:])]
    ids = r.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    sets = {d: shingles(t) for d, t in zip(ids, texts, strict=True)}
    want = closed(sorted(ids), lambda a, b: near(sets[a], sets[b]))
    far = closed(sorted(ids), lambda a, b: sets[a] == sets[b])
    assert len(set(want.values())) < len(set(far.values())) - 30
    found = {x.doc_id: x.component_id for x in similar.similar(docs, simhash.components).collect()}
    assert found == want
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_columns_named_like_the_working_ones(spark):
    rows = [(k, text, "en", "a", 0, 7, "x", k, 1) for k, text in enumerate(["a b c d e f g", "a b c d e f g", "h i j k l m", None, ""])]
    docs = spark.createDataFrame(rows, SCHEMA + ", __key int, __text string, __needed int, component_id int")
    assert sorted(map(tuple, simhash.keep_first(docs).collect())) == [rows[0], rows[2], rows[3]]


def test_fingerprints_connect_near_copies_first(spark, monkeypatch):
    """The stage compares the pairs of the range join of fingerprints before any others, and loses none that are farther apart."""
    r = random.Random(17)
    base = [f"w{r.randrange(3000)}" for _ in range(2000)]
    texts = [" ".join(base), edited(r, base, 1), edited(r, base, 40)] + [" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(5)]
    prints = [simhash.majority(similar.gram_set(t, 5, {})) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.NEAR < (prints[0] ^ prints[2]).bit_count()
    seen, verified = [], similar.verified

    def spy(pairs, named, *rest):
        found = verified(pairs, named, *rest)
        ids = {x.node: x.doc_id.i for x in named.collect()}
        seen.append({frozenset((ids[x.a], ids[x.b])) for x in found.collect()})
        return found

    monkeypatch.setattr(similar, "verified", spy)
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], SCHEMA)
    kept = sorted(x.doc_id for x in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect())
    assert seen[0] == {frozenset((0, 1))} and kept == [0, 3, 4, 5, 6, 7]


def test_bound_holds_for_sets_of_all_sizes():
    """Long sets have more segments: unrelated ones are told apart by the bound, and it never exceeds the distance."""
    r = np.random.default_rng(5)
    fresh = lambda n: np.unique(r.integers(0, 1 << 64, n, np.uint64))
    sets = [fresh(n) for n in (0, 1, 30, 700, 760, 800, 1500, 1600, 5000, 5100, 40000)]
    sets += [np.unique(np.concatenate([x[len(x) // 9 :], fresh(len(x) // 9)])) for x in sets]
    counts = [similar.segment_counts(x) for x in sets]
    for x, a in zip(sets, counts, strict=True):
        for y, b, far in zip(sets, counts, similar.apart([a] * len(sets), counts), strict=True):
            true, both = len(np.setxor1d(x, y)), len(x) + len(y)
            assert far <= true
            assert 9 * far > both or 2 * true < both or min(len(x), len(y)) < 700
