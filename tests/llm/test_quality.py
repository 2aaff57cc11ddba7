"""Thresholds come from the sketches of a source, its language and the corpus."""

import random

import pytest

from motifspark.llm import quality
from tests.llm.test_corpus import SCHEMA


def sketch_rows(spark, groups):
    """groups: (lang, source) -> values of the symbol rate; the other signals are constant."""
    rows = [(lang, source, v, 0, 0, 500, False) for (lang, source), values in groups.items() for v in values]
    return spark.createDataFrame(rows, "lang string, source string, __symbol_rate long, __repeat_rate long, __dup_line_rate long, __word_length long, __base_failed boolean")


def fences(spark, groups):
    return {(x.lang, x.source): tuple(x.fences["symbol_rate"]) for x in quality.thresholds(sketch_rows(spark, groups), "lang", "source", "__").collect()}


def bucket_of(v):
    e = max(0, v.bit_length() - 6)
    return e * 32 + (v >> e)


def expected(groups, key):
    """The high fence by brute force over weighted values."""
    own, lang = groups[key], [v for (x, _), values in groups.items() if x == key[0] for v in values]
    corpus = [v for values in groups.values() for v in values]
    floor = lambda v: v if v < 64 else v >> v.bit_length() - 6 << v.bit_length() - 6
    upto = lambda values, v: sum(floor(x) <= v for x in values)
    weight = 1000 * len(own) + 2 * 1000 * quality.PRIOR
    at = lambda q: next(v for v in sorted({floor(x) for x in corpus}) if 100 * (1000 * upto(own, v) + 1000 * quality.PRIOR * upto(lang, v) // len(lang) + 1000 * quality.PRIOR * upto(corpus, v) // len(corpus)) >= q * weight)
    beyond = at(75) + max(1, 1 << at(75).bit_length() - 6 if at(75) > 63 else 1)
    return bucket_of(beyond + 5 * (beyond - at(50)))


@pytest.fixture(scope="module")
def groups():
    r = random.Random(47)
    drawn = lambda n, top: [r.randint(0, top) for _ in range(n)]
    return {("en", "a"): drawn(900, 40), ("en", "b"): drawn(3, 40), ("en", None): drawn(500, 200), ("fr", "a"): drawn(60, 500), (None, "a"): drawn(1, 5000)}


def test_fences_equal_brute_force(spark, groups):
    assert fences(spark, groups) == {k: (0, expected(groups, k)) for k in groups}


def test_a_sources_distribution_moves_its_fence(spark, groups):
    before = fences(spark, groups)
    after = fences(spark, groups | {("en", "a"): [10 * v for v in groups["en", "a"]]})
    assert after["en", "a"][1] > before["en", "a"][1] + 32  # more than a power of two
    assert fences(spark, groups | {("en", "a"): groups["en", "a"] + [9000] * 90})["en", "a"][1] < before["en", "a"][1] + 16  # a tenth of junk hardly does


def test_few_documents_lean_on_the_rest(spark, groups):
    few = fences(spark, groups | {("en", "b"): [5000] * 3})["en", "b"][1]
    many = fences(spark, groups | {("en", "b"): [4000 + k for k in range(2000)]})["en", "b"][1]
    assert few < bucket_of(1000) < bucket_of(4000) < many


def test_columns_named_like_the_working_ones(spark):
    r = random.Random(5)
    text = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(80))
    rows = [(k, text() if k else text() + " #" * 90, "en", "a", 0, k, "x", k, k) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA + ", __n_words int, __kept string, ___fences int, fences int")
    assert sorted(map(tuple, quality.keep_good(docs).collect())) == rows[1:]
    assert {x.doc_id: x.kept for x in quality.quality_table(docs).collect()} == {k: k > 0 for k in range(40)}
