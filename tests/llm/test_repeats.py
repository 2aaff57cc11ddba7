"""Suffix-array dedup where one passage is in very many documents, in different surroundings, and where one anchor's segments
are too many for one suffix array."""

import random

import numpy as np
import pyarrow as pa

from motifspark.llm import suffix_dedup
from tests.llm.test_corpus import removed


def values(df):
    return {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digest(df).collect()}


def test_a_passage_in_thousands_of_surroundings(spark):
    r = random.Random(23)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, line = letters(70), "\n" + letters(52) + "\n"
    rows = [(k, letters(r.choice([0, 1, 15, 60])) + passage + letters(r.choice([0, 1, 15, 60]))) for k in range(5000)]
    rows += [(5000 + k, letters(30) + line + letters(20) + line * (k % 3)) for k in range(300)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert len(suffix_dedup.hot_grams(docs.selectExpr("doc_id", "text", "0L AS rid"), len(rows)).hashes) >= 55
    assert values(suffix_dedup.remove_repeats(docs)) == removed(rows)


def test_anchors_do_not_depend_on_the_texts_around(monkeypatch):
    r = random.Random(29)
    texts = [bytes(r.choice(b"ab \n") for _ in range(r.choice([0, 10, 49, 50, 51, 300]))) for _ in range(60)]
    hot = suffix_dedup.HotGrams(suffix_dedup.gram_hashes(texts[-1] + bytes(400), 0, 300)[::3])

    def marked(raws):
        row, h, first, last = suffix_dedup.anchors(raws, hot)
        return {(raws[i][a + j : a + j + 50], k) for i, k, a, b in zip(row, h, first, last) for j in range(b - a + 1)}, sorted((int(i), int(p)) for i, a, b in zip(row, first, last) for p in range(a, b + 1))

    strings, places = marked(texts)
    assert places == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)]
    assert len({s for s, _ in strings}) == len(strings)  # equal strings have equal anchors
    assert strings == set().union(*(marked([t])[0] for t in texts))
    monkeypatch.setattr(suffix_dedup, "WINDOW", 64)
    assert marked(texts) == (strings, places)


def test_segments_dealt_out_in_parts_find_the_same():
    r = random.Random(31)
    parts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (30, 45, 60)]
    raws = [(b"".join(r.choice(parts) for _ in range(3)))[r.randrange(20) :][:84] for _ in range(400)]
    buffer = np.frombuffer(b"".join(raws) + bytes(88), np.uint8)
    sizes = np.array([len(x) for x in raws])
    n = np.arange(len(raws))
    s = suffix_dedup.Segments.cut(np.full(len(raws), 7), buffer, np.cumsum(sizes) - sizes, sizes, n, n * 0, n * 0)
    heads, _ = s.collapsed()
    whole = sorted(zip(*(x.tolist() for x in suffix_dedup.spans_of(heads))))
    assert whole and whole == sorted(zip(*(x.tolist() for x in suffix_dedup.spans_of(heads, 500))))


def test_common_prefixes_are_exact():
    r = random.Random(37)
    text = np.frombuffer(bytes(r.choice(b"aab") for _ in range(400)) * 2, np.uint8)
    order = suffix_dedup.suffix_array(text)
    raw = text.tobytes()
    for found, a, b in zip(suffix_dedup.common_prefixes(text, order)[1:].tolist(), order[1:].tolist(), order.tolist()):
        x, y = raw[a : a + 50].ljust(50, b"\0"), raw[b : b + 50].ljust(50, b"\0")
        assert found == next((k for k in range(50) if x[k] != y[k]), 50)


def test_rows_of_segments_in_any_batches():
    r = random.Random(41)
    rows = sorted((k, bytes(r.choice(b"ab") for _ in range(60)) if r.random() < 0.5 else bytes([97 + k]) * 70, d) for k in range(6) for d in range(30))
    table = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], pa.binary()), *(pa.array([x[2] if c == 0 else 0 for x in rows]) for c in range(4)), pa.nulls(len(rows), pa.binary())], names=["k", "segment", "doc_id", "rid", "low", "high", "more"])

    def found(rows_each, chunk):
        covered = set()
        for b in suffix_dedup._compared((table.slice(k, rows_each) for k in range(0, len(rows), rows_each)), chunk):
            covered |= {(d, p) for d, _, low, high in zip(*(c.to_pylist() for c in b.columns)) for p in range(low, high)}
        return covered

    assert found(len(rows), 10**6) == found(7, 300) == found(1, 100) != set()


def test_periodic_texts(spark):
    r = random.Random(43)
    rows = [(k, " ".join(r.choice(["same words. " * r.randint(3, 60), "ab" * 80, "x" * r.randint(40, 130)]) for _ in range(r.randint(1, 3)))) for k in range(150)]
    r.shuffle(rows)
    rows += [(3000, "only here, again and again! " * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert values(suffix_dedup.remove_repeats(docs)) == removed(rows)
