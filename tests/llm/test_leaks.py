"""Benchmark items that leaked into very many documents, cut or edited, and the bound that spares alignments."""

import random

import numpy as np
import pytest

from motifspark.llm import decontam


@pytest.mark.parametrize("way", ["cut", "every 8th", "every 6th"])
def test_partial_copies_in_a_thousand_documents(spark, way):
    r = random.Random(17)
    fresh = lambda n: [f"q{r.randrange(5000)}" for _ in range(n)]
    items = [fresh(40) for _ in range(3)]
    step = 8 if way == "every 8th" else 6
    leaked = items[1][:24] if way == "cut" else [f"edited{k}" if k % step == step - 1 else w for k, w in enumerate(items[1])]
    texts = [fresh(20) + leaked + fresh(20) for _ in range(1000)] + [fresh(80) for _ in range(50)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.find_leaks(docs, bench).collect()} == {(k, 1) for k in range(1000)}
    assert sorted(x.doc_id for x in decontam.drop_leaks(docs, bench).collect()) == list(range(1000, 1050))


def test_found_wherever_an_ngram_is_shared_and_the_score_reached():
    """Against alignment of every item with the whole text, for texts of few words, edited in all ways."""
    r = random.Random(19)
    seen = 0
    for _ in range(400):
        item = [f"w{r.randrange(12)}" for _ in range(r.randint(6, 20))]
        text = [f"w{r.randrange(30)}" for _ in range(5)]
        for w in item:
            text += r.choice([[w], [w], [w], [w], ["x"], [], [w, "y"]])
        text += [f"w{r.randrange(30)}" for _ in range(5)]
        grams = lambda x: set(zip(x, x[1:], x[2:], strict=False))
        codes = {w: k for k, w in enumerate(dict.fromkeys(item + text))}
        score = decontam.align(np.array([codes[w] for w in item]), np.array([codes[w] for w in text]))[0]
        found = decontam.Matcher([item], 0.5).find(" ".join(text))
        want = score >= max(0.5 * len(item), 5) and bool(grams(item) & grams(text))
        assert bool(found) == want and (not found or found[0][1] == score / len(item))
        seen += want
    assert 50 < seen < 390


CASES = [
    "Paris", "two words", "東京は日本の首都です。人口はとても多い。", "ภาษาไทยไม่มีช่องว่าง", "", None, "A somewhat longer question, which asks: what is the answer to it?",
    "the the the the the the", "A somewhat longer question, which asks: what is the answer to it?",
]


@pytest.fixture(scope="module")
def leaky():
    r = random.Random(53)
    fresh = lambda n: " ".join(f"q{r.randrange(4000)}" for _ in range(n))
    items = [(k, t) for k, t in enumerate(CASES)] + [(20 + k, fresh(r.randint(1, 40))) for k in range(25)] + [(None, fresh(12))]
    texts = [fresh(60) for _ in range(30)] + [None, "", "I saw paris, once.", "words two words; two", "in two. WORDS", "の首都です。人口はとても多い", "私は東京は日本の首都です と", "ไม่มีช่องว่าง ภาษาไทยไม่มี", "the the the cat and the the dog"]
    for _, t in items:
        if t and " " in t:
            w = t.split()
            for _ in range(3):
                kept = [x for x in w if r.random() > 0.15]
                for _ in range(len(w) // 8):
                    kept.insert(r.randrange(len(kept) + 1), "extra")
                texts.append(f"{fresh(20)} {' '.join(kept)} {fresh(20)}")
            texts.append(f"{fresh(5)} {' '.join(w[: len(w) // 2])} {fresh(5)}")
    return items, [(k if k % 9 else None, t) for k, t in enumerate(texts)]


def test_every_item_against_every_document(spark, leaky):
    """Full alignment of all items with all whole texts; the operator finds all that share a seed, which is nearly all."""
    items, rows = leaky
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    want, lost = [], 0
    for d, text in rows:
        words = decontam.words_of(text)
        for i, t in items:
            own = decontam.words_of(t)
            codes = {w: k for k, w in enumerate(dict.fromkeys(own + words))}
            score = decontam.align(np.array([codes[w] for w in own]), np.array([codes[w] for w in words]))[0] if own and words else 0
            if own and score >= max(len(own) / 2, min(len(own), 5)):
                n = min(3, len(own))
                seeds = lambda x: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
                if seeds(own) & seeds(words):
                    want.append((d, i, score / len(own)))
                else:
                    lost += 1
    found = decontam.find_leaks(docs, bench).collect()
    assert sorted(((x.doc_id, x.item_id, x.score) for x in found), key=repr) == sorted(want, key=repr)
    assert lost <= 0.05 * len(want)  # recall of 0.95 or more
    assert {0, 1, 2, 3} <= {x.item_id for x in found}
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows_of(decontam.find_leaks(docs, bench, broadcast_bytes=0)) == rows_of(decontam.find_leaks(docs, bench))


def test_columns_named_like_the_working_ones(spark, leaky):
    items, rows = leaky
    docs = spark.createDataFrame([(*x, 1, "a", 2) for x in rows], "doc_id bigint, text string, digest int, __digest string, salt int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = [sorted(map(tuple, decontam.drop_leaks(docs, bench, broadcast_bytes=n).collect()), key=repr) for n in (0, 1 << 20)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < len(rows)
