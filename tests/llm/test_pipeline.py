"""The pipeline against a brute-force version, and the registered queries over a small table."""

import bisect
import hashlib
import re

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from motifspark.llm import queries, rank_bpe, secret_scan, url_filter
from tests.llm.test_corpus import SCHEMA, closed, corpus, counted, plain_alignment, secrets
from tests.llm.test_similar import near, shingles


def tables(spark, folder):
    r = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"q{k}" for k in r.integers(0, 4000, n))
    items = [fresh(25) for _ in range(4)]
    rows = corpus()
    rows += [(200 + k, f"{fresh(40)} {items[k % 3]} {fresh(40)}", "en", "a", 0) for k in range(6)]
    rows.append((210, fresh(70) + ' password = "hunter2hunter2" ' + fresh(10), "en", "a", 0))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.net/fr/x"), (2, None)], "page_id bigint, url string").write.parquet(f"{folder}/pages.parquet")
    return rows, items


def bucket(v):
    e = max(0, v.bit_length() - 6)
    return e * 32 + (v >> e)


def value(b):
    return b if b < 64 else (b - (b // 32 - 1) * 32) << (b // 32 - 1)


def kept_by_quality(rows):
    """The ids that the quality rules keep, by weighted quantiles over the values themselves."""
    signals, passed = {}, []
    for d, text, lang, source, _ in rows:
        n, chars, symbols, dup, repeats = counted(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        signals[d] = (symbols * 10000 // max(chars, 1), repeats * 10000 // max(n, 1), dup * 10000 // max(lines, 1), chars * 100 // max(n, 1))
        if n >= 50 and 100 * repeats <= 50 * n:
            passed.append((d, lang, source))
    kept = {d for d, *_ in passed}
    for k, (inner, outer, spreads, both) in enumerate([(50, 75, 5, False), (90, 99, 3, False), (90, 99, 3, False), (50, 75, 11, True)]):
        of = lambda test: sorted(bucket(signals[d][k]) for d, lang, source in passed if test(lang, source))  # noqa: E731, B023
        for group in {(lang, source) for _, lang, source in passed}:
            own, lang, corpus = of(lambda a, b: (a, b) == group), of(lambda a, b: a == group[0]), of(lambda a, b: True)  # noqa: B023
            upto = lambda xs, b: bisect.bisect_right(xs, b)
            at = lambda q: next(b for b in sorted(set(corpus)) if 100 * (1000 * upto(own, b) + 100_000 * upto(lang, b) // len(lang) + 100_000 * upto(corpus, b) // len(corpus)) >= q * (1000 * len(own) + 200_000))  # noqa: E731, B023
            top = value(at(outer) + 1)
            high, low = bucket(top + spreads * (top - value(at(inner)))), 0
            if both:
                bottom = value(at(100 - outer))
                low = bucket(max(0, bottom - spreads * (value(at(100 - inner) + 1) - bottom)))
            kept -= {d for d, *g in passed if tuple(g) == group and not low <= bucket(signals[d][k]) <= high}
    return kept


def leaks(text, items):
    """Whether any item, aligned in full with the whole text, has the score asked for."""
    words = re.findall(r"\w+", text.lower())
    for item in items:
        own = re.findall(r"\w+", item.lower())
        if plain_alignment(own, words) >= max(len(own) / 2, min(len(own), 5)):
            return True
    return False


def test_pipeline(spark, tmp_path):
    import tiktoken

    rows, items = tables(spark, tmp_path)
    good = kept_by_quality(rows)
    assert good == {r.doc_id for r in queries.op2_quality_rules(spark, str(tmp_path)).collect() if r.kept} and 60 < len(good) < len(rows) - 10
    texts = {d: t for d, t, *_ in rows if d in good}
    sets = {d: shingles(t) for d, t in texts.items()}
    groups = closed(sorted(sets), lambda a, b: near(sets[a], sets[b]))
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    texts = {d: t for d, t in texts.items() if not leaks(t, items)}
    assert not any(200 <= d < 206 for d in texts) and 210 in texts
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for d, t in texts.items():
        out, done = "", 0
        for a, b, _ in secrets(t):
            if a >= done:
                out += t[done:a] + "[secret]"
            done = max(done, b)
        out += t[done:]
        ids = np.array(library.encode_ordinary(out), "<u4")
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want and len(found) == len(want)
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in found)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, _ = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_every_query_returns_a_row_for_each_input_row(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    for name, query in queries.QUERIES.items():
        n = query(spark, str(tmp_path)).count()
        assert n == (2 if name.startswith("op7") else 6 if name.startswith("op6") else len(rows)), name
    assert url_filter.BASE_RULES and secret_scan.BASE_KINDS == ("assign", "access", "hex")
