"""What a Python worker holds at once, and from one operator to the next."""

import gc
import weakref
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from motifspark.llm import common, decontam, rank_bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_slices_have_few_bytes_and_all_rows():
    texts = [None, "a" * 30, "", "é" * 40, *["b" * 7] * 50, "c" * 500, None]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    for part in (batch, batch.slice(2, 40)):
        for rows, size in ((10, 100), (3, 50), (100, 1), (100, None), (1, 10_000)):
            got = list(common.slices(part, rows, size))
            assert [x for p in got for x in p.column(0).to_pylist()] == part.column(0).to_pylist()
            assert all(0 < p.num_rows <= rows for p in got)
            assert size is None or part.nbytes <= size or all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= size for p in got)
    assert not list(common.slices(batch.slice(0, 0), 10, 100))


def test_a_worker_encodes_a_large_batch_in_slices(spark, monkeypatch):
    import tiktoken

    docs = spark.createDataFrame([(1, "")], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kind: run)
    run = rank_bpe.encode_texts(docs, RANKS, P.PATTERN, decoded=True)
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 900, 3000)) for _ in range(400)]
    got = list(run(iter([pa.record_batch({"doc_id": pa.array(range(400), pa.int64()), "text": pa.array(texts)})])))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_bpe.read_ranks(RANKS), special_tokens={})
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(400))
    assert [x.decode() for b in got for x in b.column(2).to_pylist()] == texts
    ids = [x for b in got for x in b.column(1).to_pylist()]
    assert all(np.frombuffer(ids[k], "<u4").tolist() == library.encode_ordinary(texts[k]) for k in (0, 57, 399))
    assert sum(map(len, texts)) > 5_000_000 and all(sum(map(len, b.column(2).to_pylist())) <= 2 << 20 for b in got)


def test_the_items_of_a_benchmark_go_when_a_worker_serves_another_operator():
    shared = SimpleNamespace(value=([7], [["one", "two", "three", "four", "five", "six"]], 0.5))
    matcher = decontam._matcher(shared)
    assert decontam._matcher(shared) is matcher and matcher.find("one two three four five six")
    gone = weakref.ref(matcher)
    del matcher
    common.drop_others(decontam.__name__)
    assert gone() is not None
    common.drop_others(rank_bpe.__name__)
    gc.collect()
    assert gone() is None
