"""The token store's hash index, and ids that very many rows share."""

import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motifspark.llm import token_store
from motifspark.llm.common import ChunkMemo

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=400))
def test_every_key_is_found_at_its_place(keys):
    keys = np.sort(np.array(keys, np.int64))
    counts = np.arange(len(keys)) % 5 + 1
    payload = np.arange(counts.sum(), dtype="<u2")
    row = token_store.pack(0, 0, keys, counts, payload.tobytes())
    shard = token_store.Shard.of(row["seeds"], row["slots"], row["payload"], row["n_ids"])
    known, at, n = shard.find(keys, token_store.repeats_of(keys))
    assert known.all() and at.tolist() == (np.cumsum(counts) - counts).tolist() and n.tolist() == counts.tolist()
    assert len(shard.slots) == len(keys) and sorted(shard.slots["offset"].tolist()) == at.tolist()
    others = np.array([k for k in range(1000) if k not in set(keys.tolist())], np.int64)
    assert shard.find(others, others * 0)[0].sum() <= 1


def test_one_id_in_ten_thousand_rows(spark):
    texts = ["alpha beta", "beta, gamma.", None]
    rows = [(7, texts[k % 3]) for k in range(9_000)] + [(None, texts[k % 2]) for k in range(1000)] + [(k, texts[0]) for k in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    store = token_store.write_tokens(docs, PATH, shard_ids=2000, parts=6)
    held = store.shards().selectExpr("part", "shard", "first", "last", "n_docs", "n_ids").collect()
    assert max(x.n_ids for x in held) < 2100 and len({x.part for x in held if x.first == x.last == 7}) >= 3
    found = sorted(store.documents().collect(), key=lambda x: x.start)
    library = Tokenizer.from_file(PATH)
    code = {t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts}
    assert sorted((x.doc_id or -1, x.n_tokens, x.ids_crc32) for x in found) == sorted((d or -1, len(code[t]) // 4, zlib.crc32(code[t])) for d, t in rows)
    assert [x.doc_id or -1 for x in found] == sorted(x.doc_id or -1 for x in found)
    assert [x.start for x in found] == np.cumsum([0, *(x.n_tokens for x in found)])[:-1].tolist()
    assert {x.doc_id for x in store.lookup([7, 25, 50]).collect()} == {7, 25}


TEXTS = st.lists(st.sampled_from(["a", "word", "Word.", "it's", " ", "  ", "\n", "\n\n", "é", "中", ".", "!?", "1", "\t", "\xa0", "\x1c", "<|endoftext|>", "x1.", "...", ",b"]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_batches_are_encoded_like_single_texts(texts):
    import pyarrow as pa

    coder, library = token_store._coder(PATH), Tokenizer.from_file(PATH)
    assert isinstance(coder.memo, ChunkMemo)
    got = [np.frombuffer(x, "<u2").tolist() for x in coder.batch(pa.array(texts, pa.string())).to_pylist()]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_memo_changes_nothing():
    import pyarrow as pa

    seen = []
    memo = ChunkMemo(lambda pieces: seen.extend(pieces) or [p.encode() for p in pieces], limit=5)
    texts = [f"w{k} w{k}, x{k % 3}.\ny{k % 7} z" for k in range(300)]
    assert [x.decode() for x in memo.batch(pa.array(texts)).to_pylist()] == texts
    assert [memo(t).decode() for t in texts] == texts and len(memo.known) < 1500
