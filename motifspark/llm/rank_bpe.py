"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that a merge rank exists for waits in the bucket of its rank, by its
position; a bucket is a heap of positions. A bit for each rank, in words of 256, and a bit for each word, in one more, mark the
buckets with entries, so find-first-set on both levels gives the next rank. A merge links past its right part and files the two
new pairs; entries whose pair has changed since are stale and skipped when they come up. A pre-token of n bytes takes
O(n log n) steps, however long, and about 200 bytes of memory for each of its bytes.

Defined cases: a null or empty text has no ids; repeated rows and ids are encoded as they are; an empty table gives an empty
result; of equal ranks the leftmost pair is merged first; columns of docs other than those named are ignored. Ids are
little-endian unsigned 32-bit integers. A pattern that can match across a space or line end between two other characters is
found out when a coder is made, and its texts are then not cut there.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkMemo, by_batch, cuts_at_blanks, table_of, with_fields

#: Bytes of texts that are encoded at once; what a worker holds beside its tables is a multiple of it.
SLICE = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().split(b"\n")))}


class RankBpe:
    """encode() and decode() under a rank table; `pattern` splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 400_000):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        bytes_of = {r: b for b, r in ranks.items()}
        self.tokens = pa.array([bytes_of.get(r) for r in range(max(ranks.values(), default=-1) + 1)], pa.binary())
        # marks of the ranks with entries: a word of 256 bits for each 256 ranks; merge() has one more for those words
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.pieces: dict[bytes, bytes] = {}
        self.limit = memo // 2
        self.memo = ChunkMemo(self._encode_all, memo) if cuts_at_blanks(lambda t: tuple(self.pattern.findall(t))) else None

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, low, top = len(piece), self.ranks.get, self.low, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(piece[k : k + 2], -1) for k in range(n - 1)]  # the rank of the pair that starts at each position
        pair.append(-1)
        buckets: dict[int, list[int]] = {}  # heaps of positions by rank; ascending positions are one
        for k, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(k)
                else:
                    buckets[rank] = [k]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            bit = word & -word
            rank = (a << 8) + bit.bit_length() - 1
            bucket = buckets[rank]
            k = heappop(bucket)
            if not bucket:
                del buckets[rank]
                word ^= bit
                low[a] = word
                if not word:
                    top &= top - 1
            if pair[k] != rank:
                continue
            gone = after[k]
            end = after[k] = after[gone]
            pair[gone] = pair[k] = -1
            left = before[k]
            if end < n:
                before[end] = k
                rank = get(piece[k : after[end]])
                if rank is not None:
                    pair[k] = rank
                    if rank in buckets:
                        heappush(buckets[rank], k)
                    else:
                        buckets[rank] = [k]
                        low[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
            if left >= 0:
                rank = get(piece[left:end])
                if rank is None:
                    pair[left] = -1
                else:
                    pair[left] = rank
                    if rank in buckets:
                        heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        low[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
        ids, k = [], 0
        while k < n:
            ids.append(self.ranks[piece[k : after[k]]])
            k = after[k]
        return ids

    def _encode_all(self, pieces: list[str]) -> list[bytes]:
        out, known = [], self.pieces
        for text in pieces:
            if text[0] == " " and text[1:].isalpha() and text.isascii():  # one match of the pattern
                out.append(array("I", self.merge(text.encode())).tobytes())
                continue
            ids = []
            for token in self.pattern.findall(text):
                raw = token.encode("utf-8")
                code = known.get(raw)
                if code is None:
                    code = array("I", self.merge(raw)).tobytes()
                    if len(raw) <= 48 and len(known) < self.limit:
                        known[raw] = code
                ids.append(code)
            out.append(b"".join(ids))
        return out

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        """The ids of texts without nulls."""
        return self.memo.batch(texts) if self.memo else pa.array(self._encode_all(texts.to_pylist()), pa.binary())

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch(pa.array([text or ""], pa.string()))[0].as_py()

    def decode_batch(self, ids: pa.Array) -> pa.Array:
        """The bytes that ids stand for."""
        ids = ids.cast(pa.binary()) if ids.type != pa.binary() else ids
        offsets = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)
        flat = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4")
        parts = self.tokens.take(pa.array(flat))
        if parts.null_count:
            raise ValueError("ids that no token has")
        at = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, parts.offset * 4)[(offsets - offsets[0]) // 4]
        valid = None if not ids.null_count else pa.array(ids.is_valid()).buffers()[1]
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [valid, pa.py_buffer(np.ascontiguousarray(at)), parts.buffers()[2] or pa.py_buffer(b"")])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_batch(pa.array([ids], pa.binary()))[0].as_py()


def bpe(path: str, pattern: str) -> RankBpe:
    """One coder for each Python worker."""
    return table_of(__name__, (path, pattern), lambda: RankBpe(read_ranks(path), pattern))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the ids as binary; with decoded also text_bytes, what the ids decode to, by the same Python worker. path:
    the rank file, which every executor must have."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        coder = bpe(path, pattern)
        ids = coder.encode_batch(batch.column(1).fill_null(""))
        return {"doc_id": batch.column(0), "ids": ids} | ({"text_bytes": coder.decode_batch(ids)} if decoded else {})

    return by_batch(docs.select(id_col, text_col), run, with_fields(docs.select(F.col(id_col).alias("doc_id")), "ids binary, text_bytes binary" if decoded else "ids binary"), size=SLICE)


def decode_ids(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """coded with a column text_bytes (binary), the bytes that the ids stand for."""
    at = coded.columns.index(ids_col)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        coder = bpe(path, pattern)
        return dict(zip([*coded_names, "text_bytes"], [*batch.columns, coder.decode_batch(batch.column(at))], strict=True))

    coded_names = coded.columns
    return by_batch(coded, run, with_fields(coded, "text_bytes binary"), rows=500)


def encoding_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to)."""
    out = encode_texts(docs, path, pattern, id_col, text_col, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text_bytes", 256).alias("decoded_sha256"))
