"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id are removed.

1. Anchors: in every 50-byte string the 16 bytes with the smallest hash are its anchor, so equal strings have equal anchors.
   Each text gives about one anchor for every 18 bytes. Grams that many texts hold are taken only by strings that hold no
   others, so the strings at the edges of a hot passage spread over the grams of what stands around it.
2. Sharing: anchors are dealt out by hash in packed arrays; those that documents with different ids hold go on. Anchors on hot
   grams are known to be shared and are not dealt out.
3. Segments: for each shared anchor, the at most 84 bytes that the 50-byte strings it is the anchor of lie in. Equal segments
   of a batch of documents are collapsed before the shuffle: all but those of the smallest id repeat throughout.
4. Suffix arrays: the different segments of the anchors that have more than one are sorted in two stages. Suffixes smaller than
   their successors are sorted directly; scans over the buckets of first bytes, in ascending order, induce the rest. The common
   prefixes of adjacent suffixes are computed, runs of 50 bytes or more are equal strings, and the smallest id keeps them.
5. The spans found are merged for each document and cut out of its text.

An anchor with more different segments than one array should hold has its strings dealt out by a hash of their 50 bytes, in as
many passes as needed, so memory is bounded by the segments themselves. Which grams count as hot is estimated from a bounded
sample; this decides where strings are compared, never what is found.

Defined cases: a null text is an empty one; documents with a null id come after all others; rows with equal ids are never
smaller than each other, so they keep what they share; texts shorter than a string keep all; an empty table gives an empty
result; columns of docs other than the two named are ignored. A task needs some 20 bytes for each byte of its longest text and
50 MB for the anchors of half a million strings, which are made at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, broadcast_if_small, by_batch, discard, release, written

STRING, GRAM = 50, 16
SPAN = STRING - GRAM + 1
#: Bytes of a segment at most, and the width of the rows that segments are kept in: room for one more, in whole words.
SEGMENT, ROW = STRING + SPAN - 1, 88
LAST_ID = (1 << 63) - 1
#: Bytes of segments that one suffix array is made of, about.
CHUNK = 1_000_000
#: String starts that anchors are made for at a time.
WINDOW = 1 << 19
#: Documents looked at for hot grams, and the share of them that holds a hot one.
SAMPLE, HOT_SHARE = 1000, 0.01
#: Parts that rows of one text are dealt into.
SALTS = 16
_MIX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


class HotGrams:
    """The sorted hashes of hot grams, behind a table of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.leading = np.zeros(1 << 20, bool)
        self.leading[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def among(self, x: np.ndarray) -> np.ndarray:
        """Places in x of hot grams."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.leading[(x >> np.uint64(44)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.hashes, x[at]), len(self.hashes) - 1)
        return at[self.hashes[near] == x[at]]


NOTHING_HOT = HotGrams(np.zeros(0, np.uint64))


def gram_hashes(buffer: bytes, low: int, grams: int) -> np.ndarray:
    """63-bit hashes of the grams that start at `grams` places from `low` on; the last six bits are zero."""
    words = np.ndarray((grams + 8,), "<u8", buffer, low, (1,))
    with np.errstate(over="ignore"):
        x = words[:grams] * _MIX[0] + words[8:] * _MIX[1]
        x ^= x >> np.uint64(32)
        x *= _MIX[2]
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(1)) & ~np.uint64(63)


def anchors(raws: list[bytes], hot: HotGrams = NOTHING_HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of the texts' 50-byte strings: row of the text, hash, first and last place in it of the strings whose anchor
    it is. Hashes of hot grams are negative, which puts them behind all others."""
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    buffer, total = b"".join(raws), int(ends[-1]) if len(raws) else 0
    found = []
    for low in range(0, total - STRING + 1, WINDOW):
        n = min(WINDOW, total - STRING + 1 - low)
        key = gram_hashes(buffer, low, n + SPAN - 1)
        key[hot.among(key)] |= np.uint64(1 << 63)
        key |= np.arange(len(key), dtype=np.uint64) & np.uint64(63)  # the low bits carry the place
        width = 1
        while width * 2 <= SPAN:  # the smallest of each run of SPAN, by doubling
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[:n], key[SPAN - width : SPAN - width + n])
        # strings may not cross the end of a text
        step = np.zeros(n + 1, np.int32)
        a, b = np.searchsorted(ends, low), np.searchsorted(ends, low + n + STRING)
        own = ends[a : b + 1]
        np.add.at(step, np.clip(np.maximum(own - STRING + 1, own - sizes[a : b + 1]) - low, 0, n), 1)
        np.add.at(step, np.clip(own - low, 0, n), -1)
        inside = np.cumsum(step[:n]) == 0
        change = np.diff(key) != 0
        first = np.flatnonzero(inside & np.concatenate([[True], change | ~inside[:-1]]))
        last = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], [True]]))
        row = np.searchsorted(ends, first + low, "right")
        begin = ends[row] - sizes[row] - low
        found.append((row, (key[first] & ~np.uint64(63)).view(np.int64), first - begin, last - begin))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def suffix_array(text: np.ndarray, depth: int = STRING) -> np.ndarray:
    """All places of `text`, ordered by `depth` bytes from there at least, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.diff(text.astype(np.int16), append=-1)  # the suffix after the last is empty and smaller
    differs = np.flatnonzero(step)
    next_step = step[differs[np.searchsorted(differs, np.arange(n))]]
    small = np.flatnonzero(next_step > 0)  # smaller than their successors
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    keys = np.ndarray((n,), f"S{depth}", padded, 0, (1,))[small]
    small = small[np.argsort(keys, kind="stable")]
    ends = np.searchsorted(text[small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            front = front[front > 0] - 1
            front = front[text[front] == c]
        bucket.append(small[ends[c] : ends[c + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        waiting[c] = []
        before = done[done > 0] - 1
        first = text[before]
        larger = first > c
        before, first = before[larger], first[larger]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        if len(before):
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = STRING) -> np.ndarray:
    """How many bytes each suffix of `order` has in common with the one before it, counted up to `most`; 0 for the first."""
    words = np.ndarray((len(text) + most,), "<u8", text.tobytes() + bytes(most + 8), 0, (1,))
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for done in range(0, most, 8):
        differ = words[order[open_] + done] ^ words[order[open_ - 1] + done]
        low = differ & (~differ + np.uint64(1))
        out[open_] = done + np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        open_ = open_[differ == 0]
    return np.minimum(out, most)


class Segments:
    """Segments in rows: anchor k, bytes (zeros behind the length), length, document, its row id, first place in it, and all its
    other places there, as the bytes of whole numbers (None: it has none)."""

    def __init__(self, k, rows, length, doc, rid, at, more=None):
        more = np.full(len(k), None, object) if more is None else more
        self.columns = k, rows, length, doc, rid, at, more
        self.k, self.rows, self.length, self.doc, self.rid, self.at, self.more = self.columns

    def __len__(self) -> int:
        return len(self.k)

    def take(self, places: np.ndarray) -> Segments:
        return Segments(*(x[places] for x in self.columns))

    @staticmethod
    def joined(parts: list[Segments]) -> Segments:
        return parts[0] if len(parts) == 1 else Segments(*(np.concatenate(x) for x in zip(*(p.columns for p in parts), strict=True)))

    @staticmethod
    def cut(k, buffer: np.ndarray, begin: np.ndarray, length: np.ndarray, doc, rid, at, more=None) -> Segments:
        """From the places `begin` of a buffer that goes on for ROW bytes behind the last segment's start."""
        rows = np.lib.stride_tricks.as_strided(buffer, (max(len(buffer) - ROW + 1, 0), ROW), (1, 1))[begin]
        rows[np.arange(ROW) >= length[:, None]] = 0
        return Segments(k, rows, length, doc, rid, at, more)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """An order in which equal segments stand together, by document, and whether each equals the one before it."""
        words = self.rows.view(np.uint64)
        with np.errstate(over="ignore"):
            h = self.k.view(np.uint64) * _MIX[0] + self.length.astype(np.uint64)
            for c in range(words.shape[1]):
                h = (h ^ (h >> np.uint64(31))) * _MIX[1] + words[:, c]
            h = (h ^ (h >> np.uint64(32))) * _MIX[2]
        order = np.lexsort((self.rid, self.doc, h))
        same = np.zeros(len(order), bool)
        near = np.flatnonzero(np.diff(h[order]) == 0) + 1
        a, b = order[near], order[near - 1]
        same[near] = (words[a] == words[b]).all(1) & (self.length[a] == self.length[b]) & (self.k[a] == self.k[b])
        return order, same

    def collapsed(self) -> tuple[Segments, Segments]:
        """Those of the smallest document that has them, one row for each row id, by anchor; and the others, which repeat
        throughout."""
        order, same = self.order()
        if not len(order):
            return self, self
        first = np.flatnonzero(~same)
        least = np.repeat(self.doc[order[first]], np.diff(np.append(first, len(order))))
        repeats = self.doc[order] > least
        again = np.concatenate([[False], same[1:] & (np.diff(self.doc[order]) == 0) & (np.diff(self.rid[order]) == 0)]) & ~repeats
        heads = self.take(order[~repeats & ~again])
        number = np.cumsum(~repeats & ~again) - 1
        ends = np.flatnonzero(again & ~np.append(again[1:], False))
        for begin, end in zip(np.flatnonzero(again & ~np.concatenate([[False], again[:-1]])).tolist(), ends.tolist(), strict=True):
            rest = order[begin : end + 1]
            own = number[begin]
            heads.more[own] = (heads.more[own] or b"") + self.at[rest].astype(np.int64).tobytes() + b"".join(x for x in self.more[rest] if x)
        return heads.take(np.argsort(heads.k, kind="stable")), self.take(order[repeats])

    def spans(self, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, rid, low, high) of spans of the segments `of`, counted from their start, at all places of theirs."""
        found = [(self.doc[of], self.rid[of], self.at[of] + low, self.at[of] + high)]
        several = np.flatnonzero(self.more[of] != None)  # noqa: E711
        for k in several.tolist():
            at, own = np.frombuffer(self.more[of[k]], np.int64), of[k]
            found.append((np.full(len(at), self.doc[own]), np.full(len(at), self.rid[own]), at + low[k], at + high[k]))
        return _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))


def repeated(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Segments and places in them at which 50-byte strings start that also start in a segment of a smaller document."""
    rows = s.rows.copy()
    rows[np.arange(len(s)), s.length] = 0xFF  # no byte of UTF-8
    text = rows[np.arange(ROW) <= s.length[:, None]]
    starts = np.concatenate([[0], np.cumsum(s.length + 1)[:-1]])
    of = np.repeat(np.arange(len(s)), s.length + 1)
    order = suffix_array(text)
    order = order[np.arange(len(text))[order] - starts[of[order]] + STRING <= s.length[of[order]]]
    if not len(order):
        return (np.zeros(0, np.int64),) * 2
    owner = s.doc[of[order]]
    first = np.flatnonzero(common_prefixes(text, order) < STRING)
    # a class may span anchors' segments: any smaller owner of an equal string decides
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(order))))
    found = np.sort(order[least < owner])
    return of[found], found - starts[of[found]]


def _dealt(s: Segments, chunk: int) -> Iterator[tuple[Segments, np.ndarray]]:
    """The 50-byte strings of the segments, dealt out by a hash of them: parts of about `chunk` bytes with, for each string, the
    segment it comes from. Equal strings are in the same part."""
    passes = int(s.length.sum()) * STRING // chunk + 1
    for p in range(passes):
        took, at = [], []
        for j in range(SPAN):
            rows = np.flatnonzero(s.length >= STRING + j)
            words = np.ascontiguousarray(s.rows[rows, j : j + STRING])
            h = np.zeros(len(rows), np.uint64)
            with np.errstate(over="ignore"):
                for c in (*range(0, STRING - 8, 8), STRING - 8):
                    h = (h ^ (h >> np.uint64(29))) * _MIX[1] + words[:, c : c + 8].copy().view(np.uint64)[:, 0]
                h = (h ^ (h >> np.uint64(32))) * _MIX[2]
            own = rows[(h >> np.uint64(20)) % np.uint64(passes) == p]
            took.append(own)
            at.append(np.full(len(own), j))
        took, at = np.concatenate(took), np.concatenate(at)
        flat = np.concatenate([s.rows.reshape(-1), np.zeros(ROW, np.uint8)])
        yield Segments.cut(s.k[took], flat, took * ROW + at, np.full(len(took), STRING), s.doc[took], s.rid[took], at), took


def _merged(doc, rid, low, high) -> tuple[np.ndarray, ...]:
    """The runs that spans cover, where spans of one row that begin later don't end earlier."""
    order = np.lexsort((low, rid, doc))
    doc, rid, low, high = doc[order], rid[order], low[order], high[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]) | (low[1:] > high[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return doc[first], rid[first], low[first], high[last]


def spans_of(s: Segments, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """(doc, rid, low, high) of what repeats in segments that are sorted by anchor and collapsed."""
    several = np.zeros(len(s), bool)  # an anchor with one segment, or one document, has nothing more to find
    if len(s) > 1:
        first = np.flatnonzero(np.concatenate([[True], np.diff(s.k) != 0]))
        least, most = np.minimum.reduceat(s.doc, first), np.maximum.reduceat(s.doc, first)
        several = np.repeat(least < most, np.diff(np.append(first, len(s))))
    s = s.take(np.flatnonzero(several))
    found = []
    if int(s.length.sum()) <= 4 * chunk:
        found.append(repeated(s) if len(s) else (np.zeros(0, np.int64),) * 2)
    else:
        for part, took in _dealt(s, chunk):
            if len(part):
                which, _ = repeated(part)
                found.append((took[which], part.at[which]))
    of, place = (np.concatenate(x) for x in zip(*found, strict=True))
    one = np.zeros(len(of), np.int64)
    of, _, place, end = _merged(of, one, place, place + STRING)
    return s.spans(of, place, end)


def _compared(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Rows of segments sorted by anchor (k, segment, doc_id, rid, low, high, more) -> spans (doc_id, rid, low, high). Rows
    without a segment are spans already."""

    def given(doc, rid, low, high) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, rid, low, high)], names=["doc_id", "rid", "low", "high"])

    def whole(s: Segments) -> pa.RecordBatch:
        return given(*s.spans(np.arange(len(s)), np.zeros(len(s), np.int64), s.length))

    held: list[Segments] = []
    size, limit = 0, chunk
    for batch in batches:
        ready = np.asarray(batch.column(1).is_null())
        if ready.any():
            yield given(*(batch.column(k).filter(pa.array(ready)).to_numpy() for k in range(2, 6)))
        if ready.all():
            continue
        got = batch.filter(pa.array(~ready))
        k, doc, rid, low = (got.column(c).to_numpy() for c in (0, 2, 3, 4))
        segments = got.column(1)
        offsets = np.frombuffer(segments.buffers()[1], np.int32, len(segments) + 1, segments.offset * 4).astype(np.int64)
        data = np.concatenate([np.frombuffer(segments.buffers()[2], np.uint8)[: offsets[-1]], np.zeros(ROW, np.uint8)])
        more = np.full(len(k), None, object)
        several = got.column(6).is_valid()
        more[np.asarray(several)] = got.column(6).filter(several).to_pylist()
        held.append(Segments.cut(k, data, offsets[:-1], np.diff(offsets), doc, rid, low, more))
        size += int(offsets[-1] - offsets[0])
        if size < limit:
            continue
        heads, others = Segments.joined(held).collapsed()
        if len(others):
            yield whole(others)
        last = int(np.searchsorted(heads.k, heads.k[-1]))  # more of the last anchor may follow
        if last:
            yield given(*spans_of(heads.take(np.arange(last)), chunk))
            heads = heads.take(np.arange(last, len(heads)))
        held, size = [heads], int(heads.length.sum())
        limit = max(chunk, 2 * size)
    if held:
        heads, others = Segments.joined(held).collapsed()
        yield whole(others)
        yield given(*spans_of(heads, chunk))
    release()


def _copies(rows: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, rid) of rows whose whole text is that of a row with a smaller id, and the number of rows."""
    prints = written(rows.select("doc_id", "rid", F.sha2("text", 256).alias("digest")), "suffix-digests")
    firsts = prints.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a text that very many rows have is split
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(SALTS)).cast("int"))
    copies = written(salted.join(firsts, ["digest", "salt"]).where("doc_id > first").select("doc_id", "rid"), "suffix-copies")
    n = prints.count()
    discard(prints)
    return copies, n


def hot_grams(rows: DataFrame, n: int) -> HotGrams:
    """Grams that at least HOT_SHARE of about SAMPLE texts hold; the texts are chosen by the ids' hash. At most as many as the
    sample's bytes / (SAMPLE * HOT_SHARE)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        texts = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                texts += 1
                if len(raw) >= STRING:
                    held.append(np.unique(gram_hashes(raw, 0, len(raw) - GRAM + 1)))
        grams, times = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams[times >= max(8, HOT_SHARE * texts)].view(np.int64))], names=["gram"])

    some = rows.where(F.pmod(F.xxhash64("doc_id", "rid"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    return HotGrams(some.repartition(1).mapInArrow(count, "gram bigint").toPandas()["gram"].to_numpy(np.int64).view(np.uint64))


def _marks(h: np.ndarray) -> np.ndarray:
    """32 bits of anchors' hashes, by which a document finds its shared ones again: a wrong one costs a comparison only."""
    return (h >> 6).astype(np.int32)


def _shared(rows: DataFrame, hot: HotGrams) -> DataFrame:
    """(doc_id, rid, mark): the anchors that rows with different ids have. Each batch of documents sends an array of its anchors
    to each bucket of hashes; anchors on hot grams go along unseen, to a bucket of the batch's choice."""
    buckets = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        row, h, _, _ = anchors([t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()], hot)
        if not len(row):
            return None
        order = np.lexsort((row, h))
        row, h = row[order], h[order]
        once = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(row) != 0)])
        row, h = row[once], h[once]
        doc, rid = (batch.column(k).to_numpy()[row] for k in (0, 1))
        bucket = np.where(h < 0, buckets + doc[0] % buckets, (h >> 32) * buckets >> 31).astype(np.int32)
        cuts = np.append(np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1]), len(h))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *binaries([h, doc, rid], cuts)], names=["bucket", "h", "doc_id", "rid"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def done() -> pa.RecordBatch:
            h, doc, rid = (np.frombuffer(b"".join(x), "<i8") for x in zip(*held, strict=True))
            if current < buckets:
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
                many = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
                places = order[np.repeat(many, np.diff(np.append(first, len(order))))]
                h, doc, rid = h[places], doc[places], rid[places]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, rid, _marks(h))], names=["doc_id", "rid", "mark"])

        for batch in batches:
            for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (bucket != current or bucket >= buckets):
                    yield done()
                current = bucket
                held.append(parts)
        if held:
            yield done()
        release()

    marks = by_batch(rows.select("doc_id", "rid", "text"), find, "bucket int, h binary, doc_id binary, rid binary", rows=1000)
    dealt = marks.repartition("bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(compare, "doc_id bigint, rid bigint, mark int"), "shared-anchors")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_copies: int = 1_000_000) -> DataFrame:
    """(doc_id, text_bytes, spans): each document's bytes and the ascending runs of them that repeat.

    Copies of whole texts repeat throughout and give nothing to others that their first row doesn't, so they are set aside
    first (by a broadcast of their ids only if there are at most broadcast_copies)."""
    key = ["doc_id", "rid"]
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("rid", F.lit(0).cast("bigint"))
    else:  # rows of one id are told apart by a number
        rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "suffix-rows")
    copies, n = _copies(rows)
    single = rows.join(broadcast_if_small(copies, broadcast_copies), key, "left_anti")
    hot = hot_grams(single, n)
    shared = _shared(single, hot)
    places = shared.groupBy(*key).agg(F.collect_list("mark").alias("marks"))

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        batch = batch.take(np.argsort(batch.column(0).to_numpy(), kind="stable"))
        docs_, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        row, h, first, last = anchors(raws, hot)
        marks = batch.column(3)
        marked = np.repeat(np.arange(len(raws)), np.diff(marks.offsets.to_numpy())) << 32 | marks.flatten().to_numpy().view(np.uint32)
        keep = np.flatnonzero(np.isin(row << 32 | _marks(h).view(np.uint32), marked))
        row, h, first, length = row[keep], h[keep], first[keep], last[keep] - first[keep] + STRING
        begins = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
        buffer = np.frombuffer(b"".join([*raws, bytes(ROW)]), np.uint8)
        s, others = Segments.cut(h, buffer, begins[row] + first, length, docs_[row], rids[row], first).collapsed()
        doc, rid, low, high = others.spans(np.arange(len(others)), np.zeros(len(others), np.int64), others.length)
        cuts = np.concatenate([[0], np.cumsum(s.length)]).astype(np.int32)
        text = pa.py_buffer(s.rows[np.arange(ROW) < s.length[:, None]])
        segments = pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(cuts), text])
        with np.errstate(over="ignore"):
            spread = (doc.view(np.uint64) * _MIX[2]).view(np.int64)
        return {
            "k": pa.array(np.concatenate([s.k, spread])), "segment": pa.concat_arrays([segments, pa.nulls(len(doc), pa.binary())]), "doc_id": pa.array(np.concatenate([s.doc, doc])),
            "rid": pa.array(np.concatenate([s.rid, rid])), "low": pa.array(np.concatenate([s.at, low])),
            "high": pa.concat_arrays([pa.nulls(len(s), pa.int64()), pa.array(high)]), "more": pa.concat_arrays([pa.array(s.more.tolist(), pa.binary()), pa.nulls(len(doc), pa.binary())]),
        }

    texts = rows.select(*key, "text")
    segments = by_batch(texts.join(places, key).select(*key, "text", "marks"), cut, "k bigint, segment binary, doc_id bigint, rid bigint, low bigint, high bigint, more binary", rows=1000)
    found = segments.repartition("k").sortWithinPartitions("k").mapInArrow(_compared, "doc_id bigint, rid bigint, low bigint, high bigint")
    whole = copies.select(*key, F.lit(0).cast("bigint").alias("low"), F.lit(-1).cast("bigint").alias("high"))
    spans = written(found.unionAll(whole).groupBy(*key).agg(F.collect_list(F.struct("low", "high")).alias("spans")), "suffix-spans")
    discard(shared)

    def merge(batch: pa.RecordBatch) -> dict[str, list]:
        out, raws = [], [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        for raw, spans in zip(raws, batch.column(2).to_pylist(), strict=True):
            runs: list[dict] = []
            for s in sorted(spans or [], key=lambda s: s["low"]):
                if s["high"] < 0:  # a copy of a whole text
                    runs = [{"low": 0, "high": len(raw)}] if len(raw) >= STRING else []
                    break
                if runs and s["low"] <= runs[-1]["high"]:
                    runs[-1]["high"] = max(runs[-1]["high"], s["high"])
                else:
                    runs.append(s)
            out.append(runs)
        return {"doc_id": [None if d == LAST_ID else d for d in batch.column(0).to_pylist()], "text_bytes": raws, "spans": out}

    joined = texts.join(spans, key, "left").select("doc_id", "text", "spans")
    return by_batch(joined, merge, "doc_id bigint, text_bytes binary, spans array<struct<low:bigint,high:bigint>>", rows=500)


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of remove_repeats()'s rows."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out = []
        for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            sha, done = hashlib.sha256(), 0
            for s in spans:
                sha.update(raw[done : s["low"]])
                done = s["high"]
            sha.update(raw[done:])
            out.append((len(raw), sum(s["high"] - s["low"] for s in spans), len(spans), sha.hexdigest()))
        return {"doc_id": batch.column(0)} | {str(k): [x[k] for x in out] for k in range(4)}

    return by_batch(cleaned, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", rows=500)
