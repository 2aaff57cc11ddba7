"""Benchmark decontamination: n-grams of the test items are seeds that join training passages to items, and Smith-Waterman
alignment of words scores the candidates, so edited and paraphrased copies are found as well as exact ones.

Words are runs of \\w characters, lower-cased; in scripts that are written without spaces each character is a word. Seeds are the
3-grams of an item, or the whole item where it is shorter. Every seed counts, however many documents have it, so an item is
found wherever a passage of the score asked for has a seed in common with it. What keeps common seeds cheap is a bound that
loses nothing: an alignment of m matches and e errors has at most e + 1 runs of matches, so at least m - 2 (e + 1) of its
3-grams are seeds. Its score m - e is thus at most half of (words in common + seeds hit + 2), and only windows in which that
reaches the score are aligned.

Seeds and documents meet by 64-bit hashes of n-grams, and the alignment verifies words. If the items have at most BROADCAST
bytes, the seeds go to all executors and one pass over the texts finds them. Otherwise the hashes that pass a filter of fixed
size are joined with the table of seeds (spread over SALTS copies of it), the candidates with their texts, and the windows of
words with the items. Both ways find the same.

Defined cases: null and empty texts and items have no words, and items without words are in no document; an item of up to
FEWEST words is found only where all of them stand together, a longer one has FEWEST matches more than errors at least;
repeated items and documents give their rows each, equal ids or not; of equally good places the first is given; empty tables
give an empty result; columns of docs other than those named are ignored by find_leaks() and kept by drop_leaks(), whatever
their names. A task needs some 100 bytes for each word of its longest text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_batch, table_of, unused, with_fields, written

WORD = re.compile(r"\w+")
#: Scripts without spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = "฀-࿿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_ANY_UNSPACED, _EITHER = re.compile(f"[{_UNSPACED}]"), re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W{_UNSPACED}]+")
GRAM, SCORE, FEWEST, BROADCAST, SALTS, FILTER_BITS = 3, 0.5, 5, 32 << 20, 8, 24
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (WORD if text.isascii() or not _ANY_UNSPACED.search(text) else _EITHER).findall(text)


class Grams:
    """Hashes of the n-grams of word lists, with a bounded memo of words."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        found = list(map(self.memo.get, words))
        if None in found:
            if len(self.memo) > 500_000:
                self.memo.clear()
            for k, code in enumerate(found):
                if code is None:
                    found[k] = self.memo[words[k]] = xxhash.xxh64_intdigest(words[k].encode("utf-8", "surrogatepass"))
        return np.array(found, np.uint64)

    @staticmethod
    def of(codes: np.ndarray, width: int) -> np.ndarray:
        out = np.full(max(len(codes) - width + 1, 0), width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                out = ((out ^ (out >> np.uint64(29))) * _MIX[0] + codes[k : k + len(out)]) * _MIX[1]
            return (out ^ (out >> np.uint64(32))) * _MIX[2]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score (match 1, mismatch -1, gap -1) and its end in the window."""
    along = np.arange(len(window) + 1)
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(window == w, 1, -1), row[1:] - 1)
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + along) - along, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Item:
    """One test item: its words, and its alignment with windows of words."""

    def __init__(self, words: list[str]):
        self.words, self.counts = words, Counter(words)
        self.ids = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
        self.codes = np.array([self.ids[w] for w in words])

    def score(self, window: list[str], seeds: int, share: float) -> tuple[int, int, int] | None:
        """Score, first word and word after the last of the best place in a window that `seeds` seeds hit, if its score is that
        share of the item's words, and FEWEST at least or all of them."""
        need = max(share * len(self.words), min(len(self.words), FEWEST))
        common = (self.counts & Counter(window)).total()
        if common < need or (GRAM - 2) * common + seeds + GRAM - 1 < (GRAM - 1) * need:
            return None
        coded = np.array([self.ids.get(w, -1) for w in window])
        score, end = align(self.codes, coded)
        return (score, end - align(self.codes[::-1], coded[:end][::-1])[1], end) if score >= need else None


def seeds_of(words: list[str], grams: Grams) -> np.ndarray:
    """The hash of the seed at each place of an item."""
    return Grams.of(grams.codes(words), min(GRAM, len(words))) if words else np.zeros(0, np.uint64)


def windows(hits: list[tuple[int, int]], n: int, length: int) -> Iterator[tuple[int, int, int]]:
    """The parts of a text of `length` words in which an item of n words may lie: first word, word after the last, seeds hit.
    hits: (where the item would begin, place in the item) of each seed, sorted."""
    low = 0
    while low < len(hits):
        high = low
        while high + 1 < len(hits) and hits[high + 1][0] - hits[high][0] <= 2 * n:
            high += 1
        yield max(0, hits[low][0] - n // 2), min(length, hits[high][0] + n + n // 2), len({place for _, place in hits[low : high + 1]})
        low = high + 1


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[list[str]], score: float):
        self.items, self.share, self.grams = [Item(x) for x in items], score, Grams()
        self.widths = sorted({min(GRAM, len(x)) for x in items if x})
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, x in enumerate(items):
            for at, h in enumerate(seeds_of(x, self.grams).tolist()):
                where[h].append((k, at))
        self.where = dict(where)
        self.leading = leading_bits(np.fromiter(self.where, np.uint64, len(self.where)))

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, score as a share of the item's words, first word, word after the last) of each item found, best place."""
        words = words_of(text)
        codes, hits = self.grams.codes(words), defaultdict(list)
        for width in self.widths:
            seeds = Grams.of(codes, width)
            near = np.flatnonzero(self.leading[(seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            for at, h in zip(near.tolist(), seeds[near].tolist(), strict=True):
                for item, place in self.where.get(h, ()):
                    hits[item].append((at - place, place))
        out = []
        for item, starts in sorted(hits.items()):
            x = self.items[item]
            n, best = len(x.words), None
            for a, b, seeds in windows(sorted(starts), n, len(words)):
                got = x.score(words[a:b], seeds, self.share)
                if got and (best is None or got[0] > best[0]):
                    best = got[0], a + got[1], a + got[2]
            if best:
                out.append((item, best[0] / n, best[1], best[2]))
        return out


def leading_bits(hashes: np.ndarray) -> np.ndarray:
    """Which first bits of a hash any of `hashes` has: a filter of fixed size."""
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


def _small(items: DataFrame, id_col: str, text_col: str, score: float, limit: int):
    """A broadcast of the matcher and the items' ids, in a lasting order; None if the items have more than `limit` bytes."""
    sized = items.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if (sized.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > limit:
        return None
    rows = sized.orderBy("id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(([r.id for r in rows], [words_of(r.text) for r in rows], score))


def _matcher(shared) -> Matcher:
    """One matcher for each broadcast and Python worker, until the worker serves another operator."""
    own = table_of(__name__, "matchers", dict)
    if shared.value is not None and id(shared.value) not in own:
        own.clear()
        own[id(shared.value)] = Matcher(shared.value[1], shared.value[2])
    return own[id(shared.value)]


def _joined(docs: DataFrame, items: DataFrame, text_col: str, item_id_col: str, item_text_col: str, score: float) -> DataFrame:
    """(digest, item_id, score, first_word, end_word): find_leaks() for items of any number, by the MD5 digest of a text."""
    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id_col).alias("item_id"), F.coalesce(item_text_col, F.lit("")).alias("text")), "leak-items")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(F.unhex(F.md5("text")).alias("digest"), "text")

    def seeds(batch: pa.RecordBatch) -> dict[str, list]:
        grams, item, n, place, h = Grams(), [], [], [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            own = seeds_of(words, grams)
            h.append(own.view(np.int64))
            item += [k] * len(own)
            n += [len(words)] * len(own)
            place += range(len(own))
        return {"h": pa.array(np.concatenate(h)), "item": item, "n": n, "place": place}

    table = written(by_batch(numbered.select("item", "text"), seeds, "h bigint, item bigint, n int, place int"), "leak-seeds")
    bits = [r[0] for r in table.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("b")).distinct().collect()]  # 2 ** FILTER_BITS at most
    widths = [r[0] for r in table.select(F.least("n", F.lit(GRAM)).alias("w")).distinct().collect()]
    known = docs.sparkSession.sparkContext.broadcast(np.array(bits, np.uint32))

    def hits(batch: pa.RecordBatch) -> dict[str, list]:
        grams, leading = Grams(), np.zeros(1 << FILTER_BITS, bool)
        leading[known.value] = True
        h, row, at = [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            codes = grams.codes(words_of(text))
            for width in widths:
                own = Grams.of(codes, width)
                near = np.flatnonzero(leading[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                h.append(own[near].view(np.int64))
                row.append(np.full(len(near), k))
                at.append(near)
        empty = [np.zeros(0, np.int64)]
        return {"h": pa.array(np.concatenate(h + empty)), "digest": batch.column(0).take(pa.array(np.concatenate(row + empty))), "at": pa.array(np.concatenate(at + empty).astype(np.int32))}

    salt = F.pmod(F.xxhash64("digest", "at"), F.lit(SALTS)).cast("int")
    found = by_batch(texts, hits, "h bigint, digest binary, at int").withColumn("salt", salt)
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = found.join(spread, ["h", "salt"]).groupBy("digest", "item", "n").agg(F.collect_set(F.struct((F.col("at") - F.col("place")).alias("start"), "place")).alias("hits"))
    hit = written(hit, "leak-hits")
    unique = texts.join(broadcast_if_small(hit.select("digest").distinct(), 200_000), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        out: list[tuple] = []
        last = words = None
        for k, (digest, item, n, starts, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if digest != last:
                last, words = digest, words_of(text)
            out += [(k, item, a, seeds, words[a:b]) for a, b, seeds in windows(sorted((x["start"], x["place"]) for x in starts), n, len(words))]
        return {"digest": batch.column(0).take(pa.array([x[0] for x in out], pa.int64()))} | {str(k): [x[k] for x in out] for k in range(1, 5)}

    parts = by_batch(hit.join(unique, "digest").select("digest", "item", "n", "hits", "text"), cut, "digest binary, item bigint, first int, seeds int, window array<string>", rows=200)
    kind = items.schema[item_id_col].dataType.simpleString()

    def check(batch: pa.RecordBatch) -> dict[str, list]:
        out = []
        for k, (first, seeds, window, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)), strict=True)):
            x = Item(words_of(text))
            got = x.score(window, seeds, score)
            if got:
                out.append((k, got[0] / len(x.words), first + got[1], first + got[2]))
        at = pa.array([x[0] for x in out], pa.int64())
        return {str(c): batch.column(c).take(at) for c in range(3)} | {f"f{k}": [x[k] for x in out] for k in range(1, 4)}

    salted = parts.withColumn("salt", F.pmod(F.xxhash64("digest", "first"), F.lit(SALTS)).cast("int"))
    against = numbered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("text", "item_text")
    pairs = salted.join(against, ["item", "salt"]).select("digest", "item", "item_id", "first", "seeds", "window", "item_text")
    good = by_batch(pairs, check, f"digest binary, item bigint, item_id {kind}, score double, first_word bigint, end_word bigint", rows=200)
    best = F.max_by(F.struct("item_id", "score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return written(good.groupBy("digest", "item").agg(best).select("digest", "best.*"), "leaks")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", score: float = SCORE, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word), a row for each item found in a document."""
    shared = _small(items, item_id_col, item_text_col, score, broadcast_bytes)
    if shared is None:
        found = _joined(docs, items, text_col, item_id_col, item_text_col, score)
        ids = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("digest"))
        return ids.join(found, "digest").select("doc_id", "item_id", "score", "first_word", "end_word")

    def find(batch: pa.RecordBatch) -> dict[str, list]:
        search, ids = _matcher(shared), shared.value[0]
        found = [(k, *x) for k, t in enumerate(batch.column(1).to_pylist()) for x in search.find(t)]
        doc = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
        return {"doc_id": doc, "item_id": [ids[x[1]] for x in found], "score": [x[2] for x in found], "first_word": [x[3] for x in found], "end_word": [x[4] for x in found]}

    kind = items.schema[item_id_col].dataType.simpleString()
    return by_batch(docs.select(id_col, text_col), find, with_fields(docs.select(F.col(id_col).alias("doc_id")), f"item_id {kind}, score double, first_word bigint, end_word bigint"))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", score: float = SCORE, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """The documents in which no item is found, with their columns."""
    shared = _small(items, item_id_col, item_text_col, score, broadcast_bytes)
    if shared is None:
        digest = f"{unused(docs)}digest"
        leaked = _joined(docs, items, text_col, item_id_col, item_text_col, score).select(F.col("digest").alias(digest)).distinct()
        mine = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
        return docs.join(leaked, mine == F.col(digest), "left_anti")
    at = docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        search = _matcher(shared)
        return batch.filter(pa.array([not search.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return by_batch(docs, keep, docs.schema)
