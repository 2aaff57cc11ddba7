"""Token-id output as binary shards with a minimal perfect hash index.

Format of a shard, the row of a Parquet table (Spark's writers and readers are the only way to storage that every cluster has):
  part, shard    place of the shard: shards in this order hold the documents in ascending order of their keys
  first, last    smallest and largest document id in it
  start          ids in all shards before
  n_docs, n_ids  documents and ids in it
  keys           the documents' ids, ascending, as little-endian signed 64-bit integers
  payload        the raw ids, little-endian unsigned 16- or 32-bit, documents one after another
  seeds          the hash index: a 32-bit number for each bucket of keys: with its highest bit set, the place of the bucket's
                 only key; otherwise the displacement of the bucket's keys
  slots          for each place of the index: 32-bit fingerprint of its key, 64-bit offset and 32-bit count of its ids

A key is (document id, number of the repetition of that id within the shard). Its hash gives a bucket, the bucket's number
gives its place, the stored fingerprint tells whether the key is in the shard, and the place gives where its ids are: constant
time.

Documents are encoded where they are read; only their ids are dealt out, by ranges of (id, hash of the text, hash of the row's
number) that a bounded sample sets, so a null or repeated id, however frequent, spreads over many ranges and shards.

Defined cases: a null text is an empty one (the end id alone); documents with a null id come first, under the key of the
smallest integer; documents of one id are in order of their texts' hashes, equal rows in any order; an empty table gives an
empty store; columns of docs other than the two named are ignored. A task holds one shard of ids and one batch of texts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ChunkMemo, broadcast_if_small, by_batch, cuts_at_blanks, release, shared_folder, shuffles_freed, table_of

NO_ID = -(1 << 63)
SHARD_SCHEMA = "part int, shard int, first bigint, last bigint, n_docs int, n_ids bigint, keys binary, payload binary, seeds binary, slots binary"
SLOT = np.dtype([("print", "<u4"), ("offset", "<u8"), ("count", "<u4")])
PER_BUCKET, ALONE, TOGETHER, AT_ONCE = 3, 1 << 31, 12, 200
#: Rows sampled for each range that the documents are dealt out by, and for all together.
SAMPLED, SAMPLED_ALL = 100, 1_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all bits of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits that place each key and 32 that tell it from others."""
    with np.errstate(over="ignore"):
        h = mixed(keys.astype(np.int64).view(np.uint64) + mixed(repeats.astype(np.uint64) + _MIX[0]))
        return h, (mixed(h + _MIX[0]) >> np.uint64(32)).astype(np.uint32)


def place(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    """Where displacements send keys, of n places."""
    with np.errstate(over="ignore"):
        x = mixed(h ^ (seed.astype(np.uint64) + np.uint64(1)) * _MIX[0])
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> np.ndarray:
    """The number of each bucket, so that all keys take different places of len(h)."""
    n = len(h)
    buckets = -(-n // PER_BUCKET)
    bucket = bucket_of(h, buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    begin = np.cumsum(sizes) - sizes
    seeds, taken = np.zeros(buckets, np.uint32), np.zeros(n, bool)
    for size in range(sizes.max(initial=0), 1, -1):
        left = np.flatnonzero(sizes == size)
        keys = h[order[begin[left][:, None] + np.arange(size)]]
        for seed in range(TOGETHER):  # all buckets of this size try a displacement at once; of those in each other's way the first stays
            spots = place(keys, np.full(1, seed), n)
            good = ~taken[spots].any(1)
            across = np.sort(spots, axis=1)
            good &= (np.diff(across, axis=1) > 0).all(1)
            tried = np.flatnonzero(good)
            flat = spots[tried].ravel()
            _, first, again = np.unique(flat, return_index=True, return_inverse=True)
            wins = tried[(first[again] == np.arange(len(flat))).reshape(-1, size).all(1)]
            taken[spots[wins]] = True
            seeds[left[wins]] = seed
            rest = np.ones(len(left), bool)
            rest[wins] = False
            left, keys = left[rest], keys[rest]
            if not len(left):
                break
        for b, own in zip(left.tolist(), keys, strict=True):  # the others each try many displacements at once
            seed = TOGETHER
            while True:
                spots = place(own, np.arange(seed, seed + AT_ONCE)[:, None], n)
                good = np.flatnonzero(~taken[spots].any(1) & (np.diff(np.sort(spots, axis=1), axis=1) > 0).all(1))
                if len(good):
                    break
                seed += AT_ONCE
            taken[spots[good[0]]] = True
            seeds[b] = seed + good[0]
    alone = np.flatnonzero(sizes == 1)
    seeds[alone] = np.flatnonzero(~taken) + ALONE
    return seeds


def repeats_of(keys: np.ndarray) -> np.ndarray:
    """The number of each key's repetition, of sorted keys."""
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(keys) != 0])[: len(keys)], at, 0))


class Shard(NamedTuple):
    seeds: np.ndarray
    slots: np.ndarray
    payload: np.ndarray

    @classmethod
    def of(cls, seeds: bytes, slots: bytes, payload: bytes, n_ids: int) -> Shard:
        return cls(np.frombuffer(seeds, "<u4"), np.frombuffer(slots, SLOT), np.frombuffer(payload, f"<u{len(payload) // max(n_ids, 1) or 2}"))

    def find(self, keys: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether it is in the shard (for one of 2^32 keys that aren't, this is wrong), offset and count of its ids."""
        if not len(self.slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        h, mark = key_hash(keys, repeats)
        seed = self.seeds[bucket_of(h, len(self.seeds))]
        spot = np.where(seed >= ALONE, np.minimum(seed.astype(np.int64) - ALONE, len(self.slots) - 1), place(h, seed, len(self.slots)))
        slot = self.slots[spot]
        return slot["print"] == mark, slot["offset"].astype(np.int64), slot["count"].astype(np.int64)


def pack(part: int, shard: int, keys: np.ndarray, counts: np.ndarray, payload: bytes) -> dict:
    """A shard's row. keys: ascending; counts: the number of ids of each; payload: all ids."""
    h, mark = key_hash(keys, repeats_of(keys))
    seeds = perfect_hash(h)
    slots = np.zeros(len(keys), SLOT)
    seed = seeds[bucket_of(h, len(seeds))]
    spot = np.where(seed >= ALONE, seed.astype(np.int64) - ALONE, place(h, seed, len(keys)))
    slots["print"][spot], slots["offset"][spot], slots["count"][spot] = mark, np.cumsum(counts) - counts, counts
    return {
        "part": part, "shard": shard, "first": int(keys[0]), "last": int(keys[-1]), "n_docs": len(keys), "n_ids": int(counts.sum()), "keys": keys.astype("<i8").tobytes(),
        "payload": payload, "seeds": seeds.astype("<u4").tobytes(), "slots": slots.tobytes(),
    }


def id_width(tokenizer) -> int:
    """Bytes of an id, of a tokenizer or its file."""
    from tokenizers import Tokenizer

    return 2 if (Tokenizer.from_file(tokenizer) if isinstance(tokenizer, str) else tokenizer).get_vocab_size() <= 1 << 16 else 4


class LibraryCoder:
    """Encodes pieces of texts with the tokenizers library. Pieces without line ends go through it in one string, with line
    ends between them: the split pattern makes a line end before a space or a word a token of its own."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = id_width(self.library)
        line_end = self.library.encode("\n", add_special_tokens=False).ids
        probe = self.library.encode(" a\n b\nc", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 and probe.count(line_end[0]) == 2 else None
        self.line_end_code = np.array(line_end, f"<u{self.width}").tobytes()
        self.memo = ChunkMemo(self.pieces) if self.line_end is not None and cuts_at_blanks(lambda t: tuple(self.library.encode(t, add_special_tokens=False).ids)) else None

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, f"<u{self.width}") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        lines = [p[p[:1] == "\n" :] for p in pieces]
        plain = [k for k, x in enumerate(lines) if x and "\n" not in x and not x[-1].isspace() and not x.removeprefix(" ")[0].isspace()]
        out: list[bytes | None] = [None] * len(pieces)
        if plain:
            ids = self.ids(["\n".join([lines[k] for k in plain])])[0]
            cuts = np.flatnonzero(ids == self.line_end).tolist()
            if len(cuts) == len(plain) - 1:
                raw, at, width = ids.tobytes(), 0, self.width
                for k, end in zip(plain, [*cuts, len(ids)], strict=True):
                    code = raw[at * width : end * width]
                    out[k] = self.line_end_code + code if pieces[k][0] == "\n" else code
                    at = end + 1
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.ids([pieces[k] for k in rest]), strict=True):
            out[k] = x.tobytes()
        return out

    def batch(self, texts: pa.Array) -> pa.Array:
        """The ids of texts without nulls, `width` bytes each."""
        return self.memo.batch(texts) if self.memo else pa.array([x.tobytes() for x in self.ids(texts.to_pylist())], pa.binary())


def _coder(path: str) -> LibraryCoder:
    return table_of(__name__, path, lambda: LibraryCoder(path))


class TokenStore:
    """A written table of shards at `path`."""

    def __init__(self, spark: SparkSession, path: str, id_name: str):
        self.spark, self.path, self.id_name = spark, path, id_name

    def shards(self) -> DataFrame:
        """The shards with start. Totals of the write's partitions are few: at most its number of tasks."""
        rows = self.spark.read.schema(SHARD_SCHEMA).parquet(self.path)
        sums = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
        before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        inside = rows.select("part", "shard", "n_ids").withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).drop("n_ids")
        starts = inside.join(before, "part").select("part", "shard", (F.col("inside") + F.col("before")).alias("start"))
        # shards are joined with their starts where they are; only with very many of them are their payloads shuffled
        return rows.join(broadcast_if_small(starts, 1_000_000), ["part", "shard"])

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, each looked up by its key."""
        name = self.id_name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    shard, keys = Shard.of(r["seeds"], r["slots"], r["payload"], r["n_ids"]), np.frombuffer(r["keys"], "<i8")
                    known, at, n = shard.find(keys, repeats_of(keys))
                    if not known.all():
                        raise ValueError("the index lacks a key of its shard")
                    raw = memoryview(shard.payload.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + n)).tolist(), strict=True)]
                    ids = pa.array(keys, mask=keys == NO_ID)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at + r["start"]), pa.array(n), pa.array(crc, pa.int64())], names=[name, "start", "n_tokens", "ids_crc32"])

        return self.shards().select("keys", "payload", "seeds", "slots", "n_ids", "start").mapInArrow(run, f"{name} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

    def lookup(self, keys: list[int]) -> DataFrame:
        """(doc_id, ids) of a short list of keys, the first of each id in every shard that has it: only shards whose range holds one
        are read."""
        name = self.id_name
        held = " OR ".join(f"({int(k)} BETWEEN first AND last)" for k in keys) or "false"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    shard, own = Shard.of(r["seeds"], r["slots"], r["payload"], r["n_ids"]), np.array([k for k in keys if r["first"] <= k <= r["last"]], np.int64)
                    known, at, n = shard.find(own, np.zeros(len(own)))
                    found = [(k, shard.payload[a : a + c].tolist()) for k, yes, a, c in zip(own.tolist(), known, at, n, strict=True) if yes]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=[name, "ids"])

        return self.spark.read.schema(SHARD_SCHEMA).parquet(self.path).where(held).select("first", "last", "payload", "seeds", "slots", "n_ids").mapInArrow(run, f"{name} bigint, ids array<bigint>")


def range_bounds(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Keys (key, text_hash, row_hash) that cut the rows into about equal ranges, from a sample of bounded size."""
    n = rows.count()
    share = min(1.0, min(SAMPLED * parts, SAMPLED_ALL) / max(n, 1))
    some = sorted(map(tuple, rows.where(F.pmod("row_hash", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key", "text_hash", "row_hash").collect()))
    return [some[len(some) * k // parts] for k in range(1, parts)] if some else []


def range_of(columns: list[np.ndarray], bounds: list[tuple[int, int, int]]) -> np.ndarray:
    """The range of each row."""
    keys = np.array([b[0] for b in bounds], np.int64)
    low, high = np.searchsorted(keys, columns[0], "left"), np.searchsorted(keys, columns[0], "right")
    for k in np.flatnonzero(low < high).tolist():
        high[k] = bisect_right(bounds, tuple(int(c[k]) for c in columns))
    return high.astype(np.int32)


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20, parts: int | None = None) -> TokenStore:
    """Encodes texts with the tokenizer file, appends end_id, and writes shards of about shard_ids ids in ascending id order,
    from `parts` ranges of the documents (if None, as many as Spark's shuffle partitions)."""
    spark = docs.sparkSession
    if path is None:
        import uuid

        path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("text_hash"), F.xxhash64(F.monotonically_increasing_id()).alias("row_hash"), text.alias("text"))
    bounds = range_bounds(rows, parts)

    def encode(batch: pa.RecordBatch) -> dict[str, list]:
        order = [batch.column(k).to_numpy() for k in range(3)]
        return {"part": range_of(order, bounds)} | {str(k): batch.column(k) for k in range(3)} | {"ids": _coder(tokenizer).batch(batch.column(3))}

    width = id_width(tokenizer)
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, size = 0, 0, [], 0

        def full() -> pa.RecordBatch:
            keys, codes = np.concatenate([k for k, _ in held]), [c for _, own in held for c in own]
            counts = np.array([len(c) // width + 1 for c in codes])
            return pa.RecordBatch.from_pylist([pack(part, shard, keys, counts, end.join([*codes, b""]))], schema=arrow)

        for batch in batches:
            part = batch.column(0)[0].as_py()
            lengths = np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32, batch.num_rows + 1, batch.column(2).offset * 4)) // width + 1
            done, upto = 0, np.cumsum(lengths)
            while done < batch.num_rows:
                before = int(upto[done - 1]) if done else 0
                to = min(int(np.searchsorted(upto, before + shard_ids - size)) + 1, batch.num_rows)
                held.append((batch.column(1)[done:to].to_numpy(), batch.column(2)[done:to].to_pylist()))
                size, done = size + int(upto[to - 1]) - before, to
                if size >= shard_ids:
                    yield full()
                    shard, held, size = shard + 1, [], 0
        if held:
            yield full()
        release()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SHARD_SCHEMA))
    coded = by_batch(rows, encode, "part int, key bigint, text_hash bigint, row_hash bigint, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("key", "text_hash", "row_hash").select("part", "key", "ids")
    with shuffles_freed(spark):
        dealt.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)
    return TokenStore(spark, path, "doc_id")
