"""What the corpus operators share: table reading, Arrow batches, a bounded memo."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import discard, shared_folder, shuffles_freed, written  # noqa: F401


BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, limit: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, counted now, and its strings at most limit_bytes; otherwise df, for
    a shuffled join."""
    texts = [F.octet_length(f"`{f.name}`") for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    size = F.coalesce(F.sum(sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0)).cast("long")), F.lit(0))
    rows, held = df.limit(limit + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= limit and held <= limit_bytes else df


def unused(df: DataFrame) -> str:
    """A prefix that no column of df begins with, for working columns."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """df's schema with more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers outlive their tasks, and stages add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


_tables: dict[str, dict] = {}


def table_of(module: str, key, make: Callable):
    """What a module's batches need again and again in one worker, made once."""
    own = _tables.setdefault(module, {})
    if key not in own:
        own[key] = make()
    return own[key]


def drop_others(module: str) -> None:
    """Frees the tables of other modules, as a worker may serve one operator after another."""
    for name in [n for n in _tables if n != module]:
        del _tables[name]


def slices(batch: pa.RecordBatch, rows: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most `rows` rows, whose texts have at most `size` bytes in all unless one row has more."""
    if size is None or batch.nbytes <= size:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        return
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    upto = np.cumsum(sum((pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64)))
    at = done = 0
    while at < batch.num_rows:
        end = min(max(int(np.searchsorted(upto, done + size, side="right")), at + 1), at + rows)
        yield batch.slice(at, end - at)
        at, done = end, upto[end - 1]


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch | None], schema, rows: int = 10_000, size: int | None = None) -> DataFrame:
    """mapInArrow of fn over the slices() of batches; fn returns columns in the order of schema. Sets the session's limit
    of a batch's bytes to BATCH_BYTES unless the user has set one: a worker holds a batch and what fn makes of it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) == "67108864b":
        conf.set(BATCH_CONF, BATCH_BYTES)

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(module)
        for whole in batches:
            for part in slices(whole, rows, size):
                got = fn(part)
                if isinstance(got, dict):
                    got = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(got.values(), arrow, strict=True)], schema=arrow)
                if got is not None and got.num_rows:
                    yield got
                del got, part
            del whole
            release()

    return df.mapInArrow(run, kind)


def binaries(columns: list[np.ndarray], cuts: np.ndarray) -> list[pa.Array]:
    """Arrays cut at the same places, as binary columns."""
    return [pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in columns]


#: Letters of several kinds, digits, punctuation, marks and symbols: what patterns of tokenizers tell apart.
_KINDS = "aZé中1½.'s-$\u0301😀"
#: Marks that often stand behind a word.
_TAIL = ".,;:!?"
#: A single space, or the place before a single line end, between two characters that no definition of white space contains.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")


def cuts_at_blanks(split: Callable[[str], tuple]) -> bool:
    """Whether split(text), the parts of a text in order, comes to the same for what stands before a space or line end between
    two other characters and for the rest, each alone; likewise for a word and the marks behind it. Tried on all neighbours of
    one and two characters of each kind."""
    ends = [*_KINDS, *(a + b for a in _KINDS for b in _KINDS)]
    alone = {x: split(x) for x in ends}
    after = {blank + x: split(blank + x) for blank in " \n" for x in ends}
    words = [x for x in ends if x.isalpha()]
    tails = {x: split(x) for x in (*_TAIL, *(a + b for a in _TAIL for b in _TAIL))}
    return all(split(a + b) == alone[a] + after[b] for a in ends for b in after) and all(split(a + b) == alone[a] + tails[b] for a in words for b in tails)


def _whole(chunk: str) -> bool:
    """Whether a chunk is text without white space at its edges, but for one line end before it."""
    inner = chunk[chunk[:1] == "\n" :]
    return bool(inner) and not (inner[0].isspace() or inner[-1].isspace())


class ChunkMemo:
    """Encodes texts through encode(list of pieces) -> list of bytes, where a text's pieces are cut before each single space,
    and each single line end, that stands between two non-space characters, and between a word and the marks behind it. Only for
    patterns that cuts_at_blanks() accepts: they never match across such a place, so the pieces' codes, joined, are the text's.

    Codes of short pieces are kept as Arrow arrays, `limit` of them at most, in which a batch's pieces are looked up at once. A
    full memo takes no more, as the first pieces met are mostly the common ones, and is emptied when it has missed many pieces
    since. Neither changes a result."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 600_000, longest: int = 48):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.tails: dict[str, bytes] = {}
        self._empty()

    def _empty(self) -> None:
        self.known, self.codes, self.missed = pa.array([], pa.string()), pa.array([], pa.binary()), 0

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].as_py()

    def batch(self, texts: pa.Array) -> pa.BinaryArray:
        """The codes of texts without nulls."""
        if not len(texts):
            return pa.array([], pa.binary())
        # a chunk stands for itself if it begins with a line end or its text, otherwise for a space and itself
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends, words = chunks.offsets.to_numpy(), chunks.flatten()
        starts = ends[:-1]
        found = pc.index_in(words, value_set=self.known)
        lost = np.asarray(found.is_null())
        which = found.fill_null(0).to_numpy(zero_copy_only=False).copy()
        new = words.filter(pa.array(lost)).dictionary_encode()
        names, base = new.dictionary.to_pylist(), self.codes
        codes, odd = self._learn(names)
        which[lost] = new.indices.to_numpy() + len(base)
        uneven_chunk = np.zeros(len(words), np.int64)
        uneven_chunk[lost] = odd[new.indices.to_numpy()]
        firsts = words.take(pa.array(starts)).to_pylist()
        uneven_chunk[starts] = [bool(x) and not _whole(x) for x in firsts]
        uneven = np.add.reduceat(uneven_chunk, starts) > 0
        number = {x: len(base) + len(codes) + k for k, x in enumerate(dict.fromkeys(x for x in firsts if x))}
        codes += [*self.encode(list(number)), b""]
        nothing = len(base) + len(codes) - 1
        which[starts] = [number.get(x, nothing) for x in firsts]
        which[np.repeat(uneven, np.diff(ends))] = nothing
        out = pa.concat_arrays([base, pa.array(codes, pa.binary())]).take(pa.array(which))
        offsets = np.frombuffer(out.buffers()[1], np.int32, len(out) + 1, out.offset * 4)[ends]
        done = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), out.buffers()[2] or pa.py_buffer(b"")])
        if not uneven.any():
            return done
        rest = iter(self._uneven(texts.filter(pa.array(uneven)).to_pylist()))
        return pa.array([next(rest) if u else x for u, x in zip(uneven, done.to_pylist(), strict=True)], pa.binary())

    def _lookup(self, names: list[str]) -> list[bytes | None]:
        at = pc.index_in(pa.array(names, pa.string()), value_set=self.known)
        return self.codes.take(at).to_pylist()

    def _learn(self, names: list[str], all_whole: bool = False) -> tuple[list[bytes], np.ndarray]:
        """The codes of different chunks that are not known, and whether each is odd, with white space at its edges; the codes of
        those are left empty unless all_whole says that they are pieces too."""
        odd = np.array([not _whole(x) for x in names], bool)
        # a word with marks behind it goes as two pieces, of which the first may be known
        parts = [(c, "") if (word := c.rstrip(_TAIL)) == c or not word[word[:1] == "\n" :].isalpha() else (word, c[len(word) :]) for c in names]
        own = {w: code for w, code in zip(words, self._lookup(words), strict=True) if code is not None} if (words := list(dict.fromkeys(w for w, t in parts if t))) else {}
        fresh = list(dict.fromkeys(w for (w, _), o in zip(parts, odd, strict=True) if w not in own and (all_whole or not o)))
        tails = list(dict.fromkeys(t for _, t in parts if t and t not in self.tails))
        got = self.encode([*(w if w[0] == "\n" else f" {w}" for w in fresh), *tails])
        own |= zip(fresh, got, strict=False)
        if len(self.tails) > 10_000:
            self.tails = {t: self.tails[t] for _, t in parts if t in self.tails}
        self.tails |= zip(tails, got[len(fresh) :], strict=True)
        out = [own[w] + self.tails[t] if t else own.get(w, b"") for w, t in parts]
        if len(self.known) > self.limit:
            self.missed += len(names)
            if self.missed > 10 * self.limit:
                self._empty()
        else:
            kept = [k for k, (c, o) in enumerate(zip(names, odd, strict=True)) if not o and len(c) <= self.longest]
            self.known = pa.concat_arrays([self.known, pa.array([names[k] for k in kept], pa.string())])
            self.codes = pa.concat_arrays([self.codes, pa.array([out[k] for k in kept], pa.binary())])
        return out, odd

    def _uneven(self, texts: list[str]) -> list[bytes]:
        """The codes of texts with other white space than single blanks."""
        cut = [_BETWEEN.split(t) for t in texts]
        rest = list(dict.fromkeys(c for _, *own in cut for c in own))
        firsts = list(dict.fromkeys(first for first, *_ in cut if first))
        code_of = dict(zip(rest, self._lookup(rest), strict=True))
        lost = [c for c in rest if code_of[c] is None]
        code_of |= zip(lost, self._learn(lost, True)[0], strict=True)
        first_code = {"": b""} | dict(zip(firsts, self.encode(firsts), strict=True))
        return [first_code[first] + b"".join(map(code_of.__getitem__, own)) for first, *own in cut]
