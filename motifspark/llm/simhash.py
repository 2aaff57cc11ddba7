"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two; its embedding is the vector of the segments' bit counts (0 to 2). The Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints. Counts are kept in unary (00, 01, 11), so a
whole embedding is one long and Manhattan distances are bit counts of differences.

Range join: the 32 dimensions are cut into 6 blocks. Of two embeddings within distance 3, at least 3 blocks are equal, so they
share a grid cell in at least one of the 20 grids that 3 blocks span. Cells are joined by equality, the whole Manhattan
distance is the lower bound that filters the cell's pairs, and the fingerprints then verify them; only verified links leave
the join. Distinct fingerprints are joined, so groups of copies count once.

Components of the links are found by alternating large-star and small-star steps, each written to the shared folder.

Defined cases: a null text is an empty one; texts without words have fingerprint zero; repeated rows and ids keep their rows;
rows with a null id are linked like others but never name a component, unless nothing else does (then null); a bit set in
exactly half the shingles is 0; an empty table gives an empty result; columns of docs other than those named are ignored by
near_duplicates() and kept by keep_first(), whatever their names. A task needs some 100 bytes for each word of its longest text.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, discard, unused, with_fields, written
from .similar import classes

#: Blocks of the embedding in segments of two bits: together 32.
BLOCKS, NEAR = (5, 5, 5, 5, 6, 6), 3
EVEN = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(w), seed) for w in zip(*(words[k:] for k in range(width)), strict=False)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprints as signed longs."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column(0), "fp": [_signed(fingerprint(t, width)) for t in batch.column(1).to_pylist()]}

    return by_batch(docs.select(id_col, text_col), run, with_fields(docs.select(F.col(id_col).alias("doc_id")), "fp bigint"))


def embedding(fp: Column) -> Column:
    """The unary segment counts: in each pair of bits the lower one if any bit is set, the upper one if both are."""
    high = F.call_function("shiftrightunsigned", fp, F.lit(1))
    even = F.lit(EVEN)
    return fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(F.call_function("shiftleft", fp.bitwiseAND(high).bitwiseAND(even), F.lit(1)))


def grids() -> list[int]:
    """The masks of the grids: all ways to take as many blocks as must be equal within distance NEAR."""
    masks, at = [], 0
    for n in BLOCKS:
        masks.append(((1 << 2 * n) - 1) << 2 * at)
        at += n
    return [_signed(sum(m)) for m in combinations(masks, len(BLOCKS) - NEAR)]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of different fingerprints at Hamming distance NEAR or less, once or more often each."""
    cells = distinct.select("fp", embedding(F.col("fp")).alias("e")).select("fp", "e", F.posexplode(F.array(*(F.lit(m).bitwiseAND(F.col("e")) for m in grids()))).alias("grid", "cell"))
    left, right = cells.select(F.col("fp").alias("a"), F.col("e").alias("ea"), "grid", "cell"), cells.select(F.col("fp").alias("b"), F.col("e").alias("eb"), "grid", "cell")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("ea").bitwiseXOR(F.col("eb"))) <= NEAR) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR)
    same = (left["grid"] == right["grid"]) & (left["cell"] == right["cell"])
    return left.join(right, same & near).select("a", "b")


def components(edges: DataFrame, persist: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(node, root): the smallest node that each node of an edge is connected to, itself included. edges: (a, b)."""
    now = persist(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "components")
    while True:
        # large star: all larger neighbours of a node move to its smallest neighbour
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v")).union(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        new = persist(small, "components")
        sign = [d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first() for d in (now, new)]
        if hasattr(now, "_written_at"):
            discard(now)
        now = new
        if sign[0] == sign[1]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included)."""
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-firsts")
    roots = components(links(firsts.select("fp")))
    linked = firsts.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    named = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = linked.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, with the columns of docs. Near-duplicates are
    connected by pairs of Jaccard similarity 0.8 or more over `width`-word shingles. The range join of the fingerprints of the
    shingles finds pairs first, each then checked exactly; as many such pairs differ by more bits than it reaches, classes()
    finds those that it leaves unconnected, so none is lost. Rows are told apart by id and text; of rows that are equal in both, one stays. Documents without id come after all others."""
    p = unused(docs)
    name, text = f"{p}key", f"{p}text"
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("n"), F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"))
    of, found = classes(docs.select(key.alias(name), F.col(f"`{text_col}`").alias(text)), components, name, text, width, (majority, links))
    kept = found.select(F.col("component_id").alias(name)).distinct()
    out = docs.withColumn(name, key).join(kept, name, "left_semi")
    if not of.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that are equal in id and text
        out = out.dropDuplicates([name])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
