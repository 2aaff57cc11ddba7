"""Texts whose sets of word n-grams have a Jaccard similarity of 4/5 or more: an exact set-similarity join by prefix filters.

A set's n-grams are put into one order for the whole corpus. Two sets of at least that similarity share an n-gram among the
first n - ceil(4n/5) + 1 of each (n: the set's size), so texts are joined by the n-grams of these prefixes, filtered by size
and by the place of the shared n-gram, and the whole sets then verify each pair. No similar pair is lost, whatever the order;
an order with the n-grams of many texts last keeps the join small. Equal sets are one node.

Only what connects nodes matters. Where the caller has fingerprints and a join of those that are near (simhash.links), its
pairs are compared first. In a few turns, each node is first compared with a few nodes of other components that share
an n-gram with it; all pairs of nodes that this has not connected yet are made and compared then, so a group of near copies
costs about as much as its texts are long, and no similar pair is lost. Before sets are moved to be compared, the Manhattan
distance of their counts in segments of the hashes rules out most pairs that aren't similar.

Defined cases: words are split at ASCII white space and lowered as bytes; a text of fewer words than an n-gram has itself as
the only one; texts without words are equal; an empty table gives an empty result. The task that gathers an n-gram's nodes holds
24 bytes for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binaries, broadcast_if_small, by_batch, discard, release, unused, with_fields, written

#: Similarity as a fraction, and how many n-grams the order knows as frequent (a bound on what the driver sees, not on results).
UP, DOWN, FREQUENT = 4, 5, 200_000
#: Turns of comparisons that connect most similar nodes, comparisons of a node in each, and parts that hot keys are split into.
TURNS, TRIES, SALTS, MANY = 4, 4, 8, 32
#: Segments of the n-grams' hashes, a power of two, doubled for sets of more than FILL n-grams a segment.
SEGMENTS, FILL = 64, 12
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_set(text: str | None, width: int, memo: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of a text's different n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    codes = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        code = memo.get(w)
        if code is None:
            code = memo[w] = xxhash.xxh64_intdigest(w, 42)
        codes[k] = code
    if not words:
        return codes
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * _MIX[0] + codes[k : k + len(out)] * _MIX[1 + k % 4]
    out ^= out >> np.uint64(32)
    return np.unique(out * _MIX[4])


def _memo_of(memo: dict[bytes, int]) -> dict[bytes, int]:
    if len(memo) > 200_000:
        memo.clear()
    return memo


def _node(grams: np.ndarray) -> int:
    """The name of a set: a hash as a signed long."""
    h = xxhash.xxh3_64_intdigest(grams.tobytes())
    return h - (1 << 64) if h >> 63 else h


def segment_counts(grams: np.ndarray) -> bytes:
    """How many of a set's n-grams lie in each segment of the hashes, a byte each (255 at most)."""
    n = SEGMENTS
    while n * FILL < len(grams):
        n *= 2
    return np.minimum(np.bincount((grams >> np.uint64(65 - n.bit_length())).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """The Manhattan distances of segment_counts(), over the segments of the one of each two that has fewer."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
    out = np.zeros(len(sizes), np.int64)
    for n, m in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == n) & (sizes[:, 1] == m))
        a, b = (np.frombuffer(b"".join(z[k] for k in at), np.uint8).reshape(len(at), min(n, m), -1).sum(2, dtype=np.int64) for z in (x, y))
        out[at] = np.abs(a - b).sum(1)
    return out


def frequent(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams that many sets hold, and their rank from the rarest on: at most FREQUENT."""
    memo: dict[bytes, int] = {}

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        held = [gram_set(t, width, _memo_of(memo)) for t in set(batch.column(0).to_pylist())]
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        often = n > 1
        return {"gram": pa.array(grams[often].view(np.int64)), "n": pa.array(n[often].astype(np.int64))}

    rows = by_batch(docs.select(text_col), count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 3")
    top = rows.orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas()
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(grams)
    return grams[by], (len(grams) - np.arange(len(grams)))[by]


def prefixes(docs: DataFrame, id_col: str, text_col: str, width: int, order: tuple[np.ndarray, np.ndarray], mark: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, node, n, prefix, counts, fp): each text's set by name, its size, its first n-grams in the order, 8 bytes each, its
    segment_counts() and its fingerprint by mark."""
    known, ranks = order
    memo: dict[bytes, int] = {}

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        nodes, sizes, firsts, counts, marks = [], [], [], [], []
        for t in batch.column(1).to_pylist():
            grams = gram_set(t, width, _memo_of(memo))
            n = len(grams)
            counts.append(segment_counts(grams))
            nodes.append(_node(grams))
            sizes.append(n)
            fp = mark(grams) if mark else 0
            marks.append(fp - (1 << 64) if fp >> 63 else fp)
            if n and len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                grams = grams[np.argsort(np.where(known[at] == grams, ranks[at], 0), kind="stable")]
            firsts.append(grams[: n - (UP * n + DOWN - 1) // DOWN + 1].tobytes())
        return {"doc_id": batch.column(0), "node": nodes, "n": sizes, "prefix": firsts, "counts": counts, "fp": marks}

    return by_batch(docs.select(id_col, text_col), run, with_fields(docs.select(F.col(id_col).alias("doc_id")), "node bigint, n bigint, prefix binary, counts binary, fp bigint"))


def shared_grams(first: DataFrame) -> DataFrame:
    """(star, gram, node, n, place, holders) of the prefix n-grams that several nodes hold, once each, with the number of these
    nodes, but for nodes that none of the others may be similar to by size and place; and rows with star, whose `gram` and `node` are the pairs of hub_pairs() in its first turn: each n-gram's nodes with
    the smallest of about their size. Each batch of nodes sends an array of its n-grams to each bucket of hashes."""
    buckets = 8 * int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        grams = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        lengths = np.array([len(g) for g in grams])
        if not lengths.sum():
            return None
        gram = np.concatenate(grams)
        place = np.arange(len(gram)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        bucket = ((gram.view(np.uint64) >> np.uint64(33)).astype(np.int64) * buckets >> 31).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1]), len(order))
        columns = [gram[order], np.repeat(batch.column(0).to_numpy(), lengths)[order], np.repeat(batch.column(1).to_numpy().astype(np.int32), lengths)[order], place[order].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts[:-1]]]), *binaries(columns, cuts)], names=["bucket", "gram", "node", "n", "place"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def made(star: bool, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), star)), *map(pa.array, columns)], names=["star", "gram", "node", "n", "place", "holders"])

        def done() -> Iterator[pa.RecordBatch]:
            gram, node, n, place = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), ("<i8", "<i8", "<i4", "<i4"), strict=True))
            held.clear()
            order = np.lexsort((node, gram))
            order = order[np.concatenate([[True], (np.diff(gram[order]) != 0) | (np.diff(node[order]) != 0)])]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(gram[order]) != 0]))
            times = np.diff(np.append(starts, len(order)))
            order = order[np.repeat(times > 1, times)]
            if not len(order):
                return
            gram, node, n, place = gram[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64)
            holders = np.repeat(times[times > 1], times[times > 1])
            # a node goes on if the next larger or smaller set of its n-gram may be similar: no other is nearer in size
            by = np.lexsort((n, gram))
            low, high = by[:-1], by[1:]
            near = (gram[low] == gram[high]) & (n[low] * DOWN >= n[high] * UP)
            near &= (holders[low] > 2) | (np.minimum(n[low] - place[low], n[high] - place[high]) * (UP + DOWN) >= (n[low] + n[high]) * UP)
            kept = np.zeros(len(gram), bool)
            kept[low[near]] = kept[high[near]] = True
            gram, node, n, place, holders = (x[kept] for x in (gram, node, n, place, holders))
            if not len(gram):
                return
            yield made(False, gram, node, n, place, holders)
            size = np.floor(np.log(n) / np.log(DOWN / UP))
            by = np.lexsort((node, size, gram))
            new = np.concatenate([[True], (np.diff(gram[by]) != 0) | (np.diff(size[by]) != 0)])
            hub = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            least, most = np.minimum(n[by], n[hub]), np.maximum(n[by], n[hub])
            left = np.minimum(n[by] - place[by], n[hub] - place[hub])
            good = (hub != by) & (least * DOWN >= most * UP) & (left * (UP + DOWN) >= (n[by] + n[hub]) * UP)
            pairs = np.unique(np.stack([node[hub[good]], node[by[good]]]), axis=1)
            if pairs.shape[1]:
                nothing = np.zeros(pairs.shape[1], np.int64)
                yield made(True, pairs[0], pairs[1], nothing, nothing, nothing)

        for batch in batches:
            for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and bucket != current:
                    yield from done()
                current = bucket
                held.append(parts)
        if held:
            yield from done()
        release()

    dealt = by_batch(first.select("node", "n", "prefix"), deal, "bucket int, gram binary, node binary, n binary, place binary", rows=2000)
    return written(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "star boolean, gram bigint, node bigint, n bigint, place bigint, holders bigint"), "gram-shared")


def may_be_similar(a: str, b: str):
    """The filters by size and by place, for rows of prefixes() with the same n-gram."""
    na, nb, pa_, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.place"), F.col(f"{b}.place")
    return (F.least(na, nb) * DOWN >= F.greatest(na, nb) * UP) & (F.least(na - pa_, nb - pb) * (UP + DOWN) >= (na + nb) * UP)


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with root (the component of their node, or the node itself) and weight (nodes of the component)."""
    if roots is None:
        return rows.withColumns({"root": F.col("node"), "weight": F.lit(1).cast("bigint")})
    known = rows.join(broadcast_if_small(roots, 200_000), "node", "left")
    return known.withColumns({"root": F.coalesce("root", "node"), "weight": F.coalesce("weight", F.lit(1))})


def rooted_nodes(links: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root, weight) of the nodes that links connect."""
    roots = written(components(links).select("node", "root"), "similar-components")
    weight = roots.groupBy("root").agg(F.count("*").alias("weight")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return written(salted.join(weight, ["root", "salt"]).select("node", "root", "weight"), "similar-roots")


def hub_pairs(rooted: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of nodes b with some nodes of other components that share an n-gram: 4 ** turn of the largest components
    among those of about b's size, chosen by hash, and up to TRIES * 4 ** turn for each b. Only n-grams of MANY nodes take part:
    the pairs of the others are few."""
    sized = rooted.where(F.col("holders") >= MANY).withColumn("size", F.floor(F.log("n") / F.log(F.lit(DOWN / UP))))
    by = F.xxhash64("node", "gram", F.lit(turn))
    best = F.struct("weight", "root", by.alias("by"), "node", "n", "place")
    hub = sized.groupBy("gram", "size", F.pmod(by, F.lit(4**turn)).alias("part")).agg(F.max(best).alias("h"), F.min("root").alias("least"), F.max("root").alias("most"))
    w = Window.partitionBy("gram", "size")  # 4 ** turn rows each
    hub = hub.withColumns({"least": F.min("least").over(w), "most": F.max("most").over(w)}).where("least < most")
    hub = hub.select("gram", "size", "h.*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    star = salted.alias("x").join(hub.alias("y"), ["gram", "size", "salt"]).where((F.col("x.root") != F.col("y.root")) & may_be_similar("x", "y"))
    pairs = star.groupBy(F.col("y.node").alias("a"), F.col("x.node").alias("b")).agg(F.count("*").alias("shared"))
    some = pairs.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), F.xxhash64("a", F.lit(turn)), "a"))).where(F.col("k") <= TRIES * 4**turn)
    return some.select("a", "b")


def near_prints(named: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are near: the smallest node of each fingerprint with that of each near one, and
    with the other nodes of its own."""
    firsts = written(named.groupBy("fp").agg(F.min("node").alias("least")), "print-firsts")
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}"))
    apart = written(near(firsts.select("fp")).distinct(), "print-links")
    apart = apart.join(side("a"), "a").join(side("b"), "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return apart.union(named.join(firsts, "fp").where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")))


def unconnected(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of nodes of different components."""
    if roots is None:
        return pairs
    for c in "ab":
        own = roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        pairs = pairs.join(broadcast_if_small(own, 200_000), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return pairs.where("root_a <> root_b").select("a", "b")


def verified(pairs: DataFrame, named: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar. named: (node, doc_id, n, counts), a document of each node. The Manhattan
    distance of two nodes' segment counts is a lower bound of the n-grams that only one of them has; pairs within the bound are
    verified exactly. Sets are made again, for the nodes in pairs: cheaper than to keep those of all texts."""

    def within(batch: pa.RecordBatch) -> pa.RecordBatch:
        far = apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
        # similar sets have at most this share of both in one of them only
        return batch.select([0, 1]).filter(pa.array(far * (UP + DOWN) <= (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (DOWN - UP)))

    side = lambda c: named.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))
    bounded = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb")
    pairs = written(by_batch(bounded, within, "a bigint, b bigint"), "similar-pairs")
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named.select("node", "doc_id"), "node"), "similar-needed")
    memo: dict[bytes, int] = {}

    def sets(batch: pa.RecordBatch) -> dict[str, list]:
        grams = [gram_set(t, width, _memo_of(memo)) for t in batch.column(0).to_pylist()]
        return {"node": [_node(g) for g in grams], "grams": [g.tobytes() for g in grams]}

    ids = needed.select(F.col("doc_id").alias(f"{unused(docs)}needed")).distinct()
    texts = docs.join(broadcast_if_small(ids, 200_000), docs[id_col].eqNullSafe(F.col(f"{unused(docs)}needed")), "left_semi").select(text_col)
    held = by_batch(texts, sets, "node bigint, grams binary").join(broadcast_if_small(needed.select("node"), 200_000), "node", "left_semi")
    held = written(held.groupBy("node").agg(F.first("grams").alias("grams")), "similar-sets")
    both = pairs.join(held.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").join(held.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            good.append(common * DOWN >= (len(x) + len(y) - common) * UP)
        return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    links = written(by_batch(both.select("a", "b", "ga", "gb"), check, "a bigint, b bigint", rows=1000), "similar-links")
    discard(pairs, needed, held)
    return links


def classes(docs: DataFrame, components: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", width: int = 5, prints: tuple[Callable[[np.ndarray], int], Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each document and (node, component_id) of each node: the smallest doc_id reachable over similar pairs.
    prints: what makes a fingerprint of a set's hashes, and pairs (a, b) of a table's near ones (fp), which are compared first."""
    mark, near = prints or (None, None)
    first = written(prefixes(docs, id_col, text_col, width, frequent(docs, text_col, width), mark), "gram-prefixes")
    nodes = written(first.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("fp").alias("fp")), "gram-nodes")
    named = nodes
    # one text of each node goes on, but for texts equal in id and set
    copies = first.select("node", "doc_id").join(broadcast_if_small(named.where("docs > 1").select("node", F.col("doc_id").alias("least")), 200_000), "node").where(~F.col("doc_id").eqNullSafe(F.col("least")))
    copies = written(copies.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id")).distinct(), "gram-copies")
    single = first.join(broadcast_if_small(copies, 200_000), (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    shared = shared_grams(single)
    rows = shared.where("NOT star").drop("star")
    of = written(first.select("doc_id", "node"), "gram-of")
    discard(first, copies)
    named, made = nodes.drop("docs"), (docs, id_col, text_col, width)
    links, roots = None, None
    if near:
        links = verified(near_prints(named, near), named.drop("fp"), *made)
        roots = rooted_nodes(links, components)
    named = named.drop("fp")
    for turn in range(TURNS):
        tried = hub_pairs(with_roots(rows, roots), turn) if turn else unconnected(shared.where("star").select(F.col("gram").alias("a"), F.col("node").alias("b")), roots)
        found = verified(tried, named, *made)
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        roots = rooted_nodes(links, components)
    # all other pairs
    rooted = written(with_roots(rows, roots).drop("weight", "holders"), "gram-rooted")
    left, right = rooted.alias("x"), rooted.alias("y")
    other = left.join(right, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & may_be_similar("x", "y"))
    found = verified(other.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), named, *made)
    links = found if links is None else links.union(found)
    roots = written(components(links).select("node", "root"), "similar-roots")
    discard(rooted, shared)
    least = roots.join(named, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("node", "component_id")
    named = written(named.join(joined, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id")), "similar-found")
    discard(nodes)
    return of, named


def similar(docs: DataFrame, components: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id reachable over similar pairs, itself included)."""
    of, classes_ = classes(docs, components, id_col, text_col, width)
    return of.join(classes_, "node").select("doc_id", "component_id")
