"""Sharding by minimax contiguous partition: a binary search finds the smallest shard capacity for which a greedy pass over
the ordered groups needs no more than the given number of shards; the shards are then cut there.

The groups (documents of equal text, never split) are ordered by the digest of their text. The driver never sees all groups:
it works on the ordered sums of groups whose digests share a prefix, treats such a bin once as divisible (lower bound) and
once as whole (upper bound), and refines only the bins that a cut can fall into until both bounds agree. The capacity found is
therefore the exact optimum over all groups, with at most LEVEL_ONE + some hundred rows on the driver at each step.

Defined cases: a null text counts as a group of its own with no bytes, an empty text is another group; repeated rows and ids
keep their rows, all in the shard of their text, in any order; fewer groups than shards leave shards empty; an empty table gives
an empty result; columns of docs other than the two named are ignored. Texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, discard, written

#: Digits of the digest that make the first bins: 16 ** 3 of them.
FIRST_DIGITS, MORE_DIGITS, DIGEST_DIGITS = 3, 2, 64


def greedy(atoms: list[tuple], shards: int, capacity: int, divisible: bool) -> tuple[bool, list[tuple[int, int]]]:
    """Fills shards in order up to capacity. atoms: (prefix, size, groups). Returns whether `shards` suffice, and of each cut
    the place of the atom in which or before which it falls with what the shard before it holds. With divisible, an atom of
    more than one group may be cut anywhere."""
    used, fill, cuts = 1, 0, []
    for k, (_, size, groups) in enumerate(atoms):
        if fill + size <= capacity:
            fill += size
            continue
        if divisible and groups > 1:
            left = fill + size - capacity
            while left > 0:
                used, fill = used + 1, min(left, capacity)
                cuts.append((k, fill))
                left -= fill
                if used > shards:
                    return False, cuts
        else:
            if size > capacity:
                return False, cuts
            used, fill = used + 1, size
            cuts.append((k, fill))
        if used > shards:
            return False, cuts
    return True, cuts


def smallest(atoms: list[tuple], shards: int, low: int, divisible: bool) -> int:
    """The smallest capacity from low for which greedy() succeeds."""
    high = max(low, sum(a[1] for a in atoms))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(atoms, shards, middle, divisible)[0] else (middle + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and the digests at which shards 1, 2, ... begin. groups: digest, bytes."""

    def bins(df: DataFrame, digits: int) -> dict[str, tuple]:
        rows = df.groupBy(F.substring("digest", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m")).collect()
        return {r.p: (r.p, r.b, r.n, r.m) for r in rows}

    found = bins(groups, FIRST_DIGITS)
    largest = max((x[3] for x in found.values()), default=0)
    digits = {p: FIRST_DIGITS for p in found}
    while True:
        atoms = [found[p][:3] for p in sorted(found)]
        total = sum(a[1] for a in atoms)
        low = smallest(atoms, shards, max(largest, -(-total // shards)), True)
        high = smallest(atoms, shards, low, False)
        if low == high:
            break
        # cut j falls between its place for the lower capacity with whole bins and its place for the higher one with divisible bins
        early, late = greedy(atoms, shards + len(atoms), low, False)[1], greedy(atoms, shards, high, True)[1]
        late += [(len(atoms) - 1, 0)] * shards
        touched = {k for (a, _), (b, _) in zip(early[: shards - 1], late[: shards - 1], strict=False) for k in range(max(0, a - 1), min(len(atoms), b + 2))}
        touched |= {k for k, a in enumerate(atoms) if a[1] > low}
        open_bins = [atoms[k][0] for k in sorted(touched) if atoms[k][2] > 1]
        if not open_bins:  # every bin that a cut can reach is one group
            open_bins = [a[0] for a in atoms if a[2] > 1]
        more = min(DIGEST_DIGITS, max(digits[p] for p in open_bins) + MORE_DIGITS)
        for n in {digits[p] for p in open_bins}:
            own = [p for p in open_bins if digits[p] == n]
            got = bins(groups.where(F.substring("digest", 1, n).isin(own)), more)
            for p in own:
                del found[p], digits[p]
            found |= got
            digits |= {p: more for p in got}
    atoms = [found[p][:3] for p in sorted(found)]
    # an uncut bin may stand for many groups: a prefix sorts before all its digests, so it is the bound as it is
    return high, [atoms[k][0] for k, _ in greedy(atoms, shards, high, False)[1]]


#: Rows of a cell in which slots are counted, about, and cells of a shard at least.
CELL_ROWS, LEAST_CELLS = 50_000, 512


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", broadcast_cells: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in each
    shard), grown_shard (null: this law promises nothing for another number of shards).

    Texts are read once, into a narrow table in the shared folder. Slots are counted in cells of each shard, as many as the rows
    ask for, which the number of a row in that table deals out: rows that are equal spread like all others.
    """
    text = F.col(text_col)
    narrow = written(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("")).alias("digest"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "shard-sizes",
    )
    groups = written(narrow.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    discard(groups)
    cells = max(LEAST_CELLS, narrow.count() // CELL_ROWS)
    shard = sum((F.when(F.col("digest") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = narrow.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("number"), F.lit(cells)).cast("int"))
    counts = placed.groupBy("shard", "cell").count()  # shards x cells rows at most
    before = counts.select("shard", "cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "digest", "number")))
    return ranked.join(broadcast_if_small(before, broadcast_cells), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
