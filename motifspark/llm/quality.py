"""Quality rules with adaptive thresholds: the fixed cut-offs of the usual heuristics are replaced by fences that mergeable
quantile sketches give per language and source; a join with the fences then filters.

The sketch of a whole-number signal is its counts by log-linear bucket (32 buckets for each power of two, so a quantile is at
most 1/32 too low). Sketches merge by adding counts: Spark's partial aggregation merges those of tasks, and those of sources
add up to their language's and of languages to the corpus's. The sketch that gives a (language, source) group its fences is
its own with that of its language and that of the corpus added, each scaled to the weight of PRIOR documents: the same rule for
groups of all sizes, in which a group of few documents leans on the other two and a large one speaks for itself.

A fence lies `spreads` times the distance of two quantiles beyond the outer of them; the distance is the largest that their
buckets allow, and documents in the fence's bucket are inside. Nothing but the sketch sets it. For symbols and word lengths the quantiles are the median and the quartile, which documents
beyond the fence can't move up to a share of a quarter. Repeats and repeated lines are natural in a few texts of most sources,
so theirs are 90 and 99 of 100.

Defined cases: a null or empty text has no words; texts without words get zeros and fail the base rule; null languages and
sources are groups like any other; repeated rows and ids are judged and counted as they are; values equal to a fence are
inside; an empty table gives an empty result; columns of docs other than those named are ignored by quality_table() and kept
by keep_good(), whatever their names. A task needs some 20 bytes for each byte of its longest text.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import broadcast_if_small, by_batch, unused, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"


class Signal(NamedTuple):
    """A number for each document: expression over COUNTS, percentiles of the sketch, spreads, whether low values are rejected too."""

    sql: str
    inner: int
    outer: int
    spreads: int
    both_sides: bool


#: Rates are per 10,000, lengths per 100.
SIGNALS = {
    "symbol_rate": Signal("n_symbols * 10000 div greatest(word_chars, 1)", 50, 75, 5, False),
    "repeat_rate": Signal("n_repeat_words * 10000 div greatest(n_words, 1)", 90, 99, 3, False),
    "dup_line_rate": Signal("n_dup_lines * 10000 div greatest(n_lines, 1)", 90, 99, 3, False),
    "word_length": Signal("word_chars * 100 div greatest(n_words, 1)", 50, 75, 11, True),
}
#: Weight of the language's and of the corpus's sketch in a group's, in documents, and the unit that weights are counted in.
PRIOR, UNIT = 100, 1000


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text. A repeated word is one that a 3-word window found twice or more covers."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, held = len(words), sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for k, w in enumerate(windows):
            if often[w] > 1:
                repeated += k + 3 - max(end, k)
                end = k + 3
    return n, len(text or "") - (len(raw) - held), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def bucket(v: Column) -> Column:
    """The log-linear bucket of a whole number of 0 or more: itself below 64, then 32 for each power of two."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", v, e)).cast("int")


def bucket_value(b: Column) -> Column:
    """The smallest number in a bucket."""
    e = F.when(b < 64, F.lit(0)).otherwise((b / 32).cast("int") - 1)
    return F.call_function("shiftleft", (b - e * 32).cast("long"), e)


def measured(docs: DataFrame, text_col: str, carry: list[str], prefix: str) -> DataFrame:
    """The carried columns with the COUNTS, base_failed and the SIGNALS, under names with the prefix."""
    fields = [docs.schema[c] for c in carry]
    at = list(dict.fromkeys([*carry, text_col]))
    kept = [at.index(c) for c in carry]
    text_at = at.index(text_col)

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        got = list(zip(*map(text_counts, batch.column(text_at).to_pylist()), strict=True)) or [()] * len(COUNTS)
        return {c: batch.column(k) for c, k in zip(carry, kept, strict=True)} | {f"{prefix}{c}": x for c, x in zip(COUNTS, got, strict=True)}

    out = by_batch(docs.select(*[F.col(f"`{c}`") for c in at]), count, StructType([*fields, *(StructField(f"{prefix}{c}", LongType()) for c in COUNTS)]))
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    added = {f"{prefix}base_failed": (n < 50) | (100 * again > 50 * n)}
    for name, signal in SIGNALS.items():
        sql = signal.sql
        for c in COUNTS:
            sql = sql.replace(c, f"{prefix}{c}")
        added[f"{prefix}{name}"] = F.expr(sql).cast("long")
    return out.withColumns(added)


def sketches(rows: DataFrame, lang_col: str, source_col: str, prefix: str) -> DataFrame:
    """(lang, source, signal, bucket, n): the mergeable sketches of all signals over the rows that pass the base rule."""
    pairs = F.array(*(F.struct(F.lit(s).alias("signal"), bucket(F.col(f"{prefix}{s}")).alias("bucket")) for s in SIGNALS))
    passed = rows.where(~F.col(f"{prefix}base_failed"))
    return passed.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(pairs).alias("p")).groupBy("lang", "source", "p.signal", "p.bucket").agg(F.count("*").alias("n"))


def merged(own: DataFrame, prior: int) -> DataFrame:
    """(lang, source, signal, bucket, upto, weight): each group's sketch with its language's and the corpus's, as running weights
    at all buckets that the corpus has; bounded by the number of buckets for each group."""
    named = lambda df, prefix: df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))
    same = lambda prefix, *keys: [F.col(k).eqNullSafe(F.col(f"{prefix}_{k}")) for k in keys]
    lang = own.groupBy("lang", "signal", "bucket").agg(F.sum("n").alias("n"))
    corpus = lang.groupBy("signal", "bucket").agg(F.sum("n").alias("c"))
    at = own.select("lang", "source", "signal").distinct().join(corpus, "signal")
    at = at.join(named(lang, "l"), same("l", "lang", "signal", "bucket"), "left").join(named(own, "o"), same("o", "lang", "source", "signal", "bucket"), "left")
    at = at.select("lang", "source", "signal", "bucket", "c", F.coalesce("o_n", F.lit(0)).alias("n"), F.coalesce("l_n", F.lit(0)).alias("m"))
    whole = Window.partitionBy("lang", "source", "signal")
    up = whole.orderBy("bucket")
    return at.select(
        "lang", "source", "signal", "bucket", F.sum("n").over(up).alias("n"), F.sum("m").over(up).alias("m"), F.sum("c").over(up).alias("c"),
        F.sum("n").over(whole).alias("all_n"), F.sum("m").over(whole).alias("all_m"), F.sum("c").over(whole).alias("all_c"),
    ).selectExpr(
        "lang", "source", "signal", "bucket", f"{UNIT} * n + ({prior * UNIT} * m) div all_m + ({prior * UNIT} * c) div all_c AS upto", f"{UNIT} * all_n + {2 * prior * UNIT} AS weight",
    )


def thresholds(rows: DataFrame, lang_col: str, source_col: str, prefix: str, prior: int = PRIOR) -> DataFrame:
    """(lang, source, fences: map of signal to the lowest and highest bucket inside), a row for each (language, source)."""
    running = merged(written(sketches(rows, lang_col, source_col, prefix), "quality-sketches"), prior)
    levels = sorted({q for s in SIGNALS.values() for q in (s.inner, s.outer, 100 - s.inner, 100 - s.outer)})
    at = running.groupBy("lang", "source", "signal").agg(*(F.min(F.when(F.col("upto") * 100 >= F.col("weight") * q, F.col("bucket"))).alias(f"q{q}") for q in levels))
    low, high = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, s in SIGNALS.items():
        least, beyond = (lambda q: bucket_value(F.col(f"q{q}"))), (lambda q: bucket_value(F.col(f"q{q}") + 1))
        top, bottom = beyond(s.outer), least(100 - s.outer)
        high = F.when(F.col("signal") == name, bucket(top + s.spreads * (top - least(s.inner)))).otherwise(high)
        low = F.when(F.col("signal") == name, bucket(F.greatest(bottom - s.spreads * (beyond(100 - s.inner) - bottom), F.lit(0))) if s.both_sides else F.lit(0)).otherwise(low)
    fence = F.struct("signal", F.struct(low.alias("low"), high.alias("high")))
    return written(at.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(fence)).alias("fences")), "quality-fences")


def judged(rows: DataFrame, limits: DataFrame, lang_col: str, source_col: str, prefix: str, broadcast_groups: int = 200_000) -> DataFrame:
    """rows (of measured()) with `kept`, under a name with the prefix: false if the base rule fails or a signal lies beyond its
    group's fence."""
    lang, source, fences = f"{prefix}lang", f"{prefix}source", f"{prefix}fences"
    limits = limits.toDF(lang, source, fences)
    found = rows.join(broadcast_if_small(limits, broadcast_groups), F.col(f"`{lang_col}`").eqNullSafe(F.col(lang)) & F.col(f"`{source_col}`").eqNullSafe(F.col(source)), "left")
    inside = F.lit(True)
    for s in SIGNALS:
        inside = inside & F.coalesce(bucket(F.col(f"{prefix}{s}")).between(F.col(fences)[s]["low"], F.col(fences)[s]["high"]), F.lit(True))
    return found.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & inside).drop(lang, source, fences)


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR) -> DataFrame:
    """One row per document: its id, counts, base_failed, signals and kept. Texts are read once; what follows works on a narrow
    table in the shared folder."""
    p = unused(docs)
    rows = written(measured(docs, text_col, list(dict.fromkeys([id_col, lang_col, source_col])), p), "quality-counts")
    out = judged(rows, thresholds(rows, lang_col, source_col, p, prior), lang_col, source_col, p)
    return out.select(F.col(id_col).alias("doc_id"), *(F.col(f"{p}{c}").alias(c) for c in [*COUNTS, "base_failed", *SIGNALS, "kept"]))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR) -> DataFrame:
    """The documents that the rules keep, with their columns. The counts are made twice, for the sketches and for the filter:
    cheaper than to shuffle or to write all texts."""
    p = unused(docs)
    limits = thresholds(measured(docs, text_col, list(dict.fromkeys([lang_col, source_col])), p), lang_col, source_col, p, prior)
    return judged(measured(docs, text_col, docs.columns, p), limits, lang_col, source_col, p).where(F.col(f"{p}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
