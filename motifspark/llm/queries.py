"""The registered queries of the corpus operators, each over its whole table, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, quality, rank_bpe, secret_scan, sharding, simhash, suffix_dedup, token_store, url_filter, wordpiece
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents")).drop("n_lines")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, url_filter.BASE_RULES))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.encoding_table(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).documents()


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scans": op3_secret_scans,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_url_filters": op7_url_filters,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_output": op9_token_output,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.BASE_RULES)
_SIGNALS = " UNION ALL ".join(f"SELECT n, lang, source, base_failed, '{name}' AS signal, CAST({x.sql.replace(' div ', ' // ')} AS BIGINT) AS v FROM c" for name, x in quality.SIGNALS.items())
_LEVELS = ", ".join(f"('{name}', {x.inner}, {x.outer}, {x.spreads}, {x.both_sides})" for name, x in quality.SIGNALS.items())
_VALUE = "CASE WHEN {0} < 64 THEN {0} ELSE ({0} - ({0} // 32 - 1) * 32) << ({0} // 32 - 1) END"
_BUCKET = "CASE WHEN {0} < 64 THEN {0} ELSE (length(bin({0})) - 6) * 32 + ({0} >> (length(bin({0})) - 6)) END"
_WORD = r"[^\x20\x09-\x0D]"
ORACLE: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
u AS (SELECT n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT n, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY n ORDER BY i)),
r AS (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS k FROM g WHERE c IS NOT NULL),
k AS (SELECT n, count(DISTINCT p) AS covered FROM (SELECT n, unnest([i, i + 1, i + 2]) AS p FROM r WHERE k > 1) GROUP BY n),
l AS (SELECT n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
b AS (SELECT d.n, doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(covered, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM d JOIN l USING (n) LEFT JOIN k USING (n)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
s AS ({_SIGNALS}),
h AS (SELECT *, {_BUCKET.format("v")} AS bucket FROM s),
ko AS (SELECT lang, source, signal, bucket, count(*) AS k FROM h WHERE NOT base_failed GROUP BY ALL),
kl AS (SELECT lang, signal, bucket, sum(k) AS k FROM ko GROUP BY ALL),
kc AS (SELECT signal, bucket, sum(k) AS k FROM ko GROUP BY ALL),
a AS (SELECT g.lang, g.source, kc.signal, kc.bucket, coalesce(ko.k, 0) AS n, coalesce(kl.k, 0) AS m, kc.k AS c
      FROM (SELECT DISTINCT lang, source FROM ko) g CROSS JOIN kc
      LEFT JOIN kl ON kl.lang IS NOT DISTINCT FROM g.lang AND kl.signal = kc.signal AND kl.bucket = kc.bucket
      LEFT JOIN ko ON ko.lang IS NOT DISTINCT FROM g.lang AND ko.source IS NOT DISTINCT FROM g.source AND ko.signal = kc.signal AND ko.bucket = kc.bucket),
e AS (SELECT *, {quality.UNIT} * sum(n) OVER up + ({quality.PRIOR * quality.UNIT} * sum(m) OVER up) // (sum(m) OVER whole) + ({quality.PRIOR * quality.UNIT} * sum(c) OVER up) // (sum(c) OVER whole) AS upto,
             {quality.UNIT} * sum(n) OVER whole + {2 * quality.PRIOR * quality.UNIT} AS weight
      FROM a WINDOW whole AS (PARTITION BY lang, source, signal), up AS (PARTITION BY lang, source, signal ORDER BY bucket)),
q AS (SELECT lang, source, signal, any_value(spreads) AS spreads, any_value(both_sides) AS both_sides,
             min(bucket) FILTER (WHERE upto * 100 >= weight * inner_level) AS inner_q, min(bucket) FILTER (WHERE upto * 100 >= weight * outer_level) AS outer_q,
             min(bucket) FILTER (WHERE upto * 100 >= weight * (100 - inner_level)) AS lower_q, min(bucket) FILTER (WHERE upto * 100 >= weight * (100 - outer_level)) AS lowest_q
      FROM e JOIN (VALUES {_LEVELS}) AS x(name, inner_level, outer_level, spreads, both_sides) ON signal = name GROUP BY lang, source, signal),
x AS (SELECT lang, source, signal, spreads, both_sides, {_VALUE.format("inner_q")} AS inner_v, {_VALUE.format("(outer_q + 1)")} AS outer_v, {_VALUE.format("(lower_q + 1)")} AS lower_v, {_VALUE.format("lowest_q")} AS lowest_v FROM q),
v AS (SELECT lang, source, signal, CAST(CASE WHEN both_sides THEN greatest(lowest_v - spreads * (lower_v - lowest_v), 0) ELSE 0 END AS BIGINT) AS low, CAST(outer_v + spreads * (outer_v - inner_v) AS BIGINT) AS high FROM x),
j AS (SELECT h.n, bool_and(bucket BETWEEN {_BUCKET.format("low")} AND {_BUCKET.format("high")}) AS inside
      FROM h JOIN v ON v.lang IS NOT DISTINCT FROM h.lang AND v.source IS NOT DISTINCT FROM h.source AND v.signal = h.signal GROUP BY h.n),
w AS (SELECT n, max(v) FILTER (WHERE signal = 'symbol_rate') AS symbol_rate, max(v) FILTER (WHERE signal = 'repeat_rate') AS repeat_rate,
             max(v) FILTER (WHERE signal = 'dup_line_rate') AS dup_line_rate, max(v) FILTER (WHERE signal = 'word_length') AS word_length FROM s GROUP BY n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbol_rate, repeat_rate, dup_line_rate, word_length, NOT base_failed AND coalesce(inside, true) AS kept
FROM c JOIN w USING (n) LEFT JOIN j USING (n)""",
    "op7_url_filters": f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES}),
u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM u),
m AS (SELECT p.n, max({{'a': length(rhost || rpath), 'b': length(rhost), 'c': rverdict = 'block', 'rule': rhost || rpath, 'verdict': rverdict}}) AS best
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.n)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict
FROM p LEFT JOIN m USING (n)""",
}
