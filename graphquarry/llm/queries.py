"""The operators' queries over the tables of a folder, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, langid, lmscore, mixing, packing, passages, periods, quality, secretscan, simhash, toxicity, warc
from .common import WORD_REGEX


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic")).drop("text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents", "doc_id", "text", "lang")).drop("text", "lang")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lmscore.score(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return d.withColumns({c: F.round(c, 6) for c in ("log10_score", "mean_log10")})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.contamination(docs, items).drop("text")


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth document by crc32 the words from some place on go round (a null id: none)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(f"({WORD_REGEX})"))

    def turned(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    planted = F.get(F.transform(F.array(words), turned), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD_REGEX), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periods.periodic_runs(_with_planted_periods(_table(spark, sf_dir, "documents", "doc_id", "text")))
    run = "struct<length:bigint,start:bigint,period:bigint>"
    longest = F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("length"), r.start.alias("start"), r.period.alias("period"))))
    d = d.withColumns({"longest": F.get(longest, F.lit(0)).cast(run), "lines": F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")})
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    exponent = F.expr("1000 * -longest.length div longest.period")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.length")).alias("length"), F.col("longest.period").alias("period"), exponent.alias("exponent_milli"), sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    d = packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), path("word_bpe_49k.json"))
    return d.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_dedup, op2_toxicity, op3_warc, op4_quality_rules, op5_substring_dedup, op6_language_id, op7_lm_scoring, op8_mixing, op9_secret_scan, op10_decontamination, op11_periodic_runs, op12_source_divergence, op13_packing)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_SPACED = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_OP3 = """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest AS digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d LEFT JOIN k ON digest = payload_digest AND payload_bytes >= 1000
"""


def _fence_sql() -> str:
    """The adaptive fences over a relation ``base`` (doc_id, lang, source, the base counts, base_failed)."""
    per = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words", "word_length": "word_chars"}
    value = {m: f"((1000 * {c}) // greatest(n_words, 1))" for m, c in per.items()}
    grid = quality.GRID
    e = f"(length(bin(v)) - {quality.EXACT_BITS})"
    bucket = f"CASE WHEN v < {2 * grid} THEN v ELSE {grid} * {e} + v // (1::BIGINT << {e}::INTEGER) END"
    low = lambda b: f"CASE WHEN {b} < {2 * grid} THEN {b} ELSE ({b} - {grid} * ({b} // {grid} - 1)) * (1::BIGINT << ({b} // {grid} - 1)::INTEGER) END"

    def quantiles(name: str, source: str, keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        at = lambda p, end: f"min(CASE WHEN 100 * upto >= {p} * docs THEN {end} END)"
        above = lambda p, end: f"min(CASE WHEN bucket > 0 AND 100 * (upto - zeros) >= {p} * (docs - zeros) THEN {end} END)"
        apart = f"1 + low >= {quality.GAP} * (1 + under) AND 4 * (upto - n) >= {quality.GAP_QUARTERS} * docs"
        return f"""{name}_ends AS (SELECT *, {low('bucket')} AS low, {low('(bucket + 1)')} - 1 AS high FROM {source}),
{name}_run AS (SELECT {by}, bucket, n, low, high, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY {by}) AS docs, sum(CASE WHEN bucket = 0 THEN n ELSE 0 END) OVER (PARTITION BY {by}) AS zeros, lag(high) OVER w AS under FROM {name}_ends WINDOW w AS (PARTITION BY {by} ORDER BY bucket)),
{name} AS (SELECT {by}, max(docs) AS docs, max(docs) - max(zeros) AS above, {at(10, 'low')} AS q10, {at(50, 'high')} AS q50, {above(50, 'low')} AS p50, {above(90, 'high')} AS p90, min(CASE WHEN {apart} THEN floor(sqrt(((1 + low) * (1 + under))::DOUBLE))::BIGINT END) AS gap FROM {name}_run GROUP BY {by})"""

    q = lambda x, n, least: f"CASE WHEN a.{n} >= {least} THEN a.{x} WHEN b.{n} >= {least} THEN b.{x} ELSE c.{x} END AS {x}"
    picks = ", ".join([q(x, "docs", 50) for x in ("q10", "q50", "gap")] + [q(x, "above", 20) for x in ("p50", "p90")])
    within = " AND ".join(f"{v} BETWEEN lo_{m} AND hi_{m}" for m, v in value.items())
    wide = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {x} END) AS {x}_{m}" for m in value for x in ("lo", "hi"))
    return f"""
long AS (SELECT lang, source, m.measure AS measure, m.v AS v FROM (SELECT lang, source, unnest([{', '.join(f"{{'measure': '{m}', 'v': {v}}}" for m, v in value.items())}]) AS m FROM base WHERE NOT base_failed)),
sketch AS (SELECT lang, source, measure, {bucket} AS bucket, count(*) AS n FROM long GROUP BY ALL),
by_lang AS (SELECT lang, measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
whole AS (SELECT measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{quantiles('qa', 'sketch', 'lang, source')},
{quantiles('qb', 'by_lang', 'lang')},
{quantiles('qc', 'whole', '')},
picked AS (SELECT a.lang, a.source, a.measure, {picks} FROM qa a JOIN qb b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN qc c ON c.measure = a.measure),
fence AS (SELECT lang, source, measure, CASE WHEN measure = 'word_length' THEN q50 - 5 * (q50 - q10) ELSE 0 END AS lo, coalesce(gap, p50 + 5 * (p90 - p50), {1 << 62}) AS hi FROM picked),
fences AS (SELECT lang, source, {wide} FROM fence GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, true) AS kept
FROM base LEFT JOIN fences ON base.lang IS NOT DISTINCT FROM fences.lang AND base.source IS NOT DISTINCT FROM fences.source
"""


_OP4 = (
    f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),"""
    + _fence_sql()
)

_OP7 = f"""
WITH w AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
uni AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
total AS (SELECT count(*) AS n FROM uni), size AS (SELECT doc_id, count(*) AS n FROM uni GROUP BY doc_id),
c1 AS (SELECT x, count(*) AS n FROM uni GROUP BY x), d1 AS (SELECT doc_id, x, count(*) AS n FROM uni GROUP BY ALL),
c2 AS (SELECT u, x, count(*) AS n FROM uni WHERE u IS NOT NULL GROUP BY ALL), d2 AS (SELECT doc_id, u, x, count(*) AS n FROM uni WHERE u IS NOT NULL GROUP BY ALL),
l AS (SELECT uni.doc_id, coalesce(c2.n - d2.n, 0) AS ab, cu.n - du.n AS a, cx.n - dx.n AS b, total.n - size.n AS others, uni.u IS NULL AS start
  FROM uni JOIN total ON true JOIN size ON size.doc_id = uni.doc_id JOIN c1 cx ON cx.x = uni.x JOIN d1 dx ON dx.doc_id = uni.doc_id AND dx.x = uni.x
  LEFT JOIN c1 cu ON cu.x = uni.u LEFT JOIN d1 du ON du.doc_id = uni.doc_id AND du.x = uni.u LEFT JOIN c2 ON c2.u = uni.u AND c2.x = uni.x LEFT JOIN d2 ON d2.doc_id = uni.doc_id AND d2.u = uni.u AND d2.x = uni.x),
s AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN ab > 0 THEN log10(ab::DOUBLE / a) ELSE log10(greatest(b, 0.5)::DOUBLE / greatest(others, 1)) + CASE WHEN start THEN 0 ELSE log10(0.4::DOUBLE) END END) AS t FROM l GROUP BY doc_id)
SELECT documents.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, round(coalesce(t, 0), 6) AS log10_score, round(t / s.n, 6) AS mean_log10 FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id
"""


def _apportion_sql(name: str, parties: str, group: str, party: str, votes: str, seats: str, cap: str) -> str:
    return f"""{name}_p AS (SELECT {group} AS g, {party} AS p, {votes}::DOUBLE AS v, {seats} AS n, {cap} AS cap, sum({votes}::DOUBLE) OVER (PARTITION BY {group}) AS all_v, count(*) OVER (PARTITION BY {group}) AS m FROM {parties}),
{name}_near AS (SELECT *, CASE WHEN all_v > 0 THEN floor(n * (v / all_v) + 0.5) ELSE 0 END::BIGINT AS near, (CASE WHEN all_v > 0 THEN ceil(m * (v / all_v) / 2) ELSE 0 END + 2)::BIGINT AS reach FROM {name}_p),
{name}_sure AS (SELECT *, greatest(0, near - reach) AS sure FROM {name}_near),
{name}_left AS (SELECT *, n - sum(sure) OVER (PARTITION BY g) AS remaining FROM {name}_sure),
{name}_offer AS (SELECT *, unnest(range(sure, near + reach + 1)) AS k FROM {name}_left WHERE v > 0),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v / (2 * k + 1) DESC, k, p) AS r FROM {name}_offer),
{name} AS (SELECT g, p, least(first(sure) + count(*), first(cap))::BIGINT AS quota FROM {name}_rank WHERE r <= remaining GROUP BY g, p)"""


_NUMBER = lambda x: f"('0x' || right({x}, 15))::BIGINT"

_OP8 = f"""
WITH d AS (SELECT doc_id, source, len({_SPACED})::BIGINT AS size FROM documents),
by_size AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM by_size),
heavy AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM placed),
fill AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::BIGINT AS free, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS open, row_number() OVER (ORDER BY source_size / weight, place) AS f FROM heavy WINDOW b AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT *, 3 * source_size * open <= free * weight AS stopped FROM fill),
level AS (SELECT free, open FROM stop WHERE NOT stopped ORDER BY f LIMIT 1),
target AS (SELECT stop.*, CASE WHEN stopped THEN (3 * source_size)::DOUBLE ELSE (weight * level.free)::DOUBLE / level.open END AS target, (sum(source_size) OVER ())::BIGINT AS total FROM stop LEFT JOIN level ON true),
sized AS (SELECT *, greatest(1, least(64, total // 100000)) AS block, greatest(1, least(4096, source_size // 100000)) AS shards FROM target),
seated AS (SELECT *, total // block AS seats, 3 * source_size // block AS room FROM sized),
{_apportion_sql("won", "seated", "0", "place", "target", "seats", "room")},
facts AS (SELECT seated.*, coalesce(quota, 0) AS blocks FROM seated LEFT JOIN won ON won.p = place),
lots AS (SELECT d.*, facts.source_size, target, place, block, blocks, md5('20:' || doc_id || ':' || size) AS lot, shards FROM d JOIN facts ON d.source IS NOT DISTINCT FROM facts.source),
dealt AS (SELECT *, {_NUMBER('lot')} % shards AS shard FROM lots),
shard_sizes AS (SELECT place, shard, sum(size)::BIGINT AS shard_size, first(blocks) AS blocks, 3 * sum(size)::BIGINT // first(block) AS room FROM dealt GROUP BY place, shard),
{_apportion_sql("won2", "shard_sizes", "place", "shard", "shard_size", "blocks", "room")},
line AS (SELECT dealt.*, (coalesce(sum(size) OVER l, 0))::BIGINT AS a, (sum(size) OVER (PARTITION BY place, shard))::BIGINT AS long, coalesce(won2.quota, 0) * block AS tokens FROM dealt LEFT JOIN won2 ON won2.g = place AND won2.p = shard WINDOW l AS (PARTITION BY place, shard ORDER BY lot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT *, CASE WHEN long > 0 THEN tokens // long ELSE 0 END AS rounds, CASE WHEN long > 0 THEN tokens % long ELSE 0 END AS rest, {_NUMBER("md5('20:' || place || ':' || shard)")} % greatest(1, long // block) * block AS b FROM line)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(a + size, least(b + rest, long)) - greatest(a, b)) + greatest(0, least(a + size, b + rest - long) - a))::BIGINT AS taken FROM cut
"""

_OP10 = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_PLAIN} AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda p: array_to_string(w[p : p + least(10, len(w)) - 1], ' '))) AS k FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, sizes),
hits AS (SELECT doc_id, n, p, item_id FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM dw) x JOIN iw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LETTERS = f"list_filter(string_split_regex({_LOW}, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
lang_size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (size.total + lang_size.v))::HUGEINT AS p, (1 + 1000000000 * (kept.n + 1)::HUGEINT // (lang_size.total + lang_size.v))::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN lang_size USING (lang) JOIN size USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

#: Fingerprints need XXH64, and chains, automata, models and guess costs a loop; tests compare those with plain versions.
ORACLE_SQL: dict[str, str] = {"op3_warc": _OP3, "op4_quality_rules": _OP4, "op7_lm_scoring": _OP7, "op8_mixing": _OP8, "op10_decontamination": _OP10, "op12_source_divergence": _OP12}
