"""Quality rules with adaptive thresholds.

Every document is measured once.  The measures go into mergeable quantile sketches, one per language,
source and measure: a sketch is a count per bucket of a fixed integer grid (exact below 128, then 64
buckets to each power of two, so a quantile is off by 1/64 at most), and sketches merge by adding
counts.  A group of too few documents borrows its language's sketch, and a small language the sketch
of everything.  The fences taken from the sketches are joined to the documents.

Most measures are zero in most documents, so an upper fence takes its spread from the values above
zero; where a stretch in which a group has nothing parts a few documents from all others, the fence
stands in that gap.  Nothing here depends on the order of rows, so reruns agree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITESPACE, aside, cut, utf8

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures as integers, per thousand words.
MEASURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
#: Buckets to a power of two, and the bits of the first number that isn't its own bucket, less one.
GRID, EXACT_BITS = 64, 7
#: How many times as high the far end of a gap is, and how many of four documents are below it, at least.
GAP, GAP_QUARTERS = 64, 3


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (null: none)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = utf8(text).split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITESPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITESPACE)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        again = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                again[i : i + 3] = b"\1\1\1"
                again[j : j + 3] = b"\1\1\1"
        repeated = sum(again)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five base counts (columns of those names are replaced)."""
    docs = docs.drop(*BASE)
    schema = docs.select("*", *(F.lit(0).cast("long").alias(c) for c in BASE)).schema

    def measure(batches):
        for b in batches:
            k = b.schema.names.index(text)
            got = [base_counts(t.as_py()) for t in b.column(k)]
            cols = [pa.array(x, pa.int64()) for x in zip(*got, strict=True)] if got else [pa.array([], pa.int64())] * len(BASE)
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *BASE])

    return docs.mapInArrow(measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    per = lambda n: F.expr(f"1000 * {n} div greatest(n_words, 1)")
    return {"symbol_rate": per("n_symbols"), "dup_line_rate": per("n_dup_lines"), "repeat_rate": per("n_repeat_words"), "word_length": per("word_chars")}


def bucket(v: str) -> str:
    """SQL for the grid bucket of a non-negative integer; buckets keep the order of values."""
    e = f"(length(bin({v})) - {EXACT_BITS})"
    return f"case when {v} < {2 * GRID} then {v} else {GRID} * {e} + {v} div cast(pow(2, {e}) as bigint) end"


def bucket_low(b: str) -> str:
    """SQL for the least value of bucket b."""
    return f"case when {b} < {2 * GRID} then {b} else ({b} - {GRID} * ({b} div {GRID} - 1)) * cast(pow(2, {b} div {GRID} - 1) as bigint) end"


def sketches(measures_of: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: one mergeable sketch per language, source and measure."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures().items()))).alias("m")
    long = measures_of.filter(~base_failed()).select("lang", "source", pairs).select("lang", "source", "m.measure", "m.v")
    return long.groupBy("lang", "source", "measure", F.expr(bucket("v")).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, docs, above, and what fences are made of, each the end of a bucket.

    q10 and q50 are the low end of the 10th and the high end of the 50th hundredth of all values; p50 and
    p90 the low end of the 50th and the high end of the 90th of those above zero, ``above`` in number; gap
    is the middle, by ratio, of the first gap, null if there is none.
    """
    w = Window.partitionBy(*keys, "measure")
    run = sketch.withColumns({"low": F.expr(bucket_low("bucket")), "high": F.expr(f"{bucket_low('(bucket + 1)')} - 1")})
    run = run.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "docs": F.sum("n").over(w), "zeros": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(w), "under": F.lag("high").over(w.orderBy("bucket"))})
    at = lambda p, end: F.min(F.when(100 * F.col("upto") >= p * F.col("docs"), F.col(end)))
    above = lambda p, end: F.min(F.when((F.col("bucket") > 0) & (100 * (F.col("upto") - F.col("zeros")) >= p * (F.col("docs") - F.col("zeros"))), F.col(end)))
    apart = (1 + F.col("low") >= GAP * (1 + F.col("under"))) & (4 * (F.col("upto") - F.col("n")) >= GAP_QUARTERS * F.col("docs"))
    gap = F.min(F.when(apart, F.floor(F.sqrt(((1 + F.col("low")) * (1 + F.col("under"))).cast("double")))))
    return run.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), (F.max("docs") - F.max("zeros")).alias("above"), at(10, "low").alias("q10"), at(50, "high").alias("q50"), above(50, "low").alias("p50"), above(90, "high").alias("p90"), gap.alias("gap"))


def fences(sketch: DataFrame, *, min_docs: int = 50, min_above: int = 20, reach: int = 5) -> DataFrame:
    """lang, source and per measure the lowest and highest value that passes.

    The upper fence stands in the gap if there is one, else ``reach`` spreads beyond the median of the values above zero;
    the spread is the distance from there to their 90th hundredth.  Only word length has a lower fence, ``reach``
    distances from the median to the 10th hundredth below the median.  A group with fewer than ``min_docs`` documents,
    or ``min_above`` above zero, takes its language's sketch, and a language with fewer that of everything.  A
    measure that is zero everywhere has no fence.
    """
    pair, lang, whole = quantiles(sketch, "lang", "source"), quantiles(merged(sketch, "lang"), "lang"), quantiles(merged(sketch))
    a, b, c = pair.alias("a"), lang.alias("b"), whole.alias("c")
    both = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure"))).join(c, F.col("a.measure") == F.col("c.measure"))
    q = lambda x, n, least: F.when(F.col(f"a.{n}") >= least, F.col(f"a.{x}")).when(F.col(f"b.{n}") >= least, F.col(f"b.{x}")).otherwise(F.col(f"c.{x}")).alias(x)
    got = both.select("a.lang", "a.source", "a.measure", *(q(x, "docs", min_docs) for x in ("q10", "q50", "gap")), *(q(x, "above", min_above) for x in ("p50", "p90")))
    hi = F.coalesce("gap", F.col("p50") + reach * (F.col("p90") - F.col("p50")), F.lit(1 << 62))
    lo = F.when(F.col("measure") == "word_length", F.col("q50") - reach * (F.col("q50") - F.col("q10"))).otherwise(F.lit(0))
    got = got.select("lang", "source", "measure", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    one = lambda m, x: F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{x}_{m}")
    return got.groupBy("lang", "source").agg(*(one(m, x) for m in MEASURES for x in ("lo", "hi")))


def verdicts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", carry: tuple[str, ...] = ("doc_id",), min_docs: int = 50, reach: int = 5) -> DataFrame:
    """carry columns, the base counts, base_failed and kept, one row per row of docs.

    Nulls: a null text has no words and fails; null languages and sources are values of their own.
    Repeated rows are judged each on its own; an empty table gives an empty result.
    """
    d = measured(docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))).drop("text")
    d = cut(d.withColumn("base_failed", base_failed()))
    f = cut(fences(sketches(d), min_docs=min_docs, reach=reach))  # its size is known then, so that small fences are broadcast and large ones not
    within = F.lit(True)
    for m, v in measures().items():
        within = within & v.between(F.col(f"lo_{m}"), F.col(f"hi_{m}"))
    joined = d.alias("d").join(f.alias("f"), F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    return joined.select(*(F.col(f"d.c_{c}").alias(c) for c in carry), *BASE, "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 50, reach: int = 5) -> DataFrame:
    """The rows of docs that pass, unchanged and with all their columns, whatever these are called.

    Null and empty texts fail the base rules; repeated rows are judged each on its own and all stay or
    go; texts of any length are measured whole; an empty table gives an empty result.
    """
    bounds = [f"{x}_{m}" for m in MEASURES for x in ("lo", "hi")]
    docs, restored = aside(docs, *BASE, *bounds, "f_lang", "f_source")
    d = cut(measured(docs, text).filter(~base_failed()))  # measured once; the sketches are of these rows alone
    f = cut(fences(sketches(d.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *BASE)), min_docs=min_docs, reach=reach))
    within = F.lit(True)
    for m, v in measures().items():
        within = within & v.between(F.col(f"lo_{m}"), F.col(f"hi_{m}"))
    f = f.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = d.join(f, F.col(lang).eqNullSafe(F.col("f_lang")) & F.col(source).eqNullSafe(F.col("f_source")), "left")
    return restored(joined.filter(F.coalesce(within, F.lit(True))))
