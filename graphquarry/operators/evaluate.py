"""Evaluation: hit rates, paired comparisons and cache effects of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What cached input costs in parts of fresh input, and output in parts of input.
CACHE_READ, CACHE_WRITE, OUTPUT_RATIO = 0.1, 1.25, 5.0


def files_used(calls: DataFrame, productive: tuple[str, ...], prefix: str | None = None) -> DataFrame:
    """run, read, written: files read or edited but not written, and files written, as sorted arrays."""
    p = F.col("file_path") if prefix is None else F.ltrim(F.regexp_replace("file_path", f"^{prefix}", ""), F.lit("/"))
    c = calls.filter(F.col("file_path").isNotNull() & F.col("tool").isin(*productive)).select("run", "tool", p.alias("path"))
    written = F.collect_set(F.when(F.col("tool") == "Write", F.col("path")))
    read = F.collect_set(F.when(F.col("tool") != "Write", F.col("path")))
    return c.groupBy("run").agg(read.alias("r"), written.alias("w")).select("run", F.array_sort(F.array_except("r", "w")).alias("read"), F.array_sort("w").alias("written"))


def hit_rate(read: Column, suggested: Column) -> list[Column]:
    """n_hits, n_misses, n_unused, precision, recall (per cent, one decimal); nothing suggested or read is 0."""
    hits = F.size(F.array_intersect(read, suggested))
    rate = lambda n: F.when(n > 0, F.round(100.0 * hits / n, 1)).otherwise(0.0)
    return [hits.alias("n_hits"), F.size(F.array_except(read, suggested)).alias("n_misses"), F.size(F.array_except(suggested, read)).alias("n_unused"), rate(F.size(suggested)).alias("precision"), rate(F.size(read)).alias("recall")]


def rate_stats(rates: DataFrame, *by: str) -> DataFrame:
    """Mean and sample deviation (null for one run) of precision and recall."""
    dev = lambda c: F.when(F.count(c) > 1, F.stddev_samp(c))
    agg = [F.count("*").alias("n")] + [f.alias(f"{name}_{c}") for c in ("precision", "recall") for name, f in (("mean", F.avg(c)), ("dev", dev(c)))]
    return rates.groupBy(*by).agg(*agg)


def top_missed(misses: DataFrame, item: str, most: int = 10) -> DataFrame:
    """The most frequent items; ties by item."""
    return misses.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(most)


def relative(control: Column, treatment: Column) -> Column:
    """Per cent by which treatment differs; null where control is 0."""
    return F.when(control != 0, (treatment - control) * 100.0 / control)


def paired(runs: DataFrame, keys: list[str], side: str, control: str, treatment: str, value: str) -> DataFrame:
    """keys, control, treatment, delta_pct of keys that both sides have."""
    one = lambda s, name: runs.filter(F.col(side) == s).select(*keys, F.col(value).alias(name))
    return one(control, "control").join(one(treatment, "treatment"), keys).withColumn("delta_pct", relative(F.col("control"), F.col("treatment")))


def across_rounds(pairs: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, spread (largest less smallest; null for one)."""
    return pairs.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.max(value) - F.min(value)).alias("spread"))


def without_repeats(rows: DataFrame, key: list[str], order: list[str], same: list[str]) -> DataFrame:
    """rows less those equal in ``same`` to the row just before them."""
    w = Window.partitionBy(*key).orderBy(*order)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = rows.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", equal)
    return marked.filter(F.col("_first") | ~F.col("_same")).drop("_first", "_same")


def cache_effect(usage: DataFrame, key: str, order: str) -> DataFrame:
    """key and sums of a run's distinct calls, with its blended price factor, and the first call's cached share."""
    calls = without_repeats(usage, [key], [order], ["input_tokens", "cache_read", "cache_creation"])
    total = F.col("fresh") + F.col("cache_read") + F.col("cache_creation")
    first = F.min_by(F.struct("input_tokens", "cache_read", "cache_creation"), order)
    s = calls.groupBy(key).agg(F.count("*").alias("api_calls"), F.sum("input_tokens").alias("fresh"), F.sum("cache_read").alias("cache_read"), F.sum("cache_creation").alias("cache_creation"), first.alias("f"))
    f_total = F.col("f.input_tokens") + F.col("f.cache_read") + F.col("f.cache_creation")
    s = s.withColumn("total_input", total).withColumn("first_rate", F.when(f_total > 0, F.col("f.cache_read") / f_total)).drop("f")
    factor = F.when(total > 0, (F.col("fresh") + F.col("cache_read") * CACHE_READ + F.col("cache_creation") * CACHE_WRITE) / total).otherwise(1.0)
    return s.withColumn("discount_factor", factor)


def uncached_cost(total_input: Column, factor: Column, output_tokens: Column, cost: Column) -> Column:
    """What a run would have cost without a cache; its own cost where nothing was used."""
    paid = total_input * factor + output_tokens * OUTPUT_RATIO
    return F.when(paid > 0, (total_input + output_tokens * OUTPUT_RATIO) * (cost / paid)).otherwise(cost)


def reconciled(total_input: Column, reported: Column) -> Column:
    return F.abs(total_input - reported) < 100


def lopsided(pairs: DataFrame, control: str, treatment: str, threshold: float = 0.10) -> DataFrame:
    """Pairs whose first-call cache rates differ by more than the threshold."""
    return pairs.filter(F.abs(F.col(treatment) - F.col(control)) > threshold)


def turns_numbered(events: DataFrame, key: str, order: str, begins: Column) -> DataFrame:
    """events with turn_no: how many rows that begin a turn came so far."""
    return events.withColumn("turn_no", F.sum(F.when(begins, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def adjacent_repeats(schedule: DataFrame, order: str, category: str) -> DataFrame:
    """Rows of a schedule (a few dozen) whose category is that of the row before."""
    return schedule.withColumn("_last", F.lag(category).over(Window.orderBy(order))).filter(F.col("_last") == F.col(category)).drop("_last")


def interleaved(tasks: list[str], sides: tuple[str, ...] = ("without", "with"), *, seed: int = 1, tries: int = 200) -> list[tuple[str, str]]:
    """(task, side) in an order without neighbours of one task, if a seeded shuffle finds one; else by side and task."""
    import random

    pairs = [(t, s) for t in tasks for s in sides]
    rng = random.Random(seed)
    for _ in range(tries):
        rng.shuffle(pairs)
        if all(a[0] != b[0] for a, b in zip(pairs, pairs[1:])):
            return pairs
    return sorted(pairs, key=lambda p: (p[1], p[0]))
