"""Reports over runs: hit rates of an analysis, comparisons of two sides, and what caches did to a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluate

#: Discount factors that differ by less are called alike.
ALIKE_FACTOR = 0.01


def side_means(runs: DataFrame, side: str, *by: str) -> DataFrame:
    """by, side, n, mean_total, mean_navigation, mean_productive, mean_files, navigation_pct.

    runs has a run a row with navigation, productive and files; the share is of all calls of the side,
    null without any.
    """
    total = F.col("navigation") + F.col("productive")
    means = [F.avg(v).alias(f"mean_{n}") for n, v in (("total", total), ("navigation", F.col("navigation")), ("productive", F.col("productive")), ("files", F.col("files")))]
    share = F.when(F.sum(total) > 0, F.sum("navigation") * 100.0 / F.sum(total))
    return runs.groupBy(*by, side).agg(F.count("*").alias("n"), *means, share.alias("navigation_pct"))


def task_report(runs: DataFrame, calls: DataFrame, *keys: str) -> DataFrame:
    """runs (with these keys) with total, navigation, productive and files: what their calls (keys, file_path, is_navigation) did.

    files counts the distinct paths that calls name; a run without calls has none of all.
    """
    n = lambda c: F.count_if(c)
    done = calls.groupBy(*keys).agg(F.count("*").alias("total"), n(F.col("is_navigation")).alias("navigation"), n(~F.col("is_navigation")).alias("productive"), F.count_distinct("file_path").alias("files"))
    return runs.join(done, list(keys), "left").na.fill(0, ["total", "navigation", "productive", "files"])


def run_report(calls: DataFrame, suggested: DataFrame, productive: tuple[str, ...], prefix: str | None = None) -> DataFrame:
    """run, read, written, suggested, n_hits, n_misses, n_unused, precision, recall, missed, created.

    calls are a log's tool calls (run, tool, file_path), suggested has run and an array of paths; created
    are files written that weren't suggested.  A run without suggestions has none of them hit.
    """
    none = F.expr("cast(array() as array<string>)")
    used = evaluate.files_used(calls, productive, prefix).join(suggested.select("run", "suggested"), "run", "left").withColumn("suggested", F.coalesce("suggested", none))
    return used.select("*", *evaluate.hit_rate(F.col("read"), F.col("suggested")), F.array_except("read", "suggested").alias("missed"), F.array_except("written", "suggested").alias("created"))


def report_summary(report: DataFrame, most_missed: int = 10, most_created: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Means and deviations over all runs, the files most often missed, and those most often created."""
    each = lambda c: report.select(F.explode(c).alias("path"))
    return evaluate.rate_stats(report), evaluate.top_missed(each("missed"), "path", most_missed), evaluate.top_missed(each("created"), "path", most_created)


def round_report(runs: DataFrame, keys: list[str], by: str, side: str, control: str, treatment: str, values: tuple[str, ...]) -> DataFrame:
    """by, value, n, mean, spread: how each value's change in per cent varies over rounds; pairs without a control are left out."""
    out = None
    for v in values:
        one = evaluate.across_rounds(evaluate.paired(runs, keys, side, control, treatment, v).filter("delta_pct is not null"), by, "delta_pct").withColumn("value", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return out


def factor_label(difference: Column) -> Column:
    """Which side's input was cheaper by its cache."""
    return F.when(difference > ALIKE_FACTOR, "control cached more").when(difference < -ALIKE_FACTOR, "treatment cached more").otherwise("alike")


def cache_report(runs: DataFrame, keys: list[str], side: str, control: str, treatment: str) -> DataFrame:
    """keys, reported_pct, uncached_pct, shift_pp, factor_difference, label, and seconds per call of both sides.

    runs has a run a row with cost, seconds, output_tokens and what cache_effect gives.  The shift is how
    many points of the reported change the caches made.
    """
    r = runs.withColumn("uncached", evaluate.uncached_cost(F.col("total_input"), F.col("discount_factor"), F.col("output_tokens"), F.col("cost")))
    r = r.withColumn("per_call", F.when(F.col("api_calls") > 0, F.col("seconds") / F.col("api_calls")))
    one = lambda s, p: r.filter(F.col(side) == s).select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("cost", "uncached", "discount_factor", "per_call")))
    j = one(control, "c").join(one(treatment, "t"), keys)
    j = j.withColumns({"reported_pct": evaluate.relative(F.col("c_cost"), F.col("t_cost")), "uncached_pct": evaluate.relative(F.col("c_uncached"), F.col("t_uncached")), "factor_difference": F.col("t_discount_factor") - F.col("c_discount_factor")})
    return j.select(*keys, "reported_pct", "uncached_pct", (F.col("reported_pct") - F.col("uncached_pct")).alias("shift_pp"), "factor_difference", factor_label(F.col("factor_difference")).alias("label"), F.col("c_per_call").alias("control_seconds_per_call"), F.col("t_per_call").alias("treatment_seconds_per_call"))
