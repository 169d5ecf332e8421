"""Tracing calls from seed symbols, all seeds at once and a bounded number of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import MAX_DEPTH, MAX_TRACE_ROWS
from ..storage import cut

#: Names of seeds that one task follows, about.
TASK_NAMES = 200_000


def adjacency(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """caller, callee: distinct pairs of symbols where one calls the other's name."""
    named = symbols.select(F.col("name").alias("callee_name"), F.col("id").alias("callee"))
    return calls.select(F.col("caller_symbol_id").alias("caller"), "callee_name").distinct().join(named, "callee_name").select("caller", "callee").distinct()


def traced(seeds: DataFrame, calls: DataFrame, symbols: DataFrame, *, hops: int = MAX_DEPTH) -> DataFrame:
    """seed, symbol_id, depth: what each seed (column seed) reaches in 1 to ``hops`` calls, itself excepted.

    A symbol stands once for every depth at which it is reached.  A hop goes through names: callers
    to distinct names, then names to symbols, so a name that many share isn't multiplied by its
    callers; each hop's frontier is made distinct and cut before the next, so no hop is computed again.
    """
    by_caller = calls.select("caller_symbol_id", "callee_name").distinct()
    by_name = symbols.select(F.col("name").alias("callee_name"), F.col("id").alias("next"))
    frontier = seeds.select("seed", F.col("seed").alias("symbol_id")).distinct()
    out = None
    for depth in range(1, hops + 1):
        names = frontier.join(by_caller, F.col("symbol_id") == F.col("caller_symbol_id")).select("seed", "callee_name").distinct()
        frontier = cut(names.join(by_name, "callee_name").filter("next <> seed").select("seed", F.col("next").alias("symbol_id")).distinct())
        level = frontier.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
    return out


def first_traced(seeds: DataFrame, calls: DataFrame, symbols: DataFrame, *, most: int = MAX_TRACE_ROWS, hops: int = MAX_DEPTH, sizes: list[int] | None = None) -> DataFrame:
    """seed, symbol_id, depth, step: per seed the first ``most`` steps by depth and symbol, the same as first_steps(traced(...)).

    Steps are in order of depth, so a seed that has ``most`` of them goes no deeper, and one that goes on has
    fewer symbols than that: a hop starts from less than ``most`` symbols a seed, whatever they call.  Of a
    name's symbols the first ``most`` and one are enough (the seed itself doesn't count), and they are found
    once a hop for all seeds that come by the name.  Of m names with as many symbols, each one's share of
    them fills a seed, so what comes after the last of these shares is none of its steps and isn't made.
    Ends when no seed goes on.  Calls by caller and symbols by name are each joined where they lie, if they
    are laid out by these keys.  ``sizes`` gets the rows of each hop.
    """
    by_caller, by_name = calls.select("caller_symbol_id", "callee_name"), symbols.select(F.col("name").alias("callee_name"), F.col("id").alias("next"))
    frontier = seeds.select("seed", F.col("seed").alias("symbol_id"), F.lit(0).alias("so_far")).distinct()
    of_seed = Window.partitionBy("seed")
    out = None
    for depth in range(1, hops + 1):
        names = cut(frontier.join(by_caller, F.col("symbol_id") == F.col("caller_symbol_id")).select("seed", "so_far", "callee_name").distinct())
        nth = F.row_number().over(Window.partitionBy("callee_name").orderBy("next"))
        few = by_name.join(names.select("callee_name").distinct(), "callee_name", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= most + 1)
        firsts = cut(few.groupBy("callee_name").agg(F.array_sort(F.collect_list("next")).alias("firsts")))
        spread = names.repartition(max(1, -(-names.count() // TASK_NAMES)), "seed").join(firsts, "callee_name")
        full = F.when(F.size("firsts") > most, F.col("firsts"))
        share = F.ceil((most + 1) / F.count(full).over(of_seed)).cast("int")
        bounded = spread.withColumn("share", share).withColumn("last", F.max(F.get(full, F.col("share") - 1)).over(of_seed))
        met = bounded.select("seed", "so_far", "last", F.explode("firsts").alias("symbol_id")).filter("symbol_id <> seed and (last is null or symbol_id <= last)")
        met = met.select("seed", "so_far", "symbol_id").distinct()
        step = F.row_number().over(Window.partitionBy("seed").orderBy("symbol_id")) + F.col("so_far")
        level = cut(met.withColumn("step", step).filter(F.col("step") <= most).select("seed", "symbol_id", F.lit(depth).alias("depth"), "step"))
        out = level if out is None else out.unionByName(level)
        reached = level.groupBy("seed").agg(F.max("step").alias("so_far")).filter(F.col("so_far") < most)
        frontier = level.join(reached, "seed").select("seed", "symbol_id", "so_far")
        n = frontier.count()
        if sizes is not None:
            sizes.append(n)
        if not n:
            break
    return out


def first_steps(traced: DataFrame, most: int = MAX_TRACE_ROWS, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """Per seed the first ``most`` steps by depth and symbol."""
    w = Window.partitionBy(*by).orderBy("depth", "symbol_id")
    return traced.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= most)
