"""What a session has already been told: similarity to its last question, and how much to say."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Share of common words and subsystems from which two questions are on one subject.
SAME_TOPIC = 0.35


def alike(a: Column, b: Column) -> Column:
    """Equal, or the shorter (four bytes at least) begins the longer."""
    shorter_first = lambda x, y: (F.octet_length(x) >= 4) & F.startswith(y, x)
    return (a == b) | F.when(F.octet_length(a) <= F.octet_length(b), shorter_first(a, b)).otherwise(shorter_first(b, a))


def fuzzy_jaccard(a: Column, b: Column) -> Column:
    """Shared words of two lists over all, where alike words are shared; two empty lists share nothing."""
    hit = lambda xs, ys: F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: alike(x, y))))
    common = (hit(a, b) + hit(b, a)) / F.lit(2.0)
    every = F.size(a) + F.size(b) - common
    return F.when(every > 0, common / every).otherwise(0.0)


def budget(kws: Column, subsystems: Column, last_kws: Column, last_subsystems: Column, output_hash: Column, last_hash: Column) -> Column:
    """skip for the same output again, brief on the same subject, else full; full without a last question."""
    by_words = fuzzy_jaccard(kws, last_kws)
    both = by_words * 0.7 + fuzzy_jaccard(subsystems, last_subsystems) * 0.3
    combined = F.when((F.size(subsystems) == 0) | (F.size(last_subsystems) == 0), by_words).otherwise(both)
    return F.when(last_kws.isNull(), "full").when(output_hash == last_hash, "skip").when(combined >= SAME_TOPIC, "brief").otherwise("full")


def budgets(asks: DataFrame, session: str, *order: str) -> DataFrame:
    """asks (session, kws, subsystems, output_hash) with the budget of each, against the one before it."""
    w = Window.partitionBy(session).orderBy(*order)
    last = {c: F.lag(c).over(w) for c in ("kws", "subsystems", "output_hash")}
    d = asks.withColumns({f"last_{c}": v for c, v in last.items()})
    return d.withColumn("budget", budget(*(F.col(c) for c in ("kws", "subsystems", "last_kws", "last_subsystems", "output_hash", "last_output_hash")))).drop("last_kws", "last_subsystems", "last_output_hash")


def output_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def save_last(state: DataFrame, path: str) -> None:
    """Write sessions' last questions (session, kws, subsystems, output_hash)."""
    state.write.mode("overwrite").parquet(path)


_STATE = "session string, kws array<string>, subsystems array<string>, output_hash string"


def load_last(spark: SparkSession, path: str) -> DataFrame:
    """Sessions' last questions as saved; none where nothing was."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], _STATE)
