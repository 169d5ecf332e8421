"""Scores and ranks of candidates, per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..functions.stem import stem_of, stems
from ..functions.vocab import MAX_FILES, MAX_SYMBOLS, MAX_TRACED, MIN_FILE_SCORE, MIN_SYMBOL_SCORE


def symbol_scores(cands: DataFrame, kws: DataFrame, file_scores: DataFrame) -> DataFrame:
    """query_id, symbol_id, ord, score: sum over keywords, bonus by kind, and what a bad file takes off.

    cands has query_id, symbol_id, ord, name, kind, file_id; kws query_id, kw, kw_stem, idf.
    """
    c = cands.withColumn("low", F.lower("name"))
    c = c.withColumn("name_stem", stem_of(F.col("low")))
    each = scoring.truncated(scoring.symbol_base(F.col("low"), F.col("name_stem"), F.col("kw"), F.col("kw_stem")), F.col("idf"))
    sums = c.join(kws, "query_id").groupBy("query_id", "symbol_id").agg(F.sum(each).alias("by_words"))
    bad = file_scores.select("query_id", "file_id", F.least(F.col("score"), F.lit(0)).alias("bad"))
    out = cands.join(sums, ["query_id", "symbol_id"]).join(bad, ["query_id", "file_id"], "left")
    return out.withColumn("score", (F.col("by_words") + scoring.kind_bonus(F.col("kind")) + F.coalesce("bad", F.lit(0))).cast("int")).drop("by_words", "bad")


def file_scores(cands: DataFrame, kws: DataFrame, about_tests: DataFrame, symbol_counts: DataFrame | None = None) -> DataFrame:
    """cands with score: words in name and path, several words at once, the file's quality, and its symbols.

    cands has query_id, file_id, path, language, size, line_count, is_test; about_tests query_id and
    about_tests; symbol_counts query_id, file_id, n.  Of files that share a name, the third and
    later ones get half.
    """
    low = F.lower("path")
    c = cands.select("query_id", "file_id", low.alias("low"), paths.stem(low).alias("stem"), paths.stem_parts(low).alias("parts"))
    c = c.withColumn("part_stems", stems(F.col("parts")))
    j = c.join(kws, "query_id").withColumn("rung", scoring.file_rung(F.col("low"), F.col("stem"), F.col("part_stems"), F.col("kw"), F.col("kw_stem")))
    hits = F.count_if(F.col("rung").between(1, 3) & ~F.col("is_synonym"))
    words = j.groupBy("query_id", "file_id").agg((F.sum(scoring.truncated(scoring.file_base(F.col("rung")), F.col("idf"))) + F.greatest(F.lit(0), hits - 1) * 30).alias("by_words"))
    out = cands.join(words, ["query_id", "file_id"]).join(about_tests, "query_id")
    boost = F.lit(0)
    if symbol_counts is not None:
        out = out.join(symbol_counts.withColumnRenamed("n", "hosted"), ["query_id", "file_id"], "left")
        boost = F.coalesce("hosted", F.lit(0)) * 15
    score = F.col("by_words") + paths.quality(F.col("path"), F.col("size"), F.col("line_count"), F.col("language"), F.col("is_test")) + boost
    score = score + F.when(F.col("is_test") & ~F.col("about_tests"), -25).otherwise(0) + F.when(paths.is_generated(F.col("path")), -40).otherwise(0)
    return same_name_halved(out.withColumn("score", score.cast("int"))).select(*cands.columns, "score")


def same_name_halved(scored: DataFrame) -> DataFrame:
    """score halved for the third and later file of a name, in order of score and path."""
    nth = F.row_number().over(Window.partitionBy("query_id", paths.basename(F.col("path"))).orderBy(F.desc("score"), "path"))
    return scored.withColumn("_nth", nth).withColumn("score", F.when(F.col("_nth") > 2, scoring.halved(F.col("score"))).otherwise(F.col("score"))).drop("_nth")


def best(scored: DataFrame, least: int, most: int, *ties: str) -> DataFrame:
    """scored with rank: those at or above the cutoff, the first ``most`` of each question."""
    w = Window.partitionBy("query_id")
    top = scored.withColumn("_cut", scoring.cutoff(F.max("score").over(w), least)).filter("score >= _cut").drop("_cut")
    return top.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), *ties))).filter(F.col("rank") <= most)


def best_symbols(scored: DataFrame) -> DataFrame:
    return best(scored, MIN_SYMBOL_SCORE, MAX_SYMBOLS, "name", "ord")


def best_files(scored: DataFrame) -> DataFrame:
    return best(scored, MIN_FILE_SCORE, MAX_FILES, "path")


def seeds(symbols: DataFrame) -> DataFrame:
    """The ranked symbols from which calls are traced."""
    return symbols.filter(F.col("rank") <= MAX_TRACED)


def relevance(counts: DataFrame) -> DataFrame:
    """counts (n_files, n_symbols, n_steps, n_tests) with the score of a repository."""
    return counts.withColumn("score", F.expr("10 * n_files + 5 * n_symbols + n_steps + 3 * n_tests"))


def best_repositories(scored: DataFrame, share: float = 0.3) -> DataFrame:
    """scored (query_id, repo, score, n_files, n_symbols, ord) with kept and rank; empty ones are gone."""
    w = Window.partitionBy("query_id")
    s = scored.filter("n_files > 0 or n_symbols > 0").withColumn("kept", F.col("score") >= (F.max("score").over(w) * share).cast("int"))
    return s.withColumn("rank", F.when(F.col("kept"), F.row_number().over(Window.partitionBy("query_id", "kept").orderBy(F.desc("score"), "ord"))))
