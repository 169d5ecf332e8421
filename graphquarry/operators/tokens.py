"""Token cost: growth of a context turn by turn, and a simulated session with and without retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens of a system prompt and of an answer, seconds per call, prices per million.
SYSTEM_TOKENS, ANSWER_TOKENS, SECONDS_PER_CALL, INPUT_PRICE, OUTPUT_PRICE = 2000, 300, 2.5, 3.0, 15.0


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    return (input_tokens * INPUT_PRICE + output_tokens * OUTPUT_PRICE) / 1_000_000


def saving(without: Column, with_: Column) -> Column:
    """Per cent saved; 0 where there was nothing."""
    return F.when(without == 0, 0.0).otherwise((without - with_) * 100.0 / without)


def growing(turns: DataFrame, session: str, order: str, new: str, system: int = SYSTEM_TOKENS) -> DataFrame:
    """turns with turn_input: the system prompt, all new tokens so far, and an answer per turn before."""
    w = Window.partitionBy(session).orderBy(order)
    so_far = F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("turn_input", so_far + system + (F.row_number().over(w) - 1) * ANSWER_TOKENS)


def session_totals(turns: DataFrame, session: str, order: str, new: str, system: int = SYSTEM_TOKENS) -> DataFrame:
    """session, input_tokens, output_tokens, turns."""
    return growing(turns, session, order, new, system).groupBy(session).agg(F.sum("turn_input").alias("input_tokens"), (F.count("*") * ANSWER_TOKENS).alias("output_tokens"), F.count("*").alias("turns"))


def chunked(rows: DataFrame, key: str, order: str, size: int = 3) -> DataFrame:
    """rows with chunk: consecutive rows of a key, ``size`` to a chunk."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))


def dir_depth(paths: DataFrame) -> DataFrame:
    """depth: the most directories above a file."""
    return paths.agg(F.coalesce(F.max(F.size(F.split("path", "/")) - 1), F.lit(0)).alias("depth"))


def simulated(asks: DataFrame, relevant: DataFrame, others: DataFrame, targeted: DataFrame, totals: DataFrame) -> DataFrame:
    """Tokens, calls and seconds of a session without and with retrieval, per question.

    asks: query_id, n_keywords, n_symbols, context_tokens; relevant: query_id, file_id, tokens of the
    result's files; others: query_id, file_id, tokens of code files that match a keyword but aren't in
    the result; targeted: query_id, file_id, tokens of files read first with retrieval; totals: one
    row n_files, depth.  Files are taken in order of id.
    """
    a = asks.crossJoin(F.broadcast(totals))
    n_relevant = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    a = a.join(n_relevant, "query_id", "left").na.fill(0, ["n_relevant"])
    globs, greps = F.least(F.lit(2) + F.col("n_keywords"), F.lit(5)), F.least("n_keywords", F.lit(3))
    explore = a.select("query_id", F.lit(-3).alias("turn"), (globs * (F.lit(50) + F.col("depth") * 15)).alias("new"), globs.alias("calls"))
    grep = a.filter("n_keywords > 0").select("query_id", F.lit(-2).alias("turn"), (greps * (F.lit(80) + F.col("n_symbols") * 15)).alias("new"), greps.alias("calls"))
    wrong = F.greatest(F.lit(1), (F.col("n_relevant") * F.least(F.lit(0.15) + F.col("n_files") / 2000, F.lit(0.4))).cast("int"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("file_id"))
    misread = others.withColumn("nth", nth).join(a.select("query_id", wrong.alias("wrong")), "query_id").filter("nth <= wrong")
    misread = misread.groupBy("query_id").agg(F.lit(-1).alias("turn"), F.sum("tokens").alias("new"), F.count("*").alias("calls"))
    read = chunked(relevant, "query_id", "file_id").groupBy("query_id", F.col("chunk").alias("turn")).agg(F.sum("tokens").alias("new"), F.count("*").alias("calls"))
    without = explore.unionByName(grep).unionByName(misread).unionByName(read)
    first = targeted.withColumn("nth", nth).filter("nth <= 15").groupBy("query_id").agg(F.sum("tokens").alias("new"), F.count("*").alias("with_calls"))
    calls = without.groupBy("query_id").agg(F.sum("calls").alias("without_calls"))
    w = session_totals(without, "query_id", "turn", "new").select("query_id", F.col("input_tokens").alias("without_input"), F.col("output_tokens").alias("without_output"))
    out = a.join(w, "query_id").join(calls, "query_id").join(first, "query_id", "left").na.fill(0, ["new", "with_calls"])
    with_input = F.lit(SYSTEM_TOKENS) + F.col("context_tokens") + F.col("new")
    return out.select(
        "query_id",
        "without_input",
        "without_output",
        "without_calls",
        (F.col("without_calls") * SECONDS_PER_CALL).alias("without_seconds"),
        with_input.alias("with_input"),
        F.lit(ANSWER_TOKENS).alias("with_output"),
        "with_calls",
        (F.col("with_calls") * SECONDS_PER_CALL).alias("with_seconds"),
        F.round(saving(F.col("without_input") + F.col("without_output"), with_input + ANSWER_TOKENS), 6).alias("saving_pct"),
        F.round(cost(F.col("without_input"), F.col("without_output")), 6).alias("without_cost"),
        F.round(cost(with_input, F.lit(ANSWER_TOKENS)), 6).alias("with_cost"),
    )
