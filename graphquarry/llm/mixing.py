"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sources get targets by weight; equal-token blocks go to the sources with the highest quotients
target / (2k + 1), and each source's blocks to its shards in the same way.  Within a shard the
documents lie on a line in seeded order, and a seeded stretch of that line (whole rounds, then a
stretch of blocks that wraps around) is what the mix takes.  The number of blocks is never listed:
a quota starts at the rounded share and only the few quotients around it are ranked, so the work
grows with the number of sources and shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, aside, cut

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def _number(digest: Column) -> Column:
    """The last 15 hex digits of a digest as an integer."""
    return F.conv(F.right(digest, F.lit(15)), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target: each source's share by weight, at most MOST times its size.

    Resharing the excess until none is above its cap ends where target = min(cap, level * weight);
    sources fill up in order of cap / weight, so one pass over that order finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.lit(weights[-1])
    for k in range(len(weights) - 1):
        pick = F.when((F.col("place") - 1) % len(weights) == k, weights[k]).otherwise(pick)
    s = by_source.withColumn("place", F.row_number().over(order)).withColumn("weight", pick)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"free": F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)), "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # the first source, in filling order, that its cap doesn't stop sets the level for itself and all after it
    s = s.withColumn("stopped", MOST * F.col("source_size") * F.col("open") <= F.col("free") * F.col("weight"))
    s = s.withColumn("level", F.first(F.when(~F.col("stopped"), F.struct("free", "open")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    level = F.when(F.col("stopped"), (MOST * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("level.free")).cast("double") / F.col("level.open"))
    return s.select("source", "source_size", "weight", "place", level.alias("target"))


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, capacity: str) -> DataFrame:
    """group, party, quota: Sainte-Lague seats; at most capacity each.

    At the divisor votes / seats, rounded shares miss the number of seats by half the parties at
    most, so the true quota of a party lies within its share of that of its rounded share; only
    those quotients are ranked.  Ties go to the lower party.
    """
    w = Window.partitionBy(*group)
    share = F.col("v") / F.col("all_v")
    p = parties.select(*group, F.col(party).alias("p"), F.col(votes).cast("double").alias("v"), F.col(seats).cast("long").alias("n"), F.col(capacity).cast("long").alias("cap"))
    p = p.withColumns({"all_v": F.sum("v").over(w), "m": F.count("*").over(w)})
    p = p.withColumn("near", F.when(F.col("all_v") > 0, F.floor(F.col("n") * share + 0.5)).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("reach", F.when(F.col("all_v") > 0, F.ceil(F.col("m") * share / 2)).otherwise(F.lit(0)).cast("long") + 2)
    p = p.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.col("near") - F.col("reach"))).withColumn("left", F.col("n") - F.sum("sure").over(w))
    offers = p.select("*", F.explode(F.sequence(F.col("sure"), F.col("near") + F.col("reach"))).alias("k"))
    rank = Window.partitionBy(*group).orderBy((F.col("v") / (2 * F.col("k") + 1)).desc(), "k", "p")
    won = offers.filter(F.col("v") > 0).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= F.col("left"))
    return won.groupBy(*group, "p").agg(F.count("*").alias("won"), F.first("sure").alias("sure"), F.first("cap").alias("cap")).select(*group, F.col("p").alias(party), F.least(F.col("sure") + F.col("won"), "cap").alias("quota"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, seed: int = 20, block: int | None = None, shard_words: int = 100_000, most_shards: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the carried columns), one row per row of docs.

    Null texts have size 0; null sources are one source, last in order; the mix is as large as docs.
    Rows that repeat an id, source and size are taken alike or in turn.  An empty table gives none.
    ``block`` is by default a hundred-thousandth of the words, at most 64.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text).cast("string")).alias("size"), *(F.col(c).alias(f"c_{c}") for c in carry))
    d = cut(d)
    by_source = targets(d, weights)
    total = F.sum("source_size").over(Window.partitionBy())
    size = F.lit(block).cast("long") if block else F.greatest(F.lit(1), F.least(F.lit(64), F.expr("total div 100000"))).cast("long")
    by_source = by_source.withColumn("total", total).withColumn("block", size).withColumn("zero", F.lit(0))
    by_source = by_source.withColumns({"seats": F.expr("total div block"), "room": F.expr(f"{MOST} * source_size div block"), "shards": F.expr(f"greatest(1, least({most_shards}, source_size div {shard_words}))")})
    quotas = apportion(by_source, ["zero"], "place", "target", "seats", "room").select("place", F.col("quota").alias("blocks"))
    by_source = cut(by_source.join(quotas, "place", "left").na.fill(0, ["blocks"]).drop("zero", "total", "seats", "room"))
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")).cast("binary"))
    facts = by_source.withColumnRenamed("source", "s")
    d = d.join(facts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("lot", lot).withColumn("shard", F.pmod(_number(F.col("lot")), F.col("shards")))
    sizes = d.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first("block").alias("block"))
    sizes = sizes.withColumn("room", F.expr(f"{MOST} * shard_size div block"))
    shard_quota = apportion(sizes, ["place"], "shard", "shard_size", "blocks", "room").withColumnsRenamed({"place": "q_place", "shard": "q_shard"})
    d = d.join(shard_quota, (F.col("place") == F.col("q_place")) & (F.col("shard") == F.col("q_shard")), "left").na.fill(0, ["quota"])
    line = Window.partitionBy("place", "shard").orderBy("lot", "doc_id", "size")
    at = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumns({"a": at, "long": F.sum("size").over(Window.partitionBy("place", "shard")), "tokens": F.col("quota") * F.col("block")})
    d = d.withColumns({"rounds": F.expr("coalesce(try_divide(tokens - tokens % nullif(long, 0), long), 0)").cast("long"), "rest": F.expr("coalesce(tokens % nullif(long, 0), 0)")})
    # the stretch starts at a seeded block and wraps around
    start = F.expr("coalesce(pmod(hash_of_shard, greatest(1, long div block)) * block, 0)")
    d = d.withColumn("hash_of_shard", _number(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("place").cast("string"), F.col("shard").cast("string")).cast("binary")))).withColumn("b", start)
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("a") + F.col("size"), hi) - F.greatest(F.col("a"), lo))
    end = F.col("b") + F.col("rest")
    stretch = overlap(F.col("b"), F.least(end, F.col("long"))) + overlap(F.lit(0), end - F.col("long"))
    taken = (F.col("rounds") * F.col("size") + stretch).cast("long")
    return d.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(F.col(f"c_{c}").alias(c) for c in carry))


def taken_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs of which the mix takes any words, with size, source_size, target and taken.

    Columns of docs of those names are replaced.  Texts are shuffled once, by a mark of id, text and
    source; rows alike in all three share what was taken of them in any order.
    """
    new = ("size", "source_size", "target", "taken")
    docs, restored = aside(docs.drop(*new), "row_mark", "nth", "m", "got", "mixed")
    marked = docs.withColumn("row_mark", F.xxhash64(doc_id, text, source))
    mixed = mix(marked, doc_id=doc_id, text=text, source=source, carry=("row_mark",), **options)
    per = mixed.groupBy(F.col("row_mark").alias("m")).agg(F.collect_list(F.struct(*new)).alias("mixed"))
    nth = F.row_number().over(Window.partitionBy("row_mark").orderBy(F.lit(1)))
    joined = marked.withColumn("nth", nth).join(per, F.col("row_mark") == F.col("m")).withColumn("got", F.element_at("mixed", F.col("nth")))
    taken = joined.filter("got.taken > 0")
    return restored(taken.withColumns({f"_{c}": F.col(f"got.{c}") for c in new}), *(F.col(f"_{c}").alias(c) for c in new))
