"""Finding texts that contain a term, or are one edit from it, by equi-joins on pieces of them.

A text holds a term only if it holds every run of three characters of the term's literal pieces, so a
relation of such runs, or grams, to the texts that hold them names the few texts that have to be
compared.  Texts are distinct and in lower case (A-Z).  A text's grams are its runs of three, two and one
characters and the empty one; a term without a piece of three characters is looked up by its longest
piece, and one of wildcards alone by the empty gram, which names all texts.

An index may be built and written once (``GramIndex``): a row per gram and block of texts, with the
texts' hashes, probed by each term's rarest grams.  Without one, the texts' grams are joined with the
terms' on the fly; texts go through once and only those that hold all of a term's grams come out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vocab import MIN_FUZZY
from ..storage import cut

SIZE = 3
#: Of an index's postings: texts in a block, about; grams of a term that are probed.
BLOCK_TEXTS, PROBES = 100_000, 3


def _runs(c: Column, n: int) -> Column:
    """All runs of n characters, none if c is shorter."""
    at = F.sequence(F.lit(1), F.length(c) - (n - 1))
    return F.when(F.length(c) >= n, F.transform(at, lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def grams_of(c: Column) -> Column:
    """The grams of a text."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *(_runs(c, n) for n in range(1, SIZE + 1))))


def needed_grams(term: Column, *, wild: bool) -> Column:
    """Grams that a text must have to contain a term (in lower case); with wild, % and _ part it into pieces."""
    pieces = F.filter(F.split(term, "[%_]"), lambda p: p != "") if wild else F.array(term)
    long = F.filter(pieces, lambda p: F.length(p) >= SIZE)
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return F.when(F.size(long) > 0, F.array_distinct(F.flatten(F.transform(long, lambda p: _runs(p, SIZE))))).otherwise(F.array(F.coalesce(longest, F.lit(""))))


def distinct_texts(rows: DataFrame, column: str) -> DataFrame:
    """value, n: the distinct texts of a column in lower case, and how many rows have them; nulls left out."""
    return rows.filter(F.col(column).isNotNull()).groupBy(text.ascii_lower(F.col(column)).alias("value")).agg(F.count("*").alias("n"))


@dataclass
class GramIndex:
    """values: key, value, n; postings: gram, block, keys, n.  key is the hash of a value."""

    values: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, texts: DataFrame, *, block_texts: int = BLOCK_TEXTS) -> GramIndex:
        """The index of distinct texts (value, n), as relations still to be written."""
        values = cut(texts.select(F.xxhash64("value").alias("key"), "value", "n"))
        blocks = max(1, -(-values.count() // block_texts))
        rows = values.select("key", F.explode(grams_of(F.col("value"))).alias("gram"))
        lists = rows.groupBy("gram", F.pmod("key", F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
        return cls(values, lists.withColumn("n", F.size("keys").cast("long")))

    def write(self, folder: str, name: str) -> None:
        """Both relations below folder, postings in order of gram, so that a probe skips files and row groups."""
        self.values.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{folder}/values_{name}")
        self.postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{folder}/grams_{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str, name: str) -> GramIndex:
        values = spark.read.schema("key long, value string, n long").parquet(f"{folder}/values_{name}")
        return cls(values, spark.read.schema("gram string, block long, keys array<long>, n long").parquet(f"{folder}/grams_{name}"))

    def held(self, needed: DataFrame) -> DataFrame:
        """term, value, n of texts that have the rarest grams of needed (term, gram)."""
        frequent = self.postings.join(needed.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("held_by"))
        order = Window.partitionBy("term").orderBy(F.coalesce("held_by", F.lit(0)), "gram")
        rare = needed.join(frequent, "gram", "left").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= PROBES)
        rare = rare.withColumn("probes", F.count("*").over(Window.partitionBy("term"))).select("term", "gram", "probes")
        lists = rare.join(self.postings.select("gram", "block", "keys"), "gram").groupBy("term", "block", "probes").agg(F.collect_list("keys").alias("lists")).filter(F.size("lists") == F.col("probes"))
        both = F.aggregate(F.slice("lists", 2, PROBES), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        return lists.select("term", F.explode(both).alias("key")).join(self.values, "key").select("term", "value", "n")


def _held(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """term, value, n of texts (value, n) that have all grams of needed (term, gram): nothing but joins and counts."""
    need = needed.withColumn("grams", F.count("*").over(Window.partitionBy("term")))
    met = texts.select("value", "n", F.explode(grams_of(F.col("value"))).alias("gram")).join(need, "gram")
    return met.groupBy("term", "value", "n", "grams").agg(F.count("*").alias("met")).filter("met = grams").select("term", "value", "n")


def containing(terms: DataFrame, texts: DataFrame | GramIndex, *, wild: bool = True) -> DataFrame:
    """term, value, n: the texts (value, n, or their index) that hold a term (column term), without regard to ASCII case.

    With wild, a text is LIKE %term%; else every character of a term is itself.
    """
    known = terms.select("term").distinct()
    needed = known.select("term", F.explode(needed_grams(text.ascii_lower(F.col("term")), wild=wild)).alias("gram"))
    held = texts.held(needed) if isinstance(texts, GramIndex) else _held(texts, needed)
    return held.filter(text.like_anywhere(F.col("value"), F.col("term")) if wild else F.contains("value", text.ascii_lower(F.col("term"))))


# --- one edit apart


def neighbourhood(c: Column) -> Column:
    """Hashes of a word and of what is left when one of its characters goes; words one edit apart share one."""
    without = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    every = F.when(F.length(c) > 0, F.concat(F.array(c), without)).otherwise(F.array(c))
    return F.array_distinct(F.transform(every, lambda w: F.xxhash64(w)))


def neighbours(values: DataFrame) -> DataFrame:
    """hash, value: the neighbourhoods of distinct values (column value) long enough to be rescued; may be written once."""
    known = values.select("value").filter(F.octet_length("value") >= MIN_FUZZY).distinct()
    return known.select("value", F.explode(neighbourhood(F.col("value"))).alias("hash"))


def one_edit_apart(terms: DataFrame, near: DataFrame) -> DataFrame:
    """term, value: values of near (hash, value) that are one insertion, deletion, substitution or swap from a term."""
    asked = terms.select("term").filter(F.octet_length("term") >= MIN_FUZZY).distinct().select("term", F.explode(neighbourhood(F.col("term"))).alias("hash"))
    met = near.join(asked, "hash").select("term", "value").distinct()
    return met.filter(text.one_edit(F.col("value"), F.col("term")))
