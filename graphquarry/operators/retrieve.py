"""Retrieval: keywords with weights, the search channels, typo rescue and candidates, for many questions at once.

Frames of questions carry query_id; terms carry their place, so first hits keep their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.scoring import idf
from ..functions.stem import stem_of
from ..functions.vocab import FEW_FILES, MAX_HITS, MIN_FUZZY, MIN_PART, MIN_STEM, SPECIFIC_RATIO, STOP_RATIO, STOP_WORDS, SYNONYM_FACTOR, SYNONYMS
from ..storage import cut
from .grams import GramIndex, containing, distinct_texts, neighbours, one_edit_apart

#: Relations' columns that are searched for terms, by the name of their index.
SEARCHED = {"path": ("files", "path"), "name": ("symbols", "name"), "signature": ("symbols", "signature"), "module": ("imports", "module"), "callee": ("calls", "callee_name")}
Names = dict[str, GramIndex]


def matched(rows: DataFrame, column: str, terms: DataFrame, texts: GramIndex | None = None, *, wild: bool = True) -> DataFrame:
    """term and rows' columns: the rows whose column contains a term; found by grams, of an index if one is given."""
    hits = containing(terms, texts or distinct_texts(rows, column), wild=wild).select("term", "value")
    return rows.join(hits, text.ascii_lower(F.col(column)) == F.col("value")).drop("value")


def indexed_names(rel: dict[str, DataFrame]) -> Names:
    """Gram indexes of all searched columns of the relations."""
    return {name: GramIndex.build(distinct_texts(rel[t], c)) for name, (t, c) in SEARCHED.items()}


def write_names(names: Names, folder: str) -> None:
    for name, texts in names.items():
        texts.write(folder, name)


def read_names(spark: SparkSession, folder: str) -> Names:
    return {name: GramIndex.read(spark, folder, name) for name in SEARCHED}


def synonym_table(spark: SparkSession) -> DataFrame:
    """kw, synonym, rank: members of the same cluster, in the clusters' order."""
    rows = [(a, b, 100 * c + k) for c, cluster in enumerate(SYNONYMS) for a in cluster for k, b in enumerate(cluster) if a != b]
    return spark.createDataFrame(rows, "kw string, synonym string, rank int")


def with_synonyms(kws: DataFrame) -> DataFrame:
    """query_id, kw, ord, is_synonym from query_id, kw, ord: originals, then what their clusters add, first come first."""
    own = kws.select("query_id", "kw", "ord", F.lit(False).alias("is_synonym"))
    added = kws.join(F.broadcast(synonym_table(kws.sparkSession)), "kw").select("query_id", F.col("synonym").alias("kw"), (F.lit(1_000_000) + F.col("ord") * 10_000 + F.col("rank")).alias("ord"))
    added = added.groupBy("query_id", "kw").agg(F.min("ord").alias("ord")).join(kws.select("query_id", "kw"), ["query_id", "kw"], "left_anti").withColumn("is_synonym", F.lit(True))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord")) - 1
    return own.unionByName(added).withColumn("ord", place)


def keyword_rows(asks: DataFrame) -> DataFrame:
    """query_id, kw, ord from query_id, ask."""
    return asks.select("query_id", F.posexplode(text.keywords(F.col("ask"))).alias("ord", "kw"))


def _apart(df: DataFrame) -> list[str]:
    """The column that keeps repositories apart, where a relation has one."""
    return ["repo"] if "repo" in df.columns else []


def hit_counts(terms: DataFrame, files: DataFrame, symbols: DataFrame, names: Names | None = None) -> DataFrame:
    """term, file_hits, symbol_hits of distinct terms: how many paths and names hold them, all terms at once.

    Relations of several repositories have a column repo; then terms and counts are each repository's own.
    """
    names, on = names or {}, _apart(files)
    known = cut(terms.select(*on, "term").distinct())

    def hits(rows: DataFrame, column: str, name: str, as_: str) -> DataFrame:
        found = containing(known, names.get(name) or distinct_texts(rows, column), wild=False)
        if not on:
            return found.groupBy("term").agg(F.sum("n").alias(as_))
        values = rows.select("repo", text.ascii_lower(F.col(column)).alias("value"))
        return values.join(found, "value").groupBy("repo", "term").agg(F.count("*").alias(as_))

    f, s = hits(files, "path", "path", "file_hits"), hits(symbols, "name", "name", "symbol_hits")
    return known.join(f, [*on, "term"], "left").join(s, [*on, "term"], "left").na.fill(0, ["file_hits", "symbol_hits"])


def weighted(kws: DataFrame, files: DataFrame, symbols: DataFrame, names: Names | None = None) -> DataFrame:
    """query_id, kw, ord, is_synonym, kw_stem, idf of the keywords that aren't too common, for questions specific enough.

    Below FEW_FILES files nothing is filtered.  A keyword counts as rare by its own hits or by its
    stem's, whichever are more.  Of several repositories, query_id is a struct of repo and query_id.
    """
    on = _apart(files)
    k = kws.withColumn("kw_stem", stem_of(F.col("kw"))).withColumn("search_stem", F.when((F.col("kw_stem") != F.col("kw")) & (F.octet_length("kw_stem") >= MIN_STEM), F.col("kw_stem")))
    k = k.withColumn("repo", F.col("query_id.repo")) if on else k
    terms = k.select(*on, F.explode(F.array_distinct(F.array_compact(F.array("kw", "search_stem")))).alias("term"))
    hits = hit_counts(terms, files, symbols, names)
    own = hits.toDF(*on, "kw", "fh", "sh")
    by_stem = hits.toDF(*on, "search_stem", "sfh", "ssh")
    j = k.join(own, [*on, "kw"]).join(by_stem, [*on, "search_stem"], "left")
    n_files, n_symbols = files.groupBy(*on).agg(F.count("*").alias("n_files")), symbols.groupBy(*on).agg(F.greatest(F.count("*"), F.lit(1)).alias("n_symbols"))
    if on:
        j = j.join(n_files.join(n_symbols, on, "left").na.fill(1, ["n_symbols"]), on)
    else:
        j = j.crossJoin(F.broadcast(n_files.crossJoin(n_symbols)))
    few = F.col("n_files") < FEW_FILES
    f_ratio, s_ratio = F.col("fh") / F.col("n_files"), F.col("sh") / F.col("n_symbols")
    weight = idf(F.col("n_files"), F.greatest("fh", F.coalesce("sfh", F.lit(0))), F.col("n_symbols"), F.greatest("sh", F.coalesce("ssh", F.lit(0))), F.col("is_synonym"))
    flat = F.when(F.col("is_synonym"), SYNONYM_FACTOR).otherwise(1.0)
    j = j.filter(few | ((f_ratio < STOP_RATIO) & (s_ratio < STOP_RATIO))).withColumn("idf", F.when(few, flat).otherwise(weight))
    j = j.withColumn("specific", few | (~F.col("is_synonym") & ((f_ratio < SPECIFIC_RATIO) | (s_ratio < SPECIFIC_RATIO))))
    j = j.withColumn("any_specific", F.bool_or("specific").over(Window.partitionBy("query_id")))
    return j.filter("any_specific").select("query_id", "kw", "ord", "is_synonym", "kw_stem", "search_stem", "idf")


def search_terms(kws: DataFrame) -> DataFrame:
    """query_id, term, term_ord: keywords and their stems, each once, stems after their words."""
    pair = F.array(F.struct(F.col("kw").alias("term"), (F.col("ord") * 2).alias("o")), F.struct(F.when(~F.col("search_stem").isin(*STOP_WORDS), F.col("search_stem")).alias("term"), (F.col("ord") * 2 + 1).alias("o")))
    return kws.select("query_id", F.explode(pair).alias("t")).filter("t.term is not null").groupBy("query_id", F.col("t.term").alias("term")).agg(F.min("t.o").alias("term_ord"))


def _first_hits(df: DataFrame, most: int | None = MAX_HITS) -> DataFrame:
    """Per term (and repository) the hits of least id."""
    if most is None:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*_apart(df), "term").orderBy("id"))).filter(F.col("_r") <= most).drop("_r")


def files_like(terms: DataFrame, files: DataFrame, texts: GramIndex | None = None) -> DataFrame:
    """term, id: files whose path is LIKE the term."""
    return matched(files.select("id", "path", *_apart(files)), "path", terms, texts).select("term", "id", *_apart(files))


def symbols_like(terms: DataFrame, symbols: DataFrame, texts: GramIndex | None = None) -> DataFrame:
    """term, id: symbols whose name is LIKE the term."""
    return matched(symbols.select("id", "name", *_apart(symbols)), "name", terms, texts).select("term", "id", *_apart(symbols))


def symbols_by_signature(terms: DataFrame, symbols: DataFrame, most: int = MAX_HITS, texts: GramIndex | None = None) -> DataFrame:
    """term, id: symbols whose signature is LIKE the term and whose name isn't; the first by id."""
    hits = matched(symbols.select("id", "name", "signature", *_apart(symbols)), "signature", terms, texts)
    return _first_hits(hits.filter(~text.like_anywhere(F.col("name"), F.col("term"))).select("term", "id", *_apart(symbols)), most)


def importing_files(terms: DataFrame, imports: DataFrame, most: int = MAX_HITS, texts: GramIndex | None = None) -> DataFrame:
    """term, id: distinct files that import a module LIKE the term; the first by id."""
    hits = matched(imports.select("file_id", "module", *_apart(imports)), "module", terms, texts)
    return _first_hits(hits.select("term", F.col("file_id").alias("id"), *_apart(imports)).distinct(), most)


def callers_like(terms: DataFrame, symbols: DataFrame, calls: DataFrame, most: int = MAX_HITS, texts: GramIndex | None = None) -> DataFrame:
    """term, id: symbols that call a name LIKE the term and aren't so named themselves; the first by id."""
    who = matched(calls.select("caller_symbol_id", "callee_name"), "callee_name", terms, texts).select("term", F.col("caller_symbol_id").alias("id")).distinct()
    hits = who.join(symbols.select("id", "name", *_apart(symbols)), "id").filter(~text.like_anywhere(F.col("name"), F.col("term")))
    return _first_hits(hits.select("term", "id", *_apart(symbols)), most)


def callers_of(names: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """name, id: distinct symbols that call exactly a name."""
    return calls.join(names, F.col("callee_name") == F.col("called")).select("called", F.col("caller_symbol_id").alias("id")).distinct().join(symbols, "id")


def fuzzy(terms: DataFrame, values: DataFrame) -> DataFrame:
    """term, value: distinct values (column value) one edit from a term, met by the hashes of their neighbourhoods."""
    return one_edit_apart(terms, neighbours(values))


def candidates(kws: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, names: Names | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, file_id, ord) and (query_id, symbol_id, ord): all channels' hits, first come first, and rescued typos.

    If the relations have a column repo, so has query_id, and each question meets its own repository only.
    """
    names, on = names or {}, _apart(files)
    st = search_terms(kws)
    st = cut(st.withColumn("repo", F.col("query_id.repo")) if on else st)
    terms = cut(st.select("term").distinct())
    long = terms.filter(F.octet_length("term") >= MIN_PART)
    of = lambda hits, channel: hits.withColumn("channel", F.lit(channel))
    f_hits = of(files_like(terms, files, names.get("path")), 0).unionByName(of(importing_files(terms, imports, texts=names.get("module")), 4))
    s_hits = of(symbols_like(terms, symbols, names.get("name")), 1).unionByName(of(symbols_by_signature(long, symbols, texts=names.get("signature")), 2)).unionByName(of(callers_like(long, symbols, calls, texts=names.get("callee")), 3))
    order = F.struct("term_ord", "channel", "id")
    ranked = lambda h: h.join(st, [*on, "term"]).groupBy("query_id", "id").agg(F.min(order).alias("ord"))
    f, s = cut(ranked(f_hits)), cut(ranked(s_hits))
    # a keyword is rescued if no row came with it first, and nothing imports it
    first = f.select("query_id", "ord.term_ord").unionByName(s.select("query_id", "ord.term_ord")).unionByName(f_hits.filter("channel = 4").join(st, [*on, "term"]).select("query_id", "term_ord")).distinct()
    lost = cut(st.join(first, ["query_id", "term_ord"], "left_anti").join(kws.select("query_id", F.col("kw").alias("term")), ["query_id", "term"], "left_semi").filter(F.octet_length("term") >= MIN_FUZZY))
    lost_terms = lost.select("term").distinct()
    called = symbols.select("id", *on, F.lower("name").alias("value"))
    s_more = fuzzy(lost_terms, called).join(called, "value").select("term", "id", *on)
    low = F.lower("path")
    parts = files.select("id", *on, F.explode(F.array_union(F.array(paths.stem(low)), paths.stem_parts(low))).alias("value"))
    f_more = fuzzy(lost_terms, parts).join(parts, "value").select("term", "id", *on).distinct()
    late = lambda h: h.join(lost, [*on, "term"]).select("query_id", "id", F.struct(F.lit(1 << 30).alias("term_ord"), F.lit(9).alias("channel"), F.col("id")).alias("ord")).distinct()
    keep = lambda a, b: a.unionByName(b).groupBy("query_id", "id").agg(F.min("ord").alias("ord"))
    return keep(f, late(f_more)).withColumnRenamed("id", "file_id"), keep(s, late(s_more)).withColumnRenamed("id", "symbol_id")
