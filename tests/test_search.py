"""Searching by grams and by neighbourhoods against comparing all with all, and the plans they take."""

import random

import pytest
from pyspark.sql import functions as F

from graphquarry.functions import text
from graphquarry.operators import grams, retrieve

TERMS = ["ab", "a", "", "%", "_", "a_c", "ab%ca", "%abc", "__", "\\", "a\\b", "ABC", "abcab", "zzz", "é", "bé_a", "cab%", "a%%b", "c_b_a"]


def some_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcABC_%\\é") for _ in range(rng.randint(0, 9))) for _ in range(n)] + ["", "ab", "a%c", "a\\b", None]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(some_texts(300, 3))], "id long, x string")
    return rows, grams.distinct_texts(rows, "x")


@pytest.mark.parametrize("wild", [True, False])
@pytest.mark.parametrize("indexed", [0, 100_000, 40])
def test_containing_like_comparing_all(spark, texts, wild, indexed, tmp_path):
    rows, known = texts
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    where = known
    if indexed:
        grams.GramIndex.build(known, block_texts=indexed).write(str(tmp_path), "x")
        where = grams.GramIndex.read(spark, str(tmp_path), "x")
        assert where.postings.agg(F.max("block")).first()[0] == (0 if indexed > 1000 else known.count() // 40)
    got = {(r.term, r.value): r.n for r in grams.containing(terms, where, wild=wild).collect()}
    hit = text.like_anywhere(F.col("x"), F.col("term")) if wild else text.contains_ascii(F.col("x"), F.col("term"))
    want = rows.crossJoin(terms).filter(hit).groupBy("term", text.ascii_lower(F.col("x")).alias("value")).agg(F.count("*").alias("n"))
    assert got == {(r.term, r.value): r.n for r in want.collect()} and len({t for t, _ in got}) > 10


def test_one_edit_like_comparing_all(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(3, 8))) for _ in range(250)] + ["widget", "widgte", "wdget", "widgett", "", None]
    values = spark.createDataFrame([(w,) for w in words], "value string")
    terms = values.select(F.col("value").alias("term")).filter("term is not null").distinct()
    got = {(r.term, r.value) for r in retrieve.fuzzy(terms, values).collect()}
    want = terms.crossJoin(values.distinct()).filter(text.one_edit(F.col("value"), F.col("term")))
    assert got == {(r.term, r.value) for r in want.collect()} and len(got) > 50


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_no_search_meets_all_with_all(spark):
    terms = spark.createDataFrame([("ab",), ("c_d",)], "term string")
    files = spark.createDataFrame([(1, "a/b")], "id long, path string")
    symbols = spark.createDataFrame([(1, "abc", "sig")], "id long, name string, signature string")
    imports = spark.createDataFrame([(1, "m.ab")], "file_id long, module string")
    calls = spark.createDataFrame([(1, "abd")], "caller_symbol_id long, callee_name string")
    names = retrieve.indexed_names({"files": files, "symbols": symbols, "imports": imports, "calls": calls})
    for n in ({}, names):
        found = [
            retrieve.files_like(terms, files, n.get("path")),
            retrieve.symbols_like(terms, symbols, n.get("name")),
            retrieve.symbols_by_signature(terms, symbols, texts=n.get("signature")),
            retrieve.importing_files(terms, imports, texts=n.get("module")),
            retrieve.callers_like(terms, symbols, calls, texts=n.get("callee")),
            retrieve.hit_counts(terms, files, symbols, n),
            retrieve.fuzzy(terms, symbols.select(F.col("name").alias("value"))),
        ]
        for df in found:
            assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
    size = plan_of(retrieve.fuzzy(terms, symbols.select(F.col("name").alias("value"))))
    assert "size#" not in size.split("Physical Plan")[1]


def test_written_indexes_find_the_same(spark, tmp_path):
    rng = random.Random(6)
    name = lambda: "_".join(rng.choice(["load", "save", "user", "cache", "Token"]) for _ in range(rng.randint(1, 3)))
    symbols = spark.createDataFrame([(i, i % 9, name(), "function", f"def {name()}()") for i in range(200)], "id long, file_id long, name string, kind string, signature string")
    files = spark.createDataFrame([(i, f"src/{name()}.py") for i in range(60)], "id long, path string")
    imports = spark.createDataFrame([(i % 60, name()) for i in range(90)], "file_id long, module string")
    calls = spark.createDataFrame([(rng.randrange(200), name()) for _ in range(300)], "caller_symbol_id long, callee_name string")
    rel = {"files": files, "symbols": symbols, "imports": imports, "calls": calls}
    retrieve.write_names(retrieve.indexed_names(rel), str(tmp_path))
    names = retrieve.read_names(spark, str(tmp_path))
    kws = spark.createDataFrame([(1, "user", 0, False, "user", None, 2.0), (1, "chace", 1, False, "chace", None, 2.0), (2, "ve_us", 0, False, "ve_us", None, 1.0), (2, "toekn", 1, False, "toekn", None, 1.0)], "query_id long, kw string, ord int, is_synonym boolean, kw_stem string, search_stem string, idf double")
    plain = [sorted(map(str, df.collect())) for df in retrieve.candidates(kws, files, symbols, imports, calls)]
    assert [sorted(map(str, df.collect())) for df in retrieve.candidates(kws, files, symbols, imports, calls, names)] == plain
    assert all(plain)
    terms = kws.select(F.col("kw").alias("term"))
    assert sorted(retrieve.hit_counts(terms, files, symbols, names).collect()) == sorted(retrieve.hit_counts(terms, files, symbols).collect())
