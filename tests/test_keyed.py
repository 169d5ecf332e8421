"""Layouts by key: what they give, and that plans read them where they lie; traces that stop early."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import keyed, trace
from graphquarry.plans import analyze


@pytest.fixture(scope="module")
def rel(spark):
    rng = random.Random(2)
    files = spark.createDataFrame([(i, f"src/f{i}.py", "python") for i in range(40)], "id long, path string, language string")
    symbols = spark.createDataFrame([(i, rng.randrange(40), f"n{rng.randrange(60)}", i) for i in range(400)], "id long, file_id long, name string, line_start long")
    imports = spark.createDataFrame([(i, rng.randrange(40), f"m{i}") for i in range(90)], "id long, file_id long, module string")
    calls = spark.createDataFrame([(i, rng.randrange(400), f"n{rng.randrange(70)}") for i in range(900)], "id long, caller_symbol_id long, callee_name string")
    edges = spark.createDataFrame([(i, rng.choice(["tests", "calls"]), rng.choice([None, *range(40)]), rng.randrange(40)) for i in range(200)], "id long, kind string, source_file_id long, target_file_id long")
    return {"files": files, "symbols": symbols, "imports": imports, "calls": calls, "edges": edges, "metadata": spark.createDataFrame([("head", "v1"), ("other", None)], "key string, value string")}


@pytest.fixture(scope="module")
def laid(spark, rel, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('keyed')}/k"
    keyed.write(rel, folder, buckets=8)
    spark.catalog.dropTempView("nothing")
    for t in spark.catalog.listTables():  # another session knows the folder only
        if t.name.startswith("keyed_"):
            spark.sql(f"DROP TABLE {t.name}")
    return keyed.Keyed.open(spark, folder)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_lookups_like_filters(rel, laid):
    same(laid.file(id=7), rel["files"].filter("id = 7"))
    same(laid.file(path="src/f9.py"), rel["files"].filter("path = 'src/f9.py'"))
    same(laid.metadata("head"), rel["metadata"].filter("key = 'head'"))
    some = rel["files"].filter("id < 5").select("id")
    same(laid.symbols_of(some), rel["symbols"].filter("file_id < 5"))
    same(laid.imports_of(some), rel["imports"].filter("file_id < 5"))
    same(laid.edges_to(some, "tests"), rel["edges"].filter("kind = 'tests' and target_file_id < 5"))
    same(laid.edges_from(some, "calls"), rel["edges"].filter("kind = 'calls' and source_file_id < 5"))
    same(laid.calls_of(rel["symbols"].filter("id in (3, 4)").select("id")), rel["calls"].filter("caller_symbol_id in (3, 4)"))
    same(laid.shown_file("src/f3.py"), analyze.shown_file(rel, "src/f3.py"))
    same(laid.shown_symbol("n5"), analyze.shown_symbol(rel, "n5"))
    assert laid.file(id=99).count() == laid.file(path="x").count() == 0


def ran(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("Initial Plan")[0]


def test_one_value_reads_one_bucket(laid):
    for df in (laid.file(id=7), laid.file(path="src/f9.py"), laid.metadata("head"), laid.one("symbols", "name", "n5"), laid.one("calls", "callee_name", "n5")):
        scan = df._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
        assert scan.optionalBucketSet().get().cardinality() == 1 and scan.relation().bucketSpec().get().numBuckets() == 8
        assert "Exchange" not in ran(df) and re.search(r"PushedFilters: \[.*EqualTo", ran(df))


@pytest.fixture
def unsent(spark):
    """No broadcasts, and more shuffle partitions than buckets."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def shuffled_scans(plan):
    """Names of tables that are shuffled as they are read, before any join."""
    found, above = set(), []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        above = [(d, x) for d, x in above if d < depth]
        m = re.search(r"FileScan parquet spark_catalog\.default\.(keyed_\w+)", line)
        kinds = [x for _, x in above if x]
        if m and kinds and kinds[-1] == "shuffle":
            found.add(m[1].split("_", 2)[2])
        above.append((depth, "join" if "Join" in line else "shuffle" if "Exchange" in line else ""))
    return found


def test_joins_shuffle_the_keys_only(spark, rel, laid, unsent):
    some = spark.createDataFrame([(i,) for i in range(5)], "id long")
    for df in (laid.symbols_of(some), laid.imports_of(some), laid.calls_of(some), laid.edges_to(some, "tests"), laid.edges_from(some, "calls")):
        assert "Bucketed: true" in ran(df) and shuffled_scans(ran(df)) == set()


def test_hops_read_layouts_where_they_lie(spark, rel, laid, unsent):
    plans, kept = [], trace.cut

    def seen(df):
        plans.append(ran(df))
        return kept(df)

    trace.cut = seen
    try:
        got = trace.first_traced(spark.createDataFrame([(1,), (2,)], "seed long"), laid.table("calls", "caller_symbol_id"), laid.table("symbols", "name"), hops=2)
    finally:
        trace.cut = kept
    assert sum("keyed_" in p for p in plans) == 4 and all(shuffled_scans(p) == set() for p in plans)
    same(got, trace.first_steps(trace.traced(spark.createDataFrame([(1,), (2,)], "seed long"), rel["calls"], rel["symbols"], hops=2)))


@pytest.mark.parametrize(("most", "hops"), [(50, 5), (3, 5), (1, 2), (1000, 3)])
def test_pruned_traces_like_whole_ones(spark, rel, most, hops):
    seeds = rel["symbols"].filter("id < 25").select(F.col("id").alias("seed"))
    sizes = []
    got = trace.first_traced(seeds, rel["calls"], rel["symbols"], most=most, hops=hops, sizes=sizes)
    whole = trace.traced(seeds, rel["calls"], rel["symbols"], hops=hops)
    same(got, trace.first_steps(whole, most))
    assert all(n < 25 * most for n in sizes)
    if most == 50:
        at = {r.depth: r.n for r in whole.groupBy("depth").agg(F.count("*").alias("n")).collect()}
        assert len(sizes) < hops and all(n < at[k + 1] for k, n in enumerate(sizes) if k)
