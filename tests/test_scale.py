"""Steps that have to grow with their input: what common keys make, and what is sent whole."""

import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from graphquarry import queries as engine
from graphquarry import queries_logs  # noqa: F401  (adds its queries)
from graphquarry.functions import text
from graphquarry.operators import index, trace
from graphquarry.storage import by_measured_size, cut
from graphquarry.streaming import sessions


def test_edges_left_are_counted_without_making_them(spark):
    symbols = spark.createDataFrame([(1, "f1", "a"), (2, "f2", "a"), (3, "f2", "b"), (4, None, "b"), (5, "f1", "c")], "id long, file_id string, name string")
    calls = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 2, "b"), (4, 3, "a"), (5, 4, "none"), (6, None, "b"), (7, 4, None), (8, 3, "c")], "id long, caller_symbol_id long, callee_name string")
    edges = index.resolved_calls(calls, symbols).withColumn("source_file_id", F.lit(None).cast("string"))
    whole = symbols.withColumn("parent_symbol_id", F.lit(None).cast("long"))
    rel = {"files": symbols.select(F.col("file_id").alias("id")), "symbols": whole, "imports": symbols.select("id", "file_id"), "calls": calls, "edges": edges}
    for gone in ([("f1",)], [("f2",), ("f2",)], [], [("f1",), ("f2",)]):
        ids = spark.createDataFrame(gone, "file_id string")
        want = index.without_files(rel, ids)["edges"].agg(F.count("*"), F.sum("source_symbol_id")).first()
        got = index.resolved_left(calls, symbols, ids).agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("total")).first()
        assert tuple(got) == tuple(want)


def test_common_keys_are_dealt_over_many_tasks(spark):
    left = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") < 200, "hot").when(F.col("id") < 290, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    right = spark.range(250).select(F.col("id").alias("b"), F.when(F.col("id") < 150, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("key"))
    got = cut(index.meeting(left, right, "key", pairs=500).withColumn("task", F.spark_partition_id()))
    pairs = lambda df: sorted((r.a, r.b) for r in df.select("a", "b").collect())
    assert pairs(got) == pairs(left.join(right, "key"))
    assert got.groupBy("task").count().agg(F.max("count")).first()[0] < 6000 and got.select("task").distinct().count() > 20  # 30,000 are of one key
    assert index.meeting(left.limit(0), right, "key").count() == 0


def test_rows_that_meet_are_dealt_out_a_few_times_however_many_pairs_they_make(spark):
    side = lambda n, c: spark.range(n).select(F.col("id").alias(c), F.when(F.col("id") >= 0, "hot").alias("key"))
    got = index.meeting(side(3000, "a"), side(2000, "b"), "key", pairs=100)  # 60,000 cells of 100 pairs
    tasks = re.findall(r"hashpartitioning\(key#\d+, _i#\d+, _j#\d+, (\d+)\)", got._jdf.queryExecution().executedPlan().toString())
    assert tasks and all(int(n) <= 64 for n in tasks)
    assert got.count() == 3000 * 2000 and got.select(F.xxhash64("a", "b")).distinct().count() == 3000 * 2000


def test_pairs_in_files_take_little_more_than_their_rows(spark, tmp_path):
    files = spark.range(3000).select((F.col("id") * 7919 % 999_983).alias("id"), F.concat(F.when(F.col("id") % 3 == 0, "tests/test_").otherwise("src/"), F.col("id") % 2, F.lit(".py")).alias("path"), (F.col("id") % 3 == 0).alias("is_test"))
    imports = files.select(F.col("id").alias("file_id"), F.lit("src").alias("module"))
    for name, edges, n in (("name", index.test_edges_by_name(files), 1_000_000), ("import", index.test_edges_by_import(files, imports), 2_000_000)):
        edges.write.parquet(f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert back.count() == back.distinct().count() == n
        assert sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")) < 0.2 * n


def test_packs_of_unlike_sides_meet_like_rows(spark):
    left = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("a", None, "x"), ("b", 2, "y"), (None, 3, "z"), ("c", 4, "w")], "key string, n long, s string")
    right = spark.range(3000).select(F.when(F.col("id") % 50 > 0, "a").when(F.col("id") % 100 > 0, "b").alias("key"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("m"), (F.col("id") % 3).alias("k"))
    for r in (right, right.drop("k")):
        for pairs in (1, 500, index.PAIRS):
            rows = lambda df: sorted(map(str, df.select("key", "n", "s", *r.columns[1:]).collect()))
            assert rows(index.meeting(left, r, "key", pairs)) == rows(left.join(r, "key"))
            assert rows(index.meeting(r, left, "key", pairs)) == rows(left.join(r, "key"))


def test_tests_of_one_name_are_no_task_of_their_own(spark):
    files = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "tests/test_a.py").otherwise("src/a.py").alias("path"), (F.col("id") % 2 == 0).alias("is_test"))
    plan = index.test_edges_by_name(files)._jdf.queryExecution().executedPlan().toString()
    assert index.test_edges_by_name(files).count() == 200 * 200
    assert "_i" in plan and "REPARTITION_BY_NUM" in plan


def test_paths_that_many_files_have_are_searched_once(spark):
    files = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("tests/test_"), "id", F.lit(".py"))).when(F.col("id") % 3 == 1, "src/large/red.py").otherwise("src/small/red.py").alias("path"), (F.col("id") % 3 == 0).alias("is_test"))
    imports = files.select(F.col("id").alias("file_id"), F.when(F.col("id") % 2 == 0, "large.red").otherwise("src").alias("module"))
    edges = index.test_edges_by_import(files, imports)
    assert edges.count() == 50 * 100 + 50 * 200 and edges.distinct().count() == 50 * 100 + 50 * 200
    assert "REPARTITION_BY_NUM" in edges._jdf.queryExecution().executedPlan().toString()


def test_ages_without_days(spark):
    got = spark.createDataFrame([(59,), (3599,), (86399,), (86400,), (1_200_000,)], "s long").select(text.age(F.col("s"), days=False), text.age(F.col("s"))).collect()
    assert [r[0] for r in got] == ["59s ago", "59m ago", "23h ago", "24h ago", "333h ago"] and [r[1] for r in got][3:] == ["1d ago", "13d ago"]


def test_shown_texts_like_sql_where_keys_pass_a_day(spark, tmp_path):
    part = spark.range(86_390, 86_420).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(map(tuple, engine.QUERIES["shown_texts"](spark, str(tmp_path)).select("id", "reason", "age", "change").collect()))
    assert got == sorted(con.execute(engine.SQL["shown_texts"]).fetchall())


def test_names_give_a_seed_no_more_than_their_shares(spark):
    symbols = spark.range(600).select("id", F.concat(F.lit("n"), F.col("id") % 6).alias("name")).unionByName(spark.createDataFrame([(1000, "rare"), (-5, "rare")], "id long, name string"))
    calls = spark.range(90).select((F.col("id") % 15).alias("caller_symbol_id"), F.when(F.col("id") % 11 == 0, "rare").otherwise(F.concat(F.lit("n"), F.floor(F.col("id") / 7) % 6)).alias("callee_name"))
    seeds = symbols.select(F.col("id").alias("seed"))
    for most in (4, 10, 50):
        want = trace.first_steps(trace.traced(seeds, calls, symbols, hops=2), most)
        rows = lambda df: sorted(map(tuple, df.select("seed", "symbol_id", "depth", "step").collect()))
        assert rows(trace.first_traced(seeds, calls, symbols, most=most, hops=2)) == rows(want)


def test_callers_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    symbols = spark.range(60).select("id", (F.col("id") % 5).alias("file_id"), F.concat(F.lit("n"), F.col("id") % 4).alias("name"))
    calls = spark.range(800).select("id", (F.col("id") % 200).alias("caller_symbol_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("n"), F.floor(F.col("id") / 200).cast("int"))).alias("callee_name"))
    edges = index.resolved_calls(calls, symbols)
    want = sorted(map(str, edges.groupBy("source_symbol_id", "target_file_id", "target_name").agg(F.count("*").alias("n"), F.count_distinct("target_symbol_id").alias("n_targets")).collect()))
    monkeypatch.setattr(index, "TASK_CALLS", 20)
    got = cut(index.resolution_counts(calls, symbols).withColumn("task", F.spark_partition_id()))
    assert got.select("task").distinct().count() > 20 and sorted(map(str, got.drop("task").collect())) == want
    assert sorted(map(str, index.resolution_counts(calls, symbols, few=0).collect())) == want


def test_relations_are_not_sent_whole_by_their_files_size(spark, tmp_path):
    spark.range(50_000).write.parquet(f"{tmp_path}/a")
    spark.range(40_000).write.parquet(f"{tmp_path}/b")
    met = lambda s: s.read.parquet(f"{tmp_path}/a").join(s.read.parquet(f"{tmp_path}/b"), "id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    other = by_measured_size(spark)
    assert "BroadcastExchange" in plan(met(spark)) and "BroadcastExchange" not in plan(met(other))
    assert met(other).count() == 40_000
    assert all(other.conf.get(k) == spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir", "spark.sql.session.timeZone"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_questions_are_answered_by_measured_size(spark):
    df = engine.QUERIES["analyze_symbols"](spark, "/root/testdata/sf0.001")
    assert df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_only_a_little_is_sent_for_each_join(spark):
    s = by_measured_size(spark)
    side = lambda n: s.range(n).groupBy(F.xxhash64("id").alias("k")).agg(F.count("*").alias("n"))

    def joined(n):
        df = side(500_000).join(side(n).withColumnRenamed("n", "m"), "k")
        assert len(df.collect()) == n
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    assert "BroadcastHashJoin" in joined(100) and "BroadcastHashJoin" not in joined(300_000)  # some 3 MB


def test_questions_send_no_side_of_a_join(spark):
    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        done = spark._jsparkSession.sharedState().statusStore().executionsList()
        return [done.apply(i).physicalPlanDescription().split("== Initial Plan ==")[0] for i in range(done.size())]

    before = len(plans())
    assert engine.QUERIES["analyze_candidates"](spark, "/root/testdata/sf0.001").count() > 0
    made = [len(re.findall(r"BroadcastExchange \(\d+\)", p)) for p in plans()[before:]]
    assert len(made) > 5 and sum(made) <= 4  # synonyms and sizes of the index


def test_a_session_asks_for_its_state_once():
    calls = []

    class Last:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    budgets = sessions.SessionBudgets(None, False)
    budgets.last = Last()
    rows = pd.DataFrame({"ask_id": [2, 1], "kws": [["a"], ["a"]], "subsystems": [[], []], "output_hash": ["x", "y"]})
    got = pd.concat(budgets.handleInputRows(("s",), iter([rows]), None))
    assert list(got["budget"]) == ["full", "brief"] and calls == ["get", "update"]
