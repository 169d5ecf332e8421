"""Relations, questions, sessions, costs and evaluation."""

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import context, evaluate, index, rank, retrieve, session, tokens, trace
from graphquarry.plans import analyze
from graphquarry.sources import tree
from graphquarry.streaming import sessions

APP = {
    "models.py": "class User:\n    def find(self, name):\n        return lookup(name)\n\n\nclass Session:\n    def create(self, user):\n        return user\n",
    "services.py": "from models import User, Session\n\n\ndef authenticate_user(name, password):\n    user = User().find(name)\n    if not user:\n        raise ValueError(name)\n    return Session().create(user)\n",
    "routes.py": "from services import authenticate_user\n\n\ndef login_handler(request):\n    return authenticate_user(request.name, request.password)\n\n\ndef health_check():\n    return 'ok'\n",
    "tests/test_services.py": "from services import authenticate_user\n\n\ndef test_authenticate_user():\n    assert authenticate_user('a', 'b')\n",
}


def write(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


@pytest.fixture(scope="module")
def app(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("app")
    write(root, APP)
    snapshots = str(tmp_path_factory.mktemp("snapshots"))
    index.write_snapshot(index.index_tree(spark, str(root), head="v1", partitions=1), snapshots)
    return index.read_snapshot(spark, snapshots), root


def count(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


def test_index(spark, app):
    rel, _ = app
    n = {r.relation: r.n for r in index.stats(rel).collect()}
    assert (n["files"], n["symbols"], n["imports"]) == (4, 8, 3)
    s = {r.id: r for r in rel["symbols"].collect()}
    assert sorted(s) == list(range(1, 9)) and s[2].name == "find" and s[2].parent_symbol_id == 1
    kinds = {r.kind: r.n for r in rel["edges"].groupBy("kind").agg(F.count("*").alias("n")).collect()}
    calls = rel["edges"].filter("kind = 'calls'")
    assert kinds["contains"] == 4 and kinds["tests"] == 2
    assert sorted(r.target_name for r in calls.filter("target_symbol_id is null").collect()) == ["ValueError", "lookup"]
    assert rel["metadata"].collect()[0].value == "v1"
    assert {r.key: r.value for r in index.set_metadata(index.set_metadata(rel["metadata"], "a", "1"), "a", "2").collect()} == {"head": "v1", "a": "2"}
    assert [r.name for r in analyze.shown_file(rel, "routes.py").collect()] == ["login_handler", "health_check"]
    assert analyze.shown_symbol(rel, "authenticate_user").first().n_callers == 2
    c = index.cleared(rel, edges_only=True)
    assert c["edges"].count() == c["calls"].count() == 0 and c["files"].count() == 4 and index.cleared(rel)["files"].count() == 0


def test_numbering_is_dense_and_ordered(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    rows = sorted((r.k, r.id) for r in index.numbered(d, "k").collect())
    assert rows == [(k, k + 1) for k in range(1000)]


def test_removal(spark, app):
    rel, _ = app
    gone = rel["files"].filter("path = 'services.py'").select(F.col("id").alias("file_id"))
    left = index.without_files(rel, gone)
    assert left["files"].count() == 3 and left["symbols"].count() == 7 and left["imports"].count() == 2
    ids = {r.id for r in left["symbols"].collect()}
    assert all(r.caller_symbol_id in ids for r in left["calls"].collect())
    assert left["edges"].filter("kind = 'tests'").count() == 0
    assert index.without_edges_of(rel, gone)["symbols"].count() == 8
    orphans = spark.createDataFrame([(1, 1, None), (2, 2, 1), (3, 2, 2)], "id long, file_id long, parent_symbol_id long")
    none = spark.createDataFrame([], "id long, file_id long, caller_symbol_id long, source_file_id long, target_file_id long, source_symbol_id long, target_symbol_id long")
    out = index.without_files({"files": none.select("id"), "symbols": orphans, "imports": none.select("id", "file_id"), "calls": none.select("id", "caller_symbol_id"), "edges": none}, spark.createDataFrame([(1,)], "file_id long"))
    assert [(r.id, r.parent_symbol_id) for r in out["symbols"].orderBy("id").collect()] == [(2, None), (3, 2)]


def test_refresh(spark, app, tmp_path):
    rel, _ = app
    files = dict(APP)
    rows = lambda fs, stamps: spark.createDataFrame([(p, c, len(c), stamps.get(p, old[p] if p in old else 9)) for p, c in fs.items()], "path string, content string, size long, mtime long")
    old = {r.path: r.mtime for r in rel["files"].collect()}
    assert index.refresh(rel, rows(files, {})) is None
    files["services.py"] += "\n\ndef lookup(name):\n    return name\n"
    del files["routes.py"]
    files["web.ts"] = "export function draw() { return login_handler(); }\n"
    new = index.refresh(rel, rows(files, {"services.py": 99}))
    names = {r.name for r in new["symbols"].collect()}
    assert "lookup" in names and "draw" in names and "login_handler" not in names
    edges = new["edges"].filter("kind = 'calls'")
    assert sorted(r.target_name for r in edges.filter("target_symbol_id is null").collect()) == ["ValueError", "login_handler"]
    ids = [r.id for r in new["symbols"].collect()]
    assert len(set(ids)) == len(ids) and {r.id for r in new["symbols"].filter("name = 'User'").collect()} == {1}
    assert count(index.snapshot_diff(spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "path string, mtime long"), spark.createDataFrame([("b", 2), ("c", None), ("d", 1)], "path string, mtime long"))) == {("a",): "deleted", ("b",): "modified", ("c",): "unchanged", ("d",): "new"}
    assert index.is_stale(None, "a", "a") and index.is_stale(301, "a", "a") and index.is_stale(1, "b", "a") and not index.is_stale(1, "a", "a")


def shown(rel, kinds=("contains", "calls", "tests")):
    """Edges by names instead of ids."""
    path = {r.id: r.path for r in rel["files"].collect()}
    name = {r.id: (path[r.file_id], r.name) for r in rel["symbols"].collect()}
    return sorted(str((r.kind, path.get(r.source_file_id), name.get(r.source_symbol_id), path.get(r.target_file_id), name.get(r.target_symbol_id), r.target_name)) for r in rel["edges"].collect() if r.kind in kinds)


def test_refresh_like_a_new_index(spark, app):
    rel, _ = app
    files = dict(APP)
    files["services.py"] += "\n\ndef lookup(name):\n    return User()\n"
    files["tests/test_models.py"] = "from models import User\n\n\ndef test_user():\n    assert User().find('a')\n"
    files["lookup.py"] = "def authenticate_user():\n    return 1\n"
    del files["routes.py"]
    old = {r.path: r.mtime for r in rel["files"].collect()}
    stamps = {p: 99 if p == "services.py" else old.get(p, 9) for p in files}
    now = spark.createDataFrame([(p, c, len(c), stamps[p]) for p, c in files.items()], "path string, content string, size long, mtime long")
    new = index.refresh(rel, now)
    whole = index.relations(tree.parsed(tree.described(now)))
    whole["edges"] = index.edges(whole)
    assert shown(new) == shown(whole)
    ids = [r.id for r in new["edges"].collect()]
    assert len(set(ids)) == len(ids)
    before = {r.id: str(r) for r in rel["edges"].collect()}
    assert any(before.get(r.id) == str(r) for r in new["edges"].collect())


def test_running_numbers(spark):
    d = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 7).alias("n")).repartition(6)
    rows = sorted((r.k, r.id, r.n, r.before) for r in index.numbered(d, "k", start=10, running={"before": "n"}).collect())
    total = 0
    for k, i, n, before in rows:
        assert i == k + 10 and before == total
        total += n


def test_counts_of_resolutions(spark):
    symbols = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 2, "a"), (4, 2, "b")], "id long, file_id long, name string")
    calls = spark.createDataFrame([(1, 9, "a"), (2, 9, "a"), (3, 9, "b"), (4, 8, "c")], "id long, caller_symbol_id long, callee_name string")
    edges = index.resolved_calls(calls, symbols)
    want = edges.groupBy("source_symbol_id", "target_file_id", "target_name").agg(F.count("*").alias("n"), F.count_distinct("target_symbol_id").alias("n_targets"))
    assert sorted(map(str, index.resolution_counts(calls, symbols).collect())) == sorted(map(str, want.collect()))


def test_trace(spark):
    symbols = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "b")], "id long, name string")
    calls = spark.createDataFrame([(1, "b"), (2, "c"), (3, "a"), (4, "b"), (1, "a")], "caller_symbol_id long, callee_name string")
    got = trace.traced(spark.createDataFrame([(1,), (4,)], "seed long"), calls, symbols)
    assert sorted((r.seed, r.symbol_id, r.depth) for r in got.collect()) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 2, 2), (1, 4, 2)][:0] + sorted([(1, 2, 1), (1, 4, 1), (1, 3, 2), (1, 2, 2), (1, 4, 2), (1, 3, 3), (1, 2, 3), (1, 4, 3), (1, 3, 4), (1, 2, 4), (1, 4, 4), (1, 3, 5), (1, 2, 5), (1, 4, 5), (4, 2, 1), (4, 3, 2), (4, 1, 3), (4, 1, 4), (4, 2, 4), (4, 1, 5), (4, 2, 5), (4, 3, 5)])
    assert trace.first_steps(got, 2).count() == 4
    assert {(r.caller, r.callee) for r in trace.adjacency(calls, symbols).collect()} == {(1, 2), (1, 4), (2, 3), (3, 1), (4, 2), (4, 4), (1, 1)}


@pytest.fixture(scope="module")
def answers(spark, app):
    asks = [(1, "authenticate user login"), (2, "where are services"), (3, "thanks"), (4, "how should we log in"), (5, "autenticate_user")]
    r = analyze.analyze(spark.createDataFrame(asks, "query_id long, ask string"), app[0]).persist()
    return {x.query_id: x for x in analyze.judged(r).collect()}, r


def test_answers(answers):
    a, _ = answers
    top = [s["name"] for s in a[1].symbols]
    assert "authenticate_user" in top and "login_handler" in top
    assert [f.path for f in a[2].files][0] == "services.py" and a[2].tests[0].path == "tests/test_services.py"
    assert any([s["name"] for s in p] == ["login_handler", "authenticate_user", "User", "find", "Session", "create"] or p[0]["name"] == "login_handler" for p in a[1].paths)
    assert a[3].skip_reason == "all_empty" and a[4].keywords == [] and a[4].skip_reason == "all_empty"
    assert "authenticate_user" in [s["name"] for s in a[5].symbols] and a[1].skip_reason is None
    assert a[1].index_file_count == 4 and a[1].index_symbol_count == 8


def test_packages(spark, app, answers):
    contents = tree.read_tree(spark, str(app[1]), partitions=1)
    p = {r.query_id: r for r in context.packaged(answers[1], contents, mode="focused").select("query_id", "mode", "package", context.as_text(F.col("package")).alias("text"), context.as_summary(F.col("package")).alias("brief"), context.as_json(F.col("package")).alias("json")).collect()}
    assert "def login_handler(request):" in p[1].text and "Call paths:" in p[1].text and "def login_handler(request):" not in p[1].brief
    assert '"key_symbols"' in p[1].json and len(p[1].package.key_files) <= 10 and p[1].package.snippets
    assert context.packaged(answers[1], mode="auto").filter("query_id = 3").first().mode == "brief"
    e = {r.query_id: r for r in analyze.estimated(answers[1], app[0], contents).collect()}
    assert e[1].without_calls > e[1].with_calls > 0 and e[1].without_input > 2000 and e[3].with_calls == 0


def test_repositories(spark, app):
    rel, _ = app
    other = {**rel, "files": rel["files"].limit(0), "symbols": rel["symbols"].limit(0), "imports": rel["imports"].limit(0), "calls": rel["calls"].limit(0), "edges": rel["edges"].limit(0)}
    got = analyze.analyze_repositories(spark.createDataFrame([(1, "authenticate user login")], "query_id long, ask string"), {"b": rel, "a": other}).collect()
    assert [(r.repo, r.kept, r.rank) for r in got] == [("b", True, 1)] and got[0].score > 0


def test_specificity(spark):
    files = spark.createDataFrame([(i, f"src/{'module' if i else 'rare'}_{i}.py") for i in range(21)], "id long, path string")
    symbols = spark.createDataFrame([(1, "f")], "id long, name string")
    run = lambda kw, syn=False: retrieve.weighted(spark.createDataFrame([(1, kw, 0, syn)], "query_id int, kw string, ord int, is_synonym boolean"), files, symbols).collect()
    assert run("module") == [] and len(run("rare")) == 1 and run("rare")[0].idf == pytest.approx(3.044522437723423)
    assert run("rare", True) == [] and run("zzz")[0].idf == 10.0
    few = retrieve.weighted(spark.createDataFrame([(1, "module", 0, True)], "query_id int, kw string, ord int, is_synonym boolean"), files.limit(9), symbols).collect()
    assert few[0].idf == 0.5


def test_rank(spark):
    scored = spark.createDataFrame([(1, i, s, n) for i, (s, n) in enumerate([(100, "b"), (100, "a"), (26, "c"), (24, "d"), (9, "e")])], "query_id int, ord int, score int, name string")
    assert [r.name for r in rank.best_symbols(scored).orderBy("rank").collect()] == ["a", "b", "c"]
    same = spark.createDataFrame([(1, f"{d}/x.py", s) for d, s in (("a", 50), ("b", 40), ("c", 31), ("d", -5))], "query_id int, path string, score int")
    assert sorted(r.score for r in rank.same_name_halved(same).collect()) == [-2, 15, 40, 50]
    repos = spark.createDataFrame([(1, "x", 100, 1, 0, 0), (1, "y", 29, 1, 0, 1), (1, "z", 30, 0, 1, 2), (1, "w", 0, 0, 0, 3)], "query_id int, repo string, score int, n_files int, n_symbols int, ord int")
    assert sorted((r.repo, r.kept, r.rank) for r in rank.best_repositories(repos).collect()) == [("x", True, 1), ("y", False, None), ("z", True, 2)]


def test_similarity_and_budget(spark):
    rows = [(["a", "b"], ["a", "b"]), (["x"], ["y"]), (["a", "b", "c"], ["a"]), (["auth"], ["authentication"]), (["ab", "cd"], ["abc", "cd"]), ([], [])]
    d = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r.x for r in d.select(session.fuzzy_jaccard(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == pytest.approx([1.0, 0.0, 1 / 3, 1.0, 1 / 3, 0.0])
    assert [sessions.similarity(a, b) for a, b in rows] == pytest.approx(got)
    asks = [("s", 1, ["auth", "login"], ["web"], "h1"), ("s", 2, ["auth", "token"], ["web"], "h2"), ("s", 3, ["queue"], ["jobs"], "h3"), ("s", 4, ["other"], [], "h3"), ("t", 1, ["queue"], [], None)]
    a = spark.createDataFrame(asks, "session string, ask_id long, kws array<string>, subsystems array<string>, output_hash string")
    want = {("s", 1): "full", ("s", 2): "brief", ("s", 3): "full", ("s", 4): "skip", ("t", 1): "full"}
    assert {(r.session, r.ask_id): r.budget for r in session.budgets(a, "session", "ask_id").collect()} == want
    last = None
    for s, i, k, sub, h in asks[:4]:
        assert sessions.decided(k, sub, h, last) == want[(s, i)]
        last = (k, sub, h)


def test_streamed_budgets(spark, tmp_path):
    schema = "session string, ask_id long, kws array<string>, subsystems array<string>, output_hash string"
    rows = [("s", 1, ["auth", "login"], ["web"], "h1"), ("s", 2, ["auth", "login", "x"], ["web"], "h2")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {}

    def run():
        def keep(df, n):
            got.update({(r.session, r.ask_id): r.budget for r in df.collect()})

        out = sessions.streamed_budgets(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), idle=None)
        out.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)

    run()
    spark.createDataFrame([("s", 3, ["zebra"], [], "h2"), ("t", 9, [], [], None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # goes on from the checkpoint's state
    assert got == {("s", 1): "full", ("s", 2): "brief", ("s", 3): "skip", ("t", 9): "full"}


def test_streamed_refresh_and_windows(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    q = sessions.refreshed(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda df, n: seen.append(df.count()), f"{tmp_path}/c", trigger="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(seen) == 5
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("ts"), "k")
    assert sorted((r.k, r.n) for r in sessions.windowed_counts(e, "ts", "k").collect()) == [("a", 2), ("b", 1)]


def test_costs(spark):
    t = spark.createDataFrame([("s", 1, 500), ("u", 1, 100), ("u", 2, 200)], "s string, n int, new long")
    assert {r.s: r.input_tokens for r in tokens.session_totals(t, "s", "n", "new").collect()} == {"s": 2500, "u": 2100 + 2600}
    d = spark.createDataFrame([(1_000_000, 100_000)], "a long, b long")
    assert d.select(tokens.cost(F.col("a"), F.col("b"))).first()[0] == 4.5
    assert [r[0] for r in spark.createDataFrame([(100, 70), (0, 5)], "a long, b long").select(tokens.saving(F.col("a"), F.col("b"))).collect()] == [30.0, 0.0]


def test_modes_and_rules(spark):
    d = spark.createDataFrame([(3, 1, 9), (5, 2, 0), (6, 1, 0), (5, 2, 1)], "f int, s int, p int")
    assert [r[0] for r in d.select(context.detected_mode(F.col("f"), F.col("s"), F.col("p"))).collect()] == ["brief", "brief", "focused", "focused"]
    d = spark.createDataFrame([(0, 0, 0, False), (3, 0, 0, True), (3, 1, 0, False), (3, 1, 0, True), (3, 2, 0, False), (0, 0, 1, False)], "f int, s int, p int, a boolean")
    assert [r[0] for r in d.select(context.skip_reason(*(F.col(c) for c in "fspa"))).collect()] == ["all_empty", "files_without_symbols", "weak_single_symbol", None, None, None]
    d = spark.createDataFrame([(["authenticate"], "fix Autenticate now"), (["user"], "used"), (["$fetch"], "call $fetch()"), ([], "x")], "n array<string>, p string")
    assert [r[0] for r in d.select(context.anchored(F.col("n"), F.col("p"))).collect()] == [True, False, True, False]
    assert [r[0] for r in spark.createDataFrame([(2, 1), (0, 3), (1, 0), (0, 0)], "s int, k int").select(context.reason(F.col("s"), F.col("k"))).collect()] == ["2 symbols, 1 keyword", "3 keywords", "1 symbol", ""]


def test_evaluation(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], []), (["a"], [])], "r array<string>, s array<string>")
    assert [tuple(x) for x in d.select(*evaluate.hit_rate(F.col("r"), F.col("s"))).collect()] == [(1, 1, 2, 33.3, 50.0), (0, 0, 0, 0.0, 0.0), (0, 1, 0, 0.0, 0.0)]
    calls = spark.createDataFrame([("r", "Read", "/w/a.py"), ("r", "Write", "/w/b.py"), ("r", "Edit", "/w/b.py"), ("r", "Grep", "/w/c.py"), ("r", "Read", None)], "run string, tool string, file_path string")
    assert tuple(evaluate.files_used(calls, ("Read", "Edit", "Write"), "/w/").first()) == ("r", ["a.py"], ["b.py"])
    u = spark.createDataFrame([("r", i, *x) for i, x in enumerate([(10, 90, 0), (10, 90, 0), (5, 0, 100), (10, 90, 0)])], "k string, n int, input_tokens long, cache_read long, cache_creation long")
    c = evaluate.cache_effect(u, "k", "n").first()
    assert (c.api_calls, c.total_input, c.first_rate) == (3, 305, 0.9) and c.discount_factor == pytest.approx((25 + 18 + 125) / 305)
    p = spark.createDataFrame([("x", 0.9, 0.7), ("y", 0.5, 0.6)], "k string, a double, b double")
    assert [r.k for r in evaluate.lopsided(p, "a", "b").collect()] == ["x"]
    r = spark.createDataFrame([("t", 10.0, 50.0), ("t", 20.0, 70.0), ("v", 5.0, 5.0)], "t string, precision double, recall double")
    s = {x.t: x for x in evaluate.rate_stats(r, "t").collect()}
    assert s["t"].mean_precision == 15 and s["t"].dev_recall == pytest.approx(14.142135623730951) and s["v"].dev_recall is None
    plan = evaluate.interleaved(["a", "b", "c"])
    assert len(plan) == 6 and all(x[0] != y[0] for x, y in zip(plan, plan[1:])) and plan == evaluate.interleaved(["a", "b", "c"])
    assert evaluate.interleaved(["a"]) == [("a", "with"), ("a", "without")]
    sched = spark.createDataFrame(list(enumerate("abba")), "n int, c string")
    assert [r.n for r in evaluate.adjacent_repeats(sched, "n", "c").collect()] == [2]


def test_sinks_and_states(spark, answers, tmp_path):
    from graphquarry.sources import logs, sinks

    results = answers[1]
    p = context.packaged(results, mode="auto")
    assert sinks.write_packages(p, str(tmp_path / "out"), "both") == [f"{tmp_path}/out/{x}" for x in ("text", "whole", "json")]
    assert spark.read.json(f"{tmp_path}/out/json").count() == spark.read.json(f"{tmp_path}/out/text").count() == results.count()
    assert 0 < spark.read.json(f"{tmp_path}/out/whole").count() == p.filter("mode = 'brief'").count()
    with pytest.raises(ValueError):
        sinks.write_packages(p, str(tmp_path), "xml")
    assert session.load_last(spark, f"{tmp_path}/none").count() == 0
    session.save_last(spark.createDataFrame([("s", ["a"], [], "h")], "session string, kws array<string>, subsystems array<string>, output_hash string"), f"{tmp_path}/last")
    assert session.load_last(spark, f"{tmp_path}/last").first().session == "s"
    for name in ("round2/b.jsonl", "round1/z.jsonl", "a.jsonl", "round1/c.txt"):
        f = tmp_path / "logs" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("{}")
    assert [x.split("/logs/")[1] for x in logs.log_files(spark, f"file://{tmp_path}/logs")] == ["round1/z.jsonl", "round2/b.jsonl", "a.jsonl"]


def test_nested_ignore_files_and_unreadable(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1\n", ".gitignore": "*.log\nbuild/\n", "x.log": "", "build/b.py": "", "in/.gitignore": "skip.py\n!keep.log\n", "in/skip.py": "", "in/keep.log": "k", "in/deep/skip.py": "", "skip.py": "y = 2\n", "node_modules/m.js": "", "out/c.py": ""})
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00")
    got = {r.path for r in tree.read_tree(spark, str(tmp_path), exclude=["out"], partitions=2).collect()}
    assert got == {"a.py", ".gitignore", "in/.gitignore", "in/keep.log", "skip.py"}
    every = tree.read_tree(spark, str(tmp_path), exclude=["out"], partitions=2, unreadable=True)
    assert [r.path for r in every.filter("content is null").collect()] == ["bad.py"]
