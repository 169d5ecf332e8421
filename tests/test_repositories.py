"""Many repositories answered in one plan like each by itself, in as many jobs."""

import random

import pytest

from graphquarry.plans import analyze

ASKS = [(1, "where does load_user reach cache"), (2, "tests of the token parser"), (3, "thanks"), (4, "lod_user and save")]


def repository(spark, seed, n):
    rng = random.Random(seed)
    word = lambda: "_".join(rng.choice(["load", "save", "user", "cache", "token", "parser", "queue"]) for _ in range(rng.randint(1, 2)))
    files = [(i, f"{rng.choice(['src', 'lib', 'tests'])}/{word()}{i}.py", "python", rng.randrange(9000), rng.randrange(1, 300)) for i in range(n)]
    files = spark.createDataFrame([(*f, f[1].startswith("tests")) for f in files], "id long, path string, language string, size long, line_count long, is_test boolean")
    symbols = spark.createDataFrame([(i, rng.randrange(max(1, n)), word(), rng.choice(["function", "class"]), 1, 2, f"def {word()}()") for i in range(3 * n)], "id long, file_id long, name string, kind string, line_start long, line_end long, signature string")
    imports = spark.createDataFrame([(i, rng.randrange(max(1, n)), word()) for i in range(n)], "id long, file_id long, module string")
    calls = spark.createDataFrame([(i, rng.randrange(3 * n), word()) for i in range(4 * n)], "id long, caller_symbol_id long, callee_name string")
    edges = spark.createDataFrame([(i, "tests", rng.randrange(n), rng.randrange(n)) for i in range(n)], "id long, kind string, source_file_id long, target_file_id long")
    return {"files": files, "symbols": symbols, "imports": imports, "calls": calls, "edges": edges}


@pytest.fixture(scope="module")
def repositories(spark):
    return {name: repository(spark, k, n) for k, (name, n) in enumerate([("web", 40), ("api", 25), ("tiny", 4)])}


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("counted", "")
    out = run().collect()
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(ids)


def test_all_like_each(spark, repositories):
    asks = spark.createDataFrame(ASKS, "query_id long, ask string")
    got, jobs = jobs_of(spark, lambda: analyze.analyze(asks, analyze.together(repositories)))
    assert len(got) == len(ASKS) * len(repositories)
    mine = {(r.repo, r.query_id): r for r in analyze.analyze_repositories(asks, repositories).collect()}
    shown = ("ask", "keywords", "files", "symbols", "tests", "paths", "subsystems", "index_file_count", "index_symbol_count")
    some = 0
    for name, rel in repositories.items():
        for r in analyze.analyze(asks, rel).collect():
            if r.files or r.symbols:
                some += 1
                assert tuple(mine[name, r.query_id][c] for c in shown) == tuple(r[c] for c in shown), (name, r.query_id)
            else:
                assert (name, r.query_id) not in mine
    assert some >= 6 and {r.query_id for r in mine.values()} >= {1, 2}
    for q in {r.query_id for r in mine.values()}:
        best = sorted((r for r in mine.values() if r.query_id == q and r.kept), key=lambda r: (-r.score, r.repo))
        assert [r.rank for r in best] == list(range(1, len(best) + 1))
    _, one = jobs_of(spark, lambda: analyze.analyze(asks, analyze.together({"web": repositories["web"]})))
    assert jobs <= one * 1.25, (jobs, one)
