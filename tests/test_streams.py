"""Sessions on a stream that is stopped, saved and gone on with elsewhere."""

import os
import random
import time

from pyspark.sql import functions as F

from graphquarry.operators import session
from graphquarry.streaming import sessions

ASKS = "session string, ask_id long, kws array<string>, subsystems array<string>, output_hash string"


def questions(n, seed):
    rng = random.Random(seed)
    pick = lambda k, xs: rng.sample(xs, rng.randint(0, k))
    rows = [(f"s{rng.randrange(6)}", i, pick(3, ["auth", "login", "queue", "token", "authent"]), pick(2, ["web", "jobs", "core"]), rng.choice([None, "h1", "h2"])) for i in range(n)]
    return [*rows, ("nulls", n, None, None, None), ("nulls", n + 1, None, None, None)]


def run(spark, tmp_path, rows, name, more=0, **options):
    """Feed rows to the stream of that name, and stop it when all are answered, and ``more`` rows besides."""
    spark.createDataFrame(rows, ASKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
    os.makedirs(f"{tmp_path}/{name}/out", exist_ok=True)
    found = lambda: {(r.session, r.ask_id): r.budget for r in spark.read.schema("session string, ask_id long, budget string").parquet(f"{tmp_path}/{name}/out").collect()}
    want = len(found()) + len(rows) + more
    out = sessions.session_budgets(spark.readStream.schema(ASKS).parquet(f"{tmp_path}/{name}/in"), **options)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/at").trigger(processingTime="500 milliseconds").start()
    until = time.time() + 90
    try:
        while len(found()) < want and time.time() < until and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    assert q.exception() is None
    return found()


def test_a_stream_goes_on_elsewhere(spark, tmp_path):
    rows = questions(90, 5)
    filled = [(s, i, k or [], sub or [], h) for s, i, k, sub, h in rows]
    want = {(r.session, r.ask_id): r.budget for r in session.budgets(spark.createDataFrame(filled, ASKS), "session", "ask_id").collect()}
    assert {"full", "brief", "skip"} <= set(want.values())
    run(spark, tmp_path, rows[:30], "a", idle=None)
    first = run(spark, tmp_path, rows[30:50], "a", idle=None)  # goes on from its own checkpoint
    session.save_last(sessions.sessions_at(spark, f"{tmp_path}/a/at"), f"{tmp_path}/saved")
    saved = session.load_last(spark, f"{tmp_path}/saved")
    assert saved.count() == len({r[0] for r in rows[:50]})
    second = run(spark, tmp_path, rows[50:], "b", saved=saved)
    assert first | second == want
    alone = run(spark, tmp_path, rows[50:], "c", saved=session.load_last(spark, f"{tmp_path}/nothing"))
    assert alone != second and set(alone) == set(second)


def test_idle_sessions_close(spark, tmp_path):
    a, b = ("s", 1, ["auth"], [], "h"), ("s", 2, ["auth"], [], "h")
    got = run(spark, tmp_path, [a], "x", idle=1, closing=True, more=1)
    assert got == {("s", 1): "full", ("s", None): "closed"}
    assert run(spark, tmp_path, [b], "x", idle=1, closing=True)[("s", 2)] == "full"  # else it would be skipped
    run(spark, tmp_path, [a], "y", idle=10**7, closing=True)
    assert run(spark, tmp_path, [b], "y", idle=10**7, closing=True) == {("s", 1): "full", ("s", 2): "skip"}


def test_states_with_and_without_end_are_read(spark, tmp_path):
    run(spark, tmp_path, [("s", 1, ["auth"], ["web"], "h")], "p", idle=10**7)
    run(spark, tmp_path, [("s", 1, ["auth"], ["web"], "h")], "q", idle=None)
    for name in "pq":
        assert [tuple(r) for r in sessions.sessions_at(spark, f"{tmp_path}/{name}/at").select("session", "kws", "subsystems", "output_hash", F.lit(1)).collect()] == [("s", ["auth"], ["web"], "h", 1)]
