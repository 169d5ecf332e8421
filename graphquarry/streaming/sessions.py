"""Streaming forms: budgets per session as questions arrive, and refreshing as files arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.session import SAME_TOPIC

_OUT = "session string, ask_id long, budget string"
_STATE = "kws array<string>, subsystems array<string>, output_hash string"


def _alike(a: str, b: str) -> bool:
    x, y = sorted((a, b), key=lambda s: len(s.encode()))
    return a == b or (len(x.encode()) >= 4 and y.startswith(x))


def similarity(a: list[str], b: list[str]) -> float:
    """The same as operators.session.fuzzy_jaccard, of two lists."""
    common = (sum(any(_alike(x, y) for y in b) for x in a) + sum(any(_alike(x, y) for x in a) for y in b)) / 2
    every = len(a) + len(b) - common
    return common / every if every > 0 else 0.0


def decided(kws: list[str], subsystems: list[str], output_hash: str | None, last: tuple | None) -> str:
    if last is None:
        return "full"
    if output_hash is not None and output_hash == last[2]:
        return "skip"
    by_words = similarity(kws, list(last[0]))
    both = by_words if not subsystems or not len(last[1]) else by_words * 0.7 + similarity(subsystems, list(last[1])) * 0.3
    return "brief" if both >= SAME_TOPIC else "full"


def streamed_budgets(asks: DataFrame, *, idle: int | None = 24 * 3600 * 1000) -> DataFrame:
    """session, ask_id, budget of a stream of session, ask_id, kws, subsystems, output_hash.

    State is the last question of each session; a session idle for ``idle`` milliseconds is forgotten.
    Forgetting takes batches without data, so such a stream runs until it is stopped; with idle None
    nothing is forgotten, and a stream over available data ends.
    Questions of one trigger are taken in order of ask_id.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("ask_id")
        last = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            kws, subs = list(r.kws if r.kws is not None else []), list(r.subsystems if r.subsystems is not None else [])
            out.append((key[0], r.ask_id, decided(kws, subs, r.output_hash, last)))
            last = (kws, subs, r.output_hash)
        state.update(last)
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["session", "ask_id", "budget"])

    return asks.groupBy("session").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionBudgets(StatefulProcessor):
    """The last question of a session as a value that lives ``idle`` milliseconds, from what was saved before if there is any.

    With ``closing``, a timer tells when a session has been idle so long, by a row without a question.
    """

    def __init__(self, idle: int | None, closing: bool):
        self.idle, self.closing = idle, closing

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE, self.idle)

    def _keep(self, last: tuple, timers) -> None:
        self.last.update(last)
        if self.closing:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(_question(next(initialState.itertuples())), timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()  # None where there is none; each call asks the state's server once
        out = []
        for r in pd.concat(list(rows)).sort_values("ask_id").itertuples():
            now = _question(r)
            out.append((key[0], r.ask_id, decided(*now, last)))
            last = now
        self._keep(last, timerValues)
        yield pd.DataFrame(out, columns=["session", "ask_id", "budget"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"session": [key[0]], "ask_id": pd.array([None], "Int64"), "budget": ["closed"]})

    def close(self) -> None:
        pass


def _question(r) -> tuple[list[str], list[str], str | None]:
    some = lambda x: list(x) if x is not None else []
    return some(r.kws), some(r.subsystems), r.output_hash


def session_budgets(asks: DataFrame, *, saved: DataFrame | None = None, idle: int | None = 24 * 3600 * 1000, closing: bool = False) -> DataFrame:
    """session, ask_id, budget of a stream of session, ask_id, kws, subsystems, output_hash, going on from saved sessions.

    ``saved`` has sessions' last questions, one a session, as operators.session.load_last reads them; they
    are taken in when the stream first starts.  A session idle for ``idle`` milliseconds begins anew (None:
    never); with closing, a row with budget ``closed`` and no ask_id tells of it.  Questions of one trigger
    are taken in order of ask_id.  With ``idle``, a stream also runs batches without data, so one over available
    data doesn't end by itself.  State is kept by RocksDB, which the session is set to.
    """
    asks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    first = None if saved is None else saved.select("session", "kws", "subsystems", "output_hash").groupBy("session")
    cols = asks.select("session", "ask_id", "kws", "subsystems", "output_hash")
    return cols.groupBy("session").transformWithStateInPandas(SessionBudgets(idle, closing), _OUT, "append", "ProcessingTime" if idle else "None", first)


def sessions_at(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session, kws, subsystems, output_hash: the sessions' last questions in a stopped stream's checkpoint, to be saved and gone on from."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    value = "value.value" if "value" in state.schema["value"].dataType.names else "value"
    return state.select("key.session", f"{value}.kws", f"{value}.subsystems", f"{value}.output_hash")


def refreshed(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, trigger: str = "300 seconds"):
    """Start a stream that hands each batch of changed files to ``apply`` (usually a refresh and a snapshot)."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def windowed_counts(events: DataFrame, ts: str, key: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: counts per key and tumbling window of event time, rows later than ``late`` dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
