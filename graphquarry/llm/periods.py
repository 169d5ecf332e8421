"""Periodic runs: stretches of words that repeat with a period four times or more.

A run with period p and at least 4 * p words holds several neighbouring points of the grid 0, p, 2p, ...
So for each p, and each pair of neighbouring grid points, the longest common extensions forward and
backward of the pair tell how far the period reaches; over all p that is a harmonic sum of queries.  An
extension is the least entry of a longest-common-prefix array between two suffixes' ranks: a suffix
array answers forward, one of the reversed words backward, each with a table of minima.

At a run's first grid point the forward extension is at least five words, so only pairs that agree in
five words are asked, and only texts with such a pair get arrays; this loses no run.  The texts of a
batch are searched side by side, behind separators that equal nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, utf8

#: Words that neighbouring grid points share at a run's first pair, at least: 2 * p + 1 for p >= 2, and 5 for p = 1.
SHARED = 5
#: Least length of a run in words, and least number of periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


class Extensions:
    """Longest common extensions of pairs of places in x: suffix array, adjacent prefixes, table of minima.

    Takes some 4 * log2(n) bytes a word twice over.  The last entry of x must differ from all others.
    """

    def __init__(self, x: np.ndarray):
        self.rank, levels = _ranks(x)
        order = np.empty(len(x), np.int64)
        order[self.rank] = np.arange(len(x))
        a, b = order[:-1], order[1:]
        shared = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            level = levels.pop()
            shared += (level[a + shared] == level[b + shared]).astype(np.int64) << k
        self.least = [shared.astype(np.int32)]  # by power of two: the least of so many entries from here on
        while 2 << (len(self.least) - 1) <= len(shared):
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many entries from i and from j on are equal; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        power = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(power):
            at = np.flatnonzero(power == k)
            table = self.least[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        return out


def _ranks(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rank of each suffix, and by k the ranks by the first 2**k entries (equal where these are).

    Only suffixes that still share their rank are sorted again when the compared length doubles.
    """
    order = np.argsort(x, kind="stable")
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    rank = np.empty(len(x), np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    levels, step = [rank.copy()], 1
    alone = new & np.append(new[1:], True)
    active = order[~alone]
    while len(active):
        mine, after = rank[active], rank[active + step]  # an equal entry is never the last one
        by = np.lexsort((after, mine))
        active, mine, after = active[by], mine[by], after[by]
        at = np.arange(len(active))
        group = np.ones(len(active), bool)
        group[1:] = mine[1:] != mine[:-1]
        new = group.copy()
        new[1:] |= after[1:] != after[:-1]
        first = np.maximum.accumulate(np.where(group, at, 0))
        rank[active] = mine + (np.maximum.accumulate(np.where(new, at, 0)) - first)
        levels.append(rank.copy())
        step *= 2
        active = active[~(new & np.append(new[1:], True))]
    return rank, levels


def _grid(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods p at which words i and i + p start five equal words, i being a multiple of p from its text's start.

    ``starts`` and ``sizes`` are of the texts in x; every pair of grid points that a run can begin at is looked at.
    """
    periods = sizes // LEAST_PERIODS
    text = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[text] - 1) // p - 2  # a run's first grid point leaves three periods after it
    begin, done = 0, np.cumsum(points)
    while begin < len(p):
        before = done[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(done, before + chunk, "right")))
        n = points[begin:end]
        total = int(n.sum())
        period = np.repeat(p[begin:end], n)
        nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(starts[text[begin:end]], n) + nth * period
        keep = np.flatnonzero(x[i] == x[i + period])
        i, period = i[keep], period[keep]
        for t in range(1, SHARED):
            keep = x[i + t] == x[i + period + t]
            i, period = i[keep], period[keep]
        if len(i):
            yield i, period
        begin = end


def find_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """For each list of word numbers its runs: (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [k for k, t in enumerate(texts) if len(t) >= LEAST_WORDS]
    if not long:
        return out
    x, starts, sizes = _joined([texts[k] for k in long])
    found = list(_grid(x, starts, sizes))
    if not found:
        return out
    i, p = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    owner = np.searchsorted(starts, i, "right") - 1
    with_pairs = np.unique(owner)
    moved = np.searchsorted(with_pairs, owner)
    y, y_starts, _ = _joined([texts[long[k]] for k in with_pairs])
    i = i - starts[owner] + y_starts[moved]
    forward = Extensions(y)(i, i + p)
    turned = y[::-1].copy()
    turned[-1] = y.min() - 1
    backward = Extensions(turned)(len(y) - i, len(y) - i - p)
    first, end = i - backward, i + p + forward
    # a run is told at its first grid point; of equal stretches the smallest period is the run's
    keep = (backward < p) & (end - first >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p))
    first, end, p, moved = first[keep], end[keep], p[keep], moved[keep]
    by = np.lexsort((p, end, first))
    first, end, p, moved = first[by], end[by], p[by], moved[by]
    least = np.ones(len(by), bool)
    least[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    rows = zip((first - y_starts[moved])[least].tolist(), (end - first)[least].tolist(), p[least].tolist(), with_pairs[moved[least]].tolist(), strict=True)
    for s, n, q, k in sorted(rows, key=lambda r: (r[3], r[0], r[2])):
        out[long[k]].append((s, n, q))
    return out


def _joined(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, with a separator before, between and after them, and spare ones at the end; starts and sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    x = np.empty(int(sizes.sum()) + len(texts) + 1 + SHARED, np.int64)
    apart = np.ones(len(x), bool)
    for t, s in zip(texts, starts, strict=True):
        x[s : s + len(t)] = t
        apart[s : s + len(t)] = False
    x[apart] = -1 - np.arange(apart.sum())
    return x, starts, sizes


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that stand in a run after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for s, n, p in runs:
        gone[s + p : s + n] = b"\1" * (n - p)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def _batches(texts: list[str | None], most: int) -> Iterator[list[list[bytes]]]:
    """The texts' words, in lists of texts of some ``most`` words in all; a longer text stands alone."""
    out, n = [], 0
    for t in texts:
        w = utf8(t).split() if t else []
        if out and n + len(w) > most:
            yield out
            out, n = [], 0
        out.append(w)
        n += len(w)
    if out:
        yield out


def periodic_runs(docs: DataFrame, *, text: str = "text", batch_words: int = 250_000) -> DataFrame:
    """docs with n_words, runs (array of {start, length, period} by start, then period) and collapsed.

    Words are runs of characters other than space and U+0009 to U+000D, numbered from 0.  A run is a
    stretch with smallest period p of at least 6 words and 4 * p, as long as the period holds.  collapsed
    is the words, joined by one space, without those that a run holds after its first period.

    A null or empty text has no words, no runs and an empty collapsed text; repeated rows are searched each
    on its own, texts of any length whole; an empty table gives an empty result.  Columns of docs with these
    names are replaced.  No shuffle; a task's memory follows batch_words or the longest text.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), F.lit("").alias("collapsed")).schema
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches):
        for b in batches:
            sizes, runs, rest = [], [], []
            for words in _batches(b.column(text).to_pylist(), batch_words):
                number: dict[bytes, int] = {}
                found = find_runs([[number.setdefault(w, len(number)) for w in ws] for ws in words])
                sizes += map(len, words)
                runs += ([dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found)
                rest += (b" ".join(collapsed(ws, rs)).decode("utf-8", "surrogatepass") for ws, rs in zip(words, found, strict=True))
            new = [pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(work, schema)


def without_repeats(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs with their texts collapsed where they have runs, and all else as it was; nulls stay null."""
    docs, restored = aside(docs, "n_words", "runs", "collapsed")
    found = periodic_runs(docs, text=text, **options)
    return restored(found.withColumn(text, F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(text))))
