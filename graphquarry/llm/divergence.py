"""How much the sources of each language differ in their words, term by term, in exact whole numbers.

A group is a language and a source.  Each group, and each language as a whole, gives every kept term a
share p of a thousand million, with one added to every count.  How far a share p stands from another, q,
is (p - q)**2 / q, rounded down.  Two groups are compared by the sum of that over all kept terms.

Terms are split by how many groups they are in.  Heavy ones are compared in dense tiles of groups by
terms.  Light ones are absent from most groups, so every pair of groups starts from the sum that it
would have if both had none of them, and what is there corrects it: once for each count that a group
has, against all other groups, and once for each two groups of a term's posting list.  All partial
sums are whole numbers and are added up by Spark.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, utf8

#: Terms are runs of letters a-z (A-Z lower-cased) and anything outside ASCII.
_KEEP = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
SCALE = 1_000_000_000
_PARTIAL = "lang string, source string, item string, part_sum long"


def terms_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_KEEP).split() if text else []


def share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / of), for n < of, by long division, so that nothing overflows."""
    rest, out = np.add(n, 1, dtype=np.int64), 0
    for _ in range(3):
        rest = rest * 1000
        digits = rest // of
        out = out * 1000 + digits
        rest = rest - digits * of
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = np.subtract(p, q)
    return d * d // q


def _share(n: str, of: str) -> Column:
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(19,0)) div cast({of} as decimal(19,0))")


def counted(docs: DataFrame, *, most: int = 400_000) -> DataFrame:
    """lang, source, term, n, docs: how often and in how many documents; each group has a row without a term as well.

    Null languages and sources are ''.  Tasks add up before they send; they hold about ``most`` counts, or one text's.
    """

    def count(batches):
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
        holding: dict[tuple[str, str], Counter] = defaultdict(Counter)
        groups: set[tuple[str, str]] = set()

        def sent():
            for g in sorted(groups):
                n, d = seen.pop(g, Counter()), holding.pop(g, Counter())
                for a in range(0, len(n) + 1, 50_000):
                    part = list(n)[a : a + 50_000]
                    mark = [None] if a == 0 else []
                    at = len(part) + len(mark)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[0]] * at, pa.string()), pa.array([g[1]] * at, pa.string()), pa.array(mark + part, pa.binary()).cast(pa.string()), pa.array([0] * len(mark) + [n[w] for w in part], pa.int64()), pa.array([0] * len(mark) + [d[w] for w in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            groups.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                g = (lang or "", source or "")
                words, own = terms_of(text), seen[g]
                before = len(own)
                own.update(words)
                holding[g].update(set(words))
                groups.add(g)
                held += len(own) - before
                if held > most:
                    yield from sent()
                    held = 0
        yield from sent()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _frame(lang: str, names: np.ndarray, a: np.ndarray, b: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    at = pa.array(names, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), at.take(pa.array(a)), at.take(pa.array(b)), pa.array(sums, pa.int64())], names=["lang", "source", "item", "part_sum"])


def _pairs(lang: str, names: list[str], mine: list[int], sums: np.ndarray, turned: np.ndarray | None = None) -> pa.Table:
    """Sums by row of ``mine`` and group as rows of pairs, groups with themselves left out; turned has the sums of the pairs the other way."""
    g = len(names)
    a, b = np.repeat(np.array(mine, np.int64), g), np.tile(np.arange(g), len(mine))
    keep = a != b
    out = [_frame(lang, names, a[keep], b[keep], sums.reshape(-1)[keep])]
    if turned is not None:
        out.append(_frame(lang, names, b[keep], a[keep], turned.reshape(-1)[keep]))
    return pa.Table.from_batches(out)


def dense_tile(table: pa.Table) -> pa.Table:
    """The sums over a tile's terms, for every ordered pair of groups.  Rows: lang, source, term, n, of; those without a term name all groups."""
    t = table.to_pydict()
    groups = sorted((s, d) for s, term, d in zip(t["source"], t["term"], t["of"], strict=True) if term is None)
    row = {s: k for k, (s, _) in enumerate(groups)}
    column: dict[str, int] = {}
    cells = [(row[s], column.setdefault(w, len(column)), n) for s, w, n in zip(t["source"], t["term"], t["n"], strict=True) if w is not None]
    counts = np.zeros((len(groups), len(column)), np.int64)
    if cells:
        at = np.array(cells, np.int64)
        counts[at[:, 0], at[:, 1]] = at[:, 2]
    p = share(counts, np.array([[d] for _, d in groups], np.int64))
    sums = np.zeros((len(groups), len(groups)), np.int64)
    for a in range(len(groups)):
        sums[a] = apart(p[a], p).sum(axis=1)
    return _pairs(t["lang"][0], [s for s, _ in groups], list(range(len(groups))), sums)


def sparse_tile(table: pa.Table) -> pa.Table:
    """For a block of groups against all: what no light term gives, and what each of a group's own counts changes.

    Rows: lang, source, n, terms, of, light, mine; those without n name all groups, with the number of light
    terms; the others say in how many light terms a group of the block has a count.
    """
    t = table.to_pydict()
    marks = sorted((s, d, light, m) for s, n, d, light, m in zip(t["source"], t["n"], t["of"], t["light"], t["mine"], strict=True) if n is None)
    names, of = [m[0] for m in marks], np.array([m[1] for m in marks], np.int64)
    own: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for s, n, terms in zip(t["source"], t["n"], t["terms"], strict=True):
        if n is not None:
            own[s].append((n, terms))
    mine = [k for k, m in enumerate(marks) if m[3]]
    none = share(np.zeros(len(names), np.int64), of)
    forth, back = np.zeros((len(mine), len(names)), np.int64), np.zeros((len(mine), len(names)), np.int64)
    for r, k in enumerate(mine):
        base, turned = apart(none[k], none), apart(none, none[k])
        forth[r] = marks[k][2] * base
        if not own[names[k]]:
            continue
        counts, terms = np.array(sorted(own[names[k]]), np.int64).T
        p = share(counts, of[k])
        step = max(1, 1_000_000 // len(p))
        for a in range(0, len(names), step):
            q = none[a : a + step, None]
            forth[r, a : a + step] += ((apart(p, q) - base[a : a + step, None]) * terms).sum(axis=1)
            back[r, a : a + step] = ((apart(q, p) - turned[a : a + step, None]) * terms).sum(axis=1)
    return _pairs(t["lang"][0], names, mine, forth, back)


def posting_corrections(batches):
    """What two groups of a light term's posting list change together, added up by pair of groups.  Rows: lang, postings (source, n, of)."""
    for b in batches:
        sums: dict[str, dict[tuple[int, int], int]] = defaultdict(lambda: defaultdict(int))
        number: dict[str, dict[str, int]] = defaultdict(dict)
        sized = defaultdict(list)
        for lang, postings in zip(b.column("lang").to_pylist(), b.column("postings").to_pylist(), strict=True):
            of = number[lang]
            sized[lang, len(postings)].append([(of.setdefault(x["source"], len(of)), x["n"], x["of"]) for x in postings])
        for (lang, k), lists in sized.items():
            per = max(1, 500_000 // k)
            for at in range(0, len(lists), per):
                x = np.array(lists[at : at + per], np.int64)  # terms, postings, (group, n, of)
                p, none = share(x[:, :, 1], x[:, :, 2]), share(np.zeros(x.shape[:2], np.int64), x[:, :, 2])
                for i in range(k):
                    pi, oi = p[:, i, None], none[:, i, None]
                    change = apart(pi, p) - apart(pi, none) - apart(oi, p) + apart(oi, none)
                    change[:, i] = 0
                    key = (x[:, i, None, 0] << 32 | x[:, :, 0]).reshape(-1)
                    which, where = np.unique(key, return_inverse=True)
                    got = np.zeros(len(which), np.int64)
                    np.add.at(got, where, change.reshape(-1))
                    for w, s in zip(which.tolist(), got.tolist(), strict=True):
                        sums[lang][w >> 32, w & 0xFFFFFFFF] += s
        for lang, of_pair in sums.items():
            names = list(number[lang])
            pairs = np.array([ab for ab in of_pair if ab[0] != ab[1]], np.int64).reshape(-1, 2)
            yield _frame(lang, names, pairs[:, 0], pairs[:, 1], np.array([of_pair[a, z] for a, z in pairs.tolist()], np.int64))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top: int = 200, heavy: float = 0.25, cells: int = 100_000, block: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group is from each other source of its language, and by which terms.

    Part ``pair``: item is another source of the language, value the sum over all kept terms (0 if none are).
    Part ``term``: item is a term that the group has, with a greater share than in the whole language, value how
    far these shares are apart; the first ``top`` by rank.  Terms are kept that stand in ``min_docs`` documents of
    their language at least.  A term is heavy if it is in more than ``heavy`` of its language's groups; a dense tile
    holds about ``cells`` counts, or as many terms as there are groups, a sparse one ``block`` groups against all.

    Null texts have no terms, and null languages and sources are ''; a group without terms is compared like
    others; rows that repeat count each; texts of any length are read whole; an empty table gives an empty
    result; other columns of docs are not looked at.
    """
    got = counted(docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")))
    # what a task sent is spread by term, so that groups of any size are spread, and a term's groups meet
    spread = got.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    known = spread.withColumns({"in_docs": F.sum("docs").over(w), "of_lang": F.sum("n").over(w), "groups": F.count("*").over(w), "first": (F.min("source").over(w) == F.col("source")).cast("int")})
    known = cut(known.filter(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).drop("docs", "in_docs"))
    marks = known.filter("term is null").select("lang", "source", F.col("groups").alias("g"))
    terms = known.filter("term is not null")
    of_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = terms.groupBy("lang").agg(F.sum("n").alias("whole"))
    # how many terms are in so many groups: a few rows a language, so which are heavy is known without a join of the terms
    spread_of = terms.filter("first = 1").groupBy("lang", "groups").agg(F.count("*").alias("v")).join(marks.groupBy("lang").agg(F.max("g").alias("g")), "lang")
    is_heavy = F.col("groups") > heavy * F.col("g")
    of_lang = spread_of.groupBy("lang").agg(F.sum("v").alias("v"), F.sum(F.when(is_heavy, F.col("v")).otherwise(0)).alias("n_heavy")).join(whole, "lang")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    facts = marks.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    facts = facts.select("lang", "source", "g", (none("v") - none("n_heavy")).alias("light"), F.greatest(none("total") + none("v"), F.lit(1)).alias("of"), (none("whole") + none("v")).alias("of_whole"), F.ceil(none("n_heavy") / F.greatest(F.lit(cells) / F.col("g"), F.col("g"))).alias("tiles"), F.ceil(F.col("g") / F.lit(block)).alias("blocks"))
    facts = cut(facts)  # its size is known then, so that it is broadcast only while small
    full = terms.join(facts, ["lang", "source"]).withColumn("heavy", is_heavy)

    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    dense = full.filter("heavy").select("lang", place("term", "tiles").alias("tile"), "source", "term", "n", "of")
    tiles = facts.filter("tiles > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "of")
    by_tile = dense.unionByName(tiles).groupBy("lang", "tile").applyInArrow(dense_tile, _PARTIAL)

    light = full.filter("not heavy")
    nothing = F.lit(None).cast("long")
    hist = light.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(facts.select("lang", "source", "blocks"), ["lang", "source"])
    hist = hist.select("lang", place("source", "blocks").alias("tile"), "source", "n", "terms", nothing.alias("of"), nothing.alias("light"), F.lit(False).alias("mine"))
    all_groups = facts.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    all_groups = all_groups.select("lang", "tile", "source", nothing.alias("n"), nothing.alias("terms"), "of", "light", (place("source", "blocks") == F.col("tile")).alias("mine"))
    by_block = hist.unionByName(all_groups).groupBy("lang", "tile").applyInArrow(sparse_tile, _PARTIAL)
    postings = light.filter("groups > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "of")).alias("postings"))
    by_list = postings.select("lang", "postings").mapInArrow(posting_corrections, _PARTIAL)

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = by_tile.unionByName(by_block).unionByName(by_list).groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("value"))
    shares = full.filter("n > 0").select("lang", "source", F.col("term").alias("item"), _share("n", "of").alias("p"), _share("of_lang", "of_whole").alias("q")).filter("p > q")
    best = ranked(shares.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))).filter(F.col("rank") <= top)
    cols = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return cols(ranked(pairs), "pair").unionByName(cols(best, "term"))
