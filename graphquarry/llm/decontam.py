"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items are normalised to words and folded into one automaton per group of items, a
group being bounded by ``group_words``; automata are broadcast one after the other, so what is
broadcast has that bound whatever the benchmark's size.  Documents stream through: each word moves one transition or falls
back along suffix links, which keeps the length of the longest match that ends at that word.  Where
that length reaches the window, the last ``window`` words stand in some item.  No shuffle is needed.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, discard, utf8

#: Words are runs of digits, letters a-z (A-Z lower-cased) and anything outside ASCII.
_KEEP = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().translate(_KEEP).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the words of several items, with the items of each window.

    States with a suffix of exactly ``window`` words know the items in which that window stands;
    items shorter than the window are known by the state and length of their whole text.

    Words are numbered, and the automaton lies in flat arrays: nearly all states have one transition
    at most, which stands at the state itself; those of the root stand by word, and further ones of
    other states in a table keyed by state and word.  A window's items are a chain of cells.
    """

    def __init__(self, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.to = array("i", [-1]), array("i", [-1])  # a state's first transition
        self.root = array("i")  # by word: the root's transition, 0 for none
        self.more: dict[int, int] = {}
        self.words_of_more: dict[int, list[int]] = {}  # only while building
        self.cell = array("i")  # by state: where the chain of its window's items begins, -1 for none
        self.cell_item, self.cell_next = array("i"), array("i")
        self.names: list[str] = []
        self.short: dict[int, dict[int, set[str]]] = {}
        self.near = array("i")
        self.n_words = 0

    def _get(self, s: int, w: int) -> int:
        """Where w leads from s; 0 for nowhere."""
        if not s:
            return self.root[w]
        if self.word[s] == w:
            return self.to[s]
        return self.more.get(s << 32 | w, 0) if self.more else 0

    def _set(self, s: int, w: int, t: int) -> None:
        if not s:
            self.root[w] = t
        elif self.word[s] in (-1, w):
            self.word[s], self.to[s] = w, t
        else:
            key = s << 32 | w
            if key not in self.more:
                self.words_of_more.setdefault(s, []).append(w)
            self.more[key] = t

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.word.append(-1)
        self.to.append(-1)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        length = self.length
        q = self._get(last, w)
        if q:  # the item repeats what an earlier item holds
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state(length[last] + 1, 0)
        p = last
        while p >= 0 and not self._get(p, w):
            self._set(p, w, cur)
            p = self.link[p]
        if p >= 0:
            q = self._get(p, w)
            self.link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q])
        self.word[c], self.to[c] = self.word[q], self.to[q]
        for x in self.words_of_more.get(q, ()):
            self._set(c, x, self.more[q << 32 | x])
        self.link[q] = c
        while p >= 0 and self._get(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def build(self, items: Iterable[tuple[str, list[bytes]]]) -> ItemAutomaton:
        numbered = []
        for name, words in items:
            self.n_words += len(words)
            ids = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            self.root.extend([0] * (len(self.vocabulary) - len(self.root)))
            numbered.append((name, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.words_of_more = {}
        self.cell = array("i", [-1]) * len(self.link)
        for k, (name, ids) in enumerate(numbered):
            self.names.append(name)
            s = n = 0
            size = min(self.window, len(ids))
            for w in ids:
                s, n = self.step(s, n, w)
                if n >= size:
                    if size == self.window:
                        h = self.holder(s, size)
                        if self.cell[h] < 0 or self.cell_item[self.cell[h]] != k:
                            self.cell_item.append(k)
                            self.cell_next.append(self.cell[h])
                            self.cell[h] = len(self.cell_item) - 1
                    elif n == len(ids):
                        self.short.setdefault(self.holder(s, n), {}).setdefault(n, set()).add(name)
        # the nearest state up the links, itself included, at which a short item ends
        if self.short:
            self.near = array("i", [-1]) * len(self.link)
            for s in sorted(range(len(self.link)), key=self.length.__getitem__):
                self.near[s] = s if s in self.short else (self.near[self.link[s]] if s else -1)
        return self

    def step(self, s: int, n: int, w: int) -> tuple[int, int]:
        """Longest match that ends with word number w, given the one that ended before it."""
        t = self._get(s, w)
        if t:
            return t, n + 1
        while s and not t:
            s = self.link[s]
            t = self._get(s, w)
        return (t, self.length[s] + 1) if t else (0, 0)

    def holder(self, s: int, size: int) -> int:
        """The state that holds the last ``size`` words of a match at s."""
        link, length = self.link, self.length
        while length[link[s]] >= size:
            s = link[s]
        return s

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) spans of words inside windows, and the items of those windows."""
        link, length, window, near = self.link, self.length, self.window, self.near
        first, to, root, more = self.word, self.to, self.root, self.more
        spans: list[list[int]] = []
        cells: set[int] = set()
        found: set[str] = set()
        s = n = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                s = n = 0
                continue
            t = (to[s] if first[s] == w else more.get(s << 32 | w, 0)) if s else root[w]
            if t:
                s = t
                n += 1
            elif s:
                while s and not t:
                    s = link[s]
                    t = (to[s] if first[s] == w else more.get(s << 32 | w, 0)) if s else root[w]
                if not t:
                    s = n = 0
                    continue
                n = length[s] + 1
                s = t
            else:
                continue
            size = 0
            if n >= window:
                cells.add(self.cell[self.holder(s, window)])
                size = window
            if near and (q := near[s]) >= 0:
                while q >= 0:
                    for m, items in self.short[q].items():
                        if m <= n:
                            found |= items
                            size = max(size, m)
                    q = near[link[q]] if q else -1
            if size:
                a = i + 1 - size
                while spans and spans[-1][0] >= a:
                    spans.pop()
                if spans and spans[-1][1] >= a:
                    spans[-1][1] = i + 1
                else:
                    spans.append([a, i + 1])
        for c in cells:
            while c >= 0:
                found.add(self.names[self.cell_item[c]])
                c = self.cell_next[c]
        return spans, found


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_groups(benchmark: DataFrame, item_id: str, text: str, group_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups of about ``group_words`` words at most, one group at a time on the driver; one group at least.

    An item is never divided, so one that is longer than a group makes its group longer.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t"))
    size = F.greatest(F.coalesce(F.octet_length("t"), F.lit(0)), F.lit(1))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // (2 * group_words)))  # a word and its space are two bytes at least
    for g in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == g)
        yield [(r.i, w) for r in part.toLocalIterator() if (w := words_of(r.t))]


def scan_items(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, group_words: int = 1_000_000) -> DataFrame:
    """docs with columns n_words, spans (array of {s, e} word offsets) and items (array of string).

    A null or empty text has no words, no spans and no items; an empty benchmark finds nothing; an empty
    table gives an empty result; rows that repeat are scanned each on its own, texts of any length whole.
    Repeated items count by their id; a null item id is the empty string.  Columns of docs named
    n_words, spans or items are replaced.

    Each group of items is a pass of its own over the documents, cut before the next, so that no
    worker ever holds two automata.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "spans", "items")
    empty = F.array().cast("array<struct<s:int,e:int>>"), F.array().cast("array<string>")
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "spans": empty[0], "items": empty[1]})
    schema = out.schema
    before = shared = None
    for group in item_groups(benchmark, item_id, item_text, group_words):
        if shared is not None:  # the groups before this one: computed and put down, and their automaton with them
            done = cut(out)
            shared.unpersist()
            if before is not None:
                discard(before)
            before = out = done
        shared = spark.sparkContext.broadcast(ItemAutomaton(window).build(group))

        def scan(batches, shared=shared, text=text, first=before is None):
            automaton = shared.value
            for b in batches:
                at = {n: k for k, n in enumerate(b.schema.names)}
                n_words, spans, items = [], [], []
                old = None if first else (b.column(at["spans"]).to_pylist(), b.column(at["items"]).to_pylist())
                for k, t in enumerate(b.column(at[text])):
                    words = words_of(t.as_py())
                    got, found = automaton.scan(words)
                    if old:
                        got = _merged(got + [[x["s"], x["e"]] for x in old[0][k]])
                        found |= set(old[1][k])
                    n_words.append(len(words))
                    spans.append([{"s": a, "e": z} for a, z in got])
                    items.append(sorted(found))
                new = {"n_words": n_words, "spans": spans, "items": items}
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else b.column(i) for i, f in enumerate(b.schema)], schema=b.schema)

        out = out.mapInArrow(scan, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated instead of the spans.

    Columns of docs that bear these names, or spans or items, are replaced.  Null and empty texts have no
    words and no hits; repeated rows, long texts and empty tables are as for ``scan_items``.
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s)
    out = scan_items(docs, benchmark, **options).withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)})
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("spans", "items")


def _char_spans(text: str, spans: list) -> list[tuple[int, int]]:
    """Word spans as byte spans of the UTF-8 text."""
    kept, starts, ends, inside = utf8(text).lower().translate(_KEEP), [], [], False
    for i, c in enumerate(kept):
        if (c != 32 and c not in b"\t\n\x0b\x0c\r") != inside:
            (ends if inside else starts).append(i)
            inside = not inside
    if inside:
        ends.append(len(kept))
    return [(starts[a], ends[z - 1]) for a, z in spans]


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", max_coverage: float = 0.5, **options) -> DataFrame:
    """Documents with the benchmark's passages cut out of their texts.

    A document of which more than ``max_coverage`` of its words lie in windows is dropped whole;
    from others each hit span is cut, from its first to its last word.  Untouched documents keep
    their texts byte for byte, null texts included.
    """
    docs, restored = aside(docs, "n_words", "spans", "items")
    spans = scan_items(docs, benchmark, text=text, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s)
    kept = spans.filter(hit <= max_coverage * F.col("n_words"))

    @F.pandas_udf("string")
    def cut_out(texts, cuts):
        import pandas as pd

        out = []
        for t, s in zip(texts, cuts, strict=True):
            if t is not None and len(s):
                b, at, parts = utf8(t), 0, []
                for a, z in _char_spans(t, [(x["s"], x["e"]) for x in s]):
                    parts.append(b[at:a])
                    at = z
                t = b"".join([*parts, b[at:]]).decode("utf-8", "surrogatepass")
            out.append(t)
        return pd.Series(out, dtype=object)

    return restored(kept.withColumn(text, F.when(F.size("spans") > 0, cut_out(text, "spans")).otherwise(F.col(text))))


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
