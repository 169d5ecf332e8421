"""Packing documents into training sequences of a fixed capacity.

A document's ids, with an end id after them, are cut into whole sequences from the start; what is left
is shorter than one.  The rests are dealt at random to groups of documents, and each group is packed
on its own by first-fit decreasing: a tournament tree over the bins' free places finds the first bin
that takes a piece.  Then the emptiest bins are cut up to fill the holes of the others, and the last
bin of a group is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# Letters U+00C0 to U+00FF in UTF-8, without the two signs among them; parts of runs of such letters, digits and printable ASCII.
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_UNITS = rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]++(?:" + _LATIN + rb"[a-z]*+)*+|(?:" + _LATIN + rb"[a-z]*+)++|[0-9]|[!-/:-@\[-`{-~]+"
#: What the tokenizer takes as one unit of such characters in lower case, so that units can be encoded apart; what else stands between blanks is whole.
UNIT = re.compile(rb"(?<![^ \t-\r])[!-~]*+(?:" + _LATIN + rb"[!-~]*+)*+[^ \t-\r]++|" + _UNITS)
ASCII_UNIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
PLAIN = bytes(range(0x20, 0x7F)) + b"\t\n\x0b\x0c\r"
#: Bytes of a unit that is remembered, at most.
LONG = 64


class Encoder(dict):
    """Ids of texts by a tokenizer of the ``tokenizers`` library that splits at white space and drops it.

    A dict of units and their ids, little-endian with ``kind.itemsize`` bytes each: what stands between
    blanks, or, with ``by_units``, for tokenizers that lower-case and split as ``UNIT`` does, its parts.  Each
    unit is encoded when it is first asked for.  Two generations of ``most`` units at most are remembered;
    units of the older one that are asked for again go on to the newer.
    """

    def __init__(self, path: str, *, by_units: bool = True, most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_units, self.most = by_units, most
        self.specials = tuple({t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, unit: bytes) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            if self.by_units and ASCII_UNIT.fullmatch(unit):
                found = [t.id for t in self.tokenizer.model.tokenize(unit.decode())]  # its normal form and only part
            else:
                found = self._ids(unit)
            ids = self._packed(found)
        if len(unit) <= LONG:
            self[unit] = ids
        return ids

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8."""
        if any(s in text for s in self.specials):
            return self._packed(self._ids(text))
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        if self.by_units:
            low = text.lower()
            units = (UNIT if low.translate(None, PLAIN) else ASCII_UNIT).findall(low)
        else:
            units = text.split()
        return b"".join(map(self.__getitem__, units))


@lru_cache(maxsize=2)
def encoder(path: str, by_units: bool) -> Encoder:
    return Encoder(path, by_units=by_units)


class FirstFit:
    """The free places of bins as a tournament tree: each node knows the most that a bin below it has free."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with ``size`` places free, which are taken."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bin_ = node - self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
        return bin_


def pack_group(sizes: list[int], capacity: int = 2048, least_hole: int = 16) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, from, to), for items of these sizes, none over capacity.

    First-fit decreasing, then whole bins, emptiest first, cut up into the holes of ``least_hole`` places
    or more that the others have; the last one so cut keeps the rest, in powers of two.
    """
    tree = FirstFit(len(sizes), capacity)
    bins: list[list[tuple[int, int, int]]] = []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if sizes[item]:
            b = tree.place(sizes[item])
            if b == len(bins):
                bins.append([])
            bins[b].append((item, 0, sizes[item]))
    fill = [sum(z - a for _, a, z in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    holes = sum(capacity - n for n in fill if capacity - n >= least_hole)
    target = 0  # the fullest bin, by place in order, that may still have a hole
    while order and capacity - fill[order[-1]] >= least_hole:
        donor = order.pop()
        holes -= capacity - fill[donor]
        pieces = bins[donor][::-1]
        while pieces and holes:
            while capacity - fill[order[target]] < least_hole:
                target += 1
            t = order[target]
            item, a, z = pieces.pop()
            n = min(z - a, capacity - fill[t])
            bins[t].append((item, a, a + n))
            if a + n < z:
                pieces.append((item, a + n, z))
            before = capacity - fill[t]
            fill[t] += n
            holes -= before if before - n < least_hole else n
        if pieces:
            return [bins[b] for b in sorted(order)] + _by_powers(pieces[::-1])
    return [bins[b] for b in sorted(order)]


def _by_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """pieces in sequences of powers of two, the largest first."""
    total = sum(z - a for _, a, z in pieces)
    rest = pieces[::-1]
    out = []
    for size in (1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1):
        seq = []
        while size:
            item, a, z = rest.pop()
            n = min(size, z - a)
            seq.append((item, a, a + n))
            size -= n
            if a + n < z:
                rest.append((item, a + n, z))
        out.append(seq)
    return out


def tokenized(docs: DataFrame, path: str, *, text: str = "text", end_id: int | None = 1, by_units: bool = True) -> DataFrame:
    """docs with ids (binary, little-endian) instead of text, and doc_tokens, their number with the end id; a null text is empty."""
    wide = Encoder(path).kind.itemsize
    rest = docs.drop(text, "ids", "doc_tokens")
    schema = rest.select("*", F.lit(0).cast("long").alias("doc_tokens"), F.lit(b"").alias("ids")).schema

    def work(batches):
        known = encoder(path, by_units)
        end = b"" if end_id is None else np.array([end_id], known.kind).tobytes()
        for b in batches:
            for at in range(0, max(1, b.num_rows), 500):  # few texts and ids at a time
                part = b.slice(at, 500)
                ids = [known.encode(t or b"") + end for t in part.column(text).cast(pa.binary()).to_pylist()]
                names = [n for n in part.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([len(x) // wide for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*names, "doc_tokens", "ids"])

    return docs.select(*rest.columns, text).mapInArrow(work, schema)


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), capacity: int = 2048, end_id: int | None = 1, by_units: bool = True, group_docs: int = 4096, least_hole: int = 16, seed: int = 13) -> DataFrame:
    """A row per piece of a document: carry columns, start, length, ids, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer's file, the same on all machines.  start is the number of the
    document's ids before the piece; ids is binary, four little-endian bytes each; doc_tokens counts the document's
    ids with its end id; offset is the piece's place in its sequence.  Sequences are filled from 0 without
    gaps; those of at most ``capacity`` ids are padded to it, but for those at a power of two.

    A null text is an empty one, whose only id is the end id (without end ids, it has no row).  Rows that
    repeat, also without an id, are packed each on its own; texts of any length are encoded whole, those of
    whole sequences without a shuffle; an empty table gives an empty result; other columns are not looked at.  Rows are
    numbered by where they stand in a written table and dealt by a hash of that number, so that a group
    has some ``group_docs`` rests whatever the ids are, and a task that runs again deals alike.
    """
    names = {c: f"c_{c}" for c in carry}
    t = cut(tokenized(docs.select(F.col(text).alias("text"), *(F.col(c).alias(n) for c, n in names.items())), tokenizer, end_id=end_id, by_units=by_units))
    wide = Encoder(tokenizer).kind
    groups = max(1, -(-t.count() // group_docs))
    carried = [f"c_{c}" for c in carry]
    out = t.select(*carried, "doc_tokens", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids").schema

    def rows(cols: list[pa.Array], kept: list[int], *values: list) -> pa.RecordBatch:
        at = pa.array(kept, pa.int64())
        more = [pa.array(v, pa.int64()) for v in values[:-1]] + [pa.array(values[-1], pa.binary())]
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in cols), *more], names=out.names)

    def whole(batches):
        for b in batches:
            cols = [b.column(n) for n in (*carried, "doc_tokens")]
            kept, start, ids = [], [], []
            for k, x in enumerate(b.column("ids")):
                x = np.frombuffer(x.as_buffer(), wide)
                for a in range(0, len(x) - capacity + 1, capacity):
                    kept.append(k)
                    start.append(a)
                    ids.append(x[a : a + capacity].astype("<u4").tobytes())
                    if len(ids) == 1000:
                        yield rows(cols, kept, start, [capacity] * 1000, [0] * 1000, [0] * 1000, ids)
                        kept, start, ids = [], [], []
            yield rows(cols, kept, start, [capacity] * len(ids), [0] * len(ids), [0] * len(ids), ids)

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        cols = [table.column(n) for n in (*carried, "doc_tokens")]
        rests = [np.frombuffer(x.as_buffer(), wide) for x in table.column("ids")]
        base = table.column("start").to_pylist()
        group = table.column("group")[0].as_py()
        kept, start, length, seq, offset, ids = [], [], [], [], [], []
        for s, pieces in enumerate(pack_group([len(r) for r in rests], capacity, least_hole)):
            ends = np.cumsum([0, *(z - a for _, a, z in pieces)]).tolist()
            for (k, a, z), (o, _) in zip(pieces, pairwise(ends), strict=True):
                kept.append(k)
                start.append(base[k] + a)
                length.append(z - a)
                seq.append((group << 33) + 2 * s + 1)
                offset.append(o)
                ids.append(rests[k][a:z].astype("<u4").tobytes())
        return pa.Table.from_batches([rows([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], kept, start, length, seq, offset, ids)])

    numbered = t.withColumn("row", F.monotonically_increasing_id())
    full = numbered.filter(F.col("doc_tokens") >= capacity).drop("row").mapInArrow(whole, out).withColumn("sequence_id", F.monotonically_increasing_id() * 2)
    at = F.col("doc_tokens") - F.col("doc_tokens") % capacity
    rests = numbered.filter(F.col("doc_tokens") % capacity > 0).select(*carried, "doc_tokens", at.alias("start"), "row", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).alias("group"), F.expr(f"substring(ids, cast((doc_tokens - doc_tokens % {capacity}) * {wide.itemsize} + 1 as int))").alias("ids"))
    some = rests.groupBy("group").applyInArrow(packed, out)
    got = full.unionByName(some)
    return got.select(*(F.col(n).alias(c) for c, n in names.items() if c not in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
