"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint maps to the bit counts of its 32 two-bit segments, a point of an integer grid.  The
Manhattan distance of two such points never exceeds the Hamming distance of the fingerprints, so all
fingerprints within ``max_bits`` are among those whose points are within ``max_bits``.  Of the two
bands of 16 segments, one at least is within half that distance; points within 2 share a cell when
each is entered in its own cell and those one step away.  Pairs that share a cell are verified
exactly.  Equal fingerprints are one node from the start, so groups of copies cost nothing, and
inside a cell nodes leave the search as soon as they are linked, so dense groups cost linear time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, discard, utf8

SEGMENTS_PER_BAND = 16
#: Cells of more fingerprints are divided into blocks that are compared pair by pair of blocks.
CELL = 20_000
#: Runs up to this many in a cell are compared in numpy without a loop over runs.
SMALL = 8


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles; 0 for no words.  A-Z are lower-cased, repeats count."""
    import xxhash

    words = utf8(text).lower().split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [digest(line[a:z], seed) for a, z in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[at : at + (1 << 16)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str, width: int = 4) -> DataFrame:
    """docs without the text, with fp (signed 64-bit)."""
    rest = docs.drop(text)
    schema = rest.select("*", F.lit(0).cast("long").alias("fp")).schema

    def work(batches):
        for b in batches:
            k = b.schema.names.index(text)
            got = np.array([fingerprint(t.as_py(), width) for t in b.column(k)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != k), pa.array(got, pa.int64())], names=[*(n for n in b.schema.names if n != text), "fp"])

    return docs.mapInArrow(work, schema)


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index) of every cell that each fingerprint is entered in: its own and those a step away."""
    fps = fps.view(np.uint64)
    low = np.uint64(0x5555555555555555)
    counts = (fps & low) + ((fps >> np.uint64(1)) & low)  # two bits each: 0, 1 or 2
    keys, rows = [], []
    index = np.arange(len(fps))
    for band in (0, 1):
        own = ((counts >> np.uint64(32 * band)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own |= np.int64(band) << np.int64(32)
        keys.append(own)
        rows.append(index)
        for s in range(SEGMENTS_PER_BAND):
            n = (own >> np.int64(2 * s)) & 3
            for ok, delta in ((n < 2, 1 << (2 * s)), (n > 0, -(1 << (2 * s)))):
                keys.append(own[ok] + delta)
                rows.append(index[ok])
    return np.concatenate(keys), np.concatenate(rows)


def link(members: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among distinct members: each found node to its component's first.

    A node leaves the search when it is reached, so a dense group is done after its first member.
    """
    out = []
    rest = members
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= max_bits
            if near.any():
                hits = rest[near]
                rest = rest[~near]
                out.append((np.full(len(hits), root), hits))
                frontier.extend(hits)
    return out


def _in_cells(batches, max_bits: int, limit: int):
    """Links within runs of equal cells in sorted (cell, fp) batches; cells over the limit are passed on."""
    held_c, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    passing = None  # a cell over the limit, whose rows are passed on as they come

    def rows(pairs, cell=None):
        a = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.uint64)
        b = np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, np.uint64)
        lo, hi = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        cells = pa.nulls(len(lo), pa.int64()) if cell is None else pa.array(np.full(len(lo), cell), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), cells], names=["a", "b", "cell"])

    def solve(c, f):
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(c)]]))
        pairs = []
        small = np.repeat(sizes <= SMALL, sizes)
        for lag in range(1, SMALL):
            same = np.flatnonzero((c[lag:] == c[:-lag]) & small[lag:])
            if not len(same):
                break
            ok = np.bitwise_count(f[same] ^ f[same + lag]) <= max_bits
            pairs.append((f[same[ok]], f[same[ok] + lag]))
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            pairs += link(f[s : s + n], max_bits)
        return rows(pairs)

    for b in batches:
        c = np.concatenate([held_c, b.column(0).to_numpy()])
        f = np.concatenate([held_f, b.column(1).to_numpy().view(np.uint64)])
        if not len(c):
            continue
        if passing is not None:
            n = int(np.searchsorted(c, passing, side="right"))
            if n:
                yield rows([(f[:n], f[:n])], passing)
                c, f = c[n:], f[n:]
            if not len(c):
                held_c, held_f = c, f
                continue
            passing = None
        last = int(np.searchsorted(c, c[-1], side="left"))
        if last:
            yield solve(c[:last], f[:last])
        held_c, held_f = c[last:], f[last:]
        if len(held_c) > limit:
            passing = held_c[0]
            yield rows([(held_f, held_f)], passing)
            held_c, held_f = held_c[:0], held_f[:0]
    if len(held_c):
        yield solve(held_c, held_f)


def links(distinct: DataFrame, max_bits: int = 4, cell_limit: int = CELL) -> DataFrame:
    """a < b: links between the distinct values of column fp; they connect all that is within max_bits."""
    if max_bits > 4:
        raise ValueError("the cells find pairs of up to 4 differing bits")

    def enter(batches):
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 1 << 14):
                part = fps[at : at + (1 << 14)]
                cell, row = cells_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[row])], names=["cell", "fp"])

    # a fingerprint makes some 50 rows, so a few small tasks of fingerprints would make large ones of cells
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    entered = spread.mapInArrow(enter, "cell long, fp long")
    runs = entered.repartition("cell").sortWithinPartitions("cell", "fp")
    found = cut(runs.mapInArrow(lambda it: _in_cells(it, max_bits, cell_limit), "a long, b long, cell long"))
    out = found.filter("cell is null").select("a", "b")
    large = found.filter("cell is not null").select("cell", F.col("a").alias("fp"))
    sizes = large.groupBy("cell").agg(F.count("*").alias("n"))
    # blocks of half a cell's limit; every pair of blocks, and so every pair of members, meets in one task
    blocks = large.join(sizes, "cell").withColumn("of", F.ceil(F.col("n") / (cell_limit // 2)).cast("int")).withColumn("own", F.pmod(F.hash("fp"), F.col("of")))
    pairs = blocks.select("cell", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j")))).alias("p"))
    keyed = pairs.select(F.xxhash64("cell", "p.i", "p.j").alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell", "fp")
    more = keyed.mapInArrow(lambda it: _in_cells(it, max_bits, 1 << 62), "a long, b long, cell long").select("a", "b")
    return out.unionByName(more).filter("a < b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of edges (a, b): root is the least node of the component.

    Alternating large-star and small-star rounds, each cut into the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    now = cut(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u > v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # minima are cut, so that joins with them have plain scans on both sides and hubs can be split
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        discard(least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        new = cut(small)
        discard(now)
        discard(large)
        discard(least)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4, carry: tuple[str, ...] = (), cell_limit: int = CELL) -> DataFrame:
    """doc_id, fingerprint, component_id (and the carried columns), one row per row of docs.

    fingerprint is 16 lower-case hex digits; texts that are null or have no words have fingerprint 0
    and link like any other.  component_id is the smallest doc_id that links reach, the row's own
    included; null ids are never the smallest unless a component has no other.  Repeated rows have equal
    results, texts of any length are read whole, and an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry)), "text", width))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected(links(nodes.select("fp"), max_bits, cell_limit)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = cut(nodes)
    component = cut(nodes.groupBy("root").agg(F.min("first_id").alias("component_id")))
    known = cut(nodes.select("fp", "root").join(component, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(known, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", *(F.col(f"c_{c}").alias(c) for c in carry))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", find=near_duplicates, **options) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest doc_id.

    ``find`` makes the groups.  Rows are told apart by id and text; of rows alike in both, one stays.  Null
    texts, and texts without words, are of one group; a null id stays only where its group has no other.
    Columns may have any names; an empty table gives an empty result.
    """
    docs, restored = aside(docs, "row_mark", "i", "r")
    marked = docs.withColumn("row_mark", F.xxhash64(doc_id, text))
    found = find(marked, doc_id=doc_id, text=text, carry=("row_mark",), **options)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_mark")
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("#"), "fingerprint"))
    best = found.groupBy(group.alias("g")).agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("i"), F.col("k.row_mark").alias("r"))
    alike = found.groupBy("doc_id", "row_mark").agg(F.count("*").alias("copies"))
    best = cut(best.join(alike, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row_mark") == F.col("r"))).select("i", "r", "copies"))
    same = F.col(doc_id).eqNullSafe(F.col("i")) & (F.col("row_mark") == F.col("r"))
    single = marked.join(best.filter("copies = 1"), same, "left_semi")
    several = marked.join(best.filter("copies > 1"), same, "left_semi").dropDuplicates([doc_id, "row_mark"])
    return restored(single.unionByName(several))
