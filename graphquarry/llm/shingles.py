"""Near-duplicates by the Jaccard similarity of word shingles.

Candidates come by SimHash: the components of all fingerprints within MAX_BITS of each other, found
through their segment counts (see simhash).  Texts at similarity 0.8 differ in some ten bits of 64, out
of reach of that search, so candidates also share one of 20 bands of five MinHash values each: a pair at
similarity 0.8 shares none with chance 4e-4, a closer one less.  Equal shingle sets are one node from the
start.  Cells (nodes of one component, or of equal band) with the same members are one cell; each gets
its members' whole shingle sets and verifies pairs exactly.  Inside a cell nodes leave the search as soon
as they are linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, utf8
from .passages import _B, _mix, _WordHashes
from .simhash import CELL, connected

BANDS, ROWS = 20, 5
#: Texts whose sets a worker makes at once.
AT_ONCE = 1_000
#: Bits by which fingerprints of one component's links differ at most.
MAX_BITS = 4
_RNG = np.random.default_rng(17)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MUL = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int, table: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of fewer words, one of all; A-Z are lower-cased."""
    words = utf8(text).lower().split() if text else []
    n = len(words)
    ids = np.fromiter((table[w] for w in words), np.uint64, n)
    width = min(width, n)
    h = ids[: n - width + 1].copy() if n else ids
    for j in range(1, width):
        h = h * _B + ids[j : n - width + 1 + j]
    return np.unique(_mix(h))


def bands(found: np.ndarray) -> np.ndarray:
    """One hash per band of a shingle set; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, ((found[at : at + 4096, None] ^ _XOR) * _MUL).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key * _B + column)
    return key.view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a shingle set, signed: the bits that are set in over half of its hashes; 0 for an empty set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        total += np.unpackbits(found[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(found), bitorder="little").tobytes(), "little", signed=True)


def _node(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def link(nodes: np.ndarray, sets: list[np.ndarray], alike: float) -> list[tuple[int, int]]:
    """Links that connect what is connected among distinct nodes: each found node to its component's first."""
    size = np.array([len(s) for s in sets])
    out, rest = [], np.arange(len(nodes))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            i = frontier.pop()
            own = sets[i]
            like = rest[(size[rest] >= alike * size[i]) & (size[i] >= alike * size[rest])]
            if not len(like):
                continue
            flat = np.concatenate([sets[j] for j in like])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size[like])[:-1]]))
            hits = like[both >= alike * (size[i] + size[like] - both) - 1e-9]
            if len(hits):
                rest = np.setdiff1d(rest, hits, assume_unique=True)
                out += [(int(nodes[root]), int(nodes[j])) for j in hits]
                frontier.extend(hits)
    return out


def _in_cells(batches, alike: float):
    """Links within runs of equal cells in batches of (cell, node, found) sorted by cell."""
    held = None

    def solve(t: pa.Table) -> pa.RecordBatch:
        cell, node = t["cell"].to_numpy(), t["node"].to_numpy()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["found"]]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist()
        out = [p for a, z in zip(starts, [*starts[1:], len(cell)], strict=True) for p in link(node[a:z], found[a:z], alike)]
        a, b = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        cell = t["cell"].to_numpy()
        if not len(cell):
            continue
        last = int(np.flatnonzero(cell == cell[-1])[0])
        if last:
            yield solve(t.slice(0, last))
        held = t.slice(last)
    if held is not None:
        yield solve(held)


def components(nodes: DataFrame, cell_limit: int = CELL) -> DataFrame:
    """cell, node: the nodes (node, fp) by the component of their fingerprints; those that are alone in one come along."""
    distinct = nodes.select("fp").distinct()
    roots = connected(simhash.links(distinct, MAX_BITS, cell_limit)).withColumnRenamed("node", "fp")
    return cut(nodes.select("node", "fp").join(roots, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit("fp")).alias("cell"), "node"))


def _parts(batches):
    """The batches in slices, whose sets take a bounded part of a worker's memory."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def links(nodes: DataFrame, texts: DataFrame, width: int, alike: float, cell_limit: int = CELL) -> DataFrame:
    """a < b: links that connect the nodes (node, text_key, fp, bands) of similar sets; texts (text_key, text) has their texts."""
    entered = nodes.select(F.explode("bands").alias("cell"), "node").unionByName(components(nodes, cell_limit))
    cells = entered.groupBy("cell").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")).filter("n > 1")
    cells = cut(cells.groupBy("n", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "n"))
    members = entered.join(cells, "cell")
    # cells over the limit: blocks of half of it; every pair of blocks, and so every pair of members, meets in one task
    of = F.when(F.col("n") <= cell_limit, F.lit(1)).otherwise(F.ceil(F.col("n") / max(1, cell_limit // 2)).cast("int"))
    blocks = members.withColumn("of", of).withColumn("own", F.pmod(F.hash("node"), F.col("of")))
    pairs = blocks.select("cell", "node", F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j")))).alias("p"))
    members = cut(pairs.select(F.xxhash64("cell", "p.i", "p.j").alias("cell"), "node"))
    wanted = members.select("node").distinct().join(nodes.select("node", "text_key"), "node").select("text_key")

    def whole(batches):
        table = _WordHashes()
        for b in _parts(batches):
            found = [shingles(t.as_py(), width, table) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "found"])

    sets = texts.join(wanted, "text_key").select("text").mapInArrow(whole, "node long, found binary").dropDuplicates(["node"])
    runs = members.join(sets, "node").repartition("cell").sortWithinPartitions("cell", "node").select("cell", "node", "found")
    return runs.mapInArrow(lambda it: _in_cells(it, alike), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, alike: float = 0.8, carry: tuple[str, ...] = (), cell_limit: int = CELL) -> DataFrame:
    """doc_id, fingerprint, component_id (and the carried columns), one row per row of docs.

    Rows are linked where the Jaccard similarity of their shingle sets is ``alike`` or more; fingerprint
    is a hash of the set.  Texts that are null or have no words are alike.  component_id is the smallest
    doc_id that links reach, the row's own included.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry)).withColumn("text_key", F.xxhash64("text"))
    rest = d.drop("text")
    schema = rest.select("*", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("fp"), F.array().cast("array<long>").alias("bands")).schema

    def work(batches):
        table = _WordHashes()
        for b in _parts(batches):
            k = b.schema.names.index("text")
            found = [shingles(t.as_py(), width, table) for t in b.column(k)]
            more = [pa.array([_node(x) for x in found], pa.int64()), pa.array([fingerprint(x) for x in found], pa.int64()), pa.array([bands(x) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != k), *more], names=[*(n for n in b.schema.names if n != "text"), "node", "fp", "bands"])

    rows = cut(d.mapInArrow(work, schema))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    roots = connected(links(nodes, d.select("text_key", "text"), width, alike, cell_limit)).withColumnRenamed("node", "v")
    rooted = cut(nodes.join(roots, F.col("node") == F.col("v"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root")))
    component = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    known = cut(rooted.join(component, "root").select("node", "component_id"))
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return rows.join(known, "node").select("doc_id", hexed.alias("fingerprint"), "component_id", *(F.col(f"c_{c}").alias(c) for c in carry))
