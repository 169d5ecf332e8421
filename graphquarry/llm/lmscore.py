"""Stupid-backoff language-model scores from the corpus's own n-gram counts, computed relationally.

The relations are: n-grams of each block of documents with the block's counts; the count tables, one
part per range of n-gram hashes, in which equal n-grams of all blocks meet and add up; and each
block's n-grams joined with their totals, from which its documents' scores are summed.  A relation's
rows travel in packed columns: the sorted 64-bit hashes of a block's n-grams in one range are one
row of compressed differences, so an n-gram costs about six bytes in the shuffle, and a frequent one
costs no more than a rare one (each block sends it once).

A document's own counts are taken out before it is scored; otherwise no n-gram would ever back off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import words_of
from .passages import _B, _mix, _WordHashes

BACKOFF = 0.4
#: Stands for the count of a word that no other document has.
UNSEEN = 0.5
BLOCK_WORDS = 1_000_000


def _pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8)).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _grams(ids: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each order's positions, and the positions at which they end."""
    h = ids
    for j in range(1, order):
        h = _mix(h[:-1] * _B + ids[j:])
    ok = doc[order - 1 :] == doc[: len(doc) - order + 1] if len(doc) >= order else np.zeros(0, bool)
    return h[ok], np.flatnonzero(ok) + order - 1


def _block_rows(ids: list, lengths: list[int], tokens: list[np.ndarray], order: int, bits: int, spread: int):
    """The packed rows of a block: its documents (part -1) and, for each order and range, its n-grams."""
    import xxhash

    toks = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    vocabulary, local = np.unique(toks, return_inverse=True)
    context = TaskContext.get()
    block = xxhash.xxh64_intdigest(repr((spread, context.partitionId() if context else 0, ids)).encode("utf-8", "surrogatepass") + toks.tobytes()) >> 1
    rows = [(block % (1 << bits), block, 0, -1, len(toks), _pack(local.astype("<u4")), _pack(np.diff(vocabulary, prepend=np.uint64(0))), len(vocabulary), ids, lengths)]
    for n in range(1, order + 1):
        h = toks if n == 1 else _grams(toks, doc, n)[0]
        uniq, count = np.unique(h, return_counts=True)
        part = (uniq >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        for a, z in zip(starts, [*starts[1:], len(part)]):
            rows.append((int(part[a]), block, n, int(part[a]), int(z - a), _pack(np.diff(uniq[a:z], prepend=np.uint64(0))), _pack(count[a:z].astype("<u4")), 0, None, None))
    return rows


_NAMES = ("key", "block", "n", "part", "size", "a", "b", "extra", "ids", "lengths")


def _types(id_type: pa.DataType) -> list[pa.DataType]:
    return [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(id_type), pa.list_(pa.int32())]


def _count_words(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(words_of(t.as_py())) for t in b.column(0))], pa.int64())})


def _blocks(batches, order: int, bits: int, block_words: int):
    """Packed rows from batches of (id, text)."""
    table = _WordHashes()
    ids, lengths, tokens, held, seq, id_type = [], [], [], 0, 0, None

    def flush():
        rows = _block_rows(ids, lengths, tokens, order, bits, seq)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(id_type), strict=True)], names=list(_NAMES))

    for b in batches:
        id_type = b.schema.types[0]
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            words = words_of(t.as_py())
            ids.append(i)
            lengths.append(len(words))
            tokens.append(np.fromiter((table[w] for w in words), np.uint64, len(words)))
            held += len(words)
            if held >= block_words or len(ids) >= 100_000:
                yield flush()
                ids, lengths, tokens, held, seq = [], [], [], 0, seq + 1
    if ids:
        yield flush()


def _count(rows: pa.Table) -> pa.Table:
    """One part of the count tables: totals of each block's n-grams in it; document rows pass."""
    n, size, a, b = (rows.column(c).to_pylist() for c in ("n", "size", "a", "b"))
    out = list(b)
    for order in sorted(set(n) - {0}):
        at = [i for i, x in enumerate(n) if x == order]
        hashes = np.concatenate([np.cumsum(_unpack(a[i], size[i], "<u8"), dtype=np.uint64) for i in at])
        counts = np.concatenate([_unpack(b[i], size[i], "<u4") for i in at])
        _, back = np.unique(hashes, return_inverse=True)
        totals = np.bincount(back, counts)[back].astype("<u8")
        for i, part in zip(at, np.split(totals, np.cumsum([size[i] for i in at])[:-1]), strict=True):
            out[i] = _pack(part)
            a[i] = None
    kinds = rows.schema
    rows = rows.set_column(kinds.get_field_index("a"), kinds.field("a"), pa.array(a, pa.binary()))
    return rows.set_column(kinds.get_field_index("b"), kinds.field("b"), pa.array(out, pa.binary()))


def _own(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each row's key stands in its own document."""
    pair = doc.astype(np.int64) * (int(key.max()) + 1 if len(key) else 1) + key
    _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
    return count[back]


def _score_block(rows: pa.Table, order: int, words: int) -> pa.Table:
    """doc_id, n_words and log10_score of a block's documents, from its rows with totals."""
    frame = rows.select(["n", "part", "size", "a", "b", "extra", "ids", "lengths"]).to_pylist()
    head = [r for r in frame if r["n"] == 0]
    if len(head) != 1:
        raise RuntimeError(f"a block has {len(head)} rows of documents")
    head = head[0]
    local = _unpack(head["a"], head["size"], "<u4").astype(np.int64)
    vocabulary = np.cumsum(_unpack(head["b"], head["extra"], "<u8"), dtype=np.uint64)
    lengths = np.array(head["lengths"], np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    toks = vocabulary[local]
    left: dict[int, np.ndarray] = {}  # order -> count outside the document, by position at which the n-gram ends
    ends: dict[int, np.ndarray] = {}
    for n in range(1, order + 1):
        parts = sorted((r for r in frame if r["n"] == n), key=lambda r: r["part"])
        totals = np.concatenate([np.zeros(0, "<u8"), *(_unpack(r["b"], r["size"], "<u8") for r in parts)]).astype(np.int64)
        if n == 1:
            at, key = np.arange(len(toks)), local
        else:
            h, at = _grams(toks, doc, n)
            uniq, key = np.unique(h, return_inverse=True)
            if len(uniq) != len(totals):
                raise RuntimeError("a block's n-grams and their totals differ")
        full = np.zeros(len(toks), np.int64)
        full[at] = totals[key] - _own(doc[at], key) if len(at) else 0
        left[n], ends[n] = full, at
    others = (words - lengths)[doc]
    score = np.log10(np.maximum(left[1], UNSEEN) / np.maximum(others, 1))
    for n in range(2, order + 1):
        # the longest order that occurs elsewhere decides; each step down costs the back-off factor
        at = ends[n]
        seen = left[n][at] > 0
        step = score[at] + np.log10(BACKOFF)
        step[seen] = np.log10(left[n][at][seen] / left[n - 1][at - 1][seen])
        score[at] = step
    sums = np.bincount(doc, score, len(lengths)).astype(float)
    ids = head["ids"]
    kind = rows.schema.field("ids").type.value_type
    return pa.table({"doc_id": pa.array(ids, kind), "n_words": pa.array(lengths), "log10_score": pa.array(sums)})


def spark_conf(df: DataFrame, name: str) -> str:
    return df.sparkSession.conf.get(name)


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = 2, block_words: int = BLOCK_WORDS, part_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, log10_score and mean_log10 (per word), one row per row of docs.

    Each word scores count(context, word) / count(context) with the longest context, up to order - 1
    words of its document, that occurs with it in other documents; each shorter step costs a factor
    0.4; a word that occurs nowhere else counts as half an occurrence.  Repeated rows count as often as they occur, each being
    another document to the next.  Null and empty texts have no words, score 0 and mean null; texts of any
    length are scored whole; other columns are left out, whatever their names; an empty table gives an
    empty result.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = d.select("text").mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0
    bits = max(4, (words * order // part_words).bit_length())
    kind = d.schema["doc_id"].dataType.simpleString()
    # a block's id follows from its rows, so they are put in an order that reruns of a task repeat
    d = d.sortWithinPartitions("doc_id", "text")
    schema = f"key long, block long, n int, part long, size int, a binary, b binary, extra int, ids array<{kind}>, lengths array<int>"
    packed = d.mapInArrow(lambda it: _blocks(it, order, bits, block_words), schema)
    parts = max(int(spark_conf(d, "spark.sql.shuffle.partitions")), -(-words * order // (8 * part_words)))  # so that a task's share doesn't grow with the corpus
    totals = packed.repartition(parts, "key").groupBy("key").applyInArrow(_count, schema)
    scored = totals.repartition(parts, "block").groupBy("block").applyInArrow(lambda t: _score_block(t, order, words), f"doc_id {kind}, n_words long, log10_score double")
    return scored.withColumn("mean_log10", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))
