"""Toxicity scores from subword-bag embeddings and a linear softmax, trained together in numpy.

A word is the mean of the vectors of its own hash and of its character n-grams' hashes; a document
is the mean of its words; a softmax over that mean gives the score.  Words never seen in training
share n-gram vectors with those that were, so misspellings score like what they resemble.  Because
the softmax is linear, each word adds a number of its own to the document's margin, which workers
keep in a bounded cache, so scoring costs one look-up a word.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

WORD = re.compile(r"[^\W\d_]+")
CACHE = 200_000
#: Letters of a piece, and how many the next one repeats: the longest n-gram less one, so none is lost.
PIECE, OVERLAP = 64, 4


def words_of(text: str | None) -> list[str]:
    """Runs of letters; of runs over PIECE letters, as in scripts without spaces, overlapping pieces of so many."""
    found = WORD.findall(text.lower()) if text else []
    if not found or max(map(len, found)) <= PIECE:
        return found
    return [x for w in found for x in ([w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - OVERLAP, PIECE - OVERLAP)])]


def features(word: str, buckets: int) -> list[int]:
    """Buckets of the word itself and of its n-grams of 3 to 5 letters, edge marks included."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in [f"={word}", *grams]]


class _Margins(dict):
    """Word -> what it adds to a margin, bounded."""

    def __init__(self, model: SubwordSoftmax):
        self.model = model

    def __missing__(self, w: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        m = self[w] = self.model.word_margin(w)
        return m


class SubwordSoftmax:
    """Embeddings (buckets x dim) and a two-class softmax, fitted by Adagrad on document means."""

    def __init__(self, buckets: int = 1 << 16, dim: int = 8, epochs: int | None = None, rate: float = 0.3, decay: float = 1e-3, seed: int = 7):
        self.buckets, self.dim, self.epochs, self.rate, self.decay, self.seed = buckets, dim, epochs, rate, decay, seed

    def fit(self, texts: list[str | None], labels: list[int]) -> SubwordSoftmax:
        rng = np.random.default_rng(self.seed)
        vocabulary: dict[str, int] = {}
        docs = []
        for t in texts:
            counts: dict[int, int] = {}
            for w in words_of(t):
                k = vocabulary.setdefault(w, len(vocabulary))
                counts[k] = counts.get(k, 0) + 1
            ids = np.fromiter(counts, np.int64, len(counts))
            n = np.fromiter(counts.values(), np.float32, len(counts))
            docs.append((ids, n / max(n.sum(), 1)))
        lists = [features(w, self.buckets) for w in vocabulary]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.array([x for f in lists for x in f], np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        scale = 100.0  # toxic words are a few hundredths of a text; this puts the mean on the weights' scale
        bags = [self._bag(ids, n, sizes, flat, starts, scale) for ids, n in docs]  # made once, used in every epoch
        y = np.array(labels, np.int64)
        emb = rng.normal(0, 0.05, (self.buckets, self.dim)).astype(np.float32)
        out = rng.normal(0, 0.05, (self.dim, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        g_emb, g_out, g_bias = np.full(self.buckets, 1e-6, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
        batch = 64
        epochs = self.epochs or max(6, min(12, 36_000 // max(1, len(docs))))  # small samples need more passes
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            rate = self.rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                chosen = chosen[[len(bags[i][0]) > 0 for i in chosen]]
                if not len(chosen):
                    continue
                part, target = [bags[i] for i in chosen], y[chosen]
                feats, share = np.concatenate([f for f, _ in part]), np.concatenate([x for _, x in part])
                n = np.array([len(f) for f, _ in part])
                doc = np.repeat(np.arange(len(part)), n)
                mean = np.add.reduceat(emb[feats] * share[:, None], np.concatenate([[0], np.cumsum(n)[:-1]]))
                z = mean @ out + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), target] -= 1
                p /= len(part)
                d_mean = p @ out.T
                d_out, d_bias = mean.T @ p + self.decay * out, p.sum(0)
                g_out += d_out**2
                g_bias += d_bias**2
                touched = np.zeros(self.buckets, bool)
                touched[feats] = True
                own = np.flatnonzero(touched)
                d = d_mean[doc] * share[:, None]
                d_emb = np.stack([np.bincount(feats, d[:, j], self.buckets)[own] for j in range(self.dim)], 1).astype(np.float32)
                g_emb[own] += (d_emb**2).mean(1)
                emb[own] -= rate * (d_emb / np.sqrt(g_emb[own])[:, None] + self.decay * emb[own])
                out -= rate * d_out / np.sqrt(g_out)
                bias -= rate * d_bias / np.sqrt(g_bias)
        self.weight = (emb @ (out[:, 1] - out[:, 0]) * scale).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        return self

    @staticmethod
    def _bag(ids, n, sizes, flat, starts, scale) -> tuple[np.ndarray, np.ndarray]:
        """Features of a document's words, each once, and what each adds to the document's mean."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        feats = np.concatenate([flat[starts[k] : starts[k + 1]] for k in ids])
        uniq, back = np.unique(feats, return_inverse=True)
        return uniq, np.bincount(back, np.repeat(n / sizes[ids] * scale, sizes[ids]), len(uniq)).astype(np.float32)

    def word_margin(self, word: str) -> float:
        f = features(word, self.buckets)
        return float(self.weight[f].sum()) / len(f)

    def scorer(self):
        """text -> score in [0, 1]; texts without words get the score of the bias alone."""
        margin_of = _Margins(self).__getitem__

        def score(text: str | None) -> float:
            words = words_of(text)
            margin = self.bias + (math.fsum(map(margin_of, words)) / len(words) if words else 0.0)
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, margin))))

        return score


def training_rows(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, max_rows: int) -> tuple[list[tuple[str, int]], float]:
    """At most ``max_rows`` labelled rows per class outside the held-out quarter, by hash of the id.

    Of rows that repeat a labelled id, the least text is taken, so repeats bring no more rows to the driver.
    Also the log odds of label 1 among all those labels, less its log odds in the sample.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(max_rows) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_rows rows at most
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(ids, "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.i).encode()), r.i, r.t or ""))
    whole, part = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}, [sum(r.y == y for r in rows) for y in (0, 1)]
    shift = math.log(whole[1] / whole[0]) - math.log(part[1] / part[0]) if len(whole) == 2 and all(part) else 0.0
    return [(r.t, r.y) for r in rows], shift


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 3000, threshold: float = 0.3, **model) -> DataFrame:
    """docs with held_out, score and predicted (columns of those names are replaced).

    Texts alone make a score: null and empty ones get the bias's.  Without any usable labels every
    score is the model's untrained 0.5.  Fitted on ``max_rows`` labelled rows per class at most.  Repeated
    rows score alike, texts of any length are scored whole, and an empty table gives an empty result.
    """
    rows, shift = training_rows(docs, labels, doc_id=doc_id, text=text, label=label, max_rows=max_rows)
    fitted = SubwordSoftmax(**model).fit([t for t, _ in rows], [y for _, y in rows])
    fitted.bias += shift  # the sample holds more of the rarer class than the labels do
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    docs = docs.drop("held_out", "score", "predicted")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def work(batches):
        score = shared.value.scorer()
        for b in batches:
            got = pa.array([score(t.as_py()) for t in b.column(b.schema.names.index(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, "score"])

    scored = docs.mapInArrow(work, schema)
    return scored.withColumns({"held_out": held_out(F.col(doc_id)), "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})
