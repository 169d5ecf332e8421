"""Language identification by cross-parsing.

Labelled text of each language is folded into a suffix automaton over normalised letters.  A text is
parsed greedily into the longest phrases that occur in a language's sample.  A phrase costs the
logarithm of the sample's length, which is what naming a place in the sample takes; without that a
language with a short sample, whose phrases are short, would lose to others.  The language of the
least cost wins.  Automata are laid out as dense transition tables, so that workers step all texts of
a batch through them side by side in numpy.

Codes are bytes below 64.  Where the samples have more letters than that, the commonest have codes of
their own and each other one is a sequence of digits, so every letter of the samples stays apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: A text is parsed in segments of this many letters, each a phrase anew.
SEGMENT = 1024
UNDETERMINED = "und"
#: Digits that spell letters beyond the commonest, and how many of them a letter has at most.
DIGITS, PLACES = 24, 4
#: Fills a letter's codes up to PLACES.
_NO_CODE = 255


def letter_table() -> np.ndarray:
    """1 for code points that are letters."""
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.uint8)


def codes(text: str | None, table: np.ndarray) -> np.ndarray:
    """Alphabet codes of the lower-cased text; runs of non-letters become one 0, and so do both ends."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = table[32]
    c = np.concatenate([[blank], table[raw], [blank]]).astype(table.dtype)
    c = c[np.concatenate([[True], (c[1:] != blank) | (c[:-1] != blank)])]
    if c.itemsize > 1:
        c = c.view(np.uint8)
        c = c[c != _NO_CODE]
    return c


def code_table(chars: list[int], letters: int) -> np.ndarray:
    """Codes by code point, for letters in order of how common they are: 0 no letter, the last code an unknown letter.

    A byte each if ``letters`` codes suffice, else up to PLACES bytes in one number.
    """
    is_letter = letter_table()
    if len(chars) <= letters:
        table = is_letter * np.uint8(len(chars) + 1)
        for k, c in enumerate(sorted(chars)):
            table[c] = k + 1
        return table
    own = letters - DIGITS
    spelt = np.full((len(is_letter), PLACES), _NO_CODE, np.uint8)
    spelt[:, 0] = is_letter * np.uint8(letters + 1)
    places = next(n for n in range(1, PLACES + 1) if DIGITS**n >= len(chars) - own)
    for k, c in enumerate(chars):
        if k < own:
            spelt[c, 0] = k + 1
        else:
            spelt[c, :places] = [own + 1 + (k - own) // DIGITS**j % DIGITS for j in range(places)]
    return np.ascontiguousarray(spelt).view("<u4").ravel()


def suffix_automaton(sample: np.ndarray, alphabet: int) -> np.ndarray:
    """Transition table [state, code] of the sample's suffix automaton; -1: the phrase ends."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sample.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                k = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = k
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = k
                    p = link[p]
        last = cur
    out = np.full((len(nxt), alphabet), -1, np.int32)
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            out[s, c] = t
    return out


class CrossParser:
    """One automaton per language over at most ``letters`` + 2 codes."""

    def __init__(self, samples: dict[str, list[str]], letters: int = 62, budget: int = 240_000):
        self.languages = sorted(samples)
        text = "".join(t.lower() for ts in samples.values() for t in ts)
        chars, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        is_letter = letter_table()
        common = [c for _, c in sorted((-k, c) for c, k in zip(chars.tolist(), n.tolist(), strict=True) if is_letter[c])]
        self.table = code_table(common, letters)
        self.alphabet = min(len(common), letters) + 2
        share = budget // max(1, len(samples))  # letters of sample per language; bounds what is broadcast
        self.automata = []
        self.cost = []  # of a phrase, by language
        for lang in self.languages:
            parts, left = [np.zeros(0, np.uint8)], share
            for t in samples[lang]:
                c = codes(t, self.table)[:left]
                parts.append(c)
                left -= len(c)
            whole = np.concatenate(parts)
            self.cost.append(float(np.log2(len(whole) + 2)))
            step = suffix_automaton(whole, self.alphabet)
            # a broken phrase starts again at once with the letter that broke it; ~ marks the break.  The last
            # state goes nowhere: parses start there, and a letter that the sample lacks is a phrase of its own
            dead = len(step)
            again = np.where(step[0] >= 0, step[0], dead)
            step = np.concatenate([step, np.full((1, self.alphabet), -1)])
            self.automata.append(np.where(step >= 0, step, ~again[None, :]).astype(np.int32).ravel())

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """[language, text] number of phrases."""
        parts = [(k, c[a : a + SEGMENT]) for k, c in enumerate(coded) for a in range(0, len(c), SEGMENT)]
        parts.sort(key=lambda x: -len(x[1]))
        out = np.zeros((len(self.languages), len(coded)))
        if not parts:
            return out
        owner = np.array([k for k, _ in parts])
        sizes = np.array([len(c) for _, c in parts])
        grid = np.zeros((len(parts), sizes[0]), np.uint8)
        for row, (_, c) in zip(grid, parts, strict=True):
            row[: len(c)] = c
        grid = np.ascontiguousarray(grid.T)
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than each position
        for x, step in enumerate(self.automata):
            state = np.full(len(parts), len(step) // self.alphabet - 1, np.int32)
            broken = np.zeros(len(parts), np.int32)
            for j, n in enumerate(live):
                t = step.take(state[:n] * self.alphabet + grid[j, :n])
                sign = t >> 31
                broken[:n] -= sign
                state[:n] = t ^ sign
            out[x] = np.bincount(owner, broken, len(coded))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [codes(t, self.table) for t in texts]
        lettered = np.array([bool(c.any()) for c in coded], bool)
        coded = [c if ok else c[:0] for c, ok in zip(coded, lettered, strict=True)]
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        n = self.phrases(coded) * np.array(self.cost)[:, None]
        best = n.argmin(0)
        first = n.min(0)
        second = np.partition(n, 1, axis=0)[1] if len(n) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(lettered, np.clip(1 - first / second, 0, 1), 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], score.tolist()


def samples_by_language(docs: DataFrame, *, doc_id: str, text: str, lang: str, per_language: int) -> dict[str, list[str]]:
    """About ``per_language`` labelled texts per language outside the held-out quarter, by hash of the id.

    A language with n labelled rows keeps those whose hash falls in the first per_language / n of all
    hashes, so one that holds most rows is never sorted or gathered whole.
    """
    known = docs.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.col(doc_id).alias("i")).filter(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    sizes = {r.l: r.n for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    place = F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*(F.lit(x) for l, n in sizes.items() for x in (l, per_language / n)))
    out: dict[str, list[str]] = {l: [] for l in sizes}
    for r in sorted(known.filter(place < share[F.col("l")]).select("l", "t", "i").collect(), key=lambda r: (hash_place(r.i), r.t)):
        out[r.l].append(r.t)
    return {l: ts for l, ts in out.items() if ts}


def hash_place(i) -> int:
    """An order of ids that doesn't follow their values."""
    import zlib

    return zlib.crc32(f"#{i}".encode())


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 200, letters: int = 62, budget: int = 240_000, step: int = 2000) -> DataFrame:
    """docs with held_out, lang_pred and score (columns of those names are replaced).

    lang_pred is ``und`` with score 0 for texts that are null or have no letter, or where nothing
    could be learned.  score is 1 - least / second least cost of the phrases; equal costs go to the
    first language by name.  Learned from at most about ``per_language`` texts a language, and of those
    from ``budget`` letters in all, shared evenly: the first ones, by hash of the id, up to the share's
    end, which may fall inside a text.  Repeated rows are predicted alike, texts of any length whole;
    an empty table gives an empty result.
    """
    parser = CrossParser(samples_by_language(docs, doc_id=doc_id, text=text, lang=lang, per_language=per_language), letters, budget)
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    docs = docs.drop("held_out", "lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                lang_pred, score = shared.value.predict(b.column(b.schema.names.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang_pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(work, schema).withColumn("held_out", held_out(F.col(doc_id)))
