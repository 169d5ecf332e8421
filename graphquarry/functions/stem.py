"""English stemming after the published Porter2 (Snowball) algorithm."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Fixed values of the algorithm: exceptions, and suffixes with what replaces them.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w) or re.search(f"[{_VOWEL}][^{_VOWEL}]", w)
    r1 = m.end() if m else len(w)
    m = re.search(f"[{_VOWEL}][^{_VOWEL}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _ends_short(w: str) -> bool:
    return bool(re.search(f"(?:[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]|^[{_VOWEL}][^{_VOWEL}])$", w))


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word; words of up to two letters are their own."""
    w = word
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _SAME:
        return w
    w = w[1:] if w[0] == "'" else w
    w = re.sub(f"(?:^y|(?<=[{_VOWEL}])y)", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            base = w[: -len(s)]
            if s in ("eedly", "eed"):
                if len(base) >= r1:
                    w = base + "ee"
            elif re.search(f"[{_VOWEL}]", base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _ends_short(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(s)] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
                w = w[: -len(s)] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(words: Column) -> Column:
    """array<string> of words -> array<string> of stems, Arrow-batched; null stays null."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        return pd.Series([None if ws is None else [seen[w] if w in seen else seen.setdefault(w, stem(w)) for w in ws] for ws in s], dtype=object)

    return run(words)


def stem_of(word: Column) -> Column:
    """string -> stem, Arrow-batched; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {w: stem(w) for w in set(s.dropna())}
        return pd.Series([known.get(w) for w in s], dtype=object)

    return run(word)
