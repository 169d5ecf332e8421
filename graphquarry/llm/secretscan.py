"""Secret scans: three base patterns, and a guess-cost estimate for values in a credential's place.

A value that stands where a credential would (``password: ...``, ``client_secret=...``) is cut by
dynamic programming into the segments that are cheapest to guess: common words, dates, repeated
characters, keyboard walks and sequences, or spans tried by brute force.  If even the cheapest cut
needs ``min_log10`` guesses, the value is a secret of kind ``guess``.

The words that guessers try are a short list of fixed ones, and after those the corpus's own commonest
words (``learned_words``): what stands between many different words, and not at a credential's place, is
a word of the language and cheap to guess.  Copies of a document show a word between the same words again,
so they teach nothing, however many there are.  Names of code, made of such words, are references and not
values, and an address is as secret as its most secret part.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, discard, utf8

#: Texts that a worker scans at once.
AT_ONCE = 1_000
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the longest runs, so the same as all runs of which short ones are dropped
CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth(?:orization)?|bearer|private[_-]?key|access[_-]?key)[\"']?\x20*(?::=|=>|[:=])\x20*(?=[^\s])|\bbearer\x20+(?=[^\s:=])", re.IGNORECASE | re.ASCII)
#: What may stand at a cue: a value in quotes up to the closing one, or a run without blanks and quotes.
QUOTED = re.compile(r"([\"'`])((?:\\.|(?!\1)[^\\\r\n])*)\1(?!\w)")
SCHEME = re.compile(r"(?:bearer|basic)\x20+", re.IGNORECASE)
BARE = re.compile(r"[\"'`]?((?:(?![,;&][\"']?[A-Za-z_][\w-]*[\"']?[=:]|</?[A-Za-z!])[^\s\"'`])+)")
SHORT = re.compile(r"[^\s\"'`,;<>()\[\]{}]*")
#: A name called or indexed, as code has it.
#: Unquoted names of code: parts joined by dots, slashes, dashes or underscores, without digits.
NAME = re.compile(r"[$%@{]*[A-Za-z]+(?:(?:\.|->|::|/|-|_)+[A-Za-z]+)*[}]*")
HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
CALL = re.compile(r"[A-Za-z_][\w.:>-]*(?:[(\[{][^()\[\]{}]*[)\]}]*)+")
#: An address, its host, where its parts end, and parts that are plain words.
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
HOST = re.compile(r"(?:[\w-]+\.)*[\w-]+(?::\d+)?(?=[/?#]|$)")
PARTS = re.compile(r"[/:@?&=#]+")
PLAIN = re.compile(r"[A-Z]?[a-z]{1,15}(?:[-_.][A-Za-z]{1,15})*|[0-9]{1,6}")
TOKEN = re.compile(r"(?=.*(?:[0-9]|[a-z][A-Z]|[A-Z]{2}))", re.DOTALL)
CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}
CUE = re.compile(rb"(?i:pass|pwd|secret|token|key|credential|auth|bearer|basic)")
CUES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
KINDS = ("assign", "access", "hex", "guess")

# Words that guessers try first, most common first.
COMMON = (
    "password pass word admin root user login welcome letmein qwerty monkey dragon master secret token key test testing example sample "
    "changeme default guest public private server service account database system manager office company summer winter spring autumn "
    "love hello world football baseball soccer hockey princess sunshine shadow michael jennifer jordan superman batman trustno "
    "access online mobile google apple samsung windows linux ubuntu docker cloud data value string null none true false undefined "
    "your my the and for this that with from here xxxx placeholder redacted insert enter "
    "administrator forgot forgotten reset remember required optional invalid missing expired session cookie bearer basic header request "
    "response config settings environment process env get set put new old api http https www com org net html index page path file name "
    "email phone address number code credentials auth authorization authentication client node local global production development "
    "staging backup temp update create delete select check validate generate encrypt decrypt hash salt"
).split()
# Rows of a keyboard and plain sequences, along which walks go either way.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef")

RANKS = {w: k + 1 for k, w in reversed(list(enumerate(COMMON)))}
#: Letters of a word that guessers know, at least and at most.
WORD_LETTERS = 3, 20
#: What a further segment costs: the choice between five patterns.
JOINT = math.log10(5)
_STEP = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:])}
_LEET = str.maketrans("4301$5@7!", "aeoissati")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)


def _case_cost(word: str) -> float:
    if word.islower() or not word.isalpha():
        return 0.0
    return 0.3 if word.istitle() or word.isupper() else min(len(word), 16) * 0.3


def log10_guesses(value: str, ranks: dict[str, int] = RANKS) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs.

    cost[i] is the cheapest cut of the first i characters; each segment multiplies the guesses of
    what came before, and every segment but the first adds a factor for the choice of pattern.  A
    segment is a word of ``ranks`` (in any case, letters may be replaced by look-alikes), a date, equal
    characters or a keyboard walk, both from where their run begins, or characters tried one by one.
    """
    n = len(value)
    lower = value.lower()
    if len(lower) != n:
        lower = value
    plain = lower.translate(_LEET)
    size = sum(k for k, seen in ((26, re.search(r"[a-z]", value)), (26, re.search(r"[A-Z]", value)), (10, re.search(r"[0-9]", value)), (33, re.search(r"[^a-zA-Z0-9]", value))) if seen)
    brute = math.log10(max(size, 10))
    cost = [0.0] + [math.inf] * n
    in_brute = [math.inf] * (n + 1)  # the same, where a brute-force span ends here and may go on
    for i in range(n):
        here = cost[i] + (JOINT if i else 0.0)

        def offer(end: int, extra: float, here=here) -> None:
            if here + extra < cost[end]:
                cost[end] = here + extra

        in_brute[i + 1] = min(in_brute[i], here) + brute
        cost[i + 1] = min(cost[i + 1], in_brute[i + 1])
        for m in range(min(WORD_LETTERS[1], n - i), WORD_LETTERS[0] - 1, -1):
            for form, extra in ((lower, 0.0), (plain, 0.3)):
                rank = ranks.get(form[i : i + m])
                if rank:
                    offer(i + m, math.log10(rank + 1) + extra + _case_cost(value[i : i + m]))
        d = _DATE.match(value, i)
        if d:
            offer(d.end(), 2.1 if len(d[0]) == 4 else 4.6)
        # repeated characters and walks: only from where the run begins, and to any of its ends
        if i == 0 or value[i] != value[i - 1]:
            j = i + 1
            while j < n and value[j] == value[i]:
                j += 1
                if j - i >= 3:
                    offer(j, brute + math.log10(j - i))
        if i == 0 or (lower[i - 1], lower[i]) not in _STEP:
            j = i + 1
            while j < n and (lower[j - 1], lower[j]) in _STEP:
                j += 1
                if j - i >= 3:
                    offer(j, 1.7 + math.log10(j - i))
    return cost[n]


def _trimmed(value: str) -> str:
    """value without the punctuation of what is around it: at its end, and closing brackets that it doesn't open."""
    spare = {c: value.count(c) - value.count(o) for c, o in CLOSERS.items()}
    end = len(value)
    while end and (value[end - 1] in ".!?,;" or spare.get(value[end - 1], 0) > 0):
        end -= 1
        if value[end] in spare:
            spare[value[end]] -= 1
    return value[:end]


def _value_at(text: str, at: int, bare_cue: bool) -> tuple[int, int, int]:
    """Start and end of the value at a cue's end, and the end of the part of it that is judged.

    Code that calls or indexes a name is judged by the name.  What follows bearer or basic is a value
    only if it doesn't read like a word.
    """
    quoted = None if bare_cue else QUOTED.match(text, at)
    scheme = SCHEME.match(text, quoted.start(2) if quoted else at)
    if quoted:
        a, z = quoted.span(2)
        if scheme and scheme.end() < z:
            a = scheme.end()
        return a, z, z
    if scheme:
        at = scheme.end()
    m = BARE.match(text, at)
    if not m:
        return at, at, at
    a = m.start(1)
    value = _trimmed(m[1])
    if (scheme or bare_cue) and not TOKEN.match(value):
        return a, a, a
    whole = a + len(value)
    return a, whole, min(whole, SHORT.match(text, a).end()) if CALL.fullmatch(value) else whole


def is_name(value: str, ranks: dict[str, int]) -> bool:
    """Whether an unquoted value is a name of code: joined or humped words that are all known."""
    return bool(NAME.fullmatch(value)) and all(h.lower() in ranks for h in HUMP.findall(value))


def cost_of(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses for a value; for an address, those for its dearest part, the scheme and host's words left out."""
    if not ADDRESS.match(value):
        return log10_guesses(value, ranks)
    rest = value.split("://", 1)[1]
    host = HOST.match(rest)
    parts = [p for p in PARTS.split(rest[host.end() :] if host else rest) if p]
    return max((log10_guesses(p, ranks) for p in parts if not PLAIN.fullmatch(p)), default=0.0)


def find_secrets(text: str | None, min_log10: float = 10.0, min_length: int = 8, ranks: dict[str, int] = RANKS) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind as in KINDS; null: none.

    Base spans are whole matches, leftmost and non-overlapping per kind.  A ``guess`` span is a whole
    value of at least ``min_length`` characters that no base span covers.
    """
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(c in low for c in CUES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(c in low for c in CUES):
        base, at, nth, covered = sorted(found), 0, 0, 0
        for m in CONTEXT.finditer(text):
            if m.end() < at:  # inside a value
                continue
            a, z, judged = _value_at(text, m.end(), m[0].endswith(" ") and ":" not in m[0] and "=" not in m[0])
            if judged - a < min_length or a < at:
                continue
            while nth < len(base) and base[nth][0] <= a:  # both go up, so each base span is looked at once
                covered = max(covered, base[nth][1])
                nth += 1
            if z <= covered or text[a - 1] not in "\"'`" and is_name(text[a:judged], ranks):
                continue
            if cost_of(text[a:judged], ranks) >= min_log10:
                found.append((a, z, "guess"))
                at = z
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """text with each span, or run of overlapping spans, replaced; of assignments only the value."""
    parts, at = [], 0
    for a, z, kind in spans:
        if kind == "assign":
            m = ASSIGN.match(text, a)
            a = m.start(2) if m else a
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, z)
    return "".join([*parts, text[at:]])


def _bare(token: bytes) -> bytes:
    """The word of 3 to 20 letters in a token, in lower case; or nothing."""
    w = token.strip(b".,;:!?\"'()[]").lower()
    return w if WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1] and w.isalpha() else b""


def _places(docs: list[str | None] | pa.Array, at_once: int = 500) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, documents, bits): one place a document for each spelling, told by a bit that the words beside it choose.

    The last place of a spelling counts, if no credential may stand there.
    """
    number: dict[bytes, int] = {}  # of tokens, in order
    words: dict[bytes, int] = {}
    word, check = np.empty(0, np.int64), np.empty(0, np.int64)  # by token: its word's number or -1, and its checksum, -1 before a credential
    held, bits = np.empty(0, np.int64), np.empty(0, np.uint64)
    for at in range(0, len(docs), at_once):
        part = docs[at : at + at_once]
        texts = [utf8(t).split() if t else [] for t in (part.to_pylist() if isinstance(part, pa.Array) else part)]
        known = len(number)
        token = np.array([number.setdefault(w, len(number)) for ws in texts for w in ws], np.int64)
        new = list(islice(number, known, None))
        bare = [_bare(w) for w in new]
        word = np.append(word, np.array([words.setdefault(w, len(words)) if w else -1 for w in bare], np.int64))
        check = np.append(check, np.array([-1 if w[-1] in b":=>" or CUE.search(w) else zlib.crc32(w) for w in new], np.int64))
        held, bits = np.append(held, np.zeros(len(words) - len(held), np.int64)), np.append(bits, np.zeros(len(words) - len(bits), np.uint64))
        doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
        i = np.flatnonzero((doc[2:] == doc[:-2]) & (word[token[1:-1]] >= 0))[::-1] + 1  # words between two of their text, the last ones first
        i = i[np.unique(doc[i] << 32 | token[i], return_index=True)[1]]
        i = i[check[token[i - 1]] >= 0]
        w = word[token[i]]
        np.bitwise_or.at(bits, w, np.uint64(1) << (check[token[i - 1]] + 31 * np.abs(check[token[i + 1]]) & 63).astype(np.uint64))
        held += np.bincount(np.unique(doc[i] << 32 | w) & 0xFFFFFFFF, minlength=len(words))
    return list(words), held, bits


def learned_words(docs: DataFrame, *, text: str = "text", most: int = 20_000, unlike: int = 24) -> list[str]:
    """The words that most documents hold, ``most`` at most, of those that stand between many different words; equal counts in order of the alphabet.

    A word is a run of 3 to 20 letters a-z in either case that stands by itself between blanks, but for
    punctuation around it.  Each document shows one place of it in each spelling, unless the text before
    it ends like a credential's name or in ``:``, ``=`` or ``>``; the words beside it set one of 64 bits, and a word is
    learned if ``unlike`` of them are set.  Copies of a text set the same bits, so they can't make a word of
    what they repeat.  Bits and counts are merged in the cluster; what comes to the driver, and is sent to
    the workers, is bounded by ``most``.
    """

    def count(batches):
        for b in batches:
            words, n, bits = _places(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n), pa.array(bits.view(np.int64))], names=["w", "n", "bits"])

    found = docs.select(text).mapInArrow(count, "w string, n long, bits long").groupBy("w").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits")).filter(F.bit_count("bits") >= unlike)
    # only words from the step of counts on that fills the list go into the sort, so its tasks send few more than ``most`` in all
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16).cast("long"))
    counted = cut(found.select("w", "n", step.alias("step")))
    least, left = 0, most
    for r in sorted(counted.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        least, left = r.step, left - r.words
        if left <= 0:
            break
    words = [r.w for r in counted.filter(F.col("step") >= least).orderBy(F.desc("n"), "w").limit(most).collect()]
    discard(counted)
    return words


def known_ranks(words: list[str]) -> dict[str, int]:
    """Ranks of the fixed words and, after them, of these."""
    out = dict(RANKS)
    for w in words:
        out.setdefault(w, len(out) + 1)
    return out


def scan(docs: DataFrame, *, text: str = "text", mask: bool = False, min_log10: float = 10.0, most_words: int = 20_000) -> DataFrame:
    """docs with secrets: array of {start, end, kind}; with mask, the text has the spans replaced.

    A null or empty text has no secrets and stays as it is; a column named secrets is replaced.  Repeated
    rows are scanned each on its own, texts of any length whole; an empty table gives an empty result.
    ``most_words`` bounds the words learned from docs (0: fixed ones only).
    """
    docs = docs.drop("secrets")
    ranks = docs.sparkSession.sparkContext.broadcast(known_ranks(learned_words(docs, text=text, most=most_words) if most_words else []))
    schema = docs.select("*", F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("secrets")).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def work(batches):
        for b in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            k = b.schema.names.index(text)
            texts = b.column(k).to_pylist()
            found = [find_secrets(t, min_log10, ranks=ranks.value) for t in texts]
            cols = list(b.columns)
            if mask:
                cols[k] = pa.array([masked(t, s) if s else t for t, s in zip(texts, found, strict=True)], b.schema.types[k])
            got = pa.array([[{"start": a, "end": z, "kind": x} for a, z, x in s] for s in found], kind)
            yield pa.RecordBatch.from_arrays([*cols, got], names=[*b.schema.names, "secrets"])

    return docs.mapInArrow(work, schema)


def masked_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with the secrets in their texts replaced, and all else as it was."""
    docs, restored = aside(docs, "secrets")
    return restored(scan(docs, mask=True, **options))


def base_digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(spans_text([s for s in spans if s[2] != "guess"]).encode()).hexdigest()


def digests(docs: DataFrame, **options) -> DataFrame:
    """docs with counts per base kind, base_sha256 and spans as text instead of the secrets.

    Columns of docs that bear these names, or secrets, are replaced; all else is as for ``scan``.
    """
    n = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = shown(F.filter("secrets", lambda s: s.kind != "guess"))
    return scan(docs, **options).withColumns({"n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex"), "base_sha256": F.sha2(base.cast("binary"), 256), "spans": shown(F.col("secrets"))}).drop("secrets")
