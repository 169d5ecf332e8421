"""Periodic runs, source divergence and packing against plain versions of what they compute."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphquarry.llm import divergence, packing, periods
from graphquarry.llm import queries as q

# --- periodic runs


def plain_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        s = 0
        while s + p < n:
            e = s + p
            while e < n and words[e] == words[e - p]:
                e += 1
            if e - s >= max(6, 4 * p):
                found.setdefault((s, e), p)
            s = max(s + 1, e - p + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6))
def test_runs_like_brute_force(texts):
    assert periods.find_runs(texts) == [plain_runs(t) for t in texts]


def test_runs_of_periodic_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        unit = [rng.randrange(50) for _ in range(rng.randint(1, 30))]
        texts.append([rng.randrange(50) for _ in range(rng.randint(0, 20))] + (unit * 12)[: rng.randint(1, 12 * len(unit))] + [rng.randrange(50) for _ in range(rng.randint(0, 20))])
    texts.append([1, 2, 3, 1, 2, 3] * 400 + [9] * 900 + [1, 2] * 3)
    assert periods.find_runs(texts) == [plain_runs(t) for t in texts]
    assert sum(map(len, periods.find_runs(texts))) > 30


def test_grid_in_small_chunks():
    texts = [[1, 2] * 20, [3] * 30, list(range(50))]
    x, starts, sizes = periods._joined(texts)
    whole, parts = list(periods._grid(x, starts, sizes)), list(periods._grid(x, starts, sizes, chunk=7))
    for k in (0, 1):
        assert np.concatenate([f[k] for f in whole]).tolist() == np.concatenate([f[k] for f in parts]).tolist()


def plain_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_over_the_table(spark):
    got = q.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    short = {i: t for i, t in docs.items() if len((t or "").split()) < 1500}
    assert len(got) == len(docs) and len(short) > 150
    by = {r.doc_id: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in got}
    assert {i: by[i] for i in short} == {i: plain_op11(i, t) for i, t in short.items()}
    assert sum(r.n_runs > 0 for r in got) >= 8


def test_op11_of_odd_rows(spark, tmp_path):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    texts = ["", None, " \n", "one", "a b", "a b c d e f g h i j", "x " * 50, "a b a b a b a b", " ".join(f"w{i}" for i in range(200)), "é　é " * 9, "a\x0bb\x0ca\tb\ra b a b", "q"]
    rows = [*zip(ids, texts), *((i + 1000, t) for i, t in enumerate(texts)), (None, "u v " * 9), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = q.op11_periodic_runs(spark, str(tmp_path)).collect()
    by = lambda r: (str(r[0]), str(r))
    want = [(i, *plain_op11(i, t)) if i is not None else (None, *plain_op11(1001, t)) for i, t in rows]
    assert sorted((tuple(r) for r in got), key=by) == sorted(want, key=by)


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "say no no no no no no more"), (2, "as  it\nwas"), (3, None)], "doc_id long, text string").withColumn("runs", F.lit("own"))
    got = {r.doc_id: (r.text, r.runs) for r in periods.without_repeats(docs).collect()}
    assert got == {1: ("say no more", "own"), 2: ("as  it\nwas", "own"), 3: (None, "own")}


# --- source divergence


def plain_audit(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for lang, source, t in rows]
    in_docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        in_docs[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in in_docs:
        kept = [w for w, n in in_docs[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in count.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def share(c, kept=kept):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}

        p, q_ = {s: share(c) for s, c in groups.items()}, share(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = [(-sum(far(p[s][w], p[o][w]) for w in kept), o.encode()) for o in groups if o != s]
            terms = [(-far(p[s][w], q_[w]), w.encode()) for w in kept if c[w] and p[s][w] > q_[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


def some_documents(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "a", "naïve", "Ünder", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    rows = []
    for k in range(n):
        source = rng.choice(["hot"] * 6 + [f"s{i}" for i in range(9)] + [None])
        pool = words if source == "hot" else words[: 20 + hash(str(k % 7)) % 40]
        rows.append((rng.choice(["en", "de", None]), source, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))))
    return [*rows, ("en", "none", None), ("en", "blank", "12 !!"), ("xx", "only", "a a a"), ("yy", "one", "a"), ("yy", "two", "b"), *[("zz", "same", "k k")] * 4]


@pytest.mark.parametrize(("heavy", "cells", "block"), [(0.25, 1_000_000, 64), (0.5, 30, 2), (1.0, 1000, 64), (0.0, 40, 3)])
def test_audit_like_brute_force(spark, heavy, cells, block):
    rows = some_documents(120, 7)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("own"), "n": F.lit(1), "tile": F.lit(2)})
    got = divergence.audit(docs, heavy=heavy, cells=cells, block=block, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, top=5)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_counts_are_sent_in_parts(spark):
    rows = some_documents(60, 9)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1).select("lang", "source", "text")
    add = lambda df: {(r.lang, r.source, r.term): (r.n, r.docs) for r in df.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    assert add(divergence.counted(docs, most=5)) == add(divergence.counted(docs))


def test_shares_of_large_counts():
    n, of = np.array([0, 5, 3 * 10**14, 10**15 - 1]), np.array([10**15] * 4)
    assert divergence.share(n, of).tolist() == [1 + 10**9 * (int(x) + 1) // 10**15 for x in n]


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return path("word_bpe_49k.json"), Tokenizer.from_file(path("word_bpe_49k.json"))


ODD = ["", "It's WE'LL they'd 'S can't'", "<|endoftext|> a<|endoftext|>b <| |>", "x　y z\x1cw\x85v", "é ́a İI ß Σς", "!!!'s ...'t 123 4a5", "漢字かな交じり" * 30, "😀👍🏽 ok", "\x00\x01 \x7f", "a" * 500, "ﬁ ½ Å", "가 ᆨ"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(ODD), st.text(alphabet="abcS'tlR. !<|0é́ \n", max_size=40)), max_size=5))
def test_ids_are_the_tokenizers(texts):
    from public_tokenizers import path

    e = packing.encoder(path("word_bpe_49k.json"), True)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [np.frombuffer(x, e.kind).tolist() for x in (e.encode(t.encode()) for t in texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetful_encoder(tokenizer):
    few = packing.Encoder(tokenizer[0], most=2)
    texts = [*ODD, *ODD, "one two three four five six one two"]
    assert [np.frombuffer(x, few.kind).tolist() for x in (few.encode(t.encode()) for t in texts)] == [tokenizer[1].encode(t, add_special_tokens=False).ids for t in texts]


def plain_first_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        for b in bins:
            if sum(b) + s <= capacity:
                b.append(s)
                break
        else:
            bins.append([s])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80), st.sampled_from([1, 4, 64, 99]))
def test_groups_are_packed_whole(sizes, hole):
    got = packing.pack_group(sizes, 64, hole)
    seen = defaultdict(list)
    for seq in got:
        assert 0 < sum(z - a for _, a, z in seq) <= 64
        for k, a, z in seq:
            assert a < z
            seen[k].append((a, z))
    for k, n in enumerate(sizes):
        spans = sorted(seen[k])
        assert [a for a, _ in spans] + [n] == [0] + [z for _, z in spans] or not n and not spans
    padded = [64 - f for f in (sum(z - a for _, a, z in s) for s in got) if f & (f - 1)]
    assert all(p < hole for p in padded) or hole == 99
    if hole == 99:
        assert sorted(map(sorted, ([z - a for _, a, z in s] for s in got))) == sorted(map(sorted, plain_first_fit([s for s in sizes if s], 64)))


def check_packing(rows, docs, tok, capacity=2048):
    """Every id of every document in one piece; sequences gapless, none over capacity; the padding's share."""
    ids = defaultdict(list)
    for r in rows:
        ids[r.doc_id].append(r)
    for i, t in docs:
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at, got = 0, []
        for r in sorted(ids.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            got += np.frombuffer(r.ids, "<u4").tolist()
            at += r.length
            assert at == len(got)
        assert got == want
    assert not ids
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding / (sum(len(r.ids) // 4 for r in rows) + padding)


@pytest.mark.parametrize(("capacity", "group"), [(2048, 4096), (128, 30)])
def test_packing_is_a_round_trip(spark, tokenizer, capacity, group):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, tokenizer[0], capacity=capacity, group_docs=group).collect()
    share = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer[1], capacity)
    assert share < 0.01 if capacity == 2048 else share < 0.12
    again = packing.pack(docs, tokenizer[0], capacity=capacity, group_docs=group).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_packing_of_odd_rows(spark, tokenizer):
    texts = [*ODD, None, "word " * 5000, "tail " * 2047]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("own") for c in ("start", "ids", "group", "row", "sequence_id", "c_doc_id")})
    rows = packing.pack(docs, tokenizer[0]).collect()
    check_packing(rows, list(enumerate(texts)), tokenizer[1])
    assert packing.pack(docs.limit(0), tokenizer[0]).collect() == []
    alike = spark.createDataFrame([(None, "a b")] * 3 + [(5, "a b")] * 2, "doc_id long, text string")
    got = packing.pack(alike, tokenizer[0], group_docs=2).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == {None: 3, 5: 2} and sum(r.length for r in got) == 15


def test_op13_tells_checksums(spark):
    rows = q.op13_packing(spark, "/root/testdata/sf0.001").collect()
    assert set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    from public_tokenizers import path

    real = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), path("word_bpe_49k.json")).collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in rows} == real
