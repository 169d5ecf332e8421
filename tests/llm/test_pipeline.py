"""The pipeline against a plain version, stage by stage."""

import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from graphquarry.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_masking", "source_mixing"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_groups(texts, alike=0.8):
    """Least member by member, of texts linked where their sets of five-word shingles are alike."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    at = {i: i for i in texts}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= alike * len(sets[a] | sets[b])) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                at[y] = x
    return {i: find(i) for i in texts}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_decontaminated(text, windows):
    """text without its runs of words inside windows; None if those are over half of all."""
    found = list(WORD.finditer(low(text)))
    words, hit = [m[0] for m in found], set()
    for n in {len(w) for w in windows}:
        for a in range(len(words) - n + 1):
            if tuple(words[a : a + n]) in windows:
                hit |= set(range(a, a + n))
    if 2 * len(hit) > len(words):
        return None
    out, at = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[at : found[k].start()])
        at = found[k].end()
    return "".join([*out, text[at:]])


def plain_masked(text):
    """text with what the three base patterns find replaced, of assignments only the value."""
    spans = [m.span(2) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII) if len(m[2]) >= 12]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out, at = [], 0
    for a, z in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def test_run_like_a_plain_version(spark, docs):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({queries.ORACLE_SQL['op4_quality_rules']}) where kept").fetchall()}
    rows = {r.doc_id: r.asDict() for r in docs.collect() if r.doc_id in kept}
    group = plain_groups({i: r["text"] for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if group[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(low(r.text or ""))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    for i, r in list(rows.items()):
        left = plain_decontaminated(r["text"], windows)
        if left is None:
            del rows[i]
        else:
            r["text"] = plain_masked(left)
    con.execute("drop view documents")
    con.register("documents", pd.DataFrame(list(rows.values())))
    mixed = con.execute(f"select doc_id, size, source_size, target, taken from ({queries.ORACLE_SQL['op8_mixing']}) where taken > 0").fetchall()
    assert {r[0] for r in mixed} == set(got)
    for i, size, source_size, target, taken in mixed:
        r = got[i]
        assert (r.size, r.source_size, r.taken, r.text) == (size, source_size, taken, rows[i]["text"]) and r.target == pytest.approx(target)


def test_queries_and_sql_agree_on_names():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
