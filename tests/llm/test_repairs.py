"""Secrets that copies must not hide, and fences that follow their source."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphquarry.llm import quality, secretscan

DOCS = "doc_id long, text string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in (int(rng.random() ** 2 * vocabulary) for _ in range(n)))


@pytest.mark.parametrize("change", [0, 0.05])
def test_copies_do_not_hide_a_secret(spark, change):
    rng = random.Random(8)
    other = [prose(rng, 60) for _ in range(150)]
    text = f"{prose(rng, 20)} pwd: qzvkwmxjhtrpbd {prose(rng, 20)} the qzvkwmxjhtrpbd again {prose(rng, 20)}"
    found = []
    for copies in (1, 2, 100):
        near = [" ".join(w if "qzv" in w or w == "pwd:" or rng.random() >= change else prose(rng, 1) for w in text.split()) for _ in range(copies - 1)]
        rows = list(enumerate([text, *near, *other]))
        spans = {r.doc_id: r.spans for r in secretscan.digests(spark.createDataFrame(rows, DOCS)).collect()}
        found.append(spans[0])
        assert all("guess" in spans[i] for i in range(copies)) and not any(spans[i] for i in range(copies, len(rows)))
    assert len(set(found)) == 1
    a = text.index("qzv")
    assert found[0] == f"guess:{a}:{a + 14}"


def test_a_password_of_many_documents_stays_a_secret(spark):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 30)} password {'=' if i % 2 else ':'} qzvkwmxjhtrpbd {prose(rng, 30)}") for i in range(120)]
    got = secretscan.scan(spark.createDataFrame(rows, DOCS).withColumn("text", F.replace("text", F.lit("password"), F.lit("passphrase")))).collect()
    assert all([s.kind for s in r.secrets] == ["guess"] for r in got)


def test_words_addresses_and_passphrases(spark):
    rng = random.Random(10)
    common = ["see", "the", "manual", "internationalization", "settings", "page", "please", "reset", "correct", "horse", "example", "on", "in"]
    rows = [(i, " ".join(rng.choice([*common, *prose(rng, 3).split()]) for _ in range(50))) for i in range(200)]
    harmless = ["see-the-manual", "https://example.com/reset", "internationalization", "https://docs.example.org/a/reset-page?lang=en", "TheManualPage", "example.settings.page", "2024-11-03"]
    secret = ["x7#Kp2vQm9!z", "https://svc:8fK2mQz7Lw4x@db.example.org/main", "zqvortex-plim-99-gandrule", "https://example.com/hook/T0B8Z2K9QX4M7W", "Mj4-tuvqe-Xo81", "qzvkwmxjhtrpbd"]
    for k, v in enumerate(harmless + secret):
        rows += [(1000 + 10 * k + j, f"{cue} {v} and so on") for j, cue in enumerate(("credentials:", "auth =", "pwd:"))]
    got = {r.doc_id: "guess" in r.spans for r in secretscan.digests(spark.createDataFrame(rows, DOCS)).collect()}
    wrong = [(v, j) for k, v in enumerate(harmless + secret) for j in range(3) if got[1000 + 10 * k + j] != (v in secret)]
    assert wrong == [] and not any(got[i] for i in range(200))


def test_the_pipeline_masks_guessed_values(spark, tmp_path):
    rng = random.Random(11)
    text = f"{prose(rng, 40)} pwd: qzvkwmxjhtrpbd {prose(rng, 40)}"
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.secret_masking(spark, docs, str(tmp_path)).collect()}
    assert got == {1: text.replace("qzvkwmxjhtrpbd", "[SECRET]"), 2: text.replace("qzvkwmxjhtrpbd", "[SECRET]"), 3: None}


# --- fences


def rated(rng, i, source, symbols, words=100):
    """A document with so many symbols in 1000 words, on the average."""
    w = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(round(symbols * words / 1000)):
        w[rng.randrange(words)] += "#"
    return (i, " ".join(w), "en", source)


def test_a_source_keeps_what_another_drops(spark):
    rng = random.Random(12)
    rows = [rated(rng, i, "code", rng.choice([60, 80, 100, 120, 150, 200])) for i in range(120)]
    rows += [rated(rng, 1000 + i, "news", rng.choice([0, 0, 0, 10, 20])) for i in range(120)]
    rows += [rated(rng, 5000, "code", 260), rated(rng, 5001, "news", 260)]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[5000] and not got[5001]
    assert all(got[r[0]] for r in rows[:-2])


def test_a_gap_parts_junk_from_the_rest(spark):
    rng = random.Random(13)
    rows = [rated(rng, i, "s", 0) for i in range(95)] + [rated(rng, 100 + i, "s", 400 + 20 * i) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.verdicts(docs).collect()}
    assert all(got[i] for i in range(95)) and not any(got[100 + i] for i in range(8))
    few = quality.fences(quality.sketches(quality.measured(docs.filter("doc_id < 95")))).first()
    assert few.hi_symbol_rate == 1 << 62  # zero everywhere: no fence


def test_small_groups_borrow(spark):
    rng = random.Random(14)
    rows = [rated(rng, i, f"s{i % 3}", rng.choice([0, 10, 20, 30]) * (1 + i % 3)) for i in range(180)] + [rated(rng, 900, "tiny", 20), rated(rng, 901, None, 30)]
    f = {r.source: r for r in quality.fences(quality.sketches(quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))).collect()}
    assert f["tiny"].hi_symbol_rate == f[None].hi_symbol_rate < 1 << 62
    assert len({f[s].hi_symbol_rate for s in ("s0", "s1", "s2", "tiny")}) == 4
