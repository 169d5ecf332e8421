"""Every operator on rows with nulls, empty and very long texts, repeats, clashing columns, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphquarry.llm import decontam, langid, lmscore, mixing, passages, periods, quality, secretscan, simhash, toxicity, warc

LONG = "the quick brown fox jumps over the lazy dog " * 20_000
ROWS = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \n\t ", "en", None),
    (4, "one two three four five", "de", "b"),
    (4, "one two three four five", "de", "b"),
    (5, "one two three four five", None, None),
    (None, "a text without an id", "en", "a"),
    (None, None, None, None),
    (6, LONG, "en", "a"),
    (7, LONG + "end", "fr", "b"),
    (8, "Über \U0001f600 çà   x y", "fr", "b"),
    (9, "12345 !!! ---", "en", "c"),
]
CLASHES = ("n_words", "spans", "items", "secrets", "score", "row_mark", "key", "fp", "i", "r", "m", "lo_symbol_rate", "f_lang", "runs", "collapsed", "nth", "got", "held_out", "label")
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two three four"), (None, "fox jumps over the lazy dog the quick brown fox jumps"), (3, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (6, 1), (8, 0), (None, 1), (9, None), (77, 1)], "doc_id long, toxic int")


OPERATORS = {
    "simhash": lambda d, b, y: simhash.near_duplicates(d),
    "toxicity": lambda d, b, y: toxicity.score_toxicity(d, y),
    "warc": lambda d, b, y: warc.round_trip(d, page_id="doc_id", html="text"),
    "quality": lambda d, b, y: quality.verdicts(d),
    "passages": lambda d, b, y: passages.repeated_passages(d),
    "langid": lambda d, b, y: langid.identify(d),
    "lmscore": lambda d, b, y: lmscore.score(d),
    "mixing": lambda d, b, y: mixing.mix(d),
    "secretscan": lambda d, b, y: secretscan.digests(d),
    "decontam": lambda d, b, y: decontam.contamination(d, b),
    "periods": lambda d, b, y: periods.periodic_runs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(name, odd, benchmark, labels):
    got = OPERATORS[name](odd, benchmark, labels).collect()
    ids = "page_id" if name == "warc" else "doc_id"
    assert sorted(str(r[ids]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty, benchmark, labels):
    assert OPERATORS[name](empty, benchmark, labels).collect() == []


@pytest.mark.parametrize("name", ["decontam", "toxicity"])
def test_empty_second_table(name, odd, benchmark, labels):
    assert OPERATORS[name](odd, benchmark.limit(0), labels.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_whole_values(stage, spark, odd, empty, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, odd, str(tmp_path))
    new = [] if stage is not corpus_pipeline.source_mixing else ["size", "source_size", "target", "taken"]
    assert got.columns == odd.columns + new
    assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHES)
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_defined_results(odd, benchmark):
    by = lambda df: {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    q = by(quality.verdicts(odd))
    assert q[1].n_words == q[2].n_words == q[3].n_words == 0 and not q[1].kept and q[1].base_failed
    s = by(simhash.near_duplicates(odd))
    assert s[1].fingerprint == s[2].fingerprint == s[3].fingerprint == "0" * 16
    assert s[1].component_id == s[3].component_id == 1 and s[5].component_id == 4
    lang = by(langid.identify(odd))
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (1, 2, 3, 9))
    m = by(mixing.mix(odd))
    assert m[1].size == m[2].size == m[3].size == 0 and m[1].taken == 0
    c = by(decontam.contamination(odd, benchmark))
    assert c[4].n_hit == 3 and c[1].n_words == 0 and c[6].contaminated
    p = by(passages.repeated_passages(odd))
    assert p[6].n_dup_words > 170_000 and p[4].n_dup_words == 0
    r = by(periods.periodic_runs(odd))
    assert r[1].n_words == r[3].n_words == 0 and r[1].runs == [] and r[2].collapsed == ""
    assert [tuple(x) for x in r[6].runs] == [(0, 180_000, 9)] and r[6].collapsed == "the quick brown fox jumps over the lazy dog"
    lm = by(lmscore.score(odd))
    assert lm[1].mean_log10 is None and lm[1].log10_score == 0
