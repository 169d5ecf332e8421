"""Packages of results under a mode's limits, as structs, JSON and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_edit, snippet
from ..functions.vocab import MIN_FUZZY, MODE_LIMITS

_LIMITS = ("files", "symbols", "paths", "depth", "steps", "tests", "snippets", "snippet_lines")


def detected_mode(n_files: Column, n_subsystems: Column, n_paths: Column) -> Column:
    """brief for few files of one subsystem, or few files without call paths; else focused."""
    return F.when((n_files <= 3) & (n_subsystems <= 1), "brief").when((n_files <= 5) & (n_paths == 0), "brief").otherwise("focused")


def skip_reason(n_files: Column, n_symbols: Column, n_paths: Column, anchored: Column) -> Column:
    """Why a result is too weak to give: all_empty, files_without_symbols or weak_single_symbol; null if it isn't."""
    return (
        F.when((n_files == 0) & (n_symbols == 0) & (n_paths == 0), "all_empty")
        .when((n_symbols == 0) & (n_paths == 0), "files_without_symbols")
        .when((n_paths == 0) & (n_symbols <= 1) & ~anchored, "weak_single_symbol")
    )


def anchored(names: Column, prompt: Column) -> Column:
    """A name stands in the prompt as a whole token, or one edit from one."""
    tokens = F.filter(F.split(F.lower(prompt), "[^\\p{L}\\p{N}_$]+"), lambda t: t != "")
    low = F.transform(names, lambda n: F.lower(n))
    near = F.exists(low, lambda n: (F.octet_length(n) >= MIN_FUZZY) & F.exists(tokens, lambda t: one_edit(t, n)))
    return F.coalesce(F.arrays_overlap(low, tokens), F.lit(False)) | near


def limits(mode: Column, snippet_lines: int = 30) -> Column:
    """struct of a mode's limits; focused is the default, and only full shows more than 30 lines of a snippet."""
    one = lambda m: F.struct(*(F.lit(min(v, snippet_lines) if k == "snippet_lines" and m == "focused" else snippet_lines if k == "snippet_lines" and m == "full" else v).alias(k) for k, v in zip(_LIMITS, MODE_LIMITS[m], strict=True)))
    return F.when(mode == "brief", one("brief")).when(mode == "full", one("full")).otherwise(one("focused"))


def reason(symbol_hits: Column, keyword_hits: Column) -> Column:
    """2 symbols, 1 keyword."""
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s")))
    return F.concat_ws(", ", part(symbol_hits, "symbol"), part(keyword_hits, "keyword"))


def keyword_hits(path: Column, kws: Column) -> Column:
    low = F.lower(path)
    return F.size(F.filter(kws, lambda k: F.contains(low, k)))


def packaged(results: DataFrame, contents: DataFrame | None = None, *, mode: str = "auto", snippet_lines: int = 30) -> DataFrame:
    """results (see plans.analyze) with mode and package, cut to the mode's limits.

    contents (path, content) are joined for snippets; auto picks brief or focused by the result.
    """
    n = {c: F.size(c) for c in ("files", "symbols", "paths")}
    chosen = detected_mode(n["files"], F.size("subsystems"), n["paths"]) if mode == "auto" else F.lit(mode)
    r = results.withColumn("mode", chosen).withColumn("_l", limits(F.col("mode"), snippet_lines))
    cap = lambda c, k: F.slice(c, 1, F.col(f"_l.{k}"))
    hosted = lambda f: F.size(F.filter("symbols", lambda s: s.file_id == f.file_id))
    files = F.transform(cap("files", "files"), lambda f: F.struct(f.path.alias("path"), f.language.alias("language"), f.line_count.alias("lines"), f.is_test.alias("is_test"), hosted(f).alias("symbol_hits"), keyword_hits(f.path, F.col("keywords")).alias("keyword_hits")))
    symbols = F.transform(cap("symbols", "symbols"), lambda s: F.struct(s["name"].alias("name"), s.kind.alias("kind"), s.path.alias("file"), s.line_start.alias("line_start"), s.line_end.alias("line_end"), s.signature.alias("signature")))
    step = lambda s: F.struct(s["name"].alias("symbol"), s["kind"].alias("kind"), s["path"].alias("file"), s["line_start"].alias("line"), s["depth"].alias("depth"))
    paths = F.transform(cap("paths", "paths"), lambda p: F.transform(F.slice(F.filter(p, lambda s: s.depth <= F.col("_l.depth")), 1, F.col("_l.steps")), step))
    r = r.withColumn("snippets", F.expr("cast(array() as array<struct<file:string,symbol:string,line_start:bigint,line_end:bigint,code:string>>)"))
    if contents is not None:
        wanted = r.select("query_id", "_l", F.posexplode(cap("symbols", "snippets")).alias("pos", "s")).select("query_id", "_l", "pos", "s.*")
        shown = wanted.join(contents.select("path", "content"), "path").withColumn("got", snippet(F.col("content"), F.col("line_start"), F.col("line_end"), F.col("_l.snippet_lines")))
        entry = F.struct("pos", F.col("path").alias("file"), F.col("name").alias("symbol"), "line_start", F.col("got.line_end").alias("line_end"), F.col("got.code").alias("code"))
        per = shown.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s.dropFields("pos")).alias("_s"))
        r = r.join(per, "query_id", "left").withColumn("snippets", F.coalesce("_s", "snippets")).drop("_s")
    package = F.struct("ask", "keywords", "subsystems", paths.alias("execution_paths"), files.alias("key_files"), symbols.alias("key_symbols"), F.transform(cap("tests", "tests"), lambda t: F.struct(t.path.alias("path"))).alias("relevant_tests"), "snippets", "index_file_count", "index_symbol_count")
    return r.withColumn("package", package).drop("_l", "snippets")


def as_json(package: Column) -> Column:
    return F.to_json(package)


def as_text(package: Column) -> Column:
    """A full account of a package in plain text, section by section; empty sections are left out."""
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(lines, "\n")))
    p = package
    why = lambda f: F.when(reason(f.symbol_hits, f.keyword_hits) != "", F.concat(F.lit(" ("), reason(f.symbol_hits, f.keyword_hits), F.lit(")"))).otherwise("")
    files = F.transform(p["key_files"], lambda f: F.concat(F.lit("  "), f.path, why(f)))
    symbols = F.transform(p["key_symbols"], lambda s: F.concat(F.lit("  "), s["kind"], F.lit(" "), s["name"], F.lit(" "), s["file"], F.lit(":"), s["line_start"].cast("string"), F.lit("-"), s["line_end"].cast("string")))
    steps = F.transform(p["execution_paths"], lambda t: F.concat(F.lit("  "), F.array_join(F.transform(t, lambda s: F.concat(F.repeat(F.lit("  "), s["depth"]), s["symbol"], F.lit(" "), s["file"], F.lit(":"), s["line"].cast("string"))), "\n  ")))
    tests = F.transform(p["relevant_tests"], lambda t: F.concat(F.lit("  "), t.path))
    code = F.transform(p["snippets"], lambda s: F.concat(F.lit("  "), s["symbol"], F.lit(" "), s["file"], F.lit(":"), s["line_start"].cast("string"), F.lit("\n"), s["code"]))
    head = F.concat(F.lit("Question: "), p["ask"], F.lit("\nKeywords: "), F.array_join(p["keywords"], ", "), F.lit("\nSubsystems: "), F.array_join(p["subsystems"], ", "))
    return F.concat_ws("\n", head, section("Call paths", steps), section("Files", files), section("Symbols", symbols), section("Tests", tests), section("Code", code))


def as_summary(package: Column) -> Column:
    """Files with reasons, symbols and tests, without code."""
    return as_text(package.withField("snippets", F.slice(package["snippets"], 1, 0)).withField("execution_paths", F.slice(package["execution_paths"], 1, 1)))
