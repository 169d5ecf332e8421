"""Questions answered over the relations, any number of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.vocab import MAX_TESTS
from ..operators import context, rank, retrieve, tokens, trace
from ..operators.index import Relations
from ..storage import cut

_FILE = "struct<rank:int,file_id:bigint,path:string,language:string,line_count:bigint,is_test:boolean,score:int>"
_SYMBOL = "struct<rank:int,symbol_id:bigint,file_id:bigint,name:string,kind:string,path:string,line_start:bigint,line_end:bigint,signature:string,score:int>"
_TEST = "struct<rank:int,file_id:bigint,path:string>"
_STEP = "struct<step:int,symbol_id:bigint,name:string,kind:string,path:string,line_start:bigint,depth:int>"


def _fields(kind: str) -> list[str]:
    return [x.split(":")[0] for x in kind[len("struct<") : -1].split(",")]


def related_tests(files: DataFrame, rel: Relations) -> DataFrame:
    """query_id, file_id, rank: test files with edges to candidates (query_id, file_id, ord), first come first."""
    e = rel["edges"].filter("kind = 'tests' and source_file_id is not null").select(F.col("id").alias("edge_id"), F.col("source_file_id").alias("test_id"), F.col("target_file_id").alias("file_id"))
    hits = files.join(e, "file_id").groupBy("query_id", "test_id").agg(F.min(F.struct("ord", "edge_id")).alias("o"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("o"))
    return hits.select("query_id", F.col("test_id").alias("file_id"), r.alias("rank")).filter(F.col("rank") <= MAX_TESTS)


def analyze(asks: DataFrame, rel: Relations, names: retrieve.Names | None = None) -> DataFrame:
    """query_id, ask, keywords, files, symbols, tests, paths, subsystems and index counts, one row per question.

    asks has query_id and ask.  A question about process, or one without a rare enough keyword, has
    empty results.  The steps are cut into tables of the shared folder, since one plan of all of them takes
    longer to analyse than to run.  files, symbols, tests and paths are arrays of structs in order of rank; a path is
    its seed and what it reaches, step by step.  Relations of several repositories have a column repo, and ids
    of their own in all of them; then each question is answered for each repository, in as many jobs as for one,
    and the rows have repo as well.  ``names`` are gram indexes of the relations, if they were built.
    """
    files, symbols, calls = rel["files"], rel["symbols"], rel["calls"]
    on = ["repo"] if "repo" in files.columns else []
    if on:  # a question of one repository is a question of its own
        asks = asks.crossJoin(files.select("repo").union(symbols.select("repo")).distinct()).withColumn("query_id", F.struct("repo", "query_id"))
        named = lambda df, c: df.withColumn(c, F.concat_ws("\0", "repo", c))
        traced_calls, traced_symbols = named(calls, "callee_name"), named(symbols, "name")
    else:
        traced_calls, traced_symbols = calls, symbols
    asked = asks.select("query_id", "ask").filter(~text.is_meta(F.col("ask")))
    own = retrieve.keyword_rows(asked)
    about = asked.select("query_id", text.about_tests(text.keywords(F.col("ask"))).alias("about_tests"))
    kws = cut(retrieve.weighted(cut(retrieve.with_synonyms(own)), files, symbols, names))
    f, s = retrieve.candidates(kws, files, symbols, rel["imports"], calls, names)
    where = symbols.select(F.col("id").alias("symbol_id"), "file_id", "name", "kind", "line_start", "line_end", "signature").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    f, s = cut(f), cut(s.join(where, "symbol_id"))
    hosts = s.groupBy("query_id", "file_id").agg(F.min("ord").alias("o")).select("query_id", "file_id", F.struct(F.lit(1 << 30).alias("term_ord"), F.lit(99).alias("channel"), F.col("file_id").alias("id")).alias("ord"))
    all_f = f.unionByName(hosts).groupBy("query_id", "file_id").agg(F.min("ord").alias("ord"))
    facts = files.select(F.col("id").alias("file_id"), "path", "language", "size", "line_count", "is_test")
    tests = related_tests(all_f, rel)
    cands = all_f.select("query_id", "file_id").join(facts, "file_id")
    scored_s = rank.symbol_scores(s, kws, rank.file_scores(cands, kws, about))
    best_s = cut(rank.best_symbols(scored_s))
    seeds = rank.seeds(best_s).select("query_id", F.col("symbol_id").alias("seed"), "rank")
    walked = trace.first_traced(seeds.select("seed"), traced_calls, traced_symbols)
    steps = cut(seeds.join(walked, "seed").join(where, "symbol_id"))
    reached = steps.select("query_id", "file_id").distinct()
    hosted = best_s.groupBy("query_id", "file_id").agg(F.count("*").alias("n"))
    every = all_f.select("query_id", "file_id").unionByName(reached).distinct().join(facts, "file_id")
    best_f = cut(rank.best_files(rank.file_scores(every, kws, about, hosted)))

    def listed(df: DataFrame, name: str, kind: str) -> DataFrame:
        return df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*_fields(kind)))).cast(f"array<{kind}>").alias(name))

    root = seeds.withColumn("symbol_id", F.col("seed")).join(where, "symbol_id").select("query_id", "seed", "rank", F.lit(0).alias("step"), "symbol_id", "name", "kind", "path", "line_start", F.lit(0).alias("depth"))
    path = root.unionByName(steps.select("query_id", "seed", "rank", "step", "symbol_id", "name", "kind", "path", "line_start", "depth"))
    one = path.groupBy("query_id", "seed", "rank").agg(F.array_sort(F.collect_list(F.struct(*_fields(_STEP)))).cast(f"array<{_STEP}>").alias("p")).filter(F.size("p") > 1)
    many = one.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda x: x.p).alias("paths"))
    shown_tests = tests.join(facts.select("file_id", "path"), "file_id")
    words = kws.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kw"))), lambda x: x.kw).alias("keywords"))
    subs = best_f.select("query_id", paths.subsystem(F.col("path")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_set("x")).alias("subsystems"))
    out = asks.select("query_id", "ask")
    for df in (words, listed(best_f, "files", _FILE), listed(best_s, "symbols", _SYMBOL), listed(shown_tests, "tests", _TEST), many, subs):
        out = out.join(df, "query_id", "left")
    n_files, n_symbols = files.groupBy(*on).agg(F.count("*").alias("index_file_count")), symbols.groupBy(*on).agg(F.count("*").alias("index_symbol_count"))
    if on:
        counts = n_files.join(n_symbols, on, "full_outer").na.fill(0)
        out = out.withColumn("repo", F.col("query_id.repo")).join(counts, on).withColumn("query_id", F.col("query_id.query_id"))
    else:
        out = out.crossJoin(F.broadcast(n_files.crossJoin(n_symbols)))
    empty = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    return out.select(*on, "query_id", "ask", empty("keywords", "string"), empty("files", _FILE), empty("symbols", _SYMBOL), empty("tests", _TEST), empty("paths", f"array<{_STEP}>"), empty("subsystems", "string"), "index_file_count", "index_symbol_count")


def judged(results: DataFrame) -> DataFrame:
    """results with skip_reason: null where they are strong enough to give."""
    names = F.transform("symbols", lambda s: s["name"])
    return results.withColumn("skip_reason", context.skip_reason(F.size("files"), F.size("symbols"), F.size("paths"), context.anchored(names, F.col("ask"))))


def _sizes() -> tuple[Column, ...]:
    return F.size("files"), F.size("symbols"), F.aggregate("paths", F.lit(0), lambda n, p: n + F.size(p)), F.size("tests")


def counted(results: DataFrame) -> DataFrame:
    """query_id, n_files, n_symbols, n_steps, n_tests of results."""
    return results.select("query_id", *(c.alias(n) for c, n in zip(_sizes(), ("n_files", "n_symbols", "n_steps", "n_tests"), strict=True)))


def together(repositories: dict[str, Relations]) -> Relations:
    """The relations of all repositories in one, with repo; an id becomes its own times their number, plus the repository's place."""
    size = len(repositories)
    ids = {"files": ("id",), "symbols": ("id", "file_id", "parent_symbol_id"), "imports": ("id", "file_id"), "calls": ("id", "caller_symbol_id"), "edges": ("id", "source_file_id", "source_symbol_id", "target_file_id", "target_symbol_id")}
    out: Relations = {}
    for k, (repo, rel) in enumerate(sorted(repositories.items())):
        for t, keys in ids.items():
            df = rel[t].withColumns({c: F.col(c) * size + k for c in keys if c in rel[t].columns}).withColumn("repo", F.lit(repo))
            out[t] = out[t].unionByName(df) if t in out else df
    return out


def analyze_repositories(asks: DataFrame, repositories: dict[str, Relations]) -> DataFrame:
    """analyze for all repositories at once, with repo, score, kept and rank: the best first, the weak not kept.

    Ids in the results are the repositories' own.
    """
    size = len(repositories)
    r = analyze(asks, together(repositories))

    def own(kind: str):
        return lambda x: F.struct(*((F.floor(x[c] / size) if c.endswith("_id") else x[c]).alias(c) for c in _fields(kind)))

    r = r.withColumns({c: F.transform(c, own(kind)) for c, kind in (("files", _FILE), ("symbols", _SYMBOL), ("tests", _TEST))})
    r = r.withColumn("paths", F.transform("paths", lambda p: F.transform(p, own(_STEP))))
    scored = rank.relevance(r.withColumns({c: x for c, x in zip(("n_files", "n_symbols", "n_steps", "n_tests"), _sizes(), strict=True)}))
    return rank.best_repositories(scored.withColumn("ord", F.col("repo")))


def estimated(results: DataFrame, rel: Relations, contents: DataFrame) -> DataFrame:
    """Simulated session costs of each question (see operators.tokens.simulated)."""
    package = context.packaged(results, contents, mode="full", snippet_lines=999)
    asked = package.select("query_id", F.size("keywords").alias("n_keywords"), F.size("symbols").alias("n_symbols"), text.token_estimate(context.as_text(F.col("package"))).alias("context_tokens"))
    size = contents.join(rel["files"].select("path", F.col("id").alias("file_id"), "language", "is_test"), "path").select("file_id", "path", "language", "is_test", text.token_estimate(F.col("content")).alias("tokens"))
    of = lambda c: results.select("query_id", F.explode(c).alias("x"))
    ids = of("files").select("query_id", "x.file_id").unionByName(of("symbols").select("query_id", "x.file_id")).unionByName(of("tests").select("query_id", "x.file_id"))
    steps = of("paths").select("query_id", F.posexplode("x").alias("nth", "s")).select("query_id", "nth", F.col("s.path").alias("path")).join(size, "path")
    relevant = ids.unionByName(steps.select("query_id", "file_id")).distinct().join(size, "file_id").select("query_id", "file_id", "tokens")
    known = size.filter("language is not null and not is_test")
    words = results.select("query_id", F.explode("keywords").alias("term"))
    named = retrieve.matched(known, "path", words, wild=False).join(words, "term").select("query_id", "file_id", "tokens").distinct()
    others = named.join(relevant.select("query_id", "file_id"), ["query_id", "file_id"], "left_anti")
    targeted = of("symbols").select("query_id", "x.file_id").unionByName(steps.filter("nth < 2").select("query_id", "file_id")).distinct().join(relevant, ["query_id", "file_id"])
    totals = rel["files"].agg(F.count("*").alias("n_files")).crossJoin(tokens.dir_depth(rel["files"]))
    return tokens.simulated(asked, relevant, others, targeted, totals)


def shown_file(rel: Relations, path: str) -> DataFrame:
    """Symbols of a file, in order."""
    return rel["symbols"].join(rel["files"].filter(F.col("path") == path).select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("line_start", "id")


def shown_symbol(rel: Relations, name: str) -> DataFrame:
    """Symbols of a name, with their files and how many call them."""
    hit = rel["symbols"].filter(F.col("name") == name)
    callers = rel["calls"].filter(F.col("callee_name") == name).agg(F.count_distinct("caller_symbol_id").alias("n_callers"))
    return hit.join(rel["files"].select(F.col("id").alias("file_id"), "path"), "file_id").crossJoin(callers)
