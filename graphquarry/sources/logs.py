"""Event logs of agent runs, in two forms, and documents of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_USAGE = "struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>"
_EVENT_A = f"type string, message struct<usage:{_USAGE},content:string>, num_turns long, total_cost_usd double, usage {_USAGE}, result string, duration_ms long"
_ITEMS = "array<struct<type:string,name:string,input:struct<file_path:string,command:string,pattern:string>>>"
_EVENT_B = "type string, data struct<toolRequests:array<struct<name:string>>,toolName:string,success:boolean,content:string>, usage struct<totalApiDurationMs:long,sessionDurationMs:long,premiumRequests:double>"

# Tools that look around, and tools that work on files.
NAVIGATION = ("Grep", "Glob", "Bash", "Agent")
PRODUCTIVE = ("Read", "Edit", "Write", "NotebookEdit")


def log_files(spark: SparkSession, root: str) -> list[str]:
    """Logs below root: those of its round folders first, then its own, each in order of name."""
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(sc._jsc.hadoopConfiguration())
    found = lambda pattern: sorted(str(f.getPath().toString()) for f in fs.globStatus(sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")) or [])
    return found("round*/*.jsonl") + found("*.jsonl")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """run (file name), line_no, line of text logs; line numbers count within a file."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("run"), F.posexplode(F.split("value", "\\r?\\n")).alias("line_no", "line"))
    return raw.filter("trim(line) <> ''")


def events(lines: DataFrame, schema: str = _EVENT_A) -> DataFrame:
    """lines with event e; lines that aren't JSON are dropped."""
    return lines.withColumn("e", F.from_json("line", schema, {"mode": "PERMISSIVE"})).filter(F.col("e.type").isNotNull()).drop("line")


def tool_calls(lines: DataFrame) -> DataFrame:
    """run, line_no, pos, tool, file_path, is_navigation of form A's assistant events.

    Paths of shell commands are what ``cat`` shows first, or ``head`` of a source file.
    """
    items = events(lines).filter("e.type = 'assistant'").select("run", "line_no", F.posexplode(F.from_json("e.message.content", _ITEMS)).alias("pos", "i")).filter("i.type = 'tool_use'")
    cmd = F.col("i.input.command")
    shown = F.nullif(F.regexp_extract(cmd, "cat\\s+(\\S+)", 1), F.lit(""))
    headed = F.nullif(F.regexp_extract(cmd, "head\\s+.*?(\\S+\\.(?:ts|js|py|rs|go|java|c|cpp|cs))", 1), F.lit(""))
    path = F.when(F.col("i.name").isin("Read", "Edit", "Write"), F.col("i.input.file_path")).when(F.col("i.name") == "Bash", F.coalesce(shown, headed))
    return items.select("run", "line_no", "pos", F.col("i.name").alias("tool"), path.alias("file_path"), F.col("i.name").isin(*NAVIGATION).alias("is_navigation"))


def usages(lines: DataFrame) -> DataFrame:
    """run, turn, input_tokens, output_tokens, cache_read, cache_creation of form A's assistant events, numbered in order."""
    u = events(lines).filter("e.type = 'assistant' and e.message.usage is not null")
    zero = lambda c: F.coalesce(F.col(f"e.message.usage.{c}"), F.lit(0))
    turn = F.row_number().over(Window.partitionBy("run").orderBy("line_no"))
    return u.select("run", turn.alias("turn"), zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), zero("cache_read_input_tokens").alias("cache_read"), zero("cache_creation_input_tokens").alias("cache_creation"))


def run_results(lines: DataFrame) -> DataFrame:
    """run, cost_usd, turns, input_tokens (fresh and cached), output_tokens, preview: form A's last result event."""
    last = events(lines).filter("e.type = 'result'").groupBy("run").agg(F.max_by("e", "line_no").alias("e"))
    zero = lambda c: F.coalesce(F.col(f"e.usage.{c}"), F.lit(0))
    every = zero("input_tokens") + zero("cache_read_input_tokens") + zero("cache_creation_input_tokens")
    return last.select("run", F.coalesce("e.total_cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("e.num_turns", F.lit(0)).alias("turns"), every.alias("input_tokens"), zero("output_tokens").alias("output_tokens"), F.substring("e.result", 1, 500).alias("preview"))


def run_counts_b(lines: DataFrame) -> DataFrame:
    """run, messages, tool_calls, failed, seconds, premium_requests of form B."""
    e = events(lines, _EVENT_B)
    n = lambda c: F.count_if(F.expr(c))
    return e.groupBy("run").agg(
        n("e.type = 'assistant.message'").alias("messages"),
        n("e.type = 'tool.execution_complete'").alias("tool_calls"),
        n("e.type = 'tool.execution_complete' and not e.data.success").alias("failed"),
        (F.max(F.when(F.expr("e.type = 'result'"), F.col("e.usage.sessionDurationMs"))) / 1000).alias("seconds"),
        F.max(F.when(F.expr("e.type = 'result'"), F.col("e.usage.premiumRequests"))).alias("premium_requests"),
    )


def tasks(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """round, task (variant) of results documents whose rounds are lists, or objects with tasks or results."""
    v = documents.select(F.parse_json(doc).alias("d"))
    rounds = v.select(F.expr("posexplode(cast(variant_get(d, '$.rounds', 'array<variant>') as array<variant>))").alias("round", "r"))
    as_list = F.expr("try_variant_get(r, '$', 'array<variant>')")
    inner = F.coalesce(as_list, F.expr("try_variant_get(r, '$.tasks', 'array<variant>')"), F.expr("try_variant_get(r, '$.results', 'array<variant>')"))
    return rounds.select((F.col("round") + 1).alias("round"), F.explode_outer(inner).alias("task"))


_RUN = "struct<cost_usd:double,input_tokens:bigint,output_tokens:bigint,tool_calls:bigint,wall_time_s:double,tools:array<struct<name:string,input_preview:string>>,per_message_usage:array<struct<turn:bigint,input_tokens:bigint,output_tokens:bigint,cache_read:bigint,cache_creation:bigint>>>"
#: By side, the key under which a task has its run.
SIDES = {"without": "without", "with": "with"}


def task_runs(documents: DataFrame, doc: str = "doc", *, sides: dict[str, str] = SIDES) -> DataFrame:
    """documents' other columns, run, round, nth, category, side, cost_usd, input_tokens, output_tokens, tool_calls, seconds, tools, usage: a row a run.

    Rounds are lists of tasks, or objects with tasks or results and maybe their number; a task has a category
    or a repo and a run for each side, under its key.  Runs that are missing, or aren't objects, give no row;
    fields that are missing or of another type are null.  Documents that aren't JSON give nothing.
    """
    carry = [c for c in documents.columns if c != doc]
    rounds = documents.select(*carry, F.try_parse_json(doc).alias("d")).select(*carry, F.expr("posexplode(try_variant_get(d, '$.rounds', 'array<variant>'))").alias("at", "r"))
    inner = F.expr("coalesce(try_variant_get(r, '$', 'array<variant>'), try_variant_get(r, '$.tasks', 'array<variant>'), try_variant_get(r, '$.results', 'array<variant>'))")
    number = F.coalesce(F.expr("try_variant_get(r, '$.round', 'int')"), F.col("at") + 1)
    found = rounds.select(*carry, number.alias("round"), F.posexplode(inner).alias("nth", "t"))
    category = F.expr("coalesce(try_variant_get(t, '$.category', 'string'), try_variant_get(t, '$.repo', 'string'), 'unknown')")
    each = F.array(*(F.struct(F.lit(side).alias("side"), F.expr(f"try_variant_get(t, '$.{key}', '{_RUN}')").alias("x")) for side, key in sides.items()))
    runs = found.select(*carry, "round", "nth", category.alias("category"), F.explode(each).alias("s")).filter("s.x is not null")
    run = F.concat(F.lit("R"), F.col("round").cast("string"), F.lit("/"), F.col("category"), F.lit("_"), F.col("s.side"))
    plain = ("cost_usd", "input_tokens", "output_tokens", "tool_calls")
    return runs.select(*carry, run.alias("run"), "round", "nth", "category", F.col("s.side").alias("side"), *(F.col(f"s.x.{c}").alias(c) for c in plain), F.col("s.x.wall_time_s").alias("seconds"), F.col("s.x.tools").alias("tools"), F.col("s.x.per_message_usage").alias("usage"))


def task_tool_calls(runs: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, tool, file_path, is_navigation of the tools of task_runs, as far as their inputs' previews show paths."""
    items = runs.select(*keys, F.posexplode("tools").alias("pos", "i"))
    return items.select(*keys, "pos", F.col("i.name").alias("tool"), preview_path(F.col("i.input_preview")).alias("file_path"), F.col("i.name").isin(*NAVIGATION).alias("is_navigation"))


def task_usages(runs: DataFrame, *keys: str) -> DataFrame:
    """keys, turn, input_tokens, output_tokens, cache_read, cache_creation of task_runs; what is missing is 0."""
    u = runs.select(*keys, F.posexplode("usage").alias("at", "u"))
    zero = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0)).alias(c)
    return u.select(*keys, F.coalesce("u.turn", F.col("at") + 1).alias("turn"), *map(zero, ("input_tokens", "output_tokens", "cache_read", "cache_creation")))


def run_totals(runs: DataFrame, *carry: str) -> DataFrame:
    """carry, total, navigation, productive, files, used_tokens of each of task_runs, from its own tools and usage.

    What task_tool_calls, reports.task_report and task_usages give of a run, without a row a call: a run stays a
    row where it lies, so nothing is dealt out by keys.
    """
    none = lambda c: F.coalesce(c, F.lit(0))
    called = lambda f: none(F.size(F.filter("tools", f))).cast("long")
    paths = F.transform(F.transform("tools", lambda i: _previewed(i.input_preview)), _whole_path)
    tokens = F.aggregate("usage", F.lit(0).cast("long"), lambda n, u: n + none(u.input_tokens))
    return runs.select(
        *carry,
        none(F.size("tools")).cast("long").alias("total"),
        called(lambda i: i["name"].isin(*NAVIGATION)).alias("navigation"),
        called(lambda i: ~i["name"].isin(*NAVIGATION)).alias("productive"),
        none(F.size(F.array_distinct(F.array_compact(paths)))).cast("long").alias("files"),
        none(tokens).alias("used_tokens"),
    )


def workspace_prefix(path: Column, marker: str = "/ab-workspace/") -> Column:
    """Up to and with the directory below the marker that names a side; null if there is none."""
    return F.nullif(F.regexp_extract(path, f"^(.*{marker}[^/]+/)", 1), F.lit(""))


def _previewed(preview: Column) -> Column:
    return F.regexp_extract(preview, "[\"']file_path[\"']\\s*:\\s*[\"']([^\"']+)", 1)


def _whole_path(p: Column) -> Column:
    return F.when(p.rlike("\\.\\w+$"), p)


def preview_path(preview: Column) -> Column:
    """A path named in a preview of a tool's input, unless it was cut before its extension."""
    return _whole_path(_previewed(preview))


def task_of(run: Column) -> Column:
    """The task that a log's file name bears: what is before its side, turn and extension."""
    return F.regexp_replace(F.regexp_replace(run, "\\.jsonl$", ""), "(_turn\\d+|_(with|without|control|treatment))+$", "")


def failed_turns(lines: DataFrame, run: str = "run") -> DataFrame:
    """run, failed_turns: in order, the turns of form A's sessions whose last result is an error or missing.

    A run's name ends in _turn and its number; its session is what is before.
    """
    schema = _EVENT_A + ", is_error boolean"
    last = events(lines, schema).groupBy(run).agg(F.max_by(F.struct("e.type", "e.is_error"), F.when(F.col("e.type") == "result", F.col("line_no"))).alias("r"))
    turn = F.regexp_extract(run, "_turn(\\d+)", 1).try_cast("int")
    failed = F.col("r").isNull() | (F.col("r.type") != "result") | F.coalesce(F.col("r.is_error"), F.lit(False))
    per = last.select(F.regexp_replace(run, "_turn\\d+(\\.jsonl)?$", "").alias(run), F.coalesce(turn, F.lit(0)).alias("turn"), failed.alias("failed"))
    return per.groupBy(run).agg(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("turn")))).alias("failed_turns"))


def is_followup(run: Column) -> Column:
    return run.rlike("_turn[1-9]\\d*\\.jsonl$")
