"""Source trees: files with their metadata, filtered as they are read, and parsed by task."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import line_count
from ..functions.vocab import IGNORED_DIRS
from ..storage import cut
from . import parsers
from .schemas import PARSED


def ignore_rule(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regex over relative paths, whether it takes back); None for blanks."""
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    back = p.startswith("!")
    p = p[back:]
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    rooted = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            z = p.index("]", i + 2)
            out, i = out + "[" + p[i + 1 : z].replace("!", "^", 1) + "]", z + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if rooted else "(?:^|.*/)") + out + ("/.*$" if only_dir else "(?:/.*)?$"), back


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that speaks of a path ignores it."""
    out = F.lit(False)
    for rule in filter(None, map(ignore_rule, patterns)):
        out = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(out)
    return out


def _listed(batches, uri: str, exclude: tuple[str, ...]):
    """Directories (path, rules) and their entries, as rows of LISTED; ignored entries and what is below them are left out.

    rules are the lines of ignore files above, as JSON of [directory, line]; a directory's own come after.  A
    directory's row has the times it and its ignore file had just before it was listed.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    base = base.rstrip("/")
    never = frozenset(IGNORED_DIRS)

    def lines(path: str) -> list[str]:
        with store.open_input_file(path) as f:
            return f.read().decode("utf-8", "replace").splitlines()

    for b in batches:
        out = []
        for at, above in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            folder = f"{base}/{at}".rstrip("/")
            itself, own = store.get_file_info([folder, f"{folder}/{IGNORE_FILE}"])
            if itself.type != fs.FileType.Directory:
                continue
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            rules = json.loads(above)
            rules += [[at, x] for x in (lines(own.path) if own.type == fs.FileType.File else [])]
            parsed = [(d, r) for d, x in rules if (r := ignore_rule(x))]
            rules = json.dumps(rules)
            out.append(("listed", at, 0, itself.mtime_ns or 0, own.mtime_ns or 0, above))
            for i in found:
                path, is_dir = f"{at}/{i.base_name}".lstrip("/"), i.type == fs.FileType.Directory
                spelt, ignored = path + "/" * is_dir, False
                for d, (pattern, back) in parsed:
                    if re.match(pattern, spelt[len(d) :].lstrip("/")):
                        ignored = not back
                if not ignored and not (is_dir and i.base_name in never) and not f"{path}/".startswith(exclude):
                    out.append(("dir" if is_dir else "file", path, i.size or 0, i.mtime_ns or 0, 0, rules if is_dir else None))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["entry", "path", "size", "mtime_ns", "ignore_ns", "rules"])


IGNORE_FILE = ".gitignore"
LISTED = "entry string, path string, size long, mtime_ns long, ignore_ns long, rules string"


def located(root: str) -> str:
    """root as a URI, or as an absolute local path."""
    return root if "://" in root else os.path.abspath(root)


def seconds(ns: str) -> Column:
    return F.expr(f"{ns} div 1000000000").alias("mtime")


def top_level(spark: SparkSession, ignore: list[str] | None = None) -> DataFrame:
    """The root as a directory to be listed: path, rules."""
    return spark.createDataFrame([("", json.dumps([["", x] for x in ignore or []]))], "path string, rules string")


def list_below(level: DataFrame, root: str, *, known: DataFrame | None = None, exclude: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Rows of LISTED for the directories of level (path, rules) and all below, but those of ``known`` (path) and what is below these.

    Directories are listed by tasks, a level of the tree at a time, so the driver holds no names.
    """
    spark, uri = level.sparkSession, located(root)
    out = tuple(d.strip("/") + "/" for d in exclude or [])
    every = None
    while True:
        spread = level.repartition(partitions or spark.sparkContext.defaultParallelism)
        found = cut(spread.mapInArrow(lambda it: _listed(it, uri, out), LISTED))
        every = found if every is None else every.unionByName(found)
        level = found.filter("entry = 'dir'").select("path", "rules")
        if known is not None:
            level = level.join(known.select("path"), "path", "left_anti")
        if level.isEmpty():
            return every.filter("entry <> 'dir'")


def list_tree(spark: SparkSession, root: str, *, ignore: list[str] | None = None, exclude: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """path, size, mtime of the files below root that no ignore file or list leaves out.

    The ignore file of each directory holds for what is below it.
    """
    found = list_below(top_level(spark, ignore), root, exclude=exclude, partitions=partitions)
    return found.filter("entry = 'file'").select("path", "size", seconds("mtime_ns"))


def read_tree(spark: SparkSession, root: str, *, ignore: list[str] | None = None, exclude: list[str] | None = None, partitions: int | None = None, unreadable: bool = False) -> DataFrame:
    """path (relative), content, size, mtime of the files below root that are text and not ignored.

    root is a local path or a URI that pyarrow's file systems know; Spark's own readers would pass over
    names that begin with a dot or an underscore.  ``ignore`` are patterns of an ignore file at the root
    (those of all directories are read too); ``exclude`` are relative directories left out.  Files that
    aren't UTF-8 are left out, or have a null content with ``unreadable``; files gone when read are left out.
    """
    listed = list_tree(spark, root, ignore=ignore, exclude=exclude, partitions=partitions)
    out = read_files(listed.filter(~paths.ignored_file(F.col("path"))), root, partitions=partitions)
    return out if unreadable else out.filter("content is not null")


def read_files(listed: DataFrame, root: str, *, partitions: int | None = None) -> DataFrame:
    """path, content, size, mtime of the listed files (path, size, mtime) below root; content is null where it isn't UTF-8, and files gone are left out."""
    from pyarrow import fs

    uri = located(root)

    def read(batches):
        store, base = fs.FileSystem.from_uri(uri)
        for b in batches:
            for p, size, mtime in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    with store.open_input_stream(f"{base}/{p}", compression=None) as f:
                        text = f.read().decode("utf-8")
                except FileNotFoundError:
                    continue
                except UnicodeDecodeError:
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([text], pa.string()), pa.array([size], pa.int64()), pa.array([mtime], pa.int64())], names=["path", "content", "size", "mtime"])

    spread = listed.select("path", "size", "mtime").repartition(partitions or listed.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(read, "path string, content string, size long, mtime long")


def described(tree: DataFrame) -> DataFrame:
    """tree with language, line_count and is_test."""
    return tree.withColumns({"language": paths.language(F.col("path")), "line_count": line_count(F.col("content")).cast("long"), "is_test": paths.is_test(F.col("path"))})


def parsed(tree: DataFrame) -> DataFrame:
    """tree (path, content, language, ...) with symbols, imports and calls; a null language has none."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tree.schema] + [PARSED])
    kinds = {
        "symbols": pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("parent", pa.int32()), ("signature", pa.string())])),
        "imports": pa.list_(pa.struct([("module", pa.string()), ("names", pa.string())])),
        "calls": pa.list_(pa.struct([("caller", pa.int32()), ("callee", pa.string()), ("line", pa.int64())])),
    }

    def run(batches):
        for b in batches:
            text, lang = (b.column(b.schema.names.index(c)).to_pylist() for c in ("content", "language"))
            found = [parsers.parse(a, t or "") for a, t in zip(lang, text, strict=True)]
            new = [pa.array([getattr(x, c) for x in found], k) for c, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *kinds])

    return tree.mapInArrow(run, schema)


def child_repositories(spark: SparkSession, parent: str) -> DataFrame:
    """name of the child directories of a local directory that are repositories of their own, sorted."""
    found = sorted(e.name for e in os.scandir(parent) if e.is_dir() and os.path.isdir(f"{e.path}/.git")) if os.path.isdir(parent) else []
    return spark.createDataFrame([(n,) for n in found], "name string")
