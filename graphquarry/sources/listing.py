"""A tree's listing that is kept, so that the next one lists only directories that changed."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import cut
from . import tree

DIRS = "path string, mtime_ns long, ignore_ns long, rules string"
FILES = "path string, size long, mtime long, skipped boolean"


def _timed(batches, uri: str, names: tuple[str, ...]):
    """is_dir, exists, size and time of each path (first column), and the time of its ignore file, beside the columns ``names``."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    base = base.rstrip("/")
    for b in batches:
        at = [f"{base}/{p}".rstrip("/") for p in b.column(0).to_pylist()]
        infos = store.get_file_info([*at, *(f"{p}/{tree.IGNORE_FILE}" for p in at)])
        own, rules = infos[: len(at)], infos[len(at) :]
        kinds = {fs.FileType.Directory: "dir", fs.FileType.File: "file"}
        new = [
            pa.array([kinds.get(i.type) for i in own], pa.string()),
            pa.array([i.size or 0 for i in own], pa.int64()),
            pa.array([i.mtime_ns or 0 for i in own], pa.int64()),
            pa.array([i.mtime_ns or 0 for i in rules], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, "kind", "size_now", "mtime_now", "ignore_now"])


def _looked_at(df: DataFrame, root: str, partitions: int | None) -> DataFrame:
    """df (path first) with kind (null: gone), size_now, mtime_now and ignore_now of each path, asked by tasks."""
    uri, names = tree.located(root), tuple(df.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["kind string, size_now long, mtime_now long, ignore_now long"])
    spread = df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(lambda it: _timed(it, uri, names), schema)


def parent(path: Column) -> Column:
    """The directory of a path; the root's is the empty text."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _above(path: Column) -> Column:
    """All directories above a path, the root first; the root has none."""
    parts = F.split(path, "/")
    over = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(over)


def _parted(found: DataFrame, before: float) -> tuple[DataFrame, DataFrame]:
    """(directories, files) of rows of LISTED.  A directory that changed since ``before`` may change again within the same tick of its clock, so its time isn't kept."""
    safe = F.when(F.col("mtime_ns") < int(before * 1e9), F.col("mtime_ns")).otherwise(-1).alias("mtime_ns")
    dirs = found.filter("entry = 'listed'").select("path", safe, "ignore_ns", "rules")
    files = found.filter("entry = 'file'").filter(~paths.ignored_file(F.col("path")))
    return dirs, files.select("path", "size", tree.seconds("mtime_ns"), F.lit(False).alias("skipped"))


def first(spark: SparkSession, root: str, *, ignore: list[str] | None = None, exclude: list[str] | None = None, partitions: int | None = None, settle: float = 2.0) -> tuple[DataFrame, DataFrame, int]:
    """(directories, files, number of directories listed) of the whole tree."""
    before = time.time() - settle
    found = tree.list_below(tree.top_level(spark, ignore), root, exclude=exclude, partitions=partitions)
    dirs, files = _parted(found, before)
    return dirs, files, dirs.count()


def following(dirs: DataFrame, files: DataFrame, root: str, *, exclude: list[str] | None = None, partitions: int | None = None, settle: float = 2.0) -> tuple[DataFrame, DataFrame, int]:
    """(directories, files, number of directories listed) as they are now, from those of an earlier listing.

    Every known directory and file is asked for its time.  A directory is listed if its time changed, which
    it does when names come or go; what is new below it is listed too.  Where an ignore file changed, came or
    went, all below is listed again.  A file skipped as unreadable stays so until its time changes.
    """
    before = time.time() - settle
    now = cut(_looked_at(dirs, root, partitions).withColumn("state", F.expr("CASE WHEN kind IS NULL OR kind <> 'dir' THEN 'gone' WHEN ignore_now <> ignore_ns THEN 'rules' WHEN mtime_now <> mtime_ns THEN 'names' ELSE 'same' END")))
    ruled = now.filter("state = 'rules'").select(F.col("path").alias("over"))
    under = now.select("path", F.explode(_above(F.col("path"))).alias("over")).join(ruled, "over", "left_semi").select("path").distinct()
    known = cut(now.filter("state <> 'gone'").join(under, "path", "left_anti"))
    # below a directory of other rules nothing is known, since its old entries are in ``under``
    level = known.filter("state <> 'same'").select("path", "rules")
    found = tree.list_below(level, root, known=known, exclude=exclude, partitions=partitions)
    new_dirs, new_files = _parted(found, before)
    same = known.filter("state = 'same'")
    held = files.withColumn("_in", parent(F.col("path"))).join(same.select(F.col("path").alias("_in")), "_in", "left_semi").select(*files.columns)
    asked = _looked_at(held, root, partitions).filter("kind = 'file'").withColumn("now", tree.seconds("mtime_now"))
    kept = asked.select("path", F.col("size_now").alias("size"), F.col("now").alias("mtime"), (F.col("skipped") & (F.col("now") == F.col("mtime"))).alias("skipped"))
    skipped = files.filter("skipped").select("path", "mtime", F.lit(True).alias("was"))
    listed = new_files.drop("skipped").join(skipped, ["path", "mtime"], "left").select("path", "size", "mtime", F.coalesce("was", F.lit(False)).alias("skipped"))
    return same.select(*new_dirs.columns).unionByName(new_dirs), kept.unionByName(listed), new_dirs.count()
