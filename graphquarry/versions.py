"""Numbered versions of a folder: each a small file that names what it consists of, made once or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class LostRace(RuntimeError):
    """Another writer made the version first; nothing of the loser's is visible."""


def _path(spark: SparkSession, folder: str, *parts: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((folder.rstrip("/"), *parts)))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the highest version; 0 and nothing before the first."""
    path, fs = _path(spark, folder, "versions")
    if not fs.exists(path):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    number = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
    return number, at(spark, folder, number) if number else {}


def at(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder.rstrip('/')}/versions/{number:012d}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Make version ``number``, or raise LostRace if it is there already.

    The content is written aside and then renamed, which fails where the name is taken; a file system
    whose renames are atomic (HDFS, a local disk with one machine's writers) lets one writer win.
    """
    jvm = spark.sparkContext._jvm
    aside, fs = _path(spark, folder, "versions", f".{uuid.uuid4().hex}")
    final, _ = _path(spark, folder, "versions", f"{number:012d}.json")
    out = fs.create(aside, True)
    out.write(json.dumps(content).encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        files.rename(aside, final, none)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(final):
            raise LostRace(f"version {number} of {folder} was made by another writer") from e
        raise


def removed(spark: SparkSession, folder: str, part: str) -> None:
    """Delete a part of the folder that no version names."""
    path, fs = _path(spark, folder, part)
    fs.delete(path, True)


def size(spark: SparkSession, folder: str, part: str) -> int:
    """Bytes of a part of the folder."""
    path, fs = _path(spark, folder, part)
    return fs.getContentSummary(path).getLength()


def forgotten(spark: SparkSession, folder: str, upto: int) -> None:
    """Delete the versions up to a number, and the parts that only they name."""
    path, fs = _path(spark, folder, "versions")
    numbers = sorted(int(n[:-5]) for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())
    old = [n for n in numbers if n <= upto]
    if not old:
        return
    live = {at(spark, folder, n).get("part") for n in numbers if n > upto}
    for n in old:
        part = at(spark, folder, n).get("part")
        if part and part not in live:
            removed(spark, folder, part)
        fs.delete(_path(spark, folder, "versions", f"{n:012d}.json")[0], False)
