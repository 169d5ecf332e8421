"""Indexes kept fresh: checked when they are old or another version is checked out, and brought up to their tree."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import versions
from ..operators import index
from ..sources import listing, tree
from ..sources.schemas import METADATA
from ..storage import cut

#: Listings that stay for readers who began before the next was made.
KEPT = 3


@dataclass(frozen=True)
class Check:
    """What a check did: ``looked`` is false where the index was fresh; ``version`` is that of the snapshot after it."""

    looked: bool
    version: int
    dirs_listed: int = 0
    files: int = 0
    skipped: int = 0
    changed: bool = False


def checked_out(root: str) -> str | None:
    """The version that a repository's HEAD names, read from its files; None where there is no repository or no version yet."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(tree.located(root))

    def text(path: str) -> str | None:
        try:
            with store.open_input_stream(path, compression=None) as f:
                return f.read().decode("utf-8", "replace")
        except (FileNotFoundError, NotADirectoryError):
            return None

    vcs = f"{base.rstrip('/')}/.git"
    if store.get_file_info(vcs).type == fs.FileType.File:  # a worktree names its folder
        named = (text(vcs) or "").partition("gitdir:")[2].strip()
        vcs = named if named.startswith("/") else f"{base.rstrip('/')}/{named}"
    head = (text(f"{vcs}/HEAD") or "").strip()
    if not head.startswith("ref:"):
        return head or None
    ref = head[4:].strip()
    shared = (text(f"{vcs}/commondir") or "").strip()
    places = [vcs] + ([shared if shared.startswith("/") else f"{vcs}/{shared}"] if shared else [])
    for at in places:
        if found := (text(f"{at}/{ref}") or "").strip():
            return found
        for line in (text(f"{at}/packed-refs") or "").splitlines():
            if line.endswith(f" {ref}") and not line.startswith(("#", "^")):
                return line.split(" ", 1)[0]
    return None


def _listings(folder: str) -> str:
    return f"{folder.rstrip('/')}/listings"


def _noted(spark: SparkSession, folder: str, number: int, content: dict, dirs: DataFrame | None = None, files: DataFrame | None = None) -> None:
    """Make listing ``number``, of new tables if there are any; older ones than KEPT go."""
    at, part = _listings(folder), None
    if dirs is not None:
        part = content["part"] = f"part-{uuid.uuid4().hex}"
        dirs.write.parquet(f"{at}/{part}/dirs")
        files.write.parquet(f"{at}/{part}/files")
    try:
        versions.commit(spark, at, number, content)
    except versions.LostRace:
        if part:
            versions.removed(spark, at, part)
        raise
    versions.forgotten(spark, at, number - KEPT)


def checked(spark: SparkSession, root: str, folder: str, *, head: str | None = None, limit: float | None = None, now: float | None = None, ignore: list[str] | None = None, exclude: list[str] | None = None, partitions: int | None = None, settle: float = 2.0) -> Check:
    """Bring the snapshots of folder up to the tree below root, if they are missing, old or of another version.

    Age is the time since the last check, whether it found changes or not (see operators.index.is_stale for
    its limit); ``head`` is read from the repository unless given.  A fresh index costs the reading of two
    small files.  Else the listing of the last check tells which directories to list (see sources.listing),
    files with another time are read and parsed, and a delta of them is written.  Files that aren't UTF-8
    are skipped and counted, and read again when their time changes.  A tree without a file of a known
    language makes no first version and raises ValueError.  Of two checks at once, one raises LostRace.
    """
    now = time.time() if now is None else now
    head = checked_out(root) if head is None else head
    asked = {"ignore": ignore or [], "exclude": exclude or []}
    number, _ = versions.latest(spark, folder)
    nth, last = versions.latest(spark, _listings(folder))
    if number:
        age = now - last["checked_at"] if last else None
        kept = {r.key: r.value for r in index.read_snapshot(spark, folder)["metadata"].filter("key = 'head'").collect()}
        if last and last["asked"] == asked and not index.is_stale(age, head, kept.get("head"), limit=limit):
            return Check(False, number)
    options = {"exclude": exclude, "partitions": partitions, "settle": settle}
    if number and last and last["asked"] == asked:
        part = f"{_listings(folder)}/{last['part']}"
        before = spark.read.schema(listing.DIRS).parquet(f"{part}/dirs"), spark.read.schema(listing.FILES).parquet(f"{part}/files")
        dirs, files, n = listing.following(*before, root, **options)
    else:
        dirs, files, n = listing.first(spark, root, ignore=ignore, **options)
    files = cut(files)
    readable = files.filter("not skipped")
    if number:
        diff = index.snapshot_diff(index.read_snapshot(spark, folder, version=number)["files"], readable)
        readable = readable.join(diff.filter("change in ('new', 'modified')"), "path", "left_semi")
    read = cut(tree.read_files(readable, root, partitions=partitions))
    odd = read.filter("content is null").select("path", F.lit(True).alias("odd"))
    files = cut(files.join(odd, "path", "left").select("path", "size", "mtime", F.coalesce("odd", "skipped").alias("skipped")))
    texts = read.filter("content is not null")
    if number:
        made = index.refresh_snapshot(spark, folder, texts, head=head, listed=files.filter("not skipped"))
        if made is None and head and kept.get("head") != head:  # the same files, checked out as another version
            rel = index.read_snapshot(spark, folder, version=number)
            none = {t: df.limit(0) for t, df in rel.items()}
            made = index.write_delta(spark, folder, none, none, index.set_metadata(rel["metadata"], "head", head), after=number)
    else:
        parsed = tree.parsed(tree.described(texts))
        if parsed.filter("language is not null").isEmpty():
            raise ValueError(f"no source files found in {root}")
        rel = index.relations(parsed)
        rel["edges"] = index.edges(rel)
        rel["metadata"] = spark.createDataFrame([("head", head)] if head else [], METADATA)
        made = index.write_snapshot(rel, folder)
    counts = files.agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped")).first()
    _noted(spark, folder, nth + 1, {"checked_at": now, "asked": asked}, dirs, files)
    return Check(True, made or number, n, counts.n, counts.skipped, made is not None)


def kept_fresh(spark: SparkSession, root: str, folder: str, checkpoint: str, *, every: str = "60 seconds", told=None, **options):
    """Start a stream that makes a check (see checked) at each trigger, and hands what it did to ``told`` if there is one.

    Triggers come oftener than an index gets old, so another version that is checked out is soon seen.  A
    check that another writer got ahead of is left to the next trigger.
    """

    def step(batch: DataFrame, nth: int) -> None:
        try:
            done = checked(batch.sparkSession, root, folder, **options)
        except versions.LostRace:
            return
        if told:
            told(done)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
