"""Indexes kept fresh: when they are checked, which directories that lists, and what the relations hold then."""

import os
import time

import pytest
from test_versions import shown

from graphquarry import versions
from graphquarry.operators import index
from graphquarry.sources import listing, tree
from graphquarry.streaming import freshness

LONG_AGO = 1_700_000_000


def put(root, path, text, when=LONG_AGO):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(at, (when, when))


def settled(root, when=LONG_AGO):
    for at, _, _ in os.walk(root):
        if os.stat(at).st_mtime > time.time() - 3600:
            os.utime(at, (when, when))


@pytest.fixture
def app(tmp_path):
    root = tmp_path / "app"
    for d in ("a", "a/x", "a/x/deep", "b", "b/y", "c"):
        put(root, f"{d}/m.py", f"from c.m import f\n\ndef f_{d.replace('/', '_')}(x):\n    return f(x)\n")
    put(root, "c/m.py", "def f(x):\n    return x\n")
    put(root, "b/odd.py", b"\xff\xfe broken")
    put(root, "b/.gitignore", "*.gen.py\n")
    put(root, "b/y/k.gen.py", "def made():\n    pass\n")
    settled(root)
    return root, f"file://{tmp_path}/index"


def look(spark, app, **options):
    return freshness.checked(spark, str(app[0]), app[1], partitions=2, **{"limit": 0, "settle": 0.0, **options})


def like_new(spark, app):
    now, new = index.read_snapshot(spark, app[1]), index.index_tree(spark, str(app[0]), partitions=2)
    assert shown(now) == shown(new)
    assert {(r.path, r.mtime, r.size) for r in now["files"].collect()} == {(r.path, r.mtime, r.size) for r in new["files"].collect()}


def test_only_changed_directories_are_listed(spark, app):
    root, folder = app
    done = look(spark, app)
    assert (done.looked, done.version, done.dirs_listed, done.skipped, done.changed) == (True, 1, 7, 1, True)
    like_new(spark, app)
    # nothing changed: nothing is listed or written; what can't be read isn't tried again
    done = look(spark, app)
    assert (done.version, done.dirs_listed, done.skipped, done.changed) == (1, 0, 1, False)
    # a text changed in place: its directory has its old time, and the file is found all the same
    put(root, "a/x/m.py", "def other(x):\n    return f(x)\n", LONG_AGO + 5)
    done = look(spark, app)
    assert (done.version, done.dirs_listed, done.changed) == (2, 0, True)
    like_new(spark, app)
    # a new name: its directory alone
    put(root, "b/y/more.py", "def more():\n    return f(1)\n")
    settled(root, LONG_AGO + 10)
    assert look(spark, app).dirs_listed == 1
    like_new(spark, app)
    # new directories, one in another: these and the one they came to
    put(root, "c/n/e/w.py", "def w():\n    return more()\n")
    settled(root, LONG_AGO + 20)
    assert look(spark, app).dirs_listed == 3
    like_new(spark, app)
    # a directory goes, with what is below
    for at in ("a/x/deep/m.py", "a/x/m.py"):
        (root / at).unlink()
    for at in ("a/x/deep", "a/x"):
        (root / at).rmdir()
    settled(root, LONG_AGO + 30)
    assert look(spark, app).dirs_listed == 1
    like_new(spark, app)
    # the broken file is mended in place
    put(root, "b/odd.py", "def mended():\n    return f(2)\n", LONG_AGO + 40)
    done = look(spark, app)
    assert (done.skipped, done.dirs_listed, done.changed) == (0, 0, True)
    like_new(spark, app)


def test_ignore_files_hold_for_all_below(spark, app):
    root, folder = app
    look(spark, app)
    put(root, "b/.gitignore", "m.py\n", LONG_AGO + 5)  # changed in place
    assert look(spark, app).dirs_listed == 2  # b and b/y
    like_new(spark, app)
    assert {r.path for r in index.read_snapshot(spark, folder)["files"].collect() if r.path.startswith("b/y")} == {"b/y/k.gen.py"}
    put(root, ".gitignore", "a/x/\n")
    settled(root, LONG_AGO + 10)
    assert look(spark, app).dirs_listed == 5  # all but a/x and a/x/deep
    like_new(spark, app)
    (root / ".gitignore").unlink()
    settled(root, LONG_AGO + 20)
    assert look(spark, app).dirs_listed == 7
    like_new(spark, app)


def test_when_an_index_is_looked_at(spark, app, monkeypatch):
    root, folder = app
    assert look(spark, app, limit=300, now=1000.0).looked
    put(root, "a/m.py", "def changed():\n    pass\n", LONG_AGO + 5)
    monkeypatch.setattr(listing, "following", lambda *a, **k: pytest.fail("listed"))
    assert look(spark, app, limit=300, now=1299.0) == freshness.Check(False, 1)
    monkeypatch.undo()
    assert look(spark, app, limit=300, now=1300.0).version == 2
    # a check without a change makes it young again
    assert look(spark, app, limit=300, now=1600.0) == freshness.Check(True, 2, 0, 8, 1, False)
    assert not look(spark, app, limit=300, now=1800.0).looked
    # another version checked out is looked at however young the index, and remembered even if no file changed
    put(root, ".git/HEAD", "ref: refs/heads/main\n")
    put(root, ".git/refs/heads/main", "abc\n")
    done = look(spark, app, limit=300, now=1801.0)
    assert (done.looked, done.version) == (True, 3)
    assert not look(spark, app, limit=300, now=1802.0).looked
    assert look(spark, app, limit=300, now=1803.0, exclude=["b"]).looked  # another question
    assert not any(r.path.startswith("b/") for r in index.read_snapshot(spark, folder)["files"].collect())
    monkeypatch.setenv("GRAPHQUARRY_STALE_SECONDS", "0")
    assert freshness.checked(spark, str(root), folder, now=1803.0, exclude=["b"]).looked
    # of the listings the last are kept
    numbers = versions.latest(spark, f"{folder}/listings")[0]
    assert numbers >= 5 and len([n for n in os.listdir(f"{folder[7:]}/listings/versions") if n.endswith(".json")]) == freshness.KEPT


def test_versions_checked_out(tmp_path):
    root = str(tmp_path)
    assert freshness.checked_out(root) is None
    put(tmp_path, ".git/HEAD", "ref: refs/heads/main\n")
    assert freshness.checked_out(root) is None
    put(tmp_path, ".git/packed-refs", "# pack-refs\n111 refs/heads/main\n^222\n333 refs/heads/mainly\n")
    assert freshness.checked_out(root) == "111"
    put(tmp_path, ".git/refs/heads/main", "444\n")
    assert freshness.checked_out(root) == "444"
    put(tmp_path, ".git/HEAD", "555\n")
    assert freshness.checked_out(root) == "555"
    put(tmp_path, ".git/worktrees/w/HEAD", "ref: refs/heads/side\n")
    put(tmp_path, ".git/worktrees/w/commondir", "../..\n")
    put(tmp_path, ".git/refs/heads/side", "666\n")
    put(tmp_path, "w/.git", f"gitdir: {tmp_path}/.git/worktrees/w\n")
    assert freshness.checked_out(f"{root}/w") == "666"


def test_a_time_too_young_to_trust(spark, app):
    root, _ = app
    look(spark, app)
    put(root, "c/new.py", "def new():\n    pass\n")
    assert look(spark, app, settle=60.0).dirs_listed == 1
    assert look(spark, app, settle=60.0).dirs_listed == 1  # it may have changed again within the same tick
    settled(root, LONG_AGO + 10)
    assert look(spark, app, settle=60.0).dirs_listed == 1
    assert look(spark, app, settle=60.0).dirs_listed == 0


def test_a_tree_without_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t", "readme.txt", "words")
    with pytest.raises(ValueError):
        freshness.checked(spark, str(tmp_path / "t"), f"file://{tmp_path}/i", partitions=1)
    assert versions.latest(spark, f"file://{tmp_path}/i") == (0, {})


def test_a_running_stream(spark, app, tmp_path):
    root, folder = app
    seen = []
    stream = freshness.kept_fresh(spark, str(root), folder, str(tmp_path / "cp"), every="1 second", told=seen.append, limit=0, partitions=2)
    try:
        end = time.time() + 120
        while not seen and time.time() < end:
            time.sleep(0.5)
        put(root, "a/m.py", "def while_running():\n    return f(3)\n", LONG_AGO + 50)
        while not any(c.version == 2 for c in seen) and time.time() < end:
            time.sleep(0.5)
        assert stream.exception() is None
    finally:
        stream.stop()
    assert seen[0].changed and any(c.version == 2 for c in seen)
    like_new(spark, app)
