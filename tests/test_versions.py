"""Versions made of a base and deltas: writers that race, bytes in step with changes, compaction."""

import pytest

from graphquarry import versions
from graphquarry.operators import index
from graphquarry.sources import tree


def sources(n, changed=()):
    return [(f"src/m{k}.py", f"from src.m{(k + 1) % n} import f{(k + 1) % n}\n\n\ndef f{k}(x):\n    return f{(k + 1) % n}(x) + {'g' if k in changed else 'h'}{k}(x)\n", 9, 2 if k in changed else 1) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string, size long, mtime long")


def built(spark, rows):
    rel = index.relations(tree.parsed(tree.described(frame(spark, rows))))
    rel["edges"] = index.edges(rel)
    return rel | {"metadata": spark.createDataFrame([("head", "v1")], "key string, value string")}


def shown(rel):
    """Rows by paths and names instead of ids."""
    path = {r.id: r.path for r in rel["files"].collect()}
    name = {r.id: (path[r.file_id], r.name) for r in rel["symbols"].collect()}
    edges = [(r.kind, path.get(r.source_file_id), name.get(r.source_symbol_id), path.get(r.target_file_id), name.get(r.target_symbol_id), r.target_name) for r in rel["edges"].collect()]
    calls = [(name[r.caller_symbol_id], r.callee_name) for r in rel["calls"].collect()]
    imports = [(path[r.file_id], r.module) for r in rel["imports"].collect()]
    return sorted(path.values()), sorted(name.values()), sorted(calls), sorted(imports), sorted(map(str, edges))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    f = f"file://{tmp_path_factory.mktemp('versions')}/s"
    assert index.write_snapshot(built(spark, sources(60)), f) == 1
    return f


def test_deltas_like_a_new_index(spark, folder):
    assert index.refresh_snapshot(spark, folder, frame(spark, sources(60))) is None
    rows = sources(60, changed=(3,))
    assert index.refresh_snapshot(spark, folder, frame(spark, rows), head="v2") == 2
    rows = [r for r in rows if r[0] != "src/m7.py"] + [("src/extra.py", "def h5(x):\n    return f7(x)\n", 9, 5)]
    assert index.refresh_snapshot(spark, folder, frame(spark, rows)) == 3
    now = index.read_snapshot(spark, folder)
    assert shown(now) == shown(built(spark, rows))
    assert [tuple(r) for r in now["metadata"].collect()] == [("head", "v2")]
    for t in ("files", "symbols", "imports", "calls", "edges"):
        ids = [r.id for r in now[t].collect()]
        assert len(set(ids)) == len(ids)
    # an older version is still there, whole
    assert shown(index.read_snapshot(spark, folder, version=1)) == shown(built(spark, sources(60)))
    # what a change of one file in sixty writes is in step with it
    base, *deltas = versions.latest(spark, folder)[1]["parts"]
    added = [spark.read.parquet(f"{folder}/{d}/{t}").count() for d in deltas for t in ("files", "symbols", "imports", "calls")]
    assert sum(added) <= 12 and index.read_snapshot(spark, folder)["edges"].count() > 150
    assert spark.read.parquet(f"{folder}/{deltas[0]}/edges").count() + spark.read.parquet(f"{folder}/{deltas[0]}/removed_edges").count() < 20
    assert versions.size(spark, folder, deltas[0]) < versions.size(spark, folder, base)


def test_one_of_two_writers_loses_cleanly(spark, folder, monkeypatch):
    number, content = versions.latest(spark, folder)
    before = shown(index.read_snapshot(spark, folder))
    rel = index.read_snapshot(spark, folder)
    none = {t: rel[t].limit(0) for t in rel}
    real = versions.commit

    def raced(spark_, folder_, n, c):
        monkeypatch.setattr(versions, "commit", real)
        index.write_delta(spark, folder, none, none, rel["metadata"])  # another writer, in between
        real(spark_, folder_, n, c)

    monkeypatch.setattr(versions, "commit", raced)
    parts = lambda: {p.getPath().getName() for p in versions._path(spark, folder)[1].listStatus(versions._path(spark, folder)[0])}
    known = parts()
    gone = rel["files"].limit(5).select("id")
    with pytest.raises(versions.LostRace):
        index.write_delta(spark, folder, none | {"files": gone}, none, rel["metadata"], after=number)
    assert versions.latest(spark, folder)[0] == number + 1
    assert shown(index.read_snapshot(spark, folder)) == before
    assert len(parts() - known) == 1  # the winner's part alone
    with pytest.raises(versions.LostRace):
        index.write_delta(spark, folder, none, none, rel["metadata"], after=number)
    assert not any(p.getPath().getName().startswith(".") and not p.getPath().getName().endswith(".crc") for p in versions._path(spark, folder, "versions")[1].listStatus(versions._path(spark, folder, "versions")[0]))


def test_compaction_folds_deltas(spark, folder):
    before = shown(index.read_snapshot(spark, folder))
    n = index.compact_snapshot(spark, folder)
    parts = versions.latest(spark, folder)[1]["parts"]
    assert len(parts) == 1 and shown(index.read_snapshot(spark, folder)) == before
    assert "removed" not in index.read_snapshot(spark, folder)["files"]._jdf.queryExecution().toString()
    dead = index.vacuum_snapshots(spark, folder)
    assert len(dead) >= 3 and parts[0] not in dead and versions.latest(spark, folder)[0] == n
    assert shown(index.read_snapshot(spark, folder)) == before
