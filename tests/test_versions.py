"""Dataset versions as trees: only changed files are read, only changed leaves compared."""

import hashlib
import os

import pytest

from fleetlens.operators import versions


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    for i in range(120):
        put(root, f"{'abc'[i % 3]}/d{i % 7}/{i}.txt", f"content {i}")
    return root


def hashes(df):
    return {r.path: r.md5 for r in df.collect()}


def test_ten_changed_files_are_read_and_no_others(spark, tmp_path, folder, monkeypatch):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    first = versions.refreshed(spark, str(folder), None)
    assert hashes(first) == {str(p.relative_to(folder)): md5(p.read_text()) for p in folder.rglob("*.txt")}
    root = versions.save_version(first, old, levels=2)
    for i in range(5):
        put(folder, f"a/d0/{i * 21}.txt", f"edited {i} and longer")
        put(folder, f"new/{i}.txt", f"new {i}")
    os.remove(folder / "b/d1/1.txt")
    read = []
    load = type(spark.read).load
    def watched(self, path=None, *args, **more):
        read.append(path)
        return load(self, path, *args, **more)
    monkeypatch.setattr(type(spark.read), "load", watched)
    second = versions.refreshed(spark, str(folder), old)
    names = [p for paths in read if isinstance(paths, list) for p in paths]
    assert len(names) == 10 and set(names) == {f"{folder}/a/d0/{i * 21}.txt" for i in range(5)} | {f"{folder}/new/{i}.txt" for i in range(5)}
    assert hashes(second) == {str(p.relative_to(folder)): md5(p.read_text()) for p in folder.rglob("*.txt")}
    assert versions.save_version(second, new, levels=2) != root
    changes = {(r.path, r.change) for r in versions.diff(spark, old, new).collect()}
    assert changes == {(f"a/d0/{i * 21}.txt", "changed") for i in range(5)} | {(f"new/{i}.txt", "added") for i in range(5)} | {("b/d1/1.txt", "removed")}
    depth, leaves = versions.changed_leaves(spark, old, new)
    assert depth == 2 and len(leaves) <= 11 and set(leaves) == {md5(path)[:2] for path, _ in changes}
    plan = versions.diff(spark, old, new)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [substring(leaf") == 2  # no other leaf's file is opened


def test_many_changes_go_by_a_scan_and_nothing_changed_reads_nothing(spark, tmp_path, folder):
    by_name, by_scan = (versions.refreshed(spark, str(folder), None, named=n) for n in (10_000, 5))
    assert hashes(by_name) == hashes(by_scan)
    target = str(tmp_path / "v1")
    root = versions.save_version(by_name, target)
    assert hashes(versions.refreshed(spark, str(folder), target, named=0)) == hashes(by_name)
    again = str(tmp_path / "v2")
    assert versions.save_version(versions.refreshed(spark, str(folder), target), again) == root
    assert versions.changed_leaves(spark, target, again)[1] == [] and versions.diff(spark, target, again).count() == 0


def test_versions_of_different_depth_and_of_nothing(spark, tmp_path, folder):
    files = versions.refreshed(spark, str(folder), None)
    versions.save_version(files, str(tmp_path / "deep"), levels=3)
    versions.save_version(files.filter("path not like 'a/%'"), str(tmp_path / "flat"), levels=1)
    gone = versions.diff(spark, str(tmp_path / "deep"), str(tmp_path / "flat")).collect()
    assert len(gone) == 40 and {r.change for r in gone} == {"removed"}
    versions.save_version(files.limit(0), str(tmp_path / "none"))
    assert versions.version(spark, str(tmp_path / "none")) is None
    assert versions.diff(spark, str(tmp_path / "none"), str(tmp_path / "flat")).count() == 80
    assert [versions.levels_for(n, 100) for n in (0, 100, 101, 1600, 1601)] == [1, 1, 1, 1, 2]
