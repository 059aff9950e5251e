"""Listing in rounds beside a walk on this machine."""

import os

import pytest

from graphlens.sources import listing, repository


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for k in range(30):
        folder = root / f"a{k % 5}" / f"b{k % 3}" / f"c{k}"
        folder.mkdir(parents=True)
        (folder / f"f{k}.py").write_text(f"x = {k}\n")
    (root / ".git").mkdir()
    (root / ".git" / "config").write_text("hidden")
    (root / ".hidden").write_text("shown")
    (root / "deep" / "/".join("d" * 40)).mkdir(parents=True)
    (root / "deep" / "/".join("d" * 40) / "end.txt").write_text("end")
    os.symlink(root / "a0", root / "loop")
    os.symlink("/etc/hostname", root / "outside")
    os.symlink(root / ".hidden", root / "inside")
    (root / "empty").mkdir()
    return root


@pytest.mark.parametrize(("budget", "folders"), [(20_000, 50), (12, 4)])
def test_the_same_files_as_a_walk(spark, tree, tmp_path, budget, folders):
    entries = listing.list_folder(spark, str(tree), str(tmp_path / "out"), budget=budget, folders=folders)
    rounds = len(os.listdir(tmp_path / "out"))
    assert rounds == 1 if budget > 100 else 2 <= rounds <= 12
    got = listing.read_files(entries, str(tree), per_task=10)
    want = repository.read_repository(spark, str(tree))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {"inside", ".hidden"} < {r.path for r in got.collect()} and "outside" not in {r.path for r in got.collect()}


def test_walk_lists_given_folders_whole_and_leaves_the_rest(tree):
    rows = list(listing._walk(str(tree), ["a0", "a1"], 1))
    assert [r for r in rows if r[1] == "file"] == [] and {r[0] for r in rows} == {f"a{i}/b{j}" for i in (0, 1) for j in range(3)}
    assert list(listing._walk(str(tree), ["gone", "empty"], 9)) == [("gone", "failed", "stat_error: No such file or directory")]


def test_files_gone_and_folders_not_listed_are_rows(spark, tree):
    entries = spark.createDataFrame([("x.py", "file", None), ("y", "failed", "stat_error: Permission denied")], listing.ENTRIES)
    assert sorted((r.path, r.error) for r in listing.read_files(entries, str(tree)).collect()) == [("x.py", "stat_error: No such file or directory"), ("y", "stat_error: Permission denied")]


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "r").mkdir()
    entries = listing.list_folder(spark, str(tmp_path / "r"), str(tmp_path / "out"))
    assert entries.count() == 0 and listing.read_files(entries, str(tmp_path / "r")).count() == 0
