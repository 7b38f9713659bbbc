import os

import pytest

from textquarry.functions.patterns import PathFilter
from textquarry.sources.listing import LISTED, distinct_files, list_tree


@pytest.fixture
def tree(tmp_path):
    for name in ("top.xlsx", "a/one.xlsx", "a/b/c/deep.xlsm", "_under/x.xlsx", ".dot/.hidden.xlsx", "skip/in.xlsx", "skip/more/in.xlsx", "a/skip/in.xlsx", "a/~$one.xlsx", "note.txt", "a/keep.tmp.xlsx", "empty/gone.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "top.xlsx", tmp_path / "link.xlsx")
    os.link(tmp_path / "a/one.xlsx", tmp_path / "again.xlsx")
    os.mkfifo(tmp_path / "pipe.xlsx")
    return tmp_path


def walk(root):
    return {os.path.relpath(os.path.join(d, f), root): os.lstat(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if os.path.isfile(os.path.join(d, f)) and not os.path.islink(os.path.join(d, f))}


def test_as_a_plain_walk(spark, tree):
    got = {r["relative_path"]: (r["size"], r["device"], r["inode"], r["kind"]) for r in list_tree(spark, [str(tree)]).collect()}
    assert got == {p: (s.st_size, s.st_dev, s.st_ino, "file") for p, s in walk(tree).items()}
    assert list_tree(spark, [str(tree)]).schema.names == LISTED.names


def test_filters_and_ignored_folders(spark, tree, monkeypatch):
    wanted = PathFilter(ignore="skip/, *.tmp.xlsx")
    got = sorted(r["relative_path"] for r in list_tree(spark, [str(tree)], wanted).collect())
    assert got == [".dot/.hidden.xlsx", "_under/x.xlsx", "a/b/c/deep.xlsm", "a/one.xlsx", "again.xlsx", "top.xlsx"]
    assert [r["relative_path"] for r in list_tree(spark, [str(tree)], PathFilter(include="deep*, a/one", ignore="b")).collect()] == ["a/one.xlsx"]


def test_files_with_two_names_count_once(spark, tree):
    files = distinct_files(list_tree(spark, [str(tree)], PathFilter(ignore="skip"))).where("kind = 'file'")
    assert sorted(r["relative_path"] for r in files.collect()) == [".dot/.hidden.xlsx", "_under/x.xlsx", "a/b/c/deep.xlsm", "a/keep.tmp.xlsx", "a/one.xlsx", "top.xlsx"]


def test_explicit_files_and_missing_roots(spark, tree):
    rows = list_tree(spark, [str(tree / "a/~$one.xlsx"), str(tree / "note.txt"), str(tree / "none"), str(tree / "a/b"), str(tree / "link.xlsx")], PathFilter()).collect()
    assert sorted((r["kind"], os.path.relpath(r["full_path"], tree)) for r in rows) == [("file", "a/b/c/deep.xlsm"), ("file", "a/~$one.xlsx"), ("file", "link.xlsx"), ("issue", "none")]


def test_a_folder_that_cannot_be_read_is_an_issue(spark, tree, monkeypatch):
    """Permissions don't bind an administrator, so a name too long for the system stands for an unreadable folder."""
    from textquarry.sources import listing

    import pyarrow as pa

    gone = str(tree / "gone")
    batch = pa.RecordBatch.from_pydict({"root": [str(tree)] * 2, "relative_path": ["gone", "a/b/c"], "full_path": [gone, str(tree / "a/b/c")]})
    rows = [r for b in listing._list_folders([batch]) for r in b.to_pylist()]
    assert [(r["kind"], r["relative_path"]) for r in rows] == [("issue", "gone"), ("file", "a/b/c/deep.xlsm")] and rows[0]["cause"]


def test_no_roots_and_empty_folders(spark, tmp_path):
    assert list_tree(spark, []).collect() == [] and list_tree(spark, [str(tmp_path)]).collect() == []
