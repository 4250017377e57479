"""Git objects, files and changes of commits against the git program; edit scripts against brute force."""

import os
import random
import shutil
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolith.operators import history
from cartolith.sources import git_objects


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def replayed(a, b, script):
    out, i = [], 0
    for op, x, y in script:
        out += a[i:x]
        i = x + (op == "-")
        assert len(out) == y
        if op == "+":
            out.append(b[y])
    return out + list(a[i:])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcd"), max_size=25))
def test_edit_scripts_are_shortest(a, b):
    script = history.edit_script(a, b)
    assert replayed(a, b, script) == b
    assert len(script) == len(a) + len(b) - 2 * lcs(a, b)


def test_edit_scripts_of_long_texts():
    rng = random.Random(1)
    a = [str(rng.randrange(50)) for _ in range(3000)]
    b = [x for x in a if rng.random() > 0.02]
    for _ in range(60):
        b.insert(rng.randrange(len(b)), f"new{rng.randrange(9)}")
    script = history.edit_script(a, b)
    assert replayed(a, b, script) == b and len(script) <= 180


def test_hunks_apply_with_git(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(25):
        a = [f"l{rng.randrange(30)}" for _ in range(rng.randrange(60))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), f"n{k}")
        rows.append((k, "".join(f"{x}\n" for x in a), "".join(f"{x}\n" for x in b)))
    rows += [(100, None, "a\nb\n"), (101, "a\nb\n", None), (102, None, None), (103, "same\n", "same\n")]
    found = {}
    for r in history.hunks(spark.createDataFrame(rows, "k long, before string, after string"), ["k"], "before", "after").orderBy("k", "old_start", "new_start").collect():
        found.setdefault(r["k"], []).append(f"@@ -{r['old_start']},{r['old_count']} +{r['new_start']},{r['new_count']} @@\n{r['body']}\n")
    assert 102 not in found and 103 not in found
    for k, a, b in rows[:25]:
        (tmp_path / "f").write_text(a)
        if k in found:
            (tmp_path / "p").write_text("--- a/f\n+++ b/f\n" + "".join(found[k]))
            subprocess.run(["git", "apply", "p"], cwd=tmp_path, check=True)
        assert (tmp_path / "f").read_text() == b


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    if shutil.which("git") is None:
        pytest.skip("needs git to make a repository")
    where = tmp_path_factory.mktemp("repo")
    env = os.environ | {"GIT_AUTHOR_NAME": "A B", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "A B", "GIT_COMMITTER_EMAIL": "a@b.c", "GIT_CONFIG_GLOBAL": "/dev/null"}
    git = lambda *args, at="2024-03-04T05:06:07+0200": subprocess.run(["git", *args], cwd=where, check=True, capture_output=True, env=env | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at}).stdout
    git("init", "-q", "-b", "main")
    rng = random.Random(5)
    base = [f"line {k} {rng.random()}" for k in range(400)]
    for n in range(14):
        for name in ("top.py", "src/a.py", "src/deep/b.py"):
            (where / name).parent.mkdir(parents=True, exist_ok=True)
            base[rng.randrange(400)] = f"changed {n} {name}"
            if rng.random() < 0.7 or n == 0:
                (where / name).write_text("\n".join(base) + "\n")
        if n == 3:
            (where / "gone.txt").write_text("x\n")
            (where / "binary.bin").write_bytes(b"\0\1\xff" * 50)
        if n == 6:
            (where / "gone.txt").unlink()
            shutil.move(where / "src/deep/b.py", where / "src/moved.py")
        (where / "n.txt").write_text(f"{n}\né\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"commit {n}\n\nbody of {n}", at=f"2024-03-{n + 1:02d}T05:06:07+0200")
        if n == 9:
            git("gc", "-q", "--aggressive")  # most objects become deltas in a pack
    return where, git


@pytest.mark.parametrize("per_task", [7, 20_000])
def test_objects_equal_git(spark, repository, per_task):
    where, git = repository
    names = [line.split() for line in git("cat-file", "--batch-all-objects", "--batch-check").decode().splitlines()]
    got = {r["oid"]: (r["type"], r["size"], bytes(r["data"])) for r in git_objects.objects(spark, str(where / ".git"), per_task).collect()}
    assert {(k, t, str(n)) for k, (t, n, _) in got.items()} == set(map(tuple, names))
    for oid, kind, _ in names:
        assert got[oid][2] == git("cat-file", kind, oid)
    assert list((where / ".git/objects/pack").glob("*.pack"))


def test_commits_files_and_changes_equal_git(spark, repository):
    where, git = repository
    found = git_objects.objects(spark, str(where / ".git")).cache()
    commits, trees = git_objects.commits(found), git_objects.trees(found)
    log = [line.split("|") for line in git("log", "--pretty=%H|%T|%an|%ae|%at|%s").decode().splitlines()]
    got = sorted((r["commit"], r["tree"], r["author"], r["email"], str(int(r["t"])), r["message"].split("\n")[0]) for r in commits.selectExpr("*", "unix_seconds(at) as t").collect())
    assert got == sorted(map(tuple, log))
    assert {r["offset"] for r in commits.collect()} == {"+0200"} and commits.filter("message like '%body of 3'").count() == 1
    files = {}
    for r in history.files_of(commits, trees).collect():
        files.setdefault(r["commit"], set()).add((r["path"], r["oid"]))
    want, changed = {}, set()
    for commit, *_ in log:
        want[commit] = {(line.split("\t")[1], line.split()[2]) for line in git("ls-tree", "-r", commit).decode().splitlines()}
        for line in git("diff-tree", "--root", "-r", "--no-commit-id", "--no-renames", commit).decode().splitlines():
            meta, path = line.split("\t")
            _, _, old, new, status = meta.split()
            changed.add((commit, path, status, None if set(old) == {"0"} else old, None if set(new) == {"0"} else new))
    assert files == want
    changes = history.changes_of(commits, trees)
    assert {tuple(r) for r in changes.select("commit", "path", "status", "old_oid", "new_oid").collect()} == changed
    texts = history.with_texts(changes, found)
    stats = {(r["commit"], r["path"]): (r["added"], r["removed"]) for r in history.change_stats(history.line_changes(texts, ["commit", "path"], "before", "after"), ["commit", "path"]).collect()}
    for commit, *_ in log:
        for line in git("diff-tree", "--root", "-r", "--no-commit-id", "--no-renames", "--numstat", "--minimal", commit).decode().splitlines():
            added, removed, path = line.split("\t")
            assert stats.get((commit, path), (0, 0)) == ((int(added), int(removed)) if added != "-" else (0, 0))
    assert texts.filter("path = 'binary.bin' and after is not null").count() == 0


def test_deltas_from_by_hand():
    base = bytes(range(200)) * 400
    delta = bytes([0x80 | (len(base) & 0x7F), 0x80 | (len(base) >> 7 & 0x7F), len(base) >> 14, 9]) + bytes([3]) + b"abc" + bytes([0b10010001, 5, 6])
    assert git_objects.applied(base, delta) == b"abc" + base[5:11]
    with pytest.raises(ValueError):
        git_objects.applied(base[1:], delta)
