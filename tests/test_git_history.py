import os
import shutil
import subprocess

import pytest

from codeloom.operators import history as H
from codeloom.sources import git_history as G

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git is not here")
ENV = {**os.environ, "GIT_AUTHOR_NAME": "A B", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d.e", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("git")
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env=ENV)

    def commit(summary, **files):
        for name, text in files.items():
            path = root / name.replace("__", "/").replace("_py", ".py")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.unlink() if text is None else path.write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", summary, "--allow-empty")

    git("init", "-q", "-b", "main")
    body = "".join(f"line {i}\n" for i in range(1, 21))
    commit("first ü", a_py=body, **{"d__x y_py": "x\n"})
    commit("edit", a_py=body.replace("line 5\n", "line five\nmore\n"))
    git("mv", "a.py", "b.py")
    commit("move")
    git("checkout", "-q", "-b", "side", "HEAD~1")
    commit("on the side", s_py="1\n")
    git("checkout", "-q", "main")
    commit("edit again", b_py=(root / "b.py").read_text().replace("line 9\n", "line nine\n"))
    git("merge", "-q", "--no-ff", "-m", "merge side", "side")
    commit("drop", **{"d__x y_py": None})
    return str(root)


def test_commits_deltas_and_hunks(spark, repo, monkeypatch):
    monkeypatch.setattr(G, "STRETCH", 2)
    commits = {r["summary"]: r for r in G.git_commits(spark, repo).collect()}
    assert [s for s, _ in sorted(commits.items(), key=lambda x: x[1]["seq"])] == ["drop", "merge side", "edit again", "move", "edit", "first ü"]
    assert commits["first ü"]["files_changed"] == 2 and commits["move"]["author_name"] == "A B" and commits["move"]["author_email"] == "a@b.c"
    name = {r["sha"]: s for s, r in commits.items()}
    deltas = sorted((name[r["sha"]], r["status"], r["old_path"] or "", r["new_path"] or "") for r in G.git_deltas(spark, repo).collect())
    assert deltas == sorted([("first ü", "added", "", "a.py"), ("first ü", "added", "", "d/x y.py"), ("edit", "modified", "a.py", "a.py"), ("move", "renamed", "a.py", "b.py"), ("edit again", "modified", "b.py", "b.py"), ("merge side", "added", "", "s.py"), ("drop", "deleted", "d/x y.py", "")])
    hunks = sorted((name[r["sha"]], r["path"], r["old_start"], r["old_lines"], r["new_start"], r["new_lines"]) for r in G.git_hunks(spark, repo).collect())
    assert ("edit", "a.py", 5, 1, 5, 2) in hunks and ("edit again", "b.py", 10, 1, 10, 1) in hunks and ("drop", "d/x y.py", 1, 1, 0, 0) in hunks and ("first ü", "a.py", 0, 0, 1, 20) in hunks


def test_history_of_a_span(spark, repo):
    commits, deltas, hunks = (f(spark, repo) for f in (G.git_commits, G.git_deltas, G.git_hunks))
    walk = H.tracked_walk(deltas, commits, spark.createDataFrame([("b.py",)], "target string"))
    name = {r["sha"]: r["summary"] for r in commits.collect()}
    assert [name[r["sha"]] for r in walk.orderBy("seq").collect()] == ["edit again", "move", "edit", "first ü"]
    got = lambda a, b: sorted((name[r["sha"]], r["confidence"]) for r in H.symbol_history(walk, hunks, spark.createDataFrame([("b.py", a, b)], "target string, start_line int, end_line int")).collect())
    below = [("edit", "low"), ("first ü", "low")]
    assert got(10, 12) == sorted([("edit again", "low"), *below]) and got(1, 3) == below


def test_no_repository_and_no_commits(spark, tmp_path):
    with pytest.raises(G.NotARepository):
        G.git_commits(spark, str(tmp_path))
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, env=ENV)
    assert G.git_commits(spark, str(tmp_path)).count() == 0 and G.git_hunks(spark, str(tmp_path)).count() == 0
