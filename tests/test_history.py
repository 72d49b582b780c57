"""A small repository, read by git."""

from __future__ import annotations

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from marginalia.sources.history import Repository


@pytest.fixture
def repo(tmp_path, spark):  # noqa: ANN001, ANN201
    def commit(at: int, **files: str | None) -> str:
        for name, text in files.items():
            place = tmp_path / f"{name}.md"
            place.unlink() if text is None else place.write_text(text)
        env = os.environ | {"GIT_AUTHOR_DATE": f"@{at} +0000", "GIT_COMMITTER_DATE": f"@{at} +0000"}
        who = ["-c", "user.name=a", "-c", "user.email=a@example.org", "-c", "commit.gpgsign=false"]
        for args in (["add", "-A"], [*who, "commit", "-q", "-m", "x"]):
            subprocess.run(["git", "-C", str(tmp_path), *args], check=True, env=env)
        return Repository(spark, str(tmp_path)).head()

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    first = commit(1_600_000_000, a="one\ntwo\n", b="b\n")
    second = commit(1_600_100_000, a="one\n2\n", b=None, c="a long text that is kept\nas it is\n")
    return Repository(spark, str(tmp_path)), first, second


def test_answers_about_commits(repo):  # noqa: ANN001
    git, first, second = repo
    assert git.resolve("HEAD~1") == first and git.resolve("no") is None and git.resolve("--all") is None
    assert git.is_ancestor(first, second) and not git.is_ancestor(second, first)
    assert git.blob(git.blob_of(first, "a.md")) == b"one\ntwo\n" and git.blob_of(second, "b.md") is None
    assert {r.path for r in git.tree(second).collect()} == {"a.md", "c.md"}
    assert {r.path for r in git.changed_paths(first, second).collect()} == {"a.md", "b.md", "c.md"}
    with pytest.raises(ValueError, match="no such"):
        git.tree("no")


def test_answers_about_files(spark, repo):  # noqa: ANN001
    git, _, second = repo
    paths, now = spark.createDataFrame([("a.md",), ("gone.md",)], "path string"), F.timestamp_seconds(F.lit(1_700_000_000))
    assert {tuple(r) for r in git.blobs_of_files(paths).collect()} == {("a.md", git.blob_of(second, "a.md")), ("gone.md", None)}
    seconds = [F.unix_seconds(c).alias(c) for c in ("first_at", "last_at")]
    assert [tuple(r) for r in git.document_times(paths, now).select("path", *seconds).collect()] == [("a.md", 1_600_000_000, 1_600_100_000)]
    lines = git.line_times(paths, second, now).select("line", F.unix_seconds("at")).collect()
    assert {tuple(r) for r in lines} == {(1, 1_600_000_000), (2, 1_600_100_000)}
