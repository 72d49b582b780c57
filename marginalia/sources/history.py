"""A git repository as a source: git is run here, and what it prints is read by ``sources.git``.

Single answers come from the driver. What is asked of many files (their times, the times of their lines) is asked on the
executors, a file at a time; the repository must lie in a folder that all of them share. Nothing is written to it.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import git


def run(root: str, *args: str, given: bytes | None = None) -> tuple[int, bytes]:
    """Exit code and output of git in ``root``; it takes no locks and asks nothing."""
    env = os.environ | {"GIT_OPTIONAL_LOCKS": "0", "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    done = subprocess.run(["git", "-C", root, *args], input=given, capture_output=True, env=env, check=False)
    return done.returncode, done.stdout


class Repository:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _one(self, *args: str) -> str | None:
        code, out = run(self.root, *args)
        return out.decode().strip() if code == 0 and out.strip() else None

    def resolve(self, revision: str) -> str | None:
        """The commit that a name means; None if there is none."""
        return self._one("rev-parse", "--verify", "--quiet", "--end-of-options", revision + "^{commit}")

    def head(self) -> str | None:
        return self.resolve("HEAD")

    def is_ancestor(self, old: str, new: str) -> bool:
        """False also for commits that aren't there."""
        return run(self.root, "merge-base", "--is-ancestor", old, new)[0] == 0

    def blob_of(self, commit: str, path: str) -> str | None:
        return self._one("rev-parse", "--verify", "--quiet", "--end-of-options", f"{commit}:{path}")

    def blob(self, blob_id: str) -> bytes | None:
        code, out = run(self.root, "cat-file", "blob", blob_id)
        return out if code == 0 else None

    def _rows(self, values: Iterator[str], name: str) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], f"{name} string")

    def tree(self, commit: str) -> DataFrame:
        """path, blob of the regular files of a commit."""
        code, out = run(self.root, "ls-tree", "-r", "-z", "--full-tree", commit)
        if code:
            raise ValueError(f"no such commit: {commit}")
        return git.tree(self._rows((line for line in out.decode(errors="replace").split("\0") if line), "line"))

    def changed_paths(self, old: str, new: str) -> DataFrame:
        """Paths that differ between two commits; a rename is two."""
        code, out = run(self.root, "diff", "--name-only", "-z", "--no-renames", old, new, "--")
        if code:
            raise ValueError(f"no such commits: {old}, {new}")
        return self._rows((path for path in out.decode(errors="replace").split("\0") if path), "path").distinct()

    def blobs_of_files(self, paths: DataFrame) -> DataFrame:
        """path, blob: what the files on disk are, as git would store them; null where there is no file."""
        return self._of_each(paths, "blob", "hash-object", "--")

    def _of_each(self, paths: DataFrame, name: str, *args: str) -> DataFrame:
        root = self.root

        def ask(batches: Iterator) -> Iterator:
            for rows in batches:
                answers = [run(root, *args, path) for path in rows["path"]]
                yield rows.assign(**{name: [out.decode(errors="replace").rstrip("\n") if code == 0 else None for code, out in answers]})

        return paths.select("path").mapInPandas(ask, f"path string, {name} string")

    def document_times(self, paths: DataFrame, now: Column) -> DataFrame:
        """path, first_at, last_at over the commits of each file, also under the names it had before."""
        out = self._of_each(paths, "lines", "log", "--follow", "--format=%at\t%ct", "--").where("lines != ''")
        return git.log(out.select(F.explode(F.split("lines", "\n")).alias("one"), "path").select(F.concat("path", F.lit("\t"), "one").alias("line")), now)

    def line_times(self, paths: DataFrame, commit: str, now: Column) -> DataFrame:
        """path, line, at of each line of the files of a commit."""
        return git.line_times(self._of_each(paths, "output", "blame", "--line-porcelain", commit, "--").where("output IS NOT NULL"), now)
