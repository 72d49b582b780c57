"""What git prints, as tables: trees, logs and line times. Running git is the caller's; nothing here starts a process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree(lines: DataFrame) -> DataFrame:
    """Lines of ``ls-tree -r``: path, blob; regular files only."""
    m = F.regexp_extract("line", r"^(100644|100755) blob ([0-9a-f]+)\t(.*)$", 2)
    return lines.select(F.regexp_extract("line", r"^\S+ \S+ \S+\t(.*)$", 1).alias("path"), m.alias("blob")).where("blob != ''")


def log(lines: DataFrame, now: Column) -> DataFrame:
    """Lines "path<TAB>author seconds<TAB>committer seconds": path, first_at, last_at of a file's commits."""
    parts = F.split("line", "\t")
    at = F.least(F.timestamp_seconds(parts[1].cast("long")), F.timestamp_seconds(parts[2].cast("long")), now)
    return lines.select(parts[0].alias("path"), at.alias("at")).groupBy("path").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def line_times(blame: DataFrame, now: Column) -> DataFrame:
    """blame: path, output (of ``blame --line-porcelain``) -> path, line, at; a gap in the lines makes ``at`` null for the whole file."""
    each = F.regexp_extract_all("output", F.lit(r"(?m)^[0-9a-f]{40,64} \d+ (\d+)(?: \d+)?\n(?:[^\t\n].*\n)*?author-time (\d+)\n(?:[^\t\n].*\n)*?committer-time (\d+)\n"), F.lit(0))
    rows = blame.select("path", F.explode(each).alias("e"))
    number = F.regexp_extract("e", r"^[0-9a-f]+ \d+ (\d+)", 1).cast("int")
    author = F.timestamp_seconds(F.regexp_extract("e", r"author-time (\d+)", 1).cast("long"))
    committer = F.timestamp_seconds(F.regexp_extract("e", r"committer-time (\d+)", 1).cast("long"))
    rows = rows.select("path", number.alias("line"), F.least(author, committer, now).alias("at"))
    whole = rows.groupBy("path").agg((F.max("line") == F.countDistinct("line")).alias("whole"))
    return rows.join(whole, "path").select("path", "line", F.when(F.col("whole"), F.col("at")).alias("at"))


def changed_since(working: DataFrame, then: DataFrame) -> DataFrame:
    """working, then: path, blob -> path, change."""
    both = working.select("path", F.col("blob").alias("now")).join(then.select("path", F.col("blob").alias("was")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def replay_mismatches(trees: DataFrame, store: DataFrame) -> DataFrame:
    """trees, store: step, path, hash -> what one side has and the other lacks, or has otherwise: step, path, kind."""
    both = trees.select("step", "path", F.col("hash").alias("t")).join(store.select("step", "path", F.col("hash").alias("s")), ["step", "path"], "full")
    kind = F.when(F.col("s").isNull(), "missing").when(F.col("t").isNull(), "extra").when(F.col("s") != F.col("t"), "different")
    return both.select("step", "path", kind.alias("kind")).where("kind IS NOT NULL")


def presence(steps: DataFrame) -> DataFrame:
    """steps: step, path, hash -> path, step, what (first_seen, changed, deleted): how a path's presence changed from step to step."""
    now = steps.select("path", "step", "hash")
    before = now.select("path", (F.col("step") + 1).alias("step"), F.col("hash").alias("was"))
    last = steps.agg(F.max("step").alias("last"))
    both = now.join(before, ["path", "step"], "full").join(F.broadcast(last)).where("step <= last")  # one row
    what = F.when(F.col("was").isNull(), "appeared").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("was"), "changed")
    return both.select("path", "step", what.alias("what")).where("what IS NOT NULL")
