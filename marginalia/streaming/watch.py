"""Changes as they come: hints are debounced per path, then batches of paths update the index.

The debouncer keeps a row of state for each path: first hint, last hint, size. A path is let go when it was quiet for a
while and its size is still that of its last hint; a file that has grown meanwhile is held for another quiet period. What is let go goes to ``foreachBatch``, whose batches are
applied with the same joins as a batch run, renames paired within a batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import is_markdown

OUT = "path string, first_at timestamp, released_at timestamp, hints long"


def classify(path: Column) -> Column:
    """markdown, structural (ignore rules, which ask for a rescan) or ignore."""
    name = F.substring_index(path, "/", -1)
    hidden = path.rlike(r"(^|/)\.[^/]+/") | name.startswith("~") | name.endswith("~")
    return F.when(name.isin(".gitignore", ".ignore"), "structural").when(hidden, "ignore").when(is_markdown(path) & ~name.startswith("."), "markdown").otherwise("ignore")


def size_of(path: str) -> int:
    """Bytes of a file, -1 if there is none."""
    try:
        return os.stat(path).st_size
    except OSError:
        return -1


class Debounce(StatefulProcessor):
    """Processing-time timers; state is one row a path and goes when the path is let go.

    ``size_now`` tells a path's size when its timer runs out, or None if that can't be known where the stream runs; then
    quiet alone decides.
    """

    quiet_ms = 1000

    @staticmethod
    def size_now(path: str) -> int | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hint", "first_ms long, last_ms long, size long, hints long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        seen = pd.concat(list(rows))
        now = timerValues.getCurrentProcessingTimeInMs()
        first, hints = now, 0
        if self.state.exists():
            first, _, _, hints = self.state.get()
        self.state.update((first, now, int(seen["size"].iloc[-1]), hints + len(seen)))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.quiet_ms)
        yield pd.DataFrame({"path": [], "first_at": pd.Series([], dtype="datetime64[us]"), "released_at": pd.Series([], dtype="datetime64[us]"), "hints": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.state.exists():
            first, _, size, hints = self.state.get()
            now, current = timerValues.getCurrentProcessingTimeInMs(), self.size_now(key[0])
            if current is not None and current != size:
                self.state.update((first, now, current, hints))
                self.handle.registerTimer(now + self.quiet_ms)
                return
            self.state.clear()
            yield pd.DataFrame({"path": [key[0]], "first_at": pd.to_datetime([first], unit="ms"), "released_at": pd.to_datetime([now], unit="ms"), "hints": [hints]})

    def close(self) -> None:
        pass


def debounced(hints: DataFrame, quiet_ms: int = 1000, size_now: Callable[[str], int | None] = Debounce.size_now) -> DataFrame:
    """hints (streaming): path, at, size -> paths let go after being quiet, whose size (as ``size_now`` tells it, such as
    ``size_of``) is that of the last hint. Needs the RocksDB state store."""
    processor = type("Debounce", (Debounce,), {"quiet_ms": quiet_ms, "size_now": staticmethod(size_now)})()
    return hints.groupBy("path").transformWithStateInPandas(processor, outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")


def settled_paths(hints: DataFrame, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The same by event time, without Python: sessions of hints whose gaps are below ``quiet``; late hints up to ``late``."""
    w = hints.withWatermark("at", late).groupBy("path", F.session_window("at", quiet).alias("w"))
    out = w.agg(F.count("*").alias("hints"), F.max_by("size", "at").alias("size"))
    return out.select("path", F.col("w.start").alias("first_at"), F.col("w.end").alias("released_at"), "hints", "size")


def hot_paths(hints: DataFrame, now: Column, ttl_seconds: int = 600) -> DataFrame:
    """Paths touched lately, the latest first: path, at, hot_rank."""
    from pyspark.sql import Window

    last = hints.groupBy("path").agg(F.max("at").alias("at")).where(F.unix_micros(now) - F.unix_micros("at") <= ttl_seconds * 1_000_000)
    return last.withColumn("hot_rank", F.row_number().over(Window.orderBy(F.desc("at"), "path")))


def plan_batch(paths: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """What a batch of paths does: path, action (index, unchanged, tombstone, ignore, rename), from_path.

    paths: path; files: path, content_hash of what exists now; docs: path, content_hash of what is indexed. A path that went
    and one that came with the same content, both in this batch, are a rename; one to one, in order of path.
    """
    from ..operators.diff import rename_pairs

    asked = paths.select("path").distinct().withColumn("kind", classify(F.col("path")))
    seen = asked.join(files.select("path", F.col("content_hash").alias("now")), "path", "left").join(docs.select("path", F.col("content_hash").alias("was")), "path", "left")
    action = (
        F.when(F.col("kind") != "markdown", "ignore").when(F.col("now").isNull() & F.col("was").isNull(), "ignore").when(F.col("now").isNull(), "tombstone")
        .when(F.col("now") == F.col("was"), "unchanged").otherwise("index")
    )
    acted = seen.withColumn("action", action)
    gone = acted.where("action = 'tombstone'").select("path", F.col("was").alias("content_hash"))
    came = acted.where("action = 'index' AND was IS NULL").select("path", F.col("now").alias("content_hash"))
    moved = rename_pairs(gone, came)
    out = acted.join(moved.select(F.col("new_path").alias("path"), F.col("old_path").alias("from_path")), "path", "left").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return out.select("path", F.when(F.col("from_path").isNotNull(), "rename").otherwise(F.col("action")).alias("action"), "from_path")


def apply_batches(released: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Start a query that hands each batch of released paths to ``apply``; batch numbers make a repeated batch recognisable."""
    return released.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("update")


def next_interval(failures: int, first: float = 5.0, most: float = 300.0) -> float:
    """Seconds to wait after so many failures in a row: doubling, bounded."""
    return min(most, first * 2 ** (failures - 1)) if failures else 0.0


def concurrency(outcomes: list[str], start: int = 2, most: int = 16, grow_after: int = 8) -> list[int]:
    """Additive increase, multiplicative decrease: the number of calls at a time after each outcome."""
    out, now, good = [], start, 0
    for outcome in outcomes:
        if outcome == "ok":
            good += 1
            if good == grow_after:
                now, good = min(most, now + 1), 0
        elif outcome == "rate_limited":
            now, good = max(1, now // 2), 0
        out.append(now)
    return out
