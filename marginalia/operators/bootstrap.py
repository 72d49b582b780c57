"""Paired bootstrap intervals from a counter-based generator, draws in parallel.

The generator is the published SplitMix64: its state advances by a constant, so draw i depends on the seed and i alone and
any task can make any range of draws. Indices below n are taken by rejection, whose chance is n / 2^64 a draw; a task that meets one replays
the stream from its start, so the result is always that of the sequential generator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank

# Fixed values of SplitMix64.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def stream_start(seed: int, label: str) -> int:
    """The first state of a labelled stream."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{label}".encode()).digest()[:8], "little")


def value_at(start: int, i: int) -> int:
    """The i-th value of a stream, from 0."""
    z = (start + GAMMA * (i + 1)) & MASK
    z = ((z ^ (z >> 30)) * MIX_1) & MASK
    z = ((z ^ (z >> 27)) * MIX_2) & MASK
    return z ^ (z >> 31)


def indices(start: int, first: int, count: int, n: int):  # noqa: ANN201
    """Values first to first + count of a stream, as indices below n."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = np.uint64(start) + np.uint64(GAMMA) * (np.arange(first, first + count, dtype=np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        z ^= z >> np.uint64(31)
    limit = MASK - (MASK + 1) % n
    if (z > np.uint64(limit)).any():
        raise OverflowError("a draw was rejected; replay the stream")
    return (z % np.uint64(n)).astype(np.int64)


def sequential(start: int, count: int, n: int) -> list[int]:
    """The first ``count`` indices with rejection, one by one."""
    out, i, limit = [], 0, MASK - (MASK + 1) % n
    while len(out) < count:
        z = value_at(start, i)
        i += 1
        if z <= limit:
            out.append(z % n)
    return out


def draw_means(spark: SparkSession, values: list[list[float]], starts: list[int], draws: int) -> DataFrame:
    """draw, mean: of each draw, the mean over groups of the mean of n values drawn with replacement from each group.

    ``values``: one list per group (the questions of one evaluation: small by nature), in a fixed order.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        arrays = [np.array(v, float) for v in values]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            total = np.zeros(len(ids))
            for x, start in zip(arrays, starts, strict=True):
                n = len(x)
                try:
                    if (np.diff(ids) == 1).all():
                        at = indices(start, int(ids[0]) * n, len(ids) * n, n).reshape(len(ids), n)
                    else:
                        at = np.stack([indices(start, int(d) * n, n, n) for d in ids])
                except OverflowError:
                    every = np.array(sequential(start, (int(ids.max()) + 1) * n, n)).reshape(-1, n)
                    at = every[ids]
                total += x[at].mean(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total / len(arrays))], names=["draw", "mean"])

    return spark.range(draws).mapInArrow(run, "draw bigint, mean double")


#: Values a task holds at once, indices it makes at once, and ranges that the draws are dealt in.
BLOCK, PIECE, RANGES = 1 << 20, 1 << 20, 64


def table_means(values: DataFrame, order: list[str], column: str, start: int, draws: int) -> DataFrame:
    """draw, mean: ``draw_means`` of one group that is a table's ``column`` in the order of ``order``; no value passes through the driver.

    Values are numbered by a range sort and kept in blocks. Each pair of a block and a range of draws is one row: the indices of
    its draws are made anew, and those that fall into the block are added up.
    """
    spark = values.sparkSession
    numbered = values.orderBy(*order).select(F.col(column).cast("double")).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    rows = spark.createDataFrame(numbered, "at bigint, value double")
    blocks = rows.groupBy(F.floor(F.col("at") / BLOCK).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("own"))
    blocks = blocks.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    step = -(-draws // RANGES)
    dealt = blocks.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(step)))).repartition(RANGES, "first")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                block, n, first = (batch.column(c)[k].as_py() for c in ("block", "n", "first"))
                own = batch.column("own")[k].values.to_numpy(zero_copy_only=False)
                low, ids = block * BLOCK, range(first, min(first + step, draws))
                sums = []
                for draw in ids:
                    total = 0.0
                    for begin in range(draw * n, (draw + 1) * n, PIECE):
                        count = min(PIECE, (draw + 1) * n - begin)
                        try:
                            at = indices(start, begin, count, n)
                        except OverflowError:
                            at = np.array(sequential(start, begin + count, n)[begin:])
                        at = at[(at >= low) & (at < low + len(own))] - low
                        total += float(own[at].sum())
                    sums.append(total)
                yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.int64()), pa.array([x / n for x in sums], pa.float64())], names=["draw", "part"])

    return dealt.select("block", "n", "first", "own").mapInArrow(run, "draw bigint, part double").groupBy("draw").agg(F.sum("part").alias("mean"))


def interval(means: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low, high: nearest-rank quantiles of the draws' means."""
    return means.select(F.round("mean", 9).alias("mean")).agg(nearest_rank("mean", low).alias("low"), nearest_rank("mean", high).alias("high"))


def paired(pairs: DataFrame, seed: int, label: str, draws: int = 5000, group: str = "project") -> DataFrame:
    """pairs: group, id, base, new -> delta, low, high, wins, losses, ties; the groups weigh the same."""
    rows = pairs.select(group, "id", "base", "new").orderBy(group, "id").collect()  # the questions of one evaluation
    groups: dict[str, list[float]] = {}
    for r in rows:
        groups.setdefault(r[group], []).append(float(r["new"]) - float(r["base"]))
    starts = [stream_start(seed, f"{label}:{g}") for g in groups]
    ends = interval(draw_means(pairs.sparkSession, list(groups.values()), starts, draws))
    per = pairs.groupBy(group).agg(F.avg(F.col("new") - F.col("base")).alias("d"), F.count_if(F.col("new") > F.col("base")).alias("w"), F.count_if(F.col("new") < F.col("base")).alias("l"), F.count_if(F.col("new") == F.col("base")).alias("t"))
    point = per.agg(F.round(F.avg("d"), 6).alias("delta"), F.sum("w").alias("wins"), F.sum("l").alias("losses"), F.sum("t").alias("ties"))
    return point.join(F.broadcast(ends)).select("delta", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "wins", "losses", "ties")  # one row each


def gates(report: DataFrame, floor: float = -0.25, least_mean: float = 4.0, grounded: float = 0.95) -> DataFrame:
    """report: low, mean, grounding -> the same with passed: no clear loss, a good mean, grounded answers."""
    return report.withColumn("passed", (F.col("low") >= floor) & (F.col("mean") >= least_mean) & (F.col("grounding") >= grounded))
