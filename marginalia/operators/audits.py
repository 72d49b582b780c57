"""Checks over runs and reports: parity, grounding, denylists, citations, replays and adaptive depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adaptive_depth(lists: DataFrame, first: int, wanted: int, most: int) -> DataFrame:
    """lists: query_id, list, page, rank -> query_id, depth: the first of first, 2 first, 4 first ... at which enough distinct
    pages are within the depth, or the lists are used up, or ``most`` is reached.

    Ranks are made once; each page counts from the depth at which its best rank is reached.
    """
    best = lists.groupBy("query_id", "page").agg(F.min("rank").alias("rank"))
    depths = [first]
    while depths[-1] < most:
        depths.append(min(most, depths[-1] * 2))
    size = lists.groupBy("query_id").agg(F.max("rank").alias("last"))
    per = best.groupBy("query_id").agg(*[F.count_if(F.col("rank") < d).alias(f"n{d}") for d in depths]).join(size, "query_id")
    depth = F.lit(depths[-1])
    for d in reversed(depths):
        depth = F.when((F.col(f"n{d}") >= wanted) | (F.col("last") < d), F.lit(d)).otherwise(depth)
    return per.select("query_id", depth.alias("depth"))


def where_lost(hits: DataFrame, arm: str) -> DataFrame:
    """hits: id, arm, hit -> for questions that ``arm`` missed: how many other arms found them."""
    lost = hits.where((F.col("arm") == arm) & (F.col("hit") == 0)).select("id")
    others = hits.where((F.col("arm") != arm) & (F.col("hit") == 1)).groupBy("id").agg(F.count("*").alias("found_by"))
    return lost.join(others, "id", "left").select("id", F.coalesce("found_by", F.lit(0)).alias("found_by"))


def parity(medians: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """medians: id, arm, score -> id, a, b, parity (within the tolerance; a side that lacks a score is no parity)."""
    wide = medians.groupBy("id").pivot("arm", [a, b]).agg(F.first("score"))
    return wide.select("id", F.col(a).alias("a"), F.col(b).alias("b"), F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False)).alias("parity"))


def cost_per_thousand(ledger: DataFrame, sections: DataFrame, by: str) -> DataFrame:
    """ledger: by, cost_usd, seconds; sections: by, n -> cost and time for a thousand sections."""
    total = ledger.groupBy(by).agg(F.sum("cost_usd").alias("cost"), F.sum("seconds").alias("seconds"))
    return total.join(sections, by).select(by, F.round(F.col("cost") * 1000 / F.col("n"), 4).alias("usd_per_1k"), F.round(F.col("seconds") * 1000 / F.col("n"), 4).alias("s_per_1k"))


def grounding_verdicts(batches: DataFrame) -> DataFrame:
    """batches: id, grounded, unresolved, oversized (citations) -> id, grounded, cause.

    A run is grounded if all its batches are and no citation is unresolved or too long; else the cause is the first of
    unresolved (U), oversized (C) and not supported (N).
    """
    all_of = batches.groupBy("id").agg(F.bool_and("grounded").alias("all_grounded"), F.sum("unresolved").alias("u"), F.sum("oversized").alias("c"))
    cause = F.when(F.col("u") > 0, "U").when(F.col("c") > 0, "C").when(~F.col("all_grounded"), "N")
    return all_of.select("id", cause.isNull().alias("grounded"), cause.alias("cause"))


def denied_windows(texts: DataFrame, denied: DataFrame, width: int = 40) -> DataFrame:
    """texts: id, text; denied: text -> ids of texts that share a run of ``width`` characters with a denied one, and how many such runs.

    Windows meet by their text, a plain equi-join; a denied text is cut at every place, so alignment doesn't matter. Any window
    holds one of the blocks of half its width that start at multiples of it, so texts are first cut into those only; just the
    texts of which a block is in a denied one are cut at every place.
    """
    block = (width + 1) // 2

    def cut(rows: DataFrame, key: list[str], size: int, step: int) -> DataFrame:
        places = F.expr(f"transform(sequence(1, length(text) - {size - 1}, {step}), i -> substring(text, i, {size}))")
        return rows.where(F.length("text") >= width).select(*key, F.explode(places).alias("w"))

    near = cut(texts, ["id"], block, block).join(cut(denied, [], block, 1).distinct(), "w", "left_semi").select("id").distinct()
    some = texts.join(near, "id", "left_semi")
    met = cut(some, ["id"], width, 1).join(cut(denied, [], width, 1).distinct(), "w", "left_semi")
    return met.groupBy("id").agg(F.count("*").alias("runs"))


def resolve_citations(cited: DataFrame, inventory: DataFrame) -> DataFrame:
    """cited: id, path; inventory: page -> id, page: the page of that name, or the only one that ends in it.

    A path's endings are listed on the inventory's side, so both steps are equi-joins.
    """
    endings = inventory.select("page", F.explode(F.expr("transform(sequence(1, size(split(page, '/'))), i -> array_join(slice(split(page, '/'), i, 1000), '/'))")).alias("path"))
    unique = endings.groupBy("path").agg(F.count("*").alias("n"), F.min("page").alias("page"), F.max((F.col("page") == F.col("path")).cast("int")).alias("exact"))
    whole = unique.withColumn("page", F.when(F.col("exact") == 1, F.col("path")).when(F.col("n") == 1, F.col("page"))).where("page IS NOT NULL")
    return cited.join(whole.select("path", "page"), "path", "left").select("id", "path", "page")


def calendar_questions(changes: DataFrame, days: int = 14, most: int = 12) -> DataFrame:
    """changes: day, path -> for each day and top folder: the folder's files changed in the ``days`` up to it, if they are 1 to ``most``.

    Each change is sent to the days whose window holds it, so the range join is an equi-join of bounded growth.
    """
    own = changes.select(F.substring_index("path", "/", 1).alias("folder"), "day", "path").distinct()
    seen = own.select("folder", "path", F.explode(F.expr(f"sequence(day, date_add(day, {days - 1}))")).alias("day"))
    asked = own.select("folder", "day").distinct()
    got = seen.join(asked, ["folder", "day"], "left_semi").groupBy("folder", "day").agg(F.countDistinct("path").alias("members"))
    return got.where(F.col("members").between(1, most))


def round_robin_arms(rows: DataFrame, key: str = "item", arm: str = "arm", order: str = "place") -> DataFrame:
    """One row of each arm in turn, every item once: the arm that reaches it first keeps it."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(arm).orderBy(order, key)))
    first = turn.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("turn", arm))).where("n = 1")
    return first.select(key, arm, "turn")
