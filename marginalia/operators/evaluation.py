"""Retrieval evaluation: splits, samples, metrics, coverage and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import discounted_gain


def seeded_key(seed: int, id_col: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)


def seeded_order(questions: DataFrame, seed: int, id_col: str, by: str | None = None) -> DataFrame:
    """questions with position, from 0, in the seed's order (of each ``by``).

    Rows are sorted in ranges of the key; the ranges' sizes add up to where each starts, so no task sorts all questions.
    """
    own = [by] if by else []
    keyed = questions.withColumn("_key", seeded_key(seed, id_col)).withColumn("_range", F.substring("_key", 1, 3))
    sizes = keyed.groupBy(*own, "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*(own or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of 4096 ranges
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in own], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_of")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy(*own, "_range").orderBy("_key", id_col))
    placed = keyed.withColumn("_within", within).join(starts, same)
    return placed.select(*questions.columns, (F.col("_start") + F.col("_within") - 1).cast("long").alias("position"))


def split(questions: DataFrame, seed: int, id_col: str, by: str) -> DataFrame:
    """questions with split: the first 30 % by position are dev, the next 55 % test, the rest holdout, of each ``by``."""
    placed = seeded_order(questions, seed, id_col, by).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    dev, test = F.floor(F.col("n") * 30 / 100), F.floor(F.col("n") * 85 / 100)
    return placed.withColumn("split", F.when(F.col("position") < dev, "dev").when(F.col("position") < test, "test").otherwise("holdout")).drop("n")


def round_robin(rows: DataFrame, seed: int, id_col: str, category: str, n: int) -> DataFrame:
    """n rows, one of each category in turn; categories in the order in which the seeded order first shows them."""
    placed = seeded_order(rows, seed, id_col)
    own = Window.partitionBy(category)
    turns = placed.withColumns({"turn": F.row_number().over(own.orderBy("position")), "shown": F.min("position").over(own)})
    return turns.orderBy("turn", "shown").limit(n).drop("turn", "shown")


def first_pages(hits: DataFrame) -> DataFrame:
    """hits: query_id, page, rank (from 0) -> pages by first occurrence, with page_rank from 1."""
    first = hits.groupBy("query_id", "page").agg(F.min("rank").alias("rank"))
    return first.withColumn("page_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "page"))).drop("rank")


def question_metrics(questions: DataFrame, qrels: DataFrame, pages: DataFrame, success_at: int = 5, gain_at: int = 10) -> DataFrame:
    """A row for every question, hit or not: rank of the first relevant page (null beyond ``success_at``), ndcg."""
    wanted = qrels.select("query_id", "page").distinct()
    found = pages.join(wanted, ["query_id", "page"])
    got = found.groupBy("query_id").agg(F.min(F.when(F.col("page_rank") <= success_at, F.col("page_rank"))).alias("rank"), F.sum(F.when(F.col("page_rank") <= gain_at, discounted_gain(F.col("page_rank"))).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(gain_at)).cast("int")), F.lit(0.0), lambda s, i: s + discounted_gain(i))
    n = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    rows = questions.select("query_id").join(n, "query_id").join(got, "query_id", "left")
    return rows.select("query_id", "rank", F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def summary(per_question: DataFrame) -> DataFrame:
    return per_question.agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("success"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg("ndcg"), 6).alias("ndcg"),
    )


def coverage(questions: DataFrame, qrels: DataFrame, indexed: DataFrame) -> DataFrame:
    """How many questions have labels, labels that are indexed, and all labels indexed."""
    marks = qrels.distinct().join(indexed.select("page").distinct().withColumn("there", F.lit(1)), "page", "left")
    per = questions.select("query_id").join(marks.groupBy("query_id").agg(F.count("*").alias("labels"), F.count("there").alias("there")), "query_id", "left")
    return per.agg(
        F.count("*").alias("questions"), F.count("labels").alias("labelled"), F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"), F.coalesce(F.sum("there"), F.lit(0)).alias("labels_indexed"),
        F.count_if(F.col("labels") == F.col("there")).alias("eligible"), F.count_if((F.col("there") < F.col("labels")) & (F.col("there") > 0)).alias("partly"), F.count_if(F.col("there") == 0).alias("uncovered"),
    )


def pooled(original: DataFrame, extra: DataFrame, known: DataFrame) -> DataFrame:
    """Original labels and the extra ones of known questions, once each."""
    return original.select("query_id", "page").unionByName(extra.join(known.select("query_id"), "query_id", "left_semi").select("query_id", "page")).distinct()


def grid(questions: DataFrame, arms: DataFrame, runs: int) -> DataFrame:
    """Every question with every arm and run; arms and runs are few, listed in a manifest."""
    return questions.select("id").join(F.broadcast(arms.select("arm").distinct())).select("id", "arm", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))


def arm_medians(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Per question and arm: median score with missing and failed runs as 0, median of completed runs, failures."""
    seen = wanted.join(rows, ["id", "arm", "run"], "left").withColumn("ok", F.col("score").isNotNull() & ~F.coalesce(F.col("error"), F.lit(True)))
    score = F.when(F.col("ok"), F.col("score"))
    return seen.groupBy("id", "arm").agg(F.median(F.coalesce(score, F.lit(0.0))).alias("score"), F.median(score).alias("completed_score"), F.count_if(~F.col("ok")).alias("failed"), F.median(F.when(F.col("ok"), F.col("tokens"))).alias("tokens"))


def arm_summary(medians: DataFrame) -> DataFrame:
    return medians.groupBy("arm").agg(F.count("*").alias("questions"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.median("score"), 6).alias("median_score"), F.sum("failed").alias("failed"), F.round(F.median("tokens"), 3).alias("tokens"))


def savings(medians: DataFrame, a: str, b: str) -> DataFrame:
    """The median ratio of b's tokens to a's over questions that both completed, and what was left out."""
    x = medians.where(F.col("arm") == a).select("id", F.col("tokens").alias("ta"))
    y = medians.where(F.col("arm") == b).select("id", F.col("tokens").alias("tb"))
    both = x.join(y, "id", "full")
    ok = F.col("ta").isNotNull() & F.col("tb").isNotNull() & (F.col("ta") > 0)
    return both.agg(F.round(F.median(F.when(ok, F.col("tb") / F.col("ta"))), 6).alias("ratio"), F.count_if(ok).alias("n"), F.count_if(~ok).alias("excluded"))


def completeness(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Missing, duplicate and extra runs: id, arm, run, problem."""
    counted = rows.groupBy("id", "arm", "run").agg(F.count("*").alias("c"))
    both = wanted.withColumn("asked", F.lit(1)).join(counted, ["id", "arm", "run"], "full")
    problem = F.when(F.col("c").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("c") > 1, "duplicate")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("id", "arm", "run", "problem")


def wins_losses(base: DataFrame, new: DataFrame) -> DataFrame:
    """base, new: id, hit -> wins, losses, ties, one_sided (ids that one side lacks), delta."""
    both = base.select("id", F.col("hit").alias("b")).join(new.select("id", F.col("hit").alias("n")), "id", "full")
    return both.agg(
        F.count_if((F.col("n") == 1) & (F.col("b") == 0)).alias("wins"), F.count_if((F.col("n") == 0) & (F.col("b") == 1)).alias("losses"), F.count_if(F.col("n") == F.col("b")).alias("ties"),
        F.count_if(F.col("n").isNull() | F.col("b").isNull()).alias("one_sided"), F.round(F.avg(F.col("n") - F.col("b")), 6).alias("delta"),
    )


def set_f1(rows: DataFrame, want: str = "want", got: str = "got") -> Column:
    """F1 of two arrays as sets; two empty ones agree."""
    both = F.size(F.array_intersect(want, got))
    total = F.size(F.array_distinct(want)) + F.size(F.array_distinct(got))
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def agreement(scores: DataFrame) -> DataFrame:
    """scores: item, judge, score -> pairs of judges: items both scored, share equal, share at most one apart."""
    a = scores.select("item", F.col("judge").alias("judge_a"), F.col("score").alias("x"))
    b = scores.select("item", F.col("judge").alias("judge_b"), F.col("score").alias("y"))
    both = a.join(b, "item").where("judge_a < judge_b")  # an item has a handful of judges
    apart = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("judge_a", "judge_b").agg(F.count("*").alias("n"), F.round(F.avg((apart == 0).cast("int")), 6).alias("exact"), F.round(F.avg((apart <= 1).cast("int")), 6).alias("within_one"))


def alert_quality(findings: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Precision of findings and recall of labels, both distinct by key."""
    f, y = findings.select(*key).distinct().withColumn("f", F.lit(1)), labels.select(*key).distinct().withColumn("y", F.lit(1))
    both = f.join(y, key, "full").agg(F.count("f").alias("findings"), F.count("y").alias("labels"), F.count_if(F.col("f").isNotNull() & F.col("y").isNotNull()).alias("met"))
    return both.select("findings", "labels", "met", F.round(F.try_divide(F.col("met"), F.col("findings")), 6).alias("precision"), F.round(F.try_divide(F.col("met"), F.col("labels")), 6).alias("recall"))


def asked(placed: DataFrame, split_name: str | None = None, only: DataFrame | None = None, id_col: str = "query_id", holdout: bool = False) -> DataFrame:
    """placed: questions with split -> those to ask: of one split or all, of the ids of ``only``; holdout stays sealed unless ``holdout`` is set."""
    kind = F.coalesce("split", F.lit("holdout"))
    rows = placed.where((kind == split_name if split_name else F.lit(True)) & ((kind != "holdout") | F.lit(holdout)))
    return rows if only is None else rows.join(only.select(id_col), id_col, "left_semi")


def golden_ranks(questions: DataFrame, expected: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """questions: query_id; expected: query_id, path, heading (null: any; else a part of it in any case); hits: query_id, rank (from 0), path, heading
    -> query_id, rank of the first expected hit among k (null: missed), expected (sorted), got (the first hit)."""
    def label(heading: str) -> Column:
        return F.concat_ws(" > ", "path", heading)

    near = hits.where(F.col("rank") < k)
    want = expected.select("query_id", "path", F.lower("heading").alias("needle"))
    fits = F.col("needle").isNull() | F.lower("heading").contains(F.col("needle"))
    met = near.join(want, ["query_id", "path"]).where(fits).groupBy("query_id").agg(F.min("rank").alias("rank"))
    first = near.groupBy("query_id").agg(F.min_by(label("heading"), "rank").alias("got"))
    listed = expected.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(label("heading"))), "; ").alias("expected"))
    out = questions.select("query_id").join(met, "query_id", "left").join(first, "query_id", "left").join(listed, "query_id", "left")
    return out.select("query_id", "rank", "expected", "got")


def golden_summary(ranks: DataFrame) -> DataFrame:
    found = F.col("rank").isNotNull()
    return ranks.agg(F.count("*").alias("queries"), F.round(F.avg(found.cast("int")), 6).alias("success"), F.round(F.avg(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))), 6).alias("mrr"), F.count_if(~found).alias("misses"))
