"""Analyses of stored runs: rollups of questions, differences of arms, tuning decisions, audits of judged cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def question_rollup(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """wanted: id, kind, arm, run (all that should be there); rows: id, arm, run, error, correct, tokens -> a row for each id and arm.

    A run that is missing or ended in an error counts as not correct; tokens are the median of what was reported.
    """
    seen = wanted.join(rows, ["id", "arm", "run"], "left")
    ok = F.col("error").isNotNull() & ~F.col("error")
    correct = F.when(ok, F.least(F.col("correct"), F.lit(1))).otherwise(0)
    out = seen.groupBy("id", "kind", "arm").agg(F.median(correct).alias("correct"), F.count_if(ok).alias("completed"), F.median("tokens").alias("tokens"))
    return out.select("id", "kind", "arm", "completed", F.col("correct").cast("double").alias("correct"), F.col("tokens").cast("double").alias("tokens"))


def kind_rollup(questions: DataFrame) -> DataFrame:
    """Of question_rollup, by arm and kind: questions, those that are right in most runs, and the share."""
    right = F.count_if(F.col("correct") >= 0.5)
    return questions.groupBy("arm", "kind").agg(F.count("*").alias("n"), right.alias("right"), F.round(right / F.count("*"), 6).alias("share"))


def differences(questions: DataFrame, ours: str, other: str) -> DataFrame:
    """id, delta (``ours`` less ``other``) of the questions that both arms have."""
    one = lambda arm, name: questions.where(F.col("arm") == arm).select("id", F.col("correct").alias(name))
    return one(ours, "a").join(one(other, "b"), "id").select("id", (F.col("a") - F.col("b")).alias("delta"))


def tuning_decision(scores: DataFrame, gain: float = 0.01, loss: float = 0.02) -> DataFrame:
    """scores: setting, project, reference, score -> setting, objective (mean over projects), kept.

    Every project weighs the same. A setting is kept if the objective grows by ``gain`` at least and no project falls by more
    than ``loss``.
    """
    per = scores.groupBy("setting", "project").agg(F.avg("reference").alias("r"), F.avg("score").alias("s"))
    means = per.groupBy("setting").agg(F.avg("s").alias("objective"), F.avg("r").alias("before"), F.min(F.round(F.col("s") - F.col("r"), 9)).alias("worst"))
    kept = (F.round(F.col("objective") - F.col("before"), 9) >= gain) & (F.col("worst") >= -loss)
    return means.select("setting", F.round("objective", 6).alias("objective"), kept.alias("kept"))


def card_audit(judged: DataFrame) -> DataFrame:
    """judged: card, judge, claims, unsupported -> judges' shares of unsupported claims, agreement, and cards that a judge left out.

    Two judges agree on a card if both or neither found an unsupported claim.
    """
    judges = judged.select("judge").distinct().agg(F.count("*").alias("judges"))
    per = judged.groupBy("card").agg(
        F.sum("claims").alias("claims"), F.sum("unsupported").alias("unsupported"), F.count("*").alias("n"),
        F.min((F.col("unsupported") > 0).cast("int")).alias("lo"), F.max((F.col("unsupported") > 0).cast("int")).alias("hi"),
    ).crossJoin(F.broadcast(judges))
    whole = F.col("n") == F.col("judges")
    return per.agg(
        F.count("*").alias("cards"), F.round(F.sum("unsupported") / F.sum("claims"), 6).alias("unsupported_rate"),
        F.round(F.count_if(whole & (F.col("lo") == F.col("hi"))) / F.count_if(whole), 6).alias("agreement"), F.count_if(~whole).alias("incomplete"),
    )


def regenerated(stored: DataFrame, made: DataFrame, key: str, columns: list[str], digits: int = 6) -> DataFrame:
    """Stored metrics that don't follow from the stored lists any more: key, kind (missing, extra, different).

    Numbers are the same if they are less than half a unit of the last digit apart: the mean of the same values summed in
    another order may fall on the other side of a rounding limit.
    """
    side = lambda rows, name: rows.select(key, F.struct(*columns).alias(name))
    both = side(stored, "was").join(side(made, "now"), key, "full")
    off = F.lit(False)
    for c in columns:
        was, now = F.col(f"was.{c}"), F.col(f"now.{c}")
        off |= ~(was.eqNullSafe(now) | F.coalesce(F.abs(was - now) < 0.5 * 10.0**-digits, F.lit(False)))
    kind = F.when(F.col("now").isNull(), "extra").when(F.col("was").isNull(), "missing").when(off, "different")
    return both.select(key, kind.alias("kind")).where("kind IS NOT NULL")


def within_a_day(wanted: Column, got: Column) -> Column:
    """Whether two dates are at most one day apart; a date that is missing isn't near any."""
    return F.coalesce(F.abs(F.date_diff(wanted, got)) <= 1, F.lit(False))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; "src1" isn't below "src"."""
    own = prefix.removeprefix("./").rstrip("/")
    return F.lit(True) if not own else (path == own) | path.startswith(own + "/")
