"""Counts, costs, timelines and work queues over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: USD for a million tokens (input, output) by the beginning of a model's name; the longest that fits counts. A parameter, not a price list.
PRICES = {"small": (0.25, 1.25), "small-2": (0.5, 2.0), "large": (3.0, 15.0)}


def index_counts(sections: DataFrame, cards: DataFrame) -> DataFrame:
    """Live documents and sections, distinct hashes, and those by state of their card."""
    hashes = sections.groupBy("section_hash").agg(F.count("*").alias("n")).join(cards.select("section_hash", "state"), "section_hash", "left")
    per_hash = hashes.agg(
        F.sum("n").alias("sections"), F.count("*").alias("hashes"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "summarized", "failed")],
        F.sum(F.when(F.col("state") == "summarized", F.col("n")).otherwise(0)).alias("sections_carded"),
    )
    return per_hash.join(F.broadcast(sections.agg(F.countDistinct("doc_id").alias("docs"))))  # one row


def usage_by_day(ledger: DataFrame, since: Column) -> DataFrame:
    """ledger: at, model, outcome, input_tokens, output_tokens, cost_usd."""
    rows = ledger.where(F.col("at") >= since).groupBy(F.to_date("at").alias("day"), "model", "outcome")
    return rows.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def usage_totals(ledger: DataFrame) -> DataFrame:
    """Totals by day, by model and outcome, and over all, in one pass (level 1, 2, 3)."""
    rows = ledger.withColumn("day", F.to_date("at")).groupingSets([["day"], ["model", "outcome"], []], "day", "model", "outcome")
    out = rows.agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") == 3, 1).when(F.col("g") == 4, 2).otherwise(3).alias("level"), "day", "model", "outcome", "calls", "cost_usd")


def card_cost(ledger: DataFrame) -> DataFrame:
    """Cost and attempts of each card."""
    return ledger.groupBy("section_hash").agg(F.count("*").alias("attempts"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def price(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls: model, input_tokens, output_tokens; prices: prefix, usd_in, usd_out -> calls with cost_usd; unknown models cost 0."""
    # candidates by each beginning of the name keep this an equi-join
    models = calls.select("model").distinct().select("model", F.explode(F.expr("transform(sequence(1, greatest(1, length(model))), n -> substring(model, 1, n))")).alias("prefix"))
    best = models.join(prices, "prefix").groupBy("model").agg(F.max_by(F.struct("usd_in", "usd_out"), F.length("prefix")).alias("p"))
    cost = (F.col("input_tokens") * F.col("p.usd_in") + F.col("output_tokens") * F.col("p.usd_out")) / 1e6
    return calls.join(best, "model", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("p")


def timeline(events: DataFrame, docs: DataFrame, since: Column, until: Column, prefix: str | None = None) -> DataFrame:
    """Events from ``since`` (included) to ``until`` (not); documents that are unknown go by their id."""
    named = events.where((F.col("at") >= since) & (F.col("at") < until)).join(docs.select("doc_id", "path"), "doc_id", "left")
    named = named.select("id", "at", "kind", F.coalesce("path", F.col("doc_id").cast("string")).alias("path"))
    return named.where(F.substring("path", 1, len(prefix)) == prefix) if prefix else named


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("at").alias("day"), "kind").agg(F.count("*").alias("n"))


def open_sections(sections: DataFrame, cards: DataFrame) -> DataFrame:
    """Documents with sections whose card is pending or failed, and how many."""
    rows = sections.join(cards.select("section_hash", "state"), "section_hash").groupBy("doc_id")
    out = rows.agg(F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "failed").alias("failed"))
    return out.where("pending + failed > 0")


def recent_documents(docs: DataFrame, sections: DataFrame, cards: DataFrame, n: int) -> DataFrame:
    """The n documents updated last, with their sections and pending sections. Counted after the limit."""
    last = docs.where("deleted_at IS NULL").orderBy(F.desc("updated_at"), "path").limit(n)
    own = sections.join(last.select("doc_id"), "doc_id", "left_semi").join(cards.select("section_hash", "state"), "section_hash", "left")
    counts = own.groupBy("doc_id").agg(F.count("*").alias("sections"), F.count_if(F.col("state") == "pending").alias("pending"))
    return last.join(counts, "doc_id", "left").select("doc_id", "path", "updated_at", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("pending", F.lit(0)).alias("pending"))


def pending_work(sections: DataFrame, cards: DataFrame) -> DataFrame:
    """Hashes to summarise, each with its first section and how many share it."""
    due = sections.join(cards.where("state = 'pending'").select("section_hash"), "section_hash", "left_semi")
    return due.groupBy("section_hash").agg(F.min("section_id").alias("section_id"), F.min("token_estimate").alias("token_estimate"), F.count("*").alias("sections"))


def within_budget(work: DataFrame, tokens: int, limit: int) -> DataFrame:
    """The smallest pending hashes whose estimates add up to the budget at most."""
    order = Window.orderBy("token_estimate", "section_hash")
    first = work.orderBy("token_estimate", "section_hash").limit(limit)  # so the window is over a bounded number of rows
    return first.withColumn("spent", F.sum("token_estimate").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("spent") <= tokens)


def without_vector(cards: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    return cards.where("state = 'summarized'").join(vectors.where(F.col("model") == model).select("section_hash"), "section_hash", "left_anti").select("section_hash")


def live_vectors(vectors: DataFrame, sections: DataFrame, model: str) -> DataFrame:
    return vectors.where(F.col("model") == model).join(sections.select("section_hash"), "section_hash", "left_semi")


def latest_vector(vectors: DataFrame) -> DataFrame:
    """One vector per hash and model: the one embedded last."""
    return vectors.groupBy("section_hash", "model").agg(F.max_by("vector_id", F.struct("embedded_at", "vector_id")).alias("vector_id"), F.max("embedded_at").alias("embedded_at"))


def page_after(rows: DataFrame, key: str, cursor: object, n: int) -> DataFrame:
    """The next n rows by key."""
    return rows.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(n)


def source_tokens(turns: DataFrame) -> DataFrame:
    """turns: run, turn, input_tokens, output_tokens -> tokens that came from sources: growth of the input beyond the last output."""
    w = Window.partitionBy("run").orderBy("turn")
    delta = F.col("input_tokens") - F.lag("input_tokens").over(w) - F.lag("output_tokens").over(w)
    each = turns.withColumn("delta", delta)
    return each.groupBy("run").agg(
        F.coalesce(F.sum(F.greatest(F.col("delta"), F.lit(0))), F.lit(0)).alias("source_tokens"), F.coalesce(F.sum("delta"), F.lit(0)).alias("signed"),
        F.coalesce(F.sum(F.greatest(-F.col("delta"), F.lit(0))), F.lit(0)).alias("negative"), F.count_if(F.col("delta") < 0).alias("negative_turns"),
    )
