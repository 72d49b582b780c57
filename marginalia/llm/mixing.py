"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is all -> domain -> language -> source. A node's capacity is the tokens of its documents times the epochs
allowed. From the root down, a node's budget is shared among its children by weight; a child that can't use its share
is filled and what it leaves goes to its siblings by weight (water filling on capacity over weight). As a node never
gets more than its subtree holds, a shortage is settled among siblings first and reaches an ancestor's siblings only
when the whole subtree is full. All amounts are integers, remainders go to the first children by name, so the leaf
budgets add up to the budget exactly.

Each leaf takes whole epochs while its budget covers them, then the prefix of the next epoch's seeded order whose
running tokens before a document are below what is left. Running sums are taken in two steps (sums of hash ranges of a
leaf, then within a range), so a source with a third of all documents is spread over all tasks.

Defined results: null languages and sources are "unknown"; null or empty texts have 0 tokens and are taken only by whole
epochs or while budget is left at their place; ties in the seeded order are broken by id, then tokens. Weights that are
missing are 1, below 1 is refused. Every input row gives one row (``copies`` may be 0); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, free, settle, unused

LEVELS = ("domain", "lang", "source")


def weight_of(column: str, weights: dict[str, int]) -> Column:
    """The integer weight of a name; 1 for names not in ``weights``."""
    out = F.lit(1)
    for name, weight in weights.items():
        if weight < 1:
            raise ValueError(f"weight of {name} is below 1")
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: *parent, name, cap, weight, given (of the parent) -> the same with budget."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap").cast("double") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumn("full", (F.col("given") - before) * F.col("weight") >= F.col("cap") * rest)
    left = F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(by)
    nodes = nodes.withColumns({"left": left, "open_weight": F.greatest(open_weight, F.lit(1))})
    nodes = nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * weight) div open_weight")))
    spare = F.col("given") - F.sum("budget").over(by)
    place = F.row_number().over(by.orderBy(F.col("full").cast("int"), name))
    return nodes.withColumn("budget", F.col("budget") + F.when(~F.col("full") & (place <= spare), 1).otherwise(0)).drop("full", "left", "open_weight")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], fill: tuple[int, int], epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens -> the same with budget. ``fill``: the budget as a fraction of all tokens."""
    cap = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = None
    for k, name in enumerate(LEVELS):
        at = list(LEVELS[: k + 1])
        nodes = cap.groupBy(*at).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight_of(name, weights.get(name, {})))
        if given is None:
            all_nodes = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumns({"whole": F.sum("tokens").over(all_nodes), "most": F.sum("cap").over(all_nodes)})
            nodes = nodes.withColumn("given", F.least(F.expr(f"whole * {fill[0]} div {fill[1]}"), F.col("most")))
        else:
            nodes = nodes.join(given, at[:-1])
        given = _share(nodes, at[:-1], name).select(*at, F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), list(LEVELS))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], fill: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, domain, lang, source, tokens, budget (of the leaf), copies (how often the document is taken), th (with the id it finds the row)."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.coalesce(domain, F.lit("unknown")).alias("domain"), *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("lang", "source")], tokens.alias("tokens"))
    named = settle(named, "mix-rows")
    leaves = named.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, fill, epochs)
    full = F.expr("if(tokens = 0, 0L, budget div tokens)")
    budgets = budgets.select(*LEVELS, "budget", full.alias("rounds"), (F.col("budget") - full * F.col("tokens")).alias("left"))
    budgets = settle(budgets, "mix-budgets")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rounds").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = named.join(budgets, list(LEVELS)).withColumn("place", place).withColumn("span", F.substring("place", 1, 3))
    rows = settle(rows, "mix-placed")
    free(named, budgets)
    spans = rows.groupBy(*LEVELS, "span").agg(F.sum("tokens").alias("span_tokens"))
    ahead = Window.partitionBy(*LEVELS).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*LEVELS, "span", F.coalesce(F.sum("span_tokens").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*LEVELS, "span").orderBy("place", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.col("ahead") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    found = rows.join(spans, [*LEVELS, "span"]).withColumn("before", passed)
    copies = F.col("rounds") + F.when(F.col("before") < F.col("left"), 1).otherwise(0)
    found = found.select(F.col("id").alias(id_col), *LEVELS, "tokens", "budget", copies.cast("long").alias("copies"), "th")
    mixed = settle(found, "mix")
    free(rows)
    return mixed


def take(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], fill: tuple[int, int] = (1, 2), epochs: int = 1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all columns of ``docs``."""
    row, taken, copies, nth = unused(docs.columns, "row", "taken", "copies", "nth")
    chosen = mix(docs, domain, weights, fill, epochs, seed, id_col, text_col)
    chosen = chosen.groupBy(F.struct(F.col(id_col).alias("id"), "th").alias(taken)).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    own = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th")))
    # rows alike in id and text share their copies; the join has put them next to each other
    once = own.join(chosen, F.col(row) == F.col(taken)).dropDuplicates([row])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns, F.explode(F.expr(f"sequence(1L, `{copies}`)")).alias(nth)).select(*columns)
