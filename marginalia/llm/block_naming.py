"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text's bytes are cut into blocks of a fixed size. Equal blocks get one integer name each: blocks are gathered by a
64-bit hash, the distinct blocks of a hash are told apart by their bytes, and the sorted result is numbered. Then
adjacent names are paired and the distinct pairs numbered, again and again, until a text has one name. Two texts
share (round, name) exactly if their bytes are equal: hashes only deal rows out, they never decide.

Text is shuffled once, with equal blocks combined before the shuffle, so a third of all rows being copies of one text
moves one block per task. Later rounds move integers. Joins on names have no bound on copies, so they are plain
sort-merge joins that adaptive execution can split.

Defined results: a null text counts as empty; empty texts are equal to each other. The largest non-null id of a group
stays. Rows that repeat id and text are copies: all count in ``group_size`` and one of them is kept. In a group whose
ids are all null, ``keep_id`` is null and one row is kept. Extra columns are ignored by ``name_texts`` and returned as
they are by ``keep_one``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, integer_names, settle, unused

BLOCK_BYTES = 16384
#: Buckets of names. Each is sorted on its own, so a bucket is what one task must be able to sort.
BUCKETS = 65536


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("raw"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("raw") / block_bytes)).cast("int"))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(raw, i * {block_bytes} + 1, {block_bytes}))")
    return rows.select("id", "sha", "n", F.posexplode(cut).alias("pos", "block")).withColumn("h", F.xxhash64("block"))


def _named_blocks(blocks: DataFrame, buckets: int) -> DataFrame:
    """h, block (null unless another block has the same hash), name."""
    found = blocks.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("same"))
    each = found.select("h", F.when(F.size("same") == 1, F.array(F.lit(None).cast("binary"))).otherwise(F.col("same")).alias("same"))
    each = each.select("h", F.posexplode("same").alias("v", "block"))
    return integer_names(each, ["h", "v"], F.col("h"), buckets).select("h", "block", "name")


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """id, sha (of the text), copies (rows alike in both), round, name: the last two are the text's identity. A settled table."""
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    names = settle(_named_blocks(blocks, buckets), "block-names")
    lone, contested = names.where("block IS NULL").select("h", "name"), names.where("block IS NOT NULL")
    rows = blocks.select("id", "sha", "n", "pos", "h").join(lone, "h").select("id", "sha", "n", "pos", "name")
    if not contested.isEmpty():
        rows = rows.unionByName(blocks.join(contested, ["h", "block"]).select("id", "sha", "n", "pos", "name"))
    rows = settle(rows, "named-rows")
    free(names)
    used = [rows]
    done = rows.where("n = 1").groupBy("id", "sha", "name").agg(F.count("*").alias("copies")).withColumn("round", F.lit(0))
    live = rows.where("n > 1").groupBy("id", "sha", "n", "pos").agg(F.first("name").alias("name"), F.count("*").alias("copies"))
    longest = rows.agg(F.max("n")).first()[0] or 1
    level = 0
    while longest > 1:
        level += 1
        pairs = live.groupBy("id", "sha", "n", "copies", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = settle(pairs, "pairs")
        named = integer_names(pairs.select("left", "right").distinct(), ["left", "right"], F.xxhash64("left", "right"), buckets)
        joined = pairs.join(named, ["left", "right"]).select("id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "copies", "name")
        joined = settle(joined, "round")
        free(pairs)
        used.append(joined)
        done = done.unionByName(joined.where("n = 1").select("id", "sha", "name", "copies", F.lit(level).alias("round")))
        live, longest = joined.where("n > 1"), (longest + 1) // 2
    identities = settle(done, "identities")
    free(*used)
    return identities


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    named = name_texts(docs, id_col, text_col, block_bytes, buckets)
    groups = named.groupBy("round", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    rows = named.join(groups, ["round", "name"]).select("*", F.explode(F.expr("sequence(1L, copies)")).alias("nth"))
    return rows.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` without copies, with all their columns."""
    copies = exact_copies(docs, id_col, text_col, block_bytes, buckets).where("kept")
    row, stays = unused(docs.columns, "row", "stays")
    stay = copies.select(F.struct(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).alias(stays))
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    own = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), sha.alias("sha")))
    # rows alike in id and text are next to each other after the join: texts are shuffled once
    kept = own.join(stay, F.col(row) == F.col(stays), "left_semi").dropDuplicates([row])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
