"""What changed between two versions: sections with their multiplicity, lines, documents and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def section_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: doc_id, idx, section_hash -> doc_id, section_hash, kind, old_idx, new_idx.

    Equal hashes are paired in order of index: at the same place they are unchanged, elsewhere moved. A copy more of a hash
    that was there before moved from its last place; a hash that is new is added once, however often it occurs.
    """
    key = ["doc_id", "section_hash"]
    a = numbered(old.select(*key, F.col("idx").alias("old_idx")), key, ["old_idx"])
    b = numbered(new.select(*key, F.col("idx").alias("new_idx")), key, ["new_idx"])
    last = a.groupBy(*key).agg(F.max("old_idx").alias("last_idx"))
    both = a.join(b, [*key, "nth"], "full").join(last, key, "left")
    kind = (
        F.when(F.col("new_idx").isNull(), "removed").when(F.col("old_idx").isNotNull(), F.when(F.col("old_idx") == F.col("new_idx"), "unchanged").otherwise("moved"))
        .when(F.col("last_idx").isNotNull(), "moved").otherwise("added")
    )
    out = both.withColumn("kind", kind).where("NOT (kind = 'added' AND nth > 1)")
    return out.select(*key, "kind", F.when(F.col("kind") == "moved", F.coalesce("old_idx", "last_idx")).otherwise(F.col("old_idx")).alias("old_idx"), "new_idx")


def upsert_outcome(old: DataFrame, new: DataFrame, cards: DataFrame) -> DataFrame:
    """Per document, for its new version: new, reused, unchanged, removed sections.

    A section is unchanged if its document had the hash before; else reused if a card or another document's section has it, or
    it repeats within the version; else new. Removed are hashes that the document no longer has.
    """
    had = old.select("doc_id", "section_hash").distinct().withColumn("had", F.lit(1))
    known = old.select("section_hash").unionByName(cards.select("section_hash")).distinct().withColumn("known", F.lit(1))
    now = numbered(new.select("doc_id", "section_hash", "idx"), ["doc_id", "section_hash"], ["idx"])
    seen = now.join(had, ["doc_id", "section_hash"], "left").join(known, "section_hash", "left")
    kind = F.when(F.col("had") == 1, "unchanged").when((F.col("known") == 1) | (F.col("nth") > 1), "reused").otherwise("new")
    counts = seen.withColumn("kind", kind).groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("new", "reused", "unchanged")])
    gone = had.join(new.select("doc_id", "section_hash").distinct(), ["doc_id", "section_hash"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("removed"))
    zero = F.lit(0).cast("long")
    return counts.join(gone, "doc_id", "full").select("doc_id", *[F.coalesce(F.col(k), zero).alias(k) for k in ("new", "reused", "unchanged", "removed")])


def carried_times(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New sections with updated_at: the old time if the document had the hash exactly once and has it exactly once, else ``now``."""
    key = ["doc_id", "section_hash"]
    before = old.groupBy(*key).agg(F.count("*").alias("n_old"), F.max("updated_at").alias("old_at"))
    w = Window.partitionBy(*key)
    seen = new.withColumn("n_new", F.count("*").over(w)).join(before, key, "left")
    return seen.withColumn("updated_at", F.when((F.col("n_old") == 1) & (F.col("n_new") == 1), F.col("old_at")).otherwise(now)).drop("n_old", "n_new", "old_at")


def document_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: path, content_hash -> path, change (added, modified, deleted) of documents that differ."""
    both = old.select("path", F.col("content_hash").alias("old_hash")).join(new.select("path", F.col("content_hash").alias("new_hash")), "path", "full")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return both.withColumn("change", change).where("change IS NOT NULL").select("path", "change")


def rename_pairs(gone: DataFrame, came: DataFrame) -> DataFrame:
    """gone, came: path, content_hash -> old_path, new_path: equal contents paired one to one, in order of path."""
    a = numbered(gone.select("content_hash", F.col("path").alias("old_path")), ["content_hash"], ["old_path"])
    b = numbered(came.select("content_hash", F.col("path").alias("new_path")), ["content_hash"], ["new_path"])
    return a.join(b, ["content_hash", "nth"]).select("old_path", "new_path")


def disk_state(docs: DataFrame, files: DataFrame) -> DataFrame:
    """docs: path, content_hash, file_mtime; files: path, content_hash, mtime, readable -> path, state.

    The hash counts only if the file's time changed.
    """
    both = docs.join(files.select("path", F.col("content_hash").alias("now_hash"), "mtime", "readable"), "path", "left")
    state = (
        F.when(F.col("mtime").isNull(), "missing").when(~F.col("readable"), "unreadable")
        .when((F.col("mtime") == F.col("file_mtime")) | (F.col("now_hash") == F.col("content_hash")), "fresh").otherwise("changed")
    )
    return both.select("path", state.alias("state"))


def lines_only_in(a: DataFrame, b: DataFrame, by: str = "doc_id") -> DataFrame:
    """a, b: by, line_no, line -> rows of a beyond the copies of the line that b has (a multiset difference, in order)."""
    key = [by, "line"]
    mine = numbered(a.select(*key, "line_no"), key, ["line_no"])
    other = b.groupBy(*key).agg(F.count("*").alias("n"))
    return mine.join(other, key, "left").where("nth > coalesce(n, 0)").select(*key, "line_no")


def tombstone(docs: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """docs with deleted_at set for the paths of ``gone``; documents that come back lose it elsewhere."""
    marked = docs.join(gone.select("path").withColumn("_gone", F.lit(True)), "path", "left")
    return marked.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), at))).drop("_gone")


def relocate(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """wanted: doc_id, idx, section_hash, heading -> the section that now stands for it: doc_id, idx, now_idx.

    Best first: same place and hash, same hash, same heading, same place; ties by index.
    """
    # of the sections that answer to a hash or a heading the first counts, so each side is one row a key
    by_place = sections.groupBy("doc_id", "idx").agg(F.max("section_hash").alias("there"), F.count("*").alias("here"))
    by_hash = sections.groupBy("doc_id", "section_hash").agg(F.min("idx").alias("hash_idx"))
    by_heading = sections.groupBy("doc_id", "heading").agg(F.min("idx").alias("heading_idx"))
    near = wanted.select("doc_id", "idx", "section_hash", "heading").join(by_place, ["doc_id", "idx"], "left")
    near = near.join(by_hash, ["doc_id", "section_hash"], "left").join(by_heading, ["doc_id", "heading"], "left")
    stays = F.when(F.col("there") == F.col("section_hash"), F.col("idx"))
    place = F.when(F.col("here") > 0, F.col("idx"))
    found = near.select("doc_id", "idx", F.coalesce(stays, "hash_idx", "heading_idx", place).alias("now_idx"))
    return found.where("now_idx IS NOT NULL")
