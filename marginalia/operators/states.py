"""State transitions of documents and cards: renames, failures, retries, attached cards, and the queue of documents to date from history.

Each takes a version of a table and gives the next one; a row that does not meet its guard stays as it was. Events are tables
of their own, made from the rows that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a new path takes over from the old one.
HISTORY = ("created_at", "created_source", "first_seen_at")


def renames_in_force(docs: DataFrame, renames: DataFrame) -> DataFrame:
    """renames: old_path, new_path -> those of two different paths that both are live documents."""
    live = docs.where("deleted_at IS NULL").select("path")
    met = renames.where("old_path != new_path").join(live.withColumnRenamed("path", "old_path"), "old_path", "left_semi")
    return met.join(live.withColumnRenamed("path", "new_path"), "new_path", "left_semi").select("old_path", "new_path").distinct()


def note_renames(docs: DataFrame, renames: DataFrame, at: Column) -> DataFrame:
    """docs after renames in force: the new path has the old one's history, the old path is deleted at ``at``. A path is renamed once at most."""
    moved = renames_in_force(docs, renames)
    past = docs.select(F.col("path").alias("old_path"), *[F.col(c).alias(f"_{c}") for c in HISTORY])
    came = moved.join(past, "old_path").select(F.col("new_path").alias("path"), F.lit(True).alias("_came"), *[f"_{c}" for c in HISTORY])
    gone = moved.select(F.col("old_path").alias("path"), F.lit(True).alias("_gone"))
    both = docs.join(came, "path", "left").join(gone, "path", "left")
    own = {c: F.when(F.col("_came"), F.col(f"_{c}")).otherwise(F.col(c)) for c in HISTORY}
    own["deleted_at"] = F.when(F.col("_gone"), at).otherwise(F.col("deleted_at"))
    return both.select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns])


def rename_events(docs: DataFrame, renames: DataFrame, at: Column) -> DataFrame:
    """An event for each rename in force, of the new path, which names the old one."""
    return renames_in_force(docs, renames).select(at.alias("at"), F.lit("doc_renamed").alias("kind"), F.col("new_path").alias("path"), F.col("old_path").alias("detail"))


def mark_failed(cards: DataFrame, failures: DataFrame) -> DataFrame:
    """failures: section_hash, reason. Only a pending card fails."""
    why = failures.groupBy("section_hash").agg(F.min("reason").alias("_reason"))
    failed = (F.col("state") == "pending") & F.col("_reason").isNotNull()
    own = {"state": F.when(failed, "failed").otherwise(F.col("state")), "fail_reason": F.when(failed, F.col("_reason")).otherwise(F.col("fail_reason"))}
    return cards.join(why, "section_hash", "left").select(*[own.get(c, F.col(c)).alias(c) for c in cards.columns])


def retry_failed(cards: DataFrame) -> DataFrame:
    failed = F.col("state") == "failed"
    return cards.withColumns({"fail_reason": F.when(~failed, F.col("fail_reason")), "state": F.when(failed, "pending").otherwise(F.col("state"))})


def attach_cards(cards: DataFrame, made: DataFrame) -> DataFrame:
    """made: section_hash, tldr, summarized_at. A card that is there already stays; of several the earliest counts."""
    first = made.groupBy("section_hash").agg(F.min_by("tldr", F.struct("summarized_at", "tldr")).alias("_tldr"), F.min("summarized_at").alias("_at"))
    new = (F.col("state") != "summarized") & F.col("_at").isNotNull()
    own = {
        "state": F.when(new, "summarized").otherwise(F.col("state")), "tldr": F.when(new, F.col("_tldr")).otherwise(F.col("tldr")),
        "summarized_at": F.when(new, F.col("_at")).otherwise(F.col("summarized_at")), "fail_reason": F.when(~new, F.col("fail_reason")),
    }
    return cards.join(first, "section_hash", "left").select(*[own.get(c, F.col(c)).alias(c) for c in cards.columns])


def card_events(before: DataFrame, after: DataFrame, sections: DataFrame) -> DataFrame:
    """before, after: section_hash, state -> section_id, doc_id, kind for every section whose card failed or came."""
    turned = before.select("section_hash", F.col("state").alias("was")).join(after.select("section_hash", "state"), "section_hash").where("state != was")
    kind = F.when(F.col("state") == "summarized", "section_summarized").when(F.col("state") == "failed", "section_failed")
    return sections.join(turned.select("section_hash", kind.alias("kind")).where("kind IS NOT NULL"), "section_hash").select("section_id", "doc_id", "kind")


def advance_commit(docs: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Live documents at ``paths`` (None: all), and those that failed before, wait for a date again."""
    live = F.col("deleted_at").isNull()
    if paths is None:
        return docs.withColumn("git_state", F.when(live, "needs").otherwise(F.col("git_state")))
    marked = docs.join(paths.select("path").distinct().withColumn("_touched", F.lit(True)), "path", "left")
    due = live & ((F.col("git_state") == "failed") | F.coalesce("_touched", F.lit(False)))
    return marked.withColumn("git_state", F.when(due, "needs").otherwise(F.col("git_state"))).select(*docs.columns)


def requeue_undated(docs: DataFrame) -> DataFrame:
    """Live documents without a date from history wait for one again."""
    due = F.col("deleted_at").isNull() & F.col("git_state").isin("failed", "filesystem")
    return docs.withColumn("git_state", F.when(due, "needs").otherwise(F.col("git_state")))


def files_seen(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """seen: path, mtime, of files with unchanged content. A live document takes a new time and waits for a date again."""
    last = seen.groupBy("path").agg(F.max("mtime").alias("_mtime"))
    new = F.col("deleted_at").isNull() & F.col("_mtime").isNotNull() & ~F.col("file_mtime").eqNullSafe(F.col("_mtime"))
    own = {"file_mtime": F.when(new, F.col("_mtime")).otherwise(F.col("file_mtime")), "git_state": F.when(new, "needs").otherwise(F.col("git_state"))}
    return docs.join(last, "path", "left").select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns])


def settle_dates(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes: path, content_hash, file_mtime, outcome (git, filesystem, failed), created_at, updated_at.

    An outcome counts only if the document is live, still waits, and has the content and file time the outcome was found for.
    Times change only with the outcome git.
    """
    found = outcomes.select("path", *[F.col(c).alias(f"_{c}") for c in ("content_hash", "file_mtime", "outcome", "created_at", "updated_at")])
    same = F.col("_content_hash").eqNullSafe(F.col("content_hash")) & F.col("_file_mtime").eqNullSafe(F.col("file_mtime"))
    ok = F.col("deleted_at").isNull() & (F.col("git_state") == "needs") & F.col("_outcome").isNotNull() & same
    dated = ok & (F.col("_outcome") == "git")
    own = {"git_state": F.when(ok, F.col("_outcome")).otherwise(F.col("git_state"))}
    own |= {c: F.when(dated, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("created_at", "updated_at")}
    own |= {c: F.when(dated, "git").otherwise(F.col(c)) for c in ("created_source", "updated_source")}
    return docs.join(found, "path", "left").select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns])


def filesystem_times(docs: DataFrame) -> DataFrame:
    """Documents with dates from history go back to the times of their files, and wait for a date."""
    from_git = (F.col("created_source") == "git") | (F.col("updated_source") == "git") | (F.col("git_state") != "needs")
    own = {
        "created_at": F.when(from_git & (F.col("created_source") == "git"), F.col("first_seen_at")).otherwise(F.col("created_at")),
        "updated_at": F.when(from_git, F.coalesce("file_mtime", "first_seen_at")).otherwise(F.col("updated_at")), "git_state": F.when(from_git, "needs").otherwise(F.col("git_state")),
    }
    own |= {c: F.when(from_git, "filesystem").otherwise(F.col(c)) for c in ("created_source", "updated_source")}
    return docs.select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns])


def waiting(docs: DataFrame, after: str, n: int) -> DataFrame:
    """The next n live documents that wait for a date, by path after a cursor."""
    return docs.where((F.col("deleted_at").isNull()) & (F.col("git_state") == "needs") & (F.col("path") > after)).orderBy("path").limit(n)


def state_counts(docs: DataFrame) -> DataFrame:
    """Live documents in each state of dating, in one row."""
    states = ("needs", "git", "filesystem", "failed")
    return docs.where("deleted_at IS NULL").agg(*[F.count_if(F.col("git_state") == s).alias(s) for s in states])


def hot_first(work: DataFrame, sections: DataFrame, hot: DataFrame, n: int) -> DataFrame:
    """work: section_hash, section_id, token_estimate; hot: doc_id, place -> the next n hashes: hot documents' first, then small ones.

    A hash is as hot as the hottest document that holds it.
    """
    place = sections.join(hot, "doc_id").groupBy("section_hash").agg(F.min("place").alias("place"))
    return work.join(place, "section_hash", "left").orderBy(F.col("place").asc_nulls_last(), "token_estimate", "section_hash").limit(n)


def newest_carded(sections: DataFrame, cards: DataFrame, n: int) -> DataFrame:
    """The n sections whose cards were made last."""
    made = cards.where("state = 'summarized'").select("section_hash", "summarized_at")
    return sections.join(made, "section_hash").orderBy(F.desc("summarized_at"), "section_id").limit(n)


def only_model(vectors: DataFrame, model: str) -> DataFrame:
    """Vectors of one model; those of all others go."""
    return vectors.where(F.col("model") == model)


def review_order(pairs: DataFrame) -> DataFrame:
    """pairs: review, change, rank, strength, section_id, wording -> review, change, rank, place (from 0), repeated.

    Round by round each change of a review gets one pair, its strongest first; within a round the changes whose next pair is
    strongest come first. A pair with the section and wording of an earlier one comes after all others and uses up no turn. A
    pair's turn depends on all before it, so a review's pairs (at most a few of a change, and no texts) meet in one place.
    """
    import pandas as pd

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [list(own.itertuples(index=False)) for _, own in rows.sort_values(["change", "strength", "rank"], ascending=[True, False, True]).groupby("change")]
        at, seen, first, again = [0] * len(lists), set(), [], []
        while left := [i for i in range(len(lists)) if at[i] < len(lists[i])]:
            for i in sorted(left, key=lambda i: -lists[i][at[i]].strength):
                while at[i] < len(lists[i]):
                    pair = lists[i][at[i]]
                    at[i] += 1
                    key = (pair.section_id, tuple(sorted(pair.wording)))
                    if key[1] and key in seen:
                        again.append(pair)
                        continue
                    seen.add(key)
                    first.append(pair)
                    break
        placed = [(p.review, p.change, p.rank, n, n >= len(first)) for n, p in enumerate(first + again)]
        return pd.DataFrame(placed, columns=["review", "change", "rank", "place", "repeated"])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("review").applyInPandas(order, f"review {kinds['review']}, change {kinds['change']}, rank int, place int, repeated boolean")


def judge_matrix(scores: DataFrame, id_col: str = "id") -> DataFrame:
    """scores: id, judge, score of two judges a and b -> a, b, n: how often each pair of scores occurs."""
    both = scores.groupBy(id_col).agg(F.max(F.when(F.col("judge") == "a", F.col("score"))).alias("a"), F.max(F.when(F.col("judge") == "b", F.col("score"))).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


def resolved_mean(scores: DataFrame, thirds: DataFrame) -> DataFrame:
    """The mean over ids of two judges' score where they agree, else of a third's (thirds: id, score); ids that no one settled are counted."""
    both = scores.groupBy("id").agg(F.max(F.when(F.col("judge") == "a", F.col("score"))).alias("a"), F.max(F.when(F.col("judge") == "b", F.col("score"))).alias("b"))
    final = both.join(thirds.select("id", "score"), "id", "left").withColumn("final", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("score")))
    return final.agg(F.count("*").alias("n"), F.count_if(F.col("final").isNull()).alias("open"), F.round(F.avg("final"), 6).alias("mean"))


def fused_to_depth(lists: DataFrame, first: int, wanted: int, most: int, k: float = 60.0) -> DataFrame:
    """lists: query_id, list, page, rank -> query_id, depth, page, place (from 1) of pages by their best fused rows.

    A query's depth doubles from ``first`` until ``wanted`` distinct pages are within it, the lists are used up or ``most`` is
    reached. Fused scores are those of that depth: a row beyond it adds nothing.
    """
    from .audits import adaptive_depth

    near = lists.join(adaptive_depth(lists, first, wanted, most), "query_id").where(F.col("rank") < F.col("depth"))
    scored = near.groupBy("query_id", "depth", "page").agg(F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page"))
    return scored.withColumn("place", place).where(F.col("place") <= wanted).select("query_id", "depth", "page", "place")
