"""Registered queries of state transitions: renames, cards, the queue of documents to date, agreement, links and change signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import impact as I
from ..operators import reports as R
from ..operators import states as T
from . import base as B
from . import evaluations as E

DAY = 86_400_000_000


def _days_before(days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(B.now()) - days.cast("long") * DAY)


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with what is known of their times; states and sources follow from ids."""
    docs = B.documents(B.table(spark, d, "documents"))
    k = F.col("doc_id") % 4
    state = F.when(k == 0, "git").when(k == 1, "needs").when(k == 2, "failed").otherwise("filesystem")
    source = F.when(k == 0, "git").otherwise("filesystem")
    return docs.select("*", state.alias("git_state"), source.alias("created_source"), source.alias("updated_source"), _days_before(F.col("doc_id") % 50 + 100).alias("created_at"), _days_before(F.col("doc_id") % 30).alias("first_seen_at"))


def _renames(spark: SparkSession, d: str) -> DataFrame:
    """Every sixth document is said to be now what the next one is."""
    docs = B.documents(B.table(spark, d, "documents")).select("doc_id", "path")
    old = docs.where("doc_id % 6 = 0").select(F.col("doc_id"), F.col("path").alias("old_path"))
    return old.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("new_path")), "doc_id").select("old_path", "new_path")


def renames_noted(spark: SparkSession, d: str) -> DataFrame:
    out = T.note_renames(_dated(spark, d), _renames(spark, d), B.now())
    return out.select("doc_id", "created_at", "created_source", "first_seen_at", "deleted_at")


def rename_events(spark: SparkSession, d: str) -> DataFrame:
    return T.rename_events(_dated(spark, d), _renames(spark, d), B.now())


def commit_advanced(spark: SparkSession, d: str) -> DataFrame:
    """Documents in each state: before, after a new commit that touched some, after one that may have touched all, after asking anew."""
    docs = _dated(spark, d)
    some = docs.where("doc_id % 10 = 3").select("path")
    steps = {"before": docs, "some": T.advance_commit(docs, some), "all": T.advance_commit(docs, None), "again": T.requeue_undated(docs)}
    out = None
    for name, rows in steps.items():
        one = T.state_counts(rows).select(F.lit(name).alias("step"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def files_noted(spark: SparkSession, d: str) -> DataFrame:
    docs = _dated(spark, d)
    seen = docs.where("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 2 == 0, F.col("file_mtime")).otherwise(B.now()).alias("mtime"))
    return T.files_seen(docs, seen).select("doc_id", "file_mtime", "git_state")


def dates_settled(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of dating, some of them for a content or a file time that is no longer there."""
    docs = _dated(spark, d)
    k = F.col("doc_id") % 9
    found = docs.where("doc_id % 2 = 1").select(
        "path", F.when(k == 4, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(k == 5, B.now()).otherwise(F.col("file_mtime")).alias("file_mtime"),
        F.when(k < 6, "git").when(k == 6, "failed").otherwise("filesystem").alias("outcome"), _days_before(F.lit(400)).alias("created_at"), _days_before(F.lit(300)).alias("updated_at"),
    )
    return T.settle_dates(docs, found).select("doc_id", "git_state", "created_source", "created_at", "updated_at")


def times_of_files(spark: SparkSession, d: str) -> DataFrame:
    return T.filesystem_times(_dated(spark, d)).select("doc_id", "git_state", "created_source", "updated_source", "created_at", "updated_at")


def dating_queue(spark: SparkSession, d: str) -> DataFrame:
    return T.waiting(T.requeue_undated(_dated(spark, d)), "src1/3", 40).select("path")


def _cards(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, their cards, and the cards after some failed and some were made."""
    rows = B.sections(spark, d)
    last = F.substring("section_hash", 64, 1)
    cards = B.cards(rows).select("section_hash", "state", "tldr", F.when(F.col("state") == "failed", "no answer").alias("fail_reason"), F.when(F.col("state") == "summarized", _days_before(F.ascii(last) % 20)).alias("summarized_at"))
    failed = T.mark_failed(cards, cards.where(last.isin("0", "1", "2")).select("section_hash", F.lit("too long").alias("reason")))
    made = cards.where(last.isin("2", "3", "4")).select("section_hash", F.concat(F.lit("card "), F.substring("section_hash", 1, 8)).alias("tldr"), B.now().alias("summarized_at"))
    return rows, cards, T.attach_cards(failed, made)


def card_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Cards after failures and attached ones, then failed ones asked for again: how many of each kind."""
    _, _, after = _cards(spark, d)
    again = T.retry_failed(after).select("section_hash", F.col("state").alias("next"), F.col("fail_reason").alias("next_reason"))
    both = after.join(again, "section_hash").groupBy("state", "fail_reason", "next", "next_reason", F.col("summarized_at").isNotNull().alias("dated"))
    return both.agg(F.count("*").alias("n"), F.min("tldr").alias("first_tldr"))


def card_events(spark: SparkSession, d: str) -> DataFrame:
    rows, before, after = _cards(spark, d)
    return T.card_events(before, after, rows)


def hot_pending(spark: SparkSession, d: str) -> DataFrame:
    """The next 60 hashes to summarise: those of three hot documents first."""
    rows = B.sections(spark, d)
    hot = B.table(spark, d, "documents").where("doc_id % 300 = 7").select("doc_id", F.col("doc_id").alias("place"))
    return T.hot_first(R.pending_work(rows, B.cards(rows)), rows, hot, 60).select("section_hash", "section_id", "place")


def newest_cards(spark: SparkSession, d: str) -> DataFrame:
    rows, _, after = _cards(spark, d)
    return T.newest_carded(rows, after, 25).select("section_id", "summarized_at", "section_hash")


def one_model(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors once those of all models but one are gone: a count for each label."""
    v = B.table(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 3 == 0, "small").otherwise("large").alias("model"))
    return T.only_model(v, "large").groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("last"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    y = B.table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("a"))
    b = F.when(F.col("id") % 4 == 1, (F.col("a") + 1) % 3).when(F.col("id") % 4 == 2, (F.col("a") + 2) % 3).otherwise(F.col("a"))
    scores = y.select("id", F.explode(F.array(F.struct(F.lit("a").alias("judge"), F.col("a").alias("score")), F.struct(F.lit("b").alias("judge"), b.alias("score"))))).select("id", "col.*")
    return scores, y.where("id % 4 = 1").select("id", F.col("a").alias("score"))


def judge_matrix(spark: SparkSession, d: str) -> DataFrame:
    return T.judge_matrix(_judged(spark, d)[0])


def resolved_mean(spark: SparkSession, d: str) -> DataFrame:
    return T.resolved_mean(*_judged(spark, d))


def links_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Links as people write them, from each document to the next: relative, escaped, without an ending, with a fragment, out of the root."""
    docs = B.documents(B.table(spark, d, "documents")).select("doc_id", "path")
    to = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("to"))
    name = F.regexp_replace("to", r"\.md$", "")
    k = F.col("doc_id") % 8
    written = (
        F.when(k == 0, F.concat(F.lit("../"), "to")).when(k == 1, F.concat(F.lit("/"), name)).when(k == 2, F.concat(F.lit(".././"), name, F.lit("%2Emd#top")))
        .when(k == 3, F.concat(F.lit("../../"), "to")).when(k == 4, F.concat(F.lit("//"), "to")).when(k == 5, F.concat(F.lit("/x/../"), "to", F.lit("?q=1")))
        .when(k == 6, F.concat(F.lit("/"), F.replace("to", F.lit("/"), F.lit("%2F")))).otherwise(F.concat(F.lit("/"), "to", F.lit("%")))
    )
    return I.resolve_links(docs.join(to, "doc_id").select(F.col("path").alias("from_path"), written.alias("target")), docs.select("path"))


def missed_copies(spark: SparkSession, d: str) -> DataFrame:
    """Orders as changes of a text: the same tokens replaced again within 30 days in another customer's file, per replacement."""
    o = B.table(spark, d, "orders").where("o_orderdate IS NOT NULL")
    region, price = (F.concat(F.lit(c), ((F.col("o_custkey") if c == "area" else F.floor("o_totalprice")) % m).cast("string")) for c, m in (("area", 11), ("v", 97)))
    before = F.concat(F.lit("Use "), region, F.lit(" of the day"))
    after = F.when(F.col("o_orderkey") % 7 == 0, before).when(F.col("o_orderkey") % 7 == 1, F.lit("Use of the day ok")).otherwise(F.concat(F.lit("Use "), price, F.lit(" of the day")))
    changes = I.change_signatures(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), F.col("o_orderdate").alias("at"), before.alias("before"), after.alias("after")))
    found = I.followed_by(changes, "30 days", ["removed", "added"])
    out = found.groupBy(F.array_join("removed", " ").alias("removed"), F.array_join("added", " ").alias("added"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("id_a").alias("first_changes"), F.max("days_later").alias("latest"))


def fused_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lists fused at the depth at which a question has enough pages: what is deeper adds nothing to a score."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")) - 1
    e = B.table(spark, d, "events").where("user_id IS NOT NULL")
    lists = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("list"), (F.col("event_id") % 12).alias("page"), place.alias("rank"))
    return T.fused_to_depth(lists, 1, 10, 16).select("query_id", "depth", "page", F.col("place").cast("long").alias("place"))


def questions_asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the splits that aren't sealed."""
    return V.asked(E.split_assign(spark, d)).select("query_id", "split")


def _golden(spark: SparkSession, d: str) -> DataFrame:
    """Users as questions, their events by value as hits; a page under any heading is wanted, and one under a given part of a heading."""
    from pyspark.sql import Window

    e = B.table(spark, d, "events").where("user_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")) - 1
    hits = e.select(F.col("user_id").alias("query_id"), place.alias("rank"), (F.col("event_id") % 12).cast("string").alias("path"), F.col("event_type").alias("heading"))
    questions = e.select(F.col("user_id").alias("query_id")).distinct()
    one = questions.select("query_id", (F.col("query_id") % 12).cast("string").alias("path"), F.lit(None).cast("string").alias("heading"))
    two = questions.select("query_id", (F.col("query_id") % 5).cast("string").alias("path"), F.lit("CLI").alias("heading"))
    return V.golden_ranks(questions, one.unionByName(two), hits, 5)


def golden_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _golden(spark, d).withColumn("rank", F.col("rank").cast("long"))


def golden_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.golden_summary(_golden(spark, d))


QUERIES = {f.__name__: f for f in (
    renames_noted, rename_events, commit_advanced, files_noted, dates_settled, times_of_files, dating_queue, card_transitions, card_events,
    hot_pending, newest_cards, one_model, judge_matrix, resolved_mean, links_resolved, missed_copies, fused_pages,
    questions_asked, golden_ranks, golden_summary,
)}

_DATED = f"""{B.DOCS}, dated AS (SELECT *, ['git', 'needs', 'failed', 'filesystem'][1 + doc_id % 4] AS git_state, CASE WHEN doc_id % 4 = 0 THEN 'git' ELSE 'filesystem' END AS src,
  {B.NOW_SQL} - to_days((doc_id % 50 + 100)::INT) AS created_at, {B.NOW_SQL} - to_days((doc_id % 30)::INT) AS first_seen_at FROM docs)"""
_MOVED = "moved AS (SELECT a.path AS old_path, b.path AS new_path, a.doc_id AS old_id, b.doc_id AS new_id FROM dated a JOIN dated b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 6 = 0 AND a.deleted_at IS NULL AND b.deleted_at IS NULL)"
_AFTER = f"""{B.SECTIONS}, {B.CARDS}, turned AS (SELECT section_hash, state AS was, section_hash[64] AS e, CASE WHEN state <> 'summarized' AND section_hash[64] IN ('2', '3', '4') THEN 'summarized' WHEN state = 'pending' AND section_hash[64] IN ('0', '1') THEN 'failed' ELSE state END AS state, tldr FROM cards),
after AS (SELECT section_hash, was, state, CASE WHEN state = 'failed' THEN CASE WHEN was = 'failed' THEN 'no answer' ELSE 'too long' END END AS fail_reason,
  CASE WHEN was = 'summarized' THEN {B.NOW_SQL} - to_days(ascii(e) % 20) WHEN state = 'summarized' THEN {B.NOW_SQL} END AS summarized_at, CASE WHEN was <> 'summarized' AND state = 'summarized' THEN 'card ' || substr(section_hash, 1, 8) ELSE tldr END AS tldr FROM turned)"""
_COUNTS = "count(*) FILTER (s = 'needs') AS needs, count(*) FILTER (s = 'git') AS git, count(*) FILTER (s = 'filesystem') AS filesystem, count(*) FILTER (s = 'failed') AS failed"
_STEPS = {"before": "git_state", "some": "CASE WHEN git_state = 'failed' OR doc_id % 10 = 3 THEN 'needs' ELSE git_state END", "all": "'needs'", "again": "CASE WHEN git_state = 'git' THEN 'git' ELSE 'needs' END"}
_JUDGED = "j AS (SELECT doc_id AS id, max(quality) AS a FROM labels GROUP BY 1), k AS (SELECT id, a, CASE id % 4 WHEN 1 THEN (a + 1) % 3 WHEN 2 THEN (a + 2) % 3 ELSE a END AS b FROM j)"

_GOLDEN = """h AS (SELECT user_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank, (event_id % 12)::VARCHAR AS path, event_type AS heading FROM events WHERE user_id IS NOT NULL),
golden AS (SELECT q AS query_id, min(rank) FILTER (path = (q % 12)::VARCHAR OR (path = (q % 5)::VARCHAR AND contains(lower(heading), 'cli'))) AS rank, array_to_string(list_sort([(q % 12)::VARCHAR, (q % 5)::VARCHAR || ' > CLI']), '; ') AS expected,
  arg_min(concat_ws(' > ', path, heading), rank) AS got FROM h WHERE rank < 5 GROUP BY q)"""

ORACLES = {
    "renames_noted": f"""WITH {_DATED}, {_MOVED} SELECT d.doc_id, coalesce(o.created_at, d.created_at) AS created_at, coalesce(o.src, d.src) AS created_source, coalesce(o.first_seen_at, d.first_seen_at) AS first_seen_at, CASE WHEN g.old_id IS NOT NULL THEN {B.NOW_SQL} ELSE d.deleted_at END AS deleted_at
      FROM dated d LEFT JOIN moved m ON m.new_id = d.doc_id LEFT JOIN dated o ON o.doc_id = m.old_id LEFT JOIN moved g ON g.old_id = d.doc_id""",
    "rename_events": f"WITH {_DATED}, {_MOVED} SELECT {B.NOW_SQL} AS at, 'doc_renamed' AS kind, new_path AS path, old_path AS detail FROM moved",
    "commit_advanced": f"WITH {_DATED} " + " UNION ALL ".join(f"SELECT '{k}' AS step, {_COUNTS} FROM (SELECT {v} AS s FROM dated WHERE deleted_at IS NULL)" for k, v in _STEPS.items()),
    "files_noted": f"""WITH {_DATED}, x AS (SELECT *, deleted_at IS NULL AND doc_id % 3 = 0 AND doc_id % 2 = 1 AND file_mtime <> {B.NOW_SQL} AS new FROM dated)
      SELECT doc_id, CASE WHEN new THEN {B.NOW_SQL} ELSE file_mtime END AS file_mtime, CASE WHEN new THEN 'needs' ELSE git_state END AS git_state FROM x""",
    "dates_settled": f"""WITH {_DATED}, x AS (SELECT *, deleted_at IS NULL AND doc_id % 4 = 1 AND doc_id % 9 <> 4 AND (doc_id % 9 <> 5 OR file_mtime = {B.NOW_SQL}) AS ok FROM dated), y AS (SELECT *, ok AND doc_id % 9 < 6 AS git FROM x)
      SELECT doc_id, CASE WHEN git THEN 'git' WHEN ok AND doc_id % 9 = 6 THEN 'failed' WHEN ok THEN 'filesystem' ELSE git_state END AS git_state, CASE WHEN git THEN 'git' ELSE src END AS created_source,
      CASE WHEN git THEN {B.NOW_SQL} - to_days(400) ELSE created_at END AS created_at, CASE WHEN git THEN {B.NOW_SQL} - to_days(300) ELSE updated_at END AS updated_at FROM y""",
    "times_of_files": f"""WITH {_DATED} SELECT doc_id, 'needs' AS git_state, 'filesystem' AS created_source, 'filesystem' AS updated_source, CASE WHEN src = 'git' THEN first_seen_at ELSE created_at END AS created_at, CASE WHEN git_state = 'needs' THEN updated_at ELSE file_mtime END AS updated_at FROM dated""",
    "dating_queue": f"WITH {_DATED} SELECT path FROM dated WHERE deleted_at IS NULL AND git_state <> 'git' AND path > 'src1/3' ORDER BY path LIMIT 40",
    "card_transitions": f"""WITH {_AFTER} SELECT state, fail_reason, CASE WHEN state = 'failed' THEN 'pending' ELSE state END AS next, NULL::VARCHAR AS next_reason, summarized_at IS NOT NULL AS dated, count(*) AS n, min(tldr) AS first_tldr FROM after GROUP BY ALL""",
    "card_events": f"WITH {_AFTER} SELECT section_id, doc_id, 'section_' || state AS kind FROM sections JOIN after USING (section_hash) WHERE was <> state",
    "hot_pending": f"""WITH {B.SECTIONS}, {B.CARDS} SELECT section_hash, min(section_id) AS section_id, min(CASE WHEN doc_id % 300 = 7 THEN doc_id END) AS place FROM sections JOIN cards USING (section_hash) WHERE state = 'pending' GROUP BY 1 ORDER BY place NULLS LAST, min(token_estimate), section_hash LIMIT 60""",
    "newest_cards": f"WITH {_AFTER} SELECT section_id, summarized_at, section_hash FROM sections JOIN after USING (section_hash) WHERE state = 'summarized' ORDER BY summarized_at DESC, section_id LIMIT 25",
    "one_model": "SELECT label, count(*) AS n, max(vec_id) AS last FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY 1",
    "judge_matrix": f"WITH {_JUDGED} SELECT a, b, count(*) AS n FROM k WHERE a IS NOT NULL GROUP BY ALL",
    "resolved_mean": f"WITH {_JUDGED}, f AS (SELECT CASE WHEN a = b OR id % 4 = 1 THEN a END AS v FROM k) SELECT count(*) AS n, count(*) FILTER (v IS NULL) AS open, round(avg(v), 6) AS mean FROM f",
    "links_resolved": f"WITH {B.DOCS} SELECT a.path AS from_path, b.path AS to_path FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 8 IN (0, 1, 2, 5)",
    "missed_copies": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS file, o_orderdate AS at, 'area' || o_custkey % 11 AS r, 'v' || (floor(o_totalprice)::BIGINT % 97) AS a FROM orders WHERE o_orderdate IS NOT NULL AND o_orderkey % 7 > 1),
      x AS (SELECT f.*, (epoch(l.at) - epoch(f.at)) AS gap FROM o f JOIN o l ON f.r = l.r AND f.a = l.a AND f.file <> l.file AND l.at > f.at AND epoch(l.at) - epoch(f.at) <= 30 * 86400)
      SELECT r AS removed, a AS added, count(*) AS n, count(DISTINCT id) AS first_changes, max(floor(gap / 86400))::BIGINT AS latest FROM x GROUP BY ALL""",
    "fused_pages": """WITH l AS (SELECT user_id AS q, event_id % 12 AS page, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) - 1 AS rank FROM events WHERE user_id IS NOT NULL),
      b AS (SELECT q, page, min(rank) AS r FROM l GROUP BY ALL), s AS (SELECT q, max(rank) AS last FROM l GROUP BY 1), t AS (SELECT unnest([1, 2, 4, 8, 16]) AS depth),
      c AS (SELECT q, depth, count(*) FILTER (r < depth) AS pages, any_value(last) AS last FROM b JOIN s USING (q), t GROUP BY ALL), d AS (SELECT q, min(depth) AS depth FROM c WHERE pages >= 10 OR last < depth OR depth = 16 GROUP BY 1),
      f AS (SELECT q, depth, page, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score FROM l JOIN d USING (q) WHERE rank < depth GROUP BY ALL)
      SELECT * FROM (SELECT q AS query_id, depth, page, row_number() OVER (PARTITION BY q ORDER BY score DESC, page) AS place FROM f) WHERE place <= 10""",
    "questions_asked": "SELECT query_id, split FROM (" + E.ORACLES["split_assign"] + ") WHERE split <> 'holdout'",
    "golden_ranks": f"WITH {_GOLDEN} SELECT * FROM golden",
    "golden_summary": f"WITH {_GOLDEN} SELECT count(*) AS queries, round(avg((rank IS NOT NULL)::INT), 6) AS success, round(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr, count(*) FILTER (rank IS NULL) AS misses FROM golden",
}
