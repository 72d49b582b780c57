"""Registered reports, work queues and change queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import reports as R
from . import base as B


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = B.sections(spark, d)
    return rows, B.cards(rows)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").alias("doc_id"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return B.documents(B.table(spark, d, "documents"))


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, *usd) for p, usd in R.PRICES.items()], "prefix string, usd_in double, usd_out double")


def _at(text: str):  # noqa: ANN202
    return F.to_timestamp(F.lit(text))


def docs_counts(spark, d):  # noqa: ANN001, ANN201
    return R.index_counts(*_rows(spark, d))


def usage_by_day(spark, d):  # noqa: ANN001, ANN201
    return R.usage_by_day(B.ledger(spark, d), _at("2024-01-08 00:00:00"))


def usage_totals_grouping(spark, d):  # noqa: ANN001, ANN201
    return R.usage_totals(B.ledger(spark, d))


def card_cost(spark, d):  # noqa: ANN001, ANN201
    return R.card_cost(B.ledger(spark, d))


def model_price_prefix(spark, d):  # noqa: ANN001, ANN201
    priced = R.price(B.ledger(spark, d).drop("cost_usd"), _prices(spark))
    return priced.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def state_pivot(spark, d):  # noqa: ANN001, ANN201
    rows, cards = _rows(spark, d)
    got = rows.join(cards.select("section_hash", "state"), "section_hash").groupBy("lang").pivot("state", ["pending", "summarized", "failed"]).count()
    return got.select("lang", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in ("pending", "summarized", "failed")])


def open_sections_by_doc(spark, d):  # noqa: ANN001, ANN201
    return R.open_sections(*_rows(spark, d))


def recent_docs(spark, d):  # noqa: ANN001, ANN201
    rows, cards = _rows(spark, d)
    return R.recent_documents(_docs(spark, d), rows, cards, 20)


def timeline_window(spark, d):  # noqa: ANN001, ANN201
    return R.timeline(_events(spark, d), _docs(spark, d), _at("2024-01-05 00:00:00"), _at("2024-01-07 00:00:00"), "src1")


def timeline_daily(spark, d):  # noqa: ANN001, ANN201
    return R.daily(_events(spark, d))


def pending_representative(spark, d):  # noqa: ANN001, ANN201
    return R.pending_work(*_rows(spark, d))


def budget_cut(spark, d):  # noqa: ANN001, ANN201
    return R.within_budget(R.pending_work(*_rows(spark, d)), 3500, 100).select("section_hash", "token_estimate", "spent")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by hash: each embedding stands for a section's hash."""
    rows = B.sections(spark, d).where("idx = 0").select(F.col("doc_id").alias("vec_id"), "section_hash")
    e = B.table(spark, d, "embeddings").join(rows, "vec_id")
    return e.select("section_hash", F.when(F.col("vec_id") % 5 == 4, "old").otherwise("new").alias("model"), F.col("vec_id").alias("vector_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") % 100).alias("embedded_at"))


def cards_without_vector(spark, d):  # noqa: ANN001, ANN201
    return R.without_vector(B.cards(B.sections(spark, d)), _vectors(spark, d), "new")


def live_vectors(spark, d):  # noqa: ANN001, ANN201
    later = B.edited(B.sections(spark, d))
    return R.live_vectors(_vectors(spark, d), later, "new").select("vector_id", "section_hash")


def latest_vectors(spark, d):  # noqa: ANN001, ANN201
    return R.latest_vector(_vectors(spark, d)).select("section_hash", "model", "vector_id")


def embedding_counts(spark, d):  # noqa: ANN001, ANN201
    carded = B.cards(B.sections(spark, d)).where("state = 'summarized'")
    there = _vectors(spark, d).where("model = 'new'").select("section_hash").distinct().withColumn("there", F.lit(1))
    return carded.join(there, "section_hash", "left").agg(F.count("*").alias("carded"), F.count("there").alias("embedded"))


def malformed_vectors(spark, d):  # noqa: ANN001, ANN201
    v = B.table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 == 8, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"))
    return v.where(F.size("vector") == 64).select("vec_id")


def keyset_page(spark, d):  # noqa: ANN001, ANN201
    return R.page_after(B.cards(B.sections(spark, d)).select("section_hash", "state"), "section_hash", "8" * 64, 50)


def has_model_cards(spark, d):  # noqa: ANN001, ANN201
    rows, cards = _rows(spark, d)
    made = cards.where("state = 'summarized'")
    return rows.join(made.select("section_hash"), "section_hash", "left_semi").agg((F.count("*") > 0).alias("has_cards"), F.countDistinct("doc_id").alias("docs"))


def source_tokens_lag(spark, d):  # noqa: ANN001, ANN201
    c = B.table(spark, d, "conversations")
    turns = c.select(F.col("conv_id").alias("run"), "turn", F.length("text").cast("long").alias("input_tokens"), (F.length("text") % 37).cast("long").alias("output_tokens"))
    return R.source_tokens(turns)


def section_delta(spark, d):  # noqa: ANN001, ANN201
    rows = B.sections(spark, d)
    return D.section_delta(rows, B.edited(rows)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("old_idx").alias("old_sum"), F.sum("new_idx").alias("new_sum"))


def upsert_outcome(spark, d):  # noqa: ANN001, ANN201
    rows, cards = _rows(spark, d)
    return D.upsert_outcome(rows, B.edited(rows), cards.where("state = 'summarized'"))


def carried_times(spark, d):  # noqa: ANN001, ANN201
    rows = B.sections(spark, d).withColumn("updated_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")))
    return D.carried_times(rows, B.edited(rows), B.now()).groupBy("doc_id").agg(F.count_if(F.col("updated_at") == B.now()).alias("touched"), F.min("updated_at").alias("oldest"))


def _moved(docs: DataFrame) -> DataFrame:
    """Documents on disk later: some gone, some renamed, some changed."""
    path = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    content = F.when(F.col("doc_id") % 10 == 5, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash"))
    return docs.where("doc_id % 10 != 7 AND content_hash IS NOT NULL").select(path.alias("path"), content.alias("content_hash"), F.when(F.col("doc_id") % 10 < 6, B.now()).otherwise(F.col("file_mtime")).alias("mtime"), (F.col("doc_id") % 20 != 1).alias("readable"))


def changed_documents(spark, d):  # noqa: ANN001, ANN201
    docs = _docs(spark, d).where("content_hash IS NOT NULL")
    return D.document_changes(docs, _moved(docs))


def rename_pairs(spark, d):  # noqa: ANN001, ANN201
    docs = _docs(spark, d).where("content_hash IS NOT NULL")
    later = _moved(docs)
    return D.rename_pairs(docs.join(later, "path", "left_anti"), later.join(docs, "path", "left_anti"))


def stale_docs(spark, d):  # noqa: ANN001, ANN201
    docs = _docs(spark, d).where("content_hash IS NOT NULL")
    return D.disk_state(docs, _moved(docs))


def line_multiset_diff(spark, d):  # noqa: ANN001, ANN201
    rows = B.sections(spark, d)
    later = B.edited(rows)
    cut = lambda r: r.select("doc_id", F.col("text").alias("line"), F.col("idx").alias("line_no"))
    return D.lines_only_in(cut(later), cut(rows)).select("doc_id", "line_no", F.md5("line").alias("line_md5"))


def relocated(spark, d):  # noqa: ANN001, ANN201
    rows = B.sections(spark, d)
    heading = F.concat_ws("/", "source", "lang")
    return D.relocate(rows.withColumn("heading", heading), B.edited(rows).withColumn("heading", F.concat(heading, F.lit("!"))))


def dedupe_content_hash(spark, d):  # noqa: ANN001, ANN201
    return B.sections(spark, d).groupBy("section_hash").agg(F.count("*").alias("sections"), F.countDistinct("doc_id").alias("docs"), F.min("section_id").alias("first_section")).where("sections > 1")


def debounce_sessions(spark, d):  # noqa: ANN001, ANN201
    e = _events(spark, d)
    s = e.groupBy("doc_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("hints"))
    return s.select("doc_id", F.col("w.start").alias("first_at"), F.col("w.end").alias("released_at"), "hints")


def tumbling_daily(spark, d):  # noqa: ANN001, ANN201
    w = B.table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def corpus_commitment(spark, d):  # noqa: ANN001, ANN201
    """Digests of (path, hash): of each range of the paths' hashes in order, of each source's ranges, and of all sources (as "*")."""
    docs = _docs(spark, d).where("content_hash IS NOT NULL").withColumn("source", F.substring_index("path", "/", 1))
    folded = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256).alias("digest")
    ranges = docs.groupBy("source", F.substring(F.sha2("path", 256), 1, 3).alias("range")).agg(folded(F.concat_ws(":", "path", "content_hash")))
    sources = ranges.groupBy("source").agg(folded(F.concat_ws(":", "range", "digest")))
    return sources.unionByName(sources.agg(folded(F.concat_ws(":", "source", "digest"))).select(F.lit("*").alias("source"), "digest"))


QUERIES = {f.__name__: f for f in (docs_counts, usage_by_day, usage_totals_grouping, card_cost, model_price_prefix, state_pivot, open_sections_by_doc, recent_docs, timeline_window, timeline_daily, pending_representative, budget_cut, cards_without_vector, live_vectors, latest_vectors, embedding_counts, malformed_vectors, keyset_page, has_model_cards, source_tokens_lag, section_delta, upsert_outcome, carried_times, changed_documents, rename_pairs, stale_docs, line_multiset_diff, relocated, dedupe_content_hash, debounce_sessions, tumbling_daily, corpus_commitment)}

_W = f"WITH {B.SECTIONS}, {B.CARDS}"
_E = f"WITH {B.SECTIONS}, {B.CARDS}, {B.EDITED}"
_V = "vecs AS (SELECT section_hash, CASE WHEN vec_id % 5 = 4 THEN 'old' ELSE 'new' END AS model, vec_id AS vector_id, to_timestamp(1704067200 + vec_id % 100) AS embedded_at FROM embeddings e JOIN sections s ON s.doc_id = e.vec_id AND s.idx = 0)"
_M = f"""WITH {B.DOCS}, live AS (SELECT * FROM docs WHERE content_hash IS NOT NULL), moved AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 10 = 5 THEN sha256(content_hash || 'x') ELSE content_hash END AS content_hash,
  CASE WHEN doc_id % 10 < 6 THEN {B.NOW_SQL} ELSE file_mtime END AS mtime, doc_id % 20 <> 1 AS readable FROM live WHERE doc_id % 10 <> 7)"""
ORACLES = {
    "docs_counts": f"""{_W}, h AS (SELECT section_hash, count(*) AS n FROM sections GROUP BY 1) SELECT sum(n)::BIGINT AS sections, count(*) AS hashes, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'summarized') AS summarized, count(*) FILTER (state = 'failed') AS failed,
      sum(CASE WHEN state = 'summarized' THEN n ELSE 0 END)::BIGINT AS sections_carded, (SELECT count(DISTINCT doc_id) FROM sections) AS docs FROM h JOIN cards USING (section_hash)""",
    "usage_by_day": f"WITH {B.LEDGER} SELECT CAST(ledger.at AS DATE) AS day, model, outcome, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 4) AS cost_usd FROM ledger WHERE ledger.at >= TIMESTAMP '2024-01-08' GROUP BY ALL",
    "usage_totals_grouping": f"WITH {B.LEDGER} SELECT CASE grouping(day, model, outcome) WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS level, day, model, outcome, count(*) AS calls, round(sum(cost_usd), 4) AS cost_usd FROM (SELECT *, CAST(ledger.at AS DATE) AS day FROM ledger) GROUP BY GROUPING SETS ((day), (model, outcome), ())",
    "card_cost": f"WITH {B.LEDGER} SELECT section_hash, count(*) AS attempts, round(sum(cost_usd), 6) AS cost_usd FROM ledger GROUP BY 1",
    "model_price_prefix": f"""WITH {B.LEDGER}, prices(prefix, i, o) AS (VALUES {", ".join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE)" for p, (a, b) in R.PRICES.items())})
      SELECT model, count(*) AS calls, round(sum(coalesce((SELECT (input_tokens * i + output_tokens * o) / 1e6 FROM prices WHERE starts_with(model, prefix) ORDER BY length(prefix) DESC LIMIT 1), 0)), 6) AS cost_usd FROM ledger GROUP BY 1""",
    "state_pivot": f"{_W} SELECT lang, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'summarized') AS summarized, count(*) FILTER (state = 'failed') AS failed FROM sections JOIN cards USING (section_hash) GROUP BY 1",
    "open_sections_by_doc": f"{_W} SELECT doc_id, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'failed') AS failed FROM sections JOIN cards USING (section_hash) GROUP BY 1 HAVING pending + failed > 0",
    "recent_docs": f"{_W}, {B.DOCS}, last AS (SELECT * FROM docs WHERE deleted_at IS NULL ORDER BY updated_at DESC, path LIMIT 20) SELECT doc_id, path, updated_at, count(section_id) AS sections, count(*) FILTER (state = 'pending') AS pending FROM last LEFT JOIN sections USING (doc_id) LEFT JOIN cards USING (section_hash) GROUP BY ALL",
    "timeline_window": f"WITH {B.DOCS} SELECT event_id AS id, ts AS at, event_type AS kind, coalesce(path, user_id::VARCHAR) AS path FROM events LEFT JOIN docs ON doc_id = user_id WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' AND substr(coalesce(path, user_id::VARCHAR), 1, 4) = 'src1'",
    "timeline_daily": "SELECT ts::DATE AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "pending_representative": f"{_W} SELECT section_hash, min(section_id) AS section_id, min(token_estimate) AS token_estimate, count(*) AS sections FROM sections JOIN cards USING (section_hash) WHERE state = 'pending' GROUP BY 1",
    "budget_cut": f"{_W} SELECT * FROM (SELECT section_hash, token_estimate, sum(token_estimate) OVER (ORDER BY token_estimate, section_hash ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM (SELECT section_hash, min(token_estimate) AS token_estimate FROM sections JOIN cards USING (section_hash) WHERE state = 'pending' GROUP BY 1 ORDER BY 2, 1 LIMIT 100)) WHERE spent <= 3500",
    "cards_without_vector": f"{_W}, {_V} SELECT section_hash FROM cards WHERE state = 'summarized' AND NOT EXISTS (SELECT 1 FROM vecs v WHERE v.section_hash = cards.section_hash AND model = 'new')",
    "live_vectors": f"{_E}, {_V} SELECT vector_id, section_hash FROM vecs WHERE model = 'new' AND section_hash IN (SELECT section_hash FROM edited)",
    "latest_vectors": f"{_W}, {_V} SELECT section_hash, model, arg_max(vector_id, (embedded_at, vector_id)) AS vector_id FROM vecs GROUP BY ALL",
    "embedding_counts": f"{_W}, {_V} SELECT count(*) AS carded, count(*) FILTER (section_hash IN (SELECT section_hash FROM vecs WHERE model = 'new')) AS embedded FROM cards WHERE state = 'summarized'",
    "malformed_vectors": "SELECT vec_id FROM embeddings WHERE len(CASE WHEN vec_id % 9 = 8 THEN embedding[1:3] ELSE embedding END) = 64",
    "keyset_page": f"{_W} SELECT section_hash, state FROM cards WHERE section_hash > repeat('8', 64) ORDER BY 1 LIMIT 50",
    "has_model_cards": f"{_W} SELECT count(*) > 0 AS has_cards, count(DISTINCT doc_id) AS docs FROM sections JOIN cards USING (section_hash) WHERE state = 'summarized'",
    "source_tokens_lag": """WITH t AS (SELECT conv_id AS run, length(text) - lag(length(text)) OVER w - lag(length(text) % 37) OVER w AS delta FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT run, coalesce(sum(greatest(delta, 0)), 0)::BIGINT AS source_tokens, coalesce(sum(delta), 0)::BIGINT AS signed, coalesce(sum(greatest(-delta, 0)), 0)::BIGINT AS negative, count(*) FILTER (delta < 0) AS negative_turns FROM t GROUP BY 1""",
    "section_delta": f"""{_E}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_hash ORDER BY idx) AS nth FROM sections), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_hash ORDER BY idx) AS nth FROM edited),
      l AS (SELECT doc_id, section_hash, max(idx) AS last_idx FROM sections GROUP BY ALL),
      k AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.idx IS NULL THEN 'removed' WHEN a.idx = b.idx THEN 'unchanged' WHEN a.idx IS NOT NULL OR last_idx IS NOT NULL THEN 'moved' ELSE 'added' END AS kind, coalesce(a.nth, b.nth) AS nth, coalesce(a.idx, last_idx) AS o, b.idx AS n
        FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.section_hash = b.section_hash AND a.nth = b.nth LEFT JOIN l ON l.doc_id = coalesce(a.doc_id, b.doc_id) AND l.section_hash = coalesce(a.section_hash, b.section_hash))
      SELECT doc_id, kind, count(*) AS n, sum(CASE WHEN kind = 'added' THEN NULL ELSE o END)::BIGINT AS old_sum, sum(n)::BIGINT AS new_sum FROM k WHERE NOT (kind = 'added' AND nth > 1) GROUP BY ALL""",
    "upsert_outcome": f"""{_E}, s AS (SELECT e.doc_id, CASE WHEN h.doc_id IS NOT NULL THEN 'unchanged' WHEN k.section_hash IS NOT NULL OR nth > 1 THEN 'reused' ELSE 'new' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_hash ORDER BY idx) AS nth FROM edited) e
        LEFT JOIN (SELECT DISTINCT doc_id, section_hash FROM sections) h ON h.doc_id = e.doc_id AND h.section_hash = e.section_hash LEFT JOIN (SELECT section_hash FROM sections UNION SELECT section_hash FROM cards WHERE state = 'summarized') k ON k.section_hash = e.section_hash),
      g AS (SELECT doc_id, count(*) AS removed FROM (SELECT DISTINCT doc_id, section_hash FROM sections EXCEPT SELECT doc_id, section_hash FROM edited) GROUP BY 1),
      c AS (SELECT doc_id, count(*) FILTER (kind = 'new') AS new, count(*) FILTER (kind = 'reused') AS reused, count(*) FILTER (kind = 'unchanged') AS unchanged FROM s GROUP BY 1)
      SELECT doc_id, coalesce(new, 0) AS new, coalesce(reused, 0) AS reused, coalesce(unchanged, 0) AS unchanged, coalesce(removed, 0) AS removed FROM c FULL JOIN g USING (doc_id)""",
    "carried_times": f"""{_E}, o AS (SELECT doc_id, section_hash, count(*) AS n FROM sections GROUP BY ALL), x AS (SELECT e.doc_id, CASE WHEN o.n = 1 AND count(*) OVER (PARTITION BY e.doc_id, e.section_hash) = 1 THEN make_timestamp((1704067200 + e.doc_id) * 1000000) ELSE {B.NOW_SQL} END AS t FROM edited e LEFT JOIN o USING (doc_id, section_hash))
      SELECT doc_id, count(*) FILTER (t = {B.NOW_SQL}) AS touched, min(t) AS oldest FROM x GROUP BY 1""",
    "changed_documents": f"{_M} SELECT coalesce(l.path, m.path) AS path, CASE WHEN l.path IS NULL THEN 'added' WHEN m.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM live l FULL JOIN moved m ON l.path = m.path WHERE l.content_hash IS DISTINCT FROM m.content_hash",
    "rename_pairs": f"""{_M}, g AS (SELECT content_hash, path AS old_path, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS nth FROM live WHERE path NOT IN (SELECT path FROM moved)), c AS (SELECT content_hash, path AS new_path, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS nth FROM moved WHERE path NOT IN (SELECT path FROM live))
      SELECT old_path, new_path FROM g JOIN c USING (content_hash, nth)""",
    "stale_docs": f"{_M} SELECT l.path, CASE WHEN m.mtime IS NULL THEN 'missing' WHEN NOT readable THEN 'unreadable' WHEN m.mtime = l.file_mtime OR m.content_hash = l.content_hash THEN 'fresh' ELSE 'changed' END AS state FROM live l LEFT JOIN moved m USING (path)",
    "line_multiset_diff": f"""{_E}, n AS (SELECT doc_id, text, count(*) AS c FROM sections GROUP BY ALL) SELECT e.doc_id, e.idx AS line_no, md5(e.text) AS line_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY idx) AS nth FROM edited) e LEFT JOIN n ON n.doc_id = e.doc_id AND n.text = e.text WHERE nth > coalesce(c, 0)""",
    "relocated": f"""{_E}, r AS (SELECT s.doc_id, s.idx, e.idx AS now_idx, CASE WHEN e.section_hash = s.section_hash AND e.idx = s.idx THEN 0 WHEN e.section_hash = s.section_hash THEN 1 WHEN e.idx = s.idx THEN 3 END AS rank FROM sections s JOIN edited e USING (doc_id))
      SELECT doc_id, idx, arg_min(now_idx, rank * 1000000000::BIGINT + now_idx) AS now_idx FROM r WHERE rank IS NOT NULL GROUP BY ALL""",
    "dedupe_content_hash": f"{_W} SELECT section_hash, count(*) AS sections, count(DISTINCT doc_id) AS docs, min(section_id) AS first_section FROM sections GROUP BY 1 HAVING count(*) > 1",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
      SELECT user_id AS doc_id, min(ts) AS first_at, max(ts) + INTERVAL 30 MINUTE AS released_at, count(*) AS hints FROM n GROUP BY user_id, s""",
    "tumbling_daily": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "corpus_commitment": f"""WITH {B.DOCS}, r AS (SELECT split_part(path, '/', 1) AS source, sha256(path)[1:3] AS range, sha256(string_agg(path || ':' || content_hash, chr(10) ORDER BY path || ':' || content_hash)) AS digest FROM docs WHERE content_hash IS NOT NULL GROUP BY ALL),
      s AS (SELECT source, sha256(string_agg(range || ':' || digest, chr(10) ORDER BY range || ':' || digest)) AS digest FROM r GROUP BY 1) SELECT * FROM s UNION ALL SELECT '*', sha256(string_agg(source || ':' || digest, chr(10) ORDER BY source || ':' || digest)) FROM s""",
}
