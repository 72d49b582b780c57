"""Registered audits, histories and file queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audits as A
from ..operators import impact as I
from ..sources import git
from ..streaming import watch
from . import base as B
from . import evaluations as E


def adaptive_depth(spark, d):  # noqa: ANN001, ANN201
    e = B.table(spark, d, "events")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")) - 1
    lists = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("list"), (F.col("event_id") % 12).alias("page"), place.alias("rank"))
    return A.adaptive_depth(lists, 1, 10, 16)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return E._runs(spark, d).where("run = 1").select("id", "arm", (F.col("score") >= 3).cast("int").alias("hit"))


def where_lost(spark, d):  # noqa: ANN001, ANN201
    return A.where_lost(_hits(spark, d), "base")


def parity_table(spark, d):  # noqa: ANN001, ANN201
    from ..operators import evaluation as V

    return A.parity(V.arm_medians(E._wanted(spark, d), E._runs(spark, d)), "base", "new", 1.0)


def build_cost(spark, d):  # noqa: ANN001, ANN201
    ledger = B.ledger(spark, d).select("model", "cost_usd", (F.col("output_tokens") / 10.0).alias("seconds"))
    n = B.ledger(spark, d).groupBy("model").agg(F.countDistinct("section_hash").alias("n"))
    return A.cost_per_thousand(ledger, n, "model")


def grounding_verdicts(spark, d):  # noqa: ANN001, ANN201
    c = B.table(spark, d, "conversations")
    n = F.length("text")
    return A.grounding_verdicts(c.select(F.col("conv_id").alias("id"), (n % 11 != 0).alias("grounded"), (n % 37 == 0).cast("int").alias("unresolved"), (n % 29 == 0).cast("int").alias("oversized")))


def denied_windows(spark, d):  # noqa: ANN001, ANN201
    docs = B.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return A.denied_windows(docs, B.table(spark, d, "benchmark").select("text"))


def resolve_citations(spark, d):  # noqa: ANN001, ANN201
    docs = B.documents(B.table(spark, d, "documents"))
    inventory = docs.select(F.concat(F.lit("docs/"), "path").alias("page"))
    name = F.concat("doc_id", F.lit(".md"))
    cited = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("docs/"), "path")).when(F.col("doc_id") % 3 == 1, name).otherwise(F.concat(F.lit("x/"), name)).alias("path"))
    return A.resolve_citations(cited, inventory)


def calendar_questions(spark, d):  # noqa: ANN001, ANN201
    o = B.table(spark, d, "orders")
    return A.calendar_questions(o.select(F.to_date("o_orderdate").alias("day"), F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey").cast("string")).alias("path")))


def round_robin_arms(spark, d):  # noqa: ANN001, ANN201
    e = B.table(spark, d, "events")
    return A.round_robin_arms(e.select((F.col("event_id") % 90).alias("item"), F.col("event_type").alias("arm"), F.col("event_id").alias("place")))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Trees of a repository at four steps: documents come, change and go by their id."""
    docs = B.documents(B.table(spark, d, "documents")).where("content_hash IS NOT NULL")
    each = docs.select("path", "doc_id", "content_hash", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step"))
    there = each.where("step >= doc_id % 3 AND NOT (doc_id % 7 = 6 AND step = 2)")
    return there.select("step", "path", F.when((F.col("doc_id") % 5 == 4) & (F.col("step") == 3), F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("hash"), "doc_id")


def step_presence(spark, d):  # noqa: ANN001, ANN201
    return git.presence(_steps(spark, d))


def replay_validation(spark, d):  # noqa: ANN001, ANN201
    trees = _steps(spark, d)
    store = trees.where("doc_id % 13 != 5").withColumn("hash", F.when(F.col("doc_id") % 17 == 3, F.lit("?")).otherwise(F.col("hash")))
    extra = trees.where("doc_id % 19 = 2").withColumn("path", F.concat(F.lit("x/"), "path"))
    return git.replay_mismatches(trees, store.unionByName(extra))


def hot_paths(spark, d):  # noqa: ANN001, ANN201
    e = B.table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("at"))
    return watch.hot_paths(e, F.to_timestamp(F.lit("2024-01-15 12:00:00")), 86400 * 30).where("hot_rank <= 25").select("path", "hot_rank")


def batch_plan(spark, d):  # noqa: ANN001, ANN201
    from .tables import _moved

    docs = B.documents(B.table(spark, d, "documents")).where("content_hash IS NOT NULL")
    later = _moved(docs)
    return watch.plan_batch(docs.select("path").unionByName(later.select("path")), later, docs)


def section_pairs(spark, d):  # noqa: ANN001, ANN201
    rows = B.sections(spark, d)
    cut = lambda r: r.select(F.col("doc_id").cast("string").alias("path"), "idx", F.substring("text", 1, 5).alias("heading"), "text")
    return I.pair_sections(cut(rows), cut(B.edited(rows).where("idx < 100000"))).groupBy("stage").agg(F.count("*").alias("n"), F.sum("old_idx").alias("old_sum"), F.sum("new_idx").alias("new_sum"))


def heading_keys(spark, d):  # noqa: ANN001, ANN201
    made = F.concat(F.lit("`Set` {% if x %}  "), F.substring_index("text", "\n", 1), F.when(F.col("doc_id") % 2 == 0, "  {% open").otherwise(" END"))
    return B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.normalize_heading(made).alias("key"))


QUERIES = {f.__name__: f for f in (adaptive_depth, where_lost, parity_table, build_cost, grounding_verdicts, denied_windows, resolve_citations, calendar_questions, round_robin_arms, step_presence, replay_validation, hot_paths, batch_plan, section_pairs, heading_keys)}

_STEPS = f"{B.DOCS}, steps AS (SELECT step, path, CASE WHEN doc_id % 5 = 4 AND step = 3 THEN content_hash || 'x' ELSE content_hash END AS hash, doc_id FROM docs, (SELECT unnest([0, 1, 2, 3]) AS step) WHERE content_hash IS NOT NULL AND step >= doc_id % 3 AND NOT (doc_id % 7 = 6 AND step = 2))"


def _pair_sql() -> str:
    """Four stages; each takes keys that are unique on both sides among what is left."""
    out, a, b, met = [], "a0", "b0", []
    for k, key in enumerate(("t, h", "t", "h, i", "h"), 1):
        one = lambda rel: f"(SELECT * FROM {rel} QUALIFY count(*) OVER (PARTITION BY path, {key}) = 1)"  # noqa: B023, E731
        out.append(f"m{k} AS (SELECT x.path, x.i AS o, y.i AS n, {k} AS stage FROM {one(a)} x JOIN {one(b)} y ON x.path = y.path AND {' AND '.join(f'x.{c} = y.{c}' for c in key.split(', '))})")
        out.append(f"a{k} AS (SELECT * FROM {a} WHERE NOT EXISTS (SELECT 1 FROM m{k} WHERE m{k}.path = {a}.path AND o = i))")
        out.append(f"b{k} AS (SELECT * FROM {b} WHERE NOT EXISTS (SELECT 1 FROM m{k} WHERE m{k}.path = {b}.path AND n = i))")
        a, b = f"a{k}", f"b{k}"
        met.append(f"SELECT * FROM m{k}")
    return f"""{", ".join(out)}, every AS ({" UNION ALL ".join(met)} UNION ALL SELECT path, i, NULL, NULL FROM a4 UNION ALL SELECT path, NULL, i, NULL FROM b4)"""


ORACLES = {
    "adaptive_depth": """WITH l AS (SELECT user_id AS q, event_id % 12 AS page, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) - 1 AS rank FROM events), b AS (SELECT q, page, min(rank) AS r FROM l GROUP BY ALL), s AS (SELECT q, max(rank) AS last FROM l GROUP BY 1)
      SELECT q AS query_id, coalesce(min(CASE WHEN n >= 10 OR last < d THEN d END), 16)::INT AS depth FROM (SELECT q, d, count(*) FILTER (r < d) AS n, any_value(last) AS last FROM b JOIN s USING (q), (SELECT unnest([1, 2, 4, 8, 16]) AS d) GROUP BY q, d) GROUP BY q""",
    "where_lost": f"WITH {E._RUNS}, h AS (SELECT id, arm, (score >= 3)::INT AS hit FROM runs WHERE run = 1) SELECT id, (SELECT count(*) FROM h o WHERE o.id = h.id AND o.arm <> 'base' AND o.hit = 1) AS found_by FROM h WHERE arm = 'base' AND hit = 0",
    "parity_table": f"WITH {E._RUNS} SELECT id, max(score) FILTER (arm = 'base') AS a, max(score) FILTER (arm = 'new') AS b, coalesce(abs(a - b) <= 1, false) AS parity FROM medians GROUP BY id",
    "build_cost": f"WITH {B.LEDGER} SELECT model, round(sum(cost_usd) * 1000 / count(DISTINCT section_hash), 4) AS usd_per_1k, round(sum(output_tokens / 10.0::DOUBLE) * 1000 / count(DISTINCT section_hash), 4) AS s_per_1k FROM ledger GROUP BY 1",
    "grounding_verdicts": "SELECT conv_id AS id, cause IS NULL AS grounded, cause FROM (SELECT conv_id, CASE WHEN bool_or(length(text) % 37 = 0) THEN 'U' WHEN bool_or(length(text) % 29 = 0) THEN 'C' WHEN bool_or(length(text) % 11 = 0) THEN 'N' END AS cause FROM conversations GROUP BY 1)",
    "denied_windows": "WITH w AS (SELECT DISTINCT substr(text, i, 40) AS w FROM (SELECT text, unnest(range(1, length(text) - 38)) AS i FROM benchmark WHERE length(text) >= 40)), t AS (SELECT doc_id AS id, substr(text, i, 40) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 38)) AS i FROM documents WHERE length(text) >= 40)) SELECT id, count(*) AS runs FROM t WHERE w IN (SELECT w FROM w) GROUP BY 1",
    "resolve_citations": f"WITH {B.DOCS} SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'docs/' || path WHEN 1 THEN doc_id || '.md' ELSE 'x/' || doc_id || '.md' END AS path, CASE WHEN doc_id % 3 < 2 THEN 'docs/' || path END AS page FROM docs",
    "calendar_questions": "WITH c AS (SELECT DISTINCT o_orderpriority AS folder, o_orderdate::DATE AS day, o_custkey AS path FROM orders) SELECT a.folder, a.day, count(DISTINCT b.path) AS members FROM (SELECT DISTINCT folder, day FROM c) a JOIN c b ON a.folder = b.folder AND b.day BETWEEN a.day - 13 AND a.day GROUP BY ALL HAVING members BETWEEN 1 AND 12",
    "round_robin_arms": "WITH t AS (SELECT event_id % 90 AS item, event_type AS arm, row_number() OVER (PARTITION BY event_type ORDER BY event_id, event_id % 90) AS turn FROM events) SELECT item, arm, turn::INT AS turn FROM t QUALIFY row_number() OVER (PARTITION BY item ORDER BY turn, arm) = 1",
    "step_presence": f"WITH {_STEPS}, p AS (SELECT coalesce(n.path, w.path) AS path, coalesce(n.step, w.step + 1) AS step, n.hash AS h, w.hash AS was FROM steps n FULL JOIN steps w ON n.path = w.path AND n.step = w.step + 1) SELECT path, step, CASE WHEN was IS NULL THEN 'appeared' WHEN h IS NULL THEN 'deleted' ELSE 'changed' END AS what FROM p WHERE step <= 3 AND h IS DISTINCT FROM was",
    "replay_validation": f"WITH {_STEPS} SELECT step, path, CASE WHEN doc_id % 13 = 5 THEN 'missing' ELSE 'different' END AS kind FROM steps WHERE doc_id % 13 = 5 OR doc_id % 17 = 3 UNION ALL SELECT step, 'x/' || path, 'extra' FROM steps WHERE doc_id % 19 = 2",
    "hot_paths": "SELECT user_id::VARCHAR AS path, hot_rank::INT AS hot_rank FROM (SELECT user_id, row_number() OVER (ORDER BY max(ts) DESC, user_id::VARCHAR) AS hot_rank FROM events GROUP BY 1 HAVING epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(max(ts)) <= 86400::BIGINT * 30 * 1000000) WHERE hot_rank <= 25",
    "batch_plan": f"""WITH {B.DOCS}, live AS (SELECT * FROM docs WHERE content_hash IS NOT NULL), moved AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 10 = 5 THEN sha256(content_hash || 'x') ELSE content_hash END AS content_hash FROM live WHERE doc_id % 10 <> 7),
      s AS (SELECT path, m.content_hash AS now, l.content_hash AS was FROM (SELECT path FROM live UNION SELECT path FROM moved) LEFT JOIN moved m USING (path) LEFT JOIN live l USING (path)),
      g AS (SELECT path, was AS h, row_number() OVER (PARTITION BY was ORDER BY path) AS n FROM s WHERE now IS NULL), c AS (SELECT path, now AS h, row_number() OVER (PARTITION BY now ORDER BY path) AS n FROM s WHERE was IS NULL), r AS (SELECT c.path, g.path AS from_path FROM g JOIN c USING (h, n))
      SELECT path, CASE WHEN from_path IS NOT NULL THEN 'rename' WHEN now IS NULL THEN 'tombstone' WHEN now = was THEN 'unchanged' ELSE 'index' END AS action, from_path FROM s LEFT JOIN r USING (path) WHERE path NOT IN (SELECT from_path FROM r)""",
    "section_pairs": f"WITH {B.SECTIONS}, {B.EDITED}, a0 AS (SELECT doc_id AS path, idx AS i, substr(text, 1, 5) AS h, sha256(text) AS t FROM sections), b0 AS (SELECT doc_id AS path, idx AS i, substr(text, 1, 5) AS h, sha256(text) AS t FROM changed), {_pair_sql()} SELECT stage, count(*) AS n, sum(o)::BIGINT AS old_sum, sum(n)::BIGINT AS new_sum FROM every GROUP BY 1",
    "heading_keys": "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower('`Set` {% if x %}  ' || split_part(text, chr(10), 1) || CASE WHEN doc_id % 2 = 0 THEN '  {% open' ELSE ' END' END), '`', ''), '\\{%.*?%\\}', '', 'g'), '\\{%.*$', ''), '\\s+', ' ', 'g')) AS key FROM documents WHERE text IS NOT NULL",
}
