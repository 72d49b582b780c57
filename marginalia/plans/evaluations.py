"""Registered evaluation, statistics, impact and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text, times
from ..operators import bootstrap as S
from ..operators import cards as C
from ..operators import evaluation as V
from ..operators import impact as I
from ..operators import retrieval as R
from ..operators.sections import line_sections
from . import base as B
from . import search as Q

SEED = 20260922


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "a").otherwise("b").alias("project"), F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")).alias("category"))


def seeded_order(spark, d):  # noqa: ANN001, ANN201
    return V.seeded_order(_questions(spark, d), SEED, "query_id").select("query_id", "position")


def split_assign(spark, d):  # noqa: ANN001, ANN201
    return V.split(_questions(spark, d), SEED, "query_id", "project").select("query_id", "project", "split")


def round_robin_sample(spark, d):  # noqa: ANN001, ANN201
    return V.round_robin(_questions(spark, d), SEED, "query_id", "category", 12).select("query_id", "category")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents retrieved for each question, as pages by first occurrence."""
    scored = Q._search(spark, d, B.queries_of_benchmark(spark, d), 40, need="best")
    return V.first_pages(scored.select("query_id", F.substring_index("section_id", "#", 1).alias("page"), "rank"))


def success_mrr_ndcg(spark, d):  # noqa: ANN001, ANN201
    return V.summary(V.question_metrics(_questions(spark, d), B.qrels(spark, d), _pages(spark, d)))


def coverage_report(spark, d):  # noqa: ANN001, ANN201
    indexed = B.table(spark, d, "documents").where("doc_id % 4 != 3").select(F.col("doc_id").cast("string").alias("page"))
    return V.coverage(_questions(spark, d), B.qrels(spark, d), indexed)


def pooled_labels(spark, d):  # noqa: ANN001, ANN201
    q = B.qrels(spark, d)
    extra = B.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7 % 50).cast("string").alias("page"))
    return V.pooled(q, extra, _questions(spark, d).where("query_id % 5 != 4"))


def doc_cap_topk(spark, d):  # noqa: ANN001, ANN201
    """At most two sections of a document, then at most eight of a question."""
    best = Q._search(spark, d, R.query_frame(spark, Q.ONE), 8, need="any", per_doc=2)
    return best.select("query_id", "section_id", F.col("rank").cast("long").alias("rank"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Graded runs: labels stand for questions, arms and scores follow from the id."""
    y = B.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    rows = y.select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(r).alias("run")) for a in ("base", "new") for r in (1, 2, 3)])).alias("x"), "quality", "toxic").select("id", "x.arm", "x.run", "quality", "toxic")
    h = (F.col("id") * 7 + F.col("run") * 3 + F.when(F.col("arm") == "new", 5).otherwise(0)) % 11
    return rows.where(h != 4).select("id", "arm", "run", (h == 7).alias("error"), ((h % 6) + F.col("quality")).cast("double").alias("score"), (h * 100 + F.col("id") % 13).cast("double").alias("tokens"))


_RUNS = """runs AS (SELECT id, arm, run, h = 7 AS error, (h % 6 + quality)::DOUBLE AS score, (h * 100 + id % 13)::DOUBLE AS tokens FROM (SELECT doc_id AS id, quality, arm, run, (doc_id * 7 + run * 3 + CASE WHEN arm = 'new' THEN 5 ELSE 0 END) % 11 AS h FROM labels, (VALUES ('base'), ('new')) a(arm), (VALUES (1), (2), (3)) r(run)) WHERE h <> 4),
medians AS (SELECT id, arm, median(coalesce(s, 0)) AS score, median(s) AS completed_score, count(*) FILTER (NOT ok) AS failed, median(t) AS tokens FROM (SELECT g.id, g.arm, g.run, r.score IS NOT NULL AND NOT coalesce(error, true) AS ok, CASE WHEN ok THEN r.score END AS s, CASE WHEN ok THEN r.tokens END AS t
  FROM (SELECT doc_id AS id, arm, run FROM labels, (VALUES ('base'), ('new')) a(arm), (VALUES (1), (2), (3)) x(run)) g LEFT JOIN runs r USING (id, arm, run)) GROUP BY ALL)"""


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    arms = spark.createDataFrame([("base",), ("new",)], "arm string")
    return V.grid(B.table(spark, d, "labels").select(F.col("doc_id").alias("id")), arms, 3)


def missing_arm_rows(spark, d):  # noqa: ANN001, ANN201
    return V.completeness(_wanted(spark, d).where("id % 10 != 9"), _runs(spark, d))


def arm_medians(spark, d):  # noqa: ANN001, ANN201
    return V.arm_medians(_wanted(spark, d), _runs(spark, d))


def arm_summary(spark, d):  # noqa: ANN001, ANN201
    return V.arm_summary(V.arm_medians(_wanted(spark, d), _runs(spark, d)))


def token_savings(spark, d):  # noqa: ANN001, ANN201
    return V.savings(V.arm_medians(_wanted(spark, d), _runs(spark, d)), "base", "new")


def paired_winloss(spark, d):  # noqa: ANN001, ANN201
    hit = lambda arm, run: _runs(spark, d).where((F.col("arm") == arm) & (F.col("run") == run)).select("id", (F.col("score") >= 3).cast("int").alias("hit"))
    return V.wins_losses(hit("base", 1), hit("new", 1))


def bootstrap_ci(spark, d):  # noqa: ANN001, ANN201
    """An interval for the share of good labels among all, 2000 draws."""
    y = B.table(spark, d, "labels").select("doc_id", "quality")
    return S.interval(S.table_means(y, ["doc_id", "quality"], "quality", S.stream_start(SEED, "quality"), 2000)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def nearest_rank(spark, d):  # noqa: ANN001, ANN201
    return B.table(spark, d, "events").groupBy("event_type").agg(stats.nearest_rank("value", 0.025).alias("low"), stats.nearest_rank("value", 0.975).alias("high"))


def quantiles_t4(spark, d):  # noqa: ANN001, ANN201
    return B.table(spark, d, "events").groupBy("user_id").agg(stats.quantile_rounded("value", 0.5).alias("p50"), stats.quantile_rounded("value", 0.9).alias("p90"))


def quantiles_latency(spark, d):  # noqa: ANN001, ANN201
    return B.table(spark, d, "events").groupBy("user_id").agg(stats.quantile_floored("value", 0.5).alias("p50"), stats.quantile_floored("value", 0.9).alias("p90"))


def agreement(spark, d):  # noqa: ANN001, ANN201
    return V.agreement(_runs(spark, d).where("arm = 'base'").select(F.col("id").alias("item"), F.concat(F.lit("j"), "run").alias("judge"), "score"))


def set_f1(spark, d):  # noqa: ANN001, ANN201
    """Of every text: the tokens at odd places as what is wanted, those at even places as what was got."""
    t = text.tokens(F.coalesce("text", F.lit("")))
    half = lambda odd: F.array_distinct(F.filter(t, lambda _, i: i % 2 == (0 if odd else 1)))
    rows = B.table(spark, d, "documents").select("doc_id", half(True).alias("want"), half(False).alias("got"))
    return rows.select("doc_id", F.round(V.set_f1(rows), 6).alias("f1"))


def alert_quality(spark, d):  # noqa: ANN001, ANN201
    y = B.table(spark, d, "labels")
    return V.alert_quality(y.where("toxic = 1").select("doc_id"), y.where("quality = 0").select("doc_id"), ["doc_id"])


def interval_selfjoin(spark, d):  # noqa: ANN001, ANN201
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.col("o_orderpriority").alias("file"), F.col("o_orderdate").alias("at"))
    return I.followed_by(o, "14 days", ["who"])


def signature_groups(spark, d):  # noqa: ANN001, ANN201
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("removed"), F.collect_set("l_linestatus").alias("added"))
    return I.signature_groups(rows, None).select("n", "first_id")


def term_df(spark, d):  # noqa: ANN001, ANN201
    return I.term_frequencies(B.sections(spark, d))


def strength_weight(spark, d):  # noqa: ANN001, ANN201
    rows = B.sections(spark, d)
    df = I.with_total(I.term_frequencies(rows), rows)
    return df.select("term", I.strength(F.col("df"), F.col("n_sections"), ~F.col("term").rlike("[0-9]"), F.length("term") % 2 == 0).alias("weight"))


def changed_terms(spark, d):  # noqa: ANN001, ANN201
    rows = B.sections(spark, d)
    pairs = rows.select(F.concat("doc_id", F.lit("-"), "idx").alias("change"), "text")
    after = rows.where("idx >= 1").select(F.concat("doc_id", F.lit("-"), F.col("idx") - 1).alias("change"), "text")
    return I.changed_terms(pairs, after)


def impact_candidates(spark, d):  # noqa: ANN001, ANN201
    rows, made_of = line_sections(B.table(spark, d, "documents")), [f"{d}/documents.parquet"]
    held = B.store.saved(spark, "held-terms", made_of, lambda: I.held_terms(rows))

    def changes():  # noqa: ANN202
        terms = held.select(F.explode(F.split("held", " ")).alias("term")).where("term != ''")
        df = I.with_total(terms.groupBy("term").agg(F.count("*").alias("df")), held)
        first = rows.where("idx = 0").select(F.col("doc_id").alias("change"), "text", "section_id")
        after = rows.where("idx = 1").select(F.col("doc_id").alias("change"), "text", "section_hash")
        chosen = I.leading_terms(I.changed_terms(first, after), df, F.col("n_sections"))
        return I.asked_terms(chosen, F.col("n_sections"), own=first, after=after)

    return I.candidates(B.store.saved(spark, "changes", made_of, changes), held).select("change", "section_id", "strength", "place")


def doc_neighbours(spark, d):  # noqa: ANN001, ANN201
    """Links of pages to pages whose address ends alike."""
    pages = B.table(spark, d, "pages").where("url IS NOT NULL").select(F.regexp_extract("url", r"/([^/?#.]+)[^/]*$", 1).alias("path"), "html", "page_id")
    known = pages.groupBy("path").agg(F.min("page_id").alias("page_id"))
    links = known.join(pages.select("page_id", "html"), "page_id").select(F.col("path").alias("from_path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return I.neighbours(I.resolve_links(links.distinct().unionByName(known.select(F.col("path").alias("from_path"), F.concat(F.lit("/"), F.substring("path", 1, 1), F.lit("0")).alias("target"))), known))


def section_times(spark, d):  # noqa: ANN001, ANN201
    li = B.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("at"))
    spans = B.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.explode(F.array(F.struct(F.lit(1).alias("line_start"), F.lit(2).alias("line_end")), F.struct(F.lit(3).alias("line_start"), F.lit(7).alias("line_end")))).alias("s")).select("path", F.concat("path", F.lit("#"), F.col("s.line_start")).alias("section_id"), "s.line_start", "s.line_end")
    return I.section_times(li, spans)


def grounded_entities(spark, d):  # noqa: ANN001, ANN201
    docs = B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.array(F.lit("The"), F.substring("text", 5, 12), F.lit("No Such Name"), F.col("lang")).alias("values"))
    return docs.select("doc_id", F.array_join(C.grounded(F.col("values"), F.col("text")), "|").alias("kept"))


def normalize_text(spark, d):  # noqa: ANN001, ANN201
    return B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.normalize_typography(F.concat(F.lit(" “A”… "), "text", F.lit(" – ")))).alias("digest"))


def token_estimate(spark, d):  # noqa: ANN001, ANN201
    return B.table(spark, d, "documents").select("doc_id", text.token_estimate(F.coalesce("text", F.lit(""))).alias("estimate"))


def heading_only(spark, d):  # noqa: ANN001, ANN201
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), F.element_at(F.split("text", "\n"), 1), F.lit("\n  \n"))).otherwise(F.concat(F.lit("# "), "text", F.lit("\nmore")))
    return B.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.is_heading_only(made).alias("only"))


def url_redaction(spark, d):  # noqa: ANN001, ANN201
    url = F.concat(F.lit("see "), F.replace(F.col("url"), F.lit("://"), F.lit("://user:secret@")), F.lit(" and /home/me/file.txt"))
    return B.table(spark, d, "pages").select("page_id", text.redact_absolute_paths(text.strip_url_credentials(url)).alias("shown"))


def host_only(spark, d):  # noqa: ANN001, ANN201
    return B.table(spark, d, "pages").select("page_id", text.host_only(F.col("url")).alias("host"))


def humanize_age(spark, d):  # noqa: ANN001, ANN201
    return B.table(spark, d, "events").select("event_id", times.humanize_age(F.unix_seconds(B.now()) - F.unix_seconds(F.col("ts").cast("timestamp"))).alias("age"))


def embed_texts(spark, d):  # noqa: ANN001, ANN201
    card = C.synthetic(F.col("text"))
    return B.sections(spark, d).select("section_id", F.md5(C.embed_text(F.concat_ws(" / ", "source", "lang"), card, "summary")).alias("digest"))


QUERIES = {f.__name__: f for f in (seeded_order, split_assign, round_robin_sample, success_mrr_ndcg, coverage_report, pooled_labels, doc_cap_topk, missing_arm_rows, arm_medians, arm_summary, token_savings, paired_winloss, bootstrap_ci, nearest_rank, quantiles_t4, quantiles_latency, agreement, set_f1, alert_quality, interval_selfjoin, signature_groups, term_df, strength_weight, changed_terms, impact_candidates, doc_neighbours, section_times, grounded_entities, normalize_text, token_estimate, heading_only, url_redaction, host_only, humanize_age, embed_texts)}

_QS = "qs AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 'b' END AS project, 'c' || item_id % 4 AS category FROM benchmark)"
_KEY = f"sha256('{SEED}:' || query_id)"
_ASKED = f"asked AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:{B.QUESTION_WORDS}], ' ') AS query FROM benchmark)"
_BENCH = f"WITH {B.SECTIONS}, {Q._RAW_SQL}, {_ASKED}, {Q._PHRASES}, {Q._bm25_sql('raw', Q.RAW_WEIGHTS, 's')}, chosen AS (SELECT *, max((matched = n_phrases)::INT) OVER (PARTITION BY query_id) = 0 AS partial FROM s)"
_DF = f"{B.SECTIONS}, df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT section_id, unnest({B.TOKENS.format('text')}) AS term FROM sections) GROUP BY 1)"

#: Typographic quotes and dashes made plain.
_PLAIN = "translate({}, '‘’‚“”„–—−', '''''''\"\"\"---')"


def _strength(df: str, n: str, word: str, replaced: str) -> str:
    whole = f"floor(round(ln(({n} + 1) / {df}) * 1000, 6))"
    part = f"CASE WHEN {word} THEN floor({whole} / 3) ELSE {whole} END"
    return f"(CASE WHEN {replaced} THEN {part} ELSE floor(({part}) / 4) END)::BIGINT"


def _terms(before: str, after: str) -> str:
    one = lambda rel, name: f"{name} AS (SELECT DISTINCT change, unnest({B.TOKENS.format('text')}) AS term FROM ({rel}))"
    return f"{one(before, 'tb')}, {one(after, 'ta')}, terms AS (SELECT coalesce(tb.change, ta.change) AS change, coalesce(tb.term, ta.term) AS term, CASE WHEN ta.term IS NULL THEN 'replaced' WHEN tb.term IS NULL THEN 'added' ELSE 'kept' END AS role FROM tb FULL JOIN ta ON tb.change = ta.change AND tb.term = ta.term)"


def _splitmix_sql(n_draws: int) -> str:
    """The same generator in 128-bit integers modulo 2^64."""
    m = "18446744073709551616::UHUGEINT"
    shift = lambda x, k: f"xor({x}, {x} >> {k})"
    start = S.stream_start(SEED, "quality")
    return f"""WITH y AS (SELECT quality, row_number() OVER (ORDER BY doc_id, quality) - 1 AS i, count(*) OVER () AS n FROM labels),
      c AS (SELECT i, n, (({start}::UHUGEINT + {S.GAMMA}::UHUGEINT * (i + 1)::UHUGEINT % {m}) % {m}) AS z FROM (SELECT unnest(range({n_draws} * (SELECT max(n) FROM y))) AS i, (SELECT max(n) FROM y) AS n)),
      a AS (SELECT i, n, {shift("z", 30)} AS z FROM c),
      b AS (SELECT i, n, (((z >> 32) * {S.MIX_1 & 0xFFFFFFFF}::UHUGEINT % {m} + (z & 4294967295::UHUGEINT) * {S.MIX_1 >> 32}::UHUGEINT % {m}) % 4294967296::UHUGEINT * 4294967296::UHUGEINT + (z & 4294967295::UHUGEINT) * {S.MIX_1 & 0xFFFFFFFF}::UHUGEINT) % {m} AS z FROM a),
      e AS (SELECT i, n, {shift("z", 27)} AS z FROM b),
      f AS (SELECT i, n, (((z >> 32) * {S.MIX_2 & 0xFFFFFFFF}::UHUGEINT % {m} + (z & 4294967295::UHUGEINT) * {S.MIX_2 >> 32}::UHUGEINT % {m}) % 4294967296::UHUGEINT * 4294967296::UHUGEINT + (z & 4294967295::UHUGEINT) * {S.MIX_2 & 0xFFFFFFFF}::UHUGEINT) % {m} AS z FROM e),
      g AS (SELECT i // n AS draw, ({shift("z", 31)} % n::UHUGEINT)::BIGINT AS at FROM f),
      m AS (SELECT draw, round(avg(quality::DOUBLE), 9) AS mean FROM g JOIN y ON y.i = g.at GROUP BY 1)
      SELECT round(quantile_disc(mean, 0.025), 6) AS low, round(quantile_disc(mean, 0.975), 6) AS high FROM m"""


ORACLES = {
    "seeded_order": f"WITH {_QS} SELECT query_id, row_number() OVER (ORDER BY {_KEY}, query_id) - 1 AS position FROM qs",
    "split_assign": f"WITH {_QS} SELECT query_id, project, CASE WHEN p < n * 30 // 100 THEN 'dev' WHEN p < n * 85 // 100 THEN 'test' ELSE 'holdout' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_KEY}, query_id) - 1 AS p, count(*) OVER (PARTITION BY project) AS n FROM qs)",
    "round_robin_sample": f"WITH {_QS}, p AS (SELECT *, row_number() OVER (ORDER BY {_KEY}, query_id) AS pos FROM qs) SELECT query_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY category) AS shown FROM p) ORDER BY turn, shown LIMIT 12",
    "success_mrr_ndcg": f"""{_BENCH}, {B.QRELS}, hits AS (SELECT query_id, split_part(section_id, '#', 1) AS page, rank FROM ({Q._top_sql("chosen", "partial OR matched = n_phrases", 40)})),
      pages AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY r, page) AS pr FROM (SELECT query_id, page, min(rank) AS r FROM hits GROUP BY ALL)),
      got AS (SELECT query_id, min(CASE WHEN pr <= 5 THEN pr END) AS rank, sum(CASE WHEN pr <= 10 THEN 1 / log2(pr + 1) ELSE 0 END) AS dcg FROM pages JOIN qrels USING (query_id, page) GROUP BY 1),
      n AS (SELECT query_id, list_aggregate(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1)), 'sum') AS ideal FROM qrels GROUP BY 1)
      SELECT count(*) AS n, round(avg((rank IS NOT NULL)::INT), 6) AS success, round(avg(coalesce(1.0 / rank, 0)::DOUBLE), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg FROM n LEFT JOIN got USING (query_id)""",
    "coverage_report": f"""WITH {B.QRELS}, p AS (SELECT item_id, l, t FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS l, count(*) FILTER (page::BIGINT % 4 <> 3) AS t FROM qrels GROUP BY 1) ON query_id = item_id)
      SELECT count(*) AS questions, count(l) AS labelled, coalesce(sum(l), 0)::BIGINT AS labels, coalesce(sum(t), 0)::BIGINT AS labels_indexed, count(*) FILTER (l = t) AS eligible, count(*) FILTER (t < l AND t > 0) AS partly, count(*) FILTER (t = 0) AS uncovered FROM p""",
    "pooled_labels": f"WITH {B.QRELS} SELECT query_id, page FROM qrels UNION SELECT item_id, (item_id * 7 % 50)::VARCHAR FROM benchmark WHERE item_id % 5 <> 4",
    "doc_cap_topk": f"""WITH {B.SECTIONS}, {Q._RAW_SQL}, {Q._query_values(Q.ONE)}, {Q._PHRASES}, {Q._bm25_sql("raw", Q.RAW_WEIGHTS, "s")}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, split_part(section_id, '#', 1) ORDER BY score DESC, section_id) AS own FROM s)
      SELECT query_id, section_id, rank FROM ({Q._top_sql("o", "own <= 2", 8)})""",
    "missing_arm_rows": f"""WITH {_RUNS}, c AS (SELECT id, arm, run, count(*) AS c FROM runs GROUP BY ALL), g AS (SELECT doc_id AS id, arm, run FROM labels, (VALUES ('base'), ('new')) a(arm), (VALUES (1), (2), (3)) x(run) WHERE doc_id % 10 <> 9)
      SELECT coalesce(g.id, c.id) AS id, coalesce(g.arm, c.arm) AS arm, coalesce(g.run, c.run) AS run, CASE WHEN c IS NULL THEN 'missing' WHEN g.id IS NULL THEN 'extra' ELSE 'duplicate' END AS problem FROM g FULL JOIN c ON g.id = c.id AND g.arm = c.arm AND g.run = c.run WHERE c IS NULL OR g.id IS NULL OR c > 1""",
    "arm_medians": f"WITH {_RUNS} SELECT * FROM medians",
    "arm_summary": f"WITH {_RUNS} SELECT arm, count(*) AS questions, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, sum(failed)::BIGINT AS failed, round(median(tokens), 3) AS tokens FROM medians GROUP BY 1",
    "token_savings": f"WITH {_RUNS}, b AS (SELECT x.tokens AS ta, y.tokens AS tb, x.tokens IS NOT NULL AND y.tokens IS NOT NULL AND coalesce(x.tokens > 0, false) AS ok FROM (SELECT * FROM medians WHERE arm = 'base') x FULL JOIN (SELECT * FROM medians WHERE arm = 'new') y USING (id)) SELECT round(median(CASE WHEN ok THEN tb / ta END), 6) AS ratio, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS excluded FROM b",
    "paired_winloss": f"WITH {_RUNS}, b AS (SELECT x.h AS b, y.h AS n FROM (SELECT id, (score >= 3)::INT AS h FROM runs WHERE arm = 'base' AND run = 1) x FULL JOIN (SELECT id, (score >= 3)::INT AS h FROM runs WHERE arm = 'new' AND run = 1) y USING (id)) SELECT count(*) FILTER (n = 1 AND b = 0) AS wins, count(*) FILTER (n = 0 AND b = 1) AS losses, count(*) FILTER (n = b) AS ties, count(*) FILTER (n IS NULL OR b IS NULL) AS one_sided, round(avg(n - b), 6) AS delta FROM b",
    "bootstrap_ci": _splitmix_sql(2000),
    "nearest_rank": "SELECT event_type, quantile_disc(value, 0.025) AS low, quantile_disc(value, 0.975) AS high FROM events GROUP BY 1",
    "quantiles_t4": "SELECT user_id, list_sort(list(value))[(floor((count(*) - 1) * 0.5 + 0.5))::INT + 1] AS p50, list_sort(list(value))[(floor((count(*) - 1) * 0.9 + 0.5))::INT + 1] AS p90 FROM events GROUP BY 1",
    "quantiles_latency": "SELECT user_id, list_sort(list(value))[(floor((count(*) - 1) * 0.5))::INT + 1] AS p50, list_sort(list(value))[(floor((count(*) - 1) * 0.9))::INT + 1] AS p90 FROM events GROUP BY 1",
    "agreement": f"WITH {_RUNS}, s AS (SELECT id, 'j' || run AS j, score FROM runs WHERE arm = 'base') SELECT a.j AS judge_a, b.j AS judge_b, count(*) AS n, round(avg((a.score = b.score)::INT), 6) AS exact, round(avg((abs(a.score - b.score) <= 1)::INT), 6) AS within_one FROM s a JOIN s b ON a.id = b.id AND a.j < b.j GROUP BY ALL",
    "set_f1": f"WITH t AS (SELECT doc_id, list_distinct({B.TOKENS.format('text')}[1:-:2]) AS want, list_distinct({B.TOKENS.format('text')}[2:-:2]) AS got FROM documents) SELECT doc_id, round(CASE WHEN len(want) + len(got) = 0 THEN 1 ELSE 2.0::DOUBLE * len(list_intersect(want, got)) / (len(want) + len(got)) END, 6) AS f1 FROM t",
    "alert_quality": "WITH b AS (SELECT toxic = 1 AS f, quality = 0 AS y FROM (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1)) SELECT count(*) FILTER (f) AS findings, count(*) FILTER (y) AS labels, count(*) FILTER (f AND y) AS met, round(count(*) FILTER (f AND y) / nullif(count(*) FILTER (f), 0), 6) AS precision, round(count(*) FILTER (f AND y) / nullif(count(*) FILTER (y), 0), 6) AS recall FROM b",
    "interval_selfjoin": "SELECT a.o_custkey AS who, a.o_orderkey AS id_a, b.o_orderkey AS id_b, ((epoch(b.o_orderdate) - epoch(a.o_orderdate)) // 86400)::BIGINT AS days_later FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND epoch(b.o_orderdate) - epoch(a.o_orderdate) <= 14 * 86400 AND a.o_orderpriority <> b.o_orderpriority",
    "signature_groups": "SELECT count(*) AS n, min(id) AS first_id FROM (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_returnflag)) AS r, list_sort(list(DISTINCT l_linestatus)) AS a FROM lineitem GROUP BY 1) GROUP BY r, a HAVING count(*) > 1",
    "term_df": f"WITH {_DF} SELECT term, df FROM df",
    "strength_weight": f"WITH {_DF} SELECT term, {_strength('df', '(SELECT count(*) FROM sections)', '''NOT regexp_matches(term, '[0-9]')''', 'length(term) % 2 = 0')} AS weight FROM df",
    "changed_terms": f"WITH {B.SECTIONS}, {_terms('SELECT doc_id || chr(45) || idx AS change, text FROM sections', 'SELECT doc_id || chr(45) || (idx - 1) AS change, text FROM sections WHERE idx >= 1')} SELECT * FROM terms",
    "impact_candidates": f"""WITH {_DF}, {_terms("SELECT doc_id AS change, text FROM sections WHERE idx = 0", "SELECT doc_id AS change, text FROM sections WHERE idx = 1")},
      chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY CASE role WHEN 'replaced' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, df, term) AS p FROM terms JOIN df USING (term) WHERE df <= greatest(10, floor((SELECT count(*) FROM sections) * 0.2))) WHERE p <= 12),
      held AS (SELECT DISTINCT section_id, doc_id, idx, section_hash, unnest({B.TOKENS.format("text")}) AS term FROM sections),
      scored AS (SELECT change, section_id, doc_id, sum({_strength("df", "(SELECT count(*) FROM sections)", "NOT regexp_matches(term, '[0-9]')", "role = 'replaced'")})::BIGINT AS strength FROM held JOIN chosen USING (term) WHERE NOT (doc_id = change AND idx = 0) AND NOT EXISTS (SELECT 1 FROM sections o WHERE o.doc_id = change AND o.idx = 1 AND o.section_hash = held.section_hash) GROUP BY ALL),
      own AS (SELECT *, row_number() OVER (PARTITION BY change, doc_id ORDER BY strength DESC, section_id) AS own FROM scored)
      SELECT change, section_id, strength, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY strength DESC, section_id) AS place FROM own WHERE own <= 2) WHERE place <= 8""",
    "doc_neighbours": """WITH p AS (SELECT page_id, html, regexp_extract(url, '/([^/?#.]+)[^/]*$', 1) AS path FROM pages WHERE url IS NOT NULL), k AS (SELECT path, min(page_id) AS page_id FROM p GROUP BY 1),
      l AS (SELECT DISTINCT k.path AS f, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM k JOIN p USING (page_id) UNION SELECT path, '/' || substr(path, 1, 1) || '0' FROM k),
      o AS (SELECT f, t, regexp_replace(substr(t, 2), '[?#].*$', '') AS b FROM l WHERE t[1] = '/' AND t[2] <> '/'), n(pr, e) AS (VALUES (1, '.md'), (2, '.mdx'), (3, '/index.md'), (4, '/README.md'), (5, '/index.mdx')),
      c AS (SELECT f, t, 0 AS pr, b AS path FROM o UNION ALL SELECT f, t, pr, b || e FROM o, n WHERE b <> '' AND NOT contains(b, '.')),
      e AS (SELECT f, arg_min(path, pr) AS t2 FROM c WHERE path IN (SELECT path FROM k) GROUP BY f, t) SELECT f AS a, t2 AS b FROM e WHERE f <> t2 UNION SELECT t2, f FROM e WHERE f <> t2""",
    "section_times": "SELECT l_orderkey::VARCHAR || CASE WHEN l_linenumber <= 2 THEN '#1' ELSE '#3' END AS section_id, max(l_shipdate) AS at FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1",
    "grounded_entities": f"""WITH n AS (SELECT doc_id, lang, text, lower(trim(regexp_replace({_PLAIN.format('text')}, '\\s+', ' ', 'g'))) AS body FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, array_to_string(list_filter(['The', substr(text, 5, 12), 'No Such Name', lang], lambda v: trim(v, ' ') <> '' AND contains(body, lower(trim(regexp_replace({_PLAIN.format('v')}, '\\s+', ' ', 'g'))))), '|') AS kept FROM n""",
    "normalize_text": f"""SELECT doc_id, md5(trim(regexp_replace(replace({_PLAIN.format("' “A”… ' || text || ' – '")}, '…', '...'), '\\s+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL""",
    "token_estimate": "SELECT doc_id, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS estimate FROM documents",
    "heading_only": "SELECT doc_id, doc_id % 3 = 0 AS only FROM documents WHERE text IS NOT NULL",
    "url_redaction": "SELECT page_id, 'see ' || url || ' and <path>' AS shown FROM pages",
    "host_only": "SELECT page_id, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS host FROM pages",
    "humanize_age": f"SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' WHEN s < 1209600 THEN s // 86400 || 'd' ELSE s // 604800 || 'w' END AS age FROM (SELECT event_id, greatest(floor(epoch({B.NOW_SQL}))::BIGINT - floor(epoch(ts))::BIGINT, 0) AS s FROM events)",
    "embed_texts": f"WITH {B.SECTIONS} SELECT section_id, md5({Q._HEAD} || chr(10) || text || chr(10) || text) AS digest FROM sections",
}
