"""The registered queries of this package, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, bpe, html_content, jaccard, mixing, pii, toxicity, url_rules, vectors, warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Target weights of the mix; names that are absent weigh 1.
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "news": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
#: The mix takes this part of all tokens, with up to two epochs of a leaf.
MIX = {"weights": WEIGHTS, "fill": (4, 5), "epochs": 2, "seed": 7}
DOMAINS = ("web", "books", "code", "news")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of_source() -> Column:
    """A source's domain: by the number that its name ends in."""
    number = F.regexp_extract("source", r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.element_at(F.array(*map(F.lit, DOMAINS)), (F.try_to_number(number, F.lit("999999999")) % 4 + 1).cast("int")))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain_of_source(), **MIX).drop("th")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.sound(warc.archive(table(spark, sf_dir, "pages")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_copies(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The path of the public byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_texts(table(spark, sf_dir, "documents")).drop("th", "component")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_html_extraction": op2_html_extraction,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _share_sql(level: str, parent: list[str], nodes: str) -> str:
    """SQL for the budgets of one level; ``nodes`` is a relation of the parent's columns, the name, cap, w and given."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, level])
    return f"""
      SELECT {keys}, budget + CASE WHEN NOT isfull AND row_number() OVER ({by} ORDER BY isfull::INT, {level}) <= given - sum(budget) OVER ({by}) THEN 1 ELSE 0 END AS given
      FROM (SELECT *, CASE WHEN isfull THEN cap ELSE ((given - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({by})) * w) // greatest(1, sum(CASE WHEN isfull THEN 0 ELSE w END) OVER ({by})) END AS budget
      FROM (SELECT *, (given - coalesce(sum(cap) OVER ({by} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
                 >= cap * sum(w) OVER ({by} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS isfull FROM ({nodes})))"""


def _mix_sql() -> str:
    a, b = MIX["fill"]
    w = MIX["weights"]
    return f"""
    WITH rows AS (SELECT doc_id,
        coalesce(CASE WHEN regexp_matches(source, '[0-9]{{1,9}}$') THEN ['{"', '".join(DOMAINS)}'][1 + regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4] END, 'unknown') AS domain,
        coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
    d AS ({_share_sql("domain", [], f"SELECT domain, sum(tokens)::BIGINT * {MIX['epochs']} AS cap, {_case('domain', w['domain'])} AS w, least((SELECT sum(tokens) FROM leaves) * {a} // {b}, (SELECT sum(tokens) FROM leaves) * {MIX['epochs']}) AS given FROM leaves GROUP BY domain")}),
    l AS ({_share_sql("lang", ["domain"], f"SELECT domain, lang, sum(tokens)::BIGINT * {MIX['epochs']} AS cap, {_case('lang', w['lang'])} AS w, any_value(given) AS given FROM leaves JOIN d USING (domain) GROUP BY domain, lang")}),
    s AS ({_share_sql("source", ["domain", "lang"], f"SELECT domain, lang, source, tokens * {MIX['epochs']} AS cap, 1 AS w, given FROM leaves JOIN l USING (domain, lang)")}),
    placed AS (SELECT r.*, s.given::BIGINT AS budget, v.tokens AS total, CASE WHEN v.tokens = 0 THEN 0 ELSE (s.given // v.tokens)::BIGINT END AS rounds
      FROM rows r JOIN s USING (domain, lang, source) JOIN leaves v USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, tokens, budget,
      (rounds + CASE WHEN coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX['seed']}:' || rounds || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < budget - rounds * total THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM placed"""


ORACLES = {
    "op1_url_filters": f"""
    WITH cut AS (SELECT page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)})
    SELECT page_id, host, path,
      (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
      coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
    FROM cut""",
    "op4_mixing": _mix_sql(),
    "op5_warc": f"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to FROM p""",
    "op6_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
