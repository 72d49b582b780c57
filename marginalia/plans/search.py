"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.sections import line_sections
from . import base as B

RAW_WEIGHTS = {"heading": 3.0, "text": 1.0}
CARD_WEIGHTS = {"heading": 3.0, "tldr": 3.0, "keywords": 1.0}
K = 10
#: Queries by kind of term; the words are common in the tables.
PHRASE = {"1": "of.the", "2": "the-of the", "3": "in.the.of"}
PREFIX = {"1": "thing* of", "2": "ered*", "3": "zzz* the"}
ONE = {"1": "the thing", "2": "of", "3": "--- the", "4": "der die", "5": "nosuchword the"}


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sections and their index. The sections are made from the documents as they are read: a question needs few of them."""
    rows = line_sections(B.table(spark, d, "documents")).withColumn("heading", F.concat_ws(" / ", "source", "lang"))
    return rows, B.index(spark, d, "raw", rows, ["heading", "text"])


def _search(spark: SparkSession, d: str, asked: DataFrame, k: int = K, **more) -> DataFrame:  # noqa: ANN003
    return R.search(_raw(spark, d)[1], R.phrases(asked), RAW_WEIGHTS, k, **more)


def _ranked(best: DataFrame) -> DataFrame:
    return best.select("query_id", "section_id", F.col("rank").cast("long").alias("rank"), "score")


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("section_id"), "text")
    return B.index(spark, d, "files", docs, ["text"])


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """Builds the three indexes if they aren't there: sections, tokens and distinct tokens of each."""
    made = {"raw": _raw(spark, d)[1], "cards": _card_index(spark, d), "files": _files(spark, d)}
    out = None
    for name, index in made.items():
        one = index.agg(F.count("*").alias("sections"), F.sum("dl").alias("tokens")).crossJoin(R.words(index).agg(F.countDistinct("token").alias("words")))  # one row each
        one = one.select(F.lit(name).alias("name"), "sections", "tokens", "words")
        out = one if out is None else out.unionByName(one)
    return out


def raw_and(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_search(spark, d, R.query_frame(spark, ONE)))


def or_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: questions of the benchmark over all sections, with provenance joined to the winners only."""
    best = _search(spark, d, B.queries_of_benchmark(spark, d), need="best")
    own = _raw(spark, d)[0].select("section_id", "doc_id", "idx", "heading", F.substring("text", 1, 80).alias("snippet"))
    met = own.join(F.broadcast(best), "section_id")  # K rows a question
    return met.select("query_id", "section_id", F.col("rank").cast("long").alias("rank"), "score", "partial", "matched", "doc_id", "idx", "heading", "snippet")


def phrase(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_search(spark, d, R.query_frame(spark, PHRASE)))


def prefix(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_search(spark, d, R.query_frame(spark, PREFIX)))


def _card_index(spark: SparkSession, d: str) -> DataFrame:
    rows = line_sections(B.table(spark, d, "documents"))
    made = B.cards(rows).where("state = 'summarized'").select("section_hash", "tldr", "keywords")
    cards = rows.select("section_id", "section_hash", F.concat_ws(" / ", "source", "lang").alias("heading")).join(made, "section_hash")
    return B.index(spark, d, "cards", cards, list(CARD_WEIGHTS))


def weighted_cards(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(R.search(_card_index(spark, d), R.phrases(R.query_frame(spark, ONE)), CARD_WEIGHTS, K))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as the unit, one column."""
    return _ranked(R.search(_files(spark, d), R.phrases(R.query_frame(spark, ONE)), {"text": 1.0}, K))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return R.vector_hits_in_blocks(v, asked, K).select("query_id", "id", "cosine", F.col("rank").cast("long").alias("rank"))


def _lists(spark: SparkSession, d: str, k: int, filtered: bool = False) -> dict[str, DataFrame]:
    """Three lists to fuse: raw text, cards, and vectors standing for the first sections of documents.

    Filters discard hits after ranking, so lists are deeper where there are any.
    """
    depth = R.depth(k, filtered)
    cards = R.search(_card_index(spark, d), R.phrases(R.query_frame(spark, ONE)), CARD_WEIGHTS, depth)
    raw = _search(spark, d, R.query_frame(spark, ONE), depth)
    v = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = R.vector_hits(v, v.where("id BETWEEN 1 AND 5").select(F.col("id").cast("string").alias("query_id"), "vector"), depth)
    vector = near.select("query_id", F.concat("id", F.lit("#0")).alias("section_id"), "rank")
    return {"cards": cards, "raw": raw, "vector": vector}


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    fused = R.fuse(_lists(spark, d, K), weights={"raw": 0.5})
    return R.top(fused, K, "rrf").select("query_id", "section_id", F.col("rank").cast("long").alias("rank"), "rrf", "matched", "in_vector")


def _with_docs(spark: SparkSession, d: str, fused: DataFrame) -> DataFrame:
    docs = B.documents(B.table(spark, d, "documents"))
    few = fused.withColumn("doc_id", F.substring_index("section_id", "#", 1).cast("long"))  # as many as the lists are deep
    return docs.select("doc_id", "path", "updated_at").join(F.broadcast(few), "doc_id")


def filtered(spark: SparkSession, d: str) -> DataFrame:
    """Time and path filters come after the lists' ranks: filtering must not change what a hit's place was."""
    near = _with_docs(spark, d, R.fuse(_lists(spark, d, K, filtered=True), weights={"raw": 0.5}))
    ok = near.where(R.passes(since="2024-01-10 00:00:00", until=B.NOW, prefix="./src1"))
    return R.top(ok, K, "rrf").select("query_id", "section_id", F.col("rank").cast("long").alias("rank"), "rrf", "path")


def rescored(spark: SparkSession, d: str) -> DataFrame:
    near = _with_docs(spark, d, R.fuse(_lists(spark, d, K), weights={"raw": 0.5}))
    return R.top(R.rescore_recent(near, B.now(), 30.0), K, "rrf").select("query_id", "section_id", F.col("rank").cast("long").alias("rank"), "rrf")


def explained(spark: SparkSession, d: str) -> DataFrame:
    return R.explain(_lists(spark, d, 4))


def hash_fanout(spark: SparkSession, d: str) -> DataFrame:
    """A hit on a hash stands for all sections that share it."""
    rows = B.sections(spark, d)
    hits = rows.groupBy("section_hash").agg(F.min("section_id").alias("hit"))
    return hits.join(rows.select("section_hash", "section_id"), "section_hash").select("hit", "section_id")


def _index_sql(rel: str, cols: dict[str, str], name: str) -> str:
    union = " UNION ALL ".join(f"SELECT section_id, '{c}' AS col, {B.TOKENS.format(e)} AS toks FROM {rel}" for c, e in cols.items())
    return f"""{name}_t AS ({union}), {name}_p AS (SELECT section_id, col, generate_subscripts(toks, 1) AS pos, unnest(toks) AS token FROM {name}_t),
    {name}_l AS (SELECT section_id, sum(len(toks))::BIGINT AS dl FROM {name}_t GROUP BY section_id)"""


def _query_values(texts: dict[str, str]) -> str:
    return "asked(query_id, query) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in texts.items()) + ")"


_PHRASES = f"""terms AS (SELECT query_id, phrase, {B.TOKENS.format("term")} AS toks, ends_with(term, '*') AS star FROM (SELECT query_id, unnest(regexp_split_to_array(query, '\\s+')) AS term, generate_subscripts(regexp_split_to_array(query, '\\s+'), 1) AS phrase FROM asked) WHERE term <> ''),
phr AS (SELECT *, len(toks) AS n_tokens, count(*) OVER (PARTITION BY query_id) AS n_phrases FROM terms WHERE len(toks) > 0),
word AS (SELECT query_id, phrase, n_phrases, n_tokens, unnest(toks) AS token, generate_subscripts(toks, 1) AS off, star FROM phr)"""


def _bm25_sql(index: str, weights: dict[str, float], name: str) -> str:
    w = "CASE col " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in weights.items()) + " ELSE 1.0 END"
    return f"""{name}_occ AS (SELECT query_id, phrase, n_phrases, section_id, col, count(*) AS n FROM (
      SELECT query_id, phrase, n_phrases, n_tokens, section_id, col, pos - off AS start, count(*) AS c FROM word w JOIN {index}_p p ON CASE WHEN star AND off = n_tokens THEN starts_with(p.token, w.token) ELSE p.token = w.token END GROUP BY ALL HAVING c = n_tokens) GROUP BY ALL),
    {name}_f AS (SELECT query_id, phrase, n_phrases, section_id, sum({w} * n)::DOUBLE AS f FROM {name}_occ GROUP BY ALL),
    {name}_df AS (SELECT query_id, phrase, count(*) AS df FROM {name}_f GROUP BY ALL), {name}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {index}_l),
    {name} AS (SELECT query_id, section_id, n_phrases, count(*) AS matched, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
      FROM {name}_f JOIN {name}_df USING (query_id, phrase) JOIN {index}_l USING (section_id), {name}_c GROUP BY ALL)"""


def _top_sql(rel: str, where: str = "matched = n_phrases", k: int = K, by: str = "score") -> str:
    return f"SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY {by} DESC, section_id) - 1)::BIGINT AS rank FROM {rel} WHERE {where}) WHERE rank < {k}"


_HEAD = "(source || ' / ' || lang)"
_RAW_SQL = _index_sql("sections", {"heading": _HEAD, "text": "text"}, "raw")
_CARD_ROWS = f"card_rows AS (SELECT section_id, {_HEAD} AS heading, tldr, keywords FROM sections JOIN cards USING (section_hash) WHERE state = 'summarized')"
_CARD_SQL = _index_sql("card_rows", {"heading": "heading", "tldr": "tldr", "keywords": "keywords"}, "card")
_VECTOR = "list_aggregate(list_transform(list_zip(v.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE), 'sum')"


def _one(texts: dict[str, str]) -> str:
    return f"WITH {B.SECTIONS}, {_RAW_SQL}, {_query_values(texts)}, {_PHRASES}, {_bm25_sql('raw', RAW_WEIGHTS, 's')} SELECT query_id, section_id, rank, score FROM ({_top_sql('s')})"


def _lists_sql(k: int, filtered: bool = False) -> str:
    depth = max(4 * k, 200) if filtered else max(4 * k, 16)
    return f"""WITH {B.SECTIONS}, {B.CARDS}, {_CARD_ROWS}, {_RAW_SQL}, {_CARD_SQL}, {_query_values(ONE)}, {_PHRASES}, {_bm25_sql("raw", RAW_WEIGHTS, "r")}, {_bm25_sql("card", CARD_WEIGHTS, "c")},
    near AS (SELECT q.vec_id::VARCHAR AS query_id, v.vec_id || '#0' AS section_id, v.vec_id AS vid, round({_VECTOR}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id BETWEEN 1 AND 5),
    lists AS (SELECT 'cards' AS list, query_id, section_id, rank FROM ({_top_sql("c", k=depth)}) UNION ALL SELECT 'raw', query_id, section_id, rank FROM ({_top_sql("r", k=depth)})
      UNION ALL SELECT 'vector', query_id, section_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vid) - 1)::BIGINT AS rank FROM near) WHERE rank < {depth}),
    fused AS (SELECT query_id, section_id, round(sum(CASE list WHEN 'raw' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank + 1)), 9) AS rrf, max((list = 'cards')::INT) AS in_cards, max((list = 'raw')::INT) AS in_raw, max((list = 'vector')::INT) AS in_vector FROM lists GROUP BY ALL),
    placed AS (SELECT f.*, d.path, d.updated_at FROM fused f JOIN docs d ON d.doc_id = split_part(section_id, '#', 1)::BIGINT)""".replace("WITH sections", f"WITH {B.DOCS}, sections", 1)


QUERIES = {
    "index_build": index_build, "bm25_raw_and": raw_and, "bm25_or_fallback": or_fallback, "bm25_phrase": phrase, "bm25_prefix": prefix, "bm25_weighted_cards": weighted_cards, "bm25_files": files,
    "vector_topk": vector_topk, "rrf_hybrid": hybrid, "rrf_filtered": filtered, "recency_rescored": rescored, "explain_lists": explained, "hash_fanout": hash_fanout,
}
ORACLES = {
    "index_build": f"""WITH {B.SECTIONS}, {B.CARDS}, {_CARD_ROWS}, {_RAW_SQL}, {_CARD_SQL}, f AS (SELECT doc_id::VARCHAR AS section_id, text FROM documents WHERE text IS NOT NULL), {_index_sql("f", {"text": "text"}, "file")}
      {" UNION ALL ".join(f"SELECT '{name}' AS name, (SELECT count(*) FROM {rel}_l) AS sections, (SELECT sum(dl)::BIGINT FROM {rel}_l) AS tokens, (SELECT count(DISTINCT token) FROM {rel}_p) AS words" for name, rel in (("raw", "raw"), ("cards", "card"), ("files", "file")))}""",
    "bm25_raw_and": _one(ONE), "bm25_phrase": _one(PHRASE), "bm25_prefix": _one(PREFIX),
    "bm25_or_fallback": f"""WITH {B.SECTIONS}, {_RAW_SQL}, asked AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:{B.QUESTION_WORDS}], ' ') AS query FROM benchmark), {_PHRASES}, {_bm25_sql("raw", RAW_WEIGHTS, "s")},
      chosen AS (SELECT *, max((matched = n_phrases)::INT) OVER (PARTITION BY query_id) = 0 AS partial FROM s)
      SELECT query_id, section_id, rank, score, partial, matched, doc_id, idx, {_HEAD} AS heading, substr(text, 1, 80) AS snippet FROM ({_top_sql("chosen", "partial OR matched = n_phrases")}) JOIN sections USING (section_id)""",
    "bm25_weighted_cards": f"WITH {B.SECTIONS}, {B.CARDS}, {_CARD_ROWS}, {_CARD_SQL}, {_query_values(ONE)}, {_PHRASES}, {_bm25_sql('card', CARD_WEIGHTS, 's')} SELECT query_id, section_id, rank, score FROM ({_top_sql('s')})",
    "bm25_files": f"WITH f AS (SELECT doc_id::VARCHAR AS section_id, text FROM documents WHERE text IS NOT NULL), {_index_sql('f', {'text': 'text'}, 'file')}, {_query_values(ONE)}, {_PHRASES}, {_bm25_sql('file', {'text': 1.0}, 's')} SELECT query_id, section_id, rank, score FROM ({_top_sql('s')})",
    "vector_topk": f"""SELECT query_id, id, cosine, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) - 1)::BIGINT AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id AS id, round({_VECTOR}, 6) AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank < {K}""",
    "rrf_hybrid": f"{_lists_sql(K)} SELECT query_id, section_id, rank, rrf, CASE WHEN in_cards = 1 AND in_raw = 1 THEN 'both' WHEN in_cards = 1 THEN 'cards' WHEN in_raw = 1 THEN 'raw' ELSE 'vector' END AS matched, in_vector FROM ({_top_sql('fused', 'true', K, 'rrf')})",
    "rrf_filtered": f"{_lists_sql(K, True)} SELECT query_id, section_id, rank, rrf, path FROM ({_top_sql('placed', f'''updated_at >= TIMESTAMP '2024-01-10' AND updated_at <= {B.NOW_SQL} AND starts_with(path, 'src1')''', K, 'rrf')})",
    "recency_rescored": f"""{_lists_sql(K)}, aged AS (SELECT query_id, section_id, round(rrf * (0.5 + 0.5 * pow(2.0, -greatest(epoch_us({B.NOW_SQL}) - epoch_us(updated_at), 0) / 86400000000.0 / 30.0)), 9) AS rrf FROM placed)
      SELECT query_id, section_id, rank, rrf FROM ({_top_sql("aged", "true", K, "rrf")})""",
    "explain_lists": f"{_lists_sql(4)} SELECT list, query_id, section_id, rank FROM lists",
    "hash_fanout": f"WITH {B.SECTIONS}, h AS (SELECT section_hash, min(section_id) AS hit FROM sections GROUP BY 1) SELECT hit, section_id FROM h JOIN sections USING (section_hash)",
}
