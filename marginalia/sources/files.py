"""Sources and sinks over files: markdown trees, JSON lines, evaluation data and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, doc_id_for, normalize_path
from ..operators.cards import CARD_SCHEMA
from ..operators.parsing import discover


def markdown_files(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """path (below the root), text (null if it isn't UTF-8), size_bytes, mtime, content_hash, doc_id."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM]*").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = normalize_path(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), "^" + "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in base) + "/", ""))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = found.select(path.alias("path"), text.alias("text"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    rows = discover(rows, ignored or [])
    return rows.withColumns({"content_hash": content_hash(F.col("text")), "doc_id": doc_id_for(F.col("path"))})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; a line that is no JSON of the schema fails the read, blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def card_map(spark: SparkSession, path: str) -> DataFrame:
    """section_hash, card of a JSON object that maps hashes to cards."""
    whole = spark.read.option("wholetext", "true").text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{', '.join(x.replace(' ', ': ', 1) for x in _fields(CARD_SCHEMA))}>>")).alias("section_hash", "card"))


def _fields(schema: str) -> list[str]:
    """The top-level fields of a schema in DDL."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def docsqa(questions: DataFrame, answers: DataFrame, corpus: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions of a project with their answers; qrels (question_id, page), once each; ids of labels that the corpus lacks.

    A question without an answer row is an error of the data and shows in the third frame as an unmapped id of null.
    """
    own = questions.where(F.col("project") == project).select("question_id", "query", "community_category")
    with_answers = own.join(answers, "question_id", "left")
    pages = corpus.where(F.col("project") == project).select(F.col("doc_id").alias("qrel_id"), normalize_path(F.col("repository_source_path")).alias("page"))
    wanted = with_answers.select("question_id", F.explode_outer(F.array_distinct("qrel_ids")).alias("qrel_id"))
    met = wanted.join(pages, "qrel_id", "left")
    marks = [F.coalesce(_any_true(c, dict(answers.dtypes)[c]), F.lit(False)).alias(c) for c in ("image_text_evidence_used", "requires_multimodal_judgment")]
    return with_answers.select("question_id", "query", "community_category", *marks), met.where("page IS NOT NULL").select("question_id", "page").distinct(), met.where("page IS NULL").select("question_id", "qrel_id")


def _any_true(column: str, kind: str) -> Column:
    return F.exists(column, lambda x: x) if kind.startswith("array") else F.col(column)


def eligible(questions: DataFrame, qrels: DataFrame, unmapped: DataFrame, indexed: DataFrame) -> DataFrame:
    """Questions without image evidence whose labels are all mapped and all indexed, and that have some."""
    missing = qrels.join(indexed.select("page").distinct(), "page", "left_anti").select("question_id")
    good = questions.where("NOT image_text_evidence_used").join(qrels.select("question_id").distinct(), "question_id", "left_semi")
    return good.join(unmapped.select("question_id").unionByName(missing), "question_id", "left_anti")


def export_cards(cards: DataFrame, path: str) -> None:
    """One card a line, in order of hash."""
    cards.select("section_hash", "card").orderBy("section_hash").write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str, day: str | None = None) -> None:
    """Add rows to an append-only table, partitioned by the day of a time column if one is named."""
    if day:
        rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def check_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations of an allow-list: each rule is a condition that every exported row must meet."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(name))])).alias("rule", "violations"))
