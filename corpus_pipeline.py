"""From raw documents to token ids, as stages that each call one operator of ``marginalia.llm``.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. ``run`` writes each stage's
result to the shared folder, so a stage that fails is run again from files.

Every stage works on all rows that the one before it kept. Null texts count as empty; empty texts are copies of each
other, have no shingles, and have no ids. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import block_naming, bpe, jaccard, mixing, toxicity
from marginalia.llm.queries import WEIGHTS, domain_of_source, table, vocabulary
from marginalia.llm.shared import free, settle

#: The mix takes this part of the tokens left, each document once at most: repeats would undo the stages before it.
MIX_FILL, MIX_EPOCHS, MIX_SEED = (9, 10), 1, 7


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return block_naming.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts, the row with the least id stays."""
    return jaccard.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights."""
    return mixing.take(docs, domain_of_source(), WEIGHTS, MIX_FILL, MIX_EPOCHS, MIX_SEED)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return bpe.encode_texts(docs, vocabulary())


STAGES = [("toxicity", clean), ("exact_dedup", without_copies), ("ngram_jaccard", without_near_copies), ("mixing", mixed), ("bpe", encoded)]
#: No SQL: the toxicity model is trained, and byte-pair encoding isn't relational. Tests compare it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = settle(stage(spark, docs, sf_dir), name)
        free(docs)  # the stage that read it is written
        docs = kept
    return docs
