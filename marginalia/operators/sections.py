"""Sections: the units that are indexed, hashed and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, section_id_for, token_estimate


def line_sections(docs: DataFrame) -> DataFrame:
    """Each line that isn't blank as a section: doc_id, idx (the line's number, from 0), section_id, text, section_hash, token_estimate, source, lang."""
    lines = docs.where("text IS NOT NULL").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    lines = lines.where(F.trim("text") != "")
    return lines.select("doc_id", "idx", section_id_for(F.col("doc_id"), F.col("idx")).alias("section_id"), "text", content_hash(F.col("text")).alias("section_hash"), token_estimate(F.col("text")).alias("token_estimate"), "source", "lang")
