"""Markdown operators over tables of files: batches of texts go to the parser, rows of sections come back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.text import flavour, is_markdown

SECTION = "index int, level int, heading_path array<string>, line_start int, line_end int, text string, hash string, token_estimate int, code_langs array<string>, has_tables boolean"
DOCUMENT = "title string, frontmatter string, links_internal array<string>, links_external array<string>, line_count int, token_estimate int, hash string"

#: Characters of texts whose sections are held at once, and what a file counts besides its own.
SLICE_CHARS, ROW_CHARS = 2_000_000, 500


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in fields.split(", "))) + ">"


def parsed_slices(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Texts and flavours -> doc and sections, in frames of bounded size."""
    for texts, kinds in batches:
        docs, sections, size = [], [], 0
        for text, kind in zip(texts, kinds, strict=True):
            d = markdown.parse(text or "", kind)
            sections.append([vars(s) for s in d.sections])
            docs.append({k: v for k, v in vars(d).items() if k != "sections"})
            size += len(text or "") + ROW_CHARS
            if size >= SLICE_CHARS:
                yield pd.DataFrame({"doc": docs, "sections": sections})
                docs, sections, size = [], [], 0
        if docs:
            yield pd.DataFrame({"doc": docs, "sections": sections})


def parse_markdown(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """files with doc (a struct of the document's columns) and sections (an array)."""

    @F.pandas_udf(f"struct<doc: {_struct(DOCUMENT)}, sections: array<{_struct(SECTION)}>>")
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return parsed_slices(batches)

    return files.withColumn("_p", parsed(F.col(text_col), flavour(F.col(path_col)))).select("*", "_p.doc", "_p.sections").drop("_p")


def sections_of(parsed: DataFrame, path_col: str = "path") -> DataFrame:
    """A row for each section, with section_id, of parsed files."""
    from ..functions.text import doc_id_for, section_id_for

    rows = parsed.select(F.col(path_col), doc_id_for(F.col(path_col)).alias("doc_id"), F.explode("sections").alias("s")).select(path_col, "doc_id", "s.*")
    return rows.withColumn("section_id", section_id_for(F.col("doc_id"), F.col("index")))


def only_changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't known yet, before anything is parsed. known: path, content_hash."""
    hashed = files.withColumn("content_hash", F.sha2(F.col("text"), 256))
    return hashed.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def snippets(text: Column) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: markdown.snippet(t or ""))

    return cut(text)


def planned(text: Column, most_tokens: int = 6000) -> Column:
    """struct(text, truncated): what is sent to a summariser."""

    @F.pandas_udf("struct<text: string, truncated: boolean>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([markdown.chunk_text(t or "", most_tokens) for t in texts], columns=["text", "truncated"])

    return cut(text)


def quote_found(quote: Column, text: Column) -> Column:
    """Where a quote stands in a text, as start and end, if white space and typography don't count; null if it does not."""

    @F.pandas_udf("struct<start: int, end: int>")
    def find(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([locate(q, t) for q, t in zip(quotes, texts, strict=True)], columns=["start", "end"]).astype("Int32")

    return find(quote, text)


_PLAIN = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "})


def _folded(text: str) -> tuple[str, list[int]]:
    """The text in comparable form, and for each of its characters the place it came from."""
    out, places, space = [], [], True
    for k, c in enumerate(text.translate(_PLAIN)):
        if c.isspace():
            if not space:
                out.append(" ")
                places.append(k)
            space = True
            continue
        low = c.lower()
        out.append(low if len(low) == 1 else c)
        places.append(k)
        space = False
    return "".join(out), places


def locate(quote: str | None, text: str | None) -> tuple[int | None, int | None]:
    wanted = _folded(quote or "")[0].strip()
    held, places = _folded(text or "")
    at = held.find(wanted) if wanted else -1
    return (None, None) if at < 0 else (places[at], places[at + len(wanted) - 1] + 1)


def discover(files: DataFrame, ignored: list[str], path_col: str = "path") -> DataFrame:
    """Markdown files that no rule ignores: hidden names, and globs where ** spans folders and a trailing slash means a folder."""
    import fnmatch
    import re

    rules = []
    for glob in ignored:
        anchored = glob.startswith("/")
        body = fnmatch.translate(glob.strip("/")).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*.*", "\x00").replace(".*", "[^/]*").replace("\x00", ".*")
        rules.append(("^" if anchored else "(^|.*/)") + body + "(/.*)?$")
    out = files.where(is_markdown(F.col(path_col)) & ~F.col(path_col).rlike(r"(^|/)\.[^/]"))
    for rule in rules:
        out = out.where(~F.col(path_col).rlike(re.sub(r"\\Z|\\z", "", rule)))
    return out
