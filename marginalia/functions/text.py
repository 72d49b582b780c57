"""Text expressions, all built from Spark's own functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _accents() -> tuple[str, str]:
    """Latin letters whose decomposition is one base letter and marks, and those base letters."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.combining(m) for m in marks):
            marked.append(chr(code))
            plain.append(first)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def tokens(text: Column) -> Column:
    """The tokens of an index entry or a query: runs of letters, digits and private-use characters, folded."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def normalize_block(text: Column) -> Column:
    """Line ends as LF, without white space before them."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[^\S\n]+(?=\n|$)", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_block(text), 256)


def doc_id_for(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def section_id_for(doc: Column, index: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit("#"), index.cast("string"))


def normalize_typography(text: Column) -> Column:
    """Curly quotes, dashes and spaces made plain, white space collapsed and trimmed."""
    # fixed values: typographic characters and their plain forms
    plain = F.translate(text, "‘’‚“”„–—−   ", "'''\"\"\"---   ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "…", "..."), r"\s+", " "))


def clip(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def is_heading_only(text: Column) -> Column:
    """A heading line and nothing after it."""
    return text.rlike(r"^\s*#[^\n]*(\n\s*)*$")


def normalize_heading(text: Column) -> Column:
    """Template tags and backticks removed, lower case, white space collapsed; an unclosed tag drops the rest."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\{%.*?%\}", ""), r"\{%.*$", "")
    return F.trim(F.regexp_replace(F.lower(F.replace(plain, F.lit("`"), F.lit(""))), r"\s+", " "))


def normalize_path(path: Column) -> Column:
    """Forward slashes, without leading "./" and repeated slashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/"), r"^(\./)+", "")


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown|mdx)$")


def flavour(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".mdx"), "mdx").otherwise("markdown")


def strip_url_credentials(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]*@", "$1")


def redact_absolute_paths(text: Column) -> Column:
    """Absolute paths (of at least two parts, not those of URLs) replaced by a mark."""
    return F.regexp_replace(text, r"(^|[\s\"'(=])(?:/[^/\s\"')]+){2,}/?", "$1<path>")


def host_only(url: Column) -> Column:
    """Scheme and host of a URL; anything else is null."""
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/@?#]*@)?([^/?#]*)", 2), F.lit(""))


def has_scheme(link: Column) -> Column:
    return link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def years_in(text: Column) -> Column:
    """Four-digit years that are no part of longer runs of digits."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))


def path_prefix_under(roots: list[str], raw: str) -> str | None:
    """The prefix below the root that a typed path filter means, by text alone; None for the whole root.

    A relative path stays as typed, without a leading "./". An absolute one must be one of the roots or below it, else
    ``ValueError``. A slash at the end is kept: ``docs/`` doesn't stand for ``docs2/a.md``, ``docs`` does.
    """

    def plain(path: str) -> list[str]:
        out: list[str] = []
        for part in path.split("/"):
            if part == "..":
                del out[-1:]
            elif part not in ("", "."):
                out.append(part)
        return out

    if not raw.startswith("/"):
        own = raw.removeprefix("./")
        return None if own in ("", ".") else own
    asked = plain(raw)
    for root in map(plain, roots):
        if asked[: len(root)] == root:
            below = "/".join(asked[len(root) :])
            return (below + "/" if raw.endswith("/") else below) if below else None
    raise ValueError(f"{raw} is not under {roots[0] if roots else 'any root'}")
