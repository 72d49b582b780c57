"""Markdown and MDX to sections, line by line, and the text tools that need a walk over lines.

A section runs from a heading to the line before the next heading of any level; what comes before the first is the
preamble, of level 0. Headings are ATX or setext, outside fenced code, comments and raw blocks; in HTML blocks ATX lines
count too. Front matter, and in MDX the leading import and export statements, belong to no section.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
NOT_TEXT = re.compile(r"^ {0,3}(?:[-*+][ \t]|\d{1,9}[.)][ \t]|>|#{1,6}(?:[ \t]|$)|\||<)|^(?: {4}|\t)")
RAW_OPEN = re.compile(r"<(pre|script|style|textarea)\b", re.I)
LINK = re.compile(r"!?\[(?:[^\[\]]|\[[^\]]*\])*\]\(\s*<?([^)\s>]+)>?(?:\s+[\"'(][^)]*)?\)")
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]+)>")
REFERENCE = re.compile(r"^ {0,3}\[[^\]]+\]:\s*<?(\S+?)>?(?:\s|$)")
TABLE_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)")


@dataclass
class Section:
    index: int
    level: int
    heading_path: list[str]
    line_start: int
    line_end: int
    text: str
    hash: str
    token_estimate: int
    code_langs: list[str]
    has_tables: bool


@dataclass
class Document:
    title: str | None
    frontmatter: str | None
    links_internal: list[str] = field(default_factory=list)
    links_external: list[str] = field(default_factory=list)
    line_count: int = 0
    token_estimate: int = 0
    hash: str = ""
    sections: list[Section] = field(default_factory=list)


def fold_newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def normalize(text: str) -> str:
    return "\n".join(line.rstrip() for line in fold_newlines(text).split("\n"))


def digest(text: str) -> str:
    return hashlib.sha256(normalize(text).encode("utf-8", "replace")).hexdigest()


def token_estimate(text: str) -> int:
    return math.ceil(len(text) / 4)


def plain_heading(text: str) -> str:
    """A heading's text without markup."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"[`*]|(?<!\w)_|_(?!\w)", "", text).strip()


def inline_pieces(line: str) -> list[tuple[str, str]]:
    """A line as (text, code or link) and what it holds, in order."""
    out: list[tuple[str, str]] = []
    at = 0
    marks = sorted([(m.start(), m.end(), "code", m[2].strip()) for m in CODE.finditer(line)] + [(m.start(), m.end(), "link", m[1]) for m in LINK.finditer(line)])
    for start, end, kind, held in marks:
        if start < at:
            continue
        if line[at:start].strip():
            out.append(("text", line[at:start].strip()))
        out.append((kind, held))
        at = end
    if line[at:].strip():
        out.append(("text", line[at:].strip()))
    return out


def _front_matter(lines: list[str]) -> tuple[int, str | None]:
    """How many lines the front matter takes, and what stands between its fences."""
    if lines and lines[0].rstrip() == "---":
        for k in range(1, len(lines)):
            if lines[k].rstrip() in ("---", "..."):
                return k + 1, "\n".join(lines[1:k])
    return 0, None


def _statements(lines: list[str], at: int) -> int:
    """Where MDX's leading import and export statements end: each goes on to the next blank line."""
    k = at
    while k < len(lines):
        if not lines[k].strip():
            k += 1
        elif re.match(r"(?:import\s+(?:[\w*{\"'])|export\s+(?:const|let|var|function|default|class|\{|\*))", lines[k]):
            while k < len(lines) and lines[k].strip():
                k += 1
            at = k
        else:
            break
    return at


def _front_title(front: str | None, statements: str) -> str | None:
    for line in (front or "").split("\n"):
        m = re.match(r"\s*title\s*[:=]\s*(.+?)\s*$", line)
        if m:
            return m[1].strip("\"'") or None
    m = re.search(r"export\s+const\s+title\s*=\s*[\"'`]([^\"'`]*)", statements)
    return m[1] if m else None


def parse(text: str, flavour: str = "markdown") -> Document:
    folded = fold_newlines(text)
    lines = folded.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    body, front = _front_matter(lines)
    begin = _statements(lines, body) if flavour == "mdx" else body
    doc = Document(None, front, line_count=len(lines), token_estimate=token_estimate(folded), hash=digest(text))
    heads: list[tuple[int, int, str]] = []  # first line, level, text
    fence: str | None = None
    comment = False
    raw: str | None = None
    langs: dict[int, list[str]] = {}
    tables: set[int] = set()
    internal: dict[str, None] = {}
    external: dict[str, None] = {}
    paragraph = -1  # the line on which the running paragraph began
    for k in range(begin, len(lines)):
        line = lines[k]
        if fence is not None:
            m = FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        if comment:
            comment = "-->" not in line
            continue
        if raw:
            if f"</{raw}" in line.lower():
                raw = None
            continue
        m = FENCE.match(line)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], -1
            langs.setdefault(k, []).append((m[2].strip().split() or ["text"])[0].strip("{}.") or "text")
            continue
        if line.lstrip().startswith("<!--"):
            comment, paragraph = "-->" not in line, -1
            continue
        m = RAW_OPEN.match(line.lstrip())
        if m:
            raw = None if f"</{m[1].lower()}" in line.lower() else m[1].lower()
            paragraph = -1
            continue
        m = ATX.match(line)
        if m:
            heads.append((k, len(m[1]), plain_heading(m[2] or "")))
            paragraph = -1
        elif (m := SETEXT.match(line)) and paragraph >= 0:
            heads.append((paragraph, 1 if m[1][0] == "=" else 2, plain_heading(" ".join(x.strip() for x in lines[paragraph:k]))))
            paragraph = -1
            continue
        elif not line.strip():
            paragraph = -1
        elif paragraph < 0 and not NOT_TEXT.match(line):
            paragraph = k
        elif paragraph >= 0 and NOT_TEXT.match(line) and not line.startswith(("    ", "\t")):
            paragraph = -1
        if "|" in line and k + 1 < len(lines) and TABLE_RULE.match(lines[k + 1]) and "-" in lines[k + 1]:
            tables.add(k)
        plain = CODE.sub("", line)
        for target in [*(x[1] for x in LINK.finditer(plain)), *(x[1] for x in AUTO.finditer(plain)), *([r[1]] if (r := REFERENCE.match(plain)) else [])]:
            if SCHEME.match(target) or target.startswith("//"):
                external[target] = None
            elif not target.startswith("#"):
                internal[target] = None
    doc.links_internal, doc.links_external = list(internal), list(external)
    doc.title = next((h[2] for h in heads if h[1] == 1), None) or _front_title(front, "\n".join(lines[body:begin]))
    starts = [(begin, 0, "")] + heads
    path: list[tuple[int, str]] = []
    for n, (start, level, heading) in enumerate(starts):
        end = starts[n + 1][0] if n + 1 < len(starts) else len(lines)
        if level:
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, heading))
        while end > start and not lines[end - 1].strip():
            end -= 1
        first = start
        while level == 0 and first < end and not lines[first].strip():
            first += 1
        if end <= first:
            continue
        own = "\n".join(line.rstrip() for line in lines[first:end])
        names: dict[str, None] = {lang: None for k in range(first, end) for lang in langs.get(k, ())}
        doc.sections.append(Section(len(doc.sections), level, [h for _, h in path] if level else [], first + 1, end, own, digest(own), token_estimate(own), list(names), any(first <= k < end for k in tables)))
    return doc


def chunk_text(text: str, most_tokens: int = 6000) -> tuple[str, bool]:
    """The text cut to a size: at the last blank line outside code that fits, else at the last line, else in the line; a marker tells what was left out."""
    if token_estimate(text) <= most_tokens:
        return text, False
    room, lines = most_tokens * 4, text.split("\n")
    used, blank, fits, fence = 0, 0, 0, False
    for k, line in enumerate(lines):
        if used + len(line) + (k > 0) > room:
            break
        used += len(line) + (k > 0)
        fits = k + 1
        if FENCE.match(line):
            fence = not fence
        if not line.strip() and not fence:
            blank = k
    cut = blank or fits
    if not cut:
        return text[:room] + f"\n[truncated: {len(lines)} lines]", True
    return "\n".join(lines[:cut]).rstrip() + f"\n[truncated: {len(lines) - cut} lines]", True


def snippet(text: str, most: int = 200) -> str:
    """The section's words after its heading, without lines that are nothing but markup."""
    out, fence = [], False
    for k, line in enumerate(fold_newlines(text).split("\n")):
        if FENCE.match(line):
            fence = not fence
            continue
        if not fence and (ATX.match(line) or SETEXT.match(line) or TABLE_RULE.match(line) or k == 0 and line.startswith("---")):
            continue
        plain = line if fence else re.sub(r"<[^>]+>", "", LINK.sub(lambda m: m[0][m[0].find("[") + 1 : m[0].find("](")], line))
        plain = plain if fence else re.sub(r"^[ \t]*(?:[-*+>]|\d{1,9}[.)])[ \t]+|[*`]", "", plain)
        if re.search(r"\w", plain):
            out.append(" ".join(plain.split()))
        if sum(map(len, out)) + len(out) > most + 1:
            break
    whole = " ".join(out)
    return whole if len(whole) <= most else whole[:most].rstrip() + "…"
