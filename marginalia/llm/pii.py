"""Personal data: generous candidate generators, boosted trees over format and context, calibrated thresholds.

Four kinds are sought: email, ip, card, phone. The base patterns of each kind always count. Beside them, generators
propose looser spans (addresses spelled out, IPv6, cards of 13 to 15 digits, numbers written without a country code),
which may overlap each other and the base spans. Gradient-boosted trees score each proposal from its format and the words
around it; a kind's threshold is the lowest at which held-out training candidates reach the wanted precision. Proposals
above it that overlap nothing better are added.

The trees are trained when first used, on candidates built here with seeded choices; nothing is learned from the corpus.

Defined results: a null text counts as empty and has no spans. Positions are code points, ends exclusive. Spans of one
kind don't overlap; a card is no phone, and added spans never touch base spans of any kind. Rows are independent:
repeated rows repeat, extra columns are ignored. Matches are found from "@", "+" and digits outward and never retried from
each position, and whether a proposal touches a span is looked up in their order, so time grows with a text's length as
sorting does.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame

from .shared import map_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

HAS_DIGIT = re.compile(r"[0-9]").search
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds change no match (a match never starts inside a run of digits); they keep the time linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser candidates.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({<]\s?(?:dot|DOT)\s?[\])}>])\s?[A-Za-z0-9-]{1,63}){1,4}")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
GROUPED = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,6}\)?){1,6}(?![0-9A-Za-z])")
WORD = re.compile(r"[^\W\d_]+")
#: Words near a span that speak for a kind, or for other uses of numbers.
CUES = {
    "email": "mail email address contact correo courriel adresse write".split(),
    "ip": "ip server host address client login gateway ping".split(),
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment".split(),
    "phone": "phone tel telephone call mobile fax cell telefon telefono handy ring".split(),
    "other": "order invoice version isbn id code ref reference number total date year page serial build ticket".split(),
}
CUE_OF = {word: kind for kind, words in CUES.items() for word in words}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind as listed, then by start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if HAS_DIGIT(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:
                digits = re.sub(r"[\x20-]", "", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """Looser spans, which may overlap."""
    out: list[Span] = []
    if any(x in text for x in ("at]", "at)", "at}", "at>", "AT]", "AT)", "at ]", "at )")):
        out += [("email", m.start(), m.end()) for m in SPELLED.finditer(text)]
    if HAS_DIGIT(text):
        if text.count(":") >= 7:
            out += [("ip", m.start(), m.end()) for m in IPV6.finditer(text)]
        for m in GROUPED.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 7 <= n <= 15:
                out.append(("phone", m.start(), m.end()))
            if 13 <= n <= 15:
                out.append(("card", m.start(), m.end()))
    return out


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    digits = [c for c in s if c.isdigit()]
    groups = re.findall(r"[0-9]+", s)
    parts = re.findall(r"[A-Za-z0-9-]+", s)
    before = [CUE_OF.get(w.lower()) for w in WORD.findall(text[max(0, a - 40) : a])[-4:]]
    after = [CUE_OF.get(w.lower()) for w in WORD.findall(text[b : b + 20])[:2]]
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(len(groups)), float(len(set(digits))),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(luhn("".join(digits)) if digits else 0),
        float("(" in s), float("-" in s), float("." in s), float("/" in s), float(" " in s), float(s[:1] == "0" or s[:2] == "(0"),
        float(before.count(kind)), float(before.count("other")), float(after.count(kind)), float(sum(c is not None and c not in (kind, "other") for c in before)),
        float(len(s) - len(digits)), float(":" in s), float(bool(re.search(r"(?i)dot", s))), float(groups[0][:2] in ("34", "37", "19", "20") if groups else 0),
        float(before[-1:] == [kind]), float(before[-1:] == ["other"]), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float(sum(c.isspace() for c in s)), float(len(parts[-1]) if parts else 0), float(any(c.isalpha() for c in s)),
        float(max(map(len, parts), default=0)), float(len(parts[0]) if parts else 0), float(". " in s or " ." in s),
    ]


class Trees:
    """Boosted trees of depth two: each is (feature, cut, feature and cut on either side, four values)."""

    def __init__(self, trees: list[tuple], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, x: list[float]) -> float:
        total = 0.0
        for f, cut, fl, cl, fr, cr, v in self.trees:
            total += v[int(x[fl] > cl)] if x[f] <= cut else v[2 + int(x[fr] > cr)]
        return total

    def accepts(self, text: str, span: Span) -> float | None:
        """The span's score, if it is above its kind's threshold."""
        s = self.score(features(text, span))
        return s if s >= self.thresholds[span[0]] else None


def _labelled(n: int, rng: random.Random) -> tuple[list[list[float]], list[int], list[str]]:
    """Candidates in made sentences, and whether each is personal data."""
    xs, ys, kinds = [], [], []

    def filler() -> str:
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(2, 7)))

    def number(*sizes: int) -> list[str]:
        return ["".join(rng.choice("0123456789") for _ in range(k)) for k in sizes]

    def card(size: int, start: str) -> str:
        body = start + "".join(number(size - len(start) - 1))
        return next(body + c for c in "0123456789" if luhn(body + c))

    for _ in range(n):
        good, kind = rng.random() < 0.5, rng.choice(KINDS)
        cue = rng.choice(CUES[kind if good else "other"]) if rng.random() < 0.8 else ""
        if kind == "email":
            if good:
                at, dot = rng.choice(["[at]", "(at)", " [at] ", " (at) ", " {at} ", "[AT]"]), rng.choice([".", " [dot] ", "(dot)", "(DOT)"])
                value = f"{rng.choice(['j.doe', 'mara', 'info7', 'tom_k', filler().split()[0]])}{at}{rng.choice(['mail', 'site', 'host-1', filler().split()[0]])}{dot}{rng.choice(['com', 'org', 'de', 'co.uk', 'net'])}"
            else:  # a remark in brackets within a sentence that ends soon after, or a rate
                a, b, c = filler().split()[0], filler().split()[0], rng.choice([*filler().split(), "is", "the", "it"])
                value = rng.choice([f"{a} (at) {b} . {c}", f"{a} (at) {b}. {c}", f"{a} [at] {b} . {c}", f"{a} (at) {rng.randint(1, 99)}.{rng.randint(10, 99)}", f"{a} <at> {rng.randint(1, 9)}.{rng.randint(1, 9)}"])
        elif kind == "ip":
            if good:
                value = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([4, 4, 4, rng.randint(1, 4)]))) for _ in range(8))
            else:  # an eight-byte hardware address, or fields of digits
                size = rng.choice([2, 2, 1, 3])
                value = ":".join("".join(rng.choice(rng.choice(["0123456789abcdef", "0123456789"])) for _ in range(size)) for _ in range(8))
        elif kind == "card":
            value = card(15, rng.choice(["34", "37"])) if good else "".join(number(rng.choice([13, 14, 15])))
            value = f"{value[:4]} {value[4:10]} {value[10:]}"
        elif good:
            a, b, c = number(3, 3, 4)
            value = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a[:2]} {b}{c}", f"(0{a[:2]}) {b} {c}", f"{a}.{b}.{c}"])
            cue = cue or rng.choice(CUES["phone"])
        else:
            a, b, c = number(4, 2, 2)
            value = rng.choice([f"{a}-{b}-{c}", f"{b}.{c}.{a}", f"{a} {a} {b}", f"978-{b}-{a}-{c}", f"{a}/{b}/{c}", f"{a}{b}-{c}"])
        lead = f"{filler()} {cue}{rng.choice(['', ':', ' is'])} " if cue else filler() + " "
        if rng.random() < 0.4:  # a word that speaks for something else stands farther away
            lead = f"{rng.choice(CUES['other' if good else kind])} {' '.join(filler().split()[:2])} {cue or 'the'} "
        text = lead + value + rng.choice([" ", ". ", ", "]) + filler()
        for span in candidates(text):
            if span[1] < len(lead) + len(value) and span[2] > len(lead):
                xs.append(features(text, span))
                ys.append(int(good and span[0] == kind and span[2] - span[1] >= len(value) - 1))
                kinds.append(span[0])
    return xs, ys, kinds


@lru_cache(maxsize=1)
def trained(n: int = 3000, rounds: int = 40, rate: float = 0.3, precision: float = 0.98, seed: int = 11) -> Trees:
    """Boost on two thirds of the labelled candidates; set thresholds on the other third."""
    import numpy as np

    xs, ys, kinds = _labelled(n, random.Random(seed))
    x, y = np.array(xs), np.array(ys, float)
    held = np.arange(len(y)) % 3 == 0
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))) for f in range(x.shape[1])]

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        found = (-1.0, 0, float("inf"))
        for f, at in enumerate(cuts):
            for cut in at:
                left = rows & (x[:, f] <= cut)
                right = rows & ~left
                gain = sum(g[side].sum() ** 2 / (h[side].sum() + 1) for side in (left, right))
                if gain > found[0]:
                    found = (gain, f, float(cut))
        return found[1], found[2]

    score, trees, fit = np.zeros(len(y)), [], ~held
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, cut = best(fit, g, h)
        left = x[:, f] <= cut
        fl, cl = best(fit & left, g, h)
        fr, cr = best(fit & ~left, g, h)
        leaves = [left & (x[:, fl] <= cl), left & (x[:, fl] > cl), ~left & (x[:, fr] <= cr), ~left & (x[:, fr] > cr)]
        values = [rate * float(g[a & fit].sum() / (h[a & fit].sum() + 1)) for a in leaves]
        for a, v in zip(leaves, values, strict=True):
            score[a] += v
        trees.append((f, cut, fl, cl, fr, cr, tuple(values)))
    thresholds = {}
    for kind in KINDS:
        own = held & (np.array(kinds) == kind)
        order = np.argsort(-score[own])
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.nonzero(right >= precision)[0]
        thresholds[kind] = max(1.0, float(score[own][order][good[-1]])) if len(good) else float("inf")
    return Trees(trees, thresholds)


def all_spans(text: str, base: list[Span], trees: Trees) -> list[Span]:
    """The base spans and those the trees add, by kind as listed, then by start."""
    scored = [(s, span) for span in candidates(text) if (s := trees.accepts(text, span)) is not None]
    taken = list(base)
    starts: list[int] = []
    ends: list[int] = []  # of the stretches that spans cover, which don't overlap, in order
    for _, a, b in sorted(base, key=lambda x: x[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for _, span in sorted(scored, key=lambda x: (-x[0], x[1][1], x[1][0])):
        at = bisect_left(starts, span[2])  # stretches before this one start before the span ends
        if not at or ends[at - 1] <= span[1]:
            taken.append(span)
            starts.insert(at, span[1])
            ends.insert(at, span[2])
    return sorted(taken, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redact(text: str | None, trees: Trees | None = None) -> str:
    """The text with each span replaced by its kind in brackets."""
    text = text or ""
    spans = sorted(all_spans(text, base_spans(text), trees or trained()), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if b > at:
            out += [text[at : max(a, at)], f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """``id_col``, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, redacted_chars."""
    own = trees or trained()

    def start():
        def work(ids: list, texts: list) -> list[tuple]:
            out = []
            for i, text in zip(ids, texts, strict=True):
                text = text or ""
                base = base_spans(text)
                spans = all_spans(text, base, own)
                count = [sum(s[0] == kind for s in base) for kind in KINDS]
                out.append((i, *count, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), sum(b - a for _, a, b in spans)))
            return out

        return work

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, redacted_chars bigint"
    return map_columns(docs, start, schema, [id_col, text_col])
