"""Toxicity by multiple-instance learning: sentences are scored, noisy-or combines them, document labels train them.

A sentence's probability is logistic in the words it holds, whole and by their first letters (languages differ in how
they bend a word). A document is toxic if any sentence is: its probability is
one less the product of the sentences' complements, times that of a leak that stands for whatever sentences don't show.
Training sees only document labels. Each round splits a document's blame over its sentences as the noisy-or says and
moves the words' weights along the gradient; a shrinking threshold keeps weights that tell little at zero, and none is negative.
Scoring needs only the words left (a lexicon of bounded size), and the sentences with the highest
probabilities are the offending ones.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` of them, and as many in that order as
``SAMPLE_BYTES`` of text hold: the ones whose hash of the id is smallest, so the sample doesn't depend on order or
partitions); rows held out are never in it. Everything is scored.

Defined results: a null text counts as empty; an empty text has the leak's probability. Labels that are null are not
learned from. Rows are independent: repeated rows repeat, extra columns are ignored. With no labelled rows at all, or
labels of one kind only, every text gets the share of toxic labels (0 with none).
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, map_columns, settle, unused

SENTENCE_END = re.compile(r"(?<=[.!?…。])[\s]+|\n+")
WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that are learned from, and entries that the lexicon may hold.
SAMPLE_ROWS, LEXICON_SIZE = 4000, 2000
#: Bytes of text that the sample may have in all, as the driver learns from it. Texts are whole or left out.
SAMPLE_BYTES = 64_000_000
#: Lengths of a word's beginnings that count beside the whole word; longer words than WORD_CHARS count by those alone.
STARTS, WORD_CHARS = (4, 5, 6, 7), 24
#: An entry must tell the labels apart by this much (twice the log likelihood ratio) and be so many times as frequent in toxic documents.
TELLING, TIMES = 15.0, 3.0


def entries(word: str) -> list[str]:
    """The lexicon entries that a word may match: its beginnings, and the whole word, marked by a full stop."""
    return [word[:n] for n in STARTS if len(word) >= n] + ([word + "."] if len(word) <= WORD_CHARS else [])


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))] if at < len(text) else out


class Scorer:
    """Weights of entries, the bias of a sentence, and the leak's log odds."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        import ahocorasick

        self.weights, self.bias, self.leak = weights, bias, leak
        self.starts = ahocorasick.Automaton()
        for entry in weights:
            self.starts.add_word(entry.rstrip("."), len(entry.rstrip(".")))
        if weights:
            self.starts.make_automaton()

    def told(self, text: str) -> dict[int, float]:
        """Probability by start of the sentences that hold words of the lexicon."""
        if not self.weights:
            return {}
        low = text.lower()
        begun = {a for end, n in self.starts.iter(low) if not (a := end - n + 1) or not low[a - 1].isalpha()}
        if not begun:
            return {}
        spans, k, own = sentences(low), 0, {}
        for at in sorted(begun):
            m = WORD.match(low, at)
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            if m and k < len(spans):
                own.setdefault(spans[k][0], set()).update(e for e in entries(m[0]) if e in self.weights)
        return {at: 1 / (1 + math.exp(-self.bias - sum(self.weights[e] for e in es))) for at, es in own.items() if es}

    def score(self, text: str) -> float:
        keep = 1 - 1 / (1 + math.exp(-self.leak))
        for p in self.told(text).values():
            keep *= 1 - p
        return min(1.0, max(0.0, 1 - keep))

    def offending(self, text: str, least: float = 0.5) -> list[str]:
        """The sentences whose own probability is at least ``least``, in order; as they stand in ``text``."""
        text = text or ""
        low = text.lower()
        where = {a: b for a, b in sentences(low)}
        return [(text if len(low) == len(text) else low)[a : where[a]] for a, p in sorted(self.told(text).items()) if p >= least]


def blame(z, doc_of, labels, leak: float):  # noqa: ANN001, ANN201
    """Of sentences with log odds ``z``: their probabilities, the documents' (by noisy-or with the leak), and the gradients of the
    log likelihood of the labels by each sentence's and by each document's leak's log odds: the share of the blame less the probability."""
    import numpy as np

    p = 1 / (1 + np.exp(-z))
    q = 1 / (1 + math.exp(-leak))
    keep = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(labels)) + math.log1p(-q)
    whole = np.clip(-np.expm1(keep), 1e-9, 1 - 1e-9)
    share = labels / whole
    return p, whole, (share[doc_of] - 1) * p, (share - 1) * q


def fit(texts: list[str], labels: list[int], rounds: int = 60, rate: float = 3.0, shrink: float = 0.0015) -> Scorer:
    """Learn a scorer from documents' labels, on the driver; the cost is bounded by the sample."""
    import numpy as np

    share = sum(labels) / len(labels) if labels else 0.0
    if not 0 < share < 1:
        return Scorer({}, -9.0, 9.0 * (2 * share - 1) if labels else -20.0)
    # Entries are kept by how well they tell the documents' labels apart.
    toxic, clean = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        (toxic if y else clean).update({e for w in set(WORD.findall(text.lower())) for e in entries(w)})
    n1, n0 = sum(labels), len(labels) - sum(labels)

    def telling(c1: int, c0: int) -> float:
        if c1 / n1 < TIMES * c0 / n0:
            return 0.0
        pairs = ((c1, n1, c1 + c0), (c0, n0, c1 + c0), (n1 - c1, n1, n1 + n0 - c1 - c0), (n0 - c0, n0, n1 + n0 - c1 - c0))
        return 2 * sum(c * math.log(c * (n1 + n0) / (n * t)) for c, n, t in pairs if c)

    gain = {e: g for e, c in toxic.items() if c >= 3 and (g := telling(c, clean[e])) >= TELLING}
    lexicon = sorted(gain, key=lambda e: (-gain[e], e))[:LEXICON_SIZE]
    index = {w: k for k, w in enumerate(lexicon)}
    doc_of, rows, cols = [], [], []
    for d, low in enumerate(map(str.lower, texts)):
        for a, b in sentences(low):
            own = {index[e] for w in WORD.findall(low[a:b]) for e in entries(w) if e in index}
            if own:
                rows += [len(doc_of)] * len(own)
                cols += own
                doc_of.append(d)
    if not doc_of:
        return Scorer({}, -3.0, math.log(share / (1 - share)))
    r, c, d = np.array(rows, int), np.array(cols, int), np.array(doc_of, int)
    y, w, bias, leak = np.array(labels, float), np.zeros(len(lexicon)), -3.0, math.log(share / (1 - share)) - 1
    seen = np.bincount(c, minlength=len(lexicon)).astype(float)
    for step in range(rounds):
        z = np.clip(bias + np.bincount(r, w[c], minlength=len(d)), -30, 30)
        p, whole, g, leak_pull = blame(z, d, y, leak)
        q = 1 / (1 + math.exp(-leak))
        pull = np.bincount(c, g[r], minlength=len(lexicon)) / (seen + 5)
        w = w + rate * pull
        w = np.maximum(w - rate * shrink * 20 / (seen + 5), 0)  # an entry may speak for toxicity or be silent
        bias += 0.2 * float(np.clip(g.sum() / max(1.0, (1 - whole[d]).sum() + p.sum()), -1, 1))
        bias = min(bias, -2.5)
        leak += 0.5 * float(leak_pull.sum() / len(y) / max(q * (1 - q), 1e-3))
        leak = min(leak, -1.5)
    kept = {lexicon[k]: float(w[k]) for k in np.nonzero(w > 0.2)[0]}
    return Scorer(kept, bias, leak)


def held_out(id_col: str, folds: int = 5):  # noqa: ANN201
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES,
) -> Scorer:
    """Fit on at most ``rows`` labelled documents of at most ``most_bytes`` outside the held-out fold; the texts are whole."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
    some = known.withColumn("place", F.crc32(F.concat(F.lit("sample"), F.col("i").cast("string")).cast("binary"))).orderBy("place", "i").limit(rows)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("text"))
    # the sample's ids are few, whatever the corpus, so they go to the documents; an id may repeat, then its least text counts
    pairs = texts.join(F.broadcast(some), "i").groupBy("i", "place", "y").agg(F.min("text").alias("text"))
    pairs = settle(pairs.withColumn("size", F.octet_length("text")), "sample")
    total, last = 0, None
    for r in pairs.select("place", "i", "size").orderBy("place", "i").collect():
        total += r["size"]
        if total > most_bytes:
            break
        last = r
    got = []
    if last is not None:
        within = (F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("i") <= last["i"]))
        got = pairs.where(within).orderBy("i").select("text", "y").collect()
    free(pairs)
    return fit([g["text"] for g in got], [g["y"] for g in got])


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, held_out, score, predicted, n_offending, worst (the first sentence above the threshold, or null)."""
    weights, bias, leak = scorer.weights, scorer.bias, scorer.leak

    def start():
        own = Scorer(weights, bias, leak)

        def work(ids: list, held: list, texts: list) -> list[tuple]:
            out = []
            for i, h, text in zip(ids, held, texts, strict=True):
                p = own.score(text or "")
                bad = own.offending(text or "", threshold) if p >= threshold else []
                out.append((i, bool(h), p, int(p >= threshold), len(bad), bad[0] if bad else None))
            return out

        return work

    (held,) = unused([id_col, text_col], "held")
    rows = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias(held), F.col(text_col))
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int, n_offending int, worst string"
    return map_columns(rows, start, schema, [id_col, held, text_col])


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; nothing is shuffled."""
    weights, bias, leak = scorer.weights, scorer.bias, scorer.leak

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        own = Scorer(weights, bias, leak)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t or "") < threshold for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
