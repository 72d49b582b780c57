"""Byte-level BPE by per-prefix dynamic programming, and its inverse.

For every prefix of a word's bytes, the last token of the prefix's encoding is unique. A token that ends at a prefix's
end is that last token exactly if the shorter prefix before it ends in a token that is compatible with it: two tokens
are compatible if encoding their joined bytes gives just the two. An automaton over the vocabulary finds all tokens that
end at each byte, the longest first; the first compatible one is stored, and following the stored tokens back from the
end gives the word's ids. No merge is ever carried out.

Compatibility is read off the merge ranks. Undo the later of the two tokens' last merges, again and again: each step
shows two tokens that once touched at the border; if they have a merge that comes before the one just undone, the border
would not have survived. Equal ranks go to the left one, as merges run from left to right.

Words repeat, so a task keeps the ids of the pre-tokenizer's pieces, and of what stands between two spaces, that it met
lately, in two generations of bounded size; longer ones are worked out anew. A piece costs time in proportion to its bytes, whatever its length.

Defined results: a null text counts as empty and has no ids. Added tokens in a text ("<|endoftext|>") are matched first,
as their files say. Rows are independent; repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .shared import map_columns

#: Unicode white space, written out: libraries differ in what \s holds.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokenizer's pattern (fixed by the format).
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Entries in each of the two generations of a task's two memories (pieces; whatever stands between spaces), and the longest kept.
KEPT, KEPT_CHARS = 300_000, 48
#: Token pairs whose compatibility is remembered; when there are so many, a task forgets them and starts anew.
PAIRS_KEPT = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Memory(dict):
    """Results met lately, in two generations: when the young one is full it becomes the old one."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.work(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class PrefixEncoder:
    """Encodes and decodes with one vocabulary; ``definition`` is the JSON text of a byte-level BPE tokenizer."""

    def __init__(self, definition: str):
        import ahocorasick
        import regex

        spec = json.loads(definition)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {k: word for word, k in vocab.items()} | {k: word.encode() for word, k in self.added.items()}
        self.rank, self.halves, self.merged = {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = (vocab[bytes(letters[c] for c in half)] for half in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab[self.bytes_of[left] + self.bytes_of[right]]
            self.merged[left, right] = r
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = r, (left, right)
        self.automaton = ahocorasick.Automaton()
        for word, k in vocab.items():
            if len(word) == 1 or k in self.rank:
                self.automaton.add_word(word.decode("latin-1"), (len(word), k))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        self.pieces = regex.compile(_PIECE).findall
        self.tangled = regex.compile(r"\s (?:\s|\Z)").search
        self.words = _Memory(self.piece)
        self.chunks = _Memory(lambda chunk: b"".join(map(self.words.__getitem__, self.pieces(" " + chunk))))

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay as they are."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            known = self.fits[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, x: int, y: int) -> bool:
        before = len(self.merged)  # a merge at the border counts if its rank is below this
        while True:
            if self.merged.get((x, y), before) < before:
                return False
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                before, x = rx, self.halves[x][1]
            else:
                before, y = ry + 1, self.halves[y][0]

    def stands(self, k: int) -> bool:
        """Whether the token's own bytes encode to the token."""
        if k not in self.halves:
            return True
        if k not in self.alone:
            a, b = self.halves[k]
            self.alone[k] = self.stands(a) and self.stands(b) and self._halves_meet(a, b, self.rank[k])
        return self.alone[k]

    def _halves_meet(self, x: int, y: int, rank: int) -> bool:
        """Whether x and y both form before any other merge crosses their border."""
        while True:
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if max(rx, ry) > rank:
                return False
            if rx > ry:
                before, x = rx, self.halves[x][1]
            else:
                before, y = ry + 1, self.halves[y][0]
            if self.merged.get((x, y), before) < before:
                return False

    def piece(self, text: str) -> bytes:
        """The ids of a piece, as little-endian unsigned 32-bit integers."""
        word = text.encode().decode("latin-1")
        last = [-1] * (len(word) + 1)
        size = [0] * (len(word) + 1)
        fits = self.fits
        for end, (n, k) in self.automaton.iter(word):
            end += 1
            if size[end]:
                continue
            if n == end:
                if not self.stands(k):
                    continue
            else:
                pair = (last[end - n], k)
                ok = fits.get(pair)
                if not (self.compatible(*pair) if ok is None else ok):
                    continue
            last[end], size[end] = k, n
        ids, at = array("I"), len(word)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        if ids.itemsize != 4:
            ids = array("L", ids)
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif self.tangled(part) or part.endswith(" "):
                out.extend(map(self.words.__getitem__, self.pieces(part)))
            else:  # no piece crosses the border before a space, so what follows each space can be looked up as one
                first, *rest = part.split(" ")
                out.extend(map(self.words.__getitem__, self.pieces(first)))
                out.extend(map(self.chunks.__getitem__, rest))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        at = array("I")
        at.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, at)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(definition: str) -> PrefixEncoder:
    return PrefixEncoder(definition)


def _definition(docs: DataFrame, path: str):
    """The vocabulary file's text, read by the driver and sent to each executor once; its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids (array of int)."""
    definition = _definition(docs, path)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = _encoder(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                coded = [encoder.encode(t or "") for t in part.column(text_col).to_pylist()]
                sizes = np.array([len(c) // 4 for c in coded])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(sizes, pa.int64()), ids], names=[id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, text."""
    definition = _definition(encoded, path)

    def start():
        encoder = _encoder(definition.value)

        def work(ids: list, arrays: list) -> list[tuple]:
            return [(i, encoder.decode(array("I", a or []).tobytes())) for i, a in zip(ids, arrays, strict=True)]

        return work

    return map_columns(encoded, start, f"{id_col} {dict(encoded.dtypes)[id_col]}, text string", [id_col, ids_col])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256: encode each text, decode the ids, keep digests of both."""
    definition = _definition(docs, path)

    def start():
        encoder = _encoder(definition.value)

        def work(ids: list, texts: list) -> list[tuple]:
            out = []
            for i, t in zip(ids, texts, strict=True):
                coded = encoder.encode(t or "")
                out.append((i, len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(encoder.decode(coded).encode()).hexdigest()))
            return out

        return work

    return map_columns(docs, start, f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", [id_col, text_col])
