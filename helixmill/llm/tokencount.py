"""Operator 1: token counts of edited documents by segment trees over pre-tokens.

The leaves of a document's tree are runs of about `LEAF` pre-tokens, each with its text and its
number of tokens; inner nodes hold the sums of characters and tokens below them. An edit finds its
leaf by descending the character sums. Only the leaves it touches are split and encoded again,
with boundary context: from a leaf that begins two or more characters before the edit (a
pre-token's end depends on at most two characters after it) to the first leaf border behind the
edit where the new split has a border too. From there on the old pre-tokens stand. Then the sums
on the paths to the root are updated.

Edits are (start, stop, insert) in characters of the original text. They are applied from the
last to the first. Bounds are cut to the text, a stop to the start of the edit behind it, and an
edit with a null bound is left out; a null insert is empty.

Rows: null text is empty. Null or empty edits leave the counts as they are. Repeated rows are
counted each. Texts of any length are counted whole. An empty table gives an empty table. Other
columns pass through; one that clashes with an output is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe

LEAF = 32
Edit = tuple[int, int, str]


def split_words(text: str, enc: bpe.WordEncoder) -> list[str]:
    """Pre-tokens, special tokens among them."""
    if enc.cut and "<" in text and any(s in text for s in enc.voc.special):
        return [w for k, part in enumerate(enc.cut(text)) for w in ([part] if k % 2 else enc.find(part))]
    return enc.find(text)


def numbers(words: list[str], enc: bpe.WordEncoder) -> np.ndarray:
    special, number = enc.voc.special, enc.number.__getitem__
    if special and any(s in words for s in special):
        return np.array([-1 - special[w] if w in special else number(w) for w in words], np.int32)
    return np.array(list(map(number, words)), np.int32)


def numbered(text: str, enc: bpe.WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's pre-tokens and their characters."""
    words = split_words(text, enc)
    return numbers(words, enc), np.fromiter(map(len, words), np.int64, len(words))


class TokenTree:
    """One document's pre-tokens and their sums."""

    def __init__(self, text: str, enc: bpe.WordEncoder, split: tuple[np.ndarray, np.ndarray] | None = None):
        """split: what numbered() gave for the text, if it is at hand."""
        self.enc = enc
        self.encoded = 0
        seq, sizes = split or numbered(text, enc)
        counts = enc.counts(seq) if len(seq) else np.zeros(0, np.int64)
        starts = np.arange(0, len(seq), LEAF)
        chars = np.add.reduceat(sizes, starts) if len(seq) else np.zeros(0, np.int64)
        tokens = np.add.reduceat(counts, starts) if len(seq) else np.zeros(0, np.int64)
        ends = np.cumsum(chars).tolist()
        self.leaves = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] or [""]
        n = len(self.leaves)
        self.width = 1 << (n - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + len(chars)] = chars
        self.tokens[self.width : self.width + len(tokens)] = tokens
        level = self.width
        while level > 1:
            half = level // 2
            for sums in (self.chars, self.tokens):
                sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half
        self.words = len(seq)

    def _split(self, text: str) -> list[str]:
        return split_words(text, self.enc)

    def _counts(self, words: list[str]) -> np.ndarray:
        self.encoded += len(words)
        return self.enc.counts(numbers(words, self.enc)) if words else np.zeros(0, np.int64)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def locate(self, place: int) -> tuple[int, int]:
        """The leaf of a character and where that leaf begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.chars[node])
            if place >= begin + left and self.chars[node + 1]:
                begin += left
                node += 1
        return node - self.width, begin

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.width
        more_chars, more_tokens = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, stop: int, insert: str) -> None:
        """One edit of the text as it stands."""
        start = max(0, min(start, self.length))
        self.apply([(start, max(start, min(stop, self.length)), insert)])

    def apply(self, edits: list[Edit]) -> None:
        """Edits without overlap, from the last to the first, all in places of the text as it stands before them.

        Edits whose leaves meet are made together, so that a leaf is encoded again once.
        """
        if not edits:
            return
        reach = max(map(len, self.enc.voc.special), default=0) if self.enc.cut else 0  # a special token may form over this many characters
        lows = [max(0, e[0] - 2 - reach) for e in edits]
        highs = [min(e[1] + reach, max(0, self.length - 1)) for e in edits]
        if len(edits) > 8:
            ends = np.cumsum(self.chars[self.width : self.width + len(self.leaves)])
            leaf = lambda places: np.minimum(np.searchsorted(ends, places, "right"), len(self.leaves) - 1).tolist()
            firsts, lasts = leaf(lows), leaf(highs)
        else:
            firsts, lasts = [self.locate(p)[0] for p in lows], [self.locate(p)[0] for p in highs]
        at = 0
        while at < len(edits):  # from the right, so places to the left stay
            end, first = at + 1, firsts[at]
            while end < len(edits) and lasts[end] >= first:
                first = min(first, firsts[end])
                end += 1
            self._remake(first, max(lasts[at:end]), edits[at:end][::-1])
            at = end

    def _remake(self, first: int, last: int, edits: list[Edit]) -> None:
        """Makes the edits (in order) in the leaves first to last and encodes these, and more up to a common border."""
        node, begin = first + self.width, 0
        while node > 1:
            if node % 2:
                begin += int(self.chars[node - 1])
            node //= 2
        body, done, parts = "".join(self.leaves[first : last + 1]), begin, []
        for start, stop, insert in edits:
            parts += [body[done - begin : start - begin], insert]
            done = stop
        body = "".join(parts) + body[done - begin :]
        n = len(self.leaves)
        reach = max(map(len, self.enc.voc.special), default=0) if self.enc.cut else 0
        while True:
            ahead, k = "", last + 1
            while k < n and len(ahead) < 4 + reach:
                ahead += self.leaves[k]
                k += 1
            words = self._split(body + ahead)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            at = int(np.searchsorted(ends, len(body)))
            if not ahead or not body or (at < len(ends) and ends[at] == len(body)):
                break
            last += 1
            body += self.leaves[last]
        kept = words[: at + 1] if ahead and body else (words if not ahead else [])
        counts = self._counts(kept)
        leaves = last - first + 1
        cuts = [len(kept) * k // leaves for k in range(leaves + 1)]  # dealt out evenly, so that no leaf grows
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            self._set(first + k, "".join(kept[a:b]), int(counts[a:b].sum()))

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def ordered(edits: list[Edit | None] | None, length: int) -> list[Edit]:
    """Usable edits from the last to the first, without overlap."""
    usable = [(max(0, min(e[0], length)), max(0, min(e[1], length)), e[2] or "") for e in edits or [] if e and e[0] is not None and e[1] is not None]
    out, bound = [], length
    for start, stop, insert in sorted(usable, key=lambda e: (-e[0], -e[1], e[2])):
        stop = min(max(start, stop), bound)
        if start <= stop:
            out.append((start, stop, insert))
            bound = start
    return out


# Fixed values of the query's edits: runs of marks go; addresses, keys and long numbers are masked.
_MARKS = re.compile(r"[$%&*#!]{2,}")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\b(?=[a-f]*[0-9])[0-9a-f]{32,}\b|\+?\d[\d ().-]{7,}\d")


def cleaning_edits(text: str) -> list[Edit]:
    found = [(m.start(), m.end(), "") for m in _MARKS.finditer(text)]
    if "@" in text:
        found += [(m.start(), m.end(), "<MAIL>") for m in _MAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "<NUM>") for m in _NUMBER.finditer(text)]
    return found


OUTPUTS = ["n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded"]


def recount(df: DataFrame, path: str | None = None, text: str = "text", edits: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with the counts before and after its edits.

    edits names a column array<struct<start int, stop int, insert string>>; without one the edits
    of cleaning_edits are made. n_reencoded counts the pre-tokens that edits made it encode again.
    """
    path = path or bpe.default_path()
    keep = [c for c in (df.columns if keep is None else keep) if c not in OUTPUTS]
    at = len(keep)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__hm_text"), *([F.col(f"`{edits}`").alias("__hm_edits")] if edits else []))
    schema = T.StructType([*source.schema.fields[:at], *(T.StructField(c, T.LongType(), False) for c in OUTPUTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for batch in batches:
            for first, stop in bpe.portions(batch.column(at), bpe.MERGE_BYTES):
                if len(enc.number) > bpe.KEEP_WORDS:
                    enc.clear()
                part = batch.slice(first, stop - first)
                texts = [t or "" for t in part.column(at).to_pylist()]
                given = part.column(at + 1).to_pylist() if edits else None
                splits = [numbered(t, enc) for t in texts]
                enc.tables()  # all words of the portion get their ids together
                rows = []
                for i, t in enumerate(texts):
                    tree = TokenTree(t, enc, splits[i])
                    before = tree.total
                    asked = cleaning_edits(t) if given is None else [e and (e["start"], e["stop"], e["insert"]) for e in given[i] or []]
                    todo = ordered(asked, len(t))
                    tree.apply(todo)
                    rows.append((before, len(todo), tree.total, tree.words, tree.encoded))
                columns = np.array(rows, np.int64).reshape(-1, len(OUTPUTS))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(at)), *(pa.array(columns[:, k]) for k in range(len(OUTPUTS)))], names=[*keep, *OUTPUTS])
        enc.clear()

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    return recount(docs, keep=["doc_id"])
