"""Operator 6: byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie in one array of symbols. An index maps each pair that has a
merge to all its positions there. The lowest active rank is taken first, all its positions are
merged together, and the lists of the pairs that this breaks or makes are updated. A word never
waits for another word, so ascending order over all words gives each word its own merge order.

Rows: null text is empty text (no ids). Empty text has no ids. Text of any length is encoded
whole. Repeated rows are encoded each. An empty table gives an empty table. Other columns pass
through; a column that clashes with an output name is replaced by the output.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts whose characters are all letters, decimal digits, marks or spaces to both expression engines.
PLAIN = r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Any other character: numerals that are no decimal digits, and what lies beyond Latin and general punctuation.
OTHER = "[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]"
#: Bytes split and merged at a time, bytes expanded to ids at a time, and distinct words kept; they bound memory and change no result.
MERGE_BYTES, CHUNK_CHARS, KEEP_WORDS = 6_000_000, 1_500_000, 250_000
SHIFT = 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, count(0x100)
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(next(extra))
    return out


class Vocabulary:
    """Tables of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = _byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = (left << SHIFT) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        tokens |= {i: s.encode() for s, i in self.special.items()}
        n = max(tokens) + 1
        parts = [tokens.get(i, b"") for i in range(n)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.pool = np.frombuffer(b"".join(parts), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has no merge."""
        key = (a.astype(np.int64) << SHIFT) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the slices [start, start + size), one after another."""
    total = int(size.sum())
    shift = start - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(total)


def merge_words(voc: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and how many each has."""
    sizes = np.array([len(w) for w in words], np.int64)
    sym = voc.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    ends = np.cumsum(sizes)
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[ends[sizes > 0] - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[(ends - sizes)[sizes > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = defaultdict(list)  # rank of a pair -> its positions
    heap: list[int] = []

    def add(pos: np.ndarray) -> None:
        r = voc.rank(sym[pos], sym[nxt[pos]])
        pos, r = pos[r >= 0], r[r >= 0]
        if not len(pos):
            return
        order = np.argsort(r, kind="stable")
        pos, r = pos[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(pos, cuts) if len(cuts) else [pos], strict=True):
            if rank not in index:
                heapq.heappush(heap, rank)
            index[rank].append(part)

    add(np.flatnonzero(nxt >= 0).astype(np.int32))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        pos = np.concatenate(lists) if len(lists) > 1 else lists[0]
        a, b, made = voc.left[rank], voc.right[rank], voc.made[rank]
        right = nxt[pos]
        ok = alive[pos] & (right >= 0)
        ok &= (sym[pos] == a) & (sym[right] == b)
        pos, right = pos[ok], right[ok]
        if not len(pos):
            continue
        if a == b and len(pos) > 1:  # of overlapping occurrences every second one, from the left
            order = np.argsort(pos)
            pos, right = pos[order], right[order]
            fresh = np.concatenate([[True], pos[1:] != right[:-1]])
            first = np.flatnonzero(fresh)
            nth = np.arange(len(pos)) - first[np.cumsum(fresh) - 1]
            keep = nth % 2 == 0
            pos, right = pos[keep], right[keep]
        after = nxt[right]
        sym[pos] = made
        alive[right] = False
        nxt[pos] = after
        prv[after[after >= 0]] = pos[after >= 0]
        before = prv[pos]
        left = before[before >= 0]
        left = left[sym[left] != made]  # one that is merged too is in pos
        twins = before[(before >= 0)]
        twins = twins[sym[twins] == made]
        if len(twins):
            left = np.concatenate([left, np.setdiff1d(twins, pos)])
        add(np.concatenate([left, pos[after >= 0]]))
    owner = np.repeat(np.arange(len(words)), sizes)[alive]
    return sym[alive], np.bincount(owner, minlength=len(words)).astype(np.int64)


class WordEncoder:
    """Numbers words as they first come; holds the ids of all numbered words."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.wide, self.plain, self.other = regex.compile(PATTERN).findall, re.compile(PLAIN).findall, re.compile(OTHER).search
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in voc.special) + ")").split if voc.special else None
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.done = 0
        self.ids, self.size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.start = np.zeros(0, np.int64)

    def find(self, text: str) -> list[str]:
        return self.wide(text) if self.other(text) else self.plain(text)

    def sequence(self, text: str) -> np.ndarray:
        """The numbers of the words of a text; -1 - id for a special token."""
        number = self.number.__getitem__
        if self.cut and "<" in text and any(s in text for s in self.voc.special):
            out: list[int] = []
            for k, part in enumerate(self.cut(text)):
                out.extend([-1 - self.voc.special[part]] if k % 2 else map(number, self.find(part)))
            return np.array(out, np.int32)
        return np.array(list(map(number, self.find(text))), np.int32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each word's ids in the pool of ids, and that pool; specials follow from the end."""
        if len(self.number) > self.done:
            from itertools import islice

            new = [w.encode() for w in islice(self.number, self.done, None)]
            ids, size = merge_words(self.voc, new)
            self.ids, self.size = [np.concatenate([*self.ids, ids])], [np.concatenate([*self.size, size])]
            self.done = len(self.number)
            self.start = np.cumsum(self.size[0]) - self.size[0]
        return self.start, self.size[0], self.ids[0]

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Ids of a sequence of word numbers."""
        start, size, pool = self.tables()
        special = seq < 0
        if special.any():
            word = np.where(special, 0, seq)
            n = np.where(special, 1, size[word] if len(size) else 1)
            out = np.empty(int(n.sum()), np.int32)
            at = np.cumsum(n) - n
            out[at[special]] = -1 - seq[special]
            plain = seq[~special]
            if len(plain):
                out[ragged(at[~special], n[~special])] = pool[ragged(start[plain], size[plain])]
            return out
        return pool[ragged(start[seq], size[seq])]

    def counts(self, seq: np.ndarray) -> np.ndarray:
        """How many ids each word of a sequence has."""
        _, size, _ = self.tables()
        return np.where(seq < 0, 1, size[np.maximum(seq, 0)] if len(size) else 1).astype(np.int64)


_LOADED: dict[str, tuple[Vocabulary, WordEncoder]] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    if path not in _LOADED:
        voc = Vocabulary(path)
        _LOADED[path] = voc, WordEncoder(voc)
    return _LOADED[path][1]


def portions(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about `most` bytes."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = begin = 0
    total = 0
    for at, x in enumerate(n):
        if total and total + x > most:
            yield begin, at
            begin, total = at, 0
        total += x
    if len(n):
        yield begin, len(n)


def encoded(enc: WordEncoder, texts: pa.Array) -> Iterator[tuple[int, int, pa.ListArray]]:
    """Consecutive rows first to last and the ids of their texts."""
    for first, last in portions(texts, MERGE_BYTES):
        if len(enc.number) > KEEP_WORDS:
            enc.clear()
        some = texts.slice(first, last - first)
        seqs = [enc.sequence(t) if (t := x.as_py()) else np.zeros(0, np.int32) for x in some]
        enc.tables()
        for a, b in portions(some):
            flat = np.concatenate(seqs[a:b])
            edge = np.cumsum([0, *map(len, seqs[a:b])])
            total = np.concatenate([[0], np.cumsum(enc.counts(flat))])[edge]
            yield first + a, first + b, pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(enc.expand(flat), pa.int32()))


def decoded(voc: Vocabulary, lists: pa.ListArray) -> list[str]:
    """The texts of lists of ids."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    begin, cuts, out = 0, [0], []
    for i, total in enumerate(np.cumsum(sizes)):
        if total - begin > CHUNK_CHARS // 2:
            cuts.append(i + 1)
            begin = total
    if cuts[-1] < len(sizes):
        cuts.append(len(sizes))
    for a, b in zip(cuts, cuts[1:], strict=False):
        flat = lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
        size = voc.size[flat]
        raw = voc.pool[ragged(voc.start[flat], size)].tobytes()
        last = 0
        for e in np.concatenate([[0], np.cumsum(size)])[np.cumsum(sizes[a:b])].tolist():
            out.append(raw[last:e].decode("utf-8", "replace"))
            last = e
    return out


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the ids of each whole text as array<int>."""
    return _passed(df, path, text, ids, keep, None)


def encode_decode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded_as: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encode, and decode of its ids, in one pass: one Python worker a task holds one vocabulary."""
    return _passed(df, path, text, ids, keep, decoded_as)


def _passed(df: DataFrame, path: str | None, text: str, ids: str, keep: list[str] | None, decoded_as: str | None) -> DataFrame:
    path = path or default_path()
    small_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in (ids, decoded_as)]
    at = len(keep)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__hm_text"))
    made = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded_as:
        made.append(T.StructField(decoded_as, T.StringType(), False))
    names = [*keep, *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b, lists in encoded(enc, batch.column(at)):
                own = [lists, pa.array(decoded(enc.voc, lists), pa.string())] if decoded_as else [lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(at)), *own], names=names)
        enc.clear()  # a worker lives on and may serve other operators

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:at], *made]))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of the ids; bytes that are no UTF-8 become U+FFFD; null ids give empty text."""
    path = path or default_path()
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text]
    at = keep.index(ids)
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*source.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = encoder(path).voc
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded(voc, batch.column(at)), pa.string())], names=[*keep, text])

    return source.mapInArrow(run, schema)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text for each document."""
    coded = encode_decode(df, path, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
