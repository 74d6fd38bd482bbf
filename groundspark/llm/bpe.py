"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

The symbols of all words that a batch meets for the first time lie in one flat array. In each
round the ranks of neighbouring pairs are found by binary search over the sorted pair keys, the
lowest-rank pair of every word is merged wherever it occurs in the word (leftmost first), and
only the pairs beside a merge are looked up again. A word with no mergeable pair left leaves the
array. Merging all occurrences at once equals merging one at a time, as a pair with a merged
symbol always has a higher rank than the merge that made the symbol.

Defined results: null and empty texts have no ids; a text of any length is encoded whole;
repeated rows give repeated results; an empty table gives an empty table; further columns of the
input are kept, and an input column named like an output column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import in_slices, ragged, small_batches, table

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: White space of Unicode (the White_Space property), fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words kept per worker, and their characters; the store is emptied when it is full, which costs time and changes no result.
STORE_WORDS, STORE_CHARS = 200_000, 32 << 20
NEVER = np.int64(1 << 40)

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of every code point, made once per worker."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        found[WHITE] = SPACE
        _classes = found
    return _classes


def word_starts(text: str, segment_starts: np.ndarray) -> np.ndarray:
    """Where the words of byte-level BPE start in a joined text; no word crosses a segment's start.

    Equals splitting with ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = char_classes()[points]
    first = np.zeros(n, bool)
    first[segment_starts[segment_starts < n]] = True
    first[0] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    gap_before = np.zeros(n, bool)
    gap_before[1:] = (points[:-1] == 0x20) & ~first[1:]
    start = run & (space | ~gap_before)
    start[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
    quote = np.flatnonzero((points == 0x27) & start & run)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        two[first[np.minimum(quote + 2, n - 1)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + size
        rest = rest[rest < n]
        start[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(start)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    named = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [named[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file (the JSON form of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        ids: dict[str, int] = said["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = np.array([ids[c] for c in symbols], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in said["model"]["merges"]]
        keys = np.array([(ids[a] << 24) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*ids.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, k in ids.items():
            pieces[k] = bytes(back[c] for c in token) if token not in self.special else token.encode()
        for token, k in self.special.items():
            pieces[k] = token.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 24) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        same = np.empty(len(word), bool)  # whether the next symbol is of the same word
        same[:-1] = word[1:] == word[:-1]
        if len(same):
            same[-1] = False
        rank = np.full(len(word), NEVER)
        at = np.flatnonzero(same)
        rank[at] = self.rank_of(symbol[at], symbol[at + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(begins, len(word)))
            low = np.minimum.reduceat(rank, begins)
            least = np.repeat(low, lengths)
            ended = least == NEVER
            if ended.any():
                done.append((word[ended], symbol[ended]))
                go = ~ended
                word, symbol, rank, least = word[go], symbol[go], rank[go], least[go]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == least)
            run_at = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1)))
            if len(run_at) < len(hit):  # a pair beside the one before overlaps with it: every second one of such a run stays
                place = np.arange(len(hit)) - np.repeat(run_at, np.diff(np.append(run_at, len(hit))))
                hit = hit[place % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            keep = np.ones(len(word), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            spots = moved[hit]
            beside = np.zeros(len(word), bool)
            beside[spots] = True
            beside[spots[spots > 0] - 1] = True
            again = np.flatnonzero(beside)
            last = again == len(word) - 1
            rank[again[last]] = NEVER
            again = again[~last]
            inside = word[again] == word[again + 1]
            rank[again[~inside]] = NEVER
            again = again[inside]
            rank[again] = self.rank_of(symbol[again], symbol[again + 1])
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.int32), np.bincount(of, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        joined = self.piece_bytes[ragged(self.piece_at[ids], self.piece_len[ids])].tobytes()
        return joined.decode("utf-8", "replace").encode()


class WordStore:
    """Ids of the words seen so far, in flat arrays; ``encode_words`` gives those of new words."""

    def __init__(self, encode_words, special: dict[str, int], split: re.Pattern | None, most: int = STORE_WORDS):
        self.encode_words, self.special, self.split, self.most = encode_words, special, split, most
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.chars = 0
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def add(self, words: list[str], first: int) -> None:
        ids, sizes = self.encode_words(words)
        self.chars += sum(map(len, words))
        self.put(ids, sizes, first)

    def put(self, ids: np.ndarray, sizes: np.ndarray, first: int) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while first + len(sizes) > len(self.at):
            self.at, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.at, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(sizes)] = sizes
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        if len(self.code) > self.most or self.chars > STORE_CHARS:
            self.clear()
        segments, owner = texts, None
        marks: dict[int, int] = {}
        if self.split is not None and any(any(s in t for s in self.special) for t in texts):
            segments, owner = [], []
            for k, t in enumerate(texts):
                for j, part in enumerate(self.split.split(t)):
                    if part:
                        if j % 2:
                            marks[len(segments)] = self.special[part]
                        segments.append(part)
                        owner.append(k)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        begins = np.cumsum(lengths) - lengths
        joined = "".join(segments)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        starts = word_starts(joined, begins)
        if marks:  # a marked segment is one word
            inside = np.searchsorted(begins, starts, "right") - 1
            starts = starts[~np.isin(inside, list(marks)) | np.isin(starts, begins)]
        ends = np.append(starts[1:], len(joined))
        known = self.code
        first = len(known)
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if marks:
            special_at = set(begins[list(marks)].tolist())
            words = [("\0special", w) if a in special_at else w for a, w in zip(starts.tolist(), words, strict=True)]
        codes = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
        if len(known) > first:
            fresh, seen = [], first
            for w in known_after(known, first):
                if isinstance(w, tuple):
                    if fresh:
                        self.add(fresh, seen)
                        seen += len(fresh)
                        fresh = []
                    self.put(np.array([self.special[w[1]]], np.int32), np.ones(1, np.int64), seen)
                    seen += 1
                else:
                    fresh.append(w)
            if fresh:
                self.add(fresh, seen)
        sizes = self.size[codes]
        ids = self.ids[ragged(self.at[codes], sizes)]
        total = np.concatenate(([0], np.cumsum(sizes)))
        per_segment = total[np.searchsorted(starts, begins + lengths)] - total[np.searchsorted(starts, begins)]
        if owner is not None:
            per_segment = np.bincount(np.array(owner, np.int64), per_segment, len(texts)).astype(np.int64)
        return ids, per_segment


def known_after(known: dict, first: int) -> list:
    """The entries of an insertion-ordered dict from number ``first`` on."""
    fresh = []
    for w in reversed(known):
        if len(fresh) == len(known) - first:
            break
        fresh.append(w)
    return fresh[::-1]


def vocabulary_path(name: str) -> str:
    """``name`` itself where it is a file, else a file of the public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_made: dict[str, tuple[Vocabulary, WordStore]] = {}


def encoder(name: str) -> tuple[Vocabulary, WordStore]:
    """The vocabulary and its word store, once per worker."""
    if name not in _made:
        vocabulary = Vocabulary(vocabulary_path(name))
        _made[name] = vocabulary, WordStore(vocabulary.merge, vocabulary.special, vocabulary.split)
    return _made[name]


def encode(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as a binary column of little-endian unsigned 32-bit integers."""
    small_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name != ids]).add(ids, T.BinaryType())
    kept = [f.name for f in schema if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, store = encoder(vocabulary)
        for batch in in_slices(batches, text, 1 << 20):
            found, counts = store.encode(["" if t is None else t for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), id_bytes(found, counts)], [*kept, ids])

    return df.mapInArrow(run, schema)


def id_bytes(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary Arrow column over the flat ids."""
    at = np.concatenate(([0], np.cumsum(counts * 4))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


def decode(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that each row's ids stand for."""
    schema = T.StructType([f for f in df.schema if f.name != text]).add(text, T.StringType())
    kept = [f.name for f in schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = encoder(vocabulary)
        for batch in batches:
            texts = [words.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)).decode() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256, encoding and decoding in one pass."""
    extra = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    small_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name not in extra])
    kept = list(schema.names)
    for name, kind in extra.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, store = encoder(vocabulary)
        for batch in in_slices(batches, text, 1 << 20):
            ids, counts = store.encode(["" if t is None else t for t in batch.column(text).to_pylist()])
            raw = ids.astype("<u4").tobytes()
            ends = np.cumsum(counts).tolist()
            ids_sha, text_sha = [], []
            sizes = words.piece_len[ids]
            joined = words.piece_bytes[ragged(words.piece_at[ids], sizes)].tobytes()
            byte_ends = np.concatenate(([0], np.cumsum(sizes)))
            begin = 0
            for end in ends:
                ids_sha.append(hashlib.sha256(raw[4 * begin : 4 * end]).hexdigest())
                decoded = joined[byte_ends[begin] : byte_ends[end]].decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                begin = end
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts.astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def pipeline_stage(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: the documents' columns and n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs)
