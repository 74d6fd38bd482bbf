"""Token ids in compressed files: canonical, length-limited Huffman codes from global counts.

Format. A table of blocks (Parquet rows, so that Spark's commit protocol guards them) and a code
book. A block holds whole documents in ascending doc_id order: their ids and token counts, the bit
length of every id's code word one after the other (most significant bit first) in ``payload``,
and ``checkpoints``, the bit offset of every ``CHECKPOINT``-th id. Blocks decode on their own;
inside a block all stretches between checkpoints decode side by side from one table of
2^``MOST_BITS`` entries. The code book has the code length of each id that occurs; codes are
canonical (by length, then id).

Defined results: a null or empty text is a document with only the end id; null doc_ids come first;
rows that share a doc_id lie side by side, ordered by a hash of the text, and may be parted by a file's end; very long documents make a block of
their own; an empty table gives an empty table and an empty code book; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, fan_out, in_slices, mix64, shared_path, small_batches, table, written
from .bpe import STORE_CHARS, WordStore, ragged, vocabulary_path, word_starts

MOST_BITS = 16
CHECKPOINT = 128
BLOCK_IDS = 1 << 17
END_ID = 2

CHUNKS = "part int, start_in_part long, doc_ids array<long>, sizes array<long>, ids binary"
BLOCKS = "part int, start_in_part long, doc_ids array<long>, sizes array<long>, n_bits long, checkpoints array<int>, payload binary"

#: Words kept per worker: the library is asked for each new one.
STORE_WORDS = 1_200_000
#: Places of the table in which words are found by their hash.
SLOT_BITS = 22
#: Bases of the two polynomial hashes modulo 2^64 (odd, one of them plus twice an odd number), and from how many code points on a word is hashed on its own.
BASES = (0x9E3779B97F4A7C17, 0xD1342543DE82EF97)
LONG_WORD = 512
_stores: dict[str, HashedStore] = {}


class HashedStore(WordStore):
    """Ids of the words seen so far, found by hash: no string is made of a word that was seen before.

    All words of a batch get two polynomial hashes from running sums over its code points. The first leads to a slot of an
    open table, the second must agree too.
    """

    def __init__(self, encode_words: Callable, encode_text: Callable, special: dict[str, int], most: int = STORE_WORDS):
        self.encode_text = encode_text
        self.powers = [self.power(base, 1 << 16) for base in BASES]
        super().__init__(encode_words, special, None, most)

    @staticmethod
    def power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of ``base``, and of its inverse."""
        return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))

    def clear(self) -> None:
        super().clear()
        self.n = 0
        self.key, self.number = np.zeros(1 << SLOT_BITS, np.uint64), np.empty(1 << SLOT_BITS, np.int32)  # key 0: free
        self.check = np.empty(1 << 14, np.uint64)

    def hashes(self, joined: str, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(points) > len(self.powers[0][0]):
            self.powers = [self.power(base, 2 * len(points)) for base in BASES]
        sizes = ends - starts
        out = []
        long_ = np.flatnonzero(sizes > LONG_WORD)
        with np.errstate(over="ignore"):
            for k, (up, down) in enumerate(self.powers):
                total = np.zeros(len(points) + 1, np.uint64)
                np.cumsum(points * up[: len(points)], out=total[1:])
                own = mix64((total[ends] - total[starts]) * down[starts] + sizes.astype(np.uint64) * np.uint64(BASES[1 - k]))
                for i in long_.tolist():
                    own[i] = xxhash.xxh64_intdigest(joined[starts[i] : ends[i]].encode(), seed=k)
                out.append(np.where(own == 0, np.uint64(1), own))
        return out

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those not seen."""
        out = np.full(len(first), -1)
        slot = (first & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        open_ = np.arange(len(first))
        while len(open_):
            held = self.key[slot[open_]]
            number = self.number[slot[open_]]
            same = held == first[open_]
            same[same] = self.check[number[same]] == second[open_[same]]
            out[open_[same]] = number[same]
            open_ = open_[~same & (held != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def insert(self, first: np.ndarray, second: np.ndarray) -> None:
        """Numbers from n on for words not seen."""
        while self.n + len(first) > len(self.check):
            self.check = np.concatenate((self.check, np.empty_like(self.check)))
        self.check[self.n : self.n + len(first)] = second
        slot = (first & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        open_ = np.arange(len(first))
        while len(open_):
            free = open_[self.key[slot[open_]] == 0]
            at, own = np.unique(slot[free], return_index=True)
            put = free[own]
            self.key[at], self.number[at] = first[put], self.n + put
            open_ = np.setdiff1d(open_, put, assume_unique=True)
            taken = self.key[slot[open_]] != 0
            slot[open_[taken]] = (slot[open_[taken]] + 1) & ((1 << SLOT_BITS) - 1)
        self.n += len(first)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has. Texts with special tokens are left to the library whole."""
        if self.n > self.most or self.chars > STORE_CHARS:
            self.clear()
        whole = {k for s in self.special for k, t in enumerate(texts) if s in t} if any(s in "".join(texts) for s in self.special) else set()
        segments = ["" if k in whole else t for k, t in enumerate(texts)] if whole else texts
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        begins = np.cumsum(lengths) - lengths
        joined = "".join(segments)
        if joined:
            starts = word_starts(joined, begins)
            ends = np.append(starts[1:], len(joined))
            hashed = self.hashes(joined, starts, ends)
            codes = self.find(*hashed)
            while len(new := np.flatnonzero(codes < 0)):
                one = new[np.sort(np.unique(hashed[0][new], return_index=True)[1])]
                self.add([joined[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], self.n)
                self.insert(*(h[one] for h in hashed))
                codes[new] = self.find(*(h[new] for h in hashed))
            sizes = self.size[codes]
            ids = self.ids[ragged(self.at[codes], sizes)]
            total = np.concatenate(([0], np.cumsum(sizes)))
            per_text = total[np.searchsorted(starts, begins + lengths)] - total[np.searchsorted(starts, begins)]
        else:
            ids, per_text = np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        if whole:
            ends = np.cumsum(per_text)
            parts = [np.array(self.encode_text(t), np.int32) if k in whole else ids[e - n : e] for k, (t, e, n) in enumerate(zip(texts, ends.tolist(), per_text.tolist(), strict=True))]
            ids, per_text = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, per_text


def library_store(name: str) -> HashedStore:
    """A word store filled by the tokenizers library, once per worker. Words are encoded by the library, each new one once."""
    if name not in _stores:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(vocabulary_path(name))
        made.no_truncation()
        made.no_padding()
        special = {t.content: k for k, t in made.get_added_tokens_decoder().items()}

        def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids: list[int] = []
            sizes = np.empty(len(words), np.int64)
            for at in range(0, len(words), 4096):
                for k, e in enumerate(made.encode_batch_fast(words[at : at + 4096], add_special_tokens=False), at):
                    ids += (own := e.ids)
                    sizes[k] = len(own)
            return np.array(ids, np.int32), sizes

        _stores[name] = HashedStore(encode_words, lambda t: made.encode(t, add_special_tokens=False).ids, special)
    return _stores[name]


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits, by package-merge over the sorted counts. Symbols with count 0 get none."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError("more symbols than code words of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(most):
        both = np.concatenate((coins, packages))
        ranked = np.argsort(both, kind="stable")
        levels.append(ranked < len(coins))
        paired = both[ranked][: len(both) // 2 * 2]
        packages = paired[::2] + paired[1::2]
    take = 2 * len(coins) - 2
    for is_coin in reversed(levels):
        own = int(is_coin[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code word of each symbol."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        sizes = lengths[order]
        steps = 1 << (MOST_BITS - sizes)
        codes[order] = (np.cumsum(steps) - steps) >> (MOST_BITS - sizes)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each MOST_BITS-bit window: the id whose code word it begins with, and that word's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    steps = 1 << (MOST_BITS - lengths[order])
    ids, sizes = np.zeros(1 << MOST_BITS, np.int32), np.ones(1 << MOST_BITS, np.int64)
    total = int(steps.sum())
    ids[:total], sizes[:total] = np.repeat(order, steps), np.repeat(lengths[order], steps)
    return ids, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """Number of bits, checkpoints and bytes of the code words of ``ids``."""
    if not len(ids):
        return 0, np.empty(0, np.int32), b""
    sizes = lengths[ids]
    ends = np.cumsum(sizes)
    at = ends - sizes
    wide = codes[ids].astype(np.uint64) << (64 - (at & 31) - sizes).astype(np.uint64)
    word = at >> 5
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    # Code words don't overlap, so sums are unions of their bits.
    out[word[begins]] += np.add.reduceat(wide >> np.uint64(32), begins)
    out[word[begins] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), begins)
    bits = int(ends[-1])
    return bits, at[::CHECKPOINT].astype(np.int32), out.astype(">u4").tobytes()[: (bits + 7) // 8]


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, ids_of: np.ndarray, sizes_of: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block; all stretches between checkpoints advance together, an id a step."""
    if not n:
        return np.empty(0, np.int32)
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    last = len(windows) - 1
    at = np.asarray(checkpoints, np.int64).copy()
    out = np.empty((CHECKPOINT, len(at)), np.int32)
    for k in range(CHECKPOINT):
        seen = (windows[np.minimum(at >> 3, last)] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[k] = ids_of[seen]
        at += sizes_of[seen]
    return out.T.reshape(-1)[:n]


def lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def encoded_chunks(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Sorted, encoded documents in chunks of about BLOCK_IDS ids. A chunk knows where it starts in its range of doc_ids."""
    rows = docs.withColumns({"text_key": F.xxhash64(F.col("text").cast("string")), "row": F.monotonically_increasing_id()})  # so that ranges part rows that share a doc_id, and equal ones
    ranged = rows.repartitionByRange(fan_out(docs.sparkSession), "doc_id", "text_key", "row").sortWithinPartitions("doc_id", "text_key", "row").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = library_store(vocabulary)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part, start, n = 0, 0, 0

        def chunk() -> pa.RecordBatch:
            ids, sizes, ids_of = (np.concatenate(x) for x in zip(*held, strict=True))
            wide = "<u2" if len(ids) == 0 or ids.max() < 1 << 16 else "<u4"
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([list(ids_of)], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([wide.encode() + ids.astype(wide).tobytes()], pa.binary())],
                ["part", "start_in_part", "doc_ids", "sizes", "ids"],
            )

        for batch in in_slices(batches, "text", 1 << 19):
            part = batch.column("part")[0].as_py()
            ids, sizes = store.encode(["" if t is None else t for t in batch.column("text").to_pylist()])
            full = np.empty(len(ids) + len(sizes), np.int32)
            ends = np.cumsum(sizes + 1) - 1
            full[ends] = end_id
            mask = np.ones(len(full), bool)
            mask[ends] = False
            full[mask] = ids
            held.append((full, sizes + 1, np.array(batch.column("doc_id").to_pylist(), object)))
            n += len(full)
            if n >= BLOCK_IDS:
                yield chunk()
                start, n, held = start + n, 0, []
        if n:
            yield chunk()

    return ranged.mapInArrow(run, CHUNKS)


def chunk_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, raw[:3].decode(), offset=3).astype(np.int64)


def global_counts(chunks: DataFrame) -> pd.DataFrame:
    """id, n over all chunks: at most as many rows as the vocabulary has entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                n = np.bincount(chunk_ids(raw.as_py()))
                if len(n) > len(total):
                    n, total = total, n.astype(np.int64)
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return chunks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()


class TokenFiles:
    """Where the blocks and the code book lie."""

    def __init__(self, spark: SparkSession, blocks: str, book: str):
        self.spark, self.blocks, self.book = spark, blocks, book

    def lengths(self) -> np.ndarray:
        """The code length of each id (0: does not occur)."""
        book = self.spark.read.schema("id long, bits int").parquet(self.book).toPandas()
        out = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.int64)
        out[book["id"]] = book["bits"]
        return out

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers), ids_crc32, decoded from the files."""
        blocks = self.spark.read.schema(BLOCKS).parquet(self.blocks)
        size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        parts = blocks.select("part", size.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")  # a row for each range
        offsets = dict(zip(parts["part"].tolist(), (parts["n"].cumsum() - parts["n"]).tolist(), strict=True))
        lengths = self.lengths()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_of, sizes_of = decoding_table(lengths)
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = np.array(row["sizes"], np.int64)
                    ends = np.cumsum(sizes)
                    raw = unpack(row["payload"], row["checkpoints"], int(ends[-1]), ids_of, sizes_of).astype("<u4").tobytes()
                    own = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"], pa.int64()), pa.array(offsets[row["part"]] + row["start_in_part"] + ends - sizes), pa.array(sizes), pa.array(own, pa.binary()), pa.array([zlib.crc32(x) for x in own], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                    )

        return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def write(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, path: str | None = None) -> TokenFiles:
    """Encode the whole texts of (doc_id, text) and write blocks and code book below ``path`` (default: the shared folder)."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-ids")
    small_batches(docs.sparkSession)
    chunks = written(encoded_chunks(docs.select("doc_id", "text"), vocabulary, end_id), "token-chunks", compression="zstd")
    counts = global_counts(chunks)
    n = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    n[counts["id"]] = counts["n"]
    lengths = code_lengths(n)
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column("ids")):
                bits, marks, payload = pack(chunk_ids(raw.as_py()), codes, lengths)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(k, 1) for c in ("part", "start_in_part", "doc_ids", "sizes")), pa.array([bits], pa.int64()), lists(marks, [len(marks)], pa.int32()), pa.array([payload], pa.binary())],
                    ["part", "start_in_part", "doc_ids", "sizes", "n_bits", "checkpoints", "payload"],
                )

    chunks.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(k), int(lengths[k])) for k in used], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    discard(chunks)
    return TokenFiles(spark, f"{path}/blocks", f"{path}/codes")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(table(spark, sf_dir, "documents")).read().select("doc_id", "start", "n_tokens", "ids_crc32")
