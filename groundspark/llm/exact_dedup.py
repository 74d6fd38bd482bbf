"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. Each has a 64-bit key. A directory of
pointers, indexed by a key's first bits, doubles while it has an overfull bucket that it must split;
its cells are counts, never keys, so it has at most 2^MOST_DEPTH entries. Each map task first folds
its own copies together, so that a hot text reaches its bucket once for each task. The directory is cut
into as many ranges as there are owner tasks, with about as many keys each; an owner reads the buckets
of its key range in order, chains texts that share a key and compares
their bytes. The index (bucket, key, digest, largest doc_id, size) is a table in the shared folder, a
file for each owner's range; each document goes through the directory to its bucket and looks itself up there.

Defined results: null counts as empty; a null doc_id is smaller than all others; rows that share a
doc_id are one document and each is reported; an empty table gives an empty table; further columns
are ignored; texts of any length are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fan_out, in_slices, one_of_each, small_batches, table, written

MOST_DEPTH = 20
#: Keys a bucket holds before it splits: this many, or a share of all keys where that is more.
BUCKET_KEYS, BUCKET_SHARE = 256, 1 / (1 << 17)
#: Bytes of distinct texts that a map task folds together before it passes them on.
FOLD_BYTES = 8 << 20


class Directory:
    """Pointers from the first bits of a key to a bucket."""

    def __init__(self, cells: np.ndarray, capacity: int):
        """``cells``: number of keys for each prefix of log2(len(cells)) bits."""
        most = len(cells).bit_length() - 1
        sums = np.concatenate(([0], np.cumsum(cells)))
        self.depth, self.pointers, self.local = 0, np.zeros(1, np.int32), [0]
        full = [(0, 0)] if sums[-1] > capacity else []  # (prefix, bucket), the bucket's depth is in local
        while full and self.local[full[-1][1]] < most:
            prefix, bucket = full.pop()
            if (depth := self.local[bucket]) == self.depth:
                self.pointers, self.depth = np.repeat(self.pointers, 2), self.depth + 1
            new = len(self.local)
            self.local[bucket] = depth + 1
            self.local.append(depth + 1)
            width = 1 << (self.depth - depth - 1)
            at = (2 * prefix + 1) * width
            self.pointers[at : at + width] = new
            for half, of in ((2 * prefix, bucket), (2 * prefix + 1, new)):
                shift = most - depth - 1
                if depth + 1 < most and sums[(half + 1) << shift] - sums[half << shift] > capacity:
                    full.append((half, of))

        self.starts = np.flatnonzero(np.diff(self.pointers, prepend=-1))  # a bucket's slots stand side by side
        before = sums[self.starts << (most - self.depth)]
        self.share = np.empty(len(self.local))
        self.share[self.pointers[self.starts]] = before / max(1, sums[-1])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(keys), np.int64)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return self.pointers[self.slot(keys)]

    def owner(self, buckets: np.ndarray, owners: int) -> np.ndarray:
        """The owner task of each bucket: the tasks' key ranges follow each other, a bucket is in one."""
        return np.minimum((self.share[buckets] * owners).astype(np.int32), owners - 1)


def normalised(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z only


def members(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text as it is), key, digest (SHA-256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 2 << 20):
            texts = [normalised(t) for t in batch.column("text").to_pylist()]
            keys = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "text_key", "key", "digest"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, key long, digest binary")


def directory(rows: DataFrame) -> Directory:
    """From the number of distinct keys for each prefix: at most 2^MOST_DEPTH rows reach the driver."""
    cells = rows.groupBy("key").agg(F.lit(1).alias("one")).groupBy(F.shiftrightunsigned("key", 64 - MOST_DEPTH).alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(1 << MOST_DEPTH, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return Directory(counts, max(BUCKET_KEYS, int(counts.sum() * BUCKET_SHARE)))


ENTRY = ["owner", "bucket", "key", "last", "n", "text"]


def placed(rows: DataFrame, through: Directory) -> DataFrame:
    """``rows``, as from ``members``, with the bucket that the directory names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = through.bucket(batch.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], [*batch.schema.names, "bucket"])

    return rows.mapInArrow(run, "doc_id long, text_key long, key long, digest binary, bucket int")


def folded(docs: DataFrame, through: Directory, owners: int) -> DataFrame:
    """One entry for each distinct text of a task: owner, bucket, key, largest doc_id, number of rows, normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = np.array([xxhash.xxh3_64_intdigest(t) for t in held], np.uint64)
            last, n = zip(*held.values(), strict=True)
            bucket = through.bucket(keys)
            return pa.RecordBatch.from_arrays([pa.array(through.owner(bucket, owners), pa.int32()), pa.array(bucket, pa.int32()), pa.array(keys.view(np.int64)), pa.array(last, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.binary())], ENTRY)

        for batch in in_slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), map(normalised, batch.column("text").to_pylist()), strict=True):
                if (own := held.get(text)) is None:
                    held[text] = [doc, 1]
                    size += len(text) + 100
                else:
                    own[0] = doc if own[0] is None else own[0] if doc is None else max(doc, own[0])
                    own[1] += 1
            if size > FOLD_BYTES:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "owner int, bucket int, key long, last long, n long, text binary")


def index(entries: DataFrame, owners: int) -> DataFrame:
    """bucket, key, digest, keep_id, group_size of every distinct text, by the owner tasks of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: dict[bytes, list] = {}  # texts of one key; as a dict of bytes it compares them whole
        at = None
        done: list[tuple] = []

        def close() -> None:
            done.extend((*at, hashlib.sha256(t).digest(), last, n) for t, (last, n) in chain.items())
            chain.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "key", "digest", "keep_id", "group_size"])

        for batch in batches:
            for bucket, key, last, n, text in zip(*(batch.column(c).to_pylist() for c in ENTRY[1:]), strict=True):
                if (bucket, key) != at:
                    close()
                    at = bucket, key
                if (own := chain.get(text)) is None:
                    chain[text] = [last, n]
                else:
                    own[0] = last if own[0] is None else own[0] if last is None else max(last, own[0])
                    own[1] += n
            if done:
                yield out()
                done.clear()
        close()
        if done:
            yield out()

    owned = entries.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "key")
    return owned.mapInArrow(run, "bucket int, key long, digest binary, keep_id long, group_size long")


def looked_up(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest, keep_id, group_size of each row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows, owners = written(members(docs), "dedup-members"), fan_out(docs.sparkSession)
    through = directory(rows)
    found = written(index(folded(docs, through, owners), owners), "dedup-index")
    return placed(rows, through).join(found, ["bucket", "key", "digest"]).select("doc_id", "text_key", "digest", "keep_id", "group_size")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    return looked_up(docs).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in doc_id and normalised text one."""
    same = looked_up(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "digest", "text_key").agg(F.count(F.lit(1)).alias("n"))
    kept = same.groupBy("doc_id", "digest").agg(F.min(F.struct("text_key", "n")).alias("k")).select("doc_id", "k.text_key", "k.n")
    return one_of_each(docs, written(kept, "dedup-kept"), [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


#: translate() lower-cases A-Z only.
OP3_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
