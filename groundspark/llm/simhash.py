"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints link at MOST_BITS or fewer differing bits. 64 bits make six blocks, and of two linked
fingerprints at least two blocks agree whole: the masked bit patterns of two blocks are the index's
upper nodes (buckets), 15 for each of the distinct fingerprints. Below, fingerprints lie in Gray order,
where neighbours share long bit patterns. A node over FAN entries holds the bits that all of these
share (as the AND and the OR of the entries); pairs of nodes are compared from the top down, the
differences in shared bits add up on the way, and a pair of nodes over the limit is dropped with all
below it. A task has one such hierarchy over all buckets that it was dealt, and finds every link
through it. A bucket of over TILE fingerprints is cut into tiles along its Gray order; tiles
are nodes too, with nodes above them, and Spark joins descend them in the same way: only pairs of tiles
within the limit are dealt out, however many tiles a bucket has. A task's links are
passed on as stars, so a group of n near copies gives no more than n links for each mask.

Defined results: a null or empty text has fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; a null doc_id links like any other, but never names a component unless all
of its documents are null; repeated rows share a component; an empty table gives an empty table; further
columns are ignored; every shingle of a text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fan_out, in_slices, one_of_each, small_batches, table, written
from .components import components

SEED = 42
SHINGLE_WORDS = 4
MOST_BITS = 4
WIDTHS = (11, 11, 11, 11, 10, 10)
TILE = 1024
FAN = 8
#: Shingles hashed at once.
BLOCK = 1 << 16


def _votes(hashes: list[int], counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, how many have each bit."""
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int32)


def fingerprint_texts(texts: list[str | None], k: int = SHINGLE_WORDS) -> np.ndarray:
    """A bit is set if over half of the text's shingle hashes have it."""
    digest = xxhash.xxh64_intdigest
    votes, totals = np.zeros((len(texts), 64), np.int32), np.zeros(len(texts), np.int32)
    hashes: list[int] = []
    rows: list[int] = []
    counts: list[int] = []

    def count() -> None:
        if hashes:
            np.add.at(votes, rows, _votes(hashes, np.array(counts)))
            np.add.at(totals, rows, counts)
            for x in (hashes, rows, counts):
                x.clear()

    for row, text in enumerate(texts):
        words = (text or "").encode().lower().split()  # both know ASCII only
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        del words
        last = ends[k - 1 :] if len(ends) > k else ends[-1:]
        begins = np.concatenate((np.zeros(1, np.int64), ends[: len(last) - 1] + 1))
        for at in range(0, len(last), BLOCK):
            own = [digest(joined[a:b], SEED) for a, b in zip(begins[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=True)]
            hashes += own
            rows.append(row)
            counts.append(len(own))
            if len(hashes) >= BLOCK:
                count()
    count()
    return np.packbits(2 * votes > totals[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp (64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fingerprint_texts(batch.column("text").to_pylist()).view(np.int64))], ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def text_key() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Where a bit pattern stands in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(shift))
    return fp


def gray_rank_column(fp):
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))  # so that signed order is unsigned order


def masks() -> list[int]:
    """For each pair of blocks, the bits of both."""
    blocks, at = [], 0
    for width in WIDTHS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class GrayIndex:
    """A hierarchy over groups of fingerprints, those of a group sorted by Gray rank."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """``group``: ascending numbers; only fingerprints of the same group are linked."""
        self.levels = [(fps, fps, group, group)]
        while len(self.levels[-1][0]) > 1:
            both, any_, first, last = self.levels[-1]
            at = np.arange(0, len(both), FAN)
            self.levels.append((np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at), first[at], last[np.minimum(at + FAN, len(last)) - 1]))

    def pairs(self, most: int = MOST_BITS, step: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places i < j of linked fingerprints, in portions; from the top down, whole nodes are dropped by the bits that differ for certain.

        Depth first, so that no more than a portion of ``step`` node pairs' children is held for each level.
        """

        def below(level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if level == 0:
                yield a, b
                return
            both, any_, first, last = self.levels[level - 1]
            for at in range(0, len(a), step):
                i = (a[at : at + step, None] * FAN + np.arange(FAN)).repeat(FAN, 1).ravel()
                j = np.tile(b[at : at + step, None] * FAN + np.arange(FAN), FAN).ravel()
                real = (j < len(both)) & ((i < j) if level == 1 else (i <= j))
                i, j = i[real], j[real]
                meet = last[i] >= first[j]
                i, j = i[meet], j[meet]
                apart = (both[i] & ~any_[j]) | (both[j] & ~any_[i])
                near = np.bitwise_count(apart) <= most
                if near.any():
                    yield from below(level - 1, i[near], j[near])

        yield from below(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))


def stars(n: int, portions: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the first place of its component."""
    root = np.arange(n)
    for i, j in portions:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != (next_ := root[root])).any():
                root = next_
    return root


def links_in_groups(group: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the same group as stars, found through one hierarchy. ``group``: ascending numbers, rows in Gray order inside."""
    root = stars(len(fp), GrayIndex(fp, group).pairs())
    moved = np.flatnonzero(root != np.arange(len(root)))
    return ids[moved], ids[root[moved]]


GROUP = ["mask", "bits", "near", "far"]


def bucket_links(dealt: DataFrame) -> DataFrame:
    """u, v from rows (mask, bits, near, far, gray, fp, id): each (mask, bits, near, far) is a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            *key, fp, ids = columns
            new = np.zeros(len(fp), bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            u, v = links_in_groups(np.cumsum(new), fp.view(np.uint64), ids)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in (*GROUP, "fp", "id")])
            n += batch.num_rows
            if n < 100_000:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.ones(n, bool)
            for c in columns[:4]:
                last &= c == c[-1]
            first = n - int(last.sum())  # the last group may go on
            if first:
                yield out([c[:first] for c in columns])
            held, n = [[c[first:] for c in columns]], n - first
        if n:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    ordered = dealt.repartition(fan_out(dealt.sparkSession), *GROUP).sortWithinPartitions(*GROUP, "gray")
    return ordered.select(*GROUP, "fp", "id").mapInArrow(run, "u long, v long")


def tiled(own: DataFrame) -> DataFrame:
    """mask, bits, gray, fp, id, part, tile: each bucket cut along its Gray order into tiles of TILE, numbered from 0 in each range of the order (part)."""
    ordered = own.repartitionByRange(fan_out(own.sparkSession), "mask", "bits", "gray").sortWithinPartitions("mask", "bits", "gray")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, bits = (batch.column(c).to_numpy() for c in ("mask", "bits"))
            new = np.concatenate(([(mask[0], bits[0]) != bucket], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))
            begin = np.flatnonzero(new)
            place = np.arange(len(mask)) + (0 if new[0] else seen)
            run_of = np.cumsum(new) - 1
            if len(begin):
                place = np.where(run_of >= 0, np.arange(len(mask)) - begin[np.maximum(run_of, 0)], place)
            bucket, seen = (mask[-1], bits[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place // TILE)], [*batch.schema.names, "tile"])

    rows = ordered.select("mask", "bits", "gray", "fp", "id", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "mask byte, bits long, gray long, fp long, id long, part int, tile long")


def near_tiles(tiles: DataFrame) -> DataFrame:
    """mask, bits, near, far: pairs of a bucket's tiles, as (part, tile) packed into a number, that may hold linked fingerprints; found from the top nodes down."""
    spark, node = tiles.sparkSession, ["mask", "bits", "part", "tile"]
    nodes = [written(tiles.groupBy(*node).agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")), "simhash-nodes")]
    most = nodes[0].agg(F.max("tile")).head()[0]
    while most:
        most //= FAN
        below = nodes[-1].withColumn("tile", F.floor(F.col("tile") / FAN))
        nodes.append(written(below.groupBy(*node).agg(F.bit_and("all").alias("all"), F.bit_or("any").alias("any")), "simhash-nodes"))

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("mask", "bits", *(F.col(c).alias(f"{c}_{s}") for c in ("part", "tile", "all", "any")))

    apart = F.bit_count(F.expr("(all_a & ~any_b) | (all_b & ~any_a)"))
    ordered = F.struct("part_a", "tile_a") <= F.struct("part_b", "tile_b")
    pair = ["mask", "bits", "part_a", "tile_a", "part_b", "tile_b"]
    # A bucket has at most one top node in each range of the order.
    pairs = side(nodes[-1], "a").join(side(nodes[-1], "b"), ["mask", "bits"]).filter(ordered & (apart <= MOST_BITS)).select(*pair)
    for level in nodes[-2::-1]:
        pairs = written(pairs, "simhash-node-pairs")
        for s in ("a", "b"):
            children = side(level, s).withColumn("_up", F.floor(F.col(f"tile_{s}") / FAN))
            pairs = pairs.withColumnRenamed(f"tile_{s}", "_up").join(children, ["mask", "bits", f"part_{s}", "_up"]).drop("_up")
        pairs = pairs.filter(ordered & (apart <= MOST_BITS)).select(*pair)
    return pairs.select("mask", "bits", *(packed(f"part_{s}", f"tile_{s}").alias(c) for s, c in (("a", "near"), ("b", "far"))))


def packed(part: str, tile: str) -> F.Column:
    return F.shiftleft(F.col(part).cast("long"), 40) + F.col(tile)


def links(classes: DataFrame) -> DataFrame:
    """u, v (ids) of linked fingerprints; ``classes`` has distinct fp and a distinct id for each."""
    dealt = classes.select("fp", "id", gray_rank_column(F.col("fp")).alias("gray"), F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks()))).alias("mask", "bits"))
    dealt = written(dealt.select(F.col("mask").cast("byte").alias("mask"), "bits", "gray", "fp", "id"), "simhash-dealt")
    large = written(dealt.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE).select("mask", "bits"), "simhash-large")
    none = F.lit(-1).cast("long")
    found = bucket_links(dealt.join(large, ["mask", "bits"], "left_anti").select("*", none.alias("near"), none.alias("far")))
    if not large.isEmpty():
        tiles = written(tiled(dealt.join(large, ["mask", "bits"], "left_semi")), "simhash-tiles")
        sides = near_tiles(tiles).select("*", F.explode(F.array_distinct(F.array("near", "far"))).alias("at"))
        rows = tiles.select("mask", "bits", "gray", "fp", "id", packed("part", "tile").alias("at")).join(sides, ["mask", "bits", "at"]).drop("at")
        found = found.unionByName(bucket_links(rows))
    return found.distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, root (a number of the component), component_id of each row of (doc_id, text).

    Distinct fingerprints have numbers of their own, so that one whose ids are all null links like any other.
    """
    small_batches(docs.sparkSession)
    rows = written(fingerprints(docs), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "simhash-classes")
    found = written(components(links(classes.select("fp", "id"))), "simhash-components")
    of = classes.join(found, "id", "left").select("fp", "least", F.coalesce("root", "id").alias("root"))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.select("fp", "root").join(names, "root"), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, fingerprint, component_id."""
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def thin_out(docs: DataFrame) -> DataFrame:
    """One document of each component, a row with the smallest doc_id, with all its columns."""
    first = grouped(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("root", "component_id", "text_key").agg(F.count(F.lit(1)).alias("n")).groupBy("root", "component_id").agg(F.min(F.struct("text_key", "n")).alias("k"))
    return one_of_each(docs, written(kept.select("component_id", "k.text_key", "k.n"), "simhash-kept"), [F.col("doc_id").cast("long"), text_key()])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
