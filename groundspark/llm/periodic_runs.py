"""All runs (maximal periodic stretches) of words in every text, by the longest-previous-factor array.

A run is a stretch of words with smallest period q, of at least two periods and LEAST words, that no
neighbouring word extends. For a batch of texts, side by side in flat numpy arrays:

1. Prefix doubling gives the suffix array. Every round's ranks are kept: equal ranks mean equal
   blocks of 2^k words, so common extensions of two places, to either side, take one step a round.
2. The longest previous factor of a place is its common prefix with one of two suffixes: the nearest
   in the suffix array, on either side, that begin earlier in the text.
3. Its greedy factors are the LZ blocks of the text.
4. A run that isn't strictly inside a block meets a block's border, with a period less than the two
   blocks beside it have words (Main 1989). Each such border and period is extended to both
   sides; pairs that disagree on two words on each side are dropped first.
5. A run strictly inside a block is the copy of one in its earlier occurrence: blocks are read
   from left to right, and runs, in buckets by their start, are copied over (Kolpakov and Kucherov 1999).

A text needs about 4 * (rounds + 10) bytes a word, a batch holds BATCH_WORDS or one text.

Defined results: a null or empty text has no runs; a null doc_id has a row like any other; repeated rows
have a row each; an empty table gives an empty one; further columns are ignored; ties between longest
runs go to the smallest start, then the smallest period.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_slices, ragged, small_batches, table

LEAST = 12
#: Words of a batch; a longer text is a batch of its own.
BATCH_WORDS = 1 << 17

Run = tuple[int, int, int]


class Repeats:
    """The suffix array of many short sequences side by side (a suffix ends with its sequence), and the ranks of each round."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """``codes``: numbers of the symbols; sequence s is codes[starts[s]:ends[s]]."""
        n = len(codes)
        of = np.repeat(np.arange(len(starts)), ends - starts)
        self.begin, self.end = starts[of], ends[of]
        key = of * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        sa = order
        self.ranks, width = [rank], 1
        open_ = np.flatnonzero(~(new & np.append(new[1:], True))) if n else np.empty(0, np.int64)  # places in the order that aren't settled
        while len(open_):
            at = sa[open_]
            on = at + width
            inside = on < self.end[at]
            second = np.where(inside, rank[np.minimum(on, n - 1)] + 1, 0)
            old = rank[at]
            key = old * (n + 1) + second
            by = np.argsort(key, kind="stable")
            at, key, old = at[by], key[by], old[by]
            sa[open_] = at
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            group = np.ones(len(at), bool)
            group[1:] = old[1:] != old[:-1]
            place = np.arange(len(at))
            rank = rank.copy()
            rank[at] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
            self.ranks.append(rank)
            width *= 2
            open_ = open_[~(new & np.append(new[1:], True))]
        self.sa, self.ranks = sa, [r.astype(np.int32) for r in self.ranks] if n < 1 << 31 else self.ranks

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from places a < b of the same sequence on; b may be its end."""
        out = np.zeros(len(a), np.int64)
        if not len(a):
            return out
        last = len(self.sa) - 1
        end = self.end[a]
        for k in range(len(self.ranks) - 1, -1, -1):
            i, j = a + out, b + out
            out += ((j < end) & (self.ranks[k][i] == self.ranks[k][np.minimum(j, last)])).astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before places a < b of the same sequence; b may be its end."""
        out = np.zeros(len(a), np.int64)
        if not len(a):
            return out
        begin = self.begin[b - 1]
        for k in range(len(self.ranks) - 1, -1, -1):
            i, j = a - out - (1 << k), b - out - (1 << k)
            real = i >= begin
            out += (real & (self.ranks[k][np.maximum(i, 0)] == self.ranks[k][np.maximum(j, 0)])).astype(np.int64) << k
        return out

    def nearest_earlier(self, step: int) -> np.ndarray:
        """For each place, the next one before (step -1) or after (1) it in the suffix array that begins earlier, of those that share a word; -1: none."""
        n = len(self.sa)
        sa = np.concatenate((self.sa, [-1]))  # at -1 a sentinel that begins before all
        word = self.ranks[0][self.sa]
        edge = np.ones(n, bool)
        found = np.arange(n) + step
        if step < 0:
            edge[1:] = word[1:] != word[:-1]
        else:
            edge[:-1] = word[1:] != word[:-1]
        found[edge] = -1
        open_ = np.flatnonzero(~edge)
        while len(open_):
            open_ = open_[sa[found[open_]] > sa[open_]]
            found[open_] = found[found[open_]]
        out = np.empty(n, np.int64)
        out[self.sa] = sa[found]
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """The length of the longest factor that began earlier, of each place, and where that begins."""
        places = np.arange(len(self.sa))
        length, source = np.zeros(len(places), np.int64), np.full(len(places), -1)
        for step in (-1, 1):
            other = self.nearest_earlier(step)
            some = np.flatnonzero(other >= 0)
            own = self.forward(other[some], places[some])
            better = own > length[some]
            length[some[better]], source[some[better]] = own[better], other[some[better]]
        return length, source


def blocks(length: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Where the LZ blocks of each sequence begin, and its end."""
    after = (np.arange(len(length)) + np.maximum(length, 1)).tolist()
    out = []
    for at, end in zip(starts.tolist(), ends.tolist(), strict=True):
        own = [at]
        while at < end:
            at = after[at]
            own.append(at)
        out.append(own)
    return out


#: Pairs of border and period looked at together.
PAIRS = 1 << 20


def border_runs(text: Repeats, borders: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """start, end, period of the stretches of two periods and LEAST words that meet a border, not extensible; portion after portion."""
    at = np.concatenate([np.array(b[1:], np.int64) for b in borders])
    before = np.concatenate([np.diff(np.array(b, np.int64)) for b in borders])
    after = np.concatenate([np.append(np.diff(np.array(b[1:], np.int64)), 0)[: len(b) - 1] for b in borders])
    begin = np.concatenate([np.full(len(b) - 1, b[0]) for b in borders])
    end = np.concatenate([np.full(len(b) - 1, b[-1]) for b in borders])
    periods = np.minimum(before + after, np.maximum(at - begin, end - at))  # a period lies on one side whole
    total = np.cumsum(periods)
    pairs_rank = text.ranks[min(1, len(text.ranks) - 1)]
    two = 1 << min(1, len(text.ranks) - 1)
    last = len(text.sa) - 1
    first = 0
    while first < len(at):
        stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
        own = slice(first, stop)
        n = periods[own]
        b, lo, hi = (np.repeat(x[own], n) for x in (at, begin, end))
        p = ragged(np.ones(len(n), np.int64), n)
        for left, right in ((b, b + p), (b - p, b)):
            ok = (left >= lo) & (right <= hi)
            x, y, low, high, period = left[ok], right[ok], lo[ok], hi[ok], p[ok]
            # Of LEAST words in two periods at least 6 agree, so two do on one side.
            ahead = (y + two <= high) & (pairs_rank[np.minimum(x, last)] == pairs_rank[np.minimum(y, last)])
            behind = (x - two >= low) & (pairs_rank[np.maximum(x - two, 0)] == pairs_rank[np.maximum(y - two, 0)])
            some = ahead | behind
            x, y, period = x[some], y[some], period[some]
            f, g = text.forward(x, y), text.backward(x, y)
            long_ = (f + g >= period) & (f + g + period >= LEAST)
            yield (x - g)[long_], (y + f)[long_], period[long_]
        first = stop


def copied(found: dict[tuple[int, int], int], borders: list[int], source: np.ndarray) -> None:
    """Add the runs strictly inside blocks: copies of those strictly inside the blocks' sources."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (start, end), period in found.items():
        buckets.setdefault(start, []).append((end, period))
    starts = sorted(buckets)
    for b, e in zip(borders, borders[1:], strict=False):
        if e - b < LEAST + 2:
            continue
        src = int(source[b])
        shift = b - src
        lo, hi = bisect_left(starts, src + 1), bisect_left(starts, e - shift)
        if lo == hi:
            continue
        heap = starts[lo:hi]
        heapify(heap)
        while heap:
            start = heappop(heap)
            for end, period in buckets[start]:
                if end + shift < e and (start + shift, end + shift) not in found:
                    found[start + shift, end + shift] = period
                    if start + shift not in buckets:
                        buckets[start + shift] = []
                        insort(starts, start + shift)
                        if start + shift < e - shift:
                            heappush(heap, start + shift)
                    buckets[start + shift].append((end + shift, period))


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> list[list[Run]]:
    """(start, length, period) of the runs of each of many sequences, by start, then period. ``codes``: symbols, sequence after sequence."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out: list[list[Run]] = [[] for _ in sizes]
    real = np.flatnonzero(sizes)
    if not len(real):
        return out
    text = Repeats(codes, starts[real], ends[real])
    length, source = text.previous_factors()
    borders = blocks(length, starts[real], ends[real])
    found: dict[int, dict[tuple[int, int], int]] = {}
    for start, end, period in border_runs(text, borders):
        of = np.searchsorted(starts[real], start, "right") - 1
        for k, i, j, p in zip(of.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
            own = found.setdefault(k, {})
            own[i, j] = min(p, own.get((i, j), p))  # of a stretch's periods the smallest
    for k, own in found.items():
        copied(own, borders[k], source)
        at = borders[k][0]
        out[real[k]] = sorted(((i - at, j - i, p) for (i, j), p in own.items()), key=lambda r: (r[0], r[2]))
    return out


def without_runs(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, n, period in runs:
        marks[start + period] += 1
        marks[start + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_and_runs(batch: list[tuple[int | None, list[bytes]]]) -> list[list[Run]]:
    codes = _Codes()
    return runs_of(np.fromiter(map(codes.__getitem__, chain.from_iterable(w for _, w in batch)), np.int64), np.array([len(w) for _, w in batch], np.int64))


def find_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (by start, then period), collapsed (the text without what runs repeat, its words joined by one space) of every row.

    Words are cut at ASCII white space. ``prepare``: takes a row's id and words, returns the words to search.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []

        def out() -> pa.RecordBatch:
            runs = words_and_runs(held)
            sizes = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            kept = [b" ".join(without_runs(w, r)).decode() for (_, w), r in zip(held, runs, strict=True)]
            made = pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), fields), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])
            held.clear()
            return made

        n = 0
        for batch in in_slices(batches, "text", 1 << 19):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or "").encode().split()
                words = prepare(doc, words) if prepare else words
                if held and n + len(words) > BATCH_WORDS:
                    yield out()
                    n = 0
                held.append((doc, words))
                n += len(words)
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def repeat_some(doc: int | None, words: list[bytes]) -> list[bytes]:
    """What the query searches: in one of ten documents, by a checksum of the id, the words from some place on repeat periodically. A null id changes nothing."""
    if doc is None or not words:
        return words
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """The longest run and checksums of (doc_id, runs, collapsed)."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    best = F.struct(best["length"].alias("length"), (-best["before"]).alias("start"), (-best["less"]).alias("period"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", *(F.col(f"b.{c}").alias(c) for c in ("start", "length", "period")), F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(table(spark, sf_dir, "documents"), repeat_some))
