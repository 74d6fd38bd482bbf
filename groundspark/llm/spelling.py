"""Spelling variants: words one edit apart, found through rolling-hash deletion keys.

For every word, prefix and suffix polynomial hashes (modulo 2^64) give the hash of the word without each
of its code points as integers, many words at once in numpy; the word's own hash is one key more.
Keys are dealt out by their top bits (a radix partition) and sorted. Words that share a key of the same
deleted place differ by a replacement there; a word whose own key is another's deletion key lacks one code
point of it. Words met in a key are compared as strings, so that a collision of hashes joins nothing.

No pair is written: a place of a key passes on, for each of its words, the number of its other words and
the best of them, so the work is linear in keys. What a key holds is bounded by the alphabet (a replacement
by 90 letters, an insertion by 90 at each place), not by the data.

Defined results: a null text has no words; a null doc_id stands as an empty id; repeated rows count as often as
they stand; ties in a word's form go to the smaller word in code-point order; an empty table gives an
empty one; further columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, fan_out, in_slices, mix64, ragged, small_batches, table, written

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form stands at least so many times as often.
TIMES = 2
BASE = 0x9E3779B97F4A7C15
RADIX_BITS = 16
#: Distinct words counted in a task before they are passed on.
HELD_WORDS = 200_000
#: Rows of keys handled at once.
HELD_KEYS = 200_000


def words_in(text: str | None) -> Counter:
    """The runs of letters of a text, A-Z lower-cased, and how often each stands."""
    return Counter(LETTERS.findall((text or "").encode().lower().decode()))  # bytes know ASCII only


def misspell(doc: str, word: str) -> str:
    """What the query counts: one of 97 pairs of document and word, by a checksum, loses a code point."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, change: Callable[[str, str], str] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words of enough code points and occurrences; counted in the tasks before they are shuffled. ``change``: takes a row's id (as text) and a word, returns the word to count."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in in_slices(batches, "text", 1 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc = "" if doc is None else str(doc)
                for word, n in words_in(text).items():
                    word = change(doc, word) if change else word
                    if len(word) >= least_length:
                        counts[word] += n
            if len(counts) >= HELD_WORDS:
                yield out()
        if counts:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def hashes(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words given by their code points: the hash of each word whole, and of each word without each of its code points (flat)."""
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(points)) - starts[own]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), BASE, np.uint64))), dtype=np.uint64)
        term = points.astype(np.uint64) * power[at]
        through = np.cumsum(term, dtype=np.uint64)  # wraps like all else
        ahead = np.concatenate((np.zeros(1, np.uint64), through))[starts]
        whole = np.zeros(len(sizes), np.uint64)
        some = sizes > 0
        whole[some] = through[(starts + sizes - 1)[some]] - ahead[some]
        prefix = through - term - ahead[own]
        suffix = (whole[own] - prefix - term) * np.uint64(pow(BASE, -1, 1 << 64))  # moved one place down
        salt = lambda n: n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # noqa: E731  words of different lengths apart
        return mix64(whole + salt(sizes)), mix64(prefix + suffix + salt(sizes[own] - 1))


def keys(words: DataFrame) -> DataFrame:
    """key, place (-1: the word itself), first (whether no equal letter stands before the place), word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "word", 1 << 18):
            text = batch.column("word").to_pylist()
            sizes = np.fromiter(map(len, text), np.int64, len(text))
            points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64)
            whole, without = hashes(points, sizes)
            own = np.repeat(np.arange(len(text)), sizes)
            place = ragged(np.zeros(len(sizes), np.int64), sizes)
            first = np.ones(len(points), bool)
            first[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
            rows = np.concatenate((np.arange(len(text)), own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((whole, without)).view(np.int64)), pa.array(np.concatenate((np.full(len(text), -1), place)).astype(np.int32)), pa.array(np.concatenate((np.ones(len(text), bool), first))), batch.column("word").take(pa.array(rows)), batch.column("n").take(pa.array(rows))],
                ["key", "place", "first", "word", "n"],
            )

    return words.select("word", "n").mapInArrow(run, "key long, place int, first boolean, word string, n long")


def best_others(group: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each row the row of its group (ascending numbers) with the largest n, then the smallest rank, besides itself; -1: none."""
    order = np.lexsort((rank, -n, group))
    ordered = group[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.diff(np.append(begin, len(order)))
    second = np.where(size > 1, order[np.minimum(begin + 1, len(order) - 1)], -1)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(new, second[run], order[begin][run])
    return out


def joined(key: np.ndarray, place: np.ndarray, first: np.ndarray, words: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """word, near (other words found), form, form_n from rows of whole keys, sorted by key."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(run)[run] > 1)
    if not len(several):
        return [], np.empty(0, np.int64), [], np.empty(0, np.int64)
    place, first, n, run = place[several], first[several], n[several], run[several]
    words = [words[k] for k in several.tolist()]
    # What is left of each word, as a string: a key's rows are taken apart by it.
    rest: dict[tuple[int, str], int] = {}
    left = np.fromiter((rest.setdefault((r, w if p < 0 else w[:p] + w[p + 1 :]), len(rest)) for r, p, w in zip(run.tolist(), place.tolist(), words, strict=True)), np.int64, len(words))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(rows: np.ndarray, near: np.ndarray, other: np.ndarray) -> None:
        some = other >= 0
        found.append((rows[some], near[some], other[some]))

    deleted = np.flatnonzero(place >= 0)
    if len(deleted):
        spot = left[deleted] * (int(place.max()) + 1) + place[deleted]
        _, group, size = np.unique(spot, return_inverse=True, return_counts=True)
        other = best_others(group, n[deleted], rank[deleted])
        put(deleted, size[group] - 1, np.where(other >= 0, deleted[other], -1))  # a replacement at that place
    whole = np.full(len(rest), -1)
    own = np.flatnonzero(place < 0)
    whole[left[own]] = own
    longer = np.flatnonzero((place >= 0) & first & (whole[left] >= 0))
    if len(longer):
        put(longer, np.ones(len(longer), np.int64), whole[left[longer]])  # it has a code point more than a word
        order = longer[np.lexsort((rank[longer], -n[longer], left[longer]))]
        head = np.ones(len(order), bool)
        head[1:] = left[order][1:] != left[order][:-1]
        at = np.flatnonzero(head)
        put(whole[left[order[at]]], np.diff(np.append(at, len(order))), order[at])
    rows, near, other = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    return [words[k] for k in rows.tolist()], near, [words[k] for k in other.tolist()], n[other]


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (form_n, form): of every word with words one edit apart."""
    dealt = keys(words).repartition(fan_out(words.sparkSession), F.shiftright("key", 64 - RADIX_BITS)).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out(t: pa.Table) -> pa.RecordBatch:
            c = {x: t.column(x).combine_chunks() for x in t.column_names}
            word, near, form, form_n = joined(c["key"].to_numpy(), c["place"].to_numpy(), c["first"].to_numpy(zero_copy_only=False), c["word"].to_pylist(), c["n"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near), pa.array(form, pa.string()), pa.array(form_n)], ["word", "near", "form", "form_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < HELD_KEYS:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            first = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if first:
                yield out(t.slice(0, first))
            held, rows = t.slice(first).to_batches(), t.num_rows - first
        if rows:
            yield out(pa.Table.from_batches(held))

    found = dealt.mapInArrow(run, "word string, near long, form string, form_n long")
    # Of equal counts the smaller form: min over (-form_n, form). Strings are ordered by their UTF-8 bytes, so by code points.
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of the words with a form: follows forms to the last by doubling; counts at least double at each step, so rounds are few."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(now.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = new
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of (word, n), words distinct."""
    own = written(words.select("word", "n"), "spelling-words")
    found = own.join(neighbours(own), "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    found = written(found, "spelling-forms")
    roots = rooted(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), misspell))
