"""Sharding, periodic runs and spelling variants against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.llm import periodic_runs, sharding, spelling

from .test_llm import DATA, ODD


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    clash = rows.withColumns({c: F.lit("clash") for c in ("shard", "slot", "frac", "stratum", "doc", "part", "at", "h", "n", "word", "key", "runs", "start", "length")})
    return clash.withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("s"), F.col("doc_id") % 3))).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# --- 11


def held_to_the_law(rows, shards, documents):
    """Counts at most one apart, slots gapless, every source's share of a shard within what the cuts allow."""
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == documents and set(by) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_match_the_mixture(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    got = sharding.op11_sharding(spark, d).toPandas()
    held_to_the_law(got.to_dict("records"), 24, len(docs))
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(got) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 8 == s for t, c, s in zip(both.text, both.text_crc32, both["size"], strict=True))
    spread = both.groupby(["source", "shard"]).size().unstack(fill_value=0).reindex(columns=range(24), fill_value=0)
    share = both.groupby("source").size() / 24
    assert (spread.sub(share, axis=0).abs() < 2).all().all()
    # Any prefix of a shard holds the large sources in proportion too.
    large = share.idxmax()
    first = both[both.slot < both.groupby("shard").slot.transform("max") / 2]
    assert abs((first.source == large).mean() - (both.source == large).mean()) < 0.05


def test_shards_equal_a_plain_interleaving(spark):
    """The same ranks, fractions and cuts, sorted in Python."""
    n = 700
    rows = [(k, f"text {k % 300}", "big" if k % 3 else f"s{k % 40}") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = docs.withColumn("stratum", F.concat(F.lit("1"), "source")).select("doc_id", "stratum", F.xxhash64(F.lit(7), "doc_id", "text").alias("h"), sharding.unit(F.lit(7), F.col("stratum")).alias("u")).collect()
    by = {}
    for r in keyed:
        by.setdefault(r.stratum, []).append(r)
    order = sorted(((k + r.u) / len(own), s, r.doc_id) for s, own in by.items() for k, r in enumerate(sorted(own, key=lambda r: r.h)))
    want = {}
    for place, (_, _, doc) in enumerate(order):
        k = max(k for k in range(9) if k * n // 9 <= place)
        want[doc] = (k, place - k * n // 9)
    got = sharding.shard(docs.repartition(5), 9, seed=7).slots(F.col("doc.doc_id")).toDF("shard", "slot", "doc_id").collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_shards_odd(spark, odd, none):
    made = sharding.shard(odd, 5)
    rows = made.slots(F.col("doc.doc_id"), F.col("doc.shard")).toDF("shard", "slot", "doc_id", "clash").collect()
    held_to_the_law([r.asDict() for r in rows], 5, len(ODD))
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in ODD) and {r.clash for r in rows} == {"clash"}
    assert Counter(r.t for r in made.files().select("doc.text").toDF("t").collect()) == Counter(t for _, t in ODD)
    assert sharding.shard(none, 24).slots(F.col("doc.doc_id")).count() == 0
    few = sharding.shard(odd.limit(3), 24).slots(F.col("doc.doc_id")).collect()
    assert len(few) == 3 and len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_a_third_of_all_rows_alike_is_spread(spark):
    """Rows alike in id, text and source: one hash, yet every shard gets its share and no range takes all."""
    docs = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).alias("text"), F.lit("one").alias("source"))
    rows = sharding.shuffled(docs, "source", 1)
    assert max(r["count"] for r in rows.groupBy(F.shiftright("at", 33).alias("p")).count().collect()) < 300
    made = sharding.shard(docs, 9).slots(F.col("doc.doc_id")).collect()
    held_to_the_law([{"shard": r[0], "slot": r[1]} for r in made], 9, 900)


# --- 12


def plain_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            a = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > a and i + p - a >= max(least, 2 * p):
                found.setdefault((a, i + p), p)
            i += i == a
    return sorted(((a, j - a, p) for (a, j), p in found.items()), key=lambda r: (r[0], r[2]))


def drawn(rng):
    n, v, kind = rng.choice([0, 1, 2, 13, 30, 60, 150, 400]), rng.choice([1, 2, 3, 4, 8, 50]), rng.randrange(5)
    w = [rng.randrange(v) for _ in range(n)]
    if kind == 0 and n:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        w = w[:a] + (w[a : a + p] * ((n - a) // p + 1))[: n - a]
    if kind == 1:
        unit = [rng.randrange(v) for _ in range(rng.randrange(1, 12))]
        w = []
        while len(w) < n:
            w += unit * rng.randrange(1, 4) + [rng.randrange(v)] * rng.randrange(14)
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    if kind == 3 and n:  # whole passages again, with runs inside
        w = (w[: n // 3] + [7] * 13 + w[: n // 5]) * 3
    return w


def test_runs_equal_brute_force():
    rng, seen = random.Random(2), 0
    for _ in range(250):
        texts = [drawn(rng) for _ in range(rng.randrange(12))]
        got = periodic_runs.runs_of(np.array([c for w in texts for c in w], np.int64), np.array([len(w) for w in texts], np.int64))
        want = [plain_runs(w) for w in texts]
        seen += sum(map(len, want))
        assert got == want
    assert seen > 3000


def test_the_method_makes_the_runs(monkeypatch):
    """The longest previous factors by their definition; without copying, runs inside blocks are missing."""
    rng = random.Random(4)
    for _ in range(60):
        w = np.array(drawn(rng) or [1], np.int64)
        text = periodic_runs.Repeats(w, np.array([0]), np.array([len(w)]))
        own = w.tolist()
        assert sorted(range(len(own)), key=lambda i: own[i:]) == text.sa.tolist()
        common = lambda i, j: next((k for k in range(len(own) - j) if own[i + k] != own[j + k]), len(own) - j)  # noqa: E731, B023
        length, source = text.previous_factors()
        want = [max((common(i, j) for i in range(j)), default=0) for j in range(len(own))]
        assert length.tolist() == want and all(common(s, j) == n for j, (s, n) in enumerate(zip(source.tolist(), want, strict=True)) if n)
    passage = [*range(10), *[77] * 13, *range(20, 30)]
    w = passage + [500] + passage + [501] + passage
    assert len(plain_runs(w)) == 3 and periodic_runs.runs_of(np.array(w), np.array([len(w)]))[0] == plain_runs(w)
    monkeypatch.setattr(periodic_runs, "copied", lambda *a: None)
    assert len(periodic_runs.runs_of(np.array(w), np.array([len(w)]))[0]) == 1


def plain_digest(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in docs if len(r.text) < 12_000]
    got = {tuple(r) for r in periodic_runs.op12_periodic_runs(spark, DATA).collect()}
    want = {plain_digest(*r) for r in short}
    assert want <= got and len(got) == len(docs) and sum(r[1] > 0 for r in want) > 5


def test_runs_odd(spark, odd, none):
    got = Counter(tuple(r) for r in periodic_runs.digests(periodic_runs.find_runs(odd, periodic_runs.repeat_some)).collect())
    assert got == Counter(plain_digest(d, t) if d != 8 else (8, 1, 0, 20000, 1, 20_000_000, hashlib.sha256(b"0,20000,1\n").hexdigest(), hashlib.sha256(b"word").hexdigest()) for d, t in ODD)
    assert periodic_runs.digests(periodic_runs.find_runs(none)).count() == 0


def test_a_long_text_of_runs():
    rng = random.Random(1)
    w = [rng.randrange(3) for _ in range(300_000)]
    w[100_000:200_000] = (w[:1000] * 100)[:100_000]
    (runs,) = periodic_runs.runs_of(np.array(w), np.array([len(w)]))
    assert any(p == 1000 and n >= 100_000 for _, n, p in runs)


# --- 13


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        if own:
            best = min(own, key=lambda v: (-counts[v], v))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_spelling_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(docs)
    got = {tuple(r) for r in spelling.op13_spelling(spark, DATA).collect()}
    assert got == plain_variants(counts) and sum(r[1] is not None for r in got) > 10


@pytest.mark.parametrize("held", [7, 200_000])
def test_variants_of_dense_words(spark, monkeypatch, held):
    """Few letters: many words share keys, letters repeat, insertions in runs of a letter."""
    monkeypatch.setattr(spelling, "HELD_KEYS", held)
    rng = random.Random(3)
    counts = {"".join(rng.choice("aabé") for _ in range(rng.randrange(5, 8))): rng.choice([3, 4, 6, 8, 20, 50]) for _ in range(300)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in spelling.variants(words).collect()} == plain_variants(counts)


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    """With two keys in all, every word meets every other."""
    whole = spelling.hashes
    monkeypatch.setattr(spelling, "mix64", lambda x: x & np.uint64(1))
    rng = random.Random(5)
    counts = {"".join(rng.choice("abc") for _ in range(5)): rng.choice([3, 9, 30]) for _ in range(60)}
    keys = sorted(((int(k), p, w) for w in counts for k, p in zip(np.concatenate(whole(np.array([ord(c) for c in w]), np.array([len(w)]))).tolist(), range(-1, len(w)), strict=True)))
    words = [w for _, _, w in keys]
    first = np.array([p < 1 or w[p] != w[p - 1] for _, p, w in keys])
    word, near, form, _ = spelling.joined(np.array([k for k, _, _ in keys]), np.array([p for _, p, _ in keys]), first, words, np.array([counts[w] for w in words]))
    total = Counter()
    for w, n in zip(word, near.tolist(), strict=True):
        total[w] += n
    assert total == Counter({w: n for w, _, _, _, n, _ in plain_variants(counts) if n}) and all(one_edit(w, f) for w, f in zip(word, form, strict=True))


def test_deletion_keys_are_hashes_of_the_rest():
    words = ["hello", "é", "", "abc", "aab"]
    whole, without = spelling.hashes(np.array([ord(c) for w in words for c in w], np.int64), np.array([len(w) for w in words]))
    left = [w[:k] + w[k + 1 :] for w in words for k in range(len(w))]
    again, _ = spelling.hashes(np.array([ord(c) for w in left for c in w], np.int64), np.array([len(w) for w in left]))
    assert (again == without).all() and len(set(whole.tolist())) == 5


def test_forms_are_followed_to_the_last(spark):
    chain = {"aaaaa" + "b" * k: 2 ** (14 - k) for k in range(12)}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaa"}


def test_spelling_odd(spark, odd, none):
    got = {tuple(r) for r in spelling.variants(spelling.vocabulary(odd, spelling.misspell, 3, 1)).collect()}
    counts = Counter()
    for doc, text in ODD:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = spelling.misspell("" if doc is None else str(doc), "".join(c.lower() if c.isascii() else c for c in run))
            counts[run] += 1
    assert got == plain_variants({w: n for w, n in counts.items() if len(w) >= 3})
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
