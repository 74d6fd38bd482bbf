"""That each operator's own method decides its results: brute force, gold cases and proofs that a path ran."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundspark.llm import chat_format, components, decontaminate, exact_dedup, html_extract, license_scan, pii, quality, simhash
from groundspark.llm._common import broadcast_if_small, utf8

from .test_llm import DATA, ODD, brute_components, fingerprint, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- 1


def test_cells_do_not_depend_on_the_pieces(monkeypatch):
    rng = random.Random(1)
    draw = lambda n: "".join(rng.choice(["ab ", "a", "B", "é", "1", ".", "..", " ", "\n", "the ", "The ", "中", "word word "]) for _ in range(n))
    for _ in range(40):
        given = utf8(pa.array([*(draw(rng.choice([0, 1, 5, 40, 400])) for _ in range(rng.randrange(1, 9))), "x" * rng.choice([0, 10, 700]) + " y"]))
        whole = quality.ngram_cells(*given)
        for piece in (16, 64, 200):
            monkeypatch.setattr(quality, "PIECE", piece)
            assert all((a == b).all() for a, b in zip(whole, quality.ngram_cells(*given), strict=True))
        monkeypatch.undo()


def test_a_long_text_takes_bounded_memory():
    import tracemalloc

    given = utf8(pa.array(["the quick Brown fox. " * 300_000 + "y" * 4_000_000 + " end"]))
    quality.ngram_cells(*given)
    tracemalloc.start()
    quality.ngram_cells(*given)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_descent_reaches_the_least_hinge_loss():
    """Against many small steps down the same loss."""
    rng = np.random.default_rng(0)
    truth = rng.normal(size=30)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(200)]
    x = np.zeros((200, 31))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(6)
    x[:, 30] = 1
    y = np.where(x[:, :30] @ truth + rng.normal(size=200) * 0.3 > 0, 1.0, -1.0)
    w, bias = quality.descend(rows, [np.full(6, 1 / np.sqrt(6))] * 200, y, np.ones(200), rounds=400)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    own, v, best = loss(np.append(w[:30], bias)), np.zeros(31), np.inf
    for k in range(20000):
        v = v - (v - (y * (y * (x @ v) < 1)) @ x) / (k + 10)
        best = min(best, loss(v))
    assert own <= best * 1.001


def test_a_repeated_row_is_fitted_on_once(spark):
    rows = [(d, f"good words number {d} here" if d % 2 else f"BAD!!! $$$ {d} ###", d % 2) for d in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    scores = lambda d: {r.doc_id: r.score for r in quality.score(docs, quality.fit(d, labels)).collect()}
    assert scores(docs) == scores(docs.unionByName(docs.filter("doc_id = 3").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("n")).drop("n")))


def test_long_documents_are_fitted_on_within_the_bound(spark, monkeypatch):
    """A very long document is in the sample; a lower bound takes fewer documents, in order of their hash, whatever their length."""
    rows = [(d, f"good words number {d} here" if d % 2 else f"BAD!!! $$$ {d} ###", d % 2) for d in range(100)]
    rows[8] = (8, " ".join(f"w{k}" for k in range(30_000)), 0)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda row, cell, good: seen.append((len(good), np.bincount(row).max())) or train(row, cell, good))
    quality.fit(docs, labels)
    assert seen[0][0] == sum(not r.h for r in labels.select(quality.held_out(F.col("doc_id")).alias("h")).collect()) and seen[0][1] > 1 << 14
    monkeypatch.setattr(quality, "FIT_CELLS", 400)
    quality.fit(docs, labels)
    assert 0 < seen[1][0] < seen[0][0]
    monkeypatch.setattr(quality, "FIT_CELLS", 1)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {0.5}


def test_the_fit_holds_little_beside_its_cells():
    """Two million cells take 8 MB; what is held for each cell beside them would take two or three times that."""
    rng = np.random.default_rng(1)
    good = rng.random(2000) < 0.5
    cell = np.concatenate([np.sort(rng.choice(1 << 17, 1000, replace=False)) + (1 << 16) * g for g in good]).astype(np.int32)
    row = np.repeat(np.arange(2000, dtype=np.int32), 1000)
    tracemalloc.start()
    model = quality.train(row, cell, good).model
    most = tracemalloc.get_traced_memory()[1] - 6 * 8 * (1 << quality.BITS)  # vectors of all possible cells
    tracemalloc.stop()
    assert model.weights is not None and most < cell.nbytes


def test_the_sample_reaches_the_driver_in_parts(spark, monkeypatch):
    rows = [(d * 7 - 300, f"good words number {d} here" if d % 2 else f"BAD!!! $$$ {d} ###", d % 2) for d in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5), spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    whole, sent, send = quality.fit(docs, labels), [], type(docs).toArrow

    def seen(df):
        out = send(df)
        if "cells" in out.column_names:
            sent.append(sum(map(len, out["cells"].to_pylist())))
        return out

    monkeypatch.setattr(type(docs), "toArrow", seen)
    monkeypatch.setattr(quality, "SENT_CELLS", 500)
    parts = quality.fit(docs, labels)
    assert len(sent) > 2 and max(sent) <= 500
    assert (whole.model.weights == parts.model.weights).all() and (whole.model.bias, whole.model.slope, whole.model.shift) == (parts.model.bias, parts.model.slope, parts.model.shift)


# --- 2


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p><span class="notice">Note:</span> The whole paragraph stays.</p></article>', "The whole paragraph stays."),
    ('<article><p class="search">How we search the web.</p><p>More.</p></article>', "How we search the web.\nMore."),
    ('<article><p>Prose <span class="ad">BUY NOW</span> more</p></article>', "Prose more"),
    ('<article><p class="ad">BUY</p><h2 class="related">Related work</h2><div class="related">Read next</div><p class="notice">Cookies!</p>text</article>', "Related work\ntext"),
    ('<main><p>a<span hidden>b</span>c</p><aside>d</aside><form><p>e</p></form><ul class="comments"><li>f</li></ul></main><footer>g</footer>', "ac"),
    ('<div class="sidebar">links</div><div>Body <b>of</b> the page</div><div id="cookie-banner">We use</div>', "Body of the page"),
    ('<article><p>Text</p></article><section class="comments"><article class="comment"><p>Nice post!</p></article><article><p>Me too</p></article></section>', "Text"),
    ('<article><p>Text</p><div id="comments"><article class="comment-body"><p>Nice post!</p></article></div><p>more</p></article>', "Text\nmore"),
    ('<aside><article><p>Related teaser</p></article></aside><main><p>Text</p></main>', "Text"),
    ('<article><p>Text</p><article class="comment"><p>Nice post!</p></article></article>', "Text"),
    ('<nav><a href="/">home</a><article><p>After a menu that is left open</p></article>', "After a menu that is left open"),
    ('<nav><nav>x</nav><article><p>Text</p></article>', "Text"),
    ("<article><p>A &amp; B&nbsp;C &#x4e2d;<script>x()</script></p></article>", "A & B C 中"),
])
def test_gold_pages(spark, page, text):
    got = html_extract.extract(spark.createDataFrame([(1, "http://a.x/b", page)], "page_id long, url string, html string")).first()
    assert (got.text, got.n_chars) == (text, len(text))


def site(template: str, pages: int = 12) -> list[tuple]:
    rng = random.Random(3)
    words = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
    return [(n, f"http://s.x/a/{n:02}", f"<article><h1>{words()}</h1><p>{words()}</p>{template}<p>{words()}</p></article>") for n in range(pages)]


def test_differencing_deletes_template_lines_of_articles(spark, monkeypatch):
    """Every page's 'Subscribe' paragraph goes by alignment alone; a sentence that two pages share stays; without alignment both stay."""
    rows = site("<p>Subscribe to our letters and never miss one</p><div>Tags</div>")
    rows[5] = (*rows[5][:2], rows[5][2].replace("</article>", "<p>A quotation that two pages share</p></article>"))
    rows[6] = (*rows[6][:2], rows[6][2].replace("</article>", "<p>A quotation that two pages share</p></article>"))
    plain = {n: re.sub(r"\n(?:Subscribe[^\n]*|Tags)", "", "\n".join(html_extract.lines_of(page)[0])) for n, _, page in rows}
    assert "quotation" in plain[5]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 30):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.page_id: r.text for r in html_extract.extract(df.repartition(3)).collect()} == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hint_is_settled_by_the_partner(spark):
    rows = site('<p class="share">Share this page with your friends</p>', 2)
    alone = html_extract.extract(spark.createDataFrame(rows[:1], "page_id long, url string, html string")).first().text
    both = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first().text
    assert "Share this" in alone and "Share this" not in both


def test_a_long_marked_page(spark):
    page = "<article>" + "".join(f"<p>line {k % 5000} of <i>many</i> in a long page</p>" for k in range(60_000)) + "</article>"
    got = html_extract.extract(spark.createDataFrame([(1, "http://a.x/b", page), (2, "http://a.x/c", page.replace("long", "huge"))], "page_id long, url string, html string")).collect()
    assert {len(r.text.split("\n")) for r in got} == {60_000}


# --- 3


def test_owners_have_ranges_of_the_directory():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 30, 1 << 12)
    through = exact_dedup.Directory(cells, 50)
    keys = np.sort(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    bucket = through.bucket(keys)
    owner = through.owner(bucket, 7)
    assert (np.diff(owner) >= 0).all() and set(owner.tolist()) == set(range(7))  # key ranges that follow each other
    held = np.bincount(through.owner(through.bucket(np.arange(1 << 12, dtype=np.uint64) << np.uint64(52)), 7), cells)
    assert held.max() < 1.2 * held.mean()
    assert exact_dedup.Directory(np.zeros(4, np.int64), 10).owner(np.zeros(3, np.int32), 5).tolist() == [0, 0, 0]


def test_documents_look_themselves_up_through_the_directory(spark, monkeypatch):
    """With buckets of four keys the index has many; a directory that names other buckets on the way back finds nothing."""
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 4)
    docs = spark.createDataFrame([(n, f"Text {n % 150}") for n in range(300)], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(n, n % 150 + 150, 2) for n in range(300)}
    plain = exact_dedup.placed
    monkeypatch.setattr(exact_dedup, "placed", lambda rows, through: plain(rows, through).withColumn("bucket", F.col("bucket") + 1000))
    assert exact_dedup.exact_groups(docs).count() == 0


# --- 4


def test_license_scan_is_linear(spark):
    def took(n):
        began = time.time()
        got = license_scan.scan(spark.createDataFrame([(1, "lorem ipsum dolor sit " * (n // 4) + "apache license version 2")], "doc_id long, text string")).first()
        assert (got.n_words, got.first_word, got.base_labels) == (n + 4, n, "apache-2")
        return time.time() - began

    took(100)
    assert took(400_000) < 30


def test_license_labels_equal_brute_force(spark):
    """Votes, merged diagonals and verified spans of texts with whole, changed and cut templates."""
    rng = random.Random(7)
    texts = []
    for _ in range(120):
        words = [rng.choice("alpha beta the license of software".split()) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(license_scan.BASE + license_scan.TEMPLATES)[0].split()
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = [rng.choice(["alpha", "beta"])] * rng.randrange(3)
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        texts.append(" ".join(words))
    got = rows_of(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    k = license_scan.K
    for n, text in enumerate(texts):
        words, spans = text.split(), []
        for number, (template, label) in enumerate(license_scan.BASE + license_scan.TEMPLATES):
            own, base = template.split(), number < len(license_scan.BASE)
            votes: dict[int, list] = {}
            for q in range(len(own) - k + 1):
                for p in range(len(words) - k + 1):
                    if own[q : q + k] == words[p : p + k]:
                        votes.setdefault(p - q, []).append((p, q))
            runs: list[list] = []
            for d in sorted(votes):
                if runs and d - runs[-1][0] <= (0 if base else license_scan.SLACK):
                    runs[-1] = [d, runs[-1][1] + votes[d]]
                else:
                    runs.append([d, votes[d]])
            for _, found in runs:
                share, begin, end = len({q for _, q in found}) / (len(own) - k + 1), min(p for p, _ in found), max(p for p, _ in found) + k
                if share == 1 if base else share >= license_scan.VERIFIED and end - begin <= 2 * (len(own) + 1):
                    spans.append((begin, end, label, share))
        assert sorted((s.begin, s.end, s.label, s.share) for s in got[n].spans) == sorted(spans), text
        assert got[n].labels == ",".join(sorted({s[2] for s in spans}))


def test_license_words_beyond_ascii(spark):
    """Lower-casing beyond A-Z changes neither word counts nor places of the base."""
    texts = ["Under the MİT license, under the mit license", "ÅK apache license version 2 K", "APACHE LICENSE VERSION 2 ÄÖ", "cc　by nc cc by nc"]
    got = rows_of(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for n, text in enumerate(texts):
        words = WORD.findall(text.translate(lower))
        at = sorted(i for p, _ in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (got[n].n_words, got[n].n_base, got[n].first_word) == (len(words), len(at), at[0] if at else None)


# --- 5


def test_short_items_equal_brute_force_and_sql(spark):
    import duckdb

    from groundspark.llm import registry

    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice("a b c d".split()) for _ in range(n))
    docs, items = [(n, draw(rng.randrange(12))) for n in range(60)], [(n, draw(rng.randrange(9))) for n in range(60)]
    grams = lambda t, k: {tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)}
    expected = set()
    for i, item in items:
        own = grams(item, k := min(5, len(item.split()))) if item else set()
        expected |= {(d, i, len(own & grams(t, k)), len(own)) for d, t in docs if own and len(own & grams(t, k)) >= 0.8 * len(own) - 1e-9}
    d, b = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    assert {tuple(r)[:4] for r in decontaminate.leaks(d, b).collect()} == expected and any(len(items[i][1].split()) < 5 for _, i, *_ in expected)
    con = duckdb.connect()
    for name, rows, c in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({c} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert {r[:4] for r in con.execute(registry.OP5_SQL).fetchall()} == expected


def test_a_very_long_text_is_searched_in_linear_time(spark):
    words = [f"w{k}" for k in range(400_000)]
    item = " ".join(words[390_000:390_040])
    took = []
    for n in (100_000, 400_000):
        began = time.time()
        docs = spark.createDataFrame([(1, " ".join(words[-n:])), (2, None)], "doc_id long, text string")
        found = decontaminate.leaks(docs, spark.createDataFrame([(7, item), (8, "w399990 w399991"), (9, "nowhere")], "item_id long, text string")).collect()
        took.append(time.time() - began)
        assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (1, 8)}
    assert took[1] < 30


def test_small_tables_are_measured(spark):
    df = spark.range(1000).withColumn("x", F.repeat(F.lit("y"), 100))
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_small(df)).lower() and "broadcast" not in plan(broadcast_if_small(df, 100_000)).lower()


# --- 6


def near_fingerprints(seed: int, groups: int, each: int, most: int) -> list[int]:
    rng, fps = random.Random(seed), set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(each):
            v = base
            for _ in range(rng.randrange(most)):
                v ^= 1 << rng.randrange(64)
            fps.add(v)
    return sorted(fps)


def test_the_hierarchy_finds_all_links_of_groups_of_any_size(monkeypatch):
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 60, 64, 65, 900):
        fps = np.array(near_fingerprints(size, 3, size, 10), np.uint64)
        group = np.sort(rng.integers(0, 3, len(fps)))
        order = np.lexsort((simhash.gray_rank(fps), group))
        fps = fps[order]
        found = [np.stack(x, 1) for x in simhash.GrayIndex(fps, group).pairs()]
        found = {tuple(p) for x in found for p in x.tolist()}
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
        expected = {(i, j) for i, j in zip(*np.nonzero((apart <= simhash.MOST_BITS) & (group[:, None] == group[None, :])), strict=True) if i < j}
        assert found == expected
    monkeypatch.setattr(simhash, "GrayIndex", None)
    with pytest.raises(TypeError):  # no other way to a link
        simhash.links_in_groups(np.zeros(2, np.int64), np.array([1, 3], np.uint64), np.arange(2))


def test_the_hierarchy_drops_whole_nodes():
    """Far fewer pairs are compared than a group has."""
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    compared, count = 0, np.bitwise_count
    for level, (both, any_, *_) in enumerate(simhash.GrayIndex(fps, np.zeros(len(fps), np.int64)).levels[1:3]):
        apart = count((both[:500, None] & ~any_[None, :]) | (both[None, :] & ~any_[:500, None]))
        compared += (apart <= simhash.MOST_BITS).mean() if level == 0 else 0
    assert compared < 0.45


def test_buckets_far_above_a_tile(spark, monkeypatch):
    """One bucket of thousands of fingerprints in tiles of four: several levels of nodes, few pairs of tiles, no link lost."""
    monkeypatch.setattr(simhash, "TILE", 4)
    rng, fps = random.Random(9), set()
    while len(fps) < 3000:
        fps.add((rng.getrandbits(42) << 22) | 5)
    fps = sorted(fps | {f ^ (1 << rng.randrange(22, 64)) for f in rng.sample(sorted(fps), 300)})
    classes = spark.createDataFrame([(i, simhash.signed(v)) for i, v in enumerate(fps)], "id long, fp long")
    seen = {}
    plain = simhash.near_tiles
    monkeypatch.setattr(simhash, "near_tiles", lambda tiles: seen.setdefault("pairs", plain(seen.setdefault("tiles", tiles))))
    roots = {r.id: r.root for r in components.components(simhash.links(classes)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(fps, list(range(len(fps))))
    tiles = seen["tiles"].filter("bits = 5").select("part", "tile").distinct().count()
    pairs = seen["pairs"].filter("bits = 5").count()
    assert tiles > 700 and tiles <= pairs < tiles * (tiles + 1) / 4
    assert seen["tiles"].groupBy("mask", "bits", "part", "tile").count().agg(F.max("count")).head()[0] == 4


def test_null_ids_link_and_bridge(spark):
    """Three texts in a chain, the middle one without an id; a pair that has none; a row alone without one."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = lambda n: " ".join(base[: 400 - n])
    far = lambda seed: " ".join(f"v{random.Random(seed).randrange(10**6)}{k}" for k in range(50))
    texts = [(5, near(0)), (None, near(1)), (None, far(1)), (None, far(1)), (9, far(2))]
    rows = simhash.grouped(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    bits = {r.fp for r in rows if r.component_id == 5}
    assert len(bits) == 2 and sum(r.component_id == 5 for r in rows) == 2 and {r.doc_id for r in rows if r.component_id == 5} == {5, None}
    kept = simhash.thin_out(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, near(0)), (0, far(1)), (9, far(2))])


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(n)) for n in (0, 1, 3, 4, 5, 90, 1000)] + [None, "  "]
    expected = [fingerprint(t or "") for t in texts]
    for block in (7, 1 << 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprint_texts(texts).tolist() == expected


# --- 7 and 9


def test_slices_of_empty_texts(spark):
    from groundspark.llm import bpe, token_output

    docs = spark.createDataFrame([(n, ("", None)[n % 2]) for n in range(5)], "doc_id long, text string").coalesce(1)
    assert {r.n_tokens for r in bpe.round_trip(docs).collect()} == {0} and {r.n_tokens for r in token_output.write(docs).read().collect()} == {1}


def test_the_word_store_is_emptied_when_full():
    from groundspark.llm import bpe

    words, _ = bpe.encoder("byte_bpe_50k.json")
    rng = random.Random(1)
    small, whole = (bpe.WordStore(words.merge, words.special, words.split, most) for most in (10, 10**6))
    for _ in range(20):
        texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(rng.randrange(9))) for _ in range(5)]
        assert all((a == b).all() for a, b in zip(small.encode(texts), whole.encode(texts), strict=True))


# --- 8


def test_a_long_conversation(spark):
    rows = [(1, n, ("user", "assistant")[n % 2], f"turn {n} <x> \\ " * 20) for n in range(6000)]
    got = chat_format.read_back(chat_format.format_turns(chat_format.turns_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)))).first()
    assert [t.text for t in got.turns] == [r[3] for r in rows] and got.loss_text == "".join(r[3] for r in rows if r[2] == "assistant")


# --- 10


def test_spans_apart_equal_the_plain_test():
    rng = random.Random(3)
    for _ in range(3000):
        draw = lambda n: [(a, a + rng.randrange(1, 6), "x") for a in (rng.randrange(30) for _ in range(rng.randrange(n)))]
        own, free = sorted(draw(6)), draw(9)
        assert pii.apart_from(free, own) == [s for s in free if not any(s[0] < e and b < s[1] for b, e, _ in own)]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{n}@b.co token = {n:020d}a" for n in range(30_000))
    began = time.time()
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_email == 30_000 and time.time() - began < 60


def test_recall_of_every_kind(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta order number value near from with the and".split()
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        begin = rng.choice("345") + digits(14)
        return next(begin + c for c in "0123456789" if pii.luhn(begin + c))

    forms = {
        "email": (lambda: f"{rng.choice(words)}.{digits(2)}@mail{digits(1)}.example.com", "{}"), "email (at)": (lambda: f"{rng.choice(words)} (at) {rng.choice(words)}(dot)com", "{}"),
        "ip": (lambda: ".".join(str(rng.randrange(1, 256)) for _ in range(4)), "{}"), "card": (card, "{}"), "card in fours": (lambda: "-".join(re.findall("....", card())), "{}"),
        "phone": (lambda: f"+1 ({digits(3)}) 555-{digits(4)}", "{}"), "phone without +": (lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digits(4)}", "{}"),
        "secret": (lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), 'token = "{}"'), "secret key": (lambda: "sk_" + "".join(rng.choice("abcdefghijkXYZ0123456789") for _ in range(24)), "api_key: {}"),
        "ssn": (lambda: f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "{}"),
    }
    docs, gold = [], {}
    for n in range(600):
        name = rng.choice(list(forms))
        value = forms[name][0]()
        text = " ".join([*rng.choices(words, k=15), forms[name][1].format(value), *rng.choices(words, k=15)])
        docs.append((n, text + rng.choice(["", " version 1.2.3", " on 2024-03-05", " at 192.168", " see a@b"])))
        at = text.index(value)
        gold.setdefault(name, []).append((n, f"{name.split()[0]}:{at}:{at + len(value)}"))
    got = {r.doc_id: r.spans.split(",") for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for name, spans in gold.items():
        assert sum(x in got[n] for n, x in spans) >= 0.9 * len(spans), name
    assert sum(len([x for x in xs if x]) for xs in got.values()) <= 1.1 * len(docs)  # and little else


# --- 9


def test_hashed_words_equal_the_library(monkeypatch):
    """New and known words, long ones, special tokens, a store that is emptied, a table in which slots and first hashes collide."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from groundspark.llm import token_output

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = next(iter(plain.get_added_tokens_decoder().values())).content
    rng = random.Random(9)
    draw = lambda: "".join(rng.choice(["ab", " the", " word", "'s", "é", "中文", "\n\n", "  ", "12", "!?", "x" * 600, special, "😀"]) for _ in range(rng.randrange(60)))
    texts = [draw() for _ in range(300)] + ["", "y" * 5000]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(token_output, "_stores", {})
    store = token_output.library_store("byte_bpe_50k.json")
    hashes = token_output.HashedStore.hashes
    for most, narrow in ((10**6, False), (20, False), (10**6, True)):
        store.most = most
        store.clear()
        if narrow:
            monkeypatch.setattr(store, "hashes", lambda *a: [(h := hashes(store, *a))[0] % np.uint64(7) + np.uint64(1), h[1]])
        for at in range(0, len(texts), 37):
            ids, sizes = store.encode(texts[at : at + 37])
            ends = np.cumsum(sizes)
            assert [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)] == want[at : at + 37]


def test_rows_of_one_id_are_spread(spark):
    """A third of all rows have no id and one text: no part of the files holds them all."""
    from groundspark.llm import token_output

    docs = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), "id")).otherwise("one text").alias("text"))
    rows = token_output.encoded_chunks(docs, "byte_bpe_50k.json", 2).select("part", F.size("doc_ids").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in rows) == 900 and max(r.n for r in rows) < 250
    read = token_output.write(docs).read().orderBy("start").collect()
    assert [r.start for r in read] == [sum(x.n_tokens for x in read[:k]) for k in range(0, 900)] and [r.doc_id is None for r in read] == [True] * 300 + [False] * 600


# --- pipeline


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeats and clashing names, then an empty table, through every stage."""
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(None).cast("string") for c in ("lang", "source", "n_chars", "score", "ids", "key", "fp", "bucket", "owner", "_kept", "_leak", "_score", "root", "w")})
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns or k == 4
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
