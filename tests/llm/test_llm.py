"""The ten operators against brute force, library results and exact round trips, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from groundspark.llm import bpe, chat_format, components, decontaminate, exact_dedup, html_extract, license_scan, pii, quality, simhash, token_output

DATA = "/root/testdata/sf0.001"
#: Texts with everything awkward; doc 3 and 4 are repeats of each other, 7 has a row twice.
ODD = [
    (1, None), (2, ""), (3, "Same TEXT here and there, too"), (4, "same text HERE and there, too"), (5, "   \n\t "), (6, "É same text"), (7, "x <|endoftext|> it's 'tis 12345 ½ 中文 😀"),
    (7, "x <|endoftext|> it's 'tis 12345 ½ 中文 😀"), (8, "word " * 20000), (9, "a@b.co, +1 (743) 555-3824, 10.0.0.1, 4785380592391139, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""), (None, "no id"), (10, "Under the MIT License."), (11, "one two"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns named like the operators' own."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({c: F.lit("clash") for c in ("score", "ids", "n_tokens", "key", "fp", "spans", "part", "h", "quality", "w")}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id")


# --- 1


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    got = quality.op1_quality(spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id")
    own = got[got.held_out]
    assert (own.predicted == own.quality).mean() > 0.95
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out, strict=True))


def test_quality_odd(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd.select("doc_id", "text"), empty)
    got = quality.score(odd, model)
    assert got.count() == len(ODD) and {r.score for r in got.collect()} == {0.5} and set(odd.columns) == set(got.columns)
    assert quality.score(none, model).count() == 0
    assert quality.keep_good(odd, empty).columns == odd.columns


def test_ngrams_follow_the_text():
    from groundspark.llm._common import utf8
    import pyarrow as pa

    row, _ = quality.ngram_cells(*utf8(pa.array(["", None, "a b", "a b", "***"])))
    assert set(row.tolist()) == {2, 3, 4}
    r, c = quality.ngram_cells(*utf8(pa.array(["q", "a b c"])))
    s, d = quality.ngram_cells(*utf8(pa.array(["a b c"])))
    assert c[r == 1].tolist() == d.tolist()


# --- 2


def test_lcs_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_extract.common_places(a, b)
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(any(a[k] == y for y in rest) for k in got)


def test_pages_whatever_the_ranges(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randrange(9)}.x/{rng.choice('abc')}/{rng.randrange(30)}", "".join(f"<div>{rng.choice('tuvw')} line {rng.randrange(4)}</div>" for _ in range(rng.randrange(7)))) for i in range(60)]
    place = {r[0]: html_extract.place(r[1]) for r in rows}
    order = sorted(rows, key=lambda r: (place[r[0]], r[0]))
    expected = {}
    for i, r in enumerate(order):
        near = [order[k] for k in (i - 1, i + 1) if 0 <= k < len(order) and place[order[k][0]][0] == place[r[0]][0]]
        lines = html_extract.lines_of(r[2])[0]
        gone = set(html_extract.common_places([hash(x) for x in lines], [hash(x) for x in html_extract.lines_of(near[0][2])[0]])) if near else set()
        expected[r[0]] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_page_marks(spark):
    page = '<html><head><title>t</title></head><body><div id=cookie-notice>We use</div><header>top</header><main><h1>A&amp;B</h1><p>one <b>two<br>three<p>four<ul><li>x<li>y</ul><div class="share-box">tweet</div><section id="comments"><p>nice</p></section></main><script>if(a<b){}</script><footer>f</footer>'
    rows = [(1, "http://a/x", page), (2, None, None), (3, "http://[bad", ""), (1, "http://a/x", page), (None, "http://b", "<p>plain"), (5, "http://b/c", "<article>" + "long text " * 50000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1))).collect()
    assert sorted(r.text for r in got if r.page_id == 1) == ["A&B\none two three\nfour\nx\ny"] * 2
    assert len(got) == 6 and {r.text for r in got if r.page_id in (2, 3)} == {""} and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mirrored_and_repeated_pages_keep_their_text(spark):
    """Pages without article markup: in groups of mirrors and repeats only what the template shares with other pages goes."""
    page = lambda body: "".join(f"<div>{x}</div>" for x in ("Our site", *body, "Imprint of the site"))
    bodies = [[f"{w} body {k}" + " of some length" * 9 for k in range(4)] for w in ("alpha", "beta", "gamma")]
    rows = [(n, f"http://m.x/{g}/{n:02}", page(body)) for g, body in enumerate(bodies) for n in range(g * 20, g * 20 + 12)]
    rows += [rows[0]] * 5 + [rows[20]] * 5 + [(90, "http://one.x/a", page(bodies[0]))] * 3 + [(91, "http://one.x/b", page(bodies[0]))]
    rows += [(92, "http://in.x/a", "<article><div>Menu</div><div>first text</div></article>")] * 2 + [(93, "http://in.x/b", "<article><div>Menu</div><div>second text</div></article>")]  # short: folded as equal rows
    own = {n: "\n".join(body) for g, body in enumerate(bodies) for n in range(g * 20, g * 20 + 12)}
    own |= {n: "\n".join(["Our site", *bodies[0], "Imprint of the site"]) for n in (90, 91)} | {92: "first text", 93: "second text"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 30):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
            assert sorted((r.page_id, r.text) for r in got) == sorted((r[0], own[r[0]]) for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- 3


def test_directory_splits_only_what_is_full():
    cells = np.zeros(1 << 10, np.int64)
    cells[[0, 1, 2, 700]] = [90, 5, 5, 3]
    d = exact_dedup.Directory(cells, 10)
    held = np.bincount(d.bucket(np.arange(1 << 10, dtype=np.uint64) << np.uint64(54)), cells)
    assert d.depth == 10 and sorted(held[held > 10]) == [90] and exact_dedup.Directory(cells, 1000).depth == 0


def test_exact_dedup_odd(odd, none):
    got = exact_dedup.exact_groups(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD)
    assert (by[3].keep_id, by[4].keep_id, by[3].group_size, by[4].kept, by[3].kept) == (4, 4, 2, True, False)
    assert by[1].keep_id == 2 and by[1].text_sha256 == hashlib.sha256(b"").hexdigest() and by[6].group_size == 1
    assert sum(r.doc_id == 7 for r in got) == 2 and by[7].group_size == 2 and by[None].kept
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.deduplicate(odd).columns == odd.columns


def test_equal_keys_are_chained(odd):
    """Texts that share a key stay apart by their bytes."""
    entries = odd.sparkSession.createDataFrame([(0, 0, 1, 5, 1, b"a"), (1, 0, 1, 7, 2, b"b"), (0, 0, 1, 6, 1, b"a")], "owner int, bucket int, key long, last long, n long, text binary")
    assert sorted((r.keep_id, r.group_size) for r in exact_dedup.index(entries.withColumn('owner', F.lit(0)), 2).collect()) == [(6, 2), (7, 2)]


# --- 4


def test_license_base(spark, documents):
    w = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = rows_of(license_scan.op4_license_scan(spark, DATA))
    for d, t in zip(documents.doc_id, documents.text, strict=True):
        words = w.findall(t.translate(lower))
        at = sorted((i, label) for p, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at}))


def test_license_template_and_odd(spark, odd, none):
    text = "intro words " + license_scan.TEMPLATES[0][0].replace("free of charge", "free  of, all charge") + " end"
    more = spark.createDataFrame([(50, text)], "doc_id long, text string")
    got = license_scan.scan(odd.select("doc_id", "text").unionByName(more)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) + 1 and by[50].labels == "mit" and by[50].base_labels == "" and 0.6 <= by[50].score <= 1
    assert by[10].base_labels == "mit" and by[10].first_word == 0 and by[1].n_words == 0 and by[1].score == 0 and by[8].n_words == 20000
    assert license_scan.scan(none).count() == 0


# --- 5


def test_leaks_equal_brute_force(spark, documents):
    w = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = lambda t: {tuple(x[i : i + 5]) for x in [w.findall(t.lower())] for i in range(len(x) - 4)}
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()
    items = {i: grams(t) for i, t in zip(items.item_id, items.text, strict=True)}
    expected = {(d, i, len(q & s)) for d, t in zip(documents.doc_id, documents.text, strict=True) for s in [grams(t)] for i, q in items.items() if q and len(q & s) >= 0.8 * len(q) - 1e-9}
    assert {(r.doc_id, r.item_id, r.shared) for r in decontaminate.op5_decontaminate(spark, DATA).collect()} == expected and expected


def test_leaks_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "same text here and there too"), (5, "not found"), (None, "no id")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()}
    assert found == {(11, 1), (3, 4), (4, 4), (None, None)}
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7, 7, 8, 9, 10]


# --- 6


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= simhash.MOST_BITS) + i + 1:
            p, q = find(i), find(int(j))
            root[max(p, q)] = min(p, q)
    return [ids[find(i)] for i in range(len(a))]


def fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, documents):
    got = simhash.op6_simhash(spark, DATA).toPandas().sort_values("doc_id")
    fps = [fingerprint(t) for t in documents.text]
    assert got.fingerprint.tolist() == [f"{v:016x}" for v in fps]
    assert got.component_id.tolist() == brute_components(fps, documents.doc_id.tolist())


def test_tiled_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng, fps = random.Random(3), set()
    for _ in range(10):
        base = rng.getrandbits(64)
        for _ in range(120):
            v = base
            for _ in range(rng.randrange(12)):
                v ^= 1 << rng.randrange(64)
            fps.add(v)
    fps = sorted(fps)
    classes = spark.createDataFrame([(i, simhash.signed(v)) for i, v in enumerate(fps)], "id long, fp long")
    roots = {r.id: r.root for r in components.components(simhash.links(classes)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(fps, list(range(len(fps))))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    roots = {r.id: r.root for r in components.components(links).collect()}
    assert all(roots[i] == 0 for i in range(61)) and roots[101] == 100


def test_simhash_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == by[5].component_id == 1
    assert by[3].component_id == by[4].component_id == 3 and by[None].component_id is None
    assert simhash.near_duplicates(none).count() == 0 and simhash.thin_out(odd).columns == odd.columns


# --- 7 and 9


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(tokenizer, documents):
    rng = random.Random(5)
    texts = [t or "" for _, t in ODD] + documents.text.tolist()[:40] + ["don't 's'therefore ''s I'M they've'd", "a  b\n\n c \n", "aaaaaaaaaaaaa", "x\u0085y \x1c\x1d", "n" * 5000]
    texts += ["".join(rng.choice("ab 's\n\t  tldver é1!.' 中<|endoftext|>") for _ in range(rng.randrange(60))) for _ in range(1500)]
    words, store = bpe.encoder("byte_bpe_50k.json")
    ids, counts = store.encode(texts)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        expected = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == expected, t
        assert words.decode(ids[at : at + n]).decode() == tokenizer.decode(expected, skip_special_tokens=False)
        at += n


def test_bpe_odd(odd, none, tokenizer):
    got = bpe.round_trip(odd).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert all(r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in got)
    assert bpe.round_trip(none).count() == 0
    back = bpe.decode(bpe.encode(odd)).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_huffman_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 1000, 50000):
        counts = (rng.pareto(0.5, n) * 3 + 1).astype(np.int64)
        lengths = token_output.code_lengths(counts)
        assert lengths.max() <= token_output.MOST_BITS and (n < 2 or (2.0 ** -lengths).sum() == 1)
        ids = rng.integers(0, n, 3001)
        _, marks, payload = token_output.pack(ids, token_output.canonical_codes(lengths), lengths)
        assert (token_output.unpack(payload, marks, len(ids), *token_output.decoding_table(lengths)) == ids).all()


def test_token_files(spark, odd, none, tokenizer, documents):
    got = token_output.op9_token_output(spark, DATA).toPandas().sort_values("doc_id")
    ids = [e.ids + [2] for e in tokenizer.encode_batch(documents.text.tolist(), add_special_tokens=False)]
    sizes = [len(x) for x in ids]
    assert got.n_tokens.tolist() == sizes and got.start.tolist() == (np.cumsum(sizes) - sizes).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    own = token_output.write(odd).read().orderBy("start").collect()
    assert len(own) == len(ODD) and own[0].doc_id is None and [r.n_tokens for r in own if r.doc_id in (1, 2)] == [1, 1]
    assert token_output.write(none).read().count() == 0


# --- 8


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\b <turn> </turn>\n ### \\l"), (1, 1, "assistant", "<x>\\"), (1, 2, "a\nb", None), (2, None, None, "t"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "assistant", "end")]
    got = rows_of(chat_format.read_back(chat_format.format_turns(chat_format.turns_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss_mask", F.lit(1))))), "conv_id")
    assert [(t.role, t.text) for t in got[1].turns] == [("user", rows[0][3]), ("assistant", "<x>\\"), ("a\nb", "")] and got[1].loss_text == "<x>\\"
    assert [(t.role, t.text) for t in got[2].turns] == [("", "t"), ("assistant", ""), ("assistant", "")] and got[None].loss_text == "end"
    assert chat_format.format_turns(chat_format.turns_of_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_layouts(spark):
    records = ['{"prompt":"a","completion":"b"}', '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}', '{"instruction":"do","input":"","output":"done"}', '{"odd":1}', "no json", None]
    got = chat_format.turns_of_records(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "n int, record string").withColumn("turns", F.lit(1))).orderBy("n").collect()
    assert [r.layout for r in got] == ["prompt", "messages", "conversations", "instruction with input", None, None, None]
    assert [[(t.role, t.text) for t in r.turns] for r in got[:4]] == [[("user", "a"), ("assistant", "b")], [("user", "hi"), ("assistant", "yo")], [("user", "q"), ("assistant", "r")], [("user", "do"), ("assistant", "done")]]


def test_chat_layouts_with_further_keys(spark):
    records = [
        ('{"id":1,"messages":[{"role":"user","content":"hi","name":"n"},{"role":"assistant","content":"yo"}]}', "messages", [("user", "hi"), ("assistant", "yo")]),
        ('{"messages":[{"role":"system"},{"role":"user","content":"q"}],"meta":{"a":[1]}}', "messages", [("system", None), ("user", "q")]),
        ('{"source":"s","completion":"b","prompt":"[{\\"x\\":1}]"}', "prompt", [("user", '[{"x":1}]'), ("assistant", "b")]),
        ('{"instruction":"do","output":"done","tag":null}', "instruction", [("user", "do"), ("assistant", "done")]),
        ('{"instruction":"do","input":"it","output":"done","n":1}', "instruction with input", [("user", "do"), ("user", "it"), ("assistant", "done")]),
        ('{"messages":[{"role":"user"}],"id":2}', None, []), ('{"prompt":[{"a":1}],"completion":"b"}', None, []), ("[]", None, []), ('{"id":1,"id":2,"prompt":"a","completion":"b"}', "prompt", [("user", "a"), ("assistant", "b")]),
    ]
    got = chat_format.turns_of_records(spark.createDataFrame([(i, r[0]) for i, r in enumerate(records)], "n int, record string")).orderBy("n").collect()
    assert [(r.layout, [(t.role, t.text) for t in r.turns]) for r in got] == [x[1:] for x in records]


def test_rows_are_selected_by_fingerprint(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "t", "more")], "conv_id long, turn long, role string, text string, further string")
    assert chat_format.mapping_of(spark, rows.schema).name == "turn rows" and chat_format.mapping_of(spark, rows.drop("role").schema) is None
    monkeypatch.setattr(chat_format, "fingerprint", lambda paths: F.xxhash64(F.rand()))
    with pytest.raises(ValueError):
        chat_format.turns_of_rows(rows)


# --- 10


def test_pii_base(spark, documents):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def fits(kind, span):
        digits = re.sub("[^0-9]", "", span)
        total = sum(v // 10 + v % 10 for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])))
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in span.split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]

    got = rows_of(pii.op10_pii(spark, DATA))
    for d, t in zip(documents.doc_id, documents.text, strict=True):
        spans = sorted((m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(patterns) for m in re.finditer(p, t) if fits(kind, m[0]))
        text = ",".join(f"{k}:{a}:{e}" for a, _, k, e in spans)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(got[d].spans.split(","))


def test_pii_loose_spans_are_whole():
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("abcdefXYZ0123456789") for _ in range(n))
    for value, kind, form in [
        (draw(3000), "secret", "api_key = '{}' ok"), (f"{draw(36)}.{draw(400)}.{draw(43)}", "secret", "token: {}. Next"), (f"{draw(100)}(at){draw(70)}.org", "email", "to {} ok"),
        ("a.b [at] c-d [dot] com", "email", "x {} y"), (draw(200000), "secret", "token={}"),
    ]:
        text = form.format(value)
        start = text.index(value)
        assert (start, start + len(value), kind) in pii.loose_spans(text), text[:80]
        if kind == "secret":
            assert pii.votes(text, start, start + len(value), kind, False) == [2, 2, 2, 2, 2, 2]
    plain = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]+)+")
    for _ in range(20000):
        text = "".join(rng.choice(["a", "b", ".", " ", "(at)", "[at]", "(dot)", "-"]) for _ in range(rng.randrange(16)))
        assert pii.loose_emails(text) == [(m.start(), m.end(), "email") for m in plain.finditer(text)], text


def test_pii_patterns_read_long_runs_once():
    rng = random.Random(6)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    for _ in range(20000):
        text = "".join(rng.choice("a+é@@..-1 ") for _ in range(rng.randrange(24)))
        text += ".".join(str(rng.randrange(300)) for _ in range(rng.randrange(10)))
        spans = pii.base_spans(text)
        for kind, p in plain.items():
            assert [(s, e) for s, e, k in spans if k == kind] == [m.span() for m in re.finditer(p, text) if pii.base_valid(kind, m[0])], text
    assert pii.base_spans("x" * 1_000_000 + " a@b.co " + "1" * 1_000_000) == [(1_000_001, 1_000_007, "email")]


def test_pii_odd(odd, none):
    got = pii.find(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and (by[9].n_email, by[9].n_ip, by[9].n_phone) == (1, 1, 1) and by[1].spans == "" and by[1].n_email == 0
    assert pii.find(none).count() == 0


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    v = np.stack([np.where(rng.random(4000) < 0.9, truth, ~truth) + 1 for _ in range(4)] + [rng.integers(1, 3, 4000) for _ in range(2)], 1)
    posterior, said = pii.reliabilities(v, np.ones(len(v)))
    assert ((posterior > 0.5) == truth).mean() > 0.93 and said[1, 0, 2] > 0.8 and abs(said[1, 5, 2] - 0.5) < 0.1


# --- pipeline


def test_pipeline_equals_brute_force(spark, documents):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA)
    scores = rows_of(quality.op1_quality(spark, DATA))
    docs = {d: t for d, t in zip(documents.doc_id, documents.text, strict=True) if scores[d].predicted}
    last = {}
    for d, t in docs.items():
        last[t.encode().lower()] = max(d, last.get(t.encode().lower(), d))
    docs = {d: t for d, t in docs.items() if last[t.encode().lower()] == d}
    ids = sorted(docs)
    roots = brute_components([fingerprint(docs[d]) for d in ids], ids)
    leaking = {r.doc_id for r in decontaminate.op5_decontaminate(spark, DATA).collect()}
    expected = {d for d, r in zip(ids, roots, strict=True) if d == r} - leaking
    rows = got.collect()
    assert {r.doc_id for r in rows} == expected and len(rows) == len(expected)
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)


# --- queries with SQL


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op5_decontaminate", "op8_chat_format"])
def test_equals_duckdb(spark, name):
    import duckdb

    from groundspark.llm import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    said = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in said.description]
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr(list(r)) for r in said.fetchall())
