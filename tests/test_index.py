"""The positional index against plain searches of every text; the English analysis against published examples."""

import random

import pytest
from pyspark.sql import functions as F

from groundspark.functions import english as E
from groundspark.operators import index as I
from groundspark.sources import sinks

#: Words and stems from the published description of the stemmer.
PUBLISHED = "consigned consign consistency consist consolatory consolatori conspirators conspir knackeries knackeri kneaded knead generally general communication communic skies sky dying die flies fli ties tie gas gas kiwis kiwi agreed agre hopping hop hoping hope happy happi say say organization organ adjustable adjust sensational sensat rational ration news news proceeding proceed".split()


def test_stems_as_published():
    assert [E.stem(w) for w in PUBLISHED[::2]] == PUBLISHED[1::2]
    for forms in ("warn warns warning warnings warned", "dose doses dosing dosed", "therapy therapies", "hope hopes hoping hoped"):
        assert len({E.stem(w) for w in forms.split()}) == 1


def test_the_sql_stemmer_is_the_same():
    import duckdb

    rng = random.Random(1)
    ends = [*E.STEP2, *E.STEP3, *E.STEP4, "s", "es", "ed", "ing", "ingly", "edly", "eed", "y", "ies", "ll", "e", ""]
    words = {"".join(rng.choice("abcdeilnorsty") for _ in range(rng.randrange(1, 6))) + rng.choice(ends) + rng.choice(["", "", "s", "ing", "ly"]) for _ in range(4000)} | {*PUBLISHED, *E.WHOLE, *E.KEPT_AFTER_PLURAL}
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS w", [sorted(words)])
    assert dict(con.execute(f"WITH {E.stem_sql('words')} SELECT w, stem FROM stems").fetchall()) == {w: E.stem(w) for w in words}


def test_web_queries():
    assert E.parse_web_query('"liver warning" or -dose') == [[["liver", "warn"]], [["-", "dose"]]]
    assert E.parse_web_query('"the risk of the liver"') == [[["risk", "", "", "liver"]]]
    assert E.parse_web_query("the of") == E.parse_web_query(None) == E.parse_web_query(" ") == []


def test_cover_density():
    assert E.cover_density([[[1], [2]]]) == 0.1 and E.cover_density([[[1], [9]]]) == pytest.approx(0.1 / 8)
    # Stretches with none, one and 34 words between: 0.15285714, as logged for two words in a label's section.
    assert round(sum(E.cover_density([[[1], [1 + d]]]) for d in (1, 2, 35)), 8) == 0.15285714
    text = "liver warnings x liver x x warning"
    assert E.match_score(E.parse_web_query("liver warning"), E.analysed(text)) == pytest.approx(0.1 + 0.1 / 2 + 0.1 / 3)
    assert E.match_score(E.parse_web_query("liver or warning"), E.analysed(text)) == pytest.approx(0.4)
    assert E.match_score(E.parse_web_query('"x liver"'), E.analysed(text)) == pytest.approx(0.1)
    assert E.match_score(E.parse_web_query("liver -x"), E.analysed(text)) is None and E.match_score(E.parse_web_query("dose"), E.analysed(text)) is None


def plain_covers(alternatives, at):
    """Each shortest stretch with all items of an alternative, by trying all; items are words."""
    sets = [[set(at.get(s, ())) for (s,) in a] for a in alternatives]
    marks = sorted({p for items in sets for places in items for p in places})
    full = lambda b, e: any(all(any(b <= p <= e for p in places) for places in items) for items in sets if all(items))
    total = 0.0
    for i, b in enumerate(marks):
        for j in range(i, len(marks)):
            if full(b, marks[j]):
                if i + 1 > j or not full(marks[i + 1], marks[j]):
                    total += 0.1 / (1 + marks[j] - b - (j - i))
                break
    return total


def test_covers_equal_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        at = E.analysed(" ".join(rng.choice(["liver", "warn", "dose", "x", "y", "the"]) for _ in range(rng.randrange(25))))
        asked = [[["liver"], ["warn"], ["dose"]], [["x"], ["dose"]]][: rng.randrange(1, 3)]
        assert (E.match_score(asked, at) or 0) == pytest.approx(plain_covers(asked, at))


WORDS = "report reports reported house houses houses' thing things the of running runs big liver".split()
QUERIES = ["reports of things", '"big house" thing', "house or running -report", "the of", "-thing", "", '-"big thing" runs', "house -house", None, "house", "liver or big or thing", "nowhere house", "nowhere or liver", '"house of things"']


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return {n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) for n in range(300)} | {999: None, 1000: "big liver " * 3000 + "house"}


@pytest.fixture(scope="module")
def index(spark, texts):
    docs = spark.createDataFrame([*texts.items(), (None, "house")], "k long, t string").repartition(4)
    return I.build(docs, "k", "t", sinks.new_folder(spark, "test-index"), block_docs=20)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(str(n), q) for n, q in enumerate(QUERIES)], "query_id string, query string")


def best(texts, query, fits=lambda k: True):
    found = [(k, E.match_score(E.parse_web_query(query), E.analysed(t))) for k, t in texts.items() if fits(k)]
    return sorted(((k, round(s, 6)) for k, s in found if s is not None), key=lambda x: (-x[1], x[0]))


def of(rows, n):
    return [(r.key, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == str(n)]


def test_every_match_is_found(index, asked, texts):
    rows = I.search(index, asked).collect()
    assert all(of(rows, n) == best(texts, q) for n, q in enumerate(QUERIES)) and len(rows) > 300


@pytest.mark.parametrize("k", [1, 3, 10])
def test_the_best_are_found_with_pruning(index, asked, texts, k, monkeypatch):
    seen = []
    scored = I.scored
    monkeypatch.setattr(I, "scored", lambda blocks, *a: seen.append(blocks.count()) or scored(blocks, *a))
    rows = I.search(index, asked, k).collect()
    assert all(of(rows, n) == best(texts, q)[:k] for n, q in enumerate(QUERIES))
    if k == 1:
        monkeypatch.undo()
        all_blocks = I.searched_blocks(index, I.asked(asked), index.postings()).count()
        assert len(seen) == 2 and sum(seen) < all_blocks  # some blocks' bounds don't reach the best


def test_filters_hold_before_the_best_are_taken(index, asked, texts):
    rows = I.search(index, asked, 2, keep=lambda met: met.filter(F.col("key") % 7 == 0)).collect()
    assert all(of(rows, n) == best(texts, q, lambda k: k % 7 == 0)[:2] for n, q in enumerate(QUERIES))


def test_an_empty_index(spark, asked):
    empty = I.build(spark.createDataFrame([], "k long, t string"), "k", "t", sinks.new_folder(spark, "test-index"))
    assert I.search(empty, asked, 3).count() == 0 and I.search(empty, asked.limit(0)).count() == 0


def test_postings_are_made_where_documents_lie(spark):
    """No shuffle of the words: blocks are of documents that lie together, whatever the number of partitions."""
    docs = spark.range(100).selectExpr("id AS k", "concat('house number ', id, ' house') AS t").repartition(9)
    made = I.posted(docs, "k", "t", block_docs=8)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == docs._jdf.queryExecution().executedPlan().toString().count("Exchange")
    rows = made.filter("term = 'hous'").collect()
    assert sorted(k for r in rows for k in r["keys"]) == list(range(100)) and all(r.n == len(r["keys"]) <= 8 and r["keys"] == sorted(r["keys"]) for r in rows)
    assert all(r.most == 2 and len(r.places) == 8 * r.n and r.starts == list(range(0, 2 * r.n, 2)) for r in rows)
    assert len({r.block for r in rows}) == len(rows)


def test_numbers_of_words_are_the_analysis():
    stems, text = E.Stems(), "The liver's warnings, warned of the LIVER; 12 Yes ñandú"
    at = {}
    for place, number in enumerate(stems.numbers(text)):
        if number >= 0:
            at.setdefault(stems.names[number], []).append(place)
    assert at == E.analysed(text) and stems.numbers(None).tolist() == []
