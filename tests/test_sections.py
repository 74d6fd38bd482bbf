"""The section tree: repeated ids, nesting, what sections inherit, intervals."""

import random

import pytest
from pyspark.sql import functions as F

from groundspark.operators import sections as S


def label(*bodies):
    return '<document xmlns="urn:hl7-org:v3"><component><structuredBody>' + "".join(f"<component>{b}</component>" for b in bodies) + "</structuredBody></component></document>"


def section(uid=None, *inside, code=None, title=None, text=None):
    own = (f'<id root="{uid}"/>' if uid else "") + (f'<code code="{code}" displayName="shown {code}"/>' if code else "") + (f"<title>{title}</title>" if title else "") + (f"<text>{text}</text>" if text else "")
    return f"<section>{own}" + "".join(f"<component>{x}</component>" for x in inside) + "</section>"


def tree(spark, *xmls):
    rows = spark.createDataFrame([(str(k), x) for k, x in enumerate(xmls)], "label_id string, xml string")
    return S.section_tree(rows)


def test_repeated_ids_give_a_row_a_section(spark):
    rows = tree(spark, label(*(section(x) for x in "aabcc")), label(section("a", section("a", section("a", code="34084-4"), title="x")))).orderBy("label_id", "order_index").collect()
    assert [r.section_uid for r in rows] == [*"aabcc", *"aaa"]
    inner = rows[5:]
    assert [(r.order_index, r.parent_index, r.last_index, r.depth) for r in inner] == [(1, None, 3, 0), (2, 1, 3, 1), (3, 2, 3, 2)]
    assert [r.retrieval_family for r in inner] == [None, None, "adverse_reactions"] and inner[2].heading_path == ["a", "x", "shown 34084-4"]


def test_a_deep_label(spark):
    xml = section("bottom", text="t")
    for k in range(150):
        xml = section(f"s{k}", xml, code="34084-4" if k == 149 else None)
    rows = tree(spark, label(xml)).orderBy("order_index").collect()
    assert len(rows) == 151 and rows[-1].depth == 150 and rows[-1].retrieval_family_source_section_uid == "s149" and len(rows[-1].heading_path) == 151
    assert {r.last_index for r in rows} == {151}


def test_what_sections_inherit_equals_a_walk(spark):
    rng = random.Random(8)

    def grown(depth):
        own = {"code": rng.choice(["34084-4", "34066-1", "42229-5", None, "x"]), "title": rng.choice([None, "1 Uses", "Pregnancy", "Other"])}
        return own, [grown(depth + 1) for _ in range(rng.randrange(0, 4 - depth))]

    def xml(node):
        return section(rng.choice([None, "same"]), *map(xml, node[1]), **node[0], text="t" * rng.randrange(5))

    roots = [grown(0) for _ in range(6)]
    want = []

    def walk(node, name, family, depth):
        code, title = node[0]["code"], (node[0]["title"] or "").upper().removeprefix("1 ")
        own = S.CODES.get(code) or S.TITLES.get(title)
        name, family = own or name, own if own in S.FAMILIES else family
        at = len(want)
        want.append(None)
        for child in node[1]:
            walk(child, name, family, depth + 1)
        want[at] = (at + 1, depth, own, name, family, len(want) - at - 1)

    for r in roots:
        walk(r, None, None, 0)
    t = tree(spark, label(*map(xml, roots))).cache()
    got = t.join(S.subtree_totals(t), ["label_id", "order_index"]).orderBy("order_index").collect()
    assert [(r.order_index, r.depth, r.canonical_section_name, r.nearest_canonical_section_name, r.retrieval_family, r.descendants) for r in got] == want
    inside = {r.order_index: [x for x in got if r.order_index < x.order_index <= r.last_index] for r in got}
    assert all(r.subtree_chars == r.direct_char_count + sum(x.direct_char_count for x in inside[r.order_index]) for r in got)
    below = S.below(t, t.filter("depth = 0")).collect()
    assert len(below) == sum(len(inside[r.order_index]) for r in got if r.depth == 0)
    assert S.hierarchy_violations(t).count() == 0


@pytest.mark.parametrize("xml", ["<broken", None, "", "<document/>"])
def test_labels_without_sections(spark, xml):
    assert tree(spark, xml, label(section("a"))).count() == 1


def test_labels_are_parsed_once(spark):
    """What joins a tree with itself reads it written, and doesn't parse the labels for each side; more sections than are handed over at once are all there."""
    from groundspark.operators import sections as operators

    xml = "<document><component><structuredBody>" + "<component><section/></component>" * 30 + "</structuredBody></component></document>"
    labels = spark.range(200).selectExpr("cast(id as string) as label_id", f"'{xml}' as xml")
    tree = operators.section_tree(labels)
    for got in (operators.hierarchy_violations(tree), operators.subtree_totals(tree)):
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert operators.subtree_totals(tree).count() == 6000


def test_labels_heads_as_their_fields(spark):
    """Parsed once, the same as by path; labels of a table in one file are dealt out."""
    from groundspark.plans import sections as plans

    d = "/root/testdata/sf0.001"
    made = plans.labels(spark, d)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {r[0]: tuple(r)[1:] for r in S.label_heads(made).collect()}
    fields = {r[0]: tuple(r)[1:] for r in S.document_fields(made).selectExpr("label_id", "set_id", "version_number", "title", "size(routes)").collect()}
    parts = {r[0]: tuple(r)[1:] for r in S.products(made).groupBy("label_id").agg(F.countDistinct("product_index"), F.count("ingredient_index")).collect()}
    assert got == {k: (*v, *parts.get(k, (0, 0))) for k, v in fields.items()}
    odd = S.label_heads(spark.createDataFrame([("a", "<document><title>  x  y </title><title>z</title></document>"), ("b", "<document"), ("c", None)], "label_id string, xml string"))
    assert {r[0]: tuple(r)[1:] for r in odd.collect()} == {"a": (None, None, "x  y", 0, 0, 0), "b": (None,) * 6, "c": (None,) * 6}


def test_document_fields_are_read_once(spark):
    """As the paths find them; a label that doesn't parse has nulls and stops nothing."""
    odd = [
        ("a", "<document><id root=''/><id root='b'/><title> </title><title>z</title><code displayName='d'/><code code='c'/></document>"),
        ("b", "<document xmlns='urn:h'><title>a<b> c</b><![CDATA[ <x>]]> &amp; e</title><setId/><setId root=' s '/><x><title>no</title><routeCode displayName=''/><activeMoiety><activeMoiety><name>one<!--k-->two<i>in</i>three</name><name> </name><name/></activeMoiety><name>not</name></activeMoiety><representedOrganization><name>F &lt; G</name></representedOrganization></x></document>"),
        ("c", "<v:document xmlns:v='u'><v:id v:root='1'/><v:routeCode v:displayName='R'/></v:document>"),
        ("d", "<other><document><id root='1'/></document><routeCode displayName='A'/><a><routeCode/><routeCode displayName='B'/></a></other>"),
        ("e", "<?xml version='1.0' encoding='ISO-8859-1'?><document><title>é x</title><versionNumber value='&#233;'/></document>"),
    ]
    good = spark.createDataFrame(odd, "label_id string, xml string")
    path = lambda p: F.nullif(F.trim(F.xpath_string("xml", F.lit(p))), F.lit(""))
    lists = {"routes": "//routeCode/@displayName", "active_moieties": "//activeMoiety/activeMoiety/name/text()", "labeler_names": "//representedOrganization/name/text()"}
    wanted = good.select("label_id", *(path(f"/document/{element}" + f"/@{attribute}" * bool(attribute)).alias(field) for field, (element, attribute) in S.HEAD.items()), *(F.xpath("xml", F.lit(p)).alias(c) for c, p in lists.items()))
    rows = good.unionByName(spark.createDataFrame([("bad", "<document>"), ("none", None), ("empty", "")], "label_id string, xml string"))
    made = S.document_fields(rows)
    assert "xpath" not in made._jdf.queryExecution().toString()
    got = {r.label_id: tuple(r)[1:] for r in made.collect()}
    assert [got.pop(k) for k in ("bad", "none", "empty")] == [(None,) * 10] * 3
    assert got == {r.label_id: tuple(r)[1:] for r in wanted.collect()}


def test_sections_in_odd_places(spark):
    """Only those whose component lies in a body or in a section of the tree."""
    xml = "<structuredBody><component><section><title>a<b>c</b> d</title><text>x<t>y</t></text><text/><component><section><section/><component><x/><section><id root=' r ' extension='e'/></section></component></section></component><q><component><section><component><section/></component></section></component></q></section></component></structuredBody>"
    got = S.section_nodes(spark.createDataFrame([("k", xml)], "label_id string, xml string")).orderBy("order_index").collect()
    assert [(r.section_uid, r.parent_index, r.last_index, r.depth, r.raw_title, r.direct_text, r.child_count, len(r.chain)) for r in got] == [
        ("synthetic_section_1", None, 3, 0, "ac d", "x y", 1, 1), ("synthetic_section_2", 1, 3, 1, None, None, 1, 2), ("r:e", 2, 3, 2, None, None, 0, 3),
    ]
