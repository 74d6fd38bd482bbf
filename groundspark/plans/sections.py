"""Section queries. Titles are made from parts and pages; labels are XML documents made from customers and their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import section_title
from ..operators import sections as S
from ..sources.sinks import materialised
from ..sources.tables import spread, table

#: What parts' types and sizes choose from.
RAW = ["1 INDICATIONS AND USAGE", "8.1 Pregnancy", " Questions  or comments?", "DO NOT USE ", "Something else", "12.3 Pharmacokinetics:", None, "warnings"]
CODE = ["34066-1", "42229-5", None, "99999-9", "34084-4"]


def pick(xs: list, n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (n + 1).cast("int"))


def titled(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", pick(CODE, k % 5).alias("loinc_code"), pick(RAW, F.floor(k / 5) % 8).alias("raw_title"), F.when(k > 1, F.floor(k / 2)).alias("parent"))


def labels(s: SparkSession, d: str) -> DataFrame:
    return label_files(table(s, d, "customer"), table(s, d, "orders"))


def label_files(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """A label for each customer: products by its number, and for each of its orders a section, under which may be another, and another under that. Some ids repeat, beside and inside each other."""
    k = F.col("o_orderkey")
    code = pick(CODE, k % 5)
    own_id = F.when(k % 4 == 1, F.format_string('<id root="n%d"/>', k)).when(k % 4 == 2, '<id root="twice"/>').when(k % 4 == 3, F.format_string('<id root="n%d" extension="e"/>', k)).otherwise("")
    title = F.when(k % 3 == 1, "<title>6.1 Pregnancy</title>").when(k % 3 == 2, F.concat(F.lit("<title>Part "), "o_orderstatus", F.lit("</title>"))).otherwise("")
    grandchild = F.when(k % 6 == 0, "<component><section/></component>").otherwise("")
    child = F.concat(F.lit("<component><section>"), F.when(k % 4 == 2, '<id root="twice"/>').otherwise(""), F.lit("<title>"), F.when(k % 8 == 0, "Uses").otherwise(F.concat(F.lit("Inner "), "o_orderstatus")), F.lit("</title><text>inner</text>"), grandchild, F.lit("</section></component>"))
    section = F.concat(F.lit("<component><section>"), own_id, F.coalesce(F.concat(F.lit('<code code="'), code, F.lit('" displayName="x"/>')), F.lit("")), title, F.lit("<text>About <b>"), "o_orderstatus", F.lit("</b> &amp; more</text>"), F.when(k % 2 == 0, child).otherwise(""), F.lit("</section></component>"))
    inside = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", section.alias("x")))), lambda r: r["x"]), "").alias("body"))
    c = F.col("c_custkey")
    count = lambda n: F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), n.cast("int"))

    def ingredient(m: Column) -> Column:
        core = F.when(m == 1, F.format_string("<activeMoiety><activeMoiety><name>core %d</name></activeMoiety></activeMoiety>", c % 4)).otherwise("")
        return F.concat(
            F.format_string('<ingredient classCode="%s"><quantity><numerator value="%d" unit="mg"/><denominator value="1" unit="1"/></quantity>', F.when(m == 1, "ACTIB").otherwise("IACT"), c % 10 + 1),
            F.format_string('<ingredientSubstance><code code="U%d"/><name>stuff %d</name>', m, m), core, F.lit("</ingredientSubstance></ingredient>"),
        )

    def product(i: Column) -> Column:
        form = F.when((c + i) % 2 == 0, "TABLET").otherwise("CAPSULE")
        head = F.format_string('<manufacturedProduct><manufacturedProduct><name>Pill %d</name><code code="c%d"/><formCode displayName="%s"/>', c % 7, i, form)
        return F.concat(head, F.array_join(F.transform(count((c + i) % 3), ingredient), ""), F.lit("</manufacturedProduct></manufacturedProduct>"))

    route = lambda name, given: F.when(given, f'<substanceAdministration><routeCode displayName="{name}"/></substanceAdministration>').otherwise("")
    routes = F.concat(F.lit("<manufacturedProduct><consumedIn>"), route("ORAL", c % 2 == 0), route("TOPICAL", c % 5 == 0), F.lit("</consumedIn></manufacturedProduct>"))
    firm = F.when(c % 3 != 0, F.format_string("<author><representedOrganization><name>Firm %d</name></representedOrganization></author>", c % 6)).otherwise("")
    head = F.format_string('<document xmlns="urn:hl7-org:v3"><id root="d%d"/><setId root="set%d"/><versionNumber value="%d"/><title> A  label %d </title>', c, c, c % 5 + 1, c)
    products = F.array_join(F.transform(count(c % 3), product), "")
    xml = F.concat(head, firm, F.lit("<component><structuredBody><component><section><subject>"), products, routes, F.lit("</subject></section></component>"), F.coalesce("body", F.lit("")), F.lit("</structuredBody></component></document>"))
    return spread(customer.select("c_custkey")).join(inside, "c_custkey", "left").select(c.cast("string").alias("label_id"), xml.alias("xml"))


def broken(tree: DataFrame) -> DataFrame:
    """The tree with some rows made wrong: a parent that isn't there, a root below depth 0, a depth that skips one, a path that lacks a heading."""
    at, root = F.col("order_index"), F.col("parent_index").isNull()
    return tree.withColumns({
        "parent_index": F.when(~root & (at % 7 == 0), -1).otherwise(F.col("parent_index")), "depth": F.when(root & (at % 8 == 2), 1).when(~root & (at % 9 == 0), 3).otherwise(F.col("depth")),
        "heading_path": F.when(~root & (at % 11 == 0), F.slice("heading_path", 1, 1)).otherwise(F.col("heading_path")),
    })


def bad(s: SparkSession, d: str) -> DataFrame:
    """Labels that don't parse have a row each and fail nothing else."""
    cut = labels(s, d).withColumn("xml", F.when(F.col("label_id").cast("int") % 2 == 1, F.substring("xml", 1, 200)).otherwise(F.col("xml")))
    return S.bad_labels(cut, S.section_tree(cut)).withColumn("status", F.lit("not parsed"))


def filldown(s: SparkSession, d: str) -> DataFrame:
    rows = S.mapped(titled(s, d)).withColumn("family", F.when(S.is_family(F.col("canonical_section_name")), F.col("canonical_section_name")))
    return S.filled_down(rows, "p_partkey", "parent", "family")


def below_families(s: SparkSession, d: str) -> DataFrame:
    """Of each section that is a family itself, what is below it."""
    tree = materialised(S.section_tree(labels(s, d)).select("label_id", "order_index", "last_index", "depth", "retrieval_family_source_section_uid", "canonical_section_name", "retrieval_family"))  # parsed once for both sides
    roots = tree.filter(F.col("retrieval_family_source_section_uid").isNotNull() & (F.col("canonical_section_name") == F.col("retrieval_family")))
    return S.below(tree, roots).select("label_id", "root_index", "order_index", "depth")


def queries() -> dict:
    q = {"family_filldown": filldown}
    q["title_normalise"] = lambda s, d: titled(s, d).select("p_partkey", section_title(F.col("raw_title")).alias("title"))
    q["canonical_map"] = lambda s, d: S.mapped(titled(s, d)).select("p_partkey", "normalized_title", "canonical_section_name", "mapping_method")
    q["unmapped_reason"] = lambda s, d: S.mapped(titled(s, d)).filter("mapping_method = 'unmapped'").groupBy(S.unmapped_reason(F.col("loinc_code"), F.col("normalized_title")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    q["section_tree"] = lambda s, d: S.section_tree(labels(s, d)).select("label_id", "section_uid", "parent_section_uid", "order_index", "parent_index", "last_index", "depth", "canonical_section_name", "nearest_canonical_section_name", "retrieval_family", "direct_text", F.array_join("heading_path", " > ").alias("heading"))
    q["section_subtrees"] = lambda s, d: S.subtree_totals(S.section_tree(labels(s, d)))
    q["sections_below"] = below_families
    q["document_fields"] = lambda s, d: S.document_fields(labels(s, d)).select("label_id", "set_id", "version_number", "title")
    q["label_products"] = lambda s, d: S.products(labels(s, d))
    q["hierarchy_check"] = lambda s, d: S.hierarchy_violations(broken(S.section_tree(labels(s, d))))
    q["label_measures"] = lambda s, d: S.label_measures(S.section_tree(labels(s, d)), labels(s, d))
    q["section_facts"] = lambda s, d: S.section_tree(labels(s, d)).select("label_id", "section_uid", "mapping_method", "is_unclassified", "direct_text_sha256", "direct_char_count", "child_count", "retrieval_family_source_section_uid")
    q["label_lists"] = lambda s, d: S.document_fields(labels(s, d)).select("label_id", *(F.array_join(c, "|").alias(c) for c in ("routes", "active_moieties", "labeler_names")))
    q["structure_inspection"] = lambda s, d: S.structure(labels(s, d))
    q["bad_labels"] = bad
    q["page_titles"] = lambda s, d: table(s, d, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)), F.lit("")).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<h1>"), F.lit(0))).cast("long").alias("headings"))
    return q


def _list(xs: list) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"


_TITLED = rf"""t AS (SELECT p_partkey, {_list(CODE)}[p_partkey % 5 + 1] AS loinc_code, {_list(RAW)}[(p_partkey // 5) % 8 + 1] AS raw_title, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part),
n AS (SELECT *, nullif(upper(regexp_replace(regexp_replace(trim(regexp_replace(raw_title, '\s+', ' ', 'g')), '^\d+(\.\d+)*\s+', ''), '^[ :;?]+|[ :;?]+$', '', 'g')), '') AS normalized_title FROM t)"""
_PAIRS = lambda pairs: ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())
_MAPPED = f"""{_TITLED}, codes(c, v) AS (VALUES {_PAIRS(S.CODES)}), titles(c, v) AS (VALUES {_PAIRS(S.TITLES)}),
m AS (SELECT n.*, coalesce(codes.v, titles.v) AS canonical_section_name, CASE WHEN codes.v IS NOT NULL THEN 'loinc' WHEN titles.v IS NOT NULL THEN 'title' ELSE 'unmapped' END AS mapping_method FROM n LEFT JOIN codes ON codes.c = loinc_code LEFT JOIN titles ON titles.c = normalized_title)"""


#: The sections that ``labels`` holds: label, place, parent's place, depth, uid, code, title, text, canonical name, family of its own; then with what they inherit.
_TREE = f"""WITH om AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, {_list(CODE)}[o_orderkey % 5 + 1] AS code, 1 + coalesce(sum(1 + (o_orderkey % 2 = 0)::INT + (o_orderkey % 6 = 0)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM orders JOIN customer ON c_custkey = o_custkey),
            tr AS (SELECT c_custkey AS c, 1 AS o, NULL AS po, 1 AS lo, 0 AS dep, NULL AS id, NULL AS code, NULL AS title, NULL AS txt, 0 AS kids FROM customer
              UNION ALL SELECT c, base + 1, NULL, base + 1 + (k % 2 = 0)::INT + (k % 6 = 0)::INT, 0, CASE k % 4 WHEN 1 THEN 'n' || k WHEN 2 THEN 'twice' WHEN 3 THEN 'n' || k || ':e' END, code, CASE k % 3 WHEN 1 THEN '6.1 Pregnancy' WHEN 2 THEN 'Part ' || st END, 'About ' || st || ' & more', (k % 2 = 0)::INT FROM om
              UNION ALL SELECT c, base + 2, base + 1, base + 2 + (k % 6 = 0)::INT, 1, CASE WHEN k % 4 = 2 THEN 'twice' END, NULL, CASE WHEN k % 8 = 0 THEN 'Uses' ELSE 'Inner ' || st END, 'inner', (k % 6 = 0)::INT FROM om WHERE k % 2 = 0
              UNION ALL SELECT c, base + 3, base + 2, base + 3, 2, NULL, NULL, NULL, NULL, 0 FROM om WHERE k % 6 = 0),
            tn AS (SELECT c, c::VARCHAR AS label_id, o::INT AS o, po::INT AS po, lo::INT AS lo, dep, coalesce(id, 'synthetic_section_' || o::INT) AS uid, code, title, txt, kids, CASE code WHEN '34084-4' THEN 'adverse_reactions' WHEN '34066-1' THEN '{S.CODES['34066-1']}' ELSE CASE title WHEN '6.1 Pregnancy' THEN 'pregnancy' WHEN 'Uses' THEN 'uses' END END AS canon FROM tr),
            tc AS (SELECT *, coalesce(title, CASE WHEN code IS NOT NULL THEN 'x' END, uid) AS head FROM tn),
            tf AS (SELECT *, CASE WHEN canon <> 'pregnancy' THEN canon END AS own FROM tc),
            t AS (SELECT a.*, b.uid AS parent, coalesce(a.canon, b.canon, g.canon) AS near, coalesce(a.own, b.own, g.own) AS family, CASE WHEN a.own IS NOT NULL THEN a.uid WHEN b.own IS NOT NULL THEN b.uid WHEN g.own IS NOT NULL THEN g.uid END AS fam, concat_ws(' > ', g.head, b.head, a.head) AS heading, a.dep + 1 AS plen FROM tf a LEFT JOIN tf b ON b.c = a.c AND b.o = a.po LEFT JOIN tf g ON g.c = a.c AND g.o = b.po)"""

_PRODUCTS = """WITH p AS (SELECT c_custkey AS c, unnest(range(1, c_custkey % 3 + 1)) AS i FROM customer), m AS (SELECT c, i, unnest(CASE WHEN (c + i) % 3 = 0 THEN [NULL] ELSE range(1, (c + i) % 3 + 1) END) AS m FROM p)
            SELECT c::VARCHAR AS label_id, i::INT AS product_index, 'Pill ' || c % 7 AS product_name, 'c' || i AS product_code, CASE WHEN (c + i) % 2 = 0 THEN 'TABLET' ELSE 'CAPSULE' END AS dosage_form_display_name, m::INT AS ingredient_index, CASE WHEN m = 1 THEN 'ACTIB' WHEN m > 1 THEN 'IACT' END AS class_code, 'stuff ' || m AS ingredient_name, 'U' || m AS unii_code,
            CASE WHEN m IS NOT NULL THEN (c % 10 + 1)::VARCHAR END AS strength_numerator_value, CASE WHEN m IS NOT NULL THEN 'mg' END AS strength_numerator_unit, CASE WHEN m IS NOT NULL THEN '1' END AS strength_denominator_value, CASE WHEN m IS NOT NULL THEN '1' END AS strength_denominator_unit FROM m"""


def oracle_sql() -> dict[str, str]:
    families = ", ".join(f"'{f}'" for f in sorted(S.FAMILIES))
    return {
        "title_normalise": f"WITH {_TITLED} SELECT p_partkey, normalized_title AS title FROM n",
        "canonical_map": f"WITH {_MAPPED} SELECT p_partkey, normalized_title, canonical_section_name, mapping_method FROM m",
        "unmapped_reason": f"WITH {_MAPPED} SELECT CASE WHEN loinc_code = '42229-5' THEN CASE WHEN normalized_title IS NOT NULL THEN 'unclassified_with_title' ELSE 'unclassified_no_title' END WHEN loinc_code IS NOT NULL THEN CASE WHEN normalized_title IS NOT NULL THEN 'coded_but_not_in_mapper' ELSE 'coded_no_title_not_in_mapper' END WHEN normalized_title IS NOT NULL THEN 'title_only_not_in_mapper' ELSE 'no_code_no_title' END AS reason, count(*) AS n FROM m WHERE mapping_method = 'unmapped' GROUP BY 1",
        "family_filldown": f"WITH RECURSIVE {_MAPPED}, f AS (SELECT p_partkey, parent, CASE WHEN canonical_section_name IN ({families}) THEN canonical_section_name END AS family FROM m), w AS (SELECT p_partkey, family AS nearest, parent AS up FROM f UNION ALL SELECT w.p_partkey, f.family, f.parent FROM w JOIN f ON w.up = f.p_partkey WHERE w.nearest IS NULL) SELECT p_partkey, max(nearest) AS nearest FROM w GROUP BY 1",
        "document_fields": "SELECT c_custkey::VARCHAR AS label_id, 'set' || c_custkey AS set_id, (c_custkey % 5 + 1)::VARCHAR AS version_number, 'A  label ' || c_custkey AS title FROM customer",
        "hierarchy_check": f"""{_TREE}, b AS (SELECT label_id, uid, o, CASE WHEN po IS NOT NULL AND o % 7 = 0 THEN -1 ELSE po END AS po, CASE WHEN po IS NULL AND o % 8 = 2 THEN 1 WHEN po IS NOT NULL AND o % 9 = 0 THEN 3 ELSE dep END AS dep, CASE WHEN po IS NOT NULL AND o % 11 = 0 THEN 1 ELSE plen END AS plen FROM t),
            j AS (SELECT b.*, u.dep AS up FROM b LEFT JOIN b u ON u.label_id = b.label_id AND u.o = b.po), v AS (SELECT label_id, uid AS section_uid, o AS order_index, CASE WHEN po IS NOT NULL AND up IS NULL THEN 'missing parent' WHEN po IS NULL AND dep <> 0 THEN 'root not at depth 0' WHEN dep <> up + 1 THEN 'depth' WHEN plen <> dep + 1 THEN 'path length' END AS problem FROM j) SELECT * FROM v WHERE problem IS NOT NULL""",
        "label_measures": f"""{_TREE} SELECT label_id, 'set' || c AS set_id, (c % 5 + 1)::VARCHAR AS version_number, 'A  label ' || c AS title, ((c % 2 = 0)::INT + (c % 5 = 0)::INT)::BIGINT AS route_count, count(*) AS section_count, count(canon) AS direct_mapped_section_count, count(*) - count(canon) AS direct_unmapped_section_count, count(fam) AS retrieval_family_covered_section_count, count(*) - count(fam) AS retrieval_family_missing_section_count,
            count(*) FILTER (code = '42229-5') AS unclassified_section_count, max(dep)::BIGINT AS max_section_depth, (c % 3)::BIGINT AS product_count, (CASE WHEN c % 3 > 0 THEN (c + 1) % 3 ELSE 0 END + CASE WHEN c % 3 > 1 THEN (c + 2) % 3 ELSE 0 END)::BIGINT AS ingredient_count FROM t GROUP BY label_id, c""",
        "section_facts": f"{_TREE} SELECT label_id, uid AS section_uid, CASE WHEN code IN ('34084-4', '34066-1') THEN 'loinc' WHEN canon IS NOT NULL THEN 'title' ELSE 'unmapped' END AS mapping_method, coalesce(code = '42229-5', false) AS is_unclassified, sha256(txt) AS direct_text_sha256, coalesce(length(txt), 0)::INT AS direct_char_count, kids AS child_count, fam AS retrieval_family_source_section_uid FROM t",
        "label_lists": """SELECT c_custkey::VARCHAR AS label_id, concat_ws('|', CASE WHEN c_custkey % 2 = 0 THEN 'ORAL' END, CASE WHEN c_custkey % 5 = 0 THEN 'TOPICAL' END) AS routes,
            concat_ws('|', CASE WHEN c_custkey % 3 > 0 AND (c_custkey + 1) % 3 > 0 THEN 'core ' || c_custkey % 4 END, CASE WHEN c_custkey % 3 > 1 AND (c_custkey + 2) % 3 > 0 THEN 'core ' || c_custkey % 4 END) AS active_moieties, CASE WHEN c_custkey % 3 <> 0 THEN 'Firm ' || c_custkey % 6 ELSE '' END AS labeler_names FROM customer""",
        "structure_inspection": f"{_TREE} SELECT label_id, o AS section_index, dep AS depth, code, (txt IS NOT NULL)::INT AS text_node_count, kids AS direct_subsection_count, coalesce(length(txt), 0)::INT AS char_count_direct_text FROM t",
        "bad_labels": "SELECT c_custkey::VARCHAR AS label_id, 'not parsed' AS status FROM customer WHERE c_custkey % 2 = 1",
        "section_tree": f"{_TREE} SELECT label_id, uid AS section_uid, parent AS parent_section_uid, o AS order_index, po AS parent_index, lo AS last_index, dep AS depth, canon AS canonical_section_name, near AS nearest_canonical_section_name, family AS retrieval_family, txt AS direct_text, heading FROM t",
        "section_subtrees": f"{_TREE} SELECT a.label_id, a.o AS order_index, (count(*) - 1)::INT AS descendants, sum(coalesce(length(b.txt), 0))::BIGINT AS subtree_chars FROM t a JOIN t b ON a.c = b.c AND (b.o = a.o OR b.po = a.o OR b.po IN (SELECT o FROM t x WHERE x.c = a.c AND x.po = a.o)) GROUP BY 1, 2",
        "sections_below": f"{_TREE} SELECT b.label_id, a.o AS root_index, b.o AS order_index, b.dep AS depth FROM t a JOIN t b ON a.c = b.c AND b.o > a.o AND b.o <= a.lo WHERE a.own IS NOT NULL",
        "label_products": _PRODUCTS,
        "page_titles": "SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') AS title, len(regexp_extract_all(html, '<h1>')) AS headings FROM pages",
    }
