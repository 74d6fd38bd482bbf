"""Lookups in a concept graph that grows with the tables: brands of parts, ingredients of suppliers, terms of customers, releases of months with orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts as C
from ..sources.tables import table


def letters(kind: str, key: Column) -> Column:
    """A name of twelve letters from a to p."""
    return F.substring(F.translate(F.md5(F.concat(F.lit(kind), key.cast("string"))), "0123456789abcdef", "abcdefghijklmnop"), 1, 12)


def graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """concepts, aliases, relations, corpus. Every 40th part has its predecessor's name, every 31st is retired; some ingredients have a precise form; corpora hold one, both or none."""
    k, none = F.col("k"), F.lit(None).cast("string")
    part = table(s, d, "part").select(F.col("p_partkey").alias("k"))
    supplier = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = letters("b", F.when((k % 40 == 0) & (k > 0), k - 1).otherwise(k))
    rows = lambda df, kind, name, synonym, tty, active: df.select(F.concat(F.lit(kind), k.cast("string")).alias("rxcui"), name.alias("name"), synonym.alias("synonym"), F.lit(tty).alias("tty"), active.alias("active"))
    brands = rows(part, "b", name, F.when(k % 5 == 0, F.concat(F.upper(name), F.lit("-XR"))), "BN", k % 31 != 0)
    plain, precise = letters("s", k), F.concat(letters("s", k), F.lit(" sodium"))
    salts = supplier.filter(k % 3 == 0)
    concepts = brands.unionByName(rows(supplier, "s", plain, none, "IN", F.lit(True))).unionByName(rows(salts, "p", precise, none, "PIN", F.lit(True)))
    aliases = brands.join(part.filter(k % 10 == 3).select(F.concat(F.lit("b"), k.cast("string")).alias("rxcui")), "rxcui").select("rxcui", F.concat("name", F.lit(" tablets")).alias("alias"))
    held = part.select(F.concat(F.lit("b"), k.cast("string")).alias("b"), F.floor(k / 20).alias("k")).join(supplier, "k")
    edge = lambda df, a, b, tty: df.select(a.alias("rxcui"), b.alias("related_rxcui"), F.lit(tty).alias("related_tty"))
    of = lambda kind: F.concat(F.lit(kind), k.cast("string"))
    relations = edge(held, F.col("b"), of("s"), "IN").unionByName(edge(held, of("s"), F.col("b"), "BN")).unionByName(edge(held.filter(k % 3 == 0), F.col("b"), of("p"), "PIN"))
    corpus = supplier.filter(k % 4 != 0).select(plain.alias("concept_name")).unionByName(supplier.filter((k % 12 == 0) | (k % 9 == 3)).select(precise.alias("concept_name")))
    return concepts, aliases, relations, corpus


def asked_terms(s: SparkSession, d: str) -> DataFrame:
    """A term for each customer: a brand as it is, in capitals, with a letter missing, with two wrong, with a suffix; some are empty."""
    k = F.col("c_custkey")
    n = letters("b", k)
    forms = [n, F.concat(F.lit("  "), F.upper(n), F.lit(" ")), F.concat(F.substring(n, 1, 4), F.substring(n, 6, 7)), F.concat(F.upper(n), F.lit("-XR")), F.concat(F.lit("q"), F.substring(n, 2, 10), F.lit("q")), F.concat(n, F.lit(" tablets"))]
    return table(s, d, "customer").select(F.when(k % 97 == 0, "").otherwise(F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))).alias("term"))


def concept_version(s: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    months = table(s, d, "orders").groupBy(F.date_format(day, "yyyy-MM").alias("m")).agg(F.max(day).alias("published"))
    return C.release(months.select(F.date_format("published", "yyyy-MM-dd").alias("version"), F.concat(F.lit("3."), F.substring("m", 1, 4)).alias("api_version"), "published"))


def concept_properties(s: SparkSession, d: str) -> DataFrame:
    """Properties by ids of customers' numbers, of which some are no part's."""
    k = F.col("c_custkey")
    ids = table(s, d, "customer").select(F.concat(F.when(k % 7 == 0, "z").otherwise("b"), k.cast("string")).alias("rxcui"))
    return C.properties(ids, graph(s, d)[0])


def concept_related(s: SparkSession, d: str) -> DataFrame:
    concepts, _, relations, _ = graph(s, d)
    return C.related_by_type(concepts, relations, concepts).select("rxcui", F.col("related.rxcui").alias("related_rxcui"), F.col("related.name").alias("related_name"), F.col("related.tty").alias("related_tty"))


def normalize_drug(s: SparkSession, d: str) -> DataFrame:
    """The normalisation frame, candidates as text."""
    concepts, aliases, relations, corpus = graph(s, d)
    line = lambda x: F.concat_ws(":", x["candidate"]["rxcui"], x["candidate"]["match_method"], x["candidate"]["score"].cast("string"), x["candidate"]["rank"].cast("string"), F.array_join(F.transform(x["related_ingredients"], lambda i: i["rxcui"]), "+"), F.array_join(x["corpus_matches"], "+"))
    found = C.normalised(asked_terms(s, d), concepts, aliases, relations, corpus)
    return found.select("input_term", "status", "corpus_concept", F.array_join("corpus_matches", ",").alias("corpus_matches"), F.col("selected.rxcui").alias("selected_rxcui"), F.coalesce(F.array_join(F.transform("candidates", line), ","), F.lit("")).alias("candidates"))


def queries() -> dict:
    return {"concept_version": concept_version, "concept_properties": concept_properties, "concept_related": concept_related, "normalize_drug": normalize_drug}


def _letters(kind: str, key: str) -> str:
    return f"substring(translate(md5('{kind}' || ({key})), '0123456789abcdef', 'abcdefghijklmnop'), 1, 12)"


_NORMAL = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_BRAND = _letters("b", "CASE WHEN p_partkey % 40 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END")
_SALT = _letters("s", "s_suppkey")
_GRAPH = f"""cc AS (SELECT 'b' || p_partkey AS rxcui, {_BRAND} AS name, CASE WHEN p_partkey % 5 = 0 THEN upper({_BRAND}) || '-XR' END AS synonym, 'BN' AS tty, p_partkey % 31 <> 0 AS active FROM part
UNION ALL SELECT 's' || s_suppkey, {_SALT}, NULL, 'IN', true FROM supplier UNION ALL SELECT 'p' || s_suppkey, {_SALT} || ' sodium', NULL, 'PIN', true FROM supplier WHERE s_suppkey % 3 = 0),
rl AS (SELECT 'b' || p_partkey AS rxcui, 's' || s_suppkey AS related_rxcui FROM part JOIN supplier ON p_partkey // 20 = s_suppkey UNION ALL SELECT 'b' || p_partkey, 'p' || s_suppkey FROM part JOIN supplier ON p_partkey // 20 = s_suppkey WHERE s_suppkey % 3 = 0)"""
_TERM = f"""CASE WHEN c_custkey % 97 = 0 THEN '' ELSE trim([n, '  ' || upper(n) || ' ', substring(n, 1, 4) || substring(n, 6, 7), upper(n) || '-XR', 'q' || substring(n, 2, 10) || 'q', n || ' tablets'][c_custkey % 6 + 1]) END"""


def oracle_sql() -> dict[str, str]:
    return {
        "concept_version": "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS version, '3.' || year(max(o_orderdate)) AS api_version FROM orders",
        "concept_properties": f"WITH {_GRAPH}, ids AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'z' ELSE 'b' END || c_custkey AS rxcui FROM customer) SELECT rxcui, name, synonym, tty, name IS NOT NULL AS known FROM ids LEFT JOIN cc USING (rxcui)",
        "concept_related": f"WITH {_GRAPH} SELECT rl.rxcui, related_rxcui, cc.name AS related_name, cc.tty AS related_tty FROM rl JOIN cc ON cc.rxcui = related_rxcui",
        "normalize_drug": f"""WITH {_GRAPH}, co AS (SELECT {_SALT} AS own FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT {_SALT} || ' sodium' FROM supplier WHERE s_suppkey % 12 = 0 OR s_suppkey % 9 = 3),
            nm AS (SELECT rxcui, active, text, {_NORMAL("text")} AS normal FROM (SELECT rxcui, active, name AS text FROM cc UNION ALL SELECT rxcui, active, synonym FROM cc WHERE synonym IS NOT NULL UNION ALL SELECT rxcui, active, name || ' tablets' FROM cc WHERE rxcui LIKE 'b%' AND substring(rxcui, 2)::BIGINT % 10 = 3)),
            tm AS (SELECT DISTINCT term, {_NORMAL("term")} AS normal FROM (SELECT {_TERM} AS term FROM (SELECT c_custkey, {_letters("b", "c_custkey")} AS n FROM customer))),
            ex AS (SELECT term, rxcui FROM tm JOIN nm ON text = term), nz AS (SELECT term, rxcui FROM tm JOIN nm USING (normal) WHERE term NOT IN (SELECT term FROM ex)), ez AS (SELECT DISTINCT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM nz)),
            ap AS (SELECT term, rxcui, min(struct_pack(e := e, o := other)) AS c, max(len) AS len FROM (SELECT term, rxcui, levenshtein(tm.normal, nm.normal) AS e, nm.normal AS other, length(tm.normal) AS len FROM tm JOIN nm ON active AND length(tm.normal) >= 5 AND abs(length(tm.normal) - length(nm.normal)) <= 2 AND levenshtein(tm.normal, nm.normal) <= 2 WHERE term NOT IN (SELECT term FROM ez)) GROUP BY 1, 2),
            ar AS (SELECT term, rxcui, (100 * (greatest(len, length(c.o)) - c.e)) // greatest(len, length(c.o)) AS score, row_number() OVER (PARTITION BY term ORDER BY c.e, c.o, rxcui) AS rank FROM ap),
            fd AS (SELECT term, rxcui, 'exact_or_normalized' AS m, NULL AS score, NULL AS rank FROM ez UNION ALL SELECT term, rxcui, 'approximate', score, rank FROM ar WHERE rank <= 5),
            ing AS (SELECT rxcui, list(DISTINCT i ORDER BY i) AS ing FROM (SELECT rxcui, related_rxcui AS i FROM rl UNION ALL SELECT rxcui, rxcui FROM cc WHERE tty IN ('IN', 'PIN')) GROUP BY 1),
            mt AS (SELECT x.rxcui, list(DISTINCT own ORDER BY own) AS ms FROM (SELECT rxcui, rxcui AS i FROM cc UNION ALL SELECT rxcui, related_rxcui FROM rl) x JOIN cc ON cc.rxcui = i JOIN co ON {_NORMAL("own")} IN ({_NORMAL("cc.name")}, {_NORMAL("cc.synonym")}) GROUP BY 1),
            w AS (SELECT term, fd.rxcui, coalesce(rank, 0) AS place, coalesce(ms, []) AS ms, concat_ws(':', fd.rxcui, m, score, rank, array_to_string(coalesce(ing, []), '+'), array_to_string(coalesce(ms, []), '+')) AS line FROM fd LEFT JOIN ing USING (rxcui) LEFT JOIN mt USING (rxcui)),
            p AS (SELECT term, string_agg(line, ',' ORDER BY place, rxcui) AS lines, list_sort(list_distinct(flatten(list(ms)))) AS cm, arg_min(rxcui, struct_pack(place := place, r := rxcui)) FILTER (len(ms) > 0) AS first FROM w GROUP BY 1)
            SELECT term AS input_term, CASE WHEN lines IS NULL THEN 'no_rxnorm_match' WHEN len(cm) = 0 THEN 'rxnorm_match_no_corpus_match' WHEN len(cm) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN len(cm) = 1 THEN cm[1] END AS corpus_concept,
              coalesce(array_to_string(cm, ','), '') AS corpus_matches, CASE WHEN len(cm) = 1 THEN first END AS selected_rxcui, coalesce(lines, '') AS candidates FROM tm LEFT JOIN p USING (term)""",
    }
