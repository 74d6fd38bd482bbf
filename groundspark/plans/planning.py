"""Planning queries over stated questions, questions formed for every customer, and the questions of users in conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning as P
from ..functions.english import STOP
from ..schemas import ALIASES, CONCEPT_RELATIONS, QUESTIONS
from ..sources.sinks import materialised
from ..sources.tables import spread, table

STATED = [
    ("q01", "What is omeprazole used for?", None, None), ("q02", "Can apixaban be taken with aspirin?", None, None), ("q03", "What are the side effects of sertraline?", None, None),
    ("q04", "What dose of omeprazole should I take?", None, None), ("q05", "Can metformin cause dangerous lactic acidosis?", None, None), ("q06", "What is omeprazole used for?", None, "clinical_studies"),
    ("q07", "Can Glucophage cause lactic acidosis?", None, None), ("q08", "Does Eliquis cure pneumonia?", None, None), ("q09", "Can Eliquis prevent stroke?", None, None),
    ("q10", "Is Eliquis the same as apixaban and can it prevent stroke?", None, None), ("q11", "Is Glucophage a brand name and what is it used for?", None, None), ("q12", "What is metformn?", None, None),
    ("q13", "What is the generic name of Glucophage?", "Glucophage", None), ("q14", "Is it safe for children?", "apixaban", None), ("q15", "Hello there", None, None),
    ("q16", "What is the active ingredient in Eliquis?", "unknownium", None), ("q17", "What is the brand name of metformin?", None, None), ("q18", "Do not take too much: dose and interaction", None, None), ("q19", "Größe of the dose?", None, None), ("q20", "What about dose and interaction?", None, None),
]
ALIAS_ROWS = [("metformin", "6809", "metformin", None, "IN"), ("Glucophage", "151827", "Glucophage", None, "BN"), ("apixaban", "1364430", "apixaban", None, "IN"), ("Eliquis", "1364435", "Eliquis", None, "BN"), ("omeprazole", "7646", "omeprazole", None, "IN"), ("sertraline", "36437", "sertraline", None, "IN")]
RELATION_ROWS = [("151827", "6809", "metformin", "IN"), ("1364435", "1364430", "apixaban", "IN"), ("6809", "151827", "Glucophage", "BN"), ("1364430", "1364435", "Eliquis", "BN")]
CORPUS = ["metformin", "apixaban", "omeprazole", "sertraline"]


#: What formed questions choose from by a customer's key: forms, names (some misspelt), explicit drugs.
FORMS = [
    "What is {x} used for?", "Can {x} be taken with {y}?", "What are the side effects of {x}?", "Can {x} cause dangerous lactic acidosis?", "Is {x} the same as {y} and can it prevent stroke?",
    "Is {x} a brand name and what is it used for?", "What is {x}?", "What is the generic name of {x}?", "What is the active ingredient in the {x}?", "What is the brand name of {x}?",
    "Is {x} equivalent to {y}?", "What is the brand name of {x} and how much of this drug is too much?", "Hello {x}", "Does {x} guarantee that I am cured?",
]
NAMES = ["metformin", "Glucophage", "apixaban", "Eliquis", "omeprazole", "sertraline", "metformn", "eliquiss", "aspirin"]
DRUGS = ["Glucophage", "apixaban", "unknownium", "Omeprazol"]
FAMILY_NAMES = ["indications_and_usage", "drug_interactions", "adverse_reactions", "dosage_and_administration", "overdosage"]
SENTENCES = ["{x} is used for a common condition and can prevent stroke", "do not take {x} with alcohol", "side effects of {x} are nausea and headache", "the usual dose of {x} is taken twice daily", "too much {x} can cause lactic acidosis", "what is known of {x} is in its label"]


def pick(xs: list, n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (n % len(xs) + 1).cast("int"))


def questions(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(*q, 5) for q in STATED], QUESTIONS)


def asked(s: SparkSession, d: str) -> DataFrame:
    """query_id, query, drug, family: the stated questions, one for each customer, and every user turn."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    query = F.replace(F.replace(pick(FORMS, k), F.lit("{x}"), pick(NAMES, k)), F.lit("{y}"), pick(NAMES, F.floor(k / 9)))
    formed = spread(table(s, d, "customer")).select(F.concat(F.lit("c"), k.cast("string")).alias("query_id"), query.alias("query"), F.when(k % 7 == 0, pick(DRUGS, F.floor(k / 7))).alias("drug"), none.alias("family"))
    turns = table(s, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"), none.alias("drug"), none.alias("family"))
    return questions(s).select("query_id", "query", "drug", "family").unionByName(formed).unionByName(turns)


def concepts(s: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return s.createDataFrame(ALIAS_ROWS, ALIASES), s.createDataFrame(RELATION_ROWS, CONCEPT_RELATIONS), s.createDataFrame([(c,) for c in CORPUS], "concept_name string")


def sections(s: SparkSession, d: str) -> DataFrame:
    """A section of a drug's label for each part."""
    k = F.col("p_partkey")
    text = F.concat(F.replace(pick(SENTENCES, F.floor(k / 20)), F.lit("{x}"), pick(CORPUS, k)), F.lit(". "), F.col("p_name"))
    return spread(table(s, d, "part")).select(k.alias("section_id"), pick(CORPUS, k).alias("concept_name"), pick(FAMILY_NAMES, F.floor(k / 4)).alias("family"), text.alias("text"))


def routed(q: DataFrame) -> DataFrame:
    s = q.sparkSession
    return P.source_route(P.family_plan(q).join(P.mentions(q, *concepts(s)), "query_id").withColumn("has_drug", F.col("retrieval_drug").isNotNull() | F.col("drug").isNotNull()))


#: What answers choose from by a customer's key: questions, answers, evidence, citation prefixes.
CLAIMS = ["Does {x} guarantee weight loss?", "Does {x} treat bacterial infections?", "Is {x} used for heartburn?", "Can {x} help with the flu?", "Is the dose safe?", "Will {x} cure a cold in the head?"]
SAID = ["Yes, it does.", "No, nothing is guaranteed.", "No, {x} does not treat bacterial infections.", "It cannot.", "no.", "used for heartburn", "results are not guaranteed"]
EVIDENCE = ["weight was lost in a study", "results are not guaranteed", "{x} is for stroke.", "It is not indicated for infections that are bacterial.", "used for heartburn", "not for a cold of the head"]
PREFIXES = [["E"], [], ["R", "E"], ["R"]]
OUTPUTS = [
    '{"status":"answered","answer":"{a}","citations":["E1"],"evidence_summary":"s"}', 'Sure: {"status":"answered","answer":"{a}","citations":["E9"]} done', "no json", '{"status":"answered","answer":"{a}","citations":["E1"]}',
    '{"status":"insufficient_evidence","answer":"unknown","citations":[]}', '{"status":"answered","answer":"{a}","citations":[]}', '{"status":"answered","answer":"{a}","citations":["E1","E2"]}', '{"status":"insufficient_evidence","answer":"{a}","citations":["E1"]}', '{"status":"answered","citations":["E1"]}',
]


def cases(s: SparkSession, d: str) -> DataFrame:
    """query_id, query, answer, cited, status, raw, evidence, prefixes: an answer to judge for each customer; every fifth row of output 3 has no evidence."""
    k = F.col("c_custkey")
    x = lambda c: F.replace(c, F.lit("{x}"), pick(CORPUS, k))
    t = table(s, d, "customer").select(k.alias("query_id"), x(pick(CLAIMS, k)).alias("query"), x(pick(SAID, F.floor(k / 6))).alias("answer"), x(pick(EVIDENCE, F.floor(k / 42))).alias("cited"), x(pick(EVIDENCE, F.floor(k / 42) + 1)).alias("other"), (k % 9).alias("v"), (k % 4).alias("p"))
    some = F.array(*(F.struct(F.lit(f"E{n}").alias("evidence_id"), F.col(c).alias("text")) for n, c in ((1, "cited"), (2, "other"))))
    lists = F.array(*(F.array(*(F.lit(y) for y in ys)).cast("array<string>") for ys in PREFIXES))
    return t.select(
        "query_id", "query", "answer", "cited", F.when(F.col("query_id") % 11 == 0, "insufficient_evidence").otherwise("answered").alias("status"),
        F.replace(pick(OUTPUTS, F.col("v")), F.lit("{a}"), F.col("answer")).alias("raw"), F.when((F.col("v") != 3) | (F.col("query_id") % 5 != 0), some).otherwise(F.array()).alias("evidence"), F.element_at(lists, (F.col("p") + 1).cast("int")).alias("prefixes"),
    )


def mixed(s: SparkSession, d: str) -> DataFrame:
    """The questions whose source is composed, with both parts' answers and the composition's status."""
    q = materialised(P.decomposed(routed(asked(s, d)).filter("planned_source = 'multi_source_composed'")))
    identity = P.identity_answers(P.identity_terms(q.select("query_id", F.col("identity_query").alias("query"), "identity_intent")), *concepts(s)[:2]).select("query_id", F.col("answered").alias("identity_answered"))
    clinical = P.label_answers(q.select("query_id", F.col("clinical_query").alias("query"), F.col("retrieval_drug").alias("drug"), F.col("plan_family").alias("family")), sections(s, d)).select("query_id", F.col("answered").alias("clinical_answered"))
    status = P.mixed_status(F.col("retrieval_drug"), F.col("identity_intent"), F.col("composition"), F.col("identity_answered"), F.col("clinical_answered"))
    return q.join(identity, "query_id").join(clinical, "query_id").select("query_id", "identity_answered", "clinical_answered", status.alias("composition_status"))


def citation_policy(s: SparkSession, d: str) -> DataFrame:
    """Citations of the raw answers that no evidence has, and whether all begin as they may."""
    cites = F.coalesce(P.parsed_answer(F.col("raw"))["citations"], F.array().cast("array<string>"))
    foreign = P.foreign_citations(cites, F.transform("evidence", lambda e: e["evidence_id"]))
    return cases(s, d).select("query_id", F.array_join(foreign, ",").alias("foreign"), P.prefixes_pass(cites, F.col("prefixes")).alias("prefixes_pass"))


def queries() -> dict:
    q = {}
    q["phrase_match"] = lambda s, d: P.signal_hits(asked(s, d), P.family_signals(s)).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    q["family_scores"] = lambda s, d: P.family_scores(asked(s, d)).select("query_id", "family", "intent", "score", F.array_join("signals", ",").alias("signals"))
    q["family_plan"] = lambda s, d: P.family_plan(asked(s, d)).select("query_id", "plan_status", "plan_family", "plan_intent")
    q["safety_regex"] = lambda s, d: asked(s, d).select("query_id", P.padded(F.col("query")).alias("t")).select("query_id", F.col("t").rlike(P.MODAL_CAUSE).alias("modal_cause"), P.any_phrase(F.col("t"), P.SAFETY).alias("safety"), P.any_phrase(F.col("t"), P.POPULATION).alias("population"))
    q["source_route"] = lambda s, d: routed(asked(s, d)).select("query_id", "route_status", "planned_source", "identity_intent")
    q["span_candidates"] = lambda s, d: P.candidate_spans(asked(s, d)).select("query_id", "place", "span")
    q["mention_detect"] = lambda s, d: P.mentions(asked(s, d), *concepts(s))
    q["resolve_term"] = lambda s, d: P.resolve_terms(P.candidate_spans(asked(s, d)).select(F.col("span").alias("term")), *concepts(s)).select("term", "match_method", "rxcui", "tty", "candidates", F.array_join("corpus_matches", ",").alias("corpus_matches"), "resolution")
    q["filter_resolution"] = lambda s, d: P.filter_resolution(asked(s, d), *concepts(s))
    q["identity_parse"] = lambda s, d: P.identity_terms(routed(asked(s, d)))
    q["identity_answers"] = lambda s, d: P.identity_answers(P.identity_terms(routed(asked(s, d))), *concepts(s)[:2]).select("query_id", "answered", "answer", F.array_join("citations", ",").alias("citations"))
    q["decompose_query"] = lambda s, d: P.decomposed(routed(asked(s, d))).select("query_id", "composition", "identity_query", "clinical_query")
    q["workflow"] = lambda s, d: P.workflow(asked(s, d), *concepts(s)).drop("query")
    q["label_evidence"] = lambda s, d: P.label_evidence(asked(s, d).select("query_id", "query", F.lit(None).cast("string").alias("drug"), "family"), sections(s, d)).select("query_id", F.size("evidence").alias("n"), F.md5(F.array_join(F.transform("evidence", lambda e: F.concat(e["evidence_id"], F.lit(" "), e["text"])), "\n")).alias("evidence_md5"))
    q["workflow_answers"] = lambda s, d: P.answers(asked(s, d), *concepts(s), sections(s, d)).withColumn("citations", F.array_join("citations", ","))
    q["guardrails"] = lambda s, d: cases(s, d).select("query_id", P.guarantee_blocked(F.col("query"), F.col("cited"), F.col("status")).alias("guarantee"), P.negative_treatment_blocked(F.col("query"), F.col("answer"), F.col("cited"), F.col("status")).alias("negative"), P.treatment_target(F.col("query")).alias("target"))
    q["json_extract"] = lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(P.json_object(F.concat(F.lit("said: "), F.col("props"), F.lit(" end"))), "$.k").cast("int").alias("k"))
    q["citation_policy"] = citation_policy
    q["answer_gates"] = lambda s, d: P.answer_gates(cases(s, d))
    q["mixed_gates"] = mixed
    return q


def _q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _l(xs: list) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _rows(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _q(v) for v in r) + ")" for r in rows) + ")"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


def _pick(xs: list, n: str) -> str:
    return f"{_l(xs)}[({n}) % {len(xs)} + 1]"


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_ASKED = f"""a AS (SELECT query_id, query, drug, family FROM {_rows(STATED)} t(query_id, query, drug, family)
UNION ALL SELECT 'c' || c_custkey, replace(replace({_pick(FORMS, "c_custkey")}, '{{x}}', {_pick(NAMES, "c_custkey")}), '{{y}}', {_pick(NAMES, "c_custkey // 9")}), CASE WHEN c_custkey % 7 = 0 THEN {_pick(DRUGS, "c_custkey // 7")} END, NULL FROM customer
UNION ALL SELECT conv_id || '-' || turn, text, NULL, NULL FROM conversations WHERE role = 'user'),
p AS (SELECT *, trim(regexp_replace(replace(lower(coalesce(query, '')), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS t FROM a),
sig AS (SELECT * FROM (VALUES {", ".join(f"({_q(ph)}, {_q(f)}, {_q(i)}, {w}, {n})" for n, (f, i, ph, w) in enumerate((f, i, ph, w) for (f, i), ps in P.FAMILY_SIGNALS.items() for ph, w in ps.items()))}) t(phrase, family_name, intent, weight, place)),
h AS (SELECT p.query_id, sig.* FROM p JOIN sig ON contains(' ' || t || ' ', ' ' || phrase || ' ')),
sc AS (SELECT query_id, family_name, intent, sum(weight)::BIGINT AS score, string_agg(phrase, ',' ORDER BY place) AS signals FROM h GROUP BY 1, 2, 3)"""
_ANY = lambda ps: "(" + " OR ".join(f"contains(' ' || t || ' ', ' {x} ')" for x in ps) + ")"
_MODAL = rf"regexp_matches(t, '{P.MODAL_CAUSE}')"


_BLANK = "regexp_replace(coalesce(family, ''), '^ +| +$', '', 'g') <> ''"
_PLAN = f"""{_ASKED}, top AS (SELECT query_id, max(score) AS top FROM sc GROUP BY 1), best AS (SELECT query_id, top, count(*) AS n, min(family_name) AS f, min(intent) AS i FROM sc JOIN top USING (query_id) WHERE score = top GROUP BY 1, 2),
z AS (SELECT p.*, top, n, f, i, {_MODAL} OR {_ANY(P.SAFETY)} AS safe, {_ANY(P.POPULATION)} AS pop FROM p LEFT JOIN best USING (query_id)),
y AS (SELECT *, CASE WHEN {_BLANK} THEN 'not_attempted_explicit_family_present' WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND top >= 2 THEN 'routed_single_family' WHEN safe OR pop THEN 'candidate_family_group_unfiltered' ELSE 'no_route_detected' END AS plan_status FROM z),
pl AS (SELECT query_id, query, t, drug, family, plan_status, CASE WHEN plan_status = 'routed_single_family' THEN f END AS plan_family, CASE WHEN plan_status = 'routed_single_family' THEN i WHEN plan_status = 'candidate_family_group_unfiltered' THEN CASE WHEN safe THEN 'safety_warning' ELSE 'population_specific_use' END END AS plan_intent FROM y)"""
_SPANS = f"""sw AS (SELECT query_id, regexp_extract_all(query, '[A-Za-z][A-Za-z0-9\\-]*') AS w FROM a), sg AS (SELECT query_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS span FROM (SELECT query_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sw, range(1, 4) r(k))),
sn AS (SELECT *, trim(regexp_replace(lower(span), '[^a-z0-9]+', ' ', 'g')) AS normal FROM sg), sf AS (SELECT * FROM sn WHERE length(replace(normal, ' ', '')) >= 4 AND len(list_filter(string_split(normal, ' '), lambda x: NOT list_contains({_l(list(P.SPAN_STOPS))}, x))) > 0),
sd AS (SELECT query_id, normal, min(k * 1000000 + i) AS o, arg_min(span, k * 1000000 + i) AS span FROM sf GROUP BY 1, 2),
spans AS (SELECT query_id, place, span FROM (SELECT query_id, span, row_number() OVER (PARTITION BY query_id ORDER BY o)::INT AS place FROM sd) WHERE place <= 18)"""
_RESOLVE = f"""{_SPANS}, al AS (SELECT * FROM {_rows(ALIAS_ROWS)} t(alias, rxcui, name, synonym, tty)), rel AS (SELECT * FROM {_rows(RELATION_ROWS)} t(rxcui, related_rxcui, related_name, related_tty)),
cn AS (SELECT concept_name, {_norm("concept_name")} AS normal FROM {_rows([(c,) for c in CORPUS])} t(concept_name)),
named AS (SELECT DISTINCT rxcui, name, tty, {_norm("v")} AS normal FROM (SELECT rxcui, name, tty, unnest([alias, name, synonym]) AS v FROM al) WHERE {_norm("v")} <> ''),
terms AS (SELECT term, {_norm("term")} AS normal FROM (SELECT span AS term FROM spans UNION SELECT trim(drug) FROM a WHERE trim(drug) <> '')),
ex AS (SELECT term, rxcui, name, tty, 'exact' AS match_method, 0 AS edits, '' AS other FROM terms JOIN named USING (normal)),
np AS (SELECT term, rxcui, name, tty, levenshtein(terms.normal, named.normal) AS edits, named.normal AS other FROM terms JOIN named ON length(terms.normal) >= 5 AND abs(length(terms.normal) - length(named.normal)) <= 2 AND levenshtein(terms.normal, named.normal) <= 2 WHERE term NOT IN (SELECT term FROM ex)),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term, rxcui ORDER BY edits, other, name, tty) AS r FROM np) WHERE r = 1),
nk AS (SELECT term, rxcui, name, tty, 'approximate' AS match_method, edits, other FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY edits, other, rxcui) AS q FROM nr) WHERE q <= 5),
fo AS (SELECT * FROM ex UNION ALL SELECT * FROM nk),
nm AS (SELECT term, {_norm("n")} AS normal FROM (SELECT term, name AS n FROM fo UNION ALL SELECT term, related_name FROM fo JOIN rel USING (rxcui) WHERE related_tty IN ('IN', 'PIN'))),
mt AS (SELECT term, list_sort(list(DISTINCT concept_name)) AS cm FROM nm JOIN cn USING (normal) GROUP BY 1),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY edits, other, rxcui, name) AS r FROM fo) WHERE r = 1), bc AS (SELECT term, count(DISTINCT rxcui) AS candidates FROM fo GROUP BY 1),
rs AS (SELECT term, match_method, rxcui, tty, coalesce(candidates, 0) AS candidates, coalesce(cm, []) AS corpus_matches, CASE WHEN rxcui IS NULL THEN 'not_found' WHEN len(cm) = 1 THEN 'resolved' WHEN len(cm) > 1 THEN 'ambiguous' ELSE 'not_in_corpus' END AS resolution FROM terms LEFT JOIN bt USING (term) LEFT JOIN bc USING (term) LEFT JOIN mt USING (term))"""
_MENTION = f"""{_PLAN}, {_RESOLVE}, dr AS (SELECT query_id, list_sort(list(DISTINCT concept_name)) AS direct FROM p JOIN cn ON contains(' ' || t || ' ', ' ' || normal || ' ') GROUP BY 1),
gd AS (SELECT query_id, list_distinct(list(corpus_matches[1])) AS drugs, arg_min(span, place) AS span FROM spans JOIN rs ON term = span WHERE resolution = 'resolved' AND query_id NOT IN (SELECT query_id FROM dr) GROUP BY 1),
un AS (SELECT DISTINCT query_id, true AS unsure FROM spans JOIN rs ON term = span WHERE resolution = 'ambiguous' AND query_id NOT IN (SELECT query_id FROM dr)),
mn AS (SELECT query_id, CASE WHEN len(direct) = 1 THEN 'direct_corpus_mention' WHEN len(direct) > 1 THEN 'ambiguous' WHEN len(drugs) = 1 THEN 'rxnorm_resolved_query_mention' WHEN len(drugs) > 1 OR unsure THEN 'ambiguous' ELSE 'no_mention_detected' END AS mention_status,
  CASE WHEN len(direct) = 1 THEN direct[1] WHEN len(direct) > 1 THEN NULL WHEN len(drugs) = 1 THEN span END AS mention, CASE WHEN len(direct) = 1 THEN direct[1] WHEN len(direct) > 1 THEN NULL WHEN len(drugs) = 1 THEN drugs[1] END AS retrieval_drug
  FROM a LEFT JOIN dr USING (query_id) LEFT JOIN gd USING (query_id) LEFT JOIN un USING (query_id)),
fl AS (SELECT query_id, CASE WHEN trim(coalesce(drug, '')) = '' THEN 'not_requested' WHEN concept_name IS NOT NULL THEN 'direct_corpus_match' WHEN resolution = 'resolved' THEN 'rxnorm_resolved' WHEN resolution = 'ambiguous' THEN 'ambiguous' WHEN resolution = 'not_in_corpus' THEN 'resolved_not_in_corpus' ELSE 'unresolved' END AS filter_status,
  coalesce(concept_name, CASE WHEN resolution = 'resolved' THEN corpus_matches[1] END) AS filter_drug FROM a LEFT JOIN cn ON cn.normal = {_norm("drug")} LEFT JOIN rs ON rs.term = trim(drug))"""


def _route(name: str, of: str) -> str:
    """``of``: a table with query_id, t, family, plan_status, has_drug and more."""
    label = "plan_status IN ('routed_single_family', 'candidate_family_group_unfiltered')"
    signals = _rows([(i, ph, w) for i, ps in P.IDENTITY_SIGNALS.items() for ph, w in ps.items()])
    return f"""{name}_h AS (SELECT query_id, intent, sum(w)::INT AS s FROM {of} JOIN {signals} g(intent, phrase, w) ON contains(' ' || t || ' ', ' ' || phrase || ' ') WHERE NOT (({label}) AND intent = 'drug_identity_definition') GROUP BY 1, 2
UNION ALL SELECT query_id, 'drug_identity_definition', 5 FROM {of} WHERE starts_with(t, 'what is ') AND has_drug AND NOT ({label})),
{name}_b AS (SELECT query_id, intent AS best, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, intent) AS r FROM {name}_h) WHERE r = 1),
{name} AS (SELECT o.*, CASE WHEN coalesce(s >= 5, false) AND lab THEN 'ambiguous_mixed_source' WHEN coalesce(s >= 5, false) THEN 'routed_rxnorm_identity' WHEN lab THEN 'routed_dailymed_label' ELSE 'fallback_dailymed_label' END AS route_status,
  CASE WHEN coalesce(s >= 5, false) AND lab THEN 'multi_source_composed' WHEN coalesce(s >= 5, false) THEN 'rxnorm_identity' ELSE 'dailymed_label' END AS planned_source, CASE WHEN s >= 5 THEN best END AS identity_intent
  FROM (SELECT *, ({_BLANK}) OR {label} AS lab FROM {of}) o LEFT JOIN {name}_b USING (query_id))"""


def _clean(x: str) -> str:
    strip = r"""[ \t\n\r?!.:,;"'']+"""
    return f"nullif(trim(regexp_replace(regexp_replace(trim({x}), '^{strip}|{strip}$', '', 'g'), '(?i)^the\\s+', '')), '')"


def _first(patterns: list[str], group: int = 1) -> str:
    return "coalesce(" + ", ".join(_clean(f"regexp_extract(query, {_q(p)}, {group})") for p in patterns) + ", NULL)"


def _identity(name: str, of: str) -> str:
    """{name}_t: forms and terms of ``of`` (query_id, query, identity_intent); {name}: their answers."""
    one = {f: _first(ps) for f, ps in P.ONE_TERM.items()}
    names = "CASE WHEN len(in_names) > 0 THEN in_names ELSE any_names END"
    side = lambda s: f"(SELECT term AS {s}_term, name AS {s}_name, tty AS {s}_tty, ingredients AS {s}_ing, {names} AS {s}_names, brands AS {s}_brands FROM {name}_k)"
    return f"""{name}_x AS (SELECT query_id, identity_intent AS ii, {_first(P.EQUIVALENCE)} AS l, {_first(P.EQUIVALENCE, 2)} AS r, {one["brand_name_of"]} AS bo, {one["is_brand_name"]} AS ib, {one["generic_name_lookup"]} AS gn, {one["ingredient_identity"]} AS ing, {one["drug_identity_definition"]} AS df FROM {of}),
{name}_t AS (SELECT query_id, CASE WHEN ii = 'brand_generic_equivalence' AND l IS NOT NULL AND r IS NOT NULL THEN 'equivalence' WHEN ii = 'brand_name_lookup' AND bo IS NOT NULL THEN 'brand_name_of' WHEN ii = 'brand_name_lookup' AND ib IS NOT NULL THEN 'is_brand_name' WHEN ii = 'generic_name_lookup' AND gn IS NOT NULL THEN ii WHEN ii = 'ingredient_identity' AND ing IS NOT NULL THEN ii WHEN ii = 'drug_identity_definition' AND df IS NOT NULL THEN ii END AS form,
  CASE WHEN ii = 'brand_generic_equivalence' AND l IS NOT NULL AND r IS NOT NULL THEN l WHEN ii = 'brand_name_lookup' THEN coalesce(bo, ib) WHEN ii = 'generic_name_lookup' THEN gn WHEN ii = 'ingredient_identity' THEN ing WHEN ii = 'drug_identity_definition' THEN df END AS left_term, CASE WHEN ii = 'brand_generic_equivalence' AND l IS NOT NULL THEN r END AS right_term FROM {name}_x),
{name}_f AS (SELECT term, min(rxcui) AS rxcui, min(name) AS name, min(tty) AS tty FROM (SELECT left_term AS term FROM {name}_t UNION SELECT right_term FROM {name}_t) JOIN named ON {_norm("term")} = normal WHERE term IS NOT NULL GROUP BY 1 HAVING count(DISTINCT rxcui) = 1),
{name}_r AS (SELECT term, rxcui AS r, name AS nm, tty AS ty FROM {name}_f WHERE tty IN ('IN', 'PIN') UNION ALL SELECT term, related_rxcui, related_name, related_tty FROM {name}_f JOIN rel USING (rxcui)),
{name}_p AS (SELECT term, coalesce(list(DISTINCT r) FILTER (ty IN ('IN', 'PIN')), []) AS ingredients, list_sort(coalesce(list(DISTINCT nm) FILTER (ty = 'IN'), [])) AS in_names, list_sort(coalesce(list(DISTINCT nm) FILTER (ty IN ('IN', 'PIN')), [])) AS any_names, list_sort(coalesce(list(DISTINCT nm) FILTER (ty = 'BN'), [])) AS brands FROM {name}_r GROUP BY 1),
{name}_k AS (SELECT * FROM {name}_f LEFT JOIN {name}_p USING (term)),
{name}_a AS (SELECT query_id, form, CASE
  WHEN form = 'equivalence' AND left_name IS NOT NULL AND right_name IS NOT NULL THEN CASE WHEN coalesce(list_has_any(left_ing, right_ing), false) THEN 'Yes. ' || left_name || ' and ' || right_name || ' share an ingredient.' ELSE 'No. ' || left_name || ' and ' || right_name || ' share no ingredient.' END
  WHEN form = 'generic_name_lookup' AND len(left_names) > 0 THEN 'The generic name of ' || left_term || ' is ' || array_to_string(left_names, ', ') || '.'
  WHEN form = 'ingredient_identity' AND len(left_names) > 0 THEN 'The active ingredient of ' || left_term || ' is ' || array_to_string(left_names, ', ') || '.'
  WHEN form = 'brand_name_of' AND len(left_brands) > 0 THEN 'Brand names of ' || left_term || ': ' || array_to_string(left_brands, ', ') || '.'
  WHEN form = 'is_brand_name' AND left_name IS NOT NULL THEN CASE WHEN left_tty = 'BN' THEN 'Yes. ' || left_name || ' is a brand name.' ELSE 'No. ' || left_name || ' is not a brand name.' END
  WHEN form = 'drug_identity_definition' AND left_name IS NOT NULL THEN CASE WHEN left_tty = 'BN' AND len(left_names) > 0 THEN left_name || ' is a brand name of ' || array_to_string(left_names, ', ') || '.' WHEN left_tty = 'IN' THEN left_name || ' is an ingredient.' WHEN left_tty = 'PIN' THEN left_name || ' is a precise ingredient.' ELSE left_name || ' is a drug concept.' END END AS answer
  FROM {name}_t LEFT JOIN {side("left")} USING (left_term) LEFT JOIN {side("right")} USING (right_term)),
{name} AS (SELECT query_id, answer IS NOT NULL AS answered, answer, CASE WHEN answer IS NULL THEN '' WHEN form = 'equivalence' THEN 'R1,R2' ELSE 'R1' END AS citations FROM {name}_a)"""


def _ask(x: str) -> str:
    bare = f"regexp_replace(trim({x}), '[\\s?.!]+$', '')"
    return f"CASE WHEN {bare} = '' THEN '' ELSE {bare} || '?' END"


def _decomposed(name: str, of: str) -> str:
    """{name}: ``of`` (query_id, query, retrieval_drug, ...) with composition, identity_query, clinical_query."""
    split = r"(?is)^(.*?)\s+and\s+(.*)$"
    swap = lambda t, w: f"regexp_replace({t}, '(?is)^(.*?)\\b{w}\\b', '\\1' || coalesce(retrieval_drug, ''))"
    first = lambda t: f"(upper(substring({t}, 1, 1)) || substring({t}, 2))"
    return f"""{name}_0 AS (SELECT *, regexp_matches(trim(query), '{split}') AS two, trim(regexp_extract(trim(query), '{split}', 1)) AS p1, regexp_replace(trim(regexp_extract(trim(query), '{split}', 2)), '[\\s?.!]+$', '') AS cl FROM {of}),
{name}_1 AS (SELECT *, nullif({_ask(first("p1"))}, '') AS i1, nullif(CASE WHEN lower(trim(regexp_replace(cl, '\\s+', ' ', 'g'))) IN ('what is it used for', 'what''s it used for', 'what is this drug used for', 'what''s this drug used for') THEN 'What is ' || retrieval_drug || ' used for?' ELSE {_ask(first(swap(swap("cl", "this drug"), "it")))} END, '') AS c1 FROM {name}_0),
{name} AS (SELECT * EXCLUDE (two, p1, cl, i1, c1), CASE WHEN two AND i1 IS NOT NULL AND c1 IS NOT NULL THEN 'composed_answered' ELSE 'unsupported_decomposition' END AS composition, CASE WHEN two THEN i1 END AS identity_query, CASE WHEN two THEN c1 END AS clinical_query FROM {name}_1)"""


_SECTIONS = f"""sec AS (SELECT p_partkey AS section_id, {_pick(CORPUS, "p_partkey")} AS concept_name, {_pick(FAMILY_NAMES, "p_partkey // 4")} AS family, replace({_pick(SENTENCES, "p_partkey // 20")}, '{{x}}', {_pick(CORPUS, "p_partkey")}) || '. ' || p_name AS text FROM part),
sect AS (SELECT section_id, concept_name, family, unnest(list_distinct({_tok("text")})) AS term FROM sec)"""


def _evidence(name: str, of: str) -> str:
    """{name}: query_id, n, ids, texts of the evidence of ``of`` (query_id, query, drug, family); {name}_a: the stand-in's answer through the gates."""
    return f"""{name}_w AS (SELECT query_id, query, drug, family, unnest(list_filter(list_distinct({_tok("query")}), lambda w: NOT list_contains({_tok("drug")}, w) AND NOT list_contains({_l(sorted(STOP))}, w))) AS term FROM {of}),
{name}_s AS (SELECT query_id, section_id, count(*) AS score FROM {name}_w w JOIN sect USING (term) WHERE (w.drug IS NULL OR lower(w.drug) = lower(concept_name)) AND (w.family IS NULL OR w.family = sect.family) GROUP BY 1, 2),
{name}_k AS (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM {name}_s),
{name}_e AS (SELECT query_id, count(*)::INT AS n, list(text ORDER BY rank) AS texts FROM {name}_k JOIN sec USING (section_id) WHERE rank <= 5 GROUP BY 1),
{name} AS (SELECT query_id, query, coalesce(n, 0) AS n, coalesce(texts, []) AS texts FROM {of} LEFT JOIN {name}_e USING (query_id)),
{name}_a AS (SELECT query_id, n > 0 AND NOT ({_has("query", P.GUARANTEE)} AND NOT {_has("texts[1]", P.GUARANTEE)}) AND NOT ({_negative("query", "texts[1]", "texts[1]")}) AS answered, texts[1] AS answer FROM {name})"""


def _has(x: str, markers: tuple) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({x}), {_q(m)})" for m in markers) + ", false)"


def _target(x: str) -> str:
    text = f"regexp_replace(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '[?.]+$', '')"
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({text}, {_q(p)}, 1)), '')" for p in P.TARGETS) + ")"


def _negative(asked: str, answer: str, cited: str) -> str:
    """Whether an answered claim is a negative treatment claim without support."""
    text, target = f"trim(regexp_replace(lower({cited}), '\\s+', ' ', 'g'))", _target(asked)
    words = f"list_filter(regexp_extract_all({target}, '[a-zA-Z0-9]+'), lambda w: NOT list_contains({_l(list(P.TARGET_STOPS))}, w) AND length(w) > 1)"
    mentioned = f"coalesce(contains({text}, {target}) OR (len({words}) > 0 AND len(list_filter({words}, lambda w: NOT contains({text}, w))) = 0), false)"
    return f"{_has(asked, P.THERAPEUTIC)} AND {_has(answer, P.NEGATIVE_ANSWER)} AND (NOT {mentioned} OR NOT {_has(cited, P.NEGATIVE_EVIDENCE)})"


_X = lambda x: f"replace({x}, '{{x}}', {_pick(CORPUS, 'c_custkey')})"
_CASES = f"""c0 AS (SELECT c_custkey AS query_id, {_X(_pick(CLAIMS, "c_custkey"))} AS query, {_X(_pick(SAID, "c_custkey // 6"))} AS answer, {_X(_pick(EVIDENCE, "c_custkey // 42"))} AS cited, {_X(_pick(EVIDENCE, "c_custkey // 42 + 1"))} AS other, c_custkey % 9 AS v,
  CASE WHEN c_custkey % 11 = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS status, {"[" + ", ".join(_l(p) + "::VARCHAR[]" for p in PREFIXES) + "]"}[c_custkey % 4 + 1] AS prefixes FROM customer),
c1 AS (SELECT *, replace({_pick(OUTPUTS, "v")}, '{{a}}', answer) AS raw, CASE WHEN v <> 3 OR query_id % 5 <> 0 THEN 2 ELSE 0 END AS n FROM c0),
c2 AS (SELECT *, nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') AS obj FROM c1),
c3 AS (SELECT *, json_extract_string(obj, '$.status') AS said, json_extract_string(obj, '$.answer') AS said_answer, coalesce(json_extract_string(obj, '$.citations[*]'), []) AS cites FROM c2),
c4 AS (SELECT *, list_filter(list_distinct(cites), lambda x: NOT (n = 2 AND x IN ('E1', 'E2'))) AS fc, array_to_string(list_concat(CASE WHEN n = 2 AND list_contains(cites, 'E1') THEN [cited] ELSE [] END, CASE WHEN n = 2 AND list_contains(cites, 'E2') THEN [other] ELSE [] END), chr(10)) AS ct FROM c3)"""
_R1 = f"""{_MENTION}, r1i AS (SELECT pl.*, retrieval_drug, retrieval_drug IS NOT NULL OR drug IS NOT NULL AS has_drug FROM pl JOIN mn USING (query_id)), {_route("r1", "r1i")}"""
_FLOW = f"""{_MENTION}, r2i AS (SELECT pl.*, filter_status, coalesce(CASE WHEN trim(coalesce(drug, '')) = '' THEN mention_status END, 'not_attempted_explicit_filter_present') AS mention_status, coalesce(filter_drug, CASE WHEN trim(coalesce(drug, '')) = '' THEN retrieval_drug END) AS drug_found, coalesce(filter_drug, CASE WHEN trim(coalesce(drug, '')) = '' THEN retrieval_drug END) IS NOT NULL AS has_drug FROM pl JOIN fl USING (query_id) JOIN mn USING (query_id)), {_route("r2", "r2i")},
wf AS (SELECT query_id, query, filter_status, plan_status, plan_family, mention_status, drug_found, route_status, planned_source, identity_intent, CASE WHEN filter_status IN ('ambiguous', 'resolved_not_in_corpus', 'unresolved') THEN 'insufficient_evidence' WHEN planned_source = 'multi_source_composed' THEN 'mixed' WHEN planned_source = 'rxnorm_identity' THEN 'identity' ELSE 'label' END AS branch, coalesce(nullif(trim(family), ''), plan_family) AS effective_family FROM r2)"""
_MIXED_STATUS = "CASE WHEN {d} IS NULL THEN 'missing_drug_context' WHEN identity_intent IS NULL THEN 'missing_identity_intent' WHEN composition <> 'composed_answered' THEN 'unsupported_decomposition' WHEN NOT coalesce({i}, false) THEN 'identity_answer_insufficient' WHEN NOT coalesce({c}, false) THEN 'clinical_answer_insufficient' ELSE 'composed_answered' END"


def oracle_sql() -> dict[str, str]:
    return {
        "phrase_match": f"WITH {_ASKED} SELECT phrase, count(*) AS n FROM h GROUP BY 1",
        "family_scores": f"WITH {_ASKED} SELECT query_id, family_name AS family, intent, score, signals FROM sc",
        "safety_regex": f"WITH {_ASKED} SELECT query_id, {_MODAL} AS modal_cause, {_ANY(P.SAFETY)} AS safety, {_ANY(P.POPULATION)} AS population FROM p",
        "family_plan": f"WITH {_PLAN} SELECT query_id, plan_status, plan_family, plan_intent FROM pl",
        "span_candidates": f"WITH {_ASKED}, {_SPANS} SELECT query_id, place, span FROM spans",
        "resolve_term": f"WITH {_ASKED}, {_RESOLVE} SELECT term, match_method, rxcui, tty, candidates, array_to_string(corpus_matches, ',') AS corpus_matches, resolution FROM rs WHERE term IN (SELECT span FROM spans)",
        "mention_detect": f"WITH {_MENTION} SELECT query_id, mention_status, mention, retrieval_drug FROM mn",
        "filter_resolution": f"WITH {_MENTION} SELECT query_id, filter_status, filter_drug FROM fl",
        "source_route": f"WITH {_R1} SELECT query_id, route_status, planned_source, identity_intent FROM r1",
        "identity_parse": f"WITH {_R1}, {_identity('ia', 'r1')} SELECT query_id, form, left_term, right_term FROM ia_t",
        "identity_answers": f"WITH {_R1}, {_identity('ia', 'r1')} SELECT query_id, answered, answer, citations FROM ia",
        "decompose_query": f"WITH {_R1}, {_decomposed('dq', 'r1')} SELECT query_id, composition, identity_query, clinical_query FROM dq",
        "mixed_gates": f"""WITH {_R1}, mx0 AS (SELECT * FROM r1 WHERE planned_source = 'multi_source_composed'), {_decomposed('mx', 'mx0')}, mxi AS (SELECT query_id, identity_query AS query, identity_intent FROM mx), {_identity('ia', 'mxi')}, {_SECTIONS},
            mxc AS (SELECT query_id, clinical_query AS query, retrieval_drug AS drug, plan_family AS family FROM mx), {_evidence('ev', 'mxc')}
            SELECT query_id, ia.answered AS identity_answered, ev_a.answered AS clinical_answered, {_MIXED_STATUS.format(d="retrieval_drug", i="ia.answered", c="ev_a.answered")} AS composition_status FROM mx JOIN ia USING (query_id) JOIN ev_a USING (query_id)""",
        "workflow": f"WITH {_FLOW} SELECT * EXCLUDE (query) FROM wf",
        "label_evidence": f"WITH {_ASKED}, {_SECTIONS}, le AS (SELECT query_id, query, NULL::VARCHAR AS drug, family FROM a), {_evidence('ev', 'le')} SELECT query_id, n, md5(array_to_string(list_transform(texts, lambda x, i: 'E' || i || ' ' || x), chr(10))) AS evidence_md5 FROM ev",
        "workflow_answers": f"""WITH {_FLOW}, mx0 AS (SELECT *, drug_found AS retrieval_drug FROM wf WHERE branch = 'mixed'), {_decomposed('mx', 'mx0')}, ii AS (SELECT query_id, query, identity_intent FROM wf WHERE branch = 'identity' UNION ALL SELECT query_id, identity_query, identity_intent FROM mx), {_identity('ia', 'ii')}, {_SECTIONS},
            lc AS (SELECT query_id, query, drug_found AS drug, effective_family AS family FROM wf WHERE branch = 'label' UNION ALL SELECT query_id, clinical_query, retrieval_drug, effective_family FROM mx), {_evidence('ev', 'lc')},
            j AS (SELECT wf.*, composition, ia.answered AS i_ok, ia.answer AS i_answer, ia.citations AS i_cites, ev_a.answered AS l_ok, CASE WHEN ev_a.answered THEN ev_a.answer END AS l_answer FROM wf LEFT JOIN mx USING (query_id) LEFT JOIN ia USING (query_id) LEFT JOIN ev_a USING (query_id)),
            g AS (SELECT *, CASE WHEN branch = 'mixed' THEN {_MIXED_STATUS.format(d="drug_found", i="i_ok", c="l_ok")} END AS composition_status FROM j),
            o AS (SELECT *, coalesce(CASE branch WHEN 'mixed' THEN composition_status = 'composed_answered' WHEN 'identity' THEN i_ok WHEN 'label' THEN l_ok ELSE false END, false) AS ok FROM g)
            SELECT query_id, branch, composition_status, CASE WHEN ok THEN 'answered' ELSE 'insufficient_evidence' END AS final_status, CASE WHEN ok THEN concat_ws(chr(10) || chr(10), i_answer, l_answer) END AS answer, CASE WHEN ok THEN concat_ws(',', i_cites, CASE WHEN l_ok THEN 'E1' END) ELSE '' END AS citations FROM o""",
        "json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
        "citation_policy": f"WITH {_CASES} SELECT query_id, array_to_string(fc, ',') AS \"foreign\", len(prefixes) = 0 OR len(list_filter(cites, lambda c: len(list_filter(prefixes, lambda p: starts_with(c, p))) = 0)) = 0 AS prefixes_pass FROM c4",
        "answer_gates": f"""WITH {_CASES}, w AS (SELECT *, list_distinct({_tok("said_answer")}) AS aw FROM c4), gt AS (SELECT query_id, CASE WHEN n = 0 THEN 'no_evidence' WHEN said IS NULL OR said_answer IS NULL THEN 'bad_output' WHEN len(fc) > 0 THEN 'foreign_citation' WHEN (said = 'answered') <> (len(cites) > 0) THEN 'citations_do_not_fit_status' WHEN said <> 'answered' THEN 'model_abstained'
            WHEN {_has("query", P.GUARANTEE)} AND NOT {_has("ct", P.GUARANTEE)} THEN 'guarantee_guardrail' WHEN {_negative("query", "said_answer", "ct")} THEN 'negative_treatment_guardrail' WHEN coalesce(len(list_intersect(aw, {_tok("ct")})) / nullif(len(aw), 0), 0) < 0.5 THEN 'verifier' ELSE 'passed' END AS gate FROM w)
            SELECT query_id, gate, CASE WHEN gate = 'passed' THEN 'answered' ELSE 'insufficient_evidence' END AS final_status FROM gt""",
        "guardrails": f"WITH {_CASES} SELECT query_id, status = 'answered' AND {_has('query', P.GUARANTEE)} AND NOT {_has('cited', P.GUARANTEE)} AS guarantee, status = 'answered' AND {_negative('query', 'answer', 'cited')} AS negative, {_target('query')} AS target FROM c0",
    }
