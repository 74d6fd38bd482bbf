"""Planning over sets of questions: family plans, source routes, mentions, concepts, identity answers, decomposition, guardrails, answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.english import STOP
from ..functions.text import capitalise_first, collapse, contains_any, phrase, question
from ..sources.sinks import materialised
from ..sources.tables import broadcast_if_small, numbered
from .phrases import phrase_hits
from .retrieval import TOP_K, tokens

# Weighted phrases of families and identity intents, phrases of unfiltered groups.
FAMILY_SIGNALS = {
    ("indications_and_usage", "indication_or_use"): {"used for": 4, "indicated for": 4, "approved for": 4, "treat": 3, "treatment": 3, "cure": 3, "prevent": 3, "prevention": 3, "what is": 1},
    ("drug_interactions", "interaction"): {"interaction": 4, "interact": 4, "taken with": 4, "take with": 4, "together with": 4, "combine": 3, "combined with": 4},
    ("dosage_and_administration", "dosage"): {"dose": 4, "dosage": 4, "how much": 4, "how often": 4, "once daily": 3, "twice daily": 3, "administer": 3},
    ("contraindications", "contraindication"): {"contraindicated": 5, "should not take": 5, "do not take": 5, "who should not take": 5},
    ("adverse_reactions", "adverse_reaction"): {"side effect": 5, "side effects": 5, "adverse reaction": 5, "adverse reactions": 5, "common reactions": 4},
    ("overdosage", "overdose"): {"overdose": 5, "too much": 4, "excess amount": 4},
    ("how_supplied_storage_and_handling", "storage"): {"store": 5, "storage": 5, "room temperature": 4, "refrigerate": 4},
}
#: Approximate names: edits, characters of a term, and concepts of a term that are kept; pieces that a name is cut into.
MOST_EDITS, LEAST_NEAR, MOST_NEAR, NEAR_PIECES = 2, 5, 5, 5
SAFETY = ("warning", "warnings", "risk", "dangerous", "serious", "fatal", "harm", "can cause", "could cause")
POPULATION = ("pregnant", "pregnancy", "breastfeeding", "nursing", "children", "child", "pediatric", "elderly", "geriatric", "unborn baby")
MODAL_CAUSE = r"\b(?:can|could|does|do|may|might|will|would)\s+(?:[a-z0-9]+\s+){0,4}cause\b"
LEAST_FAMILY, LEAST_IDENTITY = 2, 5
IDENTITY_SIGNALS = {
    "brand_generic_equivalence": {"same as": 6, "equivalent to": 6, "another name for": 6},
    "generic_name_lookup": {"generic name": 6},
    "brand_name_lookup": {"brand name": 6, "brand of": 5},
    "ingredient_identity": {"active ingredient": 6, "ingredient in": 5},
    "drug_identity_definition": {"what is": 2},
}
LABEL_PLANS = ("routed_single_family", "candidate_family_group_unfiltered")
# Words of which a span of a question must not consist.
SPAN_STOPS = tuple("a an and are as at be before can cause causes caused could do does drug for from have help if in is it may medication medicine of or should the this to treat treats use used using what when will with".split())
MOST_SPANS, SPAN_WORDS, LEAST_SPAN = 18, 3, 4


def signal_hits(questions: DataFrame, signals: DataFrame) -> DataFrame:
    """query_id and the signals whose phrase occurs in the question as whole words, each once."""
    runs = phrase_hits(questions.withColumn("normal", phrase(F.col("query"))), "query_id", "normal", signals).select("query_id", "phrase").distinct()
    return runs.join(F.broadcast(signals), "phrase")  # a fixed rule table


def family_signals(spark: SparkSession) -> DataFrame:
    rows = [(p, f, i, w, n) for n, (f, i, p, w) in enumerate((f, i, p, w) for (f, i), ps in FAMILY_SIGNALS.items() for p, w in ps.items())]
    return spark.createDataFrame(rows, "phrase string, family string, intent string, weight int, place int")


def padded(text: Column) -> Column:
    """The normalised text between spaces, in which whole words are found as substrings. A column of its own, so that it is made once."""
    return F.concat(F.lit(" "), phrase(text), F.lit(" "))


def rule_matches(text: Column, rules: dict) -> Column:
    """For each group of a fixed rule table with a phrase in the padded text: key, score, signals. Plain expressions, computed in the row, so nothing is shuffled."""
    groups = []
    for key, phrases in rules.items():
        names = (key,) if isinstance(key, str) else key
        hit = {p: F.contains(text, F.lit(f" {p} ")) for p in phrases}
        score = reduce(lambda a, b: a + b, (F.when(hit[p], w).otherwise(0) for p, w in phrases.items())).cast("long")
        groups.append(F.struct(*(F.lit(n).alias(c) for n, c in zip(names, ("name", "intent"), strict=False)), score.alias("score"), F.array_compact(F.array(*(F.when(hit[p], p) for p in phrases))).alias("signals")))
    return F.filter(F.array(*groups), lambda g: g["score"] > 0)


def family_scores(questions: DataFrame) -> DataFrame:
    """query_id, family, intent, score and the matched phrases in the table's order."""
    padded_ = questions.select("query_id", padded(F.col("query")).alias("_text"))
    return padded_.select("query_id", F.inline(rule_matches(F.col("_text"), FAMILY_SIGNALS))).withColumnRenamed("name", "family")


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases is in the padded text."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(f" {p} ")) for p in phrases))


def family_plan(questions: DataFrame) -> DataFrame:
    """``questions`` with plan_status, plan_family, plan_intent. A tie at the top is found before the least score counts."""
    text = F.col("_text")
    q = questions.withColumn("_text", padded(F.col("query"))).withColumn("_all", rule_matches(text, FAMILY_SIGNALS)).withColumn("top", F.array_max(F.transform("_all", lambda x: x["score"])))
    q = q.withColumn("best", F.filter("_all", lambda x: x["score"] == F.col("top"))).drop("_all")
    best = F.get("best", F.lit(0))
    safety = any_phrase(text, SAFETY) | text.rlike(MODAL_CAUSE)
    population = any_phrase(text, POPULATION)
    single = (F.size("best") == 1) & (F.col("top") >= LEAST_FAMILY)
    status = (
        F.when(F.trim(F.coalesce("family", F.lit(""))) != "", "not_attempted_explicit_family_present").when(F.size("best") > 1, "ambiguous").when(single, "routed_single_family")
        .when(safety | population, "candidate_family_group_unfiltered").otherwise("no_route_detected")
    )
    planned = q.withColumn("plan_status", status)
    routed = F.col("plan_status") == "routed_single_family"
    grouped = F.col("plan_status") == "candidate_family_group_unfiltered"
    intent = F.when(routed, best["intent"]).when(grouped & safety, "safety_warning").when(grouped, "population_specific_use")
    return planned.withColumns({"plan_family": F.when(routed, best["name"]), "plan_intent": intent}).drop("best", "top", "_text")


def source_route(planned: DataFrame) -> DataFrame:
    """Planned questions (family_plan) with has_drug get route_status, planned_source and identity_intent."""
    label_plan = F.col("plan_status").isin(*LABEL_PLANS)
    text = F.col("_text")
    planned = planned.withColumn("_text", padded(F.col("query")))
    kept = F.filter(rule_matches(text, IDENTITY_SIGNALS), lambda g: ~(label_plan & (g["name"] == "drug_identity_definition")))  # its only phrase is "what is"
    plain = F.transform(kept, lambda g: F.struct(-g["score"], g["name"]))
    boost = F.when(text.startswith(" what is ") & F.col("has_drug") & ~label_plan, F.array(F.struct(F.lit(-LEAST_IDENTITY).cast("long"), F.lit("drug_identity_definition")))).otherwise(F.array())
    order = F.array_sort(F.concat(plain.cast("array<struct<score:bigint,name:string>>"), boost.cast("array<struct<score:bigint,name:string>>")))
    q = planned.withColumn("_best", F.get(order, F.lit(0))).withColumns({"identity_score": -F.col("_best.score"), "identity_intent": F.col("_best.name")}).drop("_best")
    identity = F.coalesce(F.col("identity_score") >= LEAST_IDENTITY, F.lit(False))
    label = (F.trim(F.coalesce("family", F.lit(""))) != "") | F.col("plan_status").isin(*LABEL_PLANS)
    status = F.when(identity & label, "ambiguous_mixed_source").when(identity, "routed_rxnorm_identity").when(label, "routed_dailymed_label").otherwise("fallback_dailymed_label")
    source = F.when(identity & label, "multi_source_composed").when(identity, "rxnorm_identity").otherwise("dailymed_label")
    return q.withColumns({"route_status": status, "planned_source": source, "identity_intent": F.when(identity, F.col("identity_intent"))}).drop("identity_score", "_text")


def candidate_spans(questions: DataFrame) -> DataFrame:
    """query_id, place, span, normal: runs of 1 to 3 words, short ones first, that aren't all stop words; each once, at most MOST_SPANS (a rule of the feature). A question is a row."""
    words = F.regexp_extract_all("query", F.lit(r"[A-Za-z][A-Za-z0-9\-]*"), F.lit(0))

    def runs(n: int) -> Column:
        count = F.size("w") - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    # All in the question's row: nothing is shuffled or grouped.
    spans = F.concat(*(runs(n) for n in range(1, SPAN_WORDS + 1)))
    normal = F.transform(spans, lambda s: F.struct(s.alias("span"), phrase(s).alias("normal")))
    kept = F.filter(normal, lambda x: (F.length(F.replace(x["normal"], F.lit(" "), F.lit(""))) >= LEAST_SPAN) & (F.size(F.array_except(F.split(x["normal"], " "), F.array(*(F.lit(s) for s in SPAN_STOPS)))) > 0))
    none = F.array().cast("array<struct<span:string,normal:string>>")
    first = F.aggregate(kept, none, lambda own, x: F.when((F.size(own) >= MOST_SPANS) | F.exists(own, lambda o: o["normal"] == x["normal"]), own).otherwise(F.concat(own, F.array(x))))
    per = questions.select("query_id", words.alias("w")).select("query_id", F.posexplode(first).alias("p", "x"))
    return per.select("query_id", (F.col("p") + 1).alias("place"), "x.span", "x.normal")


def near_names(terms: DataFrame, named: DataFrame) -> DataFrame:
    """term, rxcui, name, tty, other, edits: the names (``named.normal``) within MOST_EDITS of each term of at least LEAST_NEAR characters.

    A name is cut into NEAR_PIECES pieces. As many edits lie in at most MOST_EDITS of them, so the rest stand in the term, each
    by as many places off as the edits before it add. Names and terms that agree without some two pieces are compared: a part that
    many names share (" tablets") is never enough for that, whatever their number.
    """
    assert MOST_EDITS == 2
    own, other, n = F.col("normal"), F.col("other"), F.col("n")
    start = [F.floor(n * k / NEAR_PIECES).cast("int") for k in range(NEAR_PIECES + 1)]

    def keys(text: Column, first: Column, both: Column) -> Column:
        """The text without pieces u and v of a name of n characters, for all u < v; ``first``, ``both``: what edits add in u, and in u and v."""
        part = lambda off, a, b: F.substring(text, start[a] + off + 1, start[b] - start[a])
        return F.array(*(F.xxhash64(n, F.lit(u), F.lit(v), part(F.lit(0), 0, u), part(first, u + 1, v), part(both, v + 1, NEAR_PIECES)) for u in range(NEAR_PIECES) for v in range(u + 1, NEAR_PIECES)))

    names = named.select(F.col("normal").alias("other")).distinct().withColumn("n", F.length("other"))
    known = names.select("other", F.explode(F.array_distinct(keys(other, F.lit(0), F.lit(0)))).alias("key"))
    lengths = F.broadcast(names.select("n").distinct())  # a row for each length
    size, both = F.length("normal"), F.length("normal") - n
    asked = terms.select("normal").filter(size >= LEAST_NEAR).distinct().withColumn("n", F.explode(F.sequence(size - MOST_EDITS, size + MOST_EDITS))).join(lengths, "n")
    shifts = F.filter(F.sequence(F.lit(-MOST_EDITS), F.lit(MOST_EDITS)), lambda first: F.abs(first) + F.abs(both - first) <= MOST_EDITS)
    asked = asked.withColumn("first", F.explode(shifts)).select("normal", F.explode(keys(own, F.col("first"), both)).alias("key"))
    pairs = asked.join(known, "key").withColumn("edits", F.levenshtein("normal", "other")).filter(F.col("edits") <= MOST_EDITS).select("normal", "other", "edits").distinct()
    return pairs.join(terms.select("term", "normal"), "normal").join(named.select("rxcui", "name", "tty", F.col("normal").alias("other")).distinct(), "other").select("term", "rxcui", "name", "tty", "other", "edits")


def resolve_terms(terms: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, match_method, rxcui, tty, concept, corpus_matches, resolution. Exact names or synonyms first; only terms without one are matched approximately
    (at most two edits, the best MOST_NEAR distinct concepts); ingredients of all of them lead to the corpus."""
    t = materialised(terms.select("term").distinct().withColumn("normal", phrase(F.col("term"))))
    named = aliases.select("rxcui", "name", "tty", F.explode(F.array_distinct(F.array(*(phrase(F.col(c)) for c in ("alias", "name", "synonym"))))).alias("normal")).filter("normal <> ''").distinct()
    exact = t.join(named, "normal").select("term", "rxcui", "name", "tty", F.lit("exact").alias("match_method"), F.lit(0).alias("edits"), F.lit("").alias("other"))
    near = near_names(t.join(exact.select("term"), "term", "left_anti"), named).groupBy("term", "rxcui").agg(F.min(F.struct("edits", "other", "name", "tty")).alias("c")).select("term", "rxcui", "c.*")
    rank = F.row_number().over(Window.partitionBy("term").orderBy("edits", "other", "rxcui"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= MOST_NEAR).select("term", "rxcui", "name", "tty", F.lit("approximate").alias("match_method"), "edits", "other")
    found = materialised(exact.unionByName(near))
    related = found.join(relations.filter("related_tty IN ('IN', 'PIN')"), "rxcui").select("term", F.col("related_name").alias("n"))
    names = found.select("term", F.col("name").alias("n")).unionByName(related).withColumn("normal", phrase(F.col("n")))
    matches = names.join(corpus.select("concept_name", phrase(F.col("concept_name")).alias("normal")), "normal").groupBy("term").agg(F.array_sort(F.collect_set("concept_name")).alias("corpus_matches"))
    best = found.groupBy("term").agg(F.min_by(F.struct("match_method", "rxcui", "name", "tty"), F.struct("edits", "other", "rxcui", "name")).alias("c"), F.countDistinct("rxcui").alias("candidates"))
    out = t.join(best, "term", "left").join(matches, "term", "left").select("term", F.col("c.match_method"), F.col("c.rxcui"), F.col("c.name").alias("concept"), F.col("c.tty"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("corpus_matches", F.array().cast("array<string>")).alias("corpus_matches"))
    n = F.size("corpus_matches")
    return out.withColumn("resolution", F.when(F.col("rxcui").isNull(), "not_found").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("not_in_corpus"))


def once(questions: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``of`` (query_id and what a question's query, drug and family decide, a row for each query_id) of every question. Those that ask the same are worked out once, and each gets the row."""
    asks = [c for c in ("query", "drug", "family") if c in questions.columns]
    keyed = questions.select("query_id", *asks, F.sha2(F.to_json(F.struct(*asks)), 256).alias("ask"))
    said = materialised(of(materialised(keyed.select(F.col("ask").alias("query_id"), *asks).distinct())))
    return keyed.select("query_id", "ask").join(broadcast_if_small(said.withColumnRenamed("query_id", "ask")), "ask").drop("ask")


def mentions(questions: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame) -> DataFrame:
    """``mentions_of_each``, questions that ask the same worked out once."""
    return once(questions.select("query_id", "query"), lambda q: mentions_of_each(q, aliases, relations, corpus))


def mentions_of_each(questions: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, mention_status, mention, retrieval_drug. Direct names decide; without one, spans are resolved, and resolved spans beat ambiguous ones."""
    names = corpus.select("concept_name", phrase(F.col("concept_name")).alias("phrase"))
    runs = phrase_hits(questions.withColumn("normal", phrase(F.col("query"))), "query_id", "normal", names).select("query_id", "phrase").distinct()
    direct = runs.join(names, "phrase").groupBy("query_id").agg(F.array_sort(F.collect_set("concept_name")).alias("direct"))
    open_ = questions.join(direct, "query_id", "left_anti")
    spans = materialised(candidate_spans(open_))
    resolved = spans.join(resolve_terms(spans.select(F.col("span").alias("term")), aliases, relations, corpus).withColumnRenamed("term", "span"), "span")
    good = resolved.filter("resolution = 'resolved'").groupBy("query_id").agg(F.array_sort(F.collect_set(F.get("corpus_matches", F.lit(0)))).alias("drugs"), F.min_by("span", "place").alias("span"))
    unsure = resolved.filter("resolution = 'ambiguous'").select("query_id", F.lit(True).alias("unsure")).distinct()
    q = questions.select("query_id").join(direct, "query_id", "left").join(good, "query_id", "left").join(unsure, "query_id", "left")
    one, many = F.size("direct") == 1, F.size("direct") > 1
    status = F.when(one, "direct_corpus_mention").when(many, "ambiguous").when(F.size("drugs") == 1, "rxnorm_resolved_query_mention").when((F.size("drugs") > 1) | F.coalesce("unsure", F.lit(False)), "ambiguous").otherwise("no_mention_detected")
    drug = F.when(one, F.get("direct", F.lit(0))).when(F.coalesce(~many, F.lit(True)) & (F.size("drugs") == 1), F.get("drugs", F.lit(0)))
    return q.select("query_id", status.alias("mention_status"), F.when(one, F.get("direct", F.lit(0))).when(drug.isNotNull(), F.col("span")).alias("mention"), drug.alias("retrieval_drug"))


def filter_resolution(questions: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, filter_status, filter_drug of an explicit drug: a corpus name directly, else resolved; what can't be resolved fails closed."""
    asked = questions.withColumn("term", F.nullif(F.trim("drug"), F.lit("")))
    names = corpus.select(F.col("concept_name").alias("own"), phrase(F.col("concept_name")).alias("normal"))
    q = asked.withColumn("normal", phrase(F.col("term"))).join(names, "normal", "left")
    rest = q.filter(F.col("own").isNull() & F.col("term").isNotNull())
    q = q.join(resolve_terms(rest.select("term"), aliases, relations, corpus).select("term", "resolution", "corpus_matches"), "term", "left")
    status = F.when(F.col("term").isNull(), "not_requested").when(F.col("own").isNotNull(), "direct_corpus_match").when(F.col("resolution") == "resolved", "rxnorm_resolved").when(F.col("resolution") == "ambiguous", "ambiguous").when(F.col("resolution") == "not_in_corpus", "resolved_not_in_corpus").otherwise("unresolved")
    return q.select("query_id", status.alias("filter_status"), F.coalesce("own", F.when(F.col("resolution") == "resolved", F.get("corpus_matches", F.lit(0)))).alias("filter_drug"))


# Forms of identity questions; the groups are the terms.
EQUIVALENCE = [
    r"(?i)^\s*(?:is|are)\s+(.+?)\s+(?:the\s+)?same\s+as\s+(.+?)\s*[?!.]*\s*$",
    r"(?i)^\s*(?:is|are)\s+(.+?)\s+equivalent\s+to\s+(.+?)\s*[?!.]*\s*$",
    r"(?i)^\s*(?:is|are)\s+(.+?)\s+another\s+name\s+for\s+(.+?)\s*[?!.]*\s*$",
]
ONE_TERM = {
    "generic_name_lookup": [
        r"(?i)^\s*(?:what\s+is|what's)\s+(?:the\s+)?generic\s+name\s+of\s+(.+?)\s*[?!.]*\s*$",
        r"(?i)^\s*(?:what\s+is|what's)\s+(?:the\s+)?generic\s+for\s+(.+?)\s*[?!.]*\s*$",
    ],
    "ingredient_identity": [
        r"(?i)^\s*(?:what\s+is|what's)\s+(?:the\s+)?active\s+ingredient\s+(?:in|of)\s+(.+?)\s*[?!.]*\s*$",
        r"(?i)^\s*(?:what\s+)?ingredient\s+(?:is\s+)?(?:in|of)\s+(.+?)\s*[?!.]*\s*$",
    ],
    "brand_name_of": [r"(?i)^\s*(?:what\s+is|what's)\s+(?:the\s+)?brand\s+name\s+of\s+(.+?)\s*[?!.]*\s*$"],
    "is_brand_name": [r"(?i)^\s*(?:is|are)\s+(.+?)\s+(?:a\s+)?brand\s+name\s*[?!.]*\s*$"],
    "drug_identity_definition": [r"(?i)^\s*(?:what\s+is|what's)\s+(.+?)\s*[?!.]*\s*$"],
}


def clean_term(term: Column) -> Column:
    bare = F.regexp_replace(F.trim(term), r"""^[ \t\n\r?!.:,;"']+|[ \t\n\r?!.:,;"']+$""", "")
    return F.nullif(F.trim(F.regexp_replace(bare, r"(?i)^the\s+", "")), F.lit(""))


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*(clean_term(F.regexp_extract(text, p, group)) for p in patterns), F.lit(None).cast("string"))


def identity_terms(questions: DataFrame) -> DataFrame:
    """query_id, form, left_term, right_term by the question's intent: the first form that fits."""
    text = F.col("query")
    left, right = first_match(text, EQUIVALENCE), first_match(text, EQUIVALENCE, 2)
    intent = F.col("identity_intent")
    both = (intent == "brand_generic_equivalence") & left.isNotNull() & right.isNotNull()
    brand_of, is_brand = first_match(text, ONE_TERM["brand_name_of"]), first_match(text, ONE_TERM["is_brand_name"])
    form = F.when(both, "equivalence").when((intent == "brand_name_lookup") & brand_of.isNotNull(), "brand_name_of").when((intent == "brand_name_lookup") & is_brand.isNotNull(), "is_brand_name")
    term = F.when(both, left).when(intent == "brand_name_lookup", F.coalesce(brand_of, is_brand))
    for name in ("generic_name_lookup", "ingredient_identity", "drug_identity_definition"):
        own = first_match(text, ONE_TERM[name])
        form, term = form.when((intent == name) & own.isNotNull(), name), term.when(intent == name, own)
    return questions.select("query_id", form.alias("form"), term.alias("left_term"), F.when(both, right).alias("right_term"))


def identity_answers(parsed: DataFrame, aliases: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, answered, answer, citations. A term must have exactly one concept; two are the same if their ingredients meet."""
    terms = parsed.select(F.explode(F.array("left_term", "right_term")).alias("term")).filter("term IS NOT NULL").distinct()
    named = aliases.select("rxcui", "name", "tty", F.explode(F.array_distinct(F.array(*(phrase(F.col(c)) for c in ("alias", "name", "synonym"))))).alias("normal")).filter("normal <> ''").distinct()
    found = terms.withColumn("normal", phrase(F.col("term"))).join(named, "normal").groupBy("term").agg(F.count_distinct("rxcui").alias("n"), F.first("rxcui").alias("rxcui"), F.first("name").alias("name"), F.first("tty").alias("tty")).filter("n = 1").drop("n")
    own = found.filter("tty IN ('IN', 'PIN')").select("term", F.col("rxcui").alias("r"), F.col("name").alias("nm"), F.col("tty").alias("ty"))
    related = found.join(relations, "rxcui").select("term", F.col("related_rxcui").alias("r"), F.col("related_name").alias("nm"), F.col("related_tty").alias("ty"))
    per = own.unionByName(related).groupBy("term").agg(
        F.array_sort(F.collect_set(F.when(F.col("ty").isin("IN", "PIN"), F.col("r")))).alias("ingredients"), F.array_sort(F.collect_set(F.when(F.col("ty") == "IN", F.col("nm")))).alias("in_names"),
        F.array_sort(F.collect_set(F.when(F.col("ty").isin("IN", "PIN"), F.col("nm")))).alias("any_names"), F.array_sort(F.collect_set(F.when(F.col("ty") == "BN", F.col("nm")))).alias("brands"),
    )
    known = found.join(per, "term", "left")
    side = lambda s: known.select(F.col("term").alias(f"{s}_term"), F.struct("name", "tty", "ingredients", F.when(F.size("in_names") > 0, F.col("in_names")).otherwise(F.col("any_names")).alias("names"), "brands").alias(s))
    q = parsed.join(side("left"), "left_term", "left").join(side("right"), "right_term", "left")
    names, brands = F.array_join("left.names", ", "), F.array_join("left.brands", ", ")
    has = F.col("left").isNotNull()
    same = F.arrays_overlap("left.ingredients", "right.ingredients")
    text = (
        F.when((F.col("form") == "equivalence") & has & F.col("right").isNotNull(), F.when(F.coalesce(same, F.lit(False)), F.format_string("Yes. %s and %s share an ingredient.", "left.name", "right.name")).otherwise(F.format_string("No. %s and %s share no ingredient.", "left.name", "right.name")))
        .when((F.col("form") == "generic_name_lookup") & (F.size("left.names") > 0), F.format_string("The generic name of %s is %s.", F.col("left_term"), names))
        .when((F.col("form") == "ingredient_identity") & (F.size("left.names") > 0), F.format_string("The active ingredient of %s is %s.", F.col("left_term"), names))
        .when((F.col("form") == "brand_name_of") & (F.size("left.brands") > 0), F.format_string("Brand names of %s: %s.", F.col("left_term"), brands))
        .when((F.col("form") == "is_brand_name") & has, F.when(F.col("left.tty") == "BN", F.format_string("Yes. %s is a brand name.", "left.name")).otherwise(F.format_string("No. %s is not a brand name.", "left.name")))
        .when((F.col("form") == "drug_identity_definition") & has, F.when((F.col("left.tty") == "BN") & (F.size("left.names") > 0), F.format_string("%s is a brand name of %s.", F.col("left.name"), names)).when(F.col("left.tty") == "IN", F.format_string("%s is an ingredient.", "left.name")).when(F.col("left.tty") == "PIN", F.format_string("%s is a precise ingredient.", "left.name")).otherwise(F.format_string("%s is a drug concept.", "left.name")))
    )
    cites = F.when(text.isNull(), F.array().cast("array<string>")).when(F.col("form") == "equivalence", F.array(F.lit("R1"), F.lit("R2"))).otherwise(F.array(F.lit("R1")))
    return q.select("query_id", text.isNotNull().alias("answered"), text.alias("answer"), cites.alias("citations"))


def decomposed(questions: DataFrame) -> DataFrame:
    """query_id, composition, identity_query, clinical_query: split at the first "and"; in the second part the drug takes the place of the first "this drug", then of the first "it"."""
    parts = F.split(F.trim("query"), r"(?i)\s+and\s+", 2)
    drug = F.regexp_replace(F.coalesce("retrieval_drug", F.lit("")), r"([\\$])", r"\\$1")
    clause = F.regexp_replace(F.trim(F.get(parts, F.lit(1))), r"[\s?.!]+$", "")
    swap = lambda t, p: F.regexp_replace(t, F.lit(rf"(?is)^(.*?)\b{p}\b"), F.concat(F.lit("$1"), drug))
    canned = F.lower(collapse(clause)).isin("what is it used for", "what's it used for", "what is this drug used for", "what's this drug used for")
    clinical = F.when(canned, F.concat(F.lit("What is "), F.col("retrieval_drug"), F.lit(" used for?"))).otherwise(question(capitalise_first(swap(swap(clause, "this drug"), "it"))))
    first = F.nullif(question(capitalise_first(F.trim(F.get(parts, F.lit(0))))), F.lit(""))
    second = F.nullif(clinical, F.lit(""))
    two = F.size(parts) == 2
    ok = two & first.isNotNull() & second.isNotNull()
    return questions.select("*", F.when(ok, "composed_answered").otherwise("unsupported_decomposition").alias("composition"), F.when(two, first).alias("identity_query"), F.when(two, second).alias("clinical_query"))


def mixed_status(drug: Column, intent: Column, composition: Column, identity_answered: Column, clinical_answered: Column) -> Column:
    """The first gate that fails names the status."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(drug.isNull(), "missing_drug_context").when(intent.isNull(), "missing_identity_intent").when(composition != "composed_answered", "unsupported_decomposition")
        .when(no(identity_answered), "identity_answer_insufficient").when(no(clinical_answered), "clinical_answer_insufficient").otherwise("composed_answered")
    )


# Markers of the guardrails, raw substrings of lower-cased text.
GUARANTEE = ("guarantee", "guarantees", "guaranteed")
THERAPEUTIC = ("treat", "treats", "treated", "cure", "cures", "used for", "help with", "help treat")
NEGATIVE_EVIDENCE = ("does not", "do not", "is not", "are not", "not used", "not indicated", "not for", "cannot", "can't")
NEGATIVE_ANSWER = ("no,", "no.", "does not", "do not", "doesn't", "is not", "are not", "not used", "not indicated", "not for", "cannot", "can't")
TARGETS = [
    r"\b(?:does|do|can|could|will|would|is|are)\s+.+?\s+treat\s+(.+)$",
    r"\b(?:does|do|can|could|will|would|is|are)\s+.+?\s+cure\s+(.+)$",
    r"\b(?:does|do|can|could|will|would|is|are)\s+.+?\s+help treat\s+(.+)$",
    r"\b(?:does|do|can|could|will|would|is|are)\s+.+?\s+help with\s+(.+)$",
    r"\b(?:is|are)\s+.+?\s+used for\s+(.+)$",
]
TARGET_STOPS = ("a", "an", "the", "of", "for", "to", "with", "in", "on", "from")


def guarantee_blocked(asked: Column, cited: Column, status: Column) -> Column:
    return (status == "answered") & contains_any(asked, GUARANTEE) & ~contains_any(cited, GUARANTEE)


def treatment_target(asked: Column) -> Column:
    text = F.regexp_replace(collapse(F.lower(asked)), "[?.]+$", "")
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in TARGETS))


def target_mentioned(cited: Column, target: Column) -> Column:
    text, wanted = collapse(F.lower(cited)), collapse(F.lower(target))
    words = F.filter(F.regexp_extract_all(F.lower(target), F.lit("[a-zA-Z0-9]+"), F.lit(0)), lambda w: ~w.isin(*TARGET_STOPS) & (F.length(w) > 1))
    return F.coalesce(F.contains(text, wanted) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(text, w))), F.lit(False))


def negative_treatment_blocked(asked: Column, answer: Column, cited: Column, status: Column) -> Column:
    claim = (status == "answered") & contains_any(asked, THERAPEUTIC) & contains_any(answer, NEGATIVE_ANSWER)
    return claim & (~target_mentioned(cited, treatment_target(asked)) | ~contains_any(cited, NEGATIVE_EVIDENCE))


def json_object(text: Column) -> Column:
    """What lies between the outermost braces; null without any."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def parsed_answer(raw: Column) -> Column:
    """status, answer, citations, evidence_summary of a model's output, and error: why some of them can't be had.

    The outermost object is parsed to a variant, from which fields are taken by type: further keys don't matter, a number
    stands for its text, an object as a field's value for its JSON. no_object: no braces; broken_json: what they hold isn't JSON (or
    names a key twice); citations_not_a_list: citations stay null.
    """
    text = json_object(raw)
    v = F.try_parse_json(text)
    field = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    given = F.is_variant_null(F.coalesce(F.try_variant_get(v, "$.citations", "variant"), F.parse_json(F.lit("null"))))
    citations = field("citations", "array<string>")
    error = F.when(text.isNull(), "no_object").when(v.isNull(), "broken_json").when(citations.isNull() & ~given, "citations_not_a_list")
    return F.struct(field("status", "string").alias("status"), field("answer", "string").alias("answer"), citations.alias("citations"), field("evidence_summary", "string").alias("evidence_summary"), error.alias("error"))


def foreign_citations(citations: Column, evidence_ids: Column) -> Column:
    return F.array_except(citations, evidence_ids)


def prefixes_pass(citations: Column, prefixes: Column) -> Column:
    """Whether every citation begins with one of the prefixes; no prefixes allow all."""
    return (F.size(prefixes) == 0) | F.forall(citations, lambda c: F.exists(prefixes, lambda p: F.startswith(c, p)))


def cited_text(evidence: Column, citations: Column) -> Column:
    """The texts of the evidence that is cited; unknown citations are passed over."""
    return F.array_join(F.transform(F.filter(evidence, lambda e: F.array_contains(citations, e["evidence_id"])), lambda e: e["text"]), "\n")


def verdict(answer: Column, cited: Column, least: float = 0.5) -> Column:
    """Stand-in for a model's verdict: supported where enough of the answer's words are in the cited text."""
    words = F.array_distinct(tokens(answer))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(words, tokens(cited))), F.size(words)), F.lit(0.0))
    return F.when(share >= least, "supported").otherwise("insufficient")


def answer_gates(answers: DataFrame, verifier: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, final_status, gate of (query_id, query, raw, evidence): the first gate that an answer fails names it.

    ``verifier``: an expression of answer and cited text that is "supported" or something else; by default ``verdict``.
    """
    a = answers.withColumn("_a", parsed_answer(F.col("raw"))).withColumn("_c", F.coalesce("_a.citations", F.array().cast("array<string>"))).withColumn("_t", cited_text(F.col("evidence"), F.col("_c")))
    ids = F.transform("evidence", lambda e: e["evidence_id"])
    status = F.col("_a.status")
    gate = (
        F.when(F.size("evidence") == 0, "no_evidence").when(status.isNull() | F.col("_a.answer").isNull(), "bad_output").when(F.size(foreign_citations(F.col("_c"), ids)) > 0, "foreign_citation")
        .when((status == "answered") != (F.size("_c") > 0), "citations_do_not_fit_status").when(status != "answered", "model_abstained").when(guarantee_blocked(F.col("query"), F.col("_t"), status), "guarantee_guardrail")
        .when(negative_treatment_blocked(F.col("query"), F.col("_a.answer"), F.col("_t"), status), "negative_treatment_guardrail").when((verifier or verdict)(F.col("_a.answer"), F.col("_t")) != "supported", "verifier").otherwise("passed")
    )
    return a.select("query_id", gate.alias("gate")).withColumn("final_status", F.when(F.col("gate") == "passed", "answered").otherwise("insufficient_evidence"))


def workflow(questions: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame) -> DataFrame:
    """``workflow_of_each``, questions that ask the same worked out once."""
    return once(questions, lambda q: workflow_of_each(q, aliases, relations, corpus))


def workflow_of_each(questions: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame) -> DataFrame:
    """``questions`` with each one's filter, plan, mention, route and branch. An explicit drug that can't be resolved ends as insufficient, whatever the branch."""
    filters = filter_resolution(questions, aliases, relations, corpus)
    found = mentions_of_each(questions.filter(F.trim(F.coalesce("drug", F.lit(""))) == ""), aliases, relations, corpus)
    q = family_plan(questions).join(filters, "query_id").join(found, "query_id", "left")
    q = q.withColumn("mention_status", F.coalesce("mention_status", F.lit("not_attempted_explicit_filter_present"))).withColumn("drug_found", F.coalesce("filter_drug", "retrieval_drug"))
    routed = source_route(q.withColumn("has_drug", F.col("drug_found").isNotNull()))
    closed = F.col("filter_status").isin("ambiguous", "resolved_not_in_corpus", "unresolved")
    branch = F.when(closed, "insufficient_evidence").when(F.col("planned_source") == "multi_source_composed", "mixed").when(F.col("planned_source") == "rxnorm_identity", "identity").otherwise("label")
    effective = F.coalesce(F.nullif(F.trim("family"), F.lit("")), "plan_family")
    return routed.select("query_id", "query", "filter_status", "plan_status", "plan_family", "mention_status", "drug_found", "route_status", "planned_source", "identity_intent", branch.alias("branch"), effective.alias("effective_family"))


def label_evidence(questions: DataFrame, sections: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id and evidence (evidence_id, text) of (query_id, query, drug, family): the k sections of the drug (any, if null) and family (any, if null) with most of the question's terms, the drug's name aside.

    Questions that ask for the same terms, drug and family are answered once. Sections that hold the same of all asked terms, with
    the same drug and family, are as good as each other: they make a class, of which the k first are kept. Questions meet
    classes, and go on with the k best of them: by score, then by the class's first section. Nothing more can be among
    the best k sections. ``sections``: section_id, concept_name, family, text.
    """
    words = F.array_except(tokens(F.col("query")), F.concat(tokens(F.col("drug")), F.array(*(F.lit(w) for w in sorted(STOP)))))
    keyed = questions.select("query_id", F.lower("drug").alias("concept"), F.col("family").alias("asked_family"), F.array_sort(F.array_distinct(words)).alias("terms"))
    keyed = materialised(keyed.withColumn("ask", F.to_json(F.struct("terms", "concept", "asked_family"))))
    asked = materialised(keyed.groupBy("ask").agg(F.first("concept").alias("concept"), F.first("asked_family").alias("asked_family"), F.first("terms").alias("terms")).select("ask", "concept", "asked_family", F.explode("terms").alias("term")))
    known = broadcast_if_small(asked.select("term").distinct())
    held = sections.select("section_id", F.lower("concept_name").alias("concept"), "family", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(known, "term", "left_semi")
    signed = held.groupBy("section_id").agg(F.first("concept").alias("concept"), F.first("family").alias("family"), F.array_sort(F.collect_set("term")).alias("own"))
    firsts = numbered(signed, ["concept", "family", "own"], [F.asc("section_id")], "n").filter(F.col("n") <= k)
    classes = materialised(firsts.groupBy("concept", "family", "own").agg(F.array_sort(F.collect_list("section_id")).alias("ids")))  # at most k
    by_term = classes.select("concept", "family", "own", "ids", F.explode("own").alias("term")).drop("own")
    named = asked.filter("concept IS NOT NULL").join(by_term, ["concept", "term"])
    free = asked.filter("concept IS NULL").drop("concept").join(by_term, "term")
    hits = named.unionByName(free).filter(F.col("asked_family").isNull() | (F.col("asked_family") == F.col("family")))
    met = numbered(hits.groupBy("ask", "ids").agg(F.count(F.lit(1)).alias("score")), ["ask"], [F.desc("score"), F.get("ids", F.lit(0))], "n").filter(F.col("n") <= k)
    best = numbered(met.select("ask", "score", F.explode("ids").alias("section_id")), ["ask"], [F.desc("score"), F.asc("section_id")], "rank").filter(F.col("rank") <= k)
    rows = best.join(sections.select("section_id", "text"), "section_id")
    per = rows.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("e"))  # at most k
    evidence = F.transform("e", lambda x: F.struct(F.concat(F.lit("E"), x["rank"].cast("string")).alias("evidence_id"), x["text"].alias("text")))
    none = F.array().cast("array<struct<evidence_id:string,text:string>>")
    return keyed.select("query_id", "ask").join(per, "ask", "left").select("query_id", F.coalesce(evidence, none).alias("evidence"))


def label_answers(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """query_id, gate, answered, answer, citations. The stand-in for a language model quotes the first evidence; its output passes every gate that a model's would."""
    q = questions.join(label_evidence(questions, sections), "query_id")
    said = F.struct(F.lit("answered").alias("status"), F.get("evidence", F.lit(0))["text"].alias("answer"), F.array(F.lit("E1")).alias("citations"))
    raw = materialised(q.withColumn("raw", F.to_json(said)))
    gates = answer_gates(raw).withColumn("answered", F.col("final_status") == "answered")
    out = raw.select("query_id", parsed_answer(F.col("raw")).alias("a")).join(gates, "query_id")
    given = lambda c, other: F.when(F.col("answered"), F.col(c)).otherwise(other)
    return out.select("query_id", "gate", "answered", given("a.answer", F.lit(None)).alias("answer"), given("a.citations", F.array().cast("array<string>")).alias("citations"))


def answers(questions: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame, sections: DataFrame) -> DataFrame:
    """``answers_of_each``, questions that ask the same worked out once."""
    return once(questions, lambda q: answers_of_each(q, aliases, relations, corpus, sections))


def answers_of_each(questions: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame, sections: DataFrame) -> DataFrame:
    """Every question through its branch: query_id, branch, composition_status, final_status, answer, citations (R* of identities, then E* of labels)."""
    flow = materialised(workflow_of_each(questions, aliases, relations, corpus))
    mixed = materialised(decomposed(flow.filter("branch = 'mixed'").withColumnRenamed("drug_found", "retrieval_drug")))
    asked = flow.filter("branch = 'identity'").select("query_id", "query", "identity_intent").unionByName(mixed.select("query_id", F.col("identity_query").alias("query"), "identity_intent"))
    identity = identity_answers(identity_terms(asked), aliases, relations).select("query_id", F.col("answered").alias("i_ok"), F.col("answer").alias("i_answer"), F.col("citations").alias("i_cites"))
    clinical = mixed.select("query_id", F.col("clinical_query").alias("query"), F.col("retrieval_drug").alias("drug"), F.col("effective_family").alias("family"))
    label = flow.filter("branch = 'label'").select("query_id", "query", F.col("drug_found").alias("drug"), F.col("effective_family").alias("family")).unionByName(clinical)
    label = label_answers(label, sections).select("query_id", F.col("answered").alias("l_ok"), F.col("answer").alias("l_answer"), F.col("citations").alias("l_cites"))
    q = flow.join(mixed.select("query_id", "composition"), "query_id", "left").join(identity, "query_id", "left").join(label, "query_id", "left")
    is_mixed = F.col("branch") == "mixed"
    q = q.withColumn("composition_status", F.when(is_mixed, mixed_status(F.col("drug_found"), F.col("identity_intent"), F.col("composition"), F.col("i_ok"), F.col("l_ok"))))
    ok = F.when(is_mixed, F.col("composition_status") == "composed_answered").when(F.col("branch") == "identity", F.col("i_ok")).when(F.col("branch") == "label", F.col("l_ok")).otherwise(F.lit(False))
    text = F.when(is_mixed, F.concat_ws("\n\n", "i_answer", "l_answer")).otherwise(F.coalesce("i_answer", "l_answer"))
    none = F.array().cast("array<string>")
    cites = F.concat(F.coalesce("i_cites", none), F.coalesce("l_cites", none))
    q = q.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return q.select("query_id", "branch", "composition_status", F.when(F.col("ok"), "answered").otherwise("insufficient_evidence").alias("final_status"), F.when(F.col("ok"), text).alias("answer"), F.when(F.col("ok"), cites).otherwise(none).alias("citations"))
