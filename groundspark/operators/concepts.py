"""Lookups in a concept graph kept as tables: its release, properties, related concepts by type, exact and approximate names, and terms normalised to a corpus.

Tables: concepts (rxcui, name, synonym, tty, active; one row an id), aliases (rxcui, alias), relations (rxcui, related_rxcui,
related_tty), corpus (concept_name), releases (version, api_version, published). Every lookup takes all its ids or terms at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE, phrase
from ..sources.sinks import materialised
from .planning import MOST_NEAR, near_names

#: Types of ingredients.
INGREDIENTS = ("IN", "PIN")
PROPERTIES = ("rxcui", "name", "synonym", "tty")
CONCEPT = "struct<rxcui:string,name:string,synonym:string,tty:string>"


def release(releases: DataFrame) -> DataFrame:
    """version, api_version of the latest release, ties by version; one row of nulls without any."""
    last = releases.agg(F.max(F.struct("published", "version", "api_version")).alias("r"))
    return last.select("r.version", "r.api_version")


def properties(ids: DataFrame, concepts: DataFrame) -> DataFrame:
    """rxcui, name, synonym, tty, known of each distinct id; one without a concept has nulls. A null id is no id."""
    own = concepts.select(*PROPERTIES, F.lit(True).alias("known"))
    return ids.select("rxcui").filter("rxcui IS NOT NULL").distinct().join(own, "rxcui", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def related_by_type(ids: DataFrame, relations: DataFrame, concepts: DataFrame, types: tuple[str, ...] = INGREDIENTS) -> DataFrame:
    """rxcui, related (its properties) of each distinct id's relations to concepts of the types, each once. Relations are filtered by type before they meet anything: an ingredient's brands may be many."""
    edges = relations.filter(F.col("related_tty").isin(*types)).select("rxcui", "related_rxcui").distinct()
    held = edges.join(ids.select("rxcui").distinct(), "rxcui", "left_semi")
    to = concepts.select(F.col("rxcui").alias("related_rxcui"), F.struct(*PROPERTIES).alias("related"))
    return held.join(to, "related_rxcui").select("rxcui", "related")


def names_of(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """rxcui, text, normal, active: every name, synonym and alias."""
    own = concepts.select("rxcui", "active", F.explode(F.array("name", "synonym")).alias("text"))
    more = aliases.join(concepts.select("rxcui", "active"), "rxcui").select("rxcui", "active", F.col("alias").alias("text"))
    return own.unionByName(more).filter("text IS NOT NULL").distinct().withColumn("normal", phrase(F.col("text"))).filter("normal <> ''")


def exact_or_normalised(terms: DataFrame, names: DataFrame) -> DataFrame:
    """term, rxcui of (term, normal): concepts named exactly so, or, where none is, those whose normalised name is the term's."""
    hits = terms.join(names, "normal").groupBy("term", "rxcui").agg(F.max(F.col("text") == F.col("term")).alias("exact"))
    best = F.max("exact").over(Window.partitionBy("term"))  # equal texts have equal normal forms, so one join finds both
    return hits.withColumn("best", best).filter(F.col("exact") == F.col("best")).select("term", "rxcui")


def approximate(terms: DataFrame, names: DataFrame, most: int = MOST_NEAR) -> DataFrame:
    """term, rxcui, edits, score, rank of (term, normal): the ``most`` active concepts with the nearest names, ties by name, then id. score: hundredths of the longer name that are left as they are."""
    named = names.filter("active").select("rxcui", F.col("text").alias("name"), F.lit(None).cast("string").alias("tty"), "normal")
    near = near_names(terms, named).groupBy("term", "rxcui").agg(F.min(F.struct("edits", "other")).alias("c"))
    ranked = near.select("term", "rxcui", "c.edits", "c.other").withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("edits", "other", "rxcui")))
    longer = F.greatest(F.length(phrase(F.col("term"))), F.length("other"))
    return ranked.filter(F.col("rank") <= most).select("term", "rxcui", "edits", F.floor(100 * (longer - F.col("edits")) / longer).cast("int").alias("score"), "rank")


def enriched(ids: DataFrame, concepts: DataFrame, relations: DataFrame, corpus: DataFrame) -> DataFrame:
    """rxcui, ingredients (of the concept, itself included if it is one; by id), matches: names of the corpus that it or they have as name or synonym, sorted.

    Of corpus names that normalise alike the largest stands for all. Concepts are enriched once, however many terms lead to them.
    """
    own = concepts.join(ids.select("rxcui").distinct(), "rxcui", "left_semi").select("rxcui", F.struct(*PROPERTIES).alias("c"))
    linked = related_by_type(ids, relations, concepts).withColumnRenamed("related", "c")
    itself = own.filter(F.col("c.tty").isin(*INGREDIENTS))
    ingredients = linked.unionByName(itself).groupBy("rxcui").agg(F.array_sort(F.collect_set("c")).alias("ingredients"))
    known = corpus.filter("concept_name IS NOT NULL").groupBy(phrase(F.col("concept_name")).alias("normal")).agg(F.max("concept_name").alias("own_name"))
    texts = linked.unionByName(own).select("rxcui", F.explode(F.array("c.name", "c.synonym")).alias("t")).select("rxcui", phrase(F.col("t")).alias("normal")).filter("normal <> ''").distinct()
    matches = texts.join(known, "normal").groupBy("rxcui").agg(F.array_sort(F.collect_set("own_name")).alias("matches"))
    return own.select("rxcui", "c").join(ingredients, "rxcui", "left").join(matches, "rxcui", "left").select("rxcui", "c", none_of("ingredients", f"array<{CONCEPT}>"), none_of("matches", "array<string>"))


def none_of(column: str, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(kind)).alias(column)


def normalised(terms: DataFrame, concepts: DataFrame, aliases: DataFrame, relations: DataFrame, corpus: DataFrame) -> DataFrame:
    """input_term, status, corpus_concept, corpus_matches, selected, candidates of each distinct term, white space at its ends aside; null counts as empty.

    Approximate names are asked only for terms without an exact or normalised one. ``candidates`` are in order of their rank (exact
    ones of their ids), with ingredients and corpus matches; ``selected`` is the first with the corpus concept. Status: no_rxnorm_match
    without candidates, rxnorm_match_no_corpus_match, resolved with one corpus name, ambiguous with more.
    """
    bare = F.regexp_replace(F.coalesce("term", F.lit("")), rf"^{WHITE}|{WHITE}$", "")
    asked = materialised(terms.select(bare.alias("term")).distinct().withColumn("normal", phrase(F.col("term"))))
    names = materialised(names_of(concepts, aliases))
    exact = materialised(exact_or_normalised(asked, names))
    near = approximate(asked.join(exact.select("term"), "term", "left_anti"), names)
    nothing = F.lit(None).cast("int")
    found = materialised(exact.select("term", "rxcui", F.lit("exact_or_normalized").alias("match_method"), nothing.alias("score"), nothing.alias("rank")).unionByName(near.select("term", "rxcui", F.lit("approximate").alias("match_method"), "score", "rank")))
    whole = found.join(enriched(found, concepts, relations, corpus), "rxcui")
    entry = F.struct(F.coalesce("rank", F.lit(0)).alias("place"), "rxcui", "c.name", "c.synonym", "c.tty", "match_method", "score", "rank", "ingredients", "matches")
    per = whole.groupBy("term").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # homonyms, or at most MOST_NEAR
    matches = F.array_sort(F.array_distinct(F.flatten(F.transform("e", lambda x: x["matches"]))))
    out = asked.select("term").join(per, "term", "left").withColumn("corpus_matches", F.coalesce(matches, F.array().cast("array<string>")))
    n = F.size("corpus_matches")
    out = out.withColumn("corpus_concept", F.when(n == 1, F.get("corpus_matches", F.lit(0))))
    fields = lambda x: F.struct(*(x[c].alias(c) for c in (*PROPERTIES, "match_method", "score", "rank")))
    chosen = F.get(F.filter("e", lambda x: F.array_contains(x["matches"], F.col("corpus_concept"))), F.lit(0))
    status = F.when(F.col("e").isNull(), "no_rxnorm_match").when(n == 0, "rxnorm_match_no_corpus_match").when(n == 1, "resolved").otherwise("ambiguous")
    candidates = F.transform(F.col("e"), lambda x: F.struct(fields(x).alias("candidate"), x["ingredients"].alias("related_ingredients"), x["matches"].alias("corpus_matches")))
    return out.select(F.col("term").alias("input_term"), status.alias("status"), "corpus_concept", "corpus_matches", F.when(F.col("corpus_concept").isNotNull(), fields(chosen)).alias("selected"), F.coalesce(candidates, F.array()).alias("candidates"))
