"""Corpus rollups and checks. Checks return the rows that violate them: none means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import numbered


def retrievable(family: Column, text: Column) -> Column:
    return family.isNotNull() & text.isNotNull() & (F.length(F.trim(text)) > 0)


def title_score(title: Column, concept: Column, prefer: Column, exclude: Column) -> dict[str, Column]:
    """10 for each preferred token in the title, -100 for each excluded one, 5 for the concept; and the tokens that matched."""
    up = F.upper(title)
    has = lambda t: F.contains(up, F.upper(t))
    good, bad = F.filter(prefer, has), F.filter(exclude, has)
    return {"score": 10 * F.size(good) - 100 * F.size(bad) + F.when(has(concept), 5).otherwise(0), "matched_preferred": good, "matched_excluded": bad}


def published(date: Column) -> Column:
    """A date in one of two forms; the least date where it is neither."""
    return F.coalesce(F.try_to_date(date, "MMM d, yyyy"), F.try_to_date(date, "yyyyMMdd"), F.lit("0001-01-01").cast("date"))


def ranked_candidates(rows: DataFrame) -> DataFrame:
    """By score, date and version, each descending. Versions compare as strings, so "9" precedes "15"."""
    return numbered(rows, ["concept_name"], [F.desc("score"), published(F.col("published_date")).desc(), F.desc("spl_version"), F.asc("setid")], "place")


def first_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.col(order)).alias("r")).select(*keys, "r.*")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents, children[child_key] == parents[parent_key], "left_anti")


def set_rollup(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Count, and each column's sorted distinct values joined."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), " | ").alias(c) for c in columns))


def reconciled(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    left, right = a.select(key, F.lit(True).alias("in_a")), b.select(key, F.lit(True).alias("in_b"))
    return left.join(right, key, "full_outer").filter(F.col("in_a").isNull() | F.col("in_b").isNull()).select(key, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def rollup_without_fan_out(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Number of each kind of child of every parent; children are counted before the join, so none multiplies another."""
    out = parents
    for name, rows in children.items():
        own = rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = out.join(own, key, "left").fillna({name: 0})
    return out
