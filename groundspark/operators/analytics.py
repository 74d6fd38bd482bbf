"""Summaries of a request log. Each takes the enriched request frame; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialised

#: What stands for a null in summaries.
SENTINELS = {
    "planned_source": "<UNPLANNED>",
    "source_plan_status": "<NO_SOURCE_PLAN_STATUS>",
    "family_plan_status": "<NO_FAMILY_PLAN_STATUS>",
    "composition_status": "<NOT_COMPOSED>",
    "drug_filter": "<NO_DRUG_FILTER>",
    "family_filter": "<NO_FAMILY_FILTER>",
}


def enrich(requests: DataFrame) -> DataFrame:
    """Request date, status transition and total evidence."""
    return requests.withColumns({
        "request_date": F.date_format("created_at", "yyyy-MM-dd"),
        "status_transition": F.concat_ws(" → ", F.coalesce("proposed_status", F.lit("none")), F.coalesce("final_status", F.lit("none"))),
        "total_evidence": F.coalesce("evidence_count", F.lit(0)) + F.coalesce("identity_evidence_count", F.lit(0)),
    })


def counts(df: DataFrame, by: str, keep_null: bool = True, sentinel: bool = False) -> DataFrame:
    if sentinel:
        df = df.fillna({by: SENTINELS[by]})
    elif not keep_null:
        df = df.filter(F.col(by).isNotNull())
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, by: str, keep_null: bool = True) -> DataFrame:
    """Counts, and each one's share of all. The window is over the groups, not over the rows."""
    grouped = counts(df, by, keep_null)
    return grouped.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def shares_within(df: DataFrame, parent: str, by: str) -> DataFrame:
    grouped = df.groupBy(parent, by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(parent)), 6))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: str | None = None) -> DataFrame:
    """Exact percentiles, interpolated, of each group: ``by`` and a column for each name in ``shares``.

    Values are counted, dealt in ranges and ranked inside these; a range's rank begins at the sum of those before it. So no group has to meet in one task, however large.
    """
    group = F.struct((F.lit(0) if by is None else F.col(by)).alias("x")).alias("_by")  # never null itself
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = materialised(counted.repartitionByRange("_by", "_v").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_by", "_part").agg(F.sum("_n").alias("_sum"))  # a row for each group and range
    before = F.sum("_sum").over(Window.partitionBy("_by").orderBy("_part")) - F.col("_sum")
    sums = sums.select("_by", "_part", before.alias("_before"), F.sum("_sum").over(Window.partitionBy("_by")).alias("_total"))
    own = F.sum("_n").over(Window.partitionBy("_by", "_part").orderBy("_v"))
    ranks = ranged.select("*", own.alias("_own")).join(sums, ["_by", "_part"]).select("_by", "_v", "_total", (F.col("_before") + F.col("_own") - F.col("_n")).alias("_first"), (F.col("_before") + F.col("_own") - 1).alias("_last"))
    at = {name: share * (F.col("_total") - 1) for name, share in shares.items()}
    holds = lambda rank: F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_v")))
    found = ranks.groupBy("_by").agg(*(holds(f(p)).alias(f"{name}_{f.__name__}") for name, p in at.items() for f in (F.floor, F.ceil)), F.max("_total").alias("_total"))
    between = lambda name, share: F.col(f"{name}_floor") + (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) * (share * (F.col("_total") - 1) - F.floor(share * (F.col("_total") - 1)))
    return found.select(*([] if by is None else [F.col("_by.x").alias(by)]), *(between(n, x).alias(n) for n, x in shares.items()))


def latency_summary(df: DataFrame, value: str = "api_latency_ms") -> DataFrame:
    """Metric rows; the 95th percentile is interpolated."""
    one = df.agg(F.count(value).cast("double").alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    one = one.join(percentiles(df, value, {"median": 0.5, "p95": 0.95}), how="left", on=F.lit(True))  # one row each
    return one.select(F.stack(F.lit(6), *(x for c in ("count", "mean", "median", "min", "max", "p95") for x in (F.lit(c), F.round(c, 4)))).alias("metric", "value"))


def latency_by(df: DataFrame, by: str, value: str = "api_latency_ms") -> DataFrame:
    each = df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.max(value), 4).alias("max"))
    parts = percentiles(df, value, {"median": 0.5, "p95": 0.95}, by)
    return each.join(parts, each[by].eqNullSafe(parts[by]), "left").select(each[by], "n", "mean", F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"), "max")


def rate(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def intervention_summary(df: DataFrame) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.coalesce("guardrail_triggered", F.lit(False))).alias("guardrail"), F.count_if(F.coalesce("overrode", F.lit(False))).alias("override"))
    pairs = [x for c in ("guardrail", "override") for x in (F.lit(c), F.col(c), F.round(rate(F.col(c), F.col("all")), 6))]
    return one.select(F.stack(F.lit(2), *pairs).alias("intervention", "n", "rate"))


def evidence_by_family(evidence: DataFrame, cited_only: bool = False) -> DataFrame:
    rows = evidence.filter(F.coalesce("was_cited", F.lit(False))) if cited_only else evidence
    return rows.groupBy("retrieval_family").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, most: int = 10) -> DataFrame:
    """Equal bins between least and largest value, at most ``most`` and no more than there are rows."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.least(F.lit(most), F.greatest(F.lit(1), F.count(value))).cast("int").alias("bins"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0)), F.col("bins") - 1)
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).select(place.cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # one row is broadcast
