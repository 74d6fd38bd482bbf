"""Request-log queries: the events table stands for the request log, labels for its evidence log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..sources.tables import table


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests; nulls where the log would have them."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    proposed = F.when(k % 3 == 0, "insufficient_evidence").otherwise("answered")
    final = F.when(k % 5 == 0, "insufficient_evidence").otherwise(proposed)
    frame = e.select(
        F.col("event_id").alias("request_log_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.nullif("event_type", F.lit("error")).alias("planned_source"),
        F.when(k % 4 != 1, F.concat(F.lit("route_"), (k % 3).cast("string"))).alias("source_plan_status"),
        F.when(k % 4 != 2, F.concat(F.lit("family_"), (k % 2).cast("string"))).alias("family_plan_status"),
        F.when(k % 10 == 0, "composed_answered").when(k % 10 == 1, "clinical_answer_insufficient").alias("composition_status"),
        F.nullif(F.concat(F.lit("drug"), (F.col("user_id") % 6).cast("string")), F.lit("drug0")).alias("drug_filter"),
        F.nullif(F.concat(F.lit("family"), (k % 8).cast("string")), F.lit("family0")).alias("family_filter"),
        F.when(k % 8 != 7, proposed).alias("proposed_status"),
        final.alias("final_status"),
        F.when(k % 4 == 0, "supported").when(k % 4 == 1, "insufficient").when(k % 4 == 2, "refuted").alias("verdict"),
        F.when(k % 9 != 0, k % 7 == 0).alias("guardrail_triggered"),
        (proposed != final).alias("overrode"),
        (k % 6).alias("evidence_count"),
        (k % 3).alias("identity_evidence_count"),
        F.col("value").alias("api_latency_ms"),
    )
    return A.enrich(frame)


REQ = """
WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
p AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS pr FROM k),
f AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'insufficient_evidence' ELSE pr END AS fi FROM p),
r0 AS (SELECT event_id AS request_log_id, ts AS created_at, nullif(event_type, 'error') AS planned_source,
  CASE WHEN k % 4 <> 1 THEN 'route_' || (k % 3) END AS source_plan_status, CASE WHEN k % 4 <> 2 THEN 'family_' || (k % 2) END AS family_plan_status,
  CASE WHEN k % 10 = 0 THEN 'composed_answered' WHEN k % 10 = 1 THEN 'clinical_answer_insufficient' END AS composition_status,
  nullif('drug' || (user_id % 6), 'drug0') AS drug_filter, nullif('family' || (k % 8), 'family0') AS family_filter,
  CASE WHEN k % 8 <> 7 THEN pr END AS proposed_status, fi AS final_status,
  CASE k % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'refuted' END AS verdict,
  CASE WHEN k % 9 <> 0 THEN k % 7 = 0 END AS guardrail_triggered, pr <> fi AS overrode, k % 6 AS evidence_count, k % 3 AS identity_evidence_count, value AS api_latency_ms FROM f),
r AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS request_date, coalesce(proposed_status, 'none') || ' → ' || coalesce(final_status, 'none') AS status_transition,
  coalesce(evidence_count, 0) + coalesce(identity_evidence_count, 0) AS total_evidence FROM r0)
"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as evidence rows: lang is the family, a row is cited where its quality is 1."""
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("retrieval_family")).join(table(spark, d, "labels"), "doc_id").withColumn("was_cited", F.col("quality") == 1)


EV = "WITH ev AS (SELECT d.doc_id, d.lang AS retrieval_family, l.quality = 1 AS was_cited FROM documents d JOIN labels l USING (doc_id)) "


def queries() -> dict:
    q = {}
    q["source_share"] = lambda s, d: A.shares(requests(s, d), "planned_source")
    q["status_share"] = lambda s, d: A.shares(requests(s, d), "final_status")
    q["verdict_counts"] = lambda s, d: A.counts(requests(s, d), "verdict", keep_null=False)
    q["status_transition"] = lambda s, d: A.counts(requests(s, d), "status_transition", keep_null=False)
    q["source_plan_counts"] = lambda s, d: A.counts(requests(s, d), "source_plan_status", sentinel=True)
    q["family_plan_counts"] = lambda s, d: A.counts(requests(s, d), "family_plan_status", sentinel=True)
    q["composition_counts"] = lambda s, d: A.counts(requests(s, d), "composition_status", sentinel=True)
    q["sentinel_fill"] = lambda s, d: requests(s, d).fillna(A.SENTINELS).select("request_log_id", *A.SENTINELS)
    q["evidence_count_dist"] = lambda s, d: A.counts(requests(s, d), "evidence_count").orderBy("evidence_count")
    q["identity_count_dist"] = lambda s, d: A.counts(requests(s, d), "identity_evidence_count").orderBy("identity_evidence_count")
    q["total_support_dist"] = lambda s, d: A.counts(requests(s, d), "total_evidence").orderBy("total_evidence")
    q["daily_volume"] = lambda s, d: A.counts(requests(s, d), "request_date").orderBy("request_date")
    q["drug_filter_counts"] = lambda s, d: A.counts(requests(s, d), "drug_filter", sentinel=True)
    q["family_filter_counts"] = lambda s, d: A.counts(requests(s, d), "family_filter", sentinel=True)
    q["top_families"] = lambda s, d: A.counts(requests(s, d), "family_filter", sentinel=True).orderBy(F.desc("n"), "family_filter").limit(5)
    q["evidence_by_family"] = lambda s, d: A.evidence_by_family(evidence(s, d))
    q["cited_by_family"] = lambda s, d: A.evidence_by_family(evidence(s, d), cited_only=True)
    q["latency_summary"] = lambda s, d: A.latency_summary(requests(s, d))
    q["latency_by_source"] = lambda s, d: A.latency_by(requests(s, d), "planned_source")
    q["share_within_source"] = lambda s, d: A.shares_within(requests(s, d), "planned_source", "final_status")
    q["intervention_summary"] = lambda s, d: A.intervention_summary(requests(s, d))
    q["latency_histogram"] = lambda s, d: A.histogram(requests(s, d), "api_latency_ms")
    q["recent_requests"] = lambda s, d: requests(s, d).orderBy(F.desc("created_at"), F.desc("request_log_id")).limit(10).select("request_log_id", "planned_source", "final_status", "api_latency_ms")
    q["status_overview"] = lambda s, d: requests(s, d).groupBy("final_status", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("api_latency_ms"), 2).alias("mean_ms"), F.round(F.max("api_latency_ms"), 2).alias("max_ms")).orderBy(F.desc("n"), "final_status")
    q["guardrail_counts"] = lambda s, d: requests(s, d).agg(F.count_if("guardrail_triggered").alias("guardrails"), F.count_if("overrode").alias("overrides"), F.count(F.lit(1)).alias("requests"))
    return q


def oracle_sql() -> dict[str, str]:
    def count(by: str, where: str = "", fill: str = "") -> str:
        col = f"coalesce({by}, '{fill}')" if fill else by
        return f"{REQ} SELECT {col} AS {by}, count(*) AS n FROM r {where} GROUP BY 1"

    def share(by: str) -> str:
        return f"{REQ} SELECT {by}, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY {by}"

    stats = {"count": "count(api_latency_ms)::DOUBLE", "mean": "avg(api_latency_ms)", "median": "quantile_cont(api_latency_ms, 0.5)", "min": "min(api_latency_ms)", "max": "max(api_latency_ms)", "p95": "quantile_cont(api_latency_ms, 0.95)"}
    s = A.SENTINELS
    return {
        "source_share": share("planned_source"),
        "status_share": share("final_status"),
        "verdict_counts": count("verdict", "WHERE verdict IS NOT NULL"),
        "status_transition": count("status_transition", "WHERE status_transition IS NOT NULL"),
        "source_plan_counts": count("source_plan_status", fill=s["source_plan_status"]),
        "family_plan_counts": count("family_plan_status", fill=s["family_plan_status"]),
        "composition_counts": count("composition_status", fill=s["composition_status"]),
        "sentinel_fill": f"{REQ} SELECT request_log_id, {', '.join(f'''coalesce({c}, '{v}') AS {c}''' for c, v in s.items())} FROM r",
        "evidence_count_dist": count("evidence_count"),
        "identity_count_dist": count("identity_evidence_count"),
        "total_support_dist": count("total_evidence"),
        "daily_volume": count("request_date"),
        "drug_filter_counts": count("drug_filter", fill=s["drug_filter"]),
        "family_filter_counts": count("family_filter", fill=s["family_filter"]),
        "top_families": count("family_filter", fill=s["family_filter"]) + " ORDER BY n DESC, 1 LIMIT 5",
        "evidence_by_family": f"{EV} SELECT retrieval_family, count(*) AS n FROM ev GROUP BY 1",
        "cited_by_family": f"{EV} SELECT retrieval_family, count(*) AS n FROM ev WHERE was_cited GROUP BY 1",
        "latency_summary": " UNION ALL ".join([f"{REQ} SELECT 'count' AS metric, round({stats['count']}, 4) AS value FROM r"] + [f"SELECT '{k}', round({v}, 4) FROM r" for k, v in stats.items() if k != "count"]),
        "latency_by_source": f"{REQ} SELECT planned_source, count(api_latency_ms) AS n, round(avg(api_latency_ms), 4) AS mean, round(quantile_cont(api_latency_ms, 0.5), 4) AS median, round(quantile_cont(api_latency_ms, 0.95), 4) AS p95, round(max(api_latency_ms), 4) AS max FROM r GROUP BY 1",
        "share_within_source": f"{REQ} SELECT planned_source, final_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY planned_source), 6) AS share FROM r GROUP BY 1, 2",
        "intervention_summary": f"{REQ}, o AS (SELECT count(*) AS a, count(*) FILTER (WHERE guardrail_triggered) AS g, count(*) FILTER (WHERE overrode) AS v FROM r) SELECT 'guardrail' AS intervention, g AS n, round(coalesce(g / a, 0), 6) AS rate FROM o UNION ALL SELECT 'override', v, round(coalesce(v / a, 0), 6) FROM o",
        "latency_histogram": f"{REQ}, b AS (SELECT min(api_latency_ms) AS lo, max(api_latency_ms) AS hi, least(10, greatest(1, count(api_latency_ms))) AS bins FROM r) SELECT least(floor((api_latency_ms - lo) / ((hi - lo) / bins)), bins - 1)::BIGINT AS bin, count(*) AS n FROM r, b GROUP BY 1",
        "recent_requests": f"{REQ} SELECT request_log_id, planned_source, final_status, api_latency_ms FROM r ORDER BY created_at DESC, request_log_id DESC LIMIT 10",
        "status_overview": f"{REQ} SELECT final_status, verdict, count(*) AS n, round(avg(api_latency_ms), 2) AS mean_ms, round(max(api_latency_ms), 2) AS max_ms FROM r GROUP BY 1, 2",
        "guardrail_counts": f"{REQ} SELECT count(*) FILTER (WHERE guardrail_triggered) AS guardrails, count(*) FILTER (WHERE overrode) AS overrides, count(*) AS requests FROM r",
    }
