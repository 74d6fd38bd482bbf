"""Writers: upsert, rebuild, exports, log appends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def shared_folder(spark: SparkSession) -> str | None:
    """What ``spark.checkpoint.dir`` names. A local session may go without it, a cluster may not."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/") if found else None


def new_folder(spark: SparkSession, name: str) -> str:
    """A place for files in the shared folder; in a local session without one, in a temporary folder."""
    return f"{shared_folder(spark) or tempfile.mkdtemp(prefix='groundspark-')}/groundspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once, for results that several branches read: a table in the shared folder, or kept by the executors where a local session has none."""
    if not shared_folder(df.sparkSession):
        return df.persist()
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    """Delete and write anew."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def joined_lists(df: DataFrame, separator: str = "|") -> DataFrame:
    """Arrays as joined strings, as CSV needs."""
    return df.select(*(F.concat_ws(separator, F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


def export_csv(df: DataFrame, path: str) -> None:
    joined_lists(df).write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def request_and_evidence_rows(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The request log's and the evidence log's rows of answers (query_id, ..., citations, evidence: array of structs with evidence_id)."""
    request = answers.withColumn("evidence_count", F.size("evidence")).drop("evidence")
    rows = answers.select("query_id", "citations", F.posexplode("evidence").alias("p", "e"))
    evidence = rows.select("query_id", "e.*", (F.col("p") + 1).alias("evidence_position"), F.coalesce(F.array_contains("citations", F.col("e.evidence_id")), F.lit(False)).alias("was_cited"))
    return request, evidence
