"""Readers. Schemas are explicit where a format doesn't carry one."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Seed records as a table; fields that a record lacks are null. (The list is a configuration file's.)"""
    names = [c.split()[0] for c in schemas.SEEDS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.SEEDS)


def seeds_from_yaml(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    found = yaml.safe_load(text[0]) if text else []
    return seeds(spark, found.get("drugs", found) if isinstance(found, dict) else found or [])


def locked(seed_rows: DataFrame) -> DataFrame:
    """Seeds with both a set and a version."""
    return seed_rows.filter(F.col("set_id").isNotNull() & F.col("locked_spl_version").isNotNull())


def histories(spark: SparkSession, path: str) -> DataFrame:
    """One row per published version from history documents."""
    return flatten_history(spark.read.schema(schemas.HISTORY).json(path, multiLine=True))


def flatten_history(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("data.spl.setid").alias("set_id"), F.col("data.spl.title").alias("title"), F.explode("data.history").alias("h")).select("set_id", "title", F.col("h.spl_version").cast("string").alias("history_spl_version"), F.col("h.published_date").alias("published_date"))


PARSED = "label_id STRING, sections ARRAY<STRUCT<section_uid: STRING, parent_section_uid: STRING, order_index: INT, depth: INT, canonical_section_name: STRING, direct_text: STRING>>"


def parsed_labels(spark: SparkSession, path: str) -> DataFrame:
    """A row for each section of parsed labels kept as JSON, one label a line."""
    return spark.read.schema(PARSED).json(path).select("label_id", F.inline("sections"))


#: Fields of an evaluation case, and what stands for those that a suite leaves out.
CASE = "case_id STRING, query STRING, expected_status STRING, drug STRING, family STRING, top_k INT, required_headings ARRAY<STRING>, allowed_citation_prefixes ARRAY<STRING>"
DEFAULTS = {"top_k": 5, "required_headings": [], "allowed_citation_prefixes": []}


def eval_suite(spark: SparkSession, path: str) -> DataFrame:
    """The cases of YAML suites, each file read by a task; optional fields get their defaults."""
    names = [c.split()[0] for c in CASE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same, in C where there is one
        kinds = [pa.string()] * 5 + [pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            for text in batch.column(0):
                found = yaml.load(text.as_py() or "", loader) or []
                cases = (found.get("cases") or []) if isinstance(found, dict) else found
                rows = [tuple(r[n] if r.get(n) is not None else DEFAULTS.get(n) for n in names) for r in cases]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return spread(spark.read.text(path, wholetext=True)).mapInArrow(run, CASE)


def pages_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Captured pages of a paged listing: the rows in each page's ``data``."""
    return spark.read.schema(f"data ARRAY<STRUCT<{schema}>>").json(path, multiLine=True).select(F.inline("data"))


def keyed_csv(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """CSV files with headers, in order of their names; of rows with equal keys the last one stays, however files are split."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.csv(path, header=True, schema=schema).select("*", at.alias("_at"))
    return last_by_key(rows, keys, "_at").drop("_at")


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select(*keys, "r.*")


def largest_xml_members(archives: DataFrame) -> DataFrame:
    """path, member, size, xml of each ZIP archive's largest .xml member; ``archives`` is of the binaryFile source. Archives without one have nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                member = size = xml = None
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        own = [i for i in z.infolist() if i.filename.lower().endswith(".xml")]
                        if own:
                            best = max(own, key=lambda i: i.file_size)
                            member, size, xml = best.filename, best.file_size, z.read(best).decode("utf-8", "replace")
                except zipfile.BadZipFile:
                    pass
                rows.append((path, member, size, xml))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "member", "size", "xml"])

    return archives.select("path", "content").mapInArrow(run, "path string, member string, size long, xml string")


def broadcast_if_small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df``, cheap to compute twice, marked for broadcast if its rows measure at most ``most`` bytes (as JSON); else joined as Spark sees fit."""
    measured = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()[0]
    return F.broadcast(df) if (measured or 0) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out if it has fewer partitions than the session can work on at once, as a small table in one file has: for what follows in Python."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    """Rows with their place, from 1, in each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
