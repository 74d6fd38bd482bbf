"""Shards that all match the corpus's mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. Row r of a source's n rows stands
at (r + u) / n, where u in [0, 1) is a hash of the source (so that small sources don't all meet at one
place); rows sorted by that fraction are cut into shards of equal counts (law ``rows``: at most one
apart). Whatever stretch of this order a shard takes, it holds each source in its proportion.

Nothing is gathered by source: rows go by ranges of the hash, each range counts its sources, and a
row's rank is its place in its range plus the counts before it. The fractions are sorted once as
narrow rows to find the cuts (one row for each shard goes to the driver). Texts are shuffled once. A
task of a hash range writes to the few shards that its range meets, in order of the fraction; slots
are numbered when the files are read, over narrow rows.

Defined results: a null source is a source of its own; a null doc_id is hashed as such; a null text has no
bytes; repeated rows (equal ids and texts, alike in the hash) are told apart by where they were read, so that
a group of any size is spread; equal texts don't stay together; an empty table gives an empty one; with
fewer rows than shards some shards are empty; a document is kept in a column of its own, so its columns
may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import broadcast_if_small, discard, fan_out, shared_path, table, written

SHARDS = 24
SEED = 42
LAW = "rows"
#: monotonically_increasing_id: the partition above, the row's place in it below.
PLACE_BITS = 33


def _part(at: str) -> F.Column:
    return F.shiftright(F.col(at), PLACE_BITS)


def _place(at: str) -> F.Column:
    return F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def unit(*of) -> F.Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def shuffled(docs: DataFrame, by: str, seed: int) -> DataFrame:
    """doc (a struct of all columns), stratum, at: dealt by ranges of a seeded hash, sorted by stratum and hash; at numbers the rows of each range."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    text = F.col("doc.text").cast("string")
    stratum = F.when(F.col(f"doc.`{by}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"doc.`{by}`").cast("string")))
    rows = docs.select(doc.alias("doc")).select("doc", stratum.alias("stratum"), F.xxhash64(F.lit(seed), F.col("doc.doc_id").cast("long"), text).alias("h"), F.monotonically_increasing_id().alias("tie"))
    dealt = rows.repartitionByRange(fan_out(docs.sparkSession), "h", "tie").sortWithinPartitions("stratum", "h", "tie")
    return written(dealt.select("doc", "stratum", F.monotonically_increasing_id().alias("at")), "shard-rows", compression="zstd")


def ranked(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with frac: the row's rank within its stratum as a fraction of the stratum."""
    per = written(rows.groupBy(_part("at").alias("part"), "stratum").agg(F.count(F.lit(1)).alias("n"), F.min(_place("at")).alias("first")), "shard-strata")
    before = F.sum("n").over(Window.partitionBy("stratum").orderBy("part")) - F.col("n")
    whole = per.groupBy("stratum").agg(F.sum("n").alias("of"))
    places = written(per.select("part", "stratum", (before - F.col("first")).alias("ahead")).join(whole, "stratum"), "shard-places")
    found = rows.withColumn("part", _part("at")).join(broadcast_if_small(places), ["part", "stratum"])
    return found.select("doc", "stratum", ((_place("at") + F.col("ahead") + unit(F.lit(seed), F.col("stratum"))) / F.col("of")).alias("frac"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, narrow ones, with ``place``: their number from 0 in ``order``, a total one."""
    ordered = rows.repartitionByRange(fan_out(rows.sparkSession), *order).sortWithinPartitions(*order)
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "shard-order")
    per = ordered.groupBy(_part("_at").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # A row for each partition.
    starts = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    starts = written(starts, "shard-starts")
    return ordered.withColumn("_part", _part("_at")).join(broadcast_if_small(starts), "_part").withColumn("place", F.col("_start") + _place("_at")).drop("_part", "_at", "_start")


class Shards:
    """Shard files: Parquet below ``path``, a folder for each shard; columns doc, stratum, frac."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, shards: int, rows: int):
        self.spark, self.path, self.schema, self.shards, self.rows = spark, path, schema, shards, rows

    def files(self) -> DataFrame:
        """doc, stratum, frac, shard as the files have them."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def slots(self, *columns: F.Column) -> DataFrame:
        """shard, slot and the given (narrow) columns of the files, slots from 0 in order of frac."""
        names = [f"_c{k}_{uuid.uuid4().hex}" for k in range(len(columns))]
        rows = self.files().select("shard", "frac", "stratum", *(c.alias(n) for c, n in zip(columns, names, strict=True)))
        start = F.expr(f"shard * {self.rows}L div {self.shards}")
        return numbered(rows, "shard", "frac", "stratum").select("shard", (F.col("place") - start).alias("slot"), *names)


def shard(docs: DataFrame, shards: int = SHARDS, by: str = "source", seed: int = SEED, path: str | None = None) -> Shards:
    """Write all rows of ``docs`` to ``shards`` shards below ``path`` (default: the shared folder)."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    rows = shuffled(docs, by, seed)
    placed = ranked(rows, seed)
    n = rows.count()
    first = sorted({k * n // shards for k in range(1, shards) if k * n // shards < n})
    cuts = numbered(placed.select("frac", "stratum"), "frac", "stratum").filter(F.col("place").isin(first)).orderBy("place").collect() if first else []  # a row for each shard
    at = {r.place: (r.frac, r.stratum) for r in cuts}
    number = F.lit(0)
    for k in range(1, shards):
        if (begin := k * n // shards) < n:
            frac, stratum = at[begin]
            number = number + F.when((F.col("frac") > frac) | ((F.col("frac") == frac) & (F.col("stratum") >= stratum)), 1).otherwise(0)
    out = placed.withColumn("shard", number.cast("int"))
    out.sortWithinPartitions("shard", "frac", "stratum").write.partitionBy("shard").parquet(path, compression="zstd")
    discard(rows)
    return Shards(spark, path, out.schema, shards, n)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    names = ["doc_id", "size", "text_crc32"]
    read = shard(table(spark, sf_dir, "documents")).slots(F.col("doc.doc_id"), F.octet_length(text).cast("long") + 8, F.crc32(text.cast("binary")))
    read = read.toDF("shard", "slot", *names)
    return read.select(*names, F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
