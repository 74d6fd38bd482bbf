"""Streams of request rows: windows over event time, sessions, duplicates. Each query drains what is there and returns the table its sink wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import new_folder


def requests_stream(spark: SparkSession, sf_dir: str, late: str = "1 hour") -> DataFrame:
    """The events table as a stream; its times carry no zone, which watermarks need, so they are read as UTC."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", "events.parquet"), sf_dir
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over all that is there and return the result. Append mode writes Parquet; results that only close later need complete mode, kept in memory for small results."""
    spark = stream.sparkSession
    place = new_folder(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{place}/out").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out")

    writer.foreachBatch(write).outputMode("complete").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
