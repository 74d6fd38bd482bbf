"""What several operators share: the shared folder, written stages, Arrow buffers, plain hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Local runs may go without it and get one of their own; a cluster may not."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.groundspark.shared.dir", None)
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="groundspark-")
        spark.conf.set("spark.groundspark.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/groundspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan_out(spark: SparkSession) -> int:
    """The session's shuffle partition count, at least 1."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes of rows that a Python worker is handed at once.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES (never raise them): a batch is held by the JVM and by Python, and long texts make large ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not re.fullmatch(r"[0-9]+b?", now) or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and where each row starts (rows + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every piece, piece after piece."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's published constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def in_slices(batches: Iterable[pa.RecordBatch], by: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the strings in column ``by`` hold about ``most`` bytes (one long row may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(by))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def one_of_each(docs: DataFrame, kept: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are a row of ``kept`` (the same keys in order, and n, how many rows have them); one of those that have them all in common."""
    names = [f"_{k}_{uuid.uuid4().hex}" for k in range(len(keys))]
    keyed = docs.withColumns(dict(zip(names, keys, strict=True)))
    theirs = [f"{x}_kept" for x in names]
    kept = kept.toDF(*theirs, "n")
    same = reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, theirs, strict=True)))
    found = keyed.join(kept.filter("n = 1"), same, "left_semi")
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():  # a task passes on one row of each, however many there are
        found = found.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(names))
    return found.drop(*names)


#: Words of a lower-cased text: digits, a-z and everything beyond ASCII. Text is cut at the rest.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in lower case; null counts as empty.

    ``lower`` changes letters beyond ASCII too. Word borders are those of lower-casing A-Z alone,
    since no upper-case letter lies outside a word in either.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def rolling_hashes(words: str, k: int) -> Column:
    """A hash of every k consecutive words in the array column ``words``; its last k - 1 entries reach past the end."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(F.col(words), i + j) for j in range(1, k))))


def broadcast_if_small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows measure at most ``most`` bytes (as JSON); else joined as Spark sees fit."""
    measured = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()[0]
    return F.broadcast(df) if (measured or 0) <= most else df
