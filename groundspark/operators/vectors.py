"""An inverted-file index of unit vectors: cells around centroids, searched through bounds or through the nearest cells.

Centroids come from k-means over a bounded sample (SAMPLE vectors, whatever the table); every vector is
then put into the cell of its nearest centroid, and each cell keeps the largest angle between its
centroid and a vector in it. A cell may hold any share of the vectors: its rows are dealt to parts of
about PART_VECTORS.

A query is as near to a vector of a cell as the angle to the centroid less the cell's angle allows. In
``exact`` mode a query meets its nearest cells first; of the others, those go whose bound doesn't reach the k-th
best score so found. Otherwise a query meets its ``probes`` nearest cells only; ``probes_for`` finds how many
reach a wanted recall on the data at hand, ``recall`` measures it. Either way scores are computed from the
vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import materialised
from ..sources.tables import broadcast_if_small, numbered, spread

#: Vectors that centroids are fitted on, at most.
SAMPLE = 20_000
ROUNDS = 8
PART_VECTORS = 4096
#: Queries that meet a part at once, about.
CHUNK_QUERIES = 8192
#: Rows of query and cell that a task makes at once, about.
CELL_ROWS = 1 << 15
#: Cells that a query meets before bounds are looked at.
FIRST_CELLS = 2
PROBES = 4
#: Queries that the number of probes is chosen on, and the share of right results that they are to find.
TUNE_QUERIES = 256
WANTED = 0.95
#: Scores are rounded to so many digits, so that equal ones are ties.
DIGITS = 6
SEED = 42


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, begun with rows chosen far from those chosen before."""
    rng = np.random.default_rng(SEED)
    sample = unit(np.asarray(sample, np.float64))
    chosen = [int(rng.integers(len(sample)))]
    near = sample @ sample[chosen[0]]
    while len(chosen) < min(cells, len(sample)):
        weight = np.maximum(1 - near, 0)
        if weight.sum() <= 1e-12:
            break
        chosen.append(int(rng.choice(len(sample), p=weight / weight.sum())))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    now = sample[chosen]
    for _ in range(rounds):
        own = np.argmax(sample @ now.T, axis=1)
        total = np.zeros_like(now)
        np.add.at(total, own, sample)
        now = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-12, unit(total), now)
    return now


class VectorIndex:
    """Where the index lies: centroids (in memory: at most as many as the sample has rows), cells, vectors."""

    def __init__(self, spark: SparkSession, path: str, middle: np.ndarray, angles: np.ndarray, parts: np.ndarray):
        self.spark, self.path, self.middle, self.angles, self.parts = spark, path, middle, angles, parts

    def rows(self) -> DataFrame:
        """cell, part, id, v, label."""
        return self.spark.read.schema("cell int, part int, id long, v array<double>, label string").parquet(f"{self.path}/rows")


def build(vectors: DataFrame, key: str, path: str, cells: int | None = None, vector: str = "embedding", label: str | None = None) -> VectorIndex:
    """Write the index of unit vectors below ``path``. ``cells``: by default the root of the number of vectors, at most 4096. Rows without a key or a vector can't be found."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label")).filter("id IS NOT NULL AND v IS NOT NULL")
    n = own.count()
    cells = cells or max(1, min(4096, round(n**0.5)))
    # The rows of least hash: a sample that doesn't depend on partitions.
    sample = [r.v for r in own.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE).select("v").collect()]
    middle = centroids(np.array(sample), cells) if sample else np.zeros((1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v")
            v = flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = v @ middle.T
            cell = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), *(batch.column(c) for c in ("id", "v", "label"))], ["cell", "angle", "id", "v", "label"])

    placed = materialised(spread(own).mapInArrow(run, "cell int, angle double, id long, v array<double>, label string"))
    per = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"))
    found = {r.cell: r for r in per.collect()}  # a row for each cell
    angles = np.array([found[c].angle if c in found else -1.0 for c in range(len(middle))])  # -1: an empty cell
    parts = np.array([-(-found[c].n // PART_VECTORS) if c in found else 0 for c in range(len(middle))])
    sizes = F.broadcast(per.select("cell", F.ceil(F.col("n") / PART_VECTORS).alias("parts")))  # a row for each cell
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed.join(sizes, "cell").select("cell", part.alias("part"), "id", "v", "label").repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/rows")
    return VectorIndex(spark, path, middle, angles, parts)


def _best(met: DataFrame, index: VectorIndex, filtered: bool, k: int) -> DataFrame:
    """query_id, id, score: of each query the best k of each part of the cells it meets; ``met``: query_id, v, label, cell."""
    parts = F.broadcast(index.spark.createDataFrame([(c, n) for c, n in enumerate(index.parts.tolist()) if n], "cell int, parts int"))  # a row for each cell
    chunks = max(1, -(-met.select("query_id").distinct().count() // CHUNK_QUERIES))
    asked = met.join(parts, "cell").select("query_id", "v", "label", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"))
    rows = index.rows().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    group = ["cell", "part", "chunk"]

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, found, scores = [], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            own, ids, labels = matrix(left), left.column("id").to_numpy(), np.array(left.column("label").to_pylist(), object)
            for at in range(0, right.num_rows, 1024):
                some = right.slice(at, 1024)
                score = np.round(matrix(some) @ own.T, DIGITS)
                if filtered:
                    asks = np.array(some.column("label").to_pylist(), object)
                    score[(asks != None)[:, None] & (asks[:, None] != labels[None, :])] = -np.inf  # noqa: E711
                for q, row in zip(some.column("query_id").to_pylist(), score, strict=True):
                    best = np.lexsort((ids, -row))[:k]
                    best = best[row[best] > -np.inf]
                    names += [q] * len(best)
                    found.append(ids[best])
                    scores.append(row[best])
        return pa.table({"query_id": pa.array(names, pa.string()), "id": pa.array(np.concatenate(found), pa.int64()), "score": pa.array(np.concatenate(scores), pa.float64())})

    return rows.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(run, "query_id string, id long, score double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    return numbered(scored, ["query_id"], [F.desc("score"), F.asc("id")], "rank").filter(F.col("rank") <= k)


def _asked(queries: DataFrame, filtered: bool) -> DataFrame:
    return queries.select(F.col("query_id").cast("string"), F.col("vector").cast("array<double>").alias("v"), (F.col("label").cast("string") if filtered else F.lit(None).cast("string")).alias("label")).filter("v IS NOT NULL")


def cells_of(index: VectorIndex, asked: DataFrame, most: int | None = None) -> DataFrame:
    """query_id, v, label, cell, place (from 0, by nearness), bound (of the scores in the cell): the ``most`` nearest cells of each query, or all."""
    middle, angles = index.middle, index.angles
    full = np.flatnonzero(angles >= 0)
    step = max(1, CELL_ROWS // max(1, len(full)))  # each row has the query's vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if len(full) else 0, step):
                batch = whole.slice(at, step)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.arccos(np.clip(unit(v) @ middle[full].T, -1, 1))
                bound = np.cos(np.maximum(near - angles[full] - 1e-9, 0)) * np.linalg.norm(v, axis=1, keepdims=True)
                place = np.argsort(np.argsort(near, axis=1, kind="stable"), axis=1)
                rows, cells = np.nonzero(place < (len(full) if most is None else most))
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("query_id", "v", "label")), pa.array(full[cells], pa.int32()), pa.array(place[rows, cells], pa.int32()), pa.array(bound[rows, cells])], ["query_id", "v", "label", "cell", "place", "bound"])

    return asked.mapInArrow(run, "query_id string, v array<double>, label string, cell int, place int, bound double")


def search(index: VectorIndex, queries: DataFrame, k: int, exact: bool = True, probes: int = PROBES, filtered: bool = False) -> DataFrame:
    """query_id, id, score, rank: the best ``k`` vectors of each of (query_id, vector, and with ``filtered`` label: null for any), ties by id."""
    asked = _asked(queries, filtered)
    if not exact:
        return _top(_best(cells_of(index, asked, probes).drop("place", "bound"), index, filtered, k), k)
    cells = cells_of(index, asked)
    found = materialised(_top(_best(cells.filter(F.col("place") < FIRST_CELLS).drop("place", "bound"), index, filtered, k), k).drop("rank"))
    least = broadcast_if_small(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")))
    rest = cells.filter(F.col("place") >= FIRST_CELLS).join(least, "query_id", "left").filter(F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("least") - 10.0**-DIGITS))
    return _top(found.unionByName(_best(rest.select("query_id", "v", "label", "cell"), index, filtered, k)), k)


def probes_for(index: VectorIndex, queries: DataFrame, k: int, wanted: float = WANTED) -> int:
    """How many nearest cells hold ``wanted`` of the right results, measured in exact mode on TUNE_QUERIES of the queries, those of least hash."""
    some = queries.orderBy(F.xxhash64(F.lit(SEED), "query_id"), "query_id").limit(TUNE_QUERIES)
    right = search(index, some, k).join(index.rows().select("id", "cell"), "id")
    places = right.join(cells_of(index, _asked(some, False)).select("query_id", "cell", "place"), ["query_id", "cell"])
    found = places.agg(F.expr(f"percentile_disc({wanted}) WITHIN GROUP (ORDER BY place)")).first()[0]
    return 1 + int(found or 0)


def recall(found: DataFrame, right: DataFrame) -> DataFrame:
    """queries, wanted, recall: what share of the rows (query_id, id) of ``right`` ``found`` has."""
    both = right.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
