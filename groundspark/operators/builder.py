"""A build as a graph of steps that goes on where it is needed.

Each step reads sources and what earlier steps wrote. Its fingerprint is made of its own version and its inputs'
digests (of their contents, not of their files); a step whose fingerprint is as it was when it last ran is left as it is. A step that
ran and wrote what it had written before changes nothing for its followers. Outputs and the record of each step are versions
of tables (``sources.versions``), so that a build that dies goes on with the step it died in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, NumericType, StringType, TimestampType

from ..sources.versions import Change, Versions

RECORD = "_steps"
FLAT = (BinaryType, BooleanType, DateType, NumericType, StringType, TimestampType)
LOG = "step string, place int, status string, rows long"


@dataclass(frozen=True)
class Step:
    name: str
    group: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: str = "1"


def digest(df: DataFrame) -> tuple[str, int]:
    """Of the rows, in any order, and their number. Values are hashed as they are, with what a hash passes over (nulls, where arrays end); only nested ones and arrays with nulls are turned to JSON."""
    parts: list[Column] = []
    for f in sorted(df.schema, key=lambda f: f.name):
        c, kind = F.col(f"`{f.name}`"), f.dataType
        whole = F.to_json(F.struct(c), {"ignoreNullFields": "false"})
        if isinstance(kind, FLAT):
            parts += [c, c.isNull()]
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, FLAT):
            parts += [c, c.isNull(), F.size(c), F.when(F.exists(c, lambda x: x.isNull()), whole)]
        else:
            parts.append(whole)
    total, n = df.agg(F.sum(F.xxhash64(*parts).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}:{total}:{n}".encode()).hexdigest(), n


def checked(steps: list[Step], sources: set[str]) -> None:
    known = set(sources)
    for step in steps:
        if missing := [x for x in step.inputs if x not in known]:
            raise ValueError(f"{step.name} needs {', '.join(missing)} before it")
        if step.name in known:
            raise ValueError(f"{step.name} is there twice")
        known.add(step.name)


class Builder:
    def __init__(self, spark: SparkSession, root: str, steps: list[Step]):
        self.spark, self.steps, self.tables = spark, steps, Versions(spark, root)

    def record(self) -> dict[str, tuple[str, str, int]]:
        """fingerprint, digest, rows of each step that ran: a row a step."""
        if RECORD not in self.tables.manifest()["tables"]:
            return {}
        return {r.step: (r.fingerprint, r.digest, r.rows) for r in self.tables.read(RECORD).collect()}

    def run(self, sources: dict[str, DataFrame], leave_out: tuple[str, ...] = (), plan_only: bool = False) -> DataFrame:
        """step, place, status (done, unchanged, planned, left out), rows of each step. The first that fails ends the build.

        A step is left out with its group, or if one of its inputs was never made.
        """
        checked(self.steps, set(sources))
        known, done = self.record(), []
        digests = {name: digest(df)[0] for name, df in sources.items()}
        for place, step in enumerate(self.steps, 1):
            if step.group in leave_out or any(x not in digests for x in step.inputs):
                if step.name in known:
                    digests[step.name] = known[step.name][1]  # as it was
                done.append((step.name, place, "left out", None))
                continue
            fingerprint = hashlib.sha256("|".join((step.name, step.version, *(digests[x] for x in step.inputs))).encode()).hexdigest()
            if step.name in known and known[step.name][0] == fingerprint:
                digests[step.name] = known[step.name][1]
                done.append((step.name, place, "unchanged", known[step.name][2]))
            elif plan_only:
                digests[step.name] = f"planned:{fingerprint}"
                done.append((step.name, place, "planned", None))
            else:
                made = step.make(*(sources[x] if x in sources else self.tables.read(x) for x in step.inputs))
                self.tables.commit({step.name: Change(made, "replace")})
                digests[step.name], n = digest(self.tables.read(step.name))
                row = self.spark.createDataFrame([(step.name, fingerprint, digests[step.name], n)], "step string, fingerprint string, digest string, rows long")
                self.tables.commit({RECORD: Change(row, "upsert", ("step",))})
                done.append((step.name, place, "done", n))
        return self.spark.createDataFrame(done, LOG)
