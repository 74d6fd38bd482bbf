"""Which phrases of a dictionary stand in texts: an Aho-Corasick automaton over words.

A dictionary of up to SHARD_PHRASES phrases and SHARD_BYTES bytes makes one automaton, which every task builds once
and reads its texts through; nothing is shuffled. A larger one is dealt to shards by the phrases' first word, and
a first word with more phrases than a shard holds to several. A text goes to the shards of which it has a first
word, in chunks; a task builds the automaton of its shard.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import broadcast_if_small, spread

SHARD_PHRASES = 50_000
SHARD_BYTES = 8 << 20
#: Texts that meet a shard at once.
CHUNK_TEXTS = 100_000


class Automaton:
    """States are prefixes of phrases, as numbers; edges are words."""

    def __init__(self, phrases: Iterable[str]):
        self.words: dict[str, int] = {}
        self.edges: list[dict[int, int]] = [{}]
        self.ends: list[str | None] = [None]
        for phrase in phrases:
            state = 0
            for w in phrase.split(" "):
                word = self.words.setdefault(w, len(self.words))
                nxt = self.edges[state].get(word)
                if nxt is None:
                    nxt = self.edges[state][word] = len(self.edges)
                    self.edges.append({})
                    self.ends.append(None)
                state = nxt
            self.ends[state] = phrase
        #: The longest other state that a state ends with, and the next on that way at which a phrase ends.
        self.fall, self.ended = [0] * len(self.edges), [0] * len(self.edges)
        waiting = deque(self.edges[0].values())
        while waiting:
            state = waiting.popleft()
            for word, nxt in self.edges[state].items():
                back = self.fall[state]
                while back and word not in self.edges[back]:
                    back = self.fall[back]
                self.fall[nxt] = back = self.edges[back].get(word, 0)
                self.ended[nxt] = back if self.ends[back] is not None else self.ended[back]
                waiting.append(nxt)

    def find(self, text: str) -> list[tuple[str, int]]:
        """Each phrase in a normalised text and the number of its first word there, from 0."""
        out, state = [], 0
        for at, w in enumerate(text.split(" ")):
            word = self.words.get(w)
            if word is None:
                state = 0
                continue
            while state and word not in self.edges[state]:
                state = self.fall[state]
            state = self.edges[state].get(word, 0)
            end = state if self.ends[state] is not None else self.ended[state]
            while end:
                phrase = self.ends[end]
                out.append((phrase, at - phrase.count(" ")))
                end = self.ended[end]
        return out


def _found(ids: list, texts: list[str], automaton: Automaton, key: pa.DataType) -> dict[str, pa.Array]:
    rows = [(k, phrase, at) for k, t in zip(ids, texts, strict=True) if t for phrase, at in automaton.find(t)]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return {"key": pa.array(columns[0], key), "phrase": pa.array(columns[1], pa.string()), "place": pa.array(columns[2], pa.int32())}


def phrase_hits(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """key, phrase, place (its first word's number, from 0) of each occurrence, as whole words, of ``phrases`` (phrase) in the column ``text``.

    Both sides are normalised (single spaces between words). Keys are distinct. Empty phrases stand nowhere.
    """
    wanted = phrases.select("phrase").filter("phrase <> ''").distinct()
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, phrase string, place int"
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    named = lambda df: df.withColumnRenamed("key", key)

    if n <= SHARD_PHRASES and size <= SHARD_BYTES:
        small = [r.phrase for r in wanted.collect()]  # bounded by the condition

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(small)
            for batch in batches:
                yield pa.RecordBatch.from_pydict(_found(batch.column("key").to_pylist(), batch.column("text").to_pylist(), automaton, batch.schema.field("key").type))

        return named(rows.mapInArrow(run, schema))

    shards = -(-n // SHARD_PHRASES) + size // SHARD_BYTES
    first = F.get(F.split("phrase", " "), F.lit(0))
    firsts = wanted.groupBy(first.alias("first")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / SHARD_PHRASES, F.sum(F.octet_length("phrase")) / SHARD_BYTES)).cast("int").alias("subs"))
    shard = F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int")
    firsts = firsts.select("first", "subs", F.when(F.col("subs") > 1, F.concat_ws(":", F.lit("own"), "first")).otherwise(shard.cast("string")).alias("shard"))
    chunks = max(1, -(-texts.count() // CHUNK_TEXTS))
    known = broadcast_if_small(firsts)
    dealt = wanted.withColumn("first", first).join(known, "first").select("phrase", F.col("shard").alias("shard"), F.pmod(F.xxhash64("phrase"), "subs").cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    met = spread(rows).select("key", F.explode(F.array_distinct(F.split("text", " "))).alias("first")).join(known, "first")
    met = met.select("key", "shard", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")).distinct().join(rows, "key").withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        automaton = Automaton(right.column("phrase").to_pylist() if left.num_rows else [])
        return pa.table(_found(left.column("key").to_pylist(), left.column("text").to_pylist(), automaton, left.schema.field("key").type))

    group = ["shard", "sub", "chunk"]
    return named(met.groupBy(*group).cogroup(dealt.groupBy(*group)).applyInArrow(meet, schema))
