"""Chat formatting: layouts are told apart by a fingerprint of their nested field paths.

A mapping says, for a set of field paths, where the turns of a conversation stand. Its fingerprint is
a hash of those paths. What a table's schema, or each JSON record, has of a mapping's paths is hashed in
the same way; the mapping with the most paths whose fingerprint this equals brings it to canonical turns
(role, text). Formatted, a turn is
``<turn>role``, a line break, the text, ``</turn>`` and a line break. Inside roles and texts a
backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in a role a line break becomes ``\\n``), so no
marker can occur in them and reading back is exact. The loss mask names, for each assistant turn, the
span of its escaped text. Only DataFrame functions run here.

Defined results: null texts and roles count as empty; rows of a conversation go by turn, then role,
then text, null turns first; repeated rows are turns of their own; a record of an unknown layout has
layout null and no turns; an empty table gives an empty table; columns beyond a mapping's are ignored,
as are a record's further keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table, written

OPEN, CLOSE = "<turn>", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns. ``rows``: one turn a row, with the columns conversation, order, role, text.
    ``fixed``: (role, path) for each turn, empty ones left out. ``listed``: an array path with role and text fields."""

    name: str
    rows: tuple[str, str, str, str] | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None

    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.listed:
            return sorted(f"{self.listed[0]}[].{f}" for f in self.listed[1:])
        return sorted(p for _, p in self.fixed)


#: Common layouts of chat data.
MAPPINGS = [
    Mapping("turn rows", rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", listed=("messages", "role", "content")),
    Mapping("conversations", listed=("conversations", "from", "value")),
    Mapping("prompt", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt response", fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question", fixed=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
]
#: Names that layouts give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: Column) -> Column:
    """Of an array of field paths."""
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def by_size() -> list[Mapping]:
    """The mappings, those with the most paths first."""
    return sorted(MAPPINGS, key=lambda m: -len(m.paths()))


def selected(paths: Column, among: list[Mapping]) -> Column:
    """Place in ``among`` of the first mapping whose fingerprint is that of its own paths among ``paths``; null if there is none."""
    at = F.lit(None).cast("int")
    for k, m in reversed(list(enumerate(among))):
        own = F.array(*(F.lit(p) for p in m.paths()))
        at = F.when(fingerprint(F.array_intersect(paths, own)) == fingerprint(own), F.lit(k)).otherwise(at)
    return at


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema, the elements of an array as []."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def mapping_of(spark: SparkSession, schema: T.StructType) -> Mapping | None:
    """The mapping with the most paths whose fingerprint is that of the same-named paths of the schema."""
    among = by_size()
    paths = F.array(*(F.lit(p) for p in schema_paths(schema))).cast("array<string>")
    at = spark.range(1).select(selected(paths, among).alias("at")).head()["at"]
    return None if at is None else among[at]


def record_paths(record: Column) -> Column:
    """Field paths of each JSON record: its keys, and for an array of objects the keys of all its elements as name[].key."""
    fields = F.coalesce(F.from_json(record, "map<string,string>"), F.create_map().cast("map<string,string>"))

    def below(key: Column, value: Column) -> Column:
        first = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("'][0]")))  # null for a string that holds JSON
        elements = F.from_json(F.when(first.isNotNull(), value), "array<string>")
        own = F.array_distinct(F.flatten(F.transform(elements, lambda e: F.coalesce(F.json_object_keys(e), F.array().cast("array<string>")))))
        return F.when(F.coalesce(F.size(own), F.lit(0)) < 1, F.array(key)).otherwise(F.transform(own, lambda k: F.concat(key, F.lit("[]."), k)))

    return F.array_distinct(F.flatten(F.transform(F.map_entries(fields), lambda e: below(e["key"], e["value"]))))


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if role else text


def unescaped(text: Column, role: bool = False) -> Column:
    """Each backslash of an escaped text begins a pair of its own, so pairs are replaced one kind after the other, the backslash last."""
    text = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")) if role else F.replace(text, F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def turns_of_records(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with layout and turns of each JSON record in the string column ``record``."""
    among = [m for m in by_size() if not m.rows]
    chosen = df.withColumn("_paths", record_paths(F.col(record))).withColumn("_mapping", selected(F.col("_paths"), among))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for k, m in enumerate(among):
        if m.listed:
            of, role, text = m.listed
            listed = F.from_json(F.get_json_object(record, f"$.{of}"), f"array<struct<`{role}`:string,`{text}`:string>>")
            own = F.transform(listed, as_turn(role, text))
        else:
            own = F.array(*(F.struct(F.lit(role).alias("role"), F.get_json_object(record, f"$.{path}").alias("text")) for role, path in m.fixed))
            own = F.filter(own, lambda x: F.coalesce(x["text"], F.lit("")) != "")
        this = F.col("_mapping") == k
        layout, turns = F.when(this, F.lit(m.name)).otherwise(layout), F.when(this, own).otherwise(turns)
    return chosen.select(*(c for c in df.columns if c not in ("layout", "turns")), layout.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def as_turn(role: str, text: str):
    return lambda x: F.struct(canonical(x[role]).alias("role"), x[text].alias("text"))


def canonical(role: Column) -> Column:
    for name, of in ROLES.items():
        role = F.when(role == name, F.lit(of)).otherwise(role)
    return role


def turns_of_rows(df: DataFrame) -> DataFrame:
    """conv_id and turns of each conversation in a table with one turn a row; the schema's fingerprint selects the columns."""
    m = mapping_of(df.sparkSession, df.schema)
    if m is None or m.rows is None:
        raise ValueError(f"no mapping has turn rows with the fields {sorted(schema_paths(df.schema))}")
    conversation, order, role, text = (F.col(c) for c in m.rows)
    rows = df.select(conversation.alias("conv_id"), order.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with formatted and loss_mask (turn, start and length inside the turn's formatted text) in place of its turns."""
    parts = df.withColumn("_parts", F.transform(turns, lambda t: F.struct(escaped(t["role"], True).alias("role"), escaped(t["text"]).alias("text"))))
    whole = F.array_join(F.transform("_parts", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")
    spans = F.transform("_parts", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("turn"), (F.length(t["role"]) + len(OPEN) + 1).alias("start"), F.length(t["text"]).alias("length"))))
    return parts.select(*(c for c in df.columns if c not in (turns, "formatted", "loss_mask")), whole.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_mask"))


def read_back(df: DataFrame) -> DataFrame:
    """``df`` with the turns that its formatted text holds, and loss_text, what its loss mask covers."""
    cut = df.withColumn("_cut", F.split("formatted", CLOSE)).withColumn("_cut", F.slice("_cut", 1, F.size("_cut") - 1))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescaped(F.substr(role, F.lit(len(OPEN) + 1)), True).alias("role"), unescaped(F.substr(x, F.length(role) + 2)).alias("text"))

    masked = F.transform("loss_mask", lambda s: unescaped(F.substr(F.get("_cut", s["turn"]), s["start"] + 1, s["length"])))
    return cut.select(*(c for c in df.columns if c not in ("turns", "loss_text")), F.transform("_cut", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(own).alias("text")) for n, role in enumerate(("user", "assistant"))))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(written(format_turns(turns_of_rows(rows)), "chat"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
