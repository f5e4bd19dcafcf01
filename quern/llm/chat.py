"""Chat formatting by schema fingerprint.

The shape of a record, its nested field paths without scalar types, is hashed;
the hash selects a declarative mapping from that layout to canonical turns. A
table's shape comes from its schema, a JSON record's from the record itself,
so one input may hold many layouts. Turns are then rendered with control
strings around them, control strings inside texts are escaped reversibly, and
a loss mask (byte spans of assistant texts) is made alongside. Built-in
expressions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import common as C

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Where a control string of this or another common template starts; a backslash goes behind that character.
_CONTROL = r"<(?=\|)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)"
# Names that other layouts give to the roles.
ROLES = {
    "human": "user",
    "prompter": "user",
    "gpt": "assistant",
    "chatgpt": "assistant",
    "bot": "assistant",
    "model": "assistant",
}
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fingerprint(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """``shape``: known fields in order of name, scalars as ``*``. ``turns``: from a getter of paths to turns."""

    name: str
    shape: str
    turns: Callable[[Callable[[str, str], Column]], Column]


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(field: str, role: str, text: str) -> Callable:
    kind = f"array<struct<{role}:string,{text}:string>>"

    def named(r: Column) -> Column:
        out = r
        for k, v in ROLES.items():
            out = F.when(F.lower(r) == k, v).otherwise(out)
        return out

    return lambda get: F.transform(get(field, kind), lambda x: _turn(named(x[role]), x[text]))


def _pair(first: str, second: str) -> Callable:
    return lambda get: F.array(_turn("user", get(first, "string")), _turn("assistant", get(second, "string")))


def _instruction(get: Callable) -> Column:
    more = get("input", "string")
    ask = F.when(F.coalesce(more, F.lit("")) == "", get("instruction", "string")).otherwise(F.concat_ws("\n\n", get("instruction", "string"), more))
    return F.array(_turn("user", ask), _turn("assistant", get("output", "string")))


LAYOUTS = (
    Layout("turn rows", "role: *, text: *", lambda get: F.array(_turn(get("role", "string"), get("text", "string")))),
    Layout("messages", "messages: ARRAY<OBJECT<content: *,role: *>>", _listed("messages", "role", "content")),
    Layout("conversations", "conversations: ARRAY<OBJECT<from: *,value: *>>", _listed("conversations", "from", "value")),
    Layout("prompt and response", "prompt: *, response: *", _pair("prompt", "response")),
    Layout("prompt and completion", "completion: *, prompt: *", _pair("prompt", "completion")),
    Layout("question and answer", "answer: *, question: *", _pair("question", "answer")),
    Layout("instruction", "input: *, instruction: *, output: *", _instruction),
    Layout("instruction without input", "instruction: *, output: *", _pair("instruction", "output")),
    Layout("prompted messages", "messages: ARRAY<OBJECT<content: *,role: *>>, prompt: *", lambda get: F.concat(F.array(_turn("system", get("prompt", "string"))), _listed("messages", "role", "content")(get))),
    Layout("dialog", "dialog: ARRAY<*>", lambda get: F.transform(get("dialog", "array<string>"), lambda x, i: _turn(F.when(i % 2 == 0, "user").otherwise("assistant"), x))),
)
_BY_PRINT = {fingerprint(x.shape): x for x in LAYOUTS}
_FIELDS = ("answer", "completion", "conversations", "dialog", "input", "instruction", "messages", "output", "prompt", "question", "response", "role", "text")
_INNER = ("content", "from", "role", "value")


def table_shape(schema: T.StructType) -> str:
    """The shape of a table's known fields; other columns don't count."""

    def kind(t: T.DataType) -> str:
        if isinstance(t, T.ArrayType):
            return f"ARRAY<{kind(t.elementType)}>"
        if isinstance(t, T.StructType):
            return "OBJECT<" + ",".join(f"{f.name}: {kind(f.dataType)}" for f in sorted(t, key=lambda f: f.name) if f.name in _INNER) + ">"
        return "*"

    return ", ".join(f"{n}: {kind(schema[n].dataType)}" for n in _FIELDS if n in schema.names)


def record_shape(v: Column) -> Column:
    """The shape of a variant's known fields, in the same form."""
    scalar = r"(: |ARRAY<|^)(?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|BINARY|UUID|VARIANT|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\))(?=[,>]|$)"
    unknown = rf"(?<=[<,])(?!(?:{'|'.join(_INNER)}): )[^<>:,]+: \*(?:,|(?=>))"

    def one(name: str) -> Column:
        inner = F.regexp_replace(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), scalar, "$1*")
        inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, ", ", ","), unknown, ""), ",>", ">")
        return F.when(inner.isNotNull(), F.concat(F.lit(f"{name}: "), inner))

    return F.array_join(F.array_compact(F.array(*[one(n) for n in _FIELDS])), ", ")


def from_table(df: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, turns)``: a table of one layout, told by the fingerprint of its schema."""
    layout = _BY_PRINT.get(fingerprint(table_shape(df.schema)))
    if layout is None:
        raise ValueError(f"no mapping for the layout {table_shape(df.schema)!r}")
    return df.select(*key, layout.turns(lambda p, kind: F.col(p).cast(kind)).alias("turns"))


def from_records(df: DataFrame, key: list[str], record: str = "record") -> DataFrame:
    """``(*key, layout, turns)``: JSON records of any layouts, each told by its own fingerprint.

    A record that isn't JSON or has an unknown layout keeps its row, with null
    layout and turns.
    """
    v = F.try_parse_json(F.col(record))
    found = df.select(*key, v.alias("v")).withColumn("print", F.sha2(record_shape(F.col("v")), 256))
    get = lambda p, kind: F.try_variant_get(F.col("v"), f"$.{p}", kind)
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for mark, layout in _BY_PRINT.items():
        turns = F.when(F.col("print") == mark, layout.turns(get).cast(TURNS)).otherwise(turns)
        name = F.when(F.col("print") == mark, layout.name).otherwise(name)
    return found.select(*key, name.alias("layout"), turns.alias("turns"))


def render(turns: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """``(conv_id, formatted, loss_mask)`` from ``turns(conv_id, *order, turns)``.

    Rows of a conversation follow each other by ``order``, then by role and
    text. loss_mask holds (start, length) in bytes of each assistant text
    within formatted.
    """
    one = turns.select(F.col(conv).alias("conv_id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.posexplode("turns").alias("place", "t"))
    role, text = F.coalesce(F.col("t.role"), F.lit("")), F.coalesce(F.col("t.text"), F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    rows = one.select("conv_id", *[f"o{i}" for i in range(len(order))], "place", head.alias("head"), escape(text).alias("body"), (role == "assistant").alias("loss"))
    by = Window.partitionBy("conv_id").orderBy(*[f"o{i}" for i in range(len(order))], "place", "head", "body")
    whole = F.octet_length("head") + F.octet_length("body") + len(END)
    before = F.coalesce(F.sum(whole).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select(
        "conv_id", F.row_number().over(by).alias("n"), F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("loss"), F.struct((before + F.octet_length("head")).cast("int").alias("start"), F.octet_length("body").alias("length"))).alias("span"),
    )
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("x"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("x", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("x", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns that a formatted conversation holds, as ``array<struct<role, text>>``."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x, i: i > 0)

    def turn(x: Column) -> Column:
        role_text = F.split(x, r"<\|text\|>|<\|end\|>")
        return C.let(role_text, lambda p: F.struct(unescape(F.get(p, 0)).alias("role"), unescape(F.get(p, 1)).alias("text")))

    return F.transform(parts, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return C.let(formatted.cast("binary"), lambda raw: F.array_join(F.transform(mask, lambda s: unescape(F.substring(raw, s["start"] + 1, s["length"]).cast("string"))), ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every conversation, and conversation -1, formatted and read back.

    Null roles and texts count as empty; rows with equal turn follow by role
    and text; rows with a null conversation are one conversation of that key.
    """
    table = from_table(C.table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    own = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
    extra = from_records(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(own).alias("record")), ["conv_id", "turn"])
    got = render(table.unionByName(extra.select("conv_id", "turn", "turns"))).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_mask")))
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for mark in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


#: The whole of op5 for DuckDB: digests of turns and of assistant texts need no formatting, only its length does.
SQL = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, r, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped_sql("r")}) + length({_escaped_sql("t")}) + {len(TURN + TEXT + END)}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
