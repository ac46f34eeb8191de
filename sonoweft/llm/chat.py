r"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a JSON object of some layout. Its fingerprint is the SHA-256 of its
nested field paths (names and nesting, without types); a mapping is declared for
each layout by an example of its schema and by where the turns are. Records with
unknown paths keep ``layout`` null and get no turns.

The template writes a turn as ``### role: text</turn>`` and a line feed. In roles
and texts, ``\`` becomes ``\\``, ``#`` becomes ``\#`` and ``</turn>`` becomes
``<\/turn>`` (in roles also ``:`` becomes ``\:``), so neither a header nor an end
mark can occur inside them; removing one backslash before any character undoes it.

Only DataFrame functions run here. The paths are taken from a skeleton of the
record, in which string values are blank, so texts of any length go through.

Defined results: a null text or role is an empty one; turns with equal numbers
are ordered by role and text; repeated rows are repeated turns; rows with a null
conv_id are one conversation; a conversation without assistant turns has an
empty loss mask; null or malformed JSON has layout null; an empty table gives no
rows. Extra columns are ignored. A conversation is one record, so it must fit in
a task's memory and below Spark's 2 GB for a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: an example record, and the turns as a SQL expression over the JSON text ``r``."""

    name: str
    example: str
    turns: str


def _json(schema: str) -> str:
    """The record ``r`` as a struct, with strings of any length."""
    return f"from_json(r, '{schema}', map('maxStringLen', '2147483647'))"


#: Layouts by example: the fingerprint is taken from the example record.
MAPPINGS = (
    Mapping("messages", '{"messages":[{"role":"","content":""}]}', f"transform({_json('struct<messages:array<struct<role:string,content:string>>>')}.messages, x -> struct(x.role AS role, x.content AS text))"),
    Mapping("conversations", '{"conversations":[{"from":"","value":""}]}', f"transform({_json('struct<conversations:array<struct<`from`:string,value:string>>>')}.conversations, x -> struct(x.`from` AS role, x.value AS text))"),
    Mapping("dialog", '{"dialog":{"turns":[{"speaker":{"name":""},"utterance":""}]}}', f"transform({_json('struct<dialog:struct<turns:array<struct<speaker:struct<name:string>,utterance:string>>>>')}.dialog.turns, x -> struct(x.speaker.name AS role, x.utterance AS text))"),
    Mapping("instruction", '{"instruction":"","input":"","output":""}', f"transform(array({_json('struct<instruction:string,input:string,output:string>')}), x -> array(struct('system' AS role, x.instruction AS text), struct('user' AS role, x.input AS text), struct('assistant' AS role, x.output AS text)))[0]"),
    Mapping("prompt", '{"prompt":"","completion":""}', f"transform(array({_json('struct<prompt:string,completion:string>')}), x -> array(struct('user' AS role, x.prompt AS text), struct('assistant' AS role, x.completion AS text)))[0]"),
)

#: A JSON string, matched without backtracking. With a colon after it, it is a name.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def skeleton(record: Column) -> Column:
    """The record with blank string values: names, nesting and the other values stay."""
    bare = F.regexp_replace(record, rf"(?s)({_STRING}\s*+:)|{_STRING}", "$1")
    return F.regexp_replace(bare, r"(?<=[:\[,])\s*+(?=[,}\]])", '""')


def fingerprint(record: Column) -> Column:
    """Of a column of JSON text; null where it isn't JSON."""
    schema = F.schema_of_variant(F.try_parse_json(skeleton(record)))
    return F.sha2(F.regexp_replace(schema, r"(: |ARRAY<)(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL[(][0-9,]+[)])", "$1"), 256)


def known_layouts(spark: SparkSession, mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """The mappings by fingerprint."""
    row = spark.range(1).select(*[fingerprint(F.lit(m.example)).alias(m.name) for m in mappings]).first()
    return {row[m.name]: m for m in mappings}


def canonical(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds fingerprint, layout and turns (array of role and text) to JSON records."""
    known = known_layouts(records.sparkSession, mappings)
    out = records.withColumn("fingerprint", fingerprint(F.col(column)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for key, m in known.items():
        here = F.col("fingerprint") == key
        layout = F.when(here, m.name).otherwise(layout)
        turns = F.when(here, F.expr(m.turns.replace("(r, ", f"({column}, ")).cast(TURNS)).otherwise(turns)
    blank = lambda c: F.coalesce(c, F.lit(""))
    layout = F.when(turns.isNotNull(), layout)  # a record whose values can't be read has none
    return out.withColumn("layout", layout).withColumn("turns", F.transform(turns, lambda x: F.struct(blank(x["role"]).alias("role"), blank(x["text"]).alias("text"))))


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(records: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss`` (code-point spans of assistant texts) from ``turns``."""
    head = lambda x: F.concat(F.lit("### "), escape(x["role"], True), F.lit(": "))
    parts = F.transform(
        "turns", lambda x: F.struct(head(x).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("learn"))
    )
    end = F.length(F.lit("</turn>\n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["head"])
        last = first + F.length(x["body"])
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct((last + end).alias("at"), F.when(x["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return records.withColumn("_parts", parts).withColumns(
        {
            "formatted": F.array_join(F.transform("_parts", lambda x: F.concat(x["head"], x["body"], F.lit("</turn>\n"))), ""),
            "loss": F.aggregate("_parts", start, step)["spans"],
        }
    ).drop("_parts")


def parsed(text: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.split(text, "</turn>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*+)$"
    return F.transform(pieces, lambda x: F.struct(unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text")))


def masked(text: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as JSON records, each in the layout that its source would use.

    A user and an assistant turn make a prompt record, a system turn before them
    an instruction record; longer ones are lists of messages in three layouts.
    """
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", blank("role"), blank("text"))
    t = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    are = lambda *names: F.col("t.role") == F.array(*map(F.lit, names))
    text = lambda i: F.get("t", F.lit(i))["text"]
    messages = lambda *names: F.transform("t", lambda x: F.struct(x["role"].alias(names[0]), x["text"].alias(names[1])))
    third = F.coalesce(F.pmod("conv_id", F.lit(3)), F.lit(0))
    speakers = F.transform("t", lambda x: F.struct(F.struct(x["role"].alias("name")).alias("speaker"), x["text"].alias("utterance")))
    record = (
        F.when(are("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(are("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(third == 0, F.to_json(F.struct(messages("role", "content").alias("messages"))))
        .when(third == 1, F.to_json(F.struct(messages("from", "value").alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.struct(speakers.alias("turns")).alias("dialog"))))
    )
    return t.select("conv_id", record.alias("record"))


def digests(chats: DataFrame) -> DataFrame:
    """Reads formatted chats back: conv_id and the digests of turns and of the text under the mask."""
    back = chats.withColumn("_turns", parsed(F.col("formatted"))).withColumn("_loss", masked(F.col("formatted"), F.col("loss")))
    line = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
