"""Chat formatting with layouts chosen by schema fingerprints.

A record is a variant value: a message list, a prompt with a response, an
instruction, or a single turn.  Its nested field paths (names and nesting,
without scalar types) are hashed; the hash selects a declarative mapping that
says where roles and texts lie, and the mapping yields canonical turns.
Everything is DataFrame expressions.

The template writes a turn as ``<turn role="ROLE">TEXT</turn>`` and a line
feed.  Inside roles and texts, backslash and both angle brackets are written as
``\\0``, ``\\1`` and ``\\2``, so a marker can never occur in them and reading
back is exact.  The loss mask holds one span of characters for each assistant
turn: its escaped text, without the markers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Written form of the characters that could make up a marker.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), (">", "\\2"))
OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
LEARNED_ROLE = "assistant"

#: Role names of message lists that call the same roles otherwise.
ROLE_ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a record of one layout keeps its turns.

    Either ``fields``, pairs of role and top-level field in speaking order
    (``optional`` ones may be missing), or ``items``, the field of a list
    ("" for the record itself) whose members hold ``role`` and ``text``.
    ``parts`` tells that a text is a list of objects with a ``text`` field.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    parts: bool = False
    aliases: dict[str, str] = field(default_factory=dict, hash=False)

    def samples(self) -> list[str]:
        """A JSON record of each set of fields that the layout may have."""
        if self.items is None:
            sets = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
            return [json.dumps({f: "" for _, f in self.fields if f not in gone}) for gone in sets]
        body = [{"type": "", "text": ""}] if self.parts else ""
        item = {self.role: "", self.text: body}
        return [json.dumps({self.items: [item]} if self.items else item)]

    def turns(self, v: Column) -> Column:
        if self.items is None:
            pairs = [F.struct(F.lit(r).alias("role"), F.try_variant_get(v, f"$.{f}", "string").alias("text"))
                     for r, f in self.fields]
            # an optional field that is missing or empty makes no turn
            keep = F.array(*pairs)
            gone = [r for r, f in self.fields if f in self.optional]
            return F.filter(keep, lambda x: ~(x["role"].isin(gone) & (F.coalesce(x["text"], F.lit("")) == ""))
                            ) if gone else keep
        kind = "array<struct<type:string,text:string>>" if self.parts else "string"
        item = f"struct<`{self.role}`:string,`{self.text}`:{kind}>"
        if self.items:
            found = F.try_variant_get(v, f"$.{self.items}", f"array<{item}>")
        else:
            found = F.array(F.try_variant_get(v, "$", item))

        def turn(x):
            role = x[self.role]
            for a, b in self.aliases.items():
                role = F.when(x[self.role] == a, b).otherwise(role)
            text = x[self.text]
            if self.parts:
                text = F.array_join(F.transform(text, lambda p: F.coalesce(p["text"], F.lit(""))), "")
            return F.struct(role.alias("role"), text.alias("text"))

        return F.transform(found, turn)


LAYOUTS = (
    Layout("turn", items="", text="text"),
    Layout("message", items=""),
    Layout("messages", items="messages"),
    Layout("message parts", items="messages", parts=True),
    Layout("conversations", items="conversations", role="from", text="value", aliases=ROLE_ALIASES),
    Layout("prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
           optional=("system",)),
    Layout("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question and answer", fields=(("system", "system"), ("user", "question"), ("assistant", "answer")),
           optional=("system",)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user input", "input"),
                                  ("assistant", "output")), optional=("system", "input")),
)


def field_paths(v: Column) -> Column:
    """Names and nesting of a variant's fields, in name order, without the
    types of scalars (so null, number and text look alike)."""
    return F.regexp_replace(F.schema_of_variant(v), r"(: |^|(?<=ARRAY<))(?!OBJECT|ARRAY)[A-Z]+(\([0-9,]+\))?", "")


def fingerprint(v: Column) -> Column:
    return F.xxhash64(field_paths(v))


def canonical(records: DataFrame, payload: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns`` (array of role and text)
    to rows whose ``payload`` is a variant; they replace columns of these
    names.

    A record whose fingerprint no mapping declares has a null layout and no
    turns, so nothing is guessed and nothing is dropped.  Null payloads too.
    """
    v, fp = F.col(payload), F.col("fingerprint")
    rows = records.withColumn("fingerprint", F.when(v.isNotNull(), fingerprint(v)))
    name, turns = F.lit(None).cast("string"), F.array().cast(_TURNS)
    for layout in reversed(layouts):
        known = [fingerprint(F.parse_json(F.lit(s))) for s in layout.samples()]
        match = fp.isin(*known)
        name = F.when(match, F.lit(layout.name)).otherwise(name)
        turns = F.when(match, merge_inputs(layout.turns(v)).cast(_TURNS)).otherwise(turns)
    return rows.withColumns({"layout": name, "turns": turns})


def merge_inputs(turns: Column) -> Column:
    """The role "user input" is a second user turn."""
    return F.transform(turns, lambda x: F.struct(
        F.when(x["role"] == "user input", F.lit("user")).otherwise(x["role"]).alias("role"), x["text"].alias("text")))


def escape(c: Column) -> Column:
    for raw, written in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(raw))
    return c


def format_turns(rows: DataFrame, id_col: str, order: list[str], turns: str = "turns",
                 learned: str = LEARNED_ROLE) -> DataFrame:
    """One row per ``id_col``: ``formatted`` and ``loss_spans`` (array of
    start and end, characters from 0).

    ``rows`` hold arrays of turns; the rows of an id are taken in ``order``,
    then by role and text.  Null roles and texts count as empty.  An id whose
    records have no turn has an empty text.  Rows with a null id form one
    conversation.  One conversation is one text, so it must fit a row.
    """
    flat = rows.select(F.col(id_col).alias("id"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("o"),
                       F.posexplode_outer(turns).alias("at", "turn"))
    role, text = (escape(F.coalesce(F.col(f"turn.{c}"), F.lit(""))) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    there = F.col("at").isNotNull()
    flat = flat.select(
        "id", F.struct("o", "at", "turn").alias("key"), there.alias("there"),
        F.when(there, head).otherwise("").alias("head"), F.when(there, text).otherwise("").alias("body"),
        (F.col("turn.role") == learned).alias("learned"))
    flat = flat.withColumn("piece", F.when(F.col("there"), F.concat("head", "body", F.lit(CLOSE))).otherwise(""))
    running = Window.partitionBy("id").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flat = flat.withColumn("upto", F.sum(F.char_length("piece").cast("long")).over(running)).withColumn(
        "n", F.row_number().over(Window.partitionBy("id").orderBy("key")))
    end = F.col("upto") - len(CLOSE)
    span = F.when(F.col("learned") & F.col("there"),
                  F.struct((end - F.char_length("body")).alias("start"), end.alias("end")))
    made = flat.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return made.select(F.col("id").alias(id_col), F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns (array of role and text) of a formatted text."""
    marked = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(p):
        halves = F.split(p, ">", 2)
        role = F.substring(halves[0], F.lit(len(OPEN) + 1), F.char_length(halves[0]) - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(marked, turn)


def read_learned(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
