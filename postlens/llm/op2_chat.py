"""Chat formatting: schema fingerprints select declarative mappings that bring
prompt, instruction and message records into canonical turns, then a chat
template with a loss mask.  DataFrame functions only.

A record is a VARIANT.  Its fingerprint is the hash of its nested field paths
(names and nesting, not scalar types), read from ``schema_of_variant``.
``LAYOUTS`` declares, by field paths, which fields hold the turns; a layout's
fingerprints are those of its required paths with any subset of the optional
ones.  A record of an unknown fingerprint keeps its key and gets no turns and
a null layout, so that it shows up in the output and is never guessed at.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside role and
text a backslash becomes ``\\s``, ``<|`` becomes ``<\\p`` and a line feed in a
role becomes ``\\n``, so control strings of the template never occur inside a
turn and the reading is exact.  The loss mask is a list of (start, length) in
code points over the formatted string, one per assistant turn.

Defined results: null text or role is empty; turns are ordered by (turn, role,
text), null turns first; equal rows stay separate turns; a null key is a
conversation of its own; an empty table gives an empty result; extra columns
are not read.  A conversation is one training example and so one row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"

#: Role names of other layouts (fixed values); any other name stays as it is.
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``paths``: field paths, ``[]`` after a list.  ``turns``: SQL over the
    record ``v`` that gives the turns."""

    name: str
    paths: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = ()


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


def _messages(path: str, role: str, text: str) -> str:
    rows = _get(path, f"array<struct<{role}:string,{text}:string>>")
    return (f"transform({rows}, (m, i) -> named_struct('turn', cast(i as bigint), "
            f"'role', m.{role}, 'text', m.{text}))")


def _fixed(*turns: tuple[str, str]) -> str:
    """Turns (role, SQL text); a turn whose text is null is left out, except the last two."""
    rows = [f"named_struct('turn', {i}L, 'role', '{r}', 'text', {t})" for i, (r, t) in enumerate(turns)]
    head = [f"filter(array({r}), x -> x.text is not null)" for r in rows[:-2]]
    return f"concat({', '.join([*head, f'array({rows[-2]}, {rows[-1]})'])})"


_INSTRUCTION = ("case when coalesce({i}, '') = '' then {q} else concat(coalesce({q}, ''), '\\n\\n', {i}) end"
                .format(q=_get("instruction"), i=_get("input")))

LAYOUTS = (
    Layout("turn_rows", ("id", "turn", "role", "text"),
           f"array(named_struct('turn', {_get('turn', 'bigint')}, 'role', {_get('role')}, 'text', {_get('text')}))"),
    Layout("messages", ("id", "messages[].role", "messages[].content"),
           _messages("messages", "role", "content"), optional=("messages[].name",)),
    Layout("from_value", ("id", "conversations[].from", "conversations[].value"),
           _messages("conversations", "`from`", "value")),
    Layout("prompt", ("id", "prompt", "completion"),
           _fixed(("system", _get("system")), ("user", _get("prompt")), ("assistant", _get("completion"))),
           optional=("system",)),
    Layout("prompt_response", ("id", "prompt", "response"),
           _fixed(("system", _get("system")), ("user", _get("prompt")), ("assistant", _get("response"))),
           optional=("system",)),
    Layout("instruction", ("id", "instruction", "output"),
           _fixed(("system", _get("system")), ("user", _INSTRUCTION), ("assistant", _get("output"))),
           optional=("system", "input")),
)


def shape_of_paths(paths: tuple[str, ...]) -> str:
    """The nesting that ``paths`` describe, as ``shape_of_record`` writes it."""
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})

    def show(node: dict) -> str:
        fields = []
        for name in sorted(node, key=lambda n: n.removesuffix("[]")):
            below = show(node[name])
            if name.endswith("[]"):
                below = f"ARRAY<{below}>" if below else "ARRAY"
            fields.append(name.removesuffix("[]") + (f": {below}" if below else ""))
        return f"OBJECT<{', '.join(fields)}>" if fields else ""

    return show(tree)


def shape_of_record(v: Column) -> Column:
    """Field names and nesting of a variant, scalar types taken out."""
    scalar = r"(?!OBJECT|ARRAY)[A-Z][A-Z_ ]*(\([0-9, ]*\))?"
    lists = F.regexp_replace(F.schema_of_variant(v), f"ARRAY<{scalar}>", "ARRAY")
    return F.regexp_replace(lists, f": {scalar}(?=[,>])", "")


def fingerprint(v: Column) -> Column:
    """Hash of the record's nested field paths."""
    return F.sha2(shape_of_record(v), 256)


def layout_fingerprints(layouts=LAYOUTS) -> list[tuple[str, Layout]]:
    out = []
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for more in combinations(layout.optional, n):
                shape = shape_of_paths((*layout.paths, *more))
                out.append((hashlib.sha256(shape.encode()).hexdigest(), layout))
    return out


def canonical_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """``records`` (conv_id, v variant) -> conv_id, layout, turns."""
    known = layout_fingerprints(layouts)
    marked = records.select("conv_id", "v", fingerprint(F.col("v")).alias("mark"))
    layout, turns = F.lit(None).cast("string"), F.expr("array()").cast(TURNS)
    for each in layouts:
        fits = F.col("mark").isin([m for m, of in known if of.name == each.name])
        layout = F.when(fits, F.lit(each.name)).otherwise(layout)
        turns = F.when(fits, F.coalesce(F.expr(each.turns).cast(TURNS), F.expr("array()").cast(TURNS))).otherwise(turns)
    aliases = F.create_map(*[F.lit(x) for kv in ROLE_ALIASES.items() for x in kv])
    read = marked.select("conv_id", layout.alias("layout"), turns.alias("turns"))
    own = F.col("layout").isin("turn_rows", "messages")  # these name roles canonically
    return read.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["turn"].alias("turn"),
        F.when(own, F.coalesce(t["role"], F.lit(""))).otherwise(
            F.coalesce(F.element_at(aliases, t["role"]), t["role"], F.lit(""))).alias("role"),
        F.coalesce(t["text"], F.lit("")).alias("text"))))


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(_escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\p"), F.lit("|")), F.lit("\\n"), F.lit("\n")),
                     F.lit("\\s"), F.lit("\\"))


def format_chats(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """``records`` (conv_id, v variant) -> conv_id, layouts, formatted, loss_mask.

    ``loss_mask``: (start, length) of each assistant text within ``formatted``,
    in code points from 0.
    """
    turns = canonical_turns(records, layouts)
    rows = (turns.select("conv_id", "layout", F.explode_outer("turns").alias("t"))
            .groupBy("conv_id").agg(
                F.array_sort(F.collect_list("t")).alias("turns"),
                F.array_join(F.array_sort(F.collect_set("layout")), ",").alias("layouts")))
    pieces = rows.select("conv_id", "layouts", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
        _escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("learn"))).alias("pieces"))
    closing = len(END) + 1
    walked = pieces.select(
        "conv_id", "layouts", "pieces",
        F.aggregate("pieces",
                    F.struct(F.lit(0).cast("bigint").alias("at"),
                             F.expr("array()").cast("array<struct<start:bigint,length:bigint>>").alias("mask")),
                    lambda acc, p: F.struct(
                        (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + closing).cast("bigint").alias("at"),
                        F.when(p["learn"], F.concat(acc["mask"], F.array(F.struct(
                            (acc["at"] + F.length(p["head"])).cast("bigint").alias("start"),
                            F.length(p["body"]).cast("bigint").alias("length"))))).otherwise(acc["mask"]).alias("mask")),
                    lambda acc: acc["mask"]).alias("loss_mask"))
    return walked.select(
        "conv_id", "layouts",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
        .alias("formatted"), "loss_mask")


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        _unescape(F.substring(p, F.instr(p, "\n") + F.lit(1),
                              F.length(p) - F.instr(p, "\n") - F.lit(len(END) + 1))).alias("text")))


def read_loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: _unescape(
        F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as records of one turn each."""
    return conversations.select("conv_id", F.to_variant_object(F.struct(
        F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")).alias("v"))


#: The probe conversation: its texts hold the template's own control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.to_variant_object(F.struct(F.lit(-1).cast("bigint").alias("id"), F.array(*[
            F.struct(F.lit(r).alias("role"), F.lit(PROBE).alias("content")) for r in ("user", "assistant")
        ]).alias("messages"))).alias("v"))
    records = turn_records(read_table(spark, sf_dir, "conversations")).unionByName(probe)
    out = format_chats(records).withColumn("turns", read_turns(F.col("formatted"))) \
        .withColumn("loss_text", read_loss_text(F.col("formatted"), F.col("loss_mask")))
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "layouts")


_ESC = "replace(replace({c}, '\\', '\\s'), '<|', '<\\p')"
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'turn_rows' AS layout FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}', 'messages'), (-1, 1, 'assistant', '{PROBE}', 'messages')),
told AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum({len(START) + len(END) + 2} + length({_ESC.format(c='text')})
             + length(replace({_ESC.format(c='role')}, chr(10), '\\n'))) AS chars,
         any_value(layout) AS layouts
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars, layouts
FROM told
"""

QUERIES = {"op2_chat_format": op2_chat_format}
ORACLE_SQL = {"op2_chat_format": SQL}
