"""Chat formatting: the fingerprint of a record's field paths selects the mapping to canonical turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"

#: Roles as layouts name them, and as turns do.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A record layout: the nested paths of its fields, and either a list field with its two parts or one field a role.

    ``paths`` are dotted, with ``[]`` for the elements of a list; a record has the layout when its paths among all
    layouts' fields are exactly these, so other fields of a record don't matter.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | tuple[tuple[str, str], ...]

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


def _listed(field: str, role: str, text: str) -> Layout:
    return Layout(field, (f"{field}[].{role}", f"{field}[].{text}"), (field, role, text))


def _fields(*pairs: tuple[str, str]) -> Layout:
    return Layout("+".join(f for f, _ in pairs), tuple(f for f, _ in pairs), pairs)


_ASKED = [("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output"), ("instruction", "response")]
#: One mapping for each layout; add to the list to read another.
LAYOUTS: tuple[Layout, ...] = (
    _listed("messages", "role", "content"), _listed("conversations", "from", "value"), _listed("turns", "role", "text"),
    *(_fields((a, "user"), (b, "assistant")) for a, b in _ASKED),
    *(_fields(("system", "system"), (a, "user"), (b, "assistant")) for a, b in _ASKED),
    _fields(("instruction", "user"), ("input", "user"), ("output", "assistant")),
    _fields(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")),
)


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """SHA-256 of a variant's sorted field paths, of those paths that some layout names."""
    known = sorted({p for layout in layouts for p in layout.paths})

    def present(path: str) -> Column:
        if "[]." in path:
            field, part = path.split("[].")
            # Every element of the list must have the part, so that no turn is lost.
            parts = F.try_variant_get(record, f"$.{field}", "array<variant>")
            return F.coalesce(F.forall(parts, lambda e: F.schema_of_variant(e).rlike(f"[<, ]`?{part}`?: ")), F.lit(False))
        return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()

    return F.sha2(F.array_join(F.filter(F.array(*[F.when(present(p), F.lit(p)) for p in known]), lambda p: p.isNotNull()), "\n"), 256)


def _reader(role: str, text: str, names: Column) -> Callable[[Column], Column]:
    def turn(t: Column) -> Column:
        named = F.try_element_at(names, F.lower(t[role])) if role == "from" else t[role]
        return F.struct(F.coalesce(named, t[role], F.lit("")).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))

    return turn


def canonical_turns(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Every row with ``layout_fingerprint`` and ``turns`` (role, text), read by the mapping its fingerprint selects.

    ``record`` is JSON text or a variant. Text that is no JSON, null records and fingerprints without a mapping give
    null turns; their fingerprints say which layout to add. Empty optional fields (``input``, ``system``) make no turn;
    null texts are empty; a null role is empty. Columns of these two names are replaced. One pass, no shuffle.
    """
    value = F.col(f"`{record}`")
    if dict(records.dtypes)[record] != "variant":
        value = F.try_parse_json(value)
    rows = records.withColumn("__record", value)
    rows = rows.withColumn("layout_fingerprint", fingerprint(F.col("__record"), layouts))
    v, turns = F.col("__record"), F.lit(None).cast(TURNS)
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    for layout in layouts:
        if isinstance(layout.turns[0], str):
            field, role, text = layout.turns
            got = F.try_variant_get(v, f"$.{field}", f"array<struct<{role}:string,{text}:string>>")
            said = F.transform(got, _reader(role, text, names))
        else:
            optional = {"input", "system"}
            parts = [F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit("")).alias("text"),
                              F.lit(field in optional).alias("optional")) for field, role in layout.turns]
            said = F.transform(F.filter(F.array(*parts), lambda t: ~t["optional"] | (t["text"] != "")),
                               lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        turns = F.when(F.col("layout_fingerprint") == layout.fingerprint, said).otherwise(turns)
    return rows.withColumn("turns", turns).drop("__record")


#: Marks of the template. Every character of texts and roles that could begin or end a control string (of this template
#: or another's: <s>, </s>, <|x|>, [INST], [/INST]) is followed by a backslash, so no control string is left in one.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_SPECIAL = r"([<\[|\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL + r"\\", "$1")


def format_turns(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """Every row with ``formatted`` and ``loss_spans`` (start from 0, length, in code points): the assistant's texts.

    ``<|turn|>role<|text|>text`` for each turn, then ``<|end|>``. No turns: the end mark alone; null turns: null.
    """
    t = F.col(f"`{turns}`")
    head = lambda x: F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT))
    parts = F.transform(t, lambda x: F.struct(
        head(x).alias("head"), escape(x["text"]).alias("text"), (x["role"] == "assistant").alias("learned")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    spans = F.aggregate("__parts", zero, lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["head"]) + F.char_length(x["text"])).alias("at"),
        F.when(x["learned"], F.array_append(acc["spans"], F.struct(
            (acc["at"] + F.char_length(x["head"])).alias("start"), F.char_length(x["text"]).cast("long").alias("length"))))
        .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    text = F.concat(F.array_join(F.transform("__parts", lambda x: F.concat(x["head"], x["text"])), ""), F.lit(END))
    return rows.withColumn("__parts", parts).withColumn("formatted", text).withColumn("loss_spans", spans).drop("__parts")


def read_back(rows: DataFrame, formatted: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """Every row with ``turns`` and ``loss_texts`` as the formatted text and its mask have them, unescaped."""
    f = F.col(f"`{formatted}`")
    body = F.substring(f, F.lit(1), F.char_length(f) - len(END))
    cut = F.split(body, r"<\|turn\|>")  # what stands before the first mark is empty
    cut = F.slice(cut, F.lit(2), F.size(cut) - 1)
    turns = F.transform(cut, lambda x: F.struct(
        unescape(F.substring_index(x, TEXT, 1)).alias("role"), unescape(F.substring(x, F.instr(x, TEXT) + len(TEXT), F.char_length(x))).alias("text")))
    learned = F.transform(F.col(f"`{spans}`"), lambda s: unescape(F.substring(f, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rows.withColumn("turns", turns).withColumn("loss_texts", learned)


def conversation_records(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One ``record`` (JSON, the messages layout) for each conversation of a table with a row for each turn.

    Rows of a conversation are in order of turn, ties in order of role, then text; null role and text are empty; a null
    turn comes first; rows without an id are one conversation. Repeated rows stay.
    """
    said = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("content"))
    listed = rows.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return listed.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))
