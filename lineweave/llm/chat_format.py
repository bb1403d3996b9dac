"""Chat formatting: records of many layouts become canonical turns, then one template.

A layout is declared as data: which nested field paths a record of that layout has, and where turns, roles and texts
are. A record's schema fingerprint is the hash of those declared paths that it has, in order; a map from fingerprint
to layout, made from the declarations, selects the mapping. A record that has paths of several layouts goes by the
first of them, in the order of their declaration, whose required paths it has: messages before prompt, instruction
before text. The template marks turns with control strings; the same
strings inside a text get one more backslash, which reading back takes away again.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat templates. None may begin where another ends.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ANY = "|".join(re.escape(c) for c in CONTROL)
TURN = "array<struct<role:string,text:string>>"

#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """name; the field paths that a record must have, those that it may have; either turns, role and text (an array of
    objects), or fields: (role, path) one turn each, in order, absent ones left out."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    rename: bool = False  # whether roles go by ROLES
    fields: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("$.messages",), ("$.messages[0].content", "$.messages[0].role", "$.system"), turns="$.messages", role="role", text="content", fields=(("system", "$.system"),)),
    Layout("conversations", ("$.conversations",), ("$.conversations[0].value", "$.conversations[0].from", "$.system"), turns="$.conversations", role="from", text="value", rename=True, fields=(("system", "$.system"),)),
    Layout("instruction", ("$.instruction",), ("$.input", "$.output", "$.response", "$.system"), fields=(("system", "$.system"), ("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"), ("assistant", "$.response"))),
    Layout("prompt", ("$.prompt",), ("$.completion", "$.response", "$.chosen", "$.system"), fields=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion"), ("assistant", "$.response"), ("assistant", "$.chosen"))),
    Layout("question", ("$.question",), ("$.context", "$.answer"), fields=(("system", "$.context"), ("user", "$.question"), ("assistant", "$.answer"))),
    Layout("text", ("$.text",), (), fields=(("assistant", "$.text"),)),
)


def paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in (*x.required, *x.optional)})


def fingerprint_of(present: list[str]) -> str:
    return hashlib.sha256("|".join(sorted(present)).encode()).hexdigest()


def registry(layouts: tuple[Layout, ...]) -> dict[str, str]:
    """Fingerprint -> layout: the required paths with every choice of optional ones; the first layout wins."""
    found: dict[str, str] = {}
    for x in layouts:
        for n in range(len(x.optional) + 1):
            for chosen in combinations(x.optional, n):
                found.setdefault(fingerprint_of([*x.required, *chosen]), x.name)
    return found


class Parsed:
    """A record as VARIANT: has any path, whatever its type."""

    def __init__(self, record: Column):
        self.record = record

    def has(self, path: str) -> Column:
        return F.try_variant_get(self.record, path, "variant").isNotNull()

    def string(self, path: str) -> Column:
        return F.try_variant_get(self.record, path, "string")

    def turns(self, layout: Layout, turn) -> Column:
        one = lambda v, name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
        return F.transform(F.try_variant_get(self.record, layout.turns, "array<variant>"), lambda v: turn(one(v, layout.role), F.coalesce(self._joined(v, layout.text), one(v, layout.text))))

    @staticmethod
    def _joined(v: Column, name: str) -> Column:
        """The texts of a content given in parts, strings or objects with a text, one after the other; null for any other."""
        said = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))
        return F.array_join(F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), said), "")


class Declared:
    """A record by the declared fields only, for JSON beyond the 16 MB that a VARIANT holds; a JSON null isn't there."""

    def __init__(self, record: Column):
        self.record = record

    @staticmethod
    def schema(layouts: tuple[Layout, ...]) -> str:
        lists = {x.turns[2:]: f"array<struct<`{x.role}`:string,`{x.text}`:string>>" for x in layouts if x.turns}
        plain = {p[2:]: "string" for p in paths(layouts) if "[" not in p and p[2:] not in lists}
        return ", ".join(f"`{n}` {t}" for n, t in sorted((lists | plain).items()))

    def has(self, path: str) -> Column:
        name, _, inner = path[2:].partition("[0].")
        whole = self.record.getField(name)
        return F.get(whole, F.lit(0)).getField(inner).isNotNull() if inner else whole.isNotNull()

    def string(self, path: str) -> Column:
        return self.record.getField(path[2:])

    def turns(self, layout: Layout, turn) -> Column:
        one = lambda v, name: F.coalesce(v.getField(name), F.lit(""))
        return F.transform(self.record.getField(layout.turns[2:]), lambda v: turn(one(v, layout.role), one(v, layout.text)))


def fingerprint(record: Parsed | Declared, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the declared field paths that a record has."""
    return F.sha2(F.concat_ws("|", *(F.when(record.has(p), F.lit(p)) for p in paths(layouts))), 256)


def _first_layout(record: Parsed | Declared, layouts: tuple[Layout, ...]) -> Column:
    """Name of the first layout whose required paths a record has; null if there is none."""
    fits = [F.lit(True) for _ in layouts]
    for k, x in enumerate(layouts):
        for p in x.required:
            fits[k] = fits[k] & record.has(p)
    return F.coalesce(*(F.when(own, F.lit(x.name)) for own, x in zip(fits, layouts, strict=True)))


def _turns(record: Parsed | Declared, layout: Layout) -> Column:
    empty = F.array().cast(TURN)
    parts = []
    for role, path in layout.fields:
        own = F.array(F.struct(F.lit(role).alias("role"), F.coalesce(record.string(path), F.lit("")).alias("text")))
        parts.append(F.when(record.has(path), own.cast(TURN)).otherwise(empty))
    if layout.turns:
        named = lambda role: _canonical_role(role) if layout.rename else role
        parts.append(F.coalesce(record.turns(layout, lambda role, text: F.struct(named(role).alias("role"), text.alias("text"))), empty))
    return F.concat(*parts)


def _canonical_role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(role)), role)


def canonical_turns(df: DataFrame, json_col: str, keep: tuple[str, ...], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """keep, then layout (null: no layout fits, or no JSON), fingerprint, turns: array of (role, text), empty if unknown.

    Records go by VARIANT; those too large for one (16 MB of JSON) by the declared fields.
    """
    names = F.create_map(*(F.lit(x) for pair in registry(layouts).items() for x in pair))
    given = F.col(json_col)
    parsed = df.select(*keep, F.try_parse_json(given).alias("_record"), given.alias("_json"))
    large = F.when(F.col("_record").isNull(), F.from_json("_json", Declared.schema(layouts), {"maxStringLen": str((1 << 31) - 1)}))
    parsed = parsed.select(*keep, "_record", large.alias("_large"))
    ways = [(F.col("_record").isNotNull(), Parsed(F.col("_record"))), (F.col("_large").isNotNull(), Declared(F.col("_large")))]
    mark = F.when(ways[0][0], fingerprint(ways[0][1], layouts)).when(ways[1][0], fingerprint(ways[1][1], layouts))
    chosen = parsed.withColumn("fingerprint", F.coalesce(mark, F.sha2(F.lit(""), 256)))
    several = F.when(ways[0][0], _first_layout(ways[0][1], layouts)).when(ways[1][0], _first_layout(ways[1][1], layouts))
    chosen = chosen.withColumn("layout", F.coalesce(F.element_at(names, F.col("fingerprint")), several))
    turns = F.lit(None).cast(TURN)
    for x in layouts:
        for there, record in ways:
            turns = F.when(there & (F.col("layout") == x.name), _turns(record, x)).otherwise(turns)
    return chosen.select(*keep, "layout", "fingerprint", F.coalesce(turns, F.array().cast(TURN)).alias("turns"))


def escape(text: Column) -> Column:
    """One backslash more before every control string and the backslashes that stand before it."""
    return F.regexp_replace(text, rf"(\\*)({_ANY})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({_ANY})", "$1$2")


def _role_mark(role: Column) -> Column:
    return F.url_encode(F.coalesce(role, F.lit("")))


def format_turns(df: DataFrame, turns_col: str, keep: tuple[str, ...], learn: str = "assistant") -> DataFrame:
    """keep, then formatted: the template's string; mask: array of (on, from, count), one a turn, in order: whether the
    loss mask is on in the turn's block of formatted, and there the first character (from 1) and the number of
    characters that it covers. An empty array of turns gives an empty string and mask; a null text or role is empty.

    A block is <|im_start|>role, newline, escaped text, newline, <|im_end|>, newline; its role is URL-encoded. The
    newline after a text keeps the text's own backslashes from the mark behind it. No turn gives an empty string.
    """

    def block(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), _role_mark(t["role"]), F.lit("\n"))
        body = escape(F.coalesce(t["text"], F.lit("")))
        return F.struct(F.concat(head, body, F.lit(f"\n{CLOSE}\n")).alias("block"), F.coalesce(t["role"] == learn, F.lit(False)).alias("on"), (F.char_length(head) + 1).alias("from"), F.char_length(body).alias("count"))

    pieces = F.transform(F.col(turns_col), block)
    made = df.select(*keep, pieces.alias("pieces"))
    return made.select(*keep, F.array_join(F.transform("pieces", lambda p: p["block"]), "").alias("formatted"), F.transform("pieces", lambda p: p.dropFields("block")).alias("mask"))


def _blocks(formatted: Column) -> Column:
    """The blocks of a formatted string, one a turn, without their closing marks."""
    return F.filter(F.split(formatted, rf"(?<!\\){re.escape(CLOSE)}\n"), lambda b: b != "")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted string says: array of (role, text)."""
    header = rf"(?s)\A{re.escape(OPEN)}([^\n]*)\n.*"
    text = lambda b: unescape(F.substr(b, F.locate("\n", b) + 1, F.char_length(b) - F.locate("\n", b) - 1))
    return F.transform(_blocks(formatted), lambda b: F.struct(F.url_decode(F.regexp_extract(b, header, 1)).alias("role"), text(b).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text of a formatted string under its loss mask, unescaped, nothing between."""
    covered = lambda b, m: F.when(m["on"], unescape(F.substr(b, m["from"], m["count"]))).otherwise("")
    return F.array_join(F.zip_with(_blocks(formatted), mask, covered), "")


def conversations_as_records(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): each conversation's rows, by turn (ties by role, then text), as JSON of the "messages" layout.

    A conversation is one record, so its rows come together in one row, as any string made from them must.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    lists = df.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    return lists.select(id_col, F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, layout, fingerprint).

    All columns but the last two are read back from the formatted string and its loss mask. Null texts and roles count
    as empty; a null id is a conversation of its own; repeated rows are repeated turns; an empty table gives no row.
    Other columns of df aren't read, and clashing names in it don't matter.
    """
    records = conversations_as_records(df, id_col, turn_col, role_col, text_col)
    turns = canonical_turns(records, "record", (id_col,))
    formatted = format_turns(turns, "turns", (id_col, "layout", "fingerprint"))
    back = formatted.select(id_col, "layout", "fingerprint", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "layout",
        "fingerprint",
    )
