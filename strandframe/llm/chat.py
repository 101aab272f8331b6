"""Chat formatting: records of several layouts become canonical turns, and turns one formatted text with a loss mask.

A record's layout is told by a fingerprint, the hash of its nested field paths, which selects a declarative mapping. All of
it is built from DataFrame functions."""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The control strings of the template, fixed values.
START, END, ROLE_END = "<|im_start|>", "<|im_end|>", "\n"
TURN_END = END + "\n"
#: Stands for a line feed in a role; escaped texts and roles can't hold it.
ROLE_LINE = "<|n|>"
TURNS = "array<struct<turn: long, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """How a record becomes turns. Either each names an array of objects whose fields role and text make a turn each, or parts
    lists (role, fields): a turn each, of the given fields that are neither null nor empty, parted by blank lines; where
    there are none there is no turn. optional fields may be absent from a record. roles renames roles."""

    name: str
    each: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    #: A layout of one turn a row: turn is the field with its number.
    turn: str | None = None

    def fields(self) -> list[str]:
        """The paths of all fields that the mapping reads; those in an array have [] behind its name."""
        if self.each:
            return [self.each, f"{self.each}[].{self.role}", f"{self.each}[].{self.text}", *(f for _, fs in self.parts for f in fs)]
        if self.turn:
            return [self.turn, self.role, self.text]
        return list(dict.fromkeys(f for _, fs in self.parts for f in fs))

    def fingerprints(self) -> list[str]:
        """Of the record with all fields, and of those without some of the optional ones."""
        fields = self.fields()
        gone = itertools.chain.from_iterable(itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [fingerprint_of([f for f in fields if f not in g]) for g in gone]

    def record(self) -> str:
        """The type of a record."""
        top = [f for f in self.fields() if "[]" not in f and f != self.each]
        each = [f"`{self.each}`: array<struct<`{self.role}`: string, `{self.text}`: string>>"] if self.each else []
        return "struct<" + ", ".join([*each, *(f"`{f}`: string" for f in top)]) + ">"

    def turns(self, get) -> Column:
        """The turns of a record; get(name) is a field's column, null where it is absent."""
        lists = []
        for role, fields in self.parts:
            text = F.concat_ws("\n\n", *(F.when(get(f) != "", get(f)) for f in fields))
            one = F.struct(F.lit(role).alias("role"), text.alias("text"))
            lists.append(F.when(text != "", F.array(one)).otherwise(F.array().cast("array<struct<role: string, text: string>>")))
        if self.each:
            each = F.transform(get(self.each), lambda t: F.struct(self._role(t[self.role]).alias("role"), F.coalesce(t[self.text], F.lit("")).alias("text")))
            lists.append(F.coalesce(each, F.array().cast("array<struct<role: string, text: string>>")))
        return F.transform(F.concat(*lists), lambda t, i: F.struct(i.cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))

    def _role(self, role: Column) -> Column:
        renamed = F.when(F.lit(False), "")
        for old, new in self.roles.items():
            renamed = renamed.when(role == old, new)
        return F.coalesce(renamed, role, F.lit(""))


SYSTEM = ("system", ("system",))
LAYOUTS = (
    Layout("rows", turn="turn", text="text"),
    Layout("messages", each="messages"),
    Layout("from_value", each="conversations", role="from", text="value", parts=(SYSTEM,), optional=("system",), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", parts=(SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt", parts=(SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("response", parts=(SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question", parts=(SYSTEM, ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _known(layouts) -> dict[str, Layout]:
    known: dict[str, Layout] = {}
    for one in layouts:
        for f in one.fingerprints():
            if f in known:
                raise ValueError(f"layouts {known[f].name} and {one.name} have the same fields")
            known[f] = one
    return known


def schema_fingerprint(schema: T.StructType, layouts=LAYOUTS) -> str:
    """The fingerprint of a table: of those nested field paths of its schema that any layout reads."""
    read = {f for one in layouts for f in one.fields()}

    def paths(kind: T.DataType, at: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                here = f"{at}.{f.name}" if at else f.name
                yield here
                yield from paths(f.dataType, here)
        elif isinstance(kind, T.ArrayType):
            yield from paths(kind.elementType, f"{at}[]")

    return fingerprint_of([p for p in paths(schema, "") if p in read])


def json_fingerprint(json: Column, layouts=LAYOUTS) -> Column:
    """The fingerprint of each JSON record: of those nested field paths, of all elements of its arrays, that any layout reads."""
    read = sorted({f for one in layouts for f in one.fields()})
    none = F.array().cast("array<string>")

    def inner(name: str) -> Column:
        keys = F.flatten(F.transform(F.from_json(F.get_json_object(json, f"$.{name}"), "array<string>"), lambda e: F.coalesce(F.json_object_keys(e), none)))
        return F.coalesce(F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k)), none)

    lists = [F.coalesce(F.json_object_keys(json), none), *map(inner, sorted({one.each for one in layouts if one.each}))]
    paths = F.array_sort(F.array_intersect(F.concat(*lists), F.array(*map(F.lit, read))))
    return F.sha2(F.array_join(paths, "\n"), 256)


def from_json(df: DataFrame, id_col: str, json_col: str, layouts=LAYOUTS) -> DataFrame:
    """(conv_id, layout, turns) of JSON records whose layouts may differ from row to row. A record of no known layout, which
    includes null, broken and empty ones, and one whose array is empty, has layout null and no turns; none is dropped.
    Fields that no layout reads don't matter."""
    found = df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("_json"), json_fingerprint(F.col(json_col), layouts).alias("_shape"))
    _known(layouts)
    layout, turns = F.when(F.lit(False), ""), F.when(F.lit(False), F.array().cast(TURNS))
    for one in (x for x in layouts if not x.turn):
        this = F.col("_shape").isin(one.fingerprints())
        record = F.from_json("_json", one.record())
        layout = layout.when(this, one.name)
        turns = turns.when(this, one.turns(lambda name, r=record: r[name]))
    return found.select("conv_id", layout.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def canonical(df: DataFrame, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text), a row a turn, of a table whose schema has the fingerprint of a layout; other columns don't
    matter. Null roles and texts are empty. A table of no known layout raises an error that names its fields."""
    one = _known(layouts).get(schema_fingerprint(df.schema, layouts))
    if one is None:
        raise ValueError(f"no layout for {df.schema.simpleString()}")
    key = F.col(f"`{id_col}`").alias("conv_id")
    if one.turn:
        return df.select(key, F.col(one.turn).cast("long").alias("turn"), one._role(F.col(one.role).cast("string")).alias("role"), F.coalesce(F.col(one.text).cast("string"), F.lit("")).alias("text"))
    present = set(df.columns)
    turns = one.turns(lambda name: (F.col(f"`{name}`") if name in present else F.lit(None).cast("string")))
    return df.select(key, F.explode(turns).alias("t")).select("conv_id", "t.*")


def escaped(text: Column) -> Column:
    """text without control strings: every "<", any backslashes, "|" gets one backslash more, so that no "<|" is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def formatted(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, text, loss): each conversation's turns as one text, and the spans of it that a model is to learn, which are
    the texts of the roles in trained, as (start, end) in bytes of UTF-8, end exclusive.

    turns has (conv_id, turn, role, text). Turns are in order of turn, then role and text (nulls first); repeated rows are
    turns of their own. Nulls are empty, a null conv_id is a conversation. Control strings in texts and roles are escaped,
    line feeds in roles too; read() undoes it. A conversation is one row, so it and its turns must fit in a row of 2 GB.
    An empty table gives no rows."""
    head = F.concat(F.lit(START), F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit(ROLE_END), F.lit(ROLE_LINE)), F.lit(ROLE_END))
    body = escaped(F.coalesce("text", F.lit("")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    size = (F.octet_length(head) + F.octet_length(body) + len(TURN_END)).cast("long")
    # sizes are summed before, texts escaped behind the shuffle, which so moves each text once
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("end", F.sum(size).over(order))
    placed = placed.select("conv_id", "end", head.alias("head"), body.alias("body"), F.coalesce(F.col("role").isin(*trained), F.lit(False)).alias("learned"))
    stop = F.col("end") - len(TURN_END)
    span = F.when(F.col("learned"), F.struct((stop - F.octet_length("body")).alias("start"), stop.alias("end")))
    one = placed.groupBy("conv_id").agg(F.collect_list(F.struct("end", F.concat("head", "body", F.lit(TURN_END)).alias("piece"), span.alias("span"))).alias("parts"))
    ordered = one.select("conv_id", F.array_sort("parts").alias("parts"))
    spans = F.filter(F.col("parts.span"), lambda s: s.isNotNull())
    return ordered.select("conv_id", F.array_join("parts.piece", "").alias("text"), spans.alias("loss"))


def read(chats: DataFrame) -> DataFrame:
    """formatted conversations with turns, an array of (role, text), and loss_texts, the unescaped texts under the loss mask,
    in order. The inverse of formatted() but for numbers of turns."""
    pieces = F.filter(F.split("text", START.replace("|", "\\|"), -1), lambda _, i: i > 0)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, ROLE_END, 1)
        skip = F.length(role) + len(ROLE_END)
        text = F.substr(p, skip + 1, F.length(p) - skip - len(TURN_END))
        return F.struct(unescaped(F.replace(role, F.lit(ROLE_LINE), F.lit(ROLE_END))).alias("role"), unescaped(text).alias("text"))

    # bound once, so that a conversation isn't turned into bytes again for each span
    under = F.transform(F.array(F.col("text").cast("binary")), lambda b: F.transform("loss", lambda s: unescaped(F.substr(b, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))))
    return chats.withColumns({"turns": F.transform(pieces, turn), "loss_texts": F.element_at(under, 1)})


def digest(chats: DataFrame) -> DataFrame:
    """What read() gives back from formatted conversations, as counts and hashes."""
    back = read(chats)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )
