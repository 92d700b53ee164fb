"""Chat formatting (operator 11, DataFrame functions only): heterogeneous conversation layouts become canonical
turns, then one prompt text per conversation with a loss mask over the assistant's words.

Layouts are chosen by schema fingerprints. The nested field paths of the schema (`messages[].role`, `prompt`, ...)
that some declared layout names are hashed; each row's fingerprint is the SHA-256 of the sorted paths that hold a
value in that row, so rows of one table (a union schema of mixed JSON, say) may each have their own layout. The
fingerprint selects a declarative mapping from a literal map: the fingerprints of every layout with every subset
of its optional paths. A table of one turn per row (conversation key, turn, role, text) is recognised by the
paths of its schema and grouped into conversations.

The template marks turns with control strings; the same strings inside texts are escaped reversibly, so the
turns can be read back from the formatted text alone (`read_back`).
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# Fixed values of the template: the text before and after a turn of each role. Control strings are the markers
# these are built of; inside texts a backslash is doubled and a backslash is put after the first character of
# each control string, which no longer reads as a marker.
BEFORE = {"system": "<<SYS>>\n", "user": "<s>[INST] ", "assistant": " "}
AFTER = {"system": "\n<</SYS>>\n\n", "user": " [/INST]", "assistant": " </s>"}
CONTROL = r"([<\[])(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
TURN = r"(?s)<<SYS>>\n.*?\n<</SYS>>\n\n|<s>\[INST\] .*? \[/INST\]| .*? </s>"
#: Role names read as the assistant or the system; every other role, null included, is the user's.
ASSISTANT_ROLES = ("assistant", "gpt", "bot", "model")
SYSTEM_ROLES = ("system",)
LAST = 9223372036854775807
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the paths that must hold a value, those that may, and how turns are read."""
    name: str
    keys: tuple[str, ...]
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        return [fingerprint(self.keys + extra) for size in range(len(self.optional) + 1)
                for extra in itertools.combinations(self.optional, size)]


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content")),
    Layout("sharegpt", ("conversations[].from", "conversations[].value")),
    Layout("instruction", ("instruction", "output"), ("input", "system")),
    Layout("prompt_response", ("prompt", "response"), ("system",)),
    Layout("prompt_completion", ("prompt", "completion")),
)
TURN_ROWS = ("turn", "role", "text")


def fingerprint(paths) -> str:
    return hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: StructType, prefix: str = "") -> set[str]:
    """All nested field paths of a schema: struct fields joined by '.', array elements as '[]'."""
    out = set()
    for field in schema.fields:
        path, kind = prefix + field.name, field.dataType
        out.add(path)
        while isinstance(kind, ArrayType):
            kind, path = kind.elementType, path + "[]"
        if isinstance(kind, StructType):
            out |= field_paths(kind, path + ".")
    return out


def canonical_role(role: Column) -> Column:
    name = F.lower(F.trim(role))
    return F.when(name.isin(*ASSISTANT_ROLES), "assistant").when(name.isin(*SYSTEM_ROLES), "system").otherwise("user")


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _present(path: str) -> Column:
    return F.col(path.split("[]")[0].split(".")[0]).isNotNull()


def _turn(role, text) -> Column:
    return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"),
                    F.coalesce(text, F.lit("")).cast("string").alias("text"))


def _turns(layout: Layout) -> Column:
    """array<struct<role, text>> of one row in this layout, roles not yet canonical."""
    if layout.name in ("messages", "sharegpt"):
        column, role, text = {"messages": ("messages", "role", "content"),
                              "sharegpt": ("conversations", "from", "value")}[layout.name]
        return F.transform(F.coalesce(F.col(column), F.array()), lambda t: _turn(t[role], t[text]))
    system = F.when(F.col("system").isNotNull(), F.array(_turn("system", F.col("system")))) \
        if "system" in layout.optional else None
    if layout.name == "instruction":
        ask = F.col("instruction").cast("string")
        if "input" in layout.optional:
            ask = F.when(F.coalesce(F.col("input").cast("string"), F.lit("")) == "", ask) \
                .otherwise(F.concat(ask, F.lit("\n\n"), F.col("input").cast("string")))
        pair = F.array(_turn("user", ask), _turn("assistant", F.col("output")))
    else:
        answer = "response" if layout.name == "prompt_response" else "completion"
        pair = F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col(answer)))
    return pair if system is None else F.concat(F.coalesce(system, F.array().cast(TURNS)), pair)


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, layout, place, role, text): one row per turn, in place order within a conversation.

    A table with the paths `key`, turn, role and text has one turn per row. Otherwise each row is a
    conversation whose layout its fingerprint selects; a row whose fingerprint no layout declares has layout
    null and no turns. Null texts are empty, roles are canonical (see ASSISTANT_ROLES), turns of one key are
    ordered by (turn, role, text), a null turn last; rows with equal key, turn, role and text are all kept.
    """
    paths = field_paths(df.schema)
    if {key, *TURN_ROWS} <= paths:
        turns = df.select(F.col(key).alias("__key"), F.lit("turn_rows").alias("layout"),
                          F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("__turn"),
                          canonical_role(F.col("role")).alias("role"),
                          F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        return turns.select("__key", "layout", F.struct("__turn", "role", "text").alias("place"), "role", "text")
    usable = [layout for layout in LAYOUTS if set(layout.keys) <= paths]
    if key not in paths or not usable:
        raise ValueError(f"no layout fits the columns {sorted(paths)} with key {key!r}")
    known = sorted({p for layout in usable for p in (*layout.keys, *layout.optional) if p in paths})
    held = F.array_sort(F.filter(F.array(*[F.when(_present(p), F.lit(p)) for p in known]), lambda p: p.isNotNull()))
    choice = F.create_map(*[F.lit(x) for layout in usable for fp in
                            Layout(layout.name, layout.keys, tuple(p for p in layout.optional if p in paths)).fingerprints()
                            for x in (fp, layout.name)])
    rows = df.select(F.col(key).alias("__key"), "*").withColumn(
        "layout", F.element_at(choice, F.sha2(F.array_join(held, "|"), 256)))
    fitted = [Layout(layout.name, layout.keys, tuple(p for p in layout.optional if p in paths)) for layout in usable]
    turns = F.lit(None).cast(TURNS)
    for layout in fitted:
        turns = F.when(F.col("layout") == layout.name, _turns(layout)).otherwise(turns)
    exploded = rows.select("__key", "layout", F.posexplode(turns).alias("__place", "__t"))
    return exploded.select("__key", "layout", F.struct(F.col("__place").cast("long").alias("__turn"),
                                                       canonical_role(F.col("__t.role")).alias("role"),
                                                       F.col("__t.text").alias("text")).alias("place"),
                           canonical_role(F.col("__t.role")).alias("role"), F.col("__t.text").alias("text"))


def _segment_parts(role: Column) -> tuple[Column, Column]:
    def pick(table):
        return F.when(role == "system", table["system"]).when(role == "assistant", table["assistant"]) \
            .otherwise(table["user"])
    return pick(BEFORE), pick(AFTER)


def format_chats(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key, layout, formatted (the template's text), n_turns and loss_spans
    (array of (start, length): 0-based code point offsets of each assistant text, escaped, in the formatted text).

    A conversation is one row, so its turns meet in one task: that is the output's own unit. Offsets come from a
    running sum over the turns in order; segments are put together with array functions. A conversation without
    turns (an empty message list, a layout no mapping declares) has no row. Other columns are not carried.
    """
    turns = canonical_turns(df, key)
    before, after = _segment_parts(F.col("role"))
    segment = F.concat(before, escape(F.col("text")), after)
    order = Window.partitionBy("__key").orderBy("place")
    placed = turns.withColumn("__segment", segment) \
        .withColumn("__end", F.sum(F.length("__segment")).over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("__n", F.row_number().over(order))
    start = F.col("__end") - F.length("__segment") + F.length(before)
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("long").alias("start"),
                                                         F.length(escape(F.col("text"))).cast("long").alias("length")))
    grouped = placed.groupBy("__key").agg(
        F.first("layout").alias("layout"),
        F.array_sort(F.collect_list(F.struct("__n", "__segment", span.alias("span")))).alias("__parts"))
    return grouped.select(
        F.col("__key").alias(key), "layout",
        F.array_join(F.transform("__parts", lambda p: p["__segment"]), "").alias("formatted"),
        F.size("__parts").cast("long").alias("n_turns"),
        F.filter(F.transform("__parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what formatted text and mask hold: turns parsed from the markers and unescaped, and the text
    under the loss mask, unescaped. Returns key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    text = F.coalesce(F.col("formatted"), F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(TURN), 0)

    def parsed(s):
        system = F.struct(F.lit("system").alias("role"), unescape(F.substring(s, 9, F.length(s) - 19)).alias("text"))
        user = F.struct(F.lit("user").alias("role"), unescape(F.substring(s, 11, F.length(s) - 18)).alias("text"))
        assistant = F.struct(F.lit("assistant").alias("role"), unescape(F.substring(s, 2, F.length(s) - 6)).alias("text"))
        return F.when(F.startswith(s, F.lit("<<SYS>>")), system).when(F.startswith(s, F.lit("<s>[INST]")), user) \
            .otherwise(assistant)

    turns = F.transform(pieces, parsed)
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.coalesce(F.col("loss_spans"), F.array()),
                                      lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"),
                                                                     s["length"].cast("int")))), "")
    return formatted.select(
        F.col(key), F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"))


def oracle_sql(conversations: str = "conversations") -> str:
    """Digests of a turn table in DuckDB SQL, computed from the rows directly (escape lengths counted)."""
    assistant = ", ".join(f"'{r}'" for r in ASSISTANT_ROLES)
    system = ", ".join(f"'{r}'" for r in SYSTEM_ROLES)
    pad = {r: len(BEFORE[r]) + len(AFTER[r]) for r in BEFORE}
    return f"""
WITH t AS (SELECT conv_id, coalesce(turn, {LAST}) AS tk,
                  CASE WHEN lower(trim(role)) IN ({assistant}) THEN 'assistant'
                       WHEN lower(trim(role)) IN ({system}) THEN 'system' ELSE 'user' END AS r,
                  coalesce(text, '') AS x
           FROM {conversations}),
s AS (SELECT *, length(x) + (length(x) - length(replace(x, '\\', '')))
                + len(regexp_extract_all(x, '{CONTROL}')) AS esc_len FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY tk, r, x)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY tk, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(esc_len + CASE r WHEN 'system' THEN {pad['system']} WHEN 'assistant' THEN {pad['assistant']}
                                 ELSE {pad['user']} END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
