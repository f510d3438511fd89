"""Chat formatting with a grammar round trip, in DataFrame operations only.

A turn is written as its marker, its text, a line feed and the end mark:

    ### User: text
    </turn>

Conversations are first written as they are and read back by the grammar. Where
the turns read back differ from the source, the conflicting texts are escaped
and the conversation is written and read again: one backslash goes in front of
each control string and of the backslashes right before it. After that a bare
control string is always a mark, whatever the texts say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marked roles, as they are written. Any other role is written by its hex digits.
ROLES = ("system", "user", "assistant", "tool")
END = "</turn>"
_HEAD = r"### (?:System|User|Assistant|Tool|Role [0-9A-F]*): "
_CONTROL = rf"(?:{_HEAD}|{END})"


def role_name(role: Column) -> Column:
    """A role as its marker names it; a null role is the empty one."""
    role = F.coalesce(role, F.lit(""))
    other = F.concat(F.lit("Role "), F.hex(F.encode(role, "utf-8")))
    return F.when(role.isin(*ROLES), F.initcap(role)).otherwise(other)


def role_of(name: Column) -> Column:
    """The role that a marker names."""
    spelled = F.decode(F.unhex(F.substring(name, 6, 1 << 30)), "utf-8")
    return F.when(F.startswith(name, F.lit("Role ")), spelled).otherwise(F.lower(name))


def marker(role: Column) -> Column:
    return F.concat(F.lit("### "), role_name(role), F.lit(": "))


def escape(text: Column) -> Column:
    """One more backslash before each control string and the backslashes before it."""
    return F.regexp_replace(text, rf"(\\*{_CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape` for any text."""
    return F.regexp_replace(text, rf"\\(\\*{_CONTROL})", "$1")


def render(turns: Column) -> Column:
    """Turns of ``(role, shown)`` as one text."""
    return F.array_join(
        F.transform(
            turns, lambda t: F.concat(marker(t["role"]), t["shown"], F.lit(f"\n{END}\n"))
        ),
        "",
    )


def _read_turn(segment: Column) -> Column:
    """One turn between end marks; null if it does not follow the grammar."""
    name = F.regexp_extract(segment, r"^### ([A-Za-z0-9 ]*): ", 1)
    start = F.length(name) + 7
    shown = F.substring(segment, start, F.length(segment) - start)
    good = (
        F.rlike(segment, F.lit(rf"^{_HEAD}"))
        & F.endswith(segment, F.lit("\n"))
        & ~F.rlike(shown, F.lit(rf"(?<!\\){_CONTROL}"))
    )
    return F.when(good, F.struct(name.alias("name"), unescape(shown).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as ``(name, text)``, null for a broken one.

    Bare end marks part the turns; a turn is one marker, a text without bare
    control strings, and a line feed.
    """
    parts = F.split(formatted, rf"(?<!\\){END}\n", -1)
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), _read_turn)


def read_turns(formatted: Column) -> Column:
    """The ``(role, text)`` turns of a formatted conversation."""
    return F.transform(
        parse(formatted),
        lambda t: F.struct(role_of(t["name"]).alias("role"), t["text"].alias("text")),
    )


def loss_texts(formatted: Column, runs: Column) -> Column:
    """The pieces of a formatted text under its loss mask, in order, with their escapes undone.

    ``runs`` are run lengths ``(chars, loss)`` in code points from the start.
    """
    spans = F.aggregate(
        runs,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("pieces")),
        lambda state, run: F.struct(
            (state["at"] + run["chars"]).alias("at"),
            F.when(
                run["loss"],
                F.concat(
                    state["pieces"],
                    F.array(unescape(F.substring(formatted, state["at"], run["chars"]))),
                ),
            )
            .otherwise(state["pieces"])
            .alias("pieces"),
        ),
    )
    return spans["pieces"]


def _same(formatted: Column, source: Column) -> Column:
    """Which turns read back as they are in the source; a turn too many is not."""
    return F.zip_with(
        parse(formatted),
        source,
        lambda read, t: F.coalesce(
            (read["name"] == role_name(t["role"])) & (read["text"] == t["text"]), F.lit(False)
        ),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_runs, escaped)`` of rows ``(conv_id, turn, role, text)``.

    ``formatted`` is the training text. ``loss_runs`` is its loss mask as run
    lengths ``(chars, loss)`` in code points, in order: the assistant's texts
    count, all else does not. ``escaped`` is the number of texts that needed
    escapes. Turns go by ``turn`` (null first), equal ones by role and text;
    repeated rows are repeated turns. A null role or text is empty. Rows
    without ``conv_id`` are one conversation. Other columns are not read. An
    empty table gives no conversation.

    A conversation is one row of the result, so its turns meet in one task;
    nothing else does. The second reading must give the source, or the query
    fails. It does give it: escaping leaves no bare control string in a text,
    and none can form across the line feed that ends a text.
    """
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    whole = whole.agg(F.sort_array(F.collect_list(turn)).alias("source"))

    def shown(how) -> Column:
        return F.transform(
            "source", lambda t: F.struct(t["role"].alias("role"), how(t["text"]).alias("shown"))
        )

    first = whole.withColumn("plain", render(shown(lambda text: text)))
    clear = F.forall(_same(F.col("plain"), F.col("source")), lambda same: same)
    second = first.withColumn("clear", clear).select(
        "conv_id",
        "source",
        F.when(F.col("clear"), shown(lambda text: text)).otherwise(shown(escape)).alias("turns"),
    )
    written = second.withColumn("formatted", render(F.col("turns")))
    identical = F.forall(_same(F.col("formatted"), F.col("source")), lambda same: same)
    runs = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.length(marker(t["role"])).alias("chars"), F.lit(False).alias("loss")),
                F.struct(
                    F.length(t["shown"]).alias("chars"), (t["role"] == "assistant").alias("loss")
                ),
                F.struct(F.lit(len(END) + 2).alias("chars"), F.lit(False).alias("loss")),
            ),
        )
    )
    changed = F.filter(
        F.zip_with("turns", "source", lambda t, own: t["shown"] != own["text"]), lambda x: x
    )
    failed = F.raise_error(F.lit("a formatted conversation does not read back as its source"))
    return written.select(
        "conv_id",
        F.when(identical, F.col("formatted")).otherwise(failed.cast("string")).alias("formatted"),
        runs.alias("loss_runs"),
        F.size(changed).alias("escaped"),
    )
