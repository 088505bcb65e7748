"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A declarative template names, for each role, the roles it may follow, whether a
conversation may end with it and whether its text is learnt. Formatting emits a
conversation's segments in order: control segments (never learnt) and text segments with
the role's loss flag. All of it is built of DataFrame functions.

Control strings inside texts are escaped so that every "<|" of the output is a marker:
a backslash becomes two, then "<|" becomes "<", backslash, "|". This is undone by
``read_back``. In roles, line feeds are escaped too.

Defined cases: turns are ordered by (turn, role, text), so ties and repeated rows have one
order; a null text is empty and a null role is an empty role; a null conversation id is a
conversation of its own; roles that the template does not know, or that break the turn
order, make ``valid`` false and name the first offending turn, but are formatted all the
same, with the loss flag of their role; an empty table gives an empty table; other columns are not read. One
conversation's output is one row, so a conversation has to fit one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<start>"


@dataclass(frozen=True)
class Template:
    """Markers, and the machine: for each role its possible predecessors, its loss flag, and final roles."""

    follows: tuple = (
        ("system", (START,)),
        ("user", (START, "system", "assistant", "tool")),
        ("assistant", ("user", "tool")),
        ("tool", ("assistant",)),
    )
    learnt: tuple = ("assistant",)
    final: tuple = ("assistant",)
    open: str = "<|im_start|>"
    close: str = "<|im_end|>"

    def __post_init__(self):
        if not (self.open.startswith("<|") and self.close.startswith("<|")) or self.open == self.close:
            raise ValueError("Markers must differ and begin with '<|', the only string that is escaped")


def _replaced(value: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(value: Column) -> Column:
    return _replaced(value, ("\\", "\\\\"), ("<|", "<\\|"))


def unescape(value: Column) -> Column:
    return _replaced(value, ("<\\|", "<|"), ("\\\\", "\\"))


def _escape_role(value: Column) -> Column:
    return _replaced(escape(value), ("\n", "<\\n"))


def _unescape_role(value: Column) -> Column:
    return unescape(_replaced(value, ("<\\n", "\n")))


def _machine(turns: Column, template: Template) -> Column:
    """Runs over the turns' roles: the last role, the place of the first that must not follow (or null), and a loss flag a turn."""
    learnt = F.array(*map(F.lit, template.learnt))
    allowed = F.array(*(F.lit(f"{before}\n{role}") for role, befores in template.follows for before in befores))
    first = F.struct(F.lit(START).alias("role"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("broken"), F.lit("").alias("flags"))

    def step(state: Column, turn: Column) -> Column:
        fits = F.array_contains(allowed, F.concat(state["role"], F.lit("\n"), turn["role"]))
        broken = F.when(state["broken"].isNotNull(), state["broken"]).when(~fits, state["n"])
        flag = F.when(F.array_contains(learnt, turn["role"]), "1").otherwise("0")
        return F.struct(
            turn["role"].alias("role"), (state["n"] + 1).alias("n"), broken.alias("broken"), F.concat(state["flags"], flag).alias("flags")
        )

    return F.aggregate(turns, first, step)


def format_chats(rows: DataFrame, template: Template = Template(), key: str = "conv_id") -> DataFrame:
    """One row a conversation: its segments (text, loss), the formatted text, and the machine's verdict."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column, place: Column) -> Column:
        head = F.concat(F.lit(template.open), _escape_role(t["role"]), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (F.substr("state.flags", place + 1, F.lit(1)) == "1").alias("loss")),
            F.struct(F.lit(template.close + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    final = F.col("state.role").isin(*template.final)
    return (
        gathered.withColumn("state", _machine(F.col("turns"), template))
        .select(
            "conv_id",
            F.flatten(F.transform("turns", segments)).alias("segments"),
            (F.col("state.broken").isNull() & final).alias("valid"),
            F.col("state.broken").alias("first_broken"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns (role, text) parsed from the formatted text, and the learnt text from the segments."""
    ended = F.lit(template.close + "\n")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        text = F.substr(piece, cut + 1, F.length(piece) - cut - F.length(ended))
        return F.struct(_unescape_role(F.substr(piece, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text"))

    opened = "".join("\\" + c if c in "|\\.[](){}^$*+?" else c for c in template.open)
    pieces = F.split("formatted", opened)
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select(
        "conv_id",
        F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        "formatted",
        "valid",
        "first_broken",
    )
