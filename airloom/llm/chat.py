"""Conversations as training text, from a declarative template.

A finite-state machine over the roles validates the order of turns. A conversation becomes a list of
segments, three for each turn (opening with role, text, closing), each with its loss flag; only the
texts of trained roles are under the loss. Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``moves``: (state, role) to the next state; ``start`` and ``final`` are states.

    ``control`` is what every control string begins with; inside texts the escape character is put
    between its characters, and itself doubled.
    """

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    control: tuple[str, str] = ("<", "|")
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })

    def __post_init__(self):
        for mark in (self.opening, self.closing):
            if not mark.startswith("".join(self.control)):
                raise ValueError(f"{mark!r} does not begin with the control characters")
        if len(self.after_role) != 1 or len(self.escape) != 1:
            raise ValueError("the escape and what ends a role are single characters")


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    first, second = template.control
    doubled = F.replace(text, F.lit(template.escape), F.lit(template.escape * 2))
    return F.replace(doubled, F.lit(first + second), F.lit(first + template.escape + second))


def escaped_role(role: Column, template: Template = CHAT) -> Column:
    """A role as ``escaped``, its line feeds too: the first bare one ends it."""
    return F.replace(escaped(role, template), F.lit(template.after_role), F.lit(template.escape + template.after_role))


def unescaped(text: Column, template: Template = CHAT) -> Column:
    """Left to right, an escape character and what follows it become what follows it."""
    return F.regexp_replace(text, r"(?s)\x{%x}(.)" % ord(template.escape), "$1")


def _concat(parts: Column) -> Column:
    return F.array_join(parts, "")


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = CHAT
) -> DataFrame:
    """One row for each conversation: (conv, valid, segments), segments being (text, loss) in order.

    Turns are ordered by ``turn`` (null first), equal ones by role and text; repeated rows are turns
    of their own. A null role or text is read as empty. ``valid`` says whether the machine ends in a
    final state; conversations that it refuses are formatted all the same. A null conversation id is
    a conversation of its own; an empty table gives no rows.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    body = F.struct("turn", "role", "text")
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list(body)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, said), to in template.moves.items() for x in (f"{state} {said}", to)])
    ended = F.aggregate(
        "turns", F.lit(template.start), lambda state, t: F.coalesce(moves[F.concat(state, F.lit(" "), t["role"])], F.lit(""))
    )

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def three(t: Column) -> Column:
        no = F.lit(False)
        return F.array(
            segment(F.concat(F.lit(template.opening), escaped_role(t["role"], template), F.lit(template.after_role)), no),
            segment(escaped(t["text"], template), t["role"].isin(*template.trained)),
            segment(F.lit(template.closing), no),
        )

    return chats.select(
        F.col("conv").alias(conv),
        ended.isin(*template.final).alias("valid"),
        F.flatten(F.transform("turns", three)).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    """The training text of a conversation."""
    return _concat(F.transform(segments, lambda s: s["text"]))


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss, unescaped, nothing between."""
    return _concat(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)))


def parsed(segments: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) that the segments were made from, unescaped."""
    before, after = len(template.opening), len(template.after_role)

    def turn(head: Column, body: Column) -> Column:
        role = F.substring(head["text"], F.lit(before + 1), F.length(head["text"]) - before - after)
        return F.struct(unescaped(role, template).alias("role"), unescaped(body["text"], template).alias("text"))

    heads = F.filter(segments, lambda _, i: i % 3 == 0)
    bodies = F.filter(segments, lambda _, i: i % 3 == 1)
    return F.zip_with(heads, bodies, turn)


def read_back(text: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a conversation from its formatted text alone, by its marks."""
    def quoted(mark: str) -> str:
        return "".join(f"\\x{{{ord(c):x}}}" for c in mark)

    plain = f"[^{quoted(template.escape)}{quoted(template.after_role)}]*+"
    role = f"({plain}(?:{quoted(template.escape)}.{plain})*+)"
    turn = f"(?s){quoted(template.opening)}{role}{quoted(template.after_role)}(.*?){quoted(template.closing)}"
    roles, texts = (F.regexp_extract_all(text, F.lit(turn), F.lit(i)) for i in (1, 2))
    return F.zip_with(roles, texts, lambda r, x: F.struct(unescaped(r, template).alias("role"), unescaped(x, template).alias("text")))
