"""Conversations as training text with a loss mask, in Spark expressions only.

Every conversation becomes one text:

    <s>[ROLE] system [IS] Be brief. [/ROLE][INST] Hi [SEP]Anyone? [/INST]Yes.</s>

``<s>`` opens it. Turns of one role in a row are one block, in which ``[SEP]`` stands
between their texts. A user's block is ``[INST] … [/INST]``, an assistant's ``…</s>``,
that of any other role ``[ROLE] name [IS] … [/ROLE]``.

Control strings inside texts and role names are escaped: a backslash goes between a
bracket, ``[`` or ``<``, and what ends a control string, also where there are some
already, so ``[INST]`` becomes ``[\\INST]`` and ``[\\INST]`` becomes ``[\\\\INST]``.
Taking one away gives the text back.

A formatted conversation is kept as its pieces in order, each with a flag: ``loss`` is
true on the texts of assistants, false on all others and on every control string. The
text is the pieces put together; the loss mask covers the flagged ones.

Defined cases. A missing text is empty, a missing role has the empty name. Turns are in
order of ``turn``, those without one first, equal ones by role and text; repeated rows
are turns of their own. Rows without a conversation id are one conversation. Other
columns are ignored. An empty table gives an empty table. A conversation is one row and
has to fit in one (2 GB, as any value of Spark); nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
USER, USER_END = "[INST] ", " [/INST]"
ROLE, IS, ROLE_END = "[ROLE] ", " [IS] ", " [/ROLE]"
SEP = "[SEP]"

# A bracket, backslashes, and the rest of a control string.
_REST = r"/?(?:INST\]|ROLE\]|IS\]|SEP\]|s>)"
_PLAIN = rf"([\[<])(\\*{_REST})"
_ESCAPED = rf"([\[<])\\(\\*{_REST})"
_BLOCK_END = r"(?<= \[/INST\]|</s>| \[/ROLE\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _piece(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _pieces(block: Column) -> Column:
    """Control strings and texts of a block: turns in a row by one role."""
    role, n = block[0]["role"], F.size(block)
    head = F.when(role == "user", USER).when(role == "assistant", "").otherwise(F.concat(F.lit(ROLE), role, F.lit(IS)))
    tail = F.when(role == "user", USER_END).when(role == "assistant", END).otherwise(ROLE_END)

    def turn(t: Column, i: Column) -> Column:
        after = F.when(i < n - 1, SEP).otherwise(tail)
        masked = F.array(_piece(t["text"], True), _piece(after, False))
        plain = F.array(_piece(F.concat(F.when(i == 0, head).otherwise(""), t["text"], after), False))
        return F.when(role == "assistant", masked).otherwise(plain)

    return F.flatten(F.transform(block, turn))


def formatted(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The conversations of ``df``, a row per turn: (``conv_col``, pieces)."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        escaped(F.coalesce(role_col, F.lit(""))).alias("role"),
        escaped(F.coalesce(text_col, F.lit(""))).alias("text"),
    )
    rows = df.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )
    turns, n = F.col("turns"), F.size("turns")
    # Places where a block begins; the last one is behind the turns.
    begins = F.filter(
        F.sequence(F.lit(0), n),
        lambda i: (i == 0) | (i == n) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    rows = rows.select("conv", "turns", begins.alias("begins"))
    blocks = F.transform(
        F.slice("begins", 1, F.size("begins") - 1),
        lambda begin, k: F.slice(turns, begin + 1, F.get("begins", k + 1) - begin),
    )
    pieces = F.concat(F.array(_piece(F.lit(BEGIN), False)), F.flatten(F.transform(blocks, _pieces)))
    return rows.select(F.col("conv").alias(conv_col), pieces.alias("pieces"))


def text_of(pieces: str = "pieces") -> Column:
    """The text that ``pieces`` make up."""
    return F.array_join(F.col(f"{pieces}.text"), "")


def loss_text(pieces: str = "pieces") -> Column:
    """All text under the loss mask, unescaped."""
    masked = F.filter(pieces, lambda p: p["loss"])
    return F.array_join(F.transform(masked, lambda p: unescaped(p["text"])), "")


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, parsed from it: an array of (role, text)."""
    body = F.substring(text, len(BEGIN) + 1, 2**31 - 1)
    blocks = F.filter(F.split(body, _BLOCK_END), lambda b: b != "")

    def inner(b: Column, head: str, tail: str) -> Column:
        return F.substring(b, F.lit(len(head) + 1), F.length(b) - len(head) - len(tail))

    def parsed(b: Column) -> Column:
        user, other = b.startswith(USER), b.startswith(ROLE)
        named = inner(b, ROLE, ROLE_END)
        name = F.substring_index(named, IS, 1)
        role = F.when(user, "user").when(other, unescaped(name)).otherwise("assistant")
        texts = (
            F.when(user, inner(b, USER, USER_END))
            .when(other, F.substring(named, F.length(name) + len(IS) + 1, F.length(named)))
            .otherwise(inner(b, "", END))
        )
        return F.transform(
            F.split(texts, r"\[SEP\]", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, parsed))
