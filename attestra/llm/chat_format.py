"""Chat formatting, in DataFrame operations only: a declarative template turns conversations into text segments with loss flags.

A finite-state machine over roles checks the order of turns. Control strings inside texts are replaced by two-character codes, so the
formatted text can be split at the template's own control strings alone, and read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: roles: how a turn opens and whether its text is trained on. other: around the name of a role without an entry. end: closes each turn.
#: order: for each state the roles that may follow. last: roles that may end a conversation.
TEMPLATE = {
    "roles": {"system": ("[SYS]", False), "user": ("[INST]", False), "assistant": ("[/INST]", True)},
    "other": ("[ROLE]", "[/ROLE]"),
    "end": "</s>",
    "order": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "last": ["assistant"],
}
MARK = "\\"


def codes(template: dict) -> list[tuple[str, str]]:
    """Each control string with its code. The mark itself comes first, so that codes can't be mistaken for text."""
    controls = [x for x, _ in template["roles"].values()] + [*template["other"], template["end"]]
    return [(MARK, MARK + "m")] + [(x, MARK + chr(ord("A") + i)) for i, x in enumerate(controls)]


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    for control, code in codes(template):
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    for control, code in reversed(codes(template)):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def opening(role: Column, template: dict) -> Column:
    left, right = template["other"]
    out = F.concat(F.lit(left), escape(role, template), F.lit(right))
    for name, (mark, _) in template["roles"].items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def next_state(state: Column, role: Column, template: dict) -> Column:
    out = F.lit("error")
    for before, roles in template["order"].items():
        out = F.when((state == before) & role.isin(roles), role).otherwise(out)
    return out


def format_conversations(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conv_id: segments (array of text, loss), formatted (all segment texts together) and valid (the turns keep the order).

    turns: conv_id, turn, role, text; other columns are not read. Null texts and roles count as empty, null conv_ids are one conversation,
    null turns come first, rows of equal turn follow by role, then text; repeated rows are turns of their own. Conversations that break
    the order are formatted as well. An empty table gives no rows.
    """
    empty = F.lit("")
    turns = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    trained = [r for r, (_, loss) in template["roles"].items() if loss]
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def segments(t: Column) -> Column:
        own = ((opening(t["role"], template), F.lit(False)), (escape(t["text"], template), t["role"].isin(trained)), (F.lit(template["end"]), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in own])

    rows = rows.select(
        "conv_id",
        F.flatten(F.transform("t", segments)).alias("segments"),
        F.aggregate(F.transform("t", lambda t: t["role"]), F.lit("start"), lambda s, r: next_state(s, r, template)).isin(template["last"]).alias("valid"),
    )
    return rows.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (array of role, text) of a formatted text."""
    left, right = template["other"]
    pieces = F.split(formatted, "\\Q" + template["end"] + "\\E")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        rest = F.substring_index(piece, right, 1)
        role, body = unescape(F.substr(rest, F.lit(len(left) + 1)), template), F.substr(piece, F.length(rest) + len(right) + 1)
        for name, (mark, _) in template["roles"].items():
            mine = F.startswith(piece, F.lit(mark))
            role, body = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, F.substr(piece, F.lit(len(mark) + 1))).otherwise(body)
        return F.struct(role.alias("role"), unescape(body, template).alias("text"))

    return F.transform(pieces, turn)


def read_loss(segments: Column, template: dict = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def conversation_digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What the output says when it is read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    rows = formatted.select("conv_id", "formatted", "valid", read_turns(F.col("formatted"), template).alias("turns"), read_loss(F.col("segments"), template).alias("loss"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
