"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<s>" role "[INST]" body "[/INST]</s>"

``role`` and ``body`` hold no control string. A conversation is rendered as it
is and parsed again; where the parser does not give back the very turns, the
control characters of all its roles and bodies are escaped, reversibly:
``~`` as ``~0``, ``[`` as ``~1``, ``<`` as ``~2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, TAIL = "<s>", "[INST]", "[/INST]</s>"
#: What a role or body must not contain, by the grammar.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"))


def escape(x: Column) -> Column:
    for plain, coded in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def unescape(x: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        x = F.replace(x, F.lit(coded), F.lit(plain))
    return x


def render(turns: Column, code=lambda x: x) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), code(t["role"]), F.lit(HEAD), code(t["text"]), F.lit(TAIL))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text; null where it is not of the grammar."""
    pieces = F.split(formatted, r"\Q[/INST]</s>\E")
    bare = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        at = F.instr(x, HEAD)
        role, body = F.substr(x, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), F.substr(x, at + len(HEAD))
        good = x.startswith(OPEN) & (at > len(OPEN))
        for control in CONTROLS:
            good = good & ~role.contains(control) & ~body.contains(control)
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(body).alias("text")))

    turns = F.transform(bare, turn)
    return F.when((F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turns (as parsed from the output), formatted, escaped (boolean).

    Turns are ordered by (turn, role, text), so ties and repeated rows have one
    order. A null role or text is empty; rows with a null conv_id make one
    conversation; an empty table gives no rows; other columns are ignored. The
    turns of one conversation meet in one row, since its text is one value.
    """
    source = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    source = source.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = source.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("t"))
    raw = source.withColumn("raw", render(F.col("t")))
    tried = raw.withColumn("escaped", F.coalesce(parse(F.col("raw")) != F.col("t"), F.lit(True)))
    done = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("t"), escape)).otherwise(F.col("raw")))
    parsed = done.withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.col("turns") == F.col("t"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    return parsed.select("conv_id", checked.alias("turns"), "formatted", "escaped")


def digests(chats: DataFrame, role: str = "assistant") -> DataFrame:
    """Digest columns of formatted chats; the loss mask covers the bodies of one role."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"]), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
