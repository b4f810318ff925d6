r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is written as

    ### role: text</turn>\n        (once for each turn, in order)

and read back by a deterministic parser: cut after each `</turn>\n`, take what
stands between `### ` and the first `: ` as the role, and drop every backslash
that isn't itself dropped (`\x` stands for x). Each turn is first written as it
is; if the parser wouldn't give back exactly its role and text, it is written
with backslashes before the characters of control strings; `round_trip` says
whether the whole conversation, read back, is the source.

Assistant texts are under the loss mask, `loss_runs`: lengths in code points of
alternating stretches without and with loss, from the start.

Turns of a conversation are ordered by turn, then role, then text; a repeated row
is a repeated turn. A null text or role is empty. Rows with a null conv_id make a
conversation of their own. Other columns are ignored. An empty table gives no
rows. A conversation is one output text, so it is put together in one row, all
by functions that take time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import let

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    r"""text with a backslash before `\` and `#`, and within `: ` and `</turn>`: no control string is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, safe in (("#", "\\#"), (": ", ":\\ "), ("</turn>", "<\\/turn>")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def parsed(formatted: Column) -> Column:
    """Turns (role, text, body) of a formatted conversation; body: the text as it is written."""
    cut = F.split(formatted, "</turn>\n")
    bodies = F.slice(cut, 1, F.size(cut) - 1)

    def turn(x: Column) -> Column:
        middle = F.instr(x, MIDDLE)
        role = F.substring(x, len(OPEN) + 1, middle - len(OPEN) - 1)
        body = F.substring(x, middle + len(MIDDLE), F.length(x))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"), body.alias("body"))

    return F.transform(bodies, turn)


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _survives(role: Column, text: Column) -> Column:
    back = parsed(_rendered(role, text))
    return let(back, lambda t: (F.size(t) == 1) & (F.get(t, F.lit(0))["role"] == role) & (F.get(t, F.lit(0))["text"] == text)) & ~F.contains(text, F.lit(OPEN)) & ~F.contains(role, F.lit(OPEN)) & ~F.contains(text, F.lit("</turn>"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_runs, round_trip); turns are those read back from formatted."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("whole", _survives(F.col("role"), F.col("text")))
    pick = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(escaped(F.col(c)))
    rows = rows.withColumn("written", _rendered(pick("role"), pick("text")))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "written"))).alias("source"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("source", lambda t: t["written"]), ""))
    whole = whole.withColumn("turns", parsed(F.col("formatted")))
    same = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select("conv_id", "formatted", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), _runs().alias("loss_runs"), same.alias("round_trip"))


def _runs() -> Column:
    """For each turn: the code points before its text, its text if it is learned, and the rest of the turn."""

    def run(t: Column, s: Column) -> Column:
        body, total = F.length(t["body"]), F.length(s["written"])
        before = total - body - len(CLOSE)
        return F.when(t["role"] == LEARNED, F.array(before, body, F.lit(len(CLOSE)), F.lit(0))).otherwise(F.array(total, F.lit(0)))

    return F.flatten(F.zip_with("turns", "source", run))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == LEARNED), lambda t: t["text"]), "")


def source_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
