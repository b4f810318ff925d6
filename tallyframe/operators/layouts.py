"""Sheets whose columns move: roles told by header cells, and kinds of rows told by what they hold.

Cells are long: (sheet, row, col, text). A sheet's header is the row with the most known labels; columns
get their roles from it, so a sheet with moved columns gives the same rows. The layout is a relation and is
joined to the cells. It is the side that is broadcast, a row for each column of a sheet, however small the
cells' files look: cells are many times their files' size. A sheet's row is put together in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.gates import failure_codes


def label(text: Column) -> Column:
    """Upper case, trimmed, with single spaces; null if nothing is left."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit(""))


def layout(cells: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(sheet, header_row, col, label, role): the header's columns; role is null for a candidate's column. roles: label -> role."""
    known = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    named = cells.select("sheet", "row", "col", label(F.col("text")).alias("label")).where("label is not null")
    votes = named.where(F.col("label").isin(*roles)).groupBy("sheet", "row").agg(F.count_distinct("label").alias("votes"))
    header = votes.groupBy("sheet").agg(F.max(F.struct("votes", (-F.col("row")).alias("row")))["row"].alias("row")).select("sheet", (-F.col("row")).alias("row"))
    return named.join(F.broadcast(header), ["sheet", "row"]).select("sheet", F.col("row").alias("header_row"), "col", "label", F.try_element_at(known, F.col("label")).alias("role"))


def layout_codes(columns: DataFrame, roles: dict[str, str], candidates: list[str], least: int = 2) -> DataFrame:
    """By sheet: its header row, its candidates' columns, and codes: `duplicate_label`, `missing_role`, `few_candidates`, `missing_candidate`."""
    by = columns.groupBy("sheet", "header_row").agg(
        F.count("*").alias("n"),
        F.count_distinct("label").alias("labels"),
        F.count_distinct("role").alias("roles"),
        F.count_if(F.col("role").isNull()).cast("long").alias("candidates"),
        F.count_distinct(F.when(F.col("role").isNull() & F.col("label").isin(*candidates), F.col("label"))).alias("named"),
    )
    rules = {"duplicate_label": F.col("n") > F.col("labels"), "missing_role": F.col("roles") < len(set(roles.values())), "few_candidates": F.col("candidates") < least, "missing_candidate": F.col("named") < len(candidates)}
    return by.select("sheet", "header_row", "candidates", failure_codes(rules).alias("failure_codes"))


def read_by_layout(cells: DataFrame, columns: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(sheet, row, a column for each role, candidate, text): the rows below the header, one for each candidate's cell that isn't blank."""
    placed = cells.join(F.broadcast(columns), ["sheet", "col"]).where("row > header_row")
    given = F.col("role").isNull() & F.coalesce(F.trim("text") != "", F.lit(False))
    fixed = [F.max(F.when(F.col("role") == r, F.col("text"))).alias(r) for r in dict.fromkeys(roles.values())]
    rows = placed.where(F.col("role").isNotNull() | given).groupBy("sheet", "row").agg(*fixed, F.collect_list(F.when(given, F.struct(F.col("label").alias("candidate"), "text"))).alias("_given"))
    return rows.withColumn("_given", F.explode("_given")).select("sheet", "row", "_given.*", *dict.fromkeys(roles.values()))


def row_kind(identity: Column, candidate: Column, caption: Column, general: Column, runoff: Column) -> Column:
    """`total`, `candidate` or null for a sheet's row.

    A total has the identity n/a, no candidate, a caption that ends with State Votes: and isn't a party's, and votes. A
    candidate has a name that isn't a caption, and votes or an identity.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    votes = (text(general) != "") | (text(runoff) != "")
    total = (F.lower(text(identity)) == "n/a") & (text(candidate) == "") & text(caption).endswith("State Votes:") & ~text(caption).startswith("Party ") & votes
    named = ~text(candidate).isin("", "Party Votes:", "Total State Votes:", "Total Party Votes:") & (votes | ~F.lower(text(identity)).isin("", "n/a"))
    return F.when(total, "total").when(named, "candidate")


def party_label(candidate: Column, parties: dict[str, str], write_in: Column) -> Column:
    """The party of a candidate's column: a named one's, else NONE_OF_THESE, W for write-ins, or OTHER_OR_INDEPENDENT."""
    out = F.when(candidate == "NONE OF THESE CANDIDATES", "NONE_OF_THESE").when(write_in | (candidate == "WRITE-INS (SCATTERED)"), "W").otherwise("OTHER_OR_INDEPENDENT")
    for name, party in parties.items():
        out = F.when(candidate == name, party).otherwise(out)
    return out


def drifted(facts: DataFrame, expected: dict[str, object]) -> DataFrame:
    """(field, found, expected, drift): one row for each frozen value of a one-row relation; a missing field is a drift."""
    missing = [f for f in expected if f not in facts.columns]
    shown = lambda f: F.lit(None).cast("string") if f in missing else F.col(f).cast("string")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), shown(f).alias("found"), F.lit(v).cast("string").alias("expected")) for f, v in expected.items()])
    return facts.select(F.explode(fields).alias("x")).select("x.*", (~F.col("x.found").eqNullSafe(F.col("x.expected"))).alias("drift"))
