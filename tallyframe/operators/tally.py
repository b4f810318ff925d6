"""From vote lines to one fact for each contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import identity

ROUND = ["seat_id", "round_no", "stage", "special"]


def rounds(lines: DataFrame) -> DataFrame:
    """One row for each round of a seat: lines, votes, distinct reported totals."""
    return lines.groupBy("cycle", "state", *ROUND).agg(F.count("*").alias("lines"), F.sum("votes").alias("votes"), F.array_sort(F.collect_set("source_total")).alias("source_totals"))


def choose_round(found: DataFrame) -> DataFrame:
    """rounds with `selected` and `ambiguity`: a House seat's deciding round, or why there is none.

    Regular rounds come before special ones; then a single runoff, a single general,
    or the only round, of whatever stage. Anything else is ambiguous: no tie is broken.
    """
    seat = Window.partitionBy("seat_id")
    regular = F.count_if(~F.col("special")).over(seat)
    counted = found.withColumn("eligible", ~F.col("special") | (regular == 0))
    of = lambda stage: F.count_if(F.col("eligible") & (F.col("stage") == stage)).over(seat)
    counted = counted.withColumns({"runoffs": of("runoff"), "generals": of("gen"), "pool": F.count_if("eligible").over(seat)})
    return _chosen(counted, found.columns, F.col("runoffs"))


def choose_senate_round(found: DataFrame) -> DataFrame:
    """rounds with `selected` and `ambiguity` of a Senate seat: a single general round, or the only round."""
    seat = Window.partitionBy("seat_id")
    counted = found.withColumns({"eligible": F.lit(True), "generals": F.count_if(F.col("stage") == "gen").over(seat), "pool": F.count("*").over(seat)})
    return _chosen(counted, found.columns, F.lit(0))


def _chosen(counted: DataFrame, columns: list[str], runoffs: Column) -> DataFrame:
    generals, pool = F.col("generals"), F.col("pool")
    ambiguity = F.when(runoffs > 1, "ambiguous_multiple_runoff_rounds").when((runoffs == 0) & (generals > 1), "ambiguous_multiple_general_rounds").when((runoffs == 0) & (generals == 0) & (pool > 1), "ambiguous_no_final_round")
    chosen = F.when(runoffs == 1, F.col("stage") == "runoff").when((runoffs == 0) & (generals == 1), F.col("stage") == "gen").otherwise((runoffs == 0) & (generals == 0) & (pool == 1))
    return counted.select(*columns, (F.col("eligible") & chosen).alias("selected"), ambiguity.alias("ambiguity"))


def party_group(parties: Column) -> Column:
    """DEMOCRATIC, REPUBLICAN, OTHER, or CONFLICT where both major parties are named."""
    d, r = F.array_contains(parties, "D"), F.array_contains(parties, "R")
    return F.when(d & r, "CONFLICT").when(d, "DEMOCRATIC").when(r, "REPUBLICAN").otherwise("OTHER")


def merge_candidates(lines: DataFrame) -> DataFrame:
    """One row for each candidate of a round; lines without a candidate never merge."""
    identity = F.coalesce(F.col("candidate"), F.concat(F.lit("line-"), F.col("line").cast("string")))
    merged = lines.groupBy("cycle", "state", *ROUND, identity.alias("identity")).agg(
        F.sum("votes").alias("votes"), F.array_sort(F.collect_set("party")).alias("parties"), F.count("*").alias("fusion_lines"), F.min("line").alias("first_line"), F.min("source_total").alias("least_total"), F.max("source_total").alias("most_total")
    )
    return merged.withColumn("group", party_group(F.col("parties")))


def contest_facts(candidates: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One row for each round: votes by group, the two-party margin or why there is none, the unique winner, the total's delta.

    A round's reported total counts if all its lines have the same. totals: rounds to take it from in place of the
    candidates' own lines. Reasons are looked for in a fixed order.
    """
    of = lambda g: F.sum(F.when(F.col("group") == g, F.col("votes")).otherwise(0))
    top = F.rank().over(Window.partitionBy(*ROUND).orderBy(F.col("votes").desc()))
    ranked = candidates.withColumn("_top", top == 1)
    facts = ranked.groupBy("cycle", "state", *ROUND).agg(
        of("DEMOCRATIC").alias("democratic_votes"),
        of("REPUBLICAN").alias("republican_votes"),
        F.sum(F.when(F.col("group").isin("OTHER", "CONFLICT"), F.col("votes")).otherwise(0)).alias("other_votes"),
        F.sum("votes").alias("total_votes"),
        F.count_if(F.col("group") == "CONFLICT").alias("conflicts"),
        F.count("*").alias("candidates"),
        F.count_if("_top").alias("leaders"),
        F.min(F.when(F.col("_top"), F.col("identity"))).alias("_winner"),
        F.min(F.when(F.col("_top"), F.col("group"))).alias("_group"),
        F.min("least_total").alias("_least"),
        F.max("most_total").alias("_most"),
    )
    d, r = F.col("democratic_votes"), F.col("republican_votes")
    reason = (
        F.when(F.col("conflicts") > 0, "fusion_cross_major_party_candidate")
        .when((F.col("total_votes") == 0) & (F.col("candidates") == 1), "zero_vote_uncontested_candidate")
        .when((d == 0) & (r == 0), "missing_both_major_parties")
        .when(d == 0, "missing_democratic_candidate")
        .when(r == 0, "missing_republican_candidate")
    )
    unique = F.col("leaders") == 1
    if totals is not None:
        given = totals.select(*ROUND, F.array_min("source_totals").alias("_least"), F.array_max("source_totals").alias("_most"))
        facts = facts.drop("_least", "_most").join(given, ROUND)
    reported = F.when(F.col("_least") == F.col("_most"), F.col("_least"))
    return facts.select(
        "cycle",
        "state",
        *ROUND,
        "democratic_votes",
        "republican_votes",
        "other_votes",
        "total_votes",
        F.when(reason.isNull(), F.round(100.0 * (d - r) / (d + r), 12)).alias("two_party_margin"),
        reason.alias("margin_reason"),
        F.when(F.col("total_votes") > 0, F.round(F.col("other_votes") / F.col("total_votes"), 12)).alias("other_share"),
        F.when(unique, F.col("_winner")).alias("winner"),
        F.when(unique, F.col("_group")).alias("winner_group"),
        F.when(~unique, "winner_tie").alias("problem"),
        (reported - F.col("total_votes")).alias("source_total_delta"),
    )


def targets(lines: DataFrame) -> DataFrame:
    """Facts of the deciding rounds whose winner is unique."""
    found = rounds(lines)
    chosen = choose_round(found).where("selected").select(*ROUND)
    facts = contest_facts(merge_candidates(lines.join(chosen, ROUND, "left_semi")))
    return facts.where("problem is null")


def cycle_reconciliation(facts: DataFrame) -> DataFrame:
    """By cycle: how many contests have what, and whether the cycle qualifies as a benchmark."""
    return facts.groupBy("cycle").agg(
        F.count("*").alias("contests"),
        F.count_if(F.expr("two_party_margin is not null")).alias("with_margin"),
        F.count_if(F.expr("problem is not null")).alias("ties"),
        F.count_if(F.expr("margin_reason = 'missing_both_major_parties'")).alias("missing_both"),
        F.count_if(F.expr("margin_reason = 'missing_democratic_candidate'")).alias("missing_democratic"),
        F.count_if(F.expr("margin_reason = 'missing_republican_candidate'")).alias("missing_republican"),
        F.count_if(F.expr("margin_reason = 'fusion_cross_major_party_candidate'")).alias("fusion"),
        F.round(F.count_if(F.expr("two_party_margin is not null")) / F.count("*"), 12).alias("margin_coverage"),
        F.bool_and(F.col("democratic_votes") + F.col("republican_votes") + F.col("other_votes") == F.col("total_votes")).alias("votes_conserved"),
    )


def merge_with_write_ins(lines: DataFrame, write_in: Column) -> DataFrame:
    """One row for each candidate of a round; write-in lines stay apart as UNKNOWN. A candidate with any Democratic line is DEMOCRATIC, else REPUBLICAN with any such line."""
    identity = F.when(write_in, F.concat(F.lit("write-in:"), F.col("line").cast("string"))).otherwise(F.col("candidate"))
    merged = lines.groupBy("cycle", "state", *ROUND, identity.alias("identity")).agg(F.sum("votes").alias("votes"), F.bool_or(write_in).alias("write_in"), F.bool_or(F.col("party") == "D").alias("d"), F.bool_or(F.col("party") == "R").alias("r"), F.count("*").alias("fusion_lines"))
    return merged.withColumn("group", F.when(F.col("write_in"), "UNKNOWN").when(F.col("d"), "DEMOCRATIC").when(F.col("r"), "REPUBLICAN").otherwise("OTHER")).drop("d", "r")


def final_groups(candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """One row for each seat, of its runoff rounds if it has any: votes by group, margin, winner, and the delta to the reported total. totals: (seat_id, round_no, stage, special, source_totals)."""
    final = F.when(F.bool_or(F.col("stage") == "runoff").over(Window.partitionBy("seat_id")), "runoff").otherwise("gen")
    rows = candidates.withColumn("final", final).where("stage = final")
    top = F.rank().over(Window.partitionBy("seat_id").orderBy(F.col("votes").desc()))
    of = lambda g: F.sum(F.when(F.col("group") == g, F.col("votes")).otherwise(0))
    sums = rows.withColumn("top", top == 1).groupBy("cycle", "seat_id").agg(
        F.first("final").alias("final"), of("DEMOCRATIC").alias("democratic"), of("REPUBLICAN").alias("republican"), F.sum("votes").alias("candidate_votes"), F.count_if("top").alias("leaders"), F.min(F.when(F.col("top"), F.col("group"))).alias("leader")
    )
    # both sides stay dealt by seat: the join has no other key
    each = totals.select("seat_id", "stage", F.explode("source_totals").alias("total"))
    reported = each.groupBy("seat_id").agg(*[F.sum(F.when(F.col("stage") == stage, F.col("total"))).alias(f"_{stage}") for stage in ("runoff", "gen")])
    given = F.when(F.col("final") == "runoff", F.col("_runoff")).otherwise(F.col("_gen"))
    d, r = F.col("democratic"), F.col("republican")
    margin = F.when((d > 0) & (r > 0), 100.0 * (d - r) / (d + r))
    delta = F.col("candidate_votes") - F.col("reported")
    return sums.join(reported, "seat_id").withColumn("reported", given).where("reported is not null").select(
        "cycle", "seat_id", "final", "democratic", "republican", (F.col("candidate_votes") - d - r).alias("third"), margin.alias("two_party_margin"), F.when(margin.isNull(), "no_democratic_and_republican_pair").alias("margin_reason"),
        F.when(F.col("leaders") == 1, F.col("leader")).alias("winner_group"), F.when(F.col("leaders") != 1, "several_winners").alias("problem"), delta.alias("delta"), (delta == 0).alias("benchmark_eligible"),
    )


def major_candidates(lines: DataFrame) -> DataFrame:
    """By round: the votes of the one candidate with a Democratic line, and of the one with a Republican line, on all their lines; and the delta to each reported total.

    A major candidate is chosen by identity, not by the sum of a party's lines; there must be exactly one. "Other"
    is nobody's identity, whatever label its lines have.
    """
    named = ~F.coalesce(identity(F.col("candidate")) == "other", F.lit(False))
    merged = lines.groupBy("cycle", *ROUND, "candidate").agg(F.sum("votes").alias("votes"), F.bool_or((F.col("party") == "D") & named).alias("d"), F.bool_or((F.col("party") == "R") & named).alias("r"), F.count("*").alias("own_lines"), F.collect_set("source_total").alias("totals"))
    of = lambda side: (F.count_if(side).alias(f"{side}_candidates"), F.when(F.count_if(side) == 1, F.sum(F.when(F.col(side), F.col("votes")))).alias(f"{side}_votes"))
    sums = merged.groupBy("cycle", *ROUND).agg(*of("d"), *of("r"), F.sum("votes").alias("votes"), F.count_if(F.col("own_lines") > 1).alias("fusions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("totals")))).alias("totals"))
    deltas = F.map_from_entries(F.transform("totals", lambda t: F.struct(t, F.col("votes") - t)))
    problem = F.when(F.col("d_candidates") != 1, "democratic_not_unique").when(F.col("r_candidates") != 1, "republican_not_unique")
    margin = F.when(problem.isNull() & (F.col("d_votes") + F.col("r_votes") > 0), 100.0 * (F.col("d_votes") - F.col("r_votes")) / (F.col("d_votes") + F.col("r_votes")))
    return sums.withColumns({"deltas": deltas, "problem": problem, "two_party_margin": margin}).drop("totals")


def winner_alias(group: Column) -> Column:
    """D, R or OTHER; what is unknown or in conflict is OTHER."""
    return F.when(group.isin("DEMOCRATIC", "D"), "D").when(group.isin("REPUBLICAN", "R"), "R").when(group.isNotNull(), "OTHER")
