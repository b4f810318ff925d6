"""Coverage decided from free text, and the activation that follows from both sources' pins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.operators.machines import Machine

#: Words that make a claim uncertain, and what stands between the years of an interval.
UNCERTAIN = r"(?i)\b(?:planned|forthcoming|expected|anticipated|provisional|pending|future|exclude|excludes|excluded|excluding|not\s+included|not\s+covered|will\s+include)\b"
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
INTERVAL = r"(?i)(?<!\d)((?:19|20)\d{2})\s*(?:-|_|–|—|to|through|至)\s*((?:19|20)\d{2})(?!\d)"


@dataclass(frozen=True)
class Need:
    """What a source must cover, the cycles that are then taken in, and those that are set apart."""

    year: int
    cycles: tuple[int, ...]
    apart: int
    #: Coverage that ends here is known to fall short; else a lack is only unproven.
    short: int | None = None


#: The needs of the two sources.
NEEDS = {"senate": Need(2022, (2018, 2022), 2024, 2020), "president": Need(2020, (2020,), 2024)}


def claims(fields: Column) -> Column:
    """A struct of the intervals (start, end) that texts claim, and whether their claim is ambiguous.

    It is if a text has a word of doubt, if two intervals end in different years, or if a year
    after the last interval stands outside of all.
    """
    pair = lambda m: F.struct(F.left(m, F.lit(4)).cast("int").alias("start"), F.right(m, F.lit(4)).cast("int").alias("end"))
    read = lambda f: F.struct(
        F.filter(F.transform(F.regexp_extract_all(f, F.lit(INTERVAL), F.lit(0)), pair), lambda p: p["start"] <= p["end"]).alias("intervals"),
        F.transform(F.regexp_extract_all(f, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")).alias("years"),
        f.rlike(UNCERTAIN).alias("doubt"),
    )

    def judged(found: Column) -> Column:
        return once(F.flatten(F.transform(found, lambda x: x["intervals"])), lambda intervals: once(F.transform(intervals, lambda p: p["end"]), lambda ends: of(found, intervals, ends)))

    def of(found: Column, intervals: Column, ends: Column) -> Column:
        outside = F.array_except(F.flatten(F.transform(found, lambda x: x["years"])), F.concat(ends, F.transform(intervals, lambda p: p["start"])))
        last = F.array_max(ends)
        doubtful = F.exists(found, lambda x: x["doubt"]) | F.coalesce(F.exists(outside, lambda y: y > last), F.lit(False)) | (F.size(F.array_distinct(ends)) > 1)
        return F.struct(intervals.alias("intervals"), doubtful.alias("ambiguous"), last.alias("last"))

    return once(F.transform(fields, lambda f: read(F.coalesce(f, F.lit("")))), judged)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once, however often `then` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def coverage(source: Column, claimed: Column, needs: dict[str, Need] = NEEDS) -> Column:
    """A struct of status, code, confirmed_through, ingest_cycles and isolated_cycles; null for an unknown source."""
    return once(claimed, lambda c: _covered(source, c, needs))


def _covered(source: Column, claimed: Column, needs: dict[str, Need]) -> Column:
    covers = lambda year: ~claimed["ambiguous"] & F.exists(claimed["intervals"], lambda p: (p["start"] <= year) & (p["end"] >= year))
    none = F.array().cast("array<int>")
    out = F.lit(None)
    for name, need in needs.items():
        apart = covers(need.apart) | F.coalesce(claimed["last"] >= need.apart, F.lit(False)) if need.short else covers(need.apart)
        short = ~claimed["ambiguous"] & F.coalesce(claimed["last"] == need.short, F.lit(False)) if need.short else F.lit(False)
        status = F.when(covers(need.year), "confirmed").when(short, "insufficient").otherwise("unverified")
        code = F.when(covers(need.year), "COVERAGE_CONFIRMED").when(short, "SOURCE_COVERAGE_INSUFFICIENT").otherwise("SOURCE_COVERAGE_UNVERIFIED")
        found = F.struct(
            status.alias("status"),
            code.alias("code"),
            claimed["last"].alias("confirmed_through"),
            F.when(covers(need.year), F.array(*[F.lit(c) for c in need.cycles])).otherwise(none).alias("ingest_cycles"),
            F.when(covers(need.year) & apart, F.array(F.lit(need.apart))).otherwise(none).alias("isolated_cycles"),
        )
        out = F.when(source == name, found).otherwise(out)
    return out


VERDICTS = ("invalid", "confirmed", "insufficient", "unverified")


def activation_machine(sources: tuple[str, str] = ("senate", "president")) -> Machine:
    """States are what both sources' first pins have been found to be (`none` before); a second pin of a source is refused.

    Symbols are `source:verdict`.
    """
    known = ("none", *VERDICTS)
    moves = {}
    for a in known:
        for b in known:
            for v in VERDICTS:
                if a == "none":
                    moves[f"{a}/{b}", f"{sources[0]}:{v}"] = f"{v}/{b}"
                if b == "none":
                    moves[f"{a}/{b}", f"{sources[1]}:{v}"] = f"{a}/{v}"
    return Machine("none/none", moves)


def activation(state: Column) -> Column:
    """A struct of activation, official_pin_complete, reason_code and next_permitted_action from a machine's state.

    Both pins are looked at before any coverage, the first source before the second.
    """
    first, second = F.split_part(state, F.lit("/"), F.lit(1)), F.split_part(state, F.lit("/"), F.lit(2))
    pin = lambda s: F.when(s == "none", "OFFICIAL_PIN_INCOMPLETE").when(s == "invalid", "OFFICIAL_PIN_INVALID")
    lack = lambda s: F.when(s == "insufficient", "SOURCE_COVERAGE_INSUFFICIENT").when(s == "unverified", "SOURCE_COVERAGE_UNVERIFIED")
    reason = F.coalesce(pin(first), pin(second), lack(first), lack(second), F.lit("METADATA_READY"))
    ready = reason == "METADATA_READY"
    return F.struct(
        F.when(ready, "metadata_ready_for_separate_ingest_contract").otherwise("blocked_source_metadata").alias("activation"),
        (~reason.startswith("OFFICIAL_PIN")).alias("official_pin_complete"),
        reason.alias("reason_code"),
        F.when(ready, "open_separate_ingest_contract").otherwise("retry_metadata_in_new_contract").alias("next_permitted_action"),
    )
