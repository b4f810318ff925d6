"""Records that come in several shapes, read as VARIANT: feature registries, values, margins, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.operators.gates import failure_codes
from tallyframe.operators.metadata import at, items, kind, members, string


def number(v: Column, path: str = "$") -> Column:
    """The finite number at a path; null if it is anything else (true and "1" are no numbers)."""
    found = F.when(kind(at(v, path)).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, path, "double"))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def feature_value(row: Column, feature: str) -> Column:
    """A feature's value, given as a number or as an object with `value`."""
    path = f"$.feature_values.{feature}"
    return F.when(kind(at(row, path)) == "OBJECT", number(row, f"{path}.value")).otherwise(number(row, path))


def actual_margin(row: Column) -> Column:
    return number(row, "$.actual_result.democratic_margin")


def finite_margin(row: Column) -> Column:
    """A struct of the margin, and whether what stands in its place is no finite number (nothing and null are no fault)."""
    there = at(row, "$.two_party_margin")
    margin = number(row, "$.two_party_margin")
    return F.struct(margin.alias("margin"), (there.isNotNull() & (kind(there) != "VOID") & margin.isNull()).alias("broken"))


def race_key(row: Column) -> Column:
    """A struct of race_id, cycle and horizon (empty if there is none)."""
    cycle = F.when(kind(at(row, "$.cycle")).isin("BIGINT", "STRING"), F.try_variant_get(row, "$.cycle", "int"))
    return F.struct(F.try_variant_get(row, "$.race_id", "string").alias("race_id"), cycle.alias("cycle"), F.coalesce(F.try_variant_get(row, "$.forecast_horizon", "string"), F.lit("")).alias("horizon"))


def registry_entries(document: Column) -> Column:
    """(id, spec) of a registry: an object with `features`, a list, or an object of id -> spec. Ids are `id`, else `name`, trimmed; null where there is none."""
    own = lambda x: F.nullif(F.trim(F.when(at(x, "$.id").isNotNull(), string(x, "$.id")).otherwise(string(x, "$.name"))), F.lit(""))
    listed = F.when(kind(at(document, "$.features")).isNotNull(), items(document, "$.features")).otherwise(items(document))
    from_list = F.transform(listed, lambda x: F.struct(own(x).alias("id"), x.alias("spec")))
    by_id = F.when(at(document, "$.features").isNull(), F.map_entries(members(document)))
    from_map = F.transform(by_id, lambda e: F.struct(F.nullif(F.trim(e["key"]), F.lit("")).alias("id"), e["value"].alias("spec")))
    return F.coalesce(from_list, from_map)


def registry_codes(document: Column) -> Column:
    """`not_a_registry`, `empty`, `entry_not_an_object`, `no_id`, `duplicate_id`."""
    entries = registry_entries(document)
    ids = F.filter(F.transform(entries, lambda e: e["id"]), lambda i: i.isNotNull())
    whole = F.coalesce(F.size(entries) > 0, F.lit(False))
    some = lambda bad: whole & F.coalesce(F.exists(entries, bad), F.lit(False))
    return failure_codes(
        {
            "not_a_registry": entries.isNull(),
            "empty": entries.isNotNull() & ~whole,
            "entry_not_an_object": some(lambda e: kind(e["spec"]) != "OBJECT"),
            "no_id": some(lambda e: (kind(e["spec"]) == "OBJECT") & e["id"].isNull()),
            "duplicate_id": whole & (F.size(F.array_distinct(ids)) < F.size(ids)),
        }
    )
