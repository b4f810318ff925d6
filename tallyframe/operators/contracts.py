"""Contracts of records: registries, closed keys, lineage, responses, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.gates import failure_codes


def registry_codes(values: DataFrame, registry: DataFrame, feature: str = "feature") -> DataFrame:
    """Feature values (feature, value, available_at, as_of, predictor) with what the registry holds against them.

    registry: (feature, minimum, maximum, predictor_allowed), a stated dimension.
    """
    named = registry.select(F.col("feature").alias("_f"), "minimum", "maximum", "predictor_allowed")
    joined = values.join(F.broadcast(named), F.col(feature) == F.col("_f"), "left")
    known = F.col("_f").isNotNull()
    rules = {
        "unknown_feature": ~known,
        "not_finite": F.isnan("value") | F.col("value").isNull(),
        "below_minimum": known & F.coalesce(F.col("value") < F.col("minimum"), F.lit(False)),
        "above_maximum": known & F.coalesce(F.col("value") > F.col("maximum"), F.lit(False)),
        "known_too_late": F.col("available_at") > F.col("as_of"),
        "not_a_predictor": known & F.col("predictor") & ~F.coalesce("predictor_allowed", F.lit(False)),
    }
    return joined.withColumn("failure_codes", failure_codes(rules)).drop("_f", "minimum", "maximum", "predictor_allowed")


def lineage_codes(entries: DataFrame) -> DataFrame:
    """Lineage (test_cycle, office, source_cycle, source_office) by test cycle: what breaks "past only, same office, once"."""
    by_fold = entries.groupBy("test_cycle", "office").agg(
        F.count("*").alias("entries"),
        F.count_distinct("source_cycle", "source_office").alias("sources"),
        F.count_if(F.col("source_cycle") >= F.col("test_cycle")).alias("not_past"),
        F.count_if(F.col("source_office") != F.col("office")).alias("other_office"),
    )
    return by_fold.withColumn("failure_codes", failure_codes({"not_past": F.col("not_past") > 0, "other_office": F.col("other_office") > 0, "repeated": F.col("sources") < F.col("entries")}))


def constant_within(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, variants): groups whose columns aren't the same in all rows."""
    return rows.groupBy(by).agg(F.count_distinct(F.struct(*columns)).alias("variants")).where("variants > 1")


def unexpected_keys(document: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON object that a closed contract doesn't name."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(document), F.expr("cast(array() as array<string>)")), F.array(*[F.lit(k) for k in allowed])))


def forbidden_keys(document: Column, words: list[str]) -> Column:
    """Keys at any depth of a JSON text that name an outcome."""
    keys = F.transform(F.regexp_extract_all(document, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)), lambda k: F.lower(k))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.array_contains(F.array(*[F.lit(w) for w in words]), k))))


def admissible(rows: DataFrame, cut_off: str) -> Column:
    """Codes of a protocol input: no outcome, known in time, a known office, a content hash."""
    return failure_codes(
        {
            "outcome": F.col("is_outcome"),
            "after_cut_off": F.col("available_at") > F.lit(cut_off).cast("timestamp"),
            "office": ~F.lower("office").isin("house", "senate"),
            "hash": ~F.col("sha256").rlike("^[0-9a-f]{64}$"),
        }
    )


def response_failure(status: Column, requested: Column, final: Column, content_type: Column, length: Column, body: Column, types: list[str], limit: int) -> Column:
    """The first thing wrong with a fetched response, or null."""
    declared = length.try_cast("long")
    kind = F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))
    return (
        F.when(~requested.startswith("https://"), "url_not_allowed")
        .when(status != 200, "status_not_allowed")
        .when(~final.eqNullSafe(requested), "final_url_mismatch")
        .when(length.isNotNull() & ~length.rlike("^(0|[1-9][0-9]*)$"), "content_length_invalid")
        .when((declared > limit) | (body > limit), "body_limit_exceeded")
        .when(~F.coalesce(kind.isin(*types), F.lit(False)), "content_type_mismatch")
    )


def source_audit(rows: DataFrame, by: str, checks: dict[str, Column]) -> DataFrame:
    """By group: rows, each check over all of them, and all checks; a bad group blocks only itself."""
    out = rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.bool_and(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    whole = F.lit(True)
    for name in checks:
        whole = whole & F.col(name)
    return out.withColumn("passed", whole)


def prefix_digest(rows: DataFrame, batch: str, value: Column) -> DataFrame:
    """(batch, rows, digest) of an append-only ledger: an order-free digest for each batch.

    A published batch is intact if its digest is the manifest's; batches are checked on their own.
    """
    h = F.conv(F.substring(F.sha2(value, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(batch).agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("digest"))
