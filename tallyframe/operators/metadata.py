"""Nested metadata as VARIANT: pins taken from version records, and what a contract holds against a pin.

Documents have any shape; nothing is cast to see whether it fits. `kind` names a value's JSON type,
fields are read by path, and each thing that is missing, doubled or of the wrong type gives a code of its
own, all at once. A document that isn't JSON (doubled keys make it none) has the code `invalid_json`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.operators.contracts import forbidden_keys
from tallyframe.operators.decisions import once
from tallyframe.operators.gates import failure_codes

#: The closed key sets of a pin, checksum lengths, and keys that no pin may have at any depth.
PIN_FIELDS = "coverage_evidence dataset_id dataset_scope dataset_title doi files guestbook_id license metadata_url pin_status release_time source_id version".split()
FILE_FIELDS = "checksum_type checksum_value content_type datafile_url_template file_id filename filesize guestbook_id representation representation_evidence restricted".split()
EVIDENCE_FIELDS = "checksum_scope file_identity original_filename source".split()
HEX_LENGTHS = {"MD5": 32, "SHA-1": 40, "SHA-256": 64, "SHA-512": 128}
RESULT_KEYS = "candidate candidates winner winners vote votes vote_count margin actual_margin brier crps delta probability probabilities score scores election_results".split()
VERSION = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"
INSTANT = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)$"


# ---- canonical addresses


def versions_url(host: str, doi: Column) -> Column:
    return F.concat(F.lit(f"https://{host}/api/datasets/:persistentId/versions?persistentId="), F.url_encode(F.concat(F.lit("doi:"), doi)))


def version_metadata_url(host: str, doi: Column, version: Column) -> Column:
    """Of a numeric version; null for any other."""
    url = F.concat(F.lit(f"https://{host}/api/datasets/:persistentId/versions/"), version, F.lit("?persistentId="), F.url_encode(F.concat(F.lit("doi:"), doi)))
    return F.when(version.rlike(VERSION), url)


def guestbook_url(host: str, guestbook: Column) -> Column:
    return F.when(guestbook > 0, F.concat(F.lit(f"https://{host}/api/guestbooks/"), guestbook.cast("string")))


def original_data_url(host: str, file_id: Column) -> Column:
    return F.when(file_id > 0, F.concat(F.lit(f"https://{host}/api/access/datafile/"), file_id.cast("string"), F.lit("?format=original")))


# ---- values of a VARIANT


def at(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID (JSON's null); null where there is nothing."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit(""))


def string(v: Column, path: str = "$") -> Column:
    """The text at a path, null if it is anything else."""
    return F.when(kind(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def strict(v: Column, path: str = "$") -> Column:
    """The text at a path if it isn't empty and has no white space around it."""
    return once(string(v, path), lambda text: F.when((text != "") & text.rlike(r"^\S(?s:.*)$") & text.rlike(r"(?s)\S\z"), text))


def whole(v: Column, path: str = "$") -> Column:
    """The whole number at a path, null if it is anything else."""
    return F.when(kind(at(v, path)) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def items(v: Column, path: str = "$") -> Column:
    """The array at a path, null if it is anything else."""
    return F.when(kind(at(v, path)) == "ARRAY", F.try_variant_get(v, path, "array<variant>"))


def members(v: Column, path: str = "$") -> Column:
    """The object at a path as a map, null if it is anything else."""
    return F.when(kind(at(v, path)) == "OBJECT", F.try_variant_get(v, path, "map<string,variant>"))


def _empty(v: Column) -> Column:
    return v.isNull() | F.to_json(v).isin("null", '""', "[]", "{}")


# ---- pins from version records


def records(document: Column) -> Column:
    """The version objects of an envelope: its data as a list, its data.datasetVersion, or its data."""
    data = items(document, "$.data")
    one = F.when(kind(at(document, "$.data.datasetVersion")) == "OBJECT", F.array(at(document, "$.data.datasetVersion"))).when(kind(at(document, "$.data")) == "OBJECT", F.array(at(document, "$.data")))
    found = F.coalesce(data, one)
    return F.when((F.size(found) > 0) & F.forall(found, lambda x: kind(x) == "OBJECT"), found)


def metadata_field(record: Column, name: str) -> Column:
    """A record's own field unless it is empty, else the first of its citation block's fields with this name."""
    cited = F.filter(items(record, "$.metadataBlocks.citation.fields"), lambda x: string(x, "$.typeName") == name)
    return once(at(record, f"$.{name}"), lambda direct: F.when(~_empty(direct), direct).otherwise(at(F.get(cited, 0), "$.value")))


def scope_text(value: Column) -> Column:
    """A strict text as it is; of a list the texts in it and, two levels deep, in its objects (by key), trimmed and joined by ` | `."""
    said = lambda x: F.trim(F.try_variant_get(x, "$", "string"))
    texts = lambda xs: F.filter(F.transform(F.filter(xs, lambda x: kind(x) == "STRING"), said), lambda t: t != "")
    values = lambda x: F.map_values(F.try_variant_get(x, "$", "map<string,variant>"))
    inner = lambda x: F.when(kind(x) == "OBJECT", texts(values(x))).otherwise(texts(F.array(x)))
    each = lambda x: F.when(kind(x) == "OBJECT", F.flatten(F.transform(values(x), inner))).otherwise(texts(F.array(x)))
    listed = F.array_join(F.flatten(F.transform(items(value), each)), " | ")
    return F.coalesce(strict(value), F.nullif(listed, F.lit("")))


def pin_parts(document: Column, version: Column, names: Column) -> dict[str, Column]:
    """Columns to be added one after the other: the record of a version, its one file among the names, and their parts."""
    major, minor = F.split_part(version, F.lit("."), F.lit(1)), F.split_part(version, F.lit("."), F.lit(2))
    same = lambda r: F.coalesce((whole(r, "$.versionNumber").cast("string") == major) & (whole(r, "$.versionMinorNumber").cast("string") == minor), F.lit(False))
    file = lambda w: F.when(at(w, "$.dataFile").isNotNull(), at(w, "$.dataFile")).otherwise(w)
    original = lambda w: F.coalesce(at(w, "$.originalFile"), at(file(w), "$.originalFile"))
    named = lambda w: (kind(w) == "OBJECT") & (kind(file(w)) == "OBJECT") & (F.array_contains(names, string(file(w), "$.filename")) | F.array_contains(names, string(original(w), "$.filename")))
    one = lambda xs: F.when(F.size(xs) == 1, F.get(xs, 0))
    record, wrapper, data, first = F.col("record"), F.col("wrapper"), F.col("data_file"), F.col("original")
    scope = F.coalesce(*[once(metadata_field(record, n), lambda v: F.when(~_empty(v), v)) for n in ("datasetScope", "dsDescription", "subtitle")])
    return {
        "document": document,
        "matches": F.filter(records(F.col("document")), same),
        "record": one(F.col("matches")),
        "chosen": F.filter(items(record, "$.files"), lambda w: F.coalesce(named(w), F.lit(False))),
        "wrapper": one(F.col("chosen")),
        "data_file": file(wrapper),
        "original": original(wrapper),
        "title": strict(metadata_field(record, "title")),
        "scope": once(scope, scope_text),
        "guestbook": F.coalesce(at(data, "$.guestbookId"), at(record, "$.guestbookId")),
        "restricted": F.coalesce(at(wrapper, "$.restricted"), at(data, "$.restricted")),
        "codes": failure_codes(
            {
                "invalid_json": F.col("document").isNull(),
                "status": F.coalesce(string(F.col("document"), "$.status") != "OK", F.lit(True)),
                "no_version_objects": records(F.col("document")).isNull(),
                "version": F.coalesce(F.size("matches") != 1, F.lit(True)),
                "not_released": F.coalesce(string(record, "$.versionState") != "RELEASED", F.lit(True)),
                "title": F.col("title").isNull(),
                "scope": F.col("scope").isNull(),
                "license": kind(at(record, "$.license")).eqNullSafe(F.lit("OBJECT")) == F.lit(False),
                "files": items(record, "$.files").isNull(),
                "file": F.coalesce(F.size("chosen") != 1, F.lit(True)),
                "original": kind(first).eqNullSafe(F.lit("OBJECT")) == F.lit(False),
                "checksum": kind(at(first, "$.checksum")).eqNullSafe(F.lit("OBJECT")) == F.lit(False),
            }
        ),
    }


def pin_json(host: str, source: Column, doi: Column, version: Column) -> Column:
    """The pin of a row with the columns of pin_parts, as JSON text."""
    record, data, first = F.col("record"), F.col("data_file"), F.col("original")
    named = {
        "coverage_evidence": F.struct(F.array(F.concat(F.lit("dataset_title="), "title"), F.concat(F.lit("dataset_scope="), "scope"), F.concat(F.lit("filename="), string(first, "$.filename"))).alias("fields"), F.lit("official_metadata").alias("source")),
        "dataset_id": at(record, "$.datasetId"),
        "dataset_scope": F.col("scope"),
        "dataset_title": F.col("title"),
        "doi": doi,
        "files": F.array(
            F.struct(
                at(first, "$.checksum.type").alias("checksum_type"),
                at(first, "$.checksum.value").alias("checksum_value"),
                at(first, "$.contentType").alias("content_type"),
                original_data_url(host, whole(data, "$.id")).alias("datafile_url_template"),
                at(data, "$.id").alias("file_id"),
                at(first, "$.filename").alias("filename"),
                at(first, "$.filesize").alias("filesize"),
                F.col("guestbook").alias("guestbook_id"),
                F.lit("original").alias("representation"),
                F.struct(F.lit("uploaded_original").alias("checksum_scope"), F.lit("uploaded_original").alias("file_identity"), at(first, "$.filename").alias("original_filename"), F.lit("official_metadata").alias("source")).alias("representation_evidence"),
                F.col("restricted").alias("restricted"),
            )
        ),
        "guestbook_id": F.col("guestbook"),
        "license": F.struct(at(record, "$.license.name").alias("name"), at(record, "$.license.uri").alias("uri")),
        "metadata_url": version_metadata_url(host, doi, version),
        "pin_status": F.lit("officially_pinned"),
        "release_time": at(record, "$.releaseTime"),
        "source_id": source,
        "version": version,
    }
    return F.to_json(F.struct(*[c.alias(k) for k, c in named.items()]), {"ignoreNullFields": "false"})


# ---- the contract of a pin


def _closed(v: Column, fields: list[str], path: str = "$") -> Column:
    return F.coalesce(F.array_sort(F.map_keys(members(v, path))) == F.array(*[F.lit(f) for f in sorted(fields)]), F.lit(False))


def _guestbook(v: Column, path: str) -> Column:
    return F.coalesce(kind(at(v, path)) == "VOID", F.lit(True)) | F.coalesce(whole(v, path) > 0, F.lit(False))


def pin_codes(text: Column, pin: Column, host: str, dois: dict[str, str], official: bool = True) -> Column:
    """All that is wrong with a pin: text, and the same as VARIANT; dois: the fixed identifier of each source."""
    return once(pin, lambda v: once(F.get(items(v, "$.files"), 0), lambda file: _pin_codes(text, v, file, host, dois, official)))


def _pin_codes(text: Column, pin: Column, file: Column, host: str, dois: dict[str, str], official: bool) -> Column:
    doi = F.element_at(F.create_map(*[F.lit(x) for kv in dois.items() for x in kv]), string(pin, "$.source_id"))
    checksum = F.element_at(F.create_map(*[F.lit(x) for kv in HEX_LENGTHS.items() for x in kv]), F.upper(strict(file, "$.checksum_type")))
    digest = F.lower(strict(file, "$.checksum_value"))
    main_type = F.lower(F.trim(F.split_part(strict(file, "$.content_type"), F.lit(";"), F.lit(1))))
    fields = items(pin, "$.coverage_evidence.fields")
    dataset_guestbook, own_guestbook = whole(pin, "$.guestbook_id"), whole(file, "$.guestbook_id")
    states = ("officially_pinned",) if official else ("metadata_candidate", "officially_pinned")
    holds = {
        "invalid_json": pin.isNotNull(),
        "fields": _closed(pin, PIN_FIELDS),
        "result_key": F.size(forbidden_keys(F.translate(text, "-", "_"), RESULT_KEYS)) == 0,
        "source": doi.isNotNull(),
        "doi": string(pin, "$.doi") == doi,
        "pin_status": string(pin, "$.pin_status").isin(*states),
        "dataset_id": whole(pin, "$.dataset_id") > 0,
        "version": strict(pin, "$.version").rlike(VERSION),
        "release_time": strict(pin, "$.release_time").rlike(INSTANT) & F.try_to_timestamp(strict(pin, "$.release_time")).isNotNull(),
        "title": strict(pin, "$.dataset_title").isNotNull(),
        "scope": strict(pin, "$.dataset_scope").isNotNull(),
        "license": _closed(pin, ["name", "uri"], "$.license") & strict(pin, "$.license.name").isNotNull() & strict(pin, "$.license.uri").rlike(r"^https://[^/?#:@]"),
        "guestbook": _guestbook(pin, "$.guestbook_id"),
        "metadata_url": string(pin, "$.metadata_url") == version_metadata_url(host, doi, strict(pin, "$.version")),
        "files": F.size(items(pin, "$.files")) == 1,
        "file_fields": _closed(file, FILE_FIELDS),
        "file_id": whole(file, "$.file_id") > 0,
        "filename": strict(file, "$.filename").isNotNull(),
        "filesize": whole(file, "$.filesize") >= 0,
        "checksum": (F.length(digest) == checksum) & digest.rlike("^[0-9a-f]+$"),
        "content_type": ~main_type.isin("text/html", "application/xhtml+xml"),
        "restricted": F.when(kind(at(file, "$.restricted")) == "BOOLEAN", ~F.try_variant_get(file, "$.restricted", "boolean")),
        "file_guestbook": _guestbook(file, "$.guestbook_id") & F.when(dataset_guestbook.isNotNull(), F.coalesce(own_guestbook == dataset_guestbook, F.lit(False))).otherwise(True),
        "representation": string(file, "$.representation") == "original",
        "evidence": _closed(file, EVIDENCE_FIELDS, "$.representation_evidence")
        & (string(file, "$.representation_evidence.source") == "official_metadata")
        & (string(file, "$.representation_evidence.file_identity") == "uploaded_original")
        & (string(file, "$.representation_evidence.checksum_scope") == "uploaded_original")
        & (string(file, "$.representation_evidence.original_filename") == strict(file, "$.filename")),
        "url_template": string(file, "$.datafile_url_template") == original_data_url(host, whole(file, "$.file_id")),
        "coverage": _closed(pin, ["fields", "source"], "$.coverage_evidence")
        & (string(pin, "$.coverage_evidence.source") == "official_metadata")
        & (F.size(fields) > 0)
        & F.forall(fields, lambda x: strict(x).isNotNull())
        & (F.size(F.array_distinct(F.transform(fields, lambda x: string(x)))) == F.size(fields)),
    }
    return failure_codes({code: ~F.coalesce(good, F.lit(False)) for code, good in holds.items()})
