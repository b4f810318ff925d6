"""Text columns: identities, numbers, URLs, headers, year claims."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

AMBIGUOUS = r"(?i)\b(approximately|about|circa|various|selected|most|some)\b"


def identity(name: Column) -> Column:
    """Lower case, trimmed, inner white space as one space; null if nothing is left."""
    text = F.regexp_replace(F.trim(F.lower(name)), "\\s+", " ")
    return F.when(text != "", text)


def identity_key(name: Column) -> Column:
    """The identity of a name in any writing: Unicode's compatibility form (NFKC), case folded, white space as in `identity`.

    The JVM's functions have neither form, so names go through Arrow.
    """

    def folded(names: pa.Array) -> pa.Array:
        out = [None if n is None else " ".join(unicodedata.normalize("NFKC", n).casefold().split()) or None for n in names.to_pylist()]
        return pa.array(out, pa.string())

    return F.arrow_udf(folded, "string")(name)


def finite(text: Column) -> Column:
    """A finite number, or null."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def whole(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def url_codes(url: Column, hosts: Column | None = None) -> Column:
    """What a URL policy holds against a URL; an empty array if nothing."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    rules = {
        "missing": url.isNull() | (url == ""),
        "not_https": ~F.coalesce(url.startswith("https://"), F.lit(False)),
        "userinfo": F.contains(authority, F.lit("@")),
        "port": authority.rlike(":[0-9]*$"),
        "fragment": F.contains(url, F.lit("#")),
        "percent": F.contains(url, F.lit("%")),
        "backslash": F.contains(url, F.lit("\\")),
        "control": url.rlike("[\\x00-\\x20\\x7f]"),
    }
    if hosts is not None:
        rules["host"] = ~F.array_contains(hosts, host)
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]))


def year_claims(text: Column) -> Column:
    """(ranges, years, ambiguous): year ranges, isolated years outside them, and whether a vague word is near."""
    ranges = F.regexp_extract_all(text, F.lit(r"\b((?:18|19|20)[0-9]{2}-(?:18|19|20)[0-9]{2})\b"), F.lit(1))
    years = F.regexp_extract_all(text, F.lit(r"(?<![0-9-])((?:18|19|20)[0-9]{2})(?![0-9-])"), F.lit(1))
    return F.struct(ranges.alias("ranges"), F.array_sort(F.array_distinct(years)).alias("years"), text.rlike(AMBIGUOUS).alias("ambiguous"))


def header_facts(pairs: Column) -> Column:
    """For an array of (name, value): lower-case names, those given twice, those in several spellings."""
    names = F.transform(pairs, lambda p: F.lower(p["name"]))
    distinct = F.array_sort(F.array_distinct(names))
    spellings = lambda n: F.size(F.array_distinct(F.transform(F.filter(pairs, lambda p: F.lower(p["name"]) == n), lambda p: p["name"])))
    times = lambda n: F.size(F.filter(names, lambda x: x == n))
    return F.struct(distinct.alias("names"), F.filter(distinct, lambda n: times(n) > 1).alias("duplicates"), F.filter(distinct, lambda n: spellings(n) > 1).alias("case_conflicts"))


def sheet_column(letters: Column) -> Column:
    """The number of a spreadsheet column: A is 1, AA is 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)
