r"""Secret scan: fixed patterns, and random strings found by token efficiency.

Words of language take few tokens for their characters; random strings take many.
A run of 20 or more of `[A-Za-z0-9+/_-]` with two of digits, small letters and
capitals is a random string if a tiktoken vocabulary spends a token on fewer than
`RATIO` characters of it. Known digests (hexadecimal of a usual digest length),
UUIDs, dates and identifiers (parts joined by `_`, `-`, `/` or capitals that are
words or numbers) aren't looked at, nor is what a pattern has already found. Each
test is linear in the run, and each text is swept once.

The patterns, leftmost and non-overlapping per kind over the whole text: `assign`
(a password, secret, token or API key given a value of 12 or more characters),
`access` (AKIA keys of 18 or more) and `hex` (16 or more hexadecimal digits).

A null or empty text has no spans. Repeated rows are scanned again. Other columns
are ignored. An empty table gives no rows. Positions are code points.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "random")
RATIO = 2.4

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("passw", "secret", "token", "api")

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGIT, SMALL, CAPITAL = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: Possessive throughout: no part can be read in two ways, so nothing is tried again.
_PART = r"(?:(?:[A-Z]?[a-z]{2,}+)++[0-9]{0,4}+|[A-Z]{2,}+[0-9]{0,4}+|[0-9]++)"
IDENTIFIER = re.compile(rf"{_PART}(?:[_/-]++{_PART})*+[_/-]*+")

_encodings: dict = {}


def encoding(path: str | None = None):
    """The vocabulary in a file of ranks; a worker reads it once."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def known(run: str) -> bool:
    """Digests, UUIDs and identifiers."""
    return bool(len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) or UUID.fullmatch(run) or IDENTIFIER.fullmatch(run))


def mixed(run: str) -> bool:
    """Two of digits, small letters and capitals."""
    return (DIGIT.search(run) is not None) + (SMALL.search(run) is not None) + (CAPITAL.search(run) is not None) > 1


def spans(text: str, vocabulary) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken, at, reach = sorted(x[1:] for x in found), 0, 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach, at = max(reach, taken[at][1]), at + 1
        if reach > m.start() or not mixed(m[0]) or known(m[0]):
            continue
        if len(m[0]) < RATIO * len(vocabulary.encode_ordinary(m[0])):
            found.append(("random", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def _scan(path: str | None) -> Callable:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoding(path)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t or "", vocabulary)] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return scan


def find_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, spans) of every row. vocabulary: path of a file of tiktoken ranks."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan(vocabulary), SPANS)
