"""Harmonic packing of tokenized documents into sequences.

A piece of r tokens is of class k if it fits k times, but not k + 1 times, into
a sequence, so capacity / (k + 1) < r <= capacity / k; the bins of class k take
k pieces, whichever they are. Each worker packs its own partition as it streams
by, with no shuffle and at most k - 1 waiting pieces a class. A full bin's gap,
capacity / (k + 1) at most, is filled with ids cut from the next long document
(or from the next of any length, once `OPEN_BINS` bins wait). What waits at the
end of a partition is laid end to end and cut at the capacity; its last part is
cut into powers of two, as those lengths need no padding.

A null or empty text is its end id alone. Rows that repeat are packed again,
each in its own pieces. Long texts are cut at the capacity and never dropped. An
empty table gives no pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyframe.llm.shared import text_slices, utf8
from tallyframe.llm.tokens import words

CAPACITY = 4096
CLASSES = 64
OPEN_BINS = 32
END_ID = 2
#: Words whose ids a worker keeps; beyond, it starts anew.
CACHED_WORDS = 1_500_000

#: Byte-level vocabularies write each byte as a character: itself if that prints, else the next one from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

#: The vocabulary's pre-tokens, where all is ASCII and in lower case (fixed by the vocabulary).
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


class WordIds:
    """Ids of texts as unsigned 32-bit integers.

    The vocabulary's pre-tokens never span white space and its text is in lower case, so
    `tokenizers` encodes each distinct word once; a worker finds it again by a 64-bit hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.known: dict[int, bytes] = {}

    def encode(self, word: bytes) -> bytes:
        """A pre-token needs the merges only; words that aren't plain enough to split here take the whole way."""
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isprintable():
            parts = ASCII_PARTS.findall(text)
        else:
            if not (text.isalpha() and text.lower() == text and is_normalized("NFC", text)):
                return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            parts = [word.decode("latin-1").translate(BYTE_CHARACTERS)]
        return array("I", [x.id for part in parts for x in self.merges.tokenize(part)]).tobytes()

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        offsets, raw = utf8(texts)
        found = words(offsets, raw, marks=True)
        distinct, at, which = np.unique(found.hashes, return_index=True, return_inverse=True)
        known, keys, data = self.known, distinct.tolist(), raw.tobytes().lower()
        for i, h in enumerate(keys):
            if h not in known:
                known[h] = self.encode(data[found.starts[at[i]] : found.ends[at[i]]])
        parts = [known[h] for h in keys]
        flat, sizes = np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        stops = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begins[which] - stops[:-1], n) + np.arange(stops[-1])]
        out = np.split(ids, stops[found.first[1:-1]])
        for i in self.special(offsets, raw):  # marks like <|endoftext|> are found in any place, and in this case only
            out[i] = np.array(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, "<u4")
        if len(known) > CACHED_WORDS:
            known.clear()
        return out

    @staticmethod
    def special(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        return np.unique(np.searchsorted(offsets, at, side="right") - 1)


class Packer:
    """Packs (doc_id, ids) as they come; `sequences` holds finished lists of (doc, start, end)."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes = capacity, classes
        self.waiting: dict[int, list] = {k: [] for k in range(1, classes + 1)}
        self.open: deque = deque()  # of [pieces, gap]
        self.sequences: list = []

    def add(self, doc: tuple, n: int) -> None:
        at = self.fill(doc, 0, n) if n > self.capacity or len(self.open) >= OPEN_BINS else 0
        while n - at >= self.capacity:
            self.sequences.append([(doc, at, at + self.capacity)])
            at += self.capacity
        if at < n:
            k = min(self.classes, self.capacity // (n - at))
            bin_ = self.waiting[k]
            bin_.append((doc, at, n))
            if len(bin_) == k:
                self.waiting[k] = []
                gap = self.capacity - sum(b - a for _, a, b in bin_)
                if gap:
                    self.open.append([bin_, gap])
                else:
                    self.sequences.append(bin_)

    def fill(self, doc: tuple, at: int, n: int) -> int:
        while self.open and at < n:
            bin_, gap = self.open[0]
            took = min(gap, n - at)
            bin_.append((doc, at, at + took))
            at += took
            if took < gap:
                self.open[0][1] = gap - took
            else:
                self.sequences.append(self.open.popleft()[0])
        return at

    def finish(self) -> None:
        rest = deque(piece for bin_ in self.waiting.values() for piece in bin_)
        while rest and self.open:
            doc, a, b = rest.popleft()
            a = self.fill(doc, a, b)
            if a < b:
                rest.appendleft((doc, a, b))
        rest.extend(piece for bin_, _ in self.open for piece in bin_)
        self.open.clear()
        self.waiting = {k: [] for k in range(1, self.classes + 1)}
        left = sum(b - a for _, a, b in rest)
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= size
            bin_ = []
            while size:
                doc, a, b = rest.popleft()
                took = min(size, b - a)
                bin_.append((doc, a, a + took))
                size -= took
                if a + took < b:
                    rest.appendleft((doc, a + took, b))
            self.sequences.append(bin_)

    def drain(self) -> list:
        done, self.sequences = self.sequences, []
        return done


def _rows(sequences: list, first: int, capacity: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(8)]
    for i, bin_ in enumerate(sequences):
        total = sum(b - a for _, a, b in bin_)
        padded = total if total & (total - 1) == 0 else capacity
        offset = 0
        for (doc_id, ids), a, b in bin_:
            for col, x in zip(cols, (doc_id, a, b - a, ids[a:b].tobytes(), len(ids), first + i, offset, padded), strict=True):
                col.append(x)
            offset += b - a
    kinds = [pa.binary() if j == 3 else pa.int64() for j in range(8)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"])


_by_path: dict[str, WordIds] = {}


def _packed(path: str, end_id: int, capacity: int, classes: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _by_path:
            _by_path[path] = WordIds(path)
        encode, packer = _by_path[path], Packer(capacity, classes)
        number = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in text_slices(batch, limit=1 << 22):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    ids = np.concatenate([ids, end])
                    packer.add((doc_id, ids), len(ids))
                done = packer.drain()
                if done:
                    yield _rows(done, number, capacity)
                    number += len(done)
        packer.finish()
        yield _rows(packer.drain(), number, capacity)

    return pack


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_length (after padding).

    tokenizer: path of a `tokenizers` file whose pre-tokens end at white space and whose text is lower-cased.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_packed(tokenizer, end_id, capacity, classes), PIECES)
