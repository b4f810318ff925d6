"""Benchmark decontamination with spaced seeds.

A seed is the hash of the tokens under a fixed mask, laid at every position of a
text; positions where the mask has 0 may differ. Test seeds and training seeds
are joined on that hash. Around each hit the two texts are laid side by side on
the hit's diagonal, and the longest stretch of which at least `IDENTITY` are equal
is the overlap. It counts if it has at least `MIN_TOKENS` tokens (an item shorter
than that: nearly all of it).

Tokens are runs of bytes other than white space and ASCII punctuation, A-Z in
lower case. The benchmark is read in blocks of at most `BLOCK_TOKENS` tokens (an
item is never split), each sent to all workers and held against all documents,
so what is broadcast doesn't grow with either table (an item of more tokens is a block
of its own). An item with fewer tokens than the shortest mask has masks of its own: its
whole length, and from `WHOLE_BELOW` tokens on that with any one token left out; a shorter
one is found where all its tokens stand.

A seed that a text and an item both repeat (tables, padding) meets itself in as many
pairs as the product of its counts. Such seeds are counted by diagonal with one
correlation, and diagonals are looked at in the order of the equal tokens they have, until
none can be better: time and memory follow the texts' lengths, and the result is the same.

Null or empty texts overlap with nothing. Repeated rows and items each give
their own rows. Columns other than the ids and texts are ignored. If either
table is empty, the result is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import text_slices, utf8
from tallyframe.llm.tokens import BREAKS, windows, words

#: Weight 8 within 13 tokens or fewer; the first also finds what has no substitutions near.
MASKS = ("11111111", "1101110111", "110110010111", "1110010110011")
MIN_TOKENS = 13
IDENTITY = 0.8
WHOLE_BELOW = 5
BLOCK_TOKENS = 2_000_000
#: The workers' first filter: one byte for each of so many hash values.
SLOTS_LOG2 = 22
#: A seed is correlated if it has so many pairs for each token of the two texts; pairs are laid out so many at a time; more diagonals than FEW are put in order first.
HEAVY, PAIRS, FEW = 16, 1 << 20, 64

OVERLAPS = "doc_id long, item_id long, doc_start long, item_start long, length long, equal long, hits long"


def _places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def _short_masks(size: int) -> list[tuple[int, ...]]:
    whole = tuple(range(size))
    return [whole, *(whole[:k] + whole[k + 1 :] for k in range(size) if size >= WHOLE_BELOW)]


def _short_salt(places: tuple[int, ...]) -> int:
    """Another for each mask: a seed's name says which mask it is of."""
    return 100 + sum(1 << p for p in places)


def _seeds(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the seeds and their positions, none across rows."""
    row_end = np.repeat(first[1:], np.diff(first))
    for k, mask in enumerate(MASKS):
        seeds = windows(hashes, _places(mask), salt=k)
        at = np.flatnonzero(np.arange(len(seeds)) + len(mask) <= row_end[: len(seeds)])
        yield seeds[at], at


class Index:
    """The seeds of a block of test items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        w = words(*utf8(pa.array(texts, pa.string())), BREAKS)
        self.ids, self.hashes, self.first = np.array(ids, np.int64), w.hashes, w.first
        found = list(_seeds(w.hashes, w.first))
        sizes = np.diff(self.first)
        #: For each mask of short items the seeds under it.
        self.short: dict[tuple[int, ...], np.ndarray] = {}
        for i in np.flatnonzero((sizes > 0) & (sizes < min(map(len, MASKS)))):
            part = self.hashes[self.first[i] : self.first[i + 1]]
            for places in _short_masks(len(part)):
                seed = windows(part[places[0] :], tuple(p - places[0] for p in places), salt=_short_salt(places))[:1]
                self.short[places] = np.concatenate([self.short.get(places, seed[:0]), seed])
                found.append((seed, np.array([self.first[i] + places[0]])))
        seeds, at = np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])
        item = np.searchsorted(self.first, at, side="right") - 1
        order = np.lexsort((at, item, seeds))
        seeds, self.at, item = seeds[order], at[order], item[order]
        #: The places of one seed in one item are a group.
        self.group_begin = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (item[1:] != item[:-1])])) if len(seeds) else np.zeros(0, np.int64)
        self.group_count = np.diff(np.concatenate([self.group_begin, [len(seeds)]]))
        self.group_seed, self.group_item = seeds[self.group_begin], item[self.group_begin]
        self.slots = np.zeros(1 << SLOTS_LOG2, bool)
        self.slots[self.group_seed >> np.uint64(64 - SLOTS_LOG2)] = True

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, Places]]:
        """For each row and item that share seeds: where these stand in either, grouped by seed."""
        seeds, at = [], []
        for mask_seeds, mask_at in _seeds(hashes, first):
            some = np.flatnonzero(self.slots[mask_seeds >> np.uint64(64 - SLOTS_LOG2)])
            seeds.append(mask_seeds[some])
            at.append(mask_at[some])
        for places, known in self.short.items():
            size = places[-1] + 1 - places[0]
            whole = windows(hashes, tuple(p - places[0] for p in places), salt=_short_salt(places))
            found = np.flatnonzero(np.isin(whole, known))
            fits = found + size <= first[np.searchsorted(first, found, side="right")]
            seeds.append(whole[found[fits]])
            at.append(found[fits])
        seeds, at = np.concatenate(seeds), np.concatenate(at)
        row = np.searchsorted(first, at, side="right") - 1
        order = np.lexsort((at, seeds, row))
        seeds, at, row = seeds[order], at[order], row[order]
        begin = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (row[1:] != row[:-1])])) if len(seeds) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([begin, [len(seeds)]]))
        lo, hi = np.searchsorted(self.group_seed, seeds[begin]), np.searchsorted(self.group_seed, seeds[begin], side="right")
        n = hi - lo
        mine = np.repeat(np.arange(len(begin)), n)
        theirs = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair_row, pair_item = row[begin[mine]], self.group_item[theirs]
        order = np.lexsort((pair_item, pair_row))
        mine, theirs, pair_row, pair_item = mine[order], theirs[order], pair_row[order], pair_item[order]
        if not len(mine):
            return
        change = np.flatnonzero(np.concatenate([[True], (pair_row[1:] != pair_row[:-1]) | (pair_item[1:] != pair_item[:-1])]))
        for start, stop in zip(change, [*change[1:], len(mine)], strict=True):
            m, t = mine[start:stop], theirs[start:stop]
            yield int(pair_row[start]), int(pair_item[start]), Places(at, begin[m], count[m], self.at, self.group_begin[t], self.group_count[t])

    def overlaps(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """(row, item, start in row, start in item, length, equal, hits), the best of each row and item."""
        for r, i, places in self.hits(hashes, first):
            a, b = hashes[first[r] : first[r + 1]], self.hashes[self.first[i] : self.first[i + 1]]
            shifts, hits = places.diagonals(int(first[r]), int(self.first[i]), len(a), len(b))
            if (best := _best(a, b, shifts, hits)) is not None:
                yield r, i, *best


class Places:
    """Where two texts have the same seeds (or tokens): for each seed a stretch of positions of either."""

    def __init__(self, a: np.ndarray, a_begin: np.ndarray, a_count: np.ndarray, b: np.ndarray, b_begin: np.ndarray, b_count: np.ndarray):
        self.a, self.a_begin, self.a_count, self.b, self.b_begin, self.b_count = a, a_begin, a_count, b, b_begin, b_count

    @classmethod
    def of_tokens(cls, a: np.ndarray, b: np.ndarray) -> Places:
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        (va, fa, na), (vb, fb, nb) = (np.unique(x, return_index=True, return_counts=True) for x in (a[by_a], b[by_b]))
        _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        return cls(by_a, fa[ia], na[ia], by_b, fb[ib], nb[ib])

    def diagonals(self, a_first: int, b_first: int, a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray]:
        """The shifts (place in a less place in b) with a hit, in rising order, and how many each has.

        A seed that stands in many places of both isn't laid out pair by pair: its hits of
        all shifts are one correlation, so time and memory follow the lengths, not their product.
        """
        pairs = self.a_count * self.b_count
        wide = a_size + b_size
        heavy = pairs > HEAVY * wide
        if pairs.sum() <= wide and not heavy.any():
            shifts, hits = np.unique(self._pairs(np.flatnonzero(~heavy)) - (a_first - b_first), return_counts=True)
            return shifts, hits
        total = np.zeros(wide, np.int64)
        light = np.flatnonzero(~heavy)
        cuts = np.searchsorted(np.cumsum(pairs[light]), np.arange(PAIRS, int(pairs[light].sum()) + PAIRS, PAIRS))
        for some in np.split(light, np.unique(cuts)):
            if len(some):
                total += np.bincount(self._pairs(some) - (a_first - b_first) + b_size, minlength=wide)
        for k in np.flatnonzero(heavy):
            here, there = np.zeros(a_size), np.zeros(b_size)
            here[self.a[self.a_begin[k] : self.a_begin[k] + self.a_count[k]] - a_first] = 1
            there[self.b[self.b_begin[k] : self.b_begin[k] + self.b_count[k]] - b_first] = 1
            size = 1 << (wide - 1).bit_length()
            both = np.fft.irfft(np.fft.rfft(here, size) * np.fft.rfft(there[::-1], size), size)[: wide - 1]
            total[1:] += np.rint(both).astype(np.int64)
        found = np.flatnonzero(total)
        return found - b_size, total[found]

    def _pairs(self, seeds: np.ndarray) -> np.ndarray:
        """Place in a less place in b of each pair of hits of these seeds."""
        n = self.a_count[seeds] * self.b_count[seeds]
        which = np.repeat(np.arange(len(seeds)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        across = self.b_count[seeds][which]
        return self.a[self.a_begin[seeds][which] + k // across] - self.b[self.b_begin[seeds][which] + k % across]


def _best(a: np.ndarray, b: np.ndarray, shifts: np.ndarray, hits: np.ndarray) -> tuple | None:
    """(start in a, start in b, length, equal, hits) of the overlap with the most equal tokens, the first of such."""
    most = np.minimum(len(a) - shifts, len(b)) - np.maximum(-shifts, 0)  # equal tokens that a diagonal can have
    if len(shifts) > FEW:
        known, equal = Places.of_tokens(a, b).diagonals(0, 0, len(a), len(b))
        most = equal[np.searchsorted(known, shifts)]
    order = np.lexsort((np.maximum(-shifts, 0), np.maximum(shifts, 0), -most))
    best = None
    for k in order.tolist():
        shift = int(shifts[k])
        if best is not None and (best[3], -best[0], -best[1]) >= (int(most[k]), -max(shift, 0), -max(-shift, 0)):
            break  # no diagonal from here on can be better
        low, high = max(-shift, 0), min(len(a) - shift, len(b))
        equal = b[low:high] == a[low + shift : high + shift]
        start, stop = _longest_stretch(equal)
        found = (low + start + shift, low + start, stop - start, int(equal[start:stop].sum()), int(hits[k]))
        if stop - start >= min(MIN_TOKENS, 0.8 * len(b)) and (best is None or (found[3], -found[0], -found[1]) > (best[3], -best[0], -best[1])):
            best = found
    return best


def _longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch of which at least IDENTITY are equal, the first of them."""
    share = Fraction(str(IDENTITY))
    total = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator, 0) - share.numerator)])
    # for each end the first start whose sum is no greater: sums of whole numbers, so exact
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    stop = int(np.argmax(np.arange(len(total)) - start))
    return int(start[stop]), stop


def _search(index) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for whole in batches:
            for batch in text_slices(whole):
                w = words(*utf8(batch.column("text")), BREAKS)
                rows = list(block.overlaps(w.hashes, w.first))
                if rows:
                    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                    cols = [np.array(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[cols[0]], block.ids[cols[1]], *cols[2:])], ["doc_id", "item_id", "doc_start", "item_start", "length", "equal", "hits"])

    return search


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each document and test item that overlap: the best overlap, in tokens."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    tokens = items.agg(F.sum(F.size(F.split("text", "[^\\p{L}\\p{N}]+")))).first()[0] or 0
    blocks = -(-tokens // BLOCK_TOKENS)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null and text is not null")
    found = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toPandas().sort_values(["item_id", "text"])
        index = spark.sparkContext.broadcast(Index(part["item_id"].tolist(), part["text"].tolist()))
        found.append(docs.mapInArrow(_search(index), OVERLAPS))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], OVERLAPS)
