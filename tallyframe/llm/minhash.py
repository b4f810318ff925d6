"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components.

Two fixed permutations of the 32-bit integers make the whole signature: `sigma`
spreads the shingles, and coordinate k is the least value of `pi` shifted
circularly by k. 24 bands of 6 coordinates miss a pair at a similarity of 0.85
with a chance of 1e-5 (0.8: 7e-4), and bring a pair at 0.3 together with 2 %.

Documents with the same shingle set fall together first, so a group of exact
copies is one row from then on. In a bucket every member is compared with the
bucket's least member only (a star, linear in the bucket); the links that hold
make components. What a star can't see, links between members of a bucket that
are in different components, is then searched for block against block: first by
signatures alone, which says who may have a link (at least six standard
deviations below the expected number of equal coordinates), then these members
with their texts, and each link is confirmed on the full sets, in the first of
the buckets that the two share.

Null or empty texts, and texts without words, have no shingles: they are linked
with nothing. Rows with a null doc_id are left out. Rows that repeat a doc_id with
the same text are one document; rows that repeat it with different texts are
judged each by its own text. Other columns of the input are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import Scratch, text_slices, utf8, written
from tallyframe.llm.tokens import mix, shingle_sets, words

BANDS, ROWS = 24, 6
COORDINATES = BANDS * ROWS
#: Shingles, and members, of one side of a block.
BLOCK = 250_000
MEMBERS = 4096


def _scramble(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def sigma(x: np.ndarray) -> np.ndarray:
    return _scramble(x, 0x7FEB352D, 0x846CA68B)


def pi(x: np.ndarray) -> np.ndarray:
    return _scramble(x, 0x85EBCA6B, 0xC2B2AE35)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of coordinates for each set; sets may not be empty."""
    spread = sigma((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32))
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(pi(spread - np.uint32(k)), at)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    parts = found.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


SKETCH = "doc_id long, text_key long, n_shingles long, digest_a long, digest_b long, keys binary, sig binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, limit=1 << 18):
            sets = shingle_sets(words(*utf8(batch.column("text"))))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, sigs = [None] * len(sets), [None] * len(sets)
            if full:
                found = signatures([sets[i] for i in full])
                bands, low = band_keys(found), found.astype(np.uint8)
                for j, i in enumerate(full):
                    keys[i], sigs[i] = bands[j].tobytes(), low[j].tobytes()
            digest = np.array([[s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "digest_a", "digest_b", "keys", "sig"],
            )


def _band_rows(reps: DataFrame) -> DataFrame:
    """(key, band, rep, n): one row for each band of each distinct set."""
    hexed = F.hex("keys")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(hexed, i * 16 + 1, F.lit(16)))
    return reps.select(F.posexplode(keys).alias("band", "hexed"), "rep", "n").select(F.xxhash64("hexed").alias("key"), "band", "rep", "n")


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _confirm(threshold: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text_a"):
                a = shingle_sets(words(*utf8(batch.column("text_a"))))
                b = shingle_sets(words(*utf8(batch.column("text_b"))))
                keep = [_similar(x, y, threshold) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return confirm


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    with_b = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(threshold), "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the least id that can be reached over links (a, b); only ids with a link.

    Alternating large-star and small-star rounds; every round is a written table.
    """
    edges = scratch.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u")
        edges = scratch.written(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct(), "edges")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the least of its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root = 1").count() == 0


def _blocks(member: DataFrame, load: str, limit: int, scratch: Scratch) -> DataFrame:
    """Rows of member (key, rep, component, ...), dealt to (key, x, y) with `rest`.

    Members outside a bucket's largest component ("rest") meet all its members, in
    blocks with a load of about `limit` a side, however large the bucket is.
    """
    by_part = member.groupBy("key", "component").agg(F.sum(load).alias("part"))
    mixed = by_part.groupBy("key").agg(F.sum("part").alias("whole"), F.max(F.struct("part", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda amount: F.ceil(amount / limit).cast("int")
    # written, so that the join below is a stage of its own, which Spark can split where a bucket is large
    mixed = scratch.written(mixed.select("key", F.col("main.component").alias("main"), blocks(F.col("whole")).alias("na"), blocks(F.col("whole") - F.col("main.part")).alias("nr")), "mixed")
    placed = member.join(mixed, "key")
    side = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = placed.select(*member.columns, side("na", 1).alias("x"), spread("nr").alias("y"), F.lit(False).alias("rest"))
    rest = placed.where("component <> main").select(*member.columns, side("nr", 2).alias("y"), spread("na").alias("x"), F.lit(True).alias("rest"))
    return every.unionByName(rest)


def _likely(pdf: pd.DataFrame, threshold: int):
    """(i, js): the places in pdf of each row of the rest, and of members that it may be linked with."""
    mean = COORDINATES * threshold / 100
    least_equal = int(mean - 6 * (mean * (1 - threshold / 100)) ** 0.5)
    own = np.flatnonzero(~pdf["rest"])
    every = pdf.iloc[own]
    sig = np.frombuffer(b"".join(every["sig"]), np.uint8).reshape(-1, COORDINATES)
    keys = np.frombuffer(b"".join(every["keys"]), np.int64).reshape(-1, BANDS)
    comps, n = every["component"].to_numpy(), every["n"].to_numpy()
    for i in np.flatnonzero(pdf["rest"]):
        one = pdf.iloc[i]
        near = np.flatnonzero((np.minimum(n, one["n"]) * 100 >= threshold * np.maximum(n, one["n"])) & (comps != one["component"]))
        near = near[(sig[near] == np.frombuffer(one["sig"], np.uint8)).sum(axis=1) >= least_equal]
        yield i, own[near[np.argmax(keys[near] == np.frombuffer(one["keys"], np.int64), axis=1) == one["band"]]]


def _likely_members(threshold: int):
    def members(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64)]
        for i, near in _likely(pdf, threshold):
            if len(near):
                found += [near, np.array([i])]
        return pdf.iloc[np.unique(np.concatenate(found))][["key", "rep"]].drop_duplicates()

    return members


def _block_links(threshold: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(words(*utf8(pa.array(pdf["text"], pa.string()))))
        ids, comps = pdf["rep"].to_numpy(), pdf["component"].to_numpy()
        a, b = [], []
        for i, near in _likely(pdf, threshold):
            met: set[int] = set()  # one link to a component is enough
            for j in near:
                if comps[j] not in met and _similar(sets[i], sets[j], threshold):
                    met.add(comps[j])
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return block


def _texts(docs: DataFrame, ids: DataFrame, reps: DataFrame, repeats: bool) -> DataFrame:
    """(rep, text) of the sets in ids (rep)."""
    wanted = reps.join(ids, "rep", "left_semi").select("rep", "first.doc_id", "first.text_key")
    texts = docs.join(wanted, ["doc_id", "text_key"]).select("rep", "text")
    return texts.groupBy("rep").agg(F.min("text").alias("text")) if repeats else texts


def near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for each document; text_key is xxhash64(text).

    Documents are linked if 100 * intersection >= threshold * union of their sets of
    5-word shingles (A-Z lower-cased; with fewer words, the whole sequence).
    component_id is the least doc_id that can be reached; kept is true for that one.
    """
    docs = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    digest = ["n_shingles", "digest_a", "digest_b"]
    with Scratch(docs.sparkSession) as scratch:
        sketch = scratch.written(docs.mapInArrow(_sketch, SKETCH), "sketch")
        repeats = not sketch.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
        sets = sketch.where("n_shingles > 0").groupBy(*digest).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("keys").alias("keys"), F.min("sig").alias("sig"))
        reps = scratch.written(sets.select(F.monotonically_increasing_id().alias("rep"), F.col("n_shingles").alias("n"), "digest_a", "digest_b", "first", "keys", "sig"), "reps")
        rows = _band_rows(reps)
        hubs = scratch.written(rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1"), "hubs")
        shared = scratch.written(rows.join(hubs, "key"), "shared")
        star = shared.where(f"rep <> hub.rep and 100 * least(n, hub.n) >= {threshold} * greatest(n, hub.n)").select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
        star = scratch.written(star, "star")
        texts = scratch.written(_texts(docs, star.select(F.col("a").alias("rep")).union(star.select("b")).distinct(), reps, repeats), "texts")
        links = scratch.written(_confirmed(star, texts, threshold), "links")
        comps, roots = scratch.written(components(links, scratch), "components"), None
        # links that no hub has seen; a bucket of two is done
        placed = shared.where("size > 2").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("component"))
        placed = scratch.written(placed, "placed")
        held = _blocks(placed.withColumn("one", F.lit(1)), "one", MEMBERS, scratch).join(reps.select("rep", "keys", "sig"), "rep")
        likely = scratch.written(held.groupBy("key", "x", "y").applyInPandas(_likely_members(threshold), "key long, rep long").distinct(), "likely")
        if not likely.isEmpty():
            member = placed.join(likely, ["key", "rep"]).join(reps.select("rep", "keys", "sig"), "rep").join(_texts(docs, likely.select("rep").distinct(), reps, repeats), "rep")
            more = scratch.written(_blocks(member, "n", BLOCK, scratch).groupBy("key", "x", "y").applyInPandas(_block_links(threshold), "a long, b long").distinct(), "more")
            if not more.isEmpty():
                name = lambda side: comps.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
                joined = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
                roots = components(joined, scratch)
        first = reps.select("rep", F.col("n").alias("n_shingles"), "digest_a", "digest_b", F.col("first.doc_id").alias("least"))
        linked = first.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        if roots is not None:
            linked = linked.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")
        named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(*digest, "component_id")
        out = sketch.select("doc_id", "text_key", *digest).join(named, digest, "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        return written(out.withColumn("kept", F.col("doc_id") == F.col("component_id")), "near-duplicates")
