"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

The text a model sees is its words, A-Z in lower case, each followed by a space,
and one end mark. Every byte is predicted from the five before it. The trie of
contexts is a table: all 6-byte strings of the training documents with their
counts, from which the counts of every shorter context follow.

A symbol met in the longest known context has probability (c - `ESCAPE`) / n
there; else the model escapes, with probability `ESCAPE` d / n (d: distinct
symbols met), to the context without its oldest byte, where the symbols met above
are excluded from n and d. Below the empty context every byte left has the same chance. All counts
are of training documents; scores are of all documents.

Words and byte strings are counted over the whole corpus and stay tables. Only
the most frequent ones, `HEAD` of each at most and `SHARE` of all occurrences,
are sent to the workers, which sum up what they find there. The rest of a document's strings and words become
rows (doc_id, key, count) and are joined with the full tables, so no score
depends on what is in the head.

A null or empty text is its end mark alone. A null doc_id counts as the empty
text. Rows that repeat are trained on and scored again. Other columns are
ignored. An empty table gives no rows; with no training documents every byte and
word is unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import Scratch, text_slices, utf8, written
from tallyframe.llm.tokens import LOWER, Words, words

ORDER = 5
#: What each symbol of a context gives to the escape; 1/2 is the known method D. Of 0.2, 0.3, 0.4 and 0.5, 0.3 scored best on fold 1 when folds 2 to 9 of the small table were learnt from and fold 0 was left out.
ESCAPE = 0.3
END = 0x0A
SPACE = 0x20
SMOOTHING = 0.1
HEAD = 1 << 20
#: The head goes no further than this share of all occurrences, so the tables do the same share of the work at every size.
SHARE = 0.99
FOLDS = 10
GRAM, WORD = 0, 1


def grams(w: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ORDER + 1 bytes that end at each symbol, as integers; row i has those from first[i] on."""
    rows, n = len(w.first) - 1, w.ends - w.starts
    row = np.repeat(np.arange(rows), np.diff(w.first))
    pad = ORDER + 1  # in each row: ORDER end marks of history, its words, its end mark
    base = np.concatenate([[0], np.cumsum(n + 1)])
    begins = base[:-1] + row * pad + ORDER
    out = np.full(int(base[-1]) + rows * pad, END, np.uint8)
    inside = np.repeat(begins - w.starts, n) + (at := _ranges(w.starts, n))
    out[inside] = LOWER[raw[at]]
    out[begins + n] = SPACE
    keys = np.zeros(len(out) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        keys <<= np.uint64(8)
        keys |= out[k : len(out) - ORDER + k]
    first = base[w.first] + np.arange(rows + 1) * pad
    size = np.diff(first) - ORDER
    return keys[_ranges(first[:-1], size)], np.concatenate([[0], np.cumsum(size)])


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + n[0] - 1, starts[1], ..."""
    stops = np.cumsum(n)
    return np.repeat(starts - stops + n, n) + np.arange(stops[-1] if len(stops) else 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, limit=1 << 20):
            offsets, raw = utf8(batch.column("text"))
            w = words(offsets, raw)
            for kind, keys in ((GRAM, grams(w, raw)[0]), (WORD, w.hashes)):
                distinct, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(distinct.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "c"])


class Table:
    """Values of 64-bit keys, by open addressing: looked up many at a time. No value is 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = np.flatnonzero(self.values[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where unknown), and which keys are unknown."""
        at = self.slot(keys)
        values = self.values[at]
        left = np.flatnonzero((self.keys[at] != keys) & (values != 0))
        values[left], at = 0, at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there, same = self.values[at], self.keys[at] == keys[left]
            values[left[same]] = there[same]
            on = ~same & (there != 0)
            left, at = left[on], at[on]
        return values, values == 0


SCORED = "row long, doc_id long, kind int, key long, c long, n_tokens long, n_known long, base double, score double"


def _score(heads) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_gram, by_word = heads.value[GRAM], heads.value[WORD]
        for whole in batches:
            for batch in text_slices(whole, limit=1 << 18):
                ids = batch.column("row").to_numpy(zero_copy_only=False)
                offsets, raw = utf8(batch.column("text"))
                w = words(offsets, raw)
                n_tokens, sums, rest = np.diff(w.first) + 1, {}, []
                for kind, keys, first, table in ((WORD, w.hashes, w.first, by_word), (GRAM, *grams(w, raw), by_gram)):
                    values, missing = table.find(keys)
                    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
                    lost = np.concatenate([[0], np.cumsum(missing)])
                    sums[kind] = (total[first[1:]] - total[first[:-1]], np.diff(first) - (lost[first[1:]] - lost[first[:-1]]))
                    at = np.flatnonzero(missing)
                    pairs = np.stack([np.searchsorted(first, at, side="right") - 1, keys[at].view(np.int64)])
                    if len(at):
                        pairs, n = np.unique(pairs, axis=1, return_counts=True)
                        rest.append((ids[pairs[0]], np.full(len(n), kind, np.int32), pairs[1], n))
                yield _scored(ids, batch.column("doc_id"), None, None, None, n_tokens, sums[WORD][1], sums[WORD][0], sums[GRAM][0])
                for row, kind, key, n in rest:
                    yield _scored(row, None, kind, key, n, None, None, None, None)

    return score


def _scored(row: np.ndarray, *cols: np.ndarray | None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    arrays = [pa.nulls(len(row), k) if c is None else (c if isinstance(c, pa.Array) else pa.array(c)).cast(k) for c, k in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *arrays], ["row", "doc_id", "kind", "key", "c", "n_tokens", "n_known", "base", "score"])


class Trie:
    """counts[j]: (key, c) of the strings of j + 1 bytes; contexts[j]: (key, n, d, above) of those of j bytes.

    above: how often the symbols met in a context occur in the context one byte shorter.
    """

    def __init__(self, strings: DataFrame, scratch: Scratch):
        self.counts = {ORDER: strings}
        for j in range(ORDER - 1, -1, -1):
            shorter = self.counts[j + 1].groupBy(_last("key", j + 1).alias("key")).agg(F.sum("c").alias("c"))
            self.counts[j] = scratch.written(shorter, f"order-{j}")
        self.contexts = {}
        for j in range(ORDER, -1, -1):
            seen = self.counts[j].select("key", "c", F.shiftright("key", 8).alias("context"))
            if j:
                lower = self.counts[j - 1].select(F.col("key").alias("low"), F.col("c").alias("c_low"))
                seen = seen.join(lower, _last("key", j) == F.col("low"))
            else:
                seen = seen.withColumn("c_low", F.col("c"))
            made = seen.groupBy("context").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("c_low").alias("above"))
            self.contexts[j] = scratch.written(made.withColumnRenamed("context", "key"), f"contexts-{j}")

    def seen(self) -> DataFrame:
        """(key, c, p) of the strings met in training."""
        n = self.contexts[ORDER].select(F.col("key").alias("context"), "n")
        return self.counts[ORDER].join(n, F.shiftright("key", 8) == F.col("context")).select("key", "c", F.log10((F.col("c") - ESCAPE) / F.col("n")).alias("p"))

    def scored(self, keys: DataFrame) -> DataFrame:
        """(key, p) of any strings of ORDER + 1 bytes, from the longest known context down."""
        state = keys.select("key", F.lit(0.0).alias("p"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("x_n"), F.lit(0).cast("long").alias("x_d"))
        for j in range(ORDER, -1, -1):
            context = self.contexts[j].select(F.col("key").alias("k1"), "n", "d", "above")
            count = self.counts[j].select(F.col("key").alias("k2"), "c")
            state = state.withColumns({"at": F.shiftright(_last("key", j + 1), 8), "with": _last("key", j + 1)})
            state = state.join(context, F.col("at") == F.col("k1"), "left").join(count, F.col("with") == F.col("k2"), "left")
            n, d = F.col("n") - F.col("x_n"), F.col("d") - F.col("x_d")
            step = F.when(F.col("done") | F.col("n").isNull() | (n <= 0), 0.0).when(F.col("c").isNotNull(), F.log10((F.col("c") - ESCAPE) / n)).otherwise(F.log10(ESCAPE * d / n))
            known = F.col("n").isNotNull()
            state = state.select(
                "key",
                (F.col("p") + step).alias("p"),
                (F.col("done") | F.col("c").isNotNull()).alias("done"),
                F.when(known, F.col("above")).otherwise(F.col("x_n")).alias("x_n"),
                F.when(known, F.col("d")).otherwise(F.col("x_d")).alias("x_d"),
            )
        flat = -F.log10(F.greatest(F.lit(256) - F.col("x_d"), F.lit(1)))
        return state.select("key", (F.col("p") + F.when(F.col("done"), 0.0).otherwise(flat)).alias("p"))


def _last(key: str, n: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _head(table: DataFrame) -> DataFrame:
    """The most frequent keys that make up SHARE of all occurrences, HEAD keys at most."""
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = sorted(table.groupBy(step.alias("step")).agg(F.count("*"), F.sum("c")).collect(), reverse=True)
    wanted = SHARE * sum(occurrences for _, _, occurrences in steps)
    held, seen, least = 0, 0, None
    for at, n, occurrences in steps:
        held += n
        if held > HEAD or seen >= wanted:
            break
        seen += occurrences
        least = at
    return table.where(step >= F.lit(least)) if least is not None else table.limit(0)


def _sent(table: DataFrame, value: str) -> Table:
    """The head, laid out for look-ups once, here; bounded by HEAD."""
    got = _head(table).select("key", value).toArrow()
    return Table(got["key"].to_numpy().view(np.uint64), got[value].to_numpy().astype(np.float64))


def score(docs: DataFrame, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Documents whose crc32(doc_id as text) leaves `fold` modulo FOLDS are held out. The end
    mark counts as a word. base_score: the words' smoothed unigram log10 probability.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == fold
    with Scratch(spark) as scratch:
        counts = docs.where(~held_out).mapInArrow(_count, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))
        counts = scratch.written(counts, "counts")
        trie = Trie(counts.where(f"kind = {GRAM}").select("key", "c"), scratch)
        vocabulary = counts.where(f"kind = {WORD}").select("key", "c")
        trained = docs.where(~held_out).count()
        totals = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        v, n = totals[0] + (trained > 0), totals[1] + trained
        below = float(np.log10(n + SMOOTHING * (v + 1)))
        heads = spark.sparkContext.broadcast({GRAM: _sent(trie.seen(), "p"), WORD: _sent(vocabulary.select("key", "c", (F.log10(F.col("c") + SMOOTHING) - below).alias("b")), "b")})
        rows = docs.withColumn("row", F.monotonically_increasing_id())
        done = scratch.written(rows.select("row", "doc_id", "text").mapInArrow(_score(heads), SCORED), "scored")
        rest = done.where("kind is not null").select("row", "kind", "key", "c")
        strings = rest.where(f"kind = {GRAM}")
        p = scratch.written(trie.scored(strings.select("key").distinct()), "rest")
        more = strings.join(p, "key").select("row", (F.col("c") * F.col("p")).alias("score"), F.lit(0.0).alias("base"), F.lit(0).alias("n_known"))
        unknown = rest.where(f"kind = {WORD}").join(vocabulary.withColumnRenamed("c", "seen"), "key", "left")
        base = F.log10(F.coalesce("seen", F.lit(0)) + SMOOTHING) - below
        words_left = unknown.select("row", F.lit(0.0).alias("score"), (F.col("c") * base).alias("base"), F.when(F.col("seen").isNotNull(), F.col("c")).otherwise(0).alias("n_known"))
        whole = done.where("kind is null").select("row", "doc_id", "score", "base", "n_known", "n_tokens")
        parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [whole, more, words_left])
        sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("score", "base", "n_known", "n_tokens")])
        end = float(np.log10(trained + SMOOTHING) - below)
        out = sums.select(
            "doc_id",
            held_out.alias("held_out"),
            "n_tokens",
            (F.col("n_known") + int(trained > 0)).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + end).alias("base_score"),
            "score",
        )
        return written(out, "scores")
