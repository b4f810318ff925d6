"""Whitening of embeddings from a weighted covariance of distinct vectors.

Entries become whole numbers, x = floor(1024 c) + 100000. Rows with equal x are
one distinct vector whose weight is their count; from there on each distinct vector is
looked at once: its weighted sums, its part in the weighted covariance (centred, then
one matrix product for each Arrow batch) and its projection on the components. The
projections are joined back to the rows by x. Sums and products are reduced within
a task before Spark adds them up, so what is shuffled and what the driver gets depends
on the number of dimensions alone.

The sums, n and the deviation, sum over dimensions of (n x - S)^2, are exact whole
numbers; a deviation of more than 38 digits is null.

A row counts only if its vector has no null, non-finite or too large entry (2^52: x
wouldn't be a long) and has the most frequent length (of equally frequent ones the
largest); other rows, those with a null or empty vector among them, have no result.
Rows that repeat each have one. Columns of the input are carried along, but for
`whitening`, which the result's own replaces. A component without variance has the
whitened value null and is left out of the identity error. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import Scratch, written

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 52)
COMPONENTS = 8

WHITENING = "struct<n:bigint,deviation:decimal(38,0),whitened:array<double>,explained:array<double>,identity_error:double>"


def whole_numbers(vector: Column) -> Column:
    """x, or null where the vector doesn't count."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return F.when(sound & (F.size(vector) > 0), F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Fit:
    """What whitening needs of all vectors: bounded by the number of dimensions."""

    n: int
    sums: list[int]
    directions: np.ndarray  # a column for each component
    variances: np.ndarray
    trace: float

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole numbers are taken off first, so that nothing is lost to rounding."""
        rest = np.array([float(Fraction(s - self.n * c, self.n)) for s, c in zip(self.sums, self.centre, strict=True)])
        return (x - np.array(self.centre, np.int64)).astype(float) - rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """sum of (n x - S)^2 for each vector; Python's whole numbers where 64 bits might not hold it."""
        far = int(np.abs(x - np.array(self.centre, np.int64)).max(initial=0)) + 1
        if (self.n * far) ** 2 * x.shape[1] < 1 << 62:
            # n (x - centre) - (S - n centre), all small
            left = np.array([s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)], np.int64)
            return pa.array(((self.n * (x - np.array(self.centre, np.int64)) - left) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return pa.array([v if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact weighted sum of each dimension over a task's vectors."""
    total: np.ndarray | None = None
    for batch in batches:
        if not len(batch):
            continue
        x, weight = _matrix(batch.column("x"), np.int64), batch.column("weight").to_numpy()
        fits = int(np.abs(x).max()) * int(weight.sum()) < 1 << 62
        part = (weight @ x).astype(object) if fits else weight.astype(object) @ x.astype(object)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.decimal128(38, 0))], ["at", "total"])


def _products(column: str, centred: Callable) -> Callable:
    """The weighted products of each pair of dimensions over a task's vectors, centred first."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if not len(batch):
                continue
            y = centred(_matrix(batch.column(column), float if column == "z" else np.int64))
            part = (y * batch.column("weight").to_numpy()[:, None]).T @ y
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "product"])

    return products


def _covariance(vectors: DataFrame, column: str, centred: Callable, n: int, size: int) -> np.ndarray:
    parts = vectors.select(column, "weight").mapInArrow(_products(column, centred), "i int, j int, product double")
    found = parts.groupBy("i", "j").agg(F.sum("product").alias("product")).toArrow()
    out = np.zeros((size, size))
    i, j = found["i"].to_numpy(), found["j"].to_numpy()
    out[i, j] = out[j, i] = found["product"].to_numpy() / n
    return out


def fit(vectors: DataFrame, n: int, size: int, components: int = COMPONENTS) -> Fit:
    """vectors (x, weight): all distinct ones of the given size, n with their weights."""
    rows = vectors.select("x", "weight").mapInArrow(_sums, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()
    sums = [int(r["total"]) for r in sorted(rows, key=lambda r: r["at"])]
    covariance = _covariance(vectors, "x", Fit(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0).centred, n, size)
    variances, directions = np.linalg.eigh(covariance)
    first = np.argsort(-variances, kind="stable")[:components]
    directions = directions[:, first]
    sign = np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(first))] < 0, -1.0, 1.0)
    return Fit(n, sums, directions * sign, np.maximum(variances[first], 0.0), float(np.trace(covariance)))


def _projected(fitted: Fit, sound: int) -> Callable:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("x"), np.int64)
                z = fitted.centred(x) @ fitted.directions[:, :sound] / np.sqrt(fitted.variances[:sound])
                values = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), sound).cast(pa.list_(pa.float64())) if sound else pa.array([[]] * len(batch), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("weight"), values, fitted.deviations(x)], ["x", "weight", "z", "deviation"])

    return project


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """rows with `whitening`: n, deviation, whitened and explained for each component, and identity_error."""
    spark = rows.sparkSession
    kept = rows.select(F.struct(*[c for c in rows.columns if c != "whitening"]).alias("row"), whole_numbers(F.col(vector)).alias("x")).where("x is not null")
    kept = kept.withColumn("key", F.xxhash64("x"))
    with Scratch(spark) as scratch:
        distinct = scratch.written(kept.groupBy("key", "x").agg(F.count("*").alias("weight")).drop("key"), "distinct-vectors")
        widths = distinct.groupBy(F.size("x").alias("size")).agg(F.sum("weight").alias("n"))
        most = widths.orderBy(F.desc("n"), F.desc("size")).first()
        if most is None:
            return kept.select("row.*", F.lit(None).cast(WHITENING).alias("whitening"))
        vectors = distinct.where(F.size("x") == most["size"])
        fitted = fit(vectors, most["n"], most["size"], components)
        #: Components that have variance, beyond what rounding leaves.
        sound = int((fitted.variances > most["size"] * np.finfo(float).eps * fitted.variances.max(initial=0.0)).sum())
        projected = vectors.mapInArrow(_projected(fitted, sound), "x array<long>, weight long, z array<double>, deviation decimal(38,0)")
        whitened = written(projected.withColumn("key", F.xxhash64("x")), "whitened")
        error = 0.0
        if sound:
            mean = whitened.agg(*[(F.sum(F.col("z")[i] * F.col("weight")) / fitted.n).alias(f"m{i}") for i in range(sound)]).first()
            centre = np.array(mean)
            error = float(np.abs(_covariance(whitened, "z", lambda z: z - centre, fitted.n, sound) - np.eye(sound)).max())
    number = lambda v: F.lit(float(v)).cast("double")
    without = [F.lit(None).cast("double")] * (len(fitted.variances) - sound)
    explained = F.array(*[number(v / fitted.trace) if fitted.trace > 0 else F.lit(None).cast("double") for v in fitted.variances])
    result = F.struct(
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.concat("z", F.array(*without).cast("array<double>")).alias("whitened"),
        explained.alias("explained"),
        number(error).alias("identity_error"),
    )
    return kept.join(whitened.drop("weight"), ["key", "x"]).select("row.*", result.alias("whitening"))
