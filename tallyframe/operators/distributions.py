"""Distributions of counts: how many of independent, or jointly shifted, events happen."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import normal
from tallyframe.operators.gates import failure_codes


#: Masses of a block, when two parts meet.
BLOCK = 1024
#: Masses of a task; events of a step in it; and the least mass, in relation to a window's largest, that is taken from it.
SPAN, STEP, SEEN = 4096, 512, 1e-4
#: Counts of a block, when moments are summed.
NEAR = 256
#: Shifts and roots of a task, when a shared shift is integrated.
POINTS, ROOTS = 32, 1024


def convolution(a: Column, b: Column) -> Column:
    """Masses of the sum of two independent counts."""
    n, m = F.size(a), F.size(b)

    def at(k: Column) -> Column:
        terms = F.sequence(F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1))
        return F.aggregate(terms, F.lit(0.0), lambda total, i: total + F.get(a, i) * F.get(b, k - i))

    return F.transform(F.sequence(F.lit(0), n + m - 2), at)


def merged(masses: DataFrame, keys: list[str], most: int, block: int = BLOCK) -> DataFrame:
    """(keys, k, mass) of (keys, slot, mass): slots meet in pairs, in as many rounds as `most` slots take.

    One of a pair's arrays goes in blocks, each a row of its own, so a task's work is a
    block times the other array.
    """
    while most > 1:
        pair = masses.groupBy(*keys, F.floor(F.col("slot") / 2).alias("slot")).agg(F.collect_list("mass").alias("m"))
        first, other = F.get("m", F.lit(0)), F.coalesce(F.get("m", F.lit(1)), F.array(F.lit(1.0)))
        blocks = pair.select(*keys, "slot", first.alias("a"), other.alias("b")).select(*keys, "slot", "a", "b", F.explode(F.sequence(F.lit(0), F.size("a") - 1, F.lit(block))).alias("from"))
        parts = blocks.select(*keys, "slot", "from", F.posexplode(convolution(F.slice("a", F.col("from") + 1, F.lit(block)), F.col("b"))).alias("k", "m"))
        summed = parts.groupBy(*keys, "slot", (F.col("from") + F.col("k")).alias("k")).agg(F.sum("m").alias("m"))
        masses = summed.groupBy(*keys, "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda e: e["m"]).alias("mass"))
        most = (most + 1) // 2
    return masses.select(*keys, F.posexplode("mass").alias("k", "mass"))


def fold_pmf(rows: DataFrame, fold: str, p: str, part: int = SPAN) -> DataFrame:
    """(fold, k, mass). Events without a probability are none."""
    return fold_log_pmf(rows, fold, p, part).drop("log_mass")


def equal_events(rows: DataFrame, fold: str, p: str) -> DataFrame:
    """(fold, p, c): how many of a fold's events have the chance p, or none."""
    return rows.select(fold, F.col(p).cast("double").alias("p")).groupBy(fold, "p").agg(F.count("*").alias("c"))


def fold_log_pmf(rows: DataFrame, fold: str, p: str, part: int = SPAN) -> DataFrame:
    """(fold, k, mass, log_mass): each mass, and its logarithm where the mass itself is too small for a double.

    Equal events are counted first. A task takes `part` masses of a fold, in windows: events are tilted (odds times
    one factor) so that the window's counts are the likely ones, their masses come from the characteristic
    function at about ten deviations of roots, and the tilt is taken back. So every mass is exact to about 1e-11 in relation
    to its size, and the work is the masses times the different probabilities. A fold that holds what is no
    probability (under 0, over 1, NaN) has NaN for its masses.

    Few bytes make much work here, so parts are dealt to a stated number of tasks: by size they would all be one task's.
    """
    counted = equal_events(rows, fold, p)
    sizes = counted.groupBy(F.col(fold).alias("_fold")).agg(F.sum(F.when(F.col("p").isNotNull(), F.col("c")).otherwise(0)).alias("n"))
    begins = F.explode(F.sequence(F.lit(0).cast("long"), "n", F.lit(part).cast("long"))).alias("begin")
    units = counted.join(sizes, F.col(fold).eqNullSafe(F.col("_fold"))).select(fold, "p", "c", "n", begins)
    kind = rows.schema[fold].dataType.simpleString()
    dealt = units.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), fold, "begin")
    return dealt.groupBy(fold, "begin").applyInArrow(_span(fold, part), f"`{fold}` {kind}, k int, mass double, log_mass double")


def _span(fold: str, part: int) -> Callable[[pa.Table], pa.Table]:
    def unit(events: pa.Table) -> pa.Table:
        given = events.filter(pc.is_valid(events.column("p")))
        p, c = (given.column(x).to_numpy().astype(float) for x in ("p", "c"))
        begin, n = events.column("begin")[0].as_py(), events.column("n")[0].as_py()
        mass, log = masses_of(p, c, begin, min(begin + part, n + 1))
        key = events.column(fold).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(log), np.int64)))
        return pa.table([key, pa.array(np.arange(begin, begin + len(log), dtype=np.int32)), pa.array(mass), pa.array(log)], [fold, "k", "mass", "log_mass"])

    return unit


def masses_of(p: np.ndarray, c: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The masses of begin..end-1 events, where c events have the chance p; and their logarithms."""
    if not ((p >= 0) & (p <= 1)).all():
        return np.full(end - begin, np.nan), np.full(end - begin, np.nan)
    mass, log = np.zeros(end - begin), np.full(end - begin, -np.inf)
    sure, open_ = int(c[p == 1].sum()), (p > 0) & (p < 1)
    p, c = p[open_], c[open_]
    n, odds, mean = int(c.sum()), np.log(p) - np.log1p(-p), float((c * p).sum())
    near = 4 * float(np.sqrt((c * p * (1 - p)).sum()))
    k, last = max(begin - sure, 0), min(end - sure, n + 1)
    while k < last:
        found = (np.ones(1), np.zeros(1)) if n == 0 else (np.empty(0), np.empty(0))
        if n and abs(k - mean) <= near:  # what is likely as it is needs no tilt
            found = _window(p, c, odds, k, None)
        if not len(found[0]):
            middle = k + 2.0 * np.sqrt(_tilted(odds, c, k)[2])
            while not len(found[0]):  # at k itself the window holds it
                found = _window(p, c, odds, k, middle)
                middle = (middle + k) / 2 if middle > k + 0.5 else float(k)
        many = min(len(found[0]), last - k, *([int(np.ceil(mean - near)) - k] if k < mean - near else []))
        at = k + sure - begin
        mass[at : at + many], log[at : at + many] = found[0][:many], found[1][:many]
        k += many
    return mass, log


def _tilted(odds: np.ndarray, c: np.ndarray, mean: float) -> tuple[float, np.ndarray, float]:
    """The tilt that brings the mean count there (half an event off the ends at least), the tilted chances, and the variance."""
    n = c.sum()
    mean = min(max(mean, 0.5), n - 0.5)
    own = np.log(mean) - np.log(n - mean)
    low, high = own - odds.max(), own - odds.min()
    for _ in range(60):
        tilt = (low + high) / 2
        q = 1 / (1 + np.exp(-(odds + tilt)))
        low, high = (tilt, high) if (c * q).sum() < mean else (low, tilt)
    return tilt, q, float((c * q * (1 - q)).sum())


def _window(p: np.ndarray, c: np.ndarray, odds: np.ndarray, k: int, middle: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The masses of k, k + 1, ..., and their logarithms, as far as a window around `middle` (none: the mean) shows them."""
    n = int(c.sum())
    tilt, q, variance = (0.0, p, float((c * p * (1 - p)).sum())) if middle is None else _tilted(odds, c, middle)
    # beyond `reach` from its mean a count has less than exp(-50) (Bernstein), so what the roots fold back is nothing
    reach = 17 + np.sqrt(280 + 100 * variance)
    size = 1 << min(n, int(2 * reach) + 1).bit_length()
    w = 2 * np.pi * np.arange(size // 2 + 1) / size
    sine, cosine, half = np.sin(w), np.cos(w), np.sin(w / 2) ** 2
    mean = float((c * q).sum())
    origin = int(mean)
    real, turn = np.zeros(len(w)), (mean - origin) * w
    with np.errstate(divide="ignore"):
        for i in range(0, len(q), STEP):
            x, many = q[i : i + STEP, None], c[i : i + STEP]
            real += many @ np.log1p(np.maximum(-4 * x * (1 - x) * half, -1.0)) / 2
            turn += many @ (np.arctan2(x * sine, 1 - x + x * cosine) - x * w)
        mass = np.fft.irfft(np.exp(real) * (np.cos(turn) - 1j * np.sin(turn)), size)
    first = max(0, min(origin - size // 2, n + 1 - size))
    mass = np.roll(mass, origin - first)
    seen = mass[k - first :] if 0 <= k - first < size else mass[:0]
    unseen = np.flatnonzero(~(seen >= SEEN * mass.max()))
    seen = seen[: unseen[0]] if len(unseen) else seen
    if middle is None:
        return seen, np.log(seen)
    cumulant = float((c * (np.log1p(-p) + np.logaddexp(0.0, odds + tilt))).sum())  # of 1 - p + p exp(tilt)
    log = np.log(seen) + (cumulant - tilt * np.arange(k, k + len(seen)))
    return np.exp(log), log


def mixture_pmf(rows: DataFrame, fold: str, tau: Column, points: int = 2048) -> DataFrame:
    """(fold, k, mass) with one normal shift of deviation tau for all of a fold's events.

    rows: (fold, mu, local). The shift is integrated over `points` equally likely quantiles; with
    tau = 0 there is nothing to integrate, and one point gives the exact masses. An event without a local
    deviation is certain once the shift is known (at exactly 0: one half); one without mu is none.

    The count of n events has n + 1 masses, which are the discrete Fourier transform of its
    characteristic function at the roots of unity of that order. At a root that function is a product over
    events, in which equal events are one factor to the power of their number; it is averaged over
    the shifts, and transformed back once. A task takes `POINTS` shifts and `ROOTS` roots of a fold; half of
    the roots are enough, the others are conjugates. Masses are exact to about 1e-15, not in
    relation to their size.
    """
    counted = rows.select(fold, "mu", "local", tau.cast("double").alias("tau")).where("mu is not null").groupBy(fold, "tau", "mu", "local").agg(F.count("*").alias("c"))
    sizes = counted.groupBy(F.col(fold).alias("_fold")).agg(F.sum("c").alias("n"), F.max(F.when(F.col("tau") == 0, 0).otherwise(1)).alias("spread"))
    shifts = F.sequence(F.lit(0), F.when(F.col("spread") == 0, 0).otherwise((points - 1) // POINTS))
    roots = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + 1) / 2 / ROOTS))
    units = counted.join(sizes, F.col(fold).eqNullSafe(F.col("_fold"))).drop("_fold").withColumn("shifts", F.explode(shifts)).withColumn("roots", F.explode(roots))
    kind = rows.schema[fold].dataType.simpleString()
    summed = units.groupBy(fold, "shifts", "roots").applyInArrow(_characteristic(fold, points), f"`{fold}` {kind}, n long, j long, re double, im double")
    whole = summed.groupBy(fold, "n", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return whole.groupBy(fold).applyInArrow(_masses(fold), f"`{fold}` {kind}, k int, mass double")


def _characteristic(fold: str, points: int) -> Callable[[pa.Table], pa.Table]:
    def unit(events: pa.Table) -> pa.Table:
        """A part of the mean over shifts of the characteristic function, at some roots."""
        mu, local, tau, c = (events.column(x).to_numpy().astype(float) for x in ("mu", "local", "tau", "c"))
        n, shift, root = (events.column(x)[0].as_py() for x in ("n", "shifts", "roots"))
        shifted = bool((tau != 0).any())
        at = np.arange(shift * POINTS, min((shift + 1) * POINTS, points)) if shifted else np.zeros(1)
        z = np.array([NormalDist().inv_cdf((i + 0.5) / points) for i in at]) if shifted else np.zeros(1)
        j = np.arange(root * ROOTS, min((root + 1) * ROOTS, (n + 1) // 2 + 1))
        turn = np.exp(2j * np.pi * j / (n + 1)) - 1
        mean = mu[:, None] + tau[:, None] * z
        certain = ~(local > 0)
        with np.errstate(under="ignore"):
            p = np.where(certain[:, None], (np.sign(mean) + 1) / 2, normal.cdf_of(mean / np.where(certain, 1.0, local)[:, None]))
            product = np.ones((len(z), len(j)), complex)
            for q, count in zip(p, c.astype(np.int64).tolist(), strict=True):
                factor = 1 + q[:, None] * turn
                while count:
                    if count & 1:
                        product *= factor
                    count >>= 1
                    if count:
                        factor *= factor
            parts = product.sum(axis=0) / (points if shifted else 1)
        size = len(j)
        return pa.table([events.column(fold).slice(0, 1).combine_chunks().take(pa.array(np.zeros(size, np.int64))), pa.array(np.full(size, n)), pa.array(j), pa.array(parts.real), pa.array(parts.imag)], [fold, "n", "j", "re", "im"])

    return unit


def _masses(fold: str) -> Callable[[pa.Table], pa.Table]:
    def back(values: pa.Table) -> pa.Table:
        order = np.argsort(values.column("j").to_numpy())
        function = (values.column("re").to_numpy() - 1j * values.column("im").to_numpy())[order]
        n = values.column("n")[0].as_py()
        mass = np.maximum(np.fft.irfft(function[: (n + 1) // 2 + 1], n + 1), 0.0)
        mass /= mass.sum()
        return pa.table([values.column(fold).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n + 1, np.int64))), pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(mass)], [fold, "k", "mass"])

    return back


def binomial_pmf(rows: DataFrame, fold: str, n: str, p: str) -> DataFrame:
    """(fold, k, mass): the masses of n independent events of one chance each, for each fold's n and p.

    Logarithms of the ratios of neighbouring masses are summed up from 0. A chance of 0 or 1 leaves one mass.
    """
    each = rows.select(fold, F.col(n).cast("long").alias("n"), F.col(p).cast("double").alias("p")).where("n >= 0 and p between 0 and 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("k"))
    ways = F.when(F.col("k") > 0, F.ln((F.col("n") - F.col("k") + 1) / F.col("k"))).otherwise(0.0)
    upto = Window.partitionBy(fold, "n", "p").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    times = lambda count, chance: F.when(count == 0, 0.0).otherwise(count * F.ln(chance))
    log = F.sum(ways).over(upto) + times(F.col("k"), F.col("p")) + times(F.col("n") - F.col("k"), 1 - F.col("p"))
    none = ((F.col("p") == 0) & (F.col("k") > 0)) | ((F.col("p") == 1) & (F.col("k") < F.col("n")))
    return each.select(fold, "k", F.when(none, 0.0).when(F.col("p").isin(0.0, 1.0), 1.0).otherwise(F.exp(log)).alias("mass"))


def moments(pmf: DataFrame, fold: str) -> DataFrame:
    """(fold, n, total, mean, variance) of masses that add up to 1.

    Sums are taken in blocks of `NEAR` counts, from each block's first count, and brought together around the mean: the mean
    square less the square of the mean has the rounding errors of squared counts, which a large fold's variance is small against.
    """
    origin = F.floor(F.col("k") / NEAR) * NEAR
    x, m = (F.col("k") - origin).cast("double"), F.col("mass")
    parts = pmf.groupBy(fold, origin.cast("double").alias("_origin")).agg(F.max("k").alias("_last"), F.sum("mass").alias("_mass"), F.sum(x * m).alias("_first"), F.sum(x * x * m).alias("_second"))
    mean = F.sum(F.col("_origin") * F.col("_mass") + F.col("_first")).over(Window.partitionBy(fold))
    off = F.col("_origin") - F.col("_mean")
    square = F.col("_second") + 2 * off * F.col("_first") + off * off * F.col("_mass")
    return parts.withColumn("_mean", mean).groupBy(fold).agg(F.max("_last").alias("n"), F.sum("_mass").alias("total"), F.max("_mean").alias("mean"), F.sum(square).alias("variance"))


def cumulative(pmf: DataFrame, fold: str) -> DataFrame:
    running = Window.partitionBy(fold).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return pmf.withColumn("cdf", F.sum("mass").over(running))


def quantiles(pmf: DataFrame, fold: str, at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(fold, q, k): the least k whose cumulated mass reaches q."""
    cdf = cumulative(pmf, fold)
    return cdf.select(fold, "k", "cdf", F.explode(F.array(*[F.lit(q) for q in at])).alias("q")).where("cdf >= q - 1e-12").groupBy(fold, "q").agg(F.min("k").alias("k"))


def intervals(pmf: DataFrame, fold: str, level: float = 0.9, tolerance: float = 1e-10) -> DataFrame:
    """(fold, low, high, inside, failure_codes): the equal-tail interval of a count, and what is wrong with its masses.

    low and high are the least counts whose cumulated mass reaches either tail's share; inside is the mass between them,
    both included. Codes: `mass` (the masses don't add up to 1), `negative`, `gap` (a count without a mass).
    """
    tail = (1 - level) / 2
    cdf = cumulative(pmf, fold)
    ends = cdf.groupBy(fold).agg(
        F.min(F.when(F.col("cdf") >= tail - 1e-12, F.col("k"))).alias("low"), F.min(F.when(F.col("cdf") >= 1 - tail - 1e-12, F.col("k"))).alias("high"),
        F.sum("mass").alias("_total"), F.min("mass").alias("_least"), F.count("*").alias("_n"), F.max("k").alias("_last"),
    )
    inside = pmf.join(ends.select(F.col(fold).alias("_fold"), "low", "high"), F.col(fold).eqNullSafe(F.col("_fold"))).where(F.col("k").between(F.col("low"), F.col("high"))).groupBy("_fold").agg(F.sum("mass").alias("inside"))
    coded = ends.withColumn("failure_codes", failure_codes({"mass": F.abs(F.col("_total") - 1) > tolerance, "negative": F.col("_least") < 0, "gap": F.col("_n") != F.col("_last") + 1}))
    return coded.join(inside, F.col(fold).eqNullSafe(F.col("_fold")), "left").select(fold, "low", "high", "inside", "failure_codes")


def discrete_scores(pmf: DataFrame, fold: str, observed: DataFrame) -> DataFrame:
    """(fold, crps, log_score) of a count. observed: (fold, y). No mass at y scores minus infinity; a mass too small for a double scores its `log_mass`, if pmf has it."""
    cdf = cumulative(pmf, fold).join(observed, fold)
    gap = F.col("cdf") - F.when(F.col("k") >= F.col("y"), 1.0).otherwise(0.0)
    log = F.col("log_mass") if "log_mass" in pmf.columns else F.when(F.col("mass") > 0, F.ln("mass"))
    hit = F.max(F.when(F.col("k") == F.col("y"), log))
    sums = cdf.groupBy(fold).agg(F.sum(gap * gap).alias("crps"), hit.alias("hit"))
    return sums.select(fold, "crps", F.coalesce("hit", F.lit(float("-inf"))).alias("log_score"))


def pair_covariance(rows: DataFrame, pmf: DataFrame, fold: str, p: str) -> DataFrame:
    """Mean covariance of two events of a fold, from the count's variance; no pair is formed. Events without a fold have none.

    Events are counted as for the masses, and no filter by fold goes down to them, so rows are read once if the masses are theirs.
    """
    own = equal_events(rows, fold, p).groupBy(F.col(fold).alias("_fold")).agg(F.sum("c").alias("events"), F.sum(F.col("c") * F.col("p") * (1 - F.col("p"))).alias("independent"))
    joined = moments(pmf.where(F.col(fold).isNotNull()), fold).join(own, F.col(fold).eqNullSafe(F.col("_fold"))).where("events > 1")
    return joined.select(fold, "events", ((F.col("variance") - F.col("independent")) / (F.col("events") * (F.col("events") - 1))).alias("covariance"))


def exact_bootstrap(spark: SparkSession, blocks: DataFrame, value: str, least: float = 0.0, most_blocks: int = 9) -> DataFrame:
    """One row: the exact bootstrap distribution of a mean of blocks, and the chance that it is below `least`.

    All multisets of n blocks are listed with their multinomial weights, one block
    after the other taking some of the draws that are left, so n is bounded by
    `most_blocks` (24,310 multisets).
    """
    values = [r[0] for r in blocks.select(value).orderBy(value).limit(most_blocks + 1).collect()]
    n = len(values)
    if not 0 < n <= most_blocks:
        raise ValueError(f"1 to {most_blocks} blocks are needed")
    drawn = spark.range(1).select(F.lit(n).alias("left"), F.factorial(F.lit(n)).alias("ways"), F.lit(0.0).alias("total"))
    for i, v in enumerate(values):
        takes = F.array("left") if i == n - 1 else F.sequence(F.lit(0), "left")
        drawn = drawn.select("*", F.explode(takes).alias("c")).select((F.col("left") - F.col("c")).alias("left"), F.expr("ways div factorial(c)").alias("ways"), (F.col("total") + F.col("c") * float(v)).alias("total"))
    means = drawn.select((F.col("total") / n).alias("mean"), "ways")
    out = means.agg(F.count("*").alias("multisets"), F.sum("ways").alias("draws"), (F.sum(F.col("mean") * F.col("ways")) / F.sum("ways")).alias("mean"), F.sum(F.when(F.col("mean") < least, F.col("ways")).otherwise(0)).alias("below"))
    return out.select("multisets", "draws", "mean", (F.col("below") / F.col("draws")).alias("chance_below"))


def simulate_counts(rows: DataFrame, fold: str, tau: float, draws: int = 200, seed: int = 1) -> DataFrame:
    """(fold, draw, wins) of correlated outcomes: one shared normal shift for each fold and draw, one local for each event.

    Uniforms come from SHA-256 of the seed, the stream, the id and the draw, so a draw
    is the same wherever it runs. With tau = 0 the outcomes are independent.
    """

    def uniform(stream: str, key: str) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{seed}:{stream}:"), F.col(key).cast("string"), F.lit(":"), F.col("draw").cast("string")), 256)
        return (F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)

    drawn = rows.select(fold, "id", "mu", "local", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    drawn = drawn.withColumns({"u": uniform("shared", fold), "v": uniform("local", "id")})
    drawn = drawn.withColumns({"shared": normal.inverse_cdf("u"), "own": normal.inverse_cdf("v")})
    won = F.col("mu") + tau * F.col("shared") + F.col("local") * F.col("own") > 0
    return drawn.groupBy(fold, "draw").agg(F.count_if(won).alias("wins"))
