"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured; two sets of rules read the measures. The hard rules
reject a document by themselves. The soft ones count as failures of its host
(the `source` column): each host's failure rate is shrunk towards the mean of
all hosts with a beta prior whose two parameters are fitted to the hosts' rates
by moments, less what chance alone makes them differ. A host is bad if its rate is very
likely above what all but a few hosts of that prior have, or above a half, and a document that fails a
soft rule is rejected if its host is bad as well. Where hosts differ by chance only,
none is bad. A host with few documents keeps close to the prior, and its
rate is uncertain, so one bad page doesn't condemn it.

A null or empty text has no words and fails the hard rules. A null host is a
host of its own. Rows that repeat count again. Columns of the input other than
the three named ones are carried along untouched, whatever their names: the
measures come in one struct column, `quality`, which takes the place of an input
column of that name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import let, written

WHITE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Soft rules: symbols per word, duplicate lines per line, mean word length.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINES = 0.3
WORD_LENGTH = (2.0, 12.0)
#: A host is bad if its rate, less so many deviations of its posterior, is above the prior's mean and so many of the prior's.
HOST_DEVIATIONS = 1.645
#: So high a rate is bad whatever other hosts have.
HOST_RATE = 0.5


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of `size` words that occur twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(p: Column) -> Column:
            same = F.filter(p, lambda s, i: F.coalesce(s["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(p, i + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda s: s["i"]))

        def lengths(at: Column) -> Column:
            steps = F.transform(at, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - x, F.lit(size))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(placed, twins), lengths)

    def count(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (size - 1))
        hashes = F.transform(at, lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
        return F.when(F.size(w) >= size, repeats).otherwise(F.lit(0))

    return let(words, count)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def from_words(w: Column) -> Column:
        return let(
            lines,
            lambda line: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(line).cast("long").alias("n_lines"),
                (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        )

    return let(text_words(text), from_words)


def _failures(m: Column) -> Column:
    """m with base_failed and soft_failed."""
    words = m["n_words"]
    base = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
    length = m["word_chars"] / F.greatest(words, F.lit(1))
    soft = (m["n_symbols"] > MAX_SYMBOLS_PER_WORD * words) | (m["n_dup_lines"] > MAX_DUP_LINES * m["n_lines"]) | ~length.between(*WORD_LENGTH)
    return m.withField("base_failed", base).withField("soft_failed", soft)


def host_rates(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, failures) with `shrunk`, the mean of the host's beta posterior, and `bad`.

    The prior's mean m and strength s come from the mean and variance of the hosts'
    rates, the variance less the mean of rate (1 - rate) / n: s = m (1 - m) / variance - 1,
    held between 1 and 10,000.
    """
    hosts = hosts.withColumn("rate", F.col("failures") / F.col("n"))
    prior = hosts.agg(F.avg("rate").alias("m"), F.greatest(F.lit(0.0), F.coalesce(F.var_samp("rate") - F.avg(F.col("rate") * (1 - F.col("rate")) / F.col("n")), F.lit(0.0))).alias("v"))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(10000.0))))
    prior = prior.select("m", strength.alias("s"))
    shrunk = hosts.join(F.broadcast(prior)).withColumn("shrunk", (F.col("failures") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s")))
    spread = lambda mean, strength: HOST_DEVIATIONS * F.sqrt(mean * (1 - mean) / (strength + 1))
    bad = F.col("shrunk") - spread(F.col("shrunk"), F.col("n") + F.col("s")) > F.least(F.col("m") + spread(F.col("m"), F.col("s")), F.lit(HOST_RATE))
    return shrunk.withColumn("bad", bad).drop("m", "s")


def host_quality(docs: DataFrame, text: str = "text", host: str = "source", drop_text: bool = False) -> DataFrame:
    """docs with `quality`: the measures, base_failed, soft_failed, host_rate, host_bad and kept.

    drop_text: leave the text column out of the result; the measures are then
    written once. With the text they are taken twice, once for the hosts and once
    for the verdicts, so that no copy of the texts is written or shuffled.
    """
    out = [c for c in docs.columns if c != "quality" and not (drop_text and c == text)]
    measured = docs.select(F.struct(*out).alias("d"), F.col(host).alias("host"), let(measures(F.col(text)), _failures).alias("q"))
    measured = written(measured, "measured") if drop_text else measured
    failed = lambda q: let(q, lambda x: x["base_failed"] | x["soft_failed"])  # noqa: E731  let: q isn't computed twice
    # written, so that Spark knows its size when it plans the join: few hosts are sent to all tasks, many are shuffled
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.count_if(failed(F.col("q"))).alias("failures"))
    rates = written(host_rates(written(hosts, "hosts")).select(F.col("host").alias("of"), "shrunk", "bad"), "host-rates")
    judged = measured.join(rates, F.col("host").eqNullSafe(F.col("of")), "left")
    kept = ~F.col("q.base_failed") & ~(F.col("q.soft_failed") & F.col("bad"))
    return judged.select("d.*", F.col("q").withField("host_rate", F.col("shrunk")).withField("host_bad", F.col("bad")).withField("kept", kept).alias("quality"))
