"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

The model reads the character 3-grams to 5-grams of host and path (in lower case,
with the parts' ends marked), hashed into `FEATURES` counts, and is fitted by
Spark's ML library on a small table of labelled URLs, a parameter; the one made
by labelled_urls() is used unless another is given. It is made of the words listed
below, so other words are judged by the n-grams that they share with them. Of a longer table `MAX_LABELLED` rows at most
are read (the first by URL), as the fit is meant for a labelled sample.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case.
Path: from there up to `?`, `#` or the end. A null URL, or one without `://`, has
an empty host and path; it fits no rule and the model judges it by its empty
n-grams. A rule holds for its host and all subdomains if the path starts with
the rule's; the longest wins. Repeated rows are judged again. Other columns are
carried along, but for `judged`, which the result's own replaces. An empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14
SIZES = (3, 4, 5)
MAX_LABELLED = 10_000
BLOCK_ABOVE = 0.5
PENALTY = 0.001
#: Size (of each class) and seed of the table of labelled URLs.
EACH, SEED = 1000, 1

#: (verdict, host, path), the fixed rules of the filter.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: What the labelled URLs are made of: words that mark a URL to be blocked, everyday words, and parts of names that mark nothing.
BLOCK_WORDS = """
casino casinos casino-bonus free-spins poker poker-room betting live-bets jackpot jackpots roulette blackjack slots slot-machines bingo-cash
pills pill-store viagra tramadol pharma-discount cheap-meds online-meds steroids weightloss-pills miracle-diet payday payday-loans cheap-loans quick-loans instant-credit
adult adult-cams live-cams porn porn-tube xxx xxx-videos escort escorts hookup hookups singles-chat sex-chat hot-dating
warez crack cracked keygen serial-keys torrent torrents pirate-movies replica-watches replicas fake-watches counterfeit fake-bags
spam spam-mail link-farm cheap-backlinks popunder pop-ads adserver ad-clicks clickbait malware trojan phishing botnet hack-tool cheats
get-rich quick-money easy-money make-money-fast forex-signals crypto-giveaway free-bitcoin
""".split()
ALLOW_WORDS = """
news newsroom library libraries museum museums school schools university college garden gardening gardens weather forecast science sciences physics chemistry biology
history archaeology music concerts recipes cooking baking travel railway railways trains timetable health hospital nursing sports football cycling hiking climbing
books bookshop poetry literature city-council council parish theatre opera orchestra choir wiki research gallery galleries paintings climate astronomy telescope observatory
archive archives cinema documentary nature birds wildlife farming village community volunteers charity teachers students lectures maths geology maps photography crafts knitting carpentry
""".split()
NAME_PARTS = "ba bel cor dan el fen gar hol in jar kem lo mar nor or pel quin ros sal tor ul ven wes yar zel".split()
ENDINGS = "com net org info example".split()
SECTIONS = "en fr de es blog page item a view".split()


def example_urls(each: int, seed: int, held_out: bool | None = None) -> list[tuple[str, int]]:
    """`each` URLs to be blocked (1) and as many others (0), made by seed.

    A word of its class stands in the host, the path or both; a fourth of the others have none.
    held_out: only every fifth word, or only the others (to tell how words that a model hasn't seen are judged).
    """
    rng, out = random.Random(seed), []
    for all_words, blocked in ((BLOCK_WORDS, 1), (ALLOW_WORDS, 0)):
        words = [w for i, w in enumerate(all_words) if held_out is None or (i % 5 == 0) == held_out]
        for i in range(each):
            place = i % (3 if blocked else 4)
            name = "".join(rng.choice(NAME_PARTS) for _ in range(rng.randint(2, 3)))
            start = rng.choice(("", "", "www.", "m.", "blog."))
            label = rng.choice((f"{rng.choice(words)}-{name}", f"{name}-{rng.choice(words)}", f"{name}{rng.choice(words)}")) if place in (0, 2) else name
            section = rng.choice(words) if place in (1, 2) else rng.choice(SECTIONS)
            out.append((f"{rng.choice(('http', 'https'))}://{start}{label}.{rng.choice(ENDINGS)}/{section}/{rng.randint(1, 999)}", blocked))
    return out


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(at: Column, under: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((at == domain) | at.endswith("." + domain)) & under.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def model(labelled: DataFrame):
    """Fitted on (url, blocked); input needs columns host and path, output has `probability`."""
    named = labelled.orderBy("url").limit(MAX_LABELLED).select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("blocked").cast("double").alias("label"))
    letters = SQLTransformer(statement="SELECT *, split(concat('^', lower(host), '$', lower(path), '$'), '') AS letters FROM __THIS__")
    ngrams = [NGram(n=n, inputCol="letters", outputCol=f"ngrams_{n}") for n in SIZES]
    joined = SQLTransformer(statement=f"SELECT *, concat({', '.join(f'ngrams_{n}' for n in SIZES)}) AS ngrams FROM __THIS__")
    hashed = HashingTF(inputCol="ngrams", outputCol="features", numFeatures=FEATURES)
    regression = LogisticRegression(regParam=PENALTY, maxIter=200, tol=1e-9)
    return Pipeline(stages=[letters, *ngrams, joined, hashed, regression]).fit(named)


def labelled_urls(spark: SparkSession, each: int = EACH, seed: int = SEED) -> DataFrame:
    return spark.createDataFrame(example_urls(each, seed), "url string, blocked int")


def judge(pages: DataFrame, url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """pages with `judged`: a struct of host, path, rule, blocked_probability and verdict."""
    fitted = model(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    kept = pages.select(F.struct(*[c for c in pages.columns if c != "judged"]).alias("page"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, verdict = _rule(F.col("host"), F.col("path"))
    scored = fitted.transform(kept).withColumn("p", vector_to_array("probability")[1])
    learned = F.when(F.col("p") > BLOCK_ABOVE, "block").otherwise("allow")
    judged = F.struct("host", "path", rule.alias("rule"), F.col("p").alias("blocked_probability"), F.coalesce(verdict, learned).alias("verdict"))
    return scored.select("page.*", judged.alias("judged"))
