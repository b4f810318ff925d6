"""Line dedup with a fixed-depth template tree, in DataFrame functions only.

Every line goes down a tree: its number of tokens, then its first tokens, with
tokens that hold a digit or stand in angle brackets masked as variable. A line of
which over half would be masked isn't: it recurs only as it is. In a leaf
the distinct lines are grouped by similarity: a line belongs to the first leader
(the line in most documents first) that has the same token in at least `SIMILAR`
of the literal places (those not masked, of the line that has more), and a line
that no leader is like becomes one. Groups met in enough documents are dropped
from all documents but the first (by doc_id). The shorter a line, the more
documents it takes. Fields vary from the fifth token on, so lines of up to four
tokens vary only where they are masked.

Lines are first counted (one row for each distinct line, named by 128 bits of its
masked tokens), so a line that a third of all documents have costs one row in its
leaf.

A null text stays null and an empty one empty; blank lines stay. Rows that
repeat a doc_id count as one document, with the same text or others. A null
doc_id keeps all its lines and counts as no document. Other columns are carried
along; names that clash are no matter, but for `dropped_lines`, which the result's
own column replaces. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.minhash import components
from tallyframe.llm.shared import Scratch, let, written

LEADING = 4
SIMILAR = 0.7
#: (least tokens, least documents), the first that fits holds.
ENOUGH = ((8, 2), (3, 10), (1, 30))
#: Most candidates for leaders that a leaf has in one round; no bound on its leaders.
WIDEST = 1024
#: Share of the tokens of both that two documents have in common lines, to be copies (where copies are spared).
COPY = 0.6
WILD = "<*>"
WHITE = "[\\x20\\x09-\\x0D]+"
#: A token with a digit or a bracket; looked for once from each token's start.
VARIABLE = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9<]*+[0-9<][^\\x20\\x09-\\x0D]*+"


def _masked(line: Column) -> Column:
    plain = F.array_remove(F.split(line, WHITE), "")
    masked = F.array_remove(F.split(F.regexp_replace(line, VARIABLE, WILD), WHITE), "")
    enough = lambda t: F.when(2 * F.size(F.filter(t, lambda x: x == WILD)) > F.size(t), plain).otherwise(t)
    return F.when(line.rlike("[0-9<]"), let(masked, enough)).otherwise(plain)


def _name(tokens: Column) -> Column:
    return F.struct(F.xxhash64(tokens).alias("a"), F.xxhash64(F.lit(1), tokens).alias("b"))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, h, leaf, n): the lines that have a token; h names the masked line, text_key the text."""
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("of"))
    lines = texts.select("doc_id", "text_key", F.posexplode("of").alias("line_no", "line"))  # the text itself isn't carried into each line's row
    key = let(_masked(F.col("line")), lambda t: F.struct(_name(t).alias("h"), F.xxhash64(F.size(t), F.slice(t, 1, LEADING)).alias("leaf"), F.size(t).alias("n")))
    return lines.select("doc_id", "text_key", "line_no", key.alias("key")).select("doc_id", "text_key", "line_no", "key.*").where("n > 0")


def _enough(n: Column, docs: Column) -> Column:
    rule = F.lit(False)
    for tokens, least in reversed(ENOUGH):
        rule = F.when(n >= tokens, docs >= least).otherwise(rule)
    return rule


def _like(a: Column, b: Column) -> Column:
    """Whether two lines (structs of tokens, 0 where masked, and the number of literal ones) have enough literal tokens in common."""
    same = F.filter(F.zip_with(a["tokens"], b["tokens"], lambda x, y: (x == y) & (x != 0)), lambda x: x)
    return F.size(same) >= SIMILAR * F.greatest(a["literal"], b["literal"])


def _leaders(heads: Column) -> Column:
    """Those of heads (in order) that are like no earlier leader."""
    first = F.slice(heads, 1, 1)
    add = lambda known, x: F.when(F.exists(known, lambda k: _like(k, x)), known).otherwise(F.concat(known, F.array(x)))
    return F.aggregate(F.slice(heads, 2, WIDEST), first, add)


def similar_groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, template): each line of rows (h, leaf, docs, of) and its leader; of: its tokens and number of literal ones.

    In each round a leaf has up to `width` candidates, the greatest of as many
    parts of its lines. All lines of the leaf are held against the leaders among
    them, and those that are like none go on until no line is left.
    """
    done, rest, width = [], rows, 1
    while True:
        heads = rest.groupBy("leaf", F.pmod("h.b", F.lit(width)).alias("slot")).agg(F.max(F.struct("docs", "h", "of.literal", "of.tokens")).alias("head"))
        heads = heads.groupBy("leaf").agg(F.sort_array(F.collect_list("head"), asc=False).alias("heads"))
        heads = heads.select("leaf", (_leaders(F.col("heads")) if width > 1 else F.col("heads")).alias("heads"))
        fits = F.get(F.filter("heads", lambda x: _like(x, F.col("of"))), F.lit(0))["h"]
        tried = rest.join(heads, "leaf").select("h", "leaf", "docs", "of", fits.alias("template"))
        tried = scratch.written(tried.withColumn("of", F.when(F.col("template").isNull(), F.col("of"))), "groups")
        done.append(tried.where("template is not null").select("h", "template"))
        rest, width = tried.where("template is null").drop("template"), min(4 * width, WIDEST)
        if rest.isEmpty():
            return reduce(DataFrame.union, done)


def recurring_lines(docs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, template): the lines of recurring templates."""
    by_doc = lines.groupBy("h", "leaf", "n", "doc_id").agg(F.min(F.struct("line_no", "text_key")).alias("at"))
    distinct = by_doc.groupBy("h", "leaf", "n").agg(F.min(F.struct("doc_id", "at")).alias("place"), F.count("*").alias("docs"))
    distinct = scratch.written(distinct.select("h", "leaf", "n", F.col("place.doc_id").alias("first"), "place.at", "docs"), "lines")
    shared = distinct.where(f"n > {LEADING}").groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1").select("leaf")
    wanted = distinct.join(shared, "leaf", "left_semi").groupBy(F.col("first").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(F.collect_list(F.struct("h", "leaf", "docs", "at.line_no")).alias("wanted"))
    numbers = lambda t: F.transform(t, lambda x: F.when(x == WILD, 0).otherwise(F.xxhash64(x)))
    tokens_of = lambda line: let(_masked(line), lambda t: F.struct(numbers(t).alias("tokens"), F.size(F.filter(t, lambda x: x != WILD)).alias("literal")))
    lines_of = let(F.split("text", "\n"), lambda of: F.transform("wanted", lambda w: F.struct(w["h"].alias("h"), w["leaf"].alias("leaf"), w["docs"].alias("docs"), tokens_of(F.get(of, w["line_no"])).alias("of"))))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(wanted, ["doc_id", "text_key"]).select(F.explode(lines_of).alias("w")).select("w.*")
    groups = similar_groups(scratch.written(texts.dropDuplicates(["h"]) if _repeats(docs) else texts, "tokens"), scratch)
    named = scratch.written(distinct.join(groups, "h", "left").withColumn("template", F.coalesce("template", "h")), "named")
    merged = named.groupBy("template").agg(F.min("first").alias("first"), F.max("docs").alias("docs"), F.sum("docs").alias("most"), F.max("first").alias("last"), F.min("n").alias("n"))
    # no fewer documents than a line of it has, or two if its lines begin in two; no more than their sum
    merged = merged.withColumn("docs", F.greatest("docs", F.when(F.col("first") < F.col("last"), 2).otherwise(1)))
    surely, perhaps = _enough(F.col("n"), F.col("docs")), _enough(F.col("n"), F.col("most"))
    merged = scratch.written(merged.where(perhaps).select("template", "n", surely.alias("surely")), "templates")
    open_ = named.join(merged.where("not surely").select("template"), "template").select("h", "template")
    counted = lines.select("h", "doc_id").join(open_, "h").select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    more = merged.where("not surely").join(counted, "template").where(_enough(F.col("n"), F.col("docs")))
    return named.join(merged.where("surely").select("template").union(more.select("template")), "template").select("h", "template")


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def _copies(lines: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): documents that have `COPY` of their tokens, and of the other's, in lines that another document has first."""
    first = scratch.written(found.groupBy("template").agg(F.min("doc_id").alias("first")), "first")
    parts = found.join(first, "template").where("doc_id <> first").groupBy("doc_id", "first").agg(F.sum("n").alias("part"))
    parts = parts.groupBy("doc_id").agg(F.max(F.struct("part", "first")).alias("most")).select("doc_id", "most.*")
    sizes = scratch.written(lines.groupBy("doc_id").agg(F.sum("n").alias("size")), "sizes")
    both = parts.join(sizes, "doc_id").join(sizes.select(F.col("doc_id").alias("first"), F.col("size").alias("other")), "first")
    return scratch.written(components(both.where(f"part >= {COPY} * greatest(size, other)").select(F.col("doc_id").alias("a"), F.col("first").alias("b")), scratch), "copies")


def recurring_drops(docs: DataFrame, spare_copies: bool = False) -> DataFrame:
    """(doc_id, text_key, lines): the numbers of the lines that go, for each text that loses any.

    spare_copies: a document and those that are copies of it by `COPY` of their lines
    count as one, so that they stay copies for a near-duplicate search: what only
    they have isn't dropped, and what others have as well is dropped from all of
    them. Other documents than copies come first.
    """
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.written(line_rows(docs.select("doc_id", "text")), "line-rows")
        recurring = scratch.written(recurring_lines(docs, lines, scratch), "recurring")
        found = scratch.written(lines.select("doc_id", "text_key", "line_no", "h", "n").join(recurring, "h").drop("h"), "found")
        if spare_copies:
            copies = _copies(lines, found, scratch).withColumnRenamed("id", "doc_id")
            found = found.join(copies, "doc_id", "left").withColumns({"group": F.coalesce("component", "doc_id"), "late": F.coalesce(F.col("doc_id") != F.col("component"), F.lit(False))})
        else:
            found = found.withColumns({"group": F.col("doc_id"), "late": F.lit(False)})
        # written, so that the join is a stage of its own, which Spark can split where one template has many rows
        first = scratch.written(found.groupBy("template").agg(F.min(F.struct("late", "doc_id", "group"))["group"].alias("first")), "first")
        drops = found.join(first, "template").where("group <> first").groupBy("doc_id", "text_key")
        return written(drops.agg(F.collect_set("line_no").alias("lines")), "drops")


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs without the lines of drops, and `dropped_lines` (their numbers, from 0)."""
    rows = docs.select(F.struct("*").alias("d"), "doc_id", F.xxhash64("text").alias("text_key"))
    left = lambda of: F.transform(F.array_except(F.sequence(F.lit(0), F.size(of) - 1), "lines"), lambda i: F.get(of, i))
    text = F.when(F.col("lines").isNull(), F.col("d.text")).otherwise(F.array_join(let(F.split("d.text", "\n"), left), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("d")[c].alias(c) for c in docs.columns if c != "dropped_lines"]
    return rows.join(drops, ["doc_id", "text_key"], "left").select(*columns, F.coalesce(F.sort_array("lines"), F.expr("cast(array() as array<int>)")).alias("dropped_lines"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with their lines of recurring templates dropped, and `dropped_lines` (their numbers, from 0)."""
    return without_lines(docs, recurring_drops(docs))
