"""Main text of web pages by wrapper induction.

Pages of a host that use the same sectioning elements and division ids have one
layout. For each layout with enough pages one page stands for it; pages of rarer
layouts go to their host's main one. Every page's DOM tree is aligned with its
layout's page by simple tree matching. Over all pages that gives, for each node of
the layout, how often its text is the same, and how much running text, not link
text, stands in or under it.

A text that most pages repeat in its place is template. Where texts vary there are
slots, and the main content is the deepest element that holds most of their running
text, widened to the article or main element around it, or to the headings and
paragraphs beside it; what holds the main heading goes before what has more text. A page's
main text is what it has under its own counterpart of that element, without the texts that
nearly all pages have there (headings stay), and without menus, footers, sidebars, forms,
notices, adverts and comments inside it, told by their elements or by whole names
of class, id or role, or as lists of like records after the text, or as articles within or apart from
the main ones. All articles beside each other are main text.

A page that has no layout (its host has one page only), or no text in that place,
is looked at alone: the article or main element with the main heading or the most running text, and those beside it, else
the deepest element with most of the page's.

Pages of a host with the same source count once, so copies of one page don't make
it a template; a layout needs `MIN_PAGES` different pages before anything is. If
all of a page's main text is template, it is kept.

Two passes read the pages. The first keeps numbers only. What the second needs of
each layout, its page and the numbers of its nodes, is joined by host and layout;
Spark sends it to the workers if it is small, else it shuffles.

A null or empty page, or one without text, has the empty text. Pages without a
host share the empty host. Rows that repeat are extracted again. Other columns
are carried along, but for `main_text`, which the result's own replaces. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.html_tree import Node, in_order, match, measured, parse
from tallyframe.llm.shared import Scratch, written
from tallyframe.llm.url_filter import host

MIN_PAGES = 5
TEMPLATE_SHARE = 0.6
#: Within the main text only what so many pages repeat is template.
FIXED_SHARE = 0.9
#: An element is gone into if it holds this share of the running text around it.
MAIN_SHARE = 0.6

#: What holds the main heading is gone into if it has this share of the running text besides, whatever else has more.
TITLED_SHARE = 0.05
#: A record of a list begins with a text of at most so many characters.
BYLINE = 60

#: Elements and names of what surrounds a main text. A name counts if all its parts stand here, and one in the second list.
OUTSIDE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "input", "canvas", "video", "audio", "map"}
OUTSIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted
    sidebar sidenav aside menu menus dropdown nav navbar navigation topbar toolbar breadcrumb breadcrumbs pagination pager
    footer colophon masthead contentinfo complementary copyright cookie cookies consent gdpr notice notices alert popup modal overlay
    newsletter subscribe subscription signup paywall disclaimer share sharing social related recommended recommendations
    comment comments commentlist respond responses reply replies feedback disqus login search searchform widget widgets tags hidden""".split()
)
NEUTRAL_NAMES = frozenset("site page top bottom left right main box bar container wrapper wrap block section list area form link links button buttons icons thread primary secondary global post posts articles unit slot inner".split())
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dt", "dd", "td", "th", "figcaption", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RECORD_TAGS = {"div", "li", "article", "section"}
LIGHT_TAGS = TEXT_TAGS | {"#", "header", "hgroup", "hr", "figure", "ul", "ol", "dl"}

PLACES = "host string, rep long, same_page long, node int, equal boolean, running long"


def _named_outside(names: frozenset) -> bool:
    for name in names:
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if any(x in OUTSIDE_NAMES for x in parts) and all(x in OUTSIDE_NAMES or x in NEUTRAL_NAMES for x in parts):
            return True
    return False


class Page:
    """A page's tree; heads: what holds a main heading; outside: what isn't main text; running: for each node its own running text, weighed."""

    def __init__(self, source: str):
        self.root = parse(source)
        self.order = measured(self.root)
        self.heads = heads = [False] * len(self.order)
        for x in reversed(self.order):
            heads[x.number] = x.tag in ("h1", "main") or any(heads[c.number] for c in x.children)
        self.outside = [False] * len(self.order)
        self.running = [0] * len(self.order)
        for x in self.order:
            k = x.number
            if x.parent is not None and self.outside[x.parent.number]:
                self.outside[k] = True
            elif x.tag in OUTSIDE_TAGS and not (x.tag in ("form", "fieldset") and heads[k]):
                self.outside[k] = True
            elif x.names and x.tag not in ("html", "body", "main") and not heads[k]:
                self.outside[k] = _named_outside(x.names)
            if x.tag == "#" and not self.outside[k]:
                self.running[k] = (len(x.text) - x.linked) * (3 if x.parent.tag in TEXT_TAGS else 1)

    def totals(self, running: list[int]) -> list[int]:
        """For each node the running text in and under it."""
        out = list(running)
        for x in reversed(self.order):
            if x.parent is not None:
                out[x.parent.number] += out[x.number]
        return out

    def region(self, running: list[int]) -> Node:
        """The element of the main text."""
        total, node = self.totals(running), self.root
        titles = any(x.tag in HEADINGS for x in self.order)
        plain = total if not titles else self.totals([0 if x.tag == "#" and x.parent.tag in HEADINGS else n for x, n in zip(self.order, running, strict=True)])
        while total[node.number]:
            inner = [c for c in node.children if c.tag != "#" and c.tag not in TEXT_TAGS]
            best = max(inner, key=lambda c: total[c.number], default=None)
            titled = [c for c in inner if self.heads[c.number] and c.tag not in OUTSIDE_TAGS | {"header"} and plain[c.number] >= TITLED_SHARE * max(plain[node.number], 1)]
            if len(titled) == 1:
                best = titled[0]
            elif best is None or total[best.number] < MAIN_SHARE * total[node.number]:
                break
            node = best
        up = node
        while up is not None:
            if _semantic(up):
                return up
            up = up.parent
        light = lambda c: c.tag in LIGHT_TAGS or self.heads[c.number]
        while node.parent is not None and node.parent.tag not in ("root", "html", "body") and all(c is node or light(c) for c in node.parent.children):
            node = node.parent
        return node

    def alone(self) -> Node:
        total = self.totals(self.running)
        named = [x for x in self.order if _semantic(x) and total[x.number] and not self.outside[x.number]]
        under = {id(y) for x in named for y in _above(x)}
        inner = [x for x in named if id(x) not in under]
        if not inner:
            return self.region(self.running)
        group = self.main_group(inner)
        return group[0] if len(group) == 1 else group[0].parent

    def main_group(self, articles: list[Node]) -> list[Node]:
        """Of elements with one parent each: those that stand beside each other and have the main heading, else the most running text."""
        total, groups = self.totals(self.running), defaultdict(list)
        for x in articles:
            groups[id(x.parent)].append(x)
        return max(groups.values(), key=lambda g: (any(self.heads[x.number] for x in g), sum(total[x.number] for x in g)))

    def foreign(self, region: Node) -> set[int]:
        """What stands inside the main text and isn't of it: articles inside or apart from the main ones, and lists of records after it.

        Records are elements beside each other with the same tag and names, each with a short text, not a
        sentence, and more after it, but without a heading; what comes after the last isn't running text.
        """
        inside = in_order(region)
        if not any(x.tag in RECORD_TAGS for x in inside[1:]):
            return set()
        articles = [x for x in inside if x.tag == "article" and x is not region]
        nested = {id(x) for x in articles if any(y.tag == "article" for y in _above(x))}
        out = {x.number for x in articles if id(x) in nested}
        apart = [x for x in articles if id(x) not in nested]
        if apart:
            kept = {id(x) for x in self.main_group(apart)}
            out |= {x.number for x in apart if id(x) not in kept}
        last = max((x.number for x in inside if x.tag == "#" and self.running[x.number] and not (out and any(y.number in out for y in _above(x)))), default=-1)
        first = min((x.number for x in inside if x.tag == "#" and self.running[x.number] and x.parent.tag not in HEADINGS), default=-1)
        for x in inside:
            kinds = defaultdict(list)
            for c in x.children if len(x.children) > 1 else ():
                if c.tag in RECORD_TAGS and c.number > first:
                    kinds[c.tag, c.names].append(c)
            for group in kinds.values():
                if len(group) > 1 and _end(group[-1]) >= last and all(map(_is_record, group)):
                    rest = [c for c in x.children if c not in group]
                    texts = [y for c in rest for y in in_order(c) if y.tag == "#"]
                    if x is not region and all(len(y.text) <= BYLINE for y in texts):
                        out.add(x.number)  # with its heading
                    else:
                        out |= {c.number for c in group}
                        before = [c for c in x.children if c.number < group[0].number]
                        if before and before[-1].tag in HEADINGS - {"h1"}:
                            out.add(before[-1].number)
        return out

    def blocks(self, region: Node) -> list[Node]:
        """The region's text blocks that no element inside it puts outside."""
        out, todo, foreign = [], [region], self.foreign(region)
        while todo:
            x = todo.pop()
            if x.tag == "#":
                out.append(x)
            elif x is region or not (x.number in foreign or x.tag in OUTSIDE_TAGS or _named_outside(x.names)):
                todo.extend(reversed(x.children))
        return out


def _above(x: Node) -> Iterator[Node]:
    while x.parent is not None:
        x = x.parent
        yield x


def _end(x: Node) -> int:
    """The number of the last node in x."""
    while x.children:
        x = x.children[-1]
    return x.number


def _is_record(x: Node) -> bool:
    inside = in_order(x)
    texts = [y for y in inside if y.tag == "#"]
    return len(texts) > 1 and len(texts[0].text) <= BYLINE and texts[0].text[-1] not in ".!?:;" and not any(y.tag in HEADINGS for y in inside)


def _semantic(x: Node) -> bool:
    return x.tag in ("article", "main") or "main" in x.names and x.tag not in ("html", "body")


class Wrapper:
    """A layout's page with what all pages say of its nodes: the element of the main text, and the constant texts."""

    def __init__(self, source: str, pages: int = 0, profile: list[dict] | None = None):
        self.page = Page(source)
        self.region, self.constant, self.fixed = None, set(), set()
        #: The same text in the same kind of element is the same node, wherever the blocks before it have moved it.
        self.by_text = {(x.parent.tag, x.text): x.number for x in reversed(self.page.order) if x.tag == "#"}
        if profile:
            running = [0] * len(self.page.order)
            for p in profile:
                if pages >= MIN_PAGES and p["equal"] >= TEMPLATE_SHARE * pages:
                    self.constant.add(p["node"])
                    if p["equal"] >= FIXED_SHARE * pages and self.page.order[p["node"]].parent.tag not in HEADINGS:
                        self.fixed.add(p["node"])
                else:
                    running[p["node"]] = p["running"]
            self.region = self.page.region(running).number


class _Kept:
    """The last few wrappers of a worker."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, OrderedDict()

    def get(self, key: tuple, *of) -> Wrapper:
        if key not in self.held:
            self.held[key] = Wrapper(*of)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]


def _counted(page: Page, wrapper: Wrapper) -> Iterator[tuple[int, bool | None, int]]:
    """(node of the layout, whether its text is there, running text) of a page."""
    pairs = {x.number: y for x, y in match(page.root, wrapper.page.root)}
    under: dict[int, int] = defaultdict(int)
    for x in page.order:
        if x.tag != "#":
            continue
        if (same := wrapper.by_text.get((x.parent.tag, x.text))) is not None:
            yield same, True, page.running[x.number]
        elif x.number in pairs:
            yield pairs[x.number].number, False, page.running[x.number]
        elif page.running[x.number]:
            up = x.parent
            while up.number not in pairs:
                up = up.parent
            under[pairs[up.number].number] += page.running[x.number]
    for node, running in under.items():
        yield node, None, running


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, kinds = _Kept(), [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
    names = ["host", "rep", "same_page", "node", "equal", "running"]
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch, rows = whole.slice(at, 256), []
            for name, rep, same, source, first in zip(*(batch.column(c).to_pylist() for c in ("host", "rep", "hash", "html", "first")), strict=True):
                rows += [(name, rep, same, *x) for x in _counted(Page(source), kept.get((name, rep), first))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def main_text(source: str, wrapper: Wrapper | None = None) -> str:
    page = Page(source)
    region, constant = None, set()
    if wrapper is not None and wrapper.region is not None:
        for x, y in match(page.root, wrapper.page.root):
            if y.number == wrapper.region:
                region = x
                break
        constant = {x.number for x in page.order if x.tag == "#" and wrapper.by_text.get((x.parent.tag, x.text)) in wrapper.fixed}
    blocks = page.blocks(region) if region is not None else []
    if not any(page.running[x.number] for x in blocks):
        blocks = page.blocks(page.alone())
    return "\n\n".join(x.text for x in [x for x in blocks if x.number not in constant] or blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = _Kept()
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch, out = whole.slice(at, 256), []
            for name, rep, source, first, pages, profile in zip(*(batch.column(c).to_pylist() for c in ("host", "rep", "html", "first", "pages", "profile")), strict=True):
                out.append(main_text(source or "", kept.get((name, rep), first, pages, profile) if first is not None else None))
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(out, pa.string())], ["page", "main_text"])


def layout(page: Column) -> Column:
    """A hash of the sectioning elements and division ids that a page uses."""
    tags = F.regexp_extract_all(page, F.lit(r"""(?i)<(?:nav|header|footer|aside|main|article|section|form)[\s>/]|<div\s(?:[^>]*?\s)?id=["']?[a-z_-]+["'\s>]"""), F.lit(0))
    names = F.transform(tags, lambda x: F.lower(F.regexp_replace(x, r"(?is)^<div.*\s|\s$|[/>]$", "")))
    return F.xxhash64(F.array_sort(F.array_distinct(names)))


def layouts(named: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(host, layout, rep): for each layout the hash of the page that stands for it; (host, rep, first): these pages."""
    distinct = named.groupBy("host", "layout", "hash").agg(F.count("*").alias("rows"))
    found = scratch.written(distinct.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min("hash").alias("own")), "layouts")
    main = found.groupBy("host").agg(F.sum("pages").alias("all"), F.max(F.struct("pages", "own"))["own"].alias("main"))
    rep = F.when(F.col("pages") >= MIN_PAGES, F.col("own")).when(F.col("all") > 1, F.col("main"))
    reps = written(found.join(main, "host").select("host", "layout", rep.alias("rep")).where("rep is not null"), "layout-pages")
    firsts = named.join(reps.select("host", F.col("rep").alias("hash")).distinct(), ["host", "hash"]).select("host", F.col("hash").alias("rep"), F.col("html").alias("first"))
    return reps, scratch.written(firsts.dropDuplicates(["host", "rep"]), "first-pages")


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, layout, rep), and (host, rep, first, pages, profile): each layout's page and the counts of its nodes."""
    with Scratch(pages.sparkSession) as scratch:
        named = pages.where("html <> ''").select("host", "layout", F.xxhash64("html").alias("hash"), "html")
        reps, firsts = layouts(named, scratch)
        aligned = named.join(reps, ["host", "layout"]).join(firsts, ["host", "rep"]).select("host", "rep", "hash", "html", "first")
        placed = scratch.written(aligned.mapInArrow(_places, PLACES).distinct(), "places")
        seen = placed.groupBy("host", "rep").agg(F.count_distinct("same_page").alias("pages"))
        nodes = placed.groupBy("host", "rep", "node").agg(F.count_if("equal").alias("equal"), F.sum("running").alias("running"))
        profile = nodes.groupBy("host", "rep").agg(F.collect_list(F.struct("node", "equal", "running")).alias("profile"))
        return reps, written(firsts.join(seen, ["host", "rep"]).join(profile, ["host", "rep"]), "templates")


def extract_text(pages: DataFrame, drop_html: bool = False) -> DataFrame:
    """pages with `main_text`. drop_html: leave the html column out."""
    at = host(F.col("url")).alias("host"), layout(F.col("html")).alias("layout")
    reps, found = templates(pages.select(*at, "html"))
    page = F.struct(*[c for c in pages.columns if c != "main_text" and not (drop_html and c == "html")]).alias("page")
    joined = pages.select(page, *at, "html").join(reps, ["host", "layout"], "left").join(found, ["host", "rep"], "left")
    kind = joined.select("page").schema["page"].dataType.simpleString()
    sides = joined.select("page", "host", "rep", "html", "first", "pages", "profile").sortWithinPartitions("host", "rep")
    return sides.mapInArrow(_extract, f"page {kind}, main_text string").select("page.*", "main_text")
