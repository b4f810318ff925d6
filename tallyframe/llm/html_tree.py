"""A lenient HTML parser for text blocks, and simple tree matching."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: The third group: the attributes of a tag without quotes, which ends there.
MARKUP = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/<>]*)(?:([^<>"']*)>)?|<[!?][^<>]*>?""")
UNQUOTED = re.compile(r"""[^<>"']*""")
VALUE = re.compile(r"=\s{0,8}\Z")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

RAW = {"script", "style", "noscript", "textarea", "title", "template", "iframe", "svg", "select", "option", "object", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "ins", "del", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: An open element of the second kind ends where one of the first begins, unless an element of NESTS stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
NESTS = ("ul", "ol", "dl", "table")


@dataclass(slots=True, eq=False)
class Node:
    """An element, or a text block (tag `#`, with its text, and how many of its characters are links)."""

    tag: str
    names: frozenset = frozenset()
    text: str = ""
    linked: int = 0
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    size: int = 1
    shape: int = 0
    number: int = 0


class _Open:
    """The open elements, and where those of each tag stand."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags: tuple) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(source: str) -> Node:
    """The tree of block elements; each longest run of inline content is one text block."""
    root = Node("root")
    stack, run = _Open(root), []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            top = stack.nodes[-1]
            top.children.append(Node("#", text=text, linked=min(linked, len(text)), parent=top))
        run.clear()
        linked = 0

    at, n = 0, len(source)
    unclosed: set[str] = set()
    while at < n:
        m = MARKUP.search(source, at)
        part = source[at : m.start() if m else n]
        run.append(part)
        linked += len(part) if links else 0
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = source.find("-->", at)
                at = end + 3 if end >= 0 else n
            continue
        attributes = m[3]
        if attributes is None:
            attributes, at = _tag_end(source, at, unclosed)
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            run.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
        elif closing:
            if stack.at.get(tag):
                flush()
                stack.cut(stack.at[tag][-1])
        elif tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^<>]*>?", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
        else:
            flush()
            links = 0
            if stack.nodes[-1].tag == "p":
                stack.cut(len(stack.nodes) - 1)
            if tag in ENDS and (place := stack.last(ENDS[tag])) > stack.last(NESTS):
                while (place - 1) and stack.nodes[place - 1].tag in ENDS[tag]:
                    place -= 1
                stack.cut(place)
            if tag in VOID:
                continue
            top = stack.nodes[-1]
            node = Node(tag, _names(attributes), parent=top)
            top.children.append(node)
            if not attributes.endswith("/"):
                stack.push(node)
    flush()
    return root


def _tag_end(source: str, at: int, unclosed: set[str]) -> tuple[str, int]:
    """A tag's attributes, and where what follows begins.

    A quote opens a value only after `=`, and only if it is closed somewhere (unclosed: the quotes of which
    none is left). A tag that isn't closed ends where the next one begins, so no part of a page is read twice.
    """
    begin = at
    while True:
        at = UNQUOTED.match(source, at).end()
        if at == len(source) or source[at] == "<":
            return source[begin:at], at
        quote = source[at]
        if quote == ">":
            return source[begin:at], at + 1
        close = source.find(quote, at + 1) if quote not in unclosed and VALUE.search(source, max(begin, at - 9), at) else -1
        if close < 0 and quote not in unclosed and source.find(quote, at + 1) < 0:
            unclosed.add(quote)
        at = close + 1 if close >= 0 else at + 1


def _names(attributes: str) -> frozenset:
    """Classes, id and role in lower case, whole, without a number at the end."""
    if not attributes or "=" not in attributes:
        return frozenset()
    found = [w for m in ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()]
    return frozenset(re.sub(r"[-_]?\d+$", "", w) for w in found) - {""}


def in_order(root: Node) -> list[Node]:
    """All nodes in page order: node k has number k."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(reversed(x.children))
    return order


def measured(root: Node) -> list[Node]:
    """All nodes in page order, with numbers, sizes (the weight of a tree matched with its like) and shapes (equal for equal structure)."""
    order = in_order(root)
    for k, x in enumerate(order):
        x.number = k
    for x in reversed(order):
        x.size = (2 if x.names else 1) + sum([c.size for c in x.children])
        x.shape = hash((x.tag, x.names, *[c.shape for c in x.children]))
    return order


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of nodes of the heaviest matching of two trees that keeps order and ancestry.

    Nodes match if their tags are equal; a pair weighs 1, and 1 more for equal names.
    """
    pairs: list[tuple[Node, Node]] = []
    weights = Weights()
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.children and y.children:
            todo.extend(aligned(x.children, y.children, weights))
    return pairs


#: Lists with more pairs of different shapes than this, and all once so many weights are known, are weighed in whole rows:
#: the weights are the same either way. The last: weights of rows that are kept for another use.
SHAPES, KNOWN, CELLS = 256, 1 << 18, 1 << 22
#: More than any tree weighs; and what no sum outweighs.
BEYOND, NEVER = 1 << 32, -(1 << 62)


class Weights:
    """Weights of pairs of trees by their shapes; deep trees are no matter, as nothing calls itself."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def ready(self, x: Node, y: Node) -> int | None:
        if x.tag != y.tag:
            return 0
        if x.shape == y.shape:
            return x.size
        if not x.children or not y.children:
            return _own(x, y)
        return self.known.get((x.shape, y.shape))

    def __call__(self, x: Node, y: Node) -> int:
        if (w := self.ready(x, y)) is not None:
            return w
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if self.ready(x, y) is not None:
                todo.pop()
                continue
            xs, ys, ends = trimmed(x.children, y.children)
            kinds_x, kinds_y = {c.shape: c for c in xs}.values(), {c.shape: c for c in ys}.values()
            missing = [] if self.wide(len(kinds_x), len(kinds_y)) else [(c, d) for c in kinds_x for d in kinds_y if self.ready(c, d) is None]
            if missing:
                todo.extend(missing)
                continue
            todo.pop()
            self.known[x.shape, y.shape] = _own(x, y) + sum(c.size for c, _ in ends) + (int(self.last_row(xs, ys)[-1]) if xs and ys else 0)
        return self.known[x.shape, y.shape]

    def wide(self, kinds_x: int, kinds_y: int) -> bool:
        return kinds_x * kinds_y > SHAPES or len(self.known) > KNOWN

    def rows(self, xs: list[Node], ys: list[Node]) -> Iterator[np.ndarray]:
        """For each of xs its weights with all of ys."""
        kinds_x, kinds_y = {c.shape: c for c in xs}, {d.shape: d for d in ys}
        if self.wide(len(kinds_x), len(kinds_y)):
            kinds = Kinds(ys)
            return (kinds.weights(x)[kinds.at] for x in xs)
        place = {shape: k for k, shape in enumerate(kinds_y)}
        at = np.array([place[d.shape] for d in ys])
        rows = {c.shape: np.array([self(c, d) for d in kinds_y.values()])[at] for c in kinds_x.values()}
        return (rows[x.shape] for x in xs)

    def last_row(self, xs: list[Node], ys: list[Node]) -> np.ndarray:
        """The weight of the best alignment of xs with each beginning of ys."""
        best = np.zeros(len(ys) + 1, np.int64)
        for row in self.rows(xs, ys):
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row))
        return best


class Kinds:
    """The different trees of a list, and under them those of their children: a tree is weighed with all of them at once.

    The children of all kinds are one row of sums, in which each kind's begin `BEYOND` higher than those before it,
    so one running maximum serves them all. Memory is that of the list's own nodes, for each open element of the tree.
    """

    def __init__(self, nodes: list[Node], above: Kinds | None = None):
        trees = {d.shape: d for d in nodes}
        self.trees, self.place = list(trees.values()), {shape: k for k, shape in enumerate(trees)}
        self.at = np.array([self.place[d.shape] for d in nodes], np.int64)
        self.ids: dict[object, int] = {}
        self.tags = np.array([self.ids.setdefault(d.tag, len(self.ids)) for d in self.trees])
        self.names = np.array([self.ids.setdefault(d.names, len(self.ids)) for d in self.trees])
        self.nesting = {d.tag for d in self.trees if d.children}
        self.kept: dict[tuple[int, int], np.ndarray] = above.kept if above else {}
        self.level = above.level + 1 if above else 0
        self._below: Kinds | None = None

    def below(self) -> Kinds:
        if self._below is None:
            self._below = Kinds([c for d in self.trees for c in d.children], self)
            many = np.array([len(d.children) for d in self.trees])
            self.ends = np.cumsum(many + 1) - 1
            self.base = np.arange(len(many)) * BEYOND
            self.begin = np.repeat(self.base, many + 1)
            self.source = np.full(len(self.begin), len(self._below.trees))
            self.source[np.delete(np.arange(len(self.begin)), self.ends - many)] = self._below.at
        return self._below

    def own(self, x: Node) -> np.ndarray:
        same = self.tags == self.ids.get(x.tag, -1)
        return np.where(same & (self.names == self.ids.get(x.names, -1)), 2, same) if x.names else same.astype(np.int64)

    def ready(self, x: Node) -> np.ndarray | None:
        if (row := self.kept.get((self.level, x.shape))) is None and (x.tag not in self.nesting or not x.children):
            row = np.append(self.own(x), NEVER)
        return row

    def weights(self, x: Node) -> np.ndarray:
        """The weights of x with each kind, and `NEVER`."""
        todo: list[list] = [[x, self, None, 0]]  # an element, the kinds at its depth, the best sums, its children so far
        row = None
        while todo:
            node, kinds, best, done = todo[-1]
            if row is not None:
                best[1:] = np.maximum(best[1:], best[:-1] + row[kinds.source[1:]])
                np.maximum.accumulate(best, out=best)
                todo[-1][3] = done = done + 1
                row = None
            elif (row := kinds.ready(node)) is not None:
                todo.pop()
                continue
            else:
                kinds.below()
                todo[-1][2] = best = kinds.begin.copy()
            if done < len(node.children):
                todo.append([node.children[done], kinds.below(), None, 0])
            else:
                todo.pop()
                row = kinds.whole(node, best)
        return row

    def whole(self, x: Node, best: np.ndarray) -> np.ndarray:
        own = self.own(x)
        row = np.append(np.where(own > 0, own + best[self.ends] - self.base, 0), NEVER)
        if len(self.kept) * len(row) > CELLS:
            self.kept.clear()
        self.kept[self.level, x.shape] = row
        return row


def _own(x: Node, y: Node) -> int:
    return 2 if x.names and x.names == y.names else 1


def trimmed(xs: list[Node], ys: list[Node]) -> tuple[list[Node], list[Node], list[tuple[Node, Node]]]:
    """Both lists without what has equal shape at either end: matching that first is never worse."""
    lo, hi_x, hi_y = 0, len(xs), len(ys)
    while lo < min(hi_x, hi_y) and xs[lo].shape == ys[lo].shape:
        lo += 1
    while hi_x > lo and hi_y > lo and xs[hi_x - 1].shape == ys[hi_y - 1].shape:
        hi_x, hi_y = hi_x - 1, hi_y - 1
    return xs[lo:hi_x], ys[lo:hi_y], list(zip(xs[:lo], ys[:lo], strict=True)) + list(zip(xs[hi_x:], ys[hi_y:], strict=True))


def aligned(xs: list[Node], ys: list[Node], weights: Weights) -> list[tuple[Node, Node]]:
    """The pairs of the best alignment, in linear space: xs is halved where both halves' best sums meet."""
    out, todo = [], [(xs, ys)]
    while todo:
        xs, ys, ends = trimmed(*todo.pop())
        out += ends
        if len(weights.known) > KNOWN:
            weights.known.clear()
        if not xs or not ys:
            continue
        if len(xs) == 1 or len(ys) == 1:
            one, many = (xs[0], ys) if len(xs) == 1 else (ys[0], xs)
            w = [weights(one, m) if len(xs) == 1 else weights(m, one) for m in many]
            k = max(range(len(many)), key=w.__getitem__)
            if w[k]:
                out.append((one, many[k]) if len(xs) == 1 else (many[k], one))
            continue
        half = len(xs) // 2
        before, after = weights.last_row(xs[:half], ys), weights.last_row(xs[half:][::-1], ys[::-1])[::-1]
        cut = int(np.argmax(before + after))
        todo += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
    return out
