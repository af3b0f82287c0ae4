"""Main text of web pages by wrapper induction: same-host DOM trees aligned by simple tree matching."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Generator, Iterator
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record_batch, small_batches, store

#: A node of a layout's reference page, or a block at a path of a host, is template if its text is the same on so many pages, and so large a share of those that have the node or path.
TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.6
#: Reference pages and wrappers are broadcast up to this size; larger ones are joined by host in a shuffle.
BROADCAST_BYTES = 16 << 20

# Classes of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Elements that make up the layout of a page, down to a depth below the page.
SECTIONS = set("html body div section main article aside header footer nav form table".split())
LAYOUT_DEPTH = 5
# Elements, and words of class, id and role attributes, that aren't part of an article.
NO_TEXT = set("head title nav footer aside form button select option input label menu dialog noscript template svg iframe object audio video canvas textarea datalist".split())
APART = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice banner comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay sidebar nav navbar navigation navigationbar menu breadcrumb breadcrumbs pagination pager widget login signup search skip copyright complementary contentinfo alert dialog".split())
APART_OUTSIDE = {"header", "footer", "masthead", "topbar", "toolbar", "site-header", "site-footer", "page-header", "page-footer", "top", "bottom"}

# Elements whose content is no markup.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style xmp noembed noframes iframe".split()}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
#: A whole tag of common form; whatever else is a tag is found step by step. The bounds keep a failed try short.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,40}+)(?=[\s/>])((?:[^>\"']{0,200}+(?:\"[^\"]{0,200}+\"|'[^']{0,200}+')){0,8}+[^>\"']{0,200}+)>")
#: Cells of a table that an alignment holds at once; larger tables are worked through by parts, with the same result.
CELLS = 4_000_000
#: Pairs of shapes from which their sizes are worked out together, for shapes with so few children.
TOGETHER = 256
FEW_KIDS = 64
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_APART_WORD = re.compile(r"[\s_-]+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element: its name, what its attributes say, its children (elements and texts), and numbers once counted."""

    __slots__ = ("tag", "marks", "hidden", "kids", "label", "number", "shape")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, self.hidden, self.number, self.shape = tag, [], False, -1, -1
        marks = []
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                    self.hidden = True
                elif name in ("class", "id", "role"):
                    marks += value.split()
        self.marks = marks
        self.label = f"{tag}.{marks[0]}" if marks else tag

    def elements(self) -> list[Node]:
        return [k for k in self.kids if k.__class__ is not str]

    def own_text(self) -> str:
        """Its texts and those of inline elements inside, as one line."""
        if len(self.kids) < 2 and (not self.kids or self.kids[0].__class__ is str):
            return " ".join(self.kids[0].split()) if self.kids else ""
        out, stack = [], [*reversed(self.kids)]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            elif k.tag not in BLOCKS:
                stack.extend(reversed(k.kids))
        return " ".join("".join(out).split())


class Page(Node):
    """A page as a whole: the element around all others, and which numbering of shapes its elements have."""

    __slots__ = ("named",)

    def __init__(self):
        super().__init__("#page")
        self.named = None


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, name, attributes, text) of a page in one pass: kind is text, open or close.

    Comments, declarations and the content of RAW elements are left out. A quote without its partner is a character
    like others, and a tag that never ends is text; each stretch is read once, so the time follows the length.
    """
    at, n, quotes = 0, len(page), True
    last = {c: page.rfind(c) for c in (">", '"', "'")}
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last[">"] and not page.startswith("<!--", start):
            yield "text", "", "", page[at:]
            return
        if start > at:
            yield "text", "", "", page[at:start]
        if quotes and (whole := _TAG.match(page, start)):
            ending, tag, attributes = whole.groups()
            tag, at = tag.lower(), whole.end()
            yield ("close" if ending else "open"), tag, attributes, ""
            if tag in RAW and not ending:
                close = RAW[tag].search(page, at)
                yield "close", tag, "", ""
                at = close.end() if close else n
            continue
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        name = _NAME.match(page, start + 1)
        if not name:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
            else:
                yield "text", "", "", "<"
                at = start + 1
            continue
        end = name.end()
        while quotes:
            end = _PLAIN.match(page, end).end()
            mark = page[end : end + 1]
            if mark == ">":
                break
            if not mark:  # all that could end it is inside quotes: from here on quotes say nothing
                quotes = False
            else:
                end = page.find(mark, end + 1) + 1 if end < last[mark] else end + 1
        if not quotes:
            end = page.find(">", name.end())
        tag, attributes, at = name[2].lower(), page[name.end() : end], end + 1
        yield ("close" if name[1] else "open"), tag, attributes, ""
        if tag in RAW and not name[1]:
            close = RAW[tag].search(page, at)
            yield "close", tag, "", ""
            at = close.end() if close else n


class _Open:
    """The open elements, with the places of each name, so that no search walks through them."""

    def __init__(self, root: Node):
        self.stack, self.where = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.where[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.where[self.stack.pop().tag].pop()

    def top(self, tags: set[str]) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, tags: set[str], scope: set[str]) -> None:
        """End the innermost of some elements, if it lies inside the innermost of others."""
        at = self.top(tags)
        if at and at > self.top(scope):
            self.cut(at)


_P_SCOPE = {"td", "th", "table", "article", "section", "div", "button", "li"}


def parse(page: str | None) -> Node:
    """A tree of a page; open ends, stray ends and missing ends are mended as browsers do in simple cases."""
    root = Page()
    opened = _Open(root)
    stack, where = opened.stack, opened.where
    for kind, tag, attributes, text in tokens(page or ""):
        if kind == "text":
            stack[-1].kids.append(entities.unescape(text))
        elif kind == "close":
            if places := where.get(tag):
                opened.cut(places[-1])
        elif tag == "br":
            stack[-1].kids.append(" ")
        else:
            if tag in CLOSES_P and where.get("p"):
                opened.close({"p"}, _P_SCOPE)
            if tag in SIBLINGS:
                opened.close(SIBLINGS[tag], SCOPES[tag])
            node = Node(tag, attributes)
            stack[-1].kids.append(node)
            if tag not in VOID and not attributes.endswith("/"):
                opened.push(node)
    return root


class Shapes:
    """Shapes of subtrees, labels without texts, as numbers; and the sizes of their matches, each computed once."""

    MOST = 500_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.mark = object()
        self.known: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.matched: dict[tuple[int, int], int] = {}

    def name(self, root: Node) -> None:
        """Give every element of a tree the number of its shape, children before parents."""
        if root.__class__ is Page:
            if root.named is self.mark:
                return
            root.named = self.mark
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            inner = [k for k in node.kids if k.__class__ is not str]
            order.append((node, inner))
            stack += inner
        for node, inner in reversed(order):
            kids = tuple([k.shape for k in inner])
            key = node.label, kids
            if (number := self.known.get(key)) is None:
                number = self.known[key] = len(self.labels)
                self.labels.append(node.label)
                self.kids.append(kids)
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
            node.shape = number

    def middle(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int]:
        """How many equal shapes two lists begin with, and end with besides. To pair these is always best: no other
        partner matches a shape in more nodes than its like does."""
        lo = 0
        while lo < len(xs) and lo < len(ys) and xs[lo] == ys[lo]:
            lo += 1
        hi = 0
        while hi < len(xs) - lo and hi < len(ys) - lo and xs[-1 - hi] == ys[-1 - hi]:
            hi += 1
        return lo, hi

    def partners(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int, list[int], list[int]]:
        """The middle of two lists, and the places there of shapes whose label the other middle has too."""
        lo, hi = self.middle(xs, ys)
        labels, end_x, end_y = self.labels, len(xs) - hi, len(ys) - hi
        both = {labels[k] for k in xs[lo:end_x]} & {labels[k] for k in ys[lo:end_y]}
        if not both:
            return lo, hi, [], []
        return lo, hi, [i for i in range(lo, end_x) if labels[xs[i]] in both], [j for j in range(lo, end_y) if labels[ys[j]] in both]

    def weights(self, xs: list[int], ys: list[int]) -> Generator[tuple[int, int] | Generator, object, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sizes of the matches of distinct shapes of two lists, and which of them each place has. Asks for what it lacks."""
        ones, which = np.unique(xs, return_inverse=True)
        twos, other = np.unique(ys, return_inverse=True)
        small = np.zeros((len(ones), len(twos)), np.int32)
        groups = defaultdict(lambda: ([], []))
        for side, shapes in enumerate((ones.tolist(), twos.tolist())):
            for place, shape in enumerate(shapes):
                groups[self.labels[shape]][side].append((place, shape))
        for left, right in groups.values():
            if len(left) * len(right) >= TOGETHER:
                few = [(j, q) for j, q in right if len(self.kids[q]) <= FEW_KIDS]
                if few:
                    yield self.batch(left, few, small)
                right = [(j, q) for j, q in right if len(self.kids[q]) > FEW_KIDS]
            for i, p in left:
                for j, q in right:
                    known = self.sizes[p] if p == q else self.matched.get((p, q))
                    small[i, j] = (yield p, q) if known is None else known
        return small, which, other

    def batch(self, left: list[tuple[int, int]], right: list[tuple[int, int]], small: np.ndarray) -> Generator[Generator, tuple, None]:
        """Put the sizes of the matches of shapes of one label into a table: each shape of the left with all of the right
        at once, whose children are aligned side by side."""
        lists = [self.kids[q] for _, q in right]
        places = np.array([j for j, _ in right])
        later = sorted({k for kids in lists for k in kids})
        number = {k: i for i, k in enumerate(later)}
        table = np.full((len(lists), max(map(len, lists))), len(later))
        for i, kids in enumerate(lists):
            table[i, : len(kids)] = [number[k] for k in kids]
        at = 0
        while at < len(left):
            earlier, some = set(), at
            while some < len(left) and (some == at or len(earlier | set(self.kids[left[some][1]])) * len(later) <= CELLS):
                earlier |= set(self.kids[left[some][1]])
                some += 1
            own, place = np.zeros((len(earlier), len(later) + 1), np.int32), {k: i for i, k in enumerate(sorted(earlier))}
            if earlier and later:
                own[:, :-1] = (yield self.weights(sorted(earlier), later))[0]
            for i, p in left[at:some]:
                row = np.zeros((len(lists), table.shape[1] + 1), np.int32)
                for k in self.kids[p]:
                    row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + own[place[k]][table]), axis=1)
                small[i, places] = 1 + row[:, -1]
            at = some

    def parts(self, xs: list[int], ys: list[int]) -> list[slice]:
        """Stretches of the first list whose weights are held at once."""
        ones, twos = len(set(xs)), len(set(ys))
        step = len(xs) if ones * twos <= CELLS else max(1, CELLS // twos)
        return [slice(at, at + step) for at in range(0, len(xs), step)]

    def sizing(self, x: int, y: int) -> Generator[tuple[int, int] | Generator, object, int]:
        """Simple tree matching of two unlike shapes of one label. Asks for the sizes of pairs that aren't known."""
        xs, ys = self.kids[x], self.kids[y]
        lo, hi, left, right = self.partners(xs, ys)
        total = 1 + sum(self.sizes[k] for k in xs[:lo]) + sum(self.sizes[k] for k in xs[len(xs) - hi :])
        if left:
            xs, ys = [xs[i] for i in left], [ys[j] for j in right]
            row = np.zeros(len(ys) + 1, np.int64)
            for part in self.parts(xs, ys):
                small, which, other = yield from self.weights(xs[part], ys)
                for i in which.tolist():
                    row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + small[i][other]))
            total += int(row[-1])
        if len(self.matched) >= self.MOST:  # only saves work: who asks gets the answer
            self.matched.clear()
        self.matched[x, y] = total
        return total

    def answer(self, task: Generator):
        """What a task returns. Tasks wait on a stack for the pairs and tasks that they ask for, so depth is no matter."""
        stack, got = [task], None
        while stack:
            try:
                wanted = stack[-1].send(got)
            except StopIteration as done:
                stack.pop()
                got = done.value
            else:
                stack.append(self.sizing(*wanted) if isinstance(wanted, tuple) else wanted)
                got = None
        return got

    def size(self, a: int, b: int) -> int:
        """Simple tree matching: the size of the largest top-down match of two shapes that keeps order.

        The roots must have one label; their children are aligned by the sizes of their own matches.
        """
        if a == b:
            return self.sizes[a]
        if self.labels[a] != self.labels[b]:
            return 0
        known = self.matched.get((a, b))
        return self.answer(self.sizing(a, b)) if known is None else known

    def filled(self, first: np.ndarray, xs: list[int], ys: list[int]) -> Iterator[np.ndarray]:
        """Rows of the table of best sums below a first one."""
        row = first
        for part in self.parts(xs, ys):
            small, which, other = self.answer(self.weights(xs[part], ys))
            for i in which.tolist():
                below = np.empty_like(row)
                below[0] = 0
                below[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + small[i][other]))
                row = below
                yield row

    def aligned(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of two lists of shapes that a largest match pairs.

        A table of more than CELLS is filled once from the top, of which every so many rows are kept, and then again
        from each of these while the match is followed from the end.
        """
        lo, hi, left, right = self.partners(xs, ys)
        pairs, back = [(k, k) for k in range(lo)], []
        if left:
            inner_x, inner_y = [xs[i] for i in left], [ys[j] for j in right]
            i, j = len(inner_x), len(inner_y)
            if i * j < TOGETHER:  # a small table is made quickest without arrays
                best = [[0] * (j + 1)]
                for p in inner_x:
                    above, row = best[-1], [0]
                    for k, q in enumerate(inner_y):
                        row.append(max(above[k + 1], row[k], above[k] + self.size(p, q)))
                    best.append(row)
                while i and j:
                    if best[i][j] == best[i - 1][j]:
                        i -= 1
                    elif best[i][j] == best[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        back.append((left[i], right[j]))
                return pairs + back[::-1] + [(len(xs) - k, len(ys) - k) for k in range(hi, 0, -1)]
            step = max(isqrt(i) + 1, CELLS // (j + 1))
            kept = [np.zeros(j + 1, np.int32)]
            if i > step:
                last = (i - 1) // step * step
                kept += [row for k, row in enumerate(self.filled(kept[0], inner_x[:last], inner_y), 1) if k % step == 0]
            while i and j:
                top = (i - 1) // step * step
                first = kept[top // step][: j + 1]
                best = [first, *self.filled(first, inner_x[top:i], inner_y[:j])]
                while i > top and j:
                    if best[i - top][j] == best[i - top - 1][j]:
                        i -= 1
                    elif best[i - top][j] == best[i - top][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        back.append((left[i], right[j]))
        return pairs + back[::-1] + [(len(xs) - k, len(ys) - k) for k in range(hi, 0, -1)]


_SHAPES = Shapes()


def match_trees(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None, shapes: Shapes = _SHAPES) -> int:
    """Simple tree matching of two trees: the size of a largest match; pairs gets its pairs of nodes from the top down."""
    if len(shapes.known) > Shapes.MOST or len(shapes.matched) > Shapes.MOST:
        shapes.clear()
    shapes.name(a)
    shapes.name(b)
    if a.label != b.label:
        return 0
    if pairs is None:
        return shapes.size(a.shape, b.shape)
    before, stack = len(pairs), [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        kids, others = shapes.kids[x.shape], shapes.kids[y.shape]
        if kids and others:
            xs, ys = x.elements(), y.elements()
            if x.shape == y.shape:
                stack.extend(zip(reversed(xs), reversed(ys), strict=True))
            else:
                stack.extend([(xs[i], ys[j]) for i, j in reversed(shapes.aligned(kids, others))])
    return len(pairs) - before


def numbered(root: Node) -> list[Node]:
    """All elements in page order, each with its place in that order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack += [k for k in reversed(node.kids) if k.__class__ is not str]
    return out


def _digest(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "big", signed=True)


#: Paths worked out before, by the path above and a label.
_PATHS: dict[tuple[int, str], int] = {}
_MOST_PATHS = 20_000


def outline(root: Node) -> tuple[int, list[tuple[Node, int, int]]]:
    """The layout of a page, and its blocks with text: (block, path, path and text).

    A path is the labels from the page down to a block, without the digits of ids; the layout is the set of paths of
    the SECTIONS near the top.
    """
    layout, found, stack = set(), [], [(root, 0, 0)]
    while stack:
        node, above, depth = stack.pop()
        if (path := _PATHS.get((above, node.label))) is None:
            if len(_PATHS) >= _MOST_PATHS:
                _PATHS.clear()
            path = _PATHS[above, node.label] = zlib.crc32(b"/" + _DIGITS.sub("0", node.label).encode("utf-8", "surrogatepass"), above)
        if node.tag in SECTIONS and depth <= LAYOUT_DEPTH:
            layout.add(path)
        if node.tag in BLOCKS and (text := node.own_text()):
            found.append((node, path, _digest(b"%d" % path, text.encode("utf-8", "surrogatepass"))))
        stack.extend([(k, path, depth + 1) for k in node.kids if k.__class__ is not str])
    return _digest(*(b"%d" % x for x in sorted(layout))), found


def _apart(node: Node, inside: bool) -> bool:
    """Is the element something else than the article, by its name and attributes?"""
    if node.hidden or node.tag in NO_TEXT or node.tag == "header" and not inside:
        return True
    for mark in node.marks:
        if not inside and mark in APART_OUTSIDE or any(w in APART for w in _APART_WORD.split(mark)):
            return True
    return False


def _roots(root: Node) -> list[Node]:
    """Where the article is: the article element with the most text, the first of equals, else the main element, else the body."""
    articles, mains, bodies = [], [], []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "article":
            if not _apart(node, True):
                articles.append(node)
            continue
        if node.tag == "main" or "main" in node.marks and node.tag in ("div", "section"):
            mains.append(node)
        elif node.tag == "body":
            bodies.append(node)
        if node.tag in ("#page", "html", "body", "main") or not _apart(node, False):
            stack.extend(reversed(node.elements()))
    if articles:
        return [max(articles, key=lambda n: sum(map(len, blocks([n], set()))))]
    return mains[:1] or bodies[:1] or [root]


def blocks(roots: list[Node], template: set[int]) -> list[str]:
    """Texts of the blocks below some elements in page order, without parts apart and without template nodes.

    The texts and inline elements of a template node go; blocks inside it are judged for themselves.
    """
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            if text := " ".join("".join(line).split()):
                out.append(text)
            line.clear()

    for root in roots:
        # what is still to be done, the next thing last: a node's child with what holds around it, or the end of a block
        stack: list[tuple] = [(root, root.tag in ("article", "main"), False, True)]
        while stack:
            node, inside, skip, whole = stack.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                if not skip:
                    line.append(node)
            elif whole or not _apart(node, inside):
                block = node.tag in BLOCKS or whole
                if not block and skip:
                    continue
                if block:
                    end()
                    stack.append((None, inside, skip, False))
                here = inside or node.tag in ("article", "main")
                left_out = node.number in template
                stack.extend((k, here, left_out, False) for k in reversed(node.kids))
    return out


def main_text(page: str | None, reference: Node | None = None, constant: set[int] = frozenset(), repeated: set[int] = frozenset()) -> str:
    """The article of a page.

    reference and constant: the layout's reference tree and the numbers of its template nodes; repeated: path and text
    of the host's template blocks.
    """
    tree = parse(page)
    return text_of(tree, outline(tree)[1] if repeated else [], reference, constant, repeated)


def text_of(tree: Node, found: list[tuple[Node, int, int]], reference: Node | None = None, constant: set[int] = frozenset(), repeated: set[int] = frozenset()) -> str:
    """main_text of a parsed page, with the blocks of its outline."""
    template: set[int] = set()
    if reference is not None and constant or repeated:
        numbered(tree)
        pairs: list[tuple[Node, Node]] = []
        if reference is not None and constant:
            match_trees(reference, tree, pairs)
        template = {b.number for a, b in pairs if a.number in constant and a.own_text() == b.own_text()}
        template |= {node.number for node, _, block in found if block in repeated}
    roots = _roots(tree)
    return "\n".join(blocks(roots, template) or (blocks(roots, set()) if template else []))


def host_of(url: str = "url"):
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1), F.lit("")))


class _References:
    """Parsed reference pages of a task, by host and layout; starts afresh now and then, since tasks meet few at a time."""

    def __init__(self):
        self.known: dict[tuple[str, int], Node] = {}
        self.texts: dict[int, str] = {}

    def text(self, node: Node) -> str:
        """The own text of a reference's node, worked out once."""
        if (found := self.texts.get(id(node))) is None:
            found = self.texts[id(node)] = node.own_text()
        return found

    def get(self, host: str, layout: int, page: str) -> Node:
        if (host, layout) not in self.known:
            if len(self.known) >= 200:
                self.known.clear()
                self.texts.clear()
            tree = parse(page)
            numbered(tree)
            self.known[host, layout] = tree
        return self.known[host, layout]


_SEEN = pa.schema([("host", pa.string()), ("key", pa.int64()), ("path", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])
_COUNTS = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("node", pa.int64()), ("aligned", pa.int64()), ("same", pa.int64())])
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_COUNTS_SQL = "host string, layout long, node long, aligned long, same long"
#: Entries that a task holds before it gives out what it has counted.
_HELD = 200_000


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pages of a task have, by host: a row for each layout (path null; its pages, and the smallest hash of
    one), for each path of a block (key null; pages that have it), and for each block (pages with its path and text).
    """
    counts: dict[tuple[str, int | None, int | None], int] = defaultdict(int)
    firsts: dict[tuple[str, int | None, int | None], int] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*key, n, firsts.get(key)) for key, n in counts.items()]
        counts.clear()
        firsts.clear()
        return record_batch(_SEEN, *zip(*rows, strict=True))

    for batch in batches:
        for host, page, h in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "h")), strict=True):
            layout, found = outline(parse(page))
            own = (host, layout, None)
            counts[own] += 1
            firsts[own] = min(h, firsts.get(own, h))
            for path in {path for _, path, _ in found}:
                counts[host, None, path] += 1
            for path, block in {(path, block) for _, path, block in found}:
                counts[host, block, path] += 1
            if len(counts) > _HELD:
                yield flush()
    if counts:
        yield flush()


def _with_layout(pages: DataFrame) -> DataFrame:
    """The rows with the layout of their html; 0 if there is none."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [outline(parse(page))[0] if page else 0 for page in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, "layout"])

    return pages.mapInArrow(look, ", ".join(f"{c} {t}" for c, t in pages.dtypes) + ", layout long")


def _counting(find: Callable[[str, int], str | None] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each layout and node of its reference page: pages of the task that have the node, and those with its text.

    find: gives the reference page of a host and layout; without it the rows have layout and reference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references, sums = _References(), defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            rows = [(h, x, n, a, s) for (h, x, n), (a, s) in sums.items()]
            sums.clear()
            return record_batch(_COUNTS, *zip(*rows, strict=True))

        for batch in batches:
            for host, page, *known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = parse(page)
                layout, first = known or (own := outline(tree)[0], find(host, own))
                if first is None:
                    continue
                reference, pairs = references.get(host, layout, first), []
                match_trees(reference, tree, pairs)
                for a, b in pairs:
                    if a.tag in BLOCKS and (text := references.text(a)):  # inline elements belong to their block
                        seen = sums[host, layout, a.number]
                        seen[0] += 1
                        seen[1] += text == b.own_text()
            if len(sums) > _HELD:
                yield flush()
        if sums:
            yield flush()

    return run


def _extracting(find: Callable[[str, int], tuple[str, list[int]] | None] | None, often: Callable[[str], list[int] | None] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts of pages. find, often: wrappers by host and layout, and template blocks by host; or columns with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _References()
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            texts = []
            for k, (host, page) in enumerate(zip(columns["host"], columns["html"], strict=True)):
                tree = parse(page)
                layout, found = outline(tree) if page else (0, [])
                first, constant = (find(host, layout) or (None, None)) if find else (columns["reference"][k], columns["constant"][k])
                repeated = often(host) if often else columns["repeated"][k]
                texts.append(text_of(tree, found, references.get(host, layout, first) if constant else None, set(constant or ()), set(repeated or ())))
            yield record_batch(_TEXTS, batch.column(0), batch.column(1), texts, [len(t) for t in texts])

    return run


def _beside(pages: DataFrame, small: DataFrame, on: list[str], size: int, how: str) -> DataFrame:
    """Join a table by host or layout: broadcast if its size is within the bound, else in a shuffle that splits hot ones."""
    return pages.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


def _bytes(rows: DataFrame, size: Column) -> int:
    return rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The article of every page, from the whole html.

    Returns page_id, url, text (blocks joined by line ends; empty if there is none), n_chars (code points). The pages
    of a host are grouped by layout, and the reference page of a layout is the one with the smallest hash of its id.
    All pages of the layout are aligned with it, and a node whose text is the same on TEMPLATE_PAGES pages and
    TEMPLATE_SHARE of those that have it is template. So is a block whose text is the same on as many pages of the
    host, whatever their layout, and as large a share of those that have blocks at its path. Names and attributes of
    elements tell menus, notices, adverts and the like apart where their texts vary. A page on which the template
    leaves nothing keeps what the attributes leave. Null and empty html gives an empty text; pages without a host, and
    hosts with few pages, go by the attributes alone; repeated rows get a row each; other columns are ignored; an
    empty table gives an empty one.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of().alias("host"), F.col("html").cast("string").alias("html"))
    mark = F.xxhash64("page_id", "url", "html")
    able = rows.where("host <> '' and html <> ''")
    seen = store(able.select("host", "html", mark.alias("h")).mapInArrow(_survey, "host string, key long, path long, n long, h long"), "survey").df
    layouts = store(seen.where("path is null").groupBy("host", F.col("key").alias("layout")).agg(F.sum("n").alias("n"), F.min("h").alias("h")).where(F.col("n") >= TEMPLATE_PAGES).select("host", "layout", "h"), "layouts").df
    # only the pages chosen move; rows that are alike in all have one hash
    chosen = _beside(able.select("host", "html", mark.alias("h")), layouts, ["host", "h"], _bytes(layouts, F.octet_length("host") + 100), "inner")
    references = store(chosen.groupBy("host", "layout").agg(F.min("html").alias("reference")), "references").df
    paths = seen.where("path is not null and key is null").groupBy("host", "path").agg(F.sum("n").alias("having"))
    same = seen.where("path is not null and key is not null").groupBy("host", "path", "key").agg(F.sum("n").alias("same")).where(F.col("same") >= TEMPLATE_PAGES)
    often = same.join(paths, ["host", "path"]).where(F.col("same") >= TEMPLATE_SHARE * F.col("having"))
    repeated = store(often.groupBy("host").agg(F.collect_list("key").alias("repeated")), "repeated").df
    held = spark.sparkContext
    if _bytes(references, F.octet_length("reference") + 100) <= BROADCAST_BYTES:
        pages_of = held.broadcast({(r["host"], r["layout"]): r["reference"] for r in references.collect()})
        counted = able.select("host", "html").mapInArrow(_counting(lambda host, layout: pages_of.value.get((host, layout))), _COUNTS_SQL)
    else:
        counted = _with_layout(able.select("host", "html")).join(references, ["host", "layout"]).select("host", "html", "layout", "reference").mapInArrow(_counting(None), _COUNTS_SQL)
    counts = counted.groupBy("host", "layout", "node").agg(F.sum("aligned").alias("aligned"), F.sum("same").alias("same"))
    constant = counts.where((F.col("same") >= TEMPLATE_PAGES) & (F.col("same") >= TEMPLATE_SHARE * F.col("aligned"))).groupBy("host", "layout").agg(F.collect_list("node").alias("constant"))
    wrappers = store(references.join(constant, ["host", "layout"]), "wrappers").df
    known, find, often = rows, None, None
    if _bytes(repeated, 8 * F.size("repeated") + 100) <= BROADCAST_BYTES:
        blocks_of = held.broadcast({r["host"]: r["repeated"] for r in repeated.collect()})
        often = lambda host: blocks_of.value.get(host)
    else:
        known = known.join(repeated, "host", "left")
    if _bytes(wrappers, F.octet_length("reference") + 8 * F.size("constant") + 100) <= BROADCAST_BYTES:
        wrapper_of = held.broadcast({(r["host"], r["layout"]): (r["reference"], r["constant"]) for r in wrappers.collect()})
        find = lambda host, layout: wrapper_of.value.get((host, layout))
    else:
        known = _with_layout(known).join(wrappers, ["host", "layout"], "left")
    names = ["page_id", "url", "host", "html", *[c for c in ("reference", "constant", "repeated") if c in known.columns]]
    return known.select(*names).mapInArrow(_extracting(find, often), "page_id long, url string, text string, n_chars long")
