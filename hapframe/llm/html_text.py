"""Main text of web pages by wrapper induction.

Pages of one host are trees from a few templates. The smallest pages of each host's ``PIVOTS`` most frequent shapes (sets of tags and
classes), at most one for four pages, are its pivots, merged into one tree that holds all their nodes; every page is aligned with it by
simple tree matching (the largest mapping that keeps order and parents, by dynamic programming over children). For each pivot
node with text the pages are counted in which it is aligned, and in which the text there is the same: nodes whose text is the same in nearly
all are template, the others are slots whose content varies. A page's text comes from its slots: nodes aligned with a template node and equal
to it are dropped, and so are slots that by their element or by their class, id or role are menus, headers, footers, sidebars, notices, adverts,
forms or comments, which vary too. A class, id or role tells by its last part that isn't a word of layout, as ``ad`` in ``ad-box``;
what holds the article or most of the paragraphs is never dropped for such a sign. What is left of all outermost article and main elements that aren't marked as comments or teasers (else of those that are; else of the
least element that holds all paragraphs and headings, or of the page if that has less than half of its text) is written block by block.

Copies of one page count once. A page that shares half of the text of its article or main element with the pivot is a near copy of it:
it says nothing about what lies in that element or holds it, and where the template would leave nothing of it, it doesn't hold there.

Counts are sums over all pages of a host, combined before the shuffle, so a host may hold any share of the pages. Pivots and templates
are joined by host; Spark broadcasts them where their written size is below its threshold.

Defined results: null and empty html give the empty text; a null URL or one without ``://`` is of the host with the empty name; a host with fewer
than ``MIN_PAGES`` distinct pages has no template; unclosed and stray tags are repaired; pages of any length and depth are read whole; repeated rows and ids give one row each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hapframe.llm.common import cut, table
from hapframe.llm.tokens import bounded_batches
from hapframe.llm.urls import host_of

MIN_PAGES, CONSTANT = 4, 0.8
#: Share of the longer one's text in the article or main element from which two pages are near copies.
NEAR = 0.5
#: A page with n copies counts UNIT // n a copy; rounded, their sum is exact for 2**31 pages of a host.
UNIT = 1 << 32
#: Most pivots of a host.
PIVOTS = 8
#: Most cells of one dynamic programme that is kept whole; larger ones are halved, and only keep a row.
CELLS = 250_000
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.DOTALL)
MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("template svg math".split())
#: The content of these isn't markup: it goes up to their own end tag, which these find. In a script <!-- <script> hides one end tag.
TEXT = {tag: re.compile(rf"<(/){tag}(?=[\s/>])", re.IGNORECASE) for tag in "style noscript textarea title iframe".split()}
TEXT["script"] = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.IGNORECASE)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of these ends an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl article section div main td th".split())
DROP = frozenset("script style noscript template textarea title iframe svg math head nav footer aside form button select option dialog menu object canvas audio video".split())
#: Elements of paragraphs and headings; other blocks count as one from LONG characters of own text.
PARAGRAPHS, LONG = frozenset("p pre blockquote li td h1 h2 h3 h4 h5 h6".split()), 40
#: Words after a sign that leave it one.
LAYOUT = frozenset("area bar block box button buttons card container content count cta form grid group holder icon icons inner item items label left link links list main nav outer panel placeholder right root row section slot title top bottom unit wrap wrapper".split())
TEASERS = frozenset("comment comments reply replies teaser teasers related recommended preview previews promo promoted sponsored".split())
COMMENTS = frozenset("comment comments disqus replies".split())
SIGNS = frozenset("ad ads advert adverts advertisement advertising adbox banner banners breadcrumb breadcrumbs comment comments disqus consent cookie cookies gdpr notice notices footer masthead menu modal nav navbar navigation newsletter pager pagination popup promo promoted promotion related replies search share sharing sidebar signup login social sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary alert header topbar".split())


class Node:
    __slots__ = ("tag", "marks", "children", "sub", "length", "size", "kind", "shape", "at", "own")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.children = tag, marks, []

    def finish(self) -> None:
        """Of each subtree: a hash of its text, its length in text, its number of nodes and its shape; and the label that aligned nodes share."""
        for node in self.upwards():
            own = " ".join("".join(c if isinstance(c, str) else " " for c in node.children).split())
            inner = node.nodes()
            node.own = own
            node.kind = (node.tag, node.marks)
            node.sub = hash((own, *(c.sub for c in inner)))
            node.length = len(own) + sum(c.length for c in inner)
            node.size = 1 + sum(c.size for c in inner)
            node.shape = hash((node.kind, *(c.shape for c in inner)))

    def measure(self) -> None:
        """Sizes and shapes anew, where nodes were added."""
        for node in self.upwards():
            inner = node.nodes()
            node.size = 1 + sum(c.size for c in inner)
            node.shape = hash((node.kind, *(c.shape for c in inner)))

    def upwards(self) -> Iterator[Node]:
        stack = [(self, False)]
        while stack:
            node, ready = stack.pop()
            if ready:
                yield node
                continue
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.nodes())


class Open(list):
    """The open elements, and how many there are of each tag, so that tags without one cost nothing at any depth."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count: Counter = Counter()

    def append(self, node: Node) -> None:
        super().append(node)
        self.count[node.tag] += 1

    def close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of this tag, inside the innermost one of ``within``."""
        if not self.count[tag]:
            return
        for k in range(len(self) - 1, 0, -1):
            if self[k].tag == tag:
                for node in self[k:]:
                    self.count[node.tag] -= 1
                del self[k:]
                return
            if self[k].tag in within:
                return


def text_end(source: str, at: int, tag: str) -> int | None:
    """Where the end tag of a TEXT element begins whose content begins at ``at``; None if it has none."""
    hidden = inner = False  # of scripts: after <!--, and there after <script
    while m := TEXT[tag].search(source, at):
        at = m.end()
        if m[0] == "<!--":
            hidden, at = True, at - 2  # <!--> is a whole one
        elif m[0] == "-->":
            hidden = inner = False
        elif not m[1]:
            inner = hidden
        elif inner:
            inner = False
        else:
            return m.start() if source.find(">", at) >= 0 else None
    return None


def parse(source: str) -> Node:
    root = Node("#")
    stack, raw, at = Open(root), None, 0
    while at is not None:
        start, at = at, None
        for m in TOKEN.finditer(source, start):
            whole = m[0]
            tag = (m[2] or m[5] or "").lower()
            if raw is not None:  # nothing but its own end tag ends it
                if m[1] or m[4]:
                    raw = None if tag == raw else raw
                elif tag in TEXT and not whole.endswith("/>"):
                    at = text_end(source, m.end(), tag)
                    break
                continue
            if not tag:
                if not whole.startswith(("<!", "<?")):
                    stack[-1].children.append(html.unescape(whole))
                continue
            if m[1] or m[4]:
                stack.close(tag)
                continue
            if tag in BLOCK:
                stack.close("p", SCOPE)
            for other in ENDS.get(tag, ()):
                stack.close(other, SCOPE)
            attributes = m[3] or m[6] or ""
            node = Node(tag, " ".join((a or b or c).lower() for _, a, b, c in MARK.findall(attributes)) if attributes else "")
            stack[-1].children.append(node)
            if tag in VOID:
                node.children.append(" ")
            elif not attributes.endswith("/") or tag in BLOCK:
                if tag in TEXT:
                    at = text_end(source, m.end(), tag)
                    break
                if tag in RAW:
                    raw = tag
                else:
                    stack.append(node)
    root.finish()
    return root


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of a largest order- and parent-keeping mapping of two trees with equal root labels."""
    seen: dict[tuple[int, int], int] = {}

    def weight(x: Node, y: Node) -> int:
        if x.kind != y.kind:
            return 0
        if not (x.size > 1 and y.size > 1):
            return 1
        if x.shape == y.shape:
            return x.size
        key = (id(x), id(y))
        if key not in seen:
            xs, ys, ends = trimmed(x.nodes(), y.nodes())
            seen[key] = 1 + sum(p.size for p, _ in ends) + (int(last_row(xs, ys)[-1]) if len(xs) * len(ys) > CELLS else programme(xs, ys)[-1][-1])
        return seen[key]

    def last_row(xs: list[Node], ys: list[Node]) -> np.ndarray:
        """The last row of programme(); weights are those of shapes."""
        codes: dict = {}
        at = np.array([codes.setdefault(y.shape, len(codes)) for y in ys], np.int64)
        first = {y.shape: y for y in reversed(ys)}
        rows: dict = {}
        row = np.zeros(len(ys) + 1, np.int64)
        for x in xs:
            if x.shape not in rows:
                rows[x.shape] = np.array([weight(x, first[c]) for c in codes], np.int64)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[x.shape][at]))
        return row

    def halves(xs: list[Node], ys: list[Node]) -> list[tuple[list[Node], list[Node]]]:
        """Parts whose best mappings make up a best one, none of more than CELLS."""
        out, parts = [], [(xs, ys)]
        while parts:
            xs, ys = parts.pop()
            if len(xs) * len(ys) <= CELLS or len(xs) == 1:
                out.append((xs, ys))
                continue
            k = len(xs) // 2
            j = int(np.argmax(last_row(xs[:k], ys) + last_row(xs[:k - 1 : -1], ys[::-1])[::-1]))
            parts += [(xs[:k], ys[:j]), (xs[k:], ys[j:])]
        return out

    def trimmed(xs: list[Node], ys: list[Node]) -> tuple[list[Node], list[Node], list[tuple[Node, Node]]]:
        """Without the equal shapes at both ends; to pair them is never worse than anything else."""
        n, low = min(len(xs), len(ys)), 0
        while low < n and xs[low].shape == ys[low].shape:
            low += 1
        high = 0
        while high < n - low and xs[-1 - high].shape == ys[-1 - high].shape:
            high += 1
        ends = [*zip(xs[:low], ys[:low], strict=True), *zip(xs[len(xs) - high :], ys[len(ys) - high :], strict=True)]
        return xs[low : len(xs) - high], ys[low : len(ys) - high], ends

    def programme(xs: list[Node], ys: list[Node]) -> list[list[int]]:
        best = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = best[-1], [0]
            for j, y in enumerate(ys):
                row.append(max(above[j + 1], row[j], above[j] + weight(x, y)))
            best.append(row)
        return best

    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs, ys, ends = trimmed(x.nodes(), y.nodes())
        todo += ends
        for xs, ys in halves(xs, ys) if len(xs) * len(ys) > CELLS else [(xs, ys)]:
            if not xs or not ys:
                continue
            best, i, j = programme(xs, ys), len(xs), len(ys)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((xs[i], ys[j]))
    return pairs


class Wrapper:
    """A host's pivots in one tree. Nodes keep the text of the first pivot that has them."""

    def __init__(self, sources: list[str]):
        self.sources, self.root = frozenset(sources), None
        self.around: set[int] = set()
        self.texts: dict[int, list[tuple[int, str]]] = {}  # of nodes in article and main elements: (pivot, own text)
        self.totals: list[int] = []
        self.pages: list[Node] = []
        for k, source in enumerate(sources):
            page = parse(source)
            inside, around = held(page)
            nodes = list(page.walk())
            same = self.merge(page)
            self.around |= {id(same.get(id(x), x)) for x in nodes if id(x) in around}
            own = [x for x in nodes if id(x) in inside]
            self.totals.append(sum(len(x.own) for x in own))
            for x in own:
                self.texts.setdefault(id(same.get(id(x), x)), []).append((k, x.own))
        for k, node in enumerate(self.root.walk()):
            node.at = k

    def merge(self, page: Node) -> dict[int, Node]:
        """Adds the nodes that the tree lacks; of the others, the tree's node by id()."""
        if self.root is None:
            self.root = page
            return {}
        pairs = match(page, self.root)
        same = {id(x): y for x, y in pairs}
        for x, y in pairs:
            before = None
            for c in x.nodes():
                if id(c) in same:
                    before = same[id(c)]
                else:
                    y.children.insert(next((i + 1 for i, q in enumerate(y.children) if q is before), 0), c)
                    before = c
        self.root.measure()
        self.pages.append(page)  # so that no other node gets the id() of one of its own
        return same

    def near_copy(self, pairs: list[tuple[Node, Node]], page: Node) -> bool:
        """Whether a page and a pivot share most of the text of their article and main elements."""
        shared: Counter = Counter()
        for x, y in pairs:
            for k, own in self.texts.get(id(y), ()):
                if own == x.own:
                    shared[k] += len(own)
        if not any(shared.values()):
            return False
        inside = held(page)[0]
        total = sum(len(x.own) for x in page.walk() if id(x) in inside)
        return any(n > 0 and n >= NEAR * max(total, self.totals[k]) for k, n in shared.items())


def is_main(x: Node) -> bool:
    return x.tag == "main" or (" main " in f" {x.marks} " and x.tag not in ("html", "body"))


def contents(root: Node, gone) -> list[Node]:
    """Outermost article and main elements, in order; ``gone(x, within)`` tells which nodes to pass over."""
    outer: list[tuple[Node, bool]] = []
    loose: list[Node] = []
    stack = [(root, False, False)]
    while stack:
        x, within, under = stack.pop()
        if gone(x, within):
            continue
        if x.tag in ("article", "main"):
            if not within:
                outer.append((x, signs(x.marks, TEASERS)[0]))
            within = True
        elif is_main(x) and not within and not under:
            loose.append(x)
            under = True
        stack += [(c, within, under) for c in reversed(x.nodes())]
    return [x for x, teaser in outer if not teaser] or loose or [x for x, _ in outer]


def held(root: Node) -> tuple[set[int], set[int]]:
    """id() of the nodes in article and main elements that are content; and of those and all that hold one."""
    kept = spared(root)
    tops = {id(x) for x in contents(root, lambda x, within: boilerplate(x, within) and id(x) not in kept)}
    inside, around = set(), set()
    stack: list = [(root, False, ())]
    while stack:
        x, within, above = stack.pop()
        if not within and id(x) in tops:
            within, up = True, above
            while up and id(up[0]) not in around:
                around.add(id(up[0]))
                up = up[1]
        if within:
            inside.add(id(x))
        stack += [(c, within, (x, above)) for c in x.nodes()]
    return inside, inside | around


@lru_cache(100_000)
def signs(marks: str, of: frozenset[str] = SIGNS) -> tuple[bool, bool]:
    """Whether a class, id or role is a sign, and whether one is no more than that."""
    some = whole = False
    for token in marks.split():
        parts = [p for p in re.split(r"[^a-z]+", token) if p]
        whole |= len(parts) == 1 and parts[0] in of
        while len(parts) > 1 and parts[-1] in LAYOUT and parts[-1] not in of:
            parts.pop()
        some |= bool(parts) and parts[-1] in of
    return some, whole


def boilerplate(node: Node, inside: bool) -> bool:
    if node.tag in DROP or (node.tag == "header" and not inside):
        return True
    if node.tag in ("article", "main"):
        return inside and node.tag == "article" and signs(node.marks, TEASERS)[0]
    return bool(node.marks) and node.tag not in ("html", "body") and signs(node.marks)[0]


def unlinked(path: tuple) -> Iterator[Node]:
    while path:
        yield path[0]
        path = path[1]


def spared(root: Node) -> set[int]:
    """id() of the elements that look like boilerplate but hold the article or main element, or most of the text and of its paragraphs."""
    paths: list[tuple] = []  # of boilerplate, around each article or main element: (innermost, the others), () at the end
    free: list[Node] = []
    looks: list[Node] = []
    stack: list = [(root, False, ())]
    while stack:
        x, within, path = stack.pop()
        if boilerplate(x, within):
            looks.append(x)
            path = (x, path)
        elif x.tag in ("article", "main") and not signs(x.marks, TEASERS)[0]:
            paths.append(path)
            free.append(x)
        within = within or x.tag in ("article", "main")
        stack += [(c, within, path) for c in x.nodes()]
    if not looks:
        return set()
    if paths:  # teasers lie in an aside or the like while another is free; a layout's class says nothing
        listed = [list(unlinked(p)) for p in paths]
        plain = [p for p in listed if not any(x.tag in DROP or x.tag == "header" or signs(x.marks)[1] for x in p)]
        kept = {id(x) for p in plain or [p for p in listed if len(p) == min(map(len, listed))] for x in p}
        teasers = [x for x in looks if x.tag == "article"]
        if all(x.tag == "main" for x in free) and 2 * sum(x.length for x in teasers) > sum(x.length for x in free):  # a page that lists them
            kept |= {id(x) for x in teasers}
        return kept

    def of_paragraphs(top: Node) -> int:
        total, todo = 0, [top]
        while todo:
            x = todo.pop()
            if x.tag in ("p", "pre", "blockquote"):
                total += x.length
            else:
                todo += x.nodes()
        return total

    most = of_paragraphs(root)
    return {id(x) for x in looks if 2 * x.length > root.length and 2 * of_paragraphs(x) > most and not signs(x.marks, COMMENTS)[0]}


def around_paragraphs(root: Node, gone) -> Node:
    """The least node that holds all paragraphs and headings, the root if that has less than half of the text."""
    lowest: Node | None = None
    below: set[int] = set()  # nodes known to lie in ``lowest``
    above: dict[int, Node | None] = {id(root): None}
    depth, own, stack = {id(root): 0}, {}, [root]
    while stack:
        x = stack.pop()
        if gone(x, False):
            continue
        own[id(x)] = len(x.own)
        if x.length and (x.tag in PARAGRAPHS or (x.tag in BLOCK and len(x.own) >= LONG)):
            holder = x if x.tag not in PARAGRAPHS else above[id(x)]
            lowest = lowest or holder
            a, path = holder, []
            while a is not lowest and id(a) not in below and depth[id(a)] > depth[id(lowest)]:
                path.append(id(a))
                a = above[id(a)]
            while a is not lowest and id(a) not in below:  # beside it: up to the least node that holds both
                if depth[id(lowest)] >= depth[id(a)]:
                    below.add(id(lowest))
                    lowest = above[id(lowest)]
                else:
                    path.append(id(a))
                    a = above[id(a)]
            below.update(path)
        for c in x.nodes():
            above[id(c)], depth[id(c)] = x, depth[id(x)] + 1
            stack.append(c)
    if lowest is None:
        return root
    return lowest if 2 * sum(own.get(id(x), 0) for x in lowest.walk()) >= sum(own.values()) else root


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the content; ``template`` holds id() of the nodes to drop."""
    kept = spared(root)

    def gone(x: Node, within: bool) -> bool:
        return id(x) in template or (boilerplate(x, within) and id(x) not in kept)

    content = contents(root, gone) or [around_paragraphs(root, gone)]
    chosen = {id(x) for x in content}
    blocks, now = [], []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    stack: list = content[::-1]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif id(x) in chosen or not gone(x, True):
            if x.tag in BLOCK or x.tag == "#":
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return "\n\n".join(blocks)


def unbounded() -> None:
    """Trees may be deep, and alignment follows them down; Python's own frames are on the heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))


def extract(source: str | None, pivot: Node | None, constant: dict[int, str]) -> str:
    if not source:
        return ""
    root = parse(source)
    template = {id(x) for x, y in match(root, pivot) if constant.get(y.at) == x.sub} if pivot is not None and constant else set()
    text = main_text(root, template)
    return text if text or not template else main_text(root, template - held(root)[1])


def shape() -> Column:
    """Of a page, a hash of its set of tags with their classes."""
    tags = F.regexp_extract_all("html", F.lit(r"""<([a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*?\bclass\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)"""), F.lit(1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda x: F.regexp_replace(x, r"\s(?s:.*)\bclass", " class")))))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``host, digest, n, shape, size``: n copies each."""
    return pages.where("length(html) > 0").select("host", digest().alias("digest"), shape().alias("shape"), F.length("html").alias("size")).groupBy("host", "digest").agg(
        F.count("*").alias("n"), F.min("shape").alias("shape"), F.min("size").alias("size"),
    )


def pivots(pages: DataFrame, copies: DataFrame) -> DataFrame:
    """``host, pivots``: of each host of MIN_PAGES distinct pages the least ones of its most frequent shapes, the most frequent first."""
    shapes = copies.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.min(F.struct("size", "digest")).alias("least"))
    ranked = shapes.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "least"))).where(F.col("rank") <= PIVOTS)
    full = copies.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    # Written out, so that Spark sees how small it is and doesn't deal out the pages.
    wanted = cut(ranked.join(full, "host").where((F.col("rank") == 1) | (F.col("rank") * 4 <= F.col("n"))).select("host", F.col("least.digest").alias("digest"), "rank"), "wanted")
    found = pages.where("length(html) > 0").withColumn("digest", digest()).join(wanted, ["host", "digest"]).groupBy("host", "rank").agg(F.min("html").alias("html"))
    return found.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "html"))), lambda x: x["html"]).alias("pivots"))


def templates(pages: DataFrame, of: DataFrame, copies: DataFrame) -> DataFrame:
    """``host, pivots, constant``: indices of the wrapper's nodes whose text is constant. Pages are (host, html), copies (host, digest, n)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unbounded()
        trees: dict[str, Wrapper] = {}
        aligned, equal = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(aligned)
            return pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in keys], pa.string()), "at": pa.array([k[1] for k in keys], pa.int64()), "aligned": pa.array([aligned[k] for k in keys], pa.int64()), "equal": pa.array([equal[k] for k in keys], pa.int64())})

        for batch in batches:
            hosts, sources, _, weights = (c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns))
            for row, (host, source, weight) in enumerate(zip(hosts, sources, weights, strict=True)):
                if host not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    trees[host] = Wrapper(batch.column(2)[row].as_py())
                wrapper = trees[host]
                if source in wrapper.sources:
                    continue
                page = parse(source)
                pairs = match(page, wrapper.root)
                near = wrapper.near_copy(pairs, page)
                for x, y in pairs:
                    if y.length and not (near and id(y) in wrapper.around):
                        aligned[host, y.at] += weight
                        equal[host, y.at] += weight * (x.sub == y.sub)
            if len(aligned) > 200_000:
                yield out()
                aligned.clear()
                equal.clear()
        yield out()

    repeated = cut(copies.where("n > 1").select("host", "digest", F.floor(F.lit(UNIT) / F.col("n")).alias("weight")), "repeated")
    weighed = pages.where("length(html) > 0").withColumn("digest", digest()).join(repeated, ["host", "digest"], "left").join(of.select("host", "pivots"), "host")
    counted = weighed.select("host", "html", "pivots", F.coalesce("weight", F.lit(UNIT)).alias("weight")).mapInArrow(count, "host string, at long, aligned long, equal long")
    pages_of = [F.round(F.sum(c) / UNIT).alias(c) for c in ("aligned", "equal")]
    # Pivots are pages too, and not counted.
    same = counted.groupBy("host", "at").agg(*pages_of).where(F.col("equal") >= CONSTANT * F.col("aligned")).where(F.col("aligned") >= MIN_PAGES - 1)
    return of.select("host", "pivots").join(same.groupBy("host").agg(F.collect_list("at").alias("constant")), "host")


def digest() -> Column:
    return F.unhex(F.md5(F.encode("html", "UTF-8")))


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` with one row a page."""
    bounded_batches(pages.sparkSession)
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    copies = cut(distinct_pages(narrow), "copies")
    of = cut(pivots(narrow, copies), "pivots")
    wrapper = cut(templates(narrow.select("host", "html"), of, copies), "templates")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unbounded()
        trees: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for row, (host, source) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:4]), strict=True)):
                if host not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    trees[host] = None, {}
                    if batch.column(4)[row].is_valid:
                        root, wanted = Wrapper(batch.column(4)[row].as_py()).root, set(batch.column(5)[row].as_py())
                        trees[host] = root, {x.at: x.sub for x in root.walk() if x.at in wanted}
                texts.append(extract(source, *trees[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    key = pages.schema[id_col].dataType.simpleString()
    return narrow.join(wrapper, "host", "left").select("page_id", "url", "host", "html", "pivots", "constant").mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
