"""HTML extraction by wrapper induction.

Every page becomes a tree of its block elements (inline markup belongs to the text of its block).  Pages of one host with
the same outline (the label paths of its upper levels) have one layout, and the page of least hash is the layout's
pattern.  Every different page of a layout is aligned with the pattern by simple tree matching: of all alignments that keep
order and ancestry, one of the greatest score, where a matched pair of nodes counts by the size of what can be matched
below it, and more if its whole text is the same.  So a fixed paragraph between changing ones finds itself.
Per node of the pattern, Spark adds up in how many different pages it is found and in how many of those its text is the pattern's.
Nodes that stay the same are the template, by path and text; all others are slots.

Pages are told apart by the hash of their article (of the whole body where there is none), and equal ones count once: copies of a
page are not boilerplate, however many there are.  What travels is a page's tree, of labels and hashes of texts, never its html; pages
only meet the small table of templates.

The text of a page is that of its slots inside ``article`` or ``main``; inside the body where it has none, or where most of its
running text is beside them.  Navigation, page headers, footers, sidebars, forms, scripts, styles, hidden parts, adverts, notices and
reader comments are left out: by element, by role, by whole class names and ids, and outside the article also by what a
compound name ends in (``site-footer``).  Inside the article only containers can be left out by name, no paragraph, heading or item.

Blocks are joined by one newline in page order; white space inside a block is one space; character references are
decoded; ``br`` ends a block.  A null or empty page has the empty text, a page without any text too.  Pages with a null
or broken URL form one host.  A layout of under ``LEAST_PAGES`` different pages has no template.  Repeated pages are
returned each by itself.  Elements may be nested to any depth: trees are walked without recursion, and a tag finds what it
closes without a look at the whole stack.  A tag without its end is read up to the next one.  Reading a page takes time that
grows with its length.  Lists of children are aligned whole, by dynamic programming: time grows with the product of their
lengths (and of the numbers of their different structures), room with their lengths.
"""

from __future__ import annotations

import html as entities
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import pieces, written

LEAST_PAGES = 5
SAME_SHARE = 0.9
#: Rows of an alignment's table that are kept at a time.
STRETCH = 64
#: A block of so many words is running text.
PROSE = 12

# Element names of HTML, and the roles and class names that mark what is not the article.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var img wbr area base link meta".split())
LEFT_OUT = set("head nav footer aside form script style noscript template button select textarea iframe object dialog menu svg canvas audio video title".split())
RAW = set("script style noscript template textarea iframe title".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended recommendations share "
    "sharing social comment comments commentlist comment-list comments-area comments-section comment-section disqus replies respond "
    "cookie cookies consent notice notices gdpr newsletter subscribe subscription popup modal login signup search toolbar "
    "pagination pager skip ad-container ad-slot ad-wrapper ad-unit related-posts related-articles share-buttons social-links "
    "social-icons widget-area cookie-notice cookie-banner cookie-consent".split())
#: Marks that may stand in an article for a part of it.
OF_ARTICLE = {"header", "masthead", "banner"}
#: What a compound name of a part outside the article ends in.
ENDINGS = set("nav navbar navigation menu footer sidebar breadcrumb breadcrumbs comments pagination newsletter cookies advert advertisement".split())
#: Elements that hold parts; any other one is left out by its name nowhere inside an article.
CONTAINERS = set("div section article ul ol dl table details center".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/<>]*)(?P<rest2>[^<>]*)(?:>|(?=<)|\Z)", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES_P = re.compile(r"(?:p|div|article|section|main|header|footer|nav|aside|form|ul|ol|dl|li|dt|dd|table|h[1-6]|pre|blockquote|figure|address|hr|fieldset|details)\Z")
_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Element:
    __slots__ = ("tag", "label", "out", "parts")

    def __init__(self, tag: str, label: str, out: bool):
        self.tag, self.label, self.out, self.parts = tag, label, out, []


def _marked(tag: str, names: list[str], inside: bool) -> bool:
    """Whether class names or ids mark an element as no part of the article."""
    names = [_CAMEL.sub("-", n).lower().replace("_", "-") for n in names]
    if inside:
        return tag in CONTAINERS and any(n in MARKS and n not in OF_ARTICLE for n in names)
    if tag in ("html", "body", "main", "article"):
        return tag == "article" and any(n in ("comment", "comments") for n in names)
    return any(n in MARKS or n.rsplit("-", 1)[-1] in ENDINGS for n in names)


def _open(tag: str, rest: str, inside: bool) -> Element:
    """``inside``: an article or main element is open."""
    classes, ids, out = [], [], tag in LEFT_OUT
    if tag == "header":
        out = not inside
    if rest and not rest.isspace():
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
                out = True
            elif name in ("class", "id"):
                (classes if name == "class" else ids).extend(value.split())
        out = out or _marked(tag, classes + ids, inside)
    kind = ".".join(sorted({re.sub(r"\d+", "", n) for n in classes}))
    return Element(tag, f"{tag}.{kind}" if kind else tag, out)


def parse(page: str) -> Element:
    """The element tree; ``parts`` holds texts and elements in order, inline markup only as its text."""
    root = Element("", "", False)
    stack, last = [root], 0
    places: dict[str, list[int]] = {}  # by tag, where it is open in the stack
    blocks = [0]  # where the elements of the stack are that are not inline

    def push(element: Element) -> None:
        places.setdefault(element.tag, []).append(len(stack))
        if element.tag not in INLINE:
            blocks.append(len(stack))
        stack.append(element)

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    def nearest(tag: str) -> int:
        return own[-1] if (own := places.get(tag)) else 0

    endless: set[str] = set()  # raw elements that no end tag follows any more
    while m := _TOKEN.search(page, last):
        if m.start() > last:
            stack[-1].parts.append(page[last:m.start()])
        last = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m.group().startswith("<![CDATA["):
                stack[-1].parts.append(m.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, end, rest = tag.lower(), m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if not end and tag in RAW and (tag in ("script", "style", "textarea") or not rest.rstrip().endswith("/")):
            stop = None if tag in endless else _RAW_END[tag].search(page, last)
            if stop:
                last = stop.end()
            elif tag in ("script", "style"):
                last = len(page)
            else:
                endless.add(tag)
            stack[-1].parts.append(Element(tag, tag, True))
            continue
        if end:
            k = nearest(tag)
            if k and (tag not in INLINE or k > blocks[-1]):
                close(k)
            continue
        if _CLOSES_P.match(tag) and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if limits := _SAME.get(tag):
            k = nearest(tag)
            if k > max(map(nearest, limits)):
                close(k)
        made = _open(tag, rest, bool(places.get("article") or places.get("main")))
        if tag in INLINE and not made.out:
            if tag not in VOID:
                made.parts = stack[-1].parts  # its text is its block's text
                push(made)
            continue
        stack[-1].parts.append(made)
        if tag not in VOID and not rest.rstrip().endswith("/"):
            push(made)
    if last < len(page):
        stack[-1].parts.append(page[last:])
    return root


def _clean(texts: list[str]) -> str:
    return " ".join(entities.unescape("".join(texts)).split())


class Node:
    """A block element in the aligned trees; what is left out is no node."""
    __slots__ = ("label", "code", "children", "shape", "whole")

    def __init__(self, label: str, code: int = 0):
        self.label, self.code, self.children = label, code, []


def tree_of(root: Element) -> Node:
    out = Node("")
    todo = [(out, root)]
    while todo:
        node, element = todo.pop()
        text, texts = [], []
        for part in [*element.parts, None]:
            if isinstance(part, str):
                text.append(part)
                continue
            if cleaned := _clean(text):
                texts.append(cleaned)
            text.clear()
            if part is not None and not part.out and part.tag not in VOID:
                child = Node(part.label)
                node.children.append(child)
                todo.append((child, part))
        if texts:
            node.code = xxhash.xxh3_64_intdigest("\n".join(texts)) >> 1 or 1
    return out


def nodes_of(root: Node) -> list[Node]:
    """In preorder."""
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo += reversed(node.children)
    return out


def dumped(root: Node) -> str:
    """A tree as text: in preorder, every node with its label, the code of its text, and how many children it has."""
    return json.dumps([[n.label, n.code, len(n.children)] for n in nodes_of(root)], separators=(",", ":"), ensure_ascii=False)


def loaded(text: str) -> Node:
    above = Node("")
    todo = [(above, 1)]  # where children are missing, and how many
    for label, code, n in json.loads(text):
        while not todo[-1][1]:
            todo.pop()
        into, missing = todo.pop()
        into.children.append(node := Node(label, code))
        todo += [(into, missing - 1), (node, n)]
    return above.children[0]


def below(path: str, label: str) -> str:
    """The path of a child: of fixed length, however deep."""
    return xxhash.xxh3_64_hexdigest(f"{path}/{label}")


ROOT = below("", "")


def constant(path: str, code: int) -> int:
    """The name of a text at a path, as templates list it."""
    return xxhash.xxh3_64_intdigest(f"{path} {code}") - (1 << 63)


def with_paths(root: Node) -> list[tuple[str, Node]]:
    """The nodes of a tree in preorder, each with its path."""
    out, todo = [], [("", root)]
    while todo:
        above, node = todo.pop()
        out.append((path := below(above, node.label), node))
        todo += [(path, c) for c in reversed(node.children)]
    return out


def outline(root: Node) -> int:
    """The layout of a page: the different label paths of the levels above and next to the article's."""
    paths, level = set(), [("", root)]
    for _ in range(4):
        level = [(f"{path}/{c.label}", c) for path, n in level for c in n.children]
        paths |= {path for path, _ in level}
    return xxhash.xxh3_64_intdigest("\n".join(sorted(paths))) - (1 << 63)


def content(root: Node) -> int:
    """What tells pages apart: the texts of the articles, or of the whole page if there are none."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.label.split(".")[0] in ("article", "main"):
            found += [n.code for n in nodes_of(node) if n.code]
        else:
            todo += node.children
    found = found or [n.code for n in nodes_of(root) if n.code]
    return xxhash.xxh3_64_intdigest(" ".join(map(str, found))) - (1 << 63)


def _next(above: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The row of an alignment's table that follows ``above``: the best sums up to each place."""
    out = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[1:], above[:-1] + scores), out=out[1:])
    return out


def _best(row, n: int, m: int) -> list[tuple[int, int]]:
    """The pairs of an order-preserving alignment of the greatest sum; pairs of score 0 do not match.

    ``row(i)`` gives the scores of the i-th against all m.  Of a long table some rows are kept, and those between are
    worked out again on the way back.
    """
    out, j = [], m
    todo = [(0, n, np.zeros(m + 1, np.int32))]  # stretches of rows, each with the table's row above it
    while todo and j:
        a, b, above = todo.pop()
        table = [above[:j + 1]]
        if b - a > STRETCH:
            step = -(-(b - a) // STRETCH)
            for k in range(a, b, step):
                todo.append((k, min(k + step, b), table[0]))
                for i in range(k, min(k + step, b) if k + step < b else k):
                    table[0] = _next(table[0], row(i)[:j])
            continue
        for i in range(a, b):
            table.append(_next(table[-1], row(i)[:j]))
        i = b
        while i > a and j:
            here, over = table[i - a], table[i - a - 1]
            if here[j] == over[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
    return out[::-1]


class Matching:
    """Simple tree matching of many pages: sub-structures that occur again are numbered, and matched once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def prepare(self, root: Node) -> Node:
        """Numbers the structure below every node and hashes its whole text."""
        for node in reversed(nodes_of(root)):
            key = (node.label, *[c.shape for c in node.children])
            if (shape := self.number.get(key)) is None:
                shape = self.number[key] = len(self.parts)
                self.parts.append(key)
                self.size.append(1 + sum(self.size[c] for c in key[1:]))
            texts = [node.code, *[c.whole for c in node.children]]
            node.shape, node.whole = shape, hash(tuple(texts)) if any(texts) else 0
        return root

    def common(self, a: int, b: int) -> int:
        """The size of the largest alignment of two structures, without their texts."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self.value(x, y) is not None:
                todo.pop()
                continue
            p, q, same = self.between(self.parts[x][1:], self.parts[y][1:])
            if missing := self.unknown(p, q):
                todo += missing
                continue
            todo.pop()
            if p and q:
                table, row = np.zeros(len(q) + 1, np.int32), self.rows(p, q)
                for i in range(len(p)):
                    table = _next(table, row(i))
                same += int(table[-1])
            self.known[x, y] = 1 + same
        return self.value(a, b)

    def between(self, p, q):
        """Two lists without the equal structures that both begin and end with, and the size of these: they always match."""
        short = min(len(p), len(q))
        k = next((i for i in range(short) if p[i] != q[i]), short)
        e = next((i for i in range(short - k) if p[-1 - i] != q[-1 - i]), short - k)
        return p[k:len(p) - e], q[k:len(q) - e], sum(self.size[c] for c in (*p[:k], *p[len(p) - e:]))

    def value(self, a: int, b: int) -> int | None:
        return self.size[a] if a == b else 0 if self.parts[a][0] != self.parts[b][0] else self.known.get((a, b))

    def by_label(self, q) -> dict[str, list[int]]:
        """The different structures of a list by their label."""
        out: dict[str, list[int]] = {}
        for b in dict.fromkeys(q):
            out.setdefault(self.parts[b][0], []).append(b)
        return out

    def unknown(self, p, q) -> list[tuple[int, int]]:
        """The pairs of structures under one label that are not matched yet."""
        by_label = self.by_label(q) if p and q else {}
        return [(a, b) for a in dict.fromkeys(p) for b in by_label.get(self.parts[a][0], ()) if self.value(a, b) is None]

    def rows(self, p, q):
        """A function that gives the scores of the i-th of ``p`` against all of ``q``."""
        different, at = np.unique(q, return_inverse=True)
        place = {int(b): j for j, b in enumerate(different)}
        by_label = {label: (own, np.array([place[b] for b in own])) for label, own in self.by_label(q).items()}
        found: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            out = np.zeros(len(different), np.int32)
            own, places = by_label.get(self.parts[a := p[i]][0], ((), ()))
            if own:
                if a not in found:
                    found[a] = np.array([self.value(a, b) for b in own], np.int32)
                out[places] = found[a]
            return out[at]

        return row

    def children(self, p: list[Node], q: list[Node]) -> list[tuple[Node, Node]]:
        out, k = [], 0
        while k < min(len(p), len(q)) and p[k].shape == q[k].shape and p[k].whole == q[k].whole:
            out.append((p[k], q[k]))
            k += 1
        p, q = p[k:], q[k:]
        if not (p and q):
            return out
        shapes = [c.shape for c in p], [c.shape for c in q]
        for pair in self.unknown(*shapes):
            self.common(*pair)
        row, equal = self.rows(*shapes), {}
        for j, c in enumerate(q):
            if c.whole:
                equal.setdefault(c.whole, []).append(j)

        def scores(i: int) -> np.ndarray:
            """A pair whose whole texts are the same counts twice and one more."""
            own = row(i)
            if at := equal.get(p[i].whole):
                own[at] += np.where(own[at] > 0, own[at] + 1, 0)
            return own

        return out + [(p[i], q[j]) for i, j in _best(scores, len(p), len(q))]

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The matched nodes of two prepared trees."""
        out, todo = [], [(a, b)] if a.label == b.label else []
        while todo:
            out.append(pair := todo.pop())
            todo += self.children(pair[0].children, pair[1].children)
        return out


def _trees(batches):
    """Of every page its layout, what tells it from others, and its tree."""
    for batch in batches:
        for part in pieces(batch, "html"):
            trees = [tree_of(parse(p or "")) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column("host"), pa.array([outline(t) for t in trees], pa.int64()),
                pa.array([content(t) for t in trees], pa.int64()), pa.array([dumped(t) for t in trees], pa.string()),
            ], ["host", "layout", "page", "tree"])


def _aligned(batches):
    """Counts per layout and node of the pattern, added up in the task before Spark does."""
    matching, patterns = Matching(), {}
    for batch in batches:
        counts: dict[tuple, list[int]] = {}
        for host, layout, text, pattern in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "tree", "pattern"))):
            if len(matching.known) > 200_000 or len(matching.parts) > 200_000 or len(patterns) > 1000:
                matching.clear()
                patterns = {}
            if (host, layout) not in patterns:
                tree = matching.prepare(loaded(pattern))
                patterns[host, layout] = tree, {id(n): i for i, n in enumerate(nodes_of(tree))}
            tree, places = patterns[host, layout]
            for a, b in matching.pairs(tree, matching.prepare(loaded(text))):
                if a.code:
                    entry = counts.setdefault((host, layout, places[id(a)]), [0, 0])
                    entry[0] += 1
                    entry[1] += a.code == b.code
        if counts:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()), pa.array([k[2] for k in counts], pa.int32()),
                *[pa.array([v[i] for v in counts.values()], pa.int64()) for i in range(2)]], ["host", "layout", "node", "pages", "same"])


def _templates(batches):
    for batch in batches:
        out = []
        for pattern, nodes in zip(batch.column("pattern").to_pylist(), batch.column("nodes").to_pylist()):
            at = with_paths(loaded(pattern))
            out.append([constant(at[n][0], at[n][1].code) for n in nodes])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.int64()))], ["host", "constants"])


def host_of(url) -> F.Column:
    """The host part of a URL, in lower case; empty for a null or broken one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def induce(pages: DataFrame) -> DataFrame:
    """(host, constants): the texts that do not change, as ``constant`` names them, from (host, html)."""
    trees = pages.mapInArrow(_trees, "host string, layout long, page long, tree string")
    # Equal pages count once.  Of a layout's pages, the pattern is one, whichever the hashes choose.
    different = trees.groupBy("host", "layout", "page").agg(F.min("tree").alias("tree"))
    different = written(different, "pages")
    layouts = different.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("page").alias("page")).where(F.col("n") >= LEAST_PAGES)
    patterns = written(different.join(layouts.drop("n"), ["host", "layout", "page"]).select("host", "layout", F.col("tree").alias("pattern")), "patterns")
    counts = different.join(patterns, ["host", "layout"]).mapInArrow(_aligned, "host string, layout long, node int, pages long, same long")
    counts = counts.groupBy("host", "layout", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    stay = counts.where((F.col("pages") >= LEAST_PAGES) & (F.col("same") >= SAME_SHARE * F.col("pages")))
    nodes = stay.groupBy("host", "layout").agg(F.collect_list("node").alias("nodes"))
    found = patterns.join(nodes, ["host", "layout"]).mapInArrow(_templates, "host string, constants array<long>")
    return written(found.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("constants"))).alias("constants")), "templates")


def _blocks(element: Element, path: str, skip: set[int], out: list[str], apart: set[int] = frozenset()) -> None:
    """The texts below an element; a text of the template goes, and so do the elements in ``apart``."""
    todo = [(iter(element.parts), path, [], [])]

    def flush(text, texts):
        if cleaned := _clean(text):
            texts.append((len(out), cleaned))
            out.append(cleaned)
        text.clear()

    while todo:
        parts, path, text, texts = todo[-1]
        for part in parts:
            if isinstance(part, str):
                text.append(part)
            else:
                flush(text, texts)
                if not part.out and id(part) not in apart and part.tag not in VOID:
                    todo.append((iter(part.parts), below(path, part.label), [], []))
                    break
        else:
            flush(text, texts)
            todo.pop()
            if skip and texts:
                code = xxhash.xxh3_64_intdigest("\n".join(t for _, t in texts)) >> 1 or 1
                if constant(path, code) in skip:
                    for at, _ in texts:
                        out[at] = ""


def _articles(element: Element, path: str, out: list[tuple[Element, str]]) -> None:
    todo = [(element, path)]
    while todo:
        element, path = todo.pop()
        if element.tag in ("article", "main"):
            out.append((element, path))
        else:
            todo += [(part, below(path, part.label)) for part in reversed(element.parts) if isinstance(part, Element) and not part.out]


def main_text(page: str | None, constants: set[int]) -> str:
    if not page:
        return ""
    root = parse(page)
    found: list[tuple[Element, str]] = []
    _articles(root, ROOT, found)
    inside: list[str] = []
    for element, path in found:
        _blocks(element, path, constants, inside)
    beside: list[str] = []
    _blocks(root, ROOT, constants, beside, {id(element) for element, _ in found})
    prose = sum(len(x) for x in beside if len(x.split()) >= PROSE)
    # A teaser may be an article element where the story is none.
    chosen = inside if any(inside) and prose <= 2 * sum(map(len, inside)) else beside
    return "\n".join(x for x in chosen if x)


def extract(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` (with ``url`` and ``html``) as ``row``, with its main ``text``."""
    rows = pages.select(host_of(pages["url"]).alias("host"), pages["html"].alias("html"), F.struct(*[pages[c] for c in pages.columns]).alias("row"))
    joined = rows.join(induce(rows.select("host", "html")), "host", "left")

    def texts(batches):
        known: dict[str, set[int]] = {}
        for batch in batches:
            for part in pieces(batch, "html"):
                out = []
                lists = part.column("constants")
                for k, (host, page) in enumerate(zip(*(part.column(c).to_pylist() for c in ("host", "html")))):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = set(lists[k].as_py() or ())
                    out.append(main_text(page, known[host]))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, pa.string())], ["row", "text"])

    return joined.mapInArrow(texts, rows.select("row").withColumn("text", F.lit("")).schema)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
