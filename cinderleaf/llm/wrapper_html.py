"""Main text of web pages by wrapper induction.

A page becomes a tree of block elements with its text blocks as leaves. Its layout is the skeleton of the
upper levels, runs of like elements as one. The pages of a host with the same layout have a wrapper of
their own, those of its rare layouts one together: some of them are aligned by simple tree matching, and a
leaf that stands with the same words at the same place of nearly all of them is template, one that varies is
a content slot. Every page is then aligned with its wrapper's tree, and its leaves that match template
are left out. What a page itself declares to be no
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) is left out in
any case; an article or main element, where there is one, is the content.

Pages are parsed once; their trees are written and everything else reads those. The trees to align are a
bounded number per host and layout; the wrappers of the layouts with many pages are broadcast, a bounded
number too, and the other pages meet theirs in a shuffle only if their layout has any template.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderleaf.llm.common import HOT_KEYS, attach, whole
from cinderleaf.session import bounded, checkpoint

# Pages of a layout that are aligned; different ones needed for a wrapper; share that must agree on a leaf;
# share of the text that may be template (pages beyond it are copies of one article).
PAGES, LEAST_PAGES, AGREE, TEMPLATE_SHARE = 12, 3, 0.8, 0.8
# Pages of a layout that are ranked for that, as a multiple; levels of a tree that make its layout.
DRAWN, LEVELS = 8, 3
PARSED = "url string, host string, layout long, hash long, tree string"
# Elements nested deeper join the tree at this depth; their text stays.
DEEPEST = 100

# Element names of HTML by their role.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address hr header footer nav aside form fieldset details summary "
    "center hgroup menu dialog search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "head script style noscript template title textarea xmp iframe noembed noframes nav footer aside form button "
    "select option svg math canvas audio video object map dialog menu search".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
# Words in class and id that mark what is no article, and those that do so only outside of one.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored "
    "promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments disqus replies respond footer pagination pager "
    "paywall disclaimer".split()
)
OUTER_MARKS = frozenset("header masthead toolbar topbar search widget copyright legal skip".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)|([^>]*+))>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# A tag that the end of the page cuts off.
TORN = re.compile(r"<[/!?a-zA-Z][^>]*\Z")
WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Node:
    """A block element, or a text block when it has words."""

    __slots__ = ("label", "children", "words", "linked")

    def __init__(self, label: str, words: str = "", linked: bool = False):
        self.label, self.words, self.linked = label, words, linked
        self.children: list[Node] = []


def _declared(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element says that it is no article; `inside` tells that an article is around it."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            marks = {w.lower() for w in WORD.findall(value)}
            if tag == "article":
                marks &= {"comment", "comments", "ad", "advert", "sponsored", "related"}
            if marks & MARKS or (not inside and marks & OUTER_MARKS):
                return True
        elif name == "role" and value.lower() in ROLES and tag != "article":
            return True
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page's blocks, without what declares to be no article."""
    root = Node("")
    # open elements: (tag, the node that takes their text, left out, within an article, within a link)
    stack: list[tuple[str, Node, bool, bool, bool]] = [("", root, False, False, False)]
    depth = {id(root): 0}
    text: list[str] = []
    links = [0, 0]  # letters of the block: all, within links

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                stack[-1][1].children.append(Node("#", words, links[1] * 2 > links[0]))
            text.clear()
            links[:] = [0, 0]

    def say(raw: str) -> None:
        if raw and not stack[-1][2]:
            text.append(raw)
            n = len(raw) - raw.count(" ")
            links[0] += n
            links[1] += n * stack[-1][4]

    opened: dict[str, int] = {}

    def close(upto: int) -> None:
        if any(t[0] in BLOCKS for t in stack[upto:]):
            flush()
        for name, *_ in stack[upto:]:
            opened[name] -= 1
        del stack[upto:]

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        found = TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if not found:
            say(TORN.sub("", page[at:]))
            break
        say(page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("article", "main", "body", "td", "th") and tag not in BLOCKS:
                    break
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        attributes = found.group(3) or found.group(4) or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = size if end is None else end.start()
            if end is not None:
                closing = page.find(">", at)
                at = size if closing < 0 else closing + 1
            continue
        if tag in VOID:
            continue
        closes = CLOSES.get(tag, ())
        ends = any(opened.get(t) for t in closes) or (opened.get("p") and tag in BLOCKS)
        for i in range(len(stack) - 1, 0, -1) if ends else ():
            name = stack[i][0]
            if name in closes:
                close(i)
            elif name == "p" and tag in BLOCKS:
                close(i)
                break
            elif name in SCOPES.get(tag, ("table",)) or name in ("article", "main", "body"):
                break
        _, node, gone, inside, linked = stack[-1]
        gone = gone or _declared(tag, attributes, inside)
        inside = inside or tag == "article" or tag == "main"
        if tag in BLOCKS:
            flush()
            if not gone and depth[id(node)] < DEEPEST:
                node.children.append(Node(tag))
                depth[id(node.children[-1])] = depth[id(node)] + 1
                node = node.children[-1]
        if not attributes.rstrip().endswith("/") or tag in BLOCKS:
            stack.append((tag, node, gone, inside, linked or tag == "a"))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return root


def content(root: Node) -> Node:
    """The tree's articles, else its main elements, else all of it without lists of links."""
    for wanted in ("article", "main"):
        found: list[Node] = []
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if node.label == wanted:
                found.append(node)
            else:
                waiting += reversed(node.children)
        if found:
            region = Node("")
            region.children = found
            return region
    return _without_links(root)


def _without_links(node: Node) -> Node:
    out = Node(node.label, node.words, node.linked)
    for child in node.children:
        if child.label in ("ul", "ol", "table", "div", "section"):
            leaves = list(texts(child))
            if len(leaves) > 1 and all(leaf.linked for leaf in leaves):
                continue
        out.children.append(_without_links(child))
    return out


def texts(node: Node) -> Iterator[Node]:
    """The text blocks of a tree in page order."""
    waiting = [node]
    while waiting:
        node = waiting.pop()
        if node.label == "#":
            yield node
        waiting += reversed(node.children)


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: (weight, matched text blocks) of the best order-keeping match of two trees.

    Only nodes with the same label match; a text block weighs one, and two more with the same words.
    """
    if a.label != b.label:
        return 0, []
    if a.label == "#":
        return (3 if a.words == b.words else 1), [(a, b)]
    n, m = len(a.children), len(b.children)
    pairs = [[match(x, y) for y in b.children] for x in a.children]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, m + 1):
            row[j] = max(above[j], row[j - 1], above[j - 1] + pairs[i - 1][j - 1][0])
    found: list[tuple[Node, Node]] = []
    i, j = n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            found += pairs[i - 1][j - 1][1]
            i, j = i - 1, j - 1
    return 1 + best[n][m], found


def skeleton(node: Node, levels: int = LEVELS) -> str:
    """The labels of a tree's upper levels, runs of like elements as one."""
    if node.label == "#" or not levels:
        return node.label
    inner: list[str] = []
    for child in node.children:
        shape = skeleton(child, levels - 1)
        if not inner or inner[-1] != shape:
            inner.append(shape)
    return f"{node.label}({','.join(inner)})"


def induce(pages: list[str]) -> str | None:
    """The wrapper of pages, see `induce_trees`."""
    return induce_trees([content(parse(page)) for page in pages])


def induce_trees(pages: list[Node]) -> str | None:
    """The wrapper of content trees as JSON: a tree whose template leaves have words; None without any."""
    trees, seen = [], set()
    for tree in pages:
        said = "\n".join(leaf.words for leaf in texts(tree))
        if said and said not in seen:
            seen.add(said)
            trees.append((len(said), said, tree))
    if len(trees) < LEAST_PAGES:
        return None
    trees.sort(key=lambda t: t[:2])
    base = trees[0][2]
    agreed: dict[int, int] = {}
    for _, _, tree in trees[1:]:
        for own, other in match(base, tree)[1]:
            agreed[id(own)] = agreed.get(id(own), 0) + (own.words == other.words)
    constant = {k for k, n in agreed.items() if n >= AGREE * (len(trees) - 1)}
    template = sum(len(leaf.words) for leaf in texts(base) if id(leaf) in constant)
    if not constant or template > TEMPLATE_SHARE * sum(t[0] for t in trees) / len(trees):
        return None
    return json.dumps(_told(base, constant))


def _told(node: Node, shown: set[int] | None = None) -> list:
    """A tree as nested lists; with `shown`, only those leaves keep their words."""
    if node.label == "#":
        return ["#", node.words if shown is None or id(node) in shown else None]
    return [node.label, [_told(child, shown) for child in node.children]]


def _tree(told: list) -> Node:
    if told[0] == "#":
        return Node("#", told[1] or "")
    node = Node(told[0])
    node.children = [_tree(child) for child in told[1]]
    return node


def extract(page: str, wrapper: str | None = None) -> str:
    """The text blocks of a page's content that are not template, joined by line breaks."""
    return remaining(content(parse(page)), wrapper)


def remaining(tree: Node, wrapper: str | None) -> str:
    """The text blocks of a content tree that are not template, joined by line breaks."""
    gone = set()
    if wrapper:
        gone = {id(own) for own, other in match(tree, _tree(json.loads(wrapper)))[1] if own.words == other.words}
    return "\n".join(leaf.words for leaf in texts(tree) if id(leaf) not in gone)


def host_of(url: str):
    """Column: the host of an address, empty for anything else."""
    return F.lower(F.regexp_extract(whole(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def parse_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, host, layout, hash, tree): the content tree of every page as JSON, and hashes of layout and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [content(parse(p)) for p in batch.column(3).to_pylist()]
            layouts = [_number(skeleton(t)) for t in trees]
            said = [_number("\n".join(leaf.words for leaf in texts(t))) for t in trees]
            told = [json.dumps(_told(t), ensure_ascii=False) for t in trees]
            cells = [*batch.columns[:3], pa.array(layouts, pa.int64()), pa.array(said, pa.int64()), pa.array(told, pa.string())]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "url", "host", "layout", "hash", "tree"])

    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), host_of(url).alias("host"), whole(page).alias("html"))
    return rows.mapInArrow(run, f"id {dict(pages.dtypes)[page_id]}, {PARSED}")


def wrappers(parsed: DataFrame) -> DataFrame:
    """(host, layout, pages, wrapper) of the layouts that have template within their content."""
    each = checkpoint(parsed.groupBy("host", "layout", "hash").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    layouts = checkpoint(each.groupBy("host", "layout").agg(F.sum("copies").alias("pages"), F.count("*").alias("different")))
    total = each.count()
    # a rare layout shares the unit 0 of its host
    unit = F.when(F.col("different") >= LEAST_PAGES, F.col("layout")).otherwise(0).alias("unit")
    placed = attach(each, layouts, ["host", "layout"], "different", total).select("host", unit, "hash", "id", "layout")
    units = checkpoint(layouts.groupBy("host", unit).agg(F.sum("different").alias("different")))
    # a draw by the text's hash leaves some times the wanted pages of a unit for the window
    share = F.pmod("hash", F.lit(1_000_000)) * F.col("different") < F.lit(1_000_000 * DRAWN * PAGES)
    drawn = attach(placed, units, ["host", "unit"], "different", total).where(share)
    place = F.row_number().over(Window.partitionBy("host", "unit").orderBy("hash", "layout"))
    chosen = drawn.where(F.col("different") >= LEAST_PAGES).withColumn("place", place)
    chosen = checkpoint(chosen.where(F.col("place") <= PAGES).select("host", "layout", "unit", "hash", "id"))
    aligned = parsed.select("host", "layout", "hash", "id", "tree").join(bounded(chosen), ["host", "layout", "hash", "id"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        some = group.drop_duplicates("hash").sort_values("hash")
        found = induce_trees([_tree(json.loads(t)) for t in some["tree"]])
        out = pd.DataFrame({"host": some["host"].iloc[:1], "unit": some["unit"].iloc[:1], "wrapper": [found]})
        return out if found else out.iloc[:0]

    found = aligned.groupBy("host", "unit").applyInPandas(learn, "host string, unit long, wrapper string")
    named = layouts.select("host", "layout", "pages", unit)
    return checkpoint(named.join(found, ["host", "unit"]).select("host", "layout", "pages", "wrapper"))


def extract_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """Per row of `pages`: page_id, url, text, n_chars.

    A null page is empty and has no text; a null or malformed url belongs to the host without a name;
    rows that repeat an id are extracted on their own. A layout with fewer than three different pages shares a
    wrapper with the other rare layouts of its host; a host with fewer than three different pages has none. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = checkpoint(parse_pages(pages, page_id, url, page))
    known = wrappers(rows)
    total = rows.count()
    key = ["host", "layout"]
    # every hot layout holds more than 1 / HOT_KEYS of the pages
    hot = known.where(F.col("pages") * HOT_KEYS > total).select(*key, "wrapper")
    mild = known.where(F.col("pages") * HOT_KEYS <= total).select(*key, "wrapper")
    parts = rows.join(F.broadcast(hot), key, "left")
    if not mild.isEmpty():
        names = bounded(mild.select(*key))
        parts = (
            rows.join(names, key, "left_anti")
            .join(F.broadcast(hot), key, "left")
            .unionByName(rows.join(mild, key))
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            said = [remaining(_tree(json.loads(t)), w) for t, w in told]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array([len(s) for s in said], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)[page_id]
    found = parts.select("id", "url", "tree", "wrapper").mapInArrow(
        run, f"id {kind}, url string, text string, n_chars long"
    )
    return found.withColumnsRenamed({"id": page_id, "url": url})
