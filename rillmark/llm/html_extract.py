"""Main text of web pages by wrapper induction.

Every page is parsed once into a tree of its block elements, in which siblings of one label (tag,
class, id and role) are one repeating node, and into text blocks that name their node. The most
common tree of a host is its wrapper; every other tree of the host is aligned with it by simple
tree matching, once for each distinct tree. The wrapper's nodes are slots. A node without a partner
belongs to the slot of its nearest aligned ancestor.

* Constant: a text that stands in a slot on more than half of the host's different pages that have
  text there, and on ``SEVERAL`` of them at least, is template. Pages with the same content are one
  page, however many rows hold it.
* Varying: what is left is summed by slot over all pages of the host, links left out. Content is the
  smallest part of the wrapper that holds two thirds of it at every step down (``content_slots``),
  so what a host's pages have in common decides where its content is. What an element declares
  weighs in: menus, headers, footers, sidebars, notices, adverts, forms and comments (by tag, role,
  class or id) have no weight and are no content, and text in an ``article`` or ``main`` counts
  ``MAIN`` times; the part begins at such an element where one is around it.
* A class or id names such a part only by a whole name (``cookie-notice``), not by a word of a
  phrase (``notice-of-award``), and names of other parts (``search``, ``related``) say nothing: these stay where the wrapper keeps them.
* Pages of a host with fewer than ``SEVERAL`` different pages, and pages without the slot where the
  content begins, are judged alone: by the same rule over their own text.

Counts by text and slot are combined before the shuffle; what is joined to pages is one row for each
distinct tree of a host, in a join that Spark may split or broadcast by its measured size.

Defined results: a null or empty page has an empty text; a null url is of the host ""; repeated
rows give the same text each and change no other page's; very long and very deep pages are parsed
whole, without recursion; a tag whose quotes never close ends at the next ``>``; an empty table gives
no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .urls import host_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements of HTML by kind.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = BLOCK - {"button", "option", "select", "html", "body", "head"}
#: An element of the key ends open elements of the value, up to the nearest of the third set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements that are parts of a text, never the whole of it.
PIECES = HEADINGS | {"p", "li", "tr", "td", "dd", "dt"}
NOT_CONTENT = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "option", "fieldset", "dialog"}
NOT_CONTENT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: Words in a class or id by which parts of a page that are no content are named.
NOT_CONTENT_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar",
    "sidebar", "aside", "widget", "footer", "copyright", "header", "masthead", "topbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "disclaimer",
    "newsletter", "subscribe", "subscription", "signup", "login", "form",
    "comment", "comments", "commentlist", "respond", "replies", "disqus",
}
NOT_ARTICLE_NAMES = {"comment", "reply", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "recommended", "teaser"}
#: Words that say nothing beside one of the above within a name.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "group", "holder",
    "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "right",
    "row", "section", "site", "slot", "text", "thread", "top", "unit", "wrap", "wrapper",
}
#: Words that make a class or id a phrase, which names nothing.
PHRASE = {"a", "an", "and", "at", "by", "for", "from", "has", "in", "is", "no", "of", "on", "or", "the", "to", "with", "without"}
#: Different pages that have to share a text before it can be template.
SEVERAL = 3
#: How many times text in a declared article counts.
MAIN = 4

Tree = list[tuple[int, str]]


class Node:
    __slots__ = ("label", "kids", "at")

    def __init__(self, label: str):
        self.label, self.kids, self.at = label, {}, -1


def label_of(tag: str, attributes: str) -> str:
    """The tag, its names (letters only, words of a name joined by -) and its role."""
    if not attributes or "=" not in attributes:
        return tag
    names, role = set(), ""
    for m in MARKS.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = "-".join(WORD.findall(value))
        else:
            names.update("-".join(WORD.findall(x)) for x in value.split())
    names.discard("")
    return tag + "".join(f".{x}" for x in sorted(names)) + ("@" + role if role else "")


class Page:
    """The open elements of a page while it is read, and what has been found."""

    def __init__(self):
        self.root = Node("#")
        self.stack: list[tuple[str, Node]] = [("#", self.root)]
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[Node, str, int]] = []
        self.held: list[str] = []
        self.in_link, self.linked = False, 0

    def say(self, text: str) -> None:
        self.held.append(text)
        if self.in_link:
            self.linked += len(text)

    def flush(self) -> None:
        if self.held:
            text = " ".join(unescape("".join(self.held)).split())
            if text:
                self.blocks.append((self.stack[-1][1], text, min(self.linked, len(text))))
            self.held.clear()
            self.linked = 0

    def begin(self, tag: str, label: str) -> None:
        kids = self.stack[-1][1].kids
        if label not in kids:
            kids[label] = Node(label)
        self.stack.append((tag, kids[label]))
        self.open[tag] += 1

    def end(self, tags: set[str], until: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                self.flush()
                for tag, _ in self.stack[i:]:
                    self.open[tag] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in until:
                return

    def tree(self) -> Tree:
        order: Tree = []
        todo = [(0, self.root)]
        while todo:
            depth, node = todo.pop()
            node.at = len(order)
            order.append((depth, node.label))
            todo.extend((depth + 1, k) for k in reversed(node.kids.values()))
        return order


def parse(html: str) -> tuple[Tree, list[tuple[int, str, int]]]:
    """The tree in preorder as (depth, label), and the blocks as (node, text, characters of it in
    links) in page order."""
    page = Page()
    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            page.say(html[at:])
            break
        if m.start() > at:
            page.say(html[at : m.start()])
        at = m.end()
        closes, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        tag = name.lower()
        if tag == "a":
            page.in_link = not closes
        if closes:
            if tag in BLOCK:
                page.flush()
                page.end({tag}, {"#"})
            continue
        if tag in RAW:
            at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at).end()
            continue
        if tag == "br":
            page.say(" ")
        if tag not in BLOCK:
            continue
        page.flush()
        if tag in CLOSES_P:
            page.end({"p"}, {"td", "th", "table", "button", "#"})
        if tag in ENDS:
            page.end(*ENDS[tag])
        if tag in HEADINGS and page.stack[-1][0] in HEADINGS:
            page.end({page.stack[-1][0]}, {"#"})
        if tag not in VOID:
            page.begin(tag, label_of(tag, attributes))
    page.flush()
    order = page.tree()
    return order, [(node.at, text, linked) for node, text, linked in page.blocks]


def to_text(order: Tree) -> str:
    return ";".join(f"{d} {label}" for d, label in order)


def from_text(tree: str) -> Tree:
    return [(int(d), label) for d, _, label in (x.partition(" ") for x in tree.split(";"))]


def parents(order: Tree) -> list[int]:
    """The node above each node; -1 above the root."""
    out, path = [], []
    for i, (depth, _) in enumerate(order):
        del path[depth:]
        out.append(path[-1] if path else -1)
        path.append(i)
    return out


def kids_of(order: Tree) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in order]
    for i, above in enumerate(parents(order)):
        if above >= 0:
            kids[above].append(i)
    return kids


def heaviest_rising(pairs: list[tuple[int, int]], weight: list[int]) -> list[int]:
    """Which of the pairs (k, m), rising in k and no m twice, to take so that m rises as well and
    their weight is largest; sums of prefixes are kept in a tree of maxima."""
    rank = {m: r for r, m in enumerate(sorted(m for _, m in pairs), 1)}
    best = [(0, -1)] * (len(pairs) + 1)
    before = []
    for x, (_, m) in enumerate(pairs):
        r, got = rank[m] - 1, (0, -1)
        while r > 0:
            got = max(got, best[r])
            r -= r & -r
        before.append(got[1])
        r, total = rank[m], (got[0] + weight[x], x)
        while r <= len(pairs):
            best[r] = max(best[r], total)
            r += r & -r
    r, last = len(pairs), (0, -1)
    while r > 0:
        last = max(last, best[r])
        r -= r & -r
    out, x = [], last[1]
    while x >= 0:
        out.append(x)
        x = before[x]
    return out[::-1]


def match_trees(one: Tree, two: Tree) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping match of equal labels under equal parents;
    node of ``one`` -> node of ``two``. Siblings have different labels, so that a node has one
    possible partner and a match of siblings is a heaviest rising sequence."""
    if one[0][1] != two[0][1]:
        return {}
    a, b = kids_of(one), kids_of(two)
    pairs, first = [(0, 0)], []
    for i, j in pairs:  # sees the pairs that it adds
        place = {two[m][1]: m for m in b[j]}
        first.append(len(pairs))
        pairs.extend((k, place[one[k][1]]) for k in a[i] if one[k][1] in place)
    first.append(len(pairs))
    size, taken = [1] * len(pairs), [[]] * len(pairs)
    for p in range(len(pairs) - 1, -1, -1):
        own = range(first[p], first[p + 1])
        if len(own) == 1:
            taken[p] = [own[0]]
        elif len(own):
            taken[p] = [own[x] for x in heaviest_rising([pairs[q] for q in own], [size[q] for q in own])]
        size[p] += sum(size[q] for q in taken[p])
    found, todo = {}, [0]
    while todo:
        p = todo.pop()
        found[pairs[p][0]] = pairs[p][1]
        todo.extend(taken[p])
    return found


def named(names: list[str], known: set[str]) -> bool:
    """Whether a whole name of an element consists of known words, beside neutral ones."""
    words = [set(n.split("-")) for n in names]
    if any(w & PHRASE for w in words):
        return False
    return any(w & known and not w - known - NEUTRAL - NOT_CONTENT_NAMES for w in words)


def is_main(label: str) -> bool:
    name, _, role = label.partition("@")
    return name.split(".")[0] in ("article", "main") or role in ("main", "article")


def declared(label: str, inside_main: bool, around_main: bool) -> str:
    """"no" for a part that says it is no content, "main" for one that says it is, else "".

    Against an article, and what lies around one, only the names of comments, adverts and teasers
    count.
    """
    name, _, role = label.partition("@")
    tag, *names = name.split(".")
    if tag in NOT_CONTENT or role in NOT_CONTENT_ROLES or tag == "header" and not inside_main:
        return "no"
    main = is_main(label)
    known = NOT_ARTICLE_NAMES | ({"comments"} if around_main else set()) if main or around_main else NOT_CONTENT_NAMES
    if tag not in ("html", "body") and names and named(names, known):
        return "no"
    return "main" if main else ""


def declared_parts(order: Tree) -> tuple[list[bool], list[bool]]:
    """Which nodes are declared to be no content, and which are in a declared article or main part."""
    above = parents(order)
    around = [False] * len(order)
    for i in range(len(order) - 1, 0, -1):
        around[above[i]] |= around[i] or is_main(order[i][1])
    no, main = [False] * len(order), [False] * len(order)
    for i, (_, label) in enumerate(order):
        inside = i > 0 and main[above[i]]
        says = declared(label, inside, around[i] and not inside)
        no[i] = says == "no" or i > 0 and no[above[i]]
        main[i] = not no[i] and (inside or says == "main")
    return no, main


def content_slots(order: Tree, varying: list[int], parts: tuple[list[bool], list[bool]]) -> tuple[int, list[bool]]:
    """The slot where content begins, and which slots are content. ``varying``: how much varying
    text each has. Without any, content begins nowhere (-1).

    From the root on, the child goes on that holds two thirds of the weight, if one does. Beside
    that part, varying headings next to it or to what is around it, and other declared articles
    with varying text, are content.
    """
    no, main = parts
    above = parents(order)
    weight = [0 if no[i] else varying[i] * (MAIN if main[i] else 1) for i in range(len(order))]
    below, heaviest = weight[:], [-1] * len(order)
    for i in range(len(order) - 1, 0, -1):
        below[above[i]] += below[i]
    if not below[0]:
        return -1, [False] * len(order)
    for i in range(len(order) - 1, 0, -1):
        if heaviest[above[i]] < 0 or below[i] >= below[heaviest[above[i]]]:
            heaviest[above[i]] = i
    top = 0
    while heaviest[top] >= 0 and 3 * below[heaviest[top]] >= 2 * below[top]:
        top = heaviest[top]
    if order[top][1].split(".")[0] in PIECES:
        top = above[top]
    path = [top]
    while path[-1]:
        path.append(above[path[-1]])
    top = next((i for i in reversed(path) if main[i]), top)
    around = set(path[path.index(top) + 1 :])
    keep = [False] * len(order)
    for i, (_, label) in enumerate(order):
        if i:
            keep[i] = keep[above[i]] or above[i] in around and label.split(".")[0] in HEADINGS and weight[i] > 0
        keep[i] = (keep[i] or i == top or main[i] and below[i] > 0) and not no[i]
    return top, keep


def content_key(no: list[bool], found: list[tuple[int, str, int]]) -> int:
    """A key of what a page says where it may be content."""
    said = "\x1f".join(text for node, text, _ in found if not no[node])
    return int.from_bytes(blake2b(said.encode(), digest_size=8).digest(), "little", signed=True)


def alone(order: Tree, found: list[tuple[int, str, int]], parts: tuple[list[bool], list[bool]]) -> list[int]:
    """The nodes whose text is content, judged by one page."""
    varying = [0] * len(order)
    for node, text, linked in found:
        varying[node] += len(text) - linked
    top, keep = content_slots(order, varying, parts)
    if top < 0:
        keep = [not x for x in parts[0]]
    return [i for i, kept in enumerate(keep) if kept]


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, host, tree, tree_id, page (key of its content), alone (the nodes that are content by
    the page alone) and blocks (node, text, linked) of every page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("node", pa.int32()), ("text", pa.string()), ("linked", pa.int32())])
        known: dict[str, tuple[list[bool], list[bool]]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                trees, blocks, keys, own = [], [], [], []
                if len(known) > 2000:
                    known.clear()
                for html in part.column(3).to_pylist():
                    order, found = parse(html or "")
                    trees.append(to_text(order))
                    parts = known.get(trees[-1]) or declared_parts(order)
                    if len(order) < 1000:
                        known[trees[-1]] = parts
                    keys.append(content_key(parts[0], found))
                    own.append(alone(order, found, parts))
                    blocks.append([{"node": n, "text": t, "linked": k} for n, t, k in found])
                cols = [part.column(0), part.column(1), part.column(2), pa.array(trees, pa.string()), pa.array(keys, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(blocks, pa.list_(block))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "host", "tree", "page", "alone", "blocks"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("h"))
    out = rows.mapInArrow(run, f"id {kind}, url string, host string, tree string, page long, alone array<int>, blocks array<struct<node:int,text:string,linked:int>>")
    return out.withColumn("tree_id", F.xxhash64("tree"))


def different_pages(parsed: DataFrame) -> DataFrame:
    """host, tree_id, said (node, said, size, linked) of the host's different pages, one row each."""
    said = F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("said"), F.length(b["text"]).alias("size"), b["linked"].alias("linked")))
    return parsed.select("host", "page", F.struct("tree_id", said.alias("said")).alias("p")).groupBy("host", "page").agg(F.min("p").alias("p")).select("host", "p.*")


def alignments(parsed: DataFrame, pages: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(host, tree_id, tree, to), the slot of each node of every tree (-1 - the slot above, if it has
    none of its own); and (host, wrapper, pages), one row of each host."""
    known = parsed.groupBy("host", "tree_id").agg(F.first("tree").alias("tree"))
    trees = written(known.join(pages.groupBy("host", "tree_id").agg(F.count("*").alias("n")), ["host", "tree_id"], "left"), "trees", rows)
    hosts = trees.groupBy("host").agg(F.max_by("tree", F.struct(F.coalesce("n", F.lit(0)), "tree_id")).alias("wrapper"), F.sum("n").alias("pages"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, wrapper in zip(batch.column("tree").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                one = from_text(tree)
                if tree == wrapper:
                    out.append(list(range(len(one))))
                    continue
                found, to = match_trees(one, from_text(wrapper)), []
                for i, above in enumerate(parents(one)):
                    near = 0 if above < 0 else to[above] if to[above] >= 0 else -1 - to[above]
                    to.append(found.get(i, -1 - near))
                out.append(to)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "tree_id", "tree")), pa.array(out, pa.list_(pa.int32()))], names=["host", "tree_id", "tree", "to"])

    aligned = trees.drop("n").join(hosts.select("host", "wrapper"), "host").mapInArrow(align, "host string, tree_id long, tree string, to array<int>")
    return written(aligned, "alignments", rows), written(hosts, "hosts", rows)


def wrappers(parsed: DataFrame, rows: int) -> DataFrame:
    """host, tree_id, slots (the slot of each node that is content, else -1; null where the wrapper
    doesn't say) and template (slot and hash of the texts to leave out) for every tree of a host."""
    pages = written(different_pages(parsed), "different-pages", rows)
    aligned, hosts = alignments(parsed, pages, rows)
    slot = lambda to: F.when(to < 0, -1 - to).otherwise(to)
    in_slots = F.transform("said", lambda s: F.struct(slot(F.get("to", s["node"])).alias("slot"), s["said"].alias("said"), (s["size"] - s["linked"]).alias("free")))
    slotted = pages.join(aligned.select("host", "tree_id", "to"), ["host", "tree_id"]).select("host", in_slots.alias("said"))
    by_text = slotted.select("host", F.explode(F.array_distinct("said")).alias("s")).groupBy("host", "s.slot", "s.said").agg(F.count("*").alias("n"), F.sum("s.free").alias("free"))
    by_text = written(by_text, "said")
    having = slotted.select("host", F.explode(F.array_distinct("said.slot")).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("all"))
    common = by_text.where(F.col("n") >= SEVERAL).join(having, ["host", "slot"]).where("2 * n > all").select("host", "slot", "said", "free")
    common = written(common, "template", by_text.count())
    total = by_text.groupBy("host", "slot").agg(F.sum("free").alias("free"))
    total = total.unionByName(common.groupBy("host", "slot").agg((-F.sum("free")).alias("free"))).groupBy("host", "slot").agg(F.sum("free").alias("varying"))
    weights = total.groupBy("host").agg(F.collect_list(F.struct("slot", "varying")).alias("weights"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, out = [], []
            for wrapper, pages, weights_of in zip(*(batch.column(c).to_pylist() for c in ("wrapper", "pages", "weights")), strict=True):
                order = from_text(wrapper)
                varying = [0] * len(order)
                for w in weights_of or ():
                    varying[w["slot"]] = w["varying"]
                top, keep = content_slots(order, varying, declared_parts(order)) if (pages or 0) >= SEVERAL else (-1, [])
                tops.append(top)
                out.append([i for i, kept in enumerate(keep) if kept])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(tops, pa.int32()), pa.array(out, pa.list_(pa.int32()))], names=["host", "top", "content"])

    decided = hosts.join(weights, "host", "left").mapInArrow(decide, "host string, top int, content array<int>").where("top >= 0")
    template = common.groupBy("host").agg(F.collect_list(F.struct("slot", "said")).alias("template"))
    decided = written(decided.join(template, "host", "left"), "decided", rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, to, top, content in zip(*(batch.column(c).to_pylist() for c in ("tree", "to", "top", "content")), strict=True):
                if top not in to:
                    out.append(None)
                    continue
                own, no = set(content), declared_parts(from_text(tree))[0]
                slots = [s if s >= 0 else -1 - s for s in to]
                out.append([s if s in own and not no[i] else -1 for i, s in enumerate(slots)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "tree_id")), pa.array(out, pa.list_(pa.int32())), batch.column("template")], names=["host", "tree_id", "slots", "template"])

    return aligned.join(decided, "host").mapInArrow(place, "host string, tree_id long, slots array<int>, template array<struct<slot:int,said:long>>").where("slots is not null")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and induced (whether a wrapper decided) of every page."""
    parsed = written(parsed_pages(pages, id_col, url_col, html_col), "parsed-pages")
    rows = parsed.count()
    joined = parsed.join(written(wrappers(parsed, rows), "wrappers", rows), ["host", "tree_id"], "left")
    slot = lambda b: F.get("slots", b["node"])
    left_out = lambda b: F.coalesce(F.exists("template", lambda t: (t["slot"] == slot(b)) & (t["said"] == F.xxhash64(b["text"]))), F.lit(False))
    by_wrapper = F.filter("blocks", lambda b: (slot(b) >= 0) & ~left_out(b))
    by_page = F.filter("blocks", lambda b: F.array_contains("alone", b["node"]))
    induced = F.col("slots").isNotNull()
    text = F.array_join(F.transform(F.when(induced, by_wrapper).otherwise(by_page), lambda b: b["text"]), "\n")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.coalesce(text, F.lit("")).alias("text"), induced.alias("induced"))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).drop("induced").withColumn("n_chars", F.length("text").cast("long"))
