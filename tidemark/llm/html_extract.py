"""Main-text extraction by wrapper induction over pages of one host.

Each page is parsed to a DOM tree, and the tree reduced to a skeleton: siblings with one label (tag and classes) become one
iterated node, so a node's children have different labels. Pages of a host whose bodies have the same kinds of children are one
layout; the skeleton that most of a layout's pages have is its reference. All pages of the layout are aligned with it by
simple tree matching, which, labels being unique among siblings, is a heaviest increasing subsequence at each node. For
every reference node and text it is counted on how many pages the text stands there. Pages with equal headings, or without any
and with equal texts, are copies or near copies and count as one. Then, for a layout with ``LEAST_PAGES`` distinct pages:

* a text that stands at its node on ``CONSTANT`` of the pages that have the node is template, inside an article too;
* the other texts are slots, and the content is found by their mass: from the root on, as long as one child holds two thirds of
  what varies, is no text block itself and leaves no varying ``h1`` beside it, the content lies in that child.

A page's text is what its nodes under the content node hold, without template texts. A page whose layout has too few distinct
pages, or that has no content node, takes its outermost ``article`` or ``main`` elements, else its body without headers.

What HTML itself marks as menu, footer, sidebar, form, script, style, dialog or hidden, by element, role or attribute, is left
out in any case. Adverts and comments vary like content; the customary class names for these (``HINT``, whole names) are the
tie-break.

Counts are summed in each batch before they are shuffled, so a host with a third of all pages is a few rows a task.

Defined results: null or empty html gives an empty text; a null or malformed url is a host of its own; repeated rows each get
their text; of skeletons that are equally frequent the least is the reference; nodes of any depth and pages of any width are
aligned; a very long page is parsed whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm import common

#: Distinct pages of a layout that a template is made from, and the share of them with a text for it to be template.
LEAST_PAGES, CONSTANT = 3, 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|template|iframe|svg|select|canvas"
INLINE = frozenset("a abbr acronym math mi mn mo mrow msup msub mfrac mtext semantics noscript b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {  # opening the key ends an open element of these, down to the nearest of _SCOPE
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set(), "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_NO_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd tr td th".split())
_P_SCOPE = frozenset("article section div main body html table td th li ul ol dl dd blockquote aside nav header footer form figure button".split())

DROPPED = frozenset("head nav aside footer form button dialog menu input audio video map".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

#: Class names and ids that adverts, reader comments and such customarily have.
HINT = re.compile(
    r"(?:ads?|ad-(?:banner|box|container|slot|unit|wrapper)|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo|comments?|comments?-(?:area|form|list|section|thread)|disqus(?:_thread)?|replies"
    r"|share|share-(?:bar|buttons?|links?)|social|social-(?:buttons?|links?|share)|newsletter|newsletter-(?:box|form|signup)|related|related-(?:articles|links|posts|stories)"
    r"|cookies?|cookie-(?:banner|bar|consent|notice)|consent|gdpr|popup|modal|breadcrumbs?|pagination|pager|sidebar)"
)

#: Elements that hold running text of their own; content never lies in one of these alone.
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th figcaption caption address summary".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW + r")\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?][^>]*>|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'>/]+)")
_DIGITS = re.compile("[0-9]+")
_KEPT_ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())


class Node:
    """An element; ``number`` is its skeleton node, -1 for none, and ``text`` the hash of its own text, 0 for none."""

    __slots__ = ("tag", "label", "attrs", "children", "parent", "number", "text")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.label = tag + ("." + ".".join(sorted(_DIGITS.sub("0", attrs["class"].lower()).split())) if attrs.get("class") else "")
        self.number, self.text = -1, 0


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    found = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(raw):
        key = (name or bare).lower()
        if key in _KEPT_ATTRIBUTES and key not in found:
            found[key] = a or b or c
    return found


def parse(page: str) -> Node:
    """A DOM tree that forgives unclosed and stray tags; scripts, styles and the like have no children."""
    root = now = Node("#root", {}, None)
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            now.children.append(page[at : m.start()])
        at = m.end()
        raw, _, closing, tag, attrs = m.groups()
        if raw or tag is None:
            continue
        tag = tag.lower()
        if closing:
            node = now
            while node.parent is not None and node.tag != tag:
                if tag == "p" and node.tag in _P_SCOPE:
                    node = root
                    break
                node = node.parent
            if node.parent is not None:
                now = node.parent
            continue
        if tag in _NO_PARAGRAPH:
            node = now
            while node.parent is not None and node.tag != "p" and node.tag not in _P_SCOPE:
                node = node.parent
            if node.tag == "p":
                now = node.parent
        if tag in CLOSES:
            node, scope = now, _SCOPE[tag]
            while node.parent is not None and node.tag not in scope:
                if node.tag in CLOSES[tag]:
                    now = node.parent
                node = node.parent
        node = Node(tag, _attributes(attrs), now)
        now.children.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            now = node
        elif tag not in VOID and attrs.endswith("/"):
            now = node  # a solidus closes nothing but void elements
    if at < len(page):
        now.children.append(page[at:])
    return root


# ---------------------------------------------------------------- skeletons and their alignment


def _left_out(node: Node) -> bool:
    """Whether HTML's own marks, or else a customary name, say that the element is no content."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in _DROPPED_ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(map(HINT.fullmatch, (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()))


def _own_text(node: Node) -> str:
    """The element's text outside of block elements below it, white space made single."""
    out, todo = [], [*reversed(node.children)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in INLINE and not _left_out(x):
            todo += reversed(x.children)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


@dataclass
class Skeleton:
    """A page's skeleton as lines of depth and label in preorder, what kinds of children its body has, and the texts of its
    nodes as (node, hash, characters), with a hash of its headings, or of all texts where it has none."""

    lines: str
    layout: int
    texts: list[tuple[int, int, int]]
    story: int


def layout_of(root: Node) -> int:
    """A hash of the kinds of children that the page's body has (or its root, for a page without one)."""
    todo, top = [root], root
    while todo:
        x = todo.pop()
        if x.tag == "body":
            top = x
            break
        if x.tag in ("#root", "html"):
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    kinds = {c.label for c in top.children if isinstance(c, Node) and c.tag not in INLINE and not _left_out(c)}
    return xxhash.xxh64_intdigest("\n".join(sorted(kinds))) - (1 << 63)


def skeleton(root: Node) -> Skeleton:
    """The skeleton of what is not left out; elements learn their number in it and the hash of their text."""
    parts: list[str] = []
    texts: list[tuple[int, int, int]] = []
    headings: list[str] = []
    todo: list[tuple[list[Node], int]] = [([root], 0)]
    while todo:
        group, depth = todo.pop()
        number = len(parts)
        parts.append(f"{depth} {group[0].label}")
        kids: dict[str, list[Node]] = {}
        for node in group:
            node.number = number
            own = _own_text(node)
            if own:
                node.text = xxhash.xxh64_intdigest(own) - (1 << 63) or 1
                texts.append((number, node.text, len(own)))
                if node.tag in ("h1", "h2", "h3"):
                    headings.append(own)
            below = [*reversed(node.children)]
            while below:  # blocks below inline elements are children too
                child = below.pop()
                if isinstance(child, str) or _left_out(child):
                    continue
                if child.tag in INLINE:
                    child.number = number
                    below += reversed(child.children)
                else:
                    kids.setdefault(child.label, []).append(child)
        todo += [(kid, depth + 1) for kid in reversed(kids.values())]
    story = "\n".join(headings) if headings else " ".join(str(t[1]) for t in texts)
    return Skeleton("\n".join(parts), layout_of(root), texts, xxhash.xxh64_intdigest(story) - (1 << 63))


def _tree(lines: str) -> tuple[list[str], list[list[int]]]:
    labels, children, path = [], [], []
    for number, line in enumerate(lines.split("\n")):
        depth, _, label = line.partition(" ")
        labels.append(label)
        children.append([])
        del path[int(depth) :]
        if path:
            children[path[-1]].append(number)
        path.append(number)
    return labels, children


def _heaviest(pairs: list[tuple[int, int, int]], width: int) -> list[int]:
    """Of (place, weight, pair) in order, the pairs of the heaviest subsequence whose places increase; places are below width."""
    tree: list[tuple[int, int]] = [(0, -1)] * (width + 1)  # a Fenwick tree of the best weight that ends at a place
    before, weight = [], []
    for k, (place, w, _) in enumerate(pairs):
        best, at = (0, -1), place
        while at:
            best = max(best, tree[at])
            at &= at - 1
        before.append(best[1])
        weight.append(best[0] + w)
        at = place + 1
        while at <= width:
            tree[at] = max(tree[at], (weight[k], k))
            at += at & -at
    out, k = [], max(range(len(pairs)), key=weight.__getitem__, default=-1)
    while k >= 0:
        out.append(pairs[k][2])
        k = before[k]
    return out[::-1]


def align(a: str, b: str) -> dict[int, int]:
    """Simple tree matching of two skeletons: which node of ``b`` each matched node of ``a`` goes with."""
    if a == b:
        return {k: k for k in range(a.count("\n") + 1)}
    la, ca = _tree(a)
    lb, cb = _tree(b)
    if la[0] != lb[0]:
        return {}
    met: list[tuple[int, int]] = [(0, 0)]  # pairs of equal labels below paired nodes, in preorder
    below: list[list[tuple[int, int, int]]] = []
    for x, y in met:
        place = {lb[q]: (j, q) for j, q in enumerate(cb[y])}
        kids = []
        for p in ca[x]:
            if la[p] in place:
                j, q = place[la[p]]
                kids.append((j, 0, len(met)))
                met.append((p, q))
        below.append(kids)
    weight, chosen = [1] * len(met), [[]] * len(met)
    for k in range(len(met) - 1, -1, -1):
        kept = _heaviest([(j, weight[m], m) for j, _, m in below[k]], len(cb[met[k][1]]))
        chosen[k] = kept
        weight[k] += sum(weight[m] for m in kept)
    found, todo = {}, [0]
    while todo:
        k = todo.pop()
        found[met[k][0]] = met[k][1]
        todo += chosen[k]
    return found


def content_node(lines: str, mass: dict[int, int]) -> int:
    """The node of the reference under which the content lies, by the characters that vary at each node; -1 if nothing varies."""
    labels, children = _tree(lines)
    tags = [x.partition(".")[0] for x in labels]
    whole, titled = [mass.get(k, 0) for k in range(len(labels))], [t == "h1" and mass.get(k, 0) > 0 for k, t in enumerate(tags)]
    for k in range(len(labels) - 1, -1, -1):  # children have higher numbers
        whole[k] += sum(whole[c] for c in children[k])
        titled[k] = titled[k] or any(titled[c] for c in children[k])
    now = 0
    while whole[0]:
        best = max(children[now], key=whole.__getitem__, default=None)
        if best is None or 3 * whole[best] < 2 * whole[now] or tags[best] in _TEXT_BLOCKS or any(titled[c] for c in children[now] if c != best):
            return now
        now = best
    return -1


# ---------------------------------------------------------------- extraction


@dataclass(frozen=True)
class Template:
    """A layout's reference skeleton, its content node and its constant texts (node, hash)."""

    lines: str
    content: int
    constant: frozenset[tuple[int, int]]


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") in ("main", "article")


def _has_article(root: Node) -> bool:
    todo: list[Node | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if _is_article(x):
            return True
        if not _left_out(x):
            todo += x.children
    return False


def main_text(root: Node, template: Template | None = None) -> str:
    """The text of the content slots, a block a line."""
    same = align(skeleton(root).lines, template.lines) if template else {}
    if template and template.content in same.values():
        constant = template.constant

        def opens(x: Node) -> bool:
            return same.get(x.number) == template.content

        def closed(x: Node) -> bool:
            return False

    else:
        constant, wanted = frozenset(), _has_article(root)

        def opens(x: Node) -> bool:
            return _is_article(x) or not wanted and x.tag == "#root"

        def closed(x: Node) -> bool:
            return not wanted and x.tag == "header"

    blocks: list[str] = []
    run: list[str] = []

    def end_block() -> None:
        if run:
            text = "".join(run)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                blocks.append(text)
            run.clear()

    todo: list[tuple[Node | str | None, bool, bool]] = [(root, False, False)]  # what, under content, in a template text
    while todo:
        x, inside, fixed = todo.pop()
        if x is None:
            end_block()
        elif isinstance(x, str):
            if inside and not fixed:
                run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not _left_out(x) and not closed(x):
            if x.tag not in INLINE:
                inside = inside or opens(x)
                fixed = bool(x.text) and (same.get(x.number), x.text) in constant
                end_block()
                todo.append((None, inside, fixed))
            todo += [(c, inside, fixed) for c in reversed(x.children)]
    end_block()
    return "\n".join(blocks)


# ---------------------------------------------------------------- Spark


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def _skeletons(pages: DataFrame) -> DataFrame:
    """(host, layout, story, lines, nodes, hashes, sizes) of pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "html"):
            made = [skeleton(parse(t.decode())) for t in common.texts_of(batch, "html")]
            lists = [pa.array([[x[k] for x in m.texts] for m in made], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.layout for m in made], pa.int64()), pa.array([m.story for m in made], pa.int64()), pa.array([m.lines for m in made], pa.string()), *lists], names=["host", "layout", "story", "lines", "nodes", "hashes", "sizes"])

    return pages.mapInArrow(run, "host string, layout long, story long, lines string, nodes array<int>, hashes array<long>, sizes array<int>")


def _matched(rows: DataFrame) -> DataFrame:
    """(layout_id, node, text, n, chars) summed by batch: on how many pages a text stands at a reference node, and its
    characters; text 0 counts the pages that have the node and the characters of all its texts. Rows have a skeleton's columns,
    ``reference`` and ``layout_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, chars = Counter(), Counter()
            for key, lines, nodes, hashes, sizes, reference in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                same = align(lines, reference)
                pages.update((key, y, 0) for y in same.values())
                here = set()
                for x, text, size in zip(nodes, hashes, sizes, strict=True):
                    if x in same:
                        y = same[x]
                        here.add((key, y, text))
                        chars[key, y, text] += size
                        chars[key, y, 0] += size
                pages.update(here)
            keys = list(pages)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([pages[k] for k in keys], pa.int64()), pa.array([chars[k] for k in keys], pa.int64())], names=["layout_id", "node", "text", "n", "chars"])

    return rows.mapInArrow(run, "layout_id long, node int, text long, n long, chars long")


def _with_content(templates: DataFrame) -> DataFrame:
    """``templates`` (host, layout, lines, nodes: (node, mass, texts)) as (t_host, t_layout, lines, content, at, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lines, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                constant = sorted((x["node"], t) for x in nodes for t in x["texts"])
                found.append((content_node(lines, {x["node"]: x["mass"] for x in nodes}), [c[0] for c in constant], [c[1] for c in constant]))
            made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["t_host", "t_layout", "lines", "content", "at", "texts"])

    return templates.mapInArrow(run, "t_host string, t_layout long, lines string, content int, at array<int>, texts array<long>")


def induce(pages: DataFrame, least_pages: int = LEAST_PAGES, constant: float = CONSTANT) -> DataFrame:
    """(t_host, t_layout, lines, content, at, texts), written: the template of every layout of every host."""
    since = common.mark()
    key = ["host", "layout"]
    rows = _skeletons(pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")))
    distinct = rows.groupBy(*key, "story").agg(F.min(F.struct("lines", "nodes", "hashes", "sizes")).alias("r"))  # copies are one page
    distinct = common.written(distinct.select(*key, "r.*"), "skeletons")
    shapes = distinct.groupBy(*key, "lines").agg(F.count("*").alias("n"))
    reference = shapes.groupBy(*key).agg(F.min_by("lines", F.struct(-F.col("n"), "lines")).alias("reference"), F.sum("n").alias("pages")).where(F.col("pages") >= least_pages)
    names = [F.col("host").alias("r_host"), F.col("layout").alias("r_layout")]
    reference = common.written_side(reference.select(*names, "reference", F.xxhash64("host", "layout").alias("layout_id")), "references")
    joined = distinct.join(reference, (F.col("host") == F.col("r_host")) & (F.col("layout") == F.col("r_layout"))).select("layout_id", "lines", "nodes", "hashes", "sizes", "reference")
    counts = _matched(joined).groupBy("layout_id", "node", "text").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    counts = common.written(counts.where((F.col("text") == 0) | (F.col("n") >= least_pages)), "node-texts")  # a template text stands on as many
    every = counts.where("text = 0").select(F.col("layout_id").alias("e_id"), F.col("node").alias("e_node"), F.col("n").alias("have"), F.col("chars").alias("total"))
    seen = counts.where("text <> 0").withColumnsRenamed({"layout_id": "s_id", "node": "s_node"})
    fixed = F.col("n") >= constant * F.col("have")
    nodes = every.join(seen, (F.col("e_id") == F.col("s_id")) & (F.col("e_node") == F.col("s_node")), "left").groupBy("e_id", "e_node").agg(
        (F.first("total") - F.sum(F.when(fixed, F.col("chars")).otherwise(0))).alias("mass"), F.collect_list(F.when(fixed, F.col("text"))).alias("texts")
    )
    nodes = nodes.groupBy("e_id").agg(F.collect_list(F.struct(F.col("e_node").alias("node"), "mass", "texts")).alias("nodes"))
    templates = nodes.join(reference, F.col("e_id") == F.col("layout_id")).select("r_host", "r_layout", F.col("reference").alias("lines"), "nodes")
    return common.written_last(_with_content(templates), "induced", since)


def _with_layout(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, host) and their layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "html"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([layout_of(parse(t.decode())) for t in common.texts_of(batch, "html")], pa.int64())], names=[*batch.schema.names, "layout"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("layout", LongType())]))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, constant: float = CONSTANT) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    common.small_batches(pages.sparkSession)
    templates = common.written_side(induce(pages, least_pages, constant), "templates")
    keyed = _with_layout(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host")))
    rows = keyed.join(templates, (F.col("host") == F.col("t_host")) & (F.col("layout") == F.col("t_layout")), "left").select("page_id", "url", "html", "lines", "content", "at", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "html"):
            texts = []
            for page, lines, content, at, fixed in zip(common.texts_of(batch, "html"), *(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                template = None if lines is None else Template(lines, content, frozenset(zip(at, fixed, strict=True)))
                texts.append(main_text(parse(page.decode()), template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    types = pages.schema
    return rows.mapInArrow(run, f"page_id {types['page_id'].dataType.simpleString()}, url string, text string")
