"""Main text of web pages by consensus paths of a host.

1. Each page's sectioning containers are scored: a block of text adds the length of what is no link to its container, and half
   of it to the container above. The best one, or what encloses it and adds text, is the page's vote: its path of generalised tags and classes, without boilerplate.
2. Spark counts votes per host and path; the path with most votes (then most text) wins. One small row per page is shuffled,
   combined on the map side, so a hot host is no hot group.
3. Every page is extracted again from the containers on its host's winning path, or from its own best one if it has none.

Parts whose tag, or a whole name in class, id or role of a container, says menu, header, footer, sidebar, notice, advert, form or
comments are left out, unless they hold most of the page's text. A block's
white space becomes single blanks; a line break tag is white space. Blocks are joined by newlines, none is dropped or cut.
Null html, and pages without text, give an empty text. A null url belongs to the host "".
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import add_from_text, written
from panelwise.llm.urlrules import host_and_path

# Tags of HTML by their part in a page, and words of class names that mark boilerplate.
SKIPPED = {
    "script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes", "svg", "template", "select", "button", "canvas", "object", "video", "audio", "map",
}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "dialog", "menu"}
BLOCKS = {
    "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
    "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "center", "hgroup", "search", *DROPPED,
}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PLAIN = {"html", "body", "main", "article"}
NOISE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer foot copyright comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login form search share sharing social related recommended widget toolbar pagination pager skip toc".split()
)
#: Tags whose names may mark boilerplate, further parts of such names, and first parts that tell of something else.
NOISY_TAGS = {"div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "td", "th", "figure", "center", "details", "fieldset", "address"}
REGIONS = set(
    "site page main post posts article articles content top bottom left right global primary secondary block box bar area wrap wrapper container inner outer section panel "
    "list item items link links button buttons text title message form info region module row col column group slot unit space google right rail media by print and the me us x".split()
)
NEGATIONS = {"has", "no", "not", "without", "with", "hide", "non"}
#: A part with more than this share of a page's text is its content, whatever its name. Comments are often longer than half.
MOST = 0.8
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSED_WITHIN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

# A quote opens a value only after `=`; any other belongs to a name or to an unquoted value, which ends at white space or `>`.
VALUE = r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*+"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:" + VALUE + r")?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*=\s*(" + VALUE + r")?)?", re.S)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    tag: str
    path: str  # hash of the tags and classes of all containers down to it
    above: int
    container: int  # the nearest container, itself included; 0 if there is none
    by_tag: bool = False  # a part that its tag drops
    named: bool = False  # a part whose names mark boilerplate
    dropped: bool = False
    raw: int = 0  # characters of its own text as it stands, white space between tags left out
    score: float = 0.0
    text: int = 0  # characters of its own blocks
    headings: int = 0  # of these, characters of headings
    free: int = 0  # characters outside links


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text), in page order


def attributes_of(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of equal names."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:].removesuffix(value[0])
        out.setdefault(m[1].lower(), value)
    return out


def noisy(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a container's names mark boilerplate: a name that is such a word, or a name of several parts that are all such
    words or name a part of the page. Names of what a part has or has not (has-sidebar, no-comments) say nothing of itself."""
    if tag not in NOISY_TAGS:
        return False
    for key in ("class", "id", "role"):
        if key == "id" and tag == "section":
            continue  # generated from the section's heading
        for name in attributes.get(key, "").split():
            parts = [w.lower() for w in PARTS.findall(name)]
            if parts and parts[0] not in NEGATIONS and any(w in NOISE for w in parts) and all(w in NOISE or w in REGIONS for w in parts):
                return True
    return False


def generalised(tag: str, attributes: dict[str, str]) -> str:
    """A tag with its classes in order, numbers in them made equal."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "0", c) for c in attributes.get("class", "").split()})])


def parse(source: str) -> Page:
    """Nodes and blocks of a page, in one pass over the source; its time does not depend on how deep the page is nested."""
    page = Page([Node("", "", -1, 0)])
    nodes = page.nodes
    found: list[tuple[int, str, int]] = []  # (node, text, characters in links) of all blocks
    stack, at, pieces, linked, in_link = [0], 0, [], 0, 0
    open_tags: Counter[str] = Counter()
    size = len(source)

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            found.append((stack[-1], text, linked))
        linked = 0

    def leave(depth: int) -> None:
        for k in stack[depth:]:
            open_tags[nodes[k].tag] -= 1
        del stack[depth:]

    while at < size:
        m = TOKEN.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            if not text.isspace():
                nodes[stack[-1]].raw += len(text)
            text = entities.unescape(text)
            pieces.append(text)
            linked += len(text) if in_link else 0
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            elif open_tags[tag]:
                open_at = next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag)
                close_block()
                leave(open_at)
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            else:
                pieces.append(" ")
            continue
        if tag == "a":
            in_link = 1
        if tag in SKIPPED and not m[3].endswith("/"):
            end = re.compile(f"</{tag}", re.I).search(source, at)
            at = end.start() if end else size
        if tag not in BLOCKS:
            continue
        close_block()
        if nodes[stack[-1]].tag == "p" or nodes[stack[-1]].tag in HEADINGS and tag in HEADINGS:
            leave(len(stack) - 1)
        if tag in CLOSES and any(open_tags[c] for c in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]].tag
                if own in CLOSED_WITHIN[tag]:
                    break
                if own in CLOSES[tag]:
                    leave(k)
                    break
        above, own = nodes[stack[-1]], len(nodes)
        attributes = attributes_of(m[3]) if tag in CONTAINERS or tag in NOISY_TAGS else {}
        path = above.path
        if tag in CONTAINERS:
            path = hashlib.blake2b((path + "/" + generalised(tag, attributes)).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        nodes.append(Node(tag, path, stack[-1], own if tag in CONTAINERS else above.container, tag in DROPPED, tag not in PLAIN and noisy(tag, attributes)))
        stack.append(own)
        open_tags[tag] += 1
        in_link = 0
    close_block()
    return scored(page, found)


def scored(page: Page, found: list[tuple[int, str, int]]) -> Page:
    """Decide top-down which parts are dropped, and give the blocks that stay to their containers."""
    nodes = page.nodes
    raw = [n.raw for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        raw[nodes[i].above] += raw[i]
    for i, n in enumerate(nodes):
        # A part that holds most of the page's text is its content, whatever its name.
        n.dropped = i > 0 and (nodes[n.above].dropped or n.by_tag or n.named and raw[i] <= MOST * raw[0])
    for node, text, linked in found:
        if nodes[node].dropped:
            continue
        page.blocks.append((node, text))
        weight = max(0, len(text) - linked)
        own = nodes[node].container
        into = nodes[own]
        into.text += len(text)
        into.headings += len(text) * (nodes[node].tag in HEADINGS)
        into.free += weight
        into.score += weight
        if own:
            nodes[nodes[into.above].container].score += weight / 2
    return page


def best(page: Page) -> int:
    """The container of the highest score (the first of equals), or the article around it, or what adds text outside links to it.

    Wrappers that add nothing are looked past. To an article only headings are added.
    """
    node = max(range(len(page.nodes)), key=lambda i: (page.nodes[i].score if page.nodes[i].tag in CONTAINERS or not i else -1, -i))
    up = node
    while up > 0 and page.nodes[up].tag != "article":
        up = page.nodes[up].above
    node = up if up > 0 else node
    ends = subtree_ends(page)
    # Sums of text, text outside links and headings over the nodes before each one.
    before = [(0, 0, 0)]
    for n in page.nodes:
        a, b, c = before[-1]
        before.append((a + n.text, b + n.free, c + n.headings))

    def below(i: int) -> tuple[int, ...]:
        return tuple(x - y for x, y in zip(before[ends[i]], before[i], strict=True))

    up = page.nodes[node].above
    while up > 0 and page.nodes[up].tag not in ("body", "html"):
        if page.nodes[up].tag in CONTAINERS:
            text, free, headings = (x - y for x, y in zip(below(up), below(node), strict=True))
            if text and (2 * free <= text or page.nodes[node].tag == "article" and headings < text):
                break
            node = up if text else node
        up = page.nodes[up].above
    return node


def subtree_ends(page: Page) -> list[int]:
    """For each node the number after its last descendant; nodes are numbered as they open, so a subtree is a range."""
    ends = list(range(1, len(page.nodes) + 1))
    for i in range(len(page.nodes) - 1, 0, -1):
        above = page.nodes[i].above
        ends[above] = max(ends[above], ends[i])
    return ends


def text_of(page: Page, path: str | None) -> str:
    """Blocks inside the containers on a path; of the page's own best container if there is none."""
    roots = {i for i, n in enumerate(page.nodes) if n.path == path and not n.dropped and (n.tag in CONTAINERS or not i)} if path is not None else set()
    blocks = within(page, roots)
    return "\n".join(blocks or within(page, {best(page)}))


def within(page: Page, roots: set[int]) -> list[str]:
    known: dict[int, bool] = {}

    def belongs(node: int) -> bool:
        trail = []
        while node >= 0 and node not in known and node not in roots:
            trail.append(node)
            node = page.nodes[node].above
        found = node >= 0 and (node in roots or known.get(node, False))
        known.update(dict.fromkeys(trail, found))
        return found

    return [text for node, text in page.blocks if belongs(node)]


def votes(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host."""

    def vote(batch: pa.RecordBatch) -> list[pa.Array]:
        paths, weights = [], []
        for source in batch.column("html").to_pylist():
            page = parse(source or "")
            node = page.nodes[best(page)]
            paths.append(node.path if node.score > 0 else None)
            weights.append(float(node.score))
        return [pa.array(paths, pa.string()), pa.array(weights, pa.float64())]

    cast = add_from_text(pages.select("host", "html"), "path string, weight double", vote).drop("html").where(F.col("path").isNotNull())
    counted = cast.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return counted.groupBy("host").agg(F.max(F.struct("n", "weight", "path")).alias("top")).select("host", F.col("top.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    The winners, one row a host, are written first, so Spark knows their size: small ones are broadcast and no html is
    shuffled; beyond its limit the join is by shuffle, and the rows of a host with very many pages are split at run time.
    """
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    winners = written(votes(rows).select(F.col("host").alias("winner_host"), "path"), "mainpath-winners")
    joined = rows.join(winners, F.col("host") == F.col("winner_host"), "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(parse(h or ""), p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
