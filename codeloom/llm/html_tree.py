"""Main text of web pages by a site style tree.

The elements of a host's pages are merged into one tree: a node is a chain of styled
elements (tag and classes), its leaves are runs of text. A node counts the pages that
have it, the presentations (sequences of children) it has on them, and on how many of
them each text of a leaf occurs. Importance goes from the leaves up:

- a leaf with m pages: 1 less the mean over its texts of log(pages with it) / log(m), so 0
  where every page says the same and 1 where no text occurs twice;
- a branch: its presentation entropy to base m and the importance of its children, which
  weigh by their characters. Of l presentations, GAMMA ** (l - 1) is the children's share.

Branches of low importance are taken out of each page with all that is below them; the
branch that holds most of what a page says for itself is never taken out. What markup
declares comes first: menus, footers, forms and the like are no article by what they are,
and where a page has article or main elements, they are its article.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import bounded_join, materialize
from codeloom.llm.url_reputation import url_host

# Elements of the HTML standard by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never the article.
SERVICE = frozenset("head nav footer aside form menu dialog button select option datalist script style noscript template iframe svg math object textarea title xmp".split())
#: Elements that a start tag of the same group closes.
CLOSES = {
    "p": frozenset("p".split()), "li": frozenset("li p".split()), "dt": frozenset("dt dd p".split()), "dd": frozenset("dt dd p".split()),
    "tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()), "th": frozenset("td th p".split()), "option": frozenset(["option"]),
}
#: Block elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Roles and names of areas that are not the article. A class or id names an area by its
#: last part ("site-footer" but not "has-sidebar", "tags-news" or "with-comments").
SERVICE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "header masthead menu nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted recommended related replies "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets modal complementary contentinfo "
    "alert disclaimer paywall gdpr login teaser outbrain taboola feedback reply".split()
)
#: First parts of names that tell a state and not an area.
STATES = frozenset("has with no is not without show hide hidden".split())
ROOTS = ("article", "main")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPLIT_WORDS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Levels of the tree; deeper elements count as the one at this depth.
DEPTH = 64
#: Share of the children in a branch's importance, to the power of its presentations less one.
GAMMA = 0.9
#: Declared by a name only, and by an element, a role or being hidden.
NAMED, DECLARED = 1, 2
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A leaf of text: its place in the style tree and its words."""

    path: str
    text: str
    service: int  # NAMED, DECLARED or 0
    root: int  # number of the article or main element around it, -1 outside


@dataclass
class _Open:
    tag: str
    path: str
    service: int
    root: int
    depth: int = 0
    children: list[str] = field(default_factory=list)  # styles, runs of equal ones once

    def child(self, style: str) -> None:
        if not self.children or self.children[-1] != style:
            self.children.append(style)


def _names_area(value: str) -> bool:
    for token in value.split():
        parts = [w.lower() for w in SPLIT_WORDS.split(token) if w]
        if parts and parts[-1] in SERVICE_WORDS and parts[0] not in STATES:
            return True
    return False


def _style(tag: str, attributes: str) -> tuple[str, int]:
    """Tag with its classes, and whether it declares an area that is not the article."""
    service, style = DECLARED * (tag in SERVICE), tag
    if "=" not in attributes and "hidden" not in attributes:
        return style, service
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            style = f"{tag}.{'.'.join(sorted(value.split()))}".replace("/", "|")
        if name in ("class", "id") and tag not in ("html", "body"):
            service = max(service, NAMED * _names_area(value))
        elif name == "role" and value.lower() in SERVICE_WORDS:
            service = DECLARED
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            service = DECLARED
    return style, service


@dataclass
class _Parser:
    stack: list[_Open] = field(default_factory=lambda: [_Open("", "", 0, -1)])
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    roots: int = 0
    inline: list[str] = field(default_factory=list)
    hide: int = 0  # open inline service elements
    styles: dict[str, set[str]] = field(default_factory=dict)  # presentations of each node

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", htmllib.unescape("".join(self.parts))).strip()
            if text:
                top = self.stack[-1]
                top.child("#")
                self.blocks.append(Block(top.path + "/#", text, top.service, top.root))
            self.parts = []

    def add(self, text: str) -> None:
        if not self.hide:
            self.parts.append(text)

    def close(self, at: int) -> None:
        """Close the open elements from place ``at`` on."""
        for node in self.stack[at:]:
            if node.path:
                self.styles.setdefault(node.path, set()).add("/".join(node.children))
        del self.stack[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.add(" ")
            return
        if tag in INLINE:
            service = bool(_style(tag, attributes)[1]) if attributes else False
            self.inline.append(tag + "!" * service)
            self.hide += service
            return
        self.flush()
        if tag in VOID:
            return
        shut = CLOSES.get(tag) or (frozenset("p") if tag in ENDS_P else frozenset())
        if shut:
            self.close_group(shut)
        top = self.stack[-1]
        style, service = _style(tag, attributes)
        service = max(service, top.service)
        # A header of the page is a service area; the header of an article holds its title.
        if tag == "header" and top.root < 0:
            service = DECLARED
        root = top.root
        if tag in ROOTS and (root < 0 or tag == "article"):
            if service == NAMED and not self.roots:
                service = 0  # a name does not hide the first article of a page
            if not service:
                root, self.roots = self.roots, self.roots + 1
        top.child(style)
        deep = top.depth >= DEPTH
        self.stack.append(_Open(tag, top.path if deep else f"{top.path}/{style}", service, root, top.depth + 1))

    def close_group(self, shut: frozenset) -> None:
        """Close open elements of ``shut`` above the nearest list, table or other container."""
        at = len(self.stack) - 1
        while at > 0 and self.stack[at].tag in shut:
            at -= 1
        self.close(at + 1)

    def end(self, tag: str) -> None:
        if tag in INLINE:
            for i in range(len(self.inline) - 1, -1, -1):
                if self.inline[i].rstrip("!") == tag:
                    self.hide -= self.inline.pop(i).endswith("!")
                    break
            return
        if tag == "br" or tag in VOID:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.flush()
                self.close(i)
                self.inline, self.hide = [], 0
                return
        if tag == "p":
            self.flush()


def parse_page(html: str | None) -> tuple[list[Block], dict[str, set[str]]]:
    """Blocks of text of a page in page order, scripts and comments left out, and the presentations of its elements."""
    p, at = _Parser(), 0
    if not html:
        return [], {}
    while m := TOKEN.search(html, at):
        if m.start() > at:
            p.add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            p.end(tag)
        elif tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            if tag not in INLINE:
                p.flush()
        else:
            p.start(tag, m[3])
    p.add(html[at:])
    p.flush()
    p.close(0)
    return p.blocks, p.styles


def parse_blocks(html: str | None) -> list[Block]:
    return parse_page(html)[0]


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


_NODES = "host string, path string, is_text boolean, content long, pages long, chars long"


def node_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the merged trees of every batch: pages and characters of each presentation, pages of each text."""
    for batch in batches:
        pages: dict[tuple, int] = {}
        chars: dict[tuple, int] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks, styles = parse_page(page)
            keys = {(host, path, False, _digest("\n".join(sorted(of)))) for path, of in styles.items()}
            for b in blocks:
                leaf = (host, b.path, False, 0)
                chars[leaf] = chars.get(leaf, 0) + len(b.text)
                keys.add(leaf)
                keys.add((host, b.path, True, _digest(b.text)))
            for key in keys:
                pages[key] = pages.get(key, 0) + 1
        keys = list(pages)
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
        columns += [pa.array([pages[k] for k in keys], pa.int64()), pa.array([chars.get(k, 0) for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "is_text", "content", "pages", "chars"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n, mass, presentation, importance) of each node of each host's style tree.

    ``n`` pages have the node and ``mass`` characters are below it. Levels of the tree are
    composed from the deepest one up, one job a level and at most DEPTH + 1 of them; no
    tree is gathered in one task.
    """
    kept = pages.select(url_host(F.col("url")).alias("host"), "html")
    seen = kept.mapInArrow(node_statistics, _NODES).groupBy("host", "path", "is_text", "content").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    node, text, n = ~F.col("is_text"), F.col("is_text"), F.col("pages")
    nodes = seen.groupBy("host", "path").agg(
        F.sum(F.when(node, n)).alias("n"), F.count_if(node).alias("styles"), F.sum(F.when(node, n * F.log(n))).alias("nlogn"), F.sum(F.when(node, F.col("chars"))).alias("chars"),
        F.count_if(text).alias("texts"), F.sum(F.when(text, F.log(n))).alias("logs"),
    )
    m = F.col("n").cast("double")
    leaf = F.when(F.col("n") < 2, 1.0).otherwise(1 - F.col("logs") / (F.col("texts") * F.log(m)))
    presentation = F.when(F.col("n") < 2, 1.0).otherwise((F.log(m) - F.col("nlogn") / m) / F.log(m))
    nodes = nodes.select(
        "host", "path", F.substring_index("path", "/", -1).alias("_name"), (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).alias("level"),
        "n", "styles", "chars", presentation.alias("presentation"), F.when(F.col("texts") > 0, leaf).alias("leaf"),
    )
    nodes = materialize(nodes.withColumn("parent", F.expr("left(path, length(path) - length(_name) - 1)")).drop("_name"), "nodes")
    out, below = None, None
    for level in range(nodes.agg(F.max("level")).first()[0] or 0, 0, -1):
        own = nodes.filter(F.col("level") == level)
        if below is None:
            own = own.withColumn("_kids", F.lit(None).cast("double")).withColumn("_kid_mass", F.lit(0).cast("long"))
        else:
            kids = below.groupBy(F.col("host").alias("_host"), F.col("parent").alias("_of")).agg(
                (F.sum(F.col("mass") * F.col("importance")) / F.sum("mass")).alias("_kids"), F.sum("mass").alias("_kid_mass")
            )
            own = own.join(kids, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_of")), "left")
        share = F.pow(F.lit(GAMMA), F.col("styles") - 1)
        branch = (1 - share) * F.col("presentation") + share * F.coalesce("_kids", "presentation")
        below = own.select("host", "path", "parent", "n", (F.col("chars") + F.coalesce("_kid_mass", F.lit(0))).alias("mass"), "presentation", F.coalesce("leaf", branch).alias("importance"))
        below = materialize(below, "level")
        out = below if out is None else out.unionByName(below)
    if out is None:
        return nodes.select("host", "path", "n", F.col("chars").alias("mass"), "presentation", F.lit(1.0).alias("importance"))
    return out.select("host", "path", "n", "mass", "presentation", "importance")


def _branches(path: str) -> Iterator[str]:
    """``path`` and the paths above it."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def choose_text(blocks: list[Block], weak: dict[str, float], least: float) -> str:
    """The article among ``blocks``: declared areas and ``weak`` branches (path to importance) of the site are left out.

    What the page itself says most of, characters weighed by importance, is its main
    branch: neither it nor anything around it is taken out. If even that is weak, all that
    the site says is alike and nothing is told apart.
    """
    rooted = any(b.root >= 0 for b in blocks)
    kept = [b for b in blocks if not b.service and (b.root >= 0 or not rooted)]
    if not kept and not rooted:  # names do not hide all of a page
        kept = [b for b in blocks if b.service < DECLARED]
    weak = {p: w for p, w in weak.items() if w < least}
    if weak and kept:
        said: dict[str, float] = {}
        for b in kept:
            said[b.path] = said.get(b.path, 0.0) + len(b.text) * (weak.get(b.path, 1.0) + 0.05)
        main = max(said, key=lambda p: (said[p], p))
        if main not in weak:
            safe = set(_branches(main))
            gone = {p for p in said if any(a in weak and a not in safe for a in _branches(p))}
            kept = [b for b in kept if b.path not in gone]
    return "\n\n".join(b.text for b in kept)


def extract_main_text(pages: DataFrame, least_importance: float = 0.2, least_pages: int = 5) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Defined results: null or empty html gives empty text; a null url belongs to the
    host of empty name; repeated rows each get their row and count as pages of the host;
    very long pages are parsed whole; extra columns are ignored; an empty table gives no
    rows. Only branches seen on ``least_pages`` pages of a host can be unimportant.
    """
    weak = style_tree(pages).filter((F.col("n") >= least_pages) & (F.col("importance") < least_importance))
    weak = materialize(weak.select("host", "path", "importance"), "style-tree")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    # One row for each host with unimportant nodes; broadcast if all their nodes are few.
    trees = weak.groupBy(F.col("host").alias("_host")).agg(F.map_from_entries(F.collect_set(F.struct("path", "importance"))).alias("_tree"))
    own = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    joined = bounded_join(own, trees, F.col("host") == F.col("_host"), "left", weak.count()).select("page_id", "url", "html", "_tree")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [dict(t) if t else {} for t in batch.column(3).to_pylist()]
            texts = [choose_text(parse_blocks(h), t, least_importance) for h, t in zip(batch.column(2).to_pylist(), trees)]
            n = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
