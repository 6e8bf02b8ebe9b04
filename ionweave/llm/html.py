"""Main text of web pages by site template removal.

Every element's subtree is hashed (name, class, text and its children's hashes). Spark counts, per host, on how many
pages each subtree occurs; subtrees on many pages of a host are its template and are deleted. Of what stays, elements
named or marked as menus, headers, footers, sidebars, notices, adverts, forms or comments go too; the rest is the
article. Only where a page has nothing of a template (a host of few pages) its ``article`` or ``main`` elements, if any,
show where the article is. Paragraphs and headings inside them are its own words and are kept even where other pages repeat them.

Defined cases: null or empty html gives an empty text; a null url has the host ''; unclosed and stray tags are mended as
browsers do for these elements; a truncated page ends where it ends; repeated rows and page_ids are rows of their own;
``br`` counts as a space; a page that is template as a whole (copies of one page without an ``article``) is read without
templates. A subtree is a host's template from ``MIN_PAGES`` pages and ``SHARE`` of the host's pages on. A host has at most
(subtrees a page / SHARE) of them: the table is sent to the tasks when its checked size is under ``BROADCAST_ROWS``, and
joined by host otherwise, with the same result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import materialize
from ionweave.llm.urls import host_and_path

SHARE, MIN_PAGES, BROADCAST_ROWS = 0.08, 4, 300_000
# Names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
DROPPED = frozenset("script style noscript template iframe head title nav footer aside form button select textarea svg object dialog menu canvas option".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main body html".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
MARKS = frozenset("ad ads advert advertisement advertising sponsor sponsored promo banner cookie cookies consent notice popup modal overlay sidebar comment comments discussion disqus replies menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related newsletter subscribe skip".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "marks", "children", "parent", "inside")

    def __init__(self, name: str, marks: str, parent):
        self.name, self.marks, self.parent, self.children = name, marks, parent, []
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main") or "role=main" in parent.marks)


def parse(page: str) -> Node:
    root = node = Node("#root", "", None)
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, attrs = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            up = node
            while up is not None and up.name != name:
                # An inline end tag doesn't reach beyond its block; a block's end tag closes what is open inside it.
                up = None if name in INLINE and up.name not in INLINE else up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if name in CLOSES_P:
            up = node
            while up.name in INLINE:
                up = up.parent
            if up.name == "p":
                node = up.parent
        if name in SELF_CLOSING:
            up = node
            while up.parent is not None and up.name != name and up.name not in SELF_CLOSING[name]:
                up = up.parent
            if up.name == name:
                node = up.parent
        marks = " ".join(f"{a[0].lower()}={(a[1] or a[2] or a[3]).lower()}" for a in ATTR.findall(attrs)) if attrs else ""
        new = Node(name, marks, node)
        node.children.append(new)
        if name in RAW:
            m = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            new.children.append(page[at : m.start()] if m else page[at:])
            at = m.end() if m else n
        elif name not in VOID and not (attrs and attrs.endswith("/") and name == "svg"):
            node = new
    return root


def unwanted(node: Node) -> bool:
    if node.name in DROPPED or node.name == "header" and not node.inside:
        return True
    return bool(node.marks) and node.name not in ("html", "body", "article", "main") and not MARKS.isdisjoint(re.split(r"[\s_=-]+", node.marks))


def subtree_hashes(root: Node) -> dict[Node, int]:
    """Hash of each element that holds any text, bottom up without recursion."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    out: dict[Node, int] = {}
    for node in reversed(order):
        parts = [node.name, node.marks]
        for c in node.children:
            if isinstance(c, str):
                if t := SPACES.sub(" ", c).strip():
                    parts.append("t" + t)
            elif c in out:
                parts.append(f"e{out[c]}")
        if len(parts) > 2:
            out[node] = xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)
    return out


def candidates(root: Node, hashes: dict[Node, int]) -> set[int]:
    """Hashes of the elements that may belong to a template: not the article's own paragraphs and what holds them."""
    return {h for node, h in hashes.items() if node.parent is not None and may_be_template(node)}


def may_be_template(node: Node) -> bool:
    if node.name in ("#root", "html", "body", "article", "main"):
        return False
    if not node.inside:
        return True
    return node.name not in PROSE and node.name not in INLINE and not any(isinstance(c, Node) and c.name in PROSE for c in node.children)


def deleted(root: Node, template: frozenset[int] | set[int]) -> set[Node]:
    """The elements that the template has, without those inside them."""
    if not template:
        return set()
    hashes, out, stack = subtree_hashes(root), set(), [root]
    while stack:
        node = stack.pop()
        if hashes.get(node) in template and may_be_template(node):
            out.add(node)
        else:
            stack += [c for c in node.children if isinstance(c, Node)]
    return out


def main_text(root: Node, template: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """Blocks of what isn't dropped, one a line, and how many subtrees the template took."""
    lost = deleted(root, template)
    if lost and (text := blocks_of([root], lost)):
        return text, len(lost)
    regions, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.name in ("article", "main") or "role=main" in node.marks:
            regions.append(node)
        elif not unwanted(node):
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return blocks_of(regions or [root], set()), 0


def blocks_of(regions: list[Node], lost: set[Node]) -> str:
    gone = lambda node: node in lost or unwanted(node)
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if t := SPACES.sub(" ", entities.unescape("".join(line))).strip():
            blocks.append(t)
        line.clear()

    for region in regions or [root]:
        # None ends a block.
        work: list = [None, region]
        first = True
        while work:
            x = work.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif x.name == "br":
                line.append(" ")
            elif first or not gone(x):
                first = False
                if x.name not in INLINE:
                    end()
                    work.append(None)
                work += reversed(x.children)
        end()
    return "\n".join(blocks)


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, hash, n): subtrees on at least SHARE of a host's pages. Sums are made in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = parse(page.as_py() or "")
                sums[host, None] += 1
                sums.update((host, h) for h in candidates(root, subtree_hashes(root)))
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sums[k] for k in keys], pa.int64())], names=["host", "hash", "n"])

    # Written once, as two things are read of it: pages by host, and subtrees that are on several of them. Most are on one page only.
    sums = materialize(pages.select("host", "html").mapInArrow(count, "host string, hash long, n long").groupBy("host", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAGES), "subtrees")
    often = sums.where(F.col("hash").isNull()).select("host", F.col("n").alias("pages"))
    return sums.where(F.col("hash").isNotNull()).join(often, "host").where(F.col("n") >= F.col("pages") * SHARE).select("host", "hash", "n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the number of subtrees that the host's template took, of each row of ``pages`` (page_id, url, html)."""
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    base = base.withColumn("host", F.coalesce(host_and_path(F.col("url"))[0], F.lit("")))
    templates = materialize(site_templates(base), "templates")
    small = templates.count() <= BROADCAST_ROWS
    known: dict[str, set[int]] = {}
    if small:
        for r in templates.collect():
            known.setdefault(r.host, set()).add(r.hash)
        rows = base.withColumn("hashes", F.lit(None).cast("array<long>"))
    else:
        rows = base.join(templates.groupBy("host").agg(F.collect_set("hash").alias("hashes")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, host, hashes in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                template = known.get(host, ()) if small else hashes.as_py() or ()
                found.append(main_text(parse(page.as_py() or ""), frozenset(template)))
            texts = [t for t, _ in found]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_template"])

    return rows.select("page_id", "url", "html", "host", "hashes").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")
