"""Main text of web pages by removal of site templates.

Every page is parsed into a tree, each element's subtree gets a hash of its tags, classes and text, Spark counts per host on
how many pages a subtree occurs, and subtrees that recur on many pages of a host are deleted. What stands in the
content element (article or main) as running text is the page's own and stays, however often it is published; boxes and
link lists in it go if they recur, unless that is most of it, as in copies of one article. Without such an element the
whole body is the content. Elements that are never main text (menus, forms, scripts and the like) go by their tag or role, and reader
comments and adverts, which differ from page to page, by a whole class name, unless they hold most of the content.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.shared import cut

#: A template subtree is on at least MIN_PAGES pages of its host and on this share of them; so a host has at most (subtrees of a page) / MIN_SHARE templates.
MIN_PAGES, MIN_SHARE = 4, 0.05
#: Templates up to this number (16 bytes each) are broadcast; more are joined to the pages by host.
BROADCAST_TEMPLATES = 1_000_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
#: What ends the search for an element that a start tag closes.
SCOPE = frozenset("article aside body div form html main nav section table ul ol dl td th footer header blockquote".split())
# What is not main text.
NEVER = frozenset("aside button canvas dialog embed footer form head iframe input map menu nav noembed noframes noscript object option script select style svg template textarea title video audio".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset("ad ads advert advertisement advertising comment-list comments cookie-banner disqus_thread reader-comments sponsored".split())
#: Boxes that may be templates inside a content element.
BOXES = frozenset("details div dl figure ol section span table ul".split())
#: Also outside a content element.
OUTSIDE = frozenset(["header"])

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|![^>]*>|\?[^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)""", re.S)
#: One attribute after another, name and value, so that nothing is found inside a value.
ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
READ = frozenset("class hidden id role".split())


class Node:
    __slots__ = ("attrs", "children", "hash", "links", "parent", "size", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.size = self.links = 0  # characters of text, and of text in links

    def close(self) -> None:
        h = xxhash.xxh3_64(f"<{self.tag} {self.attrs.get('class', '')}>")
        for c in self.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                h.update(text)
                self.size += len(text)
            else:
                h.update(c.hash.to_bytes(8, "little"))
                self.size += c.size
                self.links += c.links
        if self.tag == "a":
            self.links = self.size
        self.hash = h.intdigest()


def attributes(raw: str) -> dict:
    """The attributes that are read, by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    if "=" in raw or "hidden" in raw.lower():
        for m in ATTR.finditer(raw):
            name = m[1].lower()
            if name in READ:
                out.setdefault(name, unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(html: str) -> Node:
    """The tree of a page; text stays undecoded until it is shown."""
    root = Node("#root", {}, None)
    stack, at, low = [root], 0, None

    def pop(n: int) -> None:
        while len(stack) > n:
            stack.pop().close()

    while True:
        m = TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if stack[i].tag in ("article", "body", "main") and tag not in BLOCK:
                    break
            continue
        for i in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                pop(i)
                break
            if stack[i].tag in SCOPE:
                break
        raw = m[3] if m[2] else m[6]
        node = Node(tag, attributes(raw or ""), stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            low = html.lower() if low is None else low
            end = low.find(f"</{tag}", at) if len(low) == len(html) else html.find(f"</{tag}", at)
            if end < 0:
                end = len(html)
            node.children.append(html[at:end])
            at = html.find(">", end) + 1 or len(html)
            node.close()
        elif tag in VOID or (raw or "").endswith("/") and tag not in BLOCK:
            node.close()
        else:
            stack.append(node)
    pop(0)
    return root


def never(node: Node, inside: bool, most: float = float("inf")) -> bool:
    """Whether an element is no main text by its tag, role, class or id; ``inside`` a content element or not; with over ``most`` characters of text not by its class or id."""
    if node.tag in NEVER or node.tag in OUTSIDE and not inside or "hidden" in node.attrs:
        return True
    if node.tag in ("html", "body", "main", "#root") or not node.attrs:
        return False
    if node.attrs.get("role", "").lower() in ROLES:
        return True
    return node.size <= most and not MARKS.isdisjoint(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split())


def is_content(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role", "").lower() == "main"


def roots(tree: Node) -> list[Node]:
    """The outermost content elements that stand in no other kind of element, else the whole tree."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if is_content(node) and not never(node, True):
            out.append(node)
        elif not never(node, False) or node.tag in ("#root", "html", "body"):
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    mains = [n for n in out if n.tag != "article"]
    return mains or out or [tree]


def is_box(node: Node) -> bool:
    """Whether a subtree inside a content element may be a template: mostly links, or a box."""
    return 2 * node.links > node.size or node.tag in BOXES


def suspects(tree: Node) -> set[int]:
    """Hashes of the subtrees that may be templates: outside the content element any with text, inside it boxes and what is mostly links."""
    out, content = set(), {id(r) for r in roots(tree) if r is not tree}
    todo = [(tree, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or id(node) in content
        if node.tag in NEVER:
            continue
        if node.size and node.tag not in ("#root", "html", "body") and id(node) not in content and (not inside or is_box(node)):
            out.add(node.hash)
        todo.extend((c, inside) for c in node.children if isinstance(c, Node))
    return out


def recurring(root: Node, templates: frozenset[int] | set[int]) -> int:
    """Characters of a content element in boxes that are templates and not mostly links."""
    found, todo = 0, [c for c in root.children if isinstance(c, Node)]
    while todo:
        node = todo.pop()
        if node.hash in templates and node.tag in BOXES and 2 * node.links <= node.size:
            found += node.size
        else:
            todo.extend(c for c in node.children if isinstance(c, Node))
    return found


def main_text(tree: Node, templates: frozenset[int] | set[int]) -> str:
    """The blocks of the content, without templates and what is never main text."""
    blocks, line = [], []

    def flush():
        text = " ".join(unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    for root in roots(tree):
        inside, most = root is not tree, root.size / 2
        boxes = not inside or recurring(root, templates) <= most

        def goes(x: Node, root=root, inside=inside, most=most, boxes=boxes) -> bool:
            return x is not root and (never(x, inside, most) or x.hash in templates and (not inside or 2 * x.links > x.size or boxes and x.tag in BOXES))

        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif goes(x):
                if x.tag in BLOCK:
                    flush()
            elif x.tag == "br":
                line.append(" ")
            elif x.tag not in VOID or x.tag in BLOCK:
                block = x.tag in BLOCK
                if block:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return "\n".join(blocks)


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _columns(batch, *names):
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def count_subtrees(pages: DataFrame) -> DataFrame:
    """``host, hash, pages``: on how many pages of a host each suspect subtree occurs; hash 0 counts all pages."""

    def run(batches):
        for batch in batches:
            hosts, hashes = [], []
            for url, html in zip(*_columns(batch, "url", "html"), strict=True):
                found = suspects(parse(html or ""))
                hosts += [host(url)] * (len(found) + 1)
                hashes += [x - (1 << 63) for x in found] + [0]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], ["host", "hash"])

    return pages.select("url", "html").mapInArrow(run, "host string, hash long").groupBy("host", "hash").agg(F.count("*").alias("pages"))


def templates(counts: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, hash`` of the subtrees that recur on many pages of their host."""
    total = counts.where("hash = 0").select("host", F.col("pages").alias("total"))
    return counts.where(f"hash <> 0 and pages >= {min_pages}").join(total, "host").where(F.col("pages") >= min_share * F.col("total")).select("host", "hash")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (``url, html`` and any more) with ``text`` and ``n_chars``; columns of these names are replaced.

    A null or empty page has the empty text. A null or broken url counts as a host of its own, the empty name. Repeated
    rows are pages that recur; rows come back as often as they came. An empty table gives an empty table.
    """
    pages = pages.drop("text", "n_chars", "__host", "__list")
    kept = pages.columns
    found = cut(templates(cut(count_subtrees(pages))))
    few = found.count() <= BROADCAST_TEMPLATES
    if few:
        by_host: dict[str, set[int]] = {}
        for r in found.collect():
            by_host.setdefault(r["host"], set()).add(r["hash"] + (1 << 63))
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
        source = pages
    else:
        source = pages.withColumn("__host", F.udf(host, "string", useArrow=True)("url")).join(found.groupBy(F.col("host").alias("__host")).agg(F.collect_list("hash").alias("__list")), "__host", "left")

    def run(batches):
        for batch in batches:
            if few:
                sets = [shared.value.get(host(u), frozenset()) for u in _columns(batch, "url")[0]]
            else:
                sets = [{x + (1 << 63) for x in v or ()} for v in _columns(batch, "__list")[0]]
            texts = [main_text(parse(h or ""), s) for h, s in zip(_columns(batch, "html")[0], sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in out] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*out, "text", "n_chars"])

    out = [c for c in kept if c != "html"]
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in out] + ["text string", "n_chars long"]))


def query(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
