"""Main text of web pages by tree scoring.

A tolerant reader builds the element tree. Elements that can't hold the article are cut off: by tag (scripts, menus,
forms, also a header or footer inside the article, with all it holds), by being hidden, or by a word of their role,
class or id. Such a word counts as a part of a name on containers, and as a whole name on paragraphs, headings and
table cells; after "with", "has", "no" or "without" it tells of the layout and doesn't count; nor does it on wrappers, which
hold a main, an article or a first-level heading that isn't cut itself. Every paragraph passes points, for itself, its
commas and its length, to its parent, and half of them to its grandparent; a container's points are discounted by its
link density. The best container is kept, widened to an article or main element around it, with those siblings that
hold a share of its points too or are paragraphs of running text. Blocks come out in page order, white space inside one
turned into single spaces.

A null page counts as empty; a page without text gives ''. Missing end tags, stray '<' and unclosed comments are
read as browsers roughly do. Repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tesselon.llm.common import col, record, text_slices, texts_of

#: Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CUT = frozenset("head nav header footer aside form button menu dialog fieldset".split())
PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSES = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
#: Words in a class, id or role that mark what is not the article.
UNLIKELY = frozenset(
    "nav navbar navigation menu menubar header masthead banner footer sidebar side aside ad ads advert adverts advertisement promo promotion sponsor sponsored cookie cookies consent notice notices "
    "popup modal overlay share sharing social related recommended comment comments reply replies disqus widget subscribe subscription newsletter signup login breadcrumb breadcrumbs pagination pager toolbar "
    "contentinfo complementary search alert skip tags".split()
)
HOLDERS = frozenset({"article", "main"})
#: A sibling is kept from this share of the best container's points on, or as a paragraph of at least so many characters with few links.
SIBLING_SHARE, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^<>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[^a-z0-9]+")
#: Parts of a name after which a word tells of the layout around an element.
LAYOUT = frozenset("with has no without".split())


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "points", "total", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.children: list[Node | str] = []
        self.points, self.total, self.chars, self.linked, self.commas = 0.0, 0.0, 0, 0, 0


def attributes_of(raw: str) -> dict[str, str]:
    """The first value of each attribute, lower-case."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


def named_unlikely(tag: str, attributes: dict[str, str]) -> bool:
    """Whether role, class or id say that the element isn't part of the article."""
    if tag in ("html", "body", "main"):
        return False
    for name in " ".join(attributes.get(k, "") for k in ("role", "class", "id")).split():
        parts = [name] if tag in PARAGRAPH or tag in HOLDERS else _PARTS.split(name)
        if any(x in UNLIKELY and (k == 0 or parts[k - 1] not in LAYOUT) for k, x in enumerate(parts)):
            return True
    return False


def spare_wrappers(root: Node, suspects: list[Node]) -> None:
    """Suspects that hold what marks an article are not cut; inner ones decide before outer ones."""
    for node in reversed(suspects):
        stack: list[Node] = [c for c in node.children if isinstance(c, Node)]
        while stack:
            x = stack.pop()
            if x.cut:
                continue
            if x.tag in HOLDERS or x.tag == "h1":
                node.cut = False
                break
            stack += [c for c in x.children if isinstance(c, Node)]


def tree(page: str) -> Node:
    root = Node("html", None)
    suspects: list[Node] = []
    at, pos, size = root, 0, len(page)
    lower = None
    while pos < size:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":  # else a comment or a tag that the page ends in
                at.children.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent if node.tag not in ("td", "th") or tag in ("tr", "table", "tbody", "thead", "body", "html") else None
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", pos)
                close = -1 if end < 0 else page.find(">", end)
                pos = size if close < 0 else close + 1
            continue
        if tag == "html":
            continue
        if tag in VOID:
            at.children.append(Node(tag, at))
            continue
        if tag in BLOCK:  # what it ends without an end tag
            node = at
            while node is not None and (node.tag not in BLOCK or node.tag in CLOSES):
                if tag in CLOSES.get(node.tag, ()):
                    at = node.parent
                    break
                node = node.parent
        attributes = attributes_of(m[3]) if m[3].strip() else {}
        node = Node(tag, at, tag in CUT or hidden(attributes))
        if not node.cut and attributes and named_unlikely(tag, attributes):
            node.cut = True
            suspects.append(node)
        at.children.append(node)
        at = node
    spare_wrappers(root, suspects)
    return root


def measure(root: Node) -> None:
    """Characters and linked characters of all nodes, and the points that paragraphs pass on."""
    order, stack = [], [(root, False)]
    links: dict[int, bool] = {}
    while stack:
        node, linked = stack.pop()
        if node.cut:
            continue
        linked = linked or node.tag == "a"
        links[id(node)] = linked
        order.append(node)
        stack += [(c, linked) for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                node.chars += n
                node.commas += c.count(",")
                node.linked += n if links[id(node)] else 0
            elif not c.cut:
                node.chars += c.chars
                node.commas += c.commas
                node.linked += c.linked
                node.total += c.total
        direct = any(isinstance(c, str) and c.strip() for c in node.children)
        if node.chars and (node.tag in PARAGRAPH or (direct and node.tag in BLOCK)):
            points = (1 + node.commas + min(3.0, node.chars / 100)) * (1 - node.linked / node.chars)
            holder = node if direct and node.tag not in PARAGRAPH else node.parent or node
            holder.points += points
            node.total += points
            if holder.parent is not None:
                holder.parent.points += points / 2


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def containers(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    best, top = root, 0.0
    stack = [root]
    while stack:
        node = stack.pop()
        if node.cut:
            continue
        score = node.points * (1 - density(node))
        if score > top:
            best, top = node, score
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    node = best
    while node is not None and node.tag not in HOLDERS:
        node = node.parent
    best = node or best
    if best.parent is None or best.tag == "body":
        return [best]
    out = []
    for c in best.parent.children:
        if not isinstance(c, Node) or c.cut:
            continue
        good = c.total * (1 - density(c)) >= max(1.0, SIBLING_SHARE * best.total)
        prose = c.tag in PARAGRAPH and density(c) < SIBLING_LINKS and (c.chars >= SIBLING_CHARS or c.tag[0] == "h" or c.tag == "p" and c.chars)
        if c is best or good or prose:
            out.append(c)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            if text:
                out.append(text)
            now.clear()

    stack: list[Node | str | None] = []
    for node in reversed(nodes):
        stack += [None, node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag in VOID:
            if x.tag in ("br", "hr"):
                now.append("\n")
        elif not x.cut:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.children)
    end()
    return out


def main_text(page: str) -> str:
    root = tree(page)
    measure(root)
    return "\n".join(blocks(containers(root)))


def extracted(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "page"):
            texts = [main_text(x) for x in texts_of(part, "page")]
            yield record(schema, part.column("key"), part.column("url"), texts, [len(t) for t in texts])

    chosen = df.select(col(key).cast("long").alias("key"), col(url).cast("string").alias("url"), col(page).cast("string").alias("page"))
    return chosen.mapInArrow(run, "key long, url string, text string, n_chars long").withColumnRenamed("key", key)
