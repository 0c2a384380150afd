"""HTML extraction with a site style tree.

1. Every page is read into a tolerant tree of elements (comments, scripts,
   styles and the head are no content). A node's *place* is its path of tags
   with their class and id words (digits ignored), so the same-host pages
   merge into one tree of places: the site style tree. Every node with text
   below it has a presentation, the sequence of its child tags with their
   class and id words, and a content, the text below it; both are hashed. Per
   place an article contributes each of them once: pages of a host with the
   same main text are copies, one article between them.
2. Spark counts, per host and place, the articles m that have it, and for each
   presentation and each content the articles c that show it: grouped sums that
   are combined before the shuffle, so a host with a third of all pages, or a
   group of copies, is a few rows a task. With shares p of a place's variants,
   entropy in base m is -sum p log p / log m: 0 if all articles show the same,
   1 if all differ. The importance of a leaf is that of its content: this
   entropy if all other articles differed, (-q log q + (1 - q) log m) / log m
   with q = c / m; and no more than the entropy of the place's contents if
   ``min_pages`` articles show the same variant.
3. The importance of an inner node is composed on its page: 1 - ``discount`` of
   it is the entropy of its place's presentations, ``discount`` of it the mean
   importance of its branches, weighted by their text. Where a host has fewer
   than ``min_pages`` articles with a place, its variants say nothing: 1.
4. Branches of an importance below ``threshold`` are removed, from the top; the
   other branches of a place stay. Inline elements amid text of their parent
   are part of its sentence. A page joins only the evidence of its own places,
   so no host's tree is ever gathered.
5. A menu, an advert or a footer need not repeat: its links and words may differ
   from page to page, and a host may have one page. What a template says of
   itself counts whatever the evidence: navigation, header, footer, aside, form,
   script, style and similar elements, and elements with a class, id or role
   whose *whole* name is made of template words (``is_template_name``: "ad",
   "cookie-notice", "siteFooter"; not "ad-hoc", "notice-period", "share-price").
   Inside article or main a header is the article's own, a heading is never
   template, and ids of paragraphs are slugs that say nothing. Where a page has
   article (or else main) elements, text outside them is not content.

Blocks are joined by one line break in page order; white space inside a block
becomes one space, the block is trimmed; ``br`` is white space. Character
references are decoded, once.

Defined cases: null or empty html has the empty text; a page without any
element is one block; unclosed elements close with their parent, stray end tags
are ignored; a null url is a host of its own kind (no host); equal pages get
equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm._shared import written

# HTML's elements and the words of templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead title tr ul caption".split()
)
NOISE_TAGS = frozenset(
    "head nav header footer aside form script style noscript template iframe button select option input textarea "
    "menu dialog svg canvas object embed audio video map title search datalist xmp noembed noframes".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside notice notices notification cookie "
    "cookies consent gdpr popup modal newsletter subscribe subscription signup login comment comments commentlist "
    "disqus replies reply respond share sharing social related recommended recommendations widget widgets toolbar "
    "pagination pager complementary contentinfo search alert skip".split()
)
# Words that tell parts of a template apart and say nothing alone.
FRAME_WORDS = frozenset(
    "site page main top bottom left right box block bar wrap wrapper container content section area panel list item "
    "items link links inner outer global primary secondary slot unit zone row col column mobile desktop fixed sticky "
    "js button icon form text body author title thread count meta info posts articles stories the".split()
)
CLOSES = {  # a start tag that ends an open element of the same parent
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot select article section div main body".split())

# The second form of a tag serves those with a stray quote.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTRIBUTE = re.compile(r"(?<![\w:.-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@lru_cache(100_000)
def name_words(name: str) -> tuple[str, ...]:
    """The words of a class or id, split at case, digits and signs, in lower case."""
    return tuple(w.lower() for w in _NAME_WORDS.findall(name))


@lru_cache(100_000)
def is_template_name(name: str) -> bool:
    """The whole name is one of template words, or of these and frame words."""
    words = name_words(name)
    own = "".join(words)
    if own in NOISE_WORDS:  # "navBar", "sign-up"
        return True
    return not NOISE_WORDS.isdisjoint(words) and all(w in NOISE_WORDS or w in FRAME_WORDS for w in words)


class Node:
    __slots__ = ("tag", "own", "ruled", "place", "children", "parent", "inside")

    def __init__(self, tag: str, names: list[str], ids: list[str], parent: Node | None):
        """``names``: classes and roles."""
        self.tag, self.parent = tag, parent
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        if tag in HEADINGS and self.inside:
            said = []
        else:
            said = names if tag == "p" and self.inside else names + ids
        self.ruled = any(map(is_template_name, said))
        words = sorted({w for name in names + ids for w in name_words(name)})
        self.own = f"{tag}.{'.'.join(words)}" if words else tag
        self.place = f"{parent.place}/{self.own}" if parent else self.own
        self.children: list[Node | str] = []
        if parent:
            parent.children.append(self)


def parse(source: str) -> Node:
    """A tree of elements and texts (character references still encoded)."""
    root = Node("#page", [], [], None)
    at, here = 0, root
    while True:
        m = _MARKUP.search(source, at)
        if m is None:
            break
        if m.start() > at:
            here.children.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        rest = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in BLOCK and here.tag != "#page":  # a block ends an open paragraph
            node = here
            while node is not root and node.tag != "p" and node.tag not in CONTAINERS:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in CLOSES:
            node = here
            while node is not root and node.tag not in CLOSES[tag] and node.tag not in ("ul", "ol", "dl", "table", "select"):
                node = node.parent
            if node.tag in CLOSES[tag]:
                here = node.parent
        names: list[str] = []
        ids: list[str] = []
        if "=" in rest:
            for x in _ATTRIBUTE.finditer(rest):
                (ids if x[1].lower() == "id" else names).extend((x[2] or x[3] or x[4] or "").split())
        node = Node(tag, names, ids, here)
        if tag in VOID or rest.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
            continue
        here = node
    if at < len(source):
        here.children.append(source[at:])
    return root


def is_template(node: Node) -> bool:
    if node.tag in NOISE_TAGS:
        return not (node.tag == "header" and node.inside)
    return node.ruled and node.tag not in ("html", "body", "article", "main")


def main_nodes(root: Node) -> list[Node]:
    """The outermost article elements outside template elements, else main, else all."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.tag == tag:
                found.append(n)
            elif not is_template(n):
                stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
        if found:
            return found
    return [root]


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Look:
    shape: int  # hash of the presentation
    content: int  # hash of the text below
    size: int  # characters of that text
    branches: list[Node]  # children that have a look of their own
    mixed: bool  # the node has text of its own


def looks(main: Node) -> dict[Node, Look]:
    """The look of every node from ``main`` down that has text below it, without
    template elements. Inline elements amid text belong to their parent's text."""
    order, stack = [], [main]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if isinstance(c, Node) and not is_template(c))
    out: dict[Node, Look] = {}
    for n in reversed(order):  # children come before their parents
        tags, parts, branches, size = [], [], [], 0
        mixed = any(isinstance(c, str) and not c.isspace() for c in n.children)
        for c in n.children:
            if isinstance(c, Node):
                tags.append(c.own)
                if c in out:
                    parts.append(f"<{out[c].content}>")
                    size += out[c].size
                    if c.tag in BLOCK or not mixed:
                        branches.append(c)
            elif not c.isspace():
                parts.append(_SPACE.sub(" ", c).strip())
                size += len(parts[-1])
        if parts:
            out[n] = Look(_number(">".join(tags)), _number("\n".join(parts)), size, branches, mixed)
    return out


def style_nodes(main: Node, found: dict[Node, Look], host: str | None) -> Iterator[tuple[Node, int, int, int]]:
    """(node, place, presentation, content) of the nodes below ``main`` that the
    style tree decides; the last two are hashes of this place."""
    keys: dict[str, int] = {}
    todo = list(found[main].branches) if main in found else []
    while todo:
        n = todo.pop()
        todo.extend(found[n].branches)
        if n.place not in keys:
            keys[n.place] = place_key(host, n.place)
        key = keys[n.place]
        yield n, key, _mix(key, found[n].shape), _mix(key, ~found[n].content)


def _mix(a: int, b: int) -> int:
    """A 64-bit number of two."""
    x = ((a ^ (b * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 29
    x = (x * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


def noisy_nodes(main: Node, host: str | None, evidence: dict[int, float], threshold: float, discount: float) -> set[Node]:
    """Nodes below ``main`` whose importance is below ``threshold``.

    ``evidence``: importance by place (of its presentations) and by content.
    """
    found = looks(main)
    importance: dict[Node, float] = {}
    nodes = list(style_nodes(main, found, host))
    for n, place, _, content in reversed(nodes):  # branches come before their nodes
        own = evidence.get(content, 1.0)
        look = found[n]
        if not look.branches:
            importance[n] = own
            continue
        size = sum(found[c].size for c in look.branches)
        parts = sum(importance[c] * found[c].size for c in look.branches)
        if look.mixed:  # its own text counts as a branch
            size, parts = look.size, parts + own * (look.size - size)
        importance[n] = (1.0 - discount) * evidence.get(place, 1.0) + discount * (parts / size if size else own)
    return {n for n, value in importance.items() if value < threshold}


def blocks(root: Node, noisy: set[Node]) -> list[str]:
    """The texts of the blocks that remain, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = _SPACE.sub(" ", references.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    for main in main_nodes(root):
        end_block()
        stack: list[Node | str | None] = [main]  # None: the end of a block
        while stack:
            n = stack.pop()
            if n is None:
                end_block()
            elif isinstance(n, str):
                line.append(n)
            elif n.tag == "br":
                line.append(" ")
            elif n is main or not (is_template(n) or n in noisy):
                if n.tag in BLOCK:
                    end_block()
                    stack.append(None)
                stack.extend(reversed(n.children))
    end_block()
    return out


def place_key(host: str | None, place: str) -> int:
    return _number(f"{host}\n{place}")


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page", "article", "place", "shape", "content"]
    for batch in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        for key, host, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            mains = [(main, looks(main)) for main in main_nodes(parse(source))] if source else []
            article = _number(" ".join(str(found[main].content) for main, found in mains if main in found))
            rows += {(key, article, *both) for main, found in mains for _, *both in style_nodes(main, found, host)}
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _extract(threshold: float, discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, source, known in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if not source:
                    texts.append("")
                    continue
                root, noisy = parse(source), set()
                evidence = {e["key"]: e["value"] for e in known or ()}
                if evidence:
                    for main in main_nodes(root):
                        noisy |= noisy_nodes(main, host, evidence, threshold, discount)
                texts.append("\n".join(blocks(root, noisy)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def _entropies(styles: DataFrame, variant: str) -> tuple[DataFrame, DataFrame]:
    """(place, variant, c), and per place the entropy of its variants but for its base:
    n = sum of c, s = sum of c log c, so that it is log n - s / n."""
    counted = styles.select("place", variant, "article").distinct().groupBy("place", variant).agg(F.count("*").alias("c"))
    sums = counted.groupBy("place").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return counted, sums.select("place", (F.log("n") - F.col("s") / F.col("n")).alias("entropy"))


def style_importance(styles: DataFrame, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """The evidence of the style tree: (place, key, value) with the entropy of a
    place's presentations (key: the place), and (content, key, value) with the
    importance of a content. Only what is below 1 is listed."""
    articles = styles.select("place", "article").distinct().groupBy("place").agg(F.count("*").alias("m"))
    articles = articles.where(F.col("m") >= min_pages)
    _, shapes = _entropies(styles, "shape")
    counted, contents = _entropies(styles, "content")
    log_m = F.log("m")
    of_places = articles.join(shapes, "place").select(
        "place", F.col("place").alias("key"), F.least(F.lit(1.0), F.col("entropy") / log_m).alias("value")
    )
    q = F.col("c") / F.col("m")
    alone = (-q * F.log(q) + (1 - q) * log_m) / log_m
    few = F.when(F.col("c") >= min_pages, F.col("entropy") / log_m)
    of_contents = (
        counted.where("c > 1")
        .join(articles, "place")
        .join(contents, "place")
        .select("content", F.col("content").alias("key"), F.least(alone, few).alias("value"))
    )
    return of_places.where("value < 1"), of_contents


def extract_text(
    pages: DataFrame,
    threshold: float = 0.2,
    discount: float = 0.9,
    min_pages: int = 8,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    url, source = F.col(url_col), F.col(html_col)
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))
    narrow = pages.select(
        F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), source.alias("html")
    ).withColumn("page", F.xxhash64("url", "html"))
    styles = written(
        narrow.select("page", "host", "html").mapInArrow(
            _styles, "page long, article long, place long, shape long, content long"
        ),
        "styles",
    )
    of_places, of_contents = style_importance(styles, min_pages)
    # A branch can fall below the threshold only if a leaf below it has less than
    # threshold / discount: only such pages need the evidence of their places.
    low = of_contents.where(F.col("value") < threshold / discount)
    touched = written(styles.select("page", "content").join(low, "content").select("page").distinct(), "touched")
    rows = written(styles.select("page", "place", "content").join(touched, "page", "left_semi"), "touched-styles")
    of_content = rows.select("page", "content").distinct().join(of_contents, "content").select("page", "key", "value")
    of_place = rows.select("page", "place").distinct().join(of_places, "place").select("page", "key", "value")
    shown = of_content.union(of_place)
    known = shown.groupBy("page").agg(F.collect_list(F.struct("key", "value")).alias("known"))
    known = written(known, "evidence")  # of known size: where it is small, the pages are not shuffled
    return (
        narrow.join(known, "page", "left")
        .select("page_id", "url", "host", "html", "known")
        .mapInArrow(
            _extract(threshold, discount),
            f"page_id {narrow.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long",
        )
        .withColumnsRenamed({"page_id": id_col, "url": url_col})
    )
