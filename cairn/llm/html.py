"""Main text of HTML pages, with removal of templates that recur over a host's pages.

Pages are parsed twice. First every container element's subtree (tag, class, children, text) is hashed, and Spark
counts in how many different articles of its host each hash occurs; an article is known by its three longest blocks
of text, so near copies of one article count once. Subtrees that occur in at least MIN_PAGES articles and MIN_SHARE
of the host's articles are templates. Each page is joined to those of its own subtrees that are templates, so a row
carries no more than its page holds. Then pages are parsed again and their text is taken without templates, and
without elements that are not content by tag, role or name (Judge). No name, role or form drops the article or what is around
it. A template that holds two thirds of the text, or a container with a doubtful class name that holds half of it,
stays: that is the article.

The text comes from the article elements that are not inside another, if they hold half of the text of main (a
quarter of the body's without main); else from main, or from the body. Inside an article only containers can be
templates: paragraphs that many articles quote stay. Blocks are joined by one space; white space inside is one space;
character references are decoded. Raw elements without an end tag end where they begin, script and style with the page.

Null html is an empty text. Pages with null or hostless urls have no template removal. Repeated rows and clashing
columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import ship, staged, unstage

MIN_PAGES, MIN_SHARE = 4, 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<\Z",
    re.S | re.I,
)
#: Elements whose content is not markup of the page; the first two run to the page's end where they are not closed.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object")}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "nav", "aside", "header", "footer", "form", "center", "menu", "details", "figure", "fieldset"}
CLOSES_P = BLOCKS - {"body", "br", "caption", "dd", "dt", "head", "html", "legend", "li", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An opening tag ends open elements of these tags, up to one of the borders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
NOT_CONTENT = {"head", "nav", "aside", "footer", "button", "select", "dialog", "menu", "input", "label"}
#: Elements that may as well wrap a whole page.
FORMS = {"form", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
NOISE = COMMENTS | set(
    "ad ads adv adbox advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification banner newsletter subscribe subscription"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar sharing social recommended recommendations popup modal overlay toolbar login signup paywall skiplink".split()
)
#: Words that say where or what shape a box is; a name of these and noise words alone means noise.
SHAPES = set(
    "article bar block body bottom box button buttons card cards close col column container content desktop entry fixed form global google group head header holder icon icons image inline inner item items left"
    " link links list main message mobile module outer page panel post primary reader readers region right row secondary section sidebar site slot sticky teaser text thread title top unit user users widget wrap wrapper zone".split()
)
#: A name that begins so, or ends in `free`, tells what a page has or lacks; function words make a heading's anchor.
TELLS = {"has", "have", "with", "without", "no", "not", "non", "is", "hide", "show"}
FUNCTION_WORDS = {"a", "and", "for", "in", "of", "on", "the", "to", "und", "der", "die", "et", "le", "la", "de", "el", "y"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
STRONG, MIXED = 2, 1
#: Names that an article's own parts may have as well.
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:alert|discussion|related|share|widget)(?:$|[\s_-])", re.I)


class Node:
    """An element: tag, attributes as written, children (nodes and decoded text)."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, *names: str) -> str:
        """The values of these attributes, joined by spaces."""
        if not self.attributes or self.attributes.isspace():
            return ""
        found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(self.attributes)}
        return " ".join(unescape(found[n]) for n in names if n in found)

    def has(self, name: str) -> bool:
        return name in self.attributes.lower() and any((m[1] or m[5]).lower() == name for m in _ATTRIBUTE.finditer(self.attributes))


def parse(html: str) -> Node:
    """The page's element tree; unclosed elements end where HTML implies it, unmatched ends are passed over."""
    root = Node("#page")
    stack, at, endless = [root], 0, set()
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main") and tag in ("p", "div", "b", "i", "span", "a", "em", "strong"):
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if tag in ("svg", "math") and attributes.endswith("/"):
                continue
            end = None if tag in endless else RAW[tag].search(html, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                return root
            else:
                endless.add(tag)
            continue
        if tag in CLOSES_P:
            _end(stack, {"p"}, {"article", "main", "table", "button", "div", "section", "td", "th", "li", "blockquote"})
        if tag in IMPLIED:
            _end(stack, *IMPLIED[tag])
        if tag == "body":
            _end(stack, {"head"}, set())
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID and not node.attributes.endswith("/"):
            stack.append(node)
    if at < len(html):
        stack[-1].children.append(unescape(html[at:]))
    return root


def _end(stack: list[Node], tags: set[str], borders: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in borders:
            return


def subtree_hashes(root: Node) -> dict[int, int]:
    """id(node) -> hash for the container elements that hold text."""
    out: dict[int, int] = {}
    done: dict[int, tuple[int, bool]] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        parts, full = [f"<{node.tag} {node.get('class', 'id') if node.tag in CONTAINERS else ''}>"], False
        for c in node.children:
            if isinstance(c, Node):
                h, some = done.pop(id(c))
                parts.append(f"\0{h:x}")
                full |= some
            elif not c.isspace():
                parts.append(" ".join(c.split()))
                full = True
        h = xxhash.xxh3_64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass")) - 2**63
        done[id(node)] = h, full
        if full and node.tag in CONTAINERS:
            out[id(node)] = h
    return out


def article_key(root: Node) -> int:
    """A hash of the three longest blocks of content, by which copies and near copies of an article are one."""
    blocks, parts, stack = [], [], [root]
    is_content = Judge(root)
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x is _BREAK or x.tag in BLOCKS:
            if parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
            if x is _BREAK:
                continue
            stack.append(_BREAK)
        stack += [c for c in reversed(x.children) if isinstance(c, str) or is_content(c, True)]
    blocks.append(" ".join("".join(parts).split()))
    longest = sorted(set(blocks), key=lambda t: (-len(t), t))[:3]
    return xxhash.xxh3_64_intdigest("\1".join(longest).encode("utf-8", "surrogatepass")) - 2**63


_BREAK = Node("#break")


def text_size(root: Node) -> int:
    """Characters of text in a subtree, white space left out."""
    size, stack = 0, [root]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                stack.append(c)
            else:
                size += sum(map(len, c.split()))
    return size


def noise_of(names: str) -> tuple[int, bool]:
    """How far class names or an id mean a box beside the article (STRONG: noise and shape words alone; MIXED: others too; 0), and whether they mean comments."""
    best, comments = 0, False
    for name in names.replace("side-bar", "sidebar").replace("skip-link", "skiplink").split():
        words = [w.lower() for w in _WORD.findall(name)]
        found = NOISE.intersection(words)
        if not found or words[0] in TELLS or words[-1] == "free" or FUNCTION_WORDS.intersection(words):
            continue
        strong = all(w in found or w in SHAPES or w.isdigit() for w in words)
        best = max(best, STRONG if strong else MIXED)
        comments |= strong and bool(COMMENTS.intersection(words))
    return best, comments


class Judge:
    """Which elements of one page are content.

    By tag, role, visibility and name. Neither a name, a role nor a form drops the page's article: the largest article and
    main element that are not themselves beside the content, and all around them, stay; and so does whatever holds half
    of the page's text (nine tenths if it is called comments). A name with other words in it counts only outside an article,
    or where half of the text is links.
    """

    def __init__(self, root: Node):
        self.root, self.sizes, self.kept = root, {}, None

    def _measure(self) -> None:
        """Text sizes of all elements, and what the article and all around it are."""
        parents: dict[int, Node | None] = {id(self.root): None}
        order, stack = [], [(self.root, False)]
        best: dict[str, Node] = {}
        candidates = []
        while stack:
            node, beside = stack.pop()
            order.append(node)
            strength, comments = noise_of(node.get("class", "id")) if node.attributes else (0, False)
            beside = beside or comments or node.tag in NOT_CONTENT or self.invisible(node)
            if node.tag in ("article", "main") and not beside and strength < STRONG:
                candidates.append(node)
            for c in node.children:
                if isinstance(c, Node):
                    parents[id(c)] = node
                    stack.append((c, beside))
        for node in reversed(order):
            self.sizes[id(node)] = sum(self.sizes[id(c)] if isinstance(c, Node) else sum(map(len, c.split())) for c in node.children)
        for node in candidates:
            if node.tag not in best or self.sizes[id(node)] > self.sizes[id(best[node.tag])]:
                best[node.tag] = node
        self.kept = set()
        for node in best.values():
            while node is not None and id(node) not in self.kept:
                self.kept.add(id(node))
                node = parents[id(node)]

    def around(self, node: Node) -> bool:
        """Whether a node is the article or main, or around it."""
        if self.kept is None:
            self._measure()
        return id(node) in self.kept

    def share(self, node: Node) -> float:
        if self.kept is None:
            self._measure()
        return self.sizes[id(node)] / max(1, self.sizes[id(self.root)])

    @staticmethod
    def invisible(node: Node) -> bool:
        if not node.attributes or node.tag in ("html", "body", "main"):
            return False
        return node.has("hidden") or node.get("aria-hidden").lower() == "true" or bool(re.search(r"display\s*:\s*none", node.get("style")))

    def _linked(self, node: Node) -> bool:
        size, stack = 0, [node]
        while stack:
            for c in stack.pop().children:
                if isinstance(c, Node) and c.tag == "a":
                    size += text_size(c)
                elif isinstance(c, Node):
                    stack.append(c)
        return 2 * size >= text_size(node)

    def __call__(self, node: Node, inside: bool) -> bool:
        """inside: below an article or main."""
        tag = node.tag
        if tag in NOT_CONTENT:
            return False
        if tag == "header" and not inside:
            return self.around(node)
        if tag not in FORMS and (not node.attributes or tag in ("html", "body", "main")):
            return True
        if self.invisible(node):
            return False
        role = node.get("role").lower()
        if role in ROLES and role != "form":
            return self.around(node)
        of_class, comments = noise_of(node.get("class"))
        of_id, comments_id = noise_of(node.get("id"))
        named = STRONG in (of_class, of_id) or of_class and not inside
        if not named and (of_class or of_id):
            named = self._linked(node)
        if not named and tag not in FORMS and role != "form":
            return True
        return self.around(node) or self.share(node) >= (0.9 if comments or comments_id else 0.5)


def is_doubtful(node: Node) -> bool:
    """Whether a container has a class name or id that may mean a box beside the article."""
    return node.tag in CONTAINERS and bool(node.attributes) and bool(_DOUBTFUL.search(node.get("class")) or _DOUBTFUL.search(node.get("id")))


def _find(root: Node, tag: str, is_content: Judge) -> list[Node]:
    """Content elements of a tag in page order, those inside another left out."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == tag:
            out.append(node)
            continue
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and is_content(c, c.tag in ("article", "main") or node.tag == "main")]
    return out


def _text_of(roots: list[Node], inside: bool, hashes: dict[int, int], templates: frozenset[int] | set[int], is_content: Judge) -> str:
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(roots))
    first = {id(r) for r in roots}
    total: list[int] = []

    def holds(x: Node, share: float) -> bool:
        if not total:
            total.append(sum(map(text_size, roots)))
        return text_size(x) >= share * total[0]

    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if id(x) not in first and (not is_content(x, inside) or hashes.get(id(x)) in templates and not holds(x, 2 / 3) or is_doubtful(x) and not holds(x, 1 / 2)):
            if x.tag in BLOCKS:
                parts.append(" ")
            continue
        edge = x.tag in BLOCKS
        if edge:
            stack.append(" ")
        stack += reversed(x.children)
        if edge:
            parts.append(" ")
    return " ".join("".join(parts).split())


def main_text(html: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """A page's main text without elements whose hash is in templates."""
    root = parse(html or "")
    hashes = subtree_hashes(root) if templates else {}
    judge = Judge(root)
    articles, main = _find(root, "article", judge), _find(root, "main", judge)
    whole = _text_of(main or [root], bool(main), hashes, templates, judge) if main or not articles else ""
    if not articles:
        return whole
    text = _text_of(articles, True, hashes, templates, judge)
    if not main:
        whole = _text_of([root], False, hashes, templates, judge)
    return text if len(text) >= len(whole) / (2 if main else 4) else whole


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Staged (host, page, hashes): for each page (by the hash of its html) that has any, its own subtrees that recur over its host."""
    ship(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit(""))
    source = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(body).alias("page"), body.alias("html")).where("host is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), set()
                for host, page, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    root = parse(text)
                    key = article_key(root)
                    rows |= {(host, page, key, h) for h in {None, *subtree_hashes(root).values()}}
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "page", "article", "hash"])

    seen = staged(source.mapInArrow(run, "host string, page bigint, article bigint, hash bigint").distinct(), "subtrees")
    counts = seen.select("host", "article", "hash").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    totals = counts.where("hash is null").select("host", F.col("n").alias("total"))
    found = counts.where(F.col("hash").isNotNull() & (F.col("n") >= min_pages)).join(totals, "host").where(F.col("n") >= min_share * F.col("total")).select("host", "hash")
    out = staged(seen.join(found, ["host", "hash"]).groupBy("host", "page").agg(F.collect_list("hash").alias("hashes")), "templates")
    unstage(seen)
    return out


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Per page: id, url, text, n_chars. Pages are joined to their templates by host and hash of the page; many copies of one page are one key, which AQE splits."""
    found = templates(pages, url, html, min_pages, min_share).select(F.col("host").alias("__host"), F.col("page").alias("__page"), "hashes")
    page = F.xxhash64(F.coalesce(F.col(html), F.lit("")))
    source = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("__host"), page.alias("__page"))
    joined = source.join(found, ["__host", "__page"], "left").select("id", "url", "html", "hashes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(t, frozenset(h or ())) for t, h in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_column, "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_column}` {kind}, url string, text string, n_chars bigint")
