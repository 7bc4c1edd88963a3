"""HTML to title, links and Markdown: one Python boundary per page.

A lenient tree on the standard library's parser (no implied end tags: an unclosed element holds what
follows until an ancestor closes), a subset of CSS selectors (tag, .class, #id, [a], [a=v], [a*=v],
descendant, child, comma), and a converter with ATX headings and fenced code.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What is pruned or selected where nothing else is said.
CONTENT_SELECTORS = ("main", "article", ".content", "#content", ".documentation")
CONTENT_FALLBACKS = ("main", "article", ".content", "#content", "body")
PRUNE_SELECTORS = ("nav", "header", "footer", ".cookie-banner", ".newsletter", ".feedback", ".edit-page", ".breadcrumb", ".toc")
GENERIC_PRUNE = ("script", "style", "noscript", "iframe", "aside", "button[aria-label*='copy']", "button[aria-label*='Copy']", ".copy-button", ".clipboard-button")
BOILERPLATE = ("script", "style", "noscript", "iframe", "svg", "nav", "header", "footer", ".cookie-banner", ".newsletter")
UNSAFE = ("script", "style", "noscript", "iframe", "object", "embed")
NAV_CLASSES = ("sidebar", "sidenav", "side-nav", "toc", "table-of-contents", "navigation", "nav-menu", "menu-panel")
SIDEBAR_LINKS = 8


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            x = stack.pop()
            yield x
            stack += [y for y in reversed(x.children) if isinstance(y, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("")
        self.open: Counter = Counter()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Node(tag, {k: v or "" for k, v in attrs}, [], self.now))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        while self.now.tag != tag:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent
        self.open[tag] -= 1
        self.now = self.now.parent

    def handle_data(self, data):
        self.now.children.append(data)


class _AsWritten(_Builder):
    """Leaves character references as the page writes them: the parser is shown another character for ``&``."""

    def __init__(self, html: str):
        super().__init__()
        self.mark = next(x for x in map(chr, range(0xE000, 0xF900)) if x not in html)

    def feed(self, data):
        super().feed(data.replace("&", self.mark))

    def _attrs(self, attrs):
        return [(k, v and v.replace(self.mark, "&")) for k, v in attrs]

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, self._attrs(attrs))

    def handle_startendtag(self, tag, attrs):
        super().handle_startendtag(tag, self._attrs(attrs))

    def handle_data(self, data):
        super().handle_data(data.replace(self.mark, "&"))


def parse(html: str, written: bool = False) -> Node:
    b = _AsWritten(html) if written else _Builder()
    b.feed(html)
    b.close()
    return b.root


_PART = re.compile(r"([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?=)[\"']?([^\"'\]]*)[\"']?)?\]")


def _compound(text: str):
    at, tests = 0, []
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"selector {text!r}")
        at = m.end()
        tag, cls, ident, attr, op, value = m.groups()
        if tag and tag != "*":
            tests.append(lambda n, t=tag.lower(): n.tag == t)
        elif cls:
            tests.append(lambda n, c=cls: c in n.classes)
        elif ident:
            tests.append(lambda n, i=ident: n.attrs.get("id") == i)
        elif attr:
            tests.append(lambda n, a=attr, o=op, v=value: a in n.attrs and (o is None or (n.attrs[a] == v if o == "=" else v in n.attrs[a])))
    return lambda n: all(t(n) for t in tests)


def compile_selector(selector: str):
    """A test of a node; ValueError for what the subset lacks."""
    ways = []
    for one in selector.split(","):
        parts = re.split(r"\s*(>)\s*|\s+", one.strip())
        parts = [x for x in parts if x]
        if not parts or parts[0] == ">" or parts[-1] == ">":
            raise ValueError(f"selector {selector!r}")
        ways.append([x if x == ">" else _compound(x) for x in parts])

    def fits(node: Node, way: list) -> bool:
        if not way[-1](node):
            return False
        rest = way[:-1]
        if not rest:
            return True
        if rest[-1] == ">":
            return node.parent is not None and bool(node.parent.tag) and fits(node.parent, rest[:-1])
        up = node.parent
        while up is not None and up.tag:
            if fits(up, rest):
                return True
            up = up.parent
        return False

    return lambda node: any(fits(node, w) for w in ways)


def select(root: Node, selector: str) -> list[Node]:
    try:
        test = compile_selector(selector)
    except ValueError:
        return []
    return [x for x in root.walk() if test(x)]


def _drop(found: list[Node]) -> None:
    gone = {id(x) for x in found}
    for parent in {id(x.parent): x.parent for x in found if x.parent}.values():
        parent.children = [x for x in parent.children if id(x) not in gone]


def prune(root: Node, selectors) -> None:
    for s in selectors:
        _drop(select(root, s))


def prune_sidebars(root: Node) -> None:
    found = []
    for x in [y for y in root.children if isinstance(y, Node)]:
        cls, style = " ".join(x.classes), x.attrs.get("style", "")
        fixed = any(k in cls for k in ("fixed", "sticky")) or any(f"position: {k}" in style for k in ("fixed", "sticky"))
        if (fixed or any(k in cls.lower() for k in NAV_CLASSES)) and sum(y.tag == "a" for y in x.walk()) >= SIDEBAR_LINKS:
            found.append(x)
    _drop(found)


def flatten_code(root: Node) -> None:
    """Lines of code blocks: span.line, else br and block elements; an element without tag is its children."""
    for pre in [x for x in root.walk() if x.tag == "pre"]:
        inside = list(pre.walk())
        if lines := [x for x in inside if x.tag == "span" and "line" in x.classes]:
            for x in lines:
                x.tag, x.children = "", [*x.children, "\n"]
            continue
        for x in inside:
            if x.tag == "br":
                x.tag, x.children = "", ["\n"]
            elif x.tag in ("div", "p", "li"):
                x.tag, x.children = "", ["\n", *x.children]


@dataclass
class _Open:
    """An element being rendered: groups of children, what they gave, and where it is among them."""

    node: Node
    depth: int
    groups: list[list[Node | str]]
    rows: list[int]
    out: list[list[str]] = field(default_factory=list)
    child: int = 0


def _opened(node: Node, depth: int) -> _Open:
    """Lists are rendered item by item, tables cell by cell (``rows``: cells in each), other elements whole."""
    if node.tag in ("pre", "code", "img", "br", "hr", "script", "style", "head"):
        return _Open(node, depth, [], [])
    if node.tag in ("ul", "ol"):
        return _Open(node, depth + 1, [x.children for x in node.children if isinstance(x, Node) and x.tag == "li"], [])
    if node.tag == "table":
        rows, stack = [], [x for x in reversed(node.children) if isinstance(x, Node)]
        while stack:  # rows of a table within a cell are that table's
            x = stack.pop()
            if x.tag == "tr":
                rows.append([y.children for y in x.children if isinstance(y, Node) and y.tag in ("td", "th")])
            elif x.tag != "table":
                stack += [y for y in reversed(x.children) if isinstance(y, Node)]
        return _Open(node, depth, [c for r in rows for c in r], [len(r) for r in rows if r])
    return _Open(node, depth, [node.children], [])


def to_markdown(node: Node | str, language: bool = True) -> str:
    """Renders with a stack of its own: elements may be open to any depth."""
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    stack = [_opened(node, 0)]
    while True:
        top = stack[-1]
        if len(top.out) < len(top.groups) or (top.out and top.child < len(top.groups[len(top.out) - 1])):
            if not top.out or top.child >= len(top.groups[len(top.out) - 1]):
                top.out.append([])
                top.child = 0
                continue
            x = top.groups[len(top.out) - 1][top.child]
            top.child += 1
            if isinstance(x, str):
                top.out[-1].append(re.sub(r"\s+", " ", x))
            else:
                stack.append(_opened(x, top.depth))
            continue
        stack.pop()
        said = _closed(top, language)
        if not stack:
            return said
        stack[-1].out[-1].append(said)


def _closed(done: _Open, language: bool) -> str:
    node, parts = done.node, ["".join(x) for x in done.out]
    if node.tag == "pre":
        code = next((x for x in node.walk() if x.tag == "code"), None)
        own = next((x for x in (node.classes or (code.classes if code else []))), "") if language else ""
        return f"\n\n```{own.replace('language-', '')}\n{node.text().strip(chr(10))}\n```\n\n"
    if node.tag in ("ul", "ol"):
        depth = done.depth - 1
        mark = lambda k: f"{k + 1}." if node.tag == "ol" else "*"
        rows = [f"{'  ' * depth}{mark(k)} {x.strip()}" for k, x in enumerate(parts)]
        return ("\n" if depth else "\n\n") + "\n".join(rows) + ("" if depth else "\n\n")
    if node.tag == "table":
        cells = iter([re.sub(r"\s+", " ", x).strip() for x in parts])
        rows = [[next(cells) for _ in range(n)] for n in done.rows]
        if not rows:
            return ""
        return "\n\n" + "\n".join(["| " + " | ".join(x) + " |" for x in [rows[0], ["---"] * len(rows[0]), *rows[1:]]]) + "\n\n"
    inner = parts[0] if parts else ""
    said = inner.strip()
    if re.fullmatch("h[1-6]", node.tag):
        return f"\n\n{'#' * int(node.tag[1])} {re.sub(r'\s+', ' ', said)}\n\n" if said else ""
    match node.tag:
        case "p" | "div" | "section" | "article" | "main" | "body" | "html" | "header" | "footer" | "nav":
            return f"\n\n{said}\n\n"
        case "br":
            return "  \n"
        case "hr":
            return "\n\n---\n\n"
        case "b" | "strong":
            return f"**{said}**" if said else ""
        case "i" | "em":
            return f"*{said}*" if said else ""
        case "code":
            return f"`{node.text()}`" if node.text() else ""
        case "a":
            return f"[{said}]({node.attrs['href']})" if "href" in node.attrs else inner
        case "img":
            return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
        case "blockquote":
            return "\n\n" + "\n".join(f"> {x}" for x in said.split("\n")) + "\n\n"
        case "script" | "style" | "head":
            return ""
        case "title":
            return said
    return inner


def title_of(root: Node, fallback: str = "", written: bool = False) -> str:
    """An empty first h1 counts: its presence decides. ``written``: neither trimmed nor cut."""
    for tag in ("h1", "title"):
        if x := next((y for y in root.walk() if y.tag == tag), None):
            return x.text() if written else "".join(p.strip() for p in _strings(x))[:200]
    return fallback or "Untitled"


def _strings(node: Node) -> list[str]:
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += reversed(x.children)
    return out


def detect_selector(html: str) -> str:
    if not html:
        return "main"
    root = parse(html)
    return next((s for s in CONTENT_SELECTORS if select(root, s)), "body")


def convert(html: str, selector: str = "main", prunes=PRUNE_SELECTORS, fallback_title: str = "", written: bool = False) -> tuple[str, str, list[str], str]:
    """Title, Markdown of the pruned content, links, preview without boilerplate.

    ``written``: all of them with character references as in the source, the title whole.
    """
    root = parse(html or "", written)
    title = title_of(root, fallback_title, written)
    links = [x.attrs["href"] for x in root.walk() if x.tag == "a" and "href" in x.attrs]
    chosen = next((s for s in CONTENT_SELECTORS if select(root, s)), "body") if html else "main"
    # One after the other: the first that is there at all, wherever it stands.
    found = next((x for s in (selector, *CONTENT_FALLBACKS) if (x := select(root, s))), None)
    if not found:
        return title, "", links, chosen
    body = found[0]
    prune(body, prunes)
    prune(body, GENERIC_PRUNE)
    prune_sidebars(body)
    flatten_code(body)
    return title, re.sub(r"\n{3,}", "\n\n", to_markdown(body)).strip(), links, chosen


def preview(html: str) -> str:
    return _preview(parse(html or ""))


def _preview(root: Node) -> str:
    prune(root, BOILERPLATE)
    return re.sub(r"\n{3,}", "\n\n", to_markdown(root, language=False)).strip()


def sanitize(html: str, most: int = 15000) -> str:
    """For prompts: active elements go, three double quotes become single ones."""
    return _sanitized(parse(html or ""), most)


def _sanitized(root: Node, most: int = 15000) -> str:
    """The tree stays as it is."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in UNSAFE:
            continue
        if x.tag:
            out.append(f"<{x.tag}{''.join(f' {k}="{v}"' for k, v in x.attrs.items())}>")
        if x.tag in VOID:
            continue
        stack += [*([f"</{x.tag}>"] if x.tag else []), *reversed(x.children)]
    return "".join(out)[:most].replace('"""', "'''")


_TEXTS = T.ArrayType(T.StringType())
PAGE = T.StructType([T.StructField(k, _TEXTS if k == "links" else T.StringType()) for k in ("title", "markdown", "links", "selector", "error")])
PREVIEW = T.StructType([T.StructField(k, T.StringType()) for k in ("preview", "sanitized")])
# Characters of HTML after which a worker hands its results on.
PART = 1 << 20


def _each(one: Callable, kind: T.DataType):
    """A UDF of html: ``one`` of each page.

    A worker holds an Arrow batch of pages, one page of it as a string and a tree, and the results of
    PART characters, however many rows a task or a batch has.
    """
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            done, size = [], 0
            for x in pages:
                html = x.as_py()
                done.append(one(html))
                size += len(html or "")
                if size >= PART:
                    yield pa.array(done, arrow)
                    done, size = [], 0
            if done:
                yield pa.array(done, arrow)

    return run


def page(selector: str = "main", prunes: tuple[str, ...] = PRUNE_SELECTORS, written: bool = False):
    """A UDF: html to the struct PAGE. Filters on other columns stay below it.

    A page that cannot be converted has null Markdown and says why in ``error``; the job goes on.
    """

    def one(html: str | None) -> tuple:
        try:
            return (*convert(html or "", selector, prunes, written=written), None)
        except Exception as e:  # noqa: BLE001
            return None, None, [], "main", f"{type(e).__name__}: {e}"[:200]

    return _each(one, PAGE)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.found.append(href)


def links_of(html: str | None) -> list[str]:
    """Targets of all ``a`` elements, entities decoded; without a tree."""
    p = _Links()
    p.feed(html or "")
    p.close()
    return p.found


links = _each(links_of, _TEXTS)


def _both(html: str | None) -> tuple[str, str]:
    """Preview and sanitized page, parsed once."""
    root = parse(html or "")
    safe = _sanitized(root)
    return _preview(root), safe


#: Both in one: two UDFs over iterators would be two workers a task, with the pages sent to each.
previews = _each(_both, PREVIEW)
