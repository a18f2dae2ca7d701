"""Main-text extraction from HTML by tree scoring [free style].

A page is read into a tree with one pattern match for each tag; end tags that HTML lets authors leave out are implied. Blocks
of running text pass points (one, one more for each comma, up to three for length) to their parent and half of them to the
grandparent; names that speak for or against an article shift a container's points. Points are discounted by link density.
The best container is kept with siblings that score a fifth of it or read like its text. Where it stands inside an ``article``,
that is kept, and where it holds only a part of the ``main`` around it, that one is; an article that is itself the best stands
for itself. Lists of links inside what is kept go, by their link density. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out wherever they stand; a form that holds most of the page's text is
the page's wrapper and counts as a plain container.

Names against a container don't count where a name of its own speaks for it, or where they only say what it has, lacks or is
tagged with. When the result is empty or far below the page's text outside links, scoring is repeated with names against as a
malus only (those of comments, notices and adverts once all else is empty), and the longer text is taken.

Defined results: of containers of equal score the first in the page wins; an empty table gives no rows; null or empty html, or a page without text: empty text, length 0; malformed markup is read as far as it goes
and never raises; pages of any length are read whole in linear time; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, table

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
# fixed values: element names by how HTML treats them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del ruby rb rt rp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that end an open element of the given names when they start, and the ones that such an end doesn't cross.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio video map nav header footer aside form button select input fieldset dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
AGAINST = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|pop-up|modal|overlay|newsletter|subscri\w*|signup|login|nav\w*|menu\w*|breadcrumbs?|pag(?:er|ination)|toolbar|header|masthead|footer|footnote-nav|copyright|sidebar|side-bar|aside|widget|rail|related|recommend\w*|share|sharing|social|comments?|comment-\w+|disqus|respond|replies|reply|discussion|tags?|hidden)(?:$|[-_\s]|\d)",
    re.I,
)
FOR = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story|column)(?:$|[-_\s]|\d)", re.I)
#: Names that speak for a container by themselves, also beside a name against it.
RESCUE = re.compile(r"(?:^|[-_])(?:article|content|entry|hentry|h-entry|main|post|story|blog)(?:$|[-_]|\d)")
#: Names against that hold in the second scoring too.
HARD = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|comments?|comment-\w+|disqus|respond|replies|reply|discussion|hidden)(?:$|[-_\s]|\d)", re.I)
#: Parts of names that say what a container has, lacks or is tagged with.
MODIFIER = re.compile(r"^tag[-_](?!cloud|list|links?$).*|(?:^|[-_])(?:has|have|no|not|with|without|hide|show)[-_].*|.*[-_](?:enabled|disabled)$")
#: Containers of links: at least so many, holding at least this share of the container's text.
LINKS, LINK_SHARE = 3, 0.8
#: Containers that are left out as lists of links.
LISTS = frozenset("ul ol dl div section table tbody tr td center".split())
#: Characters of text outside links that make a form the wrapper of a page.
WRAPPER = 250
#: Share of a main element's text outside links that a container must hold to stand for it.
STANDS_FOR = 0.75
#: Share of the page's text outside links below which a result is far too little.
FAR = 0.2
BASE = {"article": 25, "main": 5, "section": 3, "div": 5, "td": 3, "blockquote": 3, "body": 0}


@lru_cache(10_000)
def judged(names: str) -> tuple[bool, int]:
    """Whether names speak for a container, and how they speak against it: 0 not, 1 in the first scoring, 2 in the second too."""
    words = [x for w in names.lower().split() if (x := MODIFIER.sub("", w))]
    for_it = any(FOR.search(w) for w in words)
    if any(RESCUE.search(w) and not AGAINST.search(w) for w in words):
        return for_it, 0
    bad = [w for w in words if AGAINST.search(re.sub("widgets?", "", w) if for_it else w)]  # page builders call every part a widget
    return for_it, 0 if not bad else 2 if any(HARD.search(w) for w in bad) else 1


class Node:
    __slots__ = ("tag", "parent", "parts", "points", "drop", "named", "weight", "inner", "links", "n_links")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.parts = tag, parent, []
        self.points, self.weight, self.inner, self.links, self.n_links = 0.0, 0, 0, 0, 0
        self.drop, self.named = tag in DROPPED, 0
        if attributes and "=" in attributes and not self.drop and tag not in ("html", "body"):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            self.drop = found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
            if names != " ":
                for_it, against = judged(names)
                if against and not self.drop and not (for_it and tag in ("article", "main")):
                    self.drop, self.named = True, against
                self.weight = 25 * for_it - 50 * (self.named > 0)


def parse(page: str) -> Node:
    """The page's tree; parts of a node are strings and nodes in page order."""
    root = at = Node("#root", None)
    pos, n = 0, len(page)
    lower = None
    while pos < n:
        m = TAG.search(page, pos)
        end = m.start() if m else n
        if end > pos:
            at.parts.append(html.unescape(page[pos:end]))
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            node = at
            while node.parent and node.tag != name:
                node = node.parent
            if node.parent:
                at = node.parent
            elif name == "p":
                at.parts.append(Node("p", at))
            elif name == "br":
                at.parts.append(Node("br", at))
            continue
        if name in CLOSES_P:
            node = at
            while node.parent and node.tag != "p" and node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            node = at
            while node.parent and node.tag not in stops:
                if node.tag in ends:
                    at = node.parent
                node = node.parent
        node = Node(name, at, m[3])
        at.parts.append(node)
        if name in RAW:
            lower = lower or page.lower()
            if len(lower) != n:
                lower = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            close = lower.find("</" + name, pos)
            close = n if close < 0 else close
            if name in ("title", "textarea"):
                node.parts.append(html.unescape(page[pos:close]))
            tail = page.find(">", close)
            pos = n if tail < 0 else tail + 1
        elif name not in VOID and not (m[3].endswith("/") and name in ("svg", "path", "use")):
            at = node
    return root


def nodes_of(root: Node) -> list[Node]:
    """Kept nodes, parents before children."""
    out = [root]
    for node in out:
        out += [p for p in node.parts if type(p) is not str and not p.drop]
    return out


def is_links(node: Node) -> bool:
    """Whether a measured container is a list of links."""
    return node.tag in LISTS and node.n_links >= LINKS and node.links >= LINK_SHARE * node.inner


def pieces(root: Node) -> list[str]:
    """The blocks of text below a measured node in page order, white space collapsed, empty ones and lists of links left out."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    stack: list = [iter(root.parts)]
    blocks = [True]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            if blocks.pop():
                flush()
        elif type(part) is str:
            run.append(part)
        elif not part.drop and not is_links(part):
            block = part.tag not in INLINE
            if block:
                flush()
            stack.append(iter(part.parts))
            blocks.append(block)
    flush()
    return out


def measure(nodes: list[Node]) -> int:
    """Sets the text and link text inside nodes; the root's text outside links."""
    for node in nodes:
        node.inner = node.links = node.n_links = 0
    for node in reversed(nodes):
        node.inner += sum(len(p.strip()) for p in node.parts if type(p) is str)
        if node.tag == "a":
            node.links, node.n_links = node.inner, 1
        if node.parent:
            node.parent.inner += node.inner
            node.parent.links += node.links
            node.parent.n_links += node.n_links
    return nodes[0].inner - nodes[0].links


def main_text(page: str | None) -> str:
    """The article of a page as one line of text."""
    if not page:
        return ""
    root = parse(page)
    unwrap_forms(root)
    text = scored_text(root)
    for level in (1, 2):
        if level == 2 and text:
            break
        named = [root]
        for node in named:
            named += [p for p in node.parts if type(p) is not str and (not p.drop or 0 < p.named <= level)]
        named = [n for n in named if n.drop]
        for node in named:
            node.drop = False
        if named and (not text or len(text) < FAR * measure(nodes_of(root))):
            text = max(text, scored_text(root), key=len)
    return text


def unwrap_forms(root: Node) -> None:
    """Lets forms that hold most of the page's text be plain containers."""
    nodes = nodes_of(root)
    forms = [p for n in nodes for p in n.parts if type(p) is not str and p.tag == "form" and p.drop and not p.named]
    if forms:
        rest = measure(nodes)
        for form in forms:
            form.drop = False
            form.drop = measure(nodes_of(form)) <= max(rest, WRAPPER)


def scored_text(root: Node) -> str:
    """The best container of a tree and its kept siblings as one line of text."""
    nodes = nodes_of(root)
    own: dict[int, list[str]] = {}
    for node in nodes:  # running text goes to the nearest block
        text = [p for p in node.parts if type(p) is str]
        if text:
            block = node
            while block.tag in INLINE and block.parent:
                block = block.parent
            own.setdefault(id(block), []).extend(text)
    measure(nodes)
    scored: dict[int, Node] = {}

    def give(node: Node | None, points: float) -> None:
        while node is not None and node.tag in INLINE:
            node = node.parent
        if node is not None:
            if id(node) not in scored:
                scored[id(node)] = node
                node.points = BASE.get(node.tag, 0) + node.weight
            node.points += points

    for node in nodes:
        if id(node) in own:
            text = " ".join("".join(own[id(node)]).split())
            if text:
                density = node.links / node.inner if node.inner else 0
                points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - density)
                up = node if node.tag in ("div", "article", "section", "main", "td", "body", "#root", "html") else node.parent
                give(up, points)
                give(up.parent if up else None, points / 2)
    if not scored:
        return ""
    value = {k: v.points * (1 - (v.links / v.inner if v.inner else 0)) for k, v in scored.items()}
    best = scored[max(value, key=value.get)]
    top = best
    node = best.parent if best.tag != "article" else None
    while node is not None:  # an article's sections belong together
        if node.tag == "article" or node.tag == "main" and best.inner - best.links < STANDS_FOR * (node.inner - node.links):
            top = node
            break
        node = node.parent
    if top.parent is None or top.tag in ("article", "main", "body", "html"):
        return " ".join(pieces(top))
    limit = max(10.0, 0.2 * value[id(best)])
    out: list[str] = []
    for part in top.parent.parts:
        if part is top:
            out += pieces(top)
        elif type(part) is not str and not part.drop and not is_links(part):
            density = part.links / part.inner if part.inner else 0
            like = part.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol") and density < 0.25 and (part.inner > 80 or part.tag[0] == "h" or density == 0 and part.inner)
            if like or value.get(id(part), 0) >= limit:
                out += pieces(part)
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; one map over the rows, no shuffle."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_text(rows, "text", one, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
