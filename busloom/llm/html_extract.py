"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by link density; the container with the
best score is kept, with those of its siblings that read like text.

Names (class and id) are points too. Words that name boilerplate stand against the points of the text in the element: a name
that says nothing else outweighs any text, one among other words a good deal of it, and a word that articles use as well only
a short notice. An element that holds most of a page's text is a wrapper, whatever its name, and so is a form. Menus,
asides, footers, forms, scripts and hidden elements go by their tag or attribute; headers go outside articles. In articles
lists of links stay; elsewhere a block of short links is a menu.

A null or empty page, and a page without text, give an empty text. Pages cut off in a tag, comment or script lose only the
open construct. Repeated rows give repeated results; columns other than the three named ones are not read.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from .common import map_texts

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?]")
_ATTRS = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+(>)?""")
_HINT = re.compile(r"""(?<![^\s"'/])(?:(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(hidden)(?=[\s=/>]|$))""", re.I)

#: Fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
DROPPED = RAW | {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "option", "dialog", "fieldset", "object", "embed", "audio", "video", "canvas", "map"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCKS = {"html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "center", "details", "summary", "hgroup", "search"} | DROPPED
ENDS_P = BLOCKS
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar", "form", "status"}
#: Words in class or id that name what isn't the article, and beginnings of such words.
NOISE = {"ad", "ads", "advert", "banner", "breadcrumb", "comments", "commentlist", "consent", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navigation", "overlay", "pager", "popup", "replies", "respond", "rss", "share", "sharing", "shoutbox", "signup", "skip", "subscribe", "subscription", "toolbar", "widget"}
STEMS = ("advert", "cookie", "comment", "sidebar", "sponsor", "newsletter", "navbar", "breadcrumb", "paginat", "promo")
#: Words that name it, but parts of articles too.
DOUBTFUL = {"disclaimer", "header", "legal", "notice", "notices", "related", "remark", "reply", "social", "tags"}
#: Words about the form of an element, which say nothing of what it is.
FORM_WORDS = {"area", "block", "body", "bottom", "box", "btn", "button", "col", "container", "content", "footer", "head", "inner", "item", "items", "left", "link", "links", "list", "outer", "panel", "right", "row", "section", "text", "title", "top", "wrap", "wrapper"}
#: Words that make a name a property of something else.
OF_OTHERS = {"closed", "disabled", "enabled", "has", "no", "not", "off", "on", "open", "with", "without"}
#: Words that name an article.
GOOD = {"article", "content", "entry", "main", "post", "story"}
#: Points that a name takes: any number, those of several paragraphs, those of a short one. What a good one gives, and the share of a page's text that only wrappers hold.
ALL, SOME, FEW, GIVEN, MOST = float("inf"), 40.0, 8.0, 10.0, 0.7
#: Length of a menu's links, at most, in the mean.
MENU_LINK = 25

#: The points of a text run go up until they are less than this.
LEAST_POINTS = 0.01


class _Node:
    __slots__ = ("tag", "parent", "kids", "score", "size", "linked", "links", "commas", "points", "against", "drop")

    def __init__(self, tag: str, parent: _Node | None, against: float = 0.0, drop: bool = False) -> None:
        self.tag, self.parent, self.against, self.drop = tag, parent, against, drop
        self.kids: list = []
        self.score = self.points = 0.0
        self.size = self.linked = self.links = self.commas = 0


def _named(name: str) -> float:
    """The points that one name takes from an element, or gives (below zero)."""
    words = re.findall(r"[a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", name).lower())
    own = set(words) if words == ["footer"] else set(words) - FORM_WORDS
    if not own or own & OF_OTHERS:
        return -GIVEN if set(words) & GOOD and not set(words) & OF_OTHERS else 0.0
    noise = {w for w in own if w in NOISE or w.startswith(STEMS)}
    doubtful = own & DOUBTFUL
    if noise:
        return ALL if noise | doubtful == own else SOME * len(noise) / len(own)
    if doubtful:
        return FEW * len(doubtful) / len(own)
    return -GIVEN if own & GOOD else 0.0


def _against(attrs: str) -> tuple[float, bool]:
    """The points that class and id take from an element, and whether it is hidden or plays a part that isn't the article's."""
    points, out = 0.0, False
    for name, value, bare in _HINT.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if bare:
            out = True
        elif name in ("class", "id"):
            found = [_named(x) for x in value.split()]
            points = max([points, *found]) if points > 0 or any(x > 0 for x in found) else min([points, *found])
        elif name == "role":
            out = out or value.lower() in ROLES
        else:
            out = out or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return points, out


def _tree(page: str) -> _Node:
    """Block elements as nodes; a kid is a node, or (text, linked characters, links) of one run of inline text."""
    root = node = _Node("#", None)
    links = begun = 0
    unwanted, depth = "", 0  # the inline element whose text is left out, until it or the block ends
    open_tags: dict[str, int] = {}
    i, n = 0, len(page)
    run: list[str] = []
    linked_run: list[str] = []

    def flush() -> None:
        nonlocal begun, unwanted
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                node.kids.append((text, len(" ".join(html.unescape("".join(linked_run)).split())), begun))
            run.clear()
        linked_run.clear()
        begun, unwanted = 0, ""

    def put(s: str) -> None:
        if s and not unwanted:
            run.append(s)
            if links:
                linked_run.append(s)

    while i < n:
        m = _TOKEN.search(page, i)
        if m is None:
            put(page[i:])
            break
        if m.start() > i:
            put(page[i : m.start()])
        i = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<!--":
                end = page.find("-->", i)
                i = n if end < 0 else end + 3
            else:
                end = page.find(">", i)
                i = n if end < 0 else end + 1
            continue
        a = _ATTRS.match(page, i)
        if a[1] is None:
            end = page.find(">", i)
            if end < 0:
                break
            attrs, i = page[i:end], end + 1
        else:
            attrs, i = a[0][:-1], a.end()
        tag = tag.lower()
        if m[1]:
            if tag == unwanted:
                depth -= 1
                if not depth:
                    unwanted = ""
            if tag == "a":
                links = max(0, links - 1)
            elif open_tags.get(tag):
                flush()
                while node.tag != tag:
                    open_tags[node.tag] -= 1
                    node = node.parent
                open_tags[tag] -= 1
                node = node.parent
                links = 0
            continue
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, i)
            if end is None:
                break
            close = page.find(">", end.end())
            i = n if close < 0 else close + 1
            if tag not in ("svg", "math"):
                put(" ")
            continue
        if tag == "br" or tag == "hr" or tag in ("td", "th"):
            put(" ")
        against, out = _against(attrs) if attrs and tag not in ("html", "body") else (0.0, False)
        if tag not in BLOCKS:
            if tag == unwanted:
                depth += 1
            elif not unwanted and (out or against == ALL) and tag not in VOID and not attrs.rstrip().endswith("/"):
                unwanted, depth = tag, 1
            if tag == "a":
                links = 1
                begun += 1
            continue
        flush()
        links = 0
        if tag in ENDS_P:
            while node.tag == "p":
                open_tags["p"] -= 1
                node = node.parent
        if node.tag == "head":  # its end tag may be left out
            open_tags["head"] -= 1
            node = node.parent
        if tag == node.tag == "li":
            open_tags["li"] -= 1
            node = node.parent
        if tag in VOID or attrs.rstrip().endswith("/"):
            continue
        out = out or tag in DROPPED and not (tag == "header" and open_tags.get("article"))
        child = _Node(tag, node, against, out)
        node.kids.append(child)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        node = child
    flush()
    return root


def _order(root: _Node, dropped: bool) -> list[_Node]:
    """Nodes, parents first; with those that are dropped, or without."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.drop and not dropped:
            continue
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, _Node))
    return out


def _points(text: str, linked: int) -> tuple[float, int]:
    size, commas = len(text), text.count(",") + text.count("，") + text.count("、")
    return (1 + commas + min(size / 100, 3)) * (1 - linked / size), commas


def _weigh(root: _Node) -> None:
    """Set the names against the text of their elements: what has too little goes, but wrappers stay."""
    nodes = _order(root, True)
    for node in nodes:
        for kid in node.kids:
            if isinstance(kid, tuple):
                node.points += _points(kid[0], kid[1])[0]
                node.size += len(kid[0])
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.points += node.points
            node.parent.size += node.size
    whole = root.size
    for node in nodes:
        wraps = whole and node.size >= MOST * whole
        if node.drop:
            node.drop = not (wraps and node.tag in ("form", "fieldset"))
        elif node.against > 0 and node.tag != "main":
            least = FEW if node.tag == "article" and node.against < ALL else node.against
            node.drop = not wraps and node.points < least
    for node in nodes:
        node.points, node.size = 0.0, 0


def _score(nodes: list[_Node]) -> None:
    """Points of text runs go to the ancestors: whole to the parent, half and then less further up."""
    for node in nodes:
        for kid in node.kids:
            if isinstance(kid, tuple):
                text, linked, links = kid
                points, commas = _points(text, linked)
                node.size += len(text)
                node.linked += linked
                node.links += links
                node.commas += commas
                up, share = (node.parent if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "td", "blockquote") and node.parent is not None else node), 1.0
                depth = 0
                while up is not None and abs(points) * share >= LEAST_POINTS:
                    up.score += points * share
                    share = 0.5 if depth == 0 else share * depth / (depth + 1.5)
                    depth += 1
                    up = up.parent
    for node in reversed(nodes):  # parents stand before their kids
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.links += node.links
            node.parent.commas += node.commas
        node.score *= 1 - (node.linked / node.size if node.size else 0)
        node.score -= min(node.against, SOME)


#: What the tag of a container adds, in points.
BONUS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 2.0, "blockquote": 1.0, "ul": -3.0, "ol": -3.0, "table": -3.0, "html": -10.0, "body": -5.0, "#": -10.0}


def _emit(node: _Node, out: list[str], article: bool) -> None:
    """The text runs under a node in page order. Outside articles blocks of short links are menus."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif not x.drop and (article or not (x.tag in ("ul", "ol", "dl", "div", "section", "table") and x.linked > 0.6 * x.size and x.linked <= MENU_LINK * x.links)):
            stack.extend(reversed(x.kids))


def _sentences(node: _Node) -> bool:
    """Whether each of a container's blocks is a paragraph that ends like a sentence."""
    kids = [k for k in node.kids if isinstance(k, tuple) or not k.drop]
    ends = (".", "!", "?", "\u3002", "\u2026", "\u201d", '"')
    return bool(kids) and all(isinstance(k, _Node) and k.tag == "p" and k.kids and isinstance(k.kids[-1], tuple) and k.kids[-1][0].endswith(ends) for k in kids)


def extract(page: str | None) -> str:
    """The blocks of the main text, joined by newlines."""
    if not page:
        return ""
    root = _tree(page)
    _weigh(root)
    nodes = _order(root, False)
    _score(nodes)
    full = [x for x in nodes if x.size and x.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr", "header")]
    if not full:
        return ""
    best = max(full, key=lambda x: x.score + BONUS.get(x.tag, 0.0))
    up = best
    while up.parent is not None:  # a part of an article is not the whole of it
        up = up.parent
        if up.tag == "article" or up.tag == "main" and best.tag != "article" or up.parent is not None and up.tag not in ("body", "html") and up.size and best.size < 0.5 * up.size and up.linked < 0.3 * up.size:
            best = up
    inside = best
    while inside is not None and inside.tag != "article":
        inside = inside.parent
    out: list[str] = []
    if best.parent is None:
        _emit(best, out, False)
        return "\n".join(out)
    least = max(10.0, 0.2 * (best.score + BONUS.get(best.tag, 0.0)))
    for kid in best.parent.kids:
        if kid is best:
            _emit(kid, out, inside is not None)
        elif isinstance(kid, _Node) and not kid.drop and kid.size:
            share = kid.linked / kid.size
            reads = kid.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and share < 0.25 and best.tag not in ("article", "main")
            told = kid.tag in ("div", "section") and best.parent.tag not in ("body", "html", "#") and not kid.linked and _sentences(kid)
            second = kid.tag == best.tag == "article" and share < 0.25 and kid.score >= 0.2 * best.score
            if reads or told or second or kid.tag == best.tag and kid.score + BONUS.get(kid.tag, 0.0) >= least and share < 0.25 and kid.commas > 2:
                _emit(kid, out, kid.tag == "article")
    return "\n".join(out)


def extract_main_text(df: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keys, text and n_chars (code points) of each row of df. One pass, no shuffle."""

    def make():
        def apply(pages: list) -> list:
            texts = [extract(p) for p in pages]
            return [texts, [len(t) for t in texts]]

        return apply

    return map_texts(df, keys, html_col, make, "text string, n_chars bigint")
