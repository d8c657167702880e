"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree: block elements, and under them their runs of text. Every node has a hidden
label, content or not. A node's tag, names and text give its own potential; a parent and a child share a
potential. Sum-product messages go up and down the tree once, which gives each node's exact marginal; the
runs of text whose marginal says content are the page's text. Potentials are counts over labelled pages.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are never text of the page.
UNSEEN = frozenset("script style noscript template iframe object svg math canvas head title audio video".split())
#: Elements whose contents run up to their end tag, whatever stands in them.
RAW = frozenset("script style noscript iframe title textarea xmp".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike
    strong sub sup time tt u var wbr br img ruby rt rp""".split())  # fmt: skip
#: Elements that a start tag of the key closes when they are open, up to one of the others.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A start tag as it should be; any other is read piece by piece.
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+)\s*+/?>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?+""")
_NAME = re.compile(r"[^\s/>]+")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_BARE = re.compile(r"[^\s>]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Attributes that tell what an element is.
TELLING = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "data-main"))

#: Kinds of names in class, id and role; the first kind that has one of a node's names is the node's.
NAME_KINDS = {
    "comment": "comment comments reply replies disqus discussion respond",
    "ad": "ad ads adv advert adverts advertisement advertorial sponsor sponsored promo promotion banner adsense doubleclick",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toolbar skip toc",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall toast privacy",
    "side": "sidebar side aside related rail widget widgets recommended recommendations popular trending complementary more",
    "foot": "footer foot copyright colophon legal contentinfo bottom",
    "head": "header head masthead topbar logo site banner top",
    "share": "share sharing social follow byline meta tags author",
    "form": "form login search comment-form contact register",
    "main": "article content post entry story main body text page",
}
_KIND = {w: k for k, words in reversed(NAME_KINDS.items()) for w in words.split()}
_RANK = {k: i for i, k in enumerate(NAME_KINDS)}
TAG_GROUPS = {
    "article": "article", "main": "main", "nav": "nav", "menu": "nav", "aside": "aside", "footer": "footer", "header": "header",
    "form": "form", "button": "form", "select": "form", "option": "form", "textarea": "form", "fieldset": "form", "dialog": "form",
    "p": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "cell",
    "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "body": "body", "html": "body", "div": "div", "section": "section", "address": "address", "hr": "div",
}


@dataclass
class Node:
    """A block element, or a run of text (``tag`` '') of its parent. Parents come before their children."""

    parent: int
    tag: str
    kind: str = "none"
    text: list[str] = field(default_factory=list)
    linked: int = 0
    label: int = -1

    def words(self) -> str:
        return " ".join("".join(self.text).split())


def _kind_of(attributes: list[tuple[str, str]]) -> str:
    best = None
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return "hidden"
        if name == "style" or name not in TELLING:
            continue
        for part in _PART.findall(value):
            k = _KIND.get(part.lower())
            if k and (best is None or _RANK[k] < _RANK[best]):
                best = k
    return best or "none"


class Tokens:
    """The page from left to right: texts, and tags as (name, attributes, closing, self-closing). Every character is passed once, but for looking ahead to the next quote of a kind."""

    def __init__(self, page: str):
        self.page, self.size, self.at = page, len(page), 0
        self._none: set[str] = set()  # quotes that don't occur any more

    def _quote(self, mark: str, at: int) -> int:
        if mark in self._none:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self._none.add(mark)
        return found

    def _beyond(self, text: str, at: int) -> int:
        """The place behind the next ``text``, else the page's end."""
        found = self.page.find(text, at)
        return self.size if found < 0 else found + len(text)

    def _odd_tag(self, at: int) -> tuple[list[tuple[str, str]], int] | None:
        """Attributes from ``at`` and the place behind the tag; None if the page ends inside.

        An unquoted value runs to white space or '>', whatever quotes it has. A quoted one that is never closed, or whose
        closing quote runs into more text and has another tag inside, was left open: it ends at its first '>'.
        """
        page, out = self.page, []
        while True:
            at = _SPACE.match(page, at).end()
            if at >= self.size:
                return None
            if page[at] == ">":
                return out, at + 1
            key = _KEY.match(page, at)
            name, at = key[0].lower(), max(key.end(), at + 1)
            eq = _SPACE.match(page, at).end() if page[at : at + 1].isspace() else at
            if page[eq : eq + 1] != "=":
                out.append((name, ""))
                continue
            at = eq + 1
            while at < self.size and page[at].isspace():
                at += 1
            mark = page[at : at + 1]
            if mark not in ('"', "'") or not mark:
                value = _BARE.match(page, at)
                out.append((name, value[0]))
                at = value.end()
                continue
            end = self._quote(mark, at + 1)
            first = page.find(">", at + 1, end if end >= 0 else self.size)
            after = page[end + 1 : end + 2]
            if end < 0 or first >= 0 and after and not after.isspace() and after not in "/>" and "<" in page[first:end]:
                if first < 0:
                    return None
                out.append((name, page[at + 1 : first]))
                return out, first + 1
            out.append((name, page[at + 1 : end]))
            at = end + 1

    def __iter__(self) -> Iterator[str | tuple[str, list[tuple[str, str]], bool, bool]]:
        page = self.page
        while self.at < self.size:
            start = page.find("<", self.at)
            if start < 0:
                yield page[self.at :]
                return
            if start > self.at:
                yield page[self.at : start]
            follows = page[start + 1 : start + 2]
            if follows.isascii() and follows.isalpha():
                good = _TAG.match(page, start)
                if good:
                    self.at = good.end()
                    held = [(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")) for m in _ATTRIBUTE.finditer(good[2])] if good[2] else []
                    yield good[1].lower(), held, False, page[self.at - 2] == "/"
                    continue
                name = _NAME.match(page, start + 1)
                found = self._odd_tag(name.end())
                if found is None:  # the page ends inside a tag
                    self.at = self.size
                    return
                self.at = found[1]
                yield name[0].lower(), found[0], False, page[self.at - 2] == "/"
            elif follows == "/" and page[start + 2 : start + 3].isascii() and page[start + 2 : start + 3].isalpha():
                name = _NAME.match(page, start + 2)
                self.at = self._beyond(">", name.end())
                yield name[0].lower(), [], True, False
            elif page.startswith("<!--", start):
                short = next((t for t in ("<!-->", "<!--->") if page.startswith(t, start)), None)
                self.at = start + len(short) if short else self._beyond("-->", start + 4)
            elif follows and follows in "!?/":
                self.at = self._beyond(">", start + 2)
            else:  # a sign of its own
                self.at = start + 1
                yield "<"

    def raw(self, tag: str) -> str:
        """What stands before the element's end tag, which is passed; all the rest without one."""
        begin = self.at
        end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(self.page, begin)
        self.at = self._beyond(">", end.end()) if end else self.size
        return self.page[begin : end.start() if end else self.size]


class Open:
    """The open elements, innermost last: of each the tag, its nearest block's node, and the place of the nearest element that is no inline one."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = [("html", 0, 0)]
        self.places: dict[str, list[int]] = {"html": [0]}

    def push(self, tag: str, block: int) -> None:
        k = len(self.stack)
        self.stack.append((tag, block, self.stack[-1][2] if tag in INLINE else k))
        self.places.setdefault(tag, []).append(k)

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.places[tag].pop()
        return tag

    def last(self, tags) -> int:
        """The place of the innermost open element of one of the tags but the page itself, else 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def outermost(self, tags, above: int) -> int:
        """The place of the outermost open element of one of the tags above a place, else 0."""
        found = []
        for t in tags:
            places = self.places.get(t, ())
            k = bisect.bisect_right(places, above)
            if k < len(places):
                found.append(places[k])
        return min(found, default=0)


def parse(page: str) -> list[Node]:
    """The page's tree as a list, in time linear in the page. Missing end tags are implied, unmatched ones ignored; no page is refused, and no tag becomes text."""
    nodes, open_ = [Node(-1, "html")], Open()
    stack = open_.stack
    run, links, unseen = -1, 0, 0
    tokens = Tokens(page)

    def say(text: str) -> None:
        nonlocal run
        if unseen or not text:
            return
        if run < 0:
            if text.isspace():
                return
            nodes.append(Node(stack[-1][1], ""))
            run = len(nodes) - 1
        nodes[run].text.append(text)
        if links:
            nodes[run].linked += len(text)

    def close(k: int) -> None:
        nonlocal run, links, unseen
        while len(stack) > max(k, 1):
            tag = open_.pop()
            links -= tag == "a"
            unseen -= tag in UNSEEN
            if tag not in INLINE:
                run = -1

    for token in tokens:
        if isinstance(token, str):
            say(html.unescape(token))
            continue
        tag, attributes, closing, empty = token
        if closing:
            if tag == "br":
                say(" ")
            k = open_.last(HEADINGS if tag in HEADINGS else (tag,))  # any heading's end tag ends a heading
            if k:
                close(k)
            continue
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                say(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                k = open_.last(("a",))
                if k > stack[-1][2]:
                    close(k)
                links += 1
            open_.push(tag, stack[-1][1])
            continue
        if tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            found = open_.outermost(same, open_.last(stop))
            if found:
                close(found)
        elif tag not in VOID and tag not in UNSEEN and stack[stack[-1][2]][0] == "p":
            close(stack[-1][2])
        run = -1
        if tag in VOID:
            continue
        if tag in ("html", "body"):
            nodes[0].kind = _kind_of(attributes) if nodes[0].kind == "none" else nodes[0].kind
            if open_.places.get(tag):
                continue
        if tag in RAW:
            inside = tokens.raw(tag)
            if tag == "textarea" and not unseen:
                nodes.append(Node(stack[-1][1], tag, _kind_of(attributes)))
                nodes.append(Node(len(nodes) - 1, "", text=[html.unescape(inside)]))
            continue
        if empty and tag in UNSEEN:
            continue
        if tag in UNSEEN:
            unseen += 1
            open_.push(tag, stack[-1][1])
            continue
        node = Node(stack[-1][1], tag, _kind_of(attributes) if attributes else "none")
        node.label = next((int(v) for n, v in attributes if n == "data-main" and v in ("0", "1")), -1)
        nodes.append(node)
        open_.push(tag, len(nodes) - 1)
    return nodes


def features(node: Node, parent: Node | None) -> tuple[str, ...]:
    """What a node shows of itself."""
    if node.tag:
        return (f"name {node.kind}",)
    text = node.words()
    n, chars = text.count(" ") + 1, max(1, len("".join(node.text)))
    density = node.linked / chars
    return (
        f"in {TAG_GROUPS.get(parent.tag, 'other')}",
        "words " + ("1" if n < 3 else "3" if n < 8 else "8" if n < 20 else "20"),
        "links " + ("0" if not node.linked else "some" if density < 0.4 else "most" if density < 0.8 else "all"),
        "stop " + ("1" if text[-1:] in ".!?…:;\"”»)" else "0"),
    )


def edge(node: Node, parent: Node) -> str:
    """What the potential of a parent and a child depends on: the child's tag, and whether the parent is the page itself."""
    return f"{TAG_GROUPS.get(node.tag, 'other') if node.tag else 'text'} {'page' if parent.tag in ('html', 'body') else 'block'}"


@dataclass
class Potentials:
    """own: feature -> log-odds of content; child[edge][p][c]: probability of label c under a parent of label p; root: of content."""

    own: dict[str, float]
    child: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    root: float

    def between(self, node: Node, parent: Node) -> tuple[tuple[float, float], tuple[float, float]]:
        return self.child.get(edge(node, parent)) or self.child[""]


def marginals(nodes: list[Node], potentials: Potentials) -> list[float]:
    """Probability that each node is content, by sum-product up and down the tree."""
    n = len(nodes)
    own, between = [], [((1.0, 0.0), (0.0, 1.0))]
    for node in nodes[1:]:
        between.append(potentials.between(node, nodes[node.parent]))
    for node in nodes:
        s = 0.0
        for f in features(node, nodes[node.parent] if node.parent >= 0 else None):
            s += potentials.own.get(f, 0.0)
        own.append(math.exp(max(-60.0, min(60.0, s))))
    # beliefs below a node as ratios content : not; messages to the parent likewise
    below, up = own[:], [1.0] * n
    for i in range(n - 1, 0, -1):
        r = below[i]
        (a, b), (c, d) = between[i]
        up[i] = (c + d * r) / (a + b * r)
        p = nodes[i].parent
        below[p] = max(1e-150, min(1e150, below[p] * up[i]))
    out = [0.0] * n
    root = potentials.root / (1 - potentials.root)
    ratio = [1.0] * n
    ratio[0] = min(1e150, below[0] * root)
    for i in range(1, n):
        (a, b), (c, d) = between[i]
        rest = max(1e-150, min(1e150, ratio[nodes[i].parent] / up[i]))  # the parent's belief without this child
        down = (b + d * rest) / (a + c * rest)
        ratio[i] = max(1e-150, min(1e150, below[i] * down))
    for i in range(n):
        out[i] = ratio[i] / (1 + ratio[i])
    return out


def fit(pages: list[str], smooth: float = 0.5) -> Potentials:
    """Potentials from labelled pages: an element's ``data-main`` labels it and what is below, up to another mark; unmarked: not content."""
    own: dict[str, list[float]] = {}
    moves: dict[str, list[list[float]]] = {}
    for page in pages:
        nodes = parse(page)
        for i, node in enumerate(nodes):
            if node.label < 0:
                node.label = nodes[node.parent].label if i else 0
            for key in (edge(node, nodes[node.parent]), "") if i else ():
                moves.setdefault(key, [[smooth, smooth], [smooth, smooth]])[nodes[node.parent].label][node.label] += 1
            for f in features(node, nodes[node.parent] if i else None):
                own.setdefault(f, [0.0, 0.0])[node.label] += 1
    groups: dict[str, list[float]] = {}
    kinds: dict[str, int] = {}
    for f, n in own.items():
        g = groups.setdefault(f.split(" ")[0], [0.0, 0.0])
        g[0], g[1] = g[0] + n[0], g[1] + n[1]
        kinds[f.split(" ")[0]] = kinds.get(f.split(" ")[0], 0) + 1
    log = {}
    for f, n in own.items():
        g, k = groups[f.split(" ")[0]], kinds[f.split(" ")[0]]
        log[f] = math.log((n[1] + smooth) / (g[1] + k * smooth)) - math.log((n[0] + smooth) / (g[0] + k * smooth))
    child = {key: tuple(tuple(x / sum(row) for x in row) for row in table) for key, table in moves.items()}
    return Potentials(log, child, 0.02)


#: Names as sites give them to their parts. They are written without regard to NAME_KINDS: some have none of its words, some
#: have a word of another kind, and neutral ones stand on any part. Training takes every second one, tests the others.
SITE_NAMES = {
    "nav": "site-navigation primary-menu topnav breadcrumb-trail navbar-nav pager-links jump-links subnav mega_menu menuItems tabStrip mainNav bc-path prev-next sitemap-links hamburger",
    "ad": "ad-slot advert-box dfp-unit leaderboard-ad sponsored-content google_ads_frame promoBox banner-300x250 outbrain adWrapper partner-offer AdUnit taboola-below paid-post",
    "notice": "cookie-banner gdpr-consent newsletter-box paywall-message alert-bar onetrust modalDialog signup-prompt toast-msg privacy-note subscribe-cta popup-overlay breaking-bar ribbon",
    "side": "sidebar-right widget-area related-posts most-popular rail-right trending-now more-stories recommendedReading col-side secondary also-like latest-news read-next sideColumn",
    "foot": "site-footer colophon footer-widgets copyright-line pageFooter bottom-bar legal-links ft-wrap imprint credits footerInner sub-footer",
    "head": "site-header masthead top-bar page-header logo-area branding hdr headerTop global-head topbar-inner hero-strip title-bar",
    "comment": "comments-area disqus_thread comment-list user-comments discussion-thread responses commentBody reply-list talkback reader-opinions respond-form feedback-posts",
    "share": "share-buttons social-links post-meta author-bio byline-box entry-meta tag-list sharedaddy followUs addthis_toolbox meta-data shareBar",
    "form": "search-form login-box contact-form wpcf7 searchbox registerForm comment-form poll-widget quick-search form-inline",
    "main": "entry-content article-body post-content story-body main-content td-post mw-parser-output blog-post markdown-body single-post storytext articleText prose content-area page-content news-body",
    "any": "container row col-md-8 wrap inner clearfix grid-x layout-2 section block_4 module cell js-root u-mb-2",
}


def labelled_pages(n: int = 600, seed: int = 7, half: int = 0) -> list[str]:
    """Labelled pages made from a grammar of common page layouts (no page of any corpus is used), with every second of SITE_NAMES, from ``half`` (0 or 1) on."""
    rnd = random.Random(seed)
    letters = "etaoinshrdlucmfwygpbvk"

    def word() -> str:
        return "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(a, b)))

    def sentence() -> str:
        return words(1, 24).capitalize() + rnd.choice("....!?")

    def para() -> str:
        body = " ".join(sentence() for _ in range(rnd.choice((1, 1, 1, 2, 3, 5))))
        if rnd.random() < 0.2:
            body = words(1, 6)
        if rnd.random() < 0.2:
            body += f' <a href="/{word()}">{words(1, 4)}</a> {words(1, 9)}.'
        return f"<p>{body}</p>"

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def name(kind: str) -> str:
        return rnd.choice(SITE_NAMES[kind].split()[half::2])

    def attr(kind: str) -> str:
        return rnd.choice((f' class="{name(kind)}"', f' id="{name(kind)}"', f' class="{word()} {name(kind)}"', f' class="{name("any")} {name(kind)}"', f" class='{name(kind)}' data-x=\"{word()}\""))

    def block() -> str:
        return rnd.choice((
            para, para, para, para, lambda: "<h{0}>{1}</h{0}>".format(rnd.randint(2, 4), words(2, 7)), lambda: f"<blockquote><p>{sentence()}</p></blockquote>",
            lambda: "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>",
            lambda: "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rnd.randint(2, 4))) + "</table>",
            lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>", lambda: f"<pre>{words(3, 20)}</pre>",
        ))()

    def other() -> str:
        kind = rnd.choice(("nav", "ad", "side", "foot", "head", "notice", "comment", "share", "form"))
        inside = {
            "nav": lambda: links(rnd.randint(3, 9)), "ad": lambda: rnd.choice((sentence(), f'<a href="/x">{words(2, 8)}</a>', para(), block())),
            "side": lambda: f"<h3>{words(1, 3)}</h3>" + rnd.choice((links(rnd.randint(2, 6)), para(), block())), "foot": lambda: f"<p>&copy; {words(2, 10)}.</p>" + rnd.choice(("", links(3))),
            "head": lambda: f"<h1>{words(1, 3)}</h1>" + rnd.choice(("", links(3), f"<p>{sentence()}</p>")), "notice": lambda: rnd.choice((sentence(), f"<p>{sentence()} {sentence()}</p>")) + rnd.choice(("", "<button>ok</button>")),
            "comment": lambda: "".join(f"<div{rnd.choice(('', attr('comment')))}><b>{word()}</b>{para()}</div>" for _ in range(rnd.randint(1, 4))),
            "share": lambda: rnd.choice((links(3), words(1, 4))), "form": lambda: f"<label>{words(1, 3)}</label><input><textarea></textarea><button>{word()}</button>",
        }[kind]()
        tag = {"nav": "nav", "side": "aside", "foot": "footer", "head": "header", "form": "form"}.get(kind)
        if tag and rnd.random() < 0.6:
            return f"<{tag}{rnd.choice(('', attr(kind)))}>{inside}</{tag}>"
        tag = rnd.choice(("div", "section", "div"))
        if rnd.random() < 0.3:
            inside = f"<div{attr('any')}>{inside}</div>"
        return f"<{tag}{attr(kind)}>{inside}</{tag}>"

    pages = []
    for _ in range(n):
        blocks = [f"<h1>{words(3, 9)}</h1>", *(block() for _ in range(rnd.randint(2, 14)))]
        blocks = [f"<div{attr('any')}>{b}</div>" if rnd.random() < 0.05 else b for b in blocks]
        for _ in range(rnd.choice((0, 0, 1, 2))):
            blocks.insert(rnd.randint(1, len(blocks)), other().replace(">", ' data-main="0">', 1))
        tag = rnd.choice((("article", ""), ("article", ""), ("article", attr("main")), ("main", ""), ("div", attr("main")), ("section", attr("main"))))
        body = f'<{tag[0]}{tag[1]} data-main="1">{"".join(blocks)}</{tag[0]}>'
        if rnd.random() < 0.08:  # no container at all
            body = "".join(b if 'data-main="0"' in b[:120] else b.replace(">", ' data-main="1">', 1) for b in blocks)
        elif rnd.random() < 0.3:
            body = f"<{rnd.choice(('main', 'div', 'div'))}>{body}{rnd.choice(('', other()))}</div>"
        before, after = [other() for _ in range(rnd.randint(1, 4))], [other() for _ in range(rnd.randint(1, 4))]
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    return pages


@functools.lru_cache(maxsize=1)
def trained() -> Potentials:
    return fit(labelled_pages())


def main_text(page: str, potentials: Potentials) -> str:
    """Text runs whose marginal says content, white space collapsed, in page order, a blank line between."""
    nodes = parse(page)
    shown = (node.words() for node, p in zip(nodes, marginals(nodes, potentials), strict=True) if not node.tag and p > 0.5)
    return "\n\n".join(t for t in shown if t)


def extract_pages(pages: DataFrame, potentials: Potentials | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, ``text`` (empty if a page has none) and ``n_chars`` of every page.

    Whole pages are parsed where they are read; nothing is shuffled. Null html is an empty page. Repeated
    rows, null ids and urls pass through; other columns are not read. An empty table gives no rows.
    """
    potentials = potentials or trained()
    form = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, potentials) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=form.names)

    return pages.select(F.col(id_col), F.col(url_col), F.coalesce(F.col(html_col).cast("string"), F.lit(""))).mapInArrow(extract, form)
