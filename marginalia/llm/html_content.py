"""Main text of HTML pages by a tree-structured graphical model over the DOM.

A page is parsed into block elements and the pieces of text in them; inline markup is transparent. Each node has a
hidden label, content or not. A node's own score comes from its tag, the words of its class, id and role, the text below
it, and for text from its length, its share of link text and its sentence marks; an edge's score depends on the labels of
parent and child and on the kind of edge. Sum-product messages go from the leaves to the root and back, which gives every
node's exact marginal (the graph is a tree); text whose marginal is above one half is main text.

A name tells an element's purpose for sure only if all its words do ("site-footer"); a name that merely holds such a
word ("related-work") is a hint, whose weight is learned apart.

Edge scores (smoothed log shares) and node scores (by the gradient of the whole model's likelihood) are trained on
labelled pages when the module is first used. The labelled pages are built here from layouts whose parts are known, with
seeded choices: with and without semantic tags, with names that tell, mislead or are missing.

Parsing takes time in proportion to the page, whatever it holds: the page is read once from left to right, nothing is
tried twice from another place, and open elements are found by lists of their positions, not by walking the stack.

Defined results: null or empty html gives empty text. Character references are decoded, white space inside a block
becomes one space, blocks are joined by a newline in page order. Rows are independent: repeated rows repeat, extra
columns are ignored, an empty table gives an empty one. Unclosed and stray tags are mended as browsers do for blocks; a
tag, comment or script that the page ends within is dropped, as browsers do.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .shared import map_columns

# Fixed values of the HTML standard: elements by how they take part in blocks.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their contents are no markup: they end at their own end tag only, or with the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Their contents aren't shown, or are shown only where something else isn't.
UNSEEN = frozenset("noscript template select datalist annotation annotation-xml".split())
BLOCK = frozenset(
    """html body article section main div p h1 h2 h3 h4 h5 h6 nav header footer aside form fieldset ul ol li dl dt dd
    table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary dialog menu hr center
    button label legend""".split()
)
#: A start tag closes these open elements first, with all that is open in them.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"),
}
#: Closing by a start tag, and by the end tags of p and li, does not reach past these.
WALLS = frozenset("ul ol dl menu table article section main body html nav aside div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that hold running text or parts of lists and tables; the other block elements frame a page's parts.
FLOW = frozenset(
    """p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption
    details summary address""".split()
)

#: The least probability of an edge's labels, so that no number of children can prove what each of them only suggests.
RARE = 0.02

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name: its end, or an attribute with its value. A value in quotes that don't end matches none of it.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+)""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: How a copyright line starts.
RIGHTS = re.compile(r"©|\(c\)|copyright\b", re.I)
SPACES = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words of class, id and role that tell what an element is for, by purpose.
PURPOSES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc sitemap tabs",
    "ad": "ad ads advert adverts advertisement banner promo promotion sponsor sponsored teaser outbrain taboola",
    "foot": "footer foot copyright colophon legal imprint contentinfo",
    "head": "header masthead topbar logo brand toolbar",
    "side": "sidebar side aside widget related recommended recommendations complementary trending share social tags",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall disclaimer",
    "reply": "comment comments reply replies respond disqus discussion reader reviews",
    "form": "form search login signup signin register contact",
    "body": "article content post entry story main text body prose",
}
PURPOSE_OF = {word: purpose for purpose, words in PURPOSES.items() for word in words.split()}
#: Words that say where or how large a part is, not what it is for.
NEUTRAL = frozenset(
    """site page container wrapper wrap box section area block inner outer list item items bar top bottom left right col
    column row panel region group holder zone slot unit posts links stories entries title small large global sticky fixed
    primary secondary module component js id""".split()
)


class Node:
    __slots__ = ("parent", "tag", "names", "text", "link")

    def __init__(self, parent: int, tag: str, names: tuple, text: str = "", link: int = 0):
        self.parent, self.tag, self.names, self.text, self.link = parent, tag, names, text, link


@lru_cache(maxsize=4096)
def purposes(value: str) -> tuple[str, ...]:
    """What the names in a class, id or role say: "sure:" or "hint:" and a purpose, or "none"."""
    out = []
    for token in value.split():
        words = WORDS.findall(CAMEL.sub("-", token).lower())
        told = {PURPOSE_OF[w] for w in words if w in PURPOSE_OF}
        if len(told) > 1:
            told.discard("body")  # "article-comments" are comments
        sure = all(w in PURPOSE_OF or w in NEUTRAL for w in words)
        out += [("sure:" if sure else "hint:") + purpose for purpose in sorted(told)] or ["none"]
    return tuple(out)


class _Open:
    """The open block elements: a stack, and for each tag and for all walls the places in it, so nothing is searched."""

    def __init__(self) -> None:
        self.stack = [(0, "html")]
        self.at: dict[str, list[int]] = {"html": [0]}
        self.walls = [0]

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((node, tag))

    def cut(self, place: int) -> None:
        """Close the element at this place and all in it."""
        while len(self.stack) > place:
            _, tag = self.stack.pop()
            self.at[tag].pop()
            if tag in WALLS:
                self.walls.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)


def _attributes(page: str, at: int) -> tuple[int, list[tuple[str, str]]]:
    """Where the tag ends whose name ends at ``at`` (-1: with the page), and its attributes."""
    out, size = [], len(page)
    while at < size:
        m = ATTRIBUTE.match(page, at)
        if m[1]:
            return m.end(), out
        if m.end() == at:
            break
        if m[2] and page.startswith(("=", " =", "\n=", "\t="), m.end()):
            break  # a value whose quotes don't end
        if m[2]:
            out.append((m[2].lower(), m[3] or m[4] or m[5] or ""))
        at = m.end()
    return -1, out


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A)


def parse(page: str) -> list[Node]:
    """Block elements and texts (tag "#text") in page order; a node's parent comes before it."""
    nodes = [Node(-1, "html", ())]
    opened = _Open()
    piece: list[str] = []
    link_chars, in_link, at, size = 0, False, 0, len(page)
    unseen, depth = "", 0  # the element whose contents aren't shown, and how many of it are open
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal link_chars
        if piece:
            text = SPACES.sub(" ", "".join(piece)).strip()
            if text:
                nodes.append(Node(opened.stack[-1][0], "#text", (), text, min(link_chars, len(text))))
            piece.clear()
        link_chars = 0

    def say(text: str) -> None:
        nonlocal link_chars
        if not unseen:
            text = html.unescape(text) if "&" in text else text
            piece.append(text)
            if in_link:
                link_chars += len(text.strip())

    def skip(end: int, length: int) -> int:
        return size if end < 0 else end + length

    def ended(tag: str) -> int:
        """Where the page's last end tag of this kind starts; looked up once."""
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in _end_of(tag).finditer(page)), default=-1)
        return last_end[tag]

    while at < size:
        start = page.find("<", at)
        if start != at:
            say(page[at : start if start >= 0 else size])
        if start < 0:
            break
        follows = page[start + 1 : start + 2]
        closing = follows == "/"
        name = TAG_NAME.match(page, start + 1 + closing)
        if not name:
            if follows == "!" or follows == "?" or closing:
                if page.startswith("<!--", start):
                    # "<!-->" and "<!--->" are comments too
                    at = skip(page.find("-->", start + 2), 3)
                else:
                    at = skip(page.find(">", start), 1)
            else:
                say("<")
                at = start + 1
            continue
        tag = name[0].lower()
        at, attributes = _attributes(page, name.end())
        if at < 0:
            break  # the page ends within the tag
        if tag in RAW and not closing:
            end = _end_of(tag).search(page, at)
            at = end.start() if end else size
            continue
        if unseen:
            if tag == unseen:
                depth += -1 if closing else 1
                unseen = unseen if depth else ""
            continue
        if tag in UNSEEN:
            if not closing and ended(tag) >= at:
                unseen, depth = tag, 1
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            piece.append(" ")
        elif tag in BLOCK:
            flush()
            in_link = False
            if closing:
                place = opened.last(tag)
                if place > 0 and (tag not in ("p", "li") or place >= opened.walls[-1]):
                    opened.cut(place)
                continue
            if opened.stack[-1][1] == "p" or opened.stack[-1][1] in HEADINGS:
                opened.cut(len(opened.stack) - 1)
            place = opened.last(*CLOSES.get(tag, ()))
            if place > opened.walls[-1]:
                opened.cut(place)
            if tag in ("html", "body") or tag in VOID:
                continue
            names: list[str] = []
            for key, value in attributes:
                if key in ("class", "id", "role"):
                    names += purposes(value)
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
                    names.append("#hidden")
            nodes.append(Node(opened.stack[-1][0], tag, tuple(sorted(set(names)))))
            opened.push(len(nodes) - 1, tag)
    flush()
    return nodes


def element_features(tag: str, names: tuple, paragraphs: int, links: int, chars: int, inside: bool, largest: bool) -> list[str]:
    """``paragraphs``: below the element, 3 for more; ``links``: tenths of the text below that are link text; ``chars``: how
    much text, in steps; ``inside``: the frame around it is an article or main part; ``largest``: an article that has half of
    the text of all the page's articles at least."""
    out = {("in:" if inside and tag in FLOW else "tag:") + tag}
    for word in names:
        out.add("hidden" if word == "#hidden" else "name:" + word)
    if largest:
        out.add("largest article")
    elif tag not in FLOW:
        out.add(f"paragraphs:{paragraphs}")
        out.add("links:" + ("all" if links > 7 else "some" if links > 2 else "few"))
        out.add(f"chars:{chars}")
        if not any(word.startswith("sure:") for word in names):
            out.add(f"unnamed {tag}:{chars}")
    return sorted(out)


def text_features(n_chars: int, links: int, sentence: bool, rights: bool, inside: bool) -> list[str]:
    size = "short" if n_chars < 25 else "middle" if n_chars < 120 else "long"
    linked = "all" if links > 7 else "some" if links > 2 else "few"
    return [("in:" if inside else "") + x for x in ("text:" + size, "text-links:" + linked, f"sentence:{sentence}", f"rights:{rights}")]


def evidence(nodes: list[Node]) -> list[tuple]:
    """What each node's own score depends on: arguments of text_features or element_features."""
    n = len(nodes)
    chars, linked, paragraphs = [0] * n, [0] * n, [0] * n
    out: list[tuple] = [()] * n
    largest = articles = 0
    inside = [False] * n
    for k in range(1, n):
        tag = nodes[k].tag
        inside[k] = inside[nodes[k].parent] if tag == "#text" or tag in FLOW else tag in ("article", "main")
    for k in range(n - 1, 0, -1):
        node = nodes[k]
        if node.tag == "#text":
            chars[k], linked[k] = len(node.text), node.link
            out[k] = (chars[k] // 5 if chars[k] < 120 else 24, linked[k] * 10 // chars[k], node.text[-1] in ".!?…", RIGHTS.match(node.text) is not None, inside[k])
        else:
            much = sum(chars[k] >= least for least in (1, 60, 250, 1000))
            out[k] = (node.tag, node.names, min(3, paragraphs[k]), linked[k] * 10 // max(1, chars[k]), much, inside[k], False)
            if node.tag == "article":
                articles += chars[k]
                if not largest or chars[k] >= chars[largest]:
                    largest = k
        up = node.parent
        chars[up] += chars[k]
        linked[up] += linked[k]
        paragraphs[up] += paragraphs[k] + (node.tag == "p")
    if largest and 2 * chars[largest] >= articles:
        out[largest] = (*out[largest][:-1], True)
    return out


def features(seen: tuple) -> list[str]:
    return text_features(seen[0] * 5, *seen[1:]) if len(seen) == 5 else element_features(*seen)


def edge_kind(tag: str) -> str:
    return "text" if tag == "#text" else "flow" if tag in FLOW else "frame"


class Model:
    """Weights of features, and edge potentials by the child's kind: for the labels (11, 10, 01, 00) of parent and child."""

    def __init__(self, weights: dict[str, float], edges: dict[str, tuple[float, float, float, float]]):
        self.weights, self.edges = weights, edges
        self.factors = {kind: tuple(map(math.exp, e)) for kind, e in edges.items()}
        self._known: dict[tuple, float] = {}

    def score(self, seen: tuple) -> float:
        """Log odds of content, from the node alone."""
        known = self._known.get(seen)
        if known is None:
            known = sum(self.weights.get(f, 0.0) for f in features(seen))
            if len(self._known) < 50_000:
                self._known[seen] = known
        return known

    def marginals(self, nodes: list[Node], own: list[float] | None = None) -> list[float]:
        """The probability that each node is content: messages from the leaves to the root, then back."""
        n, exp, log, factors = len(nodes), math.exp, math.log, self.factors
        belief = own or [0.0, *map(self.score, evidence(nodes)[1:])]
        up = [0.0] * n

        def passed(odds: float, f11: float, f10: float, f01: float, f00: float) -> float:
            """Log odds at the near end of an edge from those at the far end; factors by near and far label."""
            if odds > 0:
                e = exp(-odds)
                return log((f11 + f10 * e) / (f01 + f00 * e))
            e = exp(odds)
            return log((f11 * e + f10) / (f01 * e + f00))

        kinds = [edge_kind(node.tag) for node in nodes]
        for k in range(n - 1, 0, -1):
            up[k] = passed(belief[k], *factors[kinds[k]])
            if nodes[k].parent:  # the document itself has no label: its parts are independent
                belief[nodes[k].parent] += up[k]
        for k in range(1, n):
            if nodes[k].parent:
                f11, f10, f01, f00 = factors[kinds[k]]
                belief[k] += passed(belief[nodes[k].parent] - up[k], f11, f01, f10, f00)
        return [1 / (1 + exp(-max(-500.0, min(500.0, b)))) for b in belief]


def _made_page(rng: random.Random) -> str:
    """A page from a random layout. Each text says itself whether it is content: it starts with KK, or with DD."""
    kinds = [kind for kind in PURPOSES if kind != "body"]
    marks = rng.choice([0.95, 0.95, 0.5, 0.1])  # how many of the article's texts end as sentences do
    lengths = rng.choice([[3], [10], [3, 10], [70, 200], [10, 70, 200], [10, 70, 200]])  # of its paragraphs, at most

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def words(least: int, most: int) -> str:
        return " ".join(word() for _ in range(rng.randint(least, most)))

    def said(label: int, least: int, most: int, stop: bool = True) -> str:
        return f"{'KK' if label else 'DD'} {words(least, most)}{rng.choice('.!?') if stop and rng.random() < (marks if label else 0.93) else ''}"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{said(0, 1, 3, False)}</a></li>' for k in range(n))

    def sure(kind: str) -> str:
        """A name that tells what the part is for, maybe with a word for its place or a number."""
        name = rng.choice(PURPOSES[kind].split())
        name = rng.choice([name, name, name, f"{name}-{rng.choice(sorted(NEUTRAL))}", f"{rng.choice(sorted(NEUTRAL))}_{name}", f"{name}-{rng.randint(1, 9)}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def slug(kind: str) -> str:
        """A name that holds a purpose's word among others."""
        parts = [rng.choice(PURPOSES[kind].split()), *(word() + "q" for _ in range(rng.randint(1, 2)))]
        rng.shuffle(parts)
        return f' {rng.choice(["id", "id", "class"])}="{"-".join(parts)}"'

    def maybe(kind: str) -> str:
        return rng.choice(["", "", "", sure(kind), sure(kind), slug(kind), f' class="{word()}q"'])

    def named(kind: str) -> str:
        return slug(kind) if rng.random() < 0.08 else sure(kind)

    def few(most: int = 40) -> str:
        forms = ["<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>"]
        return "".join(rng.choice(forms).format(said(0, 1, most)) for _ in range(rng.randint(1, 3)))

    def title() -> str:
        return said(0, 1, 4, False)

    def replies() -> str:
        form = rng.choice(["<div{0}><p>{1}</p></div>", "<li{0}><p>{1}</p></li>"] * 3 + ["<article{0}><p>{1}</p></article>"])
        return "".join(form.format(maybe("reply"), said(0, 4, 50)) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 12])))

    def junk(kind: str) -> str:
        n = rng.randint(3, 8)
        return rng.choice({
            "menu": [lambda: f"<nav{maybe(kind)}><ul>{links(n)}</ul></nav>", lambda: f"<div{named(kind)}><ul>{links(n)}</ul></div>", lambda: f"<nav>{few()}</nav>",
                     lambda: f"<ul{maybe(kind)}>{links(n)}</ul>", lambda: "<div>" + " | ".join(f'<a href="{k}">{title()}</a>' for k in range(n)) + "</div>"],
            "ad": [lambda: f"<div{named(kind)}>{few()}</div>", lambda: f"<aside{named(kind)}>{few()}</aside>"],
            "foot": [lambda: f"<footer{maybe(kind)}>{few()}</footer>", lambda: f"<div{named(kind)}>{few()}</div>", lambda: f"<div>DD {rng.choice(['&copy;', '(c)', 'Copyright'])} {words(1, 5)}</div>"],
            "head": [lambda: f"<header{maybe(kind)}>{few()}</header>", lambda: f"<div{named(kind)}><h1>{title()}</h1>{few()}</div>"],
            "side": [lambda: f"<aside{maybe(kind)}><h3>{title()}</h3><ul>{links(3)}</ul>{few()}</aside>", lambda: f"<div{named(kind)}>{few()}</div>",
                     lambda: f"<section{named(kind)}><h3>{title()}</h3>{rng.choice([few(), '<ul>' + links(n) + '</ul>'])}</section>"],
            "notice": [lambda: f"<div{named(kind)}><p>{said(0, 5, 30)}</p><button>{title()}</button></div>", lambda: f"<dialog><p>{said(0, 5, 30)}</p></dialog>"],
            "form": [lambda: f"<form{maybe(kind)}><label>{title()}</label><input><button>{title()}</button>{rng.choice(['', f'<p>{said(0, 4, 12)}</p>'])}</form>"],
            "reply": [lambda: f"<section{named(kind)}>{replies()}</section>", lambda: f"<div{named(kind)}><h3>{title()}</h3>{replies()}</div>", lambda: f"<ol{sure(kind)}>{replies()}</ol>"],
        }[kind])()

    def part() -> str:
        """A part of the main text, in one of the forms that it has on the page."""
        kind = rng.random()
        if kind < 0.7:
            text = f"{rng.choice(['', '<b>'])}{said(1, 1, rng.choice(lengths))}{rng.choice(['', '<br>'])}"
            if form == "div":
                return f"<div{maybe('body') if rng.random() < 0.2 else ''}>{text}</div>"
            if form == "br":
                return f"{text}<br><br>"
            return f"<p{maybe('body')}>{text}{rng.choice(['</p>', '</p>', ''])}"
        if kind < 0.78:
            return f"<h2>{said(1, 1, 6, False)}</h2>"
        if kind < 0.86:
            return f"<ul>{''.join(f'<li>{said(1, 2, 15)}</li>' for _ in range(3))}</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{said(1, 4, 30)}</p></blockquote>"
        if kind < 0.96:
            return f"<table><tr><td>{said(1, 1, 4, False)}</td><td>{said(1, 1, 4, False)}</td></tr></table>"
        return f"<figure><figcaption>{said(1, 2, 12)}</figcaption></figure>"

    def main() -> str:
        out = [f"<h1>{said(1, 2, 9, rng.random() < 0.4)}</h1>"] if rng.random() < 0.8 else []
        n = rng.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 16, 25, rng.choice([50, 300])])
        while n > 0:
            if rng.random() < 0.15:  # a section of its own, whose name is made from its heading
                inside = [part() for _ in range(rng.randint(1, 4))]
                n -= len(inside)
                name = rng.choice(["", slug(rng.choice(kinds)), slug(rng.choice(kinds)), f' id="{word()}q"'])
                tag = rng.choice(["section", "section", "div"])
                out.append(f"<{tag}{name}>{rng.choice(['', f'<h2>{said(1, 1, 6, False)}</h2>'])}{''.join(inside)}</{tag}>")
            else:
                out.append(part())
                n -= 1
            if rng.random() < 0.08:
                out.append(junk(rng.choice(["ad", "side", "notice", "form"])))
        return "".join(out)

    plain = rng.random() < 0.3  # no tags that tell the article from the rest
    form = rng.choice(["p", "p", "div", "br"]) if plain else rng.choice(["p", "p", "p", "p", "div"])
    before = [junk(k) for k in rng.sample(["menu", "head", "ad", "notice", "form", "side"], rng.randint(0, 4))]
    after = [junk(k) for k in rng.sample(["reply", "side", "ad", "foot", "menu", "foot", "ad"], rng.randint(1, 4))]
    if plain:
        while len(text := main()) < 300 or lengths == [3]:  # with nothing else to go by, there has to be some text
            lengths = [10, 70, 200]
        wrap = rng.choice(["<div>{}</div>", "<div>{}</div>", "<div><div>{}</div></div>", "{}", "<table><tr><td>{}</td></tr></table>", f"<div{slug('body')}>{{}}</div>"])
        body = [*before, wrap.format(text), *after]
    elif rng.random() < 0.25:
        body = [*before, f"<div{sure('body')}>{main()}</div>", *after]
    else:
        wraps = ["<article{}>{}</article>", "<main{}><article>{}</article></main>", "<article{}>{}</article>", "<main{}>{}</main>", "<article{}><div>{}</div></article>"]
        body = [*before, rng.choice(wraps).format(maybe("body"), main()), *after]
    if rng.random() < 0.4:
        body = [f"<div{rng.choice(['', ' class=page', ' id=wrapper', ' class=container'])}>", *body, "</div>"]
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(body)}</body></html>"


def train(pages: int = 900, seed: int = 5, epochs: int = 30, rate: float = 0.12) -> Model:
    """Fit the model on ``pages`` labelled pages; a few seconds, whatever the corpus.

    Edge potentials are smoothed log shares of the child's label given its parent's; then the node weights climb the
    likelihood of the labels under the whole model, whose gradient (label less marginal) comes from message passing.
    """
    rng = random.Random(seed)
    made, counts = [], {kind: [[1.0, 1.0], [1.0, 1.0]] for kind in ("text", "flow", "frame")}
    for _ in range(pages):
        nodes = parse(_made_page(rng))
        votes = [[0, 0] for _ in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            if nodes[k].tag == "#text":
                votes[k][nodes[k].text.startswith("KK")] += 1
                nodes[k].text = nodes[k].text[3:] or "x"
            for label in (0, 1):
                votes[nodes[k].parent][label] += votes[k][label]
        labels = [int(b > a) for a, b in votes]
        for k in range(1, len(nodes)):
            if nodes[k].parent:
                counts[edge_kind(nodes[k].tag)][labels[nodes[k].parent]][labels[k]] += 1
        made.append((nodes, [features(x) if x else [] for x in evidence(nodes)], labels))
    potentials = {}
    for kind, ((n00, n01), (n10, n11)) in counts.items():  # of the child given the parent: a child that tells nothing says nothing
        stays, comes = (min(1 - RARE, max(RARE, p)) for p in (n11 / (n10 + n11), n01 / (n00 + n01)))
        potentials[kind] = (math.log(stays), math.log(1 - stays), math.log(comes), math.log(1 - comes))
    model = Model({}, potentials)
    weights = model.weights
    for epoch in range(epochs):
        step = rate / (1 + 0.2 * epoch)
        for nodes, told, labels in made:
            odds = model.marginals(nodes, [sum(weights.get(f, 0.0) for f in fs) for fs in told])
            for fs, y, p in zip(told, labels, odds, strict=True):
                if abs(y - p) > 0.01:
                    for f in fs:
                        weights[f] = weights.get(f, 0.0) + step * (y - p)
    return Model(weights, potentials)


@lru_cache(maxsize=1)
def trained() -> Model:
    return train()


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes = parse(page)
    odds = model.marginals(nodes)
    return "\n".join(node.text for node, p in zip(nodes, odds, strict=True) if node.tag == "#text" and p > 0.5)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", model: Model | None = None) -> DataFrame:
    """*keep, text, n_chars. The model (a few hundred weights) is trained by the driver and sent with the task."""
    fitted = model or trained()
    weights, edges = fitted.weights, fitted.edges
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", text string, n_chars bigint"

    def start():
        own = Model(weights, edges)

        def work(*columns: list) -> list[tuple]:
            texts = [main_text(page, own) for page in columns[-1]]
            return [(*row, text, len(text)) for *row, text in zip(*columns[:-1], texts, strict=True)]

        return work

    return map_columns(pages, start, schema, [*keep, html_col])
