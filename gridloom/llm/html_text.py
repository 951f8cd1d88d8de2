"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden state, content or not. A node's own features (tag, words
of class and id, amount of text, share of it in links) give its potential; a potential for every pair
of parent and child states, by the child's tag, connects it to its parent. Sum-product messages run
from the leaves to the root and back, which on a tree gives exact marginals. Weights are those of
maximum likelihood on labelled pages: the gradient is observed minus expected feature counts, the
expected ones from the same messages. Text whose node is content with probability over one half is kept.

The labelled pages are rendered here (``labelled_pages``) with layouts of many kinds; the label of
every node is known because its text was put there as article or as something else.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import rows_of, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is not markup: skipped to their end tag.
RAW = frozenset("script style noscript textarea title iframe".split())
#: Elements with markup inside that is never content; they close like any other, with their parent at the latest.
HOLLOW = frozenset("template svg select option object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": "li", "dt": "dl", "dd": "dl", "tr": "tr", "td": "td", "th": "td", "option": "option"}
ALIKE = {x: [t for t in SAME if SAME[t] == x] for x in SAME.values()}
SCOPE = frozenset("ul ol dl table div article section body html main aside nav form".split())

# A quoted value holds no ``>`` or nothing that looks like a tag: a quote left open does not swallow the markup
# behind it.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:"(?:[^">]*|(?:[^"<]|<(?![a-zA-Z/!]))*)"|'(?:[^'>]*|(?:[^'<]|<(?![a-zA-Z/!]))*)'|[^<>"'])*+|[^<>]*+)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("chars", "links", "names", "parent", "tag")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...]):
        self.tag, self.parent, self.names, self.chars, self.links = tag, parent, names, 0, 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes (parents before children) and the page's text as (node, raw text of one block)."""
    nodes, blocks, stack = [Node("html", -1, ())], [], [("html", 0)]
    held: list[str] = []
    at, links, hollow = 0, 0, 0
    inner = [0]  # depths of the open blocks
    scopes = [0]  # depths of the open blocks that optional end tags don't look behind
    open_at: dict[str, list[int]] = {}  # depths of the open elements by tag, so that no tag makes the stack be walked
    outer = 0  # depth of the outermost hollow element

    def flush() -> None:
        if held:
            blocks.append((stack_node(), "".join(held)))
            held.clear()

    def stack_node() -> int:
        return stack[inner[-1]][1]

    def add(text: str) -> None:
        if text and not hollow:
            held.append(text)
            n = len(text) - text.count(" ")
            node = nodes[stack_node()]
            node.chars += n
            if links:
                node.links += n

    def pop_to(depth: int) -> None:
        nonlocal links, hollow
        while len(stack) > depth:
            tag, node = stack.pop()
            open_at[tag].pop()
            if node >= 0:
                inner.pop()
                if tag in SCOPE:
                    scopes.pop()
            links -= tag == "a"
            hollow -= tag in HOLLOW

    def push(tag: str, node: int) -> None:
        open_at.setdefault(tag, []).append(len(stack))
        if node >= 0:
            inner.append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
        stack.append((tag, node))

    def last(*tags: str) -> int:
        """Depth of the innermost open element of these tags, 0 if none is open."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def leave_for(tag: str) -> None:
        """A block's start closes an open svg (but not inside its foreignObject) and an option outside a select."""
        kind = stack[outer][0]
        if tag in ENDS_P and (kind == "option" or (kind == "svg" and last("foreignobject") < outer)):
            pop_to(outer)

    while m := TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = last(tag)
            if depth and tag in INLINE:  # an inline end never closes a block
                depth = depth if depth > inner[-1] else 0
            elif depth and inner[-1] >= depth:
                flush()
            if depth:
                pop_to(depth)
            continue
        if hollow:
            leave_for(tag)
        empty = m[3].endswith("/")
        if tag in RAW:
            if empty and last("svg"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if hollow or tag in HOLLOW:
            if tag == "option" and (d := last("option", "select", "datalist")) and stack[d][0] == "option":
                pop_to(d)
            if tag not in VOID and not empty:
                outer = outer if hollow else len(stack)
                push(tag, -1)
                links += tag == "a"
                hollow += tag in HOLLOW
            continue
        if tag in INLINE or tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            elif tag not in VOID and not empty:
                push(tag, -1)
                links += tag == "a"
            continue
        flush()
        if tag == "html" or (tag == "body" and last("body")):
            continue
        ends = (("p",) if tag in ENDS_P else ()) + tuple(ALIKE.get(SAME.get(tag), ())) + (("head",) if tag == "body" else ())
        if (d := last(*ends)) > scopes[-1]:
            pop_to(d)
        names = tuple(dict.fromkeys(p.lower() for g in NAMES.findall(m[3]) for p in PART.findall("".join(g)))) if m[3] else ()
        nodes.append(Node(tag, stack_node(), names))
        if not empty:
            push(tag, len(nodes) - 1)
    add(html[at:])
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features that each node has."""
    chars, links = [n.chars for n in nodes], [n.links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    out = []
    for i, n in enumerate(nodes):
        share = links[i] / chars[i] if chars[i] else 0.0
        found = ["bias", f"tag {n.tag}", f"size {min(6, int(math.log2(n.chars + 1)) // 2)}", f"links {0 if share < 0.2 else 1 if share < 0.6 else 2}"]
        above = nodes[n.parent] if i else n
        found += [f"name {x}" for x in n.names] or [f"plain {n.tag}"]
        out.append([*found, f"{n.tag} in {above.tag}", *(f"in name {x}" for x in above.names)])
    return out


class Model:
    """Weights of node features for the content state, and of (child tag, parent state, child state)."""

    def __init__(self):
        self.node: dict[str, float] = {}
        self.edge: dict[tuple[str, int, int], float] = {}

    def marginals(self, nodes: list[Node], found: list[list[str]]):
        """(probability of content by node, pair probabilities [parent state][child state] by node)."""
        n = len(nodes)
        get, edge = self.node.get, self.edge.get
        own = [math.exp(max(-30.0, min(30.0, sum(get(f, 0.0) for f in fs)))) for fs in found]
        pair = {t: [[math.exp(edge((t, p, c), 0.0)) for c in (0, 1)] for p in (0, 1)] for t in {x.tag for x in nodes}}
        below = [[1.0, o] for o in own]  # own potential times messages of the children, scaled
        message = [[1.0, 1.0] for _ in nodes]  # of each node to its parent
        for i in range(n - 1, 0, -1):
            e, (b0, b1) = pair[nodes[i].tag], below[i]
            m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
            message[i] = [m0 / (m0 + m1), m1 / (m0 + m1)]
            up = below[nodes[i].parent]
            u0, u1 = up[0] * message[i][0], up[1] * message[i][1]
            up[0], up[1] = u0 / (u0 + u1), u1 / (u0 + u1)
        belief = [below[0]]
        pairs: list = [None]
        total = sum(belief[0])
        belief[0] = [x / total for x in belief[0]]
        for i in range(1, n):
            e, parent, (m0, m1), (b0, b1) = pair[nodes[i].tag], belief[nodes[i].parent], message[i], below[i]
            a0, a1 = parent[0] / max(m0, 1e-300), parent[1] / max(m1, 1e-300)  # the parent without this child
            joint = [[a0 * e[0][0] * b0, a0 * e[0][1] * b1], [a1 * e[1][0] * b0, a1 * e[1][1] * b1]]
            total = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
            joint = [[x / total for x in row] for row in joint]
            pairs.append(joint)
            belief.append([joint[0][0] + joint[1][0], joint[0][1] + joint[1][1]])
        return [b[1] for b in belief], pairs

    def fit(self, pages: list[tuple[str, set[str]]], epochs: int = 8, rate: float = 0.5, decay: float = 1e-3) -> Model:
        """AdaGrad on the log-likelihood. Pages come with the words that only the article holds."""
        seen: dict = {}
        parsed = []
        for html, words in pages:
            nodes, blocks = parse(html)
            state, total, own = [0] * len(nodes), [n.chars for n in nodes], [0] * len(nodes)
            for node, text in blocks:
                if words & set(text.split()):
                    state[node], own[node] = 1, nodes[node].chars
            for i in range(len(nodes) - 1, 0, -1):
                if not nodes[i].chars and nodes[i].tag != "body":  # no text of its own: as most of what it holds
                    state[i] = int(2 * own[i] > total[i])
                total[nodes[i].parent] += total[i]
                own[nodes[i].parent] += own[i]
            parsed.append((nodes, features(nodes), state))
        for _ in range(epochs):
            for nodes, found, state in parsed:
                belief, pairs = self.marginals(nodes, found)
                gradient: dict = {}
                for i, fs in enumerate(found):
                    for f in fs:
                        gradient[f] = gradient.get(f, 0.0) + state[i] - belief[i]
                for i in range(1, len(nodes)):
                    t, p = nodes[i].tag, state[nodes[i].parent]
                    for a in (0, 1):
                        for b in (0, 1):
                            gradient[t, a, b] = gradient.get((t, a, b), 0.0) + (p == a and state[i] == b) - pairs[i][a][b]
                for key, g in gradient.items():
                    weights = self.edge if isinstance(key, tuple) else self.node
                    g -= decay * weights.get(key, 0.0)
                    seen[key] = seen.get(key, 1e-6) + g * g
                    weights[key] = weights.get(key, 0.0) + rate * g / math.sqrt(seen[key])
        return self


# Words that sites put in class and id names, by what they mark (fixed values).
ARTICLE_NAMES = "article content main post entry story body text prose page".split()
OTHER_NAMES = {
    "nav": "nav menu navbar breadcrumb breadcrumbs topbar links toolbar".split(),
    "header": "header masthead banner top branding logo".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside related widget recommended popular trending promo".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo adbox banner".split(),
    "notice": "cookie notice consent alert gdpr popup modal newsletter subscribe".split(),
    "comments": "comments comment replies reply discussion disqus responses".split(),
    "form": "search login signup subscribe contact form".split(),
    "share": "share social meta tags byline author date".split(),
}


def labelled_pages(n: int = 900, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(html, words of the article): pages with layouts, names and lengths drawn at random."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "re", "ti", "on", "el", "ma", "su", "ke")) for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        article: set[str] = set()

        def say(lo: int, hi: int, mine: bool = False) -> str:
            words = [("q" if mine else "") + word() for _ in range(rng.randint(lo, hi))]  # noqa: B023
            if mine:
                article.update(words)  # noqa: B023
            return " ".join(words).capitalize() if not mine else " ".join(words)

        def named(kind: str, tag: str) -> str:
            names = OTHER_NAMES[kind]
            return f' class="{rng.choice(names)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""

        def linked() -> str:
            items = "".join(f"<li><a href='#'>{say(1, 2)}</a></li>" for _ in range(rng.randint(2, 8)))
            return f"<ul>{items}</ul>" if rng.random() < 0.8 else items.replace("<li>", "").replace("</li>", " ")

        def other(kind: str) -> str:
            if kind == "nav":
                tag = rng.choice(("nav", "nav", "div", "menu"))
                body = linked()
            elif kind == "header":
                tag = rng.choice(("header", "header", "div"))
                body = rng.choice((f"<h1>{say(1, 3)}</h1><p>{say(2, 8)}</p>", f"<div>{say(1, 4)}</div>{linked()}", say(1, 6)))
            elif kind == "footer":
                tag = rng.choice(("footer", "footer", "div"))
                body = rng.choice((f"&copy; {say(1, 20)}", f"<p>&copy; {say(2, 30)}</p>{linked()}", linked()))
            elif kind == "aside":
                tag = rng.choice(("aside", "aside", "div", "section"))
                body = f"<h{(k := rng.randint(2, 4))}>{say(1, 4)}</h{k}>" + "".join(f"<p>{say(2, 60)}</p>" for _ in range(rng.randint(1, 3))) + (linked() if rng.random() < 0.5 else "")
            elif kind == "comments":
                tag = rng.choice(("section", "div", "ol", "ul"))
                one = "li" if tag in ("ol", "ul") else rng.choice(("div", "article", "p"))
                body = (f"<h3>{say(1, 3)}</h3>" if one != "li" else "") + "".join(f'<{one} class="comment">' + (f"<p>{say(3, 80)}</p>" if one != "p" else say(3, 80)) + f"</{one}>" for _ in range(rng.randint(1, 5)))
                return f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(OTHER_NAMES["comments"])}">{body}</{tag}>'
            elif kind == "form":
                tag, body = "form", f"<label>{say(1, 3)}</label><input type='text'><p>{say(1, 12)}</p><button>{say(1, 2)}</button>"
            else:
                tag = rng.choice(("div", "div", "section", "p"))
                body = rng.choice((say(3, 30), f"<p>{say(3, 30)}</p>", f"<span>{say(2, 12)}</span> <a href='#'>{say(1, 4)}</a>"))
                return f'<{tag} class="{rng.choice(OTHER_NAMES[kind])}">{body}</{tag}>'
            return f"<{tag}{named(kind, tag)}>{body}</{tag}>"

        def heading() -> str:
            k = rng.choice((2, 2, 3, 3, 4, 5, 6))
            return f"<h{k}>{say(1, 6, True)}</h{k}>"

        def paragraph() -> str:
            mine = lambda lo, hi: say(lo, hi, True)
            text = mine(1, rng.choice((3, 20, 120)))
            kind = rng.random()
            if kind < 0.52:
                return f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><b>{text}<br>"
            if kind < 0.62:
                return heading()
            if kind < 0.68:
                tag = rng.choice(("ul", "ul", "ol"))
                return f"<{tag}>" + "".join(f"<li>{mine(1, 12)}</li>" for _ in range(rng.randint(1, 4))) + f"</{tag}>"
            if kind < 0.72:
                return f"<blockquote><p>{text}</p></blockquote>"
            if kind < 0.75:
                return f"<pre>{text}</pre>"
            if kind < 0.80:
                caption = f"<caption>{mine(1, 6)}</caption>" if rng.random() < 0.6 else ""
                head = f"<tr><th>{mine(1, 3)}</th><th>{mine(1, 3)}</th></tr>" if rng.random() < 0.6 else ""
                return f"<table>{caption}{head}<tr><td>{mine(1, 5)}</td><td>{mine(1, 5)}</td></tr></table>"
            if kind < 0.84:
                return f"<figure><img src='x'><figcaption>{mine(1, 12)}</figcaption></figure>"
            if kind < 0.88:
                return "<dl>" + "".join(f"<dt>{mine(1, 3)}</dt><dd>{mine(1, 12)}</dd>" for _ in range(rng.randint(1, 3))) + "</dl>"
            if kind < 0.90:
                return f"<address>{mine(1, 8)}</address>"
            if kind < 0.92:
                return f"<details><summary>{mine(1, 5)}</summary><p>{text}</p></details>"
            if kind < 0.96:
                return f"<div>{text}</div>" if rng.random() < 0.5 else f"<div><p>{text}</p><p>{mine(1, 20)}</p></div>"
            return f"<p>{text} <a href='#'>{mine(1, 3)}</a></p>"

        def sectioned(parts: list[str]) -> str:
            """Paragraphs in sections or bare divs, which are content as the article is."""
            tag, out, at = rng.choice(("section", "section", "div")), "", 0
            while at < len(parts):
                k = rng.randint(1, 4)
                out += f"<{tag}>{heading() if rng.random() < 0.8 else ''}{''.join(parts[at : at + k])}</{tag}>"
                at += k
            return out

        if rng.random() < 0.06:  # text without blocks around it
            lines = "<br>".join(say(1, 60, True) for _ in range(rng.randint(1, 4)))
            out.append((lines if rng.random() < 0.5 else f"<html><head><title>{say(1, 5)}</title></head><body>{lines}</body></html>", article))
            continue
        inner = f"<h1>{say(1, 9, True)}</h1>" if rng.random() < 0.8 else ""
        if inner and rng.random() < 0.25:
            inner = f"<header>{inner}</header>"
        parts = [paragraph() for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12)))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), other(rng.choice(("ad", "share", "aside", "notice", "form"))))
        inner += sectioned(parts) if rng.random() < 0.35 else "".join(parts)
        tag = rng.choice(("article", "article", "article", "main", "main", "div", "div", "section"))
        name = f' {rng.choice(("class", "id"))}="{rng.choice(ARTICLE_NAMES)}"' if rng.random() < (0.7 if tag in ("div", "section") else 0.3) else ""
        main = f"<{tag}{name}>{inner}</{tag}>" if rng.random() < 0.92 else inner  # now and then the page itself holds the article
        if rng.random() < 0.3:
            main = f"<main>{main}{other('comments') if rng.random() < 0.5 else ''}</main>"
        before = "".join(other(k) for k in ("notice", "header", "nav", "form", "ad") if rng.random() < 0.5)
        after = "".join(other(k) for k in ("share", "comments", "aside", "form", "ad", "footer") if rng.random() < 0.5)
        if rng.random() < 0.2:
            before, main = before + '<div class="container">', main + "</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{say(1, 5)}</title></head><body>{before}{main}{after}</body></html>", article))
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model().fit(labelled_pages())


def extract(html: str | None, model: Model) -> list[str]:
    """Content blocks in page order: references decoded, white space folded, empty ones left out."""
    if not html:
        return []
    nodes, blocks = parse(html)
    belief, _ = model.marginals(nodes, features(nodes))
    return [x for node, text in blocks if belief[node] > 0.5 and (x := " ".join(unescape(text).split()))]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    A null or empty html, or one without content, gives an empty text. Repeated rows are judged each
    by itself; other input columns are ignored; an empty table gives no rows. Pages of any length are
    read whole, in time that grows with the length, however deep elements lie in each other.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())  # some hundred weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = ["\n\n".join(extract(h, model.value)) for h in batch.pop("html")]
            batch["n_chars"] = [len(t) for t in batch.text]
            yield batch

    rows = rows_of(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return main_text(table(spark, sf_dir, "pages"))
