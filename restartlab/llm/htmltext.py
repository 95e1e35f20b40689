"""Main text of HTML pages by sum-product message passing over the DOM tree."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas select option textarea math audio video".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button").split())
#: A start tag of the left side ends an open element of the right side.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main aside nav footer header body form blockquote td th".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
NAMED = re.compile(r"""(?:^|[\s/])(class|id|role|hidden|aria-label|aria-hidden|itemprop|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
STOP = re.compile(r"[.!?…](?=\s|$)")
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"[ \t\n\r\f\v ]+")


@dataclass
class Tree:
    """Elements of a page in document order, and its text runs with the element that holds each."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    marks: list[str] = field(default_factory=lambda: [""])
    shown: list[bool] = field(default_factory=lambda: [True])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    stops: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str | None]] = field(default_factory=list)  # None: a block border

    def seen(self) -> Tree:
        """The tree without elements that are not shown, all that is below them, and their text."""
        place, out = [0] * len(self.tag), Tree([], [], [], [], [], [], [], [])
        for i, tag in enumerate(self.tag):
            gone = i and (place[self.parent[i]] < 0 or tag in HIDDEN or not self.shown[i])
            place[i] = -1 if gone else len(out.tag)
            if not gone:
                out.parent.append(place[self.parent[i]] if i else -1)
                out.tag.append(tag)
                out.marks.append(self.marks[i])
                out.shown.append(True)
                out.chars.append(self.chars[i])
                out.linked.append(self.linked[i])
                out.stops.append(self.stops[i])
        out.runs = [(max(place[i], 0), t) for i, t in self.runs if t is None or place[i] >= 0]
        return out


def parse(page: str | None) -> Tree:
    """A forgiving reader: unclosed and stray tags are taken as browsers mostly take them."""
    tree, page = Tree(), page or ""
    stack, at, link, end = [0], 0, 0, len(page)
    low = None
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else end]
        if text:
            tree.runs.append((stack[-1], text))
            bare = len(text.split()) and len(text)
            tree.chars[stack[-1]] += bare
            tree.linked[stack[-1]] += bare if link else 0
            tree.stops[stack[-1]] += len(STOP.findall(text))
        if not m:
            break
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in BLOCK:
                tree.runs.append((stack[-1], None))
                if tag != "button":  # a block ends an open paragraph
                    for i in range(len(stack) - 1, 0, -1):
                        if tree.tag[stack[i]] == "p":
                            link -= sum(tree.tag[n] == "a" for n in stack[i:])
                            del stack[i:]
                            break
                        if tree.tag[stack[i]] in SCOPES:
                            break
            elif tag == "br":
                tree.runs.append((stack[-1], " "))
            for i in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
                name = tree.tag[stack[i]]
                if name in CLOSES[tag]:
                    link -= sum(tree.tag[n] == "a" for n in stack[i:])
                    del stack[i:]
                    break
                if name in SCOPES - {"td", "th"}:
                    break
            if tag in VOID:
                continue
            attrs = m[3] or ""
            if tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"):
                if attrs.rstrip().endswith("/") and tag == "svg":
                    continue
                low = page.lower() if low is None else low
                close = low.find("</" + tag, at)
                if close < 0:
                    close = end if tag in ("script", "style", "template", "svg") else at
                stop = page.find(">", close)
                at = stop + 1 if stop >= 0 and close < end else end if close == end else at
                continue
            named = [(n.lower(), (a or b or c).lower()) for n, a, b, c in NAMED.findall(attrs)] if attrs else []
            marks = " ".join(f"{n} {v}" for n, v in named)
            tree.shown.append(not any((n == "hidden" and v != "until-found") or (n == "aria-hidden" and v == "true") or (n == "style" and UNSEEN.search(v)) for n, v in named))
            tree.parent.append(stack[-1])
            tree.tag.append(tag)
            tree.marks.append(marks)
            tree.chars.append(0)
            tree.linked.append(0)
            tree.stops.append(0)
            if not attrs.rstrip().endswith("/") or tag in BLOCK:
                stack.append(len(tree.tag) - 1)
                link += tag == "a"
        elif m[1]:
            tag = m[1].lower()
            if tag in BLOCK:
                tree.runs.append((stack[-1], None))
            for i in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[i]] == tag:
                    link -= sum(tree.tag[n] == "a" for n in stack[i:])
                    del stack[i:]
                    break
                if tag not in BLOCK and tree.tag[stack[i]] in BLOCK:
                    break  # an inline end tag does not reach out of its block
    return tree.seen()


#: Words in class, id and role values, by what they usually mark. Others have no say.
CUES = {
    "content": "article content entry main post story text body copy prose reading news".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toolbar tabs pagination pager skip toc banner masthead topbar".split(),
    "frame": "header footer foot site copyright legal colophon imprint bottom branding logo".split(),
    "side": "sidebar side aside related recommended more widget rail trending popular also tags share social follow author bio meta newsletter".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr toast warning dialog message hidden none".split(),
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promoted promotion banner adsense outbrain taboola offer".split(),
    "form": "form search login signup subscribe subscription register input contact newsletter".split(),
    "comment": "comment comments reply replies respond discussion disqus thread reader feedback review reviews".split(),
}
OF_CUE = {word: name for name, words in CUES.items() for word in words}
TAGS = "article main section div p h1 h2 h3 ul li a nav header footer aside form button table blockquote pre b i em strong span figure body other".split()
NAMES = [*(f"tag:{t}" for t in TAGS), *(f"cue:{c}" for c in CUES), "links", "long", "below", "below links", "share", "sentences", "prose", "bias"]
COLUMN = {n: i for i, n in enumerate(NAMES)}


def described(tree: Tree) -> np.ndarray:
    """Features of every element: its tag, cues of its names, link share and length of its own text and of all text below it, its part of the page, and sentences."""
    x = np.zeros((len(tree.tag), len(NAMES)), np.float32)
    for i, tag in enumerate(tree.tag):
        x[i, COLUMN.get(f"tag:{tag}", COLUMN["tag:other"])] = 1
        if tree.marks[i]:
            for word in PART.findall(tree.marks[i]):
                if word in OF_CUE:
                    x[i, COLUMN[f"cue:{OF_CUE[word]}"]] = 1
    chars = np.array(tree.chars, np.float32)
    x[:, COLUMN["links"]] = np.array(tree.linked, np.float32) / np.maximum(chars, 1)
    x[:, COLUMN["long"]] = np.log1p(chars) / 6
    x[:, COLUMN["prose"]] = np.minimum(1, chars / 150) * (1 - x[:, COLUMN["links"]]) * (np.array(tree.stops) > 1)
    below, linked, stops = chars.copy(), np.array(tree.linked, np.float32), np.array(tree.stops, np.float32)
    for i in range(len(below) - 1, 0, -1):
        for total in (below, linked, stops):
            total[tree.parent[i]] += total[i]
    x[:, COLUMN["below"]] = np.log1p(below) / 8
    x[:, COLUMN["below links"]] = linked / np.maximum(below, 1)
    x[:, COLUMN["share"]] = below / max(1, below[0])
    x[:, COLUMN["sentences"]] = np.minimum(stops, 4) / 4
    x[:, COLUMN["bias"]] = 1
    return x


@dataclass
class Model:
    """Log potentials: features to the two states of a node, and parent state by child state."""

    weight: np.ndarray  # (features,): evidence for content
    pair: np.ndarray  # (2, 2): log potential of (parent, child)


def marginals(model: Model, tree: Tree, x: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Chance of content for every element, and the expected number of (parent, child) state pairs, by one pass up and one down.

    Children have larger numbers than parents, so the orders are plain loops; the
    messages are log odds and log sums of two states.
    """
    n, parent = len(tree.tag), tree.parent
    own = x @ model.weight
    (p00, p01), (p10, p11) = model.pair.tolist()
    zero, one = [0.0] * n, own.tolist()
    up0, up1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        a, b = zero[i], one[i]
        up0[i], up1[i] = either(p00 + a, p01 + b), either(p10 + a, p11 + b)
        zero[parent[i]] += up0[i]
        one[parent[i]] += up1[i]
    out, pairs = np.zeros(n), np.zeros((2, 2))
    down0, down1 = [0.0] * n, [0.0] * n
    for i in range(n):
        if i:
            j = parent[i]
            r0, r1 = zero[j] + down0[j] - up0[i], one[j] + down1[j] - up1[i]
            down0[i], down1[i] = either(r0 + p00, r1 + p10), either(r0 + p01, r1 + p11)
            if with_pairs:
                table = np.array([[r0 + p00 + zero[i], r0 + p01 + one[i]], [r1 + p10 + zero[i], r1 + p11 + one[i]]])
                table = np.exp(table - table.max())
                pairs += table / table.sum()
        out[i] = 1 / (1 + math.exp(min(60.0, max(-60.0, zero[i] + down0[i] - one[i] - down1[i]))))
    return out, pairs


def either(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


#: Labelled pages to learn from: y1 begins content, y0 ends it, for an element and all below it; {n} stands for n words.
LABELLED = (
    """<html><body><nav><ul><li><a href=x>{1}</a><li><a href=x>{1}</a><li><a href=x>{2}</a></ul></nav><div class=ad>{9}</div>
    <article itemprop=y1><h1>{8}</h1><p><b>{60}</b><p>{80}<p>{2}<p>{50} <a href=x>{2}</a> {10}<ul><li>{12}<li>{9}</ul><h2>{4}</h2><p>{30}<blockquote><p>{20}</blockquote></article><footer>{12}</footer>""",
    """<html><body><header class=site-header><a class=logo href=x>{2}</a><form class=search><button>{1}</button></form></header>
    <main itemprop=y1><h1>{6}</h1><p>{90}<p>{40}<table><tr><td>{3}<td>{4}</table><p>{20} <em>{2}</em> {7}<aside class=related itemprop=y0><h3>{2}</h3><ul><li><a href=x>{5}</a><li><a href=x>{6}</a></ul></aside><p>{70}</main>
    <aside class=sidebar><h3>{2}</h3><p>{25}<p>{15}</aside><footer id=footer><p>{14} <a href=x>{2}</a></footer>""",
    """<html><body><div id=cookie-notice class=notice role=dialog><p>{25}<button>{1}</button></div><div id=header><div class=menu><a href=x>{1}</a> <a href=x>{1}</a></div></div>
    <div id=content class=post itemprop=y1><h1>{7}</h1><div class=entry><p>{100}<p>{5}<p>{35}<pre>{20}</pre></div></div>
    <section id=comments class=comments><h3>{2}</h3><div class=comment><p>{40}<p>{12}</div><div class=comment><p>{22}</div><form class=reply><label>{2}</label></form></section><div id=footer>{15}</div>""",
    """<html><body><div class=wrapper><div class=navbar><ul><li><a href=x>{1}</a><li><a href=x>{2}</a></ul></div><div class=main><div class=story itemprop=y1><h1>{9}</h1><div>{60}</div><div>{45}</div><figure><figcaption>{8}</figcaption></figure><div class=advert itemprop=y0>{10}</div><div>{50}</div></div>
    <div class=sidebar><div class=widget><p>{30}</div><div class=promo>{20}</div></div></div><div class=footer><p>{9}</div></div>""",
    """<html><body><article itemprop=y1><header><h1>{5}</h1></header><section><h2>{3}</h2><p>{55}<ol><li>{10}<li>{14}</ol></section><section><p>{30}<p>{28}</section><footer itemprop=y0>{6} <a href=x>{2}</a></footer></article>
    <section class=discussion itemprop=y0><article class=comment><p>{33}</article><article class=comment><p>{18}</article></section><form class=newsletter><p>{12}</form><footer><p>{11}</footer>""",
    """<html><body><div class=banner>{8}</div><div class=breadcrumb><a href=x>{1}</a> <a href=x>{2}</a></div><div class=page><h1 itemprop=y1>{6}</h1><p itemprop=y1>{70}<p itemprop=y1>{3}<p itemprop=y1>{44} <a href=x>{3}</a><ul itemprop=y1><li>{11}<li>{8}</ul></div>
    <div class=related><p>{20}<a href=x>{6}</a></div><div role=alert>{14}</div><div class=share><a href=x>{1}</a><a href=x>{1}</a></div><div class=copyright>{7}</div>""",
    """<html><body><nav><a href=x>{1}</a></nav><article itemprop=y1><h1>{7}</h1><p>{6}<p>{3}<p>{1}</article><div class=ads><p>{30}</div><div class=popup>{18}</div><aside><p>{40}<p>{22}</aside><footer>{20}</footer>""",
    """<html><body><nav><ul><li><a href=x>{1}</a></ul></nav><article itemprop=y1><h1>{2}</h1><p>{1}<p>{1}<p><b>{1}</b><p>{2}<div>{1}</div><span>{1}</span><p>{1}</article><div class=ad>{60}</div><footer><p>{50}<p>{30}</footer>""",
    """<html><body><div class=top-bar>{1} <a href=x>{1}</a></div><div id=content itemprop=y1><h1>{2}</h1><p>{4}<p>{2}<div><p>{3}<p>{1} <strong>{1}</strong> <i>{1}</i></div><div class=comments itemprop=y0><h3>{1}</h3><p>{40}<div><p>{60}</div></div></div><div class=sidebar>{40}<div><p>{50}</div></div><p class=footer>{5}""",
    """<html><body><main itemprop=y1><article><h1>{2}</h1><p>{3}<ul><li>{1}<li><a href=x>{2}</a></ul><p><a href=x>{4}</a><p>{2}</article></main><aside><section><p>{60}<p>{50}</section></aside><form><p>{40}<ul><li>{20}</ul></form>""",
    """<html><body><section class=article-body itemprop=y1><p>{1}<p>{2}<p>{1} <a href=x>{2}</a><h2>{1}</h2><p>{1}<div><div><p>{2}</div></div></section><div class=cookie-banner><div><p>{50}</div></div><section id=comments><div><p>{80}<p>{60}</div><ul><li>{30}</ul></section>""",
    """<html><body><header><h2>{3}</h2><p>{10}</header><section class=content itemprop=y1><p>{66}<div>{30}</div><p>{12}</section><section class=reviews><p>{45}</section><section class=sponsored><h3>{3}</h3><p>{25}</section><div class=login-form><p>{9}</div>""",
    # without class names, or with names that say nothing
    """<html><body><div><a href=x>{1}</a> <a href=x>{1}</a> <a href=x>{1}</a></div><div itemprop=y1><h1>{6}</h1><p>{60}<p>{45}<p>{30}</div><div>{5}</div>""",
    """<html><body><ul><li><a href=x>{1}</a><li><a href=x>{2}</a></ul><div><div itemprop=y1><h1>{5}</h1><p>{80}<p>{20} <a href=x>{2}</a> {9}<ul><li>{8}<li>{10}</ul></div><div><h3>{2}</h3><ul><li><a href=x>{4}</a><li><a href=x>{5}</a></ul></div></div><div><p>{6} <a href=x>{1}</a></div>""",
    """<html><body><table><tr><td><a href=x>{1}</a><br><a href=x>{1}</a></td><td itemprop=y1><h1>{4}</h1><p>{50}<p>{70}</td></tr></table><p>{4}""",
    """<html><body><div class=kopf><a href=x>{1}</a> <a href=x>{2}</a></div><div class=inhalt itemprop=y1><h1>{6}</h1><p>{40}<p>{90}<h2>{3}</h2><p>{25}</div><div class=fuss>{5} <a href=x>{1}</a></div>""",
    """<html><body><div class=c1><div class=c2><a href=x>{1}</a><a href=x>{2}</a></div><div class=c3 itemprop=y1><h1>{7}</h1><div>{55}</div><div>{35}</div><div>{60}</div></div><div class=c4><a href=x>{6}</a><a href=x>{7}</a></div></div>""",
    """<html><body><h1 itemprop=y1>{6}</h1><p itemprop=y1>{60}<p itemprop=y1>{40}<p itemprop=y1>{22}<hr><p><a href=x>{2}</a> <a href=x>{1}</a>""",
    """<html><body><div><a href=x>{1}</a> <a href=x>{2}</a></div><div itemprop=y1><h2>{4}</h2><p>{30}<p>{22}<ul><li>{8}<li>{12}</ul></div><div><a href=x>{3}</a></div>""",
    """<html><body><p><a href=x>{1}</a> / <a href=x>{1}</a> / <a href=x>{2}</a><h1 itemprop=y1>{4}</h1><p itemprop=y1>{45}<p itemprop=y1>{24}<p itemprop=y1>{60}<p>{3}""",
    """<html><body><div><ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul></div><div><div itemprop=y1><h2>{3}</h2><p>{18}<ol><li>{9}<li>{14}</ol><p>{33}<dl><dt>{2}<dd>{12}</dl></div></div><div>{4} <a href=x>{1}</a></div>""",
    """<html><body><center><a href=x>{1}</a> <a href=x>{1}</a></center><div itemprop=y1><b>{4}</b><p>{42}<p>{20}<p>{9}</div><center>{4}</center>""",
    """<html><body><section><a href=x>{1}</a><a href=x>{1}</a></section><section itemprop=y1><h1>{4}</h1><p>{26}<p>{50}<blockquote>{16}</blockquote><p>{11}</section><section><a href=x>{2}</a></section>""",
    """<html><body><div itemprop=y1><p>{24}<p>{40}</div><div><a href=x>{3}</a> <a href=x>{2}</a></div>""",
    # notices, shares, forms and side notes inside the content
    """<html><body><main itemprop=y1><h1>{5}</h1><div class=cookie-notice itemprop=y0><p>{14}<button>{1}</button></div><p>{70}<p>{40}<div class=share itemprop=y0><a href=x>{1}</a> <a href=x>{1}</a></div><form itemprop=y0><p>{6}</form></main><footer>{6}</footer>""",
    """<html><body><article itemprop=y1><h1>{6}</h1><p>{50}<aside itemprop=y0><h3>{2}</h3><p>{14}</aside><p>{60}<div class=newsletter itemprop=y0><h4>{3}</h4><p>{12}<form><label>{2}</label></form></div><p>{30}</article><nav><a href=x>{1}</a></nav>""",
    """<html><body><div id=main itemprop=y1><div class=alert itemprop=y0>{16}</div><h1>{4}</h1><p>{45}<div class=advertisement itemprop=y0><p>{20}</div><p>{55}<nav class=pager itemprop=y0><a href=x>{1}</a> <a href=x>{1}</a></nav></div><aside><p>{30}</aside>""",
    """<html><body><article itemprop=y1><header><h1>{7}</h1><div class=social itemprop=y0><a href=x>{1}</a><a href=x>{1}</a></div></header><p>{30}<p>{80}<section class=related itemprop=y0><h2>{2}</h2><p>{9} <a href=x>{4}</a></section><div role=dialog itemprop=y0><p>{22}</div><p>{15}</article>""",
    """<html><body><main itemprop=y1><article><h1>{3}</h1><p>{12}<p>{30}<aside class=promo itemprop=y0>{12}</aside><p>{24}<form class=search itemprop=y0><label>{2}</label><button>{1}</button></form></article></main>""",
)


def filled(page: str, word: str = "words") -> str:
    """A labelled page with its words: sentences of nine where there are more than seven."""
    def text(n: int) -> str:
        whole = [" ".join([word] * min(9, n - i)) for i in range(0, n, 9)]
        return ". ".join(whole) + ("." if n > 7 else "")

    return re.sub(r"{(\d+)}", lambda m: text(int(m[1])), page)


def learn(pages: tuple[str, ...] = LABELLED, rounds: int = 120, rate: float = 0.25, ridge: float = 0.01) -> Model:
    """Weights and parent-child potentials that raise the likelihood of labelled pages: observed minus expected counts."""
    model, cases = Model(np.zeros(len(NAMES)), np.zeros((2, 2))), []
    for page in pages:
        tree = parse(filled(page))
        y = [0] * len(tree.tag)
        for i in range(1, len(y)):
            y[i] = int("itemprop y1" in tree.marks[i]) if "itemprop y" in tree.marks[i] else y[tree.parent[i]]
        cases.append((tree, described(tree), np.array(y)))
    one, two = np.zeros(len(NAMES) + 4), np.zeros(len(NAMES) + 4)
    for n in range(1, rounds + 1):
        grad_w, grad_p = -ridge * model.weight, -ridge * model.pair
        for tree, x, y in cases:
            p, pairs = marginals(model, tree, x, True)
            grad_w += x[1:].T @ (y - p)[1:]
            np.add.at(grad_p, (y[tree.parent[1:]], y[1:]), 1)
            grad_p -= pairs
        g = np.concatenate([grad_w, grad_p.reshape(-1)])
        one += 0.1 * (g - one)
        two += 0.01 * (g * g - two)
        step = rate * (one / (1 - 0.9 ** n)) / (np.sqrt(two / (1 - 0.99 ** n)) + 1e-6) * min(1, 2 - 2 * n / rounds + 0.05)
        model.weight = model.weight + step[:len(NAMES)]
        model.pair = model.pair + step[len(NAMES):].reshape(2, 2)
    return model


def main_text(page: str | None, model: Model) -> str:
    """Text of the elements that are content with a chance above one half: blocks in page order, parted by an empty line."""
    tree = parse(page)
    chance, _ = marginals(model, tree, described(tree))
    keep = [c > 0.5 for c in chance]
    blocks, now = [], []
    for at, text in tree.runs:
        if text is None:
            blocks.append(now)
            now = []
        elif keep[at]:
            now.append(text)
    blocks.append(now)
    joined = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks if b)
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    The DOM is the graph: evidence of each element (tag, names, link share, length)
    and parent-child potentials; messages go up and down once and give each element
    its chance of being content. Elements that are not shown (by tag, ``hidden``,
    ``aria-hidden`` or an own style) leave the tree with all below them before that;
    comments and markup have no text. A null or empty page has an empty text. Pages
    are independent: repeated rows and ids give repeated results, other columns are
    not read, nothing is shuffled.
    """
    known = model or learn()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h, known) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
