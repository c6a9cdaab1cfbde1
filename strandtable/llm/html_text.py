"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

``blocks`` turns a page into its leaf blocks in page order, in time that grows with its length, each with its
ancestors' tags and class or id words and the share of its letters inside links. Features of ancestors and text feed a two-label chain
(article, other); weights are learnt by gradient ascent on the exact log-likelihood (forward-backward over
all labelled pages at once) and pages are decoded by Viterbi. Labelled pages come from ``labelled_pages``:
seeded layouts of many kinds whose blocks are marked as they are written.

Scale. Pages are independent: one narrow pass, no shuffle, whole html. Training takes ``TRAINING_PAGES``
labelled pages on the driver once per process, whatever the size of the input; the weights are a small
dictionary that goes to the tasks.

Nulls and odd rows: a null or empty html has empty text; unclosed, stray and overlapping tags are closed
where a browser would; a '<' that opens no tag is text, and an unfinished tag at the end of a page is none; text
outside all blocks is a block; comments, scripts, styles and templates are never text. Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TRAINING_PAGES = 1200
EPOCHS = 200

# Element names of HTML by their role.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = "script style template noscript svg iframe object canvas"
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_SILENT = "|".join(SILENT_TAGS.split())
# Attributes are read by name and value, so that a stray quote is part of a name or an unquoted value; a quoted
# value ends at a quote that white space, '/' or '>' follows, so that an unclosed quote does not run into the text.
_ATTRS = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s>\"'][^\s>]*+)?+)?+)*+"
# What is not closed ends with the page, so every part of a page is read once; '<' before anything else is text.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<svg(?=[\s/>]){_ATTRS}(?<=/)>"
    rf"|<(?P<silent>{_SILENT})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=silent)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _name_words(attrs: str) -> tuple[str, ...]:
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs))
    return tuple(dict.fromkeys(_PIECES.findall(_CAMEL.sub(r"\1 \2", found).lower()))) if found else ()


class Place(NamedTuple):
    """Where a block stands: features of all its ancestors, its parent's tag, that one's parent's, and the nearest names."""

    names: frozenset
    tag: str
    above: str | None
    near: tuple[str, ...]

    def inside(self, tag: str, words: tuple[str, ...], known: Container | None) -> Place:
        """The place within an element; names that ``known`` lacks are left out, so deep pages stay small."""
        new = {f for f in (f"in={tag}", *(f"name={w}" for w in words)) if known is None or f in known}
        return Place(self.names if new <= self.names else self.names | new, tag, self.tag or None, words or self.near)


_ROOT = Place(frozenset(), "", None, ())


def blocks(page: str | None, known: Container | None = None) -> list[tuple[str, Place, float]]:
    """(text, place, share of letters in links) of each leaf block with text."""
    page = page or ""
    stack: list[tuple[str, Place]] = []
    opened: Counter = Counter()
    out: list[tuple[str, Place, float]] = []
    held: list[str] = []
    place, empty, linked = _ROOT, True, 0

    def flush() -> None:
        nonlocal linked, empty
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, place, min(1.0, linked / len(text))))
            held.clear()
            linked, empty = 0, True

    def say(raw: str) -> None:
        nonlocal place, linked, empty
        if raw:
            if empty and raw.strip():
                place, empty = stack[-1][1] if stack else _ROOT, False
            held.append(raw)
            if opened["a"]:
                linked += len(raw)

    def shut(k: int) -> None:
        """Close the elements from place ``k`` of the stack on."""
        for t, _ in stack[k:]:
            opened[t] -= 1
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
        elif m["end"]:
            block = tag in BLOCK_TAGS
            if block:
                flush()
            if opened[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        shut(k)
                        break
                    if not block and stack[k][0] in BLOCK_TAGS:
                        break
        else:
            if tag in BLOCK_TAGS:
                flush()
                ends = {"p"} | CLOSES.get(tag, set())
                if any(opened[t] for t in ends):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in ends:
                            shut(k)
                            break
                        if stack[k][0] in BLOCK_TAGS:
                            break
            if tag not in VOID_TAGS and not m["attrs"].endswith("/"):
                words = _name_words(m["attrs"])
                outer = stack[-1][1] if stack else _ROOT
                stack.append((tag, outer.inside(tag, words, known) if tag in BLOCK_TAGS or words else outer))
                opened[tag] += 1
    say(page[at:])
    flush()
    return out


def features(found: list) -> list[list[str]]:
    """Names of each block's features."""
    out = []
    n = len(found)
    for k, (text, place, linked) in enumerate(found):
        count = text.count(" ") + 1
        names = ["bias", f"parent={place.tag or 'body'}", f"words={min(7, count.bit_length())}", f"linked={int(linked * 4)}", f"at={min(4, 5 * k // n)}"]
        names += sorted(place.names) if place.tag else ["in=body"]
        if place.above:
            names.append(f"above={place.above}/{place.tag}")
        names += [f"near={w}" for w in place.near]
        names += [f"has={c}" for c in "©|" if c in text]
        if text[-1] in ".!?":
            names.append("ends")
        if count >= 8 and linked < 0.3:
            names.append("prose")
        out.append(names)
    return out


class Chain:
    """Weights of the chain: one per feature (article against other), start and steps between labels."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start, step

    def decode(self, named: list[list[str]]) -> list[bool]:
        """The most probable labels (Viterbi)."""
        if not named:
            return []
        get = self.weights.get
        (s0, s1), ((t00, t01), (t10, t11)) = self.start.tolist(), self.step.tolist()
        a, b, back = s0, s1, []
        for k, names in enumerate(named):
            x = sum(get(f, 0.0) for f in names)
            if k:
                to0, to1 = (a + t00, b + t10), (a + t01, b + t11)
                back.append((to0[1] > to0[0], to1[1] > to1[0]))
                a, b = max(to0), max(to1)
            b += x
        label = b > a
        out = [label]
        for zero, one in reversed(back):
            label = one if label else zero
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[bool]]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 2e-4) -> Chain:
    """Maximum likelihood with weight decay (Adam); ``pages`` holds feature names and labels of blocks."""
    pages = [p for p in pages if p[0]]
    vocabulary = {f: k for k, f in enumerate(sorted({f for named, _ in pages for x in named for f in x}))}
    n, longest, m = len(pages), max(len(x) for x, _ in pages), len(vocabulary)
    row, col = [], []
    gold, real = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for p, (named, labels) in enumerate(pages):
        real[p, : len(named)], gold[p, : len(named)] = True, labels
        for k, names in enumerate(named):
            row += [p * longest + k] * len(names)
            col += [vocabulary[f] for f in names]
    row, col = np.array(row), np.array(col)
    theta = np.zeros(m + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inner = real[:, 1:]
    pair = np.stack([((gold[:, :-1] == i) & (gold[:, 1:] == j) & inner).sum() for i in (0, 1) for j in (0, 1)])
    seen = np.concatenate((np.bincount(col, weights=(gold.ravel()[row]), minlength=m), [(gold[:, 0] == i).sum() for i in (0, 1)], pair))
    for t in range(1, epochs + 1):
        w, start, step = theta[:m], theta[m : m + 2], theta[m + 2 :].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = np.bincount(row, weights=w[col], minlength=n * longest).reshape(n, longest)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = start + emit[:, 0]
        for k in range(1, longest):
            new = np.logaddexp(alpha[:, k - 1, :1] + step[0], alpha[:, k - 1, 1:] + step[1]) + emit[:, k]
            alpha[:, k] = np.where(real[:, k, None], new, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            after = emit[:, k + 1] + beta[:, k + 1]
            new = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
            beta[:, k] = np.where(real[:, k + 1, None], new, 0.0)
        whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
        one = np.where(real, np.exp(alpha[:, :, 1] + beta[:, :, 1] - whole), 0.0)
        both = [np.where(inner, np.exp(alpha[:, :-1, i] + step[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - whole), 0.0).sum() for i in (0, 1) for j in (0, 1)]
        wanted = np.concatenate((np.bincount(col, weights=one.ravel()[row], minlength=m), [(1 - one[:, 0]).sum(), one[:, 0].sum()], both))
        grad = (wanted - seen) / n + decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    weights = {f: float(theta[k]) for f, k in vocabulary.items()}
    return Chain(weights, theta[m : m + 2], theta[m + 2 :].reshape(2, 2))


# Names that page authors give to the parts of a page.
ARTICLE_NAMES = "article content post entry story main body text page single".split()
OTHER_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager toc".split(),
    "header": "header masthead banner brand logo site-header topline".split(),
    "footer": "footer copyright colophon bottom legal site-footer imprint".split(),
    "side": "sidebar aside widget related recommended trending popular tags categories archive more-stories".split(),
    "notice": "cookie consent notice alert popup modal overlay gdpr banner-notice paywall disclaimer".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted adsense affiliate".split(),
    "form": "newsletter subscribe signup login search searchbox contact-form subscription".split(),
    "share": "share social sharing follow print-tools buttons".split(),
    "comments": "comments comment replies reply discussion disqus responses respond reader-comments".split(),
}


class _Page:
    """A page under construction: html pieces and the labels of its blocks."""

    def __init__(self, draw: np.random.Generator):
        self.draw, self.html, self.labels = draw, [], []

    def pick(self, options: list) -> object:
        return options[int(self.draw.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def words(self, low: int, high: int) -> str:
        made = ["".join(self.pick(["ba", "ke", "li", "mo", "nu", "ras", "ter", "vin", "sol", "dra", "q", "st"]) for _ in range(int(self.draw.integers(1, 4)))) for _ in range(int(self.draw.integers(low, high + 1)))]
        return " ".join(made)

    def block(self, tag: str, text: str, article: bool) -> None:
        self.html.append(f"<{tag}>{text}</{tag}>" if tag else text)
        self.labels.append(article)

    def wrap(self, tags: list[str], names: list[str]) -> str:
        tag = self.pick(tags)
        name = self.pick(names)
        if self.chance(0.3):
            name = f"{self.pick(['site', 'page', 'l', 'c', 'js', 'block', 'x'])}-{name}"
        key = self.pick(["class", "class", "id"])
        self.html.append(f'<{tag} {key}="{name}">' if tag in ("div", "section", "ul", "p") or self.chance(0.4) else f"<{tag}>")
        return f"</{tag}>"

    def links(self) -> None:
        for _ in range(int(self.draw.integers(2, 9))):
            self.block("li", f'<a href="/x">{self.words(1, 4)}</a>', False)

    def prose(self, article: bool, most: int) -> None:
        for _ in range(int(self.draw.integers(1, most + 1))):
            text = self.words(1, int(self.pick([6, 30, 90]))).capitalize() + self.pick([".", ".", ".", "", "!", ":"])
            if self.chance(0.15):
                text = text.replace(" ", ' <a href="/y">', 1) + ("</a>" if " " in text else "")
            if self.chance(0.1):
                text = f"<b>{text}"
                self.html.append(f"<p>{text}<br>")
                self.labels.append(article)
            else:
                self.block(self.pick(["p", "p", "p", "p", "blockquote", "li", "div", "pre", "td"]), text, article)

    def other(self, kind: str) -> None:
        tags = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div"]}.get(kind, ["div", "div", "section", "p"])
        end = self.wrap(tags, OTHER_NAMES[kind])
        if kind in ("menu", "side", "share") and self.chance(0.8):
            if end != "</p>":
                self.html.append("<ul>")
            self.links()
            if end != "</p>":
                self.html.append("</ul>")
        elif kind == "form":
            self.block("label", self.words(1, 4), False)
            self.html.append('<input type="text"><br>')
            self.html.append("<button>Go</button>")
            self.labels.append(False)
        elif kind == "comments":
            self.block("h3", self.words(1, 3), False)
            for _ in range(int(self.draw.integers(1, 5))):
                inner = self.wrap(["div", "article", "li"], OTHER_NAMES["comments"])
                self.prose(False, 2)
                self.html.append(inner)
        elif kind == "footer":
            self.block(self.pick(["p", "", "div"]), f"&copy; {self.words(1, 3)} &middot; {self.words(2, 9)}.", False)
        elif end == "</p>" or self.chance(0.5):
            self.block("", self.words(2, 25).capitalize() + ".", False)
        else:
            self.prose(False, 2)
        self.html.append(end)


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts with the label of each leaf block."""
    draw = np.random.Generator(np.random.PCG64(seed))
    out = []
    for _ in range(n):
        p = _Page(draw)
        p.html.append(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{p.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        p.labels.append(False)
        for kind in draw.permutation(["header", "menu", "notice", "advert", "form", "share"])[: int(draw.integers(0, 5))]:
            p.other(str(kind))
        outer = p.wrap(["main", "div", "section"], ["wrapper", "container", "layout", "row", "main"]) if p.chance(0.4) else ""
        kind = int(draw.integers(10))
        end = p.wrap(["article"], ARTICLE_NAMES) if kind < 5 else p.wrap(["main"], ARTICLE_NAMES) if kind < 7 else p.wrap(["div", "section"], ARTICLE_NAMES)
        headed = p.wrap(["header", "div"], ["entry-head", "title", "headline"]) if p.chance(0.15) else ""
        if p.chance(0.85):
            p.block(p.pick(["h1", "h1", "h2"]), p.words(2, 9), True)
        p.html.append(headed)
        for _ in range(int(draw.integers(1, 4))):
            p.prose(True, 8)
            if p.chance(0.3):
                p.block(p.pick(["h2", "h3"]), p.words(1, 5), True)
                p.prose(True, 2)
            if p.chance(0.6):
                p.other(p.pick(["advert", "side", "share", "form", "notice", "comments"]))
        p.html.append(end)
        for kind in draw.permutation(["side", "comments", "advert", "share", "form", "menu", "notice"])[: int(draw.integers(0, 5))]:
            p.other(str(kind))
        p.html.append(outer)
        if p.chance(0.8):
            p.other("footer")
        p.html.append("</body></html>" if p.chance(0.8) else "")
        out.append(("".join(p.html), p.labels))
    return out


@cache
def trained(n: int = TRAINING_PAGES) -> Chain:
    """The chain learnt from the labelled pages; pages whose blocks do not match their labels are left out."""
    pages = [(features(blocks(h)), labels) for h, labels in labelled_pages(n)]
    return fit([(x, y) for x, y in pages if len(x) == len(y)])


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page, chain.weights)
    keep = chain.decode(features(found)) if found else []
    return "\n\n".join(text for (text, _, _), yes in zip(found, keep, strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of ``pages``."""
    chain = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            text = [main_text(h, chain) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
