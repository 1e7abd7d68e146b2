"""HTML extraction: the maximum-scoring contiguous region of a page.

A page becomes a sequence of tokens: words and tags.  A word's score is the log-odds
that it it belongs to the main text rather than to the rest: positive by itself, less for each
name and word of class, id or role around it that marks menus, adverts and the like.
A tag's score is negative, by how seldom such tags stand inside main texts.  All weights are learned from labelled pages (made here, with their
main text known): no list says what a menu is.  One linear scan finds the contiguous
region with the largest sum.  Its ends are moved to those of the innermost element around it (if the region is most
of that) and of their blocks, and blocks of it whose words together score below zero
are left out (a minimal-scoring stretch inside the region: adverts, comments, forms).  The tokens of one element that
scores below zero cost LIMIT at most, so that a large box doesn't cut a text in two.

Defined results: a null or empty page, or one without a positive region, has the
empty text; of regions with equal sums the first wins; an unclosed paragraph ends
at the next block, any other unclosed element with its parent; `<br>` is white
space; a `<` that begins no whole tag is text; pages that repeat are extracted one
by one; other columns than those kept are ignored; an empty table gives an empty one.
Time is linear in a page's length, and nothing is cut off.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Names of HTML elements by their role.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open element of their own name.
ENDS_ITSELF = frozenset("li td th tr dt dd option".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>?"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_LETTERS = re.compile(r"[a-z]+")

#: The most that a word, and one element below zero, cost the region.
WORD_LIMIT, LIMIT = 1.0, 12.0


class Page:
    """Blocks of a page with their scores, and the tokens' scores in order.

    `table` has the weights (`word` and features for words, `<name` for tags); with
    `watch`, each run of words is reported with the features around it.
    """

    def __init__(self, html: str, table: dict[str, float], watch=None):
        self.table = table
        self.tokens: list[float] = []
        self.owner: list[int] = []  # block of each token
        self.blocks: list[list[str]] = [[]]  # texts of each block
        self.scores: list[float] = [0.0]
        self.names: list[str] = []  # of each token: a tag's kind, or "" for words
        self.elements: list[tuple[int, int]] = []  # tokens [first, end) inside each block element
        self._read(html, watch)

    def _read(self, html: str, watch) -> None:
        table, tokens, owner = self.table, self.tokens, self.owner
        base, unknown = table.get("word", 0.0), table.get("<", 0.0)
        stack: list[tuple[str, str, list[str], float]] = []  # name, kind of tag, features it adds, score of a word inside
        outer: list[tuple[int, int]] = []  # block elements: places on the stack, first tokens inside
        open_: Counter = Counter()  # features around
        elements: Counter = Counter()  # elements on the stack by name
        spent, low_at = 0.0, -1  # cost of the outermost element below zero, and its place on the stack

        def add(score: float, name: str) -> None:
            nonlocal spent
            if low_at >= 0 and score < 0:
                score = max(score, -LIMIT - spent)
                spent += score
            tokens.append(score)
            owner.append(len(self.blocks) - 1)
            self.names.append(name)

        def new_block() -> None:
            if self.blocks[-1]:
                self.blocks.append([])
                self.scores.append(0.0)

        def pop() -> None:
            nonlocal low_at
            name, _, features, _ = stack.pop()
            elements[name] -= 1
            for f in features:
                open_[f] -= 1
            if outer and outer[-1][0] == len(stack):
                self.elements.append((outer.pop()[1], len(tokens)))
            if low_at >= len(stack):
                low_at = -1

        for m in TOKEN.finditer(html):
            if (text := m["text"]) is not None:
                words = unescape(text)
                self.blocks[-1].append(words)
                if n := len(words.split()):
                    score = max(stack[-1][3], -WORD_LIMIT) if stack else base
                    self.scores[-1] += n * score
                    add(n * score, "")
                    if watch:
                        watch(words, n, [f for f, k in open_.items() if k])
            elif (name := m["name"]) is not None:
                name = name.lower()
                if m["close"]:
                    kind = name
                    if elements[name]:
                        cut = False
                        while True:
                            last, kind, _, score = stack[-1]
                            pop()
                            cut = cut or (score < 0 <= (stack[-1][3] if stack else base) and last != "a")
                            if last == name:
                                break
                        if cut:
                            new_block()
                    if name in BLOCKS:
                        new_block()
                    add(table.get("<" + kind, table.get("<" + name, unknown)), kind)
                    continue
                if name in BLOCKS:
                    if outer and ((above := stack[outer[-1][0]][0]) == "p" or above == name and name in ENDS_ITSELF):
                        for _ in range(len(stack) - outer[-1][0]):
                            pop()
                    new_block()
                elif name == "br":
                    self.blocks[-1].append(" ")
                kind = name + "+" * bool(m["attrs"].strip(" \t\r\n/"))  # bare elements are told from those with attributes
                add(table.get("<" + kind, table.get("<" + name, unknown)), kind)
                if name in VOID or m["attrs"].endswith("/"):
                    continue
                own = name if name != "a" else "a in " + (stack[outer[-1][0]][0] if outer else "")  # links in prose aren't links in lists
                features = [f for f in dict.fromkeys([own, *self._words(m["attrs"])]) if f in table or watch]
                around = stack[-1][3] if stack else base
                inside = around + sum(table.get(f, 0.0) for f in features if not open_[f])
                open_.update(features)
                elements[name] += 1
                if name in BLOCKS:
                    outer.append((len(stack), len(tokens)))
                elif inside < 0 <= around and name != "a":
                    new_block()
                if inside < 0 and low_at < 0:
                    low_at, spent = len(stack), 0.0
                stack.append((name, kind, features, inside))
        while outer:
            self.elements.append((outer.pop()[1], len(tokens)))

    def aligned(self, first: int, end: int) -> tuple[int, int]:
        """A region's ends moved to those of the innermost block element around it, if the region is most of that element's words."""
        around = min((e for e in self.elements if e[0] <= first and end <= e[1]), key=lambda e: e[1] - e[0], default=(first, end))
        part, whole = (sum(s for s, name in zip(self.tokens[a:b], self.names[a:b]) if s > 0 and not name) for a, b in ((first, end), around))
        if 2 * part >= whole:
            words = [i for i in range(*around) if not self.names[i]]
            first, end = words[0], words[-1] + 1
        return first, end

    @staticmethod
    def _words(attrs: str) -> list[str]:
        """Features of an element's class, id and role: their words."""
        if not attrs:
            return []
        return ["." + w for groups in _ATTR.findall(attrs) for value in groups if value for w in _LETTERS.findall(value.lower())]


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, end) of the contiguous run with the largest positive sum; (0, 0) if there is none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


# Words that authors of pages use in class and id, for the labelled pages.
CONTENT_NAMES = "content post entry story text body page article main wrapper container col inner single blog prose".split()
FURNITURE_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar tabs sitemap",
    "advert": "ad ads advert adverts advertisement promo promotion sponsor sponsored banner",
    "notice": "cookie cookies notice notices popup modal consent alert gdpr newsletter subscribe signup",
    "side": "sidebar widget related recommended popular search tags share sharing social complementary",
    "head": "masthead topbar branding header logo",
    "foot": "footer foot copyright contentinfo legal colophon",
    "comments": "comments comment disqus replies reply discussion respond",
}


def labelled_pages(n: int = 400, seed: int = 7, named: bool | None = None, holders: bool | None = None):
    """(html, its main text as a list of block texts) of made pages.

    Words of the main text are in capitals, all others in small letters.  `named`
    says whether furniture has telling names (else they are random letters, and texts in
    furniture are short, as nothing else would tell them from a main text), and
    `holders` whether <article> and <main> occur; None mixes both.
    """
    rng = random.Random(seed)
    syllables = [c + v + e for c in "bdfgklmnprst" for v in "aeiou" for e in ("", "n", "r", "s")]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    for _ in range(n):
        telling = rng.random() < 0.75 if named is None else named
        with_holder = rng.random() < 0.5 if holders is None else holders
        letters = lambda: "".join(rng.choice("bcdfghjkmqvwxz") for _ in range(6))

        def attribute(names, kind: str = "") -> str:
            shown = rng.choice(names) if telling else letters()
            return f' {rng.choice(["class", "class", "id"])}="{shown}{rng.choice(["", "-" + letters(), " " + letters()])}"' if rng.random() < 0.85 or kind == "comments" else ""

        def links(low: int, high: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(low, high))) + "</ul>"

        def box(kind: str, body: str, *elements: str) -> str:
            name = rng.choice(elements or ("div",))
            if not with_holder and not telling:
                name = "div"
            shown = attribute(FURNITURE_NAMES[kind].split(), kind)
            return f"<{name}{shown}>{body}</{name}>"

        def menu() -> str:
            return box("menu", links(3, 12), "nav", "div", "div", "menu")

        def advert() -> str:
            return box("advert", rng.choice([words(2, 14 if telling else 8), f"<a>{words(2, 9)}</a>", f"<p>{words(2, 9)}</p>"]), "div", "aside", "div")

        def notice() -> str:
            return box("notice", words(2, 12 if telling else 6) + rng.choice(["", f"<button>{words(1, 2)}</button>", f"<a>{words(1, 2)}</a>"]), "div", "dialog", "section")

        def form() -> str:
            return f"<form><label>{words(1, 3)}</label><input><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 3)}</button></form>"

        def side() -> str:
            return box("side", rng.choice(["", f"<h3>{words(1, 3)}</h3>"]) + links(2, 8), "aside", "div", "section")

        def head() -> str:
            return box("head", rng.choice([f"<a>{words(1, 3)}</a>", f"<p>{words(1, 8)}</p>"]), "header", "header", "div")

        def foot() -> str:
            return box("foot", rng.choice([f"{words(2, 15 if telling else 4)}<br>{words(1, 4)}", f"<p>{words(2, 12 if telling else 8)}</p>", links(2, 5) + words(1, 6)]), "footer", "footer", "div")

        def comments() -> str:
            if not telling:
                return ""  # nothing but the name tells long comments from a main text
            return box("comments", "".join(f"<{e}>{words(3, 30)}</{e}>" for e in rng.choices(["p", "div", "li"], k=rng.randint(1, 5))), "div", "section", "ul")

        content = []

        def main(low: int, high: int, inline: bool = True) -> str:
            """A block's text; now and then with an inline element."""
            text = words(low, high).upper()
            content.append(text)
            if inline and rng.random() < 0.3:
                parts = text.split(" ")
                at, e = rng.randrange(len(parts)), rng.choice(["a", "a", "b", "em", "span", "code", "br", "br"])
                link = " href=\"/x\"" if e == "a" else ""
                parts[at] = f"<br>{parts[at]}" if e == "br" else f"<{e}{link}>{parts[at]}</{e}>"
                text = " ".join(parts)
            return text

        def paragraph() -> str:
            x = rng.random()
            if x < 0.72:
                return f"<{p}>{main(1, 90)}" + f"</{p}>" * (rng.random() < 0.9 or p != "p")
            if x < 0.80:
                return "<ul>" + "".join(f"<li>{main(1, 12)}" + "</li>" * (rng.random() < 0.8) for _ in range(rng.randint(1, 5))) + "</ul>"
            if x < 0.86:
                return f"<h{(k := rng.randint(2, 4))}>{main(1, 8)}</h{k}>"
            if x < 0.92:
                return f"<blockquote><p>{main(3, 30)}</p></blockquote>"
            if x < 0.96:
                return f"<figure><img><figcaption>{main(1, 10)}</figcaption></figure>"
            return f"<table><tr><td>{main(1, 6)}</td><td>{main(1, 6)}</td></tr></table>"

        holder = rng.choice(["article", "article", "main"]) if with_holder else rng.choice(["div", "div", "section"])
        p = "div" if rng.random() < 0.1 else "p"
        title = f"<h1>{main(1, 9)}</h1>"
        body = [f"<header>{title}</header>" if with_holder and rng.random() < 0.2 else title, *(paragraph() for _ in range(rng.randint(1, 12)))]
        if telling:
            for extra in (advert, side, form, comments, menu):
                if rng.random() < 0.12:
                    body.insert(rng.randint(1, len(body)), extra())
            if with_holder and rng.random() < 0.1:
                body.append(foot())
        inner = f"<{holder}{attribute(CONTENT_NAMES) if rng.random() < 0.5 else ''}>{''.join(body)}</{holder}>"
        if rng.random() < 0.4:
            inner = f"<div{attribute(CONTENT_NAMES)}>{inner}</div>"
        if with_holder and holder == "article" and rng.random() < 0.3:
            inner = f"<main>{inner}</main>"
        pick = lambda kinds: "".join(f() for f in kinds if rng.random() < 0.55)
        before, after = pick([notice, head, menu, advert, form, side]), pick([comments, advert, side, form, notice, foot])
        yield f"<html><head><title>{words(2, 6)}</title></head><body>{before}{inner}{after}{rng.choice(['</body></html>', ''])}", content


#: A feature counts if so many labelled pages have it and at most this share of its words is main text.
LEAST_PAGES, MOST_MAIN = 3, 0.25


def _fit(samples: dict[tuple[str, ...], list[float]], base: float, rounds: int = 60, penalty: float = 1.0) -> dict[str, float]:
    """What each feature takes from a word's log-odds: logistic regression with the word's own score given and no weight above 0.

    Samples hold [words outside, words inside] by their features; Newton's steps, projected.
    """
    features = sorted({f for key in samples for f in key})
    place = {f: i for i, f in enumerate(features)}
    x = np.zeros((len(samples), len(features)))
    for row, key in enumerate(samples):
        x[row, [place[f] for f in key]] = 1
    counts = np.array(list(samples.values()))
    n, w = counts.sum(axis=1), np.zeros(len(features))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(base + x @ w, -30, 30)))
        gradient = x.T @ (counts[:, 1] - n * p) - penalty * w
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = np.minimum(w + np.clip(np.linalg.solve(curvature, gradient), -1, 1), 0.0)
    return {f: round(float(w[i]), 6) for f, i in place.items() if w[i] < -0.01}


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Scores of words by what is around them, and of tags, from the labelled pages."""
    runs: list[tuple[bool, int, list[str]]] = []  # of each page: main text or not, words, features
    pages: Counter = Counter()
    words, texts = {}, []
    tags: tuple[Counter, Counter] = (Counter(), Counter())  # outside, inside
    sizes = [0, 0]  # words outside and inside
    for html, _ in labelled_pages():
        runs = []
        page = Page(html, {}, lambda text, n, features, runs=runs: runs.append((text.strip().isupper(), n, features)))
        own, before, between = iter(runs), False, []
        for name in [*page.names, ""]:  # a tag stands inside if main text is the last before and the first after it
            if name:
                between.append(name)
                continue
            main = next(own, (False,))[0]
            tags[before and main].update(between)
            before, between = main, []
        pages.update({f for _, _, features in runs for f in features})
        for main, n, features in runs:
            sizes[main] += n
            for f in features:
                words.setdefault(f, [0, 0])[main] += n
        texts += runs
    useful = {f for f, (out, main) in words.items() if pages[f] >= LEAST_PAGES and main <= MOST_MAIN * (out + main)}
    samples: dict[tuple[str, ...], list[float]] = {}
    for main, n, features in texts:
        samples.setdefault(tuple(sorted(useful.intersection(features))), [0.0, 0.0])[main] += n
    totals = [sum(t.values()) for t in tags]
    base = math.log(sizes[1] / (sizes[1] + totals[1])) - math.log(sizes[0] / (sizes[0] + totals[0]))
    table = {"word": base} | _fit(samples, base)
    for name in tags[0] | tags[1]:
        table["<" + name] = min(math.log((tags[1][name] + 0.5) / totals[1]) - math.log((tags[0][name] + 0.5) / totals[0]), -0.02)
    table["<"] = -0.1  # a tag that the labelled pages don't have
    return table


def extract(html: str | None, table: dict[str, float] | None = None, scan=best_region) -> str:
    """The main text of a page: its blocks, one a line."""
    if not html:
        return ""
    page = Page(html, table or weights())
    first, end = scan(page.tokens)
    if first == end:
        return ""
    first, end = page.aligned(first, end)
    low, high = page.owner[first], page.owner[end - 1]
    texts = (" ".join("".join(b).split()) for b, score in zip(page.blocks[low : high + 1], page.scores[low : high + 1]) if score >= 0)
    return "\n".join(t for t in texts if t)


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """`key`, the columns in `keep`, text and n_chars of every page."""
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    table = weights()

    def run(batch):
        texts = [extract(h, table) for h in batch.column(1).to_pylist()]
        return {key: batch.column(0), **{c: batch.column(2 + i) for i, c in enumerate(keep)}, "text": texts, "n_chars": pa.array(map(len, texts), pa.int64())}

    return map_batches(pages.select(key, html, *keep), run, ", ".join([*kinds, "text string", "n_chars bigint"]))


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns for `pages`."""
    return extract_pages(pages).select(F.col("page_id"), "url", "text", "n_chars")
