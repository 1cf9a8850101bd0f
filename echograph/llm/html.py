"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Labelled pages made for training, and the seed they are made from.
TRAINING_PAGES, SEED = 900, 11
#: By how much a block's features must speak against main text for it to go from a page whose only text is its article.
MARGIN = 4.0
# Element kinds of the HTML standard. What stands in SILENT ones is code, settings or form controls, never text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template iframe select textarea title button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - frozenset("caption dd dt legend li option summary tbody td tfoot th thead tr body html".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: The rest of a tag: a quote opens a value only after =; possessive, so that each character is read once.
_REST = re.compile(r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WANTED = re.compile(r"class|id|role|hidden|style", re.I)
_HIDES = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden")
_PARTS = re.compile(r"[a-z]+")
_ENDING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in SILENT}
_RIGHTS = re.compile(r"\b(?:19|20)\d\d\b.{0,80}rights", re.I)


@dataclass
class Block:
    """A leaf block: its text, the node it stands in (0 is the page), how many of its characters are in links, its innermost block element, and whether it stands in none at all."""

    text: str
    node: int
    linked: int = 0
    near: str = ""
    bare: bool = False


@dataclass
class Page:
    """The leaf blocks of a page in order, and its elements: of each the one around it and the features that it adds to those around it.

    Elements are shared by the blocks within them, and a feature is told once on the way from the page
    to a block, so nesting of any depth costs no more than its markup.
    """

    blocks: list[Block] = field(default_factory=list)
    above: list[int] = field(default_factory=lambda: [-1])
    adds: list[tuple[str, ...]] = field(default_factory=lambda: [()])

    def __len__(self) -> int:
        return len(self.blocks)

    def __getitem__(self, part: slice) -> Page:
        return Page(self.blocks[part], self.above, self.adds)

    def around(self, block: Block) -> list[str]:
        """The features of the elements around a block."""
        out, node = [], block.node
        while node >= 0:
            out += self.adds[node]
            node = self.above[node]
        return out


def _attributes(text: str) -> list[str]:
    """The words of class, id and role, and -hidden where the element isn't shown."""
    out: list[str] = []
    if not _WANTED.search(text):
        return out
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "style" and _HIDES.search(value):
            out.append("-hidden")
        elif name in ("class", "id", "role"):
            out += _PARTS.findall(value)
    return out


class _Open:
    """The open elements, with the last place of each name, so that closing one takes no search."""

    def __init__(self, page: Page):
        self.page, self.stack, self.places, self.seen = page, [(0, "", (), "", True)], {}, {}

    def push(self, name: str, words: list[str]) -> None:
        # an article's own header and footer aren't the page's
        inner = name in ("header", "footer") and (self.last("article") or self.last("main"))
        own = dict.fromkeys([*([] if name in ("html", "body") else ["a:" + name + "-in" * bool(inner)]), *("c:" + w for w in words)])
        new = tuple(f for f in own if not self.seen.get(f))
        for f in own:
            self.seen[f] = self.seen.get(f, 0) + 1
        node, _, _, near, bare = self.stack[-1]
        if new:
            self.page.above.append(node)
            self.page.adds.append(new)
            node = len(self.page.above) - 1
        self.places.setdefault(name, []).append(len(self.stack))
        outer = name in ("html", "body")
        self.stack.append((node, name, tuple(own), name if name in BLOCK and not outer else near, bare and outer))

    def pop(self, name: str, within: tuple[str, ...] = ()) -> None:
        """Closes the innermost element of that name and what is open in it, unless one of ``within`` stands between."""
        at = self.last(name)
        if not at or any(self.last(w) > at for w in within):
            return
        for _, n, own, _, _ in self.stack[at:]:
            self.places[n].pop()
            for f in own:
                self.seen[f] -= 1
        del self.stack[at:]

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0


def blocks(page: str | None) -> Page:
    """The leaf blocks of a page in order; markup that is broken or never closed is taken as browsers mostly do. Time follows the page's length."""
    page, out = page or "", Page()
    opened, buffer, linked = _Open(out), [], 0
    gone: set[str] = set()  # silent elements of which no end comes any more

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            buffer.append(page[a:b])
            if opened.last("a"):
                linked += b - a

    def flush() -> None:
        nonlocal linked
        if buffer:
            words = " ".join(entities.unescape("".join(buffer)).split())
            if words:
                node, _, _, near, bare = opened.stack[-1]
                out.blocks.append(Block(words, node, linked, near, bare))
            buffer.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = page.find("<", at)
        if m < 0:
            break
        mark = page[m + 1 : m + 2]
        if mark in ("!", "?") and mark:
            text(at, m)
            if page.startswith("<![CDATA[", m):
                end = page.find("]]>", m)
                buffer.append(page[m + 9 : end if end >= 0 else size].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else size
            elif page.startswith("<!--", m):
                end = page.find("-->", m + 2)
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", m)
                at = end + 1 if end >= 0 else size
            continue
        closes = mark == "/"
        found = _NAME.match(page, m + 1 + closes)
        if not found:
            if closes and m + 2 < size:  # </ and no name: a comment
                text(at, m)
                end = page.find(">", m)
                at = end + 1 if end >= 0 else size
            else:
                text(at, m + 1)
                at = m + 1
            continue
        rest = _REST.match(page, found.end())
        text(at, m)
        at = rest.end() if rest else size  # a tag that never ends takes the rest of the page with it
        if not rest:
            break
        name = found[0].lower()
        if name in BLOCK:
            flush()
        if closes:
            opened.pop(name, () if name in ("table", "body", "html", "main", "article", "div", "section") else ("table",))
            continue
        if name == "br":
            buffer.append(" ")
        if name in VOID:
            continue
        if name in SILENT:
            end = None if name in gone else _ENDING[name].search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = size
            else:
                gone.add(name)
            if name not in ("script", "style", "template"):  # those leave no gap where they stand
                buffer.append(" ")
            continue
        if name in _ENDS_P:
            opened.pop("p", ("table", "td", "th", "button", "object"))
        elif name in ("li", "dt", "dd", "option"):
            for other in ("dt", "dd") if name in ("dt", "dd") else (name,):
                opened.pop(other, ("ul", "ol", "dl", "menu", "select"))
        elif name in ("td", "th", "tr"):
            for other in ("td", "th") if name != "tr" else ("td", "th", "tr"):
                opened.pop(other, ("table",))
        opened.push(name, _attributes(page[found.end() : at - 1]))
    text(at, size)
    flush()
    return out


def _own_features(page: Page) -> list[list[str]]:
    """Of each block, what its text and place are like; the features of the elements around it come from the page."""
    out, last = [], len(page.blocks) - 1
    for k, b in enumerate(page.blocks):
        n = b.text.count(" ") + 1
        share = min(3, 4 * b.linked // max(1, len(b.text)))
        f = ["1", "t:" + b.near, f"n:{min(6, n.bit_length())}", f"l:{share}", "end:" + ("." if b.text[-1] in ".!?…。\"”»" else "x")]
        if "©" in b.text or _RIGHTS.search(b.text):
            f.append("copyright")
        if b.bare:
            f.append("bare")
        f.append("only" if not last else "first" if k == 0 else "last" if k == last else "mid")
        out.append(f)
    return out


def _features(page: Page) -> list[list[str]]:
    """Of each block: what it is like, the elements around it and their class words."""
    return [own + page.around(b) for own, b in zip(_own_features(page), page.blocks)]


@dataclass
class Chain:
    """Two labels (0 other, 1 main text): a weight for each feature and label, and for each step between labels."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self) -> None:
        self._plain = {w: (float(v[0]), float(v[1])) for w, v in self.weights.items()}

    def odds(self, features: list[str]) -> float:
        """By how much a block's features speak for main text, its neighbours aside."""
        return sum(b - a for a, b in (self._plain.get(f, (0.0, 0.0)) for f in features))

    def viterbi(self, page: Page) -> list[bool]:
        """The likeliest labels of a page's blocks together; of equal ones those that leave a block out."""
        if not page.blocks:
            return []
        # each element's weights with those of the elements around it, outermost first
        none, sums, get = (0.0, 0.0), [], self._plain.get
        for above, adds in zip(page.above, page.adds):
            x, y = sums[above] if above >= 0 else none
            for f in adds:
                p, q = get(f, none)
                x, y = x + p, y + q
            sums.append((x, y))
        back = []
        (s00, s01), (s10, s11) = self.steps.tolist()
        a = b = 0.0
        for k, (block, own) in enumerate(zip(page.blocks, _own_features(page))):
            x, y = sums[block.node]
            for f in own:
                p, q = get(f, none)
                x, y = x + p, y + q
            if k:
                back.append((b + s10 > a + s00, b + s11 > a + s01))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11)
            a, b = a + x, b + y
        out = [b > a]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def fit(pages: list[tuple[Page, list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 2e-3) -> Chain:
    """Adagrad on the penalised log likelihood (forward and backward sums), all pages at once."""
    names = sorted({w for found, _ in pages for f in _features(found) for w in f})
    index = {w: k for k, w in enumerate(names)}
    n, longest = len(pages), max((len(x.blocks) for x, _ in pages), default=0)
    row, col, feature = [], [], []
    gold, live = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (found, y) in enumerate(pages):
        live[i, : len(y)], gold[i, : len(y)] = True, y
        for j, f in enumerate(_features(found)):
            row += [i] * len(f)
            col += [j] * len(f)
            feature += [index[w] for w in f]
    cell, feature = np.array(row, np.int64) * longest + np.array(col, np.int64), np.array(feature, np.int64)
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gt = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6)
    both = live[:, 1:]
    truth = np.eye(2)[gold] * live[..., None]
    for _ in range(rounds if n and longest else 0):
        emit = np.stack([np.bincount(cell, w[feature, k], n * longest) for k in (0, 1)], 1).reshape(n, longest, 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for j in range(1, longest):
            ahead[:, j] = np.where(live[:, j, None], np.logaddexp(*(ahead[:, j - 1, k, None] + t[k] for k in (0, 1))) + emit[:, j], ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            into = emit[:, j + 1] + behind[:, j + 1]
            behind[:, j] = np.where(live[:, j + 1, None], np.logaddexp(*(t[:, k][None] + into[:, k, None] for k in (0, 1))), 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
        chance = np.exp(ahead + behind - total[..., None]) * live[..., None]
        pairs = np.exp(ahead[:, :-1, :, None] + t + (emit + behind)[:, 1:, None, :] - total[..., None, None]) * both[..., None, None]
        slope = (truth - chance).reshape(-1, 2)
        dw = np.stack([np.bincount(feature, slope[cell, k], len(names)) for k in (0, 1)], 1) / n - decay * w
        dt = (truth[:, :-1, :, None] * truth[:, 1:, None, :] - pairs).sum((0, 1)) / n - decay * t
        gw, gt = gw + dw * dw, gt + dt * dt
        w, t = w + rate * dw / np.sqrt(gw), t + rate * dt / np.sqrt(gt)
    return Chain({x: w[k] for k, x in enumerate(names)}, t)


# What the labelled pages are made of: class words of each kind of part, in natural order.
MAIN = "article content post entry story main body text page".split()
SUFFIX = "area block box container content inner list main section text wrap wrapper".split()
OUTER = "container layout outer page root site wrap wrapper".split()
OTHER = {
    "nav": "nav menu navbar breadcrumb navigation links topbar".split(),
    "header": "header masthead banner site top logo branding".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside related recommended widget popular trending more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion".split(),
    "notice": "notice cookie consent alert message warning gdpr popup modal overlay".split(),
    "form": "form newsletter signup subscribe search login contact".split(),
    "comments": "comments comment reply replies discussion respond thread".split(),
    "share": "share social tags meta byline author date pagination pager".split(),
}


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """(html, main blocks): pages of many layouts made from a seed; which blocks are main text is known as they are made."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def line(a: int, b: int) -> str:
        out = " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
        return out + rng.choice([".", ".", ".", "?", "!", ""])

    def part(kind: str) -> str:
        name = rng.choice(OTHER[kind])
        mark = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-{rng.choice(SUFFIX)}"'])
        if kind in ("nav", "share"):
            items = "".join(f'<li><a href="/{k}">{line(1, 3)}</a></li>' for k in range(rng.randint(2, 8)))
            return rng.choice([f"<nav{rng.choice(['', mark])}><ul>{items}</ul></nav>", f"<div{mark}><ul>{items}</ul></div>"])
        if kind == "form":
            return rng.choice([f"<form{rng.choice(['', mark])}><label>{line(1, 4)}</label><input><button>Go</button><p>{line(3, 14)}</p></form>", f"<div{mark}><p>{line(3, 14)}</p></div>"])
        if kind == "footer":
            text = rng.choice([f"&copy; {line(1, 4)} &middot; {line(2, 12)}", line(3, 20), f"<p>{line(3, 12)}</p><p>{line(2, 9)}</p>"])
            return rng.choice([f"<footer{rng.choice(['', mark])}>{text}</footer>", f"<div{mark}>{text}</div>"])
        if kind == "header":
            return rng.choice([f"<header{rng.choice(['', mark])}><h1>{line(1, 4)}</h1><p>{line(2, 8)}</p></header>", f"<div{mark}>{line(1, 8)}</div>"])
        if kind == "comments":
            each = "".join(f"<{t}>{line(1, 3)}</{t}><p>{line(4, 40)}</p>" for t in (rng.choice(["h4", "div", "span"]) for _ in range(rng.randint(1, 5))))
            return rng.choice([f"<section{mark}><h3>{line(1, 3)}</h3>{each}</section>", f"<div{mark}>{each}</div>"])
        tag = rng.choice({"aside": ["aside", "div"], "ad": ["div", "aside", "p"], "notice": ["div", "p", "section"]}[kind])
        inner = rng.choice([line(2, 25), f"<p>{line(3, 25)}</p>", f"<h3>{line(1, 4)}</h3><p>{line(3, 25)}</p>"]) if tag != "p" else line(2, 25)
        return f"<{tag}{'' if tag == 'aside' and rng.random() < 0.5 else mark}>{inner}</{tag}>"

    def plain(main: list[str]) -> str:
        """The body of a page that is little but its article."""

        def text(a: int, b: int) -> str:
            main.append(line(a, b))
            return main[-1]

        paragraphs = lambda: "".join(f"<p>{text(*rng.choice([(1, 4), (3, 30), (20, 90)]))}</p>" for _ in range(rng.choice([1, 1, 2, 3, 6])))
        shape = rng.randrange(8)
        if shape == 0:
            return paragraphs()
        if shape == 1:
            return f"<div>{paragraphs()}</div>"
        if shape == 2:
            return f"<main>{paragraphs()}</main>"
        if shape == 3:  # a headline in the article's own header, and what stands below the article
            head = f"<header><h1>{text(1, 10)}</h1></header>" if rng.random() < 0.7 else f"<header><h1>{text(1, 10)}</h1><p>{text(3, 20)}</p></header>"
            foot = rng.choice(["", f"<footer>{line(2, 9)}</footer>", f"<footer><p>{line(2, 9)}</p></footer>"])
            return f"<article>{head}{paragraphs()}{foot}</article>"
        if shape == 4:  # a layout table: the menu in one cell, the article in another
            menu = rng.choice(["<br>", " | ", " "]).join(f'<a href="/{k}">{line(1, 2)}</a>' for k in range(rng.randint(2, 7)))
            menu = rng.choice([menu, "".join(f'<p><a href="/{k}">{line(1, 2)}</a></p>' for k in range(3))])
            return f"<table><tr><td>{menu}</td>{rng.choice(['', '</tr><tr>'])}<td>{paragraphs()}</td></tr></table>"
        if shape == 5:
            return f"<article>{text(1, 60)}</article>"
        if shape == 6:
            return f"<article>{paragraphs()}</article>" + rng.choice(["", part("footer"), part("nav"), part("comments")])
        return rng.choice(["", part("nav"), part("header")]) + f"<article>{paragraphs()}</article>"

    out = []
    for n in range(count):
        main: list[str] = []
        if n % 3 == 2:
            out.append((f"<html><body>{plain(main)}</body></html>", main))
            continue

        def text(a: int, b: int, main=main) -> str:
            main.append(line(a, b))
            if rng.random() < 0.04:
                main[-1] += rng.choice([" © ", " (c) 2019 ", " | "]) + line(1, 6)
            return main[-1]

        def linked(main=main) -> str:
            a, b = line(3, 20), line(1, 6)
            main.append(f"{a} {b}")
            return f'<p>{a} <a href="/x">{b}</a></p>'

        body = []
        if rng.random() < 0.85:
            body.append(f"<h1>{text(1, 10)}</h1>")
        for _ in range(rng.randint(1, 10)):
            body.append(rng.choice([lambda: f"<p>{text(1, 60)}</p>", lambda: f"<p>{text(1, 60)}</p>", lambda: f"<p>{text(2, 90)}", lambda: f"<p><b>{text(1, 12)}<br><p>{text(4, 60)}</p>", lambda: f"<h2>{text(1, 8)}</h2>", lambda: f"<ul><li>{text(1, 12)}</li><li>{text(1, 12)}</li></ul>", lambda: f"<blockquote>{text(4, 30)}</blockquote>", lambda: f"<pre>{text(2, 20)}</pre>", lambda: f"<table><tr><td>{text(1, 5)}</td><td>{text(1, 5)}</td></tr></table>", linked])())
            if rng.random() < 0.12:
                body.append(part(rng.choice(["ad", "share", "aside", "notice", "form"])))
        inner, name = "".join(body), rng.choice(MAIN)
        if rng.random() < 0.6:
            name += rng.choice(["-", "_", " "]) + rng.choice(SUFFIX)
        if rng.random() < 0.15:
            inner += part(rng.choice(["comments", "share", "form", "aside"]))
        whole = rng.choice([f"<article>{inner}</article>", f"<main>{inner}</main>", f'<div class="{name}">{inner}</div>', f'<div id="{name}"><article>{inner}</article></div>', f"<main><article class='{name}'>{inner}</article></main>", f"<section class='{name}'>{inner}</section>", f"<div>{inner}</div>"])
        before = [part(k) for k in ("header", "nav", "notice", "ad", "share") if rng.random() < 0.5]
        after = [part(k) for k in ("share", "comments", "form", "aside", "ad", "footer", "notice") if rng.random() < 0.5]
        rng.shuffle(before)
        page = "".join([*before, whole, *after])
        if rng.random() < 0.5:
            page = f'<div {rng.choice(["class", "id"])}="{rng.choice(OUTER)}">{page}</div>'
        out.append((f"<!DOCTYPE html><html><head><title>{line(1, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>", main))
    return out


@lru_cache(maxsize=4)
def train(count: int = TRAINING_PAGES, seed: int = SEED) -> Chain:
    """The chain of the labelled pages."""
    data = []
    for page, main in labelled_pages(count, seed):
        found, left = blocks(page), [" ".join(x.split()) for x in main]
        y, k = [], 0
        for b in found.blocks:
            y.append(int(k < len(left) and b.text == left[k]))
            k += y[-1]
        if k != len(left):
            raise AssertionError("a labelled page's main text isn't found in order")
        data.append((found, y))
    return fit(data)


def main_text(page: str | None, chain: Chain) -> str:
    """The blocks labelled main, in page order, joined by an empty line.

    Of a page with no such block those in an article or main element stand, unless a block's own features speak against it by MARGIN or more.
    """
    found = blocks(page)
    labels = chain.viterbi(found)
    if not any(labels):
        labels = [not {"a:article", "a:main"}.isdisjoint(f) and chain.odds(f) > -MARGIN for f in _features(found)]
    return "\n\n".join(b.text for b, keep in zip(found.blocks, labels) if keep)


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """One row per page: id_col, url, text (main text, empty if none), n_chars (its code points).

    A null or empty page gives an empty text; pages of any length are read whole, in time that follows their length; of equally
    likely labellings that with less text is taken; repeated rows give a row each and repeated blocks stay; other columns are ignored; an empty table gives an empty result. The model is
    trained on the driver on ``training_pages`` made pages and goes to the tasks with the function.
    """
    chain = train(training_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h, chain) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"{id_col} long, url string, text string, n_chars long")
