"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between block-level tags, with the path of open
elements and their class and id words. Each block becomes a vector of hashed path parts, hashed
words and a few figures; a numpy LSTM reads the page's vectors in both directions, so every block is judged with
all others in view. Blocks labelled as content are joined in page order.

The network is trained here, on the driver, on PAGES pages that a seeded generator writes: articles
in varied markup among menus, headers, footers, sidebars, notices, adverts, forms and comments. It
reads nothing of the input, so its cost does not grow. It is sent to the tasks (about 100 kB) and
applied page by page, in batches of pages of similar length; nothing is shuffled.

Null and empty pages give an empty text. White space inside a block becomes one space;
character references are decoded; scripts, styles, templates, comments, titles and the head are skipped (the head ends at the first
text or element that can't stand in it), nothing else is. Tags are read by the states of the HTML tokenizer: a quote opens a value
only after an equals sign. A tag that the end of the page cuts off is dropped, a template without an end is no template.
Nesting has no limit: an element keeps the slots of its whole path as bits. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as kernels
from .common import slices

PATH, WORDS, FIGURES, HIDDEN, PAGES, EPOCHS, SEED = 128, 64, 6, 24, 600, 14, 5
SIZE = PATH + WORDS + FIGURES
#: A tag without attributes; the name of any tag; one attribute, by the states of the HTML tokenizer.
_PLAIN = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*+)\s*+/?>")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+(=)\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?)?")
_COMMENT_END = re.compile(r"--!?>")
_PART = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")
RAW = frozenset(("script", "style"))
#: Elements that may stand in the head; any other ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    (
        "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em embed font g i iframe img ins kbd label map mark noscript object picture q rp rt ruby s samp small "
        "span strike strong sub sup svg text time tspan tt u var video wbr math maction menclose merror mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle "
        "msub msubsup msup mtext munder munderover semantics annotation"
    ).split()
)
#: Elements that a new one of the same group closes.
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Block:
    __slots__ = ("path", "pieces", "linked")

    def __init__(self, path: tuple[int, int]) -> None:
        self.path, self.pieces, self.linked = path, [], 0


def _slot(part: str, cache: dict[str, int] = {}) -> int:
    if part not in cache:
        if len(cache) > 100_000:
            cache.clear()
        h = 2166136261
        for c in part.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        cache[part] = (h ^ h >> 13) % PATH
    return cache[part]


def mask(*parts: str) -> int:
    """The slots of path parts, as bits."""
    out = 0
    for part in parts:
        out |= 1 << _slot(part)
    return out


def tag_at(page: str, at: int) -> tuple[str, bool, list[str], int]:
    """The tag at page[at] == '<': its name ('' if it is none), whether it closes itself, words of class, id and role, and its end.

    A quote opens a value only after an equals sign. A tag that the page's end cuts off ends there.
    """
    m = _PLAIN.match(page, at)
    if m:
        return m[1].lower(), page[m.end() - 2] == "/", [], m.end()
    m = _NAME.match(page, at)
    if m is None:
        return "", False, [], at
    name, marks, at, end = m[1].lower(), [], m.end(), len(page)
    while at < end and page[at] != ">":
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if m[2] and at < end and page[at] in "\"'" and m[3] is m[4] is m[5] is None:  # a value that never ends
            return name, False, [], end
        if m[1] and m[1].lower() in ("class", "id", "role"):
            marks += _PART.findall((m[3] or m[4] or m[5] or "").lower())
    return name, page[at - 1] == "/", marks, min(end, at + 1)


def blocks(page: str) -> list[tuple[tuple[int, int], str, float]]:
    """Leaf blocks: path (slots of its parts as bits, number of parts), text, share of linked characters."""
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    opened: dict[str, int] = {}  # elements of the stack by name
    found: list[Block] = []
    current: Block | None = None
    link, hidden, at, end, in_head = 0, 0, 0, len(page), False

    def add(raw: str) -> None:
        nonlocal current, in_head
        if not raw or hidden or (current is None and raw.isspace()):
            return
        in_head = in_head and raw.isspace()
        if in_head:
            return
        if current is None:
            current = Block(stack[-1][1:])
            found.append(current)
        current.pieces.append(html_lib.unescape(raw))
        if link:
            current.linked += len(current.pieces[-1])

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        add(page[at:begin])
        at = begin
        if page.startswith("<!--", at):
            m = _COMMENT_END.search(page, at + 2)  # <!--> is a whole comment
            at = m.end() if m else end
            continue
        if page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            add(html_lib.escape(page[at + 9 : stop if stop >= 0 else end]))
            at = stop + 3 if stop >= 0 else end
            continue
        closing = page.startswith("</", at)
        name, single, marks, stop = tag_at(page, at)
        if not name:
            if page[at + 1 : at + 2] in ("!", "?", "/") and page[at + 1 : at + 2]:  # a doctype, an instruction or </ without a name
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else end
            else:
                add("<")
                at += 1
            continue
        at = stop
        if stop == end and page[end - 1] != ">":
            break
        if name == "template":
            if closing:
                hidden = max(0, hidden - 1)
            elif re.compile("</template[\\s/>]", re.I).search(page, at):
                hidden += 1
            current = None
            continue
        if name in RAW or name == "title":
            if not closing:
                m = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
                at = m.start() if m else at if name == "title" else end
            current = current if in_head or name in RAW else None
            continue
        if name == "head":
            in_head = not closing
            continue
        in_head = in_head and (closing or name in IN_HEAD)
        if name == "a":
            link = 0 if closing else 1
        if name in INLINE:
            if name == "br":
                add(" ")
            continue
        current = None
        if closing:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if stack[-1][0] == "p" or stack[-1][0] in (CLOSED_BY.get(name) or ()):
            pop()
            if stack[-1][0] in (CLOSED_BY.get(name) or ()):
                pop()
        if name not in VOID and not single:
            stack.append((name, stack[-1][1] | mask(name, *marks), stack[-1][2] + 1 + len(marks)))
            opened[name] = opened.get(name, 0) + 1
    out = []
    for b in found:
        raw = "".join(b.pieces)
        value = _SPACES.sub(" ", raw).strip()
        if value:
            out.append((b.path, value, b.linked / len(raw)))
    return out


def vectors(pages: list[list[tuple[tuple[int, int], str, float]]]) -> list[np.ndarray]:
    """(blocks, SIZE) input of each page."""
    flat = [b for page in pages for b in page]
    x = np.zeros((len(flat), SIZE), np.float32)
    if flat:
        hashes, bounds = kernels.words(pa.array([b[1] for b in flat]))
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(flat)), n)
        bag = np.bincount(row * WORDS + (hashes >> np.uint64(58)).astype(np.int64), minlength=len(flat) * WORDS).reshape(-1, WORDS)
        x[:, PATH : PATH + WORDS] = np.minimum(bag / np.sqrt(np.maximum(n, 1))[:, None] / 2, 0.6)  # one word again and again says no more
        paths = np.frombuffer(b"".join(b[0][0].to_bytes(PATH // 8, "little") for b in flat), np.uint8).reshape(-1, PATH // 8)
        x[:, :PATH] = np.unpackbits(paths, axis=1, bitorder="little")
        for i, ((_, depth), value, linked) in enumerate(flat):
            sentence = value.count(". ") + (value[-1] in ".!?")
            x[i, PATH + WORDS :] = linked, np.log1p(n[i]) / 4, np.log1p(len(value)) / 6, min(sentence, 8) / 8, value[-1] in ".!?", min(depth, 40) / 10
    cuts = np.cumsum([0, *map(len, pages)])
    return [x[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one a direction, and a logistic output on both states."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"{d}x"] = rng.normal(0, 0.1, (SIZE, 4 * HIDDEN))
            self.p[f"{d}h"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.p[f"{d}0"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["o"], self.p["o0"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, pages, HIDDEN) of direction d over x (time, pages, SIZE)."""
        pre = x @ self.p[f"{d}x"] + self.p[f"{d}0"]
        t_max, n, _ = x.shape
        h, c, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((t_max, n, HIDDEN))
        for t in range(t_max) if d == "f" else reversed(range(t_max)):
            z = pre[t] + h @ self.p[f"{d}h"]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = []
        for d in "fb":
            steps = None if keep is None else []
            both.append(self._run(d, x, mask, steps))
            if keep is not None:
                keep[d] = steps
        states = np.concatenate(both, axis=2)
        if keep is not None:
            keep["s"] = states
        return states @ self.p["o"] + self.p["o0"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, by back-propagation through time."""
        keep: dict = {}
        err = (_sigmoid(self.logits(x, mask, keep)) - y) * mask / mask.sum()
        grad = {"o": np.tensordot(err, keep["s"], ((0, 1), (0, 1))), "o0": np.array([err.sum()])}
        up = err[:, :, None] * self.p["o"]
        for k, d in enumerate("fb"):
            own = up[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros(own.shape[1:]), np.zeros(own.shape[1:])
            gx, gh, dz_all = self.p[f"{d}x"], np.zeros_like(self.p[f"{d}h"]), np.zeros((*own.shape[:2], 4 * HIDDEN))
            for t, h, c, i, f, o, g, tanh, m in reversed(keep[d]):
                total = dh + own[t]
                live = np.where(m, total, 0)
                cell = np.where(m, dc + live * o * (1 - tanh * tanh), 0)
                dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), live * tanh * o * (1 - o), cell * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = np.where(m, dz @ self.p[f"{d}h"].T, total)
                dc = np.where(m, cell * f, dc)
            grad[f"{d}x"], grad[f"{d}h"], grad[f"{d}0"] = np.tensordot(x, dz_all, ((0, 1), (0, 1))), gh, dz_all.sum((0, 1))
        return grad

    def content(self, inputs: list[np.ndarray], batch: int = 128) -> list[np.ndarray]:
        """Whether each block is content; pages of similar length are run together."""
        out = [np.zeros(len(x), bool) for x in inputs]
        order = sorted((i for i in range(len(inputs)) if len(inputs[i])), key=lambda i: len(inputs[i]))
        at = 0
        while at < len(order):
            longest, part = 0, []
            while at < len(order) and len(part) < batch:
                longest = max(longest, len(inputs[order[at]]))
                if part and longest * (len(part) + 1) > 40_000:
                    break
                part.append(order[at])
                at += 1
            x, mask = _padded([inputs[i] for i in part])
            z = self.logits(x, mask)
            for k, i in enumerate(part):
                out[i] = z[: len(inputs[i]), k] > 0
        return out


def _padded(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, inputs))
    x, mask = np.zeros((t, len(inputs), SIZE)), np.zeros((t, len(inputs)), bool)
    for k, v in enumerate(inputs):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


# The generator of training pages.
_MENU = "home about contact news products login register search archive help sitemap blog shop cart account sports world".split()
_NOTICE = ["we use cookies to improve your visit", "accept all cookies", "this site requires javascript", "subscribe to our newsletter", "sign up for updates", "you have reached your limit of free articles"]
_FOOT = ["all rights reserved", "copyright 2024 example inc", "privacy policy", "terms of use", "powered by example", "follow us on social media"]
_SIDE = ["most read", "related stories", "popular posts", "recent comments", "tags", "categories", "you may also like"]
_AD = ["advertisement", "sponsored content", "buy now and save", "limited offer", "click here for a free trial"]
_CALL = ["great article thanks", "i disagree with this", "first", "reply", "well said", "can you explain more"]


def _words(rng: np.random.Generator, low: int, high: int) -> str:
    letters = np.array(list("etaoinshrdlucmfwygpbvkéèñóüäßçí"))
    n = int(rng.integers(low, high + 1))
    value = " ".join("".join(rng.choice(letters, int(k))) for k in rng.integers(1, 11, n))
    return value.capitalize() + ("." if rng.random() < 0.85 else "")


def training_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and the labels of its blocks in order."""
    out, y = [], []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    noise = lambda xs: pick(xs) if rng.random() < 0.5 else _words(rng, 1, 14)

    def put(tag: str, value: str, label: bool, attr: str = "") -> None:
        inner = value if rng.random() > 0.15 else f"<b>{value}</b>" if rng.random() < 0.5 else f"{value}<br>"
        out.append(f"<{tag}{attr}>{inner}</{tag}>" if tag != "p" or rng.random() < 0.8 else f"<p{attr}>{inner}")
        y.append(label)

    def wrap(names: list[tuple[str, str]], body) -> None:
        tag, attr = pick(names)
        out.append(f"<{tag}{attr}>")
        body()
        out.append(f"</{tag}>")

    def menu() -> None:
        out.append("<ul>")
        for _ in range(int(rng.integers(2, 9))):
            out.append(f'<li><a href="/x">{noise(_MENU)}</a></li>')
            y.append(False)
        out.append("</ul>")

    def few(xs: list[str], most: int = 3) -> None:
        for _ in range(int(rng.integers(1, most + 1))):
            value = noise(xs)
            if rng.random() < 0.4:
                out.append(value + " ")
                out.append("<div></div>")
                y.append(False)
            else:
                put(pick(["p", "div", "li", "h3"]), value if rng.random() < 0.6 else f'<a href="/y">{value}</a>', False)

    def form() -> None:
        out.append('<label>name</label><input name="q">')
        y.append(False)
        put("button", "submit", False)

    def comments() -> None:
        for _ in range(int(rng.integers(1, 5))):
            put(pick(["p", "div", "li"]), noise(_CALL) if rng.random() < 0.4 else _words(rng, 5, 40), False)

    def aside() -> None:
        put(pick(["h3", "h4"]), noise(_SIDE), False)
        menu() if rng.random() < 0.6 else few(_SIDE)

    AD = [("div", ' class="ad"'), ("div", ' class="ads banner"'), ("div", ' id="sponsored"'), ("aside", ' class="advert"'), ("div", ' class="promo"')]
    NOTICE = [("div", ' class="cookie-notice"'), ("div", ' id="banner" class="notice"'), ("div", ' role="alert"'), ("div", ' class="popup newsletter"'), ("section", ' class="notice"')]
    SIDE = [("aside", ""), ("div", ' class="sidebar"'), ("div", ' id="sidebar"'), ("section", ' class="related"'), ("div", ' class="widget"')]
    COMMENTS = [("section", ' class="comments"'), ("div", ' id="comments"'), ("div", ' class="comment-list"'), ("ol", ' class="replies comments"')]
    FORM = [("form", ""), ("form", ' class="search"'), ("form", ' id="login"')]

    def inside() -> None:
        """Among the article's own blocks there may be others."""
        if rng.random() < 0.12:
            wrap(AD, lambda: few(_AD, 2))
        if rng.random() < 0.05:
            wrap(FORM, form)
        if rng.random() < 0.06:
            wrap(SIDE, aside)

    def article() -> None:
        if rng.random() < 0.85:
            put("h1", _words(rng, 1, 14), True)
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.82:
                put("p", _words(rng, *((1, 6) if rng.random() < 0.15 else (8, 70))), True)
            elif kind < 0.88:
                put(pick(["h2", "h3"]), _words(rng, 1, 8), True)
            elif kind < 0.92:
                put("blockquote", _words(rng, 5, 40), True)
            elif kind < 0.96:
                out.append("<ul>")
                for _ in range(int(rng.integers(2, 5))):
                    put("li", _words(rng, 2, 20), True)
                out.append("</ul>")
            else:
                put("pre", _words(rng, 3, 20), True)
            inside()

    out.append(f'<html lang="en"><head><title>{_words(rng, 2, 9)}</title><script>var a = "</p>";</script></head><body>')
    if rng.random() < 0.5:
        wrap(NOTICE, lambda: few(_NOTICE, 2))
    if rng.random() < 0.5:
        wrap([("header", ""), ("div", ' class="header"'), ("div", ' id="top" class="site-header"')], lambda: (put(pick(["h2", "div", "p"]), _words(rng, 1, 5), False), menu() if rng.random() < 0.5 else None))
    if rng.random() < 0.9:
        wrap([("nav", ""), ("nav", ""), ("div", ' class="menu"'), ("div", ' id="nav" class="navbar"'), ("ul", ' class="nav"')], menu)
    for kind, body, share in ((AD, lambda: few(_AD, 2), 0.6), (SIDE, aside, 0.3), (FORM, form, 0.2)):
        if rng.random() < share:
            wrap(kind, body)
    outer = pick([None, None, ("main", ""), ("div", ' id="wrapper"'), ("div", ' class="container"')])
    if outer:
        out.append(f"<{outer[0]}{outer[1]}>")
    wrap([("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", ' class="article-body"'), ("div", ' id="content"'), ("div", ' class="post entry"'), ("section", ' class="story"'), ("div", "")], article)
    for kind, body, share in ((COMMENTS, comments, 0.4), (SIDE, aside, 0.35), (AD, lambda: few(_AD, 2), 0.3), (FORM, form, 0.25), (NOTICE, lambda: few(_NOTICE, 2), 0.15)):
        if rng.random() < share:
            wrap(kind, body)
    if outer:
        out.append(f"</{outer[0]}>")
    if rng.random() < 0.9:
        wrap([("footer", ""), ("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer" class="bottom"')], lambda: few(_FOOT) if rng.random() < 0.6 else (out.append(f"&copy; {_words(rng, 1, 3)} &middot; {_words(rng, 4, 24)}"), y.append(False)))
    out.append("</body></html>")
    return "".join(out), y


_TRAINED: dict[tuple[int, int, int], Labeller] = {}


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Adam over batches of generated pages; the same weights for the same parameters."""
    if (pages, epochs, seed) in _TRAINED:
        return _TRAINED[pages, epochs, seed]
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        page, y = training_page(rng)
        found = blocks(page)
        if len(found) == len(y):  # a rare page has an empty block
            data.append((found, np.array(y, float)))
    inputs = vectors([d[0] for d in data])
    net = Labeller(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(pages)
        order = order[np.argsort([len(inputs[i]) // 8 for i in order], kind="stable")]
        batches = np.array_split(order, max(1, pages // 24))
        for b in rng.permutation(len(batches)):
            x, mask = _padded([inputs[i] for i in batches[b]])
            x *= rng.random(x.shape) > 0.1  # dropout: no feature decides alone
            y = np.zeros(mask.shape)
            for k, i in enumerate(batches[b]):
                y[: len(inputs[i]), k] = data[i][1]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for key, g in net.gradient(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.99 * v[key] + 0.01 * g * g
                net.p[key] = net.p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)
    _TRAINED[pages, epochs, seed] = net
    return net


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """One row a page: id, url, text, n_chars, n_blocks."""
    sent = pages.sparkSession.sparkContext.broadcast(net or train())  # fixed size: the network's weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [blocks(x or "") for x in part.column("html").to_pylist()]
                keep = sent.value.content(vectors(found))
                texts = ["\n".join(b[1] for b, k in zip(bs, ks) if k) for bs, ks in zip(found, keep)]
                cols = [part.column("id"), part.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long, n_blocks long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
