"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text under the same block
elements). Each block is a vector of its tag path with class, id and role words, of its
hashed words and of a few figures (length, links, punctuation, place). A bidirectional
LSTM in numpy reads the sequence both ways and labels every block, so each decision
sees the whole page. It is trained here on a bounded sample of pages, with labels from
the paths that name themselves, and on generated pages whose layout says less.

Defined results: a null, empty or text-less page has an empty text; pages of any length
are read whole, in training too; columns named `text` and `n_chars` are replaced, the others
are kept; broken markup never fails (a text without tags is one block); equal
pages get equal texts; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import hashed_share, with_struct, word_hashes

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
# Element names of HTML by their part in the layout.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
KEEPS_P = frozenset("button caption option optgroup select legend summary td th".split())
# Words of class, id and role attributes, and elements, that name what isn't the article.
BOILER = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search form comment comments reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget copyright legal toolbar skip topbar bottombar complementary contentinfo dialog".split()
)
ARTICLE = frozenset("article main content post entry story text body".split())

N_PATH, N_WORD, N_FIGURE = 512, 64, 10
DIM = N_PATH + N_WORD + N_FIGURE


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    links: float


def _tokens(tag: str, attrs: str) -> tuple[str, ...]:
    found = ["<" + tag]
    if attrs and "=" in attrs:
        for m in ATTR.finditer(attrs):
            found += [w for w in SPLIT.split((m[2] or m[3] or m[4] or "").lower()) if w]
    return tuple(found)


def parse(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with their paths; text of raw elements is left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    state = {"links": 0, "depth": 0}

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append(Block(text, tuple(t for tag, own in stack if tag in BLOCK or len(own) > 1 for t in own), min(1.0, state["links"] / len(text))))
            held.clear()
        state["links"] = 0

    def add(text: str) -> None:
        if text:
            held.append(text)
            if state["depth"]:
                state["links"] += len(text.strip())

    def pop_to(i: int) -> None:
        flush()
        state["depth"] -= sum(tag == "a" for tag, _ in stack[i:])
        del stack[i:]

    page = page or ""
    at = 0
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:  # an end tag
            if tag == "br":
                add(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCK:
                        pop_to(i)
                    else:
                        if tag == "a":
                            state["depth"] -= 1
                        del stack[i]
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            if not attrs.endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                add(" " if tag != "wbr" else "")
                if tag == "hr":
                    flush()
            continue
        if tag in BLOCK:
            if tag in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[tag]:
                        pop_to(i)
                        break
                    if stack[i][0] in STOPS[tag]:
                        break
            if tag not in KEEPS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            flush()
        if not attrs.endswith("/") or tag in BLOCK:
            stack.append((tag, _tokens(tag, attrs)))
            state["depth"] += tag == "a"
    add(page[at:])
    flush()
    return out


# --- vectors ------------------------------------------------------------------------


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(N_PATH, np.float32)
    for t in path:
        v[zlib.crc32(t.encode()) % N_PATH] += 1
    tags = [t for t in path if t[0] == "<"]
    if tags:
        v[zlib.crc32(("leaf" + tags[-1]).encode()) % N_PATH] += 1
    return np.minimum(v, 2)


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), DIM), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        out[i, :N_PATH] = _path_vector(b.path)
        data = b.text.lower().encode("utf-8", "surrogatepass")
        h, _ = word_hashes(data)
        k = len(h)
        if k:
            out[i, N_PATH : N_PATH + N_WORD] = np.bincount((h % np.uint64(N_WORD)).astype(np.int64), minlength=N_WORD) / k
        stops = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
        out[i, N_PATH + N_WORD :] = (np.log1p(k) / 5, b.links, min(1.0, 5 * stops / max(1, k)), i / n, min(i, 10) / 10, min(n - 1 - i, 10) / 10, np.log1p(n) / 6, k < 4, k > 15, b.text[-1:] in ".!?")
    return out


# --- the network --------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w, u, b, keep: bool):
    """Hidden states over (time, batch, features); where the mask is 0 the state stays."""
    steps, n, _ = x.shape
    size = u.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    hs, kept = np.empty((steps, n, size), np.float32), []
    z_in = x.reshape(steps * n, -1) @ w + b
    z_in = z_in.reshape(steps, n, -1)
    for t in range(steps):
        z = z_in[t] + h @ u
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        h_new = o * tc
        if keep:
            kept.append((h, c, i, f, o, g, tc, m))
        h, c = m * h_new + (1 - m) * h, m * c_new + (1 - m) * c
        hs[t] = h
    return hs, kept


def _lstm_back(x, kept, dhs, w, u):
    """Gradients of w, u and b from the gradients of all hidden states."""
    steps, n, _ = x.shape
    size = u.shape[0]
    dz_all = np.empty((steps, n, 4 * size), np.float32)
    dh, dc, du = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32), np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h0, c0, i, f, o, g, tc, m = kept[t]
        dh = dh + dhs[t]
        own, pass_h, pass_c = dh * m, dh * (1 - m), dc * (1 - m)
        dct = dc * m + own * o * (1 - tc * tc)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), own * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
        dz_all[t] = dz
        du += h0.T @ dz
        dh, dc = dz @ u.T + pass_h, dct * f + pass_c
    flat = dz_all.reshape(steps * n, -1)
    return x.reshape(steps * n, -1).T @ flat, du, flat.sum(0)


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence backwards within its own length."""
    out = np.zeros_like(x)
    for j, n in enumerate(lengths):
        out[:n, j] = x[:n, j][::-1]
    return out


@dataclass
class BlockModel:
    """Weights: of both directions (w, u, b), then of the label (from both states and the block itself)."""

    weights: list[np.ndarray]
    threshold: float = 0.5

    @staticmethod
    def fresh(hidden: int, rng) -> BlockModel:
        def one():
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1  # remember at first
            return [(rng.normal(0, 1, (DIM, 4 * hidden)) * 0.08).astype(np.float32), (rng.normal(0, 1, (hidden, 4 * hidden)) * 0.15).astype(np.float32), b]

        return BlockModel([*one(), *one(), np.zeros(2 * hidden + DIM, np.float32), np.zeros(1, np.float32)])

    def forward(self, pages: list[np.ndarray], keep: bool = False):
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((lengths.max(), len(pages), DIM), np.float32)
        for j, p in enumerate(pages):
            x[: len(p), j] = p
        mask = (np.arange(len(x))[:, None] < lengths[None]).astype(np.float32)
        w1, u1, b1, w2, u2, b2, v, c = self.weights
        hf, kf = _lstm(x, mask, w1, u1, b1, keep)
        xr = _reverse(x, lengths)
        hr, kr = _lstm(xr, mask, w2, u2, b2, keep)
        both = np.concatenate([hf, _reverse(hr, lengths), x], 2)
        return _sigmoid(both @ v + c[0]), (x, xr, mask, lengths, both, kf, kr)

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients of the mean cross entropy."""
        p, (x, xr, mask, lengths, both, kf, kr) = self.forward(pages, True)
        y = np.zeros_like(p)
        for j, own in enumerate(labels):
            y[: len(own), j] = own
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        w1, u1, b1, w2, u2, b2, v, c = self.weights
        size = u1.shape[0]
        dh = d[:, :, None] * v[: 2 * size]
        g1 = _lstm_back(x, kf, dh[:, :, :size], w1, u1)
        g2 = _lstm_back(xr, kr, _reverse(dh[:, :, size:], lengths), w2, u2)
        return [*g1, *g2, np.tensordot(d, both, ((0, 1), (0, 1))), np.array([d.sum()])]

    def label(self, pages: list[np.ndarray], steps: int = 16_000) -> list[np.ndarray]:
        """A probability for each block of each page; pages of like length run together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and len(pages[order[b]]) * (b + 1 - a) <= steps:
                b += 1
            p, _ = self.forward([pages[i] for i in order[a:b]])
            for j, i in enumerate(order[a:b]):
                out[i] = p[: len(pages[i]), j]
            a = b
        return out


# --- training -----------------------------------------------------------------------


def teacher(b: Block) -> int:
    """What a block's path says of itself; without a word of either kind, long blocks of few links are text."""
    names = {t.lstrip("<") for t in b.path}
    inside = "article" in names or "main" in names
    if (names - ({"header"} if inside else set())) & BOILER or b.links > 0.6:
        return 0
    if inside or names & ARTICLE - {"body", "text"}:
        return 1
    return int(len(b.text) >= 60)


#: Words that names of parts are joined with, and that say nothing of the part.
NEUTRAL = tuple("area thread box list wrap wrapper container section block item inner col left right page site".split())


def generated(words: list[str], rng) -> tuple[list[Block], list[int]]:
    """A page of a random layout from the given words, with its labels: with or without telling names, in boxes, cells of a table or none at all, its paragraphs in any element, its comments few or many."""
    pick = lambda n: " ".join(words[int(i)] for i in rng.integers(0, len(words), n))
    noise = lambda: "".join(chr(97 + int(i)) for i in rng.integers(0, 26, 6))
    one = lambda *xs: xs[int(rng.integers(len(xs)))]
    named = rng.random() < 0.65
    div = "<td" if rng.random() < 0.12 else "<div"

    def cls(*names: str) -> tuple[str, ...]:
        if rng.random() >= (0.95 if named else 0.35):
            return (noise(),) if rng.random() < 0.7 else ()
        k = rng.random()
        return (one(*names),) if k < 0.65 else (one(*names), one(*NEUTRAL)) if k < 0.9 else (one(*NEUTRAL), one(*names))

    def sentence(n: int) -> str:
        return pick(n).capitalize() + "."

    blocks: list[Block] = []
    labels: list[int] = []
    top = ("<html", "<body", *(("<div", one(noise(), *NEUTRAL)) if rng.random() < 0.4 else ()), *(("<table", "<tr") if div == "<td" else ()))
    kind = rng.random()
    bare = kind < 0.12

    def put(text: str, path: tuple[str, ...], links: float, y: int) -> None:
        blocks.append(Block(text, (*top, *path), links))
        labels.append(y)

    def boiler(kind: str) -> None:
        loose = bare and rng.random() < 0.5  # nothing names the part but its words, links and place
        if kind == "nav":
            box = ("<nav",) if rng.random() < 0.5 else (div, *cls("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar"))
            if loose or rng.random() < 0.3:
                put(" ".join(one("Home", "About", "News", "Contact", "Blog", pick(1)) for _ in range(int(rng.integers(2, 7)))), ("<p",) if loose else box, 0.6 + 0.4 * rng.random(), 0)
                return
            for _ in range(int(rng.integers(2, 9))):
                put(pick(int(rng.integers(1, 4))), (*box, "<ul", "<li"), 1.0, 0)
        elif kind == "header":
            box = ("<header",) if rng.random() < 0.6 else (div, *cls("header", "masthead", "banner", "topbar"))
            put(pick(int(rng.integers(1, 6))), (*box, *one((), ("<h1",), ("<p",))), rng.random() if rng.random() < 0.5 else 0.0, 0)
        elif kind == "ad":
            box = ("<aside",) if rng.random() < 0.2 else (one(div, div, div, "<section"), *cls("ad", "ads", "advert", "advertisement", "adverts", "sponsored", "sponsor", "promo", "promotion", "banner"))
            for _ in range(int(rng.integers(1, 3))):
                put(one("", "", "Buy now! ", "Sponsored: ") + sentence(int(rng.integers(3, 30))), box if rng.random() < 0.6 else (*box, "<p"), float(rng.random() < 0.3), 0)
        elif kind == "side":
            box = ("<aside", *(cls("sidebar", "related") if rng.random() < 0.4 else ())) if rng.random() < 0.5 else (div, *cls("sidebar", "side", "widget", "related", "recommended", "share", "social"))
            leaf = one(("<p",), ("<li",), ("<h3",), ("<div",))
            for _ in range(int(rng.integers(1, 6))):
                put(sentence(int(rng.integers(2, 25))), (*box, *leaf), float(rng.random() < 0.5), 0)
        elif kind == "notice":
            box = (one(div, div, div, "<dialog"), *cls("cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "alert"))
            put(one("", "", "We use cookies. ", "Sign up to our newsletter. ") + sentence(int(rng.integers(3, 30))), box if rng.random() < 0.5 else (*box, "<p"), 0.0, 0)
            if rng.random() < 0.5:
                put(pick(1), (*box, "<button"), 0.0, 0)
        elif kind == "form":
            box = (*((div, *cls("login", "search", "signup", "subscribe", "form")) if rng.random() < 0.4 else ()), "<form")
            for _ in range(int(rng.integers(1, 4))):
                put(pick(int(rng.integers(1, 6))), (*box, one("<label", "<button", "<p", "<div")), 0.0, 0)
        elif kind == "comments":
            box = (one("<section", div), *cls("comments", "comment", "replies", "discussion", "respond", "disqus"))
            if rng.random() < 0.7:
                put(one("Comments", "Replies", pick(2)), (*box, one("<h2", "<h3")), 0.0, 0)
            entry = (one("<div", "<article", "<li"), *cls("comment", "reply"))
            leaf = one((), ("<p",), ("<p",), ("<div",))
            for _ in range(int(rng.integers(1, 7)) if rng.random() < 0.7 else int(rng.integers(7, 40))):
                if rng.random() < 0.2:
                    put(pick(1), (*box, *entry, *one((), ("<h4",), ("<div",))), 0.0, 0)
                put(sentence(int(rng.integers(3, 60))), (*box, *entry, *leaf), 0.0, 0)
        elif kind == "footer":
            box = ("<p",) if loose else ("<footer",) if rng.random() < 0.6 else (div, *cls("footer", "copyright", "legal", "bottom", "contentinfo"))
            for _ in range(1 if loose else int(rng.integers(1, 5))):
                right = loose or rng.random() < 0.4
                put((one("© ", "Copyright ", "Copyright © ") + str(int(rng.integers(1995, 2030))) + " " if right else "") + sentence(int(rng.integers(2, 8 if loose else 20))) + (" All rights reserved." if right and rng.random() < 0.6 else ""), box if loose or rng.random() < 0.5 else (*box, "<p"), float(rng.random() < 0.3), 0)

    busy = one(0.25, 0.6, 1.0, 1.0)
    # without names nothing tells a box of prose from the article, so such pages have few
    shown = lambda k: named or k not in ("ad", "side", "notice", "comments") or rng.random() < 0.25

    def some(kinds: list[str], share: float) -> None:
        for k in kinds:
            if rng.random() < share * busy and shown(k):
                boiler(k)

    some(["notice", "header", "nav", "ad"], 0.6)
    around = ("<main",) if rng.random() < 0.15 else ()
    box = () if bare else ("<article",) if kind < 0.4 else ("<main",) if kind < 0.5 else ("<main", "<article") if kind < 0.6 else (div, *cls("content", "post", "entry", "article", "story", "main"))
    if around and box[:1] != ("<main",):
        box = (*around, *box)
    if rng.random() < 0.3:
        box = (*box, "<section" if rng.random() < 0.5 else "<div", *cls("body", "text", "content"))
    if rng.random() < 0.7:
        put(pick(int(rng.integers(2, 14))), (*box, *(("<header",) if rng.random() < 0.2 else ()), one("<h1", "<h1", "<h2")), 0.0, 1)
    usual = ("<p",) if rng.random() < 0.8 or bare else ("<div",)
    size, again = one(90, 90, 90, 8), rng.random() < 0.15  # some articles have short lines only, some repeat theirs
    for _ in range(int(rng.integers(1, 14)) if rng.random() < 0.85 else int(rng.integers(14, 100))):
        k = 0.0 if again and rng.random() < 0.8 else rng.random()
        n = int(rng.integers(1, size))
        leaf = usual if k < 0.72 else ("<h2",) if k < 0.79 else ("<ul", "<li") if k < 0.86 else ("<blockquote", "<p") if k < 0.9 else ("<pre",) if k < 0.93 else ("<figure", "<figcaption") if k < 0.95 else ("<table", "<tr", "<td")
        put(blocks[-1].text if again and labels[-1:] == [1] and rng.random() < 0.6 else sentence(n if leaf == usual else max(1, n // 4)), (*box, *leaf), float(rng.random() < 0.1) * 0.3, 1)
        if rng.random() < 0.07 and shown(inner := one("ad", "side", "notice", "form")):
            held = len(blocks)
            boiler(inner)
            for b in blocks[held:]:  # inside the article
                b.path = (*top, *box, *b.path[len(top) :])
    if around and rng.random() < 0.6 and shown("comments"):
        held = len(blocks)
        boiler("comments")
        for b in blocks[held:]:  # beside the article, in the same main part
            b.path = (*top, *around, *b.path[len(top) :])
    some(["comments", "side", "form", "ad", "nav", "footer", "notice"], 0.5)
    return blocks, labels


def fit_pages(sample: list[str], hidden: int = 16, epochs: int = 6, made: int = 1600, rate: float = 0.01, batch: int = 24, seed: int = 7, window: int = 400) -> BlockModel:
    """Train on the sample (labels by the teacher) and on `made` generated pages, in pieces of at most `window` blocks; the weights are the last epoch's mean."""
    rng = np.random.default_rng(seed)
    parsed = [p for p in map(parse, sample) if p]
    words = [w for p in parsed for b in p for w in b.text.split()] or ["text", "page", "word", "line"]
    data = []
    for p in parsed:
        x, y = vectors(p), np.array([teacher(b) for b in p], np.float32)
        data += [(x[a : a + window], y[a : a + window]) for a in range(0, len(p), window)]
    for _ in range(made):
        blocks, labels = generated(words, rng)
        data.append((vectors(blocks), np.array(labels, np.float32)))
    model = BlockModel.fresh(hidden, rng)
    m = [np.zeros_like(w) for w in model.weights]
    mean, n_mean = [np.zeros(w.shape) for w in model.weights], 0
    v = [np.zeros_like(w) for w in model.weights]
    t = 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 8, rng.random()))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for gi in rng.permutation(len(groups)):
            own = groups[gi]
            grads = model.step([data[i][0] for i in own], [data[i][1] for i in own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            t += 1
            lr = rate * (0.3 if epoch == epochs - 1 else 1) * min(1, t / 20)
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(norm, 1e-9)) + 1e-6 * model.weights[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.weights[k] = (model.weights[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            if epoch == epochs - 1:
                mean, n_mean = [a + w for a, w in zip(mean, model.weights, strict=True)], n_mean + 1
    return BlockModel([(a / n_mean).astype(np.float32) for a in mean], model.threshold) if n_mean else model


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", max_pages: int = 400, **options) -> BlockModel:
    """Fit on about `max_pages` pages chosen by a hash of the id."""
    known = pages.where(F.col(html).isNotNull() & F.col(key).isNotNull())
    share = min(1.0, max_pages / max(1, pages.select(key).count()))
    return fit_pages(sorted(r[0] for r in known.where(hashed_share(F.col(key), share)).select(html).collect()), **options)


def main_text(model: BlockModel, pages: list[str | None]) -> list[str]:
    parsed = [parse(p) for p in pages]
    found = model.label([vectors(b) for b in parsed])
    return [" ".join(b.text for b, y in zip(blocks, p, strict=True) if y >= model.threshold) for blocks, p in zip(parsed, found, strict=True)]


def extract(pages: DataFrame, model: BlockModel, html: str = "html", group: int = 256) -> DataFrame:
    """Append text and n_chars (its code points); the column of the pages' source stays."""

    @F.arrow_udf("struct<text: string, n_chars: bigint>")
    def run(col: pa.Array) -> pa.Array:
        texts = [t for a in range(0, len(col), group) for t in main_text(model, [x.as_py() for x in col[a : a + group]])]
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n_chars"])

    return with_struct(pages, "main", run(F.col(html)), ["text", "n_chars"])
