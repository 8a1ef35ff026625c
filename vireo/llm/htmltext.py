"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (leaves between block-level tags). Each block has the tokens of its tag path (tags, and the words of
class, id and role), its words, and a few numbers (length, share of links, position). A bidirectional LSTM in numpy reads hashed
path and word vectors of the whole sequence, so that every block is labelled in view of the whole page; blocks labelled as
main text are joined in page order. Text is kept wherever it stands but in scripts, styles, titles, frames, drawings and form fields: so it
is in noscript, template, canvas, audio, video and xmp.

The model is trained here, on PAGES pages drawn by rule from TEMPLATES of layouts with known labels (no page of the input is
used), with a fixed seed: the same weights each time. They take some hundred kilobytes, whatever the input.

Defined cases: a null or empty html has no blocks and an empty text; a null url or page_id passes; unclosed, stray and nested
tags are put right as browsers do, roughly; repeated rows are extracted each; an empty table gives an empty result; other
columns of the input are never read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import one_blas_thread, read_table, small_batches

PATH_BUCKETS, WORD_BUCKETS = 2048, 256
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 16, 6, 8, 16
PAGES, BATCH, EPOCHS, SEED = 700, 24, 5, 11
STEPS = 4096  # blocks whose products are worked out at a time
HELD = 20_000  # blocks that are held before they are labelled, beside a page that has more

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out with all up to their end, which is the page's end if nothing closes them; xmp shows what is in it as it stands.
RAW = frozenset("script style textarea title iframe noframes".split())
SHOWN = "xmp"
UNSEEN = frozenset("svg select".split())  # left out with all up to their end; only the tag is if nothing closes it
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: What an opening tag closes first, within the given borders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Block:
    path: int  # the buckets of its path's tokens as bits, and that of what it stands in
    text: str
    linked: int  # characters within links


@dataclass
class _Open:
    tag: str
    path: int = 0  # bits of all tokens down to here
    last: str = ""


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % buckets


@lru_cache(maxsize=50_000)
def _bit(token: str) -> int:
    return 1 << _bucket(token, PATH_BUCKETS)


def _tokens(tag: str, attrs: str) -> list[str]:
    out = [tag]
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role", "itemprop"):
                out += ["." + w.lower() for w in _CAMEL.findall(value)]
            elif name == "hidden" or name == "style" and "none" in value or name == "aria-hidden" and value == "true":
                out.append("!hidden")
    return out


class _Scanner:
    """Where tags end, each place looked at a bounded number of times: what one search has found to lead nowhere no other tries again."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self._ends: dict[str, int] = {}
        self._lost: set[int] = set()  # quotation marks from which no end is reached outside of quotations

    def find(self, text: str, at: int) -> int:
        """The place of a text from at on, or -1, which is remembered."""
        if at >= self._ends.get(text, len(self.page) + 1):
            return -1
        found = self.page.find(text, at)
        if found < 0:
            self._ends[text] = min(at, self._ends.get(text, at))
        return found

    def tag_end(self, at: int) -> int:
        """The > that ends a tag, outside of quotations if one is; -1 if there is none."""
        if at > self.last:
            return -1
        seen, place = [], at
        while (m := _STOP.search(self.page, place)) and m.start() not in self._lost:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            if (close := self.find(m[0], m.end())) < 0:
                break
            place = close + 1
        self._lost.update(seen)
        return self.find(">", at)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, character references decoded and white space made single spaces.

    Time and memory grow with the page's length: tags are told apart in one pass, open tags are found by name, and a path is a number
    that an element takes over from the one around it.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of open tags, in the stack
    framed: list[int] = []  # of those that make blocks
    parts: list[tuple[str, bool]] = []
    where = _Open("")
    links = 0
    unclosed: set[str] = set()
    scan = _Scanner(page)

    def flush() -> None:
        if not parts:
            return
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(p.strip()) for p, in_link in parts if in_link)
            out.append(Block(where.path | (_bit("<" + where.last) if where.last else 0), text, min(linked, len(text))))
        parts.clear()

    def add(text: str) -> None:
        nonlocal where
        if not text:
            return
        if not parts:
            if text.isspace():
                return
            where = stack[-1] if stack else _Open("")
        parts.append((text, links > 0))

    def pop(to: int) -> None:
        nonlocal links
        for x in reversed(stack[to:]):
            places[x.tag].pop()
            if x.tag in BLOCK:
                framed.pop()
                flush()
            links -= x.tag == "a"
        del stack[to:]

    def last_of(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def push(tag: str, attrs: str) -> None:
        nonlocal links
        tokens = _tokens(tag, attrs)
        bits = stack[-1].path if stack else 0
        for t in tokens:
            if t not in ("html", "body"):
                bits |= _bit(t)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            framed.append(len(stack))
        stack.append(_Open(tag, bits, tokens[-1]))
        links += tag == "a"

    at, end = 0, len(page)
    while at < end:
        start = scan.find("<", at)
        if start < 0 or start > scan.last:
            # no tag ends from here on; a comment may begin
            comment = scan.find("<!--", at)
            add(page[at : comment if comment >= 0 else end])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            close = min((c for c in (scan.find("-->", start + 4), scan.find("--!>", start + 4)) if c >= 0), default=-1)
            at = end if close < 0 else page.index(">", close) + 1
            continue
        if page.startswith("<![CDATA[", start) and (close := scan.find("]]>", start)) >= 0:
            add(page[start + 9 : close])
            at = close + 3
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.index(">", start) + 1
            continue
        m = _NAME.match(page, start + 1)
        if m is None:
            add("<")
            at = start + 1
            continue
        close = scan.tag_end(m.end())
        tag, attrs = m[2].lower(), page[m.end() : close]
        at = close + 1
        if m[1]:
            if places.get(tag):
                pop(places[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW or tag in UNSEEN or tag == SHOWN:
            if tag == SHOWN:
                flush()
                push(tag, attrs)
            if (not attrs.rstrip().endswith("/") or tag != "svg") and tag not in unclosed:
                found = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at, scan.last + 1)
                if tag == SHOWN:
                    add(html.escape(page[at : found.start() if found else end], quote=False))
                if found:
                    at = found.end()
                elif tag in UNSEEN:
                    unclosed.add(tag)
                else:
                    at = end
            if tag == SHOWN:
                pop(places[tag][-1])
            add(" ")
            continue
        if tag == "br" or tag == "wbr":
            add(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            if framed and stack[framed[-1]].tag == "p":
                pop(framed[-1])
            if tag in CLOSES:
                shut, border = CLOSES[tag]
                if (k := last_of(shut)) > last_of(border):
                    pop(k)
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            push(tag, attrs)
    flush()
    return out


# --- features -----------------------------------------------------------------------------------------------------------


PATH_TERMS = 1 << 20  # buckets of paths that are summed at a time
_FEW = 64


def _bits(path: int) -> tuple[int, ...]:
    held = np.frombuffer(path.to_bytes(PATH_BUCKETS // 8, "little"), np.uint8)
    return tuple(np.flatnonzero(np.unpackbits(held, bitorder="little")).tolist())


_held_bits = lru_cache(maxsize=100_000)(_bits)


def _path_ids(path: int) -> tuple[int, ...]:
    """The buckets of a path. Those of few buckets, which most are, are remembered."""
    return _held_bits(path) if path.bit_count() <= _FEW else _bits(path)


def features(page: list[Block]) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Paths (as bits), word buckets (all words of a block) and numbers of a page's blocks."""
    n = len(page)
    numbers = np.zeros((n, NUMBERS), np.float32)
    paths, words = [], []
    for k, b in enumerate(page):
        paths.append(b.path)
        found = b.text.lower().split(" ")
        words.append(np.fromiter([zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS for w in found], np.uint8, len(found)))
        size = len(b.text)
        numbers[k] = (np.log1p(size) / 8, b.linked / size, min(len(found), 30) / 30, b.text[-1] in ".!?:;\"'”", k / n, 1 - k / n, sum(b.text.count(c) for c in ".,;") / size * 10, 1)
    return paths, words, numbers


# --- the model ----------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = PATH_DIM + WORD_DIM + NUMBERS
    w = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.3, (WORD_BUCKETS, WORD_DIM)), "out": rng.normal(0, 0.3, 2 * HIDDEN + d), "bias": np.zeros(1)}
    for side in "fb":
        w[side + "x"] = rng.normal(0, 0.25, (d, 4 * HIDDEN))
        w[side + "h"] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
        w[side + "c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in w.items()}


def _lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, c0: np.ndarray, train: bool) -> tuple[np.ndarray, list]:
    """x (time, batch, d), mask (time, batch, 1): hidden states, and what the way back needs (nothing if not train)."""
    t, b, _ = x.shape
    h = np.zeros((b, HIDDEN), np.float32)
    c = np.zeros((b, HIDDEN), np.float32)
    out, kept = np.empty((t, b, HIDDEN), np.float32), []
    for k in range(t):
        if k % STEPS == 0:
            pre = x[k : k + STEPS] @ wx + c0
        z = pre[k % STEPS] + h @ wh
        i, f, o = np.split(_sigmoid(z[:, : 3 * HIDDEN]), 3, axis=1)
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        th = np.tanh(c2)
        if train:
            kept.append((h, c, i, f, o, g, th))
        m = mask[k]
        h = m * (o * th) + (1 - m) * h
        c = m * c2 + (1 - m) * c
        out[k] = h
    return out, kept


def _lstm_back(dout: np.ndarray, x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t, b, _ = x.shape
    dz = np.empty((t, b, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh = np.zeros((b, HIDDEN), np.float32)
    dc = np.zeros((b, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, g, th = kept[k]
        m = mask[k]
        dh = dh + dout[k]
        dhm, dcm = dh * m, dc * m
        dc2 = dcm + dhm * o * (1 - th * th)
        z = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dhm * th * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
        dz[k] = z
        dwh += h.T @ z
        dh = z @ wh.T + dh * (1 - m)
        dc = dc2 * f + dc * (1 - m)
    flat = dz.reshape(-1, 4 * HIDDEN)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


def _inputs(w: dict, pages: list[tuple], train: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Vectors of blocks, and what they were made of, for training. Otherwise the buckets of paths are summed in portions, and not kept."""
    t, b = max(len(p[0]) for p in pages), len(pages)
    x = np.zeros((t, b, PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    mask = np.zeros((t, b, 1), np.float32)
    rows, ids, cells, bags = [], [], [], []
    flat = np.zeros((t * b, PATH_DIM), np.float32)
    for j, (paths, words, numbers) in enumerate(pages):
        n = len(paths)
        mask[:n, j] = 1
        x[:n, j, PATH_DIM + WORD_DIM :] = numbers
        cells += range(j, n * b + j, b)
        bags += words
        for k, p in enumerate(map(_path_ids, paths)):
            rows += [k * b + j] * len(p)
            ids += p
            if not train and len(ids) > PATH_TERMS:
                np.add.at(flat, np.array(rows), w["path"][ids])
                rows.clear()
                ids.clear()
    rows, ids, cells = (np.array(a, np.int64) for a in (rows, ids, cells))
    np.add.at(flat, rows, w["path"][ids])
    x[:, :, :PATH_DIM] = np.tanh(flat).reshape(t, b, PATH_DIM)
    # a block has one word at least: the mean of its words' vectors, a bounded number of words at a time
    sizes = np.array([len(a) for a in bags])
    mean = np.empty((len(cells), WORD_DIM), np.float32)
    for lo in range(0, len(cells), STEPS):
        part = sizes[lo : lo + STEPS]
        mean[lo : lo + STEPS] = np.add.reduceat(w["word"][np.concatenate(bags[lo : lo + STEPS])], np.cumsum(part) - part, axis=0) / part[:, None]
    x.reshape(t * b, -1)[cells, PATH_DIM : PATH_DIM + WORD_DIM] = mean
    return x, mask, (rows, ids, cells, bags, sizes)


def _forward(w: dict, pages: list[tuple], train: bool = False) -> tuple:
    x, mask, more = _inputs(w, pages, train)
    hf, kf = _lstm(x, mask, w["fx"], w["fh"], w["fc"], train)
    hb, kb = _lstm(x[::-1], mask[::-1], w["bx"], w["bh"], w["bc"], train)
    joined = np.concatenate([hf, hb[::-1], x], axis=2)
    return _sigmoid(joined @ w["out"] + w["bias"]), joined, x, mask, kf, kb, more


def probabilities(w: dict, pages: list[tuple], cells: int = 20_000) -> list[np.ndarray]:
    """For each page (features()) the probability that each block is main text. Pages of like length are padded together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k][0])), key=lambda k: len(pages[k][0]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]][0]) * (end + 1 - at) <= cells:
            end += 1
        p = _forward(w, [pages[k] for k in order[at:end]])[0]
        for j, k in enumerate(order[at:end]):
            out[k] = p[: len(pages[k][0]), j]
        at = end
    return out


def fit(pages: list[tuple], labels: list[np.ndarray], seed: int = SEED, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights by Adam on the log loss of blocks."""
    rng = np.random.Generator(np.random.PCG64(seed))
    w = initial(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in "12")
    step = 0
    order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
    groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            batch = [pages[k] for k in groups[g]]
            p, joined, x, mask, kf, kb, (rows, ids, cells, bags, sizes) = _forward(w, batch, True)
            y = np.zeros(p.shape, np.float32)
            for j, k in enumerate(groups[g]):
                y[: len(labels[k]), j] = labels[k]
            d = (p - y) * mask[:, :, 0] / mask.sum()
            grad = {"out": np.tensordot(d, joined, 2), "bias": d.sum(keepdims=True).reshape(1)}
            dj = d[:, :, None] * w["out"]
            dxf, grad["fx"], grad["fh"], grad["fc"] = _lstm_back(dj[:, :, :HIDDEN], x, mask, w["fx"], w["fh"], kf)
            dxb, grad["bx"], grad["bh"], grad["bc"] = _lstm_back(dj[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1], mask[::-1], w["bx"], w["bh"], kb)
            dx = dxf + dxb[::-1] + dj[:, :, 2 * HIDDEN :]
            dpath = dx[:, :, :PATH_DIM] * (1 - x[:, :, :PATH_DIM] ** 2)
            grad["path"] = np.zeros_like(w["path"])
            np.add.at(grad["path"], ids, dpath.reshape(-1, PATH_DIM)[rows])
            grad["word"] = np.zeros_like(w["word"])
            dword = dx.reshape(len(x) * len(batch), -1)[cells, PATH_DIM : PATH_DIM + WORD_DIM] / sizes[:, None]
            np.add.at(grad["word"], np.concatenate(bags), np.repeat(dword, sizes, axis=0))
            step += 1
            rate = 0.01 * (0.3 if epoch >= epochs - 2 else 1)
            for k, v in grad.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return w


# --- labelled pages, drawn by rule ---------------------------------------------------------------------------------------

MAIN = ["article", "main", "main article", "div.content", "div.post", "div.entry-content", "div.article-body", "div#content", "div.story", "div.post-content", "div#main-content", "section.article", "main div.text", "div.page article", "div.body-text", "div#article", "div[articleBody]"]
WRAP = ["", "", "", "div.container", "div.wrapper", "div#page", "div.row div.col", "div.site", "div#root div.layout", "table tr td"]
MENU = ["nav", "nav.menu", "div.menu", "div.nav", "ul.navbar", "div#navigation", "div.breadcrumb", "div.breadcrumbs", "header nav", "nav.main-nav", "div.topbar", "ul#menu", "div[navigation]"]
TOP = ["header", "div.header", "div#header", "div.masthead", "header.site-header", "div.banner", "div.logo", "div[banner]"]
SIDE = ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.widget", "div.related", "section.related-posts", "div.recommended", "div.popular", "div.tags", "div.share", "div.social", "ul.share-links", "div[complementary]", "div.author-box", "div.trending"]
ADVERT = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.promo", "div#ad-1", "div.banner-ad", "ins.adsbygoogle", "section.sponsor", "div.ad-slot"]
NOTICE = ["div.cookie", "div.cookie-notice", "div.notice", "div#consent", "div.gdpr", "div.alert", "div.popup", "div.modal", "div.newsletter", "div.subscribe", "section.signup", "dialog", "div.paywall", "div[alert]", "div.disclaimer"]
FORM = ["form", "form.search", "form#login", "div.search form", "form.contact", "div.newsletter form"]
COMMENTS = ["div.comments", "section.comments", "div#comments", "ol.comment-list", "div.comment", "section#discussion", "div.replies", "div#disqus-thread", "ul.comments", "div.reader-comments", "div.responses"]
BOTTOM = ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom", "div[contentinfo]", "div.legal"]
_SYLLABLES = "an ba ce do er fi ga he in jo ka le mi no or pe qui ra se ti un ve wa xi yo za ch ent tion ous".split()
_SMALL = "the of and to in a is that for it as was with be on not he by are at from this have or an".split()
_STOCK = {
    "menu": "Home|About|Contact|News|Sign in|Products|Blog|Archive|Help|Next|Previous|Skip to content".split("|"),
    "side": "Related articles|Share this|Popular posts|Tags|Follow us|More stories|Read more|Recommended for you".split("|"),
    "notice": "We use cookies to improve your experience.|Accept all|Subscribe to our newsletter|Please enable JavaScript.|Sign up for updates".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Limited offer|Ad|Shop today and save".split("|"),
    "form": "Search|Your email|Name|Submit|Password|Log in|Comment".split("|"),
    "bottom": "© 2024|All rights reserved.|Privacy policy|Terms of use|Copyright|Imprint".split("|"),
    "comments": "Reply|Great post!|Leave a comment|3 comments|Anonymous says:|Report".split("|"),
}


class _Draw:
    """A page and, by text, the label of each of its blocks."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng, self.label, self.count = rng, {}, 0

    def pick(self, xs: list):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        self.count += 1
        n = int(self.rng.integers(low, high + 1))
        found = [self.pick(_SMALL) if self.chance(0.4) else "".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 5)))) for _ in range(n)]
        found[int(self.rng.integers(n))] += f"{self.count}"  # no two texts are alike
        out = " ".join(found)
        return (out[0].upper() + out[1:] + self.pick([".", ".", ".", "", "?"])) if self.chance(0.9) else out

    def leaf(self, text: str, main: bool) -> str:
        self.label[" ".join(html.unescape(text).split())] = main
        return html.escape(text, quote=False)

    def wrap(self, spec: str, inner: str) -> str:
        for part in reversed(spec.split()):
            m = re.fullmatch(r"(\w+)(?:([.#\[])([\w-]+)\]?)?", part)
            name = {".": "class", "#": "id", "[": "role", None: ""}[m[2]]
            if m[3] == "articleBody":
                name = "itemprop"
            extra = f' {name}="{m[3]}"' if name else ""
            if name == "class" and self.chance(0.2):
                extra = f' class="{m[3]} {self.pick(["clearfix", "x1", "box", "dark", "col-8", "wide"])}"'
            inner = f"<{m[1]}{extra}>{inner}</{m[1]}>"
        return inner

    def boiler(self, specs: list[str], kind: str) -> str:
        style = int(self.rng.integers(4)) if kind not in ("comments", "ad") else int(self.rng.integers(1, 4))
        out = []
        if style == 0:  # a list of links
            items = "".join(f'<li><a href="/{k}">{self.leaf(self.stock(kind, 1, 3), False)}</a></li>' for k in range(int(self.rng.integers(2, 9))))
            out.append(f"<ul>{items}</ul>")
        elif style == 1:
            out.append(self.leaf(self.stock(kind, 3, 25), False))
        elif style == 2:
            for _ in range(int(self.rng.integers(1, 5))):
                out.append(f"<p>{self.leaf(self.stock(kind, 3, 40 if kind in ('comments', 'notice', 'ad') else 12), False)}</p>")
        else:
            for _ in range(int(self.rng.integers(1, 5))):
                out.append(f"<div>{self.leaf(self.stock(kind, 1, 30 if kind == 'comments' else 10), False)}</div>")
            if self.chance(0.5):
                out.insert(0, f"<h3>{self.leaf(self.stock(kind, 1, 3), False)}</h3>")
        return self.wrap(self.pick(specs), "".join(out))

    def stock(self, kind: str, low: int, high: int) -> str:
        own = _STOCK.get(kind, _STOCK["menu"])
        self.count += 1
        return f"{self.pick(own)} {self.count}" if self.chance(0.35) else self.words(low, high)

    def paragraph(self) -> str:
        text = self.words(2, 12) if self.chance(0.15) else self.words(8, 90)
        r = self.rng.random()
        shown = self.leaf(text, True)
        if r < 0.06:
            return f"<h2>{shown}</h2>"
        if r < 0.1:
            return f"<blockquote>{shown}</blockquote>"
        if r < 0.16:
            items = [self.leaf(self.words(2, 15), True) for _ in range(int(self.rng.integers(1, 5)))]
            return f"<p>{shown}</p><{(u := self.pick(['ul', 'ol']))}>{''.join(f'<li>{x}</li>' for x in items)}</{u}>"
        if r < 0.2:
            return f"<div>{shown}</div>"
        if r < 0.23:
            return f"<pre>{shown}</pre>"
        if r < 0.25:
            return f"<table><tr><td>{shown}</td><td>{self.leaf(self.words(1, 3), True)}</td></tr></table>"
        if r < 0.28:
            return f"<figure><figcaption>{shown}</figcaption></figure>"
        if r < 0.4:
            return f"<p><b>{shown}<br>" if self.chance(0.5) else f"<p><em>{shown}</em>"
        return f"<p>{shown}</p>" if self.chance(0.8) else f"<p>{shown}"

    def page(self) -> str:
        body = []
        title = self.leaf(self.words(1, 12), True)
        h1 = f"<h1>{title}</h1>"
        if self.chance(0.2):
            h1 = f"<header>{h1}</header>"
        inner = [h1]
        for _ in range(max(1, int(self.rng.exponential(9)))):
            inner.append(self.paragraph())
            if self.chance(0.04):
                inner.append(self.boiler(ADVERT, "ad"))
            if self.chance(0.02):
                inner.append(self.boiler(SIDE, "side"))
        if self.chance(0.15):
            inner.append(self.boiler(SIDE, "side"))
        if self.chance(0.1):
            inner.append(self.boiler(NOTICE, "notice"))
        if self.chance(0.12):
            inner.append(self.boiler(COMMENTS, "comments"))
        if self.chance(0.1):
            inner.append(self.boiler(FORM, "form"))
        main = self.wrap(self.pick(MAIN), "".join(inner))
        for specs, kind, p in ((TOP, "menu", 0.4), (MENU, "menu", 0.8), (NOTICE, "notice", 0.3), (ADVERT, "ad", 0.4), (FORM, "form", 0.25), (SIDE, "side", 0.25)):
            if self.chance(p):
                body.append(self.boiler(specs, kind))
        if self.chance(0.3):
            self.rng.shuffle(body)
        if self.chance(0.25):
            main = f"{self.pick(['', h1.replace(title, self.leaf(self.words(2, 9), True))])}{main}"
        body.append(main)
        for specs, kind, p in ((SIDE, "side", 0.4), (ADVERT, "ad", 0.2), (COMMENTS, "comments", 0.35), (FORM, "form", 0.15), (NOTICE, "notice", 0.2), (BOTTOM, "bottom", 0.85)):
            if self.chance(p):
                body.append(self.boiler(specs, kind))
        wrap = self.pick(WRAP)
        inside = "".join(body)
        return f"<html><head><title>{title}</title></head><body>{self.wrap(wrap, inside) if wrap else inside}</body></html>"


def drawn_pages(n: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """n pages as blocks, and the label of every block."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pages, labels = [], []
    for _ in range(n):
        draw = _Draw(rng)
        found = blocks(draw.page())
        found = [b for b in found if b.text in draw.label]
        pages.append(found)
        labels.append(np.array([draw.label[b.text] for b in found], np.float32))
    return pages, labels


@lru_cache(maxsize=1)
def model() -> dict[str, np.ndarray]:
    pages, labels = drawn_pages(PAGES, SEED)
    return fit([features(p) for p in pages], labels)


# --- over a table -------------------------------------------------------------------------------------------------------


def extract(pages: Iterable[str | None], weights: dict[str, np.ndarray]) -> list[str]:
    """The main text of each page. Pages are labelled once HELD blocks have come together, so memory follows the longest page and not their number."""
    out: list[str] = []
    held: list[list[Block]] = []

    def label() -> None:
        chances = probabilities(weights, [features(b) for b in held])
        out.extend("\n".join(b.text for b, p in zip(bs, ps, strict=True) if p > 0.5) for bs, ps in zip(held, chances, strict=True))
        held.clear()

    n = 0
    for page in pages:
        held.append(blocks(page or ""))
        n += len(held[-1])
        if n > HELD:
            label()
            n = 0
    label()
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    small_batches(pages.sparkSession)
    weights = model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in batches:
            text = extract(batch.column(2).to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages. Awkward cases: see the module."""
    return main_text(read_table(spark, sf_dir, "pages"))
