"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page as content or not.

A page is cut into leaf blocks: runs of text between block-level tags, in page order, outside scripts, styles,
templates, svg drawings and comments. A block's vector holds hashed tags, classes and ids of its path, hashed words, and
a few numbers (length, share of links, place in the page). The network reads a page's blocks in both directions,
so that every label depends on the whole page. Blocks labelled as content are joined by line feeds, with
character references decoded and white space turned into single spaces; no block is cut or dropped otherwise.

The network is trained on pages that :func:`synthetic_page` makes, with many forms of menus, notices, adverts,
comments and so on around an article, from a fixed seed; training takes some seconds in the driver, once.

Null and empty pages, and pages without a content block, have an empty text. Repeated rows each give a row; null ids and
extra columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

PATH, WORDS, NUMBERS = 256, 32, 8
SIZE = PATH + WORDS + NUMBERS
HIDDEN = 20
TRAIN_PAGES, EPOCHS, RATE, SEED = 900, 10, 6e-3, 11
CELLS = 1 << 16  #: blocks, with padding, that are labelled at a time

BLOCK_TAGS = frozenset(
    "html head body title article section nav header footer aside main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption form fieldset legend label button select option textarea input hr address details summary dialog menu search noscript iframe object center".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end of these isn't crossed when a tag closes an open one of its kind.
SCOPES = frozenset("ul ol table dl select article section div body".split())
#: A p ends where one of these begins.
ENDS_P = BLOCK_TAGS - frozenset("label button select option textarea input noscript iframe object html head body".split())

#: What may stand at a "<".
OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-z][^\s/>]*))", re.I)
#: Their content is no text of the page, up to their end tag or the end of the page; that of xmp is text as it stands.
RAW = frozenset("script style template noembed noframes xmp".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
COMMENT_END = re.compile(r"--!?>")
SPECIAL = re.compile("[>\"']")
#: Elements nested deeper than this are taken as siblings, as browsers do.
NESTED = 512


class Scanner:
    """The tags of a page, in order. It goes forward only: what a quote or the like leads to is found once for each place."""

    def __init__(self, page: str):
        self.page = page
        self.after: dict[int, int] = {}
        self.special = self.close = -2

    def greater(self, at: int) -> int:
        """The next ">" from ``at`` on, or -1."""
        if self.close != -1 and self.close < at:
            self.close = self.page.find(">", at)
        return self.close

    def tag_end(self, at: int) -> int:
        """The ">" that ends a tag, outside its quotes, or -1."""
        if self.special != -1 and self.special < at:
            m = SPECIAL.search(self.page, at)
            self.special = m.start() if m else -1
        place, passed = self.special, []
        while place >= 0 and place not in self.after and self.page[place] != ">":
            passed.append(place)
            quote = self.page.find(self.page[place], place + 1)
            m = SPECIAL.search(self.page, quote + 1) if quote >= 0 else None
            place = m.start() if m else -1
        end = self.after.get(place, place)
        for x in passed:
            self.after[x] = end
        return end

    def tags(self) -> Generator[tuple[int, int, str, str | None, str], int | None]:
        """Start and end of each tag, comment or raw element; "/" of an end tag, its name in lower case (None: no tag), and the rest of it or raw text."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            m = OPEN.match(page, at)
            if not m:
                at += 1
                continue
            start, tag = at, (m["tag"] or "").lower()
            if m["comment"]:
                m = COMMENT_END.search(page, at + 2 if page.startswith("<!-->", at) or page.startswith("<!--->", at) else at + 4)
                at = m.end() if m else len(page)
                yield start, at, "", None, ""
            elif m["other"]:
                end = self.greater(at)
                at = end + 1 if end >= 0 else len(page)
                yield start, at, "", None, ""
            elif tag in RAW and not m["end"]:
                end = self.greater(m.end())
                if end < 0:
                    at += 1
                    continue
                stop = RAW_END[tag].search(page, end + 1)
                close = self.greater(stop.end()) if stop else -1
                at = close + 1 if close >= 0 else len(page)
                yield start, at, "", None, page[end + 1 : stop.start() if stop else at] if tag == "xmp" else ""
            else:
                if "<" in tag:  # "<b<i>": the first isn't a tag
                    at += 1
                    continue
                end = self.tag_end(m.end())
                if end < 0:  # a quote that stands alone: to the next ">", unless a tag begins before it
                    end = self.greater(m.end())
                    begin = page.find("<", m.end(), end) if end >= 0 else 0
                    if begin >= 0:
                        at += 1
                        continue
                at = end + 1
                jump = yield start, at, m["end"], tag, page[m.end() : end]
                if jump:
                    at = jump
                    yield start, at, "", None, ""


SVG_END = re.compile(r"</svg\s*>", re.I)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|data-y)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

Block = tuple[tuple[str, ...], str, float, str]  #: path, text, share of it in links, label (in training pages)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str]] = []  # tag, what it adds to the path, label
    parts: list[str] = []
    opened: Counter[str] = Counter()
    state = [0, 0]  # open links, characters of the block in links

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = tuple(x for _, names, _ in stack for x in names)
                out.append((path, text, min(state[1] / len(text), 1.0), next((y for _, _, y in reversed(stack) if y), "")))
            parts.clear()
        state[1] = 0

    def close(tags, scopes):
        if not any(map(opened.__getitem__, tags)):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                opened.subtract(x[0] for x in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in scopes:
                return

    def say(text):
        parts.append(text)
        if state[0]:
            state[1] += len(text)

    at, svg_ends = 0, True
    found = Scanner(page).tags()
    m = next(found, None)
    while m:
        start, stop, end, tag, rest = m
        if start > at:
            say(page[at:start])
        at, jump = stop, None
        if not tag:
            if rest:
                say(html.escape(rest))  # xmp as it stands: neither tags nor references in it mean anything
        elif tag == "br":
            parts.append(" ")
        elif tag == "svg":  # '<svg .../>', and one without an end, is only a tag
            if not end and not rest.endswith("/") and svg_ends:
                last = SVG_END.search(page, at)
                jump, svg_ends = (last.end() if last else None), bool(last)
        elif tag == "a":
            state[0] = 0 if end else 1
        elif tag in BLOCK_TAGS:
            flush()
            if end:
                close({tag}, ())
                state[0] = 0
            else:
                if tag in ENDS_P:
                    close({"p"}, SCOPES)
                if tag in CLOSES and tag != "p":
                    close(CLOSES[tag], SCOPES - {"div", "section", "article"} if tag != "li" else SCOPES)
                if tag not in VOID:
                    names, label = ["<" + tag], ""
                    if rest and "=" in rest or "hidden" in rest:
                        for name, value in NAMES.findall(rest):
                            name, value = name.lower(), value.strip("\"'")
                            if name == "data-y":
                                label = value
                            elif name == "hidden" or name == "style":
                                names += ["hidden"] if name == "hidden" or "display:none" in value.replace(" ", "") else []
                            else:
                                names += [x for x in re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])|\d+", value) if x]
                    if len(stack) < NESTED:
                        stack.append((tag, tuple(x.lower() for x in names), label))
                        opened[tag] += 1
        # other tags stand within a text and don't part it
        if jump:
            found.send(jump)
            at = jump
        m = next(found, None)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = _paths.get(path)
    if v is None:
        v = np.zeros(PATH, np.float32)
        for x in set(path):
            h = crc32(x.encode())
            v[h % PATH] += 1
            v[(h >> 12) % PATH] += 1 if h & 1 << 30 else -1
        if path and path[-1][0] != "<" or len(path) > 1:
            last = next((x for x in reversed(path) if x[0] == "<"), "")
            v[crc32(b"last" + last.encode()) % PATH] += 1
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = v
    return v


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """(blocks of all pages, SIZE)."""
    blocks = [b for p in pages for b in p]
    x = np.zeros((len(blocks), SIZE), np.float32)
    if not blocks:
        return x
    x[:, :PATH] = [_path_vector(b[0]) for b in blocks]
    words = [b[1].lower().encode().split() for b in blocks]
    n = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter((crc32(w) for own in words for w in own), np.uint32, int(n.sum())).astype(np.int64) % WORDS
    counts = np.bincount(np.repeat(np.arange(len(blocks)) * WORDS, n) + hashes, minlength=len(blocks) * WORDS).reshape(len(blocks), WORDS)
    x[:, PATH : PATH + WORDS] = counts / np.sqrt(n)[:, None]
    size = np.fromiter((len(b[1]) for b in blocks), np.float32, len(blocks))
    per_page = np.array([len(p) for p in pages])
    place = np.arange(len(blocks)) - np.repeat(np.cumsum(per_page) - per_page, per_page)
    x[:, PATH + WORDS :] = np.column_stack([
        np.log1p(size) / 5, np.log1p(n) / 4, [b[2] for b in blocks], [b[1][-1] in ".!?…" for b in blocks],
        place / np.repeat(per_page, per_page), np.exp(-place / 4), [len(b[0]) / 10 for b in blocks], size / np.maximum(n, 1) / 10,
    ])
    return x


Weights = dict[str, np.ndarray]


def first_weights() -> Weights:
    r = np.random.default_rng(SEED)
    w: Weights = {}
    for d in "fb":
        w["x" + d] = r.normal(0, 0.15, (SIZE, 4 * HIDDEN)).astype(np.float32)
        w["h" + d] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w["c" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN).astype(np.float32)  # in, forget, out, new
    w["v"], w["s"] = r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(z: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden values (steps, pages, HIDDEN) from the input's part of the gates (steps, pages, 4 HIDDEN)."""
    steps, pages, _ = z.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, kept = np.empty((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        g = z[t] + h @ u
        gates = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        new = np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * new
        tc = np.tanh(c)
        if keep:
            kept.append((h, i, f, o, new, before, tc))
        h = o * tc
        out[t] = h
    return out, kept


def _lstm_back(dh_out: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, pages, _ = dh_out.shape
    dz, du = np.empty((steps, pages, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, i, f, o, new, before, tc = kept[t]
        d = dh_out[t] + dh
        dc = dc + d * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        du += h.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    return dz, du


def _order(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block numbers (steps, pages) forwards and backwards from each page's first or last block, and the mask."""
    t = np.arange(counts.max(initial=0))[:, None]
    mask = t < counts
    start = np.cumsum(counts) - counts
    return np.where(mask, start + t, 0), np.where(mask, start + counts - 1 - t, 0), mask


def log_odds(w: Weights, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of content, for each block; counts: the blocks of each page, none of them 0."""
    out = np.full(len(x), w["s"][0], np.float32)
    forward, backward, mask = _order(counts)
    for d, at in (("f", forward), ("b", backward)):
        z = x @ w["x" + d] + w["c" + d]
        h, _ = _lstm(z[at], w["h" + d], False)
        out[at[mask]] += (h @ w["v"][:HIDDEN] if d == "f" else h @ w["v"][HIDDEN:])[mask]
    return out


def _gradient(w: Weights, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> Weights:
    forward, backward, mask = _order(counts)
    odds, held = np.full(len(x), w["s"][0], np.float32), {}
    for d, at in (("f", forward), ("b", backward)):
        h, kept = _lstm((x @ w["x" + d] + w["c" + d])[at], w["h" + d], True)
        held[d] = (h, kept, at)
        v = w["v"][:HIDDEN] if d == "f" else w["v"][HIDDEN:]
        odds[at[mask]] += (h @ v)[mask]
    delta = (_sigmoid(odds) - y).astype(np.float32) / len(x)
    g: Weights = {"s": np.array([delta.sum()], np.float32), "v": np.empty_like(w["v"])}
    for d, (h, kept, at) in held.items():
        own = np.where(mask, delta[at], 0).astype(np.float32)
        half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        g["v"][half] = np.einsum("tp,tph->h", own, h)
        dz, g["h" + d] = _lstm_back(own[:, :, None] * w["v"][half], kept, w["h" + d])
        flat = dz[mask]
        g["x" + d], g["c" + d] = x[at[mask]].T @ flat, flat.sum(axis=0)
    return g


def fit(pages: list[list[Block]], epochs: int = EPOCHS) -> Weights:
    w = first_weights()
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    r = np.random.default_rng(SEED)
    for _ in range(epochs):
        order = r.permutation(len(pages))
        for i in range(0, len(order), 16):
            own = [pages[j] for j in order[i : i + 16]]
            x = vectors(own)
            y = np.array([b[3] == "1" for p in own for b in p], np.float32)
            t += 1
            for k, g in _gradient(w, x, np.array([len(p) for p in own]), y).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                w[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    return w


# Training pages

_SYLLABLES = ["the an er on in at es re ou ti or ea nd th st sh ing ed".split(), "le de ou ai eau en re tion men pa vi ch é".split(), "der ein sch ung ber te zu lich keit ä".split(), "de la ción ar os ra ue do ga es ll ñ".split()]
_FURNITURE = {
    "nav": ["nav", "nav class=main-menu", "div class=menu", "ul id=navigation", "div class=navbar", "div role=navigation", "div class=breadcrumbs", "nav class=breadcrumb", "menu", "div id=topnav"],
    "header": ["header", "div class=header", "div id=masthead", "header class=site-header", "div class=top-bar", "div class=logo", "div role=banner"],
    "footer": ["footer", "div class=footer", "div id=colophon", "footer class=site-footer", "div class=copyright", "div role=contentinfo", "div class=bottom"],
    "side": ["aside", "div class=sidebar", "aside class=widget", "div id=secondary", "div class=related-posts", "section class=related", "div class=popular", "div class=recommended", "div class=tags", "div class=author-bio", "div class=share-buttons", "div class=social", "section class=newsletter"],
    "notice": ["div class=cookie-notice", "div class=notice", "div id=cookie-banner", "div class=alert", "div class=gdpr consent", "div role=alert", "div class=paywall", "div class=popup modal", "dialog", "noscript"],
    "ad": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div id=ad-slot", "div class=sponsored", "div class=promo", "aside class=banner", "div class=ad-container", "section class=sponsor"],
    "form": ["form", "form class=search", "div class=search-form", "form class=login", "div class=subscribe", "fieldset", "form id=contact"],
    "comments": ["section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div class=reader-comments", "section id=discussion", "div class=replies", "div id=disqus-thread", "div class=responses"],
}
_SAID = {
    "nav": "home about contact news menu login sign up archive next previous blog",
    "header": "welcome to our site the daily search subscribe",
    "footer": "© copyright all rights reserved privacy policy terms imprint contact",
    "side": "related popular recent posts tags share follow us read more newsletter",
    "notice": "we use cookies accept to continue this site please enable javascript agree privacy",
    "ad": "advertisement sponsored buy now free offer sale discount click here",
    "form": "search email password name send submit subscribe log in",
    "comments": "reply comment says comments like posted by report",
}


def _words(r: np.random.Generator, n: int, lang: list[str]) -> list[str]:
    return ["".join(lang[j] for j in r.integers(0, len(lang), r.integers(1, 5))) for _ in range(n)]


def _prose(r: np.random.Generator, lang: list[str], most: int = 90) -> str:
    kind = r.random()
    n = int(r.integers(1, 6)) if kind < 0.15 else int(r.integers(min(4, most - 1), most))
    w = _words(r, n, lang)
    w[0] = w[0].capitalize()
    if r.random() < 0.08:
        w = [x + "###"[: r.integers(1, 4)] if r.random() < 0.6 else x + "&amp;&amp;" for x in w]
    elif r.random() < 0.05:
        w = [x.upper() + "!!" for x in w]
    elif r.random() < 0.05:
        w = [x + " |" for x in w]
    for tag in ("a href='/x'", "b", "em", "span", "i", "strong", "code"):
        if r.random() < 0.06:
            j = r.integers(0, len(w))
            w[j] = f"<{tag}>{w[j]}</{tag.split()[0]}>"
    if r.random() < 0.02:
        w = [f"<a href='/y'>{' '.join(w)}</a>"]
    return " ".join(w) + ("" if r.random() < 0.15 else ".")


def _box(r: np.random.Generator, kind: str, lang: list[str]) -> str:
    name = _FURNITURE[kind][r.integers(0, len(_FURNITURE[kind]))]
    if r.random() < 0.1:  # nothing but the tag or a strange name
        name = name.split()[0] if name.split()[0] not in ("div", "ul", "ol", "section") else name
    tag, _, attribute = name.partition(" ")
    attribute = re.sub(r"=(.*)", r'="\1"', attribute)
    own = _SAID[kind].split()
    mixed = lambda n: " ".join(own[r.integers(0, len(own))] if r.random() < 0.35 else _words(r, 1, lang)[0] for _ in range(n))
    if kind == "comments":
        inner = "".join(f'<div class="comment"><p>{_prose(r, lang, 40)}</p></div>' if r.random() < 0.6 else f"<{'li' if tag == 'ol' else 'p'}>{_prose(r, lang, 40)}" for _ in range(r.integers(1, 8)))
        inner = (f"<h3>{mixed(2)}</h3>" if r.random() < 0.5 else "") + inner
    elif kind == "form":
        inner = f"<label>{mixed(2)}</label><input type=text name=q><button>{mixed(1)}</button>" + (f"<select><option>{mixed(1)}<option>{mixed(1)}</select>" if r.random() < 0.3 else "") + (f"<p>{_prose(r, lang, 20)}</p>" if r.random() < 0.3 else "")
    elif kind in ("nav", "side") and r.random() < 0.75 or kind in ("header", "footer") and r.random() < 0.3:
        items = "".join(f'<li><a href="/{i}">{mixed(r.integers(1, 5))}</a></li>' for i in range(r.integers(2, 9)))
        inner = items if tag in ("ul", "ol", "menu") else f"<ul>{items}</ul>"
        inner = (f"<h3>{mixed(2)}</h3>" if r.random() < 0.3 and tag != "ul" else "") + inner
    else:
        inner = "".join(r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<a href='/z'>{}</a>"]).format(mixed(r.integers(1, 12)) if r.random() < 0.5 else _prose(r, lang, 30)) for _ in range(r.integers(1, 4)))
        inner = ("&copy; 2024 " if kind == "footer" and r.random() < 0.5 else "") + inner
    return f'<{tag} {attribute} data-y="0">{inner}</{tag}>'


def synthetic_page(r: np.random.Generator) -> str:
    """A page whose content blocks stand within data-y="1", all others within data-y="0"."""
    lang, other = _SYLLABLES[r.integers(0, 4)], _SYLLABLES[r.integers(0, 4)]
    kinds = list(_FURNITURE)
    boxes = lambda most, weights=None: "".join(_box(r, kinds[r.choice(len(kinds), p=weights)], lang if r.random() < 0.5 else other) for _ in range(r.integers(0, most + 1)))
    top, bottom = np.array([4, 4, 0, 1, 2, 3, 1, 0]) / 15, np.array([1, 0, 4, 2, 1, 1, 1, 4]) / 14
    body = [f"<h1>{_prose(r, lang, 14)}</h1>"] if r.random() < 0.85 else []
    for _ in range(int(r.integers(1, 6) if r.random() < 0.3 else r.integers(2, 30))):
        kind = r.random()
        if kind < 0.72:
            body.append(f"<p>{_prose(r, lang)}" + ("</p>" if r.random() < 0.8 else "<br>"))
        elif kind < 0.78:
            body.append(f"<p><b>{_prose(r, lang)}<br>")
        elif kind < 0.84:
            h = r.choice(["h2", "h3", "h4"])
            body.append(f"<{h}>{_prose(r, lang, 9)}</{h}>")
        elif kind < 0.88:
            body.append("<ul>" + "".join(f"<li>{_prose(r, lang, 12)}" for _ in range(r.integers(2, 6))) + "</ul>")
        elif kind < 0.91:
            body.append(f"<blockquote>{_prose(r, lang)}</blockquote>")
        elif kind < 0.93:
            body.append("<table>" + "".join(f"<tr><td>{_prose(r, lang, 4)}<td>{_prose(r, lang, 4)}" for _ in range(r.integers(1, 5))) + "</table>")
        elif kind < 0.95:
            body.append(f"<div>{_prose(r, lang)}</div>")
        elif kind < 0.96:
            body.append(f"<figure><img src=a.png><figcaption>{_prose(r, lang, 12)}</figcaption></figure>")
        elif kind < 0.98:
            body.append(_box(r, ["ad", "side", "notice", "form"][r.integers(0, 4)], other))
        else:
            body.append(f"<pre>{_prose(r, lang, 20)}</pre>")
    if r.random() < 0.15:
        body.append(_box(r, "comments", lang))
    outer = ["article", "article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post"', 'section class="entry-content"', 'div class="article-body"', 'div class="story"', 'div role="main"']
    outer = outer[r.integers(0, len(outer))]
    text = f'<{outer} data-y="1">{"".join(body)}</{outer.split()[0]}>'
    if r.random() < 0.25:
        wrap = ["main", "div", 'div class="container"', 'div id="page"', 'div class="row"'][r.integers(0, 5)]
        text = f"<{wrap}>{text}</{wrap.split()[0]}>"
    if r.random() < 0.05:
        text = ""
    title = f'<title data-y="0">{_prose(r, lang, 9)}</title>'
    return f"<!DOCTYPE html><html><head>{title}</head><body>{boxes(4, top)}{text}{boxes(4, bottom)}</body></html>"


_model: list[Weights] = []


def model() -> Weights:
    """The trained network; it is the same in every process, and trained once in one."""
    if not _model:
        r = np.random.default_rng(SEED)
        pages = [blocks_of(synthetic_page(r)) for _ in range(TRAIN_PAGES)]
        _model.append(fit([p for p in pages if p]))
    return _model[0]


def label(pages: list[list[Block]], w: Weights) -> list[np.ndarray]:
    """Whether each block of each page is content."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        n = max(1, min(len(order), CELLS // len(pages[order[-1]])))
        own, order = order[-n:], order[:-n]
        counts = np.array([len(pages[i]) for i in own])
        odds = log_odds(w, vectors([pages[i] for i in own]), counts)
        for i, part in zip(own, np.split(odds, np.cumsum(counts)[:-1]), strict=True):
            out[i] = part > 0
    return out


def main_texts(pages: list[str], w: Weights) -> list[str]:
    cut = [blocks_of(p) for p in pages]
    return ["\n".join(b[1] for b, y in zip(p, own, strict=True) if y) for p, own in zip(cut, label(cut, w), strict=True)]


def extract(pages: DataFrame, w: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    w = w or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 1 << 20):
                found = main_texts([h or "" for h in batch.column("html").to_pylist()], w)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
