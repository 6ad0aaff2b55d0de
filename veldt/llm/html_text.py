"""HTML main text by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. A bidirectional LSTM in numpy reads the blocks of a
whole page in order; a block enters as a vector of its tag path (tags, class and id words of all open elements, hashed), of
its words (hashed) and of a few measures. So each block is judged as article or not with the whole document as
context. The network is trained on made-up pages of many layouts, whose labels are known; nothing is looked up in the corpus.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import slices, text_once

PATHS, WORDS = 2048, 2048
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 24, 12, 10, 24
TRAIN_PAGES, EPOCHS, PAGES_A_STEP = 1000, 10, 40
SEED = 5
#: Pages that the network reads side by side, and their padded blocks together; a longer page is read alone.
PAGES_AT_ONCE, BLOCKS_AT_ONCE = 64, 16_384
#: A path is read from so many of the open elements nearest to the text, a name from so many of its words.
DEPTH, NAME_WORDS = 64, 32
#: Longer words and tags are hashed without being remembered.
KEPT_LETTERS = 200

# fixed values: elements of HTML that don't break a line, that have no end tag, whose content is no text, and that end an open paragraph
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = "script|style|noscript|template|title|iframe|svg|math|object|textarea"
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: The rest of a tag. A quote counts only as the first sign of a value; a quote that never ends counts for nothing.
REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
TOKEN = re.compile(
    # a drawing or formula that closes itself hides nothing; a hidden element's name ends before a blank, a slash or the end of the tag
    rf"""<(?:svg|math)(?=[\s/]){REST}(?<=/)>|"""
    rf"""<!--.*?(?:-->|\Z)|<(?P<skip>{HIDDEN_TEXT})(?=[\s/>]){REST}>.*?(?:</(?P=skip)\s*+>|\Z)"""
    rf"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>{REST})>|<[a-z/!?][^>]*+(?:>|\Z)""",
    re.IGNORECASE | re.DOTALL,
)
NAMES = re.compile(r"""\b(class|id|role|hidden|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
NAME_WORD = re.compile(r"[a-z]+")


class Block:
    """A leaf: its text, the hashed path, its share of link letters and whether it is a heading."""

    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text: str, path: list[int], linked: float, tag: str):
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


def _hashed(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


_remembered = functools.lru_cache(maxsize=50_000)(_hashed)


def _slot(word: str, size: int) -> int:
    return (_remembered if len(word) <= KEPT_LETTERS else _hashed)(word, size)


def _features(tag: str, rest: str) -> tuple[int, ...]:
    """Hashed features of an element: its tag and the words of its class, id and role."""
    words = {f"<{tag}"}
    for kind, *values in NAMES.findall(rest):
        for w in NAME_WORD.findall("".join(values).lower())[:NAME_WORDS]:
            words |= {w, f"{tag}.{w}"}
        if kind.lower() == "hidden":
            words.add("hidden")
    return tuple(sorted({_slot(w, PATHS) for w in words}))


_remembered_features = functools.lru_cache(maxsize=20_000)(_features)


def _element(tag: str, rest: str) -> tuple[int, ...]:
    return (_remembered_features if len(rest) <= KEPT_LETTERS else _features)(tag, rest)


class Open:
    """The open elements. What a block, an end tag or a paragraph's end asks takes no walk through all of them."""

    def __init__(self):
        #: (tag, features, position of the nearest element at or below that breaks a line)
        self.stack: list[tuple[str, tuple[int, ...], int]] = []
        self.of: Counter[str] = Counter()
        self.near: dict[int, int] = {}  # how many of the DEPTH nearest elements have a feature
        self.known: list[int] | None = None

    def _count(self, slots: tuple[int, ...], by: int) -> None:
        for s in slots:
            now = self.near.get(s, 0) + by
            if now:
                self.near[s] = now
            else:
                del self.near[s]

    def push(self, tag: str, slots: tuple[int, ...]) -> None:
        base = len(self.stack) if tag not in INLINE else self.stack[-1][2] if self.stack else -1
        self.stack.append((tag, slots, base))
        self.of[tag] += 1
        self._count(slots, 1)
        if len(self.stack) > DEPTH:
            self._count(self.stack[-1 - DEPTH][1], -1)
        self.known = None

    def cut(self, at: int) -> None:
        """Close all elements from position ``at`` on."""
        while len(self.stack) > at:
            if len(self.stack) > DEPTH:
                self._count(self.stack[-1 - DEPTH][1], 1)
            tag, slots, _ = self.stack.pop()
            self.of[tag] -= 1
            self._count(slots, -1)
        self.known = None

    def end(self, tag: str) -> None:
        if self.of[tag]:
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self.cut(at)

    def block(self) -> str:
        """The nearest open element that breaks a line."""
        base = self.stack[-1][2] if self.stack else -1
        return self.stack[base][0] if base >= 0 else ""

    def make_way(self, tag: str) -> None:
        """End an open paragraph, item or cell that the start of ``tag`` ends; inline elements left open end with it."""
        ends = ("p",) if tag in ENDS_P else {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(tag, (tag, "p"))
        if self.block() in ends:
            self.cut(self.stack[-1][2])

    def path(self) -> list[int]:
        """Features of the path; those of the innermost element also stand a second time, one slot on."""
        if self.known is None:
            own = [(s + 1) % PATHS for s in self.stack[-1][1]] if self.stack else []
            self.known = sorted(self.near.keys() | own)
        return self.known


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order. Scripts, styles, comments and other hidden content are no blocks."""
    found: list[Block] = []
    parts: list[str] = []
    open_, linked = Open(), 0

    def done() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, open_.path(), min(1.0, linked / len(text)), open_.block()))
            parts.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if open_.of["a"]:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append("\n")
            continue
        if tag not in INLINE:
            done()
        if m["end"]:
            open_.end(tag)
        elif tag not in VOID and not m["rest"].endswith("/"):
            if tag in ENDS_P or tag in ("li", "option", "td", "th", "tr", "dd", "dt"):
                open_.make_way(tag)
            open_.push(tag, _element(tag, m["rest"]))
    if at < len(page):
        parts.append(page[at:])
        if open_.of["a"]:
            linked += len(page) - at
    done()
    return found


def measures(blocks: list[Block]) -> np.ndarray:
    """A few numbers of each block: length, links, marks, and where it stands in the page."""
    n = len(blocks)
    out = np.zeros((n, MEASURES), np.float32)
    for i, b in enumerate(blocks):
        t, size = b.text, len(b.text)
        out[i] = (
            np.log1p(size) / 6, b.linked, t.count(",") / (1 + size / 60), t[-1] in ".!?:;\"'”»…", t.count(" ") > 15, t.count("|") + t.count("©") + t.count("·") > 0,
            i / n, 1 - i / n, b.tag in ("h1", "h2", "h3", "h4"), min(n, 60) / 60,
        )
    return out


def words_of(text: str) -> list[int]:
    """Slots of the distinct words of a block."""
    return sorted({_slot(w.strip(".,:;!?()\"'"), WORDS) for w in text.lower().split()})


class Pages:
    """Blocks of several pages as flat arrays with padding, longest page first."""

    def __init__(self, pages: list[list[Block]]):
        self.order = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
        pages = [pages[k] for k in self.order]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        self.steps, self.n = int(self.lengths.max(initial=0)), len(pages)
        blocks = [b for p in pages for b in p]
        # position of each block in (steps, pages)
        self.row = np.concatenate([np.arange(k) for k in self.lengths]) if blocks else np.zeros(0, np.int64)
        self.col = np.repeat(np.arange(self.n), self.lengths)
        self.path, self.path_at = _bags([b.path for b in blocks])
        self.word, self.word_at = _bags([words_of(b.text) for b in blocks])
        self.measures = np.concatenate([measures(p) for p in pages if p]) if blocks else np.zeros((0, MEASURES), np.float32)
        self.alive = (np.arange(self.steps)[:, None] < self.lengths[None, :]).sum(1)


def _bags(bags: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    return np.fromiter(chain.from_iterable(bags), np.int32, int(sizes.sum())), np.repeat(np.arange(len(bags), dtype=np.int32), sizes)


def _mean(table: np.ndarray, slots: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of table rows of each bag over the root of its size, that root)."""
    out = np.zeros((n, table.shape[1]), np.float32)
    edges = np.searchsorted(at, np.arange(0, n + 8192, 8192))
    for lo, hi in zip(edges, edges[1:]):  # some thousand bags at once
        if hi > lo:
            own = at[lo:hi]
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            out[own[starts]] = np.add.reduceat(table[slots[lo:hi]], starts, axis=0)
    root = np.sqrt(np.maximum(np.bincount(at, minlength=n), 1)).astype(np.float32)[:, None]
    return out / root, root


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: embedding tables, one LSTM in each direction, and a logistic output that also sees the block itself."""

    SHAPES = {
        "path": (PATHS, PATH_SIZE), "word": (WORDS, WORD_SIZE),
        "wf": (PATH_SIZE + WORD_SIZE + MEASURES + HIDDEN, 4 * HIDDEN), "bf": (4 * HIDDEN,),
        "wb": (PATH_SIZE + WORD_SIZE + MEASURES + HIDDEN, 4 * HIDDEN), "bb": (4 * HIDDEN,),
        "out": (PATH_SIZE + WORD_SIZE + MEASURES + 2 * HIDDEN, 1), "bias": (1,),
    }

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {k: (rng.normal(0, 0.3 if k in ("path", "word") else 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}
        for b in ("bf", "bb"):
            self.w[b][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def inputs(self, p: Pages) -> tuple[np.ndarray, tuple]:
        path, path_root = _mean(self.w["path"], p.path, p.path_at, len(p.row))
        word, word_root = _mean(self.w["word"], p.word, p.word_at, len(p.row))
        return np.concatenate([path, word, p.measures], axis=1), (path_root, word_root)

    def _read(self, x: np.ndarray, alive: np.ndarray, w: np.ndarray, b: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, pages, HIDDEN). Pages are sorted by length, so step t has alive[t] pages."""
        steps, n, size = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        run = max(1, BLOCKS_AT_ONCE // max(n, 1))  # the inputs' share of the gates is made for so many steps at once
        for t in range(steps - 1, -1, -1) if back else range(steps):
            k, part = alive[t], t // run
            if t == (min(steps, (part + 1) * run) - 1 if back else part * run):
                some = x[part * run : (part + 1) * run]
                seen = (some.reshape(-1, size) @ w[:size] + b).reshape(len(some), n, 4 * HIDDEN)
            g = seen[t - part * run, :k] + h[:k] @ w[size:]
            i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN])
            u = np.tanh(g[:, 3 * HIDDEN :])
            before, last = c[:k].copy(), h[:k].copy()
            c[:k] = f * before + i * u
            th = np.tanh(c[:k])
            h[:k] = o * th
            out[t, :k] = h[:k]
            if keep:
                kept.append((t, k, i, f, o, u, before, last, th))
        return out, kept

    def forward(self, p: Pages, keep: bool = False):
        flat, roots = self.inputs(p)
        x = np.zeros((p.steps, p.n, flat.shape[1]), np.float32)
        x[p.row, p.col] = flat
        hf, kf = self._read(x, p.alive, self.w["wf"], self.w["bf"], False, keep)
        hb, kb = self._read(x, p.alive, self.w["wb"], self.w["bb"], True, keep)
        seen = np.concatenate([flat, hf[p.row, p.col], hb[p.row, p.col]], axis=1)
        score = seen @ self.w["out"][:, 0] + self.w["bias"]
        return score, (flat, roots, x, kf, kb, seen)

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Log odds of each block of each page."""
        if not any(pages):
            return [np.zeros(0, np.float32)] * len(pages)
        p = Pages(pages)
        flat, _ = self.forward(p)
        ends = np.cumsum(p.lengths)
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        for k, (end, n) in enumerate(zip(ends.tolist(), p.lengths.tolist())):
            out[p.order[k]] = flat[end - n : end]
        return out

    def gradients(self, p: Pages, labels: np.ndarray) -> dict[str, np.ndarray]:
        score, (flat, roots, x, kf, kb, seen) = self.forward(p, keep=True)
        d = ((_sigmoid(score) - labels) / len(labels)).astype(np.float32)
        grads = {"out": (seen.T @ d)[:, None], "bias": np.array([d.sum()], np.float32)}
        back = d[:, None] * self.w["out"][:, 0]
        size = flat.shape[1]
        dx = np.zeros_like(x)
        dx[p.row, p.col] = back[:, :size]
        for w, b, kept, at in (("wf", "bf", kf, size), ("wb", "bb", kb, size + HIDDEN)):
            dh = np.zeros((p.steps, p.n, HIDDEN), np.float32)
            dh[p.row, p.col] = back[:, at : at + HIDDEN]
            self._unread(grads, dx, x, dh, kept, w, b)
        flat_dx = dx[p.row, p.col]
        grads["path"] = np.zeros_like(self.w["path"])
        np.add.at(grads["path"], p.path, (flat_dx[:, :PATH_SIZE] / roots[0])[p.path_at])
        grads["word"] = np.zeros_like(self.w["word"])
        np.add.at(grads["word"], p.word, (flat_dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / roots[1])[p.word_at])
        return grads

    def _unread(self, grads: dict, dx: np.ndarray, x: np.ndarray, dh: np.ndarray, kept: list, w: str, b: str) -> None:
        """Gradients of one direction, last step read first."""
        size = x.shape[2]
        gw, gb = np.zeros_like(self.w[w]), np.zeros_like(self.w[b])
        rh, rc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, k, i, f, o, u, before, last, th in reversed(kept):
            d = dh[t, :k] + rh[:k]
            dc = rc[:k] + d * o * (1 - th * th)
            g = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), d * th * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            gw[:size] += x[t, :k].T @ g
            gw[size:] += last.T @ g
            gb += g.sum(0)
            dx[t, :k] += g @ self.w[w][:size].T
            rh[:k] = g @ self.w[w][size:].T
            rc[:k] = dc * f
        grads[w], grads[b] = gw, gb


# fixed values: how sites name things, by what they hold
ARTICLE_NAMES = "content article post entry story text body main-content post-content entry-content article-body page-content article__body story-body".split()
NOISE_NAMES = {
    "menu": "nav navbar menu main-menu navigation topnav site-nav breadcrumb breadcrumbs pagination pager tabs".split(),
    "header": "header site-header masthead top-bar branding logo page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer".split(),
    "side": "sidebar side aside widget related related-posts recommended popular trending secondary rail teaser".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay paywall newsletter subscribe".split(),
    "ad": "ad ads advert advertisement ad-slot banner sponsor sponsored promo promotion adsbygoogle".split(),
    "share": "share sharing social social-links tags meta byline author-box follow".split(),
    "form": "form search search-form login signup contact-form subscribe-form".split(),
    "comments": "comments comment comment-list commentlist discussion replies responses disqus comment-body reply".split(),
}
NOISE_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}
NOISE_WORDS = {
    "menu": "Home About Contact News Products Services Login Startseite Kontakt Accueil Inicio Contacto Blog Help FAQ Next Previous".split(),
    "footer": "© Copyright 2024 All rights reserved Privacy policy Terms of use Imprint Impressum Mentions légales Aviso legal Contact".split(),
    "notice": "We use cookies to improve your experience Accept all Reject Subscribe to our newsletter Wir verwenden Cookies Nous utilisons des cookies Utilizamos".split(),
    "ad": "Advertisement Sponsored Buy now Shop Sale off Offer Anzeige Werbung Publicité Publicidad".split(),
    "share": "Share Tweet Facebook Twitter Follow us Email Print Tags Posted by".split(),
    "form": "Search Name Email Password Submit Send Sign up Your message Suche Rechercher Buscar".split(),
    "comments": "Reply Comments says Leave a comment wrote on Antworten Répondre Responder Report".split(),
    "side": "Related Popular Read more Most read Trending You may also like Recent posts Archives".split(),
    "header": "Welcome Menu Skip to content Sign in Subscribe".split(),
}


class Maker:
    """Makes pages of many layouts with the label of each block: 1 for the article."""

    SYLLABLES = "a an ar be ca co de di en er es fo ge ha he in is ka le li ma me mo na ne no o on or pa po que ra re ri sa se si so sta te ter ti to tra un ur va ve vi za".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def some(self, low: int, high: int, kind: str | None = None, end: str = "") -> str:
        n = self.r.randint(low, high)
        words = [self.word() for _ in range(n)]
        if kind in NOISE_WORDS and self.r.random() < 0.6:
            for k in range(n):
                if self.r.random() < 0.6:
                    words[k] = self.r.choice(NOISE_WORDS[kind])
        style = self.r.random()
        if style < 0.06:  # odd texts stand in articles and elsewhere
            words = [words[0]] * n
        elif style < 0.12:
            words = [w + self.r.choice(("###", "%%%", "***", "&amp;&amp;", "!!", "")) for w in words]
        elif style < 0.16:
            words = [w.upper() if self.r.random() < 0.7 else str(self.r.randint(0, 99999)) for w in words]
        for k in range(n - 1):
            if self.r.random() < 0.08:
                words[k] += self.r.choice(",.;")
        text = (" | " if 0.16 < style < 0.22 else " ").join(words)
        return text[0].upper() + text[1:] + end

    def open(self, tag: str, names: list[str] | None = None, named: float = 0.9) -> str:
        if names and self.r.random() < named:
            name = " ".join(self.r.sample(names, 1) + ([f"c{self.r.randint(0, 99)}"] if self.r.random() < 0.3 else []))
            self.out.append(f'<{tag} {self.r.choice(("class", "class", "id"))}="{name}">')
        else:
            self.out.append(f"<{tag}>")
        return tag

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def leaf(self, tag: str, text: str, label: int, link: bool = False) -> None:
        close = f"</{tag}>" if self.r.random() < 0.9 or tag not in ("p", "li") else ""
        inner = f'<a href="/x">{text}</a>' if link else text
        if not link and self.r.random() < 0.15:
            inner = f"<b>{inner}" + ("</b>" if self.r.random() < 0.6 else "")
        if not link and label and self.r.random() < 0.15:
            inner = inner.replace(" ", ' <a href="/y">', 1) + "</a>"
        self.out.append(f"<{tag}>{inner}{close}")
        self.labels.append(label)

    def noise(self, kind: str, inside: bool = False) -> None:
        r = self.r
        tag = NOISE_TAGS.get(kind, "div") if r.random() < 0.55 else r.choice(("div", "div", "section", "ul" if kind == "menu" else "div"))
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        self.open(tag, None if plain else NOISE_NAMES[kind], 1.0 if inside or tag not in NOISE_TAGS.values() else 0.9)
        if kind in ("menu", "share"):
            if tag != "ul" and r.random() < 0.7:
                self.out.append("<ul>")
            for _ in range(r.randint(2, 9)):
                self.leaf("li" if r.random() < 0.8 else "div", self.some(1, 3, kind), 0, r.random() < 0.9)
            self.out.append("</ul>")
        elif kind == "comments":
            if r.random() < 0.7:
                self.leaf(r.choice(("h2", "h3")), self.some(1, 3, kind), 0)
            for _ in range(r.randint(1, 5)):
                own = self.open(r.choice(("div", "li", "article")), NOISE_NAMES[kind], 1.0)
                if r.random() < 0.6:
                    self.leaf(r.choice(("div", "h4")), self.some(1, 4, kind), 0, r.random() < 0.4)
                for _ in range(r.randint(1, 2)):
                    self.leaf("p", self.some(3, 40, None, "."), 0)
                self.close(own)
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                self.leaf(r.choice(("label", "label", "button", "legend", "p", "div")), self.some(1, 5, kind), 0)
                self.out.append('<input type="text" name="q">')
        elif kind == "side":
            for _ in range(r.randint(1, 5)):
                self.leaf(r.choice(("h3", "li", "p", "div")), self.some(2, 14, kind), 0, r.random() < 0.6)
        else:
            for _ in range(r.randint(1, 3)):
                self.leaf(r.choice(("p", "div")), self.some(2, 22, kind, r.choice(("", "."))), 0, r.random() < 0.3)
            if r.random() < 0.3:
                text = self.some(2, 16, kind, ".")
                self.out.append(text)
                self.labels.append(0)
        self.close(tag)

    def article(self, plain: bool) -> None:
        r = self.r
        tags = [r.choice(("article", "article", "main", "div", "div", "section"))]
        if tags[0] == "main" and r.random() < 0.5:
            tags.append(r.choice(("article", "div")))
        for t in tags:
            self.open(t, ARTICLE_NAMES if t in ("div", "section") or r.random() < 0.35 else None)
        if r.random() < 0.8:
            inner = r.random() < 0.2
            if inner:
                self.out.append("<header>")
            title = self.some(2, 12)
            self.leaf(r.choice(("h1", "h1", "h2")), title, 1)
            if r.random() < 0.2:
                self.leaf("p", title, 1)
            self.out.append("</header>" if inner else "")
        nested = r.random() < 0.3
        if nested:
            self.open("div", ARTICLE_NAMES)
        same = self.some(1, 14) if r.random() < 0.08 else ""
        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 8, 12, 20, 30, 60) if r.random() < 0.9 else (40, 90, 150))):
            x = r.random()
            if same and x < 0.9:
                self.leaf("p", same, 1)
                continue
            if x < 0.72:
                self.leaf("p" if r.random() < 0.93 else "div", self.some(*r.choice(((1, 1), (1, 4), (3, 12), (10, 40), (20, 90))), None, r.choice((".", ".", ""))), 1)
            elif x < 0.8:
                self.leaf(r.choice(("h2", "h3", "h4")), self.some(1, 8), 1)
            elif x < 0.87:
                tag = self.open(r.choice(("ul", "ol")))
                for _ in range(r.randint(1, 5)):
                    self.leaf("li", self.some(2, 18), 1)
                self.close(tag)
            elif x < 0.92:
                self.leaf(r.choice(("blockquote", "pre", "figcaption")), self.some(3, 30, None, "."), 1)
            elif x < 0.95:
                self.out.append("<table><tr>")
                for _ in range(r.randint(2, 6)):
                    self.leaf("td", self.some(1, 4), 1)
                self.out.append("</tr></table>")
            elif not plain:
                self.noise(r.choice(("ad", "notice", "share", "side", "form")), inside=True)
        if nested:
            self.close("div")
        for t in reversed(tags):
            self.close(t)

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.out, self.labels = ["<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"], []
        outer = r.random() < 0.4
        if outer:
            self.out.append(f'<div class="{r.choice(("wrapper", "container", "page", "site", "layout"))}">')
        for kind in ("notice", "header", "menu", "ad", "form"):
            if r.random() < (0.75 if kind == "menu" else 0.4):
                self.noise(kind)
        row = r.random() < 0.4
        if row:
            self.out.append(f'<div class="{r.choice(("row", "columns", "main-wrap", "grid"))}">')
        if row and r.random() < 0.3:
            self.noise("side")
        if r.random() < 0.96:
            self.article(r.random() < 0.6)
        for kind in ("share", "side", "comments", "ad", "notice"):
            if r.random() < 0.4:
                self.noise(kind)
        self.out.append("</div>" * row)
        if r.random() < 0.8:
            self.noise("footer")
        self.out.append("</div>" * outer + "</body></html>" * (r.random() < 0.8))
        return "".join(self.out), self.labels


def made_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    maker, found = Maker(seed), []
    while len(found) < n:
        page, labels = maker.page()
        blocks = blocks_of(page)
        if blocks and len(blocks) == len(labels):
            found.append((blocks, np.array(labels, np.float32)))
    return found


@functools.lru_cache(maxsize=4)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The network after some rounds of Adam over ``pages`` made-up pages. It depends on the parameters alone."""
    net, made = Labeller(seed), made_pages(pages, seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        # pages of like length read side by side
        order = sorted(range(len(made)), key=lambda k: (len(made[k][0]) // 8, rng.random()))
        groups = [order[k : k + PAGES_A_STEP] for k in range(0, len(order), PAGES_A_STEP)]
        for g in rng.permutation(len(groups)):
            p = Pages([made[k][0] for k in groups[g]])
            labels = np.concatenate([made[groups[g][k]][1] for k in p.order])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, d in net.gradients(p, labels).items():
                d = np.clip(d, -1, 1)
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                net.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def extract(pages: DataFrame, net: Labeller | None = None, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``source`` added as ``out``; a column of that name is replaced.

    The whole page is read. Kept blocks have their character references decoded and white space turned into one space, and are
    joined in page order by one space. A null or empty page, or one without article blocks, gives an empty text. Rows are
    independent, so repeated rows, null keys and empty tables need no care.
    """
    shared = pages.sparkSession.sparkContext.broadcast(net or train())  # size: fixed by SHAPES
    keep = [c for c in pages.columns if c != out]

    rows, at = text_once(pages, keep, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, at, 256):
            cut = [blocks_of(x or "") for x in batch.column(at).to_pylist()]
            texts = [""] * len(cut)
            for group in side_by_side([len(b) for b in cut]):
                for k, score in zip(group, model.scores([cut[k] for k in group])):
                    texts[k] = " ".join(b.text for b, s in zip(cut[k], score) if s > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, out])

    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(out, T.StringType())])
    return rows.mapInArrow(run, schema)


def side_by_side(lengths: list[int]) -> Iterator[list[int]]:
    """Groups of pages of like length that are read together, within the bounds."""
    group: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if group and (len(group) >= PAGES_AT_ONCE or (len(group) + 1) * lengths[group[0]] > BLOCKS_AT_ONCE):
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
