"""Main text of web pages: a recurrent labeller over the page's blocks.

A page becomes the sequence of its leaf texts, the blocks. Each is described by
its tag path (tags with classes, ids and roles), its hashed words and a few
numbers. A bidirectional LSTM in numpy reads the sequence both ways, and every
block is classified from both states at its place and the mean of all states,
so a label depends on the whole page. It is trained here, on pages that a
generator makes in many layouts.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import text_or_empty
from monthmatch.llm.words import Words

# --- blocks --------------------------------------------------------------

# Fixed values of HTML: elements within a line, elements without an end, and
# elements whose content is not page text. Of those, the raw ones hold no
# elements: only their own end tag or the end of the page ends them.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset(
    "script style noscript template textarea title select button svg iframe object canvas audio video".split()
)
_RAW = frozenset("script style textarea title".split())
# Elements that end a drawing they stand in, unless they are within one of its points.
_NOT_DRAWN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_POINTS = frozenset("foreignobject desc title".split())
# An element that ends others of these kinds when it starts.
_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"tr", "td", "th"},
    "option": {"option"},
}
_SCOPES = frozenset("ul ol dl table td th div section article body".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
# A value that a slash at the end of the tag belongs to.
_UNQUOTED = re.compile(r"""=\s*[^\s"']+$""")
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True


@dataclass(frozen=True)
class Block:
    """A leaf text with the path of elements around it; each element is a tuple of its tag and names."""

    text: str
    path: tuple[tuple[str, ...], ...]
    linked: float


def _names(rest: str) -> tuple[str, ...]:
    if "=" not in rest:
        return ()
    values = (m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(rest))
    return tuple(w.lower() for v in values for w in re.split(r"[\W_]+", v) if w)


def _scoped(tag: str) -> bool:
    """Whether an end tag does not reach beyond the list, cell or section it stands in."""
    return tag in _INLINE or tag == "p"


class _Reader:
    """Collects the blocks of one page."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, ...]] = []
        #: An open element whose text is ignored and what is open in it, each with whether it is drawn.
        self.ignored: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        self.path: tuple[tuple[str, ...], ...] = ()
        self.chars = self.linked = 0

    def text(self, raw: str) -> None:
        if not raw or self.ignored:
            return
        text = entities.unescape(raw)
        visible = len(text) - text.count(" ")
        if not self.chars and visible and not text.isspace():
            self.path = tuple(self.open)
        self.parts.append(text)
        self.chars += visible
        if any(e[0] == "a" for e in self.open):
            self.linked += visible

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.path, self.linked / max(self.chars, 1)))
        self.parts, self.chars, self.linked = [], 0, 0

    def place(self, kinds: set[str], scoped: bool) -> int:
        """Where the innermost open element of the kinds is, or -1."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in kinds:
                return k
            if scoped and self.open[k][0] in _SCOPES:
                break
        return -1

    def close(self, kinds: set[str], scoped: bool) -> None:
        """End the innermost open element of the kinds, with what is open in it."""
        k = self.place(kinds, scoped)
        if k >= 0:
            del self.open[k:]

    def ignore(self, tag: str) -> None:
        """Open an element within the ignored one, or the ignored one itself."""
        drawn = bool(self.ignored) and self.ignored[-1][1]
        self.ignored.append((tag, tag == "svg" or (drawn and tag not in _POINTS)))

    def unignore(self, tag: str) -> bool:
        """End the innermost element of the tag within the ignored one, or that one itself."""
        for k in range(len(self.ignored) - 1, -1, -1):
            if self.ignored[k][0] == tag:
                del self.ignored[k:]
                return True
        return False

    def ignores(self, tag: str, end: bool, empty: bool) -> bool:
        """Whether a tag belongs to the ignored element; one that does not ends it."""
        if end:
            if self.unignore(tag) or self.place({tag}, _scoped(tag)) < 0:
                return True
            self.ignored = []
            return False
        while self.ignored and self.ignored[-1][1] and tag in _NOT_DRAWN:
            self.unignore("svg")
        if not self.ignored:
            return False
        if tag in ("button", "select"):
            # These do not nest.
            self.unignore(tag)
        if not empty and tag not in _VOID:
            self.ignore(tag)
        return bool(self.ignored)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page, in its order, with decoded text in single spaces."""
    reader, at = _Reader(), 0
    while True:
        found = _TOKEN.search(page, at)
        reader.text(page[at : found.start()] if found else page[at:])
        if found is None:
            break
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        end = bool(found["end"] or found["end2"])
        rest = found["rest"] or found["rest2"] or ""
        empty = rest.endswith("/") and not _UNQUOTED.search(rest)
        if tag in _RAW and not end:
            drawn = bool(reader.ignored) and reader.ignored[-1][1]
            closing = None
            if not drawn or not (empty or tag == "title"):
                closing = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            # In a drawing these are elements as others.
            if closing or not drawn:
                at = closing.end() if closing else len(page)
                continue
        if reader.ignored and reader.ignores(tag, end, empty):
            continue
        if tag == "br":
            reader.text(" ")
        if tag not in _INLINE and tag not in _SKIPPED:
            reader.flush()
        if end:
            reader.close({tag}, _scoped(tag))
        elif tag in _SKIPPED:
            if not empty:
                reader.ignore(tag)
        elif tag not in _VOID:
            if tag not in _INLINE:
                # A paragraph ends where another block starts.
                reader.close({"p"}, scoped=True)
                if tag in _ENDS:
                    reader.close(_ENDS[tag], scoped=False) if tag == "tr" else _close_sibling(reader, tag)
            reader.open.append((tag, *_names(rest)))
    reader.flush()
    return reader.blocks


def _close_sibling(reader: _Reader, tag: str) -> None:
    """End an open item of the same list or row, not one of a list around it."""
    stop = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}.get(tag, {"tr", "table"})
    for k in range(len(reader.open) - 1, -1, -1):
        if reader.open[k][0] in _ENDS[tag]:
            del reader.open[k:]
            return
        if reader.open[k][0] in stop:
            return


# --- description of blocks -----------------------------------------------

PATH_SIZE, WORD_SIZE, NUMBERS = 192, 64, 10
#: Letters at the start of a name that count by themselves, for names of several words.
PREFIX = 4
SIZE = PATH_SIZE + WORD_SIZE + NUMBERS
#: Share of pages whose words are hidden in training, and decimals that weights keep.
UNREAD, DECIMALS = 0.4, 3


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


@functools.lru_cache(maxsize=1 << 14)
def _path_slots(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """The features that a tag path sets."""
    tokens = {"<" + element[0] for element in path}
    tokens |= {"." + name for element in path for name in element[1:]}
    tokens |= {"~" + name[:PREFIX] for element in path for name in element[1:]}
    if path:
        tokens.add("<<" + path[-1][0])
    return np.asarray(sorted({_slot(t, PATH_SIZE) for t in tokens}), dtype=np.int64)


# Characters that end a sentence or part one, in several scripts.
_ENDS_SENTENCE = ".!?;\u3002\uff01\uff1f\u061f\u0964"
_PARTS_SENTENCE = ",\uff0c\u3001\u060c"


def describe(blocks: Sequence[Block]) -> np.ndarray:
    """A row of features for each block."""
    out = np.zeros((len(blocks), SIZE), dtype=np.float32)
    if not len(blocks):
        return out
    numbers = PATH_SIZE + WORD_SIZE
    # All words of the page at once; a text goes on in any number of bytes.
    words = Words(pa.array([b.text.encode("utf-8", "surrogatepass") for b in blocks], pa.binary()))
    cells = words.text * WORD_SIZE + (words.hashes() % np.uint64(WORD_SIZE)).astype(np.int64)
    counts = np.bincount(cells, minlength=len(blocks) * WORD_SIZE).reshape(len(blocks), WORD_SIZE)
    n_words = words.counts()
    digits = np.diff(np.searchsorted(np.flatnonzero(_DIGIT[words.data]), words.ends))
    for i, b in enumerate(blocks):
        out[i, _path_slots(b.path)] = 1
        n = len(b.text)
        out[i, numbers:] = (
            np.log1p(n) / 8,
            np.log1p(n_words[i]) / 6,
            b.linked,
            sum(map(b.text.count, _ENDS_SENTENCE)) / n * 10,
            sum(map(b.text.count, _PARTS_SENTENCE)) / n * 10,
            b.text[-1] in _ENDS_SENTENCE or b.text[-1] == ":",
            digits[i] / n,
            min(len(b.path), 40) / 10,
            i / len(blocks),
            1.0,
        )
    out[:, PATH_SIZE:numbers] = counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1)
    return out


# --- labeller ------------------------------------------------------------


@dataclass
class Labeller:
    """Weights: for each direction input, recurrent and bias; then the output layer."""

    weights: dict[str, np.ndarray]

    def probabilities(self, pages: Sequence[np.ndarray], cells: int = 1 << 15) -> list[np.ndarray]:
        """For each page the probability of each of its blocks to be main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            # Pages of like length side by side, as many as keep the matrices small.
            longest = len(pages[order[-1]])
            some = [order.pop() for _ in range(min(len(order), max(1, cells // longest)))]
            x, mask = _padded([pages[i] for i in some])
            p = _forward(self.weights, x, mask)[0]
            for k, i in enumerate(some):
                out[i] = p[k, : len(pages[i])]
        return out


def _padded(pages: Sequence[np.ndarray], kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x = np.zeros((len(pages), longest, SIZE), dtype=kind)
    mask = np.zeros((len(pages), longest), dtype=kind)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(w: dict, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """States of one direction; a step of padding keeps the state before."""
    pages, steps, _ = x.shape
    hidden = w[f"{d}u"].shape[0]
    given = x.reshape(-1, x.shape[2]) @ w[f"{d}w"] + w[f"{d}b"]
    given = given.reshape(pages, steps, 4 * hidden)
    h = c = np.zeros((pages, hidden), dtype=x.dtype)
    states, trace = np.zeros((pages, steps, hidden), dtype=x.dtype), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = given[:, t] + h @ w[f"{d}u"]
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        new = f * c + i * g
        squashed = np.tanh(new)
        m = mask[:, t : t + 1]
        trace.append((t, i, f, o, g, c, h, squashed, m))
        c = m * new + (1 - m) * c
        h = m * o * squashed + (1 - m) * h
        states[:, t] = h
    return states, trace


def _forward(w: dict, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    ahead, trace_f = _lstm(w, "f", x, mask)
    back, trace_b = _lstm(w, "b", x, mask)
    both = np.concatenate([ahead, back], axis=2) * mask[:, :, None]
    mean = both.sum(axis=1) / mask.sum(axis=1, keepdims=True)
    out = both @ w["v"] + (mean @ w["m"])[:, None] + w["c"]
    return _sigmoid(out), (both, mean, trace_f, trace_b)


def _lstm_back(w: dict, d: str, x: np.ndarray, trace: list, dstates: np.ndarray, grads: dict) -> None:
    hidden = w[f"{d}u"].shape[0]
    dh = dc = np.zeros((len(x), hidden))
    dgiven = np.zeros((*x.shape[:2], 4 * hidden))
    du = np.zeros_like(w[f"{d}u"])
    for t, i, f, o, g, c, h, squashed, m in reversed(trace):
        dh = dh + dstates[:, t]
        dnew_h, dh_kept = dh * m, dh * (1 - m)
        dnew = dc * m + dnew_h * o * (1 - squashed**2)
        dz = np.concatenate(
            [
                dnew * g * i * (1 - i),
                dnew * c * f * (1 - f),
                dnew_h * squashed * o * (1 - o),
                dnew * i * (1 - g**2),
            ],
            axis=1,
        )
        dgiven[:, t] = dz
        du += h.T @ dz
        dc = dc * (1 - m) + dnew * f
        dh = dh_kept + dz @ w[f"{d}u"].T
    flat = dgiven.reshape(-1, 4 * hidden)
    grads[f"{d}u"], grads[f"{d}b"] = du, flat.sum(axis=0)
    grads[f"{d}w"] = x.reshape(-1, x.shape[2]).T @ flat


def train(
    pages: Sequence[np.ndarray],
    labels: Sequence[np.ndarray],
    hidden: int = 24,
    epochs: int = 5,
    batch: int = 24,
    rate: float = 4e-3,
    seed: int = 3,
) -> Labeller:
    """Fit by Adam on the cross-entropy; the same pages give the same weights.

    Sums are taken in doubles and the weights rounded at the end, so that the
    order in which a machine adds does not show in them.
    """
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        w[f"{d}w"] = rng.normal(0, SIZE**-0.5, (SIZE, 4 * hidden))
        w[f"{d}u"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1
        w[f"{d}b"] = bias
    w["v"] = rng.normal(0, 0.2, 2 * hidden)
    w["m"] = np.zeros(2 * hidden)
    w["c"] = np.zeros(())
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    usable = [i for i in range(len(pages)) if len(pages[i])]
    for _ in range(epochs):
        order = rng.permutation(usable)
        # Like lengths together within stretches of a random order.
        for s in range(0, len(order), 8 * batch):
            stretch = sorted(order[s : s + 8 * batch], key=lambda i: len(pages[i]))
            for k in range(0, len(stretch), batch):
                some = stretch[k : k + batch]
                x, mask = _padded([pages[i] for i in some], np.float64)
                # Words are hidden on some pages, as pages in other languages have other ones.
                x[rng.random(len(some)) < UNREAD, :, PATH_SIZE : PATH_SIZE + WORD_SIZE] = 0
                y = np.zeros(mask.shape)
                for r, i in enumerate(some):
                    y[r, : len(labels[i])] = labels[i]
                p, (both, mean, trace_f, trace_b) = _forward(w, x, mask)
                dout = (p - y) * mask / mask.sum()
                dsum = dout.sum(axis=1, keepdims=True)
                dboth = dout[:, :, None] * w["v"] + (dsum / mask.sum(axis=1, keepdims=True))[:, :, None] * w["m"]
                dboth *= mask[:, :, None]
                grads = {
                    "v": (both * dout[:, :, None]).sum(axis=(0, 1)),
                    "m": mean.T @ dsum[:, 0],
                    "c": dout.sum(),
                }
                _lstm_back(w, "f", x, trace_f, dboth[:, :, :hidden], grads)
                _lstm_back(w, "b", x, trace_b, dboth[:, :, hidden:], grads)
                step += 1
                scale = min(1, 5 / max(1e-9, np.sqrt(sum((g**2).sum() for g in grads.values()))))
                for name, g in grads.items():
                    g = g * scale
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g**2
                    change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    w[name] = (w[name] - rate * change)
    return Labeller({k: np.round(v, DECIMALS).astype(np.float32) for k, v in w.items()})


# --- pages to learn from -------------------------------------------------

#: Stands before each main text of a made page; private to the generator.
_MAIN = ""
#: Letters of made-up words: those that begin a syllable and those that end it.
_SCRIPTS = (
    ("bcdfghjklmnprstvwz", "aeiou"),
    ("bcdfghjklmnprstvwz", "aeiou\u00e4\u00f6\u00fc\u00e9\u00e8\u00f1"),
    ("".join(map(chr, range(0x431, 0x44A))), "\u0430\u0435\u0438\u043e\u0443\u044f"),
    ("\u03b2\u03b3\u03b4\u03ba\u03bb\u03bc\u03bd\u03c0\u03c1\u03c3\u03c4", "\u03b1\u03b5\u03b9\u03bf\u03c5"),
    ("".join(map(chr, range(0x628, 0x63B))), "\u0627\u0648\u064a"),
)
#: Ideographs, of which sentences are written without spaces.
_IDEOGRAPHS = (0x4E00, 0x9FA5)
# Words of site furniture, by what they stand in.
_LINK_WORDS = (
    "Home About Contact News Products Services Blog Login Register Shop Help Support Careers Archive Sitemap Menu "
    "Start Kontakt Accueil Inicio Impressum Datenschutz"
).split()
_NOTICES = (
    "We use cookies to improve your experience",
    "This site uses cookies. By continuing you accept our policy",
    "Subscribe to our newsletter",
    "Please enable JavaScript",
    "Sign up for free to read more",
    "Wir verwenden Cookies",
    "Nous utilisons des cookies",
)
_LEGAL = (
    "Copyright 2024. All rights reserved.",
    "© 2023 Example Inc. Terms of use. Privacy policy.",
    "Alle Rechte vorbehalten",
    "Tous droits réservés",
    "Powered by Example",
)
_BOX = {
    "nav": "menu nav navigation navbar topnav main-menu breadcrumb breadcrumbs pagination pager tabs toolbar",
    "ad": "ad ads advert advertisement banner sponsor sponsored promo adsense",
    "notice": "cookie cookies consent notice gdpr popup modal alert newsletter subscribe overlay message",
    "side": "sidebar side widget aside left-column right-column secondary rail",
    "related": "related recommended more-stories share social trending popular tags read-more",
    "comments": "comments comment-list discussion responses replies feedback commentlist reader-comments",
    "foot": "footer bottom legal site-info colophon copyright",
    "head": "header masthead top site-header branding logo",
    "main": "content post entry entry-content article article-body story main main-content text post-body body-text",
}


class _Maker:
    """Makes pages with furniture around, before, after and within a main text.

    Each page has a script and a stock of words of its own, from three words
    to ever new ones, so that only the words of site furniture tell anything.
    """

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.ideographs = self.r.random() < 0.12
        self.script = _SCRIPTS[self.r.choices(range(len(_SCRIPTS)), (6, 2, 2, 1, 1))[0]]
        size = self.r.choice((3, 8, 40, 300, 0, 0))
        self.stock = [self.new_word() for _ in range(size)]

    def new_word(self) -> str:
        if self.ideographs:
            return "".join(chr(self.r.randint(*_IDEOGRAPHS)) for _ in range(self.r.choice((1, 2, 2, 3))))
        first, last = self.script
        return "".join(
            self.r.choice(first) + self.r.choice(last) + (self.r.choice(first) if self.r.random() < 0.3 else "")
            for _ in range(self.r.choice((1, 1, 2, 2, 3, 4)))
        )

    def word(self) -> str:
        return self.r.choice(self.stock) if self.stock else self.new_word()

    def prose(self, low: int, high: int) -> str:
        out: list[str] = []
        marks = ("", "\uff0c", "\u3002", "", "\uff01") if self.ideographs else ("", ",", ".", "&amp;", "!")
        # Some texts are sentences, some go on without a mark.
        shares = (80, 7, 10, 1, 1) if self.r.random() < 0.8 else (1, 0, 0, 0, 0)
        for k in range(self.r.randint(low, high)):
            w = self.word()
            if k == 0 or out[-1].endswith("."):
                w = w.capitalize()
            out.append(w + self.r.choices(marks, shares)[0])
        joint = "" if self.ideographs else " "
        return joint.join(out) + self.r.choice((marks[2], marks[2], "", "?"))

    def box(self, kind: str, inner: str, tags: Sequence[str] = ("div", "div", "section")) -> str:
        names = _BOX[kind].split()
        attribute = self.r.choice(("class", "class", "id"))
        extra = f" {self.word()}" if self.r.random() < 0.3 else ""
        tag = self.r.choice(tags)
        return f'<{tag} {attribute}="{self.r.choice(names)}{extra}">{inner}</{tag}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        def text() -> str:
            return self.r.choice(_LINK_WORDS) if self.r.random() < 0.5 else self.word()

        some = [f'<a href="/{self.word()}">{text()}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in some) + "</ul>"
        return self.r.choice((" | ", " ", "")).join(some)

    def furniture(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return f"<nav>{self.links()}</nav>" if r.random() < 0.6 else self.box("nav", self.links(), ("div", "ul"))
        if kind == "ad":
            inner = self.prose(2, 60)
            return self.box("ad", f"<p>{inner}</p>" if r.random() < 0.4 else inner, ("div", "div", "section", "aside"))
        if kind == "notice":
            inner = f"{r.choice(_NOTICES)} {self.prose(0, 30)}"
            return self.box("notice", f"<p>{inner}</p>" if r.random() < 0.5 else inner)
        if kind == "side":
            inner = f"<h3>{self.prose(1, 4)}</h3>"
            inner += self.links() if r.random() < 0.6 else "".join(f"<p>{self.prose(4, 60)}</p>" for _ in range(2))
            return f"<aside>{inner}</aside>" if r.random() < 0.6 else self.box("side", inner)
        if kind == "related":
            return self.box("related", f"<h3>{self.prose(1, 4)}</h3>{self.links()}")
        if kind == "comments":
            ones = "".join(
                f'<div class="comment"><b>{self.word()}</b><p>{self.prose(3, 70)}</p></div>'
                if r.random() < 0.7
                else f"<li class='reply'>{self.prose(3, 60)}</li>"
                for _ in range(r.randint(1, 6))
            )
            title = r.choice(("Comments", "Kommentare", self.word(), self.prose(1, 4)))
            heading = f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{title}</{h}>" if r.random() < 0.8 else ""
            if r.random() < 0.3:
                ones = "".join(f"<p>{self.prose(3, 70)}</p>" for _ in range(r.randint(1, 5)))
            elif r.random() < 0.3:
                ones = "".join(f"<li><p>{self.prose(3, 70)}</p></li>" for _ in range(r.randint(1, 5)))
                return self.box("comments", heading + ones, ("ol", "ul"))
            return self.box("comments", heading + ones)
        if kind == "form":
            return (
                f"<form action='/x'><label>{self.word()}</label><input name=a><p>{self.prose(2, 25)}</p>"
                f"<button>{self.word()}</button></form>"
            )
        if kind == "foot":
            inner = f"{r.choice(_LEGAL)} {self.prose(0, 30)}" if r.random() < 0.6 else self.prose(3, 40)
            inner = f"<p>{inner}</p>" if r.random() < 0.4 else inner
            inner += self.links(2, 5) if r.random() < 0.4 else ""
            return f"<footer>{inner}</footer>" if r.random() < 0.7 else self.box("foot", inner)
        inner = f"<a href='/'>{self.word()}</a><p>{self.prose(1, 12)}</p>"
        return f"<header>{inner}</header>" if r.random() < 0.6 else self.box("head", inner)

    def main(self) -> str:
        r, parts = self.r, []
        title = f"<h1>{_MAIN}{self.prose(2, 12)}</h1>"
        if r.random() < 0.6:
            parts.append(f"<header>{title}</header>" if r.random() < 0.1 else title)
        loose = r.random() < 0.35
        # Some texts are of paragraphs only, some of paragraphs that are alike.
        plain, alike = r.random() < 0.3, r.random() < 0.3
        low, high = r.choice(((2, 8), (5, 25), (30, 90))) if alike else (3, 90)
        for _ in range(r.choices((1, 2, 4, 8, 14, 30, 80, 300, 900), (150, 100, 110, 90, 50, 30, 15, 4, 1))[0]):
            kind = 0 if plain else r.random()
            text = self.prose(low, high) if alike or r.random() < 0.8 else self.prose(1, 8)
            if kind < 0.66:
                if not plain and r.random() < 0.25:
                    text = f"{text} <a href='/x'>{self.word()}</a> <em>{self.word()}</em> {self.prose(2, 20)}"
                parts.append(f"<p>{_MAIN}{text}" + ("" if loose else "</p>"))
            elif kind < 0.74:
                parts.append(f"<p><b>{_MAIN}{self.prose(2, 9)}<br>" if loose else f"<h2>{_MAIN}{self.prose(2, 9)}</h2>")
            elif kind < 0.8:
                items = "".join(f"<li>{_MAIN}{self.prose(2, 25)}</li>" for _ in range(r.randint(2, 6)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.84:
                parts.append(f"<blockquote>{_MAIN}{text}</blockquote>")
            elif kind < 0.87:
                cells = "".join(f"<tr><td>{_MAIN}{self.word()}<td>{_MAIN}{self.prose(1, 4)}" for _ in range(3))
                parts.append(f"<table>{cells}</table>")
            elif kind < 0.89:
                parts.append(f"<pre>{_MAIN}{text}</pre>")
            else:
                parts.append(self.furniture(r.choice(("ad", "ad", "related", "side", "notice", "form"))))
        if r.random() < 0.15:
            parts.append(self.furniture("comments"))
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.42:
            inner = f"<article>{inner}</article>"
        elif kind < 0.54:
            inner = f"<main>{inner}</main>"
        elif kind < 0.76:
            inner = self.box("main", inner)
        elif kind < 0.86:
            inner = f"<div>{inner}</div>"
        return inner

    def page(self) -> tuple[list[Block], np.ndarray]:
        r = self.r

        def some(kinds: Sequence[tuple[str, float]]) -> list[str]:
            return [self.furniture(k) for k, share in kinds if r.random() < share]

        before = some((("notice", 0.25), ("head", 0.4), ("nav", 0.85), ("ad", 0.6), ("side", 0.15), ("form", 0.1)))
        after = some(
            (("related", 0.3), ("comments", 0.35), ("ad", 0.2), ("side", 0.25), ("form", 0.15), ("foot", 0.9), ("notice", 0.15))
        )
        bare = r.random()
        # Some pages have nothing but their main text, some nothing before or after it.
        before, after = [] if bare < 0.16 else before, [] if bare < 0.12 or bare > 0.96 else after
        body = "".join(before) + (self.main() if bare < 0.12 or r.random() < 0.96 else "") + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f'<div class="{r.choice(("wrapper", "page", "container", "row", self.word()))}">{body}</div>'
        if r.random() < 0.8:
            body = f"<html><head><title>{self.word()}</title></head><body>{body}</body></html>"
        found = blocks_of(body)
        labels = np.asarray([_MAIN in b.text for b in found], dtype=np.float32)
        return [Block(b.text.replace(_MAIN, ""), b.path, b.linked) for b in found], labels


def made_pages(count: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Descriptions and labels of the blocks of made pages; 1 is main text."""
    pages = []
    for k in range(count):
        blocks, labels = _Maker(seed * 1_000_003 + k).page()
        # A block of nothing but the mark is no text.
        kept = [i for i, b in enumerate(blocks) if b.text]
        pages.append((describe([blocks[i] for i in kept]), labels[kept]))
    return [x for x, _ in pages], [y for _, y in pages]


@functools.lru_cache(maxsize=4)
def trained_labeller(count: int = 2400, seed: int = 5) -> Labeller:
    """The labeller trained on so many made pages; once per process."""
    return train(*made_pages(count, seed))


# --- extraction ----------------------------------------------------------


def main_texts(
    pages: Sequence[str], labeller: Labeller, threshold: float = 0.5, separator: str = "\n"
) -> list[str]:
    """The main text of each page: its blocks labelled as such, with the separator between them."""
    blocks = [blocks_of(p) for p in pages]
    labels = labeller.probabilities([describe(b) for b in blocks])
    return [
        separator.join(b.text for b, p in zip(bs, ps, strict=True) if p > threshold)
        for bs, ps in zip(blocks, labels, strict=True)
    ]


def extract_main_text(
    df: DataFrame,
    html: str = "html",
    labeller: Labeller | None = None,
    threshold: float = 0.5,
    separator: str = "\n",
) -> DataFrame:
    """Append ``text`` and ``n_chars``: the page's main text and its code points.

    Null and empty pages, and pages without main text, have the empty text.
    Character references are decoded, white space within a block becomes one
    space, blocks are joined by ``separator``. What scripts, styles, titles, text
    fields, buttons, selections, drawings, frames, media and the like hold is no
    text of the page; without an end tag, the first four end with the page and
    the others with the element around them. Nothing else is dropped. A page
    that ends within a tag or a comment ends there. Columns of the
    two names are replaced, all other columns and all rows stay. No shuffle.
    """
    labeller = labeller or trained_labeller()

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        def texts() -> Iterator[str]:
            # A few pages at a time, by their size, so that descriptions stay small.
            some, held = [], 0
            for page in pages:
                some.append(page)
                held += len(page)
                if held >= 2 << 20:
                    yield from main_texts(some, labeller, threshold, separator)
                    some, held = [], 0
            yield from main_texts(some, labeller, threshold, separator)

        return pd.Series(list(texts()), dtype=object)

    return df.withColumn("text", extracted(text_or_empty(html))).withColumn(
        "n_chars", F.length("text").cast("long")
    )
