"""Main-text extraction: a bidirectional LSTM labels every leaf block of a page.

A page becomes the sequence of its leaf blocks (text between block-level tags;
scripts, styles and markup are no text). Each block is read as one vector:
hashed tag path (names, class and id words, position in the path), hashed
words, and a few measures (length, link share, position). A numpy LSTM runs over
the sequence in both directions, so every label sees the whole document, and a
logistic output keeps or drops the block.

It is trained here on a bounded sample: the ``SAMPLE_PAGES`` pages with the smallest hash
of their id, whose blocks are labelled by their semantic ancestors (article or main:
text; nav, header, footer, aside, form, advert, notice, comment: boilerplate), and
seeded variants of them with other wrappers and inserted boilerplate blocks, so that
class words and neighbourhood count where semantic tags are missing. Sampled pages without
article or main lend only their texts; seeded pages with article, main, content-class and plain wrappers
are always in the training set, more of them where few pages are labelled. Every page and its whole html is scored.

Defined cases: null or empty html gives an empty text; unclosed and stray tags
are tolerated (without an end tag only script and style hide the rest of the page); a page without semantic tags is labelled by the model alone; an empty
table gives no rows; repeated pages are labelled each; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import U64, word_hashes, words

SAMPLE_PAGES = 300
#: seeded pages in every training set, and labelled sequences to reach with them where few pages have semantic tags
SEEDED_PAGES, LEAST_SEQUENCES = 120, 1200
PATH_DIM, WORD_DIM, MEASURES = 48, 24, 6
INPUT = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 16
EPOCHS = 10
_BATCH = 64

TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>|([^<]+|<)", re.S)
#: text alone, in the group that it has in TOKENS
_TEXT = re.compile(r"(\b\B)?(\b\B)?(\b\B)?([^<]+|<)")
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_QUOTED = re.compile(r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)")
#: nearest ancestors that a block's path holds
DEPTH = 64
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
                     "ol p pre section table ul".split())
RAW = frozenset(("script", "style"))
SKIPPED = RAW | frozenset("noscript template svg textarea select iframe head".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
IN_SELECT = frozenset("option optgroup hr script template".split())
#: HTML start tags that end an svg element outside of its foreignObject
BREAKOUT = CLOSES_P | frozenset("b big body br center code dd dt em embed head i img li listing meta nobr ruby s small span strong "
                                "strike sub sup tt u var".split())
FOREIGN = frozenset("svg math mspace mglyph malignmark maligngroup mprescripts none".split())
GOOD_TAGS = frozenset(("article", "main"))
BAD_TAGS = frozenset("nav header footer aside form dialog menu button".split())
BAD_WORDS = ("ad", "ads", "advert", "banner", "cookie", "notice", "comment", "comments", "sidebar", "menu", "navbar",
             "breadcrumb", "share", "social", "related", "promo", "sponsored", "newsletter", "footer", "header", "popup",
             "consent", "login", "signup", "widget", "pagination", "disclaimer", "reply", "replies")
GOOD_WORDS = ("content", "post", "entry", "story", "text", "body", "articlebody", "maincontent")
_WORD = re.compile(r"[a-z]+|[0-9]+")


class _Page:
    """Tokens of a page, in time in proportion to its length however broken it is.

    A tag that does not end is text. To find that, it is read to the end of the page, and its quotes are noted: a later
    tag whose name ends outside of them would be read the same way, so it is text at once. Three such notes
    cover every state a tag can be in.
    """

    def __init__(self, html: str):
        self.html = html
        self.open_from = len(html) + 1  # no ">" from here on
        self.name = (0, 0)              # of the last tag that does not end
        self.notes: list[tuple[int, list[int], list[int]]] = []  # from where, starts and ends of quotes
        self.unclosed: dict[str, int] = {}  # no end tag from here on
        self.broken = False             # whether a tag without end was met

    def token(self, at: int) -> re.Match:
        html = self.html
        if not self.broken:
            m = TOKENS.match(html, at)
            if m.group(4) == "<":
                self._note(at, None)
            return m
        if html[at] != "<" or html.startswith("<!--", at):
            return TOKENS.match(html, at)
        if at >= self.open_from or self.name[0] < at < self.name[1]:
            return _TEXT.match(html, at)
        name = _NAME.match(html, at) if self.notes else None
        if name:
            for begin, starts, ends in self.notes:
                i = bisect_left(starts, name.end()) - 1
                if begin <= at and (i < 0 or name.end() >= ends[i]):
                    self.name = name.span()
                    return _TEXT.match(html, at)
        m = TOKENS.match(html, at)
        if m.group(4) is not None:
            self._note(at, name)
        return m

    def _note(self, at: int, name: re.Match | None) -> None:
        html = self.html
        if html.find(">", at) < 0:
            self.open_from = at
        elif name := name or _NAME.match(html, at):
            spans = [q.span() for q in _QUOTED.finditer(html, name.end())]
            if spans and (html[spans[-1][1] - 1] != html[spans[-1][0]] or spans[-1][1] - spans[-1][0] == 1):
                spans[-1] = (spans[-1][0], len(html) + 1)
            self.notes.append((at, [x for x, _ in spans], [y for _, y in spans]))
            self.name = name.span()
        else:
            return
        self.broken = True

    def closed(self, tag: str, at: int) -> int | None:
        """End of the next end tag of ``tag``; None is remembered."""
        if at >= min(self.unclosed.get(tag, at + 1), self.open_from):
            return None
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(self.html, at) if self.html.find(">", at) >= 0 else None
        if m is None:
            self.unclosed[tag] = at
        return m.end() if m else None


def _skipped(page: _Page, tag: str, rest: str, at: int, missing: dict[str, int]) -> int:
    """Where an element without text for the reader ends, whose start tag ends at ``at``.

    Without an end tag only script and style reach to the end of the page; head, select and svg end
    before the first tag that cannot be inside, the others are their start tag alone. ``missing`` notes tags
    that were sought to the end of the page, so that no page is read again for each of them.
    """
    if tag in RAW:
        return page.closed(tag, at) or len(page.html)
    if tag == "svg" and rest.rstrip().endswith("/"):
        return at
    if tag not in ("head", "select", "svg", "template") or missing.get(tag):
        end = None if missing.get(tag) == 2 else page.closed(tag, at)
        if end is None:
            missing[tag] = 2
        return end or at
    opened = [tag]
    pos = at
    while pos < len(page.html):
        m = page.token(pos)
        pos = m.end()
        if m.group(4) is not None:
            if tag == "head" and m.group(4).strip():
                return m.start()
            continue
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name in opened:
                while opened.pop() != name:
                    pass
                if not opened:
                    return pos
            elif tag == "svg" or tag == "select" or tag == "head" and name in ("body", "html", "br"):
                return m.start()
        elif name in RAW:
            pos = page.closed(name, pos) or len(page.html)
        elif tag == "head":
            if name not in IN_HEAD:
                return m.start()
            if name in ("title", "noscript", "template", "noframes"):
                pos = page.closed(name, pos) or pos
        elif tag == "select" and name not in IN_SELECT:
            return m.start()
        elif tag == "svg" and name in BREAKOUT and "foreignobject" not in opened:
            return m.start()
        elif name not in VOID and not m.group(3).rstrip().endswith("/"):
            opened.append(name)
    missing[tag] = 1
    return at


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of the text inside links) of the leaf blocks, in page order.

    A path holds the ``DEPTH`` nearest ancestors that are not inline.
    """
    out: list[tuple[tuple[str, ...], str, float]] = []
    path: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = total = in_link = 0
    missing: dict[str, int] = {}
    reader, match = _Page(page), TOKENS.match
    opened: Counter = Counter()  # tags on the path
    outer: list[int] = []        # places on the path that are not inline

    def cut(i: int) -> None:
        for name, _ in path[i:]:
            opened[name] -= 1
        del path[i:]
        while outer and outer[-1] >= i:
            outer.pop()

    def close() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(path[i][1] for i in outer[-DEPTH:]), text, linked / max(total, 1)))
            parts.clear()
        linked = total = 0

    pos = 0
    while pos < len(page):
        m = match(page, pos) if not reader.broken else reader.token(pos)
        t = m.group(4)
        if t is not None:
            if t == "<" and not reader.broken:
                reader.token(pos)
            pos = m.end()
            if "&" in t:
                t = entities.unescape(t)
            parts.append(t)
            total += len(t)
            linked += len(t) if in_link else 0
            continue
        pos = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close()
        if tag in SKIPPED and not m.group(1):
            pos = _skipped(reader, tag, m.group(3), pos, missing)
            continue
        if m.group(1):
            if tag == "a":
                in_link = 0
            if opened[tag]:
                cut(next(i for i in range(len(path) - 1, -1, -1) if path[i][0] == tag))
            continue
        if tag in CLOSES_P and outer and path[outer[-1]][0] == "p":
            cut(outer[-1])
        if tag in VOID or tag in FOREIGN and m.group(3).rstrip().endswith("/"):
            continue
        if tag == "a":
            in_link = 1
        label = tag
        if m.group(3) and "=" in m.group(3):
            label += "".join(" " + a.group(2).strip("\"'").lower() for a in ATTRIBUTE.finditer(m.group(3)))
        path.append((tag, label))
        opened[tag] += 1
        if tag not in INLINE:
            outer.append(len(path) - 1)
    close()
    return out


def weak_label(path: tuple[str, ...]) -> int:
    """1 inside article or main and no boilerplate ancestor, else 0."""
    good = False
    for step in path:
        tag, *names = _WORD.findall(step)[:1] + _WORD.findall(step)[1:]
        if tag in BAD_TAGS and not (tag == "header" and good) or any(n in BAD_WORDS for n in names):
            return 0
        good = good or tag in GOOD_TAGS
    return int(good)


def _unit(key: str, dim: int) -> np.ndarray:
    """Fixed sparse signed code of a token: three of ``dim`` places."""
    v = np.zeros(dim)
    for salt in range(3):
        h = zlib.crc32(f"{salt}:{key}".encode())
        v[h % dim] += 1.0 if h >> 31 else -1.0
    return v


_paths: dict[tuple[str, ...], np.ndarray] = {}
_codes: dict[str, np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = _paths.get(path)
    if v is None:
        v = np.zeros(PATH_DIM)
        for depth, step in enumerate(reversed(path)):
            names = _WORD.findall(step)
            for i, name in enumerate(names):
                v += _unit(("t:" if i == 0 else "c:") + name, PATH_DIM) * (1.0 if depth else 1.2)
        v = np.clip(v, -3, 3)
        if len(_paths) > 20_000:  # a cache of fixed size
            _paths.clear()
        _paths[path] = v
    return v


def vectors(seq: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """(blocks x INPUT) input of the network."""
    x = np.zeros((len(seq), INPUT), np.float32)
    raw = [b[1].encode("utf-8", "replace") for b in seq]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, first = words(data, off)
    h = word_hashes(data, start, end)
    at = np.repeat(np.arange(len(seq)), np.diff(first)) * WORD_DIM + (h >> U64(33)).astype(np.int64) % WORD_DIM
    code = np.bincount(at, np.where(h >> U64(63), 1.0, -1.0), len(seq) * WORD_DIM).reshape(len(seq), WORD_DIM)
    x[:, PATH_DIM:PATH_DIM + WORD_DIM] = code / np.sqrt(np.maximum(np.diff(first), 1))[:, None]
    for i, (path, text, link) in enumerate(seq):
        x[i, :PATH_DIM] = _path_vector(path)
        x[i, PATH_DIM + WORD_DIM:] = (np.log1p(len(text)) / 4, link, i / len(seq), 1 - i / len(seq),
                                      float(text[-1:] in ".!?"), float("©" in text))
    np.clip(x, -3, 3, out=x)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM with a logistic output per step, in numpy."""

    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"out": g(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": g(INPUT, 4 * HIDDEN), f"wh{d}": g(HIDDEN, 4 * HIDDEN),
                       f"b{d}": np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction over (time, page, input); masked steps leave the state alone."""
        t, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        z0 = (x.reshape(t * n, -1) @ self.p[f"wx{d}"]).reshape(t, n, -1) + self.p[f"b{d}"]
        out, tape = np.zeros((t, n, HIDDEN), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z0[s] + h @ self.p[f"wh{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[s][:, None]
            c2 = m * (f * c + i * u) + (1 - m) * c
            th = np.tanh(c2)
            h2 = m * (o * th) + (1 - m) * h
            if keep:
                tape.append((s, i, f, o, u, c, th, h, m))
            h, c = h2, c2
            out[s] = h
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], 2)
        return _sigmoid((both @ self.p["out"])[..., 0] + self.p["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        err = (_sigmoid((both @ self.p["out"])[..., 0] + self.p["bias"]) - y) * mask / max(mask.sum(), 1)
        g = {"out": both.reshape(-1, 2 * HIDDEN).T @ err.reshape(-1, 1), "bias": err.sum(keepdims=True).reshape(1)}
        dh_all = err[..., None] * self.p["out"][:, 0]
        for k, d in enumerate("fb"):
            wh = self.p[f"wh{d}"]
            gz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for s, i, f, o, u, c, th, h, m in reversed(runs[d][1]):
                dh = dh + dh_all[s][:, k * HIDDEN:(k + 1) * HIDDEN]
                do = dh * th * m
                dcc = dc * m + dh * o * (1 - th * th) * m
                z = np.concatenate([dcc * u * i * (1 - i), dcc * c * f * (1 - f), do * o * (1 - o),
                                    dcc * i * (1 - u * u)], 1)
                gz[s] = z
                gh += h.T @ z
                dh = z @ wh.T + dh * (1 - m)
                dc = dcc * f + dc * (1 - m)
            g |= {f"wx{d}": x.reshape(-1, INPUT).T @ gz.reshape(-1, 4 * HIDDEN), f"wh{d}": gh,
                  f"b{d}": gz.sum((0, 1))}
        return g

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = EPOCHS) -> BlockLabeller:
        """Adam over mini-batches of pages of like length."""
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng = np.random.Generator(np.random.PCG64(9))
        groups = np.array_split(np.array(sorted(range(len(xs)), key=lambda i: len(xs[i])), int), max(1, len(xs) // 24))
        step = 0
        for _ in range(epochs if len(xs) else 0):
            for k in rng.permutation(len(groups)):
                x, mask = pad([xs[i] for i in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(groups[k]):
                    y[:len(ys[i]), j] = ys[i]
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m1[name] = 0.9 * m1[name] + 0.1 * g
                    m2[name] = 0.99 * m2[name] + 0.01 * g * g
                    self.p[name] -= (0.02 * (m1[name] / (1 - 0.9 ** step))
                                     / (np.sqrt(m2[name] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """Boolean label per block of every page, in batches of pages of like length."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        for a in range(0, len(order), _BATCH):
            pick = order[a:a + _BATCH]
            x, mask = pad([vectors(pages[i]) for i in pick])
            p = self.probabilities(x, mask)
            for j, i in enumerate(pick):
                out[i] = p[:len(pages[i]), j] >= 0.5
        return out


def pad(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in xs)
    x = np.zeros((t, len(xs), INPUT), np.float32)
    mask = np.zeros((t, len(xs)), np.float32)
    for j, v in enumerate(xs):
        x[:len(v), j], mask[:len(v), j] = v, 1
    return x, mask


def variants(pages: list[list], seed: int = 2) -> tuple[list[list], list[np.ndarray]]:
    """Labelled block sequences: the pages themselves, and copies with other wrappers and more boilerplate."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pool = [b[1] for p in pages for b in p]
    if not pool:
        return [], []
    short = [" ".join(t.split()[:6]) for t in pool]
    one = lambda seq: seq[int(rng.integers(len(seq)))]

    def boilerplate(inside: tuple[str, ...]) -> tuple[tuple[str, ...], str, float]:
        kind = int(rng.integers(4))
        top = inside if rng.random() < 0.5 else ("html", "body")
        if kind == 0:
            return (*top, one(("nav", "ul", "div menu", "div breadcrumb")), "ul", "li"), one(short), 1.0
        if kind == 1:
            return (*top, one(("aside", "div sidebar", "div related", "footer", "header", "form"))), one(short), float(rng.random())
        name = one(BAD_WORDS)
        step = one((f"div {name}", f"section {name}", f"div {name} box", f"ul {name}", f"p {name}", f"div {name} {name}"))
        return (*top, step, *one(((), ("p",), ("div",), ("ul", "li")))), one(pool if kind == 3 else short), 0.0

    out, labels = list(pages), [np.array([weak_label(b[0]) for b in p], np.float32) for p in pages]
    for p, y in zip(list(out), list(labels), strict=True):
        for _ in range(4):
            wrap = one((("article",), ("main",), ("main", "article"), ("article", "div content"),
                        ("section", "article"), *(("div", f"div {w}") for w in GOOD_WORDS),
                        *((f"div {w}",) for w in GOOD_WORDS)))
            rename = rng.random() < 0.7
            thin = rng.random() < 0.4  # short pages: a few blocks of the text, little around it
            keep = min(1.0, float(rng.integers(1, 8)) / max(y.sum(), 1))
            seq, lab = [], []
            for b, v in zip(p, y, strict=True):
                if thin and rng.random() > (keep if v else 0.3):
                    continue
                path = tuple(s for step in b[0] for s in (wrap if rename and v and step.split()[0] in GOOD_TAGS else (step,)))
                while rng.random() < 0.18:
                    seq.append(boilerplate(path[:-1] if v else ("html", "body")))
                    lab.append(0)
                if v and rng.random() < 0.12:
                    path = (*path[:-1], *one((("blockquote", "p"), ("ul", "li"), ("h2",), ("table", "tr", "td"), ("pre",),
                                              ("figure", "figcaption"), ("section", "p"), ("div",))))
                seq.append((path, b[1], b[2]))
                lab.append(int(v))
            if rng.random() < 0.5:  # a run of reader comments or notices after the text, inside or outside its wrapper
                inner = wrap if rng.random() < 0.5 else ()
                step = one(("section", "div", "ul", "ol")) + " " + one((*BAD_WORDS, *["comments"] * 6, *["comment"] * 3))
                for _ in range(int(rng.integers(1, 5))):
                    seq.append((("html", "body", *inner, step, *one((("p",), ("li",), ("div", "p"), ()))), one(pool), 0.0))
                    lab.append(0)
            while rng.random() < 0.5:
                seq.append(boilerplate(("html", "body")))
                lab.append(0)
            out.append(seq)
            labels.append(np.array(lab, np.float32))
    keep = [i for i, p in enumerate(out) if 0 < len(p) <= 400]
    return [out[i] for i in keep], [labels[i] for i in keep]


def seeded_pages(pages: list[list], n: int, seed: int = 7) -> tuple[list[list], list[np.ndarray]]:
    """Labelled block sequences of ``n`` made-up pages with article, main, content-class and plain wrappers.

    The texts are blocks of ``pages`` (long ones as text, first words as boilerplate) and runs of their words.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    one = lambda seq: seq[int(rng.integers(len(seq)))]
    pool = [b[1] for p in pages for b in p]
    stock = sorted({w.strip(".,;:!?") for t in pool for w in t.split()} - {""}) or ["text"]
    long = [b[1] for p in pages for b in p if b[2] < 0.5 and len(b[1].split()) >= 8]

    def run(least: int, most: int) -> str:
        return " ".join(one(stock) for _ in range(int(rng.integers(least, most))))

    def body() -> str:
        return one(long) if long and rng.random() < 0.6 else ". ".join(run(6, 16).capitalize() for _ in range(int(rng.integers(1, 5)))) + "."

    out, labels = [], []
    for _ in range(n):
        wrap = one((("article",), ("main",), ("main", "article"), ("div main",), ("div",), ("div", "div"),
                    *((f"div {w}",) for w in GOOD_WORDS), *(("div", f"div {w}") for w in GOOD_WORDS)))
        top = ("html", "body", *one(((), ("div",), ("div wrapper",), ("div page", "div"))))
        seq, lab = [], []

        def add(path: tuple[str, ...], text: str, link: float, label: int) -> None:
            seq.append((path, text, link))  # noqa: B023
            lab.append(label)  # noqa: B023

        head, foot = one(("header", "nav", "div header", "div menu", "div navbar")), one(("footer", "div footer", "div disclaimer"))
        for _ in range(int(rng.integers(0, 6))):
            add((*top, head, *one(((), ("ul", "li"), ("div",)))), run(1, 4), float(rng.random() < 0.8), 0)
        if rng.random() < 0.7:
            add((*top, *wrap, one(("h1", "h2"))), run(2, 9), 0.0, 1)
        for _ in range(int(rng.integers(1, 9))):
            inner = one((("p",),) * 8 + (("blockquote", "p"), ("ul", "li"), ("div",), ("section", "p"), ("pre",), ()))
            add((*top, *wrap, *inner), body(), 0.0, 1)
            if rng.random() < 0.15:
                name = one(BAD_WORDS)
                add((*top, *wrap, f"div {name}", *one(((), ("p",)))), run(2, 9) if rng.random() < 0.7 else body(), float(rng.random() < 0.3), 0)
        for _ in range(int(rng.integers(0, 5))):
            side = one(("aside", "div sidebar", "div related", "section comments", "div comment", f"div {one(BAD_WORDS)}"))
            add((*top, side, *one(((), ("p",), ("ul", "li")))), run(2, 9) if rng.random() < 0.6 else body(), float(rng.random() < 0.4), 0)
        for _ in range(int(rng.integers(0, 3))):
            add((*top, foot, *one(((), ("p",), ("div",)))), run(2, 8), float(rng.random() < 0.4), 0)
        out.append(seq)
        labels.append(np.array(lab, np.float32))
    return out, labels


def train(df: DataFrame, html: str = "html", page_id: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> BlockLabeller:
    """Fit on at most ``sample_pages`` pages and their seeded variants."""
    ids = df.select(F.col(page_id).alias("p")).filter("p is not null").distinct().orderBy(F.xxhash64("p"), "p").limit(sample_pages)
    rows = (df.select(F.col(page_id).alias("p"), F.col(html).alias("html")).filter("html is not null")
            .join(F.broadcast(ids), "p")  # at most sample_pages ids
            .groupBy("p").agg(F.min("html").alias("html"))  # one page an id, however often it is repeated
            .select(F.xxhash64("p").alias("h"), "html").mapInArrow(_sample, "h long, path array<array<string>>, text array<string>, link array<double>")
            .collect())
    rows = sorted(rows, key=lambda r: (r.h, r.text))[:sample_pages]
    pages = [[(tuple(p), t, x) for p, t, x in zip(r.path, r.text, r.link, strict=True)] for r in rows]
    # blocks of a page without article or main are not known to be boilerplate
    seqs, labels = variants([p for p in pages if any(weak_label(b[0]) for b in p)])
    if any(pages):
        more, known = seeded_pages(pages, max(SEEDED_PAGES, LEAST_SEQUENCES - len(seqs)))
        seqs, labels = seqs + more, labels + known
    return BlockLabeller().fit([vectors(s) for s in seqs], labels)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seqs = [blocks(x.as_py()) for x in batch.column("html")]
        yield pa.record_batch([batch.column("h"), pa.array([[list(b[0]) for b in s] for s in seqs], pa.list_(pa.list_(pa.string()))),
                               pa.array([[b[1] for b in s] for s in seqs], pa.list_(pa.string())),
                               pa.array([[b[2] for b in s] for s in seqs], pa.list_(pa.float64()))],
                              names=["h", "path", "text", "link"])


def _extract(model: BlockLabeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                pages = [blocks(x.as_py()) for x in part.column("html")]
                rows = [[{"path": "/".join(b[0]), "text": b[1], "main": bool(v)} for b, v in zip(p, lab, strict=True)]
                        for p, lab in zip(pages, model.label(pages), strict=True)]
                yield pa.record_batch([part.column("key"), pa.array(rows, BLOCKS)], names=["key", "blocks"])
    return run


BLOCKS = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("main", pa.bool_())]))


def label_blocks(df: DataFrame, key: Column, html: str = "html", model: BlockLabeller | None = None,
                 page_id: str = "page_id") -> DataFrame:
    """(key, blocks array<struct<path, text, main>>) for every page."""
    model = model or train(df, html, page_id)
    narrow = df.select(key.alias("key"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return narrow.mapInArrow(_extract(model), f"key {dict(narrow.dtypes)['key']}, "
                                              "blocks array<struct<path:string,text:string,main:boolean>>")


def report(df: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    text = "array_join(transform(filter(blocks, b -> b.main), b -> b.text), ' ')"
    return (label_blocks(df, F.struct("page_id", "url")).selectExpr("key.page_id", "key.url", f"{text} as text")
            .withColumn("n_chars", F.length("text").cast("long")))
