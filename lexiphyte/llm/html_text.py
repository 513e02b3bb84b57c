"""Main text of web pages: a bidirectional LSTM in numpy labels every text block with the whole page as context."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.llm.common import buffers, shared_dir, slices, words

TAGS, WORDS, TAG_DIM, WORD_DIM, HIDDEN = 1024, 1024, 16, 8, 24
#: Least chance of a block to be kept: boilerplate scores far below, and a lost paragraph costs more than a kept line.
KEEP = 0.15
#: Pages that the labeller is trained on and passes over them.
TRAIN_PAGES, EPOCHS = 1_600, 10

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
#: Elements whose content is raw: no markup is read in it and none of it is text of the page.
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
#: Controls, whose labels are no text of the page where their end tag closes them; one inside another ends that first.
_CONTROL = frozenset(("button", "select"))
#: Formulas stand in the line; these and pictures may be empty elements, as of all markup only XML's may.
_MATH = frozenset("math annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | _MATH
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul dd dt".split())


@dataclass
class Block:
    text: str
    path: str  # open elements, outermost first, each as tag and names of its class, id and role
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: runs of text between the edges of block elements, decoded and trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links: list[str] = []
    before: list[int] = []  # for each open control, outermost first, the number of blocks before it
    in_link = 0
    at, size, path = 0, len(page), ""

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = "".join(parts)
            text = _SPACE.sub(" ", entities.unescape(text) if "&" in text else text).strip()
            if text:
                out.append(Block(text, path, min(len(text), sum(map(len, links)))))
            parts, links = [], []

    def take(a: int, b: int) -> None:
        nonlocal path
        if a < b:
            piece = page[a:b]
            if not parts:
                if piece.isspace():
                    return
                path = " ".join(x for _, x in stack)
            parts.append(piece)
            if in_link:
                links.append(piece)

    def cut(k: int) -> None:
        """Close the open elements from the k-th on."""
        n = sum(t in _CONTROL for t, _ in stack[k:])
        if n:
            del before[-n:]
        del stack[k:]

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            take(at, size)
            break
        take(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        elif tag == "br" and parts:
            parts.append(" ")
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _CONTROL:
                        del out[before[sum(t in _CONTROL for t, _ in stack[:k])] :]
                    cut(k)
                    break
            if tag == "a":
                in_link = 0
            continue
        attrs = m[3] or m[6] or ""
        empty = attrs.rstrip().endswith("/")
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style") and not empty:
                at = size  # the rest is code
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == tag == "li":
                    cut(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
            in_link = 0
        if tag in _CONTROL:
            for k, (t, _) in enumerate(stack):
                if t in _CONTROL:
                    cut(k)
                    break
            if not empty:
                before.append(len(out))
        if not empty or tag in _INLINE and tag not in _MATH or tag in _CLOSES_P:
            names = [tag]
            if attrs:
                names += [f"{a.lower()[0]}={p}" for a, v in _ATTR.findall(attrs) for p in _PART.findall(v.lower())[:8]]
            stack.append((tag, " ".join(names)))
            if tag == "a":
                in_link = 1
    flush()
    return out


@dataclass
class Features:
    """Blocks of pages: hashed path tokens and words, with row ends, and a few numbers of each block."""

    tag: np.ndarray
    tag_end: np.ndarray
    word: np.ndarray
    word_end: np.ndarray
    number: np.ndarray
    page_end: np.ndarray


_paths: dict[str, list[int]] = {}


def _path_ids(path: str) -> list[int]:
    found = _paths.get(path)
    if found is None:
        if len(_paths) > 50_000:
            _paths.clear()
        tokens = path.split()
        # Tokens count by name, and the innermost ones also as such.
        found = _paths[path] = sorted({zlib.crc32(t.encode()) % TAGS for t in tokens} | {zlib.crc32(f"in {t}".encode()) % TAGS for t in tokens[-2:]}) or [0]
    return found


def features(pages: list[list[Block]]) -> Features:
    every = [b for p in pages for b in p]
    ids = [_path_ids(b.path) for b in every]
    tag_end = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    tag = np.fromiter((t for x in ids for t in x), np.int64, int(tag_end[-1]))
    h, word_end = words(*buffers(pa.array([b.text for b in every], pa.large_string())), "alnum")
    size = np.array([len(b.text) for b in every], np.float64)
    page_end = np.concatenate(([0], np.cumsum([len(p) for p in pages]))).astype(np.int64)
    per = np.diff(page_end)
    place = (np.arange(len(every)) - np.repeat(page_end[:-1], per) + 0.5) / np.maximum(np.repeat(per, per), 1)
    number = np.stack(
        [
            np.log1p(size) / 4,
            np.array([b.linked for b in every]) / np.maximum(size, 1),
            np.array([b.text[-1] in ".!?…\"'”»" for b in every], np.float64) if every else np.zeros(0),
            np.array([min(1.0, sum(b.text.count(c) for c in ".,;") / 8) for b in every]) if every else np.zeros(0),
            place,
            np.ones(len(every)),
        ],
        1,
    )
    return Features(tag, tag_end, (h & np.uint64(WORDS - 1)).astype(np.int64), word_end, number.astype(np.float32), page_end)


def _means(table: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = np.diff(ends)
    out = np.zeros((len(n), table.shape[1]), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(table[ids], ends[full], axis=0) / n[full, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BlockLabeller:
    """Path and word vectors and block numbers, read by an LSTM in each direction, then one logit a block."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> BlockLabeller:
        r = np.random.default_rng(seed)
        n_in = TAG_DIM + WORD_DIM + 6
        f = lambda *s, k=0.1: r.normal(0, k, s).astype(np.float32)
        self.p = {"tag": f(TAGS, TAG_DIM), "word": f(WORDS, WORD_DIM)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p |= {f"x{d}": f(n_in, 4 * HIDDEN, k=0.2), f"h{d}": f(HIDDEN, 4 * HIDDEN, k=0.2), f"b{d}": bias, f"o{d}": f(HIDDEN)}
        self.p |= {"ox": f(n_in), "o0": np.zeros(1, np.float32)}
        return self

    def _inputs(self, x: Features) -> np.ndarray:
        return np.concatenate((_means(self.p["tag"], x.tag, x.tag_end), _means(self.p["word"], x.word, x.word_end), x.number), 1)

    def _run(self, d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, row, unit) of one direction over inputs (time, row, feature)."""
        wh, n = self.p[f"h{d}"], HIDDEN
        z_all = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape[:2], n), np.float32)
        for t in range(len(x)):
            z = z_all[t] + h @ wh
            gate = _sigmoid(z[:, : 3 * n])
            i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            before = c
            c = f * before + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out

    def _back(self, d: str, x: np.ndarray, keep: list, d_out: np.ndarray, grad: dict) -> np.ndarray:
        wx, wh, n = self.p[f"x{d}"], self.p[f"h{d}"], HIDDEN
        d_h, d_c = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
        d_z = np.empty((*x.shape[:2], 4 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, o, g, tc = keep[t]
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z[t] = np.concatenate((d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)), 1)
            grad[f"h{d}"] += h.T @ d_z[t]
            d_h = d_z[t] @ wh.T
            d_c = d_c * f
        grad[f"x{d}"] += np.tensordot(x, d_z, ((0, 1), (0, 1)))
        grad[f"b{d}"] += d_z.sum((0, 1))
        return d_z @ wx.T

    @staticmethod
    def _grid(x: Features, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block of each (time, page), the same read backwards, and which are real."""
        n = np.diff(x.page_end)[own]
        t = np.arange(int(n.max(initial=0)))[:, None]
        real = t < n[None, :]
        first = x.page_end[own][None, :]
        return np.where(real, first + t, 0), np.where(real, first + n[None, :] - 1 - t, 0), real

    def probabilities(self, x: Features, together: int = 128) -> np.ndarray:
        """The chance of every block to be main text; pages of like length are read together."""
        inputs = self._inputs(x)
        logit = inputs @ self.p["ox"] + self.p["o0"]
        order = np.argsort(np.diff(x.page_end), kind="stable")
        for at in range(0, len(order), together):
            fore, back, real = self._grid(x, order[at : at + together])
            for d, grid in (("f", fore), ("b", back)):
                if len(grid):
                    s = self._run(d, inputs[grid], None) @ self.p[f"o{d}"]
                    logit[grid[real]] += s[real]
        return _sigmoid(logit)

    def fit(self, x: Features, y: np.ndarray, seed: int = 5) -> BlockLabeller:
        self.start(seed)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, pages = 0, len(x.page_end) - 1
        for epoch in range(EPOCHS):
            order = rng.permutation(pages)
            for at in range(0, pages, 32):
                fore, back, real = self._grid(x, order[at : at + 32])
                if not real.any():
                    continue
                used = np.unique(fore[real])
                sub = _rows(x, used)
                inputs = self._inputs(sub)
                fore, back = np.searchsorted(used, fore), np.searchsorted(used, back)
                fore, back = np.where(real, fore, 0), np.where(real, back, 0)
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                keeps: dict[str, list] = {"f": [], "b": []}
                logit = inputs @ self.p["ox"] + self.p["o0"]
                states = {}
                for d, grid in (("f", fore), ("b", back)):
                    states[d] = self._run(d, inputs[grid], keeps[d])
                    logit[grid[real]] += (states[d] @ self.p[f"o{d}"])[real]
                e = (_sigmoid(logit) - y[used]).astype(np.float32) / len(used)
                grad["ox"], grad["o0"] = inputs.T @ e, e.sum(keepdims=True)
                d_in = np.outer(e, self.p["ox"])
                for d, grid in (("f", fore), ("b", back)):
                    d_logit = np.where(real, e[grid], 0).astype(np.float32)
                    grad[f"o{d}"] = np.tensordot(states[d], d_logit, ((0, 1), (0, 1)))
                    back_in = self._back(d, inputs[grid], keeps[d], d_logit[:, :, None] * self.p[f"o{d}"], grad)
                    np.add.at(d_in, grid[real], back_in[real])
                for name, ids, ends, cols in (("tag", sub.tag, sub.tag_end, slice(0, TAG_DIM)), ("word", sub.word, sub.word_end, slice(TAG_DIM, TAG_DIM + WORD_DIM))):
                    n = np.diff(ends)
                    flow = np.repeat(d_in[:, cols] / np.maximum(n, 1)[:, None], n, 0)
                    grad[name] = np.stack([np.bincount(ids, flow[:, j], len(self.p[name])) for j in range(flow.shape[1])], 1).astype(np.float32)
                step += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 0.001
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _rows(x: Features, own: np.ndarray) -> Features:
    def part(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = ends[own + 1] - ends[own]
        take = np.arange(n.sum()) + np.repeat(ends[own] - np.cumsum(n) + n, n)
        return ids[take], np.concatenate(([0], np.cumsum(n)))

    return Features(*part(x.tag, x.tag_end), *part(x.word, x.word_end), x.number[own], np.array([0, len(own)]))


# Training pages: layouts drawn at random from the ways in which sites mark up their parts.
_MAIN = ["<article{}>", "<main{}>", '<div class="content"{}>', '<div id="content"{}>', '<div class="post-body"{}>', '<div class="entry-content"{}>', '<div id="main" class="story"{}>', '<section class="article-body"{}>', '<div role="main"{}>']
_OTHER = {
    "menu": ["<nav>", '<div class="menu">', '<ul id="nav" class="navigation">', '<div role="navigation">', '<div class="breadcrumb">', '<nav class="topnav">', '<div class="tabs">'],
    "header": ["<header>", '<div class="header">', '<div id="masthead">', '<div class="topbar">', '<div role="banner">', '<header class="site-header">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<div role="contentinfo">', '<footer class="site-footer">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<div class="widget">', '<section class="recommended">', '<div class="rail popular">', '<div role="complementary">'],
    "notice": ['<div class="cookie-notice">', '<div id="consent">', '<div class="banner alert">', '<div class="notice">', '<div class="popup modal">', '<div class="disclaimer">', '<p class="notice">', '<div class="newsletter subscribe">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="ad-1">', '<div class="sponsored promo">', '<aside class="ad">', '<section class="advertisement">', '<div class="banner-ad">', '<p class="ad">'],
    "form": ["<form>", '<form class="search">', '<form id="login">', '<div class="search-form">', '<fieldset>'],
    "comments": ['<div class="comments">', '<section id="comments">', '<ol class="commentlist">', '<div class="comment">', '<div id="disqus">', '<section class="replies responses">', '<ul class="comments">', '<div class="reader-comments">'],
    "share": ['<div class="share">', '<div class="social">', '<div class="tags">', '<p class="byline meta">', '<ul class="pagination">', '<div class="author-bio">'],
}


def _closing(opening: str) -> str:
    return f"</{re.match(r'<([a-z]+)', opening)[1]}>"


def training_pages(count: int = TRAIN_PAGES, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages of random layout in invented words, with whether each block is main text."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    syllables = ["".join(pick("bcdfghklmnprstvwz") + pick("aeiouéäñ") + pick(["", "n", "r", "st"])) for _ in range(150)]
    page_words = "home about contact login search news cookies privacy subscribe share reply advertisement copyright rights terms related".split()

    def word() -> str:
        return "".join(pick(syllables) for _ in range(int(r.integers(1, 4))))

    def sentence(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def prose(long: bool) -> str:
        return " ".join(sentence(int(r.integers(1, 14))) for _ in range(int(r.integers(1, pick([4, 7, 7, 40]) if long else 3))))

    def other(kind: str, out: list[bool]) -> str:
        opening = pick(_OTHER[kind])
        body = []
        style = int(r.integers(4))
        if style == 0 or kind == "menu" and style < 3:
            items = int(r.integers(2, 8))
            for _ in range(items):
                text = pick([word(), pick(page_words), sentence(3)])
                body.append(f'<li><a href="/{word()}">{text}</a></li>')
            out += [False] * items
            body = ["<ul>", *body, "</ul>"]
        elif style == 1:
            body.append(prose(kind == "comments"))
            out.append(False)
        else:
            for _ in range(int(r.integers(1, 6 if kind in ("comments", "side") else 3))):
                text = prose(kind in ("comments", "side", "notice")) if r.random() < 0.7 else f"{pick(page_words)} {word()}"
                if kind == "form":
                    text = f"<label>{text}</label><input type=text>"
                body.append(pick(["<p>{}</p>", "<div>{}</div>", "<p>{}</p>", "<h3>{}</h3>"]).format(text))
                out.append(False)
        return f"{opening}{''.join(body)}{_closing(opening)}"

    def main(out: list[bool]) -> str:
        opening = pick(_MAIN)
        body = []
        if r.random() < 0.7:
            body.append(f"<h1>{sentence(6)}</h1>")
            out.append(True)
        for _ in range(int(r.integers(1, 14))):
            x = r.random()
            if x < 0.76:
                text = prose(True) if r.random() < 0.68 else sentence(int(r.integers(1, 3)))
                if r.random() < 0.15:
                    text = f"<b>{text}<br>"
                body.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
                out.append(True)
            elif x < 0.84:
                body.append(f"<h2>{sentence(4)}</h2>")
                out.append(True)
            elif x < 0.9:
                k = int(r.integers(2, 5))
                body.append("<ul>" + "".join(f"<li>{sentence(5)}</li>" for _ in range(k)) + "</ul>")
                out += [True] * k
            elif x < 0.94:
                body.append(f"<blockquote>{prose(False)}</blockquote>")
                out.append(True)
            else:
                body.append(other(pick(["advert", "share", "side", "notice"]), out))
        return f"{opening.format(pick(['', '', ' lang=en']))}{''.join(body)}{_closing(opening)}"

    pages = []
    for _ in range(count):
        out: list[bool] = []
        before = [k for k in ("header", "menu", "notice", "advert", "form") if r.random() < 0.5]
        after = [k for k in ("share", "side", "comments", "advert", "form", "notice", "menu", "footer") if r.random() < 0.45]
        r.shuffle(before)
        body = [other(k, out) for k in before]
        wrap = r.random() < 0.3
        body.append(("<div class=wrapper>" if wrap else "") + main(out))
        body += [other(k, out) for k in after]
        body.append("</div>" if wrap else "")
        pages.append((f"<!DOCTYPE html><html><head><title>{sentence(5)}</title><script>var a='<p>';</script></head><body>{''.join(body)}</body></html>", out))
    return pages


def train(count: int = TRAIN_PAGES, seed: int = 11) -> BlockLabeller:
    parsed, labels = [], []
    for page, y in training_pages(count, seed):
        found = blocks(page)
        if len(found) == len(y):  # all but pages where invented markup ran two blocks together
            parsed.append(found)
            labels += y
    return BlockLabeller().fit(features(parsed), np.array(labels, np.float32))


def _extract(model, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                parsed = [blocks(x or "") for x in part.column("html").to_pylist()]
                x = features(parsed)
                good = model.value.probabilities(x) >= KEEP
                texts = ["\n\n".join(b.text for b, g in zip(p, good[a:], strict=False) if g) for p, a in zip(parsed, x.page_end[:-1], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, model: BlockLabeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every whole page.

    A page is cut to text blocks at the edges of block elements. Scripts, styles, forms' controls and comments of the
    markup hold no text; an end tag that is missing costs no text but of scripts and styles. Each block is a vector of its path of tags, classes and ids, of its hashed words and of a few
    numbers (length, share of links, punctuation, place); an LSTM reads the sequence in both directions, and blocks
    labelled as main text are joined by two line ends. The model is trained in numpy on TRAIN_PAGES pages that
    ``training_pages`` draws, as no labelled pages come with the data.

    A null or empty page gives an empty text; repeated rows are handled one by one; an empty table gives no rows;
    further columns are ignored.
    """
    spark = pages.sparkSession
    shared_dir(spark)
    held = spark.sparkContext.broadcast(model or train())  # under 1 MB, fixed by the dimensions above
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in ("page_id", "url"))
    return source.mapInArrow(_extract(held, ["page_id", "url"]), f"{kinds}, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLE_SQL: dict[str, str] = {}
