"""Main text of web pages: a recurrent labeller reads the leaf blocks of a page in both directions.

A page becomes the sequence of its leaf blocks, each with the path of tags, classes and ids above it. A bidirectional
LSTM in numpy reads embeddings of hashed path tokens and words, and a few measures, and labels every block with
the whole page as context. It is trained here: on a bounded sample of pages, labelled by their semantic tags, and
on layouts of many styles made of those pages' texts, whose labels are known.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

#: The sample that the labeller is trained on: pages, and characters of one page, at most. The fit is bounded by design.
SAMPLE_PAGES, SAMPLE_CHARS = 160, 60_000
LAYOUTS, EPOCHS, BATCH, RATE = 480, 9, 24, 0.012
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, HIDDEN = 1024, 1024, 20, 4, 16
#: Words of a block whose hashes are averaged; all words count in its text and measures.
MEASURES = 8
#: Cells (pages times blocks of the longest) that are labelled together.
CELLS = 1 << 14

# HTML's void elements, elements whose content isn't text, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW, HIDDEN_TAGS = ("script", "style", "iframe"), ("script", "style", "noscript", "template", "svg", "iframe", "object")
BLOCK = frozenset(("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary "
                   "table tbody td textarea tfoot th thead title tr ul").split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|([^<]+|<)", re.S)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: its text, the path above it, and how many of its characters are in links."""

    text: str
    path: tuple[str, ...]
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, without scripts, styles, comments and empty blocks; any markup is accepted."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tag, its path tokens
    parts: list[str] = []
    state = {"linked": 0, "links": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tuple(t for _, names in stack for t in names), min(state["linked"], len(text))))
        parts.clear()
        state["linked"] = 0

    def close(at: int) -> None:
        if any(tag in BLOCK for tag, _ in stack[at:]):
            flush()
        state["links"] -= sum(tag == "a" for tag, _ in stack[at:])
        del stack[at:]

    page, at_char, hidden = page or "", 0, None  # hidden: where in the stack the outermost hidden element is
    while at_char < len(page):
        m = _TOKEN.match(page, at_char)
        at_char = m.end()
        text = m[7]
        if text:
            if hidden is None:
                text = html.unescape(text)
                parts.append(text)
                if state["links"]:
                    state["linked"] += len(text.strip())
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if hidden is not None:
                if at is not None and at >= hidden:
                    del stack[at:]
                    hidden = None if at == hidden else hidden
                    continue
                if at is None:
                    continue
                del stack[hidden:]  # its container ends, and so does a hidden element without an end tag
                hidden = None
            if at is not None:
                close(at)
            elif tag in BLOCK:
                flush()
            continue
        empty = attributes.endswith("/")
        if tag in RAW and not (empty and any(t == "svg" for t, _ in stack)):
            at_char = _RAW_ENDS[tag].search(page, at_char).end()
            continue
        if hidden is not None or tag in HIDDEN_TAGS:
            # A slash closes svg and what is in it; the other hidden elements end by a tag, as in browsers.
            if tag in VOID or empty and (tag == "svg" or hidden is not None):
                continue
            hidden = len(stack) if hidden is None else hidden
            stack.append((tag, ()))
            continue
        if tag in BLOCK:
            flush()
            _close_open(stack, tag, close)
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        names = [tag]
        for found in _NAMES.finditer(attributes):
            names += ["." + p for p in _PARTS.findall((found[1] or found[2] or found[3] or "").lower())]
        stack.append((tag, tuple(names)))
        state["links"] += tag == "a"
    flush()
    return out


def _close_open(stack: list, tag: str, close) -> None:
    """A new block ends an open paragraph, and a new item an open one of its kind, within the same container."""
    ends = ("p",) if tag not in CLOSES_ITSELF else ("p", tag) if tag not in ("td", "th") else ("p", "td", "th")
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in ends:
            close(i)
            return
        if stack[i][0] in BLOCK:
            return


# --- features --------------------------------------------------------------------------------------

@lru_cache(maxsize=1 << 16)
def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % buckets


@dataclass
class Page:
    """Bucket numbers and measures of a page's blocks."""

    path: list[list[int]]
    words: list[list[int]]
    measures: np.ndarray
    main: np.ndarray | None = field(default=None)


def page_of(blocks: list[Block], main: list[bool] | None = None) -> Page:
    measures = np.zeros((len(blocks), MEASURES))
    path, words = [], []
    for i, b in enumerate(blocks):
        own = b.text.split()
        path.append([_bucket(t, PATH_BUCKETS) for t in b.path] or [0])
        words.append([_bucket(w.lower(), WORD_BUCKETS) for w in own])
        size = len(b.text)
        measures[i] = (np.log1p(size) / 5, np.log1p(len(own)) / 4, b.linked / size, b.text[-1] in ".!?…:;\"»”", i / len(blocks),
                       len(b.path) / 10, sum(c.isdigit() for c in b.text[:200]) / min(size, 200), size > 120)
    return Page(path, words, measures, None if main is None else np.array(main, float))


def _sums(table: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    flat = np.fromiter((i for r in rows for i in r), np.int64)
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.add.reduceat(table[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]


class Labeller:
    """A bidirectional LSTM over the blocks of pages, with its own training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        width = PATH_DIM + WORD_DIM + MEASURES

        def normal(*shape, scale=None):
            return r.normal(0, scale or 1 / np.sqrt(shape[0]), shape)

        self.w = {"path": normal(PATH_BUCKETS, PATH_DIM, scale=0.3), "words": normal(WORD_BUCKETS, WORD_DIM, scale=0.1),
                  "out": normal(2 * HIDDEN), "out_b": np.zeros(1)}
        for d in "fb":
            self.w[d + "x"], self.w[d + "h"], self.w[d + "b"] = normal(width, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN)
            self.w[d + "b"][HIDDEN:2 * HIDDEN] = 1

    def _input(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(len(p.path) for p in pages)
        x, mask = np.zeros((longest, len(pages), PATH_DIM + WORD_DIM + MEASURES)), np.zeros((longest, len(pages), 1))
        path = _sums(self.w["path"], [r for p in pages for r in p.path])
        words = _sums(self.w["words"], [r for p in pages for r in p.words])
        every = np.concatenate([path, words, np.concatenate([p.measures for p in pages])], axis=1)
        at = 0
        for k, p in enumerate(pages):
            n = len(p.path)
            x[:n, k], mask[:n, k] = every[at:at + n], 1
            at += n
        return x, mask

    def _read(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states in one direction; what is beyond a page's end stays zero."""
        wx, wh, b = (self.w[d + k] for k in "xhb")
        given = x @ wx + b
        h = c = np.zeros((x.shape[1], HIDDEN))
        out, kept = np.zeros((*x.shape[:2], HIDDEN)), []
        for t in (range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)):
            gates = given[t] + h @ wh
            i, f, o = (1 / (1 + np.exp(-gates[:, k * HIDDEN:(k + 1) * HIDDEN])) for k in (0, 1, 2))
            g = np.tanh(gates[:, 3 * HIDDEN:])
            before = h, c
            c = (f * c + i * g) * mask[t]
            s = np.tanh(c)
            h = o * s * mask[t]
            out[t] = h
            kept.append((t, i, f, o, g, s, *before))
        return out, kept

    def scores(self, pages: list[Page]) -> np.ndarray:
        """Log odds that a block is main text; blocks by pages."""
        x, mask = self._input(pages)
        both = np.concatenate([self._read(x, mask, d)[0] for d in "fb"], axis=2)
        return both @ self.w["out"] + self.w["out_b"]

    def _gradient(self, pages: list[Page]) -> dict[str, np.ndarray]:
        x, mask = self._input(pages)
        states = {d: self._read(x, mask, d) for d in "fb"}
        both = np.concatenate([states[d][0] for d in "fb"], axis=2)
        y = np.zeros(mask.shape[:2])
        for k, p in enumerate(pages):
            y[:len(p.main), k] = p.main
        odds = np.clip(both @ self.w["out"] + self.w["out_b"], -30, 30)
        error = (1 / (1 + np.exp(-odds)) - y) * mask[..., 0] / mask.sum()
        out = {"out": np.einsum("tb,tbh->h", error, both), "out_b": np.array([error.sum()])}
        below, dx = error[..., None] * self.w["out"], np.zeros_like(x)
        for n, d in enumerate("fb"):
            dx += self._back(x, mask, d, below[..., n * HIDDEN:(n + 1) * HIDDEN], states[d][1], out)
        flat = dx.transpose(1, 0, 2)[mask[..., 0].T > 0]  # page after page, as in _input
        for name, rows, at in (("path", [r for p in pages for r in p.path], 0), ("words", [r for p in pages for r in p.words], PATH_DIM)):
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            part = flat[:, at:at + self.w[name].shape[1]] / np.sqrt(size)[:, None]
            out[name] = np.zeros_like(self.w[name])
            np.add.at(out[name], np.fromiter((i for r in rows for i in r), np.int64), np.repeat(part, size, axis=0))
        return out

    def _back(self, x, mask, d: str, above: np.ndarray, kept: list, out: dict) -> np.ndarray:
        wx, wh = self.w[d + "x"], self.w[d + "h"]
        dgates = np.zeros((*x.shape[:2], 4 * HIDDEN))
        dh = dc = np.zeros((x.shape[1], HIDDEN))
        dwh = np.zeros_like(wh)
        for t, i, f, o, g, s, h, c in reversed(kept):
            dh = (dh + above[t]) * mask[t]
            dc = (dc + dh * o * (1 - s * s)) * mask[t]
            dgates[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dwh += h.T @ dgates[t]
            dh, dc = dgates[t] @ wh.T, dc * f
        out[d + "x"], out[d + "h"], out[d + "b"] = np.einsum("tbi,tbg->ig", x, dgates), dwh, dgates.sum((0, 1))
        return dgates @ wx.T

    def train(self, pages: list[Page], epochs: int = EPOCHS, seed: int = 11) -> Labeller:
        """Adam over shuffled batches of pages of like length."""
        r, first, second, step = np.random.default_rng(seed), {}, {}, 0
        pages = sorted((p for p in pages if p.path), key=lambda p: len(p.path))
        batches = [pages[i:i + BATCH] for i in range(0, len(pages), BATCH)]
        for epoch in range(epochs):
            for k in r.permutation(len(batches)):
                step += 1
                for name, g in self._gradient(batches[k]).items():
                    m = first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    v = second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                    rate = RATE * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.w[name] = self.w[name] - rate * m / (np.sqrt(v) + 1e-8)
        return self

    def main_blocks(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Which blocks are main text; pages of like length are read together."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * len(pages[order[stop]]) <= CELLS:
                stop += 1
            own = order[at:stop]
            odds = self.scores([page_of(pages[i]) for i in own])
            for k, i in enumerate(own):
                out[i] = (odds[:len(pages[i]), k] > 0).tolist()
            at = stop
        return out


# --- training pages --------------------------------------------------------------------------------

# Names that pages give to their parts.
NAMES = {
    "content": "content article post entry story main body text copy page news blog".split(),
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc links pagination pager tabs".split(),
    "header": "header masthead top banner brand logo site title tagline hero".split(),
    "footer": "footer bottom copyright legal colophon imprint foot".split(),
    "sidebar": "sidebar aside side rail column widget related recommended popular trending archive tags".split(),
    "notice": "notice cookie cookies consent alert gdpr message warning banner popup modal overlay paywall subscribe newsletter".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense banner commercial".split(),
    "form": "form search login signup subscribe contact newsletter register".split(),
    "comments": "comments comment replies reply discussion respond responses disqus thread feedback reviews".split(),
}
OWN_TAGS = {"menu": ("nav", "menu"), "header": ("header",), "footer": ("footer",), "sidebar": ("aside",), "form": ("form",), "notice": ("div", "aside", "dialog"),
            "ad": ("div", "aside", "ins"), "comments": ("section", "div", "ol", "ul")}
_NEVER = frozenset("nav menu header footer aside form button select option textarea label head title".split())
_OTHERS = frozenset("." + n for part in ("menu", "footer", "sidebar", "ad", "comments", "notice") for n in NAMES[part] if n not in ("title", "top", "column"))


def weak_labels(blocks: list[Block]) -> list[bool]:
    """Main text by semantic tags: under an article or main element and under no part of another kind."""
    out = []
    for b in blocks:
        inner = [i for i, t in enumerate(b.path) if t in ("article", "main")]
        out.append(bool(inner) and not any(t in _NEVER or t in _OTHERS for t in b.path[inner[0]:]))
    return out


class Layouts:
    """Pages of many styles made of given paragraphs, with the label of each block."""

    def __init__(self, paragraphs: list[str], seed: int = 5):
        self.r = np.random.default_rng(seed)
        self.long = [p for p in paragraphs if len(p) >= 60] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."]
        self.vocabulary = [w for p in paragraphs[:400] for w in p.split()][:20_000] or ["lorem", "ipsum", "dolor"]

    def _pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def _some(self, low: int, high: int) -> str:
        return " ".join(self._pick(self.vocabulary) for _ in range(int(self.r.integers(low, high))))

    def _sentence(self) -> str:
        words = self._pick(self.long).split()
        at = int(self.r.integers(max(1, len(words) - 8)))
        return " ".join(words[at:at + int(self.r.integers(4, 24))])

    def _named(self, tag: str, part: str) -> tuple[str, ...]:
        """A path element with names of its part, some with a further word, some with none but its own tag."""
        if tag in OWN_TAGS.get(part, ()) and tag not in ("div", "section", "ol", "ul", "aside") and self.r.random() < 0.4:
            return (tag,)
        names = ["." + self._pick(NAMES[part])]
        if self.r.random() < 0.3:
            names.append("." + self._pick(("box", "wrapper", "container", "inner", "area", "list", "block", "item", "left", "right", "col", "row")))
        return (tag, *names)

    def _tag(self, part: str) -> str:
        return self._pick(OWN_TAGS[part]) if self.r.random() < 0.6 else self._pick(("div", "div", "section", "ul", "td"))

    def _part(self, part: str, above: tuple[str, ...]) -> list[Block]:
        path = (*above, *self._named(self._tag(part), part))
        r, out = self.r, []

        def add(text: str, *tags: str, linked: bool = False) -> None:
            out.append(Block(text, (*path, *tags), len(text) if linked else 0))

        if part in ("menu", "sidebar", "header", "footer") and r.random() < 0.35:
            add(self._some(1, 5), self._pick(("h2", "h3", "h4", "div", "p")))
        if part == "menu" or (part in ("sidebar", "header", "footer") and r.random() < 0.6):
            tags = self._pick((("ul", "li"), ("ul", "li"), ("ol", "li"), ("div",), ("p",)))
            for _ in range(int(r.integers(2, 9))):
                add(self._some(1, 5), *tags, linked=True)
        elif part == "form":
            for tag in self._pick((("label", "button"), ("p", "button"), ("label", "label", "button"), ("h3", "label", "button"), ("label", "option", "option"))):
                add(self._some(1, 6), tag)
        elif part == "comments":
            if r.random() < 0.6:
                add(self._some(1, 4), self._pick(("h2", "h3", "h4")))
            for _ in range(int(r.integers(1, 7))):
                item = self._named(self._pick(("div", "li", "article", "p", "div")), "comments") if r.random() < 0.7 else (self._pick(("div", "li", "p")),)
                if r.random() < 0.5:
                    add(self._some(1, 4), *item, self._pick(("div", "span", "h4", "p")))
                add(self._pick(self.long) if r.random() < 0.5 else self._sentence(), *item, *(("p",) if r.random() < 0.6 else ()))
        else:
            for _ in range(int(r.integers(1, 3))):
                add(self._sentence() if r.random() < 0.75 else self._pick(self.long), *(self._pick((("p",), ("p",), (), ("span",), ("div",)))))
            if part == "notice" and r.random() < 0.6:
                add(self._some(1, 3), "button")
        return out

    def page(self) -> tuple[list[Block], list[bool]]:
        r = self.r
        blocks: list[Block] = []
        main: list[bool] = []
        above = ("html", "body")
        for _ in range(int(r.integers(0, 3))):
            above = (*above, "div", *(("." + self._pick(("wrapper", "container", "page", "site", "outer", "layout", "grid", "app", "root")),) if r.random() < 0.8 else ()))

        def put(found: list[Block], label: bool) -> None:
            blocks.extend(found)
            main.extend([label] * len(found))

        if r.random() < 0.7:
            put([Block(self._some(2, 12), ("html", "head", "title"), 0)], False)
        for part in ("header", "menu", "notice", "ad", "form", "sidebar"):
            if r.random() < (0.6 if part in ("header", "menu") else 0.25 if part != "ad" else 0.4):
                put(self._part(part, above), False)
        kind = r.random()
        inner = above
        if kind < 0.6:
            inner = (*inner, *(("main",) if r.random() < 0.3 else ()), "article", *(("." + self._pick(NAMES["content"]),) if r.random() < 0.4 else ()))
        elif kind < 0.7:
            inner = (*inner, *self._named("main", "content"))
        elif kind < 0.95:
            inner = (*inner, *self._named(self._pick(("div", "div", "section", "td")), "content"), *(self._named("div", "content") if r.random() < 0.4 else ()))
        if r.random() < 0.85:
            put([Block(self._some(2, 12) if r.random() < 0.7 else self._sentence(), (*inner, "h1"), 0)], True)
        n = int(r.integers(1, 14))
        for k in range(n):
            kind = r.random()
            if kind < 0.78:
                text = self._pick(self.long) if r.random() < 0.8 else self._sentence() if r.random() < 0.6 else self._some(1, 4)
                put([Block(text, (*inner, "p", *(("b",) if r.random() < 0.1 else ())), 0)], True)
            elif kind < 0.86:
                put([Block(self._some(1, 8), (*inner, self._pick(("h2", "h3"))), 0)], True)
            elif kind < 0.95:
                tags = self._pick((("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("blockquote",), ("table", "tr", "td"), ("pre",), ("figure", "figcaption"), ("div",)))
                put([Block(self._sentence(), (*inner, *tags), 0) for _ in range(int(r.integers(1, 4)))], True)
            elif k:
                put(self._part(self._pick(("ad", "sidebar", "notice", "form")), inner), False)
        if r.random() < 0.3:
            put(self._part("comments", inner if r.random() < 0.3 else above), False)
        for part in ("ad", "sidebar", "form", "menu", "footer"):
            if r.random() < (0.8 if part == "footer" else 0.2):
                put(self._part(part, above), False)
        return blocks, main


def fit(pages: DataFrame, html_column: str = "html", id_column: str = "page_id") -> Labeller:
    """Trains on a bounded sample: the first ``SAMPLE_PAGES`` pages by hash of their ids and markup."""
    markup = F.col(html_column).cast("string")
    sample = (pages.where(F.length(markup) <= SAMPLE_CHARS).select(F.xxhash64(F.col(id_column).cast("string"), markup).alias("o"), markup.alias("html"))
              .orderBy("o").limit(SAMPLE_PAGES).collect())
    seen = [blocks_of(r.html) for r in sample]
    layouts = Layouts([b.text for page in seen for b in page])
    made = [layouts.page() for _ in range(LAYOUTS)]
    labelled = [(p, weak_labels(p)) for p in seen]
    return Labeller().train([page_of(p, y) for p, y in [*made, *(x for x in labelled if any(x[1]))]])


def extracted(pages: DataFrame, html_column: str = "html", id_column: str = "page_id", labeller: Labeller | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_blocks.

    The text is that of all blocks labelled as main, character references decoded, white space inside a block as one
    space, joined by one space; empty if there is none. Null markup counts as empty. Any text parses as markup, however
    broken; a very long page is read whole. Repeated rows and null ids each give a row; other columns aren't read.
    An empty table gives no rows.
    """
    spark = prepare(pages.sparkSession)
    sent = spark.sparkContext.broadcast(pickle.dumps((labeller or fit(pages, html_column, id_column)).w))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.w = pickle.loads(sent.value)
        for batch in batches:
            read = [blocks_of(p) for p in batch.column(2).to_pylist()]
            texts = [" ".join(b.text for b, m in zip(blocks, main) if m) for blocks, main in zip(read, own.main_blocks(read))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, read), pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks"])

    chosen = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint")
