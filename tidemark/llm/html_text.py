"""HTML extraction with a recurrent block labeller: a bidirectional LSTM in numpy reads a page's leaf blocks in order.

Each block is seen as a hashed vector of its tag path (with class and id words), a hashed vector of its words, and a few
shares (length, links, marks). The labeller classifies every block with the whole page as context. It is trained here, on
a bounded sample of pages whose own semantic tags tell what is the article, and on variants of these pages with other
tags, in which the same text stands in other page furniture.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import ALNUM, byte_slices, words_of

#: Pages that the labeller is fitted on, about (hashed choice; all with fewer), and variants made of each.
SAMPLE_PAGES, VARIANTS = 300, 3
#: Pages of more blocks aren't used for fitting (extraction takes any).
TRAIN_BLOCKS = 120
PATH_DIMS, WORD_DIMS, SHARES = 64, 32, 5
DIMS = PATH_DIMS + WORD_DIMS + SHARES
HIDDEN, STEPS, RATE, BATCH = 16, 300, 0.02, 48

# Fixed values of HTML.
#: Elements whose content isn't markup (or isn't shown), up to their end tag; those of code take the rest of the page if none follows.
RAW, CODE = frozenset("script style textarea title template iframe".split()), frozenset(("script", "style"))
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of these, up to the nearest of the second.
IMPLIED = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), (("p",), ("td", "th", "button", "caption"))),
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
#: What page furniture calls itself, in tags and in class, id and role words.
FURNITURE = frozenset(
    "nav header footer aside form button menu sidebar banner ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice notices"
    " popup modal newsletter subscribe breadcrumb breadcrumbs share social related comment comments reply respond disqus widget toolbar pagination navigation contentinfo complementary search login copyright".split()
)
ARTICLE = frozenset(("article", "main"))

# A quote opens a string only after an equals sign, and only if another ends it. Possessive, so in linear time.
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?|<[!?][^>]*+>?", re.S
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+[0-9]*")


@functools.lru_cache(maxsize=1 << 16)
def _place(word: str) -> tuple[int, float]:
    """Dimension and sign of a word of a path."""
    h = zlib.crc32(word.strip("<>").encode())
    return h % PATH_DIMS, 1.0 - 2.0 * (h >> 31)


class Path:
    """The tags, and class, id and role words, from the page's root to an element, as a link to the parent's path: an element
    costs its own words only, however deep it stands."""

    __slots__ = ("depth", "own", "up", "vector")

    def __init__(self, up: Path | None, own: tuple[str, ...]):
        self.up, self.own = up, own
        self.depth = len(own) + (up.depth if up else 0)
        self.vector = up.vector.copy() if up else np.zeros(PATH_DIMS, np.float32)
        for word in own:
            at, sign = _place(word)
            self.vector[at] += sign

    def words(self) -> tuple[str, ...]:
        parts, at = [], self
        while at is not None:
            parts.append(at.own)
            at = at.up
        return tuple(w for own in reversed(parts) for w in own)


def path_of(words: tuple[str, ...]) -> Path:
    return Path(None, words)


_ROOT = path_of(())


class Block:
    __slots__ = ("linked", "parts", "path")

    def __init__(self, path: Path):
        self.path, self.parts, self.linked = path, [], 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


class Reader:
    """The leaf blocks of one page, read once from its start to its end. Open elements stand on a stack, with the places of
    each tag and of block elements beside it, so that no tag or text looks through the stack."""

    def __init__(self, page: str):
        self.page, self.done, self.now, self.links = page, [], None, 0
        self.stack: list[tuple[str, Path]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.never: set[str] = set()  # raw tags of which no end tag follows

    def top(self, tags: tuple[str, ...]) -> int:
        """The innermost open element of these tags, or -1."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def close(self, to: int) -> None:
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            self.links -= tag == "a"
            if tag in BLOCK:
                self.blocks.pop()
                self.now = None

    def add(self, text: str) -> None:
        if not text:
            return
        if (head := self.top(("head",))) >= 0:
            if text.isspace():
                return
            self.close(head)  # text ends the head
        if self.now is None:
            self.now = Block(self.stack[-1][1] if self.stack else _ROOT)
            self.done.append(self.now)
        self.now.parts.append(text)
        self.now.linked += len(text) * (self.links > 0)

    def end_tag(self, tag: str) -> None:
        at = self.top((tag,))
        # Inline elements don't end across blocks.
        if at >= 0 and (tag in BLOCK or at > (self.blocks[-1] if self.blocks else -1)):
            self.close(at)
        if tag in BLOCK:
            self.now = None

    def raw(self, tag: str, at: int) -> int:
        """Where the page goes on after a raw element's start tag that ends at `at`."""
        found = None if tag in self.never else re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(self.page, at)
        if found is None:
            self.never.add(tag)
            return len(self.page) if tag in CODE else at
        shut = self.page.find(">", found.end())
        return len(self.page) if shut < 0 else shut + 1

    def start_tag(self, tag: str, rest: str) -> None:
        if tag not in HEAD and (head := self.top(("head",))) >= 0:
            self.close(head)
        if tag in IMPLIED:
            shut, bound = IMPLIED[tag]
            if (at := self.top(shut)) > self.top(bound):
                self.close(at)
        if tag in BLOCK:
            self.now = None
        if tag == "br":
            self.add(" ")
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            return
        names = " ".join(x for g in _NAMES.findall(rest) for x in g) if "=" in rest else ""
        up = self.stack[-1][1] if self.stack else None
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, Path(up, (f"<{tag}>", *_WORD.findall(names.lower())))))
        self.links += tag == "a"

    def read(self) -> list[Block]:
        at = 0
        while m := _MARKUP.search(self.page, at):
            self.add(self.page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.end_tag(tag)
            elif tag in RAW and not (m[3].endswith("/") and self.top(tuple(FOREIGN)) >= 0):
                at = self.raw(tag, at)
            else:
                self.start_tag(tag, m[3])
        self.add(self.page[at:])
        return self.done


def blocks_of(page: str | None) -> list[tuple[Path, str, float]]:
    """(path; text; share of it in links) of a page's blocks that aren't empty, in order, in time linear in the page.

    Scripts, styles, raw form fields and comments are passed over. Elements that are left open, unclosed markup and stray
    end tags are dealt with as browsers do in the common cases.
    """
    out = []
    for b in Reader(page or "").read():
        if t := b.text():
            out.append((b.path, t, min(1.0, b.linked / max(1, sum(map(len, b.parts))))))
    return out


def by_tags(path: tuple[str, ...]) -> int:
    """The label that semantic tags give a block: 1 in an article or main part and in no furniture, else 0."""
    names = [w.strip("<>") for w in path]
    top = max((i for i, w in enumerate(names) if path[i] in ("<article>", "<main>")), default=-1)
    return int(top >= 0 and not FURNITURE.intersection(names[top + 1 :]) and not FURNITURE.intersection(w for w in names[:top] if w != "form"))


def features(blocks: list[tuple[Path, str, float]]) -> np.ndarray:
    """(blocks, DIMS)."""
    n = len(blocks)
    out = np.zeros((n, DIMS), np.float32)
    if not n:
        return out
    scaled = lambda h: h / np.maximum(1, np.sqrt((h * h).sum(1, keepdims=True))) * 2
    out[:, :PATH_DIMS] = scaled(np.stack([b[0].vector for b in blocks]))
    for row, to, data, offsets in byte_slices(pa.array([b[1] for b in blocks], pa.string())):
        w = words_of(data, offsets, ALNUM)
        text = np.repeat(np.arange(to - row), np.diff(w.first))
        bucket = (w.hash % np.uint64(WORD_DIMS)).astype(np.int64)
        sign = 1.0 - 2.0 * ((w.hash >> np.uint64(60)) & np.uint64(1)).astype(np.float64)
        h = np.bincount(text * WORD_DIMS + bucket, sign, (to - row) * WORD_DIMS).reshape(-1, WORD_DIMS)
        out[row:to, PATH_DIMS : PATH_DIMS + WORD_DIMS] = scaled(h)
    size = np.array([len(b[1]) for b in blocks], float)
    words = np.array([b[1].count(" ") + 1 for b in blocks], float)
    marks = np.array([sum(map(b[1].count, ".,;!?")) for b in blocks], float)
    depth = np.array([min(40, b[0].depth) for b in blocks], float)
    out[:, -SHARES:] = np.stack([np.log1p(size) / 5 - 0.7, np.log1p(words) / 3 - 0.7, marks / words, [b[2] for b in blocks], depth / 10], 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM and a logistic output on both hidden states. Parameters: one matrix a direction and the output."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 0.15, (DIMS + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        for w in self.w:
            w[-1, :HIDDEN] = 1  # remembers at first
        self.out = np.zeros(2 * HIDDEN + 1, np.float32)

    def _scan(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, order: list[int], keep: list | None) -> np.ndarray:
        """x (pages, blocks, DIMS) -> hidden states (pages, blocks, HIDDEN), in the given order."""
        n = len(x)
        h = c = np.zeros((n, HIDDEN), np.float32)
        states = np.zeros((n, x.shape[1], HIDDEN), np.float32)
        given = x @ w[:DIMS] + w[-1]
        for t in order:
            z = given[:, t] + h @ w[DIMS:-1]
            f, i, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * g
            s = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, f, i, o, g, s, m))
            c = np.where(m, new, c)
            h = np.where(m, o * s, h)
            states[:, t] = h
        return states

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        order = list(range(x.shape[1]))
        kept: tuple[list | None, list | None] = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._scan(x, mask, self.w[0], order, kept[0]), self._scan(x, mask, self.w[1], order[::-1], kept[1])], 2)
        if keep is not None:
            keep += kept
        return _sigmoid(both @ self.out[:-1] + self.out[-1]), both

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        keep: list = []
        p, both = self.forward(x, mask, keep)
        n = mask.sum()
        loss = float(-(np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / n)
        d = (p - y) * mask / n
        g_out = np.append((d[:, :, None] * both).sum((0, 1)), d.sum())
        grads = []
        for k in range(2):
            w, gw = self.w[k], np.zeros_like(self.w[k])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            given = d[:, :, None] * self.out[k * HIDDEN : (k + 1) * HIDDEN]
            for t, h0, c0, f, i, o, g, s, m in reversed(keep[k]):
                dh = dh + given[:, t]
                own, dnew = np.where(m, dh, 0), np.where(m, dc, 0)
                dnew = dnew + own * o * (1 - s * s)
                dz = np.concatenate([dnew * c0 * f * (1 - f), dnew * g * i * (1 - i), own * s * o * (1 - o), dnew * i * (1 - g * g)], 1)
                gw[:DIMS] += x[:, t].T @ dz
                gw[DIMS:-1] += h0.T @ dz
                gw[-1] += dz.sum(0)
                dh = np.where(m, 0, dh) + dz @ w[DIMS:-1].T
                dc = np.where(m, dnew * f, dc)
            grads.append(gw)
        return loss, [*grads, g_out]

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 2) -> float:
        rng = np.random.default_rng(seed)
        params = [*self.w, self.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        loss = 0.0
        for step in range(1, steps + 1):
            some = [pages[i] for i in rng.integers(0, len(pages), min(BATCH, len(pages)))]
            x, mask = padded([f for f, _ in some])
            y = np.zeros(mask.shape, np.float32)
            for r, (_, label) in enumerate(some):
                y[r, : len(label)] = label
            loss, grads = self.gradients(x, mask, y)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * min(1.0, 2 - 2 * step / steps) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return loss

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of each block to be main text. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            longest = len(pages[order[min(at + 127, len(order) - 1)]])
            some = order[at : at + max(1, min(128, 20_000 // longest))]
            x, mask = padded([pages[i] for i in some])
            p, _ = self.forward(x, mask)
            for r, i in enumerate(some):
                out[i] = p[r, : len(pages[i])]
            at += len(some)
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((len(pages), longest, DIMS), np.float32), np.zeros((len(pages), longest), bool)
    for r, f in enumerate(pages):
        x[r, : len(f)], mask[r, : len(f)] = f, True
    return x, mask


def variant(blocks: list[tuple[Path, str, float]], labels: list[int], rng: np.random.Generator) -> tuple[list, list[int]]:
    """The same texts in another page: other wrappers of the main part, and other furniture around and inside it."""
    main = [(b, path.words()) for (path, b, _), y in zip(blocks, labels, strict=True) if y]
    rest = [b for (_, b, _), y in zip(blocks, labels, strict=True) if not y] or ["Home", "About us", "All rights reserved"]
    top = ("<html>", "<body>", *[(), ("<div>", "page"), ("<div>", "wrapper", "site")][rng.integers(3)])
    wrap = [("<article>",), ("<main>",), ("<main>", "<article>", "post"), ("<div>", "content"), ("<div>", "entry", "content"), ("<section>", "article", "body"), ("<div>", "post", "body")][rng.integers(7)]
    kinds = [("<nav>", "<ul>", "<li>", "<a>"), ("<header>",), ("<header>", "<h2>"), ("<footer>",), ("<aside>", "<p>"), ("<aside>", "sidebar", "<ul>", "<li>"), ("<div>", "ad"), ("<div>", "advert", "banner"),
             ("<div>", "cookie", "notice"), ("<div>", "notice", "<p>"), ("<form>",), ("<form>", "<label>"), ("<section>", "comments", "<p>"), ("<div>", "comments", "<div>", "comment", "<p>"),
             ("<div>", "menu", "<a>"), ("<div>", "sidebar"), ("<div>", "related", "<a>"), ("<div>", "newsletter", "<p>"), ("<div>", "social", "share", "<a>")]
    out, y = [], []

    def furniture(base: tuple[str, ...]) -> None:
        kind = kinds[rng.integers(len(kinds))]
        for _ in range(rng.integers(1, 5)):
            # Comments and notices may be prose as well: some take main text.
            text = main[rng.integers(len(main))][0] if main and rng.random() < 0.3 else rest[rng.integers(len(rest))]
            out.append((path_of((*base, *kind)), text, float("<a>" in kind)))
            y.append(0)

    for _ in range(rng.integers(0, 4)):
        furniture(top)
    inner = [("<p>",), ("<p>",), ("<p>",), ("<p>",), ("<h2>",), ("<h3>",), ("<ul>", "<li>"), ("<ol>", "<li>"), ("<blockquote>",), ("<p>", "<b>"), ("<pre>",), ("<table>", "<tr>", "<td>"), ("<figure>", "<figcaption>"), ("<dl>", "<dd>")]
    for k, (text, path) in enumerate(main):
        leaf = ("<h1>",) if "<h1>" in path else inner[rng.integers(len(inner))]
        out.append((path_of((*top, *wrap, *leaf)), text, 0.0))
        y.append(1)
        if rng.random() < 0.1 and k + 1 < len(main):
            furniture((*top, *wrap))
    for _ in range(rng.integers(0, 4)):
        furniture(top)
    return out, y


def fit_labeller(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, train_blocks: int = TRAIN_BLOCKS) -> Labeller:
    """Fits the labeller on about sample_pages pages, chosen by a hash of page_id. Pages without main text by their tags, or of
    more than train_blocks blocks, aren't fitted on."""
    rows = pages.where("html is not null").select("page_id", "html")
    n, span = rows.count(), 1 << 30
    share = min(span, -(-sample_pages * span // max(1, n)))
    sample = rows.where(F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(span)) < share).orderBy("page_id", "html").toLocalIterator()
    rng = np.random.default_rng(11)
    train = []
    for row in sample:
        blocks = blocks_of(row.html)
        labels = [by_tags(b[0].words()) for b in blocks] if len(blocks) <= train_blocks else []
        if any(labels):
            train.append((features(blocks), np.array(labels, np.float32)))
            for _ in range(VARIANTS):
                b, y = variant(blocks, labels, rng)
                train.append((features(b), np.array(y, np.float32)))
    labeller = Labeller()
    if train:
        labeller.fit(train)
    else:
        labeller.out[-1] = 1  # nothing to learn from: every block is taken
    return labeller


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared.value
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                pages = [blocks_of(x) for x in part.column(2).to_pylist()]
                every = features([b for p in pages for b in p])
                ends = np.cumsum([len(p) for p in pages])
                chances = labeller.label([every[e - len(p) : e] for p, e in zip(pages, ends, strict=True)])
                texts = ["\n\n".join(b[1] for b, c in zip(p, chance, strict=True) if c >= 0.5) for p, chance in zip(pages, chances, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """pages -> (page_id, url, text, n_chars): main blocks in page order, joined by an empty line.

    Null and empty html, and pages without main blocks, give the empty text. Null ids and urls and repeated rows are
    kept, other columns ignored, an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
