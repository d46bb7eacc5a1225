"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text inside one block element. Each block becomes a
vector of hashed features of its tag path, its hashed words and a few numbers; a
bidirectional LSTM reads the page's whole sequence of blocks and labels each as article text or not.

There are no labels, so the network learns from markup that states its purpose: elements and
class or id words such as nav, footer, aside, advert, comment. The training pages are a bounded
sample; copies of them get such blocks of all kinds put in, and their telling words dropped here and
there, so that the network has to use the neighbours, links and words as well.

Defined results: a null html counts as empty and gives an empty text; pages without article text give an
empty text; broken markup and cut-off tags are read as far as they go; an empty table gives no rows;
repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Adam, chunks, fitted_in_task, table, texts

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
NAMES = re.compile(r"""\b(class|id|role|itemprop|type)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)
#: Never text, up to their end tag.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
#: An opening tag of these closes an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements and name words that say that a block is not the article.
OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset"}
OTHER_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disclaimer", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "reply", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "alert", "login", "search", "pagination", "pager"}
SPACES = re.compile(r"\s+")


@dataclass(frozen=True)
class Shape:
    """The training sample takes at most ``sample`` pages of at most ``sample_chars`` characters."""

    path_dim: int = 128
    word_dim: int = 64
    hidden: int = 24
    sample: int = 400
    sample_chars: int = 40_000
    epochs: int = 8
    batch: int = 16
    seed: int = 3


@dataclass
class Block:
    path: tuple[str, ...]  # tags and name words from the root on
    text: str
    linked: int  # characters inside links


def names(attributes: str) -> list[str]:
    out = []
    for _, a, b, c in NAMES.findall(attributes):
        out += [f".{w}" for w in re.split(r"[^a-z0-9]+", (a or b or c).lower()) if w]
    if HIDDEN.search(attributes):
        out.append(".hidden")
    return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    stack: list[tuple[str, list[str]]] = []
    out: list[Block] = []
    text: list[str] = []
    linked, links, raw, raw_path = 0, 0, "", 0

    def flush() -> None:
        nonlocal text, linked
        joined = SPACES.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append(Block(tuple(x for tag, more in stack for x in (tag, *more)), joined, linked))
        text, linked = [], 0

    def close(at: int) -> None:
        nonlocal links
        for tag, _ in stack[at:]:
            links -= tag == "a"
        del stack[at:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                text.append(s)
                linked += len(s) * (links > 0)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if found >= 0 and all(t in INLINE for t, _ in stack[found:]):
                    close(found)
                continue
            flush()
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if found >= 0:
                close(found)
            continue
        if tag in RAW:
            if tag in ("title", "noscript", "template", "iframe", "object"):
                flush()
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            # A block element ends an open paragraph, with what was left open inside it.
            ends = CLOSES.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        links += tag == "a"
        if not m[3].rstrip().endswith("/") or tag in INLINE:
            stack.append((tag, names(m[3]) if m[3].strip() else []))
    flush()
    return out


def says_other(block: Block) -> bool:
    return any(x in OTHER_TAGS or (x[0] == "." and (x[1:] in OTHER_WORDS or x == ".hidden")) for x in block.path)


def hashed(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % n


class Featurizer:
    """Vectors of a page's blocks: hashed tag path, hashed words (all of a block, as shares), and a few numbers."""

    def __init__(self, shape: Shape, most: int = 200_000):
        self.shape, self.most, self.paths, self.words = shape, most, {}, {}

    def __call__(self, page: list[Block]) -> np.ndarray:
        s, known = self.shape, self.words
        if len(known) > self.most:
            known.clear()
        x = np.zeros((len(page), s.path_dim + s.word_dim + 6), np.float32)
        buckets, count = [], np.zeros(len(page), np.int64)
        for i, b in enumerate(page):
            at = self.paths.get(b.path)
            if at is None:
                if len(self.paths) > self.most:
                    self.paths.clear()
                at = self.paths[b.path] = np.array(sorted({hashed(p, s.path_dim) for p in b.path} | {hashed("last " + p, s.path_dim) for p in b.path[-1:]}), np.int64)
            x[i, at] = 1
            words = b.text.lower().split()
            for w in words:
                k = known.get(w)
                if k is None:
                    k = known[w] = hashed(w, s.word_dim)
                buckets.append(k)
            n, count[i] = len(b.text), len(words)
            ends = sum(map(b.text.count, ".!?"))
            x[i, -6:] = (np.log1p(n) / 8, b.linked / n, min(1.0, len(words) / 50), ends / max(1, len(words)), i / len(page), 1)
        cells = np.repeat(np.arange(len(page)), count) * s.word_dim + np.array(buckets, np.int64)
        shares = np.bincount(cells, minlength=len(page) * s.word_dim).reshape(len(page), s.word_dim) / np.maximum(count, 1)[:, None]
        x[:, s.path_dim : s.path_dim + s.word_dim] = shares
        return x


class Labeller:
    """Bidirectional LSTM with a logistic unit for every block."""

    def __init__(self, shape: Shape):
        r, d, h = np.random.default_rng(shape.seed), shape.path_dim + shape.word_dim + 6, shape.hidden
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.shape = shape
        self.w = {"wx": f(d, 8 * h, scale=0.15), "b": np.zeros(8 * h, np.float32), "u": f(2, h, 4 * h, scale=h**-0.5), "out": f(2 * h, scale=0.2), "bias": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, n: np.ndarray, keep: bool = False):
        """x (steps, pages, features), n blocks per page -> logits (steps, pages)."""
        steps, pages, _ = x.shape
        h = self.shape.hidden
        g = x @ self.w["wx"] + self.w["b"]
        states = np.zeros((steps, pages, 2 * h), np.float32)
        saved = [[None] * steps, [None] * steps]
        for d in (0, 1):
            s, c = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a = g[t, :, 4 * h * d : 4 * h * (d + 1)] + s @ self.w["u"][d]
                gate = 1 / (1 + np.exp(-np.clip(a[:, : 3 * h], -30, 30)))
                i, f_, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                z = np.tanh(a[:, 3 * h :])
                on = (t < n)[:, None]
                new = f_ * c + i * z
                tc = np.tanh(new)
                if keep:
                    saved[d][t] = (s, c, i, f_, o, z, tc, on)
                c = np.where(on, new, c)
                s = np.where(on, o * tc, s)
                states[t, :, h * d : h * (d + 1)] = s * on
        return states @ self.w["out"] + self.w["bias"][0], (states, saved)

    def backward(self, x: np.ndarray, kept, dlogit: np.ndarray) -> dict:
        states, saved = kept
        steps, pages, _ = x.shape
        h = self.shape.hidden
        grads = {"out": np.einsum("tnk,tn->k", states, dlogit), "bias": np.array([dlogit.sum()], np.float32), "u": np.zeros_like(self.w["u"])}
        dg = np.zeros((steps, pages, 8 * h), np.float32)
        for d in (0, 1):
            ds, dc = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                s, c, i, f_, o, z, tc, on = saved[d][t]
                ds = ds + dlogit[t, :, None] * self.w["out"][h * d : h * (d + 1)] * on
                dnew = (ds * o * (1 - tc * tc) + dc) * on
                da = np.concatenate([dnew * z * i * (1 - i), dnew * c * f_ * (1 - f_), ds * on * tc * o * (1 - o), dnew * i * (1 - z * z)], 1)
                dg[t, :, 4 * h * d : 4 * h * (d + 1)] = da
                grads["u"][d] += s.T @ da
                dc = np.where(on, dnew * f_, dc)
                ds = np.where(on, da @ self.w["u"][d].T, ds)
        flat = dg.reshape(-1, 8 * h)
        grads["wx"], grads["b"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
        return grads


#: Blocks put into training pages: wrapper, and whether what is inside counts as linked.
INSERTS = [
    ("nav", (), True), ("header", (), False), ("footer", (), False), ("aside", (".sidebar",), True), ("div", (".sidebar",), False), ("div", (".ad",), False), ("div", (".advert", ".banner"), False),
    ("div", (".cookie", ".notice"), False), ("section", (".comments",), False), ("div", (".comment",), False), ("form", (), False), ("div", (".newsletter",), False), ("ul", (".menu",), True),
    ("div", (".related",), True), ("div", (".share",), True), ("div", (".promo",), False), ("p", (".notice",), False), ("div", (".popup",), False), ("ol", (".comments", ".list"), False),
]


def vary(page: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page with boilerplate put in and telling words dropped, and its labels."""
    labels = [0 if says_other(b) else 1 for b in page]
    pool = [b.text for b in page]
    if not pool:
        return page, labels
    rows = list(zip(page, labels, strict=True))
    for _ in range(rng.integers(0, 4)):
        tag, more, linked = INSERTS[rng.integers(len(INSERTS))]
        where = int(rng.integers(len(rows) + 1))
        around = rows[min(where, len(rows) - 1)][0].path
        root = around[: int(rng.integers(len(around) + 1))] if rng.random() < 0.5 else around[:2]
        if any(x in OTHER_TAGS for x in root):
            root = around[:2]
        new = []
        for _ in range(rng.integers(1, 5)):
            words = pool[rng.integers(len(pool))].split()
            start = int(rng.integers(max(1, len(words) - 3)))
            text = " ".join(words[start : start + int(rng.integers(1, 30))]) or "more"
            child = (("li", "a") if linked else ("p",))[: int(rng.integers(3))]
            new.append((Block((*root, tag, *more, *child), text, len(text) * linked), 0))
        rows[where:where] = new
    out, marks = [], []
    blank = rng.random() < 0.25
    for b, y in rows:
        path = tuple(x for x in b.path if not (blank and rng.random() < 0.3 and (x in ("article", "main", "section") or x[0] == ".")))
        out.append(Block(path, b.text, b.linked))
        marks.append(y)
    return out, marks


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in pages])
    x = np.zeros((int(n.max()), len(pages), pages[0].shape[1]), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
    return x, n


def train(samples: list[str], shape: Shape) -> Labeller:
    net, rng, featurize = Labeller(shape), np.random.default_rng(shape.seed), Featurizer(shape)
    parsed = [p for p in map(blocks, samples) if p]
    adam = Adam(net.w, 0.01)
    steps = max(shape.epochs * len(parsed) // shape.batch, 60 if parsed else 0)
    for step in range(steps):
        chosen = rng.choice(len(parsed), min(shape.batch, len(parsed)), replace=False)
        varied = [vary(parsed[i], rng) for i in chosen]
        x, n = pad([featurize(p) for p, _ in varied])
        y = np.zeros(x.shape[:2], np.float32)
        for j, (_, marks) in enumerate(varied):
            y[: len(marks), j] = marks
        on = np.arange(len(x))[:, None] < n
        logits, kept = net.forward(x, n, keep=True)
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) * on / on.sum()
        adam.rate = 0.01 if step < steps * 0.7 else 0.003
        adam.step(net.backward(x, kept, error.astype(np.float32)))
    return net


class Extractor:
    def __init__(self, net: Labeller):
        self.net, self.featurize = net, Featurizer(net.shape)

    def __call__(self, pages: list[str]) -> list[str]:
        parsed = [blocks(p) for p in pages]
        out = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
        at = 0
        while at < len(order):
            # Groups of pages with like numbers of blocks, bounded by blocks in all.
            size = max(1, min(64, 4096 // len(parsed[order[min(at + 63, len(order) - 1)]])))
            group = order[at : at + size]
            x, n = pad([self.featurize(parsed[i]) for i in group])
            logits, _ = self.net.forward(x, n)
            for j, i in enumerate(group):
                out[i] = "\n\n".join(b.text for b, v in zip(parsed[i], logits[:, j], strict=False) if v >= 0)
            at += size
        return out


def fit(pages: DataFrame, html_col: str = "html", shape: Shape = Shape()) -> Labeller:
    """Learn from a bounded sample of pages, chosen by a hash of their html."""
    short = pages.select(F.col(html_col).alias("html")).filter(F.length("html").between(1, shape.sample_chars))
    sample = short.select("html", F.xxhash64("html").alias("h")).orderBy("h").limit(shape.sample)
    net = Labeller(shape)
    net.w = fitted_in_task(sample, lambda t: train(texts(t.sort_by([("h", "ascending"), ("html", "ascending")]), "html") if t else [], shape).w)
    return net


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shape: Shape = Shape()) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    # Plain values, as executors may not have this package.
    model = pages.sparkSession.sparkContext.broadcast((asdict(shape), fit(pages, html_col, shape).w))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, weights = model.value
        net = Labeller(Shape(**given))
        net.w = weights
        extractor = Extractor(net)
        for t in chunks(batches, "html", 4_000_000):
            found = extractor(texts(t, "html"))
            yield pa.RecordBatch.from_arrays([t["page_id"].combine_chunks(), t["url"].combine_chunks(), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
QUERIES = {"op2_html_extract": op2_html_extract}
