"""Toxicity scoring by a bidirectional gated recurrent network with attention pooling.

A word's input is the embedding of its hash plus those of its character n-grams. Two GRUs
read a window of words in both directions, attention pools their states, and a logistic
unit gives the window's score. All overlapping windows of a text are scored and the
largest score is the document's, both in training and in use. The network is trained in
numpy in one task, on a bounded sample of labelled rows; scoring reads every row.

Defined results: a null text or one without words gets the learned base rate as score;
without labelled rows of both kinds every score is the (smoothed) base rate; an empty table gives no
rows; repeated rows each get their row; labels that contradict each other count as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Adam, chunks, cut, fitted_in_task, remainder, table, texts, tidy

TOKEN = re.compile(r"\w+")
CUTOFF = 0.3
#: Features and inputs of words are made for so many words at a time; the arrays for all their characters take memory.
WORDS = 5000


@dataclass(frozen=True)
class Shape:
    """The training sample takes at most ``sample`` labelled rows of at most ``sample_chars`` characters."""

    window: int = 48
    stride: int = 36
    dim: int = 12
    hidden: int = 12
    word_buckets: int = 1 << 14
    gram_buckets: int = 1 << 15
    grams: tuple[int, ...] = (3, 4, 5)
    sample: int = 6000
    sample_chars: int = 6000
    steps: int = 400
    batch: int = 96
    picks: int = 8
    min_docs: int = 3
    drop: float = 0.2
    seed: int = 7


def hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of every n consecutive codes."""
    m = len(codes) - n + 1
    h = np.full(m, 0x811C9DC5 + n, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : k + m]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; buckets of all its character n-grams, and where each word's begin."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    parts, owners = [], []
    for n in shape.grams:
        h = hashed(codes, n) if len(codes) >= n else np.zeros(0, np.uint32)
        inside = owner[: len(h)] == owner[n - 1 :][: len(h)]
        parts.append(h[inside] % np.uint32(shape.gram_buckets))
        owners.append(owner[: len(h)][inside])
    grams, owners = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    grams, count = grams[order].astype(np.int32), np.bincount(owners, minlength=len(words))
    # A word's own hash: over all its codes by a running sum of position-weighted codes.
    weight = (np.arange(len(codes), dtype=np.uint32) - np.repeat(begin, size).astype(np.uint32)) * np.uint32(0x9E3779B1) + np.uint32(1)
    mixed = (codes * weight) ^ ((codes * weight) >> np.uint32(16))
    word = np.add.reduceat(mixed * np.uint32(0x85EBCA6B), begin)
    word ^= word >> np.uint32(15)
    return (word % np.uint32(shape.word_buckets)).astype(np.int64), grams, np.cumsum(count) - count


def all_features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``features``, a bounded number of words at a time."""
    parts = [features(words[i : i + WORDS], shape) for i in range(0, len(words), WORDS)]
    n = np.cumsum([0] + [len(grams) for _, grams, _ in parts])
    word, grams, first = zip(*parts)
    return np.concatenate(word), np.concatenate(grams), np.concatenate([f + k for f, k in zip(first, n)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Weights and passes. Directions are stacked in the first axis of recurrent weights."""

    def __init__(self, shape: Shape):
        r, d, h = np.random.default_rng(shape.seed), shape.dim, shape.hidden
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.shape = shape
        self.w = {
            "word": f(shape.word_buckets, d, scale=0.05), "gram": f(shape.gram_buckets, d, scale=0.05),
            "wx": f(d, 6 * h, scale=d**-0.5), "b": np.zeros(6 * h, np.float32), "u": f(2, h, 3 * h, scale=h**-0.5),
            "wa": f(2 * h, h, scale=(2 * h) ** -0.5), "va": f(h, scale=0.3), "out": f(2 * h, scale=0.3), "bias": np.zeros(1, np.float32),
        }
        self.base = 0.1

    def embed(self, words: list[str]):
        word, grams, first = features(words, self.shape)
        n = np.diff(np.append(first, len(grams)))
        # Every word has an n-gram of length 3: its own characters between the two marks.
        e = self.w["word"][word] + np.add.reduceat(self.w["gram"][grams], first, axis=0) / np.sqrt(n)[:, None].astype(np.float32)
        return e, (word, grams, first, n)

    def project(self, e: np.ndarray) -> np.ndarray:
        return e @ self.w["wx"] + self.w["b"]

    def project_words(self, words: list[str], out: np.ndarray | None = None) -> np.ndarray:
        """Projected inputs of words, a bounded number at a time, put into ``out`` if it is given."""
        out = np.empty((len(words), 6 * self.shape.hidden), np.float32) if out is None else out
        for i in range(0, len(words), WORDS):
            out[i : i + WORDS] = self.project(self.embed(words[i : i + WORDS])[0])
        return out

    def forward(self, x: np.ndarray, length: np.ndarray, keep: bool = False):
        """x: projected inputs (steps, windows, 6 hidden), zero beyond a window's length."""
        steps, n, _ = x.shape
        h, u = self.shape.hidden, self.w["u"]
        states = np.zeros((steps, n, 2 * h), np.float32)
        saved = [[None] * steps, [None] * steps]
        for d in (0, 1):
            s = np.zeros((n, h), np.float32)
            xd = x[:, :, 3 * h * d : 3 * h * (d + 1)]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = s @ u[d]
                zr = 1 / (1 + np.exp(-(xd[t, :, : 2 * h] + g[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(xd[t, :, 2 * h :] + r * g[:, 2 * h :])
                z = z * (t < length)[:, None]
                if keep:
                    saved[d][t] = (s, z, r, c, g[:, 2 * h :])
                s = s + z * (c - s)
                states[t, :, h * d : h * (d + 1)] = s
        a = np.tanh(states @ self.w["wa"])
        score = a @ self.w["va"]
        score = np.where(np.arange(steps)[:, None] < length, score, -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logit = pooled @ self.w["out"] + self.w["bias"][0]
        return logit, (states, a, weight, pooled, saved)

    def backward(self, x: np.ndarray, length: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        states, a, weight, pooled, saved = kept
        steps, n, _ = x.shape
        h, w = self.shape.hidden, self.w
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * w["out"]
        dstates = weight[:, :, None] * dpool
        dweight = np.einsum("tnk,nk->tn", states, dpool)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        g["va"] = np.einsum("tnk,tn->k", a, dscore)
        da = dscore[:, :, None] * w["va"] * (1 - a * a)
        g["wa"] = np.einsum("tnk,tnj->kj", states, da)
        dstates += da @ w["wa"].T
        dx, g["u"] = np.zeros_like(x), np.zeros_like(w["u"])
        for d in (0, 1):
            ds = np.zeros((n, h), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                s, z, r, c, gc = saved[d][t]
                ds = ds + dstates[t, :, h * d : h * (d + 1)]
                dc = ds * z * (1 - c * c)
                dz = ds * (c - s) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], 1)
                dx[t, :, 3 * h * d : 3 * h * (d + 1)] = np.concatenate([dz, dr, dc], 1)
                g["u"][d] += s.T @ dg
                ds = ds * (1 - z) + dg @ w["u"][d].T
        return g, dx


def windows(n: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of every window; documents have n words, one after another."""
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - shape.window) // shape.stride)), 0)
    doc = np.repeat(np.arange(len(n)), many)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * shape.stride
    return doc, (np.cumsum(n) - n)[doc] + start, np.minimum(n[doc] - start, shape.window)


def gather(table_: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray, steps: int) -> np.ndarray:
    at = start + np.minimum(np.arange(steps)[:, None], length - 1)
    return table_[ids[at]]


def train(doc_texts: list[str], toxic: np.ndarray, shape: Shape) -> Net:
    """Fit on documents with labels; each document counts through its highest-scored window."""
    net = Net(shape)
    net.base = float((toxic.sum() + 0.1) / (len(toxic) + 1))
    number: dict[str, int] = {}
    tokens = [np.fromiter((number.setdefault(w, len(number)) for w in TOKEN.findall(t.lower())), np.int32) for t in doc_texts]
    some = [i for i, w in enumerate(tokens) if len(w)]
    y = toxic[some].astype(np.float32)
    if not len(y) or y.min() == y.max():
        return net
    ids = np.concatenate([tokens[i] for i in some])
    n = np.array([len(tokens[i]) for i in some])
    net.w["bias"][0] = np.log(net.base / (1 - net.base))
    doc, start, length = windows(n, shape)
    vocabulary = list(number)
    del tokens, number
    word, grams, first = all_features(vocabulary, shape)
    n_grams = np.diff(np.append(first, len(grams)))
    root = np.sqrt(n_grams).astype(np.float32)
    # The tables' first column is the smoothed log-odds of a bucket. The odds come from one half of the
    # documents while the network learns from the other half how far to trust them; buckets that few
    # documents have stay blank.
    half = np.random.default_rng(shape.seed + 1).permutation(len(n)) % 2 == 0
    if y[half].min() == y[half].max() or y[~half].min() == y[~half].max():
        half = np.ones(len(n), bool)
    spread = {k: np.zeros((2, 2, len(net.w[k]))) for k in ("word", "gram")}  # documents by half, label and bucket
    at = 0
    for i, size in enumerate(n):
        own = np.unique(ids[at : at + size])
        many = n_grams[own]
        span = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        spread["word"][int(half[i]), int(y[i]), np.unique(word[own])] += 1
        spread["gram"][int(half[i]), int(y[i]), np.unique(grams[span])] += 1
        at += size
    alive = {k: spread[k].sum((0, 1))[:, None] >= shape.min_docs for k in spread}
    for k in spread:
        net.w[k] *= alive[k]
        net.w[k][:, 0] = log_odds(*spread[k][1], p=float(y[half].mean()))
    learners = np.flatnonzero(~half) if not half.all() else np.arange(len(n))
    rng, adam = np.random.default_rng(shape.seed), Adam(net.w, 0.01, ("word", "gram"))
    of_doc = np.searchsorted(doc, np.arange(len(n) + 1))
    for phase in range(shape.picks):
        if phase < 2:  # any window may stand for its document until the network tells windows apart
            pick = None
        else:
            order = np.lexsort((-score_windows(net, net.project_words(vocabulary), ids, start, length), doc))
            pick = order[of_doc[:-1]]
        for _ in range(shape.steps // shape.picks):
            at = rng.choice(learners, min(len(learners), shape.batch), replace=False)
            win = of_doc[at] + (rng.random(len(at)) * np.diff(of_doc)[at]).astype(np.int64) if pick is None else pick[at]
            pos = start[win] + np.minimum(np.arange(shape.window)[:, None], length[win] - 1)
            used, inverse = np.unique(ids[pos], return_inverse=True)
            inverse = inverse.reshape(pos.shape)
            span = np.repeat(first[used] - np.r_[0, np.cumsum(n_grams[used])[:-1]], n_grams[used]) + np.arange(n_grams[used].sum())
            g_ids, begin = grams[span], np.r_[0, np.cumsum(n_grams[used])[:-1]]
            e = net.w["word"][word[used]] + np.add.reduceat(net.w["gram"][g_ids], begin, axis=0) / root[used, None]
            valid = (np.arange(shape.window)[:, None] < length[win])[:, :, None]
            valid = valid & (rng.random(valid.shape) >= shape.drop)
            x = net.project(e)[inverse] * valid
            logit, kept = net.forward(x, length[win], keep=True)
            grads, dx = net.backward(x, length[win], kept, ((sigmoid(logit) - y[at]) / len(at)).astype(np.float32))
            dx *= valid
            dproj = np.zeros((len(used), dx.shape[2]), np.float32)
            np.add.at(dproj, inverse.ravel(), dx.reshape(-1, dx.shape[2]))
            grads["wx"], grads["b"] = e.T @ dproj, dproj.sum(0)
            de = dproj @ net.w["wx"].T
            grads["word"], grads["gram"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["gram"])
            np.add.at(grads["word"], word[used], de)
            np.add.at(grads["gram"], g_ids, np.repeat(de / root[used, None], n_grams[used], axis=0))
            for k, a in alive.items():
                grads[k] *= a
                grads[k][:, 0] = 0
            adam.step(grads)
    for k in spread:
        net.w[k][:, 0] = log_odds(*spread[k].sum(0), p=float(y.mean()))
    return net


def log_odds(no: np.ndarray, yes: np.ndarray, p: float, prior: float = 4.0) -> np.ndarray:
    """Log-odds of label 1 among the documents that have a bucket, against rate p, shrunk by ``prior`` documents."""
    rate = np.clip((yes + prior * p) / (no + yes + prior), 1e-4, 1 - 1e-4)
    return (np.clip(np.log(rate / (1 - rate)) - np.log(p / (1 - p)), -3, 6) / 2).astype(np.float32)


def score_windows(net: Net, projected: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray, batch: int = 512) -> np.ndarray:
    out = np.zeros(len(start), np.float32)
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), batch):
        at = order[i : i + batch]
        steps = int(length[at].max())
        out[at] = net.forward(gather(projected, ids, start[at], length[at], steps), length[at])[0]
    return out


class Scorer:
    """Scores texts in a task; projections of words met before are kept, up to a bound."""

    def __init__(self, net: Net, most_words: int = 100_000):
        self.net, self.most = net, most_words
        self.number: dict[str, int] = {}
        self.rows = self.room(2 * most_words)

    def room(self, words: int) -> np.ndarray:
        """Rows for so many words; they take memory when they are written."""
        return np.empty((words, 6 * self.net.shape.hidden), np.float32)

    def __call__(self, doc_texts: list[str]) -> np.ndarray:
        if len(self.number) > self.most:
            self.number = {}
        known, number = len(self.number), self.number
        tokens = [TOKEN.findall(t.lower()) for t in doc_texts]
        n = np.array([len(w) for w in tokens], np.int64)
        ids = np.fromiter((number.setdefault(w, len(number)) for ws in tokens for w in ws), np.int64, int(n.sum()))
        if len(number) > known:
            if len(number) > len(self.rows):
                old, self.rows = self.rows, self.room(2 * len(number))
                self.rows[:known] = old[:known]
            self.net.project_words(list(islice(number, known, None)), self.rows[known : len(number)])
        out = np.full(len(doc_texts), self.net.base)
        doc, start, length = windows(n, self.net.shape)
        if len(doc):
            scores = sigmoid(score_windows(self.net, self.rows, ids, start, length).astype(np.float64))
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out[doc[first]] = np.maximum.reduceat(scores, first)
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> Net:
    """Train on labelled rows, sampled by a hash of the id. ``labels`` has doc_id and toxic (0 or 1).

    The sample is drawn from ids alone, and the texts of those ids are read then, so that no other text is shuffled.
    """
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic is not null and id is not null")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text").between(1, shape.sample_chars))
    ids = rows.select("id").join(marks, "id").select("id", "toxic", F.xxhash64("id").alias("h")).distinct().orderBy("h").limit(shape.sample)
    sample = rows.join(F.broadcast(cut(ids)), "id")  # ``ids`` has at most shape.sample rows
    # Ids that repeat could bring more rows than ids.
    sample = sample.select("text", "toxic", "h").orderBy("h", "text").limit(shape.sample)

    def learn(t: pa.Table | None) -> dict:
        if t is None:
            net = Net(shape)
        else:
            t = t.sort_by([("h", "ascending"), ("text", "ascending")])
            net = train(texts(t), t["toxic"].to_numpy(), shape)
        return {**net.w, "base": np.array(net.base)}

    return rebuilt(asdict(shape), fitted_in_task(sample, learn))


def rebuilt(shape: dict, arrays: dict) -> Net:
    """A network from plain arrays; only those are broadcast, as executors may not have this package."""
    net = Net(Shape(**shape))
    net.w = {k: v for k, v in arrays.items() if k != "base"}
    net.base = float(arrays["base"])
    return net


def scores(docs: DataFrame, net: Net):
    """A column function: the score of a text column."""
    model = docs.sparkSession.sparkContext.broadcast((asdict(net.shape), {**net.w, "base": net.base}))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(rebuilt(*model.value))
        for part in parts:
            rows = pa.RecordBatch.from_arrays([part], ["text"])
            yield pa.array(np.concatenate([scorer(texts(t)) for t in chunks([rows], limit=1_500_000)] or [np.zeros(0)]))

    tidied = tidy(run)

    @F.arrow_udf("double")
    def score_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(parts)

    return score_of


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scores(docs, net)(F.col(text_col).cast("string")).alias("score"))


def drop_toxic(docs: DataFrame, net: Net, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows whose text scores below ``cutoff``, with all their columns; only the texts go through Python."""
    return docs.filter(scores(docs, net)(F.col(text_col).cast("string")) < cutoff)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    net = fit(docs.filter(~held), table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op1_toxicity": op1_toxicity}
