"""Language-model scoring: a gated recurrent network beside a smoothed unigram base.

Documents are encoded in chunks: each chunk has a vocabulary of its own, its tokens as numbers in
it, and the training count of each number. Counts of all chunks are added per word and go back to the
chunks that have the word. The network predicts the next of the most frequent training words, or "other";
its output softmax is factored into frequency classes, and an "other" word then has its share of the
smoothed counts of all other words, so every text has a proper likelihood. Output biases start from the
counts of the whole training corpus. Weights are trained by truncated backpropagation in the tasks: a chunk's
training documents are put one after another in a seeded random order and read as parallel streams of equal
length, a part of them in each round, with a falling rate; the state is carried across windows and set back where
a document begins. Weights are averaged over the chunks after every round, so they depend on how Spark splits the table.
In scoring, too, the state is carried from a document's first window to its last.

Defined results: a null text counts as empty and has the end token alone; without training rows all
counts are 0 and the network is the untrained one; an empty table gives no rows; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Adam, chunks, cut, remainder, table

END = b""
#: Long enough chunks for the network to read many documents side by side.
CHUNK_CHARS = 24_000_000
#: Every training document is learned from in one of the rounds.
ROUNDS = 2


@dataclass(frozen=True)
class Shape:
    words: int = 1500
    classes: int = 32
    hidden: int = 16
    window: int = 16
    streams: int = 512
    tokens: int = 8192
    rate: float = 0.03
    seed: int = 5


# Chunks -----------------------------------------------------------------------------------------


def numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of the tokens of all texts one after another, tokens of each, and the words that have the numbers; END has number 0."""
    # Only A-Z change, and texts are split at space and controls 9 to 13 alone.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "").combine_chunks()))
    first, flat = lists.offsets.to_numpy(), lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # spaces at an end give empty words
    upto = np.concatenate(([0], np.cumsum(full)))
    lengths = upto[first[1:] - first[0]] - upto[first[:-1] - first[0]]
    words = flat.filter(pa.array(full)).dictionary_encode()
    tokens = np.zeros(len(words) + len(lengths), np.int32)
    at = np.ones(len(tokens), bool)
    at[np.cumsum(lengths + 1) - 1] = False
    tokens[at] = words.indices.to_numpy(zero_copy_only=False) + 1
    return tokens, lengths + 1, [END, *words.dictionary.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame) -> DataFrame:
    """One row per chunk from rows (doc_id, text, held_out): its documents, tokens, words and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, part = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId()
        for i, t in enumerate(chunks(batches, limit=CHUNK_CHARS)):
            tokens, lengths, words = numbered(t["text"])
            held = np.array(t["held_out"].to_pylist(), bool)
            n = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([(part << 24) + i], pa.int64()), "ids": pa.array([t["doc_id"].to_pylist()], pa.list_(pa.int64())), "held": pa.array([held.tolist()], pa.list_(pa.bool_())),
                "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())), "tokens": pa.array([pack(tokens.tobytes())], pa.binary()), "words": pa.array([pack(b" ".join(words))], pa.binary()), "counts": pa.array([pack(n.tobytes())], pa.binary()),
            })

    return docs.mapInArrow(run, "chunk long, ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words binary, counts binary")


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def words_of(data: bytes) -> list[bytes]:
    return unpack(data).split(b" ")


def word_rows(encoded: DataFrame) -> DataFrame:
    """word, chunk, local, n: every word of every chunk with its training count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words, counts in zip(*(b[c].to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                words, n = words_of(words), np.frombuffer(unpack(counts), np.int64)
                for i in range(0, len(words), 20_000):
                    w = words[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(np.full(len(w), chunk)), pa.array(np.arange(i, i + len(w), dtype=np.int32)), pa.array(n[i : i + len(w)])], ["word", "chunk", "local", "n"])

    return encoded.select("chunk", "words", "counts").mapInArrow(run, "word binary, chunk long, local int, n long")


@dataclass
class Corpus:
    """N, V and the most frequent training words with their counts, most frequent first."""

    n: int
    v: int
    words: list[bytes] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)


def word_totals(rows: DataFrame) -> DataFrame:
    """word, n: training count of every word."""
    return cut(rows.groupBy("word").agg(F.sum("n").alias("n")))


def corpus_counts(totals: DataFrame, most: int) -> Corpus:
    totals = totals.filter("n > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = 0
        best = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for b in batches:
            n, v = n + (pc.sum(b["n"]).as_py() or 0), v + b.num_rows
            best = pa.concat_tables([best, pa.table({"word": b["word"].cast(pa.binary()), "n": b["n"]})]).sort_by([("n", "descending"), ("word", "ascending")]).slice(0, most)
        yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.binary()), "n": [n], "v": [v]})
        for b in best.combine_chunks().to_batches():
            yield pa.RecordBatch.from_pydict({"word": b["word"], "n": b["n"], "v": pa.nulls(b.num_rows, pa.int64())})

    parts = cut(totals.mapInArrow(run, "word binary, n long, v long"))
    size = parts.filter("word is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    top = parts.filter("word is not null").orderBy(F.desc("n"), "word").limit(most).collect()
    return Corpus(size.n or 0, size.v or 0, [bytes(r.word) for r in top], [r.n for r in top])


# The network ------------------------------------------------------------------------------------


class Model:
    """GRU over word symbols; symbol len(words) is "other", a class of its own."""

    def __init__(self, corpus: Corpus, shape: Shape):
        self.shape, self.corpus = shape, corpus
        k, h, r = len(corpus.words), shape.hidden, np.random.default_rng(shape.seed)
        counts = np.array([*corpus.counts, max(1, corpus.n - sum(corpus.counts))], np.float64)
        # Words by falling count, cut into classes of about equal sums of root counts.
        root = np.cumsum(np.sqrt(counts[:-1])) if k else np.zeros(0)
        cls = np.minimum((root / root[-1] * shape.classes).astype(np.int64), shape.classes - 1) if k else np.zeros(0, np.int64)
        _, cls = np.unique(cls, return_inverse=True)
        self.cls = np.append(cls, cls.max() + 1 if k else 0)
        self.first = np.flatnonzero(np.append(True, self.cls[1:] != self.cls[:-1]))
        self.last = np.append(self.first[1:], k + 1)
        mass = np.add.reduceat(counts, self.first)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.w = {
            "e": f(k + 1, h, scale=0.3), "wx": f(h, 3 * h, scale=h**-0.5), "b": np.zeros(3 * h, np.float32), "u": f(h, 3 * h, scale=h**-0.5),
            "oc": f(h, len(self.first), scale=0.01), "bc": np.log(mass / mass.sum()).astype(np.float32),
            "ow": f(k + 1, h, scale=0.01), "bw": np.log(counts / mass[self.cls]).astype(np.float32),
        }
        self.start = corpus.words.index(END) if END in corpus.words else k
        # An "other" word of count c has probability (c + 1) / (other tokens + other words + 1).
        self.other = corpus.n - sum(corpus.counts) + corpus.v - k + 1

    def step(self, s: np.ndarray, symbol: np.ndarray, projected: np.ndarray):
        h = self.shape.hidden
        x, g = projected[symbol], s @ self.w["u"]
        zr = 1 / (1 + np.exp(-(x[:, : 2 * h] + g[:, : 2 * h])))
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
        return s + z * (c - s), (s, z, r, c, g[:, 2 * h :])

    def outputs(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Log-probabilities of the targets; with ``grads`` also the gradient of their negative mean."""
        w, n = self.w, len(target)
        logits = states @ w["oc"] + w["bc"]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(1)
        cls = self.cls[target]
        rows = np.arange(n)
        out = logits[rows, cls] - np.log(total)
        dstates = None
        if grads is not None:
            d = e / total[:, None]
            d[rows, cls] -= 1
            d /= n
            grads["oc"] += states.T @ d
            grads["bc"] += d.sum(0)
            dstates = d @ w["oc"].T
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(len(self.first) + 1))
        for c in range(len(self.first)):
            at = order[edges[c] : edges[c + 1]]
            i, j = self.first[c], self.last[c]
            if not len(at) or j - i == 1:
                continue
            s = states[at]
            logits = s @ w["ow"][i:j].T + w["bw"][i:j]
            logits -= logits.max(1, keepdims=True)
            e = np.exp(logits)
            total, t, own = e.sum(1), target[at] - i, np.arange(len(at))
            out[at] += logits[own, t] - np.log(total)
            if grads is not None:
                d = e / total[:, None]
                d[own, t] -= 1
                d /= n
                grads["ow"][i:j] += d.T @ s
                grads["bw"][i:j] += d.sum(0)
                dstates[at] += d @ w["ow"][i:j]
        return out, dstates

    def loss_and_grads(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, valid: np.ndarray, s: np.ndarray):
        """Mean loss of a window of steps x streams, its gradients, and the state after it.

        x: symbols read, fresh: where a document begins, y: symbols to predict, valid: which of them count.
        """
        w, h, (steps, n) = self.w, self.shape.hidden, x.shape
        projected = w["e"] @ w["wx"] + w["b"]
        g_in, keep = projected[x], np.float32(1) - fresh[:, :, None]
        before, zr, c, back, states = (np.empty((steps, n, k), np.float32) for k in (h, 2 * h, h, h, h))
        for t in range(steps):
            before[t] = s = s * keep[t]
            g = s @ w["u"]
            zr[t] = 1 / (1 + np.exp(-(g_in[t, :, : 2 * h] + g[:, : 2 * h])))
            back[t] = g[:, 2 * h :]
            c[t] = np.tanh(g_in[t, :, 2 * h :] + zr[t, :, h:] * back[t])
            states[t] = s = s + zr[t, :, :h] * (c[t] - s)
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        like, dout = self.outputs(states[valid], y[valid], grads)
        dstates = np.zeros_like(states)
        dstates[valid] = dout
        z, r = zr[:, :, :h], zr[:, :, h:]
        by_c, by_z, by_r = z * (1 - c * c), (c - before) * z * (1 - z), back * r * (1 - r)
        dx, dg = np.empty((steps, n, 3 * h), np.float32), np.empty((steps, n, 3 * h), np.float32)
        ds, u_t = np.zeros((n, h), np.float32), np.ascontiguousarray(w["u"].T)
        for t in range(steps - 1, -1, -1):
            ds = ds + dstates[t]
            dc = ds * by_c[t]
            dx[t, :, :h] = ds * by_z[t]
            dx[t, :, h : 2 * h] = dc * by_r[t]
            dx[t, :, 2 * h :] = dc
            dg[t, :, : 2 * h] = dx[t, :, : 2 * h]
            dg[t, :, 2 * h :] = dc * r[t]
            ds = (ds * (1 - z[t]) + dg[t] @ u_t) * keep[t]
        grads["u"] = before.reshape(-1, h).T @ dg.reshape(-1, 3 * h)
        seen = x.ravel()
        order = np.argsort(seen, kind="stable")
        first = np.flatnonzero(np.diff(seen[order], prepend=-1))
        dproj = np.zeros_like(projected)
        dproj[seen[order][first]] = np.add.reduceat(dx.reshape(-1, 3 * h)[order], first)
        grads["wx"], grads["b"], grads["e"] = w["e"].T @ dproj, dproj.sum(0), dproj @ w["wx"].T
        return -float(like.mean()), grads, s

    def train(self, docs: list[np.ndarray], rates: tuple[float, float]) -> None:
        """One pass over documents of symbols, with a rate that falls from the first to the second of ``rates``."""
        shape, rng = self.shape, np.random.default_rng(self.shape.seed)
        docs = [docs[i] for i in rng.permutation(len(docs))]
        stream, size = np.concatenate(docs), np.array([len(d) for d in docs])
        begins = np.zeros(len(stream), bool)
        begins[np.cumsum(size) - size] = True
        # A document begins with what every one ends with.
        read = np.where(begins, self.start, np.concatenate(([self.start], stream[:-1])))
        n = max(1, min(shape.streams, len(stream) // (8 * shape.window)))
        length = -(-len(stream) // n)
        lay = lambda v, fill: np.concatenate((v, np.full(n * length - len(v), fill, v.dtype))).reshape(n, length).T
        x, y, fresh, valid = lay(read, self.start), lay(stream, self.start), lay(begins, True), lay(np.ones(len(stream), bool), False)
        adam, s = Adam(self.w, rates[0]), np.zeros((n, shape.hidden), np.float32)
        for t in range(0, length, shape.window):
            part = slice(t, t + shape.window)
            if not valid[part].any():
                continue
            _, grads, s = self.loss_and_grads(x[part], fresh[part].astype(np.float32), y[part], valid[part], s)
            norm = float(np.sqrt(sum((v * v).sum() for v in grads.values())))
            adam.rate = rates[0] + (rates[1] - rates[0]) * t / length
            adam.step({k: v * np.float32(min(1.0, 1 / (norm + 1e-9))) for k, v in grads.items()})

    def score(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of log-probabilities per document; documents follow one another in ``symbols``."""
        begin, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
        n, begin = lengths[order], begin[order]
        total, projected = np.zeros(len(n)), self.w["e"] @ self.w["wx"] + self.w["b"]
        s, previous = np.zeros((len(n), self.shape.hidden), np.float32), np.full(len(n), self.start, np.int64)
        t = 0
        while len(n) and t < n[0]:
            # Outputs are computed for a window of steps, longer when few documents are left.
            states, targets, owners, size = [], [], [], 0
            while t < n[0] and size < self.shape.tokens:
                live = int(np.searchsorted(-n, -t, side="left"))
                s, _ = self.step(s[:live], previous[:live], projected)
                previous = symbols[begin[:live] + t]
                states.append(s)
                targets.append(previous)
                owners.append(live)
                size, t = size + live, t + 1
            target = np.concatenate(targets)
            like, _ = self.outputs(np.concatenate(states), target)
            total += np.bincount(np.arange(size) - np.repeat(np.cumsum(owners) - owners, owners), like, len(n))
        out = np.zeros(len(n))
        out[order] = total
        return out

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """Symbol of each word of a chunk."""
        number = {w: i for i, w in enumerate(self.corpus.words)}
        other = len(number)
        return np.fromiter((number.get(w, other) for w in words), np.int64, len(words))


def plain(model: Model) -> tuple[dict, dict, dict]:
    """A model as plain values; only those are broadcast, as executors may not have this package."""
    return asdict(model.corpus), asdict(model.shape), model.w


def rebuilt(corpus: dict, shape: dict, weights: dict) -> Model:
    model = Model(Corpus(**corpus), Shape(**shape))
    model.w = {k: v.copy() for k, v in weights.items()}
    return model


def train_round(encoded: DataFrame, model: Model, turn: int) -> tuple[dict | None, int]:
    """Weights averaged by trained tokens over all chunks, None without any, and the number of trained tokens."""
    given = encoded.sparkSession.sparkContext.broadcast(plain(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ids, held, lengths, tokens, words in zip(*(b[c].to_pylist() for c in ("chunk", "ids", "held", "lengths", "tokens", "words")), strict=True):
                own = rebuilt(*given.value)
                symbol = own.symbols(words_of(words))[np.frombuffer(unpack(tokens), np.int32)]
                end = np.cumsum(lengths)
                # Knuth's multiplier spreads ids over the rounds.
                mine = [i for i, d in enumerate(ids) if not held[i] and ((d or 0) * 2654435761 >> 7) % ROUNDS == turn]
                docs = [symbol[end[i] - lengths[i] : end[i]] for i in mine]
                n = sum(map(len, docs))
                if n:
                    own.train(docs, tuple(own.shape.rate * (1 - k / ROUNDS) for k in (turn, turn + 1)))
                    flat = np.concatenate([v.ravel() for v in own.w.values()]).astype(np.float64) * n
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "n": pa.array([n], pa.int64()), "sums": pa.array([flat.tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in t["sums"]:
            total += np.frombuffer(x.as_py())
        return pa.table({"n": pa.array([pc.sum(t["n"]).as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    size = sum(v.size for v in model.w.values())
    parts = encoded.mapInArrow(run, "chunk long, n long, sums binary")
    # Two levels, so that no task or the driver holds the weights of all chunks.
    some = parts.withColumn("to", F.pmod(F.xxhash64("chunk"), F.lit(16))).groupBy("to").applyInArrow(add, "n long, sums binary").collect()
    n = sum(r.n for r in some)
    if not n:
        return None, 0
    flat, out, at = sum(np.frombuffer(r.sums) for r in some) / n, {}, 0
    for k, v in model.w.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out, n


def lm_score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column; the other documents are learned from.
    """
    encoded = cut(encode(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))))
    rows = word_rows(encoded)
    totals = word_totals(rows)
    corpus = corpus_counts(totals, shape.words)
    model = Model(corpus, shape)
    for turn in range(ROUNDS):
        if corpus.n:
            model.w = train_round(encoded, model, turn)[0] or model.w
    given = docs.sparkSession.sparkContext.broadcast(plain(model))
    back = rows.select("word", "chunk", "local").join(totals.withColumnRenamed("n", "c"), "word").select("chunk", "local", "c")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = rebuilt(*given.value)
        out = []
        for chunk in left.to_pylist():
            words = words_of(chunk["words"])
            c = np.zeros(len(words), np.int64)
            c[right["local"].to_numpy()] = right["c"].to_numpy()
            symbol = m.symbols(words)
            tokens, lengths = np.frombuffer(unpack(chunk["tokens"]), np.int32), np.array(chunk["lengths"], np.int64)
            first = np.cumsum(lengths) - lengths
            count = c[tokens]
            base = np.log10((c + 1) / (m.corpus.n + m.corpus.v + 1))[tokens]
            other = np.where(symbol == len(m.corpus.words), np.log10((c + 1) / max(1, m.other)), 0.0)[tokens]
            score = m.score(symbol[tokens], lengths) / np.log(10) + np.add.reduceat(other, first)
            out.append(pa.table([
                pa.array(chunk["ids"], pa.int64()), pa.array(chunk["held"], pa.bool_()), pa.array(lengths), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                pa.array(np.full(len(lengths), m.corpus.n, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(score),
            ], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    needed = encoded.select("chunk", "ids", "held", "lengths", "tokens", "words")
    return needed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


SQL: dict[str, str] = {}
QUERIES = {"op8_lm_score": op8_lm_score}
