"""Language identification by multilingual mixture inference.

Letter trigrams of all training documents are counted per language (hashed to BUCKETS). A
document is a mixture of languages: expectation-maximisation estimates the proportions
from its trigrams' likelihoods, and a likelihood penalised by the number of languages
(BIC) chooses how many of the strongest ones it is written in: one more as long as that raises it.

Defined results: a null text, or one without letters, is ``und`` with score 0; without
training rows everything is ``und``; documents with a null language or in the held-out part
are never learned from; an empty table gives no rows; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, remainder, table, texts

BUCKETS = 1 << 16
#: The model goes to every task: BUCKETS x languages x 4 bytes, at most 128 MB.
MAX_LANGUAGES = 512
ROUNDS, FEWER = 10, 5


def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(doc_texts: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of every trigram with a letter in its middle; other characters count as spaces."""
    # A space at both ends of each document keeps documents apart.
    joined = " " + "  ".join(t.lower() for t in doc_texts) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t.lower()) + 2 for t in doc_texts])
    word = is_letter[c]
    c = np.where(word, c, np.uint32(32))
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(word[1:-1])
    return np.searchsorted(ends, at + 1, side="right"), (h[at] >> np.uint32(16)).astype(np.int64)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, seen = letters(), {}
        for t in chunks(batches):
            langs, inverse = np.unique(np.array(t["lang"].to_pylist(), object), return_inverse=True)
            doc, bucket = trigrams(texts(t), is_letter)
            n = np.bincount(inverse[doc] * BUCKETS + bucket, minlength=len(langs) * BUCKETS).reshape(len(langs), BUCKETS)
            for i, lang in enumerate(langs):
                seen[lang] = seen.get(lang, 0) + n[i]
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": n[at].astype(np.int64)})

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and P[bucket, language], each column summing to 1, from rows (text, lang)."""
    if docs.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = count_trigrams(docs).toArrow()  # at most MAX_LANGUAGES x BUCKETS rows
    langs = sorted(set(found["lang"].to_pylist()))
    n = np.full((BUCKETS, max(1, len(langs))), 0.5)
    number = {lang: i for i, lang in enumerate(langs)}
    n[found["bucket"].to_numpy(), [number[x] for x in found["lang"].to_pylist()]] += found["n"].to_numpy()
    return langs, (n / n.sum(0)).astype(np.float32)


def em(p: np.ndarray, count: np.ndarray, doc: np.ndarray, first: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood per document. Rows of p, count and doc are (document, trigram) pairs by document."""
    total = np.add.reduceat(count, first)[:, None]
    for _ in range(rounds):
        r = p * pi[doc]
        r *= (count / np.einsum("gl->g", r))[:, None]
        pi = np.add.reduceat(r, first, axis=0) / total
        pi = np.maximum(pi, 1e-8)
        pi /= pi.sum(1, keepdims=True)
    like = np.einsum("gl,gl->g", p, pi[doc])
    return pi, np.add.reduceat(count * np.log(like), first)


def infer(doc_texts: list[str], p: np.ndarray, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: proportions over all languages, number of languages chosen (0: no letters), their ranking."""
    n_docs, n_langs = len(doc_texts), p.shape[1]
    pi_all, chosen = np.full((n_docs, n_langs), 1 / n_langs, np.float32), np.zeros(n_docs, np.int64)
    doc, bucket = trigrams(doc_texts, is_letter)
    if not len(doc):
        return pi_all, chosen, np.argsort(-pi_all, 1, kind="stable")
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc, bucket, count = key // BUCKETS, key % BUCKETS, count.astype(np.float32)
    present, doc = np.unique(doc, return_inverse=True)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    q = p[bucket]
    # Only ratios between languages matter for the proportions.
    top = q.max(1)
    q = q / top[:, None]
    pi, _ = em(q, count, doc, first, np.full((len(present), n_langs), 1 / n_langs, np.float32), ROUNDS)
    rank = np.argsort(-pi, 1, kind="stable")
    best, k_best = np.full(len(present), -np.inf), np.ones(len(present), np.int64)
    size = np.log(np.maximum(2, np.add.reduceat(count, first)))
    open_ = np.arange(len(present))  # documents that the last language more has made likelier
    for k in range(1, n_langs + 1):
        live = np.zeros(len(present), bool)
        live[open_] = True
        at = live[doc]
        q_k, count_k, doc_k = q[at], count[at], (np.cumsum(live) - 1)[doc[at]]
        first_k = np.flatnonzero(np.r_[True, doc_k[1:] != doc_k[:-1]])
        top_k = rank[open_, :k]
        if k == 1:
            like = np.add.reduceat(count_k * np.log(np.maximum(q_k[np.arange(len(doc_k)), top_k[doc_k, 0]], 1e-30)), first_k)
        else:
            mask = np.zeros((len(open_), n_langs), pi.dtype)
            np.put_along_axis(mask, top_k, 1, 1)
            start = np.maximum(pi[open_] * mask, mask * 1e-6)
            start /= start.sum(1, keepdims=True)
            like = em(q_k, count_k, doc_k, first_k, start, FEWER)[1]
        value = like - 0.5 * (k - 1) * size[open_]
        better = value > best[open_]
        open_ = open_[better]
        if not len(open_):
            break
        k_best[open_], best[open_] = k, value[better]
    pi_all[present], chosen[present] = pi, k_best
    return pi_all, chosen, np.argsort(-pi_all, 1, kind="stable")


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (its proportion), langs (the chosen set, strongest first).

    ``train`` has text and lang (not null).
    """
    langs, p = fit(train.select("text", "lang"))
    model = docs.sparkSession.sparkContext.broadcast((langs, p))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = model.value
        is_letter = letters()
        for t in chunks(batches, limit=min(3_000_000, 48_000_000 // max(1, len(names)))):
            pi, chosen, rank = infer(texts(t), p, is_letter)
            chosen = chosen * bool(names)
            sets = [[names[i] for i in rank[d, : chosen[d]]] for d in range(t.num_rows)]
            score = np.where(chosen > 0, np.clip(pi.max(1), 0, 1), 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array([s[0] if s else "und" for s in sets], pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    train = docs.filter(~held & F.col("lang").isNotNull())
    return identify(docs, train).select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs")


SQL: dict[str, str] = {}
QUERIES = {"op7_language_id": op7_language_id}
