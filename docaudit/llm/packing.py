"""Packing documents into training sequences by vector bin packing.

A document's ids are cut into pieces of the sequence length; the last, shorter pieces
are packed together. An item is a vector (tokens, segments, loss-bearing tokens), a
sequence has a limit for each, and the next item of a sequence is the one that fits
and has the largest dot product with what is left of the limits.

Items are dealt to shards of about SHARD_ITEMS by a hash of their row, and each shard is
packed by itself; the waste of a shard's last sequences is a few in a thousand.

Defined results: a null text counts as empty and gives one piece with the end id alone;
an empty table gives no rows; repeated rows are packed one by one.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, small_batches, table, texts, tidy

SHARD_ITEMS = 4096


@dataclass(frozen=True)
class Limits:
    """Of a sequence. A document's piece bears loss on all tokens but its first, so with whole documents the
    limit on loss-bearing tokens follows from the one on tokens; with examples (``pack_examples``) it is one of its own."""

    tokens: int = 1024
    segments: int = 8
    loss_tokens: int = 1023


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """The ids that ``tokenizers`` gives for ``path``.

    If the file says that it splits text as byte-level vocabularies do by default and merges by rank alone, ordinary
    text goes through tiktoken over the same ranks, which gives the same ids about four
    times faster; a text that holds a special token's string, and any text of another kind of file, goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        by_bytes = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        if spec.get("normalizer") or spec.get("truncation") or model.get("type") != "BPE" or not plain or not by_bytes:
            return
        # Byte-level vocabularies write bytes as printable characters: the printable ones stand
        # for themselves, the others follow from code point 256 on.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None or any(s in text for s in self.special):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray(array("I", ids), "<u4").tobytes()


PIECES = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, length: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens and the crc32 of each piece."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path)
        for t in chunks(batches):
            counts, crcs = [], []
            for text in texts(t):
                data = memoryview(ids(text) + end)
                counts.append(len(data) // 4)
                crcs.append([zlib.crc32(data[i : i + 4 * length]) for i in range(0, len(data), 4 * length)])
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], schema=PIECES)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id long, doc_tokens long, crcs array<long>")


def pack_vectors(items: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset (in the first dimension) of each item. Every item alone must fit.

    A bin starts with the largest item left; then comes, again and again, the item that fits and has
    the largest dot product with the bin's remaining limits, both as shares of the limits.
    """
    share = items / limits
    order = np.lexsort((np.arange(len(items)), -share.sum(1)))
    left = list(order)
    bins, offsets = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    pool, rows = share[order], items[order]
    live = np.ones(len(order), bool)
    n_bins, first = 0, 0
    while True:
        while first < len(left) and not live[first]:
            first += 1
        if first == len(left):
            return bins, offsets
        free, pick, used = limits.astype(np.int64).copy(), first, 0
        while pick >= 0:
            live[pick] = False
            bins[left[pick]], offsets[left[pick]] = n_bins, used
            used += rows[pick, 0]
            free = free - rows[pick]
            if free.min() <= 0:
                break
            fits = live & (rows <= free).all(1)
            if not fits.any():
                break
            pick = int(np.where(fits, pool @ (free / limits), -1.0).argmax())
        n_bins += 1
        if n_bins % 64 == 0:
            keep = np.flatnonzero(live)
            left, pool, rows = [left[i] for i in keep], pool[keep], rows[keep]
            live, first = np.ones(len(keep), bool), 0


def pack_shard(limits: Limits):
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row"], kind="stable", ignore_index=True)
        n = pdf.crcs.map(len).to_numpy()
        at = np.repeat(np.arange(len(pdf)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        total = pdf.doc_tokens.to_numpy()[at]
        start = k * limits.tokens
        length = np.minimum(total - start, limits.tokens)
        full = length == limits.tokens
        sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        sequence[full] = np.arange(full.sum())
        tail = np.flatnonzero(~full)
        # A piece's first token is given, not predicted, so it bears no loss.
        vectors = np.stack([length[tail], np.ones(len(tail), np.int64), length[tail] - 1], 1)
        bins, offsets = pack_vectors(vectors, most)
        sequence[tail], offset[tail] = bins + full.sum(), offsets
        return pd.DataFrame({
            "doc_id": pdf.doc_id.to_numpy()[at], "start": start, "length": length, "ids_crc32": np.fromiter((c for x in pdf.crcs for c in x), np.int64, len(at)),
            "doc_tokens": total, "sequence_id": sequence + (int(pdf.shard.iloc[0]) << 36), "offset": offset,
        }) if len(pdf) else pd.DataFrame(columns=["doc_id"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limits: Limits = Limits(), end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with small_batches(docs.sparkSession):
        pieces = cut(cut_pieces(docs, id_col, text_col, path or vocabulary(), limits.tokens, end_id).withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-pieces.count() // SHARD_ITEMS))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(
        pack_shard(limits), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def pack_examples(items: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """Place whole examples (instruction data): id, sequence_id, offset. Longer ones than the limits are an error.

    ``tokens_col`` and ``loss_col`` hold an example's tokens and loss-bearing tokens.
    """
    rows = cut(items.select(F.col(id_col).alias("item_id"), F.col(tokens_col).cast("long").alias("tokens"), F.col(loss_col).cast("long").alias("loss")).withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-rows.count() // SHARD_ITEMS))
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        vectors = np.stack([pdf.tokens, np.ones(len(pdf), np.int64), pdf.loss], 1)
        if (vectors > most).any():
            raise ValueError("an example is beyond the limits of a sequence")
        bins, offsets = pack_vectors(vectors, most)
        return pd.DataFrame({"item_id": pdf.item_id, "sequence_id": bins + (int(pdf.shard.iloc[0]) << 36), "offset": offsets})

    kind = dict(rows.dtypes)["item_id"]
    return rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long")).groupBy("shard").applyInPandas(run, f"item_id {kind}, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_packing": op6_packing}
