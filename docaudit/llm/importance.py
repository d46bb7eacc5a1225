"""Importance resampling of documents towards a target corpus, over hashed word n-grams.

Every run of one to three words is a feature, and its bucket is its CRC-32 modulo the number of buckets. The head of
the vocabulary, the most frequent words of the whole corpus with the CRC state of each and the most frequent
pairs of them with the CRC and bucket of each, is broadcast. Features of the tail take their CRC from their bytes: a word that is not in the head by
itself, a pair or triple by carrying the state of what it begins with over the word that follows. Either way the
CRC is exact, so the head decides how fast buckets are found and never which. CRC-32 is linear: the state after
A and B is the state of A moved on by as many zero bytes as B has, xor the CRC of B. This makes it work on arrays.

A bucket's gain compares its smoothed frequencies in target and corpus. A document's weight is the sum of its
features' gains; with Gumbel noise from its id added, the highest scores are a draw without replacement.

Defined results: a null text has no words; a null id is hashed as the empty string and loses ties; repeated
rows are drawn as often as they score; tables without rows or words give weights of 0 or no rows; extra columns are ignored; words of any length are
exact, though only words up to ``head_bytes`` enter the head.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, table


@dataclass(frozen=True)
class Resampling:
    """``head_words``, ``pair_words`` (pairs are of the first so many head words) and ``head_pairs`` bound the broadcast; they change no result."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 5
    seed: int = 42
    head_words: int = 1 << 14
    head_bytes: int = 64
    pair_words: int = 1 << 10
    head_pairs: int = 1 << 16


#: Bytes of words: digits, letters, and all of code points beyond ASCII. Upper-case letters are lowered first.
WORD_BYTE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SHORT = 64  # shifts by up to so many bytes have a table each


def byte_table() -> np.ndarray:
    """What a step of CRC-32 (reflected polynomial EDB88320) makes of each low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


class Shifts:
    """CRC states moved on by a number of zero bytes, each a linear map of 32 bits, as tables of four bytes."""

    def __init__(self):
        t = byte_table()
        one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        tables = [one]
        for _ in range(SHORT):
            x = tables[-1]
            tables.append(t[x & 0xFF] ^ (x >> np.uint32(8)))
        self.short = np.stack(tables)
        self.doubled = [tables[1]]  # by 1, 2, 4, ... bytes
        for _ in range(40):
            self.doubled.append(self.through(self.doubled[-1], self.doubled[-1]))

    @staticmethod
    def through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]

    def move(self, states: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Each state moved on by its own number of bytes."""
        n, s = np.minimum(by, SHORT), self.short
        out = s[n, 0, states & 0xFF] ^ s[n, 1, (states >> 8) & 0xFF] ^ s[n, 2, (states >> 16) & 0xFF] ^ s[n, 3, states >> 24]
        rest = by - n
        for k in range(int(rest.max(initial=0)).bit_length()):
            at = (rest >> k) & 1 == 1
            out[at] = self.through(self.doubled[k], out[at])
        return out


class Words:
    """The words of some texts in order: ``words`` (binary array), ``doc`` (place of each word's text), ``n_docs``."""

    def __init__(self, column: pa.ChunkedArray):
        text = pa.compute.fill_null(column, "").combine_chunks().cast(pa.large_binary())
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.n_docs, bounds = len(text), offsets - offsets[0]
        inside = WORD_BYTE[data]
        edge = np.zeros(len(data) + 1, bool)  # a word cannot go on over the border of two texts
        edge[bounds] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        kept = np.flatnonzero(inside)
        at = np.append(np.searchsorted(kept, starts), len(kept))
        self.sizes = np.diff(at)
        self.words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(LOWER[data[kept]])])
        self.doc = np.searchsorted(bounds, starts, "right") - 1

    def neighbours(self, k: int) -> np.ndarray:
        """Where a run of k words begins."""
        n = len(self.doc) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


class Head:
    """Frequent words with their CRC states, frequent pairs (places of two of the first ``pair_words`` words) with their CRCs.

    Plain arrays, so that it travels as a broadcast variable.
    """

    def __init__(self, words: list[bytes], states: list[int], pair_words: int, pairs: list[tuple[int, int, int]] = ()):
        self.words, self.states, self.pair_words = words, np.array(states, np.uint32), pair_words
        self.pair = np.full(pair_words * pair_words, -1, np.int32)
        self.pair_states = np.array([s for _, _, s in pairs], np.uint32)
        for i, (a, b, _) in enumerate(pairs):
            self.pair[a * pair_words + b] = i

    def places(self, w: Words) -> np.ndarray:
        """Place in the head of each word, -1 for the tail."""
        if not self.words:
            return np.full(len(w.words), -1, np.int64)
        return pc.fill_null(pc.index_in(w.words, pa.array(self.words, pa.large_binary())), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def frequent(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the pair that begins at each of these words, among all that the first head words can form; -1 for others."""
        a, b = place[at], place[at + 1]
        both = (a >= 0) & (a < self.pair_words) & (b >= 0) & (b < self.pair_words)
        return np.where(both, a * self.pair_words + b, -1)


def crcs(w: Words, head: Head, shifts: Shifts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three words: the word that each begins with, and its CRC-32."""
    place = head.places(w)
    one, tail = np.zeros(len(place), np.uint32), np.flatnonzero(place < 0)
    one[place >= 0] = head.states[place[place >= 0]]
    if len(tail):
        found = w.words.take(pa.array(tail)).dictionary_encode()
        direct = np.array([zlib.crc32(x) for x in found.dictionary.to_pylist()], np.uint32)
        one[tail] = direct[found.indices.to_numpy()]
    yield np.arange(len(one)), one
    # The CRC of a space and the word, and the bytes of both.
    linked, wide = shifts.move(np.full(len(one), zlib.crc32(b" "), np.uint32), w.sizes) ^ one, w.sizes + 1
    at = w.neighbours(2)
    number = head.frequent(place, at)
    known = np.full(len(at), -1, np.int64)
    known[number >= 0] = head.pair[number[number >= 0]]
    two = np.zeros(len(one), np.uint32)
    two[at[known >= 0]] = head.pair_states[known[known >= 0]]
    rest = at[known < 0]
    two[rest] = shifts.move(one[rest], wide[rest + 1]) ^ linked[rest + 1]
    yield at, two[at]
    at = w.neighbours(3)
    yield at, shifts.move(two[at], wide[at + 2]) ^ linked[at + 2]


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows with the largest ``n``: as many levels of n, sixteenths of a doubling, as have at most ``most`` rows together.

    The levels' sizes alone come to the driver, a thousand numbers at most; no task gathers the first rows of all others.
    """
    level = F.floor(16 * F.log2(F.col("n").cast("double")))
    sizes, lowest, total = dict(counts.groupBy(level).count().collect()), None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        lowest = k
    return counts.filter(F.lit(False) if lowest is None else level >= lowest)


def frequent_words(texts: DataFrame, r: Resampling) -> Head:
    """The most frequent words, counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            w = Words(t["text"])
            got = pc.value_counts(w.words.filter(pa.array(w.sizes <= r.head_bytes)))
            yield pa.RecordBatch.from_arrays([got.field("values").cast(pa.binary()), got.field("counts")], ["word", "n"])

    counts = cut(texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = most_frequent(counts, r.head_words).orderBy(F.col("n").desc(), "word").select("word", F.crc32("word").alias("state")).collect()
    return Head([bytes(x.word) for x in top], [x.state for x in top], min(r.pair_words, len(top)))


def frequent_pairs(texts: DataFrame, head: Head, r: Resampling) -> Head:
    """``head`` with the most frequent pairs of its first words, counted over all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(head)
    side = head.pair_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, np.int64)
        for t in chunks(batches):
            w = Words(t["text"])
            number = sent.value.frequent(sent.value.places(w), w.neighbours(2))
            total += np.bincount(number[number >= 0], minlength=side * side)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["pair", "n"])

    counts = cut(texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    top = [x.pair for x in most_frequent(counts, r.head_pairs).select("pair").collect()]
    pairs = [(p // side, p % side, zlib.crc32(b" " + head.words[p % side], int(head.states[p // side]))) for p in top]
    return Head(head.words, head.states.tolist(), side, pairs)


def bucket_counts(texts: DataFrame, head, buckets: int) -> dict[int, int]:
    """Features in each bucket; ``head`` is a broadcast variable. At most ``buckets`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for t in chunks(batches):
            for _, crc in crcs(Words(t["text"]), head.value, shifts):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {x.bucket: x.n for x in counts.collect()}


def gains(spark: SparkSession, corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """The gain of each bucket: floor of 1000 times the log ratio of smoothed frequencies."""
    rows = spark.createDataFrame([(b, float(corpus.get(b, 0)), float(target.get(b, 0))) for b in range(buckets)], "bucket int, s double, t double")
    all_s, all_t = float(sum(corpus.values())), float(sum(target.values()))
    ratio = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    got = rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for x in got:
        out[x.bucket] = x.gain
    return out


def weighed(docs: DataFrame, head, gain: np.ndarray) -> DataFrame:
    """n_words, n_features and weight beside the rows' own columns but ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for t in chunks(batches):
            w = Words(t["text"])
            n_words = np.bincount(w.doc, minlength=w.n_docs)
            n, weight = np.zeros(w.n_docs, np.int64), np.zeros(w.n_docs, np.int64)
            for at, crc in crcs(w, head.value, shifts):
                n += np.bincount(w.doc[at], minlength=w.n_docs)
                total = np.concatenate(([0], np.cumsum(sent.value[crc % np.uint32(len(sent.value))])))
                ends = np.searchsorted(w.doc[at], np.arange(w.n_docs + 1))
                weight += total[ends[1:]] - total[ends[:-1]]
            columns = [t[c] for c in rest] + [pa.array(x) for x in (n_words, n, weight)]
            yield from pa.table(columns, [*rest, "n_words", "n_features", "weight"]).to_batches()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{schema}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... by falling score, ties to the smaller doc_id, null beyond ``n``.

    Rows are dealt by ranges of their order, so each task numbers its own; the tasks' sizes add up on the driver. A number
    that no two rows share ends the order, so that rows alike in all else spread over tasks, too.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row number")]
    rows = rows.withColumn("row number", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1)))
    sizes, before, so_far = {x.part: x.n for x in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}, [], 0
    for p in sorted(sizes):
        before.append((p, so_far))
        so_far += sizes[p]
    offsets = rows.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("place") + 1
    return rows.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= n, rank)).drop("row number", "at", "part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", r: Resampling = Resampling()) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (of the drawn, else null)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts, target = docs.select("text"), target.select(F.col(target_col).alias("text"))
    head = spark.sparkContext.broadcast(frequent_pairs(texts, frequent_words(texts, r), r))
    gain = gains(spark, bucket_counts(texts, head, r.buckets), bucket_counts(target, head, r.buckets), r.buckets)
    digest = F.sha2(F.concat(F.lit(f"{r.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = cut(weighed(docs, head, gain).withColumn("score", F.col("weight") + noise))
    enough = F.col("n_words") >= r.least_words
    n = rows.filter(enough).count()
    few = rows.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.filter(enough), r.percent * n // 100).unionByName(few)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a feature by half bytes: what a step makes of each value of the four low bits.
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
SQL = {
    "op11_importance": f"""
with words as (
  select doc_id, false as target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
  union all
  select item_id, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
spots as (select doc_id, target, w, unnest(range(1, len(w) + 1)) as i from words),
runs as (
  select doc_id, target, array_to_string(w[i:i + k - 1], ' ') as f from spots, (values (1), (2), (3)) as n(k) where i + k - 1 <= len(w)),
counted as (select doc_id, target, f, count(*) as n from runs group by all),
features as (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, flatten([[('0x' || h[2 * j])::bigint, ('0x' || h[2 * j - 1])::bigint] for j in range(1, len(h) // 2 + 1)])),
    lambda c, x: xor({_NIBBLES}[1 + (xor(c, x) & 15)]::bigint, c >> 4)), 4294967295::bigint) % 10000 as bucket
  from (select distinct f, string_split(hex(encode(f)), '') as h from counted)),
bucketed as (select doc_id, target, bucket, n from counted join features using (f)),
totals as (select bucket, sum(case when target then 0 else n end) as s, sum(case when target then n else 0 end) as t from bucketed group by bucket),
every as (select sum(s) as s_all, sum(t) as t_all from totals),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain from totals, every),
weights as (
  select doc_id, sum(n) as n_features, sum(n * gain) as weight from bucketed join gain using (bucket) where not target group by doc_id),
scored as (
  select d.doc_id, len(d.w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || cast(d.doc_id as varchar)), 1, 8))::bigint::double + 0.5) / 4294967296)))::bigint as score
  from words d left join weights using (doc_id) where not d.target)
select doc_id, n_features, weight, score,
  case when n_words >= 20 and row_number() over (partition by n_words >= 20 order by score desc, doc_id) <= 5 * (count(*) filter (n_words >= 20) over ()) // 100
    then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end as rank
from scored
"""
}
QUERIES = {"op11_importance": op11_importance}
