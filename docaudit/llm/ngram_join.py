"""Exact n-gram Jaccard join by signature trees.

A text is the set of its distinct k-word shingles. Texts with equal sets are one class.
Two classes link when num / den is at most |intersection| / |union|.

1. Routing. Sets that link differ in at most H shingles, H following from their sizes. Shingles are
   dealt by hash to more than H parts, so a linked pair agrees on whole parts; classes that agree on
   a part (of the same size scheme) are candidates, and candidates that hang together form a block.
   Blocks are narrowed by trees over bitmaps, a small part of the sets: what no pair of bitmaps that allows a link
   connects falls apart, and classes that are left alone link with nothing, so their sets are not shuffled.
2. Trees. Within a block, sets are leaves of a signature tree: a node holds the OR of its sets'
   token bitmaps and their range of sizes. A dual traversal descends only into pairs of nodes
   whose greatest possible overlap reaches the threshold, and skips pairs whose sets are
   connected already. At the leaves the overlap is exact.
3. Blocks beyond SUB_BLOCK classes or SUB_SHINGLES shingles are split: each split is joined with itself,
   then, if they are few, one set of each component found. Where a block has several components left, trees over the bitmaps
   alone, a small part of the sets, are traversed for each size interval of the block; in a block of more than WIDE
   splits for each of its parts instead, on one of which a link agrees still. Groups that one component or
   split has alone are left out, those of the same sets taken once, and large ones joined as pairs of their splits.
   Of the pairs that are left, each set's likeliest one in every other component is checked exactly, then all
   others whose components are still apart.

Shingles and sets are known by 64-bit hashes. Defined results: null texts and texts without words
have the empty set and link with nothing; fewer words than k make one shingle of the whole
sequence; an empty table gives no rows; repeated rows each get their row; a class takes the smallest
doc_id of its rows; rows without an id link like others, and only a component of such rows has no id;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, contracted
from .common import chunks, cut, not_in, only_in, release, small_batches, split_by, table, texts, tidy, without_rows, written

#: A task holds the sets of one split at a time: about so many classes and shingles, and never less than one set.
SUB_BLOCK, SUB_SHINGLES = 4096, 1 << 20
#: Bitmaps are smaller, so a task holds more of them; beyond WIDE splits a block is joined by its parts.
SUB_MAPS, WIDE = 16384, 128
#: A size interval of a block is narrowed by pairs of its splits up to so many splits; beyond them it stays together.
NARROW = 16
LEAF, MAP_LEAF, FANOUT = 32, 128, 8
MAX_BITS = 1 << 16
RUN_BITS = 10

U = np.uint64


@dataclass(frozen=True)
class Join:
    k: int = 3
    num: int = 90
    den: int = 100


# Shingles ---------------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, k: int):
        self.k = k
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.byte = mix64(np.arange(1, 257, dtype=np.uint64))
        self.step = 0x9E3779B97F4A7C15 | 1
        self.back = pow(self.step, -1, 1 << 64)
        self.power = self.unpower = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, x in (("power", self.step), ("unpower", self.back)):
                a = np.full(2 * n, x, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def words(self, text: str) -> np.ndarray:
        a = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # bytes.lower() changes A-Z alone
        if not len(a):
            return np.zeros(0, np.uint64)
        edge = np.flatnonzero(np.diff(np.concatenate(([1], self.space[a].view(np.int8), [1]))))
        start, end = edge[::2], edge[1::2]
        self.grow(len(a))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte[a] * self.power[: len(a)], dtype=np.uint64)))
        return mix64((total[end] - total[start]) * self.unpower[start] + (end - start).astype(np.uint64))

    def __call__(self, text: str) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        k = min(self.k, len(w))
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h = h * U(0xD1342543DE82EF95) + mix64(w[i : len(w) - k + 1 + i] + U(i))
        return np.unique(mix64(h + U(k)))


def digest(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed integer."""
    return int(mix64(mix64(s).sum(dtype=np.uint64, keepdims=True) + U(len(s)))[0].astype(np.int64))


# Routing ----------------------------------------------------------------------------------------


class Schemes:
    """Size intervals; interval i's scheme serves pairs whose smaller set lies in it, the larger one there or in i + 1."""

    def __init__(self, join: Join):
        self.num, self.den = join.num, join.den
        self.bounds, self.parts, self.spare = [1], [], []

    def interval(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.extend()
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def extend(self) -> None:
        low = self.bounds[-1]
        self.bounds.append(max(low + 1, low * self.den // self.num + 1))
        top = self.bounds[-1] - 1
        differ = (self.den - self.num) * (top + top * self.den // self.num) // (self.den + self.num)
        # With r parts to spare, r + 1 parts agree at least. Sets with more than r empty parts have to
        # offer those too, so r is chosen to make such sets rare, and no larger than that needs.
        best = (2.0, 0)
        for r in range(differ + 9 if differ else 1):
            best = min(best, (self.too_many_empty(low, differ + 1 + r, r), r))
            if best[0] < 1e-4:
                break
        r = best[1]
        self.parts.append(differ + 1 + r)
        self.spare.append(r)

    @staticmethod
    def too_many_empty(n: int, parts: int, r: int) -> float:
        """About the probability that more than r of the parts get none of n shingles."""
        e = parts * np.exp(-n / parts)
        term = total = np.exp(-e)
        for k in range(1, r + 1):
            term *= e / k
            total += term
        return max(0.0, 1.0 - float(total))

    def bits(self, i: int) -> int:
        """Width of the bitmaps of sets that meet in scheme i: two bits or more for a shingle."""
        return min(MAX_BITS, max(64, 1 << (2 * self.bounds[i + 1] - 1).bit_length()))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        return np.concatenate([keys for _, keys in self.each(s)])

    def serving(self, n: int) -> tuple[int, ...]:
        own = self.interval(n)
        return (own, own - 1) if own else (own,)

    def each(self, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Schemes that serve the set, and its signatures in them."""
        out = []
        for i in self.serving(len(s)):
            p, r = self.parts[i], self.spare[i]
            h = mix64(s + U(i + 1))
            part = ((h >> U(32)) * U(p)) >> U(32)
            order = np.argsort(part, kind="stable")
            at = part[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            total = np.add.reduceat(h[order], first)
            where = at[first]
            if p - len(first) > r:  # too many empty parts: they count as signatures too
                empty = np.setdiff1d(np.arange(p, dtype=np.uint64), where)
                where, total = np.concatenate((where, empty)), np.concatenate((total, np.zeros(len(empty), np.uint64)))
            out.append((i, mix64(total + mix64(where + U(i << 32)))))
        return out


def set_rows(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, row_key, n, d per row: size and digest of its set (n = 0: none)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(join.k)
        for t in chunks(batches):
            sets = [shingle(x) for x in texts(t)]
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), t["row_key"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64())], schema=schema)

    return docs.mapInArrow(tidy(run), "doc_id long, row_key long, n long, d long")


def signature_rows(docs: DataFrame, join: Join) -> DataFrame:
    """key, d. Of equal keys in a chunk one row goes out; its other classes are tied to that one by a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, schemes = Shingler(join.k), Schemes(join)
        for t in chunks(batches, limit=4_000_000):
            sets = {digest(s): s for s in map(shingle, texts(t)) if len(s)}
            if not sets:
                continue
            keys = [schemes.signatures(s) for s in sets.values()]
            d = np.repeat(np.array(list(sets), np.int64), [len(x) for x in keys])
            key = np.concatenate(keys)
            order = np.lexsort((d, key))
            key, d = key[order], d[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            leader = d[np.flatnonzero(new)[np.cumsum(new) - 1]]
            tied = ~new & (d != leader)
            ties = np.unique(np.stack([d[tied], leader[tied]], 1), axis=0)
            tie = mix64(mix64(ties[:, 0].astype(np.uint64)) + ties[:, 1].astype(np.uint64))
            key, d = np.concatenate((key[new], tie, tie)), np.concatenate((d[new], ties[:, 0], ties[:, 1]))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(d)], ["key", "d"])

    return docs.mapInArrow(tidy(run), "key long, d long")


def candidate_edges(signatures: DataFrame) -> DataFrame:
    """src, dst: edges that connect the classes of each key. Rows stream by; none are gathered.

    A partition contracts its edges before they are dealt anew: a class in many keys with a large group leaves it few edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0
        for b in batches:
            key, d = b["key"].to_numpy(), b["d"].to_numpy()
            if not len(key):
                continue
            new = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
            run_no = np.cumsum(new)
            heads = np.concatenate(([last], d[new]))
            leader = heads[run_no]
            last_key, last = key[-1], int(leader[-1])
            at = np.flatnonzero(d != leader)
            if len(at):
                pairs = np.unique(np.stack([d[at], leader[at]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return contracted(signatures.repartition("key").sortWithinPartitions("key", "d"), run, "a long, b long", roots=False).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


# Trees ------------------------------------------------------------------------------------------


class Forest:
    """Union-find that keeps the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class SignatureTree:
    """Levels of nodes over sets sorted by size; level 0 nodes hold up to ``leaf`` sets."""

    def __init__(self, size: np.ndarray, maps: np.ndarray, leaf: int = LEAF):
        self.size, self.map, self.leaf = size, maps, leaf
        #: Tokens of a set that share a bit with another one of it.
        self.hidden = self.size - np.bitwise_count(self.map).sum(1).astype(np.int64)
        self.levels = []
        span, m, lo, hi, hid = leaf, self.map, self.size, self.size, self.hidden
        while True:
            at = np.arange(0, len(m), span)
            m, lo, hi, hid = np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hid, at)
            self.levels.append((m, lo, hi, hid))
            if len(m) <= 1:
                return
            span = FANOUT


def bitmaps(size: np.ndarray, number: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap for each set; ``number`` gives each token of all sets its number. With more numbers than bits, bits are shared."""
    maps = np.zeros((len(size), -(-bits // 64)), np.uint64)
    owner, bit = np.repeat(np.arange(len(size)), size), number % bits
    np.bitwise_or.at(maps, (owner, bit >> 6), U(1) << (bit & 63).astype(np.uint64))
    return maps


def greatest_overlap(x, y) -> np.ndarray:
    """Of pairs of nodes (or sets); x and y are (map, least size, greatest size, hidden)."""
    overlap = np.bitwise_count(x[0][:, None] & y[0][None]).sum(2, dtype=np.int64) + np.minimum(x[3][:, None], y[3][None])
    return np.minimum(overlap, np.minimum(x[2][:, None], y[2][None]))


def reachable(x, y, join: Join) -> np.ndarray:
    """Pairs of nodes (or sets) whose overlap can reach the threshold."""
    least = np.maximum(x[1][:, None] + y[1][None], 0)
    # num/den <= o / (|x| + |y| - o), and neither set may be larger than den/num of the other.
    fits = (join.den + join.num) * greatest_overlap(x, y) >= join.num * least
    return fits & (join.den * x[2][:, None] >= join.num * y[1][None]) & (join.den * y[2][None] >= join.num * x[1][:, None])


def traverse(a: SignatureTree, b: SignatureTree, same: bool, join: Join) -> Iterator[tuple[slice, slice]]:
    """Pairs of leaves of two trees that can hold linked sets; of one tree with itself each pair once."""
    todo = [(len(a.levels) - 1, len(b.levels) - 1, 0, 0)]
    while todo:
        la, lb, i, j = todo.pop()
        if la == 0 and lb == 0:
            yield slice(i * a.leaf, (i + 1) * a.leaf), slice(j * b.leaf, (j + 1) * b.leaf)
            continue
        ka = range(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[la - 1][1]))) if la else range(i, i + 1)
        kb = range(j * FANOUT, min((j + 1) * FANOUT, len(b.levels[lb - 1][1]))) if lb else range(j, j + 1)
        da, db = max(0, la - 1), max(0, lb - 1)
        ok = reachable(*(tuple(v[k[0] : k[-1] + 1] for v in t.levels[d]) for t, d, k in ((a, da, ka), (b, db, kb))), join)
        for x, y in zip(*np.nonzero(ok), strict=True):
            if not same or ka[x] <= kb[y]:
                todo.append((da, db, ka[x], kb[y]))


def surviving_pairs(size: np.ndarray, maps: np.ndarray, label: np.ndarray, side: np.ndarray | None, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of two sets with different labels whose bitmaps allow a link, and their greatest overlap; with ``side`` only across the sides."""
    groups = [np.argsort(size, kind="stable")] if side is None else [o[np.argsort(size[o], kind="stable")] for o in (np.flatnonzero(side == 0), np.flatnonzero(side == 1))]
    out = [(np.zeros(0, np.int64),) * 3]
    if all(len(g) for g in groups):
        trees = [SignatureTree(size[g], maps[g], MAP_LEAF) for g in groups]
        for ia, jb in traverse(trees[0], trees[-1], side is None, join):
            ga, gb = groups[0][ia], groups[-1][jb]
            own = [(t.map[k], t.size[k], t.size[k], t.hidden[k]) for t, k in ((trees[0], ia), (trees[-1], jb))]
            x, y = np.nonzero(reachable(*own, join) & (label[ga][:, None] != label[gb][None]))
            if len(x):
                out.append((ga[x], gb[y], greatest_overlap(*own)[x, y]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def tree_links(sets: list[np.ndarray], join: Join) -> Forest:
    """Components of sets under the join."""
    n = len(sets)
    forest = Forest(n)
    if n < 2:
        return forest
    sizes = np.array([len(s) for s in sets])
    group = np.lexsort((np.arange(n), sizes))
    tokens, number = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    bits = min(max(64, len(tokens)), MAX_BITS)
    tree = SignatureTree(sizes[group], bitmaps(sizes[group], np.concatenate([number[begin[i] : begin[i + 1]] for i in group]), bits))
    exact = len(tokens) <= bits
    for ia, jb in traverse(tree, tree, True, join):
        ga, gb = group[ia], group[jb]
        if len({forest.root(int(x)) for x in ga} | {forest.root(int(x)) for x in gb}) == 1:
            continue
        own = [(tree.map[k], tree.size[k], tree.size[k], tree.hidden[k]) for k in (ia, jb)]
        for x, y in zip(*np.nonzero(reachable(*own, join)), strict=True):
            p, q = int(ga[x]), int(gb[y])
            if p == q or forest.root(p) == forest.root(q):
                continue
            if exact or linked(sets[p], sets[q], join):
                forest.join(p, q)
    return forest


def linked(a: np.ndarray, b: np.ndarray, join: Join) -> bool:
    return (join.den + join.num) * len(np.intersect1d(a, b, assume_unique=True)) >= join.num * (len(a) + len(b))


def map_forest(size: np.ndarray, maps: np.ndarray, side: np.ndarray | None, join: Join) -> Forest:
    """Components of sets under the pairs whose bitmaps allow a link; with ``side`` only pairs across the sides count."""
    forest = Forest(len(size))
    groups = [np.argsort(size, kind="stable")] if side is None else [o[np.argsort(size[o], kind="stable")] for o in (np.flatnonzero(side == 0), np.flatnonzero(side == 1))]
    if not all(len(g) for g in groups):
        return forest
    trees = [SignatureTree(size[g], maps[g], MAP_LEAF) for g in groups]
    for ia, jb in traverse(trees[0], trees[-1], side is None, join):
        ga, gb = groups[0][ia], groups[-1][jb]
        if len({forest.root(int(x)) for x in (*ga, *gb)}) == 1:
            continue
        own = [(t.map[k], t.size[k], t.size[k], t.hidden[k]) for t, k in ((trees[0], ia), (trees[-1], jb))]
        for x, y in zip(*np.nonzero(reachable(*own, join)), strict=True):
            forest.join(int(ga[x]), int(gb[y]))
    return forest


# The join ---------------------------------------------------------------------------------------


def by_run(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that follow each other with equal keys, one frame at a time."""
    parts: list[pd.DataFrame] = []
    for b in batches:
        pdf = b.to_pandas()
        if not len(pdf):
            continue
        change = np.flatnonzero((pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(1)) + 1
        for i, j in pairwise([0, *change, len(pdf)]):
            piece = pdf.iloc[i:j]
            if parts and (parts[-1][keys].iloc[-1] != piece[keys].iloc[0]).any():
                yield pd.concat(parts) if len(parts) > 1 else parts[0]
                parts = []
            parts.append(piece)
    if parts:
        yield pd.concat(parts) if len(parts) > 1 else parts[0]


def join_groups(rows: DataFrame, keys: list[str], join: Join, kept: str = "") -> DataFrame:
    """src, dst: every class with the root of its component among the rows of equal keys. Rows: the keys, d, shingles (bytes).

    ``kept`` (as a schema) names columns of the rows that go out with them, so that sets need not be joined with their roots again.
    """
    schema = f"src long, dst long{', ' * bool(kept)}{kept}"
    names = [x.split()[0] for x in kept.split(", ")] if kept else []
    binary = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for g in by_run(batches, keys):
            g = g.drop_duplicates("d").sort_values("d")
            forest = tree_links([np.frombuffer(x, np.uint64) for x in g.shingles], join)
            d = g.d.to_numpy()
            held.append(pd.DataFrame({"src": d, "dst": d[[forest.root(i) for i in range(len(d))]], **{c: g[c].to_numpy() for c in names}}))
            weight += len(d) + (g.shingles.str.len().sum() >> 8 if names else 0)
            if weight > 50_000:
                yield pa.RecordBatch.from_pandas(pd.concat(held), schema=binary, preserve_index=False)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(pd.concat(held), schema=binary, preserve_index=False)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "d").mapInArrow(tidy(run), schema)


def surviving(rows: DataFrame, keys: list[str], join: Join) -> DataFrame:
    """a, b, overlap: pairs of classes with different labels that the trees of the rows of equal keys leave.

    Rows: the keys, d, n, label, map (bytes of the bitmap), and side if pairs across sides alone are wanted.
    """
    crossing = "side" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_run(batches, keys):
            maps = np.stack([np.frombuffer(x, np.uint64) for x in g["map"]])
            d = g.d.to_numpy()
            x, y, overlap = surviving_pairs(g.n.to_numpy(), maps, g.label.to_numpy(), g.side.to_numpy() if crossing else None, join)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(d[x], d[y])), pa.array(np.maximum(d[x], d[y])), pa.array(overlap)], ["a", "b", "overlap"])

    pairs = rows.repartition(*keys).sortWithinPartitions(*keys, "d").mapInArrow(tidy(run), "a long, b long, overlap long")
    return pairs.groupBy("a", "b").agg(F.min("overlap").alias("overlap"))


def checked(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that link. sets: d, n, shingles.

    Sets are dealt to buckets of about half of what a task holds, and pairs to pairs of buckets. A group gets each of its sets once,
    however many pairs the set is in, and then its pairs one batch after another.
    """
    pairs = pairs.select("a", "b")
    used = written(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct().join(sets.select("d", "n"), "d"))
    total = used.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).first()
    buckets = max(1, -(-2 * (total.n or 0) // SUB_SHINGLES), -(-2 * total.c // SUB_BLOCK))
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(2)), F.lit(buckets))
    dealt = pairs.withColumn("i", bucket("a")).withColumn("j", bucket("b"))
    needed = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("d")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    given = needed.join(sets.select("d", "shingles"), "d").select("i", "j", F.col("d").alias("a"), none("long").alias("b"), "shingles")
    rows = given.unionByName(dealt.withColumn("shingles", none("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            out = []
            for i, j, a, b, s in zip(*(batch[c] for c in ("i", "j", "a", "b", "shingles")), strict=True):
                now, a, b = (i.as_py(), j.as_py()), a.as_py(), b.as_py()
                if now != group:
                    group, held = now, {}
                if b is None:
                    held[a] = np.frombuffer(s.as_py(), np.uint64)
                elif linked(held[a], held[b], join):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    # A group's sets come first: they have no b.
    return rows.repartition("i", "j").sortWithinPartitions("i", "j", F.col("b").asc_nulls_first()).mapInArrow(tidy(run), "a long, b long")


def split_count(most: int | None = None):
    """Splits that a group needs, from its classes and their sizes n; shingles count as those of SUB_BLOCK classes do."""
    most = most or SUB_BLOCK
    return F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") / (SUB_SHINGLES * most // SUB_BLOCK)))


def set_keys(sets: DataFrame, join: Join) -> DataFrame:
    """key, bits, d, label, split, n for every group of every set of rows (d, shingles, label, block, splits, split), and
    ``map``, the set's bitmap of so many bits, in one row for each width. Groups are the size intervals of a block, or its parts if it is wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = Schemes(join)
        for b in batches:
            for d, shingles, label, block, splits, split in zip(*(b[c].to_pylist() for c in ("d", "shingles", "label", "block", "splits", "split")), strict=True):
                s = np.frombuffer(shingles, np.uint64)
                if splits > WIDE:
                    groups = schemes.each(s)
                else:
                    groups = [(i, mix64(mix64(np.array([block], np.int64).astype(np.uint64)) + U(i))) for i in schemes.serving(len(s))]
                drawn: set[int] = set()
                for i, keys in groups:
                    bits = schemes.bits(i)
                    maps: list[bytes | None] = [None] * len(keys)
                    if bits not in drawn:
                        maps[0] = bitmaps(np.array([len(s)]), (mix64(s) % U(bits)).astype(np.int64), bits).tobytes()
                        drawn.add(bits)
                    same = [pa.array(np.full(len(keys), x, np.int64)) for x in (bits, d, label, split, len(s))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *same, pa.array(maps, pa.binary())], ["key", "bits", "d", "label", "split", "n", "map"])

    columns = ["d", "shingles", "label", "block", "splits", "split"]
    return sets.select(columns).mapInArrow(tidy(run), "key long, bits long, d long, label long, split long, n long, map binary")


def shingle_sets(docs: DataFrame, join: Join) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(join.k)
        for t in chunks(batches):
            sets = [shingle(x) for x in texts(t)]
            yield pa.RecordBatch.from_arrays([t["row_key"].combine_chunks(), pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.large_binary() if sum(map(len, sets)) > 1 << 27 else pa.binary())], ["row_key", "d", "shingles"])

    return docs.mapInArrow(tidy(run), "row_key long, d long, shingles binary")


def map_rows(docs: DataFrame, join: Join) -> DataFrame:
    """row_key, d, n, level (its size interval), map (bytes of its bitmap, two bits or more for a shingle)."""
    schema = pa.schema([*((x, pa.int64()) for x in ("row_key", "d", "n", "level")), ("map", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bounds = Shingler(join.k), [1]
        for t in chunks(batches):
            sets = [shingle(x) for x in texts(t)]
            while bounds[-1] <= max(map(len, sets)):  # the intervals of Schemes, which takes long over the parts of very large sets
                bounds.append(max(bounds[-1] + 1, bounds[-1] * join.den // join.num + 1))
            levels = [max(0, bisect_right(bounds, len(s)) - 1) for s in sets]
            maps = []
            for s, i in zip(sets, levels, strict=True):
                bits = min(MAX_BITS, max(64, 1 << (2 * (bounds[i + 1] if len(s) else 1) - 1).bit_length()))
                maps.append(bitmaps(np.array([len(s)]), (mix64(s) % U(bits)).astype(np.int64), bits).tobytes())
            columns = [digest(s) for s in sets], [len(s) for s in sets], levels
            yield pa.RecordBatch.from_arrays([t["row_key"].combine_chunks(), *(pa.array(c, pa.int64()) for c in columns), pa.array(maps, pa.binary())], schema=schema)

    return docs.mapInArrow(tidy(run), "row_key long, d long, n long, level long, map binary")


def folded(data: bytes, words: int) -> np.ndarray:
    """A bitmap as one of so many words of 64 bits, a power of two."""
    return np.bitwise_or.reduce(np.frombuffer(data, np.uint64).reshape(-1, words), axis=0)


def map_edges(rows: DataFrame, keys: list[str], join: Join) -> DataFrame:
    """src, dst: edges that connect the classes that pairs of bitmaps connect among the rows of equal keys. Rows: the keys, d, n,
    map (the widest are folded to the narrowest), and side if pairs across sides alone are wanted."""
    crossing = "side" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_run(batches, keys):
            g = g.drop_duplicates("d").sort_values("d")
            d, words = g.d.to_numpy(), int(g["map"].str.len().min()) >> 3
            forest = map_forest(g.n.to_numpy(), np.stack([folded(x, words) for x in g["map"]]), g.side.to_numpy() if crossing else None, join)
            root = np.array([forest.root(x) for x in range(len(d))])
            tied = root != np.arange(len(d))
            yield pa.RecordBatch.from_arrays([pa.array(d[tied]), pa.array(d[root[tied]])], ["src", "dst"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "d").mapInArrow(tidy(run), "src long, dst long")


def narrowed(docs: DataFrame, candidates: DataFrame, join: Join) -> DataFrame:
    """d, block: what is left of the blocks where pairs of bitmaps that allow no link do not count. candidates: d, block, row_key.

    Sets that link meet in the size interval of the smaller one. Classes that nothing is connected with are left out.
    """
    hit, _ = split_by(docs, candidates.select("row_key"), "row_key")
    maps = written(map_rows(hit, join).join(candidates.select("row_key", "d", "block"), ["row_key", "d"]).drop("row_key"))
    rows = maps.withColumn("level", F.explode(F.when(F.col("level") > 0, F.array("level", F.col("level") - 1)).otherwise(F.array("level"))))
    counted = rows.groupBy("block", "level").agg(split_count(SUB_MAPS).alias("splits"), F.min("d").alias("low"), F.max("d").alias("high"))
    groups = written(counted.filter("low < high").select("block", "level", "splits", "low"))
    rows = rows.join(groups, ["block", "level"]).withColumn("split", F.pmod(F.xxhash64("d"), F.col("splits")))
    edges = map_edges(rows.filter(F.col("splits") <= NARROW).select("block", "level", "split", "d", "n", "map"), ["block", "level", "split"], join)
    if not groups.filter("splits > 1").isEmpty():
        several = groups.filter((F.col("splits") > 1) & (F.col("splits") <= NARROW))
        each = several.select("block", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("i"), "splits")
        both = each.select("block", "level", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("j")).filter("i < j")
        of_split = rows.filter("splits > 1").select("block", "level", "split", "d", "n", "map")
        sides = [both.join(of_split.withColumnRenamed("split", name), ["block", "level", name]).withColumn("side", F.lit(side)).select("block", "level", "i", "j", "d", "n", "map", "side") for side, name in enumerate("ij")]
        edges = edges.unionByName(map_edges(sides[0].union(sides[1]), ["block", "level", "i", "j"], join))
        edges = edges.unionByName(rows.filter((F.col("splits") > NARROW) & (F.col("d") != F.col("low"))).select(F.col("d").alias("src"), F.col("low").alias("dst")))
    # Contracted in the task that makes them, edges would take a second worker for each task, which stays for the next stages.
    return connected_components(written(edges)).select(F.col("node").alias("d"), F.col("component").alias("block"))


def merged_labels(found: DataFrame, merged: DataFrame) -> DataFrame:
    """node, component of ``found`` with components renamed by ``merged`` (component, head)."""
    return written(found.join(merged, "component", "left").select("node", F.coalesce("head", "component").alias("component")))


def link_classes(docs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """node, component over the digests of classes that link with another one. classes: d, n, rep."""
    blocks = connected_components(candidate_edges(signature_rows(docs, join)))
    blocks = blocks.select(F.col("node").alias("d"), F.col("component").alias("block"))
    with small_batches(docs.sparkSession):
        candidates = written(classes.join(blocks, "d").select("d", "block", F.col("rep.row_key").alias("row_key")))
        release(docs.sparkSession)  # the signatures, much more than the sets, are not needed any more
        return link_blocks(docs, classes, narrowed(docs, candidates, join), join)


def link_blocks(docs: DataFrame, classes: DataFrame, blocks: DataFrame, join: Join) -> DataFrame:
    """node, component over the digests of classes in blocks. blocks: d, block."""
    candidates = written(classes.join(blocks, "d").select("d", "n", "block", F.col("rep.row_key").alias("row_key")))
    # Rows that the filter lets through by chance fall out in the join with the candidates; texts need no shuffle for that.
    sets = shingle_sets(split_by(docs, candidates.select("row_key"), "row_key")[0], join)
    sizes = candidates.groupBy("block").agg(split_count().alias("splits"))
    rows = candidates.join(sizes, "block").withColumn("split", F.pmod(F.xxhash64("d"), F.col("splits")))
    rows = rows.join(sets, ["row_key", "d"]).select("block", "splits", "split", "d", "n", "shingles")
    # Every class is in one group, so its root there is its component so far. Sets stay where they are from here on.
    kept = "block long, splits long, split long, n long, shingles binary"
    first = cut(join_groups(rows, ["block", "split"], join, kept).withColumn("shingles", F.when(F.col("splits") > 1, F.col("shingles"))))
    found = written(first.select(F.col("src").alias("node"), F.col("dst").alias("component"), "block", "splits", "n"))
    large = first.filter("splits > 1").select(F.col("src").alias("d"), F.col("dst").alias("label"), "block", "splits", "split", "n", "shingles")
    placed = found.filter("splits > 1").select(F.col("node").alias("d"), "component", "block", "splits", "n")
    found = found.select("node", "component")
    if placed.isEmpty():
        return found
    # One set of each component, grouped again per block, where that leaves half of the splits or fewer: with more of them
    # hardly two sets that link would meet.
    heads = placed.filter("d = component")
    count = heads.groupBy("block").agg(split_count().alias("parts"), F.first("splits").alias("splits")).filter("2 * parts <= splits").select("block", "parts")
    heads = written(heads.join(count, "block").select("d", "block", F.pmod(F.xxhash64("d", F.lit(1)), F.col("parts")).alias("split")))
    if not heads.isEmpty():
        merged = join_groups(only_in(large.select("d", "shingles"), heads.select("d"), "d").join(heads, "d"), ["block", "split"], join)
        merged = written(merged.filter("src <> dst").select(F.col("src").alias("component"), F.col("dst").alias("head")))
        moved = written(found.join(merged, "component").select(F.col("node").alias("d"), "head"))
        found = merged_labels(found, merged)
        maybe, same = split_by(large, moved.select("d"), "d")
        large = same.unionByName(maybe.join(moved, "d", "left").withColumn("label", F.coalesce("head", "label")).select(large.columns))
        placed = placed.drop("component").join(found.withColumnRenamed("node", "d"), "d")
    # Links across splits, where a block has several components left.
    closed = placed.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low = high").select("block")
    large = cut(not_in(large, written(placed.join(closed, "block", "left_semi").select("d")), "d"))
    if large.isEmpty():
        return found
    keys = cut(set_keys(large, join))
    ends = [f(c).alias(n) for c in ("label", "split") for f, n in ((F.min, f"low_{c}"), (F.max, f"high_{c}"))]
    mixed = keys.groupBy("key").agg(*ends, split_count(SUB_MAPS).alias("splits"), F.struct(F.bit_xor(F.xxhash64("d")), F.count(F.lit(1)), F.min("d"), F.max("d")).alias("members"))
    mixed = mixed.filter("low_label < high_label and low_split < high_split").groupBy("members").agg(F.min(F.struct("key", "splits")).alias("k")).select("k.*")
    maps = keys.filter("map is not null").select("d", "bits", "map")
    mixed = keys.drop("map", "split").join(mixed, "key").withColumn("split", F.pmod(F.xxhash64("d"), F.col("splits"))).join(maps, ["d", "bits"])
    mixed = cut(mixed.select("key", "splits", "split", "d", "n", "label", "map"))
    pairs = surviving(mixed.drop("splits"), ["key", "split"], join)
    if not mixed.filter("splits > 1").isEmpty():
        # Pairs of the splits of one part: only parts beyond what a task holds have more than one.
        splits = mixed.filter("splits > 1").select("key", "split").distinct()
        both = splits.select("key", F.col("split").alias("i")).join(splits.select("key", F.col("split").alias("j")), "key").filter("i < j")
        sides = [both.join(mixed.drop("splits").withColumnRenamed("split", name), ["key", name]).withColumn("side", F.lit(side)).select("key", "i", "j", "d", "n", "label", "map", "side") for side, name in enumerate("ij")]
        pairs = pairs.unionByName(surviving(sides[0].union(sides[1]), ["key", "i", "j"], join))
    pairs = written(pairs)

    def apart(found: DataFrame) -> DataFrame:
        """Pairs whose components are still apart, with the components."""
        label_of = lambda c, n: found.select(F.col("node").alias(c), F.col("component").alias(n))
        return pairs.join(label_of("a", "of_a"), "a").join(label_of("b", "of_b"), "b").filter("of_a <> of_b")

    def with_links(found: DataFrame, links: DataFrame) -> DataFrame:
        ends = apart(found).join(links, ["a", "b"], "left_semi").select("of_a", "of_b").distinct()
        merged = connected_components(written(ends), "of_a", "of_b")
        return merged_labels(found, merged.select(F.col("node").alias("component"), F.col("component").alias("head")))

    first = written(apart(found).groupBy("a", "of_b").agg(F.max_by("b", F.struct("overlap", "b")).alias("b")).select("a", "b"))
    found = with_links(found, written(checked(first, large, join)))
    rest = written(apart(found).join(first, ["a", "b"], "left_anti").select("a", "b"))
    return with_links(found, written(checked(rest, large, join)))


def row_key(id_col: str, text_col: str):
    """A hash of id and text; rows with equal ones repeat each other."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def near_rows(docs: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    """Per row: doc_id, row_key, n_shingles, component_id (smallest doc_id reachable by links), leader (row_key of that row)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row_key"))
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    rows = set_rows(docs, join).withColumn("row", F.monotonically_increasing_id())
    # Equal sets are gathered per run of rows first, so that a hot class is one row for each run.
    runs = cut(rows.groupBy("d", "n", F.shiftright("row", RUN_BITS).alias("run")).agg(F.collect_list(F.struct("doc_id", "row_key")).alias("ids"), F.min(one).alias("rep")))
    classes = written(runs.filter("n > 0").groupBy("d").agg(F.first("n").alias("n"), F.min("rep").alias("rep")))
    links = link_classes(docs, classes, join)
    of_label = classes.join(links.select(F.col("node").alias("d"), F.col("component").alias("label")), "d")
    smallest = of_label.groupBy("label").agg(F.min("rep").alias("first"))
    linked = of_label.join(smallest, "label").select("d", "first")
    resolved = classes.join(linked, "d", "left").select("d", F.coalesce("first", "rep").alias("first"))
    full = runs.filter("n > 0").join(resolved, "d").select(F.explode("ids").alias("r"), "n", "first")
    none = runs.filter("n = 0").select(F.explode("ids").alias("r"), "n").select("r", "n", F.col("r").alias("first"))
    out = ["r.doc_id", "r.row_key", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("leader")]
    return full.select(out).union(none.select(out))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return near_rows(docs, id_col, text_col, join).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join(k=5, num=80, den=100)) -> DataFrame:
    """One row of each component, of those with the smallest id, with all its columns; rows without shingles all stay."""
    found = written(near_rows(docs, id_col, text_col, join).filter("n_shingles > 0").select("row_key", "leader"))
    again = found.filter("row_key = leader").groupBy("row_key").count().filter("count > 1")
    gone = found.filter("row_key <> leader").select("row_key").distinct()
    return without_rows(docs, row_key(id_col, text_col), gone, again.select("row_key"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op3_ngram_join": """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s from words),
sized as (select doc_id, len(s) as n, s from sets),
classes as (select min(doc_id) as rep, n, any_value(s) as s from sized where n > 0 group by n, list_sort(s)),
shingles as (select rep, n, unnest(s) as f from classes),
links as (
  select a.rep as x, b.rep as y from shingles a join shingles b on a.f = b.f and a.rep < b.rep and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 190 * count(*) >= 90 * (a.n + b.n)),
edges as (select x, y from links union all select y, x from links),
reach as (select rep as a, rep as b from classes union select reach.a, edges.y from reach join edges on reach.b = edges.x),
component as (select b as rep, min(a) as component_id from reach group by b),
member as (select z.doc_id, c.rep from sized z join classes c on z.n = c.n and list_sort(z.s) = list_sort(c.s))
select z.doc_id, z.n as n_shingles, coalesce(c.component_id, z.doc_id) as component_id
from sized z left join member m using (doc_id) left join component c using (rep)
"""
}
QUERIES = {"op3_ngram_join": op3_ngram_join}
