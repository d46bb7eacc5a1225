"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. The flow routes the
words of each pattern to the quotas of its sources; reading a pattern a k-th time
costs more than the (k-1)-th, so repeats are spread before they pile up. The
pattern's routed words then become whole copies of documents: all of them as often
as the flow allows, and a seeded choice of documents once more.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is
a source of its own, sorted last; documents with no source at all (empty array) are not
taken; an empty table gives no rows; repeated rows are chosen together.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, cut, table

#: Hash ranges per pattern when the cut of the seeded choice is looked for.
BINS = 4096
#: Patterns and sources are planned on the driver; more than this many is an error.
MAX_PATTERNS = 50_000


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sorted sources; ``share`` of all words is wanted; no source or document beyond ``cap`` times."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    seed: int = 42


def source_targets(sizes: dict[str | None, int], mix: Mix) -> dict[str | None, float]:
    """Targets by weight; what is beyond cap x size is shared again by weight among the rest."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(mix.weights[i % len(mix.weights)]) for i, s in enumerate(order)}
    left, open_, out = mix.share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        over = [s for s in order if s in open_ and left * weight[s] / total > mix.cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in order if s in open_}
            break
        for s in over:
            out[s] = float(mix.cap * sizes[s])
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


def route(patterns: list[tuple[tuple, int]], targets: dict, cap: int) -> list[float]:
    """Words routed out of each pattern: min-cost flow by cheapest augmenting paths.

    Arcs: start -> pattern once per repetition k at cost k with the pattern's words as
    capacity; pattern -> each of its sources without limit; source -> end with its target.
    """
    sources = list(targets)
    at = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    arcs: list[list] = []  # to, capacity, cost; the reverse arc is the next or last one
    out: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]

    def arc(a: int, b: int, capacity: float, cost: float) -> None:
        out[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0.0, -cost])

    for p, (members, size) in enumerate(patterns):
        for k in range(cap):
            arc(0, 2 + p, float(size), float(k))
        for s in members:
            arc(2 + p, at[s], float("inf"), 0.0)
    for s in sources:
        arc(at[s], 1, targets[s], 0.0)
    while True:
        far, via, queue = {0: 0.0}, {}, [0]
        while queue:
            following = []
            for a in queue:
                for e in out[a]:
                    b, capacity, cost = arcs[e]
                    if capacity > 1e-6 and far[a] + cost < far.get(b, float("inf")) - 1e-12:
                        far[b], via[b] = far[a] + cost, (a, e)
                        following.append(b)
            queue = list(dict.fromkeys(following))
        if 1 not in far:
            break
        path, node = [], 1
        while node != 0:
            node, e = via[node]
            path.append(e)
        flow = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= flow
            arcs[e ^ 1][1] += flow
    return [sum(arcs[e ^ 1][1] for e in out[0] if arcs[e][0] == 2 + p) for p in range(len(patterns))]


def sized(docs: DataFrame, id_col: str, text_col: str, members, mix: Mix) -> DataFrame:
    """doc_id, size, pattern (sorted distinct sources, null last) and the seeded hash."""
    names = F.array_sort(F.array_distinct(members))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        names.alias("pattern"),
        F.xxhash64(F.lit(mix.seed), F.col(id_col).cast("long")).alias("h"),
    )


def bin_of(h):
    return F.shiftrightunsigned(h, 64 - 12).cast("int")


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row per pattern: copies of every document, and the hash up to which one copy more is taken.

    Also carries the first source's size and target. The result has at most MAX_PATTERNS rows.
    """
    spark = rows.sparkSession
    bins = cut(rows.groupBy("pattern", bin_of(F.col("h")).alias("bin")).agg(F.sum("size").alias("words")))
    found = bins.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted(((tuple(r.pattern), r.words) for r in found), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict = {}
    for members, words in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes, mix)
    routed = route(patterns, targets, mix.cap)
    lines = []
    for (members, words), flow in zip(patterns, routed, strict=True):
        copies = min(mix.cap, int((flow + 1e-6) // words)) if words else 0
        first = members[0] if members else None
        lines.append((list(members), copies, max(0.0, flow - copies * words), sizes.get(first, 0), float(targets.get(first, 0.0))))
    schema = pa.schema([("pattern", pa.list_(pa.string())), ("copies", pa.int32()), ("extra", pa.float64()), ("source_size", pa.int64()), ("target", pa.float64())])
    # An Arrow table: for Python rows executors would start workers of another kind, which stay.
    plans = spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, x, strict=True)) for x in lines], schema=schema))
    # The bin in which the extra words run out, and what is taken before it.
    order = W.Window.partitionBy("pattern").orderBy("bin")
    edge = (
        bins.withColumn("upto", F.sum("words").over(order))
        .join(F.broadcast(plans), "pattern")
        .filter(F.col("extra") > 0)
        .withColumn("before", F.col("upto") - F.col("words"))
        .filter((F.col("before") < F.col("extra")) & (F.col("upto") >= F.col("extra")))
        .groupBy("pattern").agg(F.min(F.struct("bin", "before", "extra")).alias("e"))
        .select("pattern", F.col("e.bin").alias("bin"), (F.col("e.extra") - F.col("e.before")).alias("rest"))
    )
    edge = cut(edge)  # a row per pattern
    inside = rows.withColumn("bin", bin_of(F.col("h"))).join(F.broadcast(edge), ["pattern", "bin"])
    inside = inside.groupBy("pattern", "bin", "rest", "h").agg(F.sum("size").alias("size"))
    order = W.Window.partitionBy("pattern", "bin").orderBy("h")
    last = (
        inside.withColumn("upto", F.sum("size").over(order))
        .filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
        .groupBy("pattern").agg(F.max("h").alias("h_in"))
    )
    # Hashes are compared as (bin, h): bins follow the unsigned order, h within a bin the signed one.
    return cut(
        plans.join(F.broadcast(edge.select("pattern", F.col("bin").alias("edge_bin"))), "pattern", "left")
        .join(F.broadcast(last), "pattern", "left")
        .select("pattern", "copies", "source_size", "target", F.coalesce("edge_bin", F.lit(-1)).alias("edge_bin"), "h_in")
    )


def with_copies(rows: DataFrame, plans: DataFrame, mix: Mix) -> DataFrame:
    """Add ``copies`` to rows that have pattern and h. ``plans`` has at most MAX_PATTERNS rows."""
    p = plans.withColumnRenamed("copies", "whole")
    more = (bin_of(F.col("h")) < F.col("edge_bin")) | ((bin_of(F.col("h")) == F.col("edge_bin")) & (F.col("h") <= F.col("h_in")))
    return rows.join(F.broadcast(p), "pattern").withColumn(
        "copies", F.least(F.lit(mix.cap), F.col("whole") + F.coalesce(more, F.lit(False)).cast("int"))
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members=None, mix: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its first source), taken, copies.

    ``members`` is an array-of-strings column with the sources of a document; by default
    the one in ``source``.
    """
    members = F.array(F.col("source").cast("string")) if members is None else members
    rows = cut(sized(docs, id_col, text_col, members, mix))
    return with_copies(rows, plan(rows, mix), mix).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The documents as the mix takes them, each row as often as it is taken, with the columns of the input."""
    members = F.array(F.col(source_col).cast("string"))
    plans = plan(cut(sized(docs, id_col, text_col, members, mix)), mix)
    kept = docs.select(
        F.struct("*").alias("doc"),
        F.array_sort(F.array_distinct(members)).alias("pattern"),
        F.xxhash64(F.lit(mix.seed), F.col(id_col).cast("long")).alias("h"),
    )
    return (
        with_copies(kept, plans, mix).filter(F.col("copies") > 0)
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


SQL: dict[str, str] = {}
QUERIES = {"op9_mixing": op9_mixing}
