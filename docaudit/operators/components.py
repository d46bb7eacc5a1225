"""Connected components on edge tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that are contracted together within a task.
CHUNK_EDGES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's folder of checkpoints, that driver and executors share; local sessions without one (tests) get a new folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for small results that go into several joins: unlike a checkpoint it hands none of its plan's constraints on."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contracted(e: DataFrame, made=None, schema: str = "", roots: bool = True) -> DataFrame:
    """Edges a, b that connect what those of ``e`` do: each node with the smallest one that it hangs together with in its part.

    Parts are runs of CHUNK_EDGES edges of a partition. ``made`` makes the edges (a, b as in ``schema``) of a partition's
    batches, where ``e`` has other rows; that saves a second Python worker for each task. Without ``roots`` the smallest node of a part has no
    row of its own if others name it; each node still occurs.
    """

    def forest(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        kind, a, b = t.schema.field("a").type, t["a"].to_numpy(), t["b"].to_numpy()
        nodes, number = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = number[: len(a)], number[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            open_ = label[x] != label[y]
            if not open_.any():
                break
            x, y, low = x[open_], y[open_], low[open_]
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            while (label != label[label]).any():
                label = label[label]
        kept = np.ones(len(nodes), bool) if roots else (label != np.arange(len(nodes))) | (np.bincount(label, minlength=len(nodes)) == 1)
        return pa.RecordBatch.from_arrays([pa.array(nodes[kept], kind), pa.array(nodes[label][kept], kind)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_EDGES:
                yield forest(held)
                held, n = [], 0
        if n:
            yield forest(held)
        held.clear()
        hand_back()

    def hand_back() -> None:
        """Idle workers would keep what they have freed."""
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return e.mapInArrow((lambda batches: run(made(batches))) if made else run, schema or e.schema)


def sparse(e: DataFrame, worth: float = 0.8) -> tuple[DataFrame, bool]:
    """Few edges that connect what those of ``e`` do, and whether they are each node's only one, to its smallest.

    Partitions contract their edges; then as many are read together as make CHUNK_EDGES edges, again and again while
    that saves some. Once a single task takes all edges that are left, its answer is whole.
    """
    e = cut(contracted(e, roots=False).distinct())
    n = e.count()
    while n:
        parts = -(-n // CHUNK_EDGES)
        e = cut(contracted(e.coalesce(parts)).distinct())
        if parts == 1:
            return e, True
        before, n = n, e.count()
        if n > worth * before:
            return e, False
    return e, True


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its smallest node) for every node of ``edges``.

    Tasks contract their own edges first, which ends it when few are left. Else each round takes the smallest label among a node's neighbours, then the label of that label, so chains shorten by
    half and more. Rounds end when no label changes. Self-edges
    introduce single nodes; edges with a null end are ignored; no edges give no rows.
    """
    e, done = sparse(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null"))
    if done:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Every node comes with the smallest one of its part, itself included; the other direction is added.
    both = cut(e.union(e.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        near = near.join(labels, near.a == labels.node).select("node", F.col("label").alias("old"), F.least("near", "label").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        found = cut(near.join(jump, near.near == jump.via).select("node", "old", F.least("near", "far").alias("label")))
        if found.filter("label < old").isEmpty():
            return found.select("node", F.col("label").alias("component"))
        labels = found.select("node", "label")
