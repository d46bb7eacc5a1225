"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import io
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed to Python in groups of about this many characters.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of checkpoints: the session's own setting; a new one where there is none, in local sessions only.

    On a cluster such a folder would be on the driver's own disk, where executors cannot find what others wrote.
    """
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
        folder = sc._jsc.sc().getCheckpointDir()
    return folder.get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files and checkpoints that nothing refers to, before a step that needs the disk.

    The cleaner learns of them only when the driver collects its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, size: int = 4_000_000, rows: int = 1000) -> Iterator[None]:
    """Fewer bytes and rows at a time between JVM and Python, where a row may hold a whole set of a text's shingles.

    A batch ends with the row that brings it to ``size`` bytes.
    """
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.execution.arrow.maxRecordsPerBatch": rows}
    before = {k: spark.conf.get(k) for k in limits}
    number = lambda x: int(x.rstrip("bB"))
    for k, most in limits.items():
        spark.conf.set(k, str(min(most, number(before[k])) if number(before[k]) > 0 else most))
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function ``run``, whose worker then hands freed memory back to the system; idle workers would keep it."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, for small results of many joins.

    A checkpoint hands the constraints of its plan on to later plans, where they multiply with every
    join and renaming until planning takes seconds and much of the driver's memory; a table has none.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.Table]:
    """The rows of a partition in order, in tables of at most ``limit`` characters or one row."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        start, seen = 0, 0
        for i, n in enumerate(pa.compute.binary_length(t[text]).to_pylist()):
            n = n or 0
            if seen and seen + n > limit:
                yield t.slice(start, i - start)
                start, seen = i, 0
            seen += n
        if t.num_rows > start:
            yield t.slice(start)


def texts(t: pa.Table, name: str = "text") -> list[str]:
    """A text column; null counts as empty."""
    return [x or "" for x in t[name].to_pylist()]


#: Bits of the filter that spares rows a shuffle: 16 for each id, within these bounds, so that its broadcast has 2^20 rows at
#: most; with more ids it only passes more rows on to the exact join.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 26


def split_by(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``column`` may be in ``ids``, a table of that column, and rows in which it surely is not.

    A bitmap of hashed ids, 64 bits in a row, is broadcast.
    """
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * ids.count()).bit_length()))
    word, place = "hash word", "hash place"
    bit = F.xxhash64(column).bitwiseAND(bits - 1)
    hashed = lambda d: d.withColumn(word, F.shiftright(bit, 6)).withColumn(place, F.expr(f"shiftleft(1L, cast(xxhash64(`{column}`) & 63 as int))"))
    words = cut(hashed(ids).groupBy(word).agg(F.bit_or(place).alias("bits")))
    marked = hashed(docs).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col(place)) != 0, F.lit(False))
    return tuple(marked.filter(c).select(docs.columns) for c in (hit, ~hit))


def only_in(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Left semi join on ``column``, which both tables have, that shuffles hardly more than the rows that stay."""
    return split_by(docs, ids, column)[0].join(ids, column, "left_semi")


def not_in(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Left anti join on ``column``, which both tables have, that shuffles hardly more than the rows that go."""
    maybe, surely_not = split_by(docs, ids, column)
    return surely_not.unionByName(maybe.join(ids, column, "left_anti"))


def without_rows(docs: DataFrame, key, gone: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key``, a column that is never null, is not in ``gone``; of rows whose key is in ``again`` one each."""
    name, columns = "row key", docs.columns
    keyed = docs.withColumn(name, key)
    gone, again = (d.select(F.col(d.columns[0]).alias(name)) for d in (gone, again))
    if again.isEmpty():
        return not_in(keyed, gone, name).select(columns)
    rest = not_in(keyed, gone.union(again), name).select(columns)
    return rest.unionByName(only_in(keyed, again, name).dropDuplicates([name]).select(columns))


def fitted_in_task(sample: DataFrame, fit) -> dict[str, np.ndarray]:
    """Arrays that ``fit`` makes of the rows of ``sample``, a pa.Table; it runs in one task, so the driver holds the result alone.

    ``sample`` must be bounded by the caller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        out = io.BytesIO()
        np.savez(out, **fit(pa.Table.from_batches(got) if got else None))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["arrays"])

    row = sample.coalesce(1).mapInArrow(tidy(run), "arrays binary").first()
    if row is None:  # an empty table may have no partition and so no task
        return fit(None)
    data = bytes(row[0])
    with np.load(io.BytesIO(data)) as arrays:
        return {k: arrays[k] for k in arrays.files}


class Adam:
    """Adam; embedding tables share one second moment each, so that rare rows move little."""

    def __init__(self, weights: dict, rate: float, tables: tuple[str, ...] = ()):
        self.w, self.rate, self.t, self.tables = weights, rate, 0, tables
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        fix = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            square = g * g
            if k in self.tables:
                square = square.sum() / max(1, np.count_nonzero(square))
            self.v[k] += 0.001 * (square - self.v[k])
            slow = 0.2 if k in self.tables else 1.0
            self.w[k] -= slow * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)
