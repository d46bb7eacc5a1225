"""Exact deduplication over a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text. A new batch is
reduced to one row per digest, sort-merge anti-joined with the index, and what is
new is appended, so that a text that came with an earlier batch keeps its first owner.

Defined results: a null text counts as the empty text; an empty table gives no rows;
of repeated rows with the same id and text exactly one is kept; extra columns of the
input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, without_rows

#: Rows of one digest are first gathered per run of so many input rows, so that a hot
#: digest reaches the join as one row for each run and never as one row for each copy.
RUN_BITS = 10
#: A digest with more runs is joined by broadcast, so that its runs stay where they are. There is
#: at most one such digest in HOT_RUNS runs; beyond MAX_HOT of them the merge join takes them, too.
HOT_RUNS, MAX_HOT = 1024, 100_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of rows with one digest: digest, rows (array of id and row number), best, n."""
    row = F.monotonically_increasing_id()
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("digest"),
        row.alias("row"),
    )
    one = F.struct(F.col("doc_id"), (-F.col("row")).alias("row"))
    return base.groupBy("digest", F.shiftright("row", RUN_BITS).alias("run")).agg(
        F.collect_list(one).alias("rows"), F.max(one).alias("best"), F.count(F.lit(1)).alias("n")
    )


class DigestIndex:
    """A digest table in the warehouse, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, runs: DataFrame) -> None:
        """Add the digests that the index lacks, each with the largest id as owner."""
        new = runs.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
        new = new.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
        if not self.exists():
            self.write(new.limit(0))  # rows made by Python would start workers
        self.write(new.join(self.frame().hint("merge"), "digest", "left_anti"))

    def write(self, rows: DataFrame) -> None:
        rows = rows.repartition(self.buckets, "digest")
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)

    def resolve(self, runs: DataFrame, seen_before: DataFrame | None = None) -> DataFrame:
        """Each row of the batch with its group's owner; ``seen_before`` holds digests of earlier batches."""
        hot = runs.groupBy("digest").agg(F.count(F.lit(1)).alias("runs")).filter(F.col("runs") > HOT_RUNS).select("digest")
        hot = cut(self.frame().join(hot, "digest", "left_semi"))
        n_hot = hot.count()
        if 0 < n_hot <= MAX_HOT:
            hot = F.broadcast(hot)
            rest = runs.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(self.frame().hint("merge"), "digest")
            owned = rest.unionByName(runs.join(hot, "digest"))
        else:
            owned = runs.join(self.frame().hint("merge"), "digest")
        owned = owned.withColumn("old", F.lit(False))
        if seen_before is not None:
            owned = owned.drop("old").join(
                seen_before.select("digest", F.lit(True).alias("was")).hint("merge"), "digest", "left"
            ).withColumn("old", F.col("was").isNotNull())
        return owned.select("digest", "keep_id", "keep_row", "group_size", "old", F.explode("rows").alias("r")).select(
            F.col("r.doc_id").alias("doc_id"),
            "keep_id",
            "group_size",
            (~F.col("old") & F.col("r.doc_id").eqNullSafe(F.col("keep_id")) & (F.col("r.row") == F.col("keep_row"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Without ``index`` a new one is made, which the returned rows are read from. With one,
    rows whose text an earlier batch brought are dropped in favour of its owner, and
    group_size stays that of the batch that brought the text.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    before = cut(index.frame().select("digest")) if index.exists() else None
    runs = cut(digests(docs, id_col, text_col))
    index.append(runs)
    return index.resolve(runs, before)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of equal texts one row with the largest id, with all its columns. Rows are known by id, which may be null or shared, and text."""
    key = lambda digest, doc_id: F.concat(digest, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    lost = exact_dedup(docs, id_col, text_col).filter(~F.col("kept"))
    # A row that is not kept and has the id of the one that is kept repeats that one.
    lost = cut(lost.select(key(F.col("text_sha256"), F.col("doc_id")).alias("key"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same")).distinct())
    own = key(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), F.col(id_col).cast("long"))
    return without_rows(docs, own, lost.filter(~F.col("same")).select("key"), lost.filter("same").select("key"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
