"""State that is carried down the rows of a long key: within its pieces first, then from piece to piece.

A piece (a page or sheet) is what a task holds; of each piece one summary row goes on, so a document of any length is no single task's work.
Rows keep the partitioning of the first step, so the summary comes back without a second shuffle of the rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_known(rows: DataFrame, key: list[str], piece: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the last value of ``value`` that is not null, at or before each row of its key."""
    own = Window.partitionBy(*key, *piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own value", F.last(value, ignorenulls=True).over(own))
    at = F.struct(*order)
    each = rows.groupBy(*key, *piece).agg(F.max_by("own value", at).alias("piece value"))
    before = Window.partitionBy(*key).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("value before", F.last("piece value", ignorenulls=True).over(before)).drop("piece value")
    return rows.join(each, [*key, *piece]).withColumn(name, F.coalesce("own value", "value before")).drop("own value", "value before")


def numbered(rows: DataFrame, key: list[str], piece: list[str], order: list[str], name: str = "id") -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... over the rows of a key, in the order of their pieces and within them."""
    rows = rows.withColumn("own number", F.row_number().over(Window.partitionBy(*key, *piece).orderBy(*order)).cast("long"))
    each = rows.groupBy(*key, *piece).agg(F.max("own number").alias("rows of piece"))
    before = Window.partitionBy(*key).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("rows before", F.coalesce(F.sum("rows of piece").over(before), F.lit(0))).drop("rows of piece")
    return rows.join(each, [*key, *piece]).withColumn(name, F.col("rows before") + F.col("own number")).drop("own number", "rows before")
