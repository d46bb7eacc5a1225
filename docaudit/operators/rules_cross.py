"""Rules across the documents of a bundle: equi joins and anti joins on (bundle, folded designator)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_designator


def keyed(rows: DataFrame, key=fold) -> DataFrame:
    return rows.withColumn("key", key(F.col("designator")))


def mass_captions(elements: DataFrame, by: str = "article", least: int = 25) -> DataFrame:
    """Texts paired in a block with so many designators that they caption none."""
    rows = elements.filter("pair_source = 'block'")
    return rows.groupBy("bundle", by).agg(F.countDistinct("designator").alias("n")).filter(F.col("n") >= least)


def spec_not_on_assembly(spec: DataFrame, elements: DataFrame, tags: DataFrame) -> DataFrame:
    """Ordered but not drawn; low when the scheme has it, medium when not."""
    s = keyed(spec).groupBy("bundle", "key").agg(F.min_by("document", "row_no").alias("document"), F.min("row_no").alias("row_no"))
    drawn = keyed(elements).select("bundle", "key").distinct()
    scheme = keyed(tags, fold_designator).select("bundle", "key", F.lit(True).alias("on_scheme")).distinct()
    missing = s.join(drawn, ["bundle", "key"], "left_anti").join(scheme, ["bundle", "key"], "left")
    return missing.select("bundle", "key", "document", "row_no", F.when(F.col("on_scheme"), "low").otherwise("medium").alias("severity"))
