"""Documents and their bundles: assignment, summary, lending of common specifications, merging, key tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_BUNDLE = "project"
#: Kinds of document that can be checked against each other; two of them make a bundle checkable.
CHECKED = ["assembly", "scheme", "spec"]


def assign_bundles(documents: DataFrame, overrides: DataFrame, root: str = "base_files") -> DataFrame:
    """bundle and bundle_source: the override for the file name, else the folder below ``root``, else the whole project.

    documents: path; overrides: name, bundle (one row per name).
    """
    folder = F.element_at(F.split("path", "/"), -2)
    documents = documents.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("folder", F.when(F.size(F.split("path", "/")) >= 2, F.when((folder != "") & (folder != root), folder)))
    given = overrides.filter("bundle <> ''").select("name", F.col("bundle").alias("given"))
    joined = documents.join(given, "name", "left")
    source = F.when(F.col("given").isNotNull(), "override").when(F.col("folder").isNotNull(), "folder").otherwise("default")
    return joined.select("path", F.coalesce("given", "folder", F.lit(DEFAULT_BUNDLE)).alias("bundle"), source.alias("bundle_source"))


def bundle_summary(documents: DataFrame) -> DataFrame:
    """documents: bundle, document, doc_type. Per bundle: n, types (sorted, comma-joined), cross_checkable."""
    types = F.sort_array(F.collect_set("doc_type"))
    per = documents.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"), types.alias("found"))
    checkable = F.size(F.array_intersect("found", F.array(*map(F.lit, CHECKED)))) >= 2
    return per.select("bundle", "n", F.array_join("found", ",").alias("types"), checkable.alias("cross_checkable"))


def pick_primary(documents: DataFrame, *quality: str) -> DataFrame:
    """One main document per bundle and type, by falling quality, then by name; ``main`` is false for the others."""
    order = Window.partitionBy("bundle", "doc_type").orderBy(*[F.desc(q) for q in quality], "document")
    return documents.withColumn("main", F.row_number().over(order) == 1)


def drop_empty(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with at least one extracted row."""
    return documents.join(rows.select("document").distinct(), "document", "left_semi")


def lend_common_specs(documents: DataFrame, common: str) -> DataFrame:
    """Rows that lend each specification of the bundle ``common`` to every bundle with a drawing or scheme but no specification."""
    own = documents.filter("doc_type = 'spec'").select("bundle").distinct()
    needy = documents.filter(F.col("doc_type").isin("assembly", "scheme")).select("bundle").distinct().join(own, "bundle", "left_anti")
    lent = documents.filter((F.col("bundle") == common) & (F.col("doc_type") == "spec")).select(F.col("document"), F.lit(common).alias("of"))
    needy = needy.filter(F.col("bundle") != common).withColumn("of", F.lit(common))
    return needy.join(lent, "of").select("bundle", "document", F.lit(True).alias("project_wide"))


def pick_project_wide_spec(lent: DataFrame, items: DataFrame, elements: DataFrame, tags: DataFrame) -> DataFrame:
    """Of the specifications lent to a bundle the one that shares most designators with its drawing and scheme together."""
    both = elements.select("bundle", "designator").intersect(tags.select("bundle", "designator"))
    listed = items.select("document", "designator").distinct()
    shared = lent.join(listed, "document").join(both, ["bundle", "designator"]).groupBy("bundle", "document").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("bundle").orderBy(F.desc("shared"), "document")
    return shared.withColumn("at", F.row_number().over(order)).filter("at = 1").drop("at")


def positions(items: DataFrame) -> DataFrame:
    """Per bundle and designator: its first row and how many rows name it."""
    return items.groupBy("bundle", "designator").agg(F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("n"))


def scheme_facts(tags: DataFrame) -> DataFrame:
    """Per bundle and designator: the sheets that show it, ascending and comma-joined."""
    sheets = F.transform(F.sort_array(F.collect_set("sheet")), lambda x: x.cast("string"))
    return tags.groupBy("bundle", "designator").agg(F.array_join(sheets, ",").alias("sheets"))


def merge_documents(elements: DataFrame) -> DataFrame:
    """One view of several documents of a type: per bundle and designator the article of the first document and sheet."""
    return elements.groupBy("bundle", "designator").agg(F.min_by("article", F.struct("document", "sheet")).alias("article"), F.countDistinct("article").alias("articles"))
