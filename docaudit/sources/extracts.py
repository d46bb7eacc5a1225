"""Files in and reports out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import severity_rank
from ..operators.report import REF_FIELDS

#: Fields of a record of known errors.
PLACE = ", ".join(f"{f}: {k}" for f, k in REF_FIELDS.items())
KNOWN_STRUCT = f"kind: string, type: string, scope: string, refs: array<struct<{PLACE}>>"
TEXTS = lambda *names: ", ".join(f"{n} string" for n in names)
#: File, schema, path of the rows within it and columns of the document, for each kind of extract.
EXTRACTS = {
    "connections": (
        "connections.json", f"statistics struct<table_kind string>, connections array<struct<{TEXTS('cable_harness', 'circuit_marking', 'kks', 'conductor', 'cabinet', 'terminal_block', 'pin', 'connection_address', 'note', 'terminal_address')}, id bigint, page bigint>>".replace(" string", ": string").replace(" bigint", ": bigint"),
        "connections", {"table_kind": "coalesce(statistics.table_kind, 'gost_connections')"},
    ),
    "specification": (
        "specification.json", "document_metadata struct<designation_in_document: string>, items array<struct<row: bigint, section: string, position_raw: string, designators: array<string>, name: string, type_mark: string, code: string, manufacturer: string, unit: string, quantity: double, mass: double, note: string>>",
        "items", {"designation": "document_metadata.designation_in_document"},
    ),
    "assembly": (
        "assembly.json", "document_metadata struct<designation_in_document: string>, elements array<struct<designator: string, article: string, pair_source: string, sheet: bigint, label_text: string>>",
        "elements", {"designation": "document_metadata.designation_in_document"},
    ),
    "nets": (
        "nets.json", "summary struct<total_sheets: bigint>, nets array<struct<id: string, page: bigint, n_segments: bigint, n_endpoints: bigint, wire_markings: array<string>, terminals: array<string>, kks_tags: array<string>, wire_gauges: array<string>>>",
        "nets", {"total_sheets": "summary.total_sheets"},
    ),
}
SPANS = "page_number bigint, text_spans array<struct<text: string, entity_type: string, bbox: array<double>>>"


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, suffix, size, modified of all files below ``root``; temporary and hidden names are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(~F.col("name").startswith("~$") & ~F.col("name").startswith("."))
    return files.withColumn("suffix", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))


def read_extracts(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """document, ord, the fields of each row, and what is said of the whole document, from root/<document>/<file>; broken files give no rows."""
    document = F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -2))
    if kind == "spans":
        pages = spark.read.schema(SPANS).option("multiLine", True).json(f"{root}/*/classified.json").select(document.alias("document"), F.col("page_number").alias("sheet"), F.posexplode("text_spans").alias("ord", "s"))
        corner = lambda i: F.get("s.bbox", F.lit(i))
        return pages.select("document", "sheet", "ord", "s.text", "s.entity_type", *[corner(i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    file, schema, rows, whole = EXTRACTS[kind]
    docs = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{file}")
    return docs.select(document.alias("document"), *[F.expr(e).alias(n) for n, e in whole.items()], F.posexplode(rows).alias("ord", "r")).select("document", "ord", *whole, "r.*")


def incremental(files: DataFrame, previous: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to read anew, and files whose earlier extract holds: same size, time and parsers, no errors then, and all its files are there.

    files: path, size, modified, parsers. previous: path, size, modified, parsers, errors, outputs (paths). present: path of every extract's file.
    """
    promised = previous.select("path", F.explode("outputs").alias("output"))
    lacking = promised.join(present.select(F.col("path").alias("output")), "output", "left_anti").select("path").distinct()
    good = previous.filter("errors = 0 and size(outputs) > 0").join(lacking, "path", "left_anti").select("path", "size", "modified", "parsers")
    by = ["path", "size", "modified", "parsers"]
    return files.join(good, by, "left_anti"), files.join(good, by, "left_semi")


def read_known_errors(spark: SparkSession, path: str) -> DataFrame:
    """known_id, kind, type, scope, refs from a bare array, or from its place under ``errors``; no rows without the file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"known_id int, {KNOWN_STRUCT.replace('kind: ', 'kind ').replace('type: string, scope: string, refs: ', 'type string, scope string, refs ')}")
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"errors array<struct<{KNOWN_STRUCT}>>")
    listed = F.from_json("value", f"array<struct<{KNOWN_STRUCT}>>")
    records = whole.select(F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(wrapped["errors"])).alias("known_id", "k"))
    return records.select("known_id", "k.*")


def write_report(findings: DataFrame, path: str) -> None:
    """One JSON document per line: first the summary, then the findings, worst first and in the order of their rules (``rule_ord``) within a severity.

    The lines are one table with its order, so errors and summary are written as one.
    """
    rank = severity_rank(F.col("severity"))
    rows = findings.select(F.lit(1).alias("part"), rank.alias("rank"), (F.col("rule_ord") if "rule_ord" in findings.columns else F.lit(0)).cast("long").alias("rule_ord"), F.col("finding_id").cast("string").alias("id"), F.to_json(F.struct(F.lit("error").alias("is"), *findings.columns)).alias("value"))
    counts = findings.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("kind", "severity", "n"))).alias("counts"))
    summary = counts.select(F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("rule_ord"), F.lit("").alias("id"), F.to_json(F.struct(F.lit("summary").alias("is"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), "counts")).alias("value"))
    summary.unionByName(rows).repartitionByRange("part", "rank", "rule_ord", "id").sortWithinPartitions("part", "rank", "rule_ord", "id").select("value").write.mode("overwrite").text(path)
