"""Files to documents: type, name, what is skipped and why, quality of an extract, counts of a run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import literals

# Markers before a name, marks of a kind of document within it, and the types they stand for; suffixes that types may have.
TYPE_ALIASES = {
    "scheme": "scheme", "schema": "scheme", "schematic": "scheme", "схема": "scheme", "netlist": "netlist", "нетлист": "netlist", "таблица": "netlist", "таблица соединений": "netlist",
    "assembly": "assembly", "сборочный": "assembly", "сборочный чертеж": "assembly", "сборочный чертёж": "assembly", "спецификация": "spec", "spec": "spec", "specification": "spec",
    "functional": "functional", "фса": "functional", "функциональная": "functional", "функциональная схема": "functional",
}
KIND_MARKS = {"Э3": "scheme", "Э4": "scheme", "Э5": "scheme", "Э6": "scheme", "СХ": "scheme", "СБ": "assembly", "СО": "spec", "NL": "netlist", "НЛ": "netlist"}
SUFFIXES = [".pdf", ".xlsx", ".xlsm"]
TYPE_SUFFIXES = {"scheme": [".pdf"], "netlist": [".pdf"], "assembly": [".pdf"], "functional": [".pdf"], "spec": [".xlsx", ".xlsm", ".pdf"]}
MARKER = r"(?U)^\s*\(\s*([^)]+?)\s*\)"
KIND_MARK = rf"(?iuU)(?:^|(?<=[\s_]))({'|'.join(KIND_MARKS)})(?=[\s_.]|$)"


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def without_kind_marks(name: Column) -> Column:
    return F.regexp_replace(name, KIND_MARK, " ")


def doc_type_of(name: Column) -> Column:
    """Type by the marker before a file's name, else by the last mark of a kind within it; null if there is none that is known."""
    mark = F.upper(F.try_element_at(F.regexp_extract_all(stem(name), F.lit(KIND_MARK), 1), F.lit(-1)))
    marker = F.lower(F.regexp_extract(name, MARKER, 1))
    return F.when(name.rlike(MARKER), F.try_element_at(literals(TYPE_ALIASES), marker)).otherwise(F.try_element_at(literals(KIND_MARKS), F.coalesce(mark, F.lit(""))))


def document_name(name: Column) -> Column:
    """A file's name without marker and suffix, with forbidden characters as underscores; never empty."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(stem(name), MARKER, "")), r'[<>:"/\\|?*]', "_")
    return F.when(plain == "", stem(name)).otherwise(plain)


def resolve_doc_type(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """doc_type of each file: given for its path, given for its bare name, else by the name. files: path, name; overrides: key, doc_type, one row a key."""
    given = lambda c, n: overrides.select(F.col("key").alias(c), F.col("doc_type").alias(n))
    rows = files.join(given("path", "by_path"), "path", "left").join(given("name", "by_name"), "name", "left")
    return rows.withColumn("doc_type", F.coalesce("by_path", "by_name", doc_type_of(F.col("name")))).drop("by_path", "by_name")


def route_skips(files: DataFrame) -> DataFrame:
    """skip_reason of each file (null: it is read). files: name, doc_type. Temporary and hidden files are no files at all."""
    ending = suffix(F.col("name"))
    fits = F.array_contains(F.try_element_at(F.create_map(*[x for t, s in TYPE_SUFFIXES.items() for x in (F.lit(t), F.array(*map(F.lit, s)))]), F.col("doc_type")), ending)
    reason = F.when(~ending.isin(SUFFIXES), "suffix").when(F.col("doc_type").isNull(), "type unknown").when(~F.coalesce(fits, F.lit(True)), "suffix of the type")
    files = files.filter(~F.col("name").startswith("~$") & ~F.col("name").startswith("."))
    return files.withColumn("skip_reason", reason).withColumn("doc_type", F.when(reason.isNull(), F.col("doc_type")))


def extraction_quality(extracts: DataFrame) -> DataFrame:
    """``warnings`` about extracts that gave next to nothing, and status: failed without files, partial with errors or nothing found, else ok.

    extracts: doc_type, n_files, n_errors, and counts that may be null: pages, nodes, nets, terminals, markings, connections, rows,
    designators, elements, paired, instruments; has_number says whether a designation was found.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    is_a = lambda t: F.col("doc_type") == t
    scheme, nets = is_a("scheme"), c("nets")
    checks = [
        (scheme & (c("nodes") == 0), "no nodes"), (scheme & (c("nodes") > 0) & (c("pages") > 0) & (c("nodes") < 20 * c("pages")), "few nodes"), (scheme & (nets == 0), "no nets"),
        (scheme & (nets > 0) & (c("terminals") == 0), "no terminals"), (scheme & (nets >= 20) & (c("terminals") > 0) & (c("terminals") < F.greatest(F.lit(3), F.bround(nets * 0.02))), "few terminals"),
        (scheme & (nets > 5) & (c("markings") == 0), "no markings"), (is_a("netlist") & (c("connections") == 0), "no connections"),
        (is_a("spec") & (c("rows") == 0), "no rows"), (is_a("spec") & (c("rows") > 0) & (c("designators") == 0), "no designators"), (is_a("spec") & ~F.col("has_number"), "no designation"),
        (is_a("functional") & (c("instruments") == 0), "no instruments"), (is_a("assembly") & (c("elements") == 0), "no elements"),
        (is_a("assembly") & (c("elements") > 0) & (c("paired") == 0), "no pairs"), (is_a("assembly") & ~F.col("has_number"), "no designation"),
    ]
    warnings = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))
    nothing = F.when(scheme, (c("nodes") == 0) & (nets == 0))
    for t, n in (("netlist", "connections"), ("spec", "rows"), ("assembly", "elements"), ("functional", "instruments")):
        nothing = nothing.when(is_a(t), c(n) == 0)
    status = F.when(F.col("n_files") == 0, "failed").when((F.col("n_errors") > 0) | F.coalesce(nothing, F.lit(False)), "partial").otherwise("ok")
    return extracts.withColumn("warnings", warnings).withColumn("status", status)


def manifest(documents: DataFrame, bundles: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: documents in all, extracted, failed; skipped files; bundles, and those that can be cross-checked."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    docs = documents.agg(F.count(F.lit(1)).alias("documents"), of("ok", "partial").alias("extracted"), of("failed").alias("failed"))
    return docs.crossJoin(skipped.agg(F.count(F.lit(1)).alias("skipped"))).crossJoin(bundles.agg(F.count(F.lit(1)).alias("bundles"), F.count_if("cross_checkable").alias("checkable")))
