"""Quality rules whose cutoffs carry a guarantee against false rejection.

Five measures of a text are compared with cutoffs, per stratum (language). Labelled documents that pass the base
rule are dealt to two halves by a hash of their id. The choosing half lays out a path of rules from lenient to strict:
in rule r each measure takes the strictest cutoff that rejects at most a share of the half's good documents by itself,
or some steps less; a measure that catches no bad document of the half stays out. The other half tests the
rules along the path: a rule holds when the exact binomial tail P(Bin(n, alpha) <= k) of its k false rejections among n good
documents, by all measures together, is at most delta / (number of strata), and all rules before it hold. This
fixed sequence needs no further correction within a stratum, and the strata share delta by Bonferroni, so with
confidence 1 - delta no stratum loses more than ``alpha`` of its good documents. Of the rules that hold,
those that catch most bad documents of the choosing half count, of those the ones with fewest false rejections, and of those the strictest is taken. A stratum with too few labels gets no cutoffs and rejects nothing.

Everything is DataFrame expressions; no Python runs on the executors.

Defined results: a null or empty text has 0 in all counts and fails the base rule; a null
language is a stratum of its own; an empty table gives no rows; repeated rows each get
their row; a document with several labels counts as good only if all say so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Strata are broadcast with their cutoffs; more are an error.
MAX_STRATA = 10_000


@dataclass(frozen=True)
class Risk:
    """``path``: the share of good documents that a measure may reject by itself in the choosing half, and steps of the grid less strict than that."""

    alpha: float = 0.05
    delta: float = 0.05
    path: tuple[tuple[float, int], ...] = ((0.0, 2), (0.0, 1), (0.0, 0), (0.005, 0), (0.01, 0), (0.02, 0), (0.03, 0))
    seed: int = 11


#: Measure -> (SQL over the base columns, cutoffs from lenient to strict). A document fails above a cutoff.
MEASURES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", [3, 2.5, 2, 1.5, 1, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "long_words": ("word_chars / greatest(n_words, 1)", [40, 30, 20, 16, 14, 12, 11, 10, 9, 8.5, 8, 7.5, 7]),
    "short_words": ("-word_chars / greatest(n_words, 1)", [-1, -1.5, -2, -2.5, -3, -3.5, -4, -4.5, -5]),
}


def let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def covered(starts: Column) -> Column:
    """Words under 3-word windows that start at these ascending positions."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((x + 3).alias("end"), (a["n"] + x + 3 - F.greatest(a["end"], x)).alias("n"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more."""

    def windows(w: Column) -> Column:
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda j, k: F.get(s, j)["h"].eqNullSafe(F.get(s, k)["h"])
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(at, lambda j: F.get(s, j)["i"]))

    return F.when(F.size(words) < 3, 0).otherwise(let(words, lambda w: let(windows(w), lambda s: covered(twice(s)))))


def stratum_name(c: Column) -> Column:
    """Null is a stratum of its own, apart from every string."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), c))


def base_columns(docs: DataFrame, id_col: str, text_col: str, stratum_col: str | None) -> DataFrame:
    """doc_id, stratum and the counts of the base rule."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        stratum_name(F.col(stratum_col).cast("string") if stratum_col else F.lit("")).alias("stratum"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        let(
            F.filter(F.split(text, SPACE), lambda x: x != ""),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")),
        ).alias("words"),
    )
    return rows.select(
        "doc_id", "stratum", F.col("words.n").alias("n_words"), "word_chars", "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        F.col("words.r").alias("n_repeat_words"), F.col("lines.n").cast("long").alias("n_lines"),
    )


def log_factorial(n: Column) -> Column:
    """ln n!, exact up to 20, then Stirling's series (error below 1e-12)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n p, else 1 (no use as evidence).

    The terms fall from k downwards at least geometrically below the mean, so summing a few
    standard deviations of them is exact to rounding.
    """
    odds = (1 - p) / p
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, (60 + 20 * F.sqrt(n * p)).cast("long"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(a: Column, j: Column) -> Column:  # from term k-j+1 to term k-j
        term = a["term"] * (k - j + 1) / (n - k + j) * odds
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.when(steps < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), zero, step, lambda a: a["total"]))
    return F.when(k < n * p, F.exp(top + F.log(total))).otherwise(F.lit(1.0))


def levels() -> Column:
    """Array of (measure, level): how many of the measure's cutoffs the document is above."""
    out = []
    for name, (sql, cutoffs) in MEASURES.items():
        value = F.expr(sql)
        level = sum((F.when(value > c, 1).otherwise(0) for c in cutoffs), F.lit(0))
        out.append(F.struct(F.lit(name).alias("measure"), level.alias("level")))
    return F.array(*out)


def failing(cutoffs: Column) -> Column:
    """Names of the measures whose level is at or above the cutoff's; measures without a cutoff never fail."""
    return F.transform(F.filter(levels(), lambda m: m["level"] >= F.try_element_at(cutoffs, m["measure"])), lambda m: m["measure"])


def rule_paths(labelled: DataFrame, risk: Risk) -> DataFrame:
    """stratum, rules: for each step of the path the cutoffs (measure -> least level that fails) that the choosing half gives."""
    by = ["stratum", "measure"]
    hist = labelled.filter("choosing").select("stratum", "good", F.explode(levels()).alias("m")).groupBy("stratum", "m.measure", "m.level").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    hist = cut(hist)  # strata x measures x levels
    # Rejected at level c are the documents above c cutoffs or more: fewer, the higher c.
    deep = W.Window.partitionBy(*by).orderBy(F.col("level").desc())
    at = hist.select(*by, "level", F.sum("good").over(deep).alias("k"), F.sum("good").over(W.Window.partitionBy(*by)).alias("n"))
    # Above the highest level that would reject too many.
    strict = at.groupBy(*by).agg(*[(F.max(F.when(F.col("k") > F.col("n") * share, F.col("level"))) + 1 + more).alias(f"c{r}") for r, (share, more) in enumerate(risk.path)])
    names = [f"c{r}" for r in range(len(risk.path))]
    caught = hist.filter("bad > 0").join(strict, by).groupBy(*by, *names).agg(*[F.sum(F.when(F.col("level") >= F.col(c), F.col("bad"))).alias(f"b_{c}") for c in names])
    grid = F.create_map(*[x for name, (_, c) in MEASURES.items() for x in (F.lit(name), F.lit(len(c)))])
    used = caught.select("stratum", *[F.when((F.col(f"b_{c}") > 0) & (F.col(c) <= F.element_at(grid, F.col("measure"))), F.struct("measure", F.col(c).alias("level"))).alias(c) for c in names])
    return used.groupBy("stratum").agg(F.array(*[F.map_from_entries(F.collect_list(c)) for c in names]).alias("rules"))  # collect_list leaves nulls out


def thresholds(rows: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """stratum, cutoffs (measure -> least level that fails); at most MAX_STRATA strata.

    A level counts the cutoffs that a document is above, so level 1 belongs to the strictest cutoff of the grid.
    """
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality is not null and doc_id is not null")
    marks = marks.select(F.col("doc_id").alias("label_id"), (F.col("quality") == 1).alias("good"))
    labelled = rows.filter(~F.col("base_failed")).join(marks, F.col("doc_id") == F.col("label_id"))
    labelled = cut(labelled.withColumn("choosing", F.xxhash64(F.lit(risk.seed), "label_id") % 2 == 0))
    strata = labelled.select("stratum").distinct().count()
    if strata > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    paths = cut(rule_paths(labelled, risk))  # at most MAX_STRATA rows of a few numbers
    tried = labelled.join(F.broadcast(paths), "stratum").select("*", F.posexplode("rules").alias("r", "cutoffs"))
    hit, testing = F.size(failing(F.col("cutoffs"))) > 0, F.col("good") & ~F.col("choosing")
    counts = tried.groupBy("stratum", "r").agg(
        F.count_if(testing & hit).alias("k"), F.count_if(testing).alias("n"), F.count_if(F.col("choosing") & ~F.col("good") & hit).alias("caught")
    )
    holds = (F.col("n") > 0) & (binomial_tail(F.col("k"), F.col("n"), risk.alpha) <= risk.delta / max(1, strata))
    so_far = W.Window.partitionBy("stratum").orderBy("r")
    held = counts.withColumn("holds", F.min(holds.cast("int")).over(so_far)).filter("holds = 1")
    best = held.groupBy("stratum").agg(F.max_by("r", F.struct("caught", -F.col("k"), "r")).alias("r"))
    return paths.join(F.broadcast(cut(best)), "stratum").select("stratum", F.get("rules", F.col("r")).alias("cutoffs"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", risk: Risk = Risk()) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and ``failed`` (names of measures above their cutoff).

    ``labels`` has doc_id and quality (1 good, 0 bad).
    """
    rows = base_columns(docs, id_col, text_col, stratum_col).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    rows = cut(rows)  # a few numbers per document, for the thresholds and the verdicts
    found = rows.join(F.broadcast(cut(thresholds(rows, labels, risk))), "stratum", "left")  # at most MAX_STRATA rows of a few numbers
    failed = F.coalesce(failing(F.col("cutoffs")), F.array().cast("array<string>"))
    return found.withColumn("failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
QUERIES = {"op4_quality_rules": op4_quality_rules}
