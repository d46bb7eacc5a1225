"""Odd labels along a net."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .grid import SHEET, distance, middle, near_lines


def odd_ones_out(marks: DataFrame) -> DataFrame:
    """document, sheet, comp, major, odd: a number met once beside one met three times or more that differs by one,
    unless the number on the other side is also met once."""
    g = ["document", "sheet", "comp"]
    n = marks.select(*g, F.col("text").try_cast("int").alias("v")).filter("v is not null").groupBy(*g, "v").agg(F.count(F.lit(1)).alias("n"))
    major = n.filter("n >= 3").select(*g, F.col("v").alias("major"))
    single = n.filter("n = 1").select(*g, F.col("v").alias("odd"))
    pairs = major.join(single, g).filter("abs(major - odd) = 1")
    mirror = single.select(*g, F.col("odd").alias("mirror"))
    return pairs.withColumn("mirror", 2 * F.col("major") - F.col("odd")).join(mirror, [*g, "mirror"], "left_anti").select(*g, "major", "odd")


def drop_repeated(candidates: DataFrame, sheets: int = 3) -> DataFrame:
    """Without pairs met on so many sheets of a document that they are a typical node."""
    p = ["document", "major", "odd"]
    often = candidates.groupBy(*p).agg(F.countDistinct("sheet").alias("n")).filter(F.col("n") >= sheets)
    return candidates.join(often, p, "left_anti").select("document", "sheet", "comp", "major", "odd")


BAND, MARGIN, KIN = 11.0, 26.0, 2


def band_markings(lines: DataFrame, comp_of: DataFrame, marks: DataFrame) -> DataFrame:
    """document, sheet, comp, ord, text: marks whose middle lies in a band along a level or upright line of a component.

    lines: segments; comp_of: seg, comp; marks: document, sheet, ord, text, x0, y0, x1, y1.
    """
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    axis = F.when((dx < 1) & (dy >= 8), "v").when((dy < 1) & (dx >= 8), "h")
    own = lines.withColumn("axis", axis).filter("axis is not null").join(comp_of, "seg").select(*SHEET, "seg", "comp", "axis", "x1", "y1", "x2", "y2")
    near = near_lines(middle(marks, "px", "py").select(*SHEET, "ord", "text", "px", "py"), own, BAND, 24.0)
    inside = lambda p, a, b: F.col(p).between(F.least(a, b), F.greatest(a, b))
    return near.filter(F.when(F.col("axis") == "h", inside("px", "x1", "x2")).otherwise(inside("py", "y1", "y2"))).select(*SHEET, "comp", "ord", "text").distinct()


def crop_box(candidates: DataFrame, marks: DataFrame, pages: DataFrame) -> DataFrame:
    """document, sheet, comp, odd, x0, y0, x1, y1: an odd label with its nearest kin and a margin, within the page.

    candidates: document, sheet, comp, major, odd. marks: document, sheet, comp, ord, text, x0, y0, x1, y1; pages: document, sheet, page_width, page_height.
    """
    g = [*SHEET, "comp"]
    kin = marks.join(candidates, g).filter("text = cast(major as string) or text = cast(odd as string)")
    kin = kin.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    one = kin.filter("text = cast(odd as string)").groupBy(*g, "major", "odd").agg(F.min_by(F.struct("ord", "cx", "cy"), "ord").alias("o"))
    rows = kin.join(one, [*g, "major", "odd"]).withColumn("dist", F.when(F.col("ord") == F.col("o.ord"), -1.0).otherwise(distance(F.col("cx") - F.col("o.cx"), F.col("cy") - F.col("o.cy"))))
    near = rows.withColumn("at", F.row_number().over(W.Window.partitionBy(*g, "major", "odd").orderBy("dist", "ord"))).filter(F.col("at") <= KIN + 1)
    box = near.groupBy(*g, "major", "odd").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]).join(pages, SHEET)
    low = lambda c: F.greatest(F.col(c) - MARGIN, F.lit(0.0)).alias(c)
    high = lambda c, size: F.least(F.col(c) + MARGIN, F.col(size)).alias(c)
    return box.select(*g, "odd", low("x0"), low("y0"), high("x1", "page_width"), high("y1", "page_height"))


def apply_verdicts(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates with kind and severity by what was read there; none is dropped. answers: document, sheet, comp, odd, numbers (null or empty: none)."""
    rows = candidates.join(answers, [*SHEET, "comp", "odd"], "left")
    read = F.coalesce(F.size("numbers") > 0, F.lit(False))
    seen = read & F.array_contains("numbers", F.col("major").cast("string"))
    verdict = F.when(~read, "unanswered").when(seen, "confirmed").otherwise("denied")
    return rows.select(*SHEET, "comp", "major", "odd", verdict.alias("verdict"), F.when(seen, "MISMATCH").otherwise("REVIEW").alias("kind"), F.when(~read, "medium").when(seen, "high").otherwise("low").alias("severity"))


def reading_score(printed: DataFrame, read: DataFrame) -> DataFrame:
    """setting, printed, hit, invented: numbers that were read as often as they are printed, and those read too often. Both: setting, tile, number."""
    count = lambda d, n: d.groupBy("setting", "tile", "number").agg(F.count(F.lit(1)).alias(n))
    both = count(printed, "p").join(count(read, "r"), ["setting", "tile", "number"], "full_outer").na.fill(0, ["p", "r"])
    return both.groupBy("setting").agg(F.sum("p").alias("printed"), F.sum(F.least("p", "r")).alias("hit"), F.sum(F.greatest(F.col("r") - F.col("p"), F.lit(0))).alias("invented"))
