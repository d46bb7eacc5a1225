"""Album splitting: from title lines to documents with a type, a cabinet and a name.

Windows run over the sheets or parts of one album, which a task holds at a time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from .files import without_kind_marks

COMMON = "общие документы"  # fixed value: the bundle of parts that name no cabinet
ALBUM_PAGES = 80

# Titles that are not analysed; titles and the type they stand for, the first that matches.
TITLE_SKIP = (
    r"план\s+расположени|планы\s+расположени|план\s+электрообогрева|молниезащита|светоограждение|заземлени|уравнивания\s+потенциалов|пояснительная\s+записка|общие\s+данные|содержание\s+тома"
    r"|установочный\s+чертеж|установочный\s+чертёж|установка\s+|отборное\s+устройство|ведомость\s+ссылочных|ведомость\s+объемов"
)
TITLE_TO_TYPE = [
    (r"внешн\w*\s+(соединен|подключен|проводок)", "scheme"), (r"схема\s+(внешних|подключени|соединени)", "scheme"), (r"кабельн\w*\s+журнал", "netlist"),
    (r"перечень\s+(входных|выходных)\s+сигналов", "netlist"), (r"перечень\s+(входных|выходных|вход\w*/\w*выход\w*)[^.]*параметров", "netlist"),
    (r"спецификаци", "spec"), (r"перечень\s+элементов", "spec"), (r"ведомость\s+(оборудования|материалов)", "spec"),
    (r"(общий\s+вид|вид\s+общий|сборочн\w*\s+черт)", "assembly"), (r"^вид\b|вид\s+(спереди|сзади|сбоку|слева|справа|снизу|сверху)", "assembly"),
    (r"функциональн\w*\s+схема\s+автоматизации", "functional"), (r"схема\s+автоматизации", "functional"),
    (r"схема\s+электрическая\s+принципиальная", "scheme"), (r"схема\s+электрическая\s+однолинейная", "scheme"), (r"однолинейная\s+схема", "scheme"),
    (r"принципиальная\s+схема", "scheme"), (r"функциональная\s+схема", "scheme"), (r"схема\s+структурная|структурная\s+схема", "scheme"),
]


# Captions left and right of a title block's title.
LEFT_LABELS = ["изм.", "изм", "кол.уч.", "кол.уч", "кол. уч.", "№ док", "№ док.", "№док", "подп.", "дата"]
RIGHT_LABELS = ["стадия", "листов"]
SHEET = ["album", "sheet"]


def stamp_lines(lines: DataFrame, pages: DataFrame, left: float = 0.30, top: float = 0.55) -> DataFrame:
    """Lines that reach into the lower right of their sheet, where the title block is. pages: album, sheet, width, height."""
    inside = (F.col("x1") > left * F.col("width")) & (F.col("y1") > top * F.col("height"))
    return lines.join(pages, SHEET).filter(inside).select(lines.columns)


def title_cell(lines: DataFrame, rulings: DataFrame, near: float = 3.0, slack: float = 2.0, share: float = 0.8) -> DataFrame:
    """album, sheet, line, text: the lines in the title's cell of a title block, in reading order, without captions and formats.

    lines: album, sheet, ord, text, x0, y0, x1, y1; rulings: album, sheet, x0, y0, x1, y1, is_rect. The cell is what the last two upright
    rulings left of the stage's caption enclose, of those that reach below the caption's top; where there are no such two, what lies between
    the captions left and right. A line may stick out to the left if ``share`` of its width is in the cell, but not to the right.
    """
    norm = T.norm_title(F.col("text"))
    right, left = norm.isin(RIGHT_LABELS), norm.isin(LEFT_LABELS)
    of = lambda f, c, side: f(F.when(side, F.col(c)))
    labels = lines.groupBy(*SHEET).agg(
        of(F.min, "x0", right).alias("right_x"), of(F.min, "y0", right).alias("right_y"), of(F.max, "x1", left).alias("left_x"), of(F.min, "y0", left).alias("left_y")
    )
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    upright = F.when(F.col("is_rect"), wide <= 1.5).otherwise((wide <= 1.0) & (high >= 3))
    anchors = labels.filter("right_x is not null").select(*SHEET, "right_x", "right_y")
    ticks = rulings.filter(upright).join(anchors, SHEET).filter(F.greatest("y0", "y1") >= F.col("right_y"))
    xs = ticks.groupBy(*SHEET, "right_x").agg(F.array_sort(F.collect_set(F.bround("x0"))).alias("xs"))
    kept = F.aggregate("xs", F.array().cast("array<double>"), lambda a, x: F.when(F.coalesce(x - F.try_element_at(a, F.lit(-1)) > near, F.lit(True)), F.concat(a, F.array(x))).otherwise(a))
    inner = xs.select(*SHEET, F.filter(kept, lambda x: x <= F.col("right_x")).alias("inner")).filter(F.size("inner") >= 2)
    ruled = inner.select(*SHEET, F.try_element_at("inner", F.lit(-2)).alias("low"), F.try_element_at("inner", F.lit(-1)).alias("high"))
    bounds = labels.join(ruled, SHEET, "left").select(
        *SHEET, F.coalesce("low", "left_x").alias("low"), F.coalesce("high", "right_x", F.lit(float("inf"))).alias("high"), F.when(F.col("low").isNotNull(), F.col("right_y")).otherwise(F.col("left_y")).alias("from")
    ).filter("low is not null")
    common = F.least("x1", "high") - F.greatest("x0", "low")
    inside = (F.col("y0") >= F.col("from") - slack) & (F.col("x1") <= F.col("high") + slack) & ((F.col("x0") >= F.col("low") - slack) | (common >= share * (F.col("x1") - F.col("x0"))))
    cell = lines.join(bounds, SHEET).filter(inside & ~T.is_title_junk(F.trim("text")))
    order = W.Window.partitionBy(*SHEET).orderBy(F.bround("y0"), "x0", "ord")
    return cell.select(*SHEET, F.row_number().over(order).alias("line"), "text")


def strip_boilerplate(lines: DataFrame) -> DataFrame:
    """album, sheet, title from title-block lines (album, sheet, line, text) without those that half of the filled sheets have."""
    rows = lines.withColumn("norm", T.norm_title(F.col("text"))).filter("norm <> ''")
    filled = rows.groupBy("album").agg(F.countDistinct("sheet").alias("filled"))
    often = rows.groupBy("album", "norm").agg(F.countDistinct("sheet").alias("n")).join(filled, "album").filter("n >= 0.5 * filled").select("album", "norm")
    kept = rows.join(often, ["album", "norm"], "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    title = F.trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["text"]), " "), r"(?U)\s+", " "))
    sheets = lines.select("album", "sheet").distinct()
    return sheets.join(kept.groupBy("album", "sheet").agg(title.alias("title")), ["album", "sheet"], "left").na.fill("", ["title"])


def split_parts(titles: DataFrame) -> DataFrame:
    """album, part, title, first_page, last_page, pages: runs of sheets whose titles are alike.

    Blank sheets belong to the title before, leading blanks to none.
    """
    w = W.Window.partitionBy("album").orderBy("sheet")
    t = titles.withColumn("at", F.row_number().over(w)).withColumn("named", F.when(F.col("title") != "", F.col("title")))
    t = t.withColumn("name", F.last(T.norm_title(F.col("named")), ignorenulls=True).over(w)).filter("name is not null")
    t = t.withColumn("new", F.when(F.coalesce(F.lag("name").over(w) == F.col("name"), F.lit(False)), 0).otherwise(1))
    t = t.withColumn("part", F.sum("new").over(w))
    return t.groupBy("album", "part").agg(F.min_by("named", "at").alias("title"), F.min("at").alias("first_page"), F.max("at").alias("last_page"), F.count(F.lit(1)).alias("pages"))


def classify_part(title: Column) -> Column:
    """(doc_type, reason): no type for titles that are skipped or not known."""
    norm = T.norm_title(title)
    pattern = lambda p: norm.rlike(f"(?iuU){p}")
    kind = F.when(pattern(TITLE_SKIP), F.lit(None).cast("string"))
    for p, doc_type in TITLE_TO_TYPE:
        kind = kind.when(pattern(p), doc_type)
    reason = F.when(pattern(TITLE_SKIP), "skipped").when(kind.isNotNull(), "matched").otherwise("unknown")
    return F.struct(kind.alias("doc_type"), reason.alias("reason"))


def classified(parts: DataFrame) -> DataFrame:
    return parts.withColumn("c", classify_part(F.col("title"))).select("*", "c.*").drop("c")


def cabinet_aliases(parts: DataFrame) -> DataFrame:
    """album, name, canonical: cabinets that share a function code are one; the most frequent name holds, of equals the first seen.

    Of several codes that rename a cabinet the last one counts.
    """
    rows = parts.withColumn("cabinet", T.detect_cabinet(F.col("title"))).filter("cabinet is not null")
    uses = rows.select("album", "part", "cabinet", F.explode(T.function_codes(F.col("title"))).alias("code"))
    names = uses.groupBy("album", "code", "cabinet").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("seen"))
    best = names.groupBy("album", "code").agg(F.max_by("cabinet", F.struct("n", -F.col("seen"))).alias("canonical"), F.count(F.lit(1)).alias("names")).filter("names > 1")
    others = names.join(best, ["album", "code"]).filter("cabinet <> canonical")
    return others.groupBy("album", F.col("cabinet").alias("name")).agg(F.max_by("canonical", "code").alias("canonical"))


def inherit_cabinet(parts: DataFrame) -> DataFrame:
    """The analysed parts with their cabinet: their own, by its canonical name; drawings without one take the last one named; else the common bundle."""
    rows = classified(parts).filter("doc_type is not null").withColumn("own", T.detect_cabinet(F.col("title")))
    named = rows.join(cabinet_aliases(parts).withColumnRenamed("name", "own"), ["album", "own"], "left").withColumn("own", F.coalesce("canonical", "own"))
    before = W.Window.partitionBy("album").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = F.when(F.col("doc_type") == "assembly", F.last("own", ignorenulls=True).over(before))
    return named.withColumn("cabinet", F.coalesce(F.col("own"), carried, F.lit(COMMON))).drop("own", "canonical", "reason")


def unique_part_names(parts: DataFrame) -> DataFrame:
    """``name`` of each part, numbered where a cabinet has it already in any case. parts: album, part, cabinet, doc_type, title."""
    name = F.concat(F.lit("("), "doc_type", F.lit(")"), T.safe_name(F.col("title")))
    again = F.row_number().over(W.Window.partitionBy("album", "cabinet", F.lower("plain")).orderBy("part"))
    return parts.withColumn("plain", name).withColumn("again", again).withColumn("name", F.when(F.col("again") > 1, F.concat("plain", F.lit(" #"), F.col("again").cast("string"))).otherwise(F.col("plain"))).drop("plain", "again")


def is_album(files: DataFrame, overrides: DataFrame, least: int = ALBUM_PAGES) -> DataFrame:
    """PDF files with many pages whose type nobody has given. files: path, name, pages; overrides: name."""
    return files.filter(F.lower("name").endswith(".pdf") & (F.col("pages") >= least)).join(overrides.select("name"), "name", "left_anti")


def split_report(parts: DataFrame) -> DataFrame:
    """album, reason, parts, pages: what was analysed and what not, and why."""
    return classified(parts).groupBy("album", "reason").agg(F.count(F.lit(1)).alias("parts"), F.sum("pages").alias("pages"))


def vote_cabinet(files: DataFrame) -> DataFrame:
    """folder, cabinet: the cabinet that most names of a folder's files give, of equals the first by name."""
    stem = F.regexp_replace(without_kind_marks(F.regexp_replace("name", r"\.[^.]*$", "")), r"[._\-]+", " ")
    votes = files.withColumn("cabinet", T.detect_cabinet(stem)).filter("cabinet is not null").groupBy("folder", "cabinet").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    w = W.Window.partitionBy("folder").orderBy(F.desc("n"), "first")
    return votes.withColumn("at", F.row_number().over(w)).filter("at = 1").select("folder", "cabinet", "n")


def parts_index(parts: DataFrame) -> DataFrame:
    """path of each part below its cabinet's folder, its album and pages there. parts: album, cabinet, name, first_page, last_page."""
    return parts.select(F.concat(T.safe_name(F.col("cabinet"), 60), F.lit("/"), "name", F.lit(".pdf")).alias("path"), "album", "first_page", "last_page")
