"""Reconstruction of tables from ruling lines and rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean, parse_designators, to_number


def column_separators(rulings: DataFrame, share: float = 0.5, near: float = 3.0) -> DataFrame:
    """document, sheet, x: where vertical lines add up to at least ``share`` of the sheet's longest; a
    line within ``near`` of the last one kept belongs to it."""
    at = F.round("x1").alias("x")
    length = rulings.filter("abs(x1 - x2) <= 1 and y1 <> y2").groupBy("document", "sheet", at).agg(F.sum(F.abs(F.col("y2") - F.col("y1"))).alias("length"))
    top = F.max("length").over(Window.partitionBy("document", "sheet"))
    xs = length.withColumn("top", top).filter(F.col("length") >= share * F.col("top")).groupBy("document", "sheet").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    kept = F.aggregate("xs", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) > near), F.concat(a, F.array(x))).otherwise(a))
    return xs.select("document", "sheet", F.explode(kept).alias("x"))


def carry_section(rows: DataFrame, by: str, order: str, heading: str) -> DataFrame:
    """section: the last non-empty heading at or above a row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(F.col(heading) != "", F.col(heading)), ignorenulls=True).over(w))


PAGE = ["document", "page"]


def separators(rulings: DataFrame, share: float = 0.35, min_x: float = 50.0, least: float = 5.0, near: float = 3.0) -> DataFrame:
    """document, page, seps: x of a page's columns, from upright lines and narrow boxes; page margins and short strokes do not count.

    rulings: document, page, x0, y0, x1, y1, is_rect. A line within ``near`` of the last one kept belongs to it.
    """
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    upright = F.when(F.col("is_rect"), w < 2.5).otherwise(w < 1.0) & (h >= least)
    length = rulings.filter(upright).groupBy(*PAGE, F.bround("x0").alias("x")).agg(F.sum(h).alias("length"))
    top = F.max("length").over(Window.partitionBy(*PAGE))
    strong = length.withColumn("top", top).filter((F.col("length") >= share * F.col("top")) & (F.col("x") >= min_x))
    kept = F.aggregate("xs", F.array().cast("array<double>"), lambda a, x: F.when(F.coalesce(x - F.try_element_at(a, F.lit(-1)) > near, F.lit(True)), F.concat(a, F.array(x))).otherwise(a))
    return strong.groupBy(*PAGE).agg(F.array_sort(F.collect_list("x")).alias("xs")).select(*PAGE, kept.alias("seps"))


def row_bands(rulings: DataFrame, min_width: float, low: float = 8.0, high: float = 45.0) -> DataFrame:
    """document, page, band, top, bottom: rows between level lines. Pieces at one height add up; heights within 2 belong to the first of them."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    level = F.when(F.col("is_rect"), h < 2.5).otherwise(h < 1.0)
    at = rulings.filter(level).groupBy(*PAGE, F.bround(F.least("y0", "y1")).alias("y")).agg(F.sum(w).alias("width"))
    item = F.struct("y", "width")

    def step(a, x):
        last = F.try_element_at(a, F.lit(-1))
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["y"].alias("y"), (last["width"] + x["width"]).alias("width"))))
        return F.when(F.coalesce(x["y"] - last["y"] <= 2, F.lit(False)), joined).otherwise(F.concat(a, F.array(x)))

    merged = F.aggregate("ys", F.array().cast("array<struct<y:double,width:double>>"), step)
    rows = at.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("ys")).select(*PAGE, F.explode(merged).alias("m")).select(*PAGE, "m.*").filter(F.col("width") >= min_width)
    below = F.lead("y").over(Window.partitionBy(*PAGE).orderBy("y"))
    bands = rows.withColumn("bottom", below).filter((F.col("bottom") - F.col("y")).between(low, high))
    return bands.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("y")).alias("band"), F.col("y").alias("top"), "bottom")


def cells(words: DataFrame, seps: DataFrame, bands: DataFrame) -> DataFrame:
    """document, page, band, column, text: the words of each cell in reading order. A word's middle gives its column, its top the band."""
    edges = bands.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("top", "bottom", "band"))).alias("bands"))
    rows = words.join(seps, PAGE).join(edges, PAGE)
    band = F.get(F.filter("bands", lambda b: (F.col("top") >= b["top"] - 0.5) & (F.col("top") < b["bottom"] - 0.5)), F.lit(0))["band"]
    column = F.size(F.filter("seps", lambda s: s <= (F.col("x0") + F.col("x1")) / 2))
    placed = rows.select(*PAGE, band.alias("band"), column.alias("column"), F.bround("top").alias("line"), "x0", "ord", "text").filter("band is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "ord", "text"))), lambda x: x["text"]), " ")
    return placed.groupBy(*PAGE, "band", "column").agg(F.trim(text).alias("text"))


def carry_layout(pages: DataFrame, near: float = 3.0) -> DataFrame:
    """document, page, layout: the columns that a page is read by: its own under a header, else those of the last header page if its lines agree.

    pages: document, page, seps, has_header. Pages that agree with no header are left out.
    """
    w = Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("layout", F.last(F.when(F.col("has_header"), F.col("seps")), ignorenulls=True).over(w))
    same = (F.size("layout") == F.size("seps")) & F.forall(F.arrays_zip(F.col("layout").alias("a"), F.col("seps").alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= near)
    return rows.filter(F.col("has_header") | F.coalesce(same, F.lit(False))).select("document", "page", "layout")


def detect_table_kind(words: DataFrame) -> DataFrame:
    """document, table_kind by the words in the top quarter of the first page. words: document, page, ord, text, top, page_height."""
    head = words.filter((F.col("page") == 1) & (F.col("top") < 0.25 * F.col("page_height"))).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("w"))
    head = head.withColumn("head", F.lower(F.regexp_replace(F.array_join(F.transform("w", lambda x: x["text"]), " "), r"(?U)\s+", " ")))
    has = lambda *texts: [F.contains("head", F.lit(t)) for t in texts]
    # Words of a table's header.
    position, scheme, alarm, limits, spare, signal, plc, inlet, outlet, cable, start, end, whence, whither = has(
        "позиция", "схеме", "сигнализация", "пределы измерений", "резервирование", "описание сигнала", "адрес plc", "номер входа", "номер выхода", "кабел", "начало", "конец", "откуда", "куда"
    )
    kind = F.when(position & scheme & (alarm | limits | spare), "param_list").when(signal & (plc | inlet | outlet), "signal_list").when(cable & ((start & end) | (whence & whither)), "cable_journal").otherwise("gost_connections")
    return words.select("document").distinct().join(head.select("document", kind.alias("table_kind")), "document", "left").na.fill("gost_connections", ["table_kind"])


# Headers of a wiring table and the fields that they name.
COLUMN_NAMES = {
    "Кабель,жгут": "cable_harness", "Кабель, жгут": "cable_harness", "Маркировка цепи": "circuit_marking", "KKS": "kks", "Проводник": "conductor", "Шкаф": "cabinet", "Клеммник/модуль": "terminal_block",
    "Штифт": "pin", "Тип клеммы/модуля": "terminal_type_or_ref", "Адрес связи": "connection_address", "Примечание": "note",
}


def build_connections(rows: DataFrame) -> DataFrame:
    """document, id, all fields and terminal_address from rows whose cells are a map by header: document, ord, cells."""
    names: dict[str, list[str]] = {}
    for header, field in COLUMN_NAMES.items():
        names.setdefault(field, []).append(header)
    bare = lambda c: F.nullif(F.trim(c), F.lit(""))
    # Of several headers for a field the last one that the row has holds.
    value = lambda headers: F.coalesce(*[F.when(F.map_contains_key("cells", h), F.coalesce(bare(F.col("cells")[h]), F.lit("\x00"))) for h in reversed(headers)])
    out = rows.select("document", F.row_number().over(Window.partitionBy("document").orderBy("ord")).alias("id"), *[F.nullif(value(h), F.lit("\x00")).alias(f) for f, h in names.items()])
    return out.withColumn("terminal_address", F.concat("cabinet", F.lit("."), "terminal_block", F.lit("."), "pin"))


def rows_by_anchor(lines: DataFrame, rules: DataFrame, low: float, high: float) -> DataFrame:
    """document, page, row, text: lines gathered to table rows, one for each number in the quantity column (middle between ``low`` and ``high``).

    Two rows part at the single ruling between their numbers, else halfway. lines: document, page, ord, text, xc, yc; rules: document, page, y.
    """
    numbers = lines.filter(F.col("xc").between(low, high) & to_number(F.trim("text")).isNotNull())
    # Numbers at one height part there, so heights and their counts tell all edges.
    anchors = numbers.groupBy(*PAGE, "yc").agg(F.count(F.lit(1)).alias("n")).withColumn("next", F.lead("yc").over(Window.partitionBy(*PAGE).orderBy("yc")))
    ys = rules.groupBy(*PAGE).agg(F.collect_list("y").alias("ys"))
    between = F.filter(F.coalesce("ys", F.array().cast("array<double>")), lambda y: (y > F.col("yc")) & (y < F.col("next")))
    edge = F.when(F.size(between) == 1, F.get(between, F.lit(0))).otherwise((F.col("yc") + F.col("next")) / 2)
    edges = anchors.join(ys, PAGE, "left").select(*PAGE, edge.alias("y"), F.lit(1).alias("n")).unionByName(anchors.select(*PAGE, F.col("yc").alias("y"), (F.col("n") - 1).alias("n")))
    heights = lines.select(*PAGE, F.col("yc").alias("y")).distinct().join(anchors.select(*PAGE).distinct(), PAGE, "left_semi")
    upto = F.sum("n").over(Window.partitionBy(*PAGE).orderBy("y"))  # with the edges at the height itself; the last row has none
    rows = edges.filter("y is not null").withColumn("line", F.lit(False)).unionByName(heights.withColumns({"n": F.lit(0), "line": F.lit(True)}))
    rows = rows.withColumn("row", (upto + 1).cast("int")).filter("line").select(*[F.col(c).alias(f"of {c}") for c in PAGE], "y", "row")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("xc", "ord", "text"))), lambda x: x["text"])
    per = lines.groupBy(*PAGE, "yc").agg(texts.alias("texts"))
    same = [F.col(c) == F.col(f"of {c}") for c in PAGE]
    placed = per.join(rows, [*same, F.col("yc").eqNullSafe(F.col("y"))])
    text = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("yc", "texts"))), lambda x: x["texts"])), " ")
    return placed.groupBy(*PAGE, "row").agg(text.alias("text"))


def spec_rows(rows: DataFrame) -> DataFrame:
    """The items among a specification's rows, under the section named last above them, with their designators.

    rows: document, row, position, name, code, quantity. Rows of column numbers, empty ones, headings and legends are no items.
    """
    c = lambda n: clean(F.col(n))
    r = rows.select("document", "row", c("position").alias("position"), c("name").alias("name"), c("code").alias("code"), to_number(F.col("quantity")).alias("quantity"))
    numbers = F.filter(F.array("position", "name", "code"), lambda x: x.isNotNull())
    numbered = (F.size(numbers) >= 2) & F.forall(numbers, lambda x: x.rlike("^[0-9]{1,2}$"))
    heading = F.col("name").isNotNull() & F.col("quantity").isNull() & F.col("code").isNull() & F.col("position").isNull()
    section = F.when(heading & F.col("name").rlike("(?iu)^(дополнен|дополнительно|раздел|изменени)"), F.col("name"))
    w = Window.partitionBy("document").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    legend = F.coalesce(F.col("name").rlike(r"^\s*[-–—]\s*\S"), F.lit(False)) & F.col("quantity").isNull()
    empty = F.col("name").isNull() & F.col("code").isNull() & F.col("quantity").isNull()
    r = r.withColumn("section", F.last(section, ignorenulls=True).over(w)).filter(~(numbered | heading | legend | empty))
    return r.withColumn("designators", parse_designators(F.col("position")))


def number_row(lines: DataFrame, least: int = 5) -> DataFrame:
    """document, page, y: the first row of cells that counts 1, 2, 3 ... up to ``least`` or more. lines: document, page, ord, text, xc, yc."""
    per = lines.groupBy(*PAGE, F.bround(F.col("yc") / 4).alias("line")).agg(F.min("yc").alias("y"), F.array_sort(F.collect_list(F.struct("xc", "ord", F.trim("text").alias("t")))).alias("w"))
    counted = F.transform("w", lambda x: x["t"].try_cast("int"))
    good = (F.size("w") >= least) & (counted == F.sequence(F.lit(1), F.size("w")))
    return per.filter(F.coalesce(good, F.lit(False))).groupBy(*PAGE).agg(F.min("y").alias("y"))


# Fields of a specification and what their headers begin with or hold.
SPEC_COLUMNS = [
    ("position", ["позиция", "поз."]), ("name", ["наименование и техническая характеристика", "наименование"]), ("type_mark", ["тип, марка", "тип,марка"]), ("code", ["код оборудования", "код изделия", "код обору"]),
    ("manufacturer", ["завод-изготовитель", "завод изготовитель", "изготовитель"]), ("unit", ["единица измерения", "ед. изм", "единица"]), ("quantity", ["количество", "кол-во", "кол."]),
    ("mass", ["масса единицы", "масса ед", "масса"]), ("note", ["примечание"]),
]


def map_columns(headers: DataFrame, patterns: list[tuple[str, list[str]]] = SPEC_COLUMNS) -> DataFrame:
    """document, page, field, column: columns from left to right take the first field that fits their header and that no column has yet.

    headers: document, page, column, text. White space and case do not matter.
    """
    norm = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    rows = headers.select(*PAGE, "column", norm.alias("text")).filter("text <> ''").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("column", "text"))).alias("headers"))

    def step(taken, header):
        free = lambda f: ~F.exists(taken, lambda t: t["field"] == f)
        fits = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(header["text"], w))
        field = F.coalesce(*[F.when(fits(words) & free(f), F.lit(f)) for f, words in patterns])
        return F.when(field.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(field.alias("field"), header["column"].alias("column")))))

    kind = dict(headers.dtypes)["column"]
    found = F.aggregate("headers", F.array().cast(f"array<struct<field:string,column:{kind}>>"), step)
    return rows.select(*PAGE, F.explode(found).alias("f")).select(*PAGE, "f.*")


def header_bottom(lines: DataFrame, patterns: list[tuple[str, list[str]]] = SPEC_COLUMNS, share: float = 0.4, gap: float = 4.0) -> DataFrame:
    """document, page, bottom: how far down the header of a table reaches that has no row of column numbers.

    It holds every line of the upper ``share`` of the page that names a field, and all that follows below without a clear
    ``gap``: the wrapped words of narrow columns. lines: document, page, ord, text, y0, y1, page_height. Pages that name no field are left out.
    """
    norm = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    names = F.array(*[F.lit(w) for _, words in patterns for w in words])
    top = lines.filter(F.col("y0") <= share * F.col("page_height"))
    top = top.withColumn("named", F.max(F.when(F.exists(names, lambda w: F.contains(norm, w)), F.col("y1"))).over(Window.partitionBy(*PAGE))).filter("named is not null")
    # From top to bottom: the first line below all before it, and below the named ones, ends the header.
    above = Window.partitionBy(*PAGE).orderBy("y0", "y1", "ord")
    reach = F.greatest("named", F.max("y1").over(above.rowsBetween(Window.unboundedPreceding, -1)))
    top = top.withColumn("apart", (F.col("y0") > reach + gap).cast("int"))
    top = top.withColumn("gaps", F.sum("apart").over(above.rowsBetween(Window.unboundedPreceding, 0))).filter("gaps = 0")
    return top.groupBy(*PAGE).agg(F.greatest(F.max("named"), F.max("y1")).alias("bottom"))
