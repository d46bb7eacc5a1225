"""Signal lists, cable journals and parameter lists from the words and rulings of their pages.

words: document, page, ord, text, x0, x1, top, bottom; rulings as for ``tables``; pages: document, page, height.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean
from . import tables as T
from .carry import last_known, numbered
from .components import tabled

PAGE = T.PAGE
#: Headers stand in the top quarter of a page; only what reaches into the top tenth says where they end.
HEADER, HEADER_END, NO_HEADER = 0.25, 0.10, 40.0

# Fields of each list and what their headers hold; words of stamps, of repeated headers and of signals.
COLUMNS = {
    "signal_list": [("kks", ["обозначение"]), ("connection_address", ["адрес plc", "номер входа", "номер выхода", "адрес"]), ("terminal_type_or_ref", ["тип"]), ("note", ["описание"])],
    "cable_journal": [
        ("cable", ["обозначение"]), ("from", ["начало", "откуда"]), ("to", ["конец", "куда"]), ("segment", ["участок"]), ("brand", ["марка"]), ("section", ["сечение", "количество кабелей"]), ("length", ["длина"])
    ],
    "param_list": [("position", ["позиция"]), ("note", ["наименование"]), ("sheet_ref", ["лист схемы", "схемы"])],
}
STAMP = r"(?iu)^(изм|лист|№\s*док|подп|дата|формат|копировал|стадия|разраб|провер|н\.\s*контр|утв|соглас|гип|гап)(?![а-яёa-z])|^[\d.,/\s-]+$"
REPEATED = r"(?iu)пределы\s+измерений|шкала\s+прибора|сигнализация\s+вход|примечание|разраб|провер|утверд|инв\.|\.внИ|теплотранссервис|стадия\s+лист|лист\s+листов"
SIGNAL = r"(?iu)(СК\s*[НH][РPЗ3]?)?\s*([=~]\s*\d{1,3}\s*[ВVB])"
ROW_WIDTH = {"signal_list": 250.0, "cable_journal": 600.0, "param_list": 250.0}
SECTION_LENGTH = 120


@dataclass(frozen=True)
class Cells:
    """The cells of a row by column, and the columns by field."""

    cells: Column
    fields: Column

    def __getitem__(self, field: str) -> Column:
        return clean(F.try_element_at(self.cells, F.try_element_at(self.fields, F.lit(field))))


def header_cells(words: DataFrame, seps: DataFrame, pages: DataFrame) -> DataFrame:
    """document, page, column, text, bottom: the words over each column, and how far they reach down."""
    top = words.join(pages, PAGE).filter(F.col("top") < HEADER * F.col("height")).join(seps, PAGE)
    column = F.size(F.filter("seps", lambda s: s <= (F.col("x0") + F.col("x1")) / 2))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "ord", "text"))), lambda w: w["text"]), " ")
    end = F.coalesce(F.max(F.when(F.col("top") < HEADER_END * F.col("height"), F.col("bottom"))), F.lit(0.0))
    return top.groupBy(*PAGE, column.alias("column")).agg(text.alias("text"), end.alias("bottom"))


def leftmost_titled(headers: DataFrame) -> DataFrame:
    """document, page, column: the first column with words over it, where the designation stands if no header names it."""
    return headers.groupBy(*PAGE).agg(F.min("column").alias("column"))


def header_pages(headers: DataFrame, kind: str) -> DataFrame:
    """document, page, fields (column by field), header_bottom of the pages whose header names the columns that the list needs."""
    named = T.map_columns(headers, COLUMNS[kind]).join(headers.select(*PAGE, "column", "bottom"), [*PAGE, "column"])
    per = named.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("field", "column"))).alias("fields"), F.max("bottom").alias("header_bottom"))
    has = lambda f: F.map_contains_key("fields", F.lit(f))
    if kind != "cable_journal":
        return per.filter(has("connection_address" if kind == "signal_list" else "position"))
    per = per.join(leftmost_titled(headers).withColumnRenamed("column", "leftmost"), PAGE)
    free = ~has("cable") & ~F.array_contains(F.map_values("fields"), F.col("leftmost"))
    per = per.withColumn("fields", F.when(free, F.map_concat("fields", F.create_map(F.lit("cable"), "leftmost"))).otherwise(F.col("fields"))).drop("leftmost")
    return per.filter(has("cable") & (has("from") | has("to")))


def layouts(seps: DataFrame, headed: DataFrame, near: float = 3.0) -> DataFrame:
    """document, page, seps, fields, header_bottom: columns of the last header at or before a page, if the page's rulings agree with them."""
    rows = seps.join(headed, PAGE, "left")
    known = F.when(F.col("fields").isNotNull(), F.struct(F.col("seps").alias("seps"), F.map_entries("fields").alias("fields")))
    w = Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)  # a row for each page
    rows = rows.withColumn("layout", F.last(known, ignorenulls=True).over(w))
    same = (F.size("layout.seps") == F.size("seps")) & F.forall(F.arrays_zip(F.col("layout.seps").alias("a"), F.col("seps").alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= near)
    return rows.filter(F.coalesce(same, F.lit(False))).select(*PAGE, "layout.seps", F.map_from_entries("layout.fields").alias("fields"), F.coalesce("header_bottom", F.lit(NO_HEADER)).alias("header_bottom"))


def list_rows(words: DataFrame, rulings: DataFrame, pages: DataFrame, kind: str) -> DataFrame:
    """document, page, band, cells (text by column), fields: the rows below the header of every page that has the list's columns. Rows without words are left out."""
    # Both have a row for each page.
    seps = tabled(T.separators(rulings).filter(F.size("seps") > 0))
    used = tabled(layouts(seps, header_pages(header_cells(words, seps, pages), kind)))
    bands = T.row_bands(rulings, ROW_WIDTH[kind]).join(used.select(*PAGE, "header_bottom"), PAGE).filter(F.col("bottom") > F.col("header_bottom") + 2)
    placed = T.cells(words, used.select(*PAGE, "seps"), bands)
    per = placed.groupBy(*PAGE, "band").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("cells"))
    return tabled(per.join(used.select(*PAGE, "fields"), PAGE))


def stamp(c: Column) -> Column:
    return F.coalesce(c.rlike(STAMP), F.lit(False))


def finished(rows: DataFrame, section: Column | None, keep: Column, columns: list[Column]) -> DataFrame:
    """The rows to keep with their numbers, under the section named last above them in the document."""
    if section is not None:
        rows = last_known(rows, ["document"], ["page"], ["band"], section, "section")
    else:
        rows = rows.withColumn("section", F.lit(None).cast("string"))
    rows = numbered(rows.filter(keep), ["document"], ["page"], ["band"])
    return rows.select("document", "id", "page", *columns, "section")


def signal_list(words: DataFrame, rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """document, id, page, kks, connection_address, terminal_type_or_ref, note, section: a channel or signal in each row.

    A row without an address, stamp or digit names the section of those below it.
    """
    rows = list_rows(words, rulings, pages, "signal_list")
    c = Cells(F.col("cells"), F.col("fields"))
    rows = rows.select(*PAGE, "band", *[c[f].alias(f) for f, _ in COLUMNS["signal_list"]])
    address, tag = F.col("connection_address"), F.col("kks")
    heading = address.isNull() & tag.isNotNull() & ~stamp(tag) & ~tag.rlike(r"\d")
    keep = F.when(address.isNotNull(), ~stamp(address)).otherwise(tag.isNotNull() & ~stamp(tag) & tag.rlike(r"\d"))
    return finished(rows, F.when(heading, tag), keep, [F.col(f) for f, _ in COLUMNS["signal_list"]])


def cable_journal(words: DataFrame, rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """document, id, page, cable_harness, note, from_point, to_point, segment, cable_brand, cable_section, cable_length, section (null): a cable in each row that has one end at least."""
    rows = list_rows(words, rulings, pages, "cable_journal")
    c = Cells(F.col("cells"), F.col("fields"))
    names = {"cable": "cable_harness", "from": "from_point", "to": "to_point", "segment": "segment", "brand": "cable_brand", "section": "cable_section", "length": "cable_length"}
    rows = rows.select(*PAGE, "band", *[c[f].alias(n) for f, n in names.items()])
    keep = F.col("cable_harness").isNotNull() & ~stamp(F.col("cable_harness")) & F.coalesce("from_point", "to_point").isNotNull()
    note = F.concat(F.coalesce("from_point", F.lit("?")), F.lit(" -> "), F.coalesce("to_point", F.lit("?"))).alias("note")
    return finished(rows, None, keep, [F.col("cable_harness"), note, *[F.col(n) for n in list(names.values())[1:]]])


def param_list(words: DataFrame, rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """document, id, page, kks (position on the diagram), note, sheet_ref, signal_spec, section: a parameter in each row.

    A row without a position names the section, unless it is part of a stamp or of a repeated header. The page's margin (column 0) says nothing about it.
    """
    rows = list_rows(words, rulings, pages, "param_list")
    c = Cells(F.col("cells"), F.col("fields"))
    in_order = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"]), " ")
    spec = clean(F.regexp_extract(in_order(F.col("cells")), SIGNAL, 0))
    title = clean(in_order(F.map_filter("cells", lambda k, _: k > 0)))
    rows = rows.select(*PAGE, "band", c["position"].alias("kks"), c["note"].alias("note"), c["sheet_ref"].alias("sheet_ref"), spec.alias("signal_spec"), title.alias("title"))
    heading = F.col("kks").isNull() & (F.length("title") < SECTION_LENGTH) & ~stamp(F.col("title")) & ~F.col("title").rlike(REPEATED)
    return finished(rows, F.when(heading, F.col("title")), F.col("kks").isNotNull() & ~stamp(F.col("kks")), [F.col(n) for n in ("kks", "note", "sheet_ref", "signal_spec")])


LISTS = {"signal_list": signal_list, "cable_journal": cable_journal, "param_list": param_list}


def extract_lists(words: DataFrame, rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of every document in the list that its first page's header names (``table_kind``), with the columns of all lists."""
    kinds = tabled(T.detect_table_kind(words.join(pages, PAGE).withColumnRenamed("height", "page_height")))
    made = []
    for kind, extract in LISTS.items():
        own = kinds.filter(F.col("table_kind") == kind).select("document")
        made.append(extract(*(d.join(own, "document", "left_semi") for d in (words, rulings, pages))).withColumn("table_kind", F.lit(kind)))
    return made[0].unionByName(made[1], allowMissingColumns=True).unionByName(made[2], allowMissingColumns=True)
