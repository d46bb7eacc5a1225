"""Joins of points and lines on a sheet through a grid, so that only what lies close meets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHEET = ["document", "sheet"]


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def cells_of(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(cell(low, size), cell(high, size)))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that deals both sides to the tasks.

    Spark judges derived rows by the size of the files behind them, which is far too small for cells, ends and labels, and would send them through the driver.
    """
    return rows.hint("merge")


def within(points: DataFrame, others: DataFrame, dx: float, dy: float) -> DataFrame:
    """Pairs of points (px, py) and others (ox, oy) of a sheet at most dx and dy apart. Each other point goes to the nine cells around it."""
    a = points.withColumn("cx", cell(F.col("px"), dx)).withColumn("cy", cell(F.col("py"), dy))
    b = others.withColumn("cx", cells_of(F.col("ox") - dx, F.col("ox") + dx, dx)).withColumn("cy", cells_of(F.col("oy") - dy, F.col("oy") + dy, dy))
    return a.join(dealt(b), [*SHEET, "cx", "cy"]).filter((F.abs(F.col("px") - F.col("ox")) <= dx) & (F.abs(F.col("py") - F.col("oy")) <= dy)).drop("cx", "cy")


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def apart() -> Column:
    return distance(F.col("px") - F.col("ox"), F.col("py") - F.col("oy"))


def near_lines(points: DataFrame, lines: DataFrame, reach: float, size: float) -> DataFrame:
    """Pairs of points (px, py) and lines (x1, y1, x2, y2) of a sheet whose box, ``reach`` wider, holds the point."""
    a = points.withColumn("cx", cell(F.col("px"), size)).withColumn("cy", cell(F.col("py"), size))
    box = {f"{f}{c}": fn(f"{c}1", f"{c}2") for c in "xy" for f, fn in (("low_", F.least), ("high_", F.greatest))}
    b = lines.withColumns(box).withColumn("cx", cells_of(F.col("low_x") - reach, F.col("high_x") + reach, size)).withColumn("cy", cells_of(F.col("low_y") - reach, F.col("high_y") + reach, size))
    inside = F.col("px").between(F.col("low_x") - reach, F.col("high_x") + reach) & F.col("py").between(F.col("low_y") - reach, F.col("high_y") + reach)
    return a.join(dealt(b), [*SHEET, "cx", "cy"]).filter(inside).drop("cx", "cy", *box)


def along() -> Column:
    """Place of a point's foot along a line, 0 at its first end and 1 at its second; null for a line without length."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    return F.when(square >= 1e-6, ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / square)


def from_line(t: Column) -> Column:
    """Distance of a point from the place ``t`` of a line."""
    x, y = F.col("x1") + t * (F.col("x2") - F.col("x1")), F.col("y1") + t * (F.col("y2") - F.col("y1"))
    return distance(F.col("px") - x, F.col("py") - y)


def middle(spans: DataFrame, x: str = "ox", y: str = "oy") -> DataFrame:
    """Spans with the middle of their box."""
    return spans.withColumns({x: (F.col("x0") + F.col("x1")) / 2, y: (F.col("y0") + F.col("y1")) / 2}).drop("x0", "y0", "x1", "y1")
