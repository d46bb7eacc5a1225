"""What has to hold when tables grow: no rows through the driver, no bounds on sheets and pages."""

import random
import time

import pytest

from docaudit import registry
from docaudit.operators import logs, nets, spans, tables

SF = "/root/testdata/sf0.01"
DEALT = [
    "net19_gauge_vs_width", "net20_issue_candidates", "net9_nearest_labels", "net16_page_graph", "net10_describe_endpoints", "net12_assemble_nets", "net13_terminal_index", "net15_net_summary",
]


@pytest.mark.parametrize("name", DEALT)
def test_no_cells_ends_or_labels_go_through_the_driver(spark, name):
    rows = registry.queries()[name](spark, SF)
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_crossings_on_a_dense_sheet(spark):
    level = "'D' as document, 1 as sheet, id as seg, 0d as x1, id * 10d as y1, 5d as x2, id * 10d as y2, 0.5d as width"
    wires = spark.range(20_001).selectExpr(*level.split(", ")).union(spark.range(1).selectExpr("'D'", "1", "99999L", "2d", "25d", "2d", "45d", "0.5d"))
    dots = spark.createDataFrame([("D", 1, 2.0, 40.0)], "document string, sheet int, ox double, oy double")
    got = {(r.a, r.b, r.x, r.y, r.has_dot) for r in nets.wire_crossings(wires, dots).collect()}
    assert got == {(3, 99999, 2.0, 30.0, False), (4, 99999, 2.0, 40.0, True)}


LINES, RULES = "document string, page int, ord int, text string, xc double, yc double", "document string, page int, y double"


def test_rows_by_anchor_match_one_pass(spark):
    rng = random.Random(5)
    lines = [("D", p, o, rng.choice(["1", "2,5", "a", "b", None]), rng.choice([10.0, 100.0]), float(rng.randrange(12) * 5)) for p in range(1, 5) for o in range(60 if p < 4 else 3)]
    lines += [("D", 9, 1, "a", 10.0, 5.0), ("D", 8, 1, "7", 100.0, 5.0), ("D", 8, 2, "a", 10.0, 1.0)]
    rules = sorted({("D", rng.randrange(1, 5), rng.randrange(60) + 0.5) for _ in range(25)})
    want = {}
    for p in {x[1] for x in lines}:
        page = sorted((x for x in lines if x[1] == p), key=lambda x: (x[5], x[4], x[2]))
        at = sorted((x[5], x[2]) for x in page if x[4] == 100.0 and x[3] in ("1", "2,5", "7"))
        edges = []
        for (y, _), (z, _) in zip(at, at[1:], strict=False):
            between = [r[2] for r in rules if r[1] == p and y < r[2] < z]
            edges.append(between[0] if len(between) == 1 else (y + z) / 2)
        for x in page if at else []:
            own = want.setdefault((p, 1 + sum(e <= x[5] for e in edges)), [])
            own += [x[3]] if x[3] is not None else []
    got = tables.rows_by_anchor(spark.createDataFrame(lines, LINES), spark.createDataFrame(rules, RULES), 95.0, 105.0).collect()
    assert {(r.page, r.row): r.text for r in got} == {k: " ".join(t) for k, t in want.items()}


def test_rows_by_anchor_of_a_long_page(spark):
    n = 100_000
    lines = spark.range(n).selectExpr("'D' as document", "1 as page", "cast(id as int) as ord", "if(id % 2 = 0, '1', 'a') as text", "if(id % 2 = 0, 100d, 10d) as xc", "cast(id as double) as yc")
    began = time.time()
    got = tables.rows_by_anchor(lines, spark.createDataFrame([], RULES), 95.0, 105.0)
    assert got.filter("text = if(row = 1, '1', 'a 1')").count() == n // 2 - 1 and got.count() == n // 2
    assert time.time() - began < 60  # pairs of lines and numbers would take far longer


def test_tags_split_on_a_full_sheet(spark):
    rows = [("D", 1, 1, "XM", "plain", 0.0, 0.0, 20.0, 5.0), ("D", 1, 99, "5", "plain", 22.0, 0.0, 25.0, 5.0)] + [("D", 1, i, "note", "plain", 1.0 + i / 10, 50.0, 30.0, 55.0) for i in range(2, 90)]
    d = spark.createDataFrame(rows, "document string, sheet int, ord int, text string, font string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.ord, r.other, r.text) for r in spans.merge_split_tags(d).collect()] == [(1, 99, "XM5")]


def test_transcript_begins_between_messages(spark):
    """The last characters are the last message and none, one or both of the line ends before it."""
    d = spark.createDataFrame([(1, 0, "assistant", "message", "first"), (1, 1, "computer", None, "second")], "conv_id long, turn int, role string, type string, text string")
    label = {"first": "[рассуждение агента]\n", "second": "[вывод кода]\n"}
    whole = "\n\n".join(label[t] + t for t in label)
    own = len(label["second"] + "second")
    for total in range(own - 1, own + 5):
        assert logs.transcript(d, 100, total).first().transcript == logs.CUT + whole[-total:]


@pytest.mark.parametrize("turned", [1, -1])
def test_lines_of_one_place_have_an_order(spark, turned):
    rows = [("D", 1, 1, "AA10"), ("D", 1, 1, "AA11"), ("D", 1, 2, "DI1"), ("D", 1, 3, "Насос включен"), ("D", 2, 1, "DI2"), ("D", 2, 2, "Клапан закрыт")]
    d = spark.createDataFrame(rows[::turned], "document string, sheet int, ord int, text string").coalesce(1)
    got = {(r.sheet, r.module, r.channel, r.description) for r in spans.io_channels(d).collect()}
    assert got == {(1, "AA11", "DI1", "Насос включен"), (2, "AA11", "DI2", "Клапан закрыт")}
