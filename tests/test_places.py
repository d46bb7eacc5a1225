"""State over sheets, stitched texts, title cells and lists on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from docaudit.operators import album, carry, lists, nets, rules_bundle, rules_single, spans, tables

BOX = "document string, sheet int, ord int, text string, entity_type string, x0 double, y0 double, x1 double, y1 double"


def box(ord_, text, x0, y0, x1, y1, kind="other", sheet=1):
    return ("D", sheet, ord_, text, kind, float(x0), float(y0), float(x1), float(y1))


def test_state_is_carried_like_one_pass(spark):
    rng = random.Random(2)
    rows = [(f"D{d}", s, o, rng.choice([None, None, None, f"v{o}"])) for d in range(3) for s in range(1, 8) for o in range(rng.randint(0, 6))]
    want, state = {}, {}
    for d, s, o, v in rows:
        state[d] = v or state.get(d)
        want[d, s, o] = state[d]
    frame = spark.createDataFrame(rows, "document string, sheet int, ord int, v string").repartition(5)
    got = carry.last_known(frame, ["document"], ["sheet"], ["ord"], F.col("v"), "w").collect()
    assert {(r.document, r.sheet, r.ord): r.w for r in got} == want
    count = {}
    numbers = {(d, s, o): count.setdefault(d, []).append(1) or len(count[d]) for d, s, o, _ in rows}
    assert {(r.document, r.sheet, r.ord): r.id for r in carry.numbered(frame, ["document"], ["sheet"], ["ord"]).collect()} == numbers


def channels(spark, lines, profile="A"):
    d = spark.createDataFrame([("D", s, i, t) for i, (s, t) in enumerate(lines)], "document string, sheet int, ord int, text string")
    return {(r.sheet, r.module, r.channel): (r.description, r.tags) for r in spans.io_channels(d, profile).collect()}


def test_a_module_holds_over_sheets(spark):
    got = channels(spark, [(1, "DI1"), (1, "до модуля"), (1, "AA12"), (1, "ничей"), (2, "DI 2"), (2, "Насос 00USE10CL001 включен 12KM3"), (2, "Лист"), (3, "ещё"), (3, "DI2"), (3, "третий"), (3, "DI2"), (3, "снова"), (3, "BA01"), (3, "DI2")])
    assert got == {(2, "AA12", "DI2"): ("Насос включен ещё", ["00USE10CL001", "12KM3"]), (3, "AA12", "DI2"): ("третий снова", []), (3, "BA01", "DI2"): ("", [])}


def test_channels_of_another_profile(spark):
    got = channels(spark, [(1, "МВ210-212"), (1, "AI 3"), (1, "Давление -2XT.AP1 в баке"), (1, "15 м"), (1, "ok"), (1, "да")], "B")
    assert got == {(1, "МВ210-212", "AI3"): ("Давление -2XT. в баке", ["AP1"])}


def test_heads_take_numbers_in_turn(spark):
    rows = [box(1, "1XT5:", 0, 0, 20, 5), box(2, "1XT6:", 0, 4, 21, 9), box(3, "3", 22, 2, 25, 7), box(4, "4", 25, 3, 28, 8), box(5, "1XT7:", 50, 0, 54, 20), box(6, "9", 50, 22, 53, 27), box(7, "8", 61, 0, 64, 5), box(8, "1XT8:", 80, 0, 90, 100), box(9, "7", 92, 90, 95, 98)]
    d = spark.createDataFrame(rows, BOX)
    got = {r.ord: (r.other, r.address) for r in spans.stitch_pin_refs(d).collect()}
    assert got == {1: (3, "1XT5:3"), 2: (4, "1XT6:4"), 5: (6, "1XT7:9")}  # the last head is read downwards, so the number beside it is not its own
    assert {(r.ord, r.text) for r in spans.stitched(d).collect()} == {(1, "1XT5:3"), (2, "1XT6:4"), (5, "1XT7:9"), (7, "8"), (9, "7")}


def test_split_addresses_count_twice(spark):
    rows = [box(1, "1XT5:", 0, 0, 20, 5), box(2, "3", 21, 0, 24, 5), box(3, "1XT5:3", 100, 0, 120, 5), box(4, "1XT5:3", 101, 0, 121, 5, sheet=2), box(5, "1XT5:3", 101, 1, 121, 6, sheet=2)]
    got = spans.dup_addresses(spark.createDataFrame(rows, BOX)).collect()
    assert [(r.sheet, r.address, r.n, [(p.x, p.y) for p in r.positions]) for r in got] == [(1, "1XT5:3", 2, [(10.0, 2.5), (110.0, 2.5)])]


def test_split_coils(spark):
    rows = [box(1, "2KL", 0, 0, 12, 5, "device_tag"), box(2, "2", 13, 0, 16, 5), box(3, "A1", 5, 10, 8, 14), box(4, "a2", 5, 20, 8, 24), box(5, "1KL1", 300, 0, 312, 5, "device_tag"), box(6, "A1", 300, 10, 303, 14)]
    assert [(r.designator, r.ord) for r in spans.relay_coils(spark.createDataFrame(rows, BOX)).collect()] == [("2KL2", 1)]


def test_tall_letters_find_their_number(spark):
    rows = [box(1, "PT", 0, 0, 80, 60), box(2, "101", 10, 100, 60, 120), box(3, "TE", 500, 0, 510, 8), box(4, "7", 500, 60, 505, 66)]
    assert {(r.tag, r.split) for r in spans.instrument_tags(spark.createDataFrame(rows, BOX)).collect()} == {("PT101", True)}


def test_links_on_a_graph(spark):
    rows = [box(1, "AA14:B1", 0, 0, 20, 5), box(2, "x", 30, 0, 35, 5), box(3, "QF1", 40, 0, 50, 5, "device_tag"), box(4, "/4.9:D", 60, 1, 80, 6, "cross_ref"), box(5, "/5.1:A", 60, 40, 80, 46, "cross_ref"), box(6, "KL1", 0, 39, 10, 45, "device_tag"), box(7, "/x", 0, 200, 5, 205, "cross_ref")]
    lines = spark.createDataFrame([("D", 1, 11, 75.0, 5.0, 200.0, 5.0)], "document string, sheet int, line int, x1 double, y1 double, x2 double, y2 double")
    got = {r.ord: (r.target_sheet, r.target_column, r.target_zone, r.line, r.node, r.device_pin) for r in nets.graph_links(spark.createDataFrame(rows, BOX), lines).collect()}
    assert got == {4: (4, 9, "D", 11, 1, "AA14:B1"), 5: (5, 1, "A", None, None, "KL1")}


def test_owners_by_marking(spark):
    rows = [(1, None, "101", None, "1"), (2, "", "", "XT", None), (3, "Резерв", "101", None, None), (4, "00USE", None, "XT", "2"), (5, " ", "102", "XT", "")]
    d = spark.createDataFrame([("D", *r) for r in rows], "document string, id int, kks string, circuit_marking string, terminal_block string, pin string")
    assert {(r.id, r.owner) for r in rules_single.missing_terminal(d).collect()} == {(1, "101"), (5, "102")}


def test_statistics_of_a_table(spark):
    rows = [("C1", "XT1", "1", "BK", "резерв 3", None), ("C1", "XT1", "1", "BU", None, "Резерв"), ("C1", "XT2", "", "BK", None, "x"), ("C1", None, "1", "", "", "")]
    d = spark.createDataFrame([("D", i, *r) for i, r in enumerate(rows)], "document string, page int, cabinet string, terminal_block string, pin string, conductor string, circuit_marking string, kks string")
    r = rules_single.table_stats(d).first()
    assert (r.n, r.pages, r.blocks, r.roles, r.reserve, r.duplicate_addresses) == (4, 3, ["XT1", "XT2"], ["BK", "BU"], 2, {"C1.XT1.1": 2})
    assert {k: v for k, v in r.filled.items() if v} == {"circuit_marking": 1, "kks": 2, "conductor": 3, "cabinet": 4, "terminal_block": 3, "pin": 3} and len(r.filled) == 10


def test_sides_are_compared_within_a_bundle(spark):
    table = spark.createDataFrame([("B1", "N1", "XT1", "1", "101"), ("B2", "N2", "ХТ01", "pe", None), ("B2", "N2", "", "3", " ")], "bundle string, document string, block string, pin string, marking string")
    drawn = spark.createDataFrame([("B2", "E2", "XT1", "1"), ("B2", "E2", "XT1", "PE")], "bundle string, document string, block string, pin string")
    marks = spark.createDataFrame([("B1", "E1", "101"), ("B2", "E2", "101")], "bundle string, document string, marking string")
    got = {(r.bundle, r.what, r.place, r.only_in, r.document) for r in rules_bundle.netlist_vs_scheme(table, drawn, marks).collect()}
    assert got == {("B1", "terminal", "XT1:1", "table", "N1"), ("B2", "terminal", "XT1:1", "scheme", "E2"), ("B2", "marking", "101", "scheme", "E2")}
    tags = lambda *rows: spark.createDataFrame(list(rows), "bundle string, document string, tag string")
    got = rules_bundle.instrument_links(tags(("B1", "F", "PT01"), ("B2", "F", "TE5")), tags(("B2", "J", "PT1"), ("B2", "J", "TE05"))).collect()
    assert {(r.bundle, r.tag, r.only_in, r.document) for r in got} == {("B1", "PT1", "diagram", "F"), ("B2", "PT1", "journal", "J")}


def titles(spark, lines, rulings):
    a = spark.createDataFrame([("A", 1, i, *r) for i, r in enumerate(lines)], "album string, sheet int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([("A", 1, *r) for r in rulings], "album string, sheet int, x0 double, y0 double, x1 double, y1 double, is_rect boolean")
    return [r.text for r in album.title_cell(a, b).orderBy("line").collect()]


def test_title_cells(spark):
    stage, dates = ("Стадия", 500.0, 600.0, 530.0, 610.0), ("Дата", 250.0, 590.0, 280.0, 600.0)
    title = [("Схема", 310.0, 620.0, 400.0, 630.0), ("щита ЩС1", 310.0, 610.0, 480.0, 620.0), ("12.05 Общий вид", 290.0, 640.0, 400.0, 650.0), ("Объект", 310.0, 611.0, 520.0, 619.0), ("фамилия", 100.0, 640.0, 200.0, 650.0), ("Лист", 310.0, 650.0, 330.0, 660.0), ("выше", 310.0, 500.0, 400.0, 510.0)]
    ruled = [(x, 580.0, x, 700.0, False) for x in (100.0, 128.0, 300.0, 482.0, 484.0, 530.0)] + [(490.0, 590.0, 490.0, 592.0, False), (495.0, 400.0, 495.0, 599.0, True)]
    assert titles(spark, [stage, dates, *title], ruled) == ["щита ЩС1", "Схема", "12.05 Общий вид"]
    assert titles(spark, [stage, dates, *title], []) == ["щита ЩС1", "Схема", "12.05 Общий вид"]  # between the captions, as there are no rulings
    assert titles(spark, [dates, *title], ruled) == ["щита ЩС1", "Объект", "Схема", "12.05 Общий вид"]
    assert titles(spark, title, ruled) == []


@pytest.fixture(scope="module")
def journal(spark):
    """Two pages of a journal whose designation no header names, and one of another table."""
    words, rulings = [], []
    for page, rows in ((1, [("W1", "ЩС1", "ЩС2", "ВВГ"), ("", "ЩС1", "ЩС2", ""), ("Подп.", "x", "y", "")]), (2, [("W2", "ЩС1", "", "КГ 3х1"), ("W3", "", "", "КГ")]), (3, [("W4", "a", "b", "c")])):
        shift = 15.0 if page == 3 else 0.0
        if page == 1:
            words += [(page, t, 70.0 + 100 * i, 30.0) for i, t in enumerate(("№ ка-", "Начало", "Конец", "Марка"))]
        words += [(page, t, 70.0 + 100 * i + 25 * j + shift, 105.0 + 20 * k) for k, row in enumerate(rows) for i, cell in enumerate(row) for j, t in enumerate(cell.split())]
        rulings += [(page, 60.0 + 100 * i + shift, 20.0, 60.0 + 100 * i + shift, 300.0, i % 2 == 0) for i in range(5)] + [(page, 60.0, 80.0 + 20 * k, 760.0, 80.0 + 20 * k, False) for k in range(len(rows) + 2)]
    w = spark.createDataFrame([("J", p, i, t, x, x + 10, y, y + 6) for i, (p, t, x, y) in enumerate(words)], "document string, page int, ord int, text string, x0 double, x1 double, top double, bottom double")
    r = spark.createDataFrame([("J", *x) for x in rulings], "document string, page int, x0 double, y0 double, x1 double, y1 double, is_rect boolean")
    return w, r, spark.createDataFrame([("J", p, 400.0) for p in (1, 2, 3)], "document string, page int, height double")


def test_cable_journal(journal):
    got = [(r.id, r.page, r.cable_harness, r.note, r.cable_brand) for r in lists.cable_journal(*journal).orderBy("id").collect()]
    assert got == [(1, 1, "W1", "ЩС1 -> ЩС2", "ВВГ"), (2, 2, "W2", "ЩС1 -> ?", "КГ 3х1")]


def test_lists_of_nothing(spark, journal):
    w, r, p = (d.filter("page > 9") for d in journal)
    assert [lists.LISTS[k](w, r, p).count() for k in lists.LISTS] == [0, 0, 0]
    assert lists.signal_list(*journal).count() == 0 and lists.param_list(*journal).count() == 0


def test_header_grows_to_a_gap(spark):
    rows = [("Код обору-", 40.0, 48.0), ("дования,", 50.0, 60.0), ("изделия", 63.0, 70.0), ("K1", 74.5, 80.0), ("K2", 60.0, 66.0), ("Количество", 330.0, 340.0)]
    d = spark.createDataFrame([("D", 1, i, t, a, b, 800.0) for i, (t, a, b) in enumerate(rows)] + [("E", 1, 1, "K1", 1.0, 2.0, 800.0)], "document string, page int, ord int, text string, y0 double, y1 double, page_height double")
    assert [tuple(r) for r in tables.header_bottom(d).collect()] == [("D", 1, 70.0)]
