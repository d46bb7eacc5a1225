"""Types of spans in six profiles, each met, and the order of rules."""

import pytest
from pyspark.sql import functions as F

from docaudit.functions.profiles import PROFILES, classify_span

# What offices write, and what it is.
SPANS = {
    "A": {"Лист": "page_frame", "F": "page_frame", "-": "glyph", "FB_OPEN": "signal_state", "A1": "power_pin", "Резерв": "reserve_label", "12С": "coil_terminal", "/15.2:D": "cross_ref", "DI7": "io_channel", "2,5 мм²": "wire_gauge", "R500 DI 16": "module_partno",
          "4х2х0,5": "cable_type", "00USE10CL001": "instrument_tag", "XPA3": "device_tag", "X2": "power_pin", "U": "device_tag", "12-3": "pin_ref", "1234": "terminal_no", "ИК.1234-5": "doc_number", "04.25": "date", "Схема соединения модуля": "long_text", "12345": "unclassified", "2XF1": "unclassified"},
    "B": {"Формат А2": "page_frame", "Форматы": "signal_label", "/4.9.2": "cross_ref", "DO1,2A": "io_channel", "AI1-R": "io_channel", "AO": "io_channel", "2/L": "power_pin", "L3": "power_pin", "48 B": "voltage", "0В": "power_pin", "0,05А": "current_rating", "15 м": "cable_length", "4x1": "wire_gauge",
          "МВ210-212": "module_partno", "-W.H25.1": "cable_tag", "W1": "cable_tag", "кввгнг-LS": "cable_type", "GNYE": "wire_color", "NO": "contact_type", "Резервный": "reserve_label", "00USE10CL001": "instrument_tag", "-2XT.AP": "device_tag", "RJ-45": "unclassified", "7-1": "pin_ref", "7": "terminal_no",
          "+G2": "location_ref", "12-345-6789-АБ": "doc_number", "04.25": "date", "AA13.1.1 Затвор": "equipment_entry", "Авария": "signal_label", "А - ": "unclassified", "Model HDR-30-24 of a supply": "long_text"},
    "C": {"Копировал": "page_frame", "(:3D)": "cross_ref", "DVP04AD-S2": "module_partno", "V1+": "module_pin", "S/S": "module_pin", "AI": "io_channel", "1/L1": "power_pin", "24VDC": "power_pin", "TA": "relay_contact", "COM": "power_pin", "NC": "contact_type", "=24В": "voltage", "C6A/30мА": "current_rating",
          "5x16": "wire_gauge", "шнк 4х11 3L": "cable_type", "РЕЗЕРВ 2": "reserve_label", "026.809.01.01-ИПК": "doc_number", "XT-AI1": "device_tag", "7-1": "pin_ref", "250": "terminal_no", "04.25": "date", "АВАРИЯ НАСОСА 1": "signal_label", "ТОК 2": "signal_label", "Т1 + 2": "unclassified"},
    "D": {"№пров.": "page_frame", "ПЛК110-24.60.Р-М": "module_partno", "МУ110-224.16Р": "module_partno", "МВ210-212": "unclassified", "2DI1": "io_channel", "AI-R": "io_channel", "B2": "power_pin", "13N1": "wire_marking", "A411": "wire_marking", "~220В/+24В": "voltage", "1P+N-C16": "breaker_spec",
          "30мА": "current_rating", "200/5": "ct_ratio", "4 (0V)": "pin_signal", "RS-485": "interface", "пвс 3х1": "cable_type", "резерв": "reserve_label", "026.808.01-ИПК": "doc_number", "2XT-G1": "device_tag", "7-1": "pin_ref", "777": "terminal_no", "04.25": "date", "Линия QFD1": "signal_label"},
    "E": {"инв.": "page_frame", "24-051-АК": "doc_number", "Лист 10.5": "cross_ref", "1XT1:PE": "pin_ref", "АT601.2": "instrument_tag", "-V (-0V)": "power_pin", "1,5 мм²": "wire_gauge", "DR-120": "cable_type", "10.2": "sheet_stamp", "04.25": "sheet_stamp", "XTG": "device_tag", "ЕL1.1": "device_tag", "7-1": "pin_ref",
          "1234": "terminal_no", "Питание ~ 220": "signal_label"},
    "F": {"Стадия": "page_frame", "СТМД.14747.75.07-Э3": "doc_number", "(Л11)": "cross_ref", "RS485-1": "interface", "S9F22110": "module_partno", "32015DEK+32017DEK": "module_partno", "24-1": "wire_marking", "7-1": "wire_marking", "U": "power_pin", "RC": "relay_contact", "NO": "contact_type", "24 В": "voltage",
          "С10A": "current_rating", "1x2x0,60 (6)": "wire_gauge", "3.1АW1": "cable_tag", "W2": "cable_tag", "Сегмент 1": "cable_type", "BK": "wire_color", "П7-М1": "device_tag", "АКБ1": "device_tag", "046": "terminal_no", "04.25": "date", "Пуск насоса": "signal_label"},
}


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(p, t, 4.0, 300.0, 800.0) for p, texts in SPANS.items() for t in texts]
    d = spark.createDataFrame(rows, "profile string, text string, size double, y0 double, height double")
    return {(r.profile, r.text): r.kind for r in d.select("profile", "text", classify_span(F.col("text"), F.col("profile"), F.col("size"), F.col("y0"), F.col("height")).alias("kind")).collect()}


@pytest.mark.parametrize("profile", SPANS)
def test_types(classified, profile):
    assert {t: classified[profile, t] for t in SPANS[profile]} == SPANS[profile]


@pytest.mark.parametrize("profile", SPANS)
def test_every_type_is_met(profile):
    hidden = {"E": {"date"}, "F": {"pin_ref"}}.get(profile, set())  # numbers of sheets and of wires look the same and come first
    assert {k for k, _ in PROFILES[profile].rules} - hidden <= set(SPANS[profile].values())


def test_digits_by_their_place(spark):
    rows = [("7", 300.0, 800.0), ("7", 20.0, 800.0), ("7", 780.0, 800.0), ("7", None, 800.0), ("7", 779.9, None), (None, 1.0, 1.0), ("  7\n", 300.0, 800.0), ("a" * 16, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "text string, y0 double, height double").coalesce(1)
    for p in ("A", "F", "?"):
        got = [r.k for r in d.select(classify_span(F.col("text"), p, F.lit(None).cast("double"), F.col("y0"), F.col("height")).alias("k")).collect()]
        assert got == ["terminal_no", "page_frame", "page_frame", "page_frame", "page_frame", "unclassified", "terminal_no", "unclassified"]
