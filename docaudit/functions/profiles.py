"""Types of text spans on schemes, by the house style (profile) of a drawing office.

A profile is data: words of the page frame, and rules (type, pattern) of which the first that fits decides. Patterns hold for Java
and RE2 alike; ``(?i)`` ignores case in Cyrillic, too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    frame_words: tuple[str, ...]
    rules: tuple[tuple[str, str], ...]
    frame: str | None = None  # a pattern beside the words


#: Distance from the upper and lower edge of the page in which a single digit names a zone of the frame.
MARGIN = 20.0
LEAST_LETTERS = 3  # of a signal's caption
LONG, LONG_SIZE = 15, 3.0  # a text of more characters in larger type is prose

# The words and patterns of each profile, in their order.
GRID_DIGIT, GLYPHS = r"^[1-9]$", ("-", "/", "+")
PIN, NUMBER, DATE, CONTACTS = r"^\d{1,2}-\d$", r"^\d{1,4}$", r"^\d{2}\.\d{2}$", r"^(NO|NC|COM)$"
COLOURS = r"^(BK|BN|BU|GY|GN|RD|WH|YE|OG|VT|PK|GD|SR|TQ|GNYE|BUWH|RDWH|GNWH|WHBU|WHBN|RDBU|YEGN)$"
FORMAT = r"^Формат([^А-Яа-яЁёA-Za-z0-9_]|$)"
B_DEVICE = r"-?\d{0,2}(\.\d{1,2})?[A-Z]{1,3}(\d{1,3}(\.[A-ZА-Я0-9]{1,5})*|(\.[A-ZА-Я0-9]{1,5})+)[а-яА-Я]?\*?"
EF_DEVICE = r"^-?\d{0,2}[A-ZА-Я]{1,4}(\d{1,3}([.\-][A-ZА-Я0-9]{1,5})*|([.\-][A-ZА-Я0-9]{1,5})+)?$"
PROFILES = {
    "A": Profile(
        ("Формат  А3", "Инв.N подл.", "Взам. инв. N", "Подп. и дата", "Лист", "Подп.", "№док.", "Дата", "Изм.", "Кол.уч", "Зам.", "A", "B", "C", "D", "E", "F"),
        (
            ("signal_state", r"^(FB_[A-Z]+|C_[A-Z]+)$"), ("power_pin", r"^(PE|0V|\+24|24V|X1|X2|X3|A1|A2|L|N)$"), ("reserve_label", r"^Резерв$"), ("coil_terminal", r"^\d{1,2}С$"),
            ("cross_ref", r"^/?\d{1,3}\.\d{1,2}:[A-F]$"), ("io_channel", r"^(AI|AO|DI|DO)\d{1,2}$"), ("wire_gauge", r"^\d+([.,]\d+)?\s*мм²$"), ("module_partno", r"^R500\s"),
            ("cable_type", r"^\d+[хx]\d+[хx][\d,.]+$|^КДВВГ"), ("instrument_tag", r"^00[A-Z]{2,4}\d{2}[A-Z]{2}\d{3}$|^00CJF02"),
            ("device_tag", r"^(AA|BA|CA|CB|RA|RB|XM|XB|XA|XT|XP[AB]|XS|QF|SF|SQ|VD|EL|SK|SFD|FU|U)\d{0,3}$"), ("pin_ref", PIN), ("terminal_no", NUMBER), ("doc_number", r"^ИК\."), ("date", DATE),
        ),
    ),
    "B": Profile(
        ("Формат", "Формат  А3", "Формат А3", "Формат  А4", "Формат А4", "Инв. № подл.", "Взам. инв. №", "Подп. и дата", "Лист", "Листов", "Подп.", "№ док", "№ док.", "Дата", "Изм.", "Кол.уч", "Кол. уч.", "Зам.",
         "Согласовано", "Разраб.", "Пров.", "Н. контр.", "Утв.", "Примечание:", "Наименование", "Поз.", "Поз", "обозначение", "Примечание", "Кол.", "Кол", "Наимен.", "A", "B", "C", "D", "E", "F"),
        (
            ("cross_ref", r"^/?\d{1,3}\.\d{1,2}\.\d{1,2}$"), ("io_channel", r"^(AI|AO|DI|DO)\d{1,2}([,.\-](\d{1,2}|[A-DR]))?[A-DR]?$|^(AI|AO|DI|DO)$"),
            ("power_pin", r"^(PE|0V|0В|\+24|24V|X1|X2|X3|A1|A2|L|N|L1|L2|L3)$"), ("power_pin", r"^\d/(L\d?|N|PE)$"), ("voltage", r"^[+\-]?\d{1,3}([.,]\d+)?\s*[BВvV]$"),
            ("current_rating", r"^\d{1,3}([.,]\d+)?\s*[AА]$"), ("cable_length", r"^\d{1,4}\s*м$"), ("wire_gauge", r"^\d+[xх]\d+([xх][\d.,]+)?$"), ("module_partno", r"^М[ВУКР]\d{3}(-\d{2,3})?$"),
            ("cable_tag", r"^-?\d{0,2}(\.\d{1,2})?WA?(\d{1,3}(\.[A-ZА-Я0-9]{1,5})*|(\.[A-ZА-Я0-9]{1,5})+)[а-яА-Я]?\*?$"), ("cable_type", r"(?i)ВВГ|КВВГ|МКЭШ|КВК|КГ|ПвПг|ПуГВ|ParLan|LiYCY|РК\s?75|КИПЭВ"),
            ("wire_color", COLOURS), ("contact_type", CONTACTS), ("reserve_label", r"^(Резерв|Резервный)$"), ("instrument_tag", r"^00[A-Z]{2,4}\d{2}[A-Z]{2}\d{3}$"), ("device_tag", rf"^{B_DEVICE}$"), ("pin_ref", PIN),
            ("terminal_no", NUMBER), ("location_ref", r"^\+[A-ZА-Я0-9]"), ("doc_number", r"^\d{2}-\d{3}-\d{4}-[А-Я]{2,4}$|^\d{5}-\d-\d-[А-Я]{2}$"), ("date", DATE), ("equipment_entry", rf"^({B_DEVICE})\s+[А-Яа-яЁё]"),
            ("signal_label", r"^[А-Яа-яЁё][А-Яа-яЁё /.,()«»\-+№]{2,39}$"),
        ),
        FORMAT,
    ),
    "C": Profile(
        ("Формат  А3", "Формат А3", "Формат  А4", "Инв.N подл.", "Инв. N подл.", "Взам. инв. N", "Подп. и дата", "Копировал", "Лист", "Листов", "Подп.", "№док.", "№ док.", "Дата", "Изм.", "Кол.уч", "Зам.", "Разраб.", "Пров.",
         "Н.контр.", "Н. контр.", "Утв.", "Т.контр.", "A", "B", "C", "D", "E", "F"),
        (
            ("cross_ref", r"^\(\d{0,3}:\d{1,2}[A-F]\)$"), ("module_partno", r"^DVP[0-9A-Z][0-9A-Z\-]*$"), ("module_pin", r"^([VI]\d{0,2}[+\-]|S/S)$"), ("io_channel", r"^(AI|AO|DI|DO)\d{0,2}$"), ("power_pin", r"^[A-Z0-9]/[LT]\d$"),
            ("power_pin", r"^(PE|XPE|N|L[123]?|FG|GND|ACM|DCM|COM|0V|0В|24VDC|24G|SG[+\-]|ZP|PH|UP|A1|A2|X\d{1,2})$"), ("relay_contact", r"^[RT][ABC]$"), ("contact_type", CONTACTS), ("voltage", r"^[=~+\-]?\d{1,3}([.,]\d+)?\s*[BВvV]$"),
            ("current_rating", r"^[A-DK]?\d{1,3}([.,]\d+)?\s?[AА](/\d{1,3}\s?м?[АA])?$"), ("wire_gauge", r"^\d+[xх]\d+([xх][\d.,]+)?$"), ("cable_type", r"(?i)ШНК|ВВГ|КВВГ|МКЭШ|ПВС|КГ|КИПЭВ"), ("reserve_label", r"(?i)^резерв"),
            ("doc_number", r"^\d{3}\.\d{3}\.\d{2}\.\d{2}-[А-Я]"), ("device_tag", r"^-?\d{0,2}[A-Z]{1,3}(\d{1,3}([.\-][A-ZА-Я0-9]{1,5})*|([.\-][A-ZА-Я0-9]{1,5})+)[а-яА-Я]?$"), ("pin_ref", PIN), ("terminal_no", NUMBER), ("date", DATE),
            ("signal_label", r"^[А-ЯЁ][А-ЯЁа-яё /.,()«»\-+№\d]{2,39}$"),
        ),
        FORMAT,
    ),
    "D": Profile(
        ("Формат А3", "Формат  А3", "Формат А4", "Инв. N подл.", "Инв.N подл.", "Взам. инв. N", "Подпись и дата", "Подп. и дата", "Согласовано", "Изм.", "Кол.уч", "Кол. уч.", "Подп.", "Дата", "№док.", "№ док.", "Лист", "Листов", "Зам.", "Разраб.",
         "Пров.", "Н.контр.", "Утв.", "Копировал", "Конт.", "№пров.", "Поз.", "Наименование", "Кол.", "Примечание", "A", "B", "C", "D", "E", "F"),
        (
            ("module_partno", r"^(ПЛК|МВ|МУ|МК|МДВВ)\d{2,3}-[\d.]*\.\d+[А-Яа-яЁёA-Za-z0-9_.\-]*$|^(ПЛК|МВ|МУ|МК|МДВВ)\d{2,3}[-.][\d.]*[А-ЯЁ]+[А-Яа-яЁёA-Za-z0-9_.\-]*$|^СЭТ-"), ("io_channel", r"^\d{0,2}(AI|AO|DI|DO)\d{0,2}(-[\dR])?$"),
            ("power_pin", r"^(PE|XPE|XN\d?|N\d?|L[123]?|FG|GND|GWG|0V|0В|\+?24V?|\+V|24V|A1|A2|B1|B2|C1|C2|PWR[+\-]|COM\d{0,2}|S/S|X\d{1,2})$"), ("wire_marking", r"^\d{1,2}[ABCN]\d{1,3}$|^[ABCN]\d{3}$"),
            ("voltage", r"^[=~+\-]?\d{1,3}([.,]\d+)?\s?(V(AC|DC)?|[BВ])(/[+\-]?\d{1,3}\s?[BВV])?$"), ("breaker_spec", r"^\d[PР](\+[NН])?-[A-DСC]\d{1,3}$"), ("current_rating", r"^[A-DСC]?\d{1,3}([.,]\d+)?\s?м?[AА]$"), ("ct_ratio", r"^\d{2,4}/\d{1,2}$"),
            ("pin_signal", r"^\d{1,2}\s?\([^)]{1,6}\)$"), ("interface", r"^(RS-?\d{3}[-А-Яа-яЁёA-Za-z0-9_]*|RJ\d{2}|DB9[-А-Яа-яЁёA-Za-z0-9_]*|485[AB](/[А-Яа-яЁёA-Za-z0-9_]+)?|DEBUG|ETH\d?)$"),
            ("cable_type", r"(?i)ВБШв|ВВГ|КВВГ|МКЭШ|ПВС|КГ|ШВВП|ПуГВ|КИПЭВ"), ("reserve_label", r"(?i)^резерв"), ("doc_number", r"^\d{3}\.\d{3}\.\d{2}(\.\d{2})?-[А-Я]"),
            ("device_tag", r"^-?\d{0,2}[A-Z]{1,3}(\d{1,3}([-.][A-ZА-Я0-9]{1,4})*|([-.][A-ZА-Я0-9]{1,4})+)$"), ("pin_ref", PIN), ("terminal_no", NUMBER), ("date", DATE), ("signal_label", r"^[А-Яа-яЁё][А-Яа-яЁёA-Za-z0-9 /.,()«»№\-+]{2,39}$"),
        ),
        FORMAT,
    ),
    "E": Profile(
        ("Взам", "Взам.", ".", "инв.", "№", "Подп. и дата", "Инв.", "подл.", "Изм.", "Кол.", "уч.", "Лист", "№док.", "Подп.", "Дата", "A3", "A4", "Примечание:"),
        (
            ("doc_number", r"^\d{2}-\d{3}-[A-ZА-Я]{2,4}$"), ("cross_ref", r"^Лист\s+\d{1,3}\.\d{1,2}$"), ("pin_ref", r"^\d{0,2}X[TM]?\d{0,2}:(\d{1,3}|PE)$"), ("instrument_tag", r"^[AА][TТ]\d{2,4}\.\d{1,2}$"),
            ("power_pin", r"^(PE|РЕ|L|N|L1|L2|L3|[+\-]?24V|[+\-]?0V|A1|A2|BAT\+|BAT-|[+\-]V(\s?\([+\-]\d?[0Vv]+\))?)$"), ("wire_gauge", r"^\d+([.,]\d+)?\s*мм²$"), ("cable_type", r"(?i)DR-|DRS-|КДВВГ"), ("sheet_stamp", r"^\d{1,3}\.\d{1,2}$"),
            ("device_tag", EF_DEVICE), ("pin_ref", PIN), ("terminal_no", NUMBER), ("date", DATE), ("signal_label", r"^[А-Яа-яЁё][А-Яа-яЁёA-Za-z0-9 /.,()«»№\-+~]{2,49}$"),
        ),
    ),
    "F": Profile(
        ("Инв. № подп.", "Инв. N подл.", "Взаим. инв. №", "Взам. инв. N", "Подл. и дата", "Согласовано", "Подпись и дата", "Лист", "Листов", "Изм.", "Кол.уч.", "Стадия", "№док.", "N док.", "Подпись", "Подп.", "Дата", "Разраб.", "Проверил",
         "Утв", "Формат А3", "A", "B", "C", "D"),
        (
            ("doc_number", r"^[А-Я]{2,6}\.\d{3,6}\.\d{1,3}\.\d{1,3}-Э\d$"), ("cross_ref", r"^\(Л\d{1,3}\)$"), ("interface", r"^RS-?\d{3}(-\d{1,2})?$"),
            ("module_partno", r"^S9[A-Z]\d{4,6}$|^SXG\d{2}[A-Z]{2}$|^HM[A-Z0-9]{3,10}$|^HD\d{3,6}[A-Z]?$|^ST[A-Z]\d{3}[A-Z0-9\-]*$|^NSE[A-Z0-9]{6,16}$|^DRC-\d{2,4}[A-Z]?$|^DT\d{4,6}$|^PK\d{3}-\d{2}$|^\d{5}DEK(\+\d{5}DEK)?$"),
            ("wire_marking", r"^\d{1,3}-\d{1,2}$"), ("power_pin", r"^(PE|РЕ|N|L|L1|L2|L3|U|V|W|[AА]1|[AА]2|24V|0V|FG|GND|RS\+|RS-)$"), ("relay_contact", r"^[RT][ABC]$"), ("contact_type", CONTACTS), ("voltage", r"^[+\-]?\d{1,3}([.,]\d+)?\s?[BВvV]$"),
            ("current_rating", r"^[CС]?\d{1,3}([.,]\d+)?\s?м?[AА]$"), ("wire_gauge", r"^\d+[xх]\d+([.,]\d+)?([xх]\d+([.,]\d+)?)?(\s*\(\d+\))?$"), ("cable_tag", r"^\d{0,2}(\.\d{1,2})?[A-ZА-Я]?W\d{0,2}$"),
            ("cable_type", r"(?i)нг\(А\)|-HF|Сегмент|МКШВ|КГВЭВ|ППГ|ВВГ|КВВГ"), ("wire_color", COLOURS), ("device_tag", EF_DEVICE), ("pin_ref", PIN), ("terminal_no", NUMBER), ("date", DATE),
            ("signal_label", r"^[А-Яа-яЁё][А-Яа-яЁёA-Za-z0-9 /.,()«»№\-+~]{2,59}$"),
        ),
    ),
}
DEFAULT = "A"


@dataclass(frozen=True)
class Channels:
    """How a profile writes the lines of a channel list: module and channel lines, tags within a line, lines that say nothing."""

    module: str
    channel: str
    equipment: str
    junk: tuple[str, ...]
    instrument: str = r"\b(00[A-Z0-9]{9,11})\b"


# The patterns of channel lists in each profile.
PLC = r"^((?:ПЛК|МВ|МУ)\d{2,3}[-.][\d.]+[-.А-ЯЁA-Z\d]*)\s*$"
CHANNELS = {
    "A": Channels(
        r"^([A-C]A\d{2})\s*$", r"^(DI|AI|DO|AO)\s*(\d{1,2})\s*$", r"\b(\d{1,2}[A-Z]{1,3}\d{1,2})\b",
        (r"(?i)^\d+[.,]?\d*\s*м?м²", r"^\d+[õxх]\d+[xх]\d+", r"^\d{1,4}$", r"^\d+-\d+", r"^/[0-9]+\.[0-9]:[A-F]", r"^[A-Z]{2}\d+:\d+", r"^X[A-Z]\d+", r"^PE$", r"^\d+W\d+$", r"^FB_[A-Z]+", r"^C_[A-Z_]+", r"(?i)КДВВГнг|КДВВГ|LS",
         r"^[A-C]A\d{2}:[A-B]\d", r"^RB\d{2}:\d+[A-Z]?", r"^RA\d{2}:\d+[A-Z]?", r"^Формат\s+А\d+", r"^Инв\.?\s*N\s*подл", r"^Взам\.?\s*инв", r"^Подп\.?\s*и\s*дата", r"^Лист$", r"^Подп\.?$", r"^№\s*док", r"^Дата$", r"^Изм\.?$",
         r"^Кол\.?\s*уч", r"^Зам\.?$", r"^ИК\.\d{4}-", r"^Схема\s+соединения\s+модуля", r"^Подключение\s+ПЛК"),
    ),
    "B": Channels(
        r"^(AA\d{2}|М[ВУК]\d{3}-\d{2,3})\s*$", r"^(DI|AI|DO|AO)\s*(\d{1,2})\s*$", r"\b(-?\d{0,2}[A-ZА-Я]{1,3}\d{1,2}(?:\.[A-ZА-Я0-9]{1,4})?)\b",
        (r"(?i)^\d+[.,]?\d*\s*м?м²", r"^\d+[xх]\d+([xх][\d.,]+)?$", r"^\d{1,4}$", r"^\d+-\d+", r"^/\d+\.\d+\.\d+", r"^\d{1,3}\s*[BВ]$", r"^\d{1,3}([.,]\d+)?\s*[AА]$", r"^\d{1,4}\s*м$", r"(?i)ВВГ|КВВГ|МКЭШ|LS|ParLan", r"^PE$", r"^Формат",
         r"^Инв\.?\s*№\s*подл", r"^Взам\.?\s*инв", r"^Подп\.?\s*и\s*дата", r"^Лист(ов)?$", r"^Подп\.?$", r"^№\s*док", r"^Дата$", r"^Изм\.?$", r"^Согласовано$", r"^Примечание"),
    ),
    "C": Channels(
        r"^(DVP[0-9A-Z\-]+)\s*$", r"^(DI|AI|DO|AO)\s*(\d{1,2})\s*$", r"\b(-?\d{0,2}[A-ZА-Я]{1,3}\d{1,2}(?:[.\-][A-ZА-Я0-9]{1,4})?)\b",
        (r"^\d{1,4}$", r"^\(\d*:\d+[A-F]\)$", r"^\d{1,3}\s*[BВ]$", r"(?i)ШНК|ВВГ|КВВГ|МКЭШ", r"^PE$|^N$|^FG$", r"^Формат", r"^Инв\.?\s*N\s*подл", r"^Взам\.?\s*инв", r"^Подп", r"^Лист(ов)?$", r"^№\s*док", r"^Дата$", r"^Изм\.?$", r"^Копировал$"),
    ),
    "D": Channels(
        r"^((?:ПЛК|МВ|МУ|МК)\d{2,3}[-.][\d.]+[-.А-ЯЁA-Z\d]*)\s*$", r"^\d{0,2}(DI|AI|DO|AO)\s*(\d{1,2})\s*$", r"\b(-?\d{0,2}[A-ZА-Я]{1,3}\d{1,2}(?:[-.][A-ZА-Я0-9]{1,4})?)\b",
        (r"^\d{1,4}$", r"^\d{1,3}\s?V(AC|DC)?$", r"^[A-DСC]?\d{1,3}\s?м?[АA]$", r"(?i)ВБШв|ВВГ|КВВГ|МКЭШ", r"^(PE|N|L[123]?|FG|GND|XPE|XN\d?)$", r"^Формат", r"^Инв\.?\s*N\s*подл", r"^Взам\.?\s*инв", r"^Подп", r"^Лист(ов)?$", r"^№\s*(док|пров)", r"^Дата$",
         r"^Изм\.?$", r"^Кол\.?\s*уч", r"^Согласовано$", r"^Конт\.$"),
    ),
    "E": Channels(
        PLC, r"^\d{0,2}(DI|AI|DO|AO)\s*(\d{1,2})\s*$", r"\b(-?\d{0,2}[A-ZА-Я]{1,4}\d{1,3}(?:[.\-][A-ZА-Я0-9]{1,4})?)\b",
        (r"^\d{1,4}$", r"^\d{1,3}\.\d{1,2}$", r"^Лист\s+\d", r"^(PE|РЕ|L|N|L1|L2|L3)$", r"^Взам", r"^инв\.?$", r"^Подп", r"^Изм\.?$", r"^Кол\.?$", r"^уч\.?$", r"^№", r"^Дата$", r"^Примечание"),
    ),
    "F": Channels(
        PLC, r"^\d{0,2}(DI|AI|DO|AO)\s*(\d{1,2})\s*$", r"\b(-?\d{0,2}[A-ZА-Я]{1,4}\d{1,3}(?:[.\-][A-ZА-Я0-9]{1,4})?)\b",
        (r"^\d{1,4}$", r"^\d{1,3}-\d{1,2}$", r"^\(Л\d{1,3}\)$", r"(?i)^\d+[xх]\d+", r"^[CС]?\d{1,3}([.,]\d+)?\s?м?[AА]$", r"^(PE|РЕ|N|L|L1|L2|L3)$", r"^Инв\.", r"^Взаим", r"^Взам", r"^Подп", r"^Подл", r"^Лист(ов)?$", r"^Изм\.?$", r"^Согласовано$", r"^Формат"),
    ),
}


def java(pattern: str) -> str:
    return pattern.replace("(?i)", "(?iu)")


def ladder(t: Column, p: Profile, grid: Column, prose: Column) -> Column:
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    framed = t.isin(*p.frame_words) | (t.rlike(p.frame) if p.frame else F.lit(False))
    first = F.when(framed, F.lit("page_frame")).when(t.rlike(GRID_DIGIT), grid).when(t.isin(*GLYPHS), F.lit("glyph"))

    def after(c: Column, rule: tuple[str, str]) -> Column:
        kind, pattern = rule
        fits = t.rlike(java(pattern))
        return c.when(fits & (letters >= LEAST_LETTERS) if kind == "signal_label" else fits, F.lit(kind))

    return reduce(after, p.rules, first).when(prose, F.lit("long_text")).otherwise(F.lit("unclassified"))


def classify_span(text: Column, profile: Column | str, size: Column, y0: Column, height: Column) -> Column:
    """The type of a span. ``size`` is its type size, ``y0`` its upper edge on a page of this height; profiles that are not known count as A.

    Null text is unclassified; a digit without a place counts as part of the frame; null sizes are small.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    edge = (y0 <= MARGIN) | (y0 >= height - MARGIN)
    grid = F.when(edge.isNull() | edge, F.lit("page_frame")).otherwise(F.lit("terminal_no"))
    prose = (F.length(t) > LONG) & t.rlike(r"\p{L}") & F.coalesce(size > LONG_SIZE, F.lit(False))
    name = F.lit(profile) if isinstance(profile, str) else profile
    rest = ladder(t, PROFILES[DEFAULT], grid, prose)
    others = [p for p in PROFILES if p != DEFAULT]
    return reduce(lambda c, p: c.when(name == p, ladder(t, PROFILES[p], grid, prose)), others[1:], F.when(name == others[0], ladder(t, PROFILES[others[0]], grid, prose))).otherwise(rest)
