"""Keys and predicates over text, as Column expressions.

Classes and word boundaries are Unicode ones (``(?U)``) wherever a text may be Cyrillic.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters that look like Latin ones, capitals and the seven small ones.
LOOKALIKES = ("АВЕКМНОРСТУХ" + "аеорсух", "ABEKMHOPCTYX" + "aeopcyx")
# Severities from worst to least.
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Comparison key of article codes: look-alikes to Latin, upper case, no white space; null gives ''."""
    return F.regexp_replace(F.upper(F.translate(F.coalesce(c, F.lit("")), *LOOKALIKES)), r"(?U)\s+", "")


def fold_designator(c: Column) -> Column:
    """``fold`` without leading zeros of each run of digits."""
    return F.regexp_replace(fold(c), "(?<![0-9])0+(?=[0-9])", "")


def text_tokens(c: Column) -> Column:
    """Distinct folded designator tokens of a text, empty ones dropped."""
    edge = r"""[.,;:()\[\]«»"']+"""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)[\s,;]+"), lambda x: fold_designator(F.regexp_replace(x, f"^{edge}|{edge}$", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def to_number(c: Column) -> Column:
    """Decimal comma allowed; what is no number gives null."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def clean(c: Column) -> Column:
    """White space collapsed; empty gives null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def norm_title(c: Column) -> Column:
    return F.translate(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), "ё", "е")


def severity_rank(c: Column) -> Column:
    out = F.lit(9)
    for i, s in enumerate(SEVERITIES):
        out = F.when(c == s, i).otherwise(out)
    return out


def approx_tokens(c: Column) -> Column:
    """Tokens of a text when its usage is not known: a quarter of its characters, half-even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(c) / 4).cast("long"))


def clip_text(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def function_codes(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Z]{2,4}\d{3})\b")))


# Patterns of catalogue numbers, terminal marks, PLC channels, ratings in volts, project numbers, spreadsheet errors.
ARTICLE_TOKEN = r"[A-Za-z][A-Za-z0-9./\-]{4,}|[A-Za-z0-9./\-]{5,}"
IEC_TERMINAL = r"(?i)^(\d{1,2}/[LT]\d|[LT]\d|A[12]|N|PE|PEN|\d{1,2}(NO|NC))$"
PLC_CHANNEL = r"(?i)^(DI|DO|AI|AO|COM|GND|VCC|VDC|\+V|0V)\d{0,3}$"
VOLTAGE = r"(?iu)^~?\d{1,4}\s*(V|В|B)\s*(AC|DC)?$"
PROJECT_NUMBER = r"^\s*(\d{2,3}(\.\d{2,4})+)"
CELL_ERROR = r"(?i)^#(REF|VALUE|DIV/0|N/A|NAME\?|NUM|NULL)!?$"
CANONICAL_TAG = r"^(00[A-Z]{2,4}\d{2}[A-Z]{2}\d{3})(.+)$"
CHANNEL_TAG = r"^00[A-Z0-9]{4,}[A-Z]\d{2,3}[A-Z]?(_\d+)?$"

# Units of measure, their quantity, and the factor to its base unit; upper and lower case are the same.
UNITS = {
    "кВт": ("power", 1000.0), "kW": ("power", 1000.0), "мВт": ("power", 0.001), "Вт": ("power", 1.0), "W": ("power", 1.0), "кВА": ("power", 1000.0), "kVA": ("power", 1000.0),
    "кА": ("current", 1000.0), "kA": ("current", 1000.0), "мА": ("current", 0.001), "mA": ("current", 0.001),
    "Ач": ("charge", 1.0), "Ah": ("charge", 1.0), "кВ": ("voltage", 1000.0), "kV": ("voltage", 1000.0),
    "мм2": ("section", 1.0), "мм²": ("section", 1.0), "mm2": ("section", 1.0), "Гц": ("frequency", 1.0), "Hz": ("frequency", 1.0),
    "А": ("current", 1.0), "A": ("current", 1.0), "В": ("voltage", 1.0), "V": ("voltage", 1.0), "B": ("voltage", 1.0),
}

# Words that are no cabinet.
NOT_CABINETS = [
    "СХЕМА", "ВИД", "ОБЩИЙ", "ПЛАН", "ЩИТ", "ШКАФ", "ШКАФА", "ЩИТА", "АВР", "КИПИА", "ГОСТ", "ПЗ", "СО", "СБ", "НЛ", "МВТ", "КВТ", "ТОМ", "ЛИСТ",
    "ДЛЯ", "НА", "И", "С", "ПО", "ОТМ", "УЗЛА", "УЧЕТА", "УЧЁТА", "СПЕРЕДИ", "СЗАДИ", "СБОКУ", "СЛЕВА", "СПРАВА",
]

# Captions of a title block, bare numbers and sheet formats.
TITLE_JUNK = (
    r"(?iuU)^(формат|масса|масштаб|лист|листов|стадия|дата|инв\.|взам\.|подп\.|разработал|разраб\.|проверил|пров\.|н\.\s*контр|нач\.|гип|гап|утвердил|согласовано|копировал)\b"
    r"|^[\d.,/\s×xX-]*$|^[aаAА]\s*\d(\s*[xхXХ×]\s*\d+)?$"
)


def literals(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def to_cyrillic(c: Column) -> Column:
    """Capital look-alikes to Cyrillic in texts that have a Cyrillic letter already."""
    capitals = LOOKALIKES[0][:12], LOOKALIKES[1][:12]
    return F.when(c.rlike("[А-яЁё]"), F.translate(c, capitals[1], capitals[0])).otherwise(c)


def article_tokens(*columns: Column) -> Column:
    """Distinct folded tokens that look like catalogue numbers: four characters or more with a digit, and a letter unless five or more."""
    strip = lambda x: F.regexp_replace(x, r"^[.\-/]+|[.\-/]+$", "")
    found = [F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ARTICLE_TOKEN), 0), strip) for c in columns]
    fits = lambda x: (F.length(x) >= 4) & x.rlike("[0-9]") & (x.rlike("[A-Za-z]") | (F.length(x) >= 5))
    return F.array_distinct(F.transform(F.filter(F.concat(*found), fits), fold))


def characteristics(*columns: Column) -> Column:
    """Distinct (quantity, value in base units, four decimals) that texts give as a number with a unit."""
    units = "|".join(sorted(UNITS, key=lambda u: -len(u)))  # longer units first, so that Вт is no В
    pattern = rf"(?iuU)(?<![\w,.])(\d{{1,4}}(?:[.,]\d{{1,3}})?)\s*({units})\s*(?:AC/DC|DC/AC|AC|DC)?(?![\wА-Яа-я])"
    quantity, factor = (literals({u.lower(): v[i] for u, v in UNITS.items()}) for i in (0, 1))

    def read(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("n"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("u"))
        value = lambda p: F.round(F.replace(p["n"], F.lit(","), F.lit(".")).cast("double") * factor[F.lower(p["u"])], 4)
        return F.transform(pairs, lambda p: F.struct(quantity[F.lower(p["u"])].alias("quantity"), value(p).alias("value")))

    return F.array_distinct(F.concat(*[read(c) for c in columns]))


def project_number(c: Column) -> Column:
    """The digits and dots that begin a document's designation; null without any."""
    return F.nullif(F.regexp_extract(c, PROJECT_NUMBER, 1), F.lit(""))


def is_iec_terminal(c: Column) -> Column:
    return c.rlike(IEC_TERMINAL)


def is_plc_channel(c: Column) -> Column:
    return c.rlike(PLC_CHANNEL)


def is_voltage(c: Column) -> Column:
    return c.rlike(VOLTAGE)


def is_cell_error(c: Column) -> Column:
    return F.trim(c).rlike(CELL_ERROR)


def kks_suffix(c: Column) -> Column:
    """(tag, tail) of a canonical tag with something after it, else null."""
    return F.when(c.rlike(CANONICAL_TAG), F.struct(F.regexp_extract(c, CANONICAL_TAG, 1).alias("tag"), F.regexp_extract(c, CANONICAL_TAG, 2).alias("tail")))


def range_members(left: Column, right: Column, most: int) -> Column:
    """All designators from ``left`` to ``right`` if they differ in one rising number alone, else both ends."""
    shape = lambda x: F.regexp_replace(x, r"\d+", "#")
    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), 0), lambda n: n.try_cast("long"))
    texts = F.split(left, r"\d+", -1)
    a, b = numbers(left), numbers(right)
    differ = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i) != F.get(b, i))
    at = F.get(differ, F.lit(0))
    low, high = F.get(a, at), F.get(b, at)

    def member(v: Column) -> Column:
        value = lambda i: F.when(i == at, v).otherwise(F.get(a, i)).cast("string")
        rest = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.concat(value(i), F.get(texts, i + 1)))
        return F.concat(F.get(texts, F.lit(0)), F.array_join(rest, ""))

    good = (F.size(a) > 0) & (shape(left) == shape(right)) & (F.size(differ) == 1) & (high >= low) & (high - low < most)
    return F.when(F.coalesce(good, F.lit(False)), F.transform(F.sequence(low, F.greatest(low, high)), member)).otherwise(F.array(left, right))


def parse_designators(c: Column, most: int = 200) -> Column:
    """Designators of a cell in order, each once: a list, whose ranges (dots, or a dash between spaces) are written out."""
    mark = "\x01"
    text = F.regexp_replace(F.trim(c), r"\s*(?:\.{2,}|…\.*)\s*|\s+[-–—]\s+", mark)
    ends = lambda x: F.filter(F.split(x, mark), lambda e: e != "")
    expand = lambda x: F.when(F.size(ends(x)) == 2, range_members(F.get(ends(x), F.lit(0)), F.get(ends(x), F.lit(1)), most)).otherwise(ends(x))
    every = F.flatten(F.transform(F.split(text, r"[,;\s]+"), expand))
    clean_ = F.filter(F.transform(every, lambda x: F.regexp_replace(x, r"^[ .,;]+|[ .,;]+$", "")), lambda x: x != "")
    return F.when(c.isNull() | is_cell_error(c), F.array().cast("array<string>")).otherwise(F.array_distinct(clean_))


def detect_cabinet(title: Column) -> Column:
    """The cabinet that a title names: one in brackets, else the last abbreviation that is no stop word and touches no dash."""
    stop = F.array(*map(F.lit, NOT_CABINETS))
    ok = lambda x: ~F.array_contains(stop, F.upper(x))
    inside = F.transform(F.regexp_extract_all(title, F.lit(r"\(([^)]{2,12})\)"), 1), lambda x: F.trim(x))
    inside = F.filter(inside, lambda x: x.rlike(r"^[А-ЯЁA-Z]{2,7}\d{0,2}$") & ok(x))
    words = F.filter(F.regexp_extract_all(title, F.lit(r"(?U)(?<!-)\b([А-ЯЁA-Z]{2,7}\d{0,2})\b(?!-)"), 1), ok)
    return to_cyrillic(F.upper(F.coalesce(F.get(inside, F.lit(0)), F.try_element_at(words, F.lit(-1)))))


def is_title_junk(c: Column) -> Column:
    return c.rlike(TITLE_JUNK)


def join_fragments(parts: Column) -> Column:
    """Lines of a cell as one text; a hyphen after a letter at a line's end is taken back."""
    lines = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    step = lambda a, x: F.when(a == "", x).when(a.rlike(r"\p{L}-$"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), x)).otherwise(F.concat(a, F.lit(" "), x))
    return F.aggregate(lines, F.lit(""), step)


def safe_name(c: Column, limit: int = 90, fallback: str = "документ") -> Column:
    """A text as a file name: forbidden characters to spaces, collapsed, trimmed, cut."""
    flat = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', " "), r"(?U)\s+", " ")
    short = F.trim(F.substring(F.regexp_replace(flat, r"^[ .]+|[ .]+$", ""), 1, limit))
    return F.when(short == "", F.lit(fallback)).otherwise(short)


# Single-byte code pages that broken fonts come from.
CODE_PAGES = ["cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5"]


def code_page_table(codec: str) -> tuple[str, str]:
    """Latin-1 characters from 128 on, and what their bytes mean in ``codec``; undefined bytes are left out."""
    pairs = []
    for b in range(128, 256):
        try:
            pairs.append((chr(b), bytes([b]).decode(codec)))
        except UnicodeDecodeError:
            pass
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def repair_encoding(c: Column, codec: str) -> Column:
    """Text whose bytes of ``codec`` were read as Latin-1; other characters stay."""
    return F.translate(c, *code_page_table(codec))


def readable_weight(c: Column) -> Column:
    """Sum of the characters' weights, fixed values: readable ones 1, punctuation 0.6, spaces 0.4, others -0.3, controls -1, replacement characters -3."""
    kinds = [("[\ufffd]", -3.0), (r"(?U)[\s\x1c-\x1f\x85]", 0.4), ("[\u0400-\u04ff]", 1.0), ("[0-9A-Za-z]", 1.0), (r"[,.:;/()№²%+'\"±≤≥×÷_-]", 0.6), (r"[\x00-\x08\x0e-\x1b]", -1.0)]
    total, left = F.lit(0.0), F.coalesce(c, F.lit(""))
    for pattern, weight in kinds:
        rest = F.regexp_replace(left, pattern, "")
        total, left = total + (F.length(left) - F.length(rest)) * F.lit(weight), rest
    return total + F.length(left) * F.lit(-0.3)


def readability(c: Column) -> Column:
    """Weighted share of readable characters; 0 for an empty text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0.0).otherwise(readable_weight(c) / n)


# Captions of pins and frames on drawings.
PIN_WORDS = [
    "l", "n", "pe", "l1", "l2", "l3", "n1", "n2", "a1", "a2", "b1", "b2", "c1", "c2", "com", "no", "nc", "gnd", "fg", "0v", "24v", "+24", "+24v", "+v", "-v", "s/s",
    "pwr+", "pwr-", "coil", "up", "vdd", "vss", "in", "out", "rs-232", "rs-485", "rs485", "ethernet", "usb", "debug", "x1", "x2",
]
FRAME_WORDS = [
    "формат", "формат а3", "формат  а3", "инв.n подл.", "инв. n подл.", "взам. инв. n", "подп. и дата", "подпись и дата", "копировал", "лист", "листов", "изм.", "кол.уч", "кол.уч.",
    "подп.", "подпись", "№док.", "№ док.", "дата", "разраб.", "разработал", "проверил", "н.контр", "н.контр.", "стадия", "масштаб", "масса", "согласовано", "лист № док.",
    "вид спереди", "вид справа", "вид слева", "вид сзади", "вид сверху",
]


def classify_label(c: Column) -> Column:
    """Type of a drawing's label; the order of the tests matters."""
    t = F.trim(c)
    low = F.lower(t)
    article = t.rlike(r"^[A-Za-z0-9][A-Za-z0-9./\-]*( [A-Za-z0-9./\-]+)*$")
    name = t.rlike(r"^\d{0,2}[A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9]*([.\-][A-Za-zА-Яа-я0-9]+)*$")
    size = t.rlike(r"(?iu)^\d+([.,]\d+)?\s*[xх×]\s*\d+") | t.rlike(r"(?iu)^[-+]?\d+([.,]\d+)?\s*(мм|см|м|кг|г|А|A|В|V|Вт|W|°C|°|мА|Гц|Ом)\.?$")
    return (
        F.when(t == "", "empty").when(low.isin(FRAME_WORDS), "frame").when(t.rlike(r"^\d{3}\.\d{3}(\.\d{2})*\s*-\s*[А-ЯA-Z]{2,4}"), "doc_number")
        .when(low.isin(PIN_WORDS), "pin_label").when(size, "dimension").when(t.rlike(r"(?iu)^C?\d+([.,]\d+)?\s*[AА](/\d+\s*мА)?$"), "rating")
        .when(t.rlike("[А-Яа-яЁё]"), "note").when(t.rlike(r"^\d{5,}$"), "article").when(t.rlike(r"^[.,]*\d[\d.,]*$"), "number")
        .when((F.length(t) > 7) & article, "article").when(F.length(t).between(2, 7) & name, "designator").when(article, "article").otherwise("other")
    )


def json_candidate(c: Column) -> Column:
    """Where an answer may hold JSON: in a json fence, in any fence, from the first brace to the last, else all of it."""
    fenced = lambda tag: F.when(c.rlike(rf"(?s)```{tag}\s*.*?```"), strip(F.regexp_extract(c, rf"(?s)```{tag}\s*(.*?)```", 1)))
    braces = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(fenced("json"), fenced(""), braces, strip(c))


def parse_number_set(c: Column) -> Column:
    """Sorted numbers of up to four digits under ``same_line``, else under ``numbers``, of an answer's JSON."""
    whole = F.from_json(F.regexp_extract(json_candidate(c), r"(?s)\{.*\}", 0), "same_line array<string>, numbers array<string>")
    values = F.coalesce(whole["same_line"], whole["numbers"], F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, strip), lambda x: x.rlike(r"^\d{1,4}$"))))


# How profiles of drawings write links to sheets; what gives a profile away, and how much it counts.
CROSS_REFS = {"A": r"^/?(\d{1,3})\.(\d{1,2}):([A-F])$", "B": r"^/?\d{1,3}\.(\d{1,2})\.(\d{1,2})()$", "C": r"^\((\d{0,3}):(\d{1,2})([A-F])\)$", "F": r"^\(Л(\d{1,3})\)()()$"}
PROFILE_SIGNS = [
    ("A", r"^/?\d{1,3}\.\d{1,2}:[A-F]$", 3), ("A", r"^00[A-Z]{2,4}\d{2}[A-Z]{2}\d{3}$|^00CJF02", 3), ("A", r"^R500\s", 3), ("A", r"^\d+([.,]\d+)?\s*мм²$", 1),
    ("B", r"^/?\d{1,3}\.\d{1,2}\.\d{1,2}$", 3), ("B", r"^М[ВУКР]\d{3}(-\d{2,3})?$", 3), ("B", r"^\d+[xх]\d+([xх][\d.,]+)?$", 1), ("B", r"(?iu)ВВГ|КВВГ|МКЭШ|КВК|КГ|ПвПг|ПуГВ|ParLan|LiYCY|РК\s?75|КИПЭВ", 1),
    ("C", r"^\(\d{0,3}:\d{1,2}[A-F]\)$", 3), ("C", r"^DVP[0-9A-Z][0-9A-Z\-]*$", 3),
    ("D", r"^(?:ПЛК|МВ|МУ|МК|МДВВ)\d{2,3}-[\d.]*\.\d+[А-ЯЁ\w.\-]*$|^(?:ПЛК|МВ|МУ|МК|МДВВ)\d{2,3}[-.][\d.]*[А-ЯЁ]+[\w.\-]*$|^СЭТ-", 3), ("D", r"^\d[PР](\+[NН])?-[A-DСC]\d{1,3}$", 2),
    ("E", r"^\d{2}-\d{3}-[A-ZА-Я]{2,4}$", 3), ("E", r"^\d{0,2}X[TM]?\d{0,2}:(?:\d{1,3}|PE)$", 2), ("E", r"^[AА][TТ]\d{2,4}\.\d{1,2}$", 1),
    ("F", r"^S9[A-Z]\d{4,6}$|^SXG\d{2}[A-Z]{2}$|^HM[A-Z0-9]{3,10}$", 3), ("F", r"^\(Л\d{1,3}\)$", 2), ("F", r"^[А-Я]{2,6}\.\d{3,6}\.\d{1,3}\.\d{1,3}-Э\d$", 2),
]


def parse_cross_ref(c: Column, profile: str) -> Column:
    """(sheet, column, zone) of a link as a profile writes it; null for other texts. A null sheet is the same sheet."""
    if profile not in CROSS_REFS:
        return F.lit(None).cast("struct<sheet:int,column:int,zone:string>")
    pattern = CROSS_REFS[profile]
    part = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return F.when(c.rlike(pattern), F.struct(part(1).cast("int").alias("sheet"), part(2).cast("int").alias("column"), part(3).alias("zone")))
