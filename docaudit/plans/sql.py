"""Pieces of DuckDB SQL that the checks of several queries share. RE2 has no look-around, so boundaries are consumed."""

LOOKALIKES = "'АВЕКМНОРСТУХаеорсух', 'ABEKMHOPCTYXaeopcyx'"


def fold(x: str) -> str:
    return f"regexp_replace(upper(translate(coalesce({x}, ''), {LOOKALIKES})), '\\s+', '', 'g')"


def fold_designator(x: str) -> str:
    return f"regexp_replace({fold(x)}, '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"


def article_tokens(*xs: str) -> str:
    one = lambda x: f"list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z][A-Za-z0-9./\\-]{{4,}}|[A-Za-z0-9./\\-]{{5,}}'), lambda t: trim(t, '.-/'))"
    found = "flatten([" + ", ".join(map(one, xs)) + "])"
    kept = f"list_filter({found}, lambda t: length(t) >= 4 and regexp_matches(t, '[0-9]') and (regexp_matches(t, '[A-Za-z]') or length(t) >= 5))"
    return f"list_distinct(list_transform({kept}, lambda t: {fold('t')}))"


def text_tokens(x: str) -> str:
    bare = "trim(t, '.,;:()[]«»\"' || chr(39))"
    parts = f"list_transform(regexp_split_to_array(coalesce({x}, ''), '[\\s,;]+'), lambda t: {fold_designator(bare)})"
    return f"list_filter(list_distinct({parts}), lambda t: t <> '')"


IEC = "'^(\\d{1,2}/[LT]\\d|[LT]\\d|A[12]|N|PE|PEN|\\d{1,2}(NO|NC))$', 'i'"
CHANNEL = "'^(DI|DO|AI|AO|COM|GND|VCC|VDC|\\+V|0V)\\d{0,3}$', 'i'"
VOLTAGE = "'^~?\\d{1,4}\\s*(V|В|B)\\s*(AC|DC)?$', 'i'"
