"""Queries over span types, title cells and lists of signals, cables and parameters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..operators import album as A
from ..operators import lists as L
from ..operators import spans as S
from ..operators import tables as T
from . import grids
from .common import over


def typed(d: DataFrame) -> DataFrame:
    return d.withColumn("entity_type", P.classify_span(F.col("text"), F.col("profile"), F.col("size"), F.col("y0"), F.col("height")))


def sheets(d: DataFrame) -> DataFrame:
    return d.select("document", "page").distinct().withColumn("height", F.lit(400.0))


def titles(lines: DataFrame, rulings: DataFrame) -> DataFrame:
    return A.strip_boilerplate(A.title_cell(lines, rulings))


def titled(words: DataFrame, rulings: DataFrame) -> DataFrame:
    return L.leftmost_titled(L.header_cells(words, T.separators(rulings), sheets(words)))


def listed(kind: str):
    def run(words: DataFrame, rulings: DataFrame) -> DataFrame:
        own = words.join(words.filter(F.col("text").isin(HEADS[kind])).select("document").distinct(), "document", "left_semi")
        return L.LISTS[kind](own, rulings, sheets(own))

    return over(run, "list_words", "list_rulings")


#: A header that the documents of each kind have in the test tables.
HEADS = {"signal_list": "Описание сигнала", "cable_journal": "№ кабеля", "param_list": "Пределы измерений"}
QUERIES = {
    "txt22_classify_span": over(lambda d: typed(d).select("ord", "entity_type"), "profile_spans"),
    "spn4_types_by_profile": over(lambda d: S.type_histogram(typed(d)), "profile_spans"),
    "alb1_title_cell": over(A.title_cell, "stamp_texts", "stamp_rulings"),
    "alb1_titles_of_sheets": over(titles, "stamp_texts", "stamp_rulings"),
    "tab4_leftmost_titled": over(titled, "list_words", "list_rulings"),
    "tab8_signal_list": listed("signal_list"),
    "tab8_cable_journal": listed("cable_journal"),
    "tab8_param_list": listed("param_list"),
    "tab8_extract_lists": over(lambda w, r: L.extract_lists(w, r, sheets(w)).select("document", "id", "page", "table_kind", "kks", "connection_address", "cable_harness", "note", "section"), "list_words", "list_rulings"),
    "tab10_header_bottom": over(T.header_bottom, "header_lines"),
}


def kind_of(p: P.Profile) -> str:
    words = ", ".join(f"'{w}'" for w in p.frame_words)
    framed = f"t in ({words})" + (f" or regexp_matches(t, '{p.frame}')" if p.frame else "")
    rules = " ".join(f"when regexp_matches(t, '{r}')" + (" and length(regexp_replace(t, '\\P{L}', '', 'g')) >= 3" if k == "signal_label" else "") + f" then '{k}'" for k, r in p.rules)
    return f"""case when {framed} then 'page_frame' when regexp_matches(t, '^[1-9]$') then case when y0 <= 20 or y0 >= height - 20 then 'page_frame' else 'terminal_no' end when t in ('-', '/', '+') then 'glyph' {rules}
 when length(t) > 15 and regexp_matches(t, '\\p{{L}}') and size > 3 then 'long_text' else 'unclassified' end"""


TYPED = "typed as (select ord, document, case profile " + " ".join(f"when '{n}' then {kind_of(p)}" for n, p in P.PROFILES.items()) + " end as entity_type from (select *, trim(text) as t from profile_spans))"
LABELS = lambda names: ", ".join(f"'{n}'" for n in names)
CELL = f"""norm as (select *, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ё', 'е') as t from stamp_texts),
 anchor as (select album, sheet, min(x0) filter (t in ({LABELS(A.RIGHT_LABELS)})) as rx, min(y0) filter (t in ({LABELS(A.RIGHT_LABELS)})) as ry, max(x1) filter (t in ({LABELS(A.LEFT_LABELS)})) as lx, min(y0) filter (t in ({LABELS(A.LEFT_LABELS)})) as ly from norm group by album, sheet),
 tick as (select distinct r.album, r.sheet, rx, round_even(r.x0, 0) as x from stamp_rulings r join anchor a using (album, sheet) where case when is_rect then abs(x1 - x0) <= 1.5 else abs(x1 - x0) <= 1 and abs(y1 - y0) >= 3 end and greatest(y0, y1) >= ry),
 comb as (select album, sheet, rx, list_reduce(list_transform(list_sort(list(x)), lambda v: [v]), lambda a, v: case when v[1] - a[-1] <= 3 then a else list_concat(a, v) end) as xs from tick group by album, sheet, rx),
 pair as (select album, sheet, list_filter(xs, lambda x: x <= rx) as xs from comb), ruled as (select album, sheet, xs[-2] as low, xs[-1] as high from pair where len(xs) >= 2),
 bound as (select a.album, a.sheet, coalesce(low, lx) as low, coalesce(high, rx, 1e300) as high, case when low is not null then ry else ly end as start from anchor a left join ruled using (album, sheet) where coalesce(low, lx) is not null),
 cell as (select album, sheet, row_number() over (partition by album, sheet order by round_even(y0, 0), x0, ord) as line, text from norm join bound using (album, sheet) where y0 >= start - 2 and x1 <= high + 2 and (x0 >= low - 2 or least(x1, high) - greatest(x0, low) >= 0.8 * (x1 - x0))
  and not regexp_matches(t, '^(формат|масса|масштаб|лист|листов|стадия|дата|инв\\.|взам\\.)([^а-яёa-z0-9_]|$)|^[\\d.,/\\s×xX-]*$|^[aа]\\s*\\d$'))"""


def list_sql(kind: str) -> str:
    """The rows of one kind of list, from the rulings up."""
    fields = {"signal_list": {"kks": "обозначение", "addr": "адрес plc", "type": "тип", "note": "описание"}, "cable_journal": {"src": "начало", "dst": "конец", "brand": "марка"}, "param_list": {"kks": "позиция", "note": "наименование", "sheet": "лист схемы"}}[kind]
    needed = {"signal_list": "addr", "cable_journal": "src", "param_list": "kks"}[kind]
    of = lambda f: f"nullif(trim(regexp_replace(max(text) filter (col = {f}), '\\s+', ' ', 'g')), '') as {f}"
    seps, bands = (x.replace("rulings", "list_rulings").replace(" lines as", " edges as").replace("from lines", "from edges").replace(">= 250", f">= {L.ROW_WIDTH[kind]}") for x in (grids.SEPS, grids.BANDS))
    junk = lambda c: f"regexp_matches({c}, '^(изм|лист|№\\s*док|подп|дата|формат)([^а-яёa-z]|$)|^[\\d.,/\\s-]+$', 'i')"
    extra = {"signal_list": "", "cable_journal": ", cable", "param_list": ""}[kind]
    cable = ", min(col) as cable" if extra else ""
    title = "trim(regexp_replace(string_agg(text, ' ' order by col) filter (col > 0), '\\s+', ' ', 'g')) as title, trim(regexp_extract(string_agg(text, ' ' order by col), '(?i)(СК\\s*[НH][РPЗ3]?)?\\s*([=~]\\s*\\d{1,3}\\s*[ВVB])')) as spec"
    names = [*fields, *(["cable"] if extra else [])]
    head, keep, out = {
        "signal_list": (f"case when addr is null and kks is not null and not {junk('kks')} and not regexp_matches(kks, '\\d') then kks end", f"case when addr is not null then not {junk('addr')} else kks is not null and not {junk('kks')} and regexp_matches(kks, '\\d') end",
                        "kks, addr as connection_address, type as terminal_type_or_ref, note"),
        "cable_journal": ("null::varchar", f"cable is not null and not {junk('cable')} and coalesce(src, dst) is not null", "cable as cable_harness, concat(coalesce(src, '?'), ' -> ', coalesce(dst, '?')) as note, src as from_point, dst as to_point, null::varchar as segment, brand as cable_brand, null::varchar as cable_section, null::varchar as cable_length"),
        "param_list": (f"case when kks is null and length(title) < 120 and not {junk('title')} and not regexp_matches(title, '(?i)примечание') then title end", f"kks is not null and not {junk('kks')}", "kks, note, sheet as sheet_ref, nullif(spec, '') as signal_spec"),
    }[kind]
    return f"""with {seps}, {bands}, own as (select w.* from list_words w where document in (select document from list_words where text = '{HEADS[kind]}')),
 over_ as (select document, page, len(list_filter(seps, lambda s: s <= (x0 + x1) / 2)) as col, lower(regexp_replace(string_agg(text, ' ' order by top, x0, ord), '\\s+', ' ', 'g')) as t, max(bottom) filter (top < 40) as b from own join seps using (document, page) where top < 100 group by all),
 headed as (select document, page, {", ".join(f"min(col) filter (contains(t, '{w}')) as {f}" for f, w in fields.items())}{cable}, max(b) filter ({" or ".join(f"contains(t, '{w}')" for w in fields.values())}) as b from over_ group by document, page having {needed} is not null),
 laid as (select document, page, seps, b, {", ".join(f"last_value({f} ignore nulls) over p as {f}" for f in names)}, last_value(case when b is not null then seps end ignore nulls) over p as layout from (select s.*, h.* exclude (document, page) from seps s left join headed h using (document, page))
  window p as (partition by document order by page rows between unbounded preceding and current row)),
 used as (select * from laid where len(seps) = len(layout) and len(list_filter(list_zip(seps, layout), lambda p: abs(p[1] - p[2]) > 3)) = 0),
 rows_ as (select document, page, band, top, bottom, u.* exclude (document, page, b) from bands join used u using (document, page) where bottom > coalesce(b, 40) + 2),
 cells as (select document, page, band, len(list_filter(layout, lambda s: s <= (x0 + x1) / 2)) as col, trim(string_agg(text, ' ' order by round_even(w.top, 0), x0, ord)) as text, {", ".join(f"any_value({f}) as {f}" for f in names)} from rows_ r join own w using (document, page) where w.top >= r.top - 0.5 and w.top < r.bottom - 0.5 group by all),
 wide as (select document, page, band, {", ".join(map(of, names))}, {title} from cells group by document, page, band),
 named as (select *, last_value({head} ignore nulls) over (partition by document order by page, band rows between unbounded preceding and current row) as section from wide)
 select document, row_number() over (partition by document order by page, band) as id, page, {out}, section from named where {keep}"""


SQL = {
    "txt22_classify_span": f"with {TYPED} select ord, entity_type from typed",
    "spn4_types_by_profile": f"with {TYPED} select document, entity_type, count(*) as n from typed group by all",
    "alb1_title_cell": f"with {CELL} select * from cell",
    "alb1_titles_of_sheets": f"""with {CELL}, k as (select *, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ё', 'е') as norm from cell), filled as (select album, count(distinct sheet) as f from k group by album), often as (select k.album, norm from k join filled using (album) group by k.album, norm, f having count(distinct sheet) >= 0.5 * f),
 t as (select album, sheet, trim(regexp_replace(string_agg(text, ' ' order by line), '\\s+', ' ', 'g')) as title from k anti join often using (album, norm) group by all) select album, sheet, coalesce(title, '') as title from (select distinct album, sheet from cell) left join t using (album, sheet)""",
    "tab4_leftmost_titled": f"""with {grids.SEPS.replace("rulings", "list_rulings")} select document, page, min(len(list_filter(seps, lambda s: s <= (x0 + x1) / 2))) as "column" from list_words join seps using (document, page) where top < 100 group by document, page""",
    **{f"tab8_{k}": list_sql(k) for k in L.LISTS},
    "tab8_extract_lists": " union all ".join(
        f"select document, id, page, '{k}' as table_kind, {', '.join(c if c in have else f'null::varchar as {c}' for c in ('kks', 'connection_address', 'cable_harness', 'note', 'section'))} from ({list_sql(k)})"
        for k, have in (("signal_list", "kks connection_address note section"), ("cable_journal", "cable_harness note section"), ("param_list", "kks note section"))
    ),
    "tab10_header_bottom": """with recursive l as (select * from header_lines where y0 <= 320), top0 as (select document, page, max(y1) as bottom from l where contains(lower(text), 'код обору') or contains(lower(text), 'наименование') or contains(lower(text), 'количество') or contains(lower(text), 'изделия код') group by all),
 grow as (select document, page, bottom, 0 as n from top0 union select g.document, g.page, max(greatest(bottom, y1)) over (partition by g.document, g.page), n + 1 from grow g join l on l.document = g.document and l.page = g.page and l.y0 <= g.bottom + 4 where n < 20)
 select document, page, max(bottom) as bottom from grow group by document, page""",
}
