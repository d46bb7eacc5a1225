"""Queries over tables on pages, odd labels and conversations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators import nets as N
from ..operators import odd as O
from ..operators import tables as T
from .common import over, raw
from .drawings import COMP
from .drawings import pages as sheet_sizes


def listed(d: DataFrame, column: str) -> DataFrame:
    return d.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("decimal(12,2)").cast("string")), ","))


def filled(words: DataFrame, rulings: DataFrame) -> DataFrame:
    return T.cells(words, T.separators(rulings), T.row_bands(rulings, 250.0))


def layouts(rulings: DataFrame) -> DataFrame:
    seps = T.separators(rulings)
    return T.carry_layout(seps.withColumn("has_header", F.col("page") == 1))


def kinds(words: DataFrame) -> DataFrame:
    return T.detect_table_kind(words.withColumn("page_height", F.lit(600.0)))


def rows(connections: DataFrame) -> DataFrame:
    """Wiring rows as maps by header; every third document spells a header another way."""
    cable = F.when(F.regexp_extract("document", r"\d+", 0).cast("int") % 3 == 0, "Кабель,жгут").otherwise("Кабель, жгут")
    cells = F.create_map(cable, F.concat(F.lit(" W"), F.col("page").cast("string")), F.lit("KKS"), F.col("kks"), F.lit("Шкаф"), F.col("cabinet"), F.lit("Клеммник/модуль"), F.coalesce("terminal_block", F.lit("  ")), F.lit("Штифт"), F.col("pin"))
    return T.build_connections(connections.select("document", F.struct("id", "kks", "terminal_block", "pin", "page").alias("ord"), cells.alias("cells")))


def anchored(words: DataFrame, rulings: DataFrame) -> DataFrame:
    lines = words.withColumn("text", F.when(F.col("ord") % 17 == 0, (F.col("ord") % 9).cast("string")).otherwise(F.col("text"))).select("document", "page", "ord", "text", F.when(F.col("ord") % 17 == 0, 100.0).otherwise(F.col("x0")).alias("xc"), F.col("top").alias("yc"))
    return T.rows_by_anchor(lines, rulings.filter("y0 = y1").select("document", "page", F.col("y0").alias("y")).distinct(), 95.0, 105.0)


def counted(words: DataFrame) -> DataFrame:
    lines = words.select("document", F.col("page"), "ord", F.when(F.col("top") == 40, (F.col("x0") / 40 + 1).cast("int").cast("string")).otherwise(F.col("text")).alias("text"), F.col("x0").alias("xc"), F.col("top").alias("yc"))
    one = lines.filter("yc <> 40").unionByName(lines.filter("yc = 40").groupBy("document", "page", "text", "yc").agg(F.min("ord").alias("ord"), F.min("xc").alias("xc")))
    return T.number_row(one)


def marks_along(wires: DataFrame, labels: DataFrame) -> DataFrame:
    return O.band_markings(wires, N.nets(wires).withColumnRenamed("net", "comp"), labels.select("document", "sheet", "ord", F.trim("text").alias("text"), "x0", "y0", "x1", "y1"))


def placed(marks: DataFrame) -> DataFrame:
    x, y = (F.col("ord") % 20 * 10).cast("double"), F.floor(F.col("ord") / 20).cast("double") * 10
    return marks.withColumns({"x0": x, "y0": y, "x1": x + 6, "y1": y + 4})


def crops(marks: DataFrame) -> DataFrame:
    return O.crop_box(O.odd_ones_out(marks), placed(marks), sheet_sizes(marks))


def verdicts(marks: DataFrame) -> DataFrame:
    candidates = O.odd_ones_out(marks)
    numbers = F.when(F.col("comp") % 4 == 0, F.array(F.col("major").cast("string"))).when(F.col("comp") % 4 == 1, F.array(F.lit("77"))).otherwise(F.array().cast("array<string>"))
    return O.apply_verdicts(candidates, candidates.filter("comp % 4 < 3").select("document", "sheet", "comp", "odd", numbers.alias("numbers")))


def reading(marks: DataFrame) -> DataFrame:
    own = marks.select("document", F.col("sheet").alias("tile"), F.col("text").alias("number")).withColumnRenamed("document", "setting")
    return O.reading_score(own, own.filter("number <> '6'").unionByName(own.filter("number = '4'")))


def prompts(messages: DataFrame) -> DataFrame:
    files = messages.filter("turn % 3 = 0").select("conv_id", "turn", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), F.concat(F.lit("f"), "turn").alias("name"), F.when(F.col("turn") % 2 == 0, F.lit("body")).alias("body"))
    return L.prompt_messages(messages, files).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


QUERIES = {
    "tab1_separators": over(lambda r: listed(T.separators(r), "seps"), "rulings"),
    "tab2_row_bands": over(lambda r: T.row_bands(r, 250.0), "rulings"),
    "tab3_cells": over(filled, "table_words", "rulings"),
    "tab4_map_columns": over(lambda d: T.map_columns(d.withColumnRenamed("column_no", "column")).withColumnRenamed("column", "column_no"), "header_cells"),
    "tab5_carry_layout": over(lambda r: listed(layouts(r), "layout"), "rulings"),
    "tab6_table_kind": over(kinds, "table_words"),
    "tab9_build_connections": over(rows, "connections"),
    "tab10_number_row": over(counted, "table_words"),
    "tab11_rows_by_anchor": over(anchored, "table_words", "rulings"),
    "tab12_spec_rows": over(lambda d: T.spec_rows(d).withColumn("designators", F.array_join("designators", ",")), "spec_lines"),
    "odd1_band_markings": over(marks_along, "wires", "wire_labels"),
    "odd4_crop_box": over(crops, "marks"),
    "odd5_apply_verdicts": over(verdicts, "marks"),
    "odd6_reading_score": over(reading, "marks"),
    "log1_transcript": over(lambda d: L.transcript(d, 60, 400), "talk"),
    "log2_prompt_messages": raw("conversations", prompts),
}
SEPS = """lengths as (select document, page, round_even(x0, 0) as x, sum(abs(y1 - y0)) as length from rulings where case when is_rect then abs(x1 - x0) < 2.5 else abs(x1 - x0) < 1 end and abs(y1 - y0) >= 5 group by all),
 strong as (select *, max(length) over (partition by document, page) as top from lengths), seps as (select document, page, list_reduce(list_transform(list_sort(list(x)), lambda v: [v]), lambda a, v: case when v[1] - a[-1] <= 3 then a else list_concat(a, v) end) as seps from strong where length >= 0.35 * top and x >= 50 group by document, page)"""
BANDS = """heights as (select document, page, round_even(least(y0, y1), 0) as y, sum(abs(x1 - x0)) as width from rulings where case when is_rect then abs(y1 - y0) < 2.5 else abs(y1 - y0) < 1 end group by all),
 merged as (select document, page, unnest(list_reduce(list_transform(list_sort(list({'y': y, 'width': width})), lambda v: [v]), lambda a, v: case when v[1].y - a[-1].y <= 2 then list_concat(a[1:len(a) - 1], [{'y': a[-1].y, 'width': a[-1].width + v[1].width}]) else list_concat(a, v) end)) as m from heights group by document, page),
 lines as (select document, page, m.y as top, lead(m.y) over (partition by document, page order by m.y) as bottom from merged where m.width >= 250), bands as (select document, page, row_number() over (partition by document, page order by top) as band, top, bottom from lines where bottom - top between 8 and 45)"""
MONEY = lambda c: f"array_to_string(list_transform({c}, lambda v: v::decimal(12, 2)::varchar), ',') as {c}"
HEAD = "head as (select document, lower(string_agg(regexp_replace(text, '\\s+', ' ', 'g'), ' ' order by ord)) as h from table_words where page = 1 and top < 150 group by document)"
ODD = """n as (select document, sheet, comp, text::int as v, count(*) as n from marks group by all), cand as (select a.document, a.sheet, a.comp, a.v as major, b.v as odd from n a join n b using (document, sheet, comp) where a.n >= 3 and b.n = 1 and abs(a.v - b.v) = 1
 and not exists (select 1 from n m where m.document = a.document and m.sheet = a.sheet and m.comp = a.comp and m.n = 1 and m.v = 2 * a.v - b.v))"""
SQL = {
    "tab1_separators": f"with {SEPS} select document, page, {MONEY('seps')} from seps",
    "tab2_row_bands": f"with {BANDS} select * from bands",
    "tab3_cells": f"""with {SEPS}, {BANDS}, placed as (select w.document, w.page, b.band, len(list_filter(s.seps, lambda x: x <= (w.x0 + w.x1) / 2)) as "column", w.* exclude (document, page) from table_words w join seps s using (document, page) join bands b on b.document = w.document and b.page = w.page and w.top >= b.top - 0.5 and w.top < b.bottom - 0.5)
 select document, page, band, "column", trim(string_agg(text, ' ' order by round_even(top, 0), x0, ord, text)) as text from placed group by document, page, band, "column\"""",
    "tab4_map_columns": """with h as (select *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from header_cells), f as (select *, case when contains(t, 'поз.') then 'position' when contains(t, 'наименование') then 'name' when contains(t, 'код изделия') then 'code' when contains(t, 'изготовитель') then 'manufacturer'
 when contains(t, 'единица измерения') then 'unit' when contains(t, 'количество') or contains(t, 'кол.') then 'quantity' when contains(t, 'масса') then 'mass' when contains(t, 'примечание') then 'note' end as field from h) select document, page, field, min(column_no) as column_no from f where field is not null group by all""",
    "tab5_carry_layout": f"""with {SEPS}, h as (select document, seps as layout from seps where page = 1) select s.document, s.page, {MONEY('layout').replace('layout,', 'h.layout,', 1)} from seps s join h using (document) where s.page = 1 or (len(s.seps) = len(layout) and len(list_filter(list_zip(s.seps, layout), lambda p: abs(p[1] - p[2]) > 3)) = 0)""",
    "tab6_table_kind": f"""with {HEAD} select d.document, case when contains(h, 'позиция') and contains(h, 'схеме') and (contains(h, 'сигнализация') or contains(h, 'резервирование')) then 'param_list' when contains(h, 'описание сигнала') and contains(h, 'номер входа') then 'signal_list'
 when contains(h, 'кабел') and contains(h, 'начало') and contains(h, 'конец') then 'cable_journal' else 'gost_connections' end as table_kind from (select distinct document from table_words) d left join head using (document)""",
    "tab9_build_connections": """select document, row_number() over (partition by document order by id, kks nulls first, terminal_block nulls first, pin, page) as id, concat('W', page) as cable_harness, null::varchar as circuit_marking, nullif(kks, '') as kks, null::varchar as conductor, cabinet, terminal_block, pin, null::varchar as terminal_type_or_ref, null::varchar as connection_address, null::varchar as note,
 cabinet || '.' || terminal_block || '.' || pin as terminal_address from connections""",
    "tab10_number_row": """with l as (select document, page, top as yc, case when top = 40 then (floor(x0 / 40) + 1)::int::varchar else text end as text, ord, x0 as xc from table_words), one as (select document, page, yc, text, ord, xc from l where yc <> 40 union all select document, page, yc, text, min(ord), min(xc) from l where yc = 40 group by document, page, yc, text),
 g as (select document, page, min(yc) as y, list(try_cast(text as int) order by xc, ord) as c from one group by document, page, round_even(yc / 4, 0)) select document, page, min(y) as y from g where len(c) >= 5 and c = range(1, len(c) + 1)::int[] group by document, page""",
    "tab11_rows_by_anchor": """with l as (select document, page, ord, case when ord % 17 = 0 then (ord % 9)::varchar else text end as text, case when ord % 17 = 0 then 100.0 else x0 end as xc, top as yc from table_words), r as (select distinct document, page, y0 as y from rulings where y0 = y1),
 a as (select *, lead(yc) over (partition by document, page order by yc, ord) as nxt from l where xc between 95 and 105 and try_cast(text as double) is not null),
 e as (select document, page, case when (select count(*) from r where r.document = a.document and r.page = a.page and y > yc and y < nxt) = 1 then (select min(y) from r where r.document = a.document and r.page = a.page and y > yc and y < nxt) else (yc + nxt) / 2 end as edge from a),
 p as (select l.*, 1 + (select count(*) from e where e.document = l.document and e.page = l.page and edge <= l.yc) as "row" from l where exists (select 1 from a where a.document = l.document and a.page = l.page)) select document, page, "row", string_agg(text, ' ' order by yc, xc, ord, text) as text from p group by document, page, "row\"""",
    "tab12_spec_rows": """with c as (select document, "row", position, trim(regexp_replace(name, '\\s+', ' ', 'g')) as name, code, try_cast(replace(quantity, ',', '.') as double) as quantity from spec_lines),
 s as (select *, last_value(case when starts_with(name, 'Раздел') then name end ignore nulls) over (partition by document order by "row" rows between unbounded preceding and current row) as section from c)
 select document, "row", position, name, code, quantity, section, case when position is null then '' else concat('K', "row", ',K', "row" + 1, ',K', "row" + 2) end as designators from s where "row" % 12 not in (4, 5, 8) and not (name is null and code is null and quantity is null)""",
    "odd1_band_markings": f"""with recursive {COMP}, m as (select document, sheet, ord, trim(text) as text, (x0 + x1) / 2 as px, (y0 + y1) / 2 as py from wire_labels),
 a as (select *, case when abs(x2 - x1) < 1 and abs(y2 - y1) >= 8 then 'v' when abs(y2 - y1) < 1 and abs(x2 - x1) >= 8 then 'h' end as axis from wires join net_of using (seg))
 select distinct m.document, m.sheet, net as comp, ord, text from m join a on a.document = m.document and a.sheet = m.sheet where (axis = 'h' and px between least(x1, x2) and greatest(x1, x2) and abs(py - y1) <= 11) or (axis = 'v' and py between least(y1, y2) and greatest(y1, y2) and px between least(x1, x2) - 11 and greatest(x1, x2) + 11)""",
    "odd4_crop_box": f"""with {ODD}, p as (select *, (ord % 20 * 10)::double as x0, floor(ord / 20) * 10 as y0 from marks), k as (select p.*, c.major, c.odd from p join cand c using (document, sheet, comp) where text = major::varchar or text = odd::varchar),
 o as (select document, sheet, comp, major, odd, min(ord) as o from k where text = odd::varchar group by all), d as (select k.*, case when k.ord = o.o then -1 else sqrt((k.x0 - q.x0) ** 2 + (k.y0 - q.y0) ** 2) end as dist from k join o using (document, sheet, comp, major, odd) join p q on q.document = k.document and q.sheet = k.sheet and q.comp = k.comp and q.ord = o.o),
 t as (select * from d qualify row_number() over (partition by document, sheet, comp, major, odd order by dist, ord) <= 3) select document, sheet, comp, odd, greatest(min(x0) - 26, 0) as x0, greatest(min(y0) - 26, 0) as y0, least(max(x0) + 6 + 26, 400) as x1, least(max(y0) + 4 + 26, 300) as y1 from t group by document, sheet, comp, major, odd""",
    "odd5_apply_verdicts": f"with {ODD} select *, case comp % 4 when 0 then 'confirmed' when 1 then 'denied' else 'unanswered' end as verdict, case comp % 4 when 0 then 'MISMATCH' else 'REVIEW' end as kind, case comp % 4 when 0 then 'high' when 1 then 'low' else 'medium' end as severity from cand",
    "odd6_reading_score": """with c as (select document, sheet, text, count(*) as p, case text when '6' then 0 when '4' then 2 * count(*) else count(*) end as r from marks group by document, sheet, text) select document as setting, sum(p)::bigint as printed, sum(least(p, r))::bigint as hit, sum(greatest(r - p, 0))::bigint as invented from c group by document""",
    "log1_transcript": """with p as (select conv_id, turn, concat(case when role = 'computer' then '[вывод кода]' when type = 'message' then '[рассуждение агента]' else '[исполненный код]' end, chr(10), case when length(text) > 60 then concat(text[1:60], chr(10), '... [обрезано, всего ', length(text), ' символов]') else text end) as part
 from talk where (role = 'computer' or (role = 'assistant' and type in ('message', 'code'))) and trim(text) <> ''), t as (select conv_id, string_agg(part, chr(10) || chr(10) order by turn) as t from p group by conv_id)
 select conv_id, case when length(t) > 400 then concat('... [начало протокола обрезано]', chr(10), chr(10), right(t, 400)) else t end as transcript from t""",
    "log2_prompt_messages": """with m as (select conv_id, turn, case when role = 'assistant' then 'assistant' else 'user' end as role, coalesce(text, '') as text, case when turn % 2 = 0 then concat('[Содержимое файла «f', turn, '»]', chr(10), 'body') else concat('[Приложен файл «f', turn, '»]') end as f from conversations),
 c as (select conv_id, turn, role, case when role = 'assistant' or turn % 3 <> 0 then text else concat(case when text = '' then '' else text || chr(10) || chr(10) end, f, chr(10), chr(10), f) end as content from m) select conv_id, string_agg(concat(role, ': ', content), chr(10) order by turn, role, content) as messages from c group by conv_id""",
}
