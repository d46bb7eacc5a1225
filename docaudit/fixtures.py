"""Audit tables derived from the TPC-H-like test tables, in SQL that Spark and DuckDB both run."""

from pyspark.sql import DataFrame, SparkSession

K_PART = "select p_partkey, p_brand, p_type, p_size, p_name, p_partkey % 10 as b, cast(floor(p_partkey / 10) as bigint) as k from part"
VIEWS = {
    "spec_items": """select concat('CAB', b) as bundle, concat('SO-', b) as document, k as row_no, concat('K', k + 1) as designator,
 case when p_partkey % 40 < 4 then concat('DUP', b, '-1000') else concat('ART', b, '-', 1000 + k) end as code,
 concat(p_type, ' relay ', case when k % 2 = 0 then '24' else '230' end, 'V') as name,
 cast(p_size % 5 + 1 as double) as quantity, cast(1 + k % 4 as bigint) as n_positions,
 case when k % 13 = 0 then concat('replaced by ALT', b, '-', 1000 + k) else null end as note
 from k_part where p_partkey % 7 <> 0""",
    "assembly_elements": """select concat('CAB', b) as bundle, concat('SB-', b) as document, s.sheet as sheet, concat('K', k + 1) as designator,
 case when p_size % 11 = 0 or k % 13 = 0 then concat('ALT', b, '-', 1000 + k) else concat('ART', b, '-', 1000 + k) end as article,
 case when k % 17 = 3 then 'nearest' else 'block' end as pair_source,
 concat('relay ', case when k % 6 = 0 then '36' else case when k % 2 = 0 then '24' else '230' end end, 'V') as label_text
 from k_part cross join (select 1 as sheet union all select 2 as sheet union all select 3 as sheet) s
 where p_partkey % 9 <> 0 and not (s.sheet = 2 and k = 5) and not (s.sheet = 3 and k % 2 = 0)""",
    "scheme_tags": "select distinct concat('CAB', b) as bundle, concat('E3-', b) as document, cast(1 + k % 8 as bigint) as sheet, concat('K', k + 1) as designator from k_part where p_partkey % 3 <> 0",
    "connections": """select l_orderkey * 10 + l_linenumber as id, concat('NL-', l_suppkey % 10) as document, cast(1 + l_orderkey % 20 as bigint) as page,
 concat('C', l_suppkey % 10) as cabinet, case when l_partkey % 37 = 0 then null else concat('XT', l_partkey % 90) end as terminal_block,
 case when l_linenumber = 7 then case when l_partkey % 2 = 0 then 'pe' else 'PE' end else cast(l_orderkey % 60 as varchar(9)) end as pin,
 concat('CAB', l_suppkey % 10) as bundle, case when l_partkey % 13 = 0 then 'Резерв 5' when l_partkey % 13 = 1 then cast(100 + l_partkey % 40 as varchar(9)) when l_partkey % 13 = 2 then '' else null end as circuit_marking,
 case when l_partkey % 17 = 0 then null when l_partkey % 19 = 0 then '' when l_returnflag = 'R' and l_linenumber = 1 then 'Резерв' when l_partkey % 11 = 0 then concat('00USE', 10 + l_partkey % 80, 'CL', 100 + l_suppkey % 90, 'XQ01') else concat('00USE', 10 + l_partkey % 80, 'CL', 100 + l_suppkey % 90) end as kks,
 case when l_partkey % 23 = 0 then concat('00USE', 10 + l_partkey % 80, 'CL', 100 + l_suppkey % 90) when l_returnflag = 'R' and l_partkey % 9 = 0 then 'BK 2x1' when l_returnflag = 'R' then '00CJF02AI010P_01' else 'L+' end as conductor
 from lineitem""",
    "sheet_titles": "select concat('ALB', user_id % 5) as album, event_id as sheet, case when event_type in ('click','view') then '' else event_type end as title from events",
    "cross_refs": "select distinct concat('E3-', l_suppkey % 10) as document, cast(1 + l_partkey % 400 as bigint) as from_sheet, cast(1 + l_orderkey % 450 as bigint) as target_sheet from lineitem",
    "segments": """select concat('E3-', b) as document, 1 + k % 3 as sheet, p_partkey as seg, cast((k % 20) * 10 as double) as x1, cast(floor(k / 20) * 10 as double) as y1,
 cast((k % 20) * 10 + case when p_size % 2 = 0 then 20 else 0 end as double) as x2, cast(floor(k / 20) * 10 + case when p_size % 2 = 0 then 0 else 10 end as double) as y2,
 cast(case when p_size % 9 = 0 then 0.0 else 0.72 end as double) as width from k_part""",
    "marks": """select concat('E3-', b) as document, case when b % 2 = 0 then 1 + cast(floor(k / 6) as bigint) % 2 else 1 + cast(floor(k / 6) as bigint) % 7 end as sheet,
 cast(floor(k / 6) as bigint) as comp, k as ord,
 case when k % 6 = 3 and cast(floor(k / 6) as bigint) % 3 = 0 then '6' when k % 6 = 3 and cast(floor(k / 6) as bigint) % 3 = 1 then '6' when k % 6 = 2 and cast(floor(k / 6) as bigint) % 3 = 1 then '4' else '5' end as text
 from k_part""",
}

VIEWS["captions"] = """select p_partkey as id, case p_partkey % 24 when 0 then '1/L1' when 1 then concat('DI', k % 20) when 2 then '230VAC' when 3 then '24 В'
 when 4 then concat('DVP16SN', k % 90, 'T, R5ST-', 1000 + k) when 5 then '026.809.01.01-ИПК ША1' when 6 then '#REF!' when 7 then concat(' КЛ0', k % 9, ' x') when 8 then 'Лист'
 when 9 then concat('A', k % 4, 'x4') when 10 then 'Количе-' when 11 then concat('600x', k % 900, ' мм') when 12 then 'C40A' when 13 then concat('8140', 10 + k % 90)
 when 14 then '12,5' when 15 then concat('XT-G', k % 9) when 16 then 'plc-kvs-16-50-gray' when 17 then 'Схема принципиальная ЩС2' when 18 then concat('Щит общекотельной (ША', k % 5, ') OS001')
 when 19 then 'Вид ЩУ-АБ ЩА1' when 20 then '#DIV/0!' when 21 then 'f:a*b?c ..' when 22 then concat('Реле 0,4кВ; 24VDC; 10А; ', k % 9, 'кА')
 else concat('-QF0', k % 30, ', (XA00', k % 7, '); КL1') end as caption from k_part"""
VIEWS["position_cells"] = """select p_partkey as id, k, k % 6 as form, case k % 6 when 0 then concat('K', k + 1, '...K0', k + 4) when 1 then concat('XT', k, ', XT', k + 1, ';XT', k)
 when 2 then concat('1KL', k, ' - 4KL', k) when 3 then concat('K', k, '-K', k + 1) when 4 then concat('A', k, '…B', k + 3) end as cell from k_part"""
VIEWS["file_names"] = """select p_partkey as id, p_size as pages, concat('base_files/CAB', b, '/', case k % 7 when 0 then '(scheme)' when 1 then ' ( Спецификация )' when 2 then '(unknown)' when 3 then '~$' else '' end, '24-', b,
 case k % 5 when 0 then ' Э3_10.04' when 1 then '_СБ_' when 2 then ' соед СО.1' when 3 then ' NL сх_' else ' СОЕДИНЕНИЙ' end, p_partkey,
 case p_partkey % 4 when 0 then '.pdf' when 1 then '.XLSX' when 2 then '.dwg' else '.PDF' end) as path from k_part"""

# Like spec_items, assembly_elements and scheme_tags, with what the cross-document rules have to fold or leave out: Cyrillic
# letters, leading zeros, terminals, channels, ratings, ranges, replaced and repeated captions, type marks.
VIEWS["order_rows"] = """select concat('CAB', b) as bundle, concat('SO-', b) as document, k as row_no, b = 7 as project_wide,
 case when k % 5 = 0 then concat('К0', k + 1) when k % 23 = 7 then concat('K', k + 1, 'A') else concat('K', k + 1) end as designator,
 case when k % 31 in (0, 4) then null when p_size % 10 = 3 then concat(' аrt', b, '-', 1000 + k) else concat('ART', b, '-', 1000 + k) end as code,
 case when k % 31 = 0 then concat('TM', b, '-', 2000 + k) else null end as type_mark,
 concat(p_type, ' relay ', case when k % 2 = 0 then '24' else '230' end, 'V', case when k % 19 = 0 then concat(' for K', k + 7, ', DIN') else '' end) as name,
 case when k % 13 = 0 then concat('replaced by ALT', b, '-', 1000 + k) else null end as note
 from k_part where p_partkey % 7 <> 0 and (b <> 6 or k < 1) and (b <> 8 or k > 2)"""
VIEWS["drawn_labels"] = """select concat('CAB', b) as bundle, concat('SB-', b) as document, s.sheet as sheet, k * 3 + s.sheet as ord,
 case when k % 23 = 4 then concat(k % 30, 'NO') when k % 23 = 5 then concat('DI', k % 9) when k % 23 = 6 then concat('K', k, '-K', k + 2) when k % 23 = 9 then concat('FU', k)
 when k % 4 = 0 then concat('К', k + 1) when k % 3 = 0 then concat('K00', k + 1) else concat('K', k + 1) end as designator,
 case when k % 29 = 2 then '230VAC' when k % 29 = 3 then '13NO' when k % 5 = 2 then concat('CAP-', b, '00') when k % 31 = 0 then concat('TM', b, '-', 2000 + k)
 when k % 41 = 8 then 'relay' when k % 41 = 9 then '' when p_size % 11 = 0 or k % 13 = 0 then concat('ALT', b, '-', 1000 + k) when k % 4 = 1 and s.sheet = 2 then concat('OTHER-', k)
 else concat('ART', b, '-', 1000 + k) end as article,
 case when k % 17 = 3 then 'nearest' else 'block' end as pair_source,
 concat('relay of type ', k, ': ', case when k % 6 = 0 then '36V' when k % 2 = 0 then '24VDC' else '0,23kV' end) as label_text
 from k_part cross join (select 1 as sheet union all select 2 as sheet union all select 3 as sheet) s
 where p_partkey % 9 <> 0 and not (s.sheet = 2 and k = 5) and not (s.sheet = 3 and k % 2 = 0)"""
VIEWS["scheme_marks"] = """select distinct concat('CAB', b) as bundle, concat('E3-', b) as document, cast(1 + k % 8 as bigint) as sheet,
 case when k % 23 = 4 then concat(k % 30, 'NO') when k % 23 = 5 then concat('DI', k % 9) when k % 23 = 6 then concat('K', k, '-K', k + 2) when k % 23 = 9 then concat('FU0', k) else concat('K', k + 1) end as designator,
 case when p_size % 2 = 0 then concat('ALT', b, '-', 1000 + k) else concat('аRT', b, '-', 1000 + k) end as article from k_part where p_partkey % 3 <> 0"""
VIEWS["designations"] = """select distinct concat('CAB', cast(floor(n_nationkey / 4) as bigint)) as bundle, concat(case when n_regionkey % 3 = 0 then 'SO-' when n_regionkey % 3 = 1 then 'SB-' else 'E3-' end, n_nationkey) as document,
 case when n_regionkey % 3 = 0 then 'spec' when n_regionkey % 3 = 1 then 'assembly' else 'scheme' end as doc_type, n_nationkey as ord, n_nationkey % 8 = 0 as project_wide,
 case when n_nationkey % 7 = 0 then 'no number' when n_nationkey % 3 <> 1 then '026.809.01-ИПК' else concat('026.80', n_regionkey % 3, '.02 СБ') end as designation from nation"""

VIEWS["sheet_refs"] = """select concat('E3-', l_suppkey % 3) as document, cast(1 + l_partkey % 30 as bigint) as from_sheet, cast(1 + l_orderkey % 35 as bigint) as target_sheet, concat('see ', l_linenumber, '/', l_partkey % 4) as raw_text from lineitem"""
ALBUM_TITLES = ["Схема электрическая принципиальная ЩС2 OS001", "Общий вид щита (ЩС1) OS001", "Спецификация оборудования", "Кабельный журнал", "План расположения оборудования", "Вид спереди", "Схема внешних соединений ШУ1",
 "Функциональная схема автоматизации", "Перечень элементов ЩС2", "Пояснительная записка", "Чертёж неизвестный", "Общий вид щита (ЩА) OS002"]
VIEWS["album_sheets"] = "select concat('ALB', user_id % 200) as album, event_id as sheet, case when event_id % 3 = 1 then '' when event_id % 5 = 0 then upper(t) when event_id % 5 = 1 then concat(' ', replace(t, ' ', '  ')) else t end as title from (select user_id, event_id, " + (
    "case cast(floor(event_id / 60) as bigint) % 12 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(ALBUM_TITLES)) + " end as t from events) as x"
)
VIEWS["title_lines"] = """select concat('ALB', user_id % 200) as album, event_id as sheet, l.line as line, case l.line when 1 then case when event_id % 7 = 0 then '' when user_id % 2 = 0 then 'Котельная  №1' else 'КОТЕЛЬНАЯ №1' end when 2 then event_type else concat('лист ', event_id % 50) end as text
 from events cross join (select 1 as line union all select 2 as line union all select 3 as line) l"""
VIEWS["extracts"] = """select p_partkey as id, case p_partkey % 5 when 0 then 'scheme' when 1 then 'netlist' when 2 then 'spec' when 3 then 'assembly' else 'functional' end as doc_type, case when p_size % 13 = 0 then 0 else 2 end as n_files, case when p_size % 7 = 0 then 1 else 0 end as n_errors,
 p_size % 9 as pages, (p_size * 7) % 90 as nodes, (p_size * 3) % 60 as nets, p_size % 4 as terminals, p_size % 3 as markings, p_size % 2 as connections, p_size % 3 as rows, p_size % 5 as designators, p_size % 4 as elements, p_size % 2 as paired, p_size % 2 as instruments, p_size % 3 > 0 as has_number from k_part"""
# Drawings: level wires with branches from their middle, crossings, strokes of letters and a frame; labels around them.
AT = "cast((k % 12) * 30 as double) as gx, cast(floor(k / 12) * 16 as double) as gy"
VIEWS["wires"] = f"""select concat('E3-', b) as document, cast(floor(k / 48) as bigint) % 3 as sheet, p_partkey as seg, case when k % 4 = 0 then gx when k % 4 = 1 then gx - 13 when k % 4 = 2 then gx - 51 else gx + 1 end as x1, case when k % 4 = 2 then gy - 5 else gy end as y1,
 case when k % 4 = 0 then gx + case when k % 16 = 8 then 130 else 30 end when k % 4 = 1 then gx - 13 when k % 4 = 2 then gx - 51 else gx + 3 end as x2, case when k % 4 = 0 then gy when k % 4 = 1 then gy + 9 when k % 4 = 2 then gy + 5.5 else gy + 1 end as y2,
 case when k % 4 = 3 then cast(0.0 as double) when k % 16 = 8 then cast(1.0 as double) when p_size % 2 = 0 then cast(0.72 as double) else cast(0.5 as double) end as width from (select p_partkey, p_size, b, k, {AT} from k_part) as g"""
VIEWS["wire_labels"] = f"""select concat('E3-', b) as document, cast(floor(k / 48) as bigint) % 3 as sheet, p_partkey as ord, case k % 8 when 0 then concat('XT', k % 5) when 1 then cast(k % 30 as varchar(9)) when 2 then concat('00USE', 10 + k % 9) when 3 then '2,5' when 4 then concat(' ', 100 + k % 9)
 when 5 then 'A1' when 6 then concat('XT', k % 3, ':', k % 4) else case when k % 16 = 7 then 'a2' else cast(40 + k % 7 as varchar(9)) end end as text,
 case k % 8 when 0 then 'device_tag' when 1 then 'terminal_no' when 2 then 'instrument_tag' when 3 then 'wire_gauge' when 4 then 'wire_marking' when 5 then 'coil_terminal' when 6 then 'pin_ref' else 'terminal_no' end as entity_type,
 gx + case k % 8 when 0 then 10 when 3 then -75 when 5 then -135 when 6 then -135 when 7 then -190 else 2 end - 2 as x0, gy + case k % 8 when 2 then -30 else 1 end - 1 as y0, gx + case k % 8 when 0 then 10 when 3 then -75 when 5 then -135 when 6 then -135 when 7 then -190 else 2 end + 2 as x1, gy + case k % 8 when 2 then -30 else 1 end + 1 as y1 from (select p_partkey, b, k, {AT} from k_part) as g"""
VIEWS["drawing_texts"] = f"""select concat('SB-', b) as document, cast(floor(k / 40) as bigint) % 3 as sheet, p_partkey as ord, cast(floor(k / 4) as bigint) as block, case k % 4 when 0 then concat('K', k) when 1 then case when p_size % 3 = 0 then concat('ART-', k) else concat('LONGART-', k) end when 2 then concat('Q', k) else case when p_size % 2 = 0 then concat('02', k % 9, '.80', b, '-ИПК') else 'A-1234' end end as text,
 case k % 4 when 0 then 'designator' when 1 then 'article' when 2 then 'designator' else case when p_size % 2 = 0 then 'doc_number' else 'article' end end as entity_type, cast(p_size % 3 + 5 as double) as size, gx as x0, gy as y0, gx + 8 as x1, gy + 4 as y1 from (select p_partkey, p_size, b, k, {AT} from k_part) as g"""
VIEWS["instrument_texts"] = f"""select concat('FSA-', b) as document, cast(floor(k / 48) as bigint) % 3 as sheet, p_partkey as ord, case k % 6 when 0 then 'PT' when 1 then cast(100 + k as varchar(9)) when 2 then concat('te ', 100 + k % 50) when 3 then 'DN50' when 4 then 'LIRA' else concat(k % 90, 'A') end as text,
 case when k % 6 in (1, 5) then gx - 30 else gx end as x0, case when k % 6 in (1, 5) then gy + 5 else gy end as y0, case when k % 6 in (1, 5) then gx - 22 else gx + 8 end as x1, case when k % 6 in (1, 5) then gy + 11 else gy + 6 end as y1 from (select p_partkey, b, k, {AT} from k_part) as g"""
# Modules stand on a few sheets and hold on the next ones; channels come again, some before any module.
VIEWS["channel_lines"] = """select concat('E3-', l_suppkey % 10) as document, l_partkey % 40 as sheet, l_orderkey * 10 + l_linenumber as ord, case l_linenumber when 1 then case when l_partkey % 40 > 5 and l_orderkey % 16 = 0 then concat('AA', 10 + l_partkey % 3, ' ') else 'motor 3QF12' end when 2 then concat('DI ', l_orderkey % 30) when 3 then concat(' Насос  00USE10CL', 100 + l_partkey % 5, ' включен 12KM', 1 + l_suppkey % 9)
 when 4 then case when l_orderkey % 2 = 0 then 'Лист' else 'RB12:3' end when 5 then concat('AO', l_orderkey % 9) when 6 then case when l_orderkey % 3 = 0 then 'ok' when l_orderkey % 3 = 1 then 'да' else 'Ввод 1W2 RA12 2X1' end else concat('сигнал ', l_partkey % 50) end as text from lineitem"""
# Addresses whole, in two spans along the line and in two spans downwards, some of them repeated on the sheet.
VIEWS["address_texts"] = f"""select concat('E3-', b) as document, cast(floor(k / 96) as bigint) % 3 as sheet, p_partkey as ord, case when k % 4 in (0, 3) and k % 8 <> 7 then concat(' 1XT', k % 3, ':') when k % 4 = 2 then concat('1XT', k % 3, ':', k % 5) else cast(k % 5 as varchar(9)) end as text,
 case when k % 4 = 1 then gx - 30 + 14 + p_size % 7 when k % 8 = 7 then gx - 120 else gx end as x0, case when k % 8 = 7 then gy + 13 else gy end as y0, case when k % 4 = 1 then gx - 30 + 24 when k % 8 = 7 then gx - 117 when k % 8 = 3 then gx + 3 else gx + 12 end as x1, case when k % 8 = 3 then gy + 12 when k % 8 = 7 then gy + 17 else gy + 4 end as y1
 from (select p_partkey, p_size, b, k, {AT} from k_part) as g"""
VIEWS["progress_rows"] = """select cast(user_id as varchar(20)) as session, ts, event_id as seq, case event_type when 'purchase' then 'document' when 'signup' then 'stage' when 'error' then 'done' else 'page' end as kind,
 cast(event_id % 5 as int) as index_, cast(9 as int) as total, cast(event_id % 50 as int) as page, concat('doc', event_id % 7) as name, 'scheme' as doc_type, concat('set/', event_id % 7) as path, concat('step ', event_id % 3) as stage,
 event_id % 40 as tokens, cast(event_id % 6 as double) as seconds from events"""
VIEWS["reply_chunks"] = """select cast(user_id as varchar(20)) as session, event_id as seq, case event_id % 9 when 0 then 'so <thi' when 1 then 'nk>maybe ' when 2 then 'not</th' when 3 then 'ink> yes ' when 4 then '<think>' when 5 then 'hm' when 6 then '</think>' else concat('word', event_id % 5, ' ') end as text from events"""
# Rulings, words and rows of tables.
VIEWS["rulings"] = """select concat('T-', b) as document, 1 + k % 2 as page, p_size % 4 = 0 as is_rect, cast(case when k % 3 = 0 then 20 + (k % 7) * 40 + (p_size % 3) * 0.75 else (k % 5) * 10 end as double) as x0, cast(case when k % 3 = 0 then 0 else 15 * (k % 11) + (p_size % 3) * 0.75 end as double) as y0,
 cast(case when k % 3 = 0 then 20 + (k % 7) * 40 + (p_size % 3) * 0.75 else (k % 5) * 10 + 300 + p_size end as double) as x1, cast(case when k % 3 = 0 then 3 + p_size * 2 else 15 * (k % 11) + (p_size % 3) * 0.75 end as double) as y1 from k_part"""
VIEWS["table_words"] = """select concat('T-', l_suppkey % 10) as document, 1 + l_linenumber % 2 as page, l_orderkey * 10 + l_linenumber as ord, case when l_partkey % 13 = 0 then case l_suppkey % 10 when 1 then 'Описание сигнала' when 2 then 'Кабели' when 3 then 'Позиция на схеме' else 'имя' end
 when l_partkey % 13 = 1 then case l_suppkey % 10 when 1 then 'Номер  входа' when 2 then 'Начало Конец' when 3 then 'Резервирование' else 'пин' end else concat('w', l_partkey % 50) end as text, cast(l_partkey % 330 as double) as x0, cast(l_partkey % 330 + 6 as double) as x1, cast(l_orderkey % 20 * 8 as double) as top from lineitem"""
VIEWS["spec_lines"] = """select concat('SP-', b) as document, k as row, case when k % 12 = 4 then '1' when k % 12 = 5 then null when k % 12 = 8 then null else concat('K', k, '...K', k + 2) end as position, case when k % 12 = 4 then '2' when k % 12 = 5 then case when p_size % 2 = 0 then 'Раздел 2' else 'Щиты' end when k % 12 = 8 then ' - замена' when k % 12 = 9 then null else concat('relay  ', p_size) end as name,
 case when k % 12 = 4 then '3' when k % 12 in (5, 8, 9) then null else concat('C', k) end as code, case when k % 12 in (5, 8, 9) then null when k % 5 = 0 then '1,5' when k % 5 = 1 then 'шт' else '2' end as quantity from k_part"""
VIEWS["talk"] = """select conv_id, turn, case when turn % 4 = 3 then 'computer' when role = 'user' and turn % 6 = 0 then 'system' else 'assistant' end as role, case when turn % 3 = 0 then 'code' when turn % 3 = 1 then 'message' else 'image' end as type, text from conversations"""
VIEWS["sheet_texts"] = """select concat('E3-', l_suppkey % 10) as document, concat('CAB', l_suppkey % 5) as bundle, l_orderkey % 40 as sheet, l_orderkey * 10 + l_linenumber as ord, case l_linenumber when 1 then concat('К0', l_partkey % 40) when 2 then concat(' K', l_partkey % 40, ' ') when 3 then concat('DVP', l_partkey % 7)
 when 4 then case when l_suppkey % 2 = 0 then concat('/', l_partkey % 90, '.', l_orderkey % 9, ':B') else concat('(', l_partkey % 90, ':', l_orderkey % 9, 'C)') end when 5 then concat('26.80', l_suppkey % 9) else concat('note, K', l_partkey % 9) end as text,
 case l_linenumber when 1 then 'device_tag' when 2 then 'instrument_tag' when 3 then 'module_partno' when 4 then 'cross_ref' when 5 then 'doc_number' else 'note' end as entity_type from lineitem"""
VIEWS["split_refs"] = f"""select concat('E3-', b) as document, cast(floor(k / 48) as bigint) % 3 as sheet, p_partkey as ord, case when k % 3 = 0 then concat('1XT', k % 9, ':') when k % 3 = 1 then cast(k % 40 as varchar(9)) else 'note 5' end as text, case when k % 3 = 0 then gx else gx - 30 + 14 + p_size % 5 end as x0, gy as y0,
 case when k % 3 = 0 then gx + 12 else gx - 30 + 20 end as x1, gy + 4 as y1 from (select p_partkey, p_size, b, k, {AT} from k_part) as g"""
VIEWS["split_tags"] = VIEWS["split_refs"].replace("concat('1XT', k % 9, ':')", "case when k % 6 = 0 then 'XM' else concat('KL', k % 9) end").replace("as text,", "as text, case when k % 8 = 1 then 'bold' else 'plain' end as font,")
VIEWS["header_cells"] = """select concat('SP-', b) as document, cast(floor(k / 12) as bigint) as page, k % 12 as column_no, case (k * 5 + b) % 12 when 0 then 'Поз. обозначение' when 1 then 'Наименование  и техническая характеристика' when 2 then 'Код изделия' when 3 then ' КОЛИЧЕСТВО' when 4 then 'Кол. на шкаф' when 5 then 'Примечание'
 when 6 then 'Масса единицы, кг' when 7 then 'Единица измерения' when 8 then 'Масса ед.' when 9 then '' when 10 then 'Завод-изготовитель' else 'Прочее' end as text from k_part"""
# Findings with one place or two, by rules and agents; some are not valid.
VIEWS["finding_rows"] = """select l_orderkey * 10 + l_linenumber as finding_id, concat('CAB', l_suppkey % 4) as bundle, case when l_linenumber = 6 then 'agent' else 'rule' end as origin,
 case l_orderkey % 5 when 0 then 'DUPLICATE' when 1 then 'MISSING' when 2 then 'MISMATCH' when 3 then 'REVIEW' else 'OTHER' end as kind,
 case l_partkey % 6 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'info' else 'urgent' end as severity,
 case when l_suppkey % 3 = 0 then 'address' else 'article' end as type, case when l_linenumber % 2 = 0 then 'single_document' else 'cross_document' end as scope,
 concat('NL-', l_suppkey % 4) as document, case when l_suppkey % 5 = 0 then 'scheme' else 'netlist' end as doc_type, l_partkey % 9 as sheet, l_orderkey % 7 as row_no,
 case when l_partkey % 3 = 0 then null else concat('XT', l_partkey % 6) end as terminal_block, cast(l_orderkey % 5 as varchar(9)) as pin, case when l_partkey % 4 = 0 then concat('00USE', 10 + l_partkey % 8) else null end as kks,
 case when l_linenumber % 3 = 0 then concat('SO-', l_suppkey % 4) else null end as document2, concat('K', l_partkey % 12) as designator, case when l_linenumber = 3 then null else concat('ART-', l_partkey % 12) end as article,
 concat('finding of row ', l_linenumber) as finding, case when l_linenumber = 5 then null else 'check it' end as action from lineitem"""


# Spans of six profiles, some of which read otherwise in another profile.
SPAN_TEXTS = [
    "Лист", "Формат А3", "A", "-", "7", "FB_OPEN", "A1", "PE", "Резерв", "РЕЗЕРВ 2", "12С", "/15.2:D", "/4.9.2", "(6:5E)", "(Л11)", "Лист 10.5", "DI7", "AO", "DO1,2A", "2DI1", "2,5 мм²", "4x1", "1x0.75", "R500 DI 16", "МВ210-212", "DVP04AD-S2", "МУ110-224.16Р",
    "S9F22110", "4х2х0,5", "кввгнг-LS", "DR-120", "00USE10CL001", "AT601.2", "XPA3", "-2XT.AP", "XT-AI1", "2XT-G1", "QF10", "12-3", "24-1", "1234", "046", "ИК.1234-5", "24-051-АК", "026.809.01.01-ИПК", "СТМД.14747.75.07-Э3", "04.25", "10.2", "48 B", "=24В", "~220В/+24В",
    "0,05А", "C6A/30мА", "15 м", "-W.H25.1", "3.1АW1", "GNYE", "NC", "+G2", "AA13.1.1 Затвор", "Авария", "АВАРИЯ НАСОСА 1", "Линия QFD1", "V1+", "1/L1", "TA", "13N1", "1P+N-C16", "200/5", "4 (0V)", "RS485-1", "1XT1:PE", "Схема соединения модуля №3 (А)", "see the other sheets", "?!",
]
VIEWS["profile_spans"] = "select l_orderkey * 10 + l_linenumber as ord, concat('E3-', l_suppkey % 60) as document, case l_suppkey % 6 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate("ABCDEF")) + " end as profile, case (l_orderkey * 7 + l_linenumber) % " + (
    f"{len(SPAN_TEXTS)} " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(SPAN_TEXTS))
    + " end as text, cast(l_linenumber as double) as size, cast(case when l_partkey % 5 = 0 then 12 when l_partkey % 5 = 1 then 790 else 300 end as double) as y0, cast(800 as double) as height from lineitem"
)
# Title blocks: captions, a title of two lines, one that sticks out to the left and one to the right; the rulings of the block.
EIGHT = "(select 1 as l union all select 2 as l union all select 3 as l union all select 4 as l union all select 5 as l union all select 6 as l union all select 7 as l union all select 8 as l) as n"
VIEWS["stamp_texts"] = f"""select concat('ALB', user_id % 50) as album, event_id as sheet, l as ord, case l when 1 then 'Стадия' when 2 then ' ЛИСТОВ' when 3 then 'Изм.' when 4 then 'Кол.уч' when 5 then concat('Щит ЩС', event_id % 9) when 6 then case when event_id % 4 = 0 then 'Формат А3' else '12.05.26 Схема' end when 7 then 'Объект' else 'выше' end as text,
 cast(case l when 1 then 500 + event_id % 3 when 2 then 540 when 3 then 100 when 4 then 125 when 5 then 305 + event_id % 4 when 6 then 270 when 7 then 310 else 320 end as double) as x0, cast(case l when 5 then 610 when 6 then 620 when 7 then 615 when 8 then 500 + event_id % 100 else 590 + l * 4 end as double) as y0,
 cast(case l when 1 then 530 when 2 then 570 when 3 then 120 when 4 then 150 when 5 then 440 when 6 then 330 + 30 * (event_id % 7) when 7 then 460 + 20 * (event_id % 5) else 400 end as double) as x1, cast(700 as double) as y1
 from events cross join {EIGHT} where not (event_id % 5 = 0 and l <= 2) and not (event_id % 15 = 0 and l in (3, 4))"""
VIEWS["stamp_rulings"] = f"""select concat('ALB', user_id % 50) as album, event_id as sheet, (event_id + l) % 2 = 0 as is_rect, cast(case l when 1 then 100 when 2 then 128 when 3 then 156 when 4 then 299.5 when 5 then 470 + event_id % 4 when 6 then 472 + event_id % 4 when 7 then 520 else 486 end as double) as x0, cast(560 as double) as y0,
 cast(case l when 1 then 100 when 2 then 128 when 3 then 156 when 4 then 300.5 when 5 then 470 + event_id % 4 when 6 then 472 + event_id % 4 when 7 then 520 else 486 end as double) as x1, cast(case when l = 8 then 562 when l = 2 then 580 when event_id % 11 = 0 and l in (4, 5) then 570 else 660 end as double) as y1 from events cross join {EIGHT}"""
# Pages of three kinds of lists: a header on every fourth page, its layout on the next two, another layout on the fourth.
CELL_TEXTS = {
    0: (("XS'k'", "Дискретные сигналы", "Лист", "XS'k'"), ("1DI'k'", "", "", "04.25"), ("bool", "bool", "bool", "bool"), ("сигнал  'k'", "", "x", "y")),
    1: (("K-'k'", "K-'k'", "Подп.", "K-'k'"), ("A'k'", "", "A'k'", "A'k'"), ("B'k'", "", "B'k'", ""), ("ВВГ", "ВВГ", "", "ВВГ")),
    2: (("PT'k'", "", "Дата", ""), ("Давление", "Насосы 'k'", "x", "Примечание"), ("СК НР =24В", "", "0..1", ""), ("лист 'k'", "", "", "")),
}
HEADER_TEXTS = (("Обозначение", "Адрес  PLC", "Тип", "Описание сигнала"), ("№ кабеля", "Начало", "Конец", "Марка"), ("Позиция по схеме", "Наименование", "Пределы измерений", "Лист схемы"))


def _cell(kind: int, column: int) -> str:
    """The text of a list's cell by row: most rows, headings, stamps, odd ones."""
    plain, heading, stamp, odd = ("concat('" + t.replace("'k'", "', k, '") + "')" for t in CELL_TEXTS[kind][column])
    return f"case k % 8 when 3 then {heading} when 5 then {stamp} when 6 then {odd} else {plain} end"


VIEWS["list_words"] = f"""select document, page, ord, text, x0, x0 + 20 as x1, top, top + 6 as bottom from (select concat('L-', b) as document, cast(floor(k / 8) as bigint) + 1 as page, k * 10 + l as ord,
 case when l > 4 then case b % 3 {" ".join(f"when {i} then case l {' '.join(f'when {j + 5} then {chr(39)}{t}{chr(39)}' for j, t in enumerate(texts))} end" for i, texts in enumerate(HEADER_TEXTS))} end
 else case b % 3 {" ".join(f"when {i} then case l {' '.join(f'when {j + 1} then {_cell(i, j)}' for j in range(4))} end" for i in range(3))} end end as text,
 cast(70 + 100 * ((l - 1) % 4) + case when floor(k / 8) % 4 = 3 then 10 else 0 end as double) as x0, cast(case when l > 4 then 30 else 105 + 20 * (k % 8) end as double) as top from k_part cross join {EIGHT}
 where l <= 4 or (k % 8 = 0 and floor(k / 8) % 4 = 0)) as w where text <> ''"""
VIEWS["list_rulings"] = f"""select concat('L-', b) as document, cast(floor(k / 8) as bigint) + 1 as page, l % 2 = 0 as is_rect, cast(case when l <= 2 then 60 else 60 + 100 * (l - 3) + case when floor(k / 8) % 4 = 3 then 10 else floor(k / 8) % 4 end end as double) as x0, cast(case when l <= 2 then 80 + 20 * (l + k % 8) else 20 end as double) as y0,
 cast(case when l <= 2 then 760 else 60 + 100 * (l - 3) + case when floor(k / 8) % 4 = 3 then 10 else floor(k / 8) % 4 end end as double) as x1, cast(case when l <= 2 then 80 + 20 * (l + k % 8) else 300 end as double) as y1 from k_part cross join {EIGHT} where l <= 2 or (l <= 7 and k % 8 = 0)"""
VIEWS["header_lines"] = """select concat('SP-', b) as document, cast(floor(k / 12) as bigint) as page, p_partkey as ord, case k % 12 when 1 then 'Код обору-' when 2 then concat('дования,', p_size) when 4 then ' Наименование' when 7 then 'изделия' when 9 then case when b % 4 = 0 then 'Количество' else '246' end else concat('K', k) end as text,
 cast(case k % 12 when 1 then 40 when 2 then 50 + p_size % 3 when 4 then 42 when 7 then 58 + b % 9 else 60 + (k % 12) * 30 end as double) as y0, cast(case k % 12 when 1 then 48 when 2 then 60 when 4 then 47 when 7 then 70 else 66 + (k % 12) * 30 end as double) as y1, cast(800 as double) as page_height from k_part"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table. Spark puts the base tables in by name through parameters of ``sql``."""
    sql = VIEWS[name]
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "events", "part", "nation", "orders", "pages", "conversations") if f"from {t}" in sql or (t == "part" and "from k_part" in sql)}
    if "part" in base:
        base["k_part"] = spark.sql(K_PART.replace("from part", "from {part}"), part=base.pop("part"))
    for t in base:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **base)


def with_views(sql: str) -> str:
    """The same tables as CTEs before a DuckDB query."""
    used = [n for n in VIEWS if n in sql]
    ctes = ([f"k_part as ({K_PART})"] if any("k_part" in VIEWS[n] for n in used) or "k_part" in sql else []) + [f"{n} as ({VIEWS[n]})" for n in used]
    own = sql.lstrip()
    for head in ("with recursive ", "with "):
        if ctes and own.startswith(head):
            return f"{head}{', '.join(ctes)}, {own[len(head):]}"
    return f"with {', '.join(ctes)} {sql}" if ctes else sql
