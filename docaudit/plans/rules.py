"""Queries over rules on one table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules_single as R
from .common import over


def wiring(connections: DataFrame) -> DataFrame:
    """The wiring table with what signal lists and cable journals have: channel and cable, and a kind of table for each document."""
    channel, cable = F.concat(F.col("id") % 97, F.lit("DO"), F.col("page")), F.concat(F.lit("W"), F.col("id") % 1013)
    kind = F.element_at(F.array(*map(F.lit, ("gost_connections", "signal_list", "cable_journal", "param_list"))), F.regexp_extract("document", r"\d+", 0).cast("int") % 4 + 1)
    return connections.withColumns({"connection_address": channel, "cable_harness": cable, "table_kind": kind})


def wide_codes(items: DataFrame) -> DataFrame:
    return R.dup_code(items, items.filter("document = 'SO-3'").select("document").distinct())


def broken(items: DataFrame) -> DataFrame:
    cells = items.select("document", F.col("row_no").alias("row"), F.lit("name").alias("cell"), F.when(F.col("row_no") % 11 == 0, "#REF!").when(F.col("row_no") % 11 == 1, " #n/a ").otherwise(F.col("name")).alias("value"))
    return R.cell_errors(cells)


def addresses(connections: DataFrame) -> DataFrame:
    """Addresses written several times on a sheet."""
    own = connections.select("document", F.col("page").alias("sheet"), F.concat("terminal_block", F.lit(":"), "pin").alias("address")).filter("address is not null")
    return R.dup_address_on_sheet(own.groupBy("document", "sheet", "address").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"))


def coils(segments: DataFrame) -> DataFrame:
    return R.dup_relay_coil(segments.select("document", "sheet", F.concat(F.lit("KL"), F.pmod("seg", F.lit(13))).alias("designator"), F.col("x1").alias("x"), F.col("y1").alias("y")))


def references(rows: DataFrame) -> DataFrame:
    return R.one_way_sheet_link(rows)


C = "connections"
def statistics(connections: DataFrame) -> DataFrame:
    entries = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    found = R.table_stats(connections)
    return found.withColumns({**{c: F.array_join(c, ",") for c in ("blocks", "roles")}, **{c: entries(c) for c in ("filled", "duplicate_addresses")}})


QUERIES = {
    "r6_dup_signal_channel": over(lambda c: R.dup_signal_channel(wiring(c)), C),
    "r7_dup_cable": over(lambda c: R.dup_cable(wiring(c)), C),
    "r8_cell_errors": over(broken, "spec_items"),
    "r10_dup_code_one_cabinet": over(wide_codes, "spec_items"),
    "r13_one_way_sheet_link": over(references, "sheet_refs"),
    "r14_dup_address_on_sheet": over(addresses, C),
    "r15_dup_relay_coil": over(coils, "segments"),
    "r16_table_stats": over(statistics, C),
    "r17_spec_sections": over(R.spec_sections, "order_rows"),
    "r18_designator_index": over(R.designator_index, "drawn_labels"),
    "r18_pairing_totals": over(R.pairing_totals, "drawn_labels"),
    "cls12_applicable": over(lambda c: R.applicable(wiring(c).select("document", F.lit("netlist").alias("doc_type"), "table_kind", F.lit(False).alias("project_wide")).distinct()), C),
}
W = """wiring as (select *, concat(id % 97, 'DO', page) as connection_address, concat('W', id % 1013) as cable_harness, (['gost_connections', 'signal_list', 'cable_journal', 'param_list'])[regexp_extract(document, '\\d+')::int % 4 + 1] as table_kind from connections)"""
DUP = lambda key, kind: f"with {W} select document, {key}, count(*) as n, list_sort(list(id))[1] as first_id, list_sort(list(id))[2] as second_id, 'high' as severity from wiring where table_kind = '{kind}' group by document, {key} having count(*) >= 2"
SQL = {
    "r6_dup_signal_channel": DUP("connection_address", "signal_list"),
    "r7_dup_cable": DUP("cable_harness", "cable_journal"),
    "r8_cell_errors": "select document, row_no as row, 'name' as cell, case when row_no % 11 = 0 then '#REF!' else ' #n/a ' end as value, 'FORMAT' as kind from spec_items where row_no % 11 < 2",
    "r10_dup_code_one_cabinet": "select document, code, count(*) as n, list_sort(list(row_no))[1] as first_id, list_sort(list(row_no))[2] as second_id from spec_items where document <> 'SO-3' group by document, code having count(*) >= 2",
    "r13_one_way_sheet_link": """select document, from_sheet, target_sheet, count(*) as n, array_to_string(list_sort(list_distinct(list(raw_text)))[1:5], '|') as examples from sheet_refs a where from_sheet <> target_sheet
 and not exists (select 1 from sheet_refs b where b.document = a.document and b.from_sheet = a.target_sheet and b.target_sheet = a.from_sheet) group by all""",
    "r14_dup_address_on_sheet": """with d as (select document, page as sheet, terminal_block as block, pin, concat(terminal_block, ':', pin) as address, count(*) as n from connections where terminal_block is not null and pin is not null group by all having count(*) >= 2)
 select document, sheet, address, n, 'high' as severity from d where upper(pin) not in ('N', 'PE', 'PEN') and (select count(*) from d e where e.document = d.document and e.sheet = d.sheet and e.block = d.block) < 2""",
    "r15_dup_relay_coil": "select document, concat('KL', seg % 13) as designator, count(*) as n, count(distinct sheet) as sheets, min(sheet) as first_sheet, 'high' as severity from segments group by all having count(*) >= 2",
    "r16_table_stats": """with d as (select document, concat(cabinet, '.', terminal_block, '.', pin) as a, count(*) as n from connections where terminal_block <> '' and pin <> '' group by all having count(*) > 1), e as (select document, string_agg(concat(a, '=', n), ',' order by a) as duplicate_addresses from d group by document)
 select c.document, count(*) as n, max(page) as pages, concat('cable_harness=0,circuit_marking=', count(*) filter (circuit_marking <> ''), ',kks=', count(*) filter (kks <> ''), ',conductor=', count(*) filter (conductor <> ''), ',cabinet=', count(*) filter (cabinet <> ''), ',terminal_block=', count(*) filter (terminal_block <> ''),
 ',pin=', count(*) filter (pin <> ''), ',terminal_type_or_ref=0,connection_address=0,note=0') as filled, array_to_string(list_sort(list(distinct nullif(terminal_block, '')) filter (terminal_block <> '')), ',') as blocks, array_to_string(list_sort(list(distinct conductor) filter (conductor <> '')), ',') as roles,
 count(*) filter (contains(lower(coalesce(kks, '')), 'резерв') or contains(lower(coalesce(circuit_marking, '')), 'резерв')) as reserve, coalesce(any_value(duplicate_addresses), '') as duplicate_addresses from connections c left join e on e.document = c.document group by c.document""",
    "r17_spec_sections": """with per as (select document, code, count(*) as n from order_rows where code is not null and code <> '' group by all) select o.document, count(*) as rows_, count(*) filter (designator <> '') as with_position, count(distinct designator) as designators,
 count(*) filter (coalesce(code, '') = '') as without_code, (select count(*) from per p where p.document = o.document and n > 1) as duplicate_codes from order_rows o group by o.document""",
    "r18_designator_index": """select document, designator, count(*) as n, array_to_string(list_sort(list_distinct(list(sheet)))::varchar[], ',') as sheets, array_to_string(list_sort(list_distinct(list(article))), ',') as articles, array_to_string(list_sort(list_distinct(list(pair_source))), ',') as sources from drawn_labels group by all""",
    "r18_pairing_totals": "select document, count(*) as n, count(*) filter (pair_source = 'block') as in_block, count(*) filter (pair_source = 'nearest') as nearest, count(*) filter (article = '') as unpaired from drawn_labels group by document",
    "cls12_applicable": """select document, unnest(case regexp_extract(document, '\\d+')::int % 4 when 0 then ['dup_terminal_address', 'tag_in_conductor', 'kks_suffix_artifact', 'missing_terminal', 'reserve_tag_placement'] when 1 then ['dup_signal_channel'] when 2 then ['dup_cable'] else [] end) as rule
 from (select distinct document from connections)""",
}
