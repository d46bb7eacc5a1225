"""Every query of the library and the SQL it is checked against."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import view, with_views
from .functions import text as T
from .plans import across, albums, drawings, grids, layouts, reports, rules, streams, texts
from .plans.common import over, raw
from .operators import bundles, logs, nets, odd, report, rules_bundle, rules_cross, rules_single, tables


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, a, t = (view(spark, sf_dir, n) for n in ("spec_items", "assembly_elements", "scheme_tags"))
    ordered = rules_cross.spec_not_on_assembly(s, a, t).select("bundle", F.col("key").alias("designator"), F.lit("MISSING_ON_DRAWING").alias("kind"), "severity")
    drawn = rules_bundle.designator_not_in_spec(*(view(spark, sf_dir, n) for n in ("order_rows", "drawn_labels", "scheme_marks"))).select("bundle", "designator", F.lit("MISSING_IN_SPEC").alias("kind"), "severity")
    return ordered.unionByName(drawn).withColumn("rank", T.severity_rank(F.col("severity"))).orderBy("rank", "bundle", "designator")


def marks_dropped(marks: DataFrame) -> DataFrame:
    return odd.drop_repeated(odd.odd_ones_out(marks))


def links(refs: DataFrame) -> DataFrame:
    return rules_single.broken_sheet_link(refs, refs.select("document").distinct().withColumn("total", F.lit(400)))


def text_keys(part: DataFrame) -> DataFrame:
    c = F.col("p_type")
    return part.select("p_partkey", T.fold(c).alias("folded"), T.fold_designator(F.concat(F.lit("xa0"), F.col("p_partkey").cast("string"))).alias("designator"), F.size(T.text_tokens(F.col("p_name"))).cast("long").alias("n_tokens"), T.to_number(F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))).alias("price"), T.approx_tokens(c).alias("tokens"), T.clip_text(c, 5).alias("clipped"), T.norm_title(c).alias("title"))


def documents(items: DataFrame, elements: DataFrame, tags: DataFrame) -> DataFrame:
    """bundle, document, doc_type, n of the derived tables; bundle CAB3 has no specification of its own, CAB0 is the common one."""
    kinds = ((items.filter("bundle <> 'CAB3'"), "spec"), (elements, "assembly"), (tags, "scheme"))
    per = [d.groupBy("bundle", "document").agg(F.count(F.lit(1)).alias("n")).withColumn("doc_type", F.lit(k)) for d, k in kinds]
    return per[0].unionByName(per[1]).unionByName(per[2])


def paths(items: DataFrame) -> DataFrame:
    return items.select(F.when(F.col("row_no") % 2 == 0, F.concat(F.lit("base_files/"), "bundle", F.lit("/"), "code")).otherwise(F.concat(F.lit("base_files/"), "code")).alias("path")).distinct()


def assigned(items: DataFrame) -> DataFrame:
    given = items.filter("row_no % 5 = 0").select(F.col("code").alias("name"), F.lit("forced").alias("bundle")).distinct()
    return bundles.assign_bundles(paths(items), given)


def lent(items: DataFrame, elements: DataFrame, tags: DataFrame) -> DataFrame:
    return bundles.lend_common_specs(documents(items, elements, tags), "CAB0")


def project_wide(items: DataFrame, elements: DataFrame, tags: DataFrame) -> DataFrame:
    return bundles.pick_project_wide_spec(lent(items, elements, tags), items, elements, tags)


def item_findings(items: DataFrame) -> DataFrame:
    """A finding for every row with a replacement note (low) or a planted code (high)."""
    kind, severity = (F.when(F.col("note").isNotNull(), x).otherwise(y) for x, y in (("REPLACED", "DUPLICATE"), ("low", "high")))
    ref = F.struct("document", "designator", F.col("code").alias("article"))
    return items.filter("note is not null or code like 'DUP%'").select(F.concat_ws("/", "document", F.lpad(F.col("row_no").cast("string"), 12, "0")).alias("finding_id"), kind.alias("kind"), severity.alias("severity"), F.array(ref).alias("refs"))


def sections(titles: DataFrame) -> DataFrame:
    return tables.carry_section(titles, "album", "sheet", "title").select("album", "sheet", "section")


s, a, t = "spec_items", "assembly_elements", "scheme_tags"
QUERIES = {
    "x1_positions": over(bundles.positions, s),
    "x2_scheme_facts": over(bundles.scheme_facts, t),
    "x3_merge_documents": over(bundles.merge_documents, a),
    "cls5_assign_bundles": over(assigned, s),
    "cls6_bundle_summary": over(lambda *d: bundles.bundle_summary(documents(*d)), s, a, t),
    "cls8_pick_primary": over(lambda e: bundles.pick_primary(e.groupBy("bundle", F.concat("document", F.lit("/"), "sheet").alias("document")).agg(F.count(F.lit(1)).alias("n")).withColumn("doc_type", F.lit("assembly")), "n"), a),
    "cls9_drop_empty": over(lambda d, e: bundles.drop_empty(d.select("document").distinct(), e.filter("note is not null").select("document")), s, s),
    "cls10_lend_common_specs": over(lent, s, a, t),
    "cls11_project_wide_spec": over(project_wide, s, a, t),
    "rep8_severity_sort": over(lambda d: report.severity_sort(item_findings(d)).select("finding_id", "severity"), s),
    "rep9_report_counts": over(lambda d: report.report_counts(item_findings(d)), s),
    "tab1_column_separators": over(tables.column_separators, "segments"),
    "tab7_carry_section": over(sections, "sheet_titles"),
    "r1_dup_terminal_address": over(rules_single.dup_terminal_address, "connections"),
    "r2_tag_in_conductor": over(rules_single.tag_in_conductor, "connections"),
    "r3_kks_suffix_artifact": over(rules_single.kks_suffix_artifact, "connections"),
    "r4_missing_terminal": over(rules_single.missing_terminal, "connections"),
    "r5_reserve_tag_placement": over(rules_single.reserve_tag_placement, "connections"),
    "r9_qty_below_positions": over(rules_single.qty_below_positions, s),
    "r10_dup_code": over(rules_single.dup_code, s),
    "r11_missing_from_peer_sheet": over(rules_single.missing_from_peer_sheet, a),
    "r12_broken_sheet_link": over(links, "cross_refs"),
    "r16_column_population": over(rules_single.column_population, "connections"),
    "r17_spec_stats": over(rules_single.spec_stats, s),
    "r18_assembly_stats": over(rules_single.assembly_stats, a),
    "x4_mass_captions": over(lambda e: rules_cross.mass_captions(e, "label_text"), a),
    "x6_spec_not_on_assembly": over(rules_cross.spec_not_on_assembly, s, a, t),
    "odd2_odd_ones_out": over(odd.odd_ones_out, "marks"),
    "odd3_drop_repeated": over(marks_dropped, "marks"),
    "net2_drop_hairlines": over(nets.drop_hairlines, "segments"),
    "net3_dense_sheets": over(lambda g: nets.dense_sheets(g, 5), "segments"),
    "net4_endpoint_edges": over(nets.endpoint_edges, "segments"),
    "net7_connected_components": over(nets.nets, "segments"),
    "log1_agent_transcript": raw("conversations", logs.agent_transcript),
    "log3_split_reasoning": raw("conversations", logs.split_reasoning),
    "txt_keys": raw("part", text_keys),
}
ADDRESS = "select *, cabinet || '.' || terminal_block || '.' || pin as terminal_address from connections"
BLOCK = "select *, upper(designator) as key from assembly_elements where pair_source = 'block'"
ODD = """n as (select document, sheet, comp, cast(text as integer) as v, count(*) as n from marks group by all),
 o as (select a.document, a.sheet, a.comp, a.v as major, b.v as odd from n a join n b using (document, sheet, comp) where a.n >= 3 and b.n = 1 and abs(a.v - b.v) = 1
 and not exists (select 1 from n m where m.document = a.document and m.sheet = a.sheet and m.comp = a.comp and m.n = 1 and m.v = 2 * a.v - b.v))"""
DOCUMENTS = """(select bundle, document, 'spec' as doc_type from spec_items where bundle <> 'CAB3' group by all union all
 select bundle, document, 'assembly' from assembly_elements group by all union all select bundle, document, 'scheme' from scheme_tags group by all)"""
FOUND = """(select document || '/' || lpad(cast(row_no as varchar), 12, '0') as finding_id, case when note is null then 'DUPLICATE' else 'REPLACED' end as kind,
 case when note is null then 'high' else 'low' end as severity, document, designator, code, row_no from spec_items where note is not null or code like 'DUP%')"""
SIGNATURE = "kind || ';' || document || '|' || designator || '|' || code"
LENT = f"""(select bundle, (select min(document) from {DOCUMENTS} where bundle = 'CAB0' and doc_type = 'spec') as document, true as project_wide from {DOCUMENTS}
 group by bundle having bundle <> 'CAB0' and count(*) filter (doc_type = 'spec') = 0)"""
SQL = {
    "x1_positions": "select bundle, designator, min(row_no) as first_row, count(*) as n from spec_items group by all",
    "x2_scheme_facts": "select bundle, designator, array_to_string(list_sort(list(distinct sheet)), ',') as sheets from scheme_tags group by all",
    "x3_merge_documents": "select distinct bundle, designator, first_value(article) over (partition by bundle, designator order by document, sheet) as article, (select count(distinct article) from assembly_elements b where b.bundle = e.bundle and b.designator = e.designator) as articles from assembly_elements e",
    "cls5_assign_bundles": "select path, case when name in (select code from spec_items where row_no % 5 = 0) then 'forced' when sub is not null then sub else 'project' end as bundle, case when name in (select code from spec_items where row_no % 5 = 0) then 'override' when sub is not null then 'folder' else 'default' end as bundle_source from (select distinct 'base_files/' || case when row_no % 2 = 0 then bundle || '/' else '' end || code as path, code as name, case when row_no % 2 = 0 then bundle end as sub from spec_items)",
    "cls6_bundle_summary": f"select bundle, count(*) as n, array_to_string(list_sort(list(distinct doc_type)), ',') as types, count(distinct doc_type) >= 2 as cross_checkable from {DOCUMENTS} group by bundle",
    "cls8_pick_primary": "select *, row_number() over (partition by bundle order by n desc, document) = 1 as main from (select bundle, document || '/' || sheet as document, count(*) as n, 'assembly' as doc_type from assembly_elements group by bundle, document, sheet)",
    "cls9_drop_empty": "select document from spec_items group by document having count(note) > 0",
    "cls10_lend_common_specs": f"select * from {LENT}",
    "cls11_project_wide_spec": f"select n.bundle, n.document, count(distinct i.designator) as shared from {LENT} n join spec_items i using (document) where exists (select 1 from assembly_elements e where e.bundle = n.bundle and e.designator = i.designator) and exists (select 1 from scheme_tags g where g.bundle = n.bundle and g.designator = i.designator) group by n.bundle, n.document",
    "rep8_severity_sort": f"select finding_id, severity from {FOUND} order by case severity when 'high' then 1 else 3 end, finding_id",
    "rep9_report_counts": f"select kind, severity, count(*) as n from {FOUND} group by all",
    "tab1_column_separators": "select document, sheet, x from (select *, max(length) over (partition by document, sheet) as top from (select document, sheet, round(x1) as x, sum(abs(y2 - y1)) as length from segments where abs(x1 - x2) <= 1 and y1 <> y2 group by document, sheet, round(x1))) where length >= 0.5 * top",
    "tab7_carry_section": "select album, sheet, last_value(nullif(title, '') ignore nulls) over (partition by album order by sheet rows between unbounded preceding and current row) as section from sheet_titles",
    "r1_dup_terminal_address": f"select document, terminal_address, count(*) as n, min(id) as first_id, list_sort(list(id))[2] as second_id, case when upper(arg_min(pin, id)) = 'PE' then 'medium' else 'high' end as severity from ({ADDRESS}) where terminal_address is not null group by document, terminal_address having count(*) >= 2",
    "r2_tag_in_conductor": "select document, id, kks from connections where kks = conductor and kks <> ''",
    "r3_kks_suffix_artifact": r"select document, id, regexp_extract(kks, '^(00[A-Z]{2,4}\d{2}[A-Z]{2}\d{3})(.+)$', 1) as tag, regexp_extract(kks, '^(00[A-Z]{2,4}\d{2}[A-Z]{2}\d{3})(.+)$', 2) as tail from connections where regexp_matches(kks, '^(00[A-Z]{2,4}\d{2}[A-Z]{2}\d{3})(.+)$')",
    "r4_missing_terminal": "select document, id, coalesce(nullif(kks, ''), nullif(circuit_marking, '')) as owner from connections where coalesce(kks, '') <> 'Резерв' and coalesce(nullif(kks, ''), nullif(circuit_marking, '')) is not null and (terminal_block is null or pin is null)",
    "r5_reserve_tag_placement": "select document, count(*) as n, concat(array_to_string(list_sort(list(id))[1:15], ','), case when count(*) > 15 then '...' else '' end) as ids from connections where kks = 'Резерв' and regexp_matches(conductor, '^00[A-Z0-9]{4,}[A-Z][0-9]{2,3}[A-Z]?(_[0-9]+)?$') group by document",
    "r9_qty_below_positions": "select document, row_no, quantity, n_positions from spec_items where quantity > 1 and n_positions >= 2 and quantity < n_positions",
    "r10_dup_code": "select document, code, count(*) as n, min(row_no) as first_id, list_sort(list(row_no))[2] as second_id from spec_items group by document, code having count(*) >= 2",
    "r11_missing_from_peer_sheet": "select * from (select x.document, x.sheet, y.sheet as peer, unnest(list_filter(x.d, lambda v: not list_contains(y.d, v))) as designator from (select document, sheet, list(distinct designator) as d from assembly_elements group by all) x join (select document, sheet, list(distinct designator) as d from assembly_elements group by all) y on x.document = y.document and x.sheet <> y.sheet where len(list_intersect(x.d, y.d)) >= 8 and len(x.d) - len(list_intersect(x.d, y.d)) between 1 and 3 and len(list_intersect(x.d, y.d)) >= 0.9 * len(x.d))",
    "r12_broken_sheet_link": "select * from cross_refs where target_sheet < 1 or target_sheet > 400",
    "r16_column_population": "select document, count(*) as n, count(*) filter (terminal_block <> '') as n_terminal_block, count(*) filter (pin <> '') as n_pin, count(*) filter (kks <> '') as n_kks, count(*) filter (conductor <> '') as n_conductor, count(*) filter (kks = 'Резерв') as n_reserve, count(distinct terminal_block) as blocks, max(page) as pages from connections group by document",
    "r17_spec_stats": "select document, count(*) as n, count(distinct designator) as designators, count(distinct code) as codes, count(*) filter (coalesce(code, '') = '') as without_code from spec_items group by document",
    "r18_assembly_stats": "select document, designator, count(*) as n, count(distinct sheet) as sheets, count(distinct article) as articles, count(*) filter (pair_source = 'block') as in_block from assembly_elements group by all",
    "x4_mass_captions": "select bundle, label_text, count(distinct designator) as n from assembly_elements where pair_source = 'block' group by all having count(distinct designator) >= 25",
    "x6_spec_not_on_assembly": "select bundle, designator as key, arg_min(document, row_no) as document, min(row_no) as row_no, case when exists (select 1 from scheme_tags g where g.bundle = s.bundle and g.designator = s.designator) then 'low' else 'medium' end as severity from spec_items s where not exists (select 1 from assembly_elements e where e.bundle = s.bundle and e.designator = s.designator) group by bundle, designator",
    "odd2_odd_ones_out": ("select * from o", ODD),
    "odd3_drop_repeated": ("select o.* from o where (select count(distinct sheet) from o p where p.document = o.document and p.major = o.major and p.odd = o.odd) < 3", ODD),
    "net2_drop_hairlines": "select * exclude (stroked) from (select *, count(*) filter (width > 0) over (partition by document, sheet) as stroked from segments) where width > 0 or stroked < 20",
    "net3_dense_sheets": "select document, sheet, count(*) as n from segments group by all having count(*) > 5",
    "net4_endpoint_edges": "select distinct seg as src, min(seg) over (partition by document, sheet, gx, gy) as dst from (select distinct document, sheet, seg, cast(round_even(x / 0.15, 0) as bigint) as gx, cast(round_even(y / 0.15, 0) as bigint) as gy from (select document, sheet, seg, x1 as x, y1 as y from segments union all select document, sheet, seg, x2, y2 from segments))",
    "net7_connected_components": f"with recursive {drawings.COMP.replace('wires', 'segments')} select seg, net from net_of",
    "log3_split_reasoning": "select conv_id, turn, array_to_string(regexp_extract_all(text, '(?s)<think>(.*?)(?:</think>|$)', 1), chr(10)) as reasoning, trim(regexp_replace(text, '(?s)<think>.*?(?:</think>|$)', '', 'g')) as visible from conversations",
    "txt_keys": """select p_partkey, upper(p_type) as folded, concat('XA', p_partkey) as designator, len(list_distinct(list_filter(list_transform(regexp_split_to_array(p_name, '[\\s,;]+'), lambda t: upper(t)), lambda t: t <> ''))) as n_tokens, p_retailprice::double as price,
 greatest(1, round_even(length(p_type) / 4, 0))::bigint as tokens, case when length(p_type) > 5 then concat(p_type[1:5], '...') else p_type end as clipped, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) as title from part""",
    "log1_agent_transcript": "select conv_id, count(*) as n_kept, cast(sum(n) as bigint) as chars from (select conv_id, n, sum(n) over (partition by conv_id order by turn desc) as upto from (select conv_id, turn, length(role) + 2 + case when length(text) > 200 then 203 else length(text) end as n from conversations)) where upto <= 1000 group by conv_id",
}


PLANS = [texts, across, reports, rules, albums, drawings, streams, grids, layouts]


def queries() -> dict:
    return {**QUERIES, **{k: q for m in PLANS for k, q in m.QUERIES.items()}}


def oracle_sql() -> dict:
    out = {}
    for k, q in SQL.items():
        q, more = q if isinstance(q, tuple) else (q, "")
        sql = with_views(q)
        if more:
            head = with_views("select 1 from marks")
            sql = head[: head.rindex("select 1")].rstrip() + ", " + more + " " + q
        out[k] = sql
    return out | {k: with_views(q) for m in PLANS for k, q in m.SQL.items()}
