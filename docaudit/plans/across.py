"""Queries over the rules across documents, on tables with everything that they fold or leave out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules_bundle as R
from ..operators import rules_cross
from . import sql as S
from .common import over

O, D, M = "order_rows", "drawn_labels", "scheme_marks"


def not_drawn(orders: DataFrame, drawn: DataFrame, marks: DataFrame) -> DataFrame:
    return rules_cross.spec_not_on_assembly(orders, drawn, marks)


def checked(orders: DataFrame, drawn: DataFrame, marks: DataFrame, documents: DataFrame) -> DataFrame:
    found = R.check_bundle(orders, drawn, marks, documents, not_drawn(orders.filter("not project_wide"), drawn, marks))
    return found.groupBy("bundle", "rule", "kind", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))


def terminals(connections: DataFrame, marks: DataFrame) -> DataFrame:
    own = connections.select("bundle", "document", F.col("terminal_block").alias("block"), "pin", F.col("circuit_marking").alias("marking"))
    number = F.regexp_extract("designator", r"\d+", 0)
    theirs = marks.select("bundle", "document", F.concat(F.lit("ХТ0"), F.col("sheet").cast("string")).alias("block"), number.alias("pin"), number.alias("marking"))
    return R.netlist_vs_scheme(own, theirs, theirs)


def instruments(connections: DataFrame, marks: DataFrame) -> DataFrame:
    drawn = marks.select("bundle", "document", F.concat(F.lit("XT"), F.regexp_extract("designator", r"\d+", 0)).alias("tag"))
    return R.instrument_links(drawn, connections.select("bundle", "document", F.col("terminal_block").alias("tag")))


def tags(spans: DataFrame) -> DataFrame:
    return R.scheme_facts(spans)[0].withColumn("sheets", F.array_join(F.transform("sheets", lambda x: x.cast("string")), ","))


def facts(spans: DataFrame) -> DataFrame:
    return R.scheme_facts(spans)[1].withColumn("articles", F.array_join("articles", ","))


def merged(spans: DataFrame) -> DataFrame:
    own = tags(spans).join(spans.select("document", "bundle").distinct(), "document")
    return R.merge_documents(own, own.select("document", (F.regexp_extract("document", r"\d+", 0).cast("int") % 7).alias("rank")).distinct())


QUERIES = {
    "x1_explode_positions": over(lambda d: R.explode_positions(d.select(F.concat(F.lit("B"), F.col("k") % 9).alias("bundle"), F.col("id").alias("row_no"), F.col("cell").alias("position"))), "position_cells"),
    "x2_scheme_tags": over(tags, "sheet_texts"),
    "x2_scheme_texts": over(facts, "sheet_texts"),
    "x3_merge_by_rank": over(merged, "sheet_texts"),
    "x5_designation_mismatch": over(R.designation_mismatch, "designations"),
    "x6_ordered_not_drawn": over(not_drawn, O, D, M),
    "x7_article_not_in_spec": over(R.article_not_in_spec, O, D),
    "x8_designator_not_in_spec": over(R.designator_not_in_spec, O, D, M),
    "x9_article_mismatch": over(R.article_mismatch, O, D, M),
    "x10_characteristic_mismatch": over(R.characteristic_mismatch, O, D),
    "x11_check_bundle": over(checked, O, D, M, "designations"),
    "x12_netlist_vs_scheme": over(terminals, "connections", M),
    "x13_instrument_links": over(instruments, "connections", M),
}
fd, f = S.fold_designator, S.fold
BLOCK = f"""mass_labels as (select bundle, article from drawn_labels where pair_source = 'block' and article <> '' group by bundle, article having count(distinct {fd('designator')}) >= 25),
 block as (select d.*, {fd('designator')} as fd, {f('designator')} as f from drawn_labels d where pair_source = 'block' and article <> '' and (bundle, article) not in (select (bundle, article) from mass_labels) and not regexp_matches({f('article')}, {S.VOLTAGE}))"""
WORDS = lambda *xs: f"list_distinct(list_concat({S.article_tokens(*xs)}, list_filter([{f('code')}, {f('type_mark')}], lambda t: t <> '')))"
CHARACTERISTIC = "list_transform(regexp_extract_all({x}, '(?i)(?:^|[^\\w,.])(\\d{{1,4}}(?:[.,]\\d{{1,3}})?\\s*k?V)\\s*(?:AC/DC|DC/AC|AC|DC)?(?:$|[^\\w])', 1), lambda t: round(replace(regexp_extract(t, '^[0-9.,]+'), ',', '.')::double * case when t ilike '%k%' then 1000 else 1 end, 4))"
PARTS = {
    "x5": """first as (select bundle, doc_type, arg_min(designation, ord) as designation, arg_min(project_wide, ord) as wide from designations group by bundle, doc_type),
 seen as (select bundle, doc_type, case doc_type when 'spec' then 1 when 'assembly' then 2 else 3 end as rank, nullif(regexp_extract(designation, '^\\s*(\\d{2,3}(\\.\\d{2,4})+)', 1), '') as number from first where not (doc_type = 'spec' and wide)),
 per as (select bundle, number, count(*) as n, min(rank) as rank from seen where number is not null group by bundle, number),
 best as (select bundle, arg_max(number, n * 10 - rank) as majority from per group by bundle having count(*) > 1),
 x5 as (select b.bundle, majority, string_agg(doc_type, ',' order by s.rank) as odd, 'high' as severity from best b join seen s on s.bundle = b.bundle and s.number <> majority group by b.bundle, majority)""",
    "x6": f"""own as (select bundle, {f('designator')} as key, arg_min(document, row_no) as document, min(row_no) as row_no from order_rows group by 1, 2),
 x6 as (select o.bundle, o.key, document, row_no, case when t.key is null then 'medium' else 'low' end as severity from own o left join (select distinct bundle, {fd('designator')} as key from scheme_marks) t on t.bundle = o.bundle and t.key = o.key
 where not exists (select 1 from drawn_labels d where d.bundle = o.bundle and {f('d.designator')} = o.key))""",
    "x7": f"""{BLOCK}, vocabulary as (select bundle, unnest({WORDS('code', 'type_mark', 'name', 'note')}) as token from order_rows),
 per as (select b.bundle, article, count(distinct designator) as designators, min(sheet) as sheet, count(*) as n, bool_and(exists (select 1 from order_rows o where o.bundle = b.bundle and {fd('o.designator')} = b.fd)) as all_ordered from block b group by b.bundle, article),
 x7 as (select bundle, article, designators, sheet, n, 'high' as severity from per p where not all_ordered and regexp_matches({f('article')}, '[0-9]') and not regexp_matches({f('article')}, {S.IEC}) and bundle in (select bundle from order_rows)
 and not exists (select 1 from vocabulary v where v.bundle = p.bundle and list_contains(list_concat({S.article_tokens('p.article')}, [{f('p.article')}]), v.token)))""",
    "x8": f"""ordered as (select distinct bundle, {fd('designator')} as key from order_rows), listed as (select bundle, list(key) as keys from ordered group by bundle), tags as (select bundle, {fd('designator')} as key, min(sheet) as scheme_sheet from scheme_marks group by 1, 2),
 own as (select d.bundle, designator, t.key, scheme_sheet, min(d.sheet) as sheet from drawn_labels d join tags t on t.bundle = d.bundle and t.key = {fd('designator')} group by all),
 share as (select bundle, count(*) filter (key in (select key from ordered r where r.bundle = o.bundle)) < 0.05 * count(*) as foreign_ from (select distinct bundle, key from own) o group by bundle),
 gate as (select s.bundle from share s join (select bundle, bool_or(project_wide) as wide from order_rows group by bundle) w on w.bundle = s.bundle where not (wide and foreign_)),
 names as (select bundle, unnest({S.text_tokens('name')}) as key from order_rows),
 open_ as (select o.* from own o join listed l on l.bundle = o.bundle where o.bundle in (select bundle from gate) and not exists (select 1 from ordered r where r.bundle = o.bundle and r.key = o.key) and regexp_matches(o.key, '[0-9]$') and not regexp_matches(o.key, {S.IEC}) and not regexp_matches(o.key, {S.CHANNEL})
 and not (contains(o.key, '-') and len(list_filter(list_filter(string_split(o.key, '-'), lambda p: p <> ''), lambda p: not list_contains(l.keys, p))) = 0)),
 x8 as (select bundle, designator, sheet, scheme_sheet, case when named then 'REVIEW' else 'MISSING' end as kind, case when named then 'low' else 'high' end as severity from (select *, exists (select 1 from names n where n.bundle = o.bundle and n.key = o.key) as named from open_ o))""",
    "x9": f"""{BLOCK}, a as (select bundle, f, arg_min(designator, ord) as designator, arg_min(article, ord) as article, arg_min(sheet, ord) as sheet from block group by bundle, f having count(distinct article) = 1),
 own as (select *, case when len({S.article_tokens('article')}) > 0 then {S.article_tokens('article')} else [{f('article')}] end as mine from a),
 rows_ as (select bundle, {f('designator')} as f, flatten(list({WORDS('code', 'type_mark', 'name')})) as tokens, min(row_no) filter (coalesce(code, '') <> '' or coalesce(type_mark, '') <> '') as row_no from order_rows group by 1, 2),
 both_ as (select o.*, r.row_no, s.code, s.type_mark, s.note, {f('o.article')} in (select {f('m.article')} from scheme_marks m where m.bundle = o.bundle) as on_scheme from own o join rows_ r on r.bundle = o.bundle and r.f = o.f join order_rows s on s.bundle = r.bundle and s.row_no = r.row_no and {f('s.designator')} = r.f
 where not list_has_any(mine, tokens) and not list_contains(tokens, {f('o.article')})),
 x9 as (select bundle, designator, article, sheet, row_no, coalesce(code, type_mark) as ordered, case when noted then 'REVIEW' else 'MISMATCH' end as kind, case when noted then 'low' when on_scheme then 'high' else 'medium' end as severity from (select *, list_has_any({S.article_tokens('note')}, mine) as noted from both_))""",
    "x10": f"""long as (select bundle, {f('designator')} as key, {fd('designator')} as fd, unnest([article, label_text]) as text from drawn_labels where pair_source = 'block'),
 mass as (select bundle, text from long where text <> '' group by 1, 2 having count(distinct fd) >= 25),
 there as (select distinct bundle, key, unnest({CHARACTERISTIC.format(x='text')}) as value from long where (bundle, text) not in (select (bundle, text) from mass)),
 here as (select bundle, {f('designator')} as key, min(row_no) as row_no, arg_min(concat(name, ' ; ', code), row_no) as text from order_rows where not project_wide group by 1, 2),
 lists as (select bundle, key, row_no, list_sort(list_distinct({CHARACTERISTIC.format(x='text')})) as a from here),
 theirs as (select bundle, key, list_sort(list(value)) as b from there group by 1, 2),
 x10 as (select l.bundle, l.key, 'voltage' as quantity, row_no, array_to_string(list_transform(a, lambda v: v::decimal(20, 4)::varchar), '|') as ordered, array_to_string(list_transform(b, lambda v: v::decimal(20, 4)::varchar), '|') as drawn, 'high' as severity
 from lists l join theirs t on t.bundle = l.bundle and t.key = l.key where len(a) > 0 and len(b) > 0 and not list_has_any(a, b))""",
}
#: In one statement the shared names of the parts are kept apart.
APART = {"x6": ["own"], "x7": ["per", "mass_labels", "block"], "x8": ["own", "ordered", "listed", "gate", "share", "tags", "names", "open_"], "x9": ["own", "mass_labels", "block"], "x5": ["per", "best"], "x10": []}


def part(x: str, apart: bool = False) -> str:
    import re

    sql = PARTS[x]
    for name in APART[x] if apart else []:
        sql = re.sub(rf"(?<![\w.'])({name})(?= as (?:materialized )?\()", rf"{x}_\1", sql)
        sql = re.sub(rf"(from|join) {name}\b", rf"\1 {x}_{name}", sql)
    return sql


SQL = {q: f"with {part(x)} select * from {x}" for x in PARTS for q in QUERIES if q.startswith(x + "_")}
TAGS = f"""tags as (select document, {fd('trim(text)')} as key, (array_agg(trim(text) order by sheet, ord, trim(text)))[1] as text, array_to_string(list_sort(list_distinct(list(sheet)))::varchar[], ',') as sheets from sheet_texts where entity_type in ('device_tag', 'instrument_tag') group by 1, 2)"""
SQL["x1_explode_positions"] = f"""with e as (select concat('B', k % 9) as bundle, id as row_no, unnest(case form when 0 then list_transform(range(k + 1, k + 5), lambda i: concat('K', i)) when 1 then list_distinct([concat('XT', k), concat('XT', k + 1)]) when 2 then list_transform(range(1, 5), lambda i: concat(i, 'KL', k))
 when 3 then [concat('K', k, '-K', k + 1)] when 4 then [concat('A', k), concat('B', k + 3)] else [] end) as designator from position_cells) select bundle, designator as key, row_no, designator from e"""
SQL["x2_scheme_tags"] = f"with {TAGS} select * from tags"
SQL["x2_scheme_texts"] = f"""with t as (select document, unnest({S.text_tokens('trim(text)')}) as token from sheet_texts), n as (select document, count(distinct token) as tokens from t group by document)
 select s.document, array_to_string(list_sort(list_distinct(list(trim(text)) filter (entity_type = 'module_partno'))), ',') as articles, (array_agg(trim(text) order by sheet, ord, trim(text)) filter (entity_type = 'doc_number'))[1] as designation, any_value(tokens) as tokens from sheet_texts s join n on n.document = s.document group by s.document"""
SQL["x3_merge_by_rank"] = f"with {TAGS}, b as (select distinct document, bundle from sheet_texts) select b.bundle, t.* from tags t join b on b.document = t.document qualify row_number() over (partition by b.bundle, key order by regexp_extract(t.document, '[0-9]+')::int % 7, t.document) = 1"
SQL["x11_check_bundle"] = (
    "with " + ", ".join(part(x, True) for x in PARTS if x != "x6") + ", " + part("x6", True).replace("from order_rows group", "from order_rows where not project_wide group")
    + """, every as (select bundle, 'designation' as rule, 'MISMATCH' as kind, severity, majority as place from x5 union all select bundle, 'article', kind, severity, designator from x9 union all select bundle, 'characteristic', 'MISMATCH', severity, key from x10
 union all select bundle, 'not ordered', 'MISSING', severity, article from x7 union all select bundle, 'not in spec', kind, severity, designator from x8 union all select bundle, 'not drawn', 'REVIEW', severity, key from x6)
 select bundle, rule, kind, severity, count(*) as n, min(place) as place from every group by all"""
)
SQL["x12_netlist_vs_scheme"] = f"""with s as (select bundle, 'terminal' as what, concat({fd('terminal_block')}, ':', upper(pin)) as place, document, true as listed from connections where terminal_block <> '' and pin <> ''
 union all select bundle, 'terminal', concat('XT', sheet, ':', regexp_extract(designator, '\\d+')), document, false from scheme_marks where regexp_extract(designator, '\\d+') <> '' union all select bundle, 'marking', {S.fold('circuit_marking')}, document, true from connections where circuit_marking <> ''
 union all select bundle, 'marking', regexp_extract(designator, '\\d+'), document, false from scheme_marks where regexp_extract(designator, '\\d+') <> '')
 select bundle, what, place, case when bool_or(listed) then 'table' else 'scheme' end as only_in, min(document) as document, 'REVIEW' as kind from s group by bundle, what, place having count(distinct listed) = 1"""
SQL["x13_instrument_links"] = f"""with s as (select bundle, document, {fd("concat('XT', regexp_extract(designator, '[0-9]+'))")} as tag, true as drawn from scheme_marks union all select bundle, document, {fd('terminal_block')}, false from connections where terminal_block <> '')
 select bundle, tag, case when bool_or(drawn) then 'diagram' else 'journal' end as only_in, min(document) as document, 'REVIEW' as kind from s group by bundle, tag having count(distinct drawn) = 1"""
