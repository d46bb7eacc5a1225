"""Queries over files and albums."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import ALBUM_TITLES
from ..functions.text import NOT_CABINETS
from ..operators import album as A
from ..operators import bundles
from ..operators import files as D
from .common import over


def named(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def typed(files: DataFrame) -> DataFrame:
    """Types of files; some paths and some names are given one."""
    d = named(files)
    given = d.filter("id % 20 = 0").select(F.col("path").alias("key"), F.lit("netlist").alias("doc_type")).unionByName(d.filter("id % 20 = 1").select(F.col("name").alias("key"), F.lit("spec").alias("doc_type")))
    return D.resolve_doc_type(d, given)


def quality(extracts: DataFrame) -> DataFrame:
    return D.extraction_quality(extracts).select("id", F.array_join("warnings", ",").alias("warnings"), "status")


def counted(extracts: DataFrame, files: DataFrame) -> DataFrame:
    docs = D.extraction_quality(extracts)
    groups = bundles.bundle_summary(docs.select((F.col("id") % 40).cast("string").alias("bundle"), F.col("id").alias("document"), "doc_type"))
    return D.manifest(docs, groups, D.route_skips(typed(files)).filter("skip_reason is not null"))


def parts(sheets: DataFrame) -> DataFrame:
    return A.split_parts(sheets)


def complete(sheets: DataFrame) -> DataFrame:
    return A.unique_part_names(A.inherit_cabinet(parts(sheets)))


def albums(files: DataFrame) -> DataFrame:
    d = named(files).withColumn("pages", F.col("pages") * 3)
    return A.is_album(d, d.filter("id % 10 = 3").select("name")).select("id")


def votes(files: DataFrame) -> DataFrame:
    d = named(files).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return A.vote_cabinet(d.withColumn("name", F.concat(F.lit("Схема ЩС"), (F.col("id") % 3).cast("string"), F.lit(" Э3_"), (F.col("id") % 7).cast("string"), F.lit(".pdf"))))


S = "album_sheets"
QUERIES = {
    "cls1_doc_type": over(lambda d: named(d).select("id", D.doc_type_of(F.col("name")).alias("doc_type")), "file_names"),
    "cls2_resolve_doc_type": over(lambda d: typed(d).select("id", "doc_type"), "file_names"),
    "cls3_route_skips": over(lambda d: D.route_skips(typed(d)).select("id", "doc_type", "skip_reason"), "file_names"),
    "cls4_document_name": over(lambda d: named(d).select("id", D.document_name(F.col("name")).alias("document")), "file_names"),
    "cls7_extraction_quality": over(quality, "extracts"),
    "snk2_manifest": over(counted, "extracts", "file_names"),
    "alb2_strip_boilerplate": over(A.strip_boilerplate, "title_lines"),
    "alb3_split_parts": over(parts, S),
    "alb4_classify_parts": over(lambda d: A.classified(parts(d)).select("album", "part", "doc_type", "reason"), S),
    "alb5_cabinet_aliases": over(lambda d: A.cabinet_aliases(parts(d)), S),
    "alb6_inherit_cabinet": over(lambda d: A.inherit_cabinet(parts(d)).select("album", "part", "doc_type", "cabinet"), S),
    "alb7_unique_part_names": over(lambda d: complete(d).select("album", "part", "name"), S),
    "alb8_is_album": over(albums, "file_names"),
    "alb9_split_report": over(lambda d: A.split_report(parts(d)), S),
    "alb10_vote_cabinet": over(votes, "file_names"),
    "snk3_parts_index": over(lambda d: A.parts_index(complete(d)), S),
}
NAMED = "named as (select *, string_split(path, '/')[-1] as name, regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1') as stem, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) as suffix from file_names)"
CASE = lambda x, table: f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"
TYPED = f"""{NAMED}, marked as (select *, lower(trim(regexp_extract(name, '^\\s*\\(([^)]+)\\)', 1))) as marker,
 upper(regexp_extract_all(regexp_replace(stem, '([\\s_.])', '\\1\\1', 'g'), '(?i)(?:^|[\\s_])({"|".join(D.KIND_MARKS)})(?:[\\s_.]|$)', 1)[-1]) as mark from named),
 kinds as (select *, case when marker <> '' then {CASE('marker', D.TYPE_ALIASES)} else {CASE('mark', D.KIND_MARKS)} end as own from marked),
 resolved as (select *, case when id % 20 = 0 then 'netlist' when exists (select 1 from named n where n.name = kinds.name and n.id % 20 = 1) then 'spec' else own end as given from kinds),
 routed as (select *, case when suffix not in ('.pdf', '.xlsx', '.xlsm') then 'suffix' when given is null then 'type unknown' when given <> 'spec' and suffix <> '.pdf' then 'suffix of the type' end as skip_reason from resolved where not starts_with(name, '~$') and not starts_with(name, '.'))"""
WARN = """warned as (select *, list_filter([case when doc_type = 'scheme' and nodes = 0 then 'no nodes' end, case when doc_type = 'scheme' and nodes > 0 and pages > 0 and nodes < 20 * pages then 'few nodes' end, case when doc_type = 'scheme' and nets = 0 then 'no nets' end,
 case when doc_type = 'scheme' and nets > 0 and terminals = 0 then 'no terminals' end, case when doc_type = 'scheme' and nets >= 20 and terminals > 0 and terminals < 3 then 'few terminals' end, case when doc_type = 'scheme' and nets > 5 and markings = 0 then 'no markings' end,
 case when doc_type = 'netlist' and connections = 0 then 'no connections' end, case when doc_type = 'spec' and "rows" = 0 then 'no rows' end, case when doc_type = 'spec' and "rows" > 0 and designators = 0 then 'no designators' end, case when doc_type = 'spec' and not has_number then 'no designation' end,
 case when doc_type = 'functional' and instruments = 0 then 'no instruments' end, case when doc_type = 'assembly' and elements = 0 then 'no elements' end, case when doc_type = 'assembly' and elements > 0 and paired = 0 then 'no pairs' end, case when doc_type = 'assembly' and not has_number then 'no designation' end], lambda x: x is not null) as w,
 case when n_files = 0 then 'failed' when n_errors > 0 or case doc_type when 'scheme' then nodes = 0 and nets = 0 when 'netlist' then connections = 0 when 'spec' then "rows" = 0 when 'assembly' then elements = 0 else instruments = 0 end then 'partial' else 'ok' end as status from extracts)"""
NORM = lambda x: f"translate(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'ё', 'е')"
PARTS = f"""named as (select *, nullif(title, '') as named, row_number() over (partition by album order by sheet) as pos from album_sheets),
 filled as (select *, last_value({NORM('named')} ignore nulls) over (partition by album order by sheet) as name from named),
 flagged as (select *, case when lag(name) over (partition by album order by sheet) = name then 0 else 1 end as new_ from filled where name is not null),
 numbered as (select *, sum(new_) over (partition by album order by sheet)::bigint as part from flagged),
 parts as (select album, part, arg_min(named, pos) as title, any_value(name) as name, min(pos) as first_page, max(pos) as last_page, count(*) as pages from numbered group by album, part)"""
TYPES = dict(zip((t.lower().replace("ё", "е") for t in ALBUM_TITLES), ("scheme", "assembly", "spec", "netlist", None, "assembly", "scheme", "functional", "spec", None, None, "assembly"), strict=True))
CABINETS = dict(zip((t.lower().replace("ё", "е") for t in ALBUM_TITLES), ("ЩС2", "ЩС1", None, None, None, None, "ШУ1", None, "ЩС2", None, None, "ЩА"), strict=True))
KNOWN = lambda table: "case name " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items() if v) + " end"
# In capitals every word of a title looks like a cabinet; the last one up to seven letters that is no stop word counts.
LOUD = f"""list_filter(regexp_extract_all(regexp_replace(title, '[^А-ЯЁA-Zа-яёa-z0-9_-]', '  ', 'g'), '(?:^|[^А-ЯЁA-Zа-яёa-z0-9_-])([А-ЯЁA-Z]{{2,7}}[0-9]{{0,2}})(?:$|[^А-ЯЁA-Zа-яёa-z0-9_-])', 1), lambda w: w not in ({', '.join(f"'{w}'" for w in NOT_CABINETS)}))[-1]"""
TYPES_OF = f"""typed as (select *, {KNOWN(TYPES)} as doc_type, case when name like 'план%' or name like 'пояснит%' then 'skipped' when name like 'чертеж%' then 'unknown' else 'matched' end as reason,
 coalesce(nullif(regexp_extract(title, '\\(([А-ЯЁ]{{2,7}}[0-9]{{0,2}})\\)', 1), ''), {LOUD}) as own, regexp_extract(title, '\\b(OS00[0-9])\\b', 1) as code from parts)"""
ALIASES = """uses as (select album, code, own, count(*) as n, min(part) as seen from typed where own is not null and code <> '' group by all),
 best as (select album, code, arg_max(own, n * 1000000 - seen) as canonical from uses group by album, code having count(*) > 1),
 aliases as (select u.album, u.own as name, arg_max(canonical, u.code) as canonical from uses u join best b on b.album = u.album and b.code = u.code where u.own <> canonical group by u.album, u.own)"""
CARRIED = """owned as (select t.*, coalesce(a.canonical, t.own) as cab from typed t left join aliases a on a.album = t.album and a.name = t.own where doc_type is not null),
 carried as (select *, coalesce(cab, case when doc_type = 'assembly' then last_value(cab ignore nulls) over (partition by album order by part rows between unbounded preceding and 1 preceding) end, 'общие документы') as cabinet from owned)"""
UNIQUE = """plain as (select *, concat('(', doc_type, ')', trim(trim(regexp_replace(title, '\\s+', ' ', 'g'), ' .')[1:90])) as plain from carried),
 again as (select *, row_number() over (partition by album, cabinet, lower(plain) order by part) as again from plain), uniq as (select *, case when again > 1 then concat(plain, ' #', again) else plain end as unique_name from again)"""
SQL = {
    "cls1_doc_type": f"with {TYPED} select id, own as doc_type from resolved",
    "cls2_resolve_doc_type": f"with {TYPED} select id, given as doc_type from resolved",
    "cls3_route_skips": f"with {TYPED} select id, case when skip_reason is null then given end as doc_type, skip_reason from routed",
    "cls4_document_name": f"with {NAMED}, p as (select id, stem, regexp_replace(trim(regexp_replace(stem, '^\\s*\\(\\s*[^)]+?\\s*\\)', '')), '[<>:\"/\\\\|?*]', '_', 'g') as d from named) select id, case when d = '' then stem else d end as document from p",
    "cls7_extraction_quality": f"with {WARN} select id, array_to_string(w, ',') as warnings, status from warned",
    "snk2_manifest": f"""with {TYPED}, {WARN}, b as (select id % 40 as bundle, count(distinct doc_type) filter (doc_type in ('scheme', 'assembly', 'spec')) >= 2 as ok from extracts group by 1)
 select count(*) as documents, count(*) filter (status in ('ok', 'partial')) as extracted, count(*) filter (status = 'failed') as failed, (select count(*) from routed where skip_reason is not null) as skipped, (select count(*) from b) as bundles, (select count(*) from b where ok) as checkable from warned""",
    "alb2_strip_boilerplate": f"""with r as (select *, {NORM('text')} as norm from title_lines), f as (select album, count(distinct sheet) as filled from r where norm <> '' group by album),
 o as (select r.album, norm from r join f on f.album = r.album where norm <> '' group by r.album, norm, filled having count(distinct sheet) >= 0.5 * filled)
 select album, sheet, coalesce(trim(regexp_replace(string_agg(text, ' ' order by line) filter (norm <> '' and (album, norm) not in (select (album, norm) from o)), '\\s+', ' ', 'g')), '') as title from r group by album, sheet""",
    "alb3_split_parts": f"with {PARTS} select album, part, title, first_page, last_page, pages from parts",
    "alb4_classify_parts": f"with {PARTS}, {TYPES_OF} select album, part, doc_type, reason from typed",
    "alb5_cabinet_aliases": f"with {PARTS}, {TYPES_OF}, {ALIASES} select * from aliases",
    "alb6_inherit_cabinet": f"with {PARTS}, {TYPES_OF}, {ALIASES}, {CARRIED} select album, part, doc_type, cabinet from carried",
    "alb7_unique_part_names": f"with {PARTS}, {TYPES_OF}, {ALIASES}, {CARRIED}, {UNIQUE} select album, part, unique_name as name from uniq",
    "alb8_is_album": f"with {NAMED} select id from named n where suffix = '.pdf' and pages * 3 >= 80 and name not in (select name from named where id % 10 = 3)",
    "alb9_split_report": f"with {PARTS}, {TYPES_OF} select album, reason, count(*) as parts, sum(pages)::bigint as pages from typed group by album, reason",
    "alb10_vote_cabinet": "with v as (select string_split(path, '/')[-2] as folder, concat('ЩС', id % 3) as cabinet, count(*) as n from file_names group by all) select folder, cabinet, n from v qualify row_number() over (partition by folder order by n desc, cabinet) = 1",
    "snk3_parts_index": f"with {PARTS}, {TYPES_OF}, {ALIASES}, {CARRIED}, {UNIQUE} select concat(cabinet, '/', unique_name, '.pdf') as path, album, first_page, last_page from uniq",
}
