"""Queries over findings and reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report as R
from .common import over


def found(rows: DataFrame) -> DataFrame:
    c = F.col
    one = R.make_ref(document=c("document"), doc_type=c("doc_type"), sheet=c("sheet"), row=c("row_no"), terminal_block=c("terminal_block"), pin=c("pin"), kks=c("kks"))
    two = R.make_ref(document=c("document2"), doc_type=F.lit("spec"), designator=c("designator"), article=c("article"), sheet=c("sheet"))
    refs = F.when(c("document2").isNull(), F.array(one)).otherwise(F.array(one, two))
    return rows.select("finding_id", "bundle", "origin", "kind", "severity", "type", "scope", refs.alias("refs"), "finding", "action")


def by(origin: str, rows: DataFrame) -> DataFrame:
    return found(rows.filter(F.col("origin") == origin))


def known(rows: DataFrame) -> DataFrame:
    """Records that cover a document's sheet, a terminal whatever the document, a pair of places, an article of a kind, and nothing."""
    spark = rows.sparkSession
    fields = ", ".join(f"{f} {k}" for f, k in R.REF_FIELDS.items())
    ref = lambda **x: tuple(x.get(f) for f in R.REF_FIELDS)
    records = [
        (1, "DUPLICATE", None, "", [ref(document="NL-1", sheet=3)]), (2, None, "address", None, [ref(terminal_block="XT4", pin="2")]),
        (3, "MISSING", None, "cross_document", [ref(document="NL-2"), ref(document="SO-2", designator="K7")]), (4, None, None, None, []), (5, "REVIEW", None, None, [ref(article="no such")]),
        (6, "MISMATCH", None, None, [ref(doc_type="spec", article="ART-8")]), (7, None, None, None, [ref(row=4, sheet=8, doc_type="netlist")]), (8, None, None, None, [ref(row=4, sheet=8, doc_type="netlist")]),
    ]
    return spark.createDataFrame(records, f"known_id int, kind string, type string, scope string, refs array<struct<{fields}>>")


def merged(rows: DataFrame) -> DataFrame:
    every = found(rows.filter("kind <> 'OTHER' and severity <> 'urgent'"))
    out = R.merge_reports(every.filter("origin = 'rule'"), every.filter("origin = 'agent'"))
    return out.select("bundle", "place", "kind", "severity", "disputed", F.size("refs").alias("places"))


def targets(rows: DataFrame) -> DataFrame:
    return R.fragment_targets(found(rows))


def located(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Targets of findings in schemes, looked for among the marks of drawings named like them."""
    spans = marks.select(F.concat(F.lit("NL-"), F.regexp_extract("document", r"\d+", 0)).alias("document"), F.col("sheet").cast("int"), F.concat(F.lit("XT"), "text", F.lit(" of "), F.lit("00USE1"), F.col("comp") % 9).alias("text"))
    return R.locate(targets(rows), spans)


def statuses(rows: DataFrame) -> DataFrame:
    docs = rows.groupBy("document", "doc_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "OTHER").alias("bad"))
    docs = docs.select("document", F.when(F.col("doc_type") == "scheme", "ok").when(F.col("bad") > 0, "partial").otherwise("failed").alias("status"), F.when(F.col("bad") > 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return R.extraction_report(docs, rows.select("bundle").distinct())


def joined(c: str):
    return F.array_join(c, ",").alias(c)


FR = "finding_rows"
QUERIES = {
    "rep1_make_findings": over(lambda d: found(d).select("finding_id", F.size("refs").alias("places"), F.get("refs", F.lit(0))["sheet"].alias("sheet"), F.get("refs", F.lit(1))["article"].alias("article"), F.get("refs", F.lit(0))["quantity"].alias("quantity")), FR),
    "rep2_signature": over(lambda d: found(d).select("finding_id", R.signature().alias("signature")), FR),
    "rep3_combine": over(lambda d: R.combine(by("rule", d), by("agent", d)).select("finding_id", "signature"), FR),
    "rep4_suppress_known": over(lambda d: R.suppress_known(found(d), known(d)).select("finding_id"), FR),
    "rep5_unused_known": over(lambda d: R.unused_known(found(d), known(d)).select("known_id"), FR),
    "rep6_merge_reports": over(merged, FR),
    "rep7_validate": over(lambda d: R.validate(found(d)).select("finding_id", joined("errors")), FR),
    "rep9_report_totals": over(lambda d: R.report_totals(found(d)), FR),
    "rep10_bundle_table": over(lambda d: R.bundle_table(found(d)), FR),
    "rep11_wiring_table": over(lambda d: R.wiring_table(found(d)), FR),
    "rep12_fragment_targets": over(lambda d: targets(d).select("finding_id", "pos", "document", "doc_type", "sheet", joined("keys")), FR),
    "rep13_locate": over(located, FR, "marks"),
    "rep14_baseline_diff": over(lambda d: R.baseline_diff(found(d.filter("row_no % 4 <> 0")), found(d.filter("row_no % 3 <> 0"))), FR),
    "rep15_extraction_report": over(statuses, FR),
}
SHOW = lambda *fs: " || '|' || ".join(f"case when {f} is null then '' else '=' || {f} end" for f in fs)
ONE, TWO = SHOW("document", "terminal_block", "pin", "kks", "null::varchar", "null::varchar"), SHOW("document2", "null::varchar", "null::varchar", "null::varchar", "designator", "article")
SIGN = f"kind || ';' || array_to_string(list_sort(list_distinct(case when document2 is null then [{ONE}] else [{ONE}, {TWO}] end)), ';')"
PLACE = SIGN.replace("kind || ';' || ", "", 1)
HITS = """hits as (select finding_id, 1 as known_id from finding_rows where kind = 'DUPLICATE' and document = 'NL-1' and sheet = 3 union all select finding_id, 2 from finding_rows where type = 'address' and terminal_block = 'XT4' and pin = '2'
 union all select finding_id, 3 from finding_rows where kind = 'MISSING' and scope = 'cross_document' and document = 'NL-2' and document2 = 'SO-2' and designator = 'K7' union all select finding_id, 6 from finding_rows where kind = 'MISMATCH' and document2 is not null and article = 'ART-8'
 union all select finding_id, unnest([7, 8]) from finding_rows where doc_type = 'netlist' and row_no = 4 and sheet = 8)"""
RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 9 end"
FULL = "(2 + 2 + (terminal_block is not null)::int + (pin is not null)::int + (kks is not null)::int + case when document2 is null then 0 else 4 + (article is not null)::int end)"
VALUE = lambda t, cond, fields: ", ".join(f"case when {cond} then {f}::varchar end as {t}_{n}" if f else f"null::varchar as {t}_{n}" for n, f in fields.items())
DIFF = " || ';' || ".join(["kind", "severity", "type", SHOW("document", "doc_type", "sheet", "row_no", "terminal_block", "pin", "kks", "null::varchar", "null::varchar")]) + " || case when document2 is null then '' else ';' || " + SHOW("document2", "'spec'", "sheet", "null::varchar", "null::varchar", "null::varchar", "null::varchar", "designator", "article") + " end"
TARGETS = """targets as (select finding_id, 0 as pos, document, doc_type, sheet::int as sheet, list_filter([kks, terminal_block], lambda x: x is not null) as keys from finding_rows where kks is not null or terminal_block is not null
 qualify row_number() over (partition by finding_id, document, sheet, coalesce(kks, terminal_block) order by keys, doc_type) = 1)"""
SQL = {
    "rep1_make_findings": "select finding_id, case when document2 is null then 1 else 2 end as places, sheet, case when document2 is not null then article end as article, null as quantity from finding_rows",
    "rep2_signature": f"select finding_id, {SIGN} as signature from finding_rows",
    "rep3_combine": f"with s as (select finding_id, origin, {SIGN} as signature from finding_rows) select finding_id, signature from s where origin = 'rule' or signature not in (select signature from s where origin = 'rule')",
    "rep4_suppress_known": f"with {HITS} select finding_id from finding_rows where finding_id not in (select finding_id from hits)",
    "rep5_unused_known": f"with {HITS} select known_id from (values (1), (2), (3), (4), (5), (6), (7), (8)) k(known_id) where known_id not in (select min(known_id) from hits group by finding_id)",
    "rep6_merge_reports": f"""with f as (select *, {PLACE} as place, {FULL} as full_, {RANK} as rank, case when document2 is null then 1 else 2 end as places from finding_rows where kind <> 'OTHER' and severity <> 'urgent'),
 side as (select bundle, place, origin, unnest(list(struct_pack(kind := kind, rank := rank, full_ := full_, places := places) order by full_ desc, length(finding) desc, finding_id desc)[1:1]) as s from f group by bundle, place, origin),
 both_ as (select coalesce(a.bundle, b.bundle) as bundle, coalesce(a.place, b.place) as place, a.s as a, b.s as b from (select * from side where origin = 'rule') a full join (select * from side where origin = 'agent') b on a.bundle = b.bundle and a.place = b.place),
 d as (select *, coalesce(a.kind <> b.kind or a.rank <> b.rank, false) as disputed, coalesce(b.full_ > a.full_, a is null) as b_leads from both_)
 select bundle, place, case when b_leads then b.kind else a.kind end as kind, (['critical', 'high', 'medium', 'low', 'info'])[least(least(coalesce(a.rank, 9), coalesce(b.rank, 9)) + disputed::int, 4) + 1] as severity, disputed, case when b_leads then b.places else a.places end as places from d""",
    "rep7_validate": "select finding_id, array_to_string(list_filter([case when kind = 'OTHER' then 'kind' end, case when severity = 'urgent' then 'severity' end, case when action is null then 'action' end], lambda x: x is not null), ',') as errors from finding_rows",
    "rep9_report_totals": f"select 'kind' as \"by\", kind as value, count(*) as n, row_number() over (order by count(*) desc, kind) - 1 as at from finding_rows group by kind union all select 'severity', severity, count(*), {RANK} from finding_rows group by severity",
    "rep10_bundle_table": f"""select finding_id, kind, severity, {VALUE('spec', 'true', {'sheet': 'sheet', 'row': None, 'designator': 'designator', 'article': 'article'})}, {VALUE('assembly', 'false', dict.fromkeys(('sheet', 'row', 'designator', 'article')))},
 {VALUE('scheme', "doc_type = 'scheme'", {'sheet': 'sheet', 'row': 'row_no', 'designator': None, 'article': None})} from finding_rows where document2 is not null""",
    "rep11_wiring_table": "select finding_id, kind, severity, " + ", ".join(VALUE(t, f"doc_type = '{t}'", {"sheet": "sheet", "row": "row_no", "cabinet": None, "terminal_block": "terminal_block", "pin": "pin", "marking": None, "kks": "kks", "conductor": None}) for t in ("netlist", "scheme")) + " from finding_rows where document2 is null",
    "rep12_fragment_targets": f"with {TARGETS} select finding_id, pos, document, doc_type, sheet, array_to_string(keys, ',') as keys from targets",
    "rep13_locate": f"""with {TARGETS}, spans as (select concat('NL-', regexp_extract(document, '\\d+')) as document, sheet, concat('XT', text, ' of 00USE1', comp % 9) as text from marks),
 keys as (select finding_id, pos, document, sheet as named, unnest(keys) as key, generate_subscripts(keys, 1) - 1 as rank from targets), wanted as (select distinct document, key from keys),
 hits as (select s.document, s.sheet, w.key, count(*) as hits from spans s join wanted w on w.document = s.document and contains(s.text, w.key) group by all),
 ordered as (select k.finding_id, k.pos, h.sheet, k.key, h.hits, coalesce(h.sheet <> k.named, true) as fallback, row_number() over (partition by k.finding_id, k.pos order by h.sheet <> coalesce(k.named, -1), h.sheet, h.hits > 12, case when h.hits > 12 then h.hits else k.rank end, k.rank, k.key) as best
 from keys k join hits h on h.document = k.document and h.key = k.key) select finding_id, pos, sheet, key, hits, fallback from ordered where best = 1""",
    "rep14_baseline_diff": f"with a as (select {DIFF} as identity, count(*) filter (row_no % 4 <> 0) - count(*) filter (row_no % 3 <> 0) as more from finding_rows group by 1) select identity, abs(more) as n, case when more > 0 then 'appeared' else 'vanished' end as change from a where more <> 0",
    "rep15_extraction_report": """with d as (select document, doc_type, count(*) filter (kind = 'OTHER') as bad from finding_rows group by all) select case when doc_type = 'scheme' then 'ok' when bad > 0 then 'partial' else 'failed' end as status, count(*) as n, sum(case when bad > 0 then 2 else 0 end)::bigint as errors from d group by 1
 union all select 'skipped', count(distinct bundle), 0 from finding_rows""",
}
