"""Queries over progress events and replies, as tables; the streams themselves are tested against these."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import progress as P
from .common import over

DAY = 86_400.0


def events(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("index_", "index")


def lines(rows: DataFrame) -> DataFrame:
    """Events as they are printed, among other output; some are cut off."""
    whole = F.concat(F.lit(P.MARKER + " "), F.to_json(F.struct("kind", "page", "total", "stage")))
    line = F.when(F.col("seq") % 13 == 0, F.concat(F.lit("read page "), "page")).when(F.col("seq") % 11 == 0, F.substring(whole, 1, 22)).otherwise(whole)
    return rows.select("session", "ts", "seq", line.alias("line"))


def replies(rows: DataFrame) -> DataFrame:
    usage = F.when(F.col("seq") % 10 == 3, F.col("seq") % 100)
    return rows.select("session", (F.col("seq") % 4).alias("reply"), "ts", usage.alias("usage"))


R = "progress_rows"
QUERIES = {
    "str1_parse_progress": over(lambda d: P.parse_progress(lines(d)).select("session", "seq", "kind", "page", "total", "stage"), R),
    "str2_latest_progress": over(lambda d: P.latest_progress(events(d)).na.fill(-1), R),
    "str3_throttle": over(lambda d: P.throttle(d, DAY), R),
    "str4_generation_speed": over(P.generation_speed, R),
    "str5_chunk_speed": over(lambda d: P.chunk_speed(replies(d)), R),
    "str6_split_reasoning": over(P.split_reasoning_chunks, "reply_chunks"),
}
AT = "epoch_us(ts) / 1000000.0"
SQL = {
    "str1_parse_progress": "select session, seq, kind, page, total, stage from progress_rows where seq % 13 <> 0 and seq % 11 <> 0",
    "str2_latest_progress": """with d as (select session, max(seq) as seq, arg_max(kind, seq) as kind, arg_max(name, seq) as document, arg_max(doc_type, seq) as doc_type, arg_max(index_, seq) as doc_index, arg_max(total, seq) as doc_total, arg_max(path, seq) as path from progress_rows where kind in ('document', 'done') group by session),
 p as (select session, max(seq) as seq, arg_max(kind, seq) as kind, arg_max(page, seq) as page, arg_max(total, seq) as total, arg_max(stage, seq) as stage from progress_rows where kind in ('page', 'stage') group by session),
 j as (select coalesce(d.session, p.session) as session, d.kind as dk, document, doc_type, doc_index, doc_total, path, p.kind as pk, page, total, stage, coalesce(p.seq > coalesce(d.seq, -1), false) as after_ from d full join p on d.session = p.session)
 select session, case when dk = 'document' then document end as document, case when dk = 'document' then doc_type end as doc_type, case when dk = 'document' then doc_index else -1 end as doc_index, case when dk = 'document' then doc_total else -1 end as doc_total, case when dk = 'document' then path end as path,
 case when after_ and pk = 'page' then page else -1 end as page, case when after_ and pk = 'page' then total else -1 end as page_total, case when after_ then stage end as stage from j where after_ or dk = 'document'""",
    "str3_throttle": f"""with recursive n as (select *, {AT} as sec, row_number() over (partition by session order by seq) as k from progress_rows),
 f(session, k, seq, kind, page, own, shown_at, shown) as (select session, k, seq, kind, page, sec, sec, true from n where k = 1
 union all select n.session, n.k, n.seq, n.kind, n.page, n.sec, case when n.kind <> 'page' or n.sec - f.shown_at >= 86400 then n.sec else f.shown_at end, n.kind <> 'page' or n.sec - f.shown_at >= 86400 from f join n on n.session = f.session and n.k = f.k + 1)
 select f.session, f.seq, not shown as late, f.kind, f.page from f left join n on n.session = f.session and n.k = f.k + 1 where shown or coalesce(case when n.kind = 'page' then n.sec - own >= 86400 else n.sec - shown_at >= 86400 end, true)""",
    "str4_generation_speed": "with g as (select * from progress_rows where tokens > 0 and seconds > 0) select session, arg_max(round_even(tokens / seconds, 1), seq) as tps, arg_max(tokens, seq) as tokens from g group by session",
    "str5_chunk_speed": f"""with c as (select session, seq % 4 as reply, {AT} as sec, case when seq % 10 = 3 then seq % 100 end as usage from progress_rows), r as (select session, reply, coalesce(max(usage), count(*)) as tokens, max(sec) - min(sec) as seconds from c group by all)
 select session, reply, tokens, seconds, case when seconds > 0 then round_even(tokens / seconds, 1) end as tps from r""",
    "str6_split_reasoning": "with w as (select session, string_agg(text, '' order by seq) as t from reply_chunks group by session) select session, array_to_string(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|$)', 1), '') as reasoning, regexp_replace(t, '(?s)<think>.*?(?:</think>|$)', '', 'g') as content from w",
}
