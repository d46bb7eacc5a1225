"""Queries over wires and labels on drawings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nets as N
from ..operators import spans as S
from .common import over


def joined(d: DataFrame, *columns: str) -> DataFrame:
    return d.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns})


def pages(wires: DataFrame) -> DataFrame:
    return wires.select("document", "sheet").distinct().withColumns({"page_width": F.lit(400.0), "page_height": F.lit(300.0)})


def dots(labels: DataFrame) -> DataFrame:
    """Small shapes on some crossings, and others that are no dots."""
    x, y = F.col("x0") - 49, F.col("y0") + 1
    shapes = labels.filter("ord % 10 in (1, 2, 3, 4, 5, 6)").select("document", "sheet", x.alias("x0"), y.alias("y0"), (x + F.when(F.col("ord") % 4 == 0, 9.0).otherwise(2.0)).alias("x1"), (y + 2).alias("y1"), F.when(F.col("ord") % 7 > 0, F.lit(1)).alias("fill"))
    return N.junction_dots(shapes)


def endpoints(wires: DataFrame) -> DataFrame:
    return N.free_ends(wires, N.nets(wires))


def assembled(wires: DataFrame, labels: DataFrame) -> DataFrame:
    return N.assemble_nets(wires, N.nets(wires), labels)


def crossings(wires: DataFrame, labels: DataFrame) -> DataFrame:
    return N.wire_crossings(wires, dots(labels))


def refs(wires: DataFrame, labels: DataFrame) -> DataFrame:
    return N.attach_cross_refs(labels.filter("entity_type = 'pin_ref'"), endpoints(wires))


def issues(wires: DataFrame, labels: DataFrame) -> DataFrame:
    return N.issue_candidates(crossings(wires, labels), S.terminal_order_anomalies(labels), N.gauge_vs_width(labels, wires))


def fonts(labels: DataFrame) -> DataFrame:
    from ..functions import text as T

    latin, meant = T.code_page_table("cp1251")
    word = F.concat(F.lit("Щит автоматики "), F.col("text"))
    return labels.select("document", (F.col("ord") % 3).cast("string").alias("font"), F.when(F.col("ord") % 3 == 0, F.translate(word, meant, latin)).otherwise(word).alias("text"))


def placed(d: DataFrame) -> DataFrame:
    return d.withColumn("positions", F.array_join(F.transform("positions", lambda p: F.concat(F.round(p["x"] * 10).cast("long").cast("string"), F.lit("/"), F.round(p["y"] * 10).cast("long").cast("string"))), ","))


def linked(labels: DataFrame) -> DataFrame:
    """Labels, of which some are links to other sheets."""
    link = F.col("ord") % 3 == 0
    return labels.withColumns({"text": F.when(link, F.concat(F.lit("/"), F.col("ord") % 90, F.lit(".4:D"))).otherwise(F.trim("text")), "entity_type": F.when(link, F.lit("cross_ref")).otherwise(F.col("entity_type"))})


W, L, D, I = "wires", "wire_labels", "drawing_texts", "instrument_texts"
QUERIES = {
    "net1_wire_candidates": over(lambda w: N.wire_candidates(w, pages(w)).select("seg"), W),
    "net5_t_junction_edges": over(N.t_junction_edges, W),
    "net6_axis_touch_edges": over(N.axis_touch_edges, W),
    "net7_nets": over(N.nets, W),
    "net8_free_ends": over(endpoints, W),
    "net9_nearest_labels": over(lambda w, s: N.nearest_labels(endpoints(w), s).withColumn("dist", F.round("dist", 6)), W, L),
    "net10_describe_endpoints": over(lambda w, s: N.describe_endpoints(endpoints(w), s), W, L),
    "net11_net_markings": over(lambda w, s: N.net_markings(w, N.nets(w), s), W, L),
    "net12_assemble_nets": over(lambda w, s: joined(assembled(w, s), "terminals", "kks_tags", "wire_gauges", "wire_markings"), W, L),
    "net13_terminal_index": over(lambda w, s: joined(N.terminal_index(assembled(w, s)), "nets", "sheets"), W, L),
    "net13_marking_index": over(lambda w, s: joined(N.marking_index(assembled(w, s)), "nets", "sheets"), W, L),
    "net14_attach_cross_refs": over(lambda w, s: refs(w, s).select("ord", F.coalesce("net", F.lit(-1).cast("long")).alias("net"), "dist_to_net"), W, L),
    "net14_graph_links": over(lambda w, s: N.graph_links(linked(s), w.withColumnRenamed("seg", "line")).na.fill(-1, ["line", "node"]), W, L),
    "net15_net_summary": over(lambda w, s: N.net_summary(assembled(w, s)), W, L),
    "net17_wire_crossings": over(crossings, W, L),
    "net18_junction_dots": over(dots, L),
    "net19_gauge_vs_width": over(lambda w, s: N.gauge_vs_width(s, w), W, L),
    "net20_issue_candidates": over(issues, W, L),
    "spn1_detect_font_codec": over(lambda s: S.detect_font_codec(fonts(s)), L),
    "net16_page_graph": over(lambda w, s: joined(N.page_graph(w, s), "labels1", "labels2"), W, L),
    "spn3_merge_split_tags": over(S.merge_split_tags, "split_tags"),
    "spn2_detect_profile": over(S.detect_profile, "sheet_texts"),
    "spn11_stitch_pin_refs": over(lambda d: S.stitch_pin_refs(d).drop("other"), "split_refs"),
    "spn4_type_histogram": over(S.type_histogram, L),
    "spn5_pair_in_block": over(S.pair_in_block, D),
    "spn6_pair_nearest": over(lambda d: S.pair_nearest(d.filter("entity_type = 'designator'"), d.filter("entity_type = 'article'")), D),
    "spn7_document_designation": over(S.document_designation, D),
    "spn8_instrument_tags": over(S.instrument_tags, I),
    "spn9_instrument_index": over(lambda d: S.instrument_index(S.instrument_tags(d)), I),
    "spn10_io_channels": over(lambda d: joined(S.io_channels(d), "tags"), "channel_lines"),
    "spn12_dup_addresses": over(lambda d: placed(S.dup_addresses(d)), L),
    "spn12_stitched_addresses": over(lambda d: placed(S.dup_addresses(d)), "address_texts"),
    "spn13_relay_coils": over(S.relay_coils, L),
    "spn14_terminal_order": over(S.terminal_order_anomalies, L),
    "spn15_pin_owners": over(lambda s: S.pin_owners(s).select("document", "sheet", "ord", "pin", "device", "kks", "owner_source"), L),
}
SAME = lambda a, b: f"{a}.document = {b}.document and {a}.sheet = {b}.sheet"
DIST = lambda ax, ay, bx, by: f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"
ENDS = "ends as (select document, sheet, seg, x1 as px, y1 as py from wires union all select document, sheet, seg, x2, y2 from wires)"
ALONG = "(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))"
FROM = lambda t: f"sqrt((px - (x1 + {t} * (x2 - x1))) ** 2 + (py - (y1 + {t} * (y2 - y1))) ** 2)"
TJ = f"tj as (select distinct e.seg as src, w.seg as dst from ends e join wires w on {SAME('e', 'w')} and e.seg <> w.seg where {ALONG} > 0.02 and {ALONG} < 0.98 and {FROM(ALONG)} <= 0.6)"
KEYS = "keys as (select document, sheet, seg, round_even(px / 0.15, 0) as kx, round_even(py / 0.15, 0) as ky from ends)"
COMP = f"""{ENDS}, {TJ}, {KEYS}, pairs as (select a.seg as s, b.seg as d from keys a join keys b on {SAME('a', 'b')} and a.kx = b.kx and a.ky = b.ky union select src, dst from tj union select dst, src from tj),
 reach(s, d) as (select s, d from pairs union select r.s, p.d from reach r join pairs p on p.s = r.d), net_of as (select s as seg, min(d) as net from reach group by s)"""
FREE = "free as (select document, sheet, net, round_even(px, 1) as px, round_even(py, 1) as py from ends join net_of using (seg) group by all having count(*) = 1)"
MID = "mid as (select document, sheet, ord, text, entity_type, (x0 + x1) / 2 as ox, (y0 + y1) / 2 as oy from wire_labels)"
LABELS = f"""points as (select distinct document, sheet, px, py from free), near_ as (select p.*, m.entity_type as type, m.text, m.ord, {DIST('px', 'py', 'ox', 'oy')} as dist from points p join mid m on {SAME('p', 'm')} where m.entity_type in ({', '.join(f"'{t}'" for t in S.LABEL_TYPES)})),
 labels_ as (select document, sheet, px, py, type, text, dist from near_ where dist <= 14 qualify row_number() over (partition by document, sheet, px, py, type order by dist, ord) = 1)"""
ADDRESS = S.FULL_ADDRESS
OWNERS = f"""pins as (select *, trim(text) as t, regexp_matches(trim(text), '{ADDRESS}') as whole from mid where entity_type in ('terminal_no', 'coil_terminal', 'pin_ref')),
 rowd as (select p.ord, arg_min(trim(d.text), (p.ox - d.ox) * 1000000 + d.ord * 0.000001) as device from pins p join mid d on {SAME('p', 'd')} and d.entity_type = 'device_tag' where not whole and abs(p.oy - d.oy) <= 4 and p.ox - d.ox > 0 and p.ox - d.ox < 60 group by p.ord),
 above as (select p.ord, arg_min(trim(d.text), (p.oy - d.oy) * 1000000 + d.ord * 0.000001) as kks from pins p join mid d on {SAME('p', 'd')} and d.entity_type = 'instrument_tag' where not whole and abs(p.ox - d.ox) <= 60 and p.oy - d.oy > 0 and p.oy - d.oy < 160 group by p.ord),
 owners as (select document, sheet, p.ord, p.ox as x, p.oy as y, case when whole then regexp_extract(t, '{ADDRESS}', 2) else t end as pin, case when whole then regexp_extract(t, '{ADDRESS}', 1) else r.device end as device, case when not whole and r.device is null then a.kks end as kks,
 case when not whole and r.device is not null then 'row' when not whole and a.kks is not null then 'above' end as owner_source from pins p left join rowd r on r.ord = p.ord left join above a on a.ord = p.ord)"""
LABEL = lambda t: f"max(case when type = '{t}' then text end)"
ABOUT = f"""pin_at as (select p.*, o.pin, o.device, o.kks, o.owner_source from points p join owners o on {SAME('p', 'o')} where {DIST('px', 'py', 'o.x', 'o.y')} < 14 qualify row_number() over (partition by p.document, p.sheet, px, py order by {DIST('px', 'py', 'o.x', 'o.y')}, o.ord) = 1),
 wide as (select document, sheet, px, py, count(*) as labels, {LABEL('device_tag')} as tag, {LABEL('instrument_tag')} as instrument, {LABEL('power_pin')} as power, {LABEL('io_channel')} as io_channel, {LABEL('signal_state')} as signal, {LABEL('wire_gauge')} as wire_gauge, {LABEL('cable_type')} as cable, {LABEL('reserve_label')} as spare from labels_ group by all),
 about as (select p.document, p.sheet, p.px, p.py, coalesce(i.device, tag) as device, i.pin, i.owner_source, coalesce(instrument, i.kks) as kks, power, io_channel, signal, wire_gauge, cable, spare is not null as reserve, case when coalesce(i.device, tag, instrument, i.kks) is not null and i.pin is not null then concat(coalesce(i.device, tag, instrument, i.kks), ':', i.pin) end as terminal, coalesce(labels, 0) as labels
 from points p left join pin_at i using (document, sheet, px, py) left join wide w using (document, sheet, px, py))"""
CLAMPED = "least(greatest(coalesce(case when (x2 - x1) ** 2 + (y2 - y1) ** 2 >= 1e-6 then " + ALONG + " end, 0), 0), 1)"
MARKS = f"""marked as (select document, sheet, x as px, y as py, pin as text from owners where device is null and kks is null and regexp_matches(pin, '^[0-9]+$') union all select document, sheet, ox, oy, trim(text) from mid where entity_type = 'wire_marking'),
 markings as (select distinct net, m.text from marked m join wires w on {SAME('m', 'w')} join net_of n on n.seg = w.seg where {FROM(CLAMPED)} <= 9)"""
NETS = f"""sizes as (select document, sheet, net, count(*) as n_segments from wires join net_of using (seg) group by all), joined as (select f.net, a.* from free f join about a using (document, sheet, px, py)),
 of_ends as (select net, count(*) as n_endpoints, sum(labels) as labels, list_sort(list_distinct(list(terminal) filter (terminal is not null))) as terminals, list_sort(list_distinct(list(kks) filter (kks is not null))) as kks_tags, list_sort(list_distinct(list(wire_gauge) filter (wire_gauge is not null))) as wire_gauges from joined group by net),
 of_marks as (select net, list_sort(list(text)) as wire_markings from markings group by net),
 assembled as (select s.*, coalesce(n_endpoints, 0) as n_endpoints, coalesce(terminals, []) as terminals, coalesce(kks_tags, []) as kks_tags, coalesce(wire_gauges, []) as wire_gauges, coalesce(wire_markings, []) as wire_markings from sizes s left join of_ends e using (net) left join of_marks m using (net) where coalesce(labels, 0) > 0 or len(coalesce(wire_markings, [])) > 0)"""
ALL = f"with recursive {COMP}, {FREE}, {MID}, {LABELS}, {OWNERS}, {ABOUT}, {MARKS}, {NETS}"
INDEX = lambda c, n: f"{ALL}, u as (select document, unnest({c}) as {n}, net, sheet from assembled) select document, {n}, array_to_string(list_sort(list_distinct(list(net)))::varchar[], ',') as nets, count(distinct net) as n_nets, array_to_string(list_sort(list_distinct(list(sheet)))::varchar[], ',') as sheets from u group by document, {n}"
DOTS = "dots as (select document, sheet, round_even(x0 - 49 + 1, 2) as ox, round_even(y0 + 1 + 1, 2) as oy from wire_labels where ord % 10 in (1, 2, 3, 4, 5, 6) and ord % 4 <> 0 and ord % 7 > 0)"
CROSS = f"""stroked as (select *, count(*) filter (width > 0) over (partition by document, sheet) as k from wires), lines as (select * from stroked where width > 0 or k < 20),
 both_ as (select a.document, a.sheet, a.seg as a, b.seg as b, a.x1, a.y1, a.x2 - a.x1 as adx, a.y2 - a.y1 as ady, b.x2 - b.x1 as bdx, b.y2 - b.y1 as bdy, b.x1 as bx1, b.y1 as by1 from lines a join lines b on {SAME('a', 'b')} and a.seg < b.seg),
 solved as (select *, ((bx1 - x1) * bdy - (by1 - y1) * bdx) / (adx * bdy - ady * bdx) as t, ((bx1 - x1) * ady - (by1 - y1) * adx) / (adx * bdy - ady * bdx) as u from both_ where abs(adx * bdy - ady * bdx) >= 1e-9),
 cross_ as (select document, sheet, a, b, x1 + t * adx as px, y1 + t * ady as py from solved where t between 0 and 1 and u between 0 and 1 and least(t, 1 - t) * sqrt(adx * adx + ady * ady) >= 0.3 and least(u, 1 - u) * sqrt(bdx * bdx + bdy * bdy) >= 0.3), {DOTS},
 crossings as (select document, sheet, a, b, round_even(px, 2) as x, round_even(py, 2) as y, exists (select 1 from dots d where {SAME('d', 'c')} and {DIST('px', 'py', 'd.ox', 'd.oy')} <= 2.5) as has_dot from cross_ c)"""
GAUGE = f"""gauges as (select g.document, g.sheet, g.ord, g.text as label, w.width, round_even({DIST('ox', 'oy', '((w.x1 + w.x2) / 2)', '((w.y1 + w.y2) / 2)')}, 2) as dist from mid g join wires w on {SAME('g', 'w')} where g.entity_type = 'wire_gauge' and width > 0 and {DIST('ox', 'oy', '((w.x1 + w.x2) / 2)', '((w.y1 + w.y2) / 2)')} < 8
 qualify row_number() over (partition by g.ord order by {DIST('ox', 'oy', '((w.x1 + w.x2) / 2)', '((w.y1 + w.y2) / 2)')}, w.seg) = 1)"""
ORDER = f"""terms as (select p.document, p.sheet, p.ord, p.text, p.ox as px, p.oy as py, trim(a.text) as connector, row_number() over (partition by p.ord order by p.ox - a.ox, a.ord) as best from mid p join mid a on {SAME('p', 'a')} where p.entity_type in ('terminal_no', 'pin_ref') and a.entity_type = 'device_tag' and regexp_matches(trim(a.text), '^(XA|XM|XB|XT|XP)\\d+$') and abs(a.oy - p.oy) <= 3 and p.ox - a.ox >= 0 and p.ox - a.ox < 60),
 placed as (select *, round_even(py / 6, 0) * 6 as row_y, coalesce(try_cast(regexp_replace(text, '[^0-9]', '', 'g') as bigint), -1) as number from terms where best = 1),
 stepped as (select *, case when lag(number) over w is not null then (number > lag(number) over w)::int end as rises from placed window w as (partition by document, sheet, connector, row_y order by px, ord)),
 anomalies as (select document, sheet, connector, row_y, string_agg(text, ',' order by px, ord) as sequence from stepped group by document, sheet, connector, row_y having count(*) >= 3 and avg(rises) < 0.9)"""
SPN8 = f"""t as (select *, upper(trim(text)) as t, (x0 + x1) / 2 as ox, (y0 + y1) / 2 as oy, y1 - y0 as h from instrument_texts where not regexp_matches(upper(trim(text)), '^(DN|PN|DU)[^A-Z]*$')),
 tags as (select document, sheet, ord, regexp_replace(t, '[ -]', '', 'g') as tag, false as split from t where regexp_matches(t, '^[A-Z]{{2,4}} ?-?[0-9]{{1,4}}[A-Z]?$') union all
 select a.document, a.sheet, a.ord, concat(a.t, d.t), true from t a join t d on {SAME('a', 'd')} where regexp_matches(a.t, '^[A-Z]{{2,4}}$') and regexp_matches(d.t, '^[0-9]{{1,4}}[A-Z]?$') and abs(a.ox - d.ox) <= 1.2 * a.h and d.oy - a.oy >= -a.h and d.oy - a.oy <= 1.4 * a.h qualify row_number() over (partition by a.ord order by abs(d.oy - a.oy), d.ord) = 1)"""
SQL = {
    "net1_wire_candidates": """with r as (select *, width between 0.9 and 1.05 and sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) > 100 as frame, least(x1, x2) <= 2 or greatest(x1, x2) >= 398 or least(y1, y2) <= 2 or greatest(y1, y2) >= 298 as edge from wires),
 f as (select document, sheet, min(least(x1, x2)) as lx, max(greatest(x1, x2)) as hx, min(least(y1, y2)) as ly, max(greatest(y1, y2)) as hy from r where frame and not edge group by all)
 select seg from r left join f using (document, sheet) where not frame and (lx is null or (least(x1, x2) >= lx - 1 and greatest(x1, x2) <= hx + 1 and least(y1, y2) >= ly - 1 and greatest(y1, y2) <= hy + 1))""",
    "net5_t_junction_edges": f"with {ENDS}, {TJ} select src, dst from tj",
    "net6_axis_touch_edges": f"""with a as (select *, case when abs(x2 - x1) < 0.8 and abs(y2 - y1) >= 3 then 'v' when abs(y2 - y1) < 0.8 and abs(x2 - x1) >= 3 then 'h' end as axis from wires), e as (select document, sheet, seg, x1 as px, y1 as py from a where axis is not null union all select document, sheet, seg, x2, y2 from a where axis is not null)
 select distinct least(e.seg, l.seg) as src, greatest(e.seg, l.seg) as dst from e join a l on {SAME('e', 'l')} and e.seg <> l.seg where axis is not null and ((abs(px - x1) <= 2 and abs(py - y1) <= 2) or (abs(px - x2) <= 2 and abs(py - y2) <= 2)
 or (axis = 'h' and abs(py - y1) <= 2 and px between least(x1, x2) - 2 and greatest(x1, x2) + 2) or (axis = 'v' and abs(px - x1) <= 2 and py between least(y1, y2) - 2 and greatest(y1, y2) + 2))""",
    "net7_nets": f"with recursive {COMP} select seg, net from net_of",
    "net8_free_ends": f"with recursive {COMP}, {FREE} select * from free",
    "net9_nearest_labels": f"with recursive {COMP}, {FREE}, {MID}, {LABELS} select document, sheet, px, py, type, text, round(dist, 6) as dist from labels_",
    "net10_describe_endpoints": f"{ALL} select * from about",
    "net11_net_markings": f"{ALL} select net, text from markings",
    "net12_assemble_nets": f"{ALL} select document, sheet, net, n_segments, n_endpoints, array_to_string(terminals, ',') as terminals, array_to_string(kks_tags, ',') as kks_tags, array_to_string(wire_gauges, ',') as wire_gauges, array_to_string(wire_markings, ',') as wire_markings from assembled",
    "net13_terminal_index": INDEX("terminals", "terminal"),
    "net13_marking_index": INDEX("wire_markings", "marking"),
    "net14_attach_cross_refs": f"""with recursive {COMP}, {FREE}, {MID}, r as (select m.ord, f.net, {DIST('m.ox', 'm.oy', 'f.px', 'f.py')} as dist from mid m left join free f on {SAME('m', 'f')} and {DIST('m.ox', 'm.oy', 'f.px', 'f.py')} < 30 where entity_type = 'pin_ref')
 select ord, coalesce(net, -1) as net, round_even(dist, 2) as dist_to_net from r qualify row_number() over (partition by ord order by dist, net) = 1""",
    "net14_graph_links": over(lambda w, s: N.graph_links(linked(s), w.withColumnRenamed("seg", "line")).na.fill(-1, ["line", "node"]), W, L),
    "net14_graph_links": f"""with t as (select *, ord % 3 = 0 as link, case when ord % 3 = 0 then concat('/', ord % 90, '.4:D') else trim(text) end as txt, (x0 + x1) / 2 as px, (y0 + y1) / 2 as py from wire_labels),
 o as (select *, {", ".join(f"lag({{'ok': not link and (regexp_matches(txt, '^[A-ZА-Я]{{1,4}}\\d{{1,4}}:[A-Z0-9]{{1,3}}$') or entity_type = 'device_tag'), 't': txt, 'y': y0}}, {i}) over w as l{i}" for i in (1, 2, 3))} from t window w as (partition by document, sheet order by round_even(y0, 0), x0, ord)),
 n as (select document, sheet, seg as line, 1 as node, x1 as ox, y1 as oy from wires union all select document, sheet, seg, 2, x2, y2 from wires), d as (select o.document, o.sheet, o.ord, n.line, n.node from o join n on {SAME('o', 'n')} and {DIST('px', 'py', 'ox', 'oy')} < 25 where link qualify row_number() over (partition by o.document, o.sheet, o.ord order by {DIST('px', 'py', 'ox', 'oy')}, n.line, n.node) = 1)
 select o.document, o.sheet, o.ord, txt as raw_text, (o.ord % 90)::int as target_sheet, 4 as target_column, 'D' as target_zone, coalesce(line, -1) as line, coalesce(node, -1) as node, case {" ".join(f"when l{i}.ok and abs(l{i}.y - y0) <= 4 then l{i}.t" for i in (3, 2, 1))} end as device_pin from o left join d on d.document = o.document and d.sheet = o.sheet and d.ord = o.ord where link""",
    "net15_net_summary": f"{ALL} select document, count(*) as nets, count(*) filter (len(terminals) >= 2) as two_or_more, count(*) filter (len(terminals) = 1) as one, count(*) filter (len(terminals) = 0) as without, count(*) filter (len(terminals) < 2 and n_endpoints < 2) as dangling from assembled group by document",
    "net17_wire_crossings": f"with {CROSS} select * from crossings",
    "net18_junction_dots": f"with {DOTS} select * from dots",
    "net19_gauge_vs_width": f"with {MID}, {GAUGE} select * from gauges",
    "net20_issue_candidates": f"with {MID}, {CROSS}, {GAUGE}, {ORDER}, k as (select document, case when has_dot then 'crossing with dot' else 'crossing without dot' end as kind from crossings union all select document, 'terminal order' from anomalies union all select document, 'gauge and width' from gauges) select document, kind, count(*) as n from k group by all",
    "spn1_detect_font_codec": "select document, (ord % 3)::varchar as font, case when any_value(ord % 3) = 0 then 'cp1251' end as codec from wire_labels group by all",
    "net16_page_graph": f"""with recursive {ENDS}, {KEYS}, pairs as (select a.seg as s, b.seg as d from keys a join keys b on {SAME('a', 'b')} and a.kx = b.kx and a.ky = b.ky), reach(s, d) as (select s, d from pairs union select r.s, p.d from reach r join pairs p on p.s = r.d),
 line_of as (select s as seg, min(d) as line from reach group by s), edges as (select document, sheet, line, min(struct_pack(x := px, y := py)) as a, max(struct_pack(x := px, y := py)) as b, count(distinct seg) as n_segments from ends join line_of using (seg) group by document, sheet, line), {MID},
 nodes as (select distinct document, sheet, a.x as px, a.y as py from edges union select document, sheet, b.x, b.y from edges), near_ as (select n.*, m.entity_type as type, m.text, m.ord, {DIST('px', 'py', 'ox', 'oy')} as dist from nodes n join mid m on {SAME('n', 'm')} where m.entity_type in ('terminal_no', 'pin_ref', 'wire_gauge', 'device_tag', 'instrument_tag', 'power_pin')),
 best as (select * from near_ where dist < 12 qualify row_number() over (partition by document, sheet, px, py, type order by dist, ord) = 1), labels_ as (select document, sheet, px, py, array_to_string(list_sort(list(concat(type, '=', text))), ',') as labels from best group by document, sheet, px, py)
 select e.document, e.sheet, line, a.x as x1, a.y as y1, b.x as x2, b.y as y2, n_segments, coalesce(p.labels, '') as labels1, coalesce(q.labels, '') as labels2 from edges e left join labels_ p on {SAME('p', 'e')} and p.px = a.x and p.py = a.y left join labels_ q on {SAME('q', 'e')} and q.px = b.x and q.py = b.y""",
    "spn3_merge_split_tags": f"""select a.document, a.sheet, a.ord, b.ord as other, concat(a.text, b.text) as text from split_tags a join split_tags b on {SAME('a', 'b')} and a.font = b.font where a.text = 'XM' and regexp_matches(b.text, '^[0-9]{{1,2}}$') and b.x0 - a.x1 between -0.5 and 10 and abs(a.y0 - b.y0) <= 2
 qualify row_number() over (partition by a.ord order by b.x0, b.ord) = 1""",
    "spn2_detect_profile": "select document, case when sum(a) >= sum(c) then 'A' else 'C' end as profile, greatest(sum(a), sum(c))::bigint as score from (select document, case when entity_type = 'cross_ref' and starts_with(text, '/') then 3 else 0 end as a, case when entity_type = 'module_partno' or (entity_type = 'cross_ref' and starts_with(text, '(')) then 3 else 0 end as c from sheet_texts) group by document",
    "spn11_stitch_pin_refs": f"""with h as (select * from split_refs where regexp_matches(text, '^[0-9]{{0,2}}[A-Z]{{1,5}}[0-9]{{1,4}}:$')), t as (select * from split_refs where regexp_matches(text, '^[A-Z0-9]{{1,4}}$')),
 p as (select h.document, h.sheet, h.ord, t.ord as other, concat(h.text, t.text) as address, abs(t.x0 - h.x1) as gap from h join t on {SAME('h', 't')} where abs(t.x0 - h.x1) <= 6 and least(h.y1, t.y1) - greatest(h.y0, t.y0) >= 1),
 r as (select *, row_number() over (partition by document, sheet, ord order by gap, ord, other) as a, row_number() over (partition by document, sheet, other order by gap, ord, other) as b from p) select document, sheet, ord, address from r where a = 1 and b = 1""",
    "spn4_type_histogram": "select document, entity_type, count(*) as n from wire_labels group by all",
    "spn5_pair_in_block": """with n as (select *, max(size) over (partition by document, sheet, block) as top from drawing_texts where entity_type = 'designator'), a as (select document, sheet, block, arg_max(text, length(text) * 1000000000 - ord) as article from drawing_texts where entity_type = 'article' group by all)
 select document, sheet, block, ord, text as designator, article from n join a using (document, sheet, block) where abs(size - top) <= 0.01""",
    "spn6_pair_nearest": f"""select n.document, n.sheet, n.ord, n.text as designator, a.text as article, 'nearest' as pair_source, round_even({DIST('n.x0', 'n.y0', 'a.x0', 'a.y0')}, 2) as dist from drawing_texts n join drawing_texts a on {SAME('n', 'a')} where n.entity_type = 'designator' and a.entity_type = 'article' and {DIST('n.x0', 'n.y0', 'a.x0', 'a.y0')} < 40
 qualify row_number() over (partition by n.ord order by {DIST('n.x0', 'n.y0', 'a.x0', 'a.y0')}, a.ord) = 1""",
    "spn7_document_designation": "select document, text as designation from drawing_texts where entity_type = 'doc_number' qualify row_number() over (partition by document order by size desc, sheet, ord) = 1",
    "spn8_instrument_tags": f"with {SPN8} select * from tags",
    "spn9_instrument_index": f"with {SPN8} select document, tag, count(*) as n, array_to_string(list_sort(list_distinct(list(sheet)))::varchar[], ',') as sheets from tags group by all",
    "spn10_io_channels": """with l as (select *, trim(text) as t from channel_lines where trim(text) <> ''), m as (select *, nullif(regexp_extract(t, '^([A-C]A\\d{2})$', 1), '') as m, case when regexp_matches(t, '^(DI|AI|DO|AO)\\s*\\d{1,2}$') then replace(t, ' ', '') end as c from l),
 g as (select *, last_value(m ignore nulls) over (partition by document order by sheet, ord rows between unbounded preceding and current row) as module from m), s as (select *, m is not null or (c is not null and module is not null) as starts from g),
 h as (select *, last_value(case when starts then {'at': sheet, 'module': module, 'channel': case when m is null then c end} end ignore nulls) over (partition by document order by sheet, ord rows between unbounded preceding and current row) as key from s),
 k as (select *, not starts and not regexp_matches(t, '^\\d{1,4}$|^RB\\d{2}:\\d|^Лист$|^\\d+W\\d+$') and (length(t) >= 3 or regexp_matches(t, '[а-яА-ЯёЁ]')) as says, list_concat(regexp_extract_all(t, '\\b(00[A-Z0-9]{9,11})\\b', 1), list_filter(regexp_extract_all(t, '\\b(\\d{1,2}[A-Z]{1,3}\\d{1,2})\\b', 1), lambda x: not regexp_matches(x, '^\\d+W\\d+$'))) as tags from h where key.channel is not null),
 p as (select *, trim(list_reduce(list_concat([t], tags), lambda a, x: replace(a, x, ''))) as bare from k)
 select document, key.at as sheet, key.module as module, key.channel as channel, coalesce(trim(regexp_replace(string_agg(case when says and regexp_matches(t, '[а-яА-ЯёЁ]') and length(bare) > 2 then bare end, ' ' order by p.sheet, ord, bare), '\\s+', ' ', 'g')), '') as description,
 array_to_string(list_sort(list_filter(list_distinct(flatten(list(case when says then tags else [] end))), lambda x: length(x) > 2 and not regexp_matches(x, '^R[AB]\\d{2}'))), ',') as tags from p group by document, key""",
    "spn12_dup_addresses": f"""with h as (select *, trim(text) as t, (y1 - y0) > (x1 - x0) as down from wire_labels), pair as (select a.document, a.sheet, a.ord, b.ord as other, a.t || b.t as whole, abs(case when a.down then b.y0 - a.y1 else b.x0 - a.x1 end) as gap from h a join h b on {SAME('a', 'b')} and regexp_matches(a.t, '^[0-9]{{0,2}}[A-ZА-Я]{{1,5}}[0-9]{{1,4}}:$')
 and regexp_matches(b.t, '^[A-Z0-9]{{1,4}}$') where case when a.down then abs(b.y0 - a.y1) <= 6 and least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 1 else abs(b.x0 - a.x1) <= 6 and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 1 end),
 best as (select * from pair qualify row_number() over (partition by document, sheet, ord order by gap, other) = 1), a as (select h.document, h.sheet, coalesce(best.whole, t) as address, (x0 + x1) / 2 as ox, (y0 + y1) / 2 as oy from h left join best on best.document = h.document and best.sheet = h.sheet and best.ord = h.ord
 where not exists (select 1 from best u where u.document = h.document and u.sheet = h.sheet and u.other = h.ord)), f as (select * from a where regexp_matches(address, '{ADDRESS}'))
 select document, sheet, address, count(*) as n, string_agg(concat(round(round_even(ox, 1) * 10)::bigint, '/', round(round_even(oy, 1) * 10)::bigint), ',' order by ox, oy) as positions from f group by document, sheet, address
 having count(*) >= 2 and exists (select 1 from f p join f q on {SAME('p', 'q')} and p.address = q.address where p.document = f.document and p.sheet = f.sheet and p.address = f.address and {DIST('p.ox', 'p.oy', 'q.ox', 'q.oy')} > 5)""",
    "spn12_stitched_addresses": f"""with h as (select *, trim(text) as t, (y1 - y0) > (x1 - x0) as down from address_texts), pair as (select a.document, a.sheet, a.ord, b.ord as other, a.t || b.t as whole, abs(case when a.down then b.y0 - a.y1 else b.x0 - a.x1 end) as gap from h a join h b on {SAME('a', 'b')} and regexp_matches(a.t, '^[0-9]{{0,2}}[A-ZА-Я]{{1,5}}[0-9]{{1,4}}:$')
 and regexp_matches(b.t, '^[A-Z0-9]{{1,4}}$') where case when a.down then abs(b.y0 - a.y1) <= 6 and least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 1 else abs(b.x0 - a.x1) <= 6 and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 1 end),
 best as (select * from pair qualify row_number() over (partition by document, sheet, ord order by gap, other) = 1), a as (select h.document, h.sheet, coalesce(best.whole, t) as address, (x0 + x1) / 2 as ox, (y0 + y1) / 2 as oy from h left join best on best.document = h.document and best.sheet = h.sheet and best.ord = h.ord
 where not exists (select 1 from best u where u.document = h.document and u.sheet = h.sheet and u.other = h.ord)), f as (select * from a where regexp_matches(address, '{ADDRESS}'))
 select document, sheet, address, count(*) as n, string_agg(concat(round(round_even(ox, 1) * 10)::bigint, '/', round(round_even(oy, 1) * 10)::bigint), ',' order by ox, oy) as positions from f group by document, sheet, address
 having count(*) >= 2 and exists (select 1 from f p join f q on {SAME('p', 'q')} and p.address = q.address where p.document = f.document and p.sheet = f.sheet and p.address = f.address and {DIST('p.ox', 'p.oy', 'q.ox', 'q.oy')} > 5)""",
    "spn13_relay_coils": f"""with {MID}, c as (select t.document, t.sheet, t.ord, trim(t.text) as tag, t.ox, t.oy from mid t join mid p on {SAME('t', 'p')} where t.entity_type = 'device_tag' and upper(trim(p.text)) in ('A1', 'A2') and {DIST('t.ox', 't.oy', 'p.ox', 'p.oy')} <= 40
 group by t.document, t.sheet, t.ord, t.text, t.ox, t.oy having count(distinct upper(trim(p.text))) = 2),
 part as (select a.document, a.sheet, a.ord, arg_min(trim(b.text), {{'gap': abs(b.x0 - a.x1), 'ord': b.ord}}) as part from wire_labels a join wire_labels b on {SAME('a', 'b')} where a.entity_type = 'device_tag' and a.ord <> b.ord and regexp_matches(trim(b.text), '^\\d{{1,2}}$') and abs(b.x0 - a.x1) <= 6 and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 1 group by all)
 select c.document, c.sheet, c.ord, tag || coalesce(part, '') as designator, round_even(ox, 1) as x, round_even(oy, 1) as y from c left join part on part.document = c.document and part.sheet = c.sheet and part.ord = c.ord""",
    "spn14_terminal_order": f"with {MID}, {ORDER} select * from anomalies",
    "spn15_pin_owners": f"with {MID}, {OWNERS} select document, sheet, ord, pin, device, kks, owner_source from owners",
}
