"""Queries over text functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sql as S
from .common import over, raw


def joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), "|")


def per_caption(**columns) -> object:
    return over(lambda d: d.select("id", *[f(F.col("caption")).alias(n) for n, f in columns.items()]), "captions")


def spread(d: DataFrame) -> DataFrame:
    found = d.select("id", F.explode(T.characteristics(F.col("caption"))).alias("c"))
    return found.select("id", "c.quantity", "c.value")


def cells(d: DataFrame) -> DataFrame:
    return d.select("id", F.array_join(T.parse_designators(F.col("cell")), "|").alias("designators"))


def damaged(d: DataFrame) -> DataFrame:
    """Texts with their bytes of cp1251 read as Latin-1, and repaired."""
    latin, meant = T.code_page_table("cp1251")
    broken = F.translate("caption", meant, latin)
    return d.select("id", (broken != F.col("caption")).alias("was_broken"), T.repair_encoding(broken, "cp1251").alias("repaired"))


def answers(d: DataFrame) -> DataFrame:
    """Conversations as answers of a model, with lists of numbers in fences and bare."""
    number = F.concat(F.lit('{"same_line": ["'), F.col("turn"), F.lit('", " 12", "x", "12345"]}'))
    other = F.concat(F.lit('{"numbers": ["7", "'), F.col("turn"), F.lit('"]}'))
    form = F.pmod(F.col("conv_id"), F.lit(4))
    text = F.when(form == 0, F.concat(F.lit("so ```json\n"), number, F.lit("\n``` done"))).when(form == 1, F.concat(F.lit("```\n"), other, F.lit("```")))
    text = text.when(form == 2, F.concat(F.lit("I see "), number, F.lit(" there"))).otherwise(F.lit("nothing at all"))
    return d.select("conv_id", "turn", text.alias("answer"))


TITLE_JUNK = (
    "'^(формат|масса|масштаб|лист|листов|стадия|дата|инв\\.|взам\\.|подп\\.|разработал|разраб\\.|проверил|пров\\.|н\\.\\s*контр|нач\\.|гип|гап|утвердил|согласовано|копировал)([^а-яёa-z0-9_]|$)"
    "|^[\\d.,/\\s×xX-]*$|^[aаAА]\\s*\\d(\\s*[xхXХ×]\\s*\\d+)?$', 'i'"
)
UNITS = " ".join(f"when '{u.lower()}' then '{q}'" for u, (q, _) in T.UNITS.items())
FACTORS = " ".join(f"when '{u.lower()}' then {f}" for u, (_, f) in T.UNITS.items())
UNIT_PATTERN = "|".join(sorted(T.UNITS, key=lambda u: -len(u)))
WORDS = lambda words: ", ".join(f"'{w}'" for w in words)

QUERIES = {
    "txt1_fold": per_caption(key=T.fold),
    "txt2_fold_designator": per_caption(key=T.fold_designator),
    "txt10_to_number": per_caption(number=lambda c: T.to_number(F.regexp_extract(c, r"[0-9][0-9,.]*", 0))),
    "txt11_clean": per_caption(text=T.clean),
    "txt14_norm_title": per_caption(title=T.norm_title),
    "txt23_cross_refs": over(lambda d: d.filter("entity_type = 'cross_ref'").select("document", "ord", F.coalesce(T.parse_cross_ref(F.col("text"), "A"), T.parse_cross_ref(F.col("text"), "C")).alias("r")).select("document", "ord", "r.sheet", "r.column", "r.zone"), "sheet_texts"),
    "txt24_severity_rank": over(lambda d: d.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select("severity", "n", T.severity_rank(F.col("severity")).alias("rank")), "finding_rows"),
    "txt27_approx_tokens": raw("conversations", lambda d: d.select("conv_id", "turn", T.approx_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))),
    "txt28_clip_text": raw("conversations", lambda d: d.select("conv_id", "turn", T.clip_text(F.col("text"), 20).alias("clipped"))),
    "txt3_to_cyrillic": per_caption(fixed=T.to_cyrillic),
    "txt4_text_tokens": per_caption(tokens=lambda c: joined(T.text_tokens(c))),
    "txt5_article_tokens": per_caption(tokens=lambda c: joined(T.article_tokens(c))),
    "txt6_characteristics": over(spread, "captions"),
    "txt7_project_number": per_caption(number=T.project_number),
    "txt8_exclusions": per_caption(terminal=T.is_iec_terminal, channel=T.is_plc_channel, voltage=T.is_voltage),
    "txt9_parse_designators": over(cells, "position_cells"),
    "txt12_cell_errors": per_caption(broken=T.is_cell_error),
    "txt13_detect_cabinet": per_caption(cabinet=T.detect_cabinet),
    "txt15_title_junk": per_caption(junk=T.is_title_junk),
    "txt16_function_codes": per_caption(codes=lambda c: joined(T.function_codes(c))),
    "txt17_join_fragments": per_caption(joined=lambda c: T.join_fragments(F.array(c, F.lit(" ство  изделий "), F.lit("")))),
    "txt18_kks_suffix": over(lambda d: d.select("id", T.kks_suffix(F.col("kks")).alias("s")).filter("s is not null").select("id", "s.tag", "s.tail"), "connections"),
    "txt19_repair_encoding": over(damaged, "captions"),
    "txt20_readability": per_caption(score=lambda c: F.round(T.readability(c), 6)),
    "txt21_classify_label": per_caption(label=T.classify_label),
    "txt25_json_candidate": raw("conversations", lambda d: answers(d).select("conv_id", "turn", T.json_candidate(F.col("answer")).alias("json"))),
    "txt26_number_set": raw("conversations", lambda d: answers(d).select("conv_id", "turn", joined(T.parse_number_set(F.col("answer"))).alias("numbers"))),
    "txt29_safe_name": per_caption(name=lambda c: T.safe_name(c, 12)),
}
NUMBERS = """case conv_id % 4 when 0 then list_sort(list_distinct([turn::varchar, '12'])) when 1 then list_sort(list_distinct(['7', turn::varchar])) when 2 then list_sort(list_distinct([turn::varchar, '12'])) else [] end"""
SQL = {
    "txt1_fold": f"select id, {S.fold('caption')} as key from captions",
    "txt2_fold_designator": f"select id, {S.fold_designator('caption')} as key from captions",
    "txt10_to_number": "select id, try_cast(replace(regexp_extract(caption, '[0-9][0-9,.]*'), ',', '.') as double) as number from captions",
    "txt11_clean": "select id, nullif(trim(regexp_replace(caption, '\\s+', ' ', 'g')), '') as text from captions",
    "txt14_norm_title": "select id, translate(lower(trim(regexp_replace(caption, '\\s+', ' ', 'g'))), 'ё', 'е') as title from captions",
    "txt23_cross_refs": "select document, ord, regexp_extract(text, '(\\d+)[.:]', 1)::int as sheet, regexp_extract(text, '[.:](\\d+)', 1)::int as \"column\", regexp_extract(text, '([A-F])\\)?$', 1) as zone from sheet_texts where entity_type = 'cross_ref'",
    "txt24_severity_rank": "select severity, count(*) as n, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 9 end as rank from finding_rows group by severity",
    "txt27_approx_tokens": "select conv_id, turn, greatest(1, round_even(length(coalesce(text, '')) / 4, 0))::bigint as tokens from conversations",
    "txt28_clip_text": "select conv_id, turn, case when length(text) > 20 then concat(text[1:20], '...') else text end as clipped from conversations",
    "txt3_to_cyrillic": "select id, case when regexp_matches(caption, '[А-яЁё]') then translate(caption, 'ABEKMHOPCTYX', 'АВЕКМНОРСТУХ') else caption end as fixed from captions",
    "txt4_text_tokens": f"select id, array_to_string(list_sort({S.text_tokens('caption')}), '|') as tokens from captions",
    "txt5_article_tokens": f"select id, array_to_string(list_sort({S.article_tokens('caption')}), '|') as tokens from captions",
    "txt6_characteristics": f"""with found as (select id, unnest(regexp_extract_all(caption, '(?i)(?:^|[^\\wА-Яа-я,.])(\\d{{1,4}}(?:[.,]\\d{{1,3}})?\\s*(?:{UNIT_PATTERN}))\\s*(?:AC/DC|DC/AC|AC|DC)?(?:$|[^\\wА-Яа-я])', 1)) as m from captions),
 parts as (select id, replace(regexp_extract(m, '^[0-9.,]+'), ',', '.')::double as v, lower(trim(regexp_replace(m, '^[0-9.,]+', ''))) as u from found)
 select distinct id, case u {UNITS} end as quantity, round(v * case u {FACTORS} end, 4)::double as value from parts""",
    "txt7_project_number": "select id, nullif(regexp_extract(caption, '^\\s*(\\d{2,3}(\\.\\d{2,4})+)', 1), '') as number from captions",
    "txt8_exclusions": f"select id, regexp_matches(caption, {S.IEC}) as terminal, regexp_matches(caption, {S.CHANNEL}) as channel, regexp_matches(caption, {S.VOLTAGE}) as voltage from captions",
    "txt9_parse_designators": """select id, case form when 0 then array_to_string(list_transform(range(k + 1, k + 5), lambda i: concat('K', i)), '|') when 1 then concat('XT', k, '|XT', k + 1)
 when 2 then array_to_string(list_transform(range(1, 5), lambda i: concat(i, 'KL', k)), '|') when 3 then concat('K', k, '-K', k + 1) when 4 then concat('A', k, '|B', k + 3) else '' end as designators from position_cells""",
    "txt12_cell_errors": "select id, regexp_matches(trim(caption), '^#(REF|VALUE|DIV/0|N/A|NAME\\?|NUM|NULL)!?$', 'i') as broken from captions",
    "txt13_detect_cabinet": f"""with words as (select id, caption, list_filter(regexp_extract_all(regexp_replace(caption, '[^А-ЯЁA-Zа-яёa-z0-9_-]', '  ', 'g'), '(?:^|[^А-ЯЁA-Zа-яёa-z0-9_-])([А-ЯЁA-Z]{{2,7}}[0-9]{{0,2}})(?:$|[^А-ЯЁA-Zа-яёa-z0-9_-])', 1), lambda w: w not in ({WORDS(T.NOT_CABINETS)})) as w,
 nullif(regexp_extract(caption, '\\(\\s*([А-ЯЁA-Z]{{2,7}}[0-9]{{0,2}})\\s*\\)', 1), '') as inside from captions),
 picked as (select id, coalesce(inside, w[-1]) as c from words) select id, case when regexp_matches(c, '[А-яЁё]') then translate(c, 'ABEKMHOPCTYX', 'АВЕКМНОРСТУХ') else c end as cabinet from picked""",
    "txt15_title_junk": f"select id, regexp_matches(caption, {TITLE_JUNK}) as junk from captions",
    "txt16_function_codes": "select id, array_to_string(list_sort(list_distinct(regexp_extract_all(caption, '\\b([A-Z]{2,4}\\d{3})\\b', 1))), '|') as codes from captions",
    "txt17_join_fragments": "select id, case when regexp_matches(trim(caption), '[a-zA-Zа-яА-Я]-$') then concat(regexp_replace(trim(caption), '-$', ''), 'ство изделий') when trim(caption) = '' then 'ство изделий' else concat(trim(regexp_replace(caption, '\\s+', ' ', 'g')), ' ство изделий') end as joined from captions",
    "txt18_kks_suffix": "select id, regexp_extract(kks, '^(00[A-Z]{2,4}\\d{2}[A-Z]{2}\\d{3})(.+)$', 1) as tag, regexp_extract(kks, '^(00[A-Z]{2,4}\\d{2}[A-Z]{2}\\d{3})(.+)$', 2) as tail from connections where regexp_matches(kks, '^(00[A-Z]{2,4}\\d{2}[A-Z]{2}\\d{3})(.+)$')",
    "txt19_repair_encoding": "select id, regexp_matches(caption, '[А-Яа-яЁё…]') as was_broken, caption as repaired from captions",
    "txt20_readability": """with n as (select id, length(caption) as n, length(regexp_replace(caption, '[^\\s]', '', 'g')) as sp, length(regexp_replace(caption, '[^0-9A-Za-zЀ-ӿ]', '', 'g')) as good,
 length(regexp_replace(caption, '[^,.:;/()№²%+''"±≤≥×÷_-]', '', 'g')) as p from captions) select id, round((0.4 * sp + good + 0.6 * p - 0.3 * (n - sp - good - p)) / n, 6)::double as score from n""",
    "txt21_classify_label": f"""select id, case when trim(caption) = '' then 'empty' when lower(trim(caption)) in ({WORDS(T.FRAME_WORDS)}) then 'frame' when regexp_matches(trim(caption), '^\\d{{3}}\\.\\d{{3}}(\\.\\d{{2}})*\\s*-\\s*[А-ЯA-Z]{{2,4}}') then 'doc_number'
 when lower(trim(caption)) in ({WORDS(T.PIN_WORDS)}) then 'pin_label' when regexp_matches(trim(caption), '^\\d+([.,]\\d+)?\\s*[xх×]\\s*\\d+', 'i') or regexp_matches(trim(caption), '^[-+]?\\d+([.,]\\d+)?\\s*(мм|см|м|кг|г|А|A|В|V|Вт|W|°C|°|мА|Гц|Ом)\\.?$', 'i') then 'dimension'
 when regexp_matches(trim(caption), '^C?\\d+([.,]\\d+)?\\s*[AА](/\\d+\\s*мА)?$', 'i') then 'rating' when regexp_matches(caption, '[А-Яа-яЁё]') then 'note' when regexp_matches(trim(caption), '^\\d{{5,}}$') then 'article' when regexp_matches(trim(caption), '^[.,]*\\d[\\d.,]*$') then 'number'
 when length(trim(caption)) > 7 and regexp_matches(trim(caption), '^[A-Za-z0-9][A-Za-z0-9./-]*( [A-Za-z0-9./-]+)*$') then 'article' when length(trim(caption)) between 2 and 7 and regexp_matches(trim(caption), '^\\d{{0,2}}[A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9]*([.-][A-Za-zА-Яа-я0-9]+)*$') then 'designator'
 when regexp_matches(trim(caption), '^[A-Za-z0-9][A-Za-z0-9./-]*( [A-Za-z0-9./-]+)*$') then 'article' else 'other' end as label from captions""",
    "txt25_json_candidate": """select conv_id, turn, case conv_id % 4 when 0 then concat('{"same_line": ["', turn, '", " 12", "x", "12345"]}') when 1 then concat('{"numbers": ["7", "', turn, '"]}') when 2 then concat('{"same_line": ["', turn, '", " 12", "x", "12345"]}') else 'nothing at all' end as json from conversations""",
    "txt26_number_set": f"select conv_id, turn, array_to_string({NUMBERS}, '|') as numbers from conversations",
    "txt29_safe_name": """with f as (select id, trim(regexp_replace(regexp_replace(caption, '[<>:"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g'), ' .') as f from captions) select id, case when trim(f[1:12]) = '' then 'документ' else trim(f[1:12]) end as name from f""",
}
