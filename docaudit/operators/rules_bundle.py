"""The rules across the documents of a bundle, in full: equi joins and anti joins on (bundle, key).

orders: bundle, document, row_no, project_wide, designator, code, type_mark, name, note, one row for each designator of a
specification row. drawn: bundle, document, sheet, ord, designator, article, pair_source, label_text. marks: bundle, document,
sheet, designator, and scheme articles as bundle, article. Null texts count as empty.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .rules_cross import keyed, mass_captions

#: Designators that share a caption make it a mass caption; part of a bundle's designators that a whole project's specification has to list.
CAPTION, OVERLAP = 25, 0.05


def in_block(drawn: DataFrame) -> DataFrame:
    """Labels that certainly belong to their designator, without mass captions and ratings."""
    rows = drawn.filter("pair_source = 'block' and article <> ''")
    keyed_by = rows.withColumn("by_designator", T.fold_designator(F.col("designator")))
    captions = keyed_by.groupBy("bundle", "article").agg(F.countDistinct("by_designator").alias("n")).filter(F.col("n") >= CAPTION)
    return rows.join(captions.select("bundle", "article"), ["bundle", "article"], "left_anti").filter(~T.is_voltage(T.fold(F.col("article"))))


def words(*columns: str) -> Column:
    """Article tokens of all columns, and code and type mark as they are."""
    whole = F.filter(F.array(T.fold(F.col("code")), T.fold(F.col("type_mark"))), lambda x: x != "")
    return F.array_union(T.article_tokens(*map(F.col, columns)), whole)


def designation_mismatch(documents: DataFrame) -> DataFrame:
    """Bundles whose documents carry different project numbers: the number of most types, and the types with another one.

    documents: bundle, doc_type, ord, designation, project_wide. The first document of a type speaks for it; a specification of the
    whole project does not count; on a tie the number of the first of spec, assembly, scheme holds.
    """
    first = documents.groupBy("bundle", "doc_type").agg(F.min_by(F.struct("designation", "project_wide"), "ord").alias("d"))
    rank = F.array_position(F.array(*map(F.lit, ("spec", "assembly", "scheme"))), F.col("doc_type"))
    seen = first.select("bundle", "doc_type", rank.alias("rank"), T.project_number(F.col("d.designation")).alias("number"), "d.project_wide").filter("rank > 0 and number is not null and not (doc_type = 'spec' and project_wide)")
    per = seen.groupBy("bundle", "number").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("rank", "doc_type"))).alias("types"))
    best = per.groupBy("bundle").agg(F.max_by("number", F.struct("n", -F.col("rank"))).alias("majority"), F.count(F.lit(1)).alias("numbers"), F.flatten(F.collect_list(F.transform("types", lambda x: F.struct(x["rank"].alias("rank"), x["doc_type"].alias("doc_type"), F.col("number").alias("number"))))).alias("all"))
    odd = F.transform(F.filter(F.array_sort("all"), lambda x: x["number"] != F.col("majority")), lambda x: x["doc_type"])
    return best.filter("numbers > 1").select("bundle", "majority", F.array_join(odd, ",").alias("odd"), F.lit("high").alias("severity"))


def article_not_in_spec(orders: DataFrame, drawn: DataFrame) -> DataFrame:
    """In-block articles that no text of the bundle's specification names, unless all their designators are ordered."""
    vocabulary = orders.select("bundle", F.explode(words("code", "type_mark", "name", "note")).alias("token")).distinct()
    ordered = keyed(orders, T.fold_designator).select("bundle", "key", F.lit(True).alias("ordered")).distinct()
    rows = keyed(in_block(drawn), T.fold_designator).join(ordered, ["bundle", "key"], "left")
    per = rows.groupBy("bundle", "article").agg(
        F.countDistinct("designator").alias("designators"), F.min("sheet").alias("sheet"), F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("ordered", F.lit(False))).alias("all_ordered")
    )
    whole = T.fold(F.col("article"))
    per = per.filter(~F.col("all_ordered") & whole.rlike("[0-9]") & ~T.is_iec_terminal(whole))
    named = per.select("bundle", "article", F.explode(F.array_union(T.article_tokens(F.col("article")), F.array(whole))).alias("token")).join(vocabulary, ["bundle", "token"], "left_semi")
    with_spec = orders.select("bundle").distinct()
    return per.join(with_spec, "bundle", "left_semi").join(named.select("bundle", "article").distinct(), ["bundle", "article"], "left_anti").select("bundle", "article", "designators", "sheet", "n", F.lit("high").alias("severity"))


def designator_not_in_spec(orders: DataFrame, drawn: DataFrame, marks: DataFrame) -> DataFrame:
    """Drawn and on the scheme but not ordered; low if a name in the specification mentions it, else high."""
    k = lambda d: keyed(d, T.fold_designator)
    ordered = k(orders).select("bundle", "key").distinct()
    on_scheme = k(marks).groupBy("bundle", "key").agg(F.min("sheet").alias("scheme_sheet"))
    own = k(drawn).groupBy("bundle", "designator", "key").agg(F.min("sheet").alias("sheet")).join(on_scheme, ["bundle", "key"])
    # A specification of the whole project speaks for a bundle only if it lists enough of it.
    listed = own.select("bundle", "key").distinct().join(ordered.withColumn("listed", F.lit(1)), ["bundle", "key"], "left")
    share = listed.groupBy("bundle").agg((F.count("listed") < OVERLAP * F.count(F.lit(1))).alias("foreign"))
    gate = orders.groupBy("bundle").agg(F.bool_or("project_wide").alias("wide")).join(share, "bundle").filter("not (wide and foreign)").select("bundle")
    open_ = own.join(ordered, ["bundle", "key"], "left_anti").join(gate, "bundle", "left_semi").filter("key rlike '[0-9]$'").filter(~T.is_iec_terminal(F.col("key")) & ~T.is_plc_channel(F.col("key")))
    # Ranges and pairs whose parts are all ordered are no findings.
    parts = open_.filter(F.contains("key", F.lit("-"))).select("bundle", "key", F.explode(F.filter(F.split("key", "-"), lambda x: x != "")).alias("part")).distinct()
    lacking = parts.join(ordered.withColumnRenamed("key", "part"), ["bundle", "part"], "left_anti").select("bundle", "key").distinct()
    covered = parts.select("bundle", "key").distinct().join(lacking, ["bundle", "key"], "left_anti")
    named = orders.select("bundle", F.explode(T.text_tokens(F.col("name"))).alias("key"), F.lit(True).alias("named")).distinct()
    out = open_.join(covered, ["bundle", "key"], "left_anti").join(named, ["bundle", "key"], "left")
    return out.select("bundle", "designator", "sheet", "scheme_sheet", F.when(F.col("named"), "REVIEW").otherwise("MISSING").alias("kind"), F.when(F.col("named"), "low").otherwise("high").alias("severity"))


def article_mismatch(orders: DataFrame, drawn: DataFrame, marks: DataFrame) -> DataFrame:
    """One in-block article for an ordered designator, and no token of it in any of its specification rows."""
    a = keyed(in_block(drawn)).groupBy("bundle", "key").agg(F.countDistinct("article").alias("articles"), F.min_by(F.struct("designator", "article", "sheet"), "ord").alias("e")).filter("articles = 1")
    a = a.select("bundle", "key", "e.*").withColumn("own", F.when(F.size(T.article_tokens(F.col("article"))) > 0, T.article_tokens(F.col("article"))).otherwise(F.array(T.fold(F.col("article")))))
    coded = (F.coalesce("code", F.lit("")) != "") | (F.coalesce("type_mark", F.lit("")) != "")
    s = keyed(orders).groupBy("bundle", "key").agg(
        F.array_distinct(F.flatten(F.collect_list(words("code", "type_mark", "name")))).alias("tokens"), F.min_by(F.struct("row_no", "code", "type_mark", "note"), F.when(coded, F.col("row_no"))).alias("row")
    ).filter("row is not null")
    both = a.join(s, ["bundle", "key"]).filter(~F.arrays_overlap("own", "tokens") & ~F.array_contains("tokens", T.fold(F.col("article"))))
    on_scheme = marks.filter("article <> ''").select("bundle", T.fold(F.col("article")).alias("art"), F.lit(True).alias("on_scheme")).distinct()
    both = both.withColumn("art", T.fold(F.col("article"))).join(on_scheme, ["bundle", "art"], "left")
    noted = F.arrays_overlap(T.article_tokens(F.col("row.note")), F.col("own"))
    severity = F.when(noted, "low").when(F.col("on_scheme"), "high").otherwise("medium")
    return both.select("bundle", "designator", "article", "sheet", "row.row_no", F.coalesce("row.code", "row.type_mark").alias("ordered"), F.when(noted, "REVIEW").otherwise("MISMATCH").alias("kind"), severity.alias("severity"))


def characteristic_mismatch(orders: DataFrame, drawn: DataFrame) -> DataFrame:
    """Quantities (volts, amperes) of a designator for which its first specification row and its in-block labels share no value."""
    rows = drawn.filter("pair_source = 'block'")
    texts = F.filter(F.array("article", "label_text"), lambda x: x != "")
    long = keyed(rows).select("bundle", "key", "ord", "designator", F.explode(texts).alias("text"))
    many = mass_captions(long.withColumn("pair_source", F.lit("block")).withColumn("designator", T.fold_designator(F.col("designator"))), "text", CAPTION).select("bundle", "text")
    there = long.join(many, ["bundle", "text"], "left_anti").select("bundle", "key", F.explode(T.characteristics(F.col("text"))).alias("c")).select("bundle", "key", "c.*").distinct()
    here = keyed(orders.filter("not project_wide")).groupBy("bundle", "key").agg(F.min_by(F.struct("row_no", "name", "code"), "row_no").alias("row"))
    here = here.select("bundle", "key", "row.row_no", F.explode(T.characteristics(F.col("row.name"), F.col("row.code"))).alias("c")).select("bundle", "key", "row_no", "c.*")
    side = lambda d, name, *more: d.groupBy("bundle", "key", "quantity", *more).agg(F.array_sort(F.collect_set("value")).alias(name))
    both = side(here, "ordered", "row_no").join(side(there, "drawn"), ["bundle", "key", "quantity"]).filter(~F.arrays_overlap("ordered", "drawn"))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("decimal(20,4)").cast("string")), "|")
    return both.select("bundle", "key", "quantity", "row_no", show(F.col("ordered")).alias("ordered"), show(F.col("drawn")).alias("drawn"), F.lit("high").alias("severity"))


def check_bundle(orders: DataFrame, drawn: DataFrame, marks: DataFrame, documents: DataFrame, missing: DataFrame) -> DataFrame:
    """Findings of all rules across documents: bundle, rule, kind, severity, place; worst first.

    missing: the findings of the rule for what is ordered but not drawn (bundle, key, severity).
    """
    found = [
        ("designation", designation_mismatch(documents), F.lit("MISMATCH"), "majority"), ("article", article_mismatch(orders, drawn, marks), F.col("kind"), "designator"),
        ("characteristic", characteristic_mismatch(orders, drawn), F.lit("MISMATCH"), "key"), ("not ordered", article_not_in_spec(orders, drawn), F.lit("MISSING"), "article"),
        ("not in spec", designator_not_in_spec(orders, drawn, marks), F.col("kind"), "designator"), ("not drawn", missing, F.lit("REVIEW"), "key"),
    ]
    parts = [d.select("bundle", F.lit(name).alias("rule"), kind.alias("kind"), "severity", F.col(place).alias("place"), F.lit(i).alias("at")) for i, (name, d, kind, place) in enumerate(found)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.orderBy(T.severity_rank(F.col("severity")), "at", "bundle", "place").drop("at")


def on_one_side(rows: DataFrame, key: list[str], first: str, second: str) -> DataFrame:
    """Keys that come from one side alone: only_in, and the smallest document they are in. rows: the key, side, document."""
    per = rows.groupBy(*key).agg(F.min("side").alias("low"), F.max("side").alias("high"), F.min("document").alias("document")).filter("low = high")
    return per.select(*key, F.when(F.col("low") == 0, first).otherwise(second).alias("only_in"), "document", F.lit("REVIEW").alias("kind"))


def netlist_vs_scheme(connections: DataFrame, terminals: DataFrame, markings: DataFrame) -> DataFrame:
    """bundle, what, place, only_in, document, kind: terminals (block:pin) and wire markings that only the wiring tables or only the schemes of a bundle have, for review.

    connections: bundle, document, block, pin, marking; terminals: bundle, document, block, pin; markings: bundle, document, marking. Nulls and empty texts are no places.
    Both sides go into one grouping, after a partial one, so that no side is joined with the other.
    """
    terminal = F.concat(T.fold_designator(F.nullif(F.trim("block"), F.lit(""))), F.lit(":"), F.upper(F.nullif(F.trim("pin"), F.lit(""))))
    terminal = F.when((F.trim("block") != "") & (F.trim("pin") != ""), terminal)
    marking = F.nullif(T.fold(F.col("marking")), F.lit(""))
    of = lambda d, side, what, place: d.select("bundle", F.lit(what).alias("what"), place.alias("place"), F.lit(side).alias("side"), "document")
    rows = of(connections, 0, "terminal", terminal).unionByName(of(terminals, 1, "terminal", terminal)).unionByName(of(connections, 0, "marking", marking)).unionByName(of(markings, 1, "marking", marking))
    return on_one_side(rows.filter("place is not null"), ["bundle", "what", "place"], "table", "scheme")


def instrument_links(instruments: DataFrame, rows: DataFrame) -> DataFrame:
    """bundle, tag, only_in, document, kind: instruments that only the functional diagrams or only the cable journals and parameter lists of a bundle have, for review. Both: bundle, document, tag."""
    of = lambda d, side: d.select("bundle", T.fold_designator(F.col("tag")).alias("tag"), F.lit(side).alias("side"), "document").filter("tag <> ''")
    return on_one_side(of(instruments, 0).unionByName(of(rows, 1)), ["bundle", "tag"], "diagram", "journal")


def explode_positions(items: DataFrame) -> DataFrame:
    """bundle, key, row_no, designator: every designator of every specification row (bundle, row_no, position)."""
    return items.select("bundle", "row_no", F.explode(T.parse_designators(F.col("position"))).alias("designator")).select("bundle", T.fold(F.col("designator")).alias("key"), "row_no", "designator")


def scheme_facts(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per scheme its tags (document, key, first text, sheets), and in one row its articles, tokens and first document number.

    spans: document, sheet, ord, text, entity_type.
    """
    rows = spans.withColumn("t", F.trim("text")).filter("t <> ''")
    tags = rows.filter("entity_type in ('device_tag', 'instrument_tag')").groupBy("document", T.fold_designator(F.col("t")).alias("key")).agg(
        F.min_by("t", F.struct("sheet", "ord", "t")).alias("text"), F.array_sort(F.collect_set("sheet")).alias("sheets")
    )
    of = lambda kind: F.when(F.col("entity_type") == kind, F.col("t"))
    whole = rows.groupBy("document").agg(F.array_sort(F.collect_set(of("module_partno"))).alias("articles"), F.min_by(of("doc_number"), F.when(F.col("entity_type") == "doc_number", F.struct("sheet", "ord", "t"))).alias("designation"))
    tokens = rows.select("document", F.explode(T.text_tokens(F.col("t"))).alias("token")).groupBy("document").agg(F.countDistinct("token").alias("tokens"))
    return tags, whole.join(tokens, "document", "left")


def merge_documents(facts: DataFrame, order: DataFrame) -> DataFrame:
    """One view of several documents of a type: for each bundle and key what the first document says that has it; nothing is mixed.

    facts: bundle, document, key and more; order: document, rank (the main document first).
    """
    w = Window.partitionBy("bundle", "key").orderBy("rank", "document")
    return facts.join(order, "document").withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at", "rank")
