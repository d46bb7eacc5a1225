"""Rules over one table; each returns its findings as rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T

RESERVE = "резерв"  # fixed value: the word that marks a spare row
# Rules by type of document, and of wiring tables by their kind; those that suit the specification of one cabinet alone.
RULES = {"scheme": ["broken_sheet_link", "one_way_sheet_link", "dup_address_on_sheet", "dup_relay_coil"], "spec": ["cell_errors", "qty_below_positions", "dup_code"], "assembly": ["missing_from_peer_sheet"]}
TABLE_RULES = {
    "gost_connections": ["dup_terminal_address", "tag_in_conductor", "kks_suffix_artifact", "missing_terminal", "reserve_tag_placement"],
    "signal_list": ["dup_signal_channel"], "cable_journal": ["dup_cable"], "param_list": [],
}
ONE_CABINET_ONLY = ["dup_code"]


def is_reserve(kks):
    return F.coalesce(F.lower(F.trim(kks)) == RESERVE, F.lit(False))


def duplicates(rows: DataFrame, by: list[str], id_col: str, extra: list | None = None) -> DataFrame:
    """Groups of two or more rows: the keys, n, and the ids of the first two.

    Each part of the table hands on two rows of a group at most, and a count, so that a large group stays small on its way.
    """
    rows = rows.filter(" and ".join(f"{c} is not null and {c} <> ''" for c in by))
    two = rows.select(*by, id_col, *(extra or [])).withColumn("at", F.row_number().over(W.Window.partitionBy(*by).orderBy(id_col))).filter("at <= 2")
    two = two.groupBy(*by).agg(F.min(id_col).alias("first_id"), F.max(id_col).alias("second_id"), F.max("at").alias("many"), *[F.min_by(c, "at").alias(c) for c in extra or []])
    return two.filter("many = 2").join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)


def dup_terminal_address(connections: DataFrame) -> DataFrame:
    """Terminal addresses met in two rows or more; medium when the first row's pin is PE."""
    rows = connections.withColumn("terminal_address", F.expr("cabinet || '.' || terminal_block || '.' || pin"))
    out = duplicates(rows, ["document", "terminal_address"], "id", ["pin"])
    return out.select("document", "terminal_address", "n", "first_id", "second_id", F.when(F.upper("pin") == "PE", "medium").otherwise("high").alias("severity"))


def dup_in_table(connections: DataFrame, kind: str, column: str) -> DataFrame:
    out = duplicates(connections.filter(F.col("table_kind") == kind), ["document", column], "id")
    return out.select("document", column, "n", "first_id", "second_id", F.lit("high").alias("severity"))


def dup_signal_channel(connections: DataFrame) -> DataFrame:
    """Channels that a signal list names in two rows or more."""
    return dup_in_table(connections, "signal_list", "connection_address")


def dup_cable(connections: DataFrame) -> DataFrame:
    """Cables that a cable journal names in two rows or more."""
    return dup_in_table(connections, "cable_journal", "cable_harness")


def cell_errors(cells: DataFrame) -> DataFrame:
    """Cells that hold a spreadsheet's error value."""
    return cells.filter(T.is_cell_error(F.col("value"))).select("document", "row", "cell", "value", F.lit("FORMAT").alias("kind"))


def tag_in_conductor(connections: DataFrame) -> DataFrame:
    return connections.filter("kks = conductor and kks <> ''").select("document", "id", "kks")


def kks_suffix_artifact(connections: DataFrame) -> DataFrame:
    return connections.select("document", "id", T.kks_suffix(F.col("kks")).alias("s")).filter("s is not null").select("document", "id", "s.tag", "s.tail")


def missing_terminal(connections: DataFrame) -> DataFrame:
    """Rows that are no spares and have an owner, by tag or by the circuit's marking, but lack a block or a pin."""
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    owner = F.coalesce(*[F.when(~empty(c), F.col(c)) for c in ("kks", "circuit_marking")])
    spare = F.coalesce(is_reserve(F.col("kks")), F.lit(False))
    return connections.filter(~spare & owner.isNotNull() & (empty("terminal_block") | empty("pin"))).select("document", "id", owner.alias("owner"))


def reserve_tag_placement(connections: DataFrame, channel_column: str = "conductor", shown: int = 15) -> DataFrame:
    """One row per document: spare rows that carry a channel name, with the first ids."""
    rows = connections.filter(is_reserve(F.col("kks")) & F.col(channel_column).rlike(T.CHANNEL_TAG))
    w = W.Window.partitionBy("document").orderBy("id")
    first = rows.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= shown)
    ids = first.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    counts = rows.groupBy("document").agg(F.count(F.lit(1)).alias("n")).join(ids, "document")
    return counts.select("document", "n", F.when(F.col("n") > shown, F.concat("ids", F.lit("..."))).otherwise(F.col("ids")).alias("ids"))


def qty_below_positions(spec_items: DataFrame) -> DataFrame:
    return spec_items.filter("quantity > 1 and n_positions >= 2 and quantity < n_positions").select("document", "row_no", "quantity", "n_positions")


def dup_code(spec_items: DataFrame, project_wide: DataFrame | None = None) -> DataFrame:
    """Codes in two rows or more; specifications of a whole project (document) are left out, as there cabinets have rows of their own."""
    if project_wide is not None:
        spec_items = spec_items.join(project_wide, "document", "left_anti")
    return duplicates(spec_items.filter("code <> ''"), ["document", "code"], "row_no").select("document", "code", "n", "first_id", "second_id")


def missing_from_peer_sheet(elements: DataFrame, shared: int = 8, most: int = 3, share: float = 0.9) -> DataFrame:
    """Designators of a sheet that an almost equal sheet of the document lacks.

    A peer lacks ``most`` designators at most, so it has one of any ``most`` + 1: only sheets that have one of a sheet's rarest ones
    in the document are compared with it.
    """
    d = elements.select("document", "sheet", "designator").distinct()
    own = W.Window.partitionBy("document", "sheet")
    often = d.groupBy("document", "designator").agg(F.count(F.lit(1)).alias("sheets"))
    ranked = d.join(often, ["document", "designator"], "left").withColumn("at", F.row_number().over(own.orderBy("sheets", "designator"))).withColumn("n", F.count(F.lit(1)).over(own))
    ranked = ranked.filter(f"n > {shared}").select("document", "sheet", "designator", "n", "at")
    sizes = d.groupBy("document", F.col("sheet").alias("peer")).agg(F.count(F.lit(1)).alias("peer_n"))
    other = d.select("document", F.col("sheet").alias("peer"), "designator")
    meeting = ranked.filter(f"at <= {most + 1}").join(other, ["document", "designator"]).filter("sheet <> peer").select("document", "sheet", "peer", "n").distinct()
    meeting = meeting.join(sizes, ["document", "peer"]).filter(f"peer_n >= greatest({shared}, n - {most})").select("document", "sheet", "peer")
    pairs = ranked.join(meeting, ["document", "sheet"]).join(other.withColumn("there", F.lit(1)), ["document", "peer", "designator"], "left")
    near = pairs.groupBy("document", "sheet", "peer", "n").agg(F.count("there").alias("both"), F.collect_list(F.when(F.col("there").isNull(), F.struct("designator"))).alias("lacking"))
    near = near.filter(f"both >= {shared} and n - both between 1 and {most} and both >= {share} * n")
    return near.select("document", "sheet", "peer", F.explode("lacking.designator").alias("designator"))


def broken_sheet_link(refs: DataFrame, sheets: DataFrame) -> DataFrame:
    """Links beyond the document's sheets. sheets: document, total."""
    return refs.join(sheets, "document").filter("target_sheet < 1 or target_sheet > total").select("document", "from_sheet", "target_sheet")


def one_way_sheet_link(refs: DataFrame, shown: int = 5) -> DataFrame:
    """Pairs of sheets without a link back: how many links, and the first texts of them."""
    rows = refs.filter("from_sheet <> target_sheet")
    back = rows.select("document", F.col("from_sheet").alias("target_sheet"), F.col("target_sheet").alias("from_sheet")).distinct()
    texts = rows.groupBy("document", "from_sheet", "target_sheet", "raw_text").agg(F.count(F.lit(1)).alias("n"))
    w = W.Window.partitionBy("document", "from_sheet", "target_sheet")
    texts = texts.withColumn("all", F.sum("n").over(w)).withColumn("at", F.row_number().over(w.orderBy("raw_text"))).filter(F.col("at") <= shown)
    pairs = texts.groupBy("document", "from_sheet", "target_sheet", F.col("all").alias("n")).agg(F.array_join(F.array_sort(F.collect_list("raw_text")), "|").alias("examples"))
    return pairs.join(back, ["document", "from_sheet", "target_sheet"], "left_anti")


def dup_address_on_sheet(addresses: DataFrame) -> DataFrame:
    """Addresses (block:pin) written several times on a sheet. Common pins do not count, nor blocks drawn again:
    those with two repeated addresses or more, common pins included. addresses: document, sheet, address, n."""
    block, pin = F.split_part("address", F.lit(":"), F.lit(1)), F.upper(F.trim(F.regexp_extract("address", ":(.*)$", 1)))
    same = W.Window.partitionBy("document", "sheet", "block")
    rows = addresses.withColumn("block", block).withColumn("together", F.size(F.collect_set("address").over(same)))
    return rows.filter((F.col("together") < 2) & ~pin.isin("N", "PE", "PEN")).select("document", "sheet", "address", "n", F.lit("high").alias("severity"))


def dup_relay_coil(coils: DataFrame) -> DataFrame:
    """Designators at two coils or more of a document."""
    per = coils.groupBy("document", "designator").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sheet").alias("sheets"), F.min("sheet").alias("first_sheet"))
    return per.filter("n >= 2").withColumn("severity", F.lit("high"))


def applicable(documents: DataFrame) -> DataFrame:
    """document, rule: the rules that read a document. documents: document, doc_type, table_kind, project_wide."""
    array = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    by = lambda c, table: F.coalesce(*[F.when(c == k, array(v)) for k, v in table.items()])
    wiring = F.coalesce(by(F.col("table_kind"), TABLE_RULES), array(TABLE_RULES["gost_connections"]))
    rules = F.when(F.col("doc_type") == "netlist", wiring).otherwise(by(F.col("doc_type"), RULES))
    rules = F.when(F.col("project_wide"), F.array_except(rules, array(ONE_CABINET_ONLY))).otherwise(rules)
    return documents.select("document", F.explode(rules).alias("rule"))


def spec_stats(spec_items: DataFrame) -> DataFrame:
    return spec_items.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("designator").alias("designators"), F.countDistinct("code").alias("codes"), F.count_if(F.coalesce(F.col("code"), F.lit("")) == "").alias("without_code"))


def assembly_stats(elements: DataFrame) -> DataFrame:
    return elements.groupBy("document", "designator").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sheet").alias("sheets"), F.countDistinct("article").alias("articles"), F.count_if(F.col("pair_source") == "block").alias("in_block"))


def column_population(connections: DataFrame) -> DataFrame:
    filled = [F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(f"n_{c}") for c in ("terminal_block", "pin", "kks", "conductor")]
    return connections.groupBy("document").agg(F.count(F.lit(1)).alias("n"), *filled, F.count_if(is_reserve(F.col("kks"))).alias("n_reserve"), F.countDistinct("terminal_block").alias("blocks"), F.max("page").alias("pages"))


# The fields of a wiring table.
FIELDS = ["cable_harness", "circuit_marking", "kks", "conductor", "cabinet", "terminal_block", "pin", "terminal_type_or_ref", "connection_address", "note"]


def table_stats(connections: DataFrame) -> DataFrame:
    """Per wiring table: rows, pages, filled cells by field (a map), its blocks and roles of conductors, spare rows, and how often each repeated address occurs (a map).

    Fields that the table lacks count as empty. A row is spare with the word anywhere in its tag or marking.
    """
    rows = connections.withColumns({c: F.lit(None).cast("string") for c in FIELDS if c not in connections.columns})
    filled = F.create_map(*[x for c in FIELDS for x in (F.lit(c), F.count_if(F.coalesce(F.col(c), F.lit("")) != ""))])
    some = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    spare = reduce(Column.__or__, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(RESERVE)) for c in ("kks", "circuit_marking")])
    stats = rows.groupBy("document").agg(
        F.count(F.lit(1)).alias("n"), F.max("page").alias("pages"), filled.alias("filled"), some("terminal_block").alias("blocks"), some("conductor").alias("roles"), F.count_if(spare).alias("reserve")
    )
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("cabinet", "terminal_block", "pin")]
    address = F.concat(parts[0], F.lit("."), parts[1], F.lit("."), parts[2])
    again = rows.select("document", address.alias("address")).filter("address is not null").groupBy("document", "address").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    again = again.groupBy("document").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("address", "k")))).alias("duplicate_addresses"))
    return stats.join(again, "document", "left").withColumn("duplicate_addresses", F.coalesce("duplicate_addresses", F.expr("cast(map() as map<string, bigint>)")))


def spec_sections(items: DataFrame) -> DataFrame:
    """Per specification: rows, rows with a position, different designators, rows without a code, codes of several rows."""
    per = items.groupBy("document").agg(
        F.count(F.lit(1)).alias("rows_"), F.count_if(F.col("designator") != "").alias("with_position"), F.countDistinct("designator").alias("designators"), F.count_if(F.coalesce("code", F.lit("")) == "").alias("without_code")
    )
    codes = items.filter("code <> ''").groupBy("document", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("document").agg(F.count_if(F.col("n") > 1).alias("duplicate_codes"))
    return per.join(codes, "document", "left").na.fill(0, ["duplicate_codes"])


def designator_index(labels: DataFrame) -> DataFrame:
    """Per designator of a drawing: labels, sheets, articles and how they were paired, each sorted and comma-joined."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",").alias(c)
    per = labels.groupBy("document", "designator").agg(F.count(F.lit(1)).alias("n"), listed("sheet"), listed("article"), listed("pair_source"))
    return per.withColumnsRenamed({"sheet": "sheets", "article": "articles", "pair_source": "sources"})


def pairing_totals(labels: DataFrame) -> DataFrame:
    """Per drawing: labels paired in a block, by nearness, and not at all."""
    of = lambda s: F.count_if(F.col("pair_source") == s)
    return labels.groupBy("document").agg(F.count(F.lit(1)).alias("n"), of("block").alias("in_block"), of("nearest").alias("nearest"), F.count_if(F.coalesce("article", F.lit("")) == "").alias("unpaired"))
