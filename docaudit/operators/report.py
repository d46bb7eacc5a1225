"""Findings: their structs, identity, union of sources, known errors, checks, order, counts and tables.

A finding has finding_id, kind, severity and refs, an array of at most three structs with REF_FIELDS; type, scope, finding,
action and evidence where a function says so.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SEVERITIES, severity_rank

# The fields of a place, those that make its identity, those that a known error may give; kinds, scopes, document types.
REF_FIELDS = {
    "document": "string", "doc_type": "string", "source_file": "string", "sheet": "int", "row": "int", "cabinet": "string", "terminal_block": "string", "pin": "string", "terminal_type": "string",
    "marking": "string", "kks": "string", "conductor": "string", "designator": "string", "article": "string", "name": "string", "quantity": "double", "found": "string",
}
IDENTITY = ["document", "terminal_block", "pin", "kks", "designator", "article"]
KNOWN_FIELDS = ["document", "doc_type", "sheet", "row", "cabinet", "terminal_block", "pin", "kks", "marking", "conductor", "designator", "article"]
COMPARED = ["document", "doc_type", "sheet", "row", "terminal_block", "pin", "kks", "designator", "article"]
KINDS = ["MISMATCH", "MISSING", "REVIEW", "DUPLICATE", "BROKEN_LINK", "FORMAT", "INCOMPLETE"]
SCOPES = ["cross_document", "single_document"]
DOC_TYPES = ["netlist", "scheme", "assembly", "spec", "functional"]
#: Known errors up to this size are broadcast; a ref of one counts for its place and so many bytes. It changes no result.
KNOWN_BYTES, ROW_BYTES = 32 << 20, 64
#: Lengths of the grams by which texts are looked up: a key has the longest one that it can fill. It changes no result.
GRAMS = (5, 3, 2)


def make_ref(**fields: Column) -> Column:
    """A place with all REF_FIELDS; absent ones are null, unknown ones an error."""
    unknown = fields.keys() - REF_FIELDS.keys()
    if unknown:
        raise ValueError(f"no fields of a place: {sorted(unknown)}")
    return F.struct(*[(fields[f] if f in fields else F.lit(None)).cast(kind).alias(f) for f, kind in REF_FIELDS.items()])


def make_finding(kind: str, severity: str, type_: str, refs: list[Column], finding: Column, action: Column, evidence: Column | None = None, scope: str = "single_document") -> list[Column]:
    """Columns of a finding; no more than three places are kept."""
    texts = {"finding": finding, "action": action, "evidence": F.lit(None) if evidence is None else evidence}
    return [
        F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), F.lit(severity).alias("severity"), F.lit(type_).alias("type"),
        F.slice(F.array(*refs), 1, 3).alias("refs"), *[c.cast("string").alias(n) for n, c in texts.items()],
    ]


def place(r: Column, fields: list[str]) -> Column:
    """A place as a text that tells null from empty."""
    return F.concat_ws("|", *[F.when(r[f].isNull(), "").otherwise(F.concat(F.lit("="), r[f].cast("string"))) for f in fields])


def signature() -> Column:
    """Kind and the set of places, whatever their order."""
    return F.concat_ws(";", F.col("kind"), F.array_sort(F.array_distinct(F.transform("refs", lambda r: place(r, IDENTITY)))))


def combine(by_rule: DataFrame, by_agent: DataFrame) -> DataFrame:
    """All findings of rules, and those of agents at places where no rule found the same; agents' are not compared among themselves."""
    rules, agents = (d.withColumn("signature", signature()) for d in (by_rule, by_agent))
    return rules.unionByName(agents.join(rules.select("signature").distinct(), "signature", "left_anti"))


def known_hits(findings: DataFrame, known: DataFrame) -> DataFrame:
    """finding_id, known_id of every record that covers a finding.

    A record has known_id, kind, type, scope and refs; null or empty fields say nothing. It covers a finding of
    its kind, type and scope if each of its refs agrees with some ref of the finding in all fields it gives, compared as texts. Records
    without refs cover nothing.

    A choice of fields is a mask, a bit for each field, so there are 2^15 of them at most. A finding's ref is offered once for
    each mask of the records whose fields it has, and joined by equality. Records are written by hand and few: up to
    KNOWN_BYTES they are broadcast, so that nothing but hits is shuffled; beyond that both sides are.
    """
    head = ["kind", "type", "scope"]
    mark = "\x01"
    given = lambda c: F.nullif(c.cast("string"), F.lit(""))
    fields = [F.col(h) for h in head] + [F.col("r")[f] for f in KNOWN_FIELDS]
    mask_of = lambda values: sum((F.when(v.isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(values)), F.lit(0))
    place_of = lambda values, mask: F.concat_ws(mark, *[F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, v).otherwise("") for i, v in enumerate(values)])
    values = [given(c) for c in fields]
    wanted = known.select("known_id", *head, F.posexplode("refs").alias("pos", "r"))
    wanted = wanted.select("known_id", "pos", mask_of(values).alias("mask"), F.concat_ws(mark, *[F.coalesce(v, F.lit("")) for v in values]).alias("place"))
    # One row comes to the driver: the masks, and the size of the records.
    of_known = wanted.agg(F.array_sort(F.collect_set("mask")).alias("masks"), F.sum(F.octet_length("place") + ROW_BYTES).alias("bytes")).first()
    needed = wanted.groupBy("known_id").agg(F.count(F.lit(1)).alias("needed"))
    own = findings.select("finding_id", *head, F.explode("refs").alias("r")).select("finding_id", *[v.alias(f"v{i}") for i, v in enumerate(values)])
    values = [F.col(f"v{i}") for i in range(len(fields))]
    masks = F.split(F.lit(",".join(map(str, of_known.masks)) or None), ",").cast("array<int>")
    offered = own.withColumn("own", mask_of(values)).withColumn("mask", F.explode(F.filter(masks, lambda m: m.bitwiseAND(F.col("own")) == m)))
    offered = offered.select("finding_id", "mask", place_of(values, F.col("mask")).alias("place"))
    few = (of_known.bytes or 0) <= KNOWN_BYTES
    met = offered.join(F.broadcast(wanted) if few else wanted, ["mask", "place"]).groupBy("finding_id", "known_id").agg(F.countDistinct("pos").alias("met"))
    return met.join(F.broadcast(needed) if few else needed, "known_id").filter("met = needed").select("finding_id", "known_id")


def suppress_known(findings: DataFrame, known: DataFrame) -> DataFrame:
    return findings.join(known_hits(findings, known).select("finding_id").distinct(), "finding_id", "left_anti")


def unused_known(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Records that suppressed nothing; a finding counts for the first record that covers it."""
    first = known_hits(findings, known).groupBy("finding_id").agg(F.min("known_id").alias("known_id"))
    return known.join(first.select("known_id").distinct(), "known_id", "left_anti")


def merge_reports(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two reports (bundle, finding_id, kind, severity, refs, finding) as one: a record for each set of places of a bundle.

    The record with more filled fields speaks; its empty fields are filled from the other. Where the two differ in kind or
    severity, the more severe one is lowered by a step, as they do not agree. Nothing is merged across bundles.
    """
    places = F.array_join(F.array_sort(F.array_distinct(F.transform("refs", lambda r: place(r, IDENTITY)))), ";")
    full = F.aggregate("refs", F.lit(0), lambda n, r: n + sum((F.when(r[f].isNull(), 0).otherwise(1) for f in REF_FIELDS), F.lit(0)))
    side = lambda d, n: d.withColumn("place", places).withColumn("full", full).groupBy("bundle", "place").agg(F.max_by(F.struct("finding_id", "kind", "severity", "refs", "finding", "full"), F.struct("full", F.length("finding"), "finding_id")).alias(n))
    both = side(one, "a").join(side(two, "b"), ["bundle", "place"], "full_outer")
    differ = (F.col("a.kind") != F.col("b.kind")) | (F.col("a.severity") != F.col("b.severity"))
    b_leads = F.coalesce(F.col("b.full") > F.col("a.full"), F.col("a").isNull())
    lead = lambda f: F.when(b_leads, F.col(f"b.{f}")).otherwise(F.col(f"a.{f}"))
    worst = F.least(severity_rank(F.coalesce("a.severity", F.lit("?"))), severity_rank(F.coalesce("b.severity", F.lit("?"))))
    lowered = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(worst + F.when(differ, 1).otherwise(0), F.lit(len(SEVERITIES) - 1)) + 1)
    fuller = F.when(F.length(F.coalesce("b.finding", F.lit(""))) > F.length(F.coalesce("a.finding", F.lit(""))), F.col("b.finding")).otherwise(F.coalesce("a.finding", "b.finding"))
    rows = both.select(
        "bundle", "place", lead("kind").alias("kind"), lowered.alias("severity"), lead("refs").alias("refs"), fuller.alias("finding"), F.coalesce(differ, F.lit(False)).alias("disputed"),
        F.col("a.refs").alias("a_refs"), F.col("b.refs").alias("b_refs"),
    )
    same = lambda r, o: place(r, IDENTITY) == place(o, IDENTITY)
    pick = lambda r, xs, f: F.get(F.transform(F.filter(F.coalesce(xs, F.array().cast(rows.schema["refs"].dataType)), lambda o: same(r, o) & o[f].isNotNull()), lambda o: o[f]), F.lit(0))
    union = F.transform("refs", lambda r: F.struct(*[F.coalesce(r[f], pick(r, F.col("a_refs"), f), pick(r, F.col("b_refs"), f)).alias(f) for f in REF_FIELDS]))
    return rows.withColumn("refs", union).drop("a_refs", "b_refs")


def validate(findings: DataFrame) -> DataFrame:
    """``errors``: what is wrong with each finding; it is valid when there is nothing."""
    listed = lambda c, values: c.isNull() | ~c.isin(values)
    n = F.size("refs")
    checks = [
        (listed(F.col("kind"), KINDS), "kind"), (listed(F.col("severity"), SEVERITIES), "severity"), (listed(F.col("scope"), SCOPES), "scope"), (F.col("type").isNull(), "type"),
        (F.col("refs").isNull() | (n < 1) | (n > 3), "refs"), (F.exists("refs", lambda r: r["document"].isNull()), "refs.document"), (F.exists("refs", lambda r: listed(r["doc_type"], DOC_TYPES)), "refs.doc_type"),
        (F.col("finding").isNull(), "finding"), (F.col("action").isNull(), "action"),
    ]
    return findings.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in checks])))


def severity_sort(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "finding_id")


def report_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def report_totals(findings: DataFrame) -> DataFrame:
    """by, value, n: totals by severity in their order and by kind, most frequent first; ``at`` is the place in the list."""
    by_kind = findings.groupBy(F.col("kind").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1)
    by_severity = findings.groupBy(F.col("severity").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("at", severity_rank(F.col("value")))
    return by_kind.select(F.lit("kind").alias("by"), "value", "n", "at").unionByName(by_severity.select(F.lit("severity").alias("by"), "value", "n", "at"))


def about_elements() -> Column:
    """Whether a finding has a place in a specification or drawing."""
    return F.exists("refs", lambda r: r["doc_type"].isin("spec", "assembly"))


def pivoted(findings: DataFrame, doc_types: list[str], fields: list[str]) -> DataFrame:
    """finding_id, kind, severity, and the given fields of the first place in each type of document."""
    first = lambda t: F.get(F.filter("refs", lambda r: r["doc_type"] == t), F.lit(0))
    return findings.select("finding_id", "kind", "severity", *[first(t)[f].cast("string").alias(f"{t}_{f}") for t in doc_types for f in fields])


def bundle_table(findings: DataFrame) -> DataFrame:
    """Findings about elements, with their places in specification, drawing and scheme side by side."""
    return pivoted(findings.filter(about_elements()), ["spec", "assembly", "scheme"], ["sheet", "row", "designator", "article"])


def wiring_table(findings: DataFrame) -> DataFrame:
    """The other findings, with their places in wiring table and scheme side by side."""
    return pivoted(findings.filter(~about_elements()), ["netlist", "scheme"], ["sheet", "row", "cabinet", "terminal_block", "pin", "marking", "kks", "conductor"])


def fragment_targets(findings: DataFrame) -> DataFrame:
    """finding_id, pos, document, doc_type, sheet, keys: where to look for each place, from the exact key to the general one; equal targets once."""
    keys = lambda r: F.filter(F.array(*[r[k] for k in ("article", "designator", "marking", "kks", "terminal_block")]), lambda k: k != "")
    rows = findings.select("finding_id", F.posexplode("refs").alias("pos", "r")).filter("r.doc_type in ('scheme', 'assembly', 'netlist') and r.document <> ''")
    rows = rows.select("finding_id", "pos", "r.document", "r.doc_type", "r.sheet", keys(F.col("r")).alias("keys")).filter(F.size("keys") > 0)
    same = Window.partitionBy("finding_id", "document", "sheet", F.get("keys", F.lit(0))).orderBy("pos", "keys", "doc_type")
    return rows.withColumn("again", F.row_number().over(same)).filter("again = 1").drop("again")


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def holding(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """document, sheet, key, n: the keys wanted in a document (two characters or more) and its texts that hold them, equal texts of a sheet as one row with their number.

    An inverted index of grams: a key is looked up under the one of its grams that fewest texts of the document have, and
    compared with those texts alone. Grams that no key has are left out of the index.
    """
    texts = spans.groupBy("document", "sheet", "text").agg(F.count(F.lit(1)).alias("n"))
    size = reduce(lambda w, n: w.when(F.length("key") >= n, n), GRAMS[1:], F.when(F.length("key") >= GRAMS[0], GRAMS[0]))
    at_size = lambda c: F.flatten(F.array(*[F.when(F.length(c) >= n, grams(F.col(c), n)).otherwise(F.array().cast("array<string>")) for n in GRAMS]))
    of_key = F.filter(at_size("key"), lambda g: F.length(g) == size)
    key_grams = wanted.select("document", "key", F.explode(of_key).alias("gram"))
    asked = key_grams.select("document", "gram").distinct()
    index = texts.select("document", "sheet", "text", "n", F.explode(at_size("text")).alias("gram"))
    common = index.groupBy("document", "gram").agg(F.count(F.lit(1)).alias("texts")).join(asked, ["document", "gram"], "left_semi")
    by = key_grams.join(common, ["document", "gram"]).groupBy("document", "key").agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"))
    return index.join(by, ["document", "gram"]).filter(F.contains("text", F.col("key"))).select("document", "sheet", "key", "n")


def locate(targets: DataFrame, spans: DataFrame, useful: int = 12) -> DataFrame:
    """The sheet and key that show a target best: finding_id, pos, sheet, key, hits, fallback.

    The sheet that the finding names comes first, then the others in order. On a sheet the first key with at most ``useful`` hits
    counts, else the one with fewest; ``fallback`` says that it is another sheet than the named one.
    spans: document, sheet, text. Keys of one character are left out; a hit is a span that holds the key.
    """
    keys = targets.select("finding_id", "pos", "document", F.col("sheet").alias("named"), F.posexplode("keys").alias("rank", "key")).withColumn("key", F.trim("key")).filter(F.length("key") >= 2)
    wanted = keys.select("document", "key").distinct()
    hits = holding(spans, wanted).groupBy("document", "sheet", "key").agg(F.sum("n").alias("hits"))
    found = keys.join(hits, ["document", "key"])
    order = [(F.col("sheet") != F.coalesce(F.col("named"), F.lit(-1))), F.col("sheet"), F.col("hits") > useful, F.when(F.col("hits") > useful, F.col("hits")).otherwise(F.col("rank")), F.col("rank"), F.col("key")]
    best = found.groupBy("finding_id", "pos").agg(F.min_by(F.struct("sheet", "key", "hits", F.coalesce(F.col("sheet") != F.col("named"), F.lit(True)).alias("fallback")), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("b"))
    return best.select("finding_id", "pos", "b.*")


def baseline_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """identity, n, change: findings that appeared and those that vanished, equal ones as often as they are too many.

    The identity has kind, severity, type and the places in order, with all fields that are compared.
    """
    own = F.concat_ws(";", F.col("kind"), F.col("severity"), F.col("type"), F.transform("refs", lambda r: place(r, COMPARED)))
    a, e = (d.groupBy(own.alias("identity")).agg(F.count(F.lit(1)).alias(n)) for d, n in ((actual, "a"), (expected, "e")))
    both = a.join(e, "identity", "full_outer").withColumn("more", F.coalesce("a", F.lit(0)) - F.coalesce("e", F.lit(0))).filter("more <> 0")
    return both.select("identity", F.abs("more").alias("n"), F.when(F.col("more") > 0, "appeared").otherwise("vanished").alias("change"))


def extraction_report(documents: DataFrame, skipped: DataFrame) -> DataFrame:
    """status, n, errors: documents by status (ok, partial, failed) and skipped files."""
    done = documents.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("errors")).cast("long").alias("errors"))
    left = skipped.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("skipped").alias("status"), "n", F.lit(0).cast("long").alias("errors"))
    return done.unionByName(left)
