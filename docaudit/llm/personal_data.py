"""Personal data by base rules, and by contexts bootstrapped from what those rules find.

Candidates are words with a digit, ``@`` or ``_``, and numbers written in groups. A candidate that holds a span of the base rules is a
seed of that kind. The one and the two words before a candidate are its lexical patterns. Patterns and instances (distinct
candidates) form a graph, which Spark scores in rounds: a pattern's confidence in a kind is the share of its occurrences in the
corpus that introduce a candidate at all, times the trusted share of its distinct instances; patterns whose confidence reaches
``confidence`` lend it to their instances that are no seeds, and so raise other patterns. In the end a candidate behind such a
pattern that touches no base span is a ``context`` span.

Everything is DataFrame expressions; no Python runs on the executors. Texts are scanned twice: for spans and candidates, and
for the occurrences of patterns. All else works on candidates. Copies of a text add no instances, so they give a pattern no support.

Defined results: a null text counts as empty; documents without spans have counts of 0 and an empty list; repeated rows, and rows
without an id, each get their row; without seeds or with few of them no pattern is learned; an empty table gives no rows; extra columns are ignored.
A document's spans are one array, and their places come from sums over blocks, so that texts with very many spans stay near linear.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .quality_rules import let

#: Base kinds as the contract lists them. Spans sort by start, then by place in this list.
KINDS = ("email", "ip", "card", "phone", "context")
LOCAL, HOST, SPACE = "A-Za-z0-9._%+-", "A-Za-z0-9-", r"\x20\x09-\x0D"
#: A match begins where its first run of characters does, or where the last match ended, so no run is tried from each of its
#: characters; nothing that is matched has to be given back, so repeats are possessive and take no stack.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A number in groups, up to the end of a word; else a word with one of the telling characters.
CANDIDATE = (
    rf"(?<![^{SPACE}])(?:[(+]*+[0-9][0-9()./-]*+(?:\x20[(]?[0-9][0-9()./-]*+)*+[,;:!?]?+(?![^{SPACE}])|[^{SPACE}0-9@_]*+[0-9@_][^{SPACE}]*+)"
)
OPENING, CLOSING = r"""^["'<\[{]+""", r"""[.,;:!?"'>\]}]+$"""
BLOCK = 64


@dataclass(frozen=True)
class Bootstrap:
    """``support`` is the least trusted mass of distinct instances behind a pattern; ``prior`` counts as so many that are not trusted.

    Words of more than ``word`` code points are no patterns, shorter candidates than ``least`` no identifiers.
    """

    confidence: float = 0.5
    support: int = 3
    prior: float = 1.0
    rounds: int = 3
    word: int = 32
    least: int = 5
    broadcast: int = 100_000  # most patterns that are broadcast; more are joined by a shuffle


def running(numbers: Column) -> Column:
    """Sums of the numbers up to each place: within blocks, and over blocks."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    last = lambda x: F.floor((F.size(x) - 1) / BLOCK).cast("int")
    blocks = lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    step = lambda a, b: F.struct((a["sum"] + total(b)).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before"))
    within = lambda b, o: F.transform(b, lambda _, j: o + total(F.slice(b, F.lit(1), j + 1)))
    sums = lambda x: let(blocks(x), lambda b: let(F.aggregate(b, zero, step, lambda a: a["before"]), lambda o: F.flatten(F.zip_with(b, o, within))))
    return let(numbers, lambda x: F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(sums(x)))


def matches(text: Column, pattern: str, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(match, start, text between the match before and this one) for each match, left to right."""

    def placed(m: Column, between: Column) -> Column:
        steps = F.transform(m, lambda _, i: (F.length(F.get(between, i)) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0))).cast("long"))
        return let(running(steps), lambda s: F.transform(m, lambda x, i: make(x, F.get(s, i), F.get(between, i))))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: let(F.split(text, pattern, -1), lambda b: placed(m, b)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    n = F.length(digits)

    def step(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return a + F.when((n - i) % 2 == 1, doubled(d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return let(F.translate(match, " -", ""), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def telling(kind: str) -> str:
    """What a text with such a span contains, which is found faster."""
    return {"email": "@", "ip": ".", "card": "", "phone": "+"}[kind]


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, kind, end)."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,ok:boolean>>")
    make = lambda m, s, _: F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s + F.length(m)).alias("end"), valid(kind, m).alias("ok"))
    found = F.when(text.contains(telling(kind)), F.filter(matches(text, PATTERNS[kind], make), lambda x: x["ok"])).otherwise(none)
    return F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def seed_kind(token: Column) -> Column:
    """The first kind that has a span in the token, else null."""
    holds = lambda k: F.exists(F.regexp_extract_all(token, F.lit(PATTERNS[k]), 0), lambda m: valid(k, m))
    return F.coalesce(*[F.when(token.contains(telling(k)) & holds(k), F.lit(i)) for i, k in enumerate(KINDS[:4])], F.lit(None).cast("int"))


def candidates(text: Column, b: Bootstrap) -> Column:
    """Array of (start, end, instance, seed kind, patterns)."""

    def contexts(between: Column) -> Column:
        tail = F.lower(F.right(between, F.lit(2 * b.word + 8)))
        one, word = F.regexp_extract(tail, rf"(?<![^{SPACE}])([^{SPACE}]{{1,{b.word}}})[{SPACE}]+$", 1), rf"[^{SPACE}]{{1,{b.word}}}"
        two = F.regexp_replace(F.regexp_extract(tail, rf"(?<![^{SPACE}])({word}[{SPACE}]+{word})[{SPACE}]+$", 1), rf"[{SPACE}]+", " ")
        return F.filter(F.array(one, two), lambda p: p.rlike(r"\p{L}") & (F.element_at(F.split(p, " "), -1).rlike(r"\p{L}")))

    def make(m: Column, start: Column, between: Column) -> Column:
        opened = F.regexp_replace(m, OPENING, "")
        token = F.regexp_replace(opened, CLOSING, "")
        first = start + F.length(m) - F.length(opened)
        return let(
            F.struct(token.alias("token"), first.alias("start")),
            lambda t: F.struct(
                t["start"].alias("start"), (t["start"] + F.length(t["token"])).alias("end"), F.md5(F.lower(t["token"]).cast("binary")).alias("instance"),
                seed_kind(t["token"]).alias("seed"), contexts(between).alias("patterns"),
            ),
        )

    return F.filter(matches(text, CANDIDATE, make), lambda c: (c["end"] - c["start"] >= b.least) & (F.size(c["patterns"]) > 0))


def scanned(docs: DataFrame, id_col: str, text_col: str, b: Bootstrap) -> DataFrame:
    """row, doc_id, spans (of the base rules), candidates; a row is known by its number, as ids may repeat."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = F.array_sort(F.concat(*[base_spans(text, k) for k in KINDS[:4]]))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), spans.alias("spans"), candidates(text, b).alias("candidates"))


def within(rows: DataFrame, patterns: DataFrame, on: str, most: int, n: int) -> DataFrame:
    """Join with a table of ``n`` patterns, by broadcast while it has at most ``most`` rows."""
    return rows.join(F.broadcast(patterns) if n <= most else patterns, on)


def occurrences(docs: DataFrame, text_col: str, patterns: DataFrame, n: int, b: Bootstrap) -> DataFrame:
    """pattern, seen: how often each of the ``n`` patterns stands in the texts."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), f"[{SPACE}]+"), lambda w: w != "")
    pairs = let(words, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("last"), F.get(w, i - 1).alias("first"))))
    each = docs.select(F.explode(pairs).alias("w")).select("w.last", "w.first")
    last = cut(patterns.select(F.element_at(F.split("pattern", " "), -1).alias("last")).distinct())
    near = within(each, last, "last", b.broadcast, n)
    both = near.select(F.explode(F.array("last", F.concat_ws(" ", "first", "last"))).alias("pattern"))  # of the first word of a text both are the same
    both = both.filter(F.col("pattern").isNotNull())
    return within(both, patterns.select("pattern"), "pattern", b.broadcast, n).groupBy("pattern").agg(F.count(F.lit(1)).alias("seen"))


def confident(edges: DataFrame, patterns: DataFrame, lent: DataFrame | None, b: Bootstrap) -> DataFrame:
    """pattern, kind, confidence of the patterns that reach it. ``lent`` has instance, kind, trust of instances that are no seeds."""
    trust = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("mass"))
    if lent is not None:
        more = edges.filter("seed is null").join(lent, "instance").groupBy("pattern", "kind").agg(F.sum("trust").alias("mass"))
        trust = trust.unionByName(more).groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"))
    sure = F.least(F.col("used") / F.greatest("seen", "used"), F.lit(1.0)) * F.col("mass") / (F.col("instances") + b.prior)
    scored = trust.filter(F.col("mass") >= b.support).join(patterns, "pattern").withColumn("confidence", sure).filter(F.col("confidence") >= b.confidence)
    best = scored.groupBy("pattern").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
    return best.select("pattern", (-F.col("best")["col2"]).alias("kind"), F.col("best.confidence").alias("confidence"))


def lending(edges: DataFrame, sure: DataFrame, n: int, b: Bootstrap) -> DataFrame:
    """instance, kind, trust: the chance that not all of the confident patterns around an instance are wrong."""
    open_ = edges.filter("seed is null").select("pattern", "instance")
    wrong = F.sum(F.log(1 - F.least("confidence", F.lit(0.99))))
    return within(open_, sure, "pattern", b.broadcast, n).groupBy("instance", "kind").agg((1 - F.exp(wrong)).alias("trust"))


def bootstrapped(docs: DataFrame, rows: DataFrame, text_col: str, b: Bootstrap) -> DataFrame | None:
    """The confident patterns, or None where there are none. ``rows`` are scanned."""
    found = rows.select(F.explode("candidates").alias("c")).select(F.explode("c.patterns").alias("pattern"), "c.instance", "c.seed")
    edges = cut(found.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("seed")))
    # Patterns behind fewer instances can never have the support.
    patterns = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("used"), F.count("seed").alias("seeds"))
    patterns = cut(patterns.filter(F.col("instances") >= b.support))
    n = patterns.count()
    if not n or not patterns.filter(F.col("seeds") >= b.support).limit(1).count():
        return None
    edges = cut(within(edges, patterns.select("pattern"), "pattern", b.broadcast, n))
    patterns = cut(patterns.join(occurrences(docs, text_col, patterns, n, b), "pattern"))
    sure, known = None, 0
    for _ in range(b.rounds):
        lent = lending(edges, sure, known, b) if known else None
        sure, before = cut(confident(edges, patterns, lent, b)), known
        known = sure.count()
        if known == before:
            break
    return sure if known else None


def added(rows: DataFrame, sure: DataFrame, b: Bootstrap) -> DataFrame:
    """row, context: array of (start, kind, end, of) of candidates behind confident patterns."""
    c = rows.select("row", F.explode("candidates").alias("c")).filter("c.seed is null")
    c = c.select("row", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    hit = within(c, sure, "pattern", b.broadcast, sure.count()).groupBy("row", "start", "end").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
    span = F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end", (-F.col("best")["col2"]).alias("of"))
    return hit.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("context"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", b: Bootstrap = Bootstrap()) -> DataFrame:
    """Per document: doc_id, spans (array of start, kind, end, of), where kind is a place in ``KINDS``; ``of`` is the base kind that a context span resembles."""
    rows = cut(scanned(docs, id_col, text_col, b))
    as_base = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"], s["kind"].alias("of")))
    sure = bootstrapped(docs, rows, text_col, b)
    if sure is None:
        return rows.select("doc_id", as_base.alias("spans"))
    got = rows.select("row", "doc_id", "spans").join(added(rows, sure, b), "row", "left")
    free = lambda s, base: ~F.exists(base, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
    new = F.filter(F.coalesce("context", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,of:int>>")), lambda s: free(s, F.col("spans")))
    return got.select("doc_id", F.array_sort(F.concat(as_base, new)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op13_personal_data": op13_personal_data}
