"""Known errors, keys in texts and sheets compared with their peers, against brute force over random rows."""

import random

import pytest
from pyspark.sql import functions as F

from docaudit.operators import nets, report, rules_single

PLACE = ", ".join(f"{f} {k}" for f, k in report.REF_FIELDS.items())
HEAD = ["kind", "type", "scope"]


def place(**fields):
    return tuple(fields.get(f) for f in report.REF_FIELDS)


FIELDS = [list(report.REF_FIELDS).index(f) for f in report.KNOWN_FIELDS]


def covers(record, finding):
    _, *head, refs = record
    agree = lambda r, o: all(r[f] in (None, "") or str(r[f]) == str(o[f]) for f in FIELDS)
    return bool(refs) and all(h in (None, "") or h == o for h, o in zip(head, finding[1:4], strict=True)) and all(any(agree(r, o) for o in finding[4]) for r in refs)


@pytest.mark.parametrize("bytes_", [report.KNOWN_BYTES, 0])
def test_known_errors_of_all_choices_of_fields(spark, monkeypatch, bytes_):
    monkeypatch.setattr(report, "KNOWN_BYTES", bytes_)
    rng = random.Random(5)
    some = lambda *x: rng.choice([None, "", *x])

    def ref(p):
        full = {f: rng.choice([1, 2]) if f in ("sheet", "row") else some("a", "b") for f in report.KNOWN_FIELDS}
        return place(**{f: v for f, v in full.items() if rng.random() < p})

    head = lambda: [some("a"), some("b"), some("c")]
    findings = [(i, *head(), [ref(0.8) for _ in range(rng.randint(0, 3))]) for i in range(60)]
    known = [(i, *head(), [ref(rng.choice([0, 0.1, 0.3])) for _ in range(rng.randint(0, 2))]) for i in range(800)]
    schema = f"id int, kind string, type string, scope string, refs array<struct<{PLACE}>>"
    f, k = spark.createDataFrame(findings, schema).withColumnRenamed("id", "finding_id"), spark.createDataFrame(known, schema).withColumnRenamed("id", "known_id")
    want = {(x[0], y[0]) for x in findings for y in known if covers(y, x)}
    assert len(want) > 50
    assert {tuple(r) for r in report.known_hits(f, k).select("finding_id", "known_id").collect()} == want
    assert {r.finding_id for r in report.suppress_known(f, k).collect()} == {x[0] for x in findings} - {a for a, _ in want}
    first = {min(b for c, b in want if c == a) for a, _ in want}
    assert {r.known_id for r in report.unused_known(f, k).collect()} == {y[0] for y in known} - first


def test_no_known_errors(spark):
    f = spark.createDataFrame([(1, "a", "b", "c", [place(document="d")])], f"finding_id int, kind string, type string, scope string, refs array<struct<{PLACE}>>")
    assert report.suppress_known(f, f.withColumnRenamed("finding_id", "known_id").limit(0)).count() == 1


def test_known_errors_are_broadcast_and_findings_not_shuffled(spark):
    f = spark.range(50).select(F.col("id").alias("finding_id"), *[F.lit(x).alias(x) for x in HEAD], F.array(report.make_ref(document=F.lit("d"))).alias("refs"))
    plan = report.known_hits(f, f.filter("finding_id = 1").withColumnRenamed("finding_id", "known_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "Distinct" not in plan


@pytest.mark.parametrize("sizes", [(5, 3, 2), (2,)])
def test_texts_that_hold_keys(spark, monkeypatch, sizes):
    monkeypatch.setattr(report, "GRAMS", sizes)
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choice("abЯ-\U0001f600") for _ in range(rng.randint(a, b)))
    spans = [(f"D{rng.randint(1, 2)}", rng.randint(1, 3), rng.choice([None, word(0, 12)])) for _ in range(300)] * 2
    wanted = {(f"D{rng.randint(1, 3)}", word(2, 7)) for _ in range(80)}
    want: dict = {}
    for d, s, t in spans:
        for e, k in wanted:
            if d == e and t is not None and k in t:
                want[d, s, k] = want.get((d, s, k), 0) + 1
    got = report.holding(spark.createDataFrame(spans, "document string, sheet int, text string"), spark.createDataFrame(sorted(wanted), "document string, key string"))
    got = got.groupBy("document", "sheet", "key").agg(F.sum("n").alias("n"))
    assert want and {(r.document, r.sheet, r.key): r.n for r in got.collect()} == want


def test_peer_sheets(spark):
    rng = random.Random(9)
    base = [f"K{i}" for i in range(30)]
    sheets = {("D", s): {x for x in base if rng.random() < 0.96} | ({None} if s == 3 else set()) for s in range(12)}
    sheets |= {("D", 20 + s): set(base[: 7 + s]) for s in range(6)} | {("E", 1): set(base[:9]), ("E", 2): set(base[:8]), ("F", 1): set(base)}
    want = set()
    for (d, s), x in sheets.items():
        for (e, p), y in sheets.items():
            both = len((x & y) - {None})
            if d == e and s != p and both >= 8 and 1 <= len(x) - both <= 3 and both >= 0.9 * len(x):
                want |= {(d, s, p, k) for k in x if k is None or k not in y}
    rows = [(d, s, k) for (d, s), x in sheets.items() for k in x] * 2
    got = rules_single.missing_from_peer_sheet(spark.createDataFrame(rows, "document string, sheet int, designator string"))
    assert len(want) > 20 and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_wires_that_cross_are_found_once(spark):
    rng = random.Random(3)
    segments = []
    for i in range(60):
        at, low, high = rng.randint(1, 300) + 0.5, rng.randint(0, 150), rng.randint(151, 400)
        x1, y1, x2, y2 = (low, at, high, at) if i % 2 else (at, low, at, high)
        segments.append(("D", 1, i, float(x1), float(y1), float(x2), float(y2), 1.0))
    slanted = [("D", 1, 60, 0.0, 0.0, 390.0, 380.0, 1.0), ("D", 1, 61, 390.0, 3.0, 0.0, 370.0, 1.0)]
    frame = spark.createDataFrame(segments + slanted, "document string, sheet int, seg int, x1 double, y1 double, x2 double, y2 double, width double")
    want = {(a[2], b[2]) for a in segments for b in segments if a[2] < b[2] and a[2] % 2 != b[2] % 2 for h, v in [(a, b) if a[2] % 2 else (b, a)] if h[3] + 0.3 <= v[3] <= h[5] - 0.3 and v[4] + 0.3 <= h[4] <= v[6] - 0.3}
    dots = spark.createDataFrame([], "document string, sheet int, ox double, oy double")
    got = [(r.a, r.b) for r in nets.wire_crossings(frame, dots).collect()]
    assert len(got) == len(set(got)) and (60, 61) in got and want and {p for p in got if p[1] < 60} == want
