"""Personal data, against brute force."""

import random
import re
from collections import Counter

import pytest

from docaudit.llm import personal_data
from docaudit.llm.personal_data import KINDS, Bootstrap

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SCHEMA = "doc_id long, text string, spans string, row long, kind int"
CARD = "4111 1111 1111 1111"
ODD = [
    (1, f"mail me a.b@c.de, or +49 (30) 123-4567. Card {CARD}; host 10.0.0.255 not 10.0.0.256"), (2, None), (3, ""), (4, "x@y.z_w@q.example.com 1.2.3.4.5.6.7.8 1-2-3 00255.1.1.000001"),
    (5, "a@b a@b.c@d.e +1 2 +12345678 +123456789012345 +1234567890123456 @x.y é@b.cd 🙂a@b.cd"), (5, "a@b a@b.c"), (5, "a@b a@b.c"), (None, "no id, but x@y.zz"),
    (6, "a" * 50_000 + " " + "7" * 50_000 + "@b" + ".a" * 30_000), (7, "k@l.m " * 5000 + "9 " * 3000 + "+1 " * 2000), (8, f"+{CARD} {CARD}{CARD} 4111-1111-1111-1111-"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in ODD], SCHEMA)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    return sorted((m.start(), i, m.end()) for i, (k, rule) in enumerate(RULES.items()) for m in rule.finditer(text or "") if valid(k, m[0]))


def triples(spans):
    return [(s.start, s.kind, s.end) for s in spans]


def test_base_spans(spark, odd):
    short = [(i, t) for i, t in ODD if i != 6]
    got = personal_data.personal_data(odd.filter("doc_id is null or doc_id <> 6")).collect()
    assert Counter((r.doc_id, tuple(triples(r.spans))) for r in got) == Counter((i, tuple(brute(t))) for i, t in short)


def test_long_runs_take_linear_time(spark, odd):
    got = personal_data.personal_data(odd.filter("doc_id = 6")).collect()
    assert triples(got[0].spans) == [(50_001, 0, 160_003)]


def test_running_sums(spark):
    F = personal_data.F
    for n in (0, 1, 63, 64, 65, 5000):
        x = [random.Random(n + i).randint(0, 9) for i in range(n)]
        got = spark.createDataFrame([(x,)], "x array<bigint>").select(personal_data.running(F.col("x")).alias("s")).first().s
        assert got == [sum(x[: i + 1]) for i in range(n)]


def test_base_spans_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = personal_data.personal_data(docs).collect()
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert len(got) == len(want) and all(triples([s for s in r.spans if s.kind < 4]) == want[r.doc_id] for r in got)
    assert sum(map(len, want.values())) > 0


def phrases(n, rng):
    """Texts with planted contexts; true and false identifiers that the base rules miss, as text slices."""
    words = [f"{a}{b}" for a in "ka lo mi ren tu sha bel dor".split() for b in "ne ri tos um vel".split()]
    rows, hidden, decoys = [], [], []
    for i in range(n):
        filler = lambda k: " ".join(rng.choices(words, k=k))
        kind = i % 6
        if kind == 0:
            rows.append(f"{filler(20)} write to user{i}@mail.example.com {filler(10)}")
        elif kind == 1:
            rows.append(f"{filler(20)} my phone: +49 30 {1_000_000 + i} {filler(10)}")
        elif kind == 2 and i % 5 == 0:  # written without the country code
            token = f"030/{1_000_000 + i}"
            hidden.append(token)
            rows.append(f"{filler(20)} my phone: {token}, {filler(10)}")
        elif kind == 3 and i % 5 == 0:  # a host without a dot
            token = f"user{i}@localhost"
            hidden.append(token)
            rows.append(f"{filler(20)} write to {token}. {filler(10)}")
        else:
            token = f"{1900 + i % 120}-{i}"
            decoys.append(token)
            rows.append(f"{filler(15)} in {filler(1)} {token} to {filler(10)}")
    return rows, hidden, decoys


def test_contexts_find_what_the_rules_miss(spark):
    rows, hidden, decoys = phrases(1500, random.Random(7))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for limit in (100_000, 0):  # patterns broadcast, and joined by a shuffle
        got = personal_data.personal_data(docs, b=Bootstrap(broadcast=limit)).collect()
        found = [(rows[r.doc_id][s.start : s.end], KINDS[s.of]) for r in got for s in r.spans if s.kind == 4]
        texts = Counter(x for x, _ in found)
        assert sum(h in texts for h in hidden) >= 0.95 * len(hidden) and len(hidden) >= 50 and not set(texts) & set(decoys)
        assert {k for x, k in found if "@" in x} == {"email"} and {k for x, k in found if "/" in x} == {"phone"}
        assert all(triples([s for s in r.spans if s.kind < 4]) == brute(rows[r.doc_id]) for r in got)


def test_discovered_instances_carry_to_other_patterns(spark):
    text = [f"contact account: ann{i}@mail.example.com now" for i in range(30)] + [f"contact account: QX-{i:04d}-77 now" for i in range(20)]
    text += [f"see reference {'QX'}-{i:04d}-77 there" for i in range(20)] + ["see reference ZZ-99999-1 there"]
    rows = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    spans = lambda b: {text[r.doc_id][s.start : s.end] for r in personal_data.personal_data(rows, b=b).collect() for s in r.spans if s.kind == 4}
    assert "ZZ-99999-1" not in spans(Bootstrap(rounds=1)) and "QX-0003-77" in spans(Bootstrap(rounds=1))
    assert "ZZ-99999-1" in spans(Bootstrap(rounds=3))


def test_copies_lend_no_support(spark):
    text = ["my phone: +49 30 1234567 ok"] * 300 + ["my phone: 030/999999 ok"]
    got = personal_data.personal_data(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()
    assert not [s for r in got for s in r.spans if s.kind == 4]


def test_no_rows_and_no_python(spark, odd):
    assert personal_data.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    rows, _, _ = phrases(300, random.Random(1))
    plan = personal_data.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert not re.search("Python|Pandas|ArrowEval", plan._jdf.queryExecution().executedPlan().toString())
