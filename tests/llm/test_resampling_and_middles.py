"""Importance resampling and fill-in-middle, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docaudit.llm import fill_middle, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SCHEMA = "doc_id long, text string, score string, n string, form string"
LONG = "Wort " + "x" * 300 + " été 日本 " + "lorem ipsum dolor sit amet 12 " * 2000
ROWS = [
    (1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, LONG), (6, "Le chat ÉTAIT sur la table, là-bas 🙂🙂"), (6, "Le chat ÉTAIT sur la table, là-bas 🙂🙂"), (7, "12 34 !!"),
    (None, "no id here " * 12), (8, "a<P>b"), (9, "<S"), (10, "ends with <"), (11, "\n\n \t"), (12, "x"), *[(20 + i, f"w{i % 3} " * (18 + i % 5)) for i in range(40)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "n", "f") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_skip_list_reaches_every_rank():
    rng = random.Random(5)
    for n in (0, 1, 2, 15, 16, 17, 255, 256, 257, 5000):
        widths = np.array([rng.randint(1, 9) for _ in range(n)], np.int64)
        places = np.append(0, np.cumsum(widths))
        for fan in (2, 16):
            units = fill_middle.SkipList(widths, fan)
            assert [units.seek(r) for r in range(n + 1)] == places.tolist()
            assert all(len(a[0]) <= fan * len(b[0]) for a, b in zip(units.lanes, units.lanes[1:], strict=False)) and len(units.lanes[-1][0]) <= fan
    with pytest.raises(IndexError):
        fill_middle.SkipList(np.ones(3)).seek(4)


def middle(doc_id, text):
    units, d = UNIT.findall(text or ""), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    text, n = text or "", len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark, docs, empty):
    got = fill_middle.fill_middle(docs).collect()
    assert Counter(map(tuple, got)) == Counter((i, *middle(i, t)) for i, t in ROWS)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and fill_middle.fill_middle(empty).count() == 0
    back = fill_middle.fill_middle(docs).select("doc_id", fill_middle.restored(fill_middle.F.col("output"), fill_middle.F.col("form")).alias("text")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in ROWS)


def test_middles_with_text_ids_and_other_shares(spark):
    rows = spark.createDataFrame([("a", "one two <"), ("b", "<M three")], "key string, body string")
    got = {r.doc_id: r for r in fill_middle.fill_middle(rows, "key", "body", fill_middle.Cuts(plain=0, spm=100)).collect()}
    assert {r.form for r in got.values()} == {"spm"} and set(got) == {"a", "b"}


def features(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f, n=10_000):
    return zlib.crc32(f.encode()) % n


def resampled(rows, target, r):
    s, t = (Counter(bucket(f, r.buckets) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + r.buckets) / ((s[b] + 1) * (T + r.buckets)))) for b in range(r.buckets)]
    out = []
    for i, x in rows:
        w, f = features(x)
        h = int(hashlib.sha256(f"{r.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(y, r.buckets)] for y in f)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((x for x in out if x[1] >= r.least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = order[: r.percent * len(order) // 100]
    for k, x in enumerate(drawn):
        x.append(k + 1)
    return [tuple(x) if len(x) == 6 else (*x, None) for x in out]


@pytest.mark.parametrize("head", [{}, {"head_words": 3, "pair_words": 2, "head_pairs": 1}, {"head_words": 0}, {"head_bytes": 2, "percent": 60}])
def test_resampling_against_brute_force(spark, docs, head):
    r = importance.Resampling(**head)
    target = ["the cat sat", "w1 w1 w2", None, "été 日本"]
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), r=r)
    cols = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.select(cols).collect())) == Counter(resampled(ROWS, target, r))


def test_resampling_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).count() == 0
    assert importance.resample(docs, none).count() == len(ROWS) and importance.resample(docs.filter("text = ''"), none).first().weight == 0


def test_repeated_rows_spread_over_ranks(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = spark.createDataFrame([(7, text)] * 400 + [(None, text)] * 200, "doc_id long, text string")
    got = importance.resample(rows, rows, r=importance.Resampling(percent=50)).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 301))


def test_crcs_of_any_bytes():
    rng = random.Random(3)
    words = ["a", "z" * 63, "z" * 64, "z" * 65, "y" * 1000, "é", "日本", "🙂", "0", *("".join(rng.choices("abc09é", k=rng.randint(1, 90))) for _ in range(300))]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(50)] + ["", "one", "A-b"]
    w = importance.Words(pa.chunked_array([pa.array([*texts, None])]))
    head = importance.Head([b"a", "é".encode()], [zlib.crc32(b"a"), zlib.crc32("é".encode())], 2, [(0, 1, zlib.crc32("a é".encode()))])
    got = Counter((int(w.doc[i]), int(c)) for at, crc in importance.crcs(w, head, importance.Shifts()) for i, c in zip(at, crc, strict=True))
    assert got == Counter((k, zlib.crc32(f.encode())) for k, x in enumerate(texts) for f in features(x)[1])
