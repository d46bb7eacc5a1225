import random

from docaudit.operators import components
from docaudit.operators.components import connected_components
from docaudit.operators.odd import drop_repeated, odd_ones_out


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in up}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def odd(spark, values, sheet=1):
    return spark.createDataFrame([("d", sheet, 1, str(v)) for v in values], "document string, sheet int, comp int, text string")


def pairs(df):
    return sorted((r.major, r.odd) for r in df.collect())


def test_odd_labels(spark):
    assert pairs(odd_ones_out(odd(spark, [5] * 4 + [6]))) == [(5, 6)]
    assert pairs(odd_ones_out(odd(spark, [14] * 8 + [13, 15]))) == []
    assert pairs(odd_ones_out(odd(spark, [51] * 3 + [41]))) == []
    same = [odd_ones_out(odd(spark, [5] * 4 + [6], s)) for s in (1, 2, 3)]
    assert drop_repeated(same[0].union(same[1]).union(same[2])).count() == 0


def test_rounds_beyond_a_task(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 150)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    want = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    monkeypatch.setattr(components, "CHUNK_EDGES", 8)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(7)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
