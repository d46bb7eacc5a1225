"""The ten operators on small cases, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from docaudit.llm import exact_dedup, html_extract, language_id, lm_score, mixing, ngram_join, packing, quality_rules, secret_scan, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
LONG = "one two three four five six seven eight nine ten " * 3000
ROWS = [
    (1, "the cat sat on the mat", "en", "a"), (2, "the cat sat on the mat", "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, LONG, "en", "b"),
    (6, "Le chat était sur la table", "fr", "b"), (6, "Le chat était sur la table", "fr", "b"), (7, "12 34 !!", "en", "c"), (None, "no id here", "en", "c"), (8, "a\n\na\nb\n a\n", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {2} and {r.keep_id for r in got if r.doc_id in (3, 4)} == {4}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_digest_index_keeps_first_batch(spark, docs):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", 2)
    exact_dedup.exact_dedup(docs.filter("doc_id <= 2"), index=index).count()
    later = exact_dedup.exact_dedup(spark.createDataFrame([(9, "the cat sat on the mat"), (10, "new")], "doc_id long, text string"), index=index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in later} == {(9, 2, False), (10, 10, True)}


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    many = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    sums, target = Counter(), {}
    rows = mixing.mix_sources(many).collect()
    for r in rows:
        sums[r.target] += r.taken
    assert all(abs(v - t) <= 5 for t, v in sums.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(many.repartition(3)).collect()))
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(many).count() == sum(r.copies for r in rows)


def test_flow_over_overlapping_sources():
    routed = mixing.route([(("a",), 100), (("b",), 100), (("a", "b"), 100)], {"a": 150.0, "b": 150.0}, 2)
    assert routed == [100.0, 100.0, 100.0]  # no repeats while fresh words are left
    assert sum(mixing.route([(("a",), 100)], {"a": 170.0}, 2)) == 170.0


def test_packing(docs, empty):
    got = packing.pack(docs).toPandas()
    ids = packing.Ids(packing.vocabulary())
    texts = Counter((r[0], zlib.crc32(ids(r[1] or "") + bytes(4))) for r in ROWS if r[1] != LONG)
    assert Counter((None if d != d else int(d), c) for d, c in got[got.doc_tokens <= 1024][["doc_id", "ids_crc32"]].values) == texts
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.r_[0, g.length.cumsum()[:-1]].tolist() and g.length.sum() <= 1024
    assert packing.pack(empty).count() == 0


def test_ids_equal_the_tokenizers(docs):
    ids = packing.Ids(packing.vocabulary())
    for text in ("Hello  world\n\n it's 12 o'clock <|endoftext|> ünïcode  ", "a" * 300, "  \t ", "été 日本語 🙂"):
        assert np.frombuffer(ids(text), "<u4").tolist() == ids.slow.encode(text, add_special_tokens=False).ids


def test_examples_keep_all_limits(spark):
    rows = [(i, 10 + i % 90, i % 50) for i in range(500)]
    limits = packing.Limits(256, 4, 100)
    got = packing.pack_examples(spark.createDataFrame(rows, "id long, tokens long, loss long"), "id", "tokens", "loss", limits).collect()
    use = defaultdict(lambda: np.zeros(3, int))
    for r in got:
        use[r.sequence_id] += (rows[r.item_id][1], 1, rows[r.item_id][2])
    assert len(got) == 500 and all((u <= (256, 4, 100)).all() for u in use.values())


def test_quality_base(spark, docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels(spark)).collect()}
    for i, text, *_ in ROWS:
        w = WORD.findall(text or "")
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
    assert quality_rules.quality_rules(empty, labels(spark)).count() == 0


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    for k, n, p in ((0, 10, 0.3), (2, 40, 0.2), (30, 5000, 0.01)):
        want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert got == pytest.approx(want, rel=1e-6)


def test_thresholds_reject_junk_only(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(i, clean if i % 4 else clean.replace("word", "w%%%%"), "en") for i in range(2400)]
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(2400)], "doc_id long, quality int")
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), marks).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in got)


def test_thresholds_take_the_strictest_cutoff(spark):
    clean = [f"word{i}" for i in range(80)]
    some = [w + "%" * (i % 5 > 0) for i, w in enumerate(clean)]  # 0.8 symbols per word
    few = [w + "%" * (i % 8 == 0) for i, w in enumerate(clean)]  # 0.125
    text = lambda i: " ".join(few if i % 4 == 1 else some if i % 4 == 0 else clean)
    rows = [(i, text(i), "en") for i in range(2400)]
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(2400)], "doc_id long, quality int")
    cols = "doc_id long, text string, lang string"
    got = quality_rules.quality_rules(spark.createDataFrame(rows, cols), marks).collect()
    assert all((r.kept, r.failed) == ((True, []) if r.doc_id % 4 else (False, ["symbols_per_word"])) for r in got)
    # Above the strictest cutoff that the good ones allow (0.2, as they have 0.125), and not above it.
    new = [(5000, " ".join(w + "%" * (i % 4 == 0) for i, w in enumerate(clean)), "en"), (5001, " ".join(w + "%" * (i % 5 == 0) for i, w in enumerate(clean)), "en")]
    got = quality_rules.quality_rules(spark.createDataFrame(rows + new, cols), marks).collect()
    assert {r.doc_id: r.kept for r in got if r.doc_id >= 5000} == {5000: False, 5001: True}


def test_secret_scan(spark, empty):
    rows = [(1, 'x password = "hunter22" y'), (2, "é AKIA" + "A1" * 10 + " z"), (3, "secret: token: abcdefg"), (4, "k " + "0a" * 15), (5, None), (6, "TOKEN=abc")]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "assign:2:22" and got[2].spans == "access:2:26" and got[3].spans == "" and got[4].spans == "hex:2:32" and got[5].n_hex == 0 and got[6].n_assign == 0
    assert secret_scan.scan_secrets(empty).count() == 0


def test_candidates_are_like_assigned_values(spark):
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    short, plain = lambda: "ZQ-" + word("0123456789", 7), lambda: "QZ_" + word("BCDFGHJKLM", 17)
    dotted = lambda: ".".join("Z" + word("0123456789", 6) for _ in range(3))
    prose = " ".join(word("abcdefghijklmnopqrstuvwxyz", rng.randint(6, 12)) for _ in range(60))
    rows = [(i, f"{prose} token={make()} {word('abcdefghij', 8)}") for i, make in enumerate([short, plain, dotted] * 100)]
    for i, make in enumerate([short, plain, dotted]):
        rows.append((1000 + i, f"see {make()} and\n{prose}"))
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[1000 + i].spans for i in range(3)] == ["format:4:14", "format:4:24", "format:4:27"]


def test_automaton_prefers_its_format():
    rng = np.random.default_rng(1)
    key = lambda: "sk-" + "".join(rng.choice(list("0123456789abcdef"), 32))
    a = secret_scan.Automaton([secret_scan.symbols(key()) for _ in range(200)], 0.05)
    assert a.score(secret_scan.symbols(key())) > a.score(secret_scan.symbols("page2-of-the-big-book")) + 0.5


def test_language_id(spark, docs, empty):
    got = language_id.identify(docs, docs.filter("lang is not null")).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == "en" and by[6].lang_pred == "fr" and by[3].lang_pred == by[4].lang_pred == by[7].lang_pred == "und"
    assert language_id.identify(empty, empty).count() == 0 and {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_mixture_finds_both_languages(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and then sleeps all day ", "le renard brun saute par dessus le chien paresseux et puis il dort toute la journée "
    train = spark.createDataFrame([(en, "en"), (fr, "fr")], "text string, lang string")
    got = language_id.identify(spark.createDataFrame([(1, en * 5 + fr * 4), (2, en * 5)], "doc_id long, text string"), train).collect()
    assert [sorted(r.langs) for r in sorted(got)] == [["en", "fr"], ["en"]]


def test_ngram_join(docs, empty):
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[3].n_shingles == 0 and by[3].component_id == 3 and by[7].n_shingles == 1 and by[5].n_shingles == 10
    assert ngram_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_ngram_join_matches_brute_force(spark, monkeypatch, block, k, num):
    monkeypatch.setattr(ngram_join, "SUB_BLOCK", block)
    rng = np.random.default_rng(k)
    rows = []
    for i in range(90):
        w = [f"w{j}" for j in range(20 + 10 * (i % 4))]
        for _ in range(i % 3):
            w[rng.integers(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = {i: frozenset(zip(*(t.split()[j:] for j in range(k)), strict=False)) for i, t in rows}
    up = list(range(90))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), join=ngram_join.Join(k, num, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_copies_are_dropped_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [
        (6, a), (6, a), (6, a),  # repeated rows
        (1, b), (2, b), (1, c),  # id 1 has two texts, b a copy of that of 2
        (None, "no id here"), (None, "no id here"), (None, a), (7, None), (8, ""),
    ]
    docs = spark.createDataFrame([(*r, "kept along") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_copies(spark, docs, "").collect()]
    want = [(6, a), (2, b), (1, c), (None, "no id here"), (8, "")]
    assert sorted(got, key=repr) == sorted(((*r, "kept along") for r in want), key=repr)
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), "").count() == 0


def test_near_copies_are_dropped_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near = lambda t: t + " tail"
    rows = [
        (6, a), (6, a), (7, near(a)), (None, a),  # repeated rows, copies with and without an id
        (1, b), (2, near(c)), (3, c), (2, near(b)),  # id 2 has two texts near others, one of them the smaller of its pair
        (None, d), (None, near(d)), (4, None), (4, None), (5, ""),
    ]
    docs = spark.createDataFrame([(*r, "kept along") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = [tuple(r)[:2] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted((r for r in got if r[1] not in (d, near(d))), key=repr) == sorted([(6, a), (1, b), (2, near(c)), (4, None), (4, None), (5, "")], key=repr)
    assert sum(r[1] in (d, near(d)) for r in got) == 1


def test_rows_without_an_id_link_others(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (None, " ".join([*w, *(f"x{i}" for i in range(6))])), (2, " ".join([*w, *(f"x{i}" for i in range(12))]))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {1}


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>Head</h1><p>One &amp; two<br>three <b>bold</b><p>Next</article><div class='comments'><p>First!</p></div><footer>&copy; me</footer>"
    rows = [(i, "u", page.replace("Next", f"Next {i}")) for i in range(30)] + [(98, None, None), (99, "u", "<p")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4].text == "Head\n\nOne & two three bold\n\nNext 4" and got[4].n_chars == len(got[4].text) and got[98].text == ""
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lm_base_score(spark, docs, empty):
    from pyspark.sql import functions as F

    got = lm_score.lm_score(docs, F.coalesce(F.col("doc_id") == 6, F.lit(False))).collect()
    c, toks = Counter(), []
    for i, t, *_ in ROWS:
        w = (t or "").encode().lower().split() + [b""]
        toks.append((i, w))
        if i != 6:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, len(w), sum(c[x] > 0 for x in w), round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in toks)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and all(r.score < 0 for r in got)
    assert lm_score.lm_score(empty, F.lit(False)).count() == 0


def test_lm_trains_on_every_training_document(spark):
    from pyspark.sql import functions as F

    rows = [(None if i == 7 else i, " ".join(f"w{(i * j) % 11}" for j in range(1 + i % 5))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)))
    encoded = lm_score.encode(docs).cache()
    corpus = lm_score.corpus_counts(lm_score.word_totals(lm_score.word_rows(encoded)), 1500)
    rounds = [lm_score.train_round(encoded, lm_score.Model(corpus, lm_score.Shape()), turn) for turn in range(lm_score.ROUNDS)]
    assert sum(n for _, n in rounds) == corpus.n == sum(2 + i % 5 for i in range(200) if i % 5)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    text = lambda bad: " ".join([*rng.choice(vocabulary, 40), *(["xyzzy"] if bad else []), *rng.choice(vocabulary, 40)])
    train = [text(i % 4 == 0) for i in range(240)]
    net = toxicity.train(train, np.array([i % 4 == 0 for i in range(240)]).astype(int), toxicity.Shape(steps=160))
    score = toxicity.Scorer(net)([text(i % 2 == 0) for i in range(40)])
    assert ((score >= 0.3) == (np.arange(40) % 2 == 0)).mean() > 0.9
    assert toxicity.score(docs, net).count() == len(ROWS) and toxicity.score(empty, toxicity.fit(empty, labels(spark))).count() == 0


def test_automata_are_closed_under_their_moves():
    rng = random.Random(5)
    for alpha in (0.5, 0.05, 1e-4):
        words = ["".join(rng.choice("aA0-_"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
        made = secret_scan.Automaton(sorted(words), alpha)
        assert all(t < len(made.states) for _, follow, _ in made.states for t in follow.values())
        assert all(set(follow) == set(count) - {""} for count, follow, _ in made.states)
        assert all(math.isfinite(made.score(w)) for w in words)
