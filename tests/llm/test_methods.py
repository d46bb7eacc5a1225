"""The operators' methods: gradients, proper likelihoods, brute force over whole tables, planted cases, executors without the package."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docaudit.llm import exact_dedup, html_extract, language_id, lm_score, mixing, ngram_join, packing, quality_rules, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def remainder(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def slope(f, w, at, eps=1e-3):
    old = w[at]
    w[at] = old + eps
    high = f()
    w[at] = old - eps
    low = f()
    w[at] = old
    return (high - low) / (2 * eps)


# Networks ---------------------------------------------------------------------------------------


def test_toxicity_gradients():
    net = toxicity.Net(toxicity.Shape(dim=4, hidden=3, word_buckets=64, gram_buckets=64))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    x, n, y = r.normal(size=(5, 3, 18)), np.array([5, 3, 2]), np.array([1.0, 0.0, 1.0])
    x *= (np.arange(5)[:, None] < n)[:, :, None]
    loss = lambda: float(np.sum(np.log1p(np.exp(net.forward(x, n)[0])) - y * net.forward(x, n)[0]))
    logit, kept = net.forward(x, n, keep=True)
    grads, dx = net.backward(x, n, kept, toxicity.sigmoid(logit) - y)
    for name, at in (("u", (0, 1, 4)), ("u", (1, 2, 7)), ("wa", (3, 1)), ("va", (2,)), ("out", (4,)), ("bias", (0,))):
        assert grads[name][at] == pytest.approx(slope(loss, net.w[name], at), abs=2e-4)
    assert dx[1, 0, 5] == pytest.approx(slope(loss, x, (1, 0, 5)), abs=2e-4)


def test_block_labeller_gradients():
    net = html_extract.Labeller(html_extract.Shape(path_dim=3, word_dim=2, hidden=3))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(1)
    x, n = r.normal(size=(4, 2, 11)), np.array([4, 2])
    on = np.arange(4)[:, None] < n
    loss = lambda: float((np.log1p(np.exp(net.forward(x, n)[0])) * on).sum())
    logits, kept = net.forward(x, n, keep=True)
    grads = net.backward(x, kept, on / (1 + np.exp(-logits)))
    for name, at in (("wx", (2, 5)), ("wx", (7, 20)), ("u", (0, 1, 4)), ("u", (1, 2, 9)), ("out", (3,)), ("b", (6,))):
        assert grads[name][at] == pytest.approx(slope(loss, net.w[name], at), abs=2e-3)


def lm(words=30, classes=4, hidden=4):
    corpus = lm_score.Corpus(5000, 90, [b"", *(f"w{i}".encode() for i in range(words - 1))], [200 - i for i in range(words)])
    m = lm_score.Model(corpus, lm_score.Shape(words=words, classes=classes, hidden=hidden))
    m.w = {k: (v + np.random.default_rng(3).normal(0, 0.2, v.shape)).astype(np.float64) for k, v in m.w.items()}
    return m


def test_lm_gradients_over_a_window_with_a_new_document():
    m, r = lm(), np.random.default_rng(2)
    x, y = r.integers(0, 31, (5, 3)), r.integers(0, 31, (5, 3))
    fresh, valid, s = np.zeros((5, 3)), np.ones((5, 3), bool), r.normal(size=(3, 4))
    fresh[2, 1], valid[4, 2] = 1, False
    loss = lambda: m.loss_and_grads(x, fresh, y, valid, s)[0]
    grads = m.loss_and_grads(x, fresh, y, valid, s)[1]
    for name in ("e", "wx", "b", "u", "oc", "bc", "ow", "bw"):
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), grads[name].shape)
        assert grads[name][at] == pytest.approx(slope(loss, m.w[name], at), abs=1e-3)


def test_lm_is_a_proper_likelihood():
    """Symbols' probabilities sum to 1 after any state, and an "other" word's share of theirs does, too."""
    m, r = lm(), np.random.default_rng(4)
    states = np.repeat(r.normal(size=(1, 4)), 31, 0)
    like, _ = m.outputs(states, np.arange(31))
    assert np.exp(like).sum() == pytest.approx(1, abs=1e-6)
    others = {f"o{i}": 5 for i in range(60)}  # the words beyond the 30 most frequent
    m.corpus.counts, m.corpus.n, m.corpus.v = [1] * 30, 30 + sum(others.values()), 90
    total = m.corpus.n - sum(m.corpus.counts) + m.corpus.v - 30 + 1
    assert sum((c + 1) / total for c in others.values()) + 1 / total == pytest.approx(1)


def test_lm_state_is_carried_over_windows():
    m = lm()
    m.shape = lm_score.Shape(words=30, classes=4, hidden=4, tokens=2)
    doc = np.random.default_rng(5).integers(0, 31, 40)
    one = m.score(doc, np.array([40]))
    m.shape = lm_score.Shape(words=30, classes=4, hidden=4, tokens=4096)
    assert m.score(doc, np.array([40])) == pytest.approx(one)
    assert m.score(np.concatenate([doc, doc[:7]]), np.array([40, 7]))[0] == pytest.approx(one[0])


def test_lm_learns_more_than_the_base(spark, documents):
    got = lm_score.op8_lm_score(spark, SF).collect()
    tokens = {d["doc_id"]: [*(d["text"] or "").encode().lower().split(), b""] for d in documents}
    c = Counter(w for i, t in tokens.items() if remainder(i, 7) != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 7) == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# Brute force over a whole small table --------------------------------------------------------------


def test_toxicity_over_the_table(spark, documents):
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    assert got.keys() == {d["doc_id"] for d in documents}
    assert all(r.held_out == (remainder(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    net = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2), spark.read.parquet(f"{SF}/labels.parquet"))
    some = documents[:12]
    assert toxicity.Scorer(net)([d["text"] or "" for d in some]) == pytest.approx([got[d["doc_id"]].score for d in some], abs=1e-5)


def test_windows_cover_every_word():
    shape = toxicity.Shape()
    n = np.array([0, 1, 48, 49, 500])
    doc, start, length = toxicity.windows(n, shape)
    seen = {(int(d), int(s) + k) for d, s, m in zip(doc, start, length, strict=True) for k in range(m)}
    begin = np.cumsum(n) - n
    assert seen == {(i, int(begin[i]) + k) for i in range(5) for k in range(n[i])} and (np.diff(start[doc == 4]) < shape.window).all()


def test_html_over_the_table(spark):
    """The article element of each page is its text, notices and comments inside it apart."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in html_extract.op2_html_extract(spark, SF).collect()}
    same = 0
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html or "", re.S)
        want = [b.text for b in html_extract.blocks(article[1])] if article else []
        r = got[p.page_id]
        assert r.url == p.url and r.n_chars == len(r.text)
        same += [b for b in r.text.split("\n\n") if b] == [b for b in want if b]
    assert same >= 0.95 * len(pages)


def test_html_by_context_and_words(spark):
    """Boilerplate whose class names say nothing, on pages whose others do."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    links = lambda: "".join(f"<li><a href='/{i}'>{rng.choice(words)}</a></li>" for i in range(5))

    def page(named):
        body = "".join(f"<p>{text(rng.randint(20, 60))}</p>" for _ in range(rng.randint(2, 6)))
        top, foot = (("nav", "footer") if named else ("div", "div"))
        return f"<html><body><{top}><ul>{links()}</ul></{top}><article><h1>{text(5)}</h1>{body}</article><{foot}><ul>{links()}</ul>&copy; 2026</{foot}></body></html>", re.findall(r"<(?:h1|p)>(.*?)</", body)

    made = [page(i % 10 > 0) for i in range(200)]
    rows = [(i, None, h, i) for i, (h, _) in enumerate(made)] + [(0, None, made[0][0], 0), (900, "u", "<p>" + text(20_000), 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.extract(docs).collect()
    assert len(got) == len(rows) and sum(r.page_id == 0 for r in got) == 2
    by = {r.page_id: r.text for r in got}
    found = [set(want) <= set(by[i].split("\n\n")) and len(by[i].split("\n\n")) <= len(want) + 2 for i, (_, want) in enumerate(made)]
    assert sum(found) >= 0.9 * len(found)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_over_the_table(spark, documents):
    got = {r.doc_id: r for r in secret_scan.op5_secret_scan(spark, SF).collect()}
    for d in documents:
        base, r = brute_spans(d["text"] or ""), got[d["doc_id"]]
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_planted_formats_are_found_and_numbers_left_alone(spark):
    """Credentials seen in assignments are found in bare text, too; words, numbers, dates and addresses are no secrets."""
    rng = random.Random(11)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    token = lambda: "ghx_" + draw("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 36)
    prose = lambda: " ".join(draw("abcdefghijklmnopqrstuvwxyz", rng.randint(3, 11)) for _ in range(80))
    noise = lambda: f"{draw('0123456789', 16)} 192.168.{rng.randint(1, 255)}.{rng.randint(1, 255)} 2026-{rng.randint(10, 12)}-{rng.randint(10, 28)} {draw('0123456789', 7)}"
    rows = [(i, f"{prose()} api_key = '{token()}' {noise()}") for i in range(150)]
    bare = {1000 + i: token() for i in range(50)}
    rows += [(i, f"{prose()} {t} {noise()}") for i, t in bare.items()] + [(2000, None), (2001, f"{prose()} " * 200), (5, rows[5][1])]
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    found = {(r.doc_id, text[r.doc_id][int(a) : int(b)]) for r in got for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "format"}
    caught = {(i, t) for i, t in bare.items()} & found
    assert len(caught) >= 48 and len(found - caught) <= 3 and len(got) == len(rows)


def test_packing_over_the_table(spark, documents):
    """The pieces put together are the ids of the tokenizer itself, and sequences hold what they may."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.op6_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d in documents:
        ids = np.array([*slow.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[d["doc_id"]], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]] and sum(r.length for r in s) <= 1024 and len(s) <= packing.Limits().segments
    total = sum(r.length for s in sequences.values() for r in s)
    assert total / (1024 * len(sequences)) > 0.97


def test_other_tokenizers_go_through_their_own_rules(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(packing.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    ids = packing.Ids(str(path))
    assert ids.fast is None and np.frombuffer(ids("one two"), "<u4").tolist() == Tokenizer.from_file(str(path)).encode("one two", add_special_tokens=False).ids


def test_languages_over_the_table(spark, documents):
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, SF).collect()}
    held = [d for d in documents if remainder(d["doc_id"], 4) == 2 and d["lang"] and any(c.isalpha() for c in d["text"] or "")]
    assert all(r.held_out == (remainder(i, 4) == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in d["text"] or "")) for d in documents for r in [got[d["doc_id"]]])
    assert sum(got[d["doc_id"]].lang_pred == d["lang"] for d in held) >= 0.95 * len(held)


def test_mixtures_of_many_languages(spark):
    """Six made-up languages with letters of their own; a document may use them all."""
    rng = random.Random(5)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    say = lambda i, n: " ".join("".join(rng.choices(letters[i], k=5)) for _ in range(n)) + " "
    train = spark.createDataFrame([(say(i, 300), f"l{i}") for i in range(6)], "text string, lang string")
    docs = spark.createDataFrame([(1, "".join(say(i, 60) for i in range(6))), (2, say(3, 60)), (3, say(0, 40) + say(5, 60))], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(docs, train).collect()}
    assert [sorted(got[i].langs) for i in (1, 2, 3)] == [[f"l{i}" for i in range(6)], ["l3"], ["l0", "l5"]] and got[3].lang_pred == "l5"


def test_mixing_over_the_table(spark, documents):
    got = {r.doc_id: r for r in mixing.op9_mixing(spark, SF).collect()}
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in documents}
    sources, taken, largest = Counter(), Counter(), Counter()
    for d in documents:
        sources[d["source"]] += size[d["doc_id"]]
        taken[d["source"]] += got[d["doc_id"]].taken
        largest[d["source"]] = max(largest[d["source"]], size[d["doc_id"]])
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sources.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sources[s]]
        target |= {s: 2.0 * sources[s] for s in over} if over else share
        left -= sum(target[s] for s in over)
        open_ -= set(over)
        if not over or not open_:
            break
    for d in documents:
        r = got[d["doc_id"]]
        assert r.size == size[d["doc_id"]] and r.source_size == sources[d["source"]] and r.target == pytest.approx(target[d["source"]]) and r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)


def test_quality_over_the_table(spark, documents):
    got = {r.doc_id: r for r in quality_rules.op4_quality_rules(spark, SF).collect()}
    for d in documents:
        text = d["text"] or ""
        w = WORD.findall(text)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and r.kept == (not r.base_failed and not r.failed)


def test_cutoffs_in_small_strata_against_brute_force(spark):
    """Null and empty strata are two; each gets the strictest rule of the path that its labels allow."""
    from math import comb

    rng = random.Random(9)
    clean = [f"word{i}" for i in range(80)]
    text = lambda n: " ".join(w + "%" * (i < n) for i, w in enumerate(clean))
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        rows.append((i, text(60 if bad else rng.choice([0, 0, 0, 2])), (None, "", "xx")[i % 3]))
    marks = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(900)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, marks).collect()}
    for k in range(3):
        own = [i for i in range(900) if i % 3 == k]
        lost = sum(not got[i].kept for i in own if i % 5)
        assert all(not got[i].kept for i in own if i % 5 == 0) and lost <= 0.05 * len(own)
    n, alpha = 120, 0.05  # about the testing half of a stratum's good documents
    assert sum(comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(1)) <= 0.05 / 3
    few = quality_rules.quality_rules(docs.filter("doc_id < 60"), marks).collect()
    assert all(r.kept for r in few)


# Index, joins, pipeline ---------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [2, 1024])
def test_hot_digests_join_by_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(exact_dedup, "RUN_BITS", 1)
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(60)] + [(None, "same text"), (5, "same text")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    same = [r for r in got if r.text_sha256 == hashlib.sha256(b"same text").hexdigest()]
    assert len(got) == 62 and len(same) == 42 and sum(r.kept for r in same) == 1 and {r.keep_id for r in same} == {59} and {r.group_size for r in same} == {42}


@pytest.mark.parametrize("wide, maps", [(0, 4), (0, 1000), (100, 4), (100, 1000)])
def test_open_blocks(spark, monkeypatch, wide, maps):
    """Families that share half of their words are one block of several components; links between them are few."""
    monkeypatch.setattr(ngram_join, "SUB_BLOCK", 4)
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    monkeypatch.setattr(ngram_join, "SUB_MAPS", maps)
    rng, rows, base = random.Random(13), [], [f"b{i}" for i in range(60)]
    for f in range(6):
        own = [f"f{f}x{i}" for i in range(60)]
        for v in range(7):
            w = base + own
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((100 * f + v, " ".join(w)))
    bridge = base + [f"f0x{i}" for i in range(52)] + [f"f1x{i}" for i in range(52, 60)]
    rows.append((999, " ".join(bridge)))
    sets = {i: frozenset(zip(*(t.split()[j:] for j in range(5)), strict=False)) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), join=ngram_join.Join(5, 80, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


@pytest.mark.parametrize("most, splits", [(16384, 16), (3, 16), (3, 1)])
def test_blocks_fall_apart_before_sets_are_shuffled(spark, monkeypatch, most, splits):
    """Chains of candidates that link with few others: what bitmaps part needs no sets, whatever way a group is joined; links stay."""
    monkeypatch.setattr(ngram_join, "SUB_MAPS", most)
    monkeypatch.setattr(ngram_join, "NARROW", splits)
    join, texts = ngram_join.Join(5, 80, 100), {}
    for i in range(12):  # half of each text is that of its neighbour
        own = [f"{p}x{j}" for p in (i, i + 1) for j in range(80)]
        texts |= {2 * i: " ".join(own), 2 * i + 1: " ".join([*own, f"tail{i}"]) if i % 3 == 0 else f"alone {i}"}
    rows = [(i, i, t) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, row_key long, text string")
    d = {i: ngram_join.digest(ngram_join.Shingler(5)(t)) for i, t in texts.items()}
    candidates = spark.createDataFrame([(x, 7, i) for i, x in d.items()], "d long, block long, row_key long")
    got = {r.d: r.block for r in ngram_join.narrowed(docs, candidates, join).collect()}
    pairs = [(d[2 * i], d[2 * i + 1]) for i in range(0, 12, 3)]
    assert all(got[a] == got[b] for a, b in pairs)
    if splits > 1:
        assert set(got) == {x for p in pairs for x in p} and len(set(got.values())) == len(pairs)


def test_pipeline_against_brute_force(spark, documents):
    out = corpus_pipeline.run(spark, SF).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(net)
    kept = [d for d in documents if scorer([d["text"] or ""])[0] < toxicity.CUTOFF]
    last = {}
    for d in kept:
        last[d["text"] or ""] = max(last.get(d["text"] or "", -1), d["doc_id"])
    kept = [d for d in kept if last[d["text"] or ""] == d["doc_id"]]
    shingles = {}
    for d in kept:
        w = WORD.findall((d["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles[d["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in shingles}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = shingles[a], shingles[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    kept = {i for i in ids if find(i) == i or not shingles[i]}
    got = {r.doc_id for r in out}
    left = [d for d in documents if d["doc_id"] in kept]
    # The mix takes documents by a seed, none that is not there, and by its targets.
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in left], docs.schema)).select("doc_id").collect())
    assert got == set(mixed) <= kept
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary())
    text = {d["doc_id"]: d["text"] or "" for d in left}
    want = {i: k * (len(slow.encode(text[i], add_special_tokens=False).ids) + 1) for i, k in mixed.items()}
    sums = Counter()
    for r in out:
        sums[r.doc_id] += r.length
    assert dict(sums) == want


def test_stages_on_odd_tables(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with the operators' own names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, taken string, kept boolean, d int"
    rows = [(1, None, None, None, None, 0.0, "x", True, 1), (2, "", "en", "a", 0, 0.0, "x", True, 1), (3, "a b c " * 30_000, "en", "a", 9, 0.0, "x", True, 1), (3, "a b c " * 30_000, "en", "a", 9, 0.0, "x", True, 1), (None, "one two", "en", "b", 7, None, None, None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= 0


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """Executors may lack this package: the driver has it on its own path alone."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
for name in ("op1_toxicity", "op2_html_extract", "op3_ngram_join", "op5_secret_scan", "op6_packing", "op7_language_id", "op8_lm_score"):
    assert queries[name](spark, {SF!r}).count() > 0, name
try:
    spark.range(1).mapInArrow(lambda b: [__import__("docaudit"), *b][1:], "id long").count()
except Exception as e:
    assert "ModuleNotFoundError" in str(e)
    print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in got.stdout, got.stderr[-3000:]
