"""What an executor's Python workers take and keep."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from docaudit.llm import common, exact_dedup, mixing, ngram_join, packing, toxicity


def words(n, seed):
    r = np.random.default_rng(seed)
    return ["".join(map(chr, r.integers(97, 123, r.integers(4, 12)))) + f"{seed}x{i}" for i in range(n)]


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_features_in_parts():
    many = words(2 * toxicity.WORDS + 7, 1) + ["é", "漢字", "a"]
    for part, whole in zip(toxicity.all_features(many, toxicity.Shape()), toxicity.features(many, toxicity.Shape())):
        assert part.dtype == whole.dtype and (part == whole).all()


def test_scoring_takes_bounded_memory():
    net = toxicity.Net(toxicity.Shape())
    groups = [[" ".join(w[i : i + 500]) for i in range(0, len(w), 500)] for w in (words(40_000, k) for k in range(5))]
    scorer = toxicity.Scorer(net)
    assert peak_mb(lambda: [scorer(g) for g in groups]) < 120  # room for 200,000 words has 58
    # Scores do not depend on what was scored before, nor on room that has to grow.
    small = toxicity.Scorer(net, most_words=100)
    small(groups[0])
    assert np.allclose(small(groups[1]), toxicity.Scorer(net)(groups[1]), atol=1e-5)


def test_training_takes_bounded_memory():
    w = words(80_000, 3)
    docs = [" ".join(w[i : i + 200]) for i in range(0, len(w), 200)]
    toxic = np.arange(len(docs)) % 2
    assert peak_mb(lambda: toxicity.train(docs, toxic, toxicity.Shape(steps=24))) < 100


def test_workers_hand_memory_back(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    runs, trims = [], []
    net = toxicity.Net(toxicity.Shape())
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or SimpleNamespace(first=lambda: None))
        packing.cut_pieces(docs, "doc_id", "text", packing.vocabulary(), 1024, 0)
        common.fitted_in_task(docs, lambda t: {})
    score = toxicity.scores(docs, net).func
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: SimpleNamespace(malloc_trim=trims.append))
    for k, run in enumerate(runs):
        assert list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})])))
        assert len(trims) == k + 1
    assert len(list(score(iter([pa.array(["a b", None])])))[0]) == 2
    assert len(trims) == 3


def test_no_workers_for_rows_of_the_driver(spark, monkeypatch):
    """Local Python rows go through workers of another kind, which stay beside those of the operators."""
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, "d", None)], "doc_id long, text string, source string").localCheckpoint()
    none = docs.limit(0).localCheckpoint()
    made = []
    kept = spark.sparkContext.parallelize
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda self, c, *a, **b: made.append(c) or kept(c, *a, **b))
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {1: 2, 2: 2, 3: 3}
    assert mixing.mixed_documents(docs).count() >= 3 and mixing.mixed_documents(none).count() == 0
    assert not made


def test_bitmap_edges_are_made_before_they_are_contracted(spark, monkeypatch):
    """A task of two Python nodes takes two workers."""
    plans = []
    kept = ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "connected_components", lambda edges, *a: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or kept(edges, *a))
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(i, f"{text} x{i}" if i < 20 else f"{i} z") for i in range(24)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: 0 if i < 20 else i for i in range(24)}
    assert "MapInArrow" not in plans[1]  # of the bitmaps; the first are made and contracted by one worker
