from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoledger.llm import quality_classifier as C

from .fixtures import clashing, corpus, frame, table

DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    from chronoledger.llm.queries import op10_quality_ranking

    scored = op10_quality_ranking(spark, str(DATA))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert scored.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    assert scored.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_ranking_orders_separable_pairs_and_cuts_at_the_quantile():
    rng = np.random.default_rng(1)
    good = np.arange(400) % 5 > 0
    x = rng.normal(size=(400, C.WIDTH))
    x[:, 3] += 4 * good
    s = C.fit(x, good).score(x)
    assert s[good].mean() > s[~good].mean() and np.isclose((s < C.CUT).mean(), (~good).mean(), atol=0.01)
    assert np.mean((s >= C.CUT) == good) > 0.95


def test_fit_is_that_of_a_plain_loop(monkeypatch):
    """Gradient ascent of the pairs' likelihood, pair by pair."""
    monkeypatch.setattr(C, "PAIRS", 60)
    monkeypatch.setattr(C, "STEPS", 15)
    rng = np.random.default_rng(5)
    x, good = rng.normal(size=(30, 3)).astype(np.float32), np.arange(30) % 3 > 0
    x[:, 1] += good
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    draw = np.random.default_rng(0)
    pairs = list(zip(draw.choice(np.flatnonzero(good), 60), draw.choice(np.flatnonzero(~good), 60)))
    w = [0.0] * 3
    for _ in range(15):
        step = [0.0] * 3
        for a, b in pairs:
            diff = [float(z[a][k] - z[b][k]) for k in range(3)]
            p = 1 / (1 + np.exp(sum(d * v for d, v in zip(diff, w))))
            step = [s + p * d / len(pairs) for s, d in zip(step, diff)]
        w = [v + C.RATE * (s - C.RIDGE * v) for v, s in zip(w, step)]
    model = C.fit(x, good)
    assert np.allclose(model.weights, w, atol=1e-4)
    strength = sorted(float(sum(z[i][k] * w[k] for k in range(3))) for i in range(30))
    bad = int((~good).sum())
    assert model.cut == pytest.approx((strength[bad - 1] + strength[bad]) / 2, abs=1e-3)


def test_vocabulary_alone_is_learned(spark, tmp_path):
    """Texts of one shape that differ in their words only."""
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    text = lambda bad: " ".join(rng.choice(words[60:] if bad and rng.random() < 0.5 else words[:60]) for _ in range(120)) + "."
    rows = [(i, text(i % 3 == 0), None) for i in range(600)]
    docs = table(frame(spark, rows), tmp_path)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    got = C.score_texts(docs, C.train(docs, labels)).filter("doc_id >= 400").collect()
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in got]) > 0.9


def test_repeated_keys_stay_within_the_bound(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "MAX_LABELLED", 10)
    monkeypatch.setattr(C, "fit", lambda x, good: seen.append(len(x)))
    docs = table(frame(spark, [(i % 3, f"text {i}", None) for i in range(60)]), tmp_path)
    C.train(docs, spark.createDataFrame([(i % 3, i % 2) for i in range(9)], "doc_id long, quality int"))
    assert seen == [10]


def test_labels_of_one_kind_or_none():
    for good in (np.ones(5, bool), np.zeros(5, bool)):
        assert np.allclose(C.fit(np.ones((5, C.WIDTH)), good).score(np.ones((2, C.WIDTH))), 0.5)
    assert np.allclose(C.fit(np.zeros((0, C.WIDTH)), np.zeros(0, bool)).score(np.zeros((1, C.WIDTH))), 0.5)


def test_features_do_not_depend_on_the_batch():
    texts = [t for _, t, _ in corpus()]
    whole = C.features_of(pa.array(texts, pa.string()))
    single = np.concatenate([C.features_of(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, single) and np.isfinite(whole).all()
    assert not whole[texts.index(None)].any() and not whole[texts.index("")].any()


def test_tables_with_nulls_clashes_and_no_rows(spark, tmp_path):
    rows = corpus() + [(None, "no key", None)]
    docs = table(clashing(spark, rows), tmp_path)
    labels = spark.createDataFrame([(k, i % 2) for i, (k, _, _) in enumerate(rows[:60])] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = C.train(docs, labels)
    assert C.score_texts(docs, model).count() == len(rows)
    assert C.score_texts(frame(spark, []), model).count() == 0
    assert C.train(docs, labels.filter(F.lit(False))).cut == pytest.approx(np.log(C.CUT / (1 - C.CUT)))
