import numpy as np
from pyspark.sql import functions as F

from wayline.llm.common import read
from wayline.llm.quality import _holds, compile_score, fit_quality, fit_rules, fold, learning_labels, op10_quality, score_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    out = op10_quality(spark, SF).where("held_out").join(read(spark, SF, "labels"), "doc_id").select("score", "predicted", "quality").toPandas()
    bad, good = out[out.quality == 0], out[out.quality == 1]
    assert len(bad) > 50 and len(good) > 300
    assert (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.9
    ranks = out.score.rank()
    auc = (ranks[out.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.97


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(int)
    model = fit_rules(x, y, ("a", "b", "c"))
    margin = model.bias + sum(w * _holds(r, x) for r, w in zip(model.rules, model.weights))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r[0] for r in df.select(compile_score(model, {k: k for k in "abc"})).collect()])
    assert np.abs(got - 1 / (1 + np.exp(-margin))).max() < 1e-9
    assert ((got > 0.5) == y).mean() > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b", 9), (3, "x" * 100_000, 9), (3, "x", 9)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    out = score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 5
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    nothing = fit_quality(docs.limit(0), labels)
    assert {r["score"] for r in score_quality(docs, nothing).collect()} == {0.5}
    assert score_quality(docs.limit(0), model).count() == 0
    assert learning_labels(spark, SF).where(fold(F.col("doc_id")) == 0).count() == 0


def test_statistics_of_whole_texts(monkeypatch):
    from wayline.llm import quality

    texts = [None, "", "Ab, cd!\nAb, cd!\nÉtE 12 12 |", "a " * 50 + "ü", " \n"]
    whole = quality.text_statistics(texts)
    monkeypatch.setattr(quality, "BLOCK", 7)
    cut = quality.text_statistics(texts)
    assert all((whole[f] == cut[f]).all() for f in quality.FEATURES)
    get = lambda f: whole[f][2]
    assert get("chars") == np.log1p(27) and get("words") == np.log1p(8) and get("word_length") == 20 / 8 and get("line_words") == 8 / 3
    assert get("upper") == 4 / 27 and get("digits") == 4 / 27 and get("stops") == 2 / 8 and get("shouts") == 2 / 8 and get("bars") == 1 / 8
    assert get("word_repeats") == 1 / 8 and get("line_repeats") == 1 / 3
    assert all(whole[f][k] == 0 for f in quality.FEATURES for k in (0, 1))
