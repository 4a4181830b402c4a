"""The keyed store, review records in it, and the neural model on small cases."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskmill.operators import ml, neural, review
from deskmill.sources.keyed import Conflict, Keyed

AT = datetime(2024, 5, 1)


def analyses(spark, ids):
    rows = [(k, AT, f"text {k}", "billing", 0.5, ["TP-1"], "A draft.", {"model": "m"}) for k in ids]
    return review.records(spark.createDataFrame(rows, "analysis_id string, created_at timestamp, ticket_text string, predicted_queue string, queue_confidence double, evidence_ids array<string>, draft string, provider map<string,string>"))


def actions(spark, *rows):
    return spark.createDataFrame([(k, a, q, d, None, AT) for k, a, q, d in rows], "analysis_id string, action string, queue string, draft string, notes string, at timestamp")


def state(kept, version=None):
    return {r["analysis_id"]: (r["state"], r["final_queue"], r["version"]) for r in kept.read(version).collect()}


def test_review_store(spark, tmp_path):
    kept = review.store(spark, str(tmp_path))
    assert kept.version() == 0 and kept.read().count() == 0
    assert review.create(kept, analyses(spark, "abc")) == 1
    assert state(kept) == {k: ("pending", None, 1) for k in "abc"}
    assert review.submit(kept, actions(spark, ("a", "accept", None, None), ("b", "reroute", "sales", None))) == 2
    assert state(kept) == {"a": ("approved", "billing", 2), "b": ("edited", "sales", 2), "c": ("pending", None, 1)}
    assert state(kept, 1) == {k: ("pending", None, 1) for k in "abc"}  # an old version stays readable
    for rows, why in (([("a", "reject", None, None)], "not pending"), ([("z", "accept", None, None)], "unknown"), ([("c", "edit", None, " ")], "not valid"), ([("c", "nod", None, None)], "not valid")):
        with pytest.raises(ValueError, match=why):
            review.submit(kept, actions(spark, *rows))
    with pytest.raises(ValueError, match="exists"):
        review.create(kept, analyses(spark, "cd"))
    with pytest.raises(ValueError, match="twice"):
        review.submit(kept, actions(spark, ("c", "accept", None, None), ("c", "reject", None, None)))
    assert kept.version() == 2


def test_two_writers(spark, tmp_path):
    """Of two who read one version, the first to commit wins on a record; on another record both do."""
    kept, other = review.store(spark, str(tmp_path)), review.store(spark, str(tmp_path))
    review.create(kept, analyses(spark, "abc"))
    read = other.version()
    review.submit(kept, actions(spark, ("a", "accept", None, None)))
    with pytest.raises(Conflict):
        review.submit(other, actions(spark, ("a", "reject", None, None)), read)
    assert review.submit(other, actions(spark, ("b", "reject", None, None)), read) == 3
    assert {k: v[0] for k, v in state(kept).items()} == {"a": "approved", "b": "rejected", "c": "pending"}
    assert not other.claim(3, {"rows": "never"}) and kept.version() == 3
    with pytest.raises(Conflict):  # a new record that another writer made in between
        other.commit(kept.read().filter("analysis_id = 'b'").drop("version"), 2)


def test_crash_between_write_and_commit(spark, tmp_path):
    kept = review.store(spark, str(tmp_path))
    review.create(kept, analyses(spark, "ab"))
    kept.write_rows(kept.read().withColumn("state", F.lit("lost")), "orphan", 2)  # and then the writer is gone
    (tmp_path / "commits" / "_half").write_text("{")
    again = review.store(spark, str(tmp_path))
    assert {v[0] for v in state(again).values()} == {"pending"} and again.version() == 1
    review.submit(again, actions(spark, ("a", "accept", None, None)))
    assert again.vacuum() == 1
    assert again.compact() == 3
    review.submit(again, actions(spark, ("b", "accept", None, None)))
    assert state(again) == {"a": ("approved", "billing", 2), "b": ("approved", "billing", 4)}
    assert again.vacuum() == 2 and state(Keyed(spark, str(tmp_path), kept.schema, kept.key)) == state(again)


# ---- the neural model ---------------------------------------------------------------------------------------------


def test_gradient_is_the_slope():
    """Against finite differences, with dropout and weights, for every parameter."""
    rng = np.random.default_rng(1)
    model = neural.Model.new(["a", "b", "c"], words=30, embedding=6, filters=5, seed=3)
    p = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in model.p.items()}
    ids, y, w = rng.integers(0, 30, (7, 9)), rng.integers(0, 3, 7), rng.uniform(0.5, 2, 7)
    masks = ((rng.random((7, 6)) > 0.2) / 0.8, (rng.random((7, 5)) > 0.4) / 0.6)
    loss, g, words, dwords = neural.gradient(p, ids, y, w, masks)
    g["words"] = np.zeros_like(p["words"])
    g["words"][words] = dwords
    for k, v in p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(12)]:
            up, down = ({**p, k: v.copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            slope = (neural.gradient(up, ids, y, w, masks)[0] - neural.gradient(down, ids, y, w, masks)[0]) / 2e-6
            assert g[k][at] == pytest.approx(slope, abs=1e-5)


def test_gradient_keeps_to_the_maxima():
    """Only words in the window of some filter's maximum get a row, also at both ends of a text and where no filter is above zero."""
    rng = np.random.default_rng(4)
    model = neural.Model.new(["a", "b"], words=400, embedding=4, filters=2, seed=9)
    ids, y, w = rng.permutation(400).reshape(4, 100), rng.integers(0, 2, 4), np.ones(4)
    _, _, words, dwords = neural.gradient(model.p, ids, y, w)
    assert 0 < len(words) <= 4 * 2 * neural.WIDTH and (np.diff(words) > 0).all() and np.abs(dwords).sum(axis=1).all()
    loss, g, words, dwords = neural.gradient({**model.p, "bias": np.full(2, -9.0)}, ids, y, w)
    assert len(words) == 0 and dwords.shape == (0, 4) and not g["kernel"].any() and g["shift"].any() and loss > 0


def planted(spark, n, seed):
    """Texts whose class is told by a pair of words in order, not by the words alone."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rng.random() < 0.5) + int(rng.random() < 0.2)
        words = [f"w{x}" for x in rng.integers(0, 40, 14)]
        at = int(rng.integers(0, 12))
        words[at : at + 2] = (["red", "door"], ["door", "red"], ["blue", "red"])[k]
        rows.append((i, ("train", "train", "validation", "test")[i % 4], " ".join(words), "xyz"[k]))
    return spark.createDataFrame(rows, "doc_id long, split string, classifier_text string, queue string")


def test_gradient_sums_over_tasks(spark):
    """The gradient of all rows does not depend on how they are dealt."""
    rows = planted(spark, 60, 2)
    words = ml.fit_vocabulary(rows)
    x = ml.sequences(rows, words, length=14).join(rows.select("doc_id", "queue"), "doc_id").select("doc_id", "ids", F.when(F.col("queue") == "x", 0).otherwise(1).cast("long").alias("y"), F.lit(1.5).alias("w")).cache()
    model = neural.Model.new(["x", "o"], words=100, embedding=8, filters=6)
    one, n, g = neural.step_gradient(x.coalesce(1), model, 4)
    two, m, h = neural.step_gradient(x.repartition(5), model, 4)
    assert n == m == 60 and one == pytest.approx(two)
    assert all(np.allclose(g[k], h[k]) for k in g)
    data = x.orderBy("doc_id").collect()
    masks = tuple((neural._random(neural.SEED + k, 4, np.array([r["doc_id"] for r in data]), size) >= rate) / (1 - rate) for k, (size, rate) in enumerate(((8, neural.DROP_WORDS), (6, neural.DROP_TOP))))
    loss, own, which, dwords = neural.gradient(model.p, np.array([r["ids"] for r in data]), np.array([r["y"] for r in data]), np.full(60, 1.5), masks)
    assert loss == pytest.approx(one) and np.allclose(own["kernel"], g["kernel"]) and np.allclose(g["words"][which], dwords)


def test_conv1d_training(spark, tmp_path):
    """Beats the most frequent class by far on planted text, keeps the best epoch, is the same again, and survives a round trip."""
    how = {"most": 60, "epochs": 6, "steps": 4, "embedding": 16, "filters": 24, "rate": 0.03}
    prepared = planted(spark, 480, 5)
    fitted, vocabulary, report = neural.train_and_evaluate(prepared, **how)
    dummy = max(r["count"] for r in prepared.filter("split = 'test'").groupBy("queue").count().collect()) / 120
    test = report["metrics"]["test"]
    assert test["accuracy"] > dummy + 0.25 and 0 <= test["ece"] <= 1 and test["log_loss"] < 0.9
    best = min(h["val_loss"] for h in fitted.history)
    x = ml.sequences(prepared, vocabulary).join(prepared.select("doc_id", "split", F.col("queue").alias("truth")), "doc_id")
    assert neural.log_loss(neural.scores(fitted.model, x.filter("split = 'validation'"))) == pytest.approx(best)
    fitted.model.save(spark, str(tmp_path / "model"))
    again = neural.Model.load(spark, str(tmp_path / "model"))
    assert again.classes == ["x", "y", "z"] and all((again.p[k] == v).all() for k, v in fitted.model.p.items())
    table = neural.comparison(spark, {"conv1d": report["metrics"], "dummy": {"test": {"accuracy": dummy}}}).collect()
    assert {(r["model"], r["split"]) for r in table} == {("conv1d", "validation"), ("conv1d", "test"), ("dummy", "test")}


def test_early_stopping(spark, monkeypatch):
    """Training ends after ``patience`` epochs without a lower validation loss; the parameters of the least one come back."""
    losses = iter([0.9, 0.5, 0.7, 0.6, 0.1])
    monkeypatch.setattr(neural, "log_loss", lambda _: next(losses))
    rows = planted(spark, 24, 7)
    x = ml.sequences(rows, ml.fit_vocabulary(rows), length=14).join(rows.select("doc_id", F.col("queue").alias("truth")), "doc_id")
    fitted = neural.fit(x, x, ["x", "y", "z"], 100, epochs=5, steps=1, embedding=4, filters=4)
    assert [h["val_loss"] for h in fitted.history] == [0.9, 0.5, 0.7, 0.6]
    two = neural.fit
    losses = iter([0.9, 0.5])
    monkeypatch.setattr(neural, "log_loss", lambda _: next(losses))
    short = two(x, x, ["x", "y", "z"], 100, epochs=2, steps=1, embedding=4, filters=4)
    assert all(np.allclose(short.model.p[k], v) for k, v in fitted.model.p.items())
    with pytest.raises(ValueError, match="no training rows"):
        neural.fit(x.limit(0), x, ["x"], 100)


# ---- support vectors ----------------------------------------------------------------------------------------------


def _classes(spark, n, k, seed):
    """Rows around k centres in 12 places, as sparse vectors with balanced weights."""
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(k, 12)) * 2
    y = rng.integers(0, k, n)
    x = centre[y] + rng.normal(size=(n, 12))
    x[rng.random((n, 12)) < 0.3] = 0
    rows = [(i, Vectors.sparse(12, {int(j): float(v) for j, v in enumerate(x[i]) if v}), float(y[i]), float(rng.uniform(0.5, 2))) for i in range(n)]
    return spark.createDataFrame(rows, ["doc_id", "features", "y", "w"]).repartition(3), x, y


def test_svc_in_one_pass(spark, monkeypatch):
    """Each class is fitted as if it were alone, in as many passes as one; predictions are those of one-vs-rest."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    rows, x, y = _classes(spark, 300, 5, 3)
    passes = []
    real = ml.hinge
    monkeypatch.setattr(ml, "hinge", lambda *a: (passes.append(1), real(*a))[1])
    model = ml.Svc(20, 1e-2).fit(rows)
    together = len(passes)
    margin = x @ model.w[:-1] + model.w[-1]
    for c in (0, 3):
        passes.clear()
        alone = ml.Svc(20, 1e-2).fit(rows.withColumn("y", F.when(F.col("y") == c, 0.0).otherwise(1.0)), 1)
        assert np.allclose(x @ alone.w[:-1, 0] + alone.w[-1, 0], margin[:, c], atol=2e-2)
        assert together <= 2 * len(passes) + 10  # not a multiple of the classes
    other = OneVsRest(classifier=LinearSVC(maxIter=60, regParam=1e-3), labelCol="y", weightCol="w").fit(rows).transform(rows).select("doc_id", "prediction").collect()
    same = np.mean([margin[r["doc_id"]].argmax() == r["prediction"] for r in other])
    assert same > 0.95 and np.mean(margin.argmax(1) == y) > 0.85


def test_hinge_slope(spark):
    rows, x, y = _classes(spark, 40, 3, 4)
    w = np.random.default_rng(1).normal(size=(13, 3)) * 0.2
    value, slope = ml.hinge(rows, w)
    for at in [(0, 0), (5, 1), (12, 2), (3, 2)]:
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert slope[at] == pytest.approx((ml.hinge(rows, up)[0][at[1]] - ml.hinge(rows, down)[0][at[1]]) / 2e-5, abs=1e-6)
    with pytest.raises(ValueError, match="no training rows"):
        ml.Svc().fit(rows.limit(0))
