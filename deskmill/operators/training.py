"""The classifier's lifecycle: baselines on the training split, choice on validation, calibration, threshold, a final fit, one look at the test split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.text import SPLITS
from deskmill.operators import classify, ml, profile, reports, search
from deskmill.sources import svg
from deskmill.sources.store import cut


@dataclass
class Trained:
    """The final model, its terms and the report."""

    model: ml.Calibrated
    terms: DataFrame
    report: dict


def _metrics(scores: DataFrame, labels: DataFrame) -> tuple[dict, DataFrame]:
    """Summary of (vec_id, truth, label, p) scores, and their predictions."""
    pred = cut(classify.predictions(scores.withColumn("split", F.lit("held"))), "baseline-predictions")
    return reports.nested(classify.summary(pred, labels)), pred


def run(prepared: DataFrame, label: str = "queue", rounds: int | None = None, minimum_coverage: float = classify.MIN_COVERAGE) -> Trained:
    """From (doc_id, split, subject, body, classifier_text, label) rows. Validation chooses the baseline and the threshold; the test split is
    only reported."""
    rows = cut(prepared.filter(F.col(label).isNotNull()).select("doc_id", "split", "subject", "body", "classifier_text", label), "training-rows")
    part = {s: rows.filter(F.col("split") == s) for s in SPLITS}
    if empty := [s for s, df in part.items() if df.isEmpty()]:
        raise ValueError(f"no rows of {', '.join(empty)}")
    names = cut(rows.select(F.col(label).alias("label")).distinct(), "training-labels")
    encoder = cut(classify.encode_labels(part["train"].select(F.col(label).alias("label"))), "training-encoder")
    fitted = ml.fit_terms(part["train"])
    x = ml.features(rows, fitted, keep=("split", label))
    of = lambda s: x.filter(F.col("split") == s)

    validation, histories = {}, {}
    for name in ml.REGISTRY:
        estimator = ml.baseline(name, rounds)
        if estimator is None:
            scores = ml.dummy_scores(of("train"), of("validation"), encoder, label)
        else:
            model = estimator.fit(ml._ready(of("train"), label, encoder))
            if hasattr(model, "summary"):
                histories[name] = [r["loss"] for r in ml.history(model).orderBy("step").collect()]
                scores = ml.probabilities(model, of("validation"), encoder, label)
            else:
                scores = ml.margins(model, of("validation"), encoder, label).withColumnRenamed("margin", "p")
        validation[name], _ = _metrics(scores, names)
    spark = prepared.sparkSession
    keys = ("macro_f1", "weighted_f1", "accuracy")
    chosen = classify.select_model(spark.createDataFrame([(n, *(m[k] for k in keys)) for n, m in validation.items()], "model string, macro_f1 double, weighted_f1 double, accuracy double")).first()["model"]

    calibrated = ml.Calibrated.fit(of("train"), label, rounds or 20).scores(of("validation"))
    seen, pred = _metrics(cut(calibrated, "validation-scores"), names)
    curve = classify.coverage_curve(pred, names)
    threshold = reports.nested(classify.select_abstention(curve, minimum_coverage))

    both = part["train"].unionByName(part["validation"])
    final_terms = ml.fit_terms(both)
    y = ml.features(rows, final_terms, keep=("split", label))
    final = ml.Calibrated.fit(y.filter("split <> 'test'"), label, rounds or 20)
    clock = search.Clock()
    scores = cut(final.scores(y.filter("split = 'test'"), clock), "test-scores")
    test, pred = _metrics(scores, names)
    at = classify.coverage_curve(pred, names).filter(F.abs(F.col("threshold") - threshold["threshold"]) < 1e-9)
    report = {
        "labels": [r["label"] for r in names.orderBy("label").collect()], "class_distribution": {s: reports.nested(profile.distribution(df, label).withColumnRenamed("value", "label"), "label") for s, df in part.items()},
        "label_mentions": _mentions(part["train"]) if label == "queue" else {}, "validation_metrics": validation, "training_history": histories, "selected_model": {"name": chosen, "final": "calibrated_linear_svc", "calibration": f"sigmoid, {ml.FOLDS} folds"},
        "calibrated_validation": {**seen, "threshold": threshold, "curve": reports.nested(curve, "threshold")},
        "test_metrics": {**test, "ms_per_row": clock.ms() / max(1, test["n"]), "calibration": reports.nested(classify.calibration(scores, pred)), "at_threshold": reports.nested(at), "bins": reports.nested(classify.bins(pred), "bin"), "per_class": reports.nested(classify.per_queue_confidence(pred, names), "label"), "confusion": reports.nested(classify.confusion(pred), "truth", "predicted")},
    }
    return Trained(final, final_terms, report)


def _mentions(train: DataFrame) -> dict:
    """How often texts hold their own label; a helper of the report."""
    return reports.nested(profile.mention_report(train.withColumn("priority", F.lit(None).cast("string"))), "field")


def save(trained: Trained, path: str) -> None:
    """Model, terms, report, and its charts under one path."""
    spark = trained.terms.sparkSession
    trained.model.save(f"{path}/model")
    trained.terms.write.mode("overwrite").parquet(f"{path}/terms")
    reports.write(spark, trained.report, f"{path}/report")
    t = trained.report["test_metrics"]
    counts = {(a, b): n for a, row in t["confusion"].items() for b, n in row.items()}
    labels = [str(x) for x in trained.report["labels"]]
    svg.write(spark, svg.confusion(labels, counts), f"{path}/confusion")
    svg.write(spark, svg.bars([(k, m["macro_f1"]) for k, m in trained.report["validation_metrics"].items()], "Validation macro F1"), f"{path}/models")
    svg.write(spark, svg.reliability([(b["mean_confidence"], b["accuracy"], b["n"]) for b in t["bins"].values()]), f"{path}/reliability")
    history = [(name, i, x) for name, xs in trained.report["training_history"].items() for i, x in enumerate(xs)]
    spark.createDataFrame(history, "model string, step long, loss double").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/history")
    wide = [(a, *(counts.get((a, b), 0) for b in labels)) for a in labels]
    spark.createDataFrame(wide, ["label", *labels]).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/confusion-table")
