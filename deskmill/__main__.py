"""Jobs from the command line: ``spark-submit -m deskmill JOB ...`` or ``python -m deskmill JOB ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from deskmill.operators import audit, contracts, gold, profile, reports, review, search, splits
from deskmill.sources import tables
from deskmill.sources.store import cut


def acquire(spark: SparkSession, a: argparse.Namespace) -> dict:
    out = tables.acquire(spark, a.source, a.out, a.sha256, a.minimum_rows, a.url, a.overwrite)
    return {"rows": out.count()}


def prepare(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Prepared rows and split manifest as Parquet, and the summary as JSON."""
    from deskmill.plans.lifecycle import dataset_document

    raw = profile.require(tables.read_csv(spark, a.source), english_only=True)
    key = F.monotonically_increasing_id() if a.key is None else F.col(a.key).cast("long")
    made = splits.manifest(cut(raw.withColumn("doc_id", key), "keyed"))  # written once, so a row keeps its number
    made.write.mode("overwrite").parquet(f"{a.out}/prepared")
    prepared = spark.read.parquet(f"{a.out}/prepared")
    contracts.require(contracts.prepared_violations(prepared))
    prepared.select("doc_id", "ticket_row_id", "group_id", "split").write.mode("overwrite").option("header", True).csv(f"{a.out}/manifest")
    report = dataset_document(prepared)
    reports.write(spark, report, f"{a.out}/summary")
    return report


def leakage(spark: SparkSession, a: argparse.Namespace) -> dict:
    prepared = audit.check_texts(tables.read_prepared(spark, a.prepared))
    pairs = audit.cross_split_pairs(prepared, min(audit.THRESHOLDS))
    pairs.write.mode("overwrite").parquet(f"{a.out}/pairs")
    found = spark.read.parquet(f"{a.out}/pairs")
    report = {
        "thresholds": list(audit.THRESHOLDS), "pair_counts": reports.nested(audit.pair_counts(found), "split_pair", "threshold"), "affected": reports.nested(audit.affected(found), "split", "threshold"),
        "scores": reports.nested(profile.describe(found, [], "similarity", ("min", "p25", "median", "p75", "p90", "p95", "p98", "p99", "max"), digits=8)),
        "queues": reports.nested(audit.label_pairs(found, "queue"), "labels"), "priorities": reports.nested(audit.label_pairs(found, "priority"), "labels"),
        "repeated_subjects": reports.nested(audit.top_subjects(audit.repeated_subjects(prepared)), "subject"),
        "samples": [r.asDict() for r in audit.samples(found).collect()],
    }
    reports.write(spark, report, f"{a.out}/report")
    return report["pair_counts"]


def index(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The lexical index of the training split's texts."""
    corpus = spark.read.parquet(a.prepared).filter("split = 'train'").select("doc_id", F.col("classifier_text").alias("text"))
    search.LexicalIndex.build(corpus, a.most).save(a.out)
    return {"rows": search.LexicalIndex.load(spark, a.out).count}


def retrieve(spark: SparkSession, a: argparse.Namespace) -> dict:
    clock = search.Clock()
    found = search.LexicalIndex.load(spark, a.index).retrieve(query_text=a.text, k=a.k, clock=clock).orderBy("rank").collect()
    return {"found": [r.asDict() for r in found], "ms": clock.ms()}


def train_neural(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The convolutional comparison model, its vocabulary and its report."""
    from deskmill.operators import neural

    fitted, vocabulary, report = neural.train_and_evaluate(spark.read.parquet(a.prepared), epochs=a.epochs)
    fitted.model.save(spark, f"{a.out}/model")
    vocabulary.write.mode("overwrite").parquet(f"{a.out}/vocabulary")
    reports.write(spark, report, f"{a.out}/report")
    return report["metrics"]


def score_labels(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Metrics and evidence thresholds of a label CSV."""
    scored = gold.scored(tables.read_labels(spark, a.labels), a.split)
    thresholds = search.evidence_thresholds(scored)
    report = {"metrics": reports.nested(search.gold_metrics(scored)), "thresholds": reports.nested(thresholds, "threshold"), "selection": reports.nested(search.select_evidence(thresholds))}
    reports.write(spark, report, a.out)
    return report["metrics"]


def train(spark: SparkSession, a: argparse.Namespace) -> dict:
    from deskmill.operators import training

    made = training.run(tables.read_prepared(spark, a.prepared), a.label, a.rounds)
    training.save(made, a.out)
    return made.report["selected_model"]


def reviews(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"reviews": [r.asDict() for r in review.frame(spark.read.schema(review.RECORD).parquet(a.records), a.limit).collect()]}


JOBS = {
    "acquire": (acquire, {"--source": {}, "--out": {}, "--sha256": {"default": None, "required": False}, "--minimum-rows": {"type": int, "default": 1, "required": False}, "--url": {"default": None, "required": False}, "--overwrite": {"action": "store_true", "required": False}}),
    "prepare": (prepare, {"--source": {}, "--out": {}, "--key": {"default": None, "required": False}}),
    "leakage": (leakage, {"--prepared": {}, "--out": {}}),
    "index": (index, {"--prepared": {}, "--out": {}, "--most": {"type": int, "default": 100_000, "required": False}}),
    "retrieve": (retrieve, {"--index": {}, "--text": {}, "--k": {"type": int, "default": 5, "required": False}}),
    "train": (train, {"--prepared": {}, "--out": {}, "--label": {"default": "queue", "required": False}, "--rounds": {"type": int, "default": None, "required": False}}),
    "train-neural": (train_neural, {"--prepared": {}, "--out": {}, "--epochs": {"type": int, "default": 12, "required": False}}),
    "score-labels": (score_labels, {"--labels": {}, "--split": {}, "--out": {}}),
    "reviews": (reviews, {"--records": {}, "--limit": {"type": int, "default": 100, "required": False}}),
}


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="deskmill")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, (_, options) in JOBS.items():
        sub = jobs.add_parser(name)
        for flag, how in options.items():
            sub.add_argument(flag, **{"required": True, **how})
    a = parser.parse_args(argv)
    out = JOBS[a.job][0](SparkSession.builder.appName(f"deskmill-{a.job}").getOrCreate(), a)
    print(json.dumps(out, indent=2, sort_keys=True, default=str))
    return out


if __name__ == "__main__":
    main()
