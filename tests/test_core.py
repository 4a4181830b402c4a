"""Reference-anchored values and edge cases of the core operators."""

import difflib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from deskmill.functions import text as X
from deskmill.operators import audit, classify, gates, ml, profile, review, search, splits
from deskmill.sources import tables
from deskmill.streaming import reviews


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string" if v is None or isinstance(v, str) else "double" for v in values.values()]))) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, X.classifier_text(F.col("a"), F.col("b")), a=" Printer error  ", b="Line one\nLine two") == "Printer error\n\nLine one Line two"
    assert one(spark, X.fold(F.col("a")), a=" Stra\xa0ße ") == "stra sse"
    assert one(spark, X.preview(F.col("a"), 10), a="abcdef  ghijklmnop") == "abcdef..."
    assert one(spark, X.word_count(F.col("a")), a=None) == 0
    assert one(spark, X.row_id(F.lit(1234567))) == "ticket-1234567"
    assert one(spark, X.clamp_probability(F.lit(float("nan")))) == 0.0
    assert one(spark, X.softmax(F.array(F.lit(1.0), F.lit(1.0)))) == [0.5, 0.5]
    assert one(spark, X.l2_normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, X.split_pair(F.lit("test"), F.lit("train"))) == "train_vs_test"
    assert one(spark, X.threshold_key(F.lit(0.9))) == ">=0.90"
    assert [one(spark, X.relevance(F.col("a")), a=v) for v in ("2", " 1.0 ", "3", "x", None)] == [2, 1, None, None, None]


TICKETS = "doc_id long, subject string, body string, queue string, priority string"


def test_splits(spark):
    rows = [(i, f"subject {i % 23 if i != 5 else 0}", f"text {i if i not in (0, 5) else 'same'}", f"q{i % 4}", ("low", "medium", "high")[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, TICKETS)
    a = {r["doc_id"]: (r["group_id"], r["split"]) for r in splits.manifest(df).collect()}
    assert a == {r["doc_id"]: (r["group_id"], r["split"]) for r in splits.manifest(df.repartition(3)).collect()}
    assert a[0] == a[5] and len({g for g, _ in a.values()}) == 239
    assert {s for _, s in a.values()} == {"train", "validation", "test"}
    n = [sum(s == k for _, s in a.values()) for k in ("train", "validation", "test")]
    assert n[0] > 160 and n[1] == n[2]


def test_half_even(spark):
    groups = spark.createDataFrame([(f"g{i}", "s") for i in range(30)], "group_id string, stratum string")
    n = {r["split"]: r["count"] for r in splits.deal(groups).groupBy("split").count().collect()}
    assert n == {"train": 22, "validation": 4, "test": 4}  # 4.5 rounds to 4


def test_gold_metrics(spark):
    rows = [(q, k + 1, v, 0.5) for q, labels in (("q1", [0, 2, 0, 1, 0]), ("q2", [1, 0, 0, 0, 0])) for k, v in enumerate(labels)]
    r = search.gold_metrics(spark.createDataFrame(rows, "query_id string, rank int, label int, score double")).first()
    assert (r["recall_1"], r["recall_3"], r["recall_5"], r["mrr"]) == (0.5, 1.0, 1.0, 0.75)
    assert r["ndcg_5"] == pytest.approx(0.819955, abs=1e-6)
    assert (r["label_0"], r["label_1"], r["label_2"]) == (7, 2, 1)


def test_evidence(spark):
    rows = [(f"q{i}", 1, v, s) for i, (s, v) in enumerate([(0.45, 2), (0.40, 1), (0.37, 0), (0.2, 0)])]
    t = search.evidence_thresholds(spark.createDataFrame(rows, "query_id string, rank int, label int, score double"))
    assert search.select_evidence(t).first()["threshold"] == 0.39
    r = t.filter("threshold = 0.39").first()
    assert (r["allowed_rate"], r["precision"]) == (0.5, 1.0)
    assert t.filter("threshold = 0.75").first()["precision"] is None


def prediction_frame(spark):
    return spark.createDataFrame([(1, "a", "a", 0.9, ["a"]), (2, "a", "b", 0.6, ["b"]), (3, "b", "b", 0.8, ["b"]), (4, "b", "a", 0.4, ["a"])], "vec_id long, truth string, predicted string, confidence double, top3 array<string>")


def test_abstention(spark):
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    r = classify.coverage_curve(prediction_frame(spark), labels).filter("threshold = 0.75").first()
    assert (r["coverage"], r["review_rate"], r["accuracy"], r["macro_f1"]) == (0.5, 0.5, 1.0, 1.0)
    assert classify.coverage_curve(prediction_frame(spark), labels).filter("threshold = 1.0").first()["accuracy"] == 0.0


def test_bins(spark):
    rows = [(i, "a", "a", c, ["a"]) for i, c in enumerate([0.3, 0.30000000000000004, 1.0, 0.0])]
    b = {r["bin"]: r["n"] for r in classify.bins(spark.createDataFrame(rows, "vec_id long, truth string, predicted string, confidence double, top3 array<string>")).collect()}
    assert (b[2], b[3], b[9], b[0], b[5]) == (1, 1, 1, 1, 0)


def test_leakage(spark):
    words = [f"w{i}" for i in range(40)]
    base = " ".join(words)
    rows = [("g1", 0, "train", base, "a", "x"), ("g2", 1, "validation", base + " extra", "a", "x"), ("g3", 2, "test", "other words entirely", "b", "x"), ("g1", 3, "train", base, "a", "x")]
    m = spark.createDataFrame(rows, "group_id string, doc_id long, split string, classifier_text string, queue string, priority string")
    p = audit.cross_split_pairs(m).collect()
    assert [(r["left_doc_id"], r["right_doc_id"], r["left_size"]) for r in p] == [(0, 1, 2)]
    counts = {(r["split_pair"], r["threshold"]): r["n"] for r in audit.pair_counts(audit.cross_split_pairs(m)).collect()}
    assert counts["train_vs_validation", ">=0.90"] == 2 and counts["train_vs_test", ">=0.90"] == 0 and len(counts) == 9
    hit = {(r["split"], r["threshold"]): r["n"] for r in audit.affected(audit.cross_split_pairs(m)).collect()}
    assert hit["train", ">=0.90"] == 2 and hit["test", ">=0.90"] == 0


def test_repeated_subjects(spark):
    rows = [(i, s, "Same", q) for i, (s, q) in enumerate([("train", "a"), ("validation", "a"), ("test", "b")])]
    r = audit.repeated_subjects(spark.createDataFrame(rows, "doc_id long, split string, subject string, queue string")).collect()
    assert [(x["pairs"], x["same_queue"], x["different_queue"]) for x in r] == [(3, 1, 2)]


def test_high_similarity(spark):
    base = "one two three four five six seven eight " + "tail " * 20
    rows = [(1, base + "a"), (2, base + "b"), (3, "one two three four five six seven eight other things here"), (4, base + "a")]
    got = audit.high_similarity_pairs(spark.createDataFrame(rows, "doc_id long, classifier_text string")).collect()
    assert [(r["left_id"], r["right_id"]) for r in got] == [(1, 2)]
    assert got[0]["ratio"] == difflib.SequenceMatcher(None, base + "a", base + "b").ratio()


def test_mentions(spark):
    rows = [(1, "Billing is down", "x", "billing", "low"), (2, None, "high load", "it", "high"), (3, "fine", "fine", "it", None), (4, "ok", "ok", "zzz", "low")]
    r = {x["field"]: (x["n"], x["rate"]) for x in profile.mention_report(spark.createDataFrame(rows, TICKETS)).collect()}
    assert r["queue_any"] == (1, 0.25) and r["priority_any"] == (1, 0.25) and r["any_label"] == (2, 0.5)


def test_contract(spark, tmp_path):
    row = dict.fromkeys(tables.TICKET_COLUMNS, "x") | {"body": 'a "quoted"\nline', "type": "Incident", "priority": "low", "language": "en", "subject": None}
    ok = spark.createDataFrame([tuple(row.values()), tuple((row | {"language": "de"}).values())], tables.TICKET_SCHEMA)
    tables.write_csv(ok.coalesce(1), str(tmp_path / "in"))
    out = tables.acquire(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert out.count() == 1 and tables.read_csv(spark, str(tmp_path / "out")).first()["body"] == row["body"]
    with pytest.raises(ValueError, match="priority"):
        profile.require(ok.withColumn("priority", F.lit("urgent")))
    with pytest.raises(ValueError, match="rows"):
        profile.require(ok, minimum_rows=3)
    with pytest.raises(ValueError, match="order"):
        tables.check_columns(list(reversed(tables.TICKET_COLUMNS)), tables.TICKET_COLUMNS)
    with pytest.raises(ValueError, match="not allowed"):
        profile.check_features(["subject", "queue"])
    tables.write_report(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "report"))
    assert tables.read_report(spark, str(tmp_path / "report")).first()["a"] == "x"


ACTIONS = "analysis_id long, seq long, at timestamp, action string, draft string, queue string, predicted_queue string"


def action_rows():
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    return [(1, 1, t(1), "edit", " ", None, "q"), (1, 2, t(2), "accept", None, None, "q"), (1, 3, t(3), "reject", None, None, "q"), (2, 4, t(1), "reroute", None, "new", "q"), (3, 5, t(1), "other", None, None, "q"), (4, 6, t(1), "mark_insufficient", None, None, "q"), (5, 7, t(1), "edit", "text", None, "q")]


def test_review(spark):
    got = {r["analysis_id"]: (r["state"], r["final_queue"], r["rejected_actions"]) for r in review.states(spark.createDataFrame(action_rows(), ACTIONS)).collect()}
    assert got == {1: ("approved", "q", 2), 2: ("edited", "new", 0), 3: ("pending", None, 1), 4: ("rejected", None, 0), 5: ("edited", None, 0)}
    log = spark.createDataFrame([(1, 0.5, "t")], "analysis_id long, queue_confidence double, ticket_text string")
    with pytest.raises(ValueError, match="exists"):
        review.append(log, log)
    with pytest.raises(ValueError, match="valid"):
        review.append(log, spark.createDataFrame([(2, 1.5, "t")], log.schema))


def test_review_stream(spark, tmp_path):
    df = spark.createDataFrame(action_rows(), ACTIONS)
    df.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = reviews.writer(stream, str(tmp_path / "cp"), str(tmp_path / "out")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, reviews.current(spark, str(tmp_path / "out")).select(review.states(df).columns).collect())) == sorted(map(str, review.states(df).collect()))


def test_gates(spark):
    ev = "array<struct<source_id:string,similarity:double>>"
    rows = [(1, 0.9, [("TP-1", 0.5), ("TP-2", 0.4), ("TP-3", 0.1)]), (2, 0.1, [("TP-1", 0.9)]), (3, 0.9, []), (4, 0.9, [("TP-1", 0.2)]), (5, 0.3, [("TP-1", 0.39)])]
    r = spark.createDataFrame(rows, f"id long, confidence double, evidence {ev}")
    made = gates.drafts(r)
    assert [(x["gate"], x["citations"]) for x in made.orderBy("id").collect()] == [("pass", ["TP-1", "TP-2"]), ("low_confidence", []), ("no_evidence", []), ("weak_evidence", []), ("pass", ["TP-1"])]
    assert all(not x["violations"] for x in gates.draft_violations(made).collect())
    assert gates.reasons(r).orderBy("id").first()["reasons"] == "human_review_required"


def test_metadata_filter(spark):
    with pytest.raises(ValueError):
        search.metadata_filter(spark.range(1), {"answer": "x"})


def test_sigmoid(spark):
    rows = [("a", m / 10, float(m > 0 or m == -1)) for m in range(-20, 21)]
    p = ml.sigmoid(spark.createDataFrame(rows, "label string, margin double, y double")).first()
    assert p["a"] < -1
