"""Indexes, reports, contracts, gold sampling, drafts, training and exact quantiles on small cases."""

import hashlib
import json
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskmill.functions import text as X
from deskmill.operators import audit, classify, contracts, gates, gold, ml, quantiles, reports, review, search, splits
from deskmill.sources import svg

# ---- quantiles and splits -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 5.0 / accuracy)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=777), "b": rng.integers(0, 4, 500).astype(float), "c": np.array([2.5]), None: np.array([1.0, 9.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    points = {"p25": 0.25, "median": 0.5, "p99": 0.99}
    got = {r["k"]: r for r in quantiles.describe(df, ["k"], "v", points).collect()}
    assert set(got) == {*groups, "d"}
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs) and got[k]["mean"] == pytest.approx(vs.mean()) and (got[k]["min"], got[k]["max"]) == (vs.min(), vs.max())
        assert [got[k][n] for n in points] == pytest.approx(np.quantile(vs, list(points.values())).tolist())
    assert got["d"]["n"] == 0 and got["d"]["median"] is None
    whole = quantiles.describe(df, [], "v", {"median": 0.5}).first()
    assert whole["median"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    none = quantiles.describe(df.limit(0), [], "v", {"median": 0.5}).collect()
    assert len(none) == 1 and none[0]["n"] == 0 and none[0]["median"] is None


def test_quantiles_order_few_values(spark):
    """Of 200,000 values only those near a wanted rank are told apart, in one scan after the first."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    plan = quantiles.describe(df, [], "v", {"p25": 0.25, "p99": 0.99})
    values = np.arange(200_000) * 7919 % 200_003
    got = plan.collect()[0]
    assert [got["p25"], got["p99"]] == np.quantile(values, [0.25, 0.99]).tolist()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[0].count("Range (0, 200000") == 1  # the first scan is done; its figures are a table of one row


def test_full_case_folding(spark):
    """Equal to Python's casefold on every code point that its Unicode version assigns, alone and in a word."""
    points = [chr(i) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) not in ("Cs", "Cn", "Co")]
    df = spark.createDataFrame([(c, f"aB{c}Z") for c in points], "c string, w string")
    got = df.select("c", X.fold_clean(F.col("c")).alias("f"), X.fold_clean(F.col("w")).alias("g")).collect()
    assert [r["c"] for r in got if r["f"] != r["c"].casefold() or r["g"] != f"ab{r['c'].casefold()}z"] == []
    assert spark.createDataFrame([(" Straße\u2003ΌΣΟΣ\t",)], "t string").select(X.fold(F.col("t"))).first()[0] == "strasse όσοσ"


@pytest.mark.parametrize("digits", [1, 3])
def test_deal_is_the_hash_order(spark, monkeypatch, digits):
    monkeypatch.setattr(splits, "DIGITS", digits)
    groups = [(f"g{i}", s) for s, n in (("x", 500), ("y", 7), ("z", 2), ("w", 1)) for i in range(n)]
    groups = [(f"{s}-{g}", s) for g, s in groups]
    got = {r["group_id"]: r["split"] for r in splits.deal(spark.createDataFrame(groups, "group_id string, stratum string").repartition(3)).collect()}
    for s in "xyzw":
        ids = sorted((g for g, t in groups if t == s), key=lambda g: hashlib.sha256(f"{splits.SEED}:{g}".encode()).hexdigest())
        m = len(ids)
        test = max(1, round(m * 0.15)) if m >= 3 else 0
        validation = max(1, round(m * 0.15)) if m >= 3 else int(m == 2)
        want = ["train"] * (m - test - validation) + ["validation"] * validation + ["test"] * test
        assert [got[g] for g in ids] == want


def test_fractions():
    with pytest.raises(ValueError, match="sum"):
        splits.check_fractions(0.5, 0.2, 0.2)
    with pytest.raises(ValueError, match="positive"):
        splits.check_fractions(1.0, 0.0, 0.0)
    with pytest.raises(ValueError, match="thresholds"):
        audit.check_thresholds((0.9, 1.2))


# ---- near duplicates across splits --------------------------------------------------------------------------------


def _manifest(spark, texts):
    rows = [(i, f"g{i}", ("train", "validation", "test")[i % 3], "q", None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, group_id string, split string, queue string, priority string, classifier_text string")


@pytest.mark.parametrize("hot", [2, 10, 10_000])
def test_cross_split_pairs(spark, monkeypatch, hot):
    """All pairs of the threshold, however many terms count as hot, with ranges of a few texts."""
    monkeypatch.setattr(audit, "RANGE", 7)
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.zipf(1.5, n) % 60]
    texts = [word(int(rng.integers(3, 40))) for _ in range(60)]
    texts.append(["alone", "here"])  # so copies are in another split
    for k in range(60):
        w = list(texts[k])
        w[int(rng.integers(len(w)))] = "changed"
        texts.append(w if k % 2 else [*w, "more"])
    texts = [" ".join([*t, f"u{i % 61}"]) for i, t in enumerate(texts)]
    m = _manifest(spark, texts)
    got = {(r["left_doc_id"], r["right_doc_id"]): r["similarity"] for r in audit.cross_split_pairs(m, 0.8, hot).collect()}
    bag = [t.split() for t in texts]
    bag = [b + [f"{x} {y}" for x, y in zip(b, b[1:])] for b in bag]
    df = {}
    for b in bag:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    vec = []
    for b in bag:
        x = {t: b.count(t) * (np.log((1 + len(bag)) / (1 + df[t])) + 1) for t in set(b)}
        norm = np.sqrt(sum(y * y for y in x.values()))
        vec.append({t: y / norm for t, y in x.items()})
    want = {}
    for i in range(len(bag)):
        for j in range(i + 1, len(bag)):
            s = sum(y * vec[j].get(t, 0) for t, y in vec[i].items())
            if s >= 0.8 and i % 3 != j % 3:
                want[(i, j) if i % 3 < j % 3 else (j, i)] = s
    assert len(want) > 20 and got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_close_pairs(spark):
    """Every pair that difflib finds similar is kept, and few others reach Python."""
    import difflib

    rng = np.random.default_rng(6)
    start = "one two three four five six seven eight"
    texts = []
    for k in range(12):
        body = [f"{chr(97 + int(x))}{int(y)}" for x, y in zip(rng.integers(0, 26, 40), rng.integers(0, 10, 40))]
        texts.append(f"{start} {' '.join(body)}")
        if k % 2:
            body[3] = "é\U0001f600"
            texts.append(f"{start} {' '.join(body)}")
    texts += [f"{start} {'z' * 300}", "other start here"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, classifier_text string")
    ids = {t: i for i, t in enumerate(texts)}
    inside = sorted(t for t in texts if t.startswith(start))
    every = [(x, y) for i, x in enumerate(inside) for y in inside[i + 1 :]]
    ratio = {(ids[x], ids[y]): difflib.SequenceMatcher(None, x, y).ratio() for x, y in every}
    got = {(r["left_id"], r["right_id"]): r["ratio"] for r in audit.high_similarity_pairs(rows).collect()}
    assert got == {k: pytest.approx(v) for k, v in ratio.items() if v >= 0.92} and len(got) >= 6
    near = audit.close_pairs(rows.select(F.lit("b").alias("block"), "doc_id", F.col("classifier_text").alias("text")), 0.92)
    quick = {k for k in ratio if (m := difflib.SequenceMatcher(None, texts[k[0]], texts[k[1]])).real_quick_ratio() >= 0.92 and m.quick_ratio() >= 0.92}
    assert {(r["left_id"], r["right_id"]) for r in near.collect()} == quick and len(quick) < len(every) / 2


def test_match_ratio_is_difflibs(monkeypatch):
    """The same number bit by bit, above and below 200 characters, with moved parts, and without difflib's own search, which a long text makes slow."""
    import difflib

    rng = np.random.default_rng(11)
    pairs = [("", ""), ("", "a"), ("aaaa" * 60, "aaaa" * 55)]
    for k, letters in enumerate(("ab", "abcdef", "abcdefghijklmnopqrstuvwxyz éß\U0001f600", "".join(map(chr, range(200, 900)))) * 30):
        size = (3, 150, 199, 200, 260, 700)[k % 6]
        a = [letters[int(x)] for x in rng.integers(0, len(letters), size)]
        b = list(a)
        for at in rng.integers(0, size, size // 12):
            b[at : at + int(rng.integers(0, 4))] = letters[: int(rng.integers(0, 3))]
        pairs.append(("".join(a), "".join(b if k % 5 else b[size // 2 :] + b[: size // 2])))
    wanted = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    monkeypatch.setattr(audit, "ANCHORS", 0)
    assert [audit.match_ratio(x, y, 0.5) for x, y in pairs] == [w if w >= 0.5 else None for w in wanted]
    monkeypatch.undo()
    monkeypatch.setattr(audit.difflib, "SequenceMatcher", None)
    for least in (0.0, 0.5, 0.92):
        assert [audit.match_ratio(x, y, least) for x, y in pairs] == [w if w >= least else None for w in wanted]
    assert sum(w >= 0.92 for w in wanted) > 5 and sum(w < 0.5 for w in wanted) > 2


def test_hot_term_makes_no_pairs(spark):
    """A term that 50,000 texts offer: of 1.25 billion pairs only those that can reach the threshold become rows."""
    n = 50_000
    offered = spark.range(n).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("id") % 3 + 1).cast("int")).alias("split"), F.lit("the").alias("term"), F.lit(0.4).alias("x"), F.when(F.col("id") % 10_000 < 2, 0.9).otherwise(0.7).alias("after"), F.lit(0.85).alias("left"))
    found = audit.candidates(offered, 0.9, hot=2000).collect()
    near = [i for i in range(n) if i % 10_000 < 2]
    assert sorted(map(tuple, found)) == [(a, b) for a in near for b in near if a < b and a % 3 != b % 3]


# ---- retrieval ----------------------------------------------------------------------------------------------------

DOCS = [(1, "printer does not print pages"), (2, "cannot log in to the portal"), (3, "printer prints blank pages"), (4, None), (5, "portal login fails after reset"), (6, "")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_lexical_index(spark, tmp_path):
    made = search.LexicalIndex.build(docs(spark))
    made.save(str(tmp_path / "index"))
    index = search.LexicalIndex.load(spark, str(tmp_path / "index"))
    assert index.count == 6 and index.fitted.count() == made.fitted.count()
    found = [(r["source_id"], r["rank"]) for r in index.retrieve(query_text="blank printer pages", k=3).collect()]
    assert found[:2] == [(3, 1), (1, 2)] and len(found) == 3  # a row that shares nothing fills the third place
    assert index.retrieve(subject=" ", body="").count() == 0
    own = docs(spark).withColumn("queue", F.when(F.col("doc_id") < 3, "a").otherwise("b"))
    assert [r["source_id"] for r in index.retrieve(subject="printer", k=1, corpus=own, wanted={"queue": "a"}).collect()] == [1]
    for bad in ({"k": 0}, {"wanted": {"queue": "a"}}, {"corpus": own, "wanted": {"answer": "a"}}):
        with pytest.raises(ValueError):
            index.retrieve(query_text="x", **bad)
    with pytest.raises(ValueError, match="fitted"):
        search.LexicalIndex.load(spark, str(tmp_path))


def test_lexical_blocks(spark, monkeypatch):
    """Block bounds leave out what cannot enter the top k, and only that: equal to scoring everything, with ties, zero scores and filters."""
    monkeypatch.setattr(search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(search, "FIRST", 1)
    rng = np.random.default_rng(10)
    kinds = [[f"{k}{x}" for x in range(120)] for k in "abcd"]
    texts = [" ".join([f"lead{i % 4}", *rng.choice(kinds[i % 4], int(rng.integers(1, 30)))]) for i in range(600)]
    texts += [texts[7]] * 6 + ["", None, "zzz"]
    index = search.LexicalIndex.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    made = search.Blocks.build(index.rows, 16)
    queries = made.rows.filter("id % 9 = 0 or id > 604")
    vec = {r["id"]: dict(zip(r["terms"], r["w"])) for r in made.rows.collect()}
    asked = [r["id"] for r in queries.collect()]

    def best(ids):
        out = {}
        for q in asked:
            s = {i: round(sum(x * vec[i].get(t, 0.0) for t, x in vec[q].items()), 9) for i in ids if i != q}
            out[q] = [(i, round(s[i], 6)) for i in sorted(s, key=lambda i: (-s[i], i))[:4]]
        return out

    def found(df):
        out = {q: [] for q in asked}
        for r in df.orderBy("query_id", "rank").collect():
            out[r["query_id"]].append((r["source_id"], r["score"]))
        return out

    assert found(search.lexical_top_k(made, queries, 4)) == best(list(vec))
    few = [i for i in vec if i % 5 == 0]
    assert found(search.lexical_top_k(made.only(spark.createDataFrame([(i,) for i in few], "id long")), queries, 4)) == best(few)
    reach = made.reach(queries)
    least = {q: v[-1][1] for q, v in best(list(vec)).items()}
    rows = reach.collect()
    blocks = {r["id"]: r["block"] for r in made.rows.collect()}
    bound = {(r["query_id"], r["block"]): r["bound"] for r in rows}
    for q in asked:  # a bound is one
        for i, v in vec.items():
            assert sum(x * v.get(t, 0.0) for t, x in vec[q].items()) <= bound.get((q, blocks[i]), 0.0) + 1e-9
    skipped = sum(r["bound"] < least[r["query_id"]] for r in rows) + len(asked) * len(set(blocks.values())) - len(rows)
    assert skipped > 0.5 * len(asked) * len(set(blocks.values()))


def test_clock(spark):
    """Scoring time is observed in the job that scores: more than nothing, and no more than all tasks had of the wall clock."""
    import time

    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(4000)], "id long, v array<double>").repartition(4).cache()
    v.count()
    clock, began = search.Clock(), time.perf_counter()
    got = search.dense_top_k(v, v.filter("id < 400"), 5, clock).collect()
    wall = 1000 * (time.perf_counter() - began)
    assert len(got) == 2000 and set(got[0].asDict()) == {"query_id", "source_id", "rank", "score"}
    assert 1 < clock.ms() < 4 * wall
    index, clock = search.LexicalIndex.build(docs(spark)), search.Clock()
    rows = search.lexical_top_k(index.rows, index.rows, 2, clock).collect()
    assert len(rows) == 12 and clock.ms() > 0


def test_clock_leaves_the_session(spark):
    """A model of two classes with a training summary goes to tasks after a search was timed in its session."""
    from pyspark.ml.linalg import Vectors

    v = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(20)], "id long, v array<double>")
    search.dense_top_k(v, v.filter("id < 3"), 2, search.Clock()).collect()
    rows = spark.createDataFrame([(i, Vectors.dense([i % 2, i]), "ab"[i % 2]) for i in range(40)], ["doc_id", "features", "label"])
    encoder = spark.createDataFrame([("a", 0), ("b", 1)], "label string, index int")
    model = ml.logistic(5).fit(ml._ready(rows, "label", encoder))
    assert model.numClasses == 2 and model.hasSummary
    assert ml.probabilities(model, rows, encoder, "label").filter("label = truth and p > 0.5").count() == 40


def test_lexical_scores_in_blocks(spark, monkeypatch):
    """Blocks, the split of common and rare terms, and chunks of rows do not change scores."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 30) % 60)) for i in range(90)]
    index = search.LexicalIndex.build(spark.createDataFrame(rows, "doc_id long, text string"))
    vectors = {r["id"]: dict(zip(r["terms"], r["w"])) for r in index.rows.collect()}
    want = {}
    for q in range(0, 90, 7):
        scored = sorted((-round(sum(x * vectors[c].get(t, 0) for t, x in vectors[q].items()), 9), c) for c in vectors if c != q)
        want[q] = [(c, round(-s, 6)) for s, c in scored[:4]]
    for values, common, cells in ((10**9, 1, 10**6), (100, 10**9, 50), (500, 3, 10)):
        monkeypatch.setattr(search, "BLOCK_VALUES", values)
        monkeypatch.setattr(search, "COMMON", common)
        monkeypatch.setattr(search, "CELLS", cells)
        got: dict = {}
        for r in search.lexical_top_k(index.rows, index.rows.filter("id % 7 = 0"), 4).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["source_id"], r["score"]))
        assert got == want


def test_dense_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id long, v array<double>")
    search.DenseIndex(rows, {"model": "stand-in", "dimensions": 2}).save(str(tmp_path / "dense"))
    index = search.DenseIndex.load(spark, str(tmp_path / "dense"))
    assert index.config == {"model": "stand-in", "dimensions": 2}
    query = spark.createDataFrame([(-1, [0.1, 1.0])], "id long, v array<double>")
    assert [r["source_id"] for r in search.dense_top_k(index.rows, query, 2).orderBy("rank").collect()] == [3, 2]
    with pytest.raises(ValueError, match="lexical"):
        search.LexicalIndex.load(spark, _with_parts(spark, tmp_path))
    search.DenseIndex(rows, {"dimensions": 3}).save(str(tmp_path / "wrong"))
    with pytest.raises(ValueError, match="3 numbers"):
        search.DenseIndex.load(spark, str(tmp_path / "wrong"))


def _with_parts(spark, tmp_path):
    spark.range(1).write.mode("overwrite").parquet(str(tmp_path / "dense" / "fitted"))
    return str(tmp_path / "dense")


def test_hybrid(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], ["a"] if i % 2 else [], [1.0] if i % 2 else []) for i in range(6)], "id long, v array<double>, terms array<string>, w array<double>")
    got = search.hybrid_top_k(rows, rows.filter("id = 5"), 3, 0.5).orderBy("rank").collect()
    assert [(r["source_id"], r["score"]) for r in got] == [(3, 0.875), (1, 0.625), (4, 0.5)]
    with pytest.raises(ValueError, match="weight"):
        search.hybrid_top_k(rows, rows, 3, 1.5)


def test_encode(spark):
    sizes = []

    def embed(texts):
        return np.array([[len(x), x.count("print"), 0.0] for x in texts])

    got = {r["doc_id"]: r["v"] for r in search.encode(docs(spark), embed, batch=2).collect()}
    assert got[4] == [0.0, 0.0, 0.0] and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6) and not sizes
    with pytest.raises(Exception, match="shape"):
        search.encode(docs(spark), lambda texts: np.zeros(3)).collect()


def test_selection(spark):
    rows = [("a", "validation", 0.8, 0.7, 0.6), ("b", "validation", 0.8, 0.7, 0.6), ("c", "test", 1.0, 1.0, 1.0)]
    assert search.select_method(spark.createDataFrame(rows, "method string, split string, recall_5 double, mrr double, recall_1 double")).first()["method"] == "b"
    none = search.ranking_metrics(spark.createDataFrame([], "query_id long, rank long, relevant boolean"), spark.createDataFrame([], "query_id long")).first()
    assert (none["n_queries"], none["recall_5"], none["mrr"]) == (0, 0.0, 0.0)


# ---- reports ------------------------------------------------------------------------------------------------------


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("a", "test", 0.5, 1), ("a", "validation", 0.25, 2), (None, "test", None, 3)], "method string, split string, mrr double, n int")
    doc = {"evaluation": reports.nested(m, "method", "split"), "selection": {"method": "a"}}
    assert doc["evaluation"] == {"a": {"test": {"mrr": 0.5, "n": 1}, "validation": {"mrr": 0.25, "n": 2}}, "none": {"test": {"mrr": None, "n": 3}}}
    path = str(tmp_path / "report")
    reports.write(spark, doc, path)
    assert reports.read(spark, path) == json.loads(json.dumps(doc)) == reports.read_if_there(spark, path)
    assert reports.read_if_there(spark, str(tmp_path / "absent")) is None
    assert reports.flat({"b": {"x": 0.5}, "a": [1, 2]}) == [("a", "1,2"), ("b.x", "0.500000")]
    assert next(r for r in reports.retrieval_rows(doc) if r["method"] == "a") == {"method": "a", "split": "test", "recall_1": None, "recall_3": None, "recall_5": None, "mrr": 0.5}
    assert (reports.selected_method(doc), reports.selected_method(None), reports.retrieval_rows(None)) == ("a", "Unavailable", [])
    spark.createDataFrame([("[1]",)], "value string").write.text(str(tmp_path / "list"))
    with pytest.raises(ValueError, match="object"):
        reports.read(spark, str(tmp_path / "list"))
    with pytest.raises(ValueError, match="rows"):
        reports.nested(spark.range(reports.ROWS + 1), "id")


def test_charts(spark, tmp_path):
    import xml.etree.ElementTree as ET

    for text in (svg.confusion(["a<b", "c"], {("a<b", "c"): 3}), svg.bars([("x", 0.5), ("y & z", 2.0)]), svg.reliability([(0.2, 0.1, 5), (0.0, 0.0, 0)])):
        assert ET.fromstring(text).tag.endswith("svg")
    svg.write(spark, svg.bars([("x", 0.5)]), str(tmp_path / "chart"))
    assert spark.read.text(str(tmp_path / "chart"), wholetext=True).first()[0].startswith("<svg")


def test_formats(spark):
    one = spark.createDataFrame([(0.12345, None, {"b": 2, "a": 1}, {})], "x double, y double, m map<string,int>, e map<string,int>")
    r = one.select(X.format_metric(F.col("x")).alias("a"), X.format_percent(F.col("x")).alias("b"), X.format_metric(F.col("y")).alias("c"), X.format_counts(F.col("m")).alias("d"), X.format_counts(F.col("e")).alias("e"), X.utc_text(F.timestamp_seconds(F.lit(0))).alias("f")).first()
    assert tuple(r) == ("0.123", "12.3%", "n/a", "a=1, b=2", "none", "1970-01-01T00:00:00+00:00")


# ---- contracts and gold labels ------------------------------------------------------------------------------------


def test_contracts(spark):
    good = spark.createDataFrame([(1, "g1", "train", "t", "q"), (2, "g2", "test", "u", "q")], "doc_id long, group_id string, split string, classifier_text string, queue string")
    contracts.require(contracts.prepared_violations(good))
    bad = good.unionByName(spark.createDataFrame([(2, "g1", "test", " ", None)], good.schema))
    with pytest.raises(ValueError, match="blank_text: 1; divided_group: 1; null_queue: 1; repeated_id: 1"):
        contracts.require(contracts.prepared_violations(bad))
    with pytest.raises(ValueError, match="lacks"):
        contracts.check_prepared_columns(["split"])


LABELS = "evaluation_split string, query_id string, candidate_rank int, relevance_label string, retrieval_score string, file_row long"


def test_gold_labels(spark):
    rows = [("validation", "q1", k + 1, v, "0.5", k + 2) for k, v in enumerate(["0", "2.0", "0", "1", "0"])] + [("validation", "q2", k + 1, v, "0.5", k + 7) for k, v in enumerate(["1", "0", "0", "0", "0"])]
    df = spark.createDataFrame(rows, LABELS)
    r = search.gold_metrics(gold.scored(df, "validation")).first()
    assert (r["recall_1"], r["mrr"], r["label_1"]) == (0.5, 0.75, 2) and r["ndcg_5"] == pytest.approx(0.819955, abs=1e-6)
    faults = {"other_split": ("test", "q3", 1, "1", "0", 12), "missing_label": ("validation", "q3", 1, " ", "0", 12), "label_domain": ("validation", "q3", 1, "1.5", "0", 12), "rank": ("validation", "q3", 0, "1", "0", 12), "repeated_rank": ("validation", "q2", 5, "1", "0", 12)}
    for name, row in faults.items():
        with pytest.raises(ValueError, match=f"^{name}: 1$"):
            gold.scored(df.unionByName(spark.createDataFrame([row], LABELS)), "validation")
    missing = df.unionByName(spark.createDataFrame([faults["missing_label"]], LABELS))
    assert [r["file_row"] for r in gold.missing_label_rows(missing).collect()] == [12]
    with pytest.raises(ValueError, match="label columns"):
        gold.check_columns(["query_id"])


def test_gold_sample():
    rng = np.random.default_rng(2)
    names = {"length_group": ("short", "medium", "long"), "difficulty_group": ("easy", "ambiguous")}
    rows = [{"doc_id": int(i), "queue": f"q{i % 9}", "support_group": "lower_support" if i % 9 > 4 else "common", **{k: str(rng.choice(v)) for k, v in names.items()}} for i in rng.permutation(80)]
    got = gold.sample(rows, 20)
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got) and len({r["doc_id"] for r in got}) == 20
    assert {r["queue"] for r in got} == {f"q{i}" for i in range(9)}  # one of each queue first
    for k, v in names.items():
        assert all(sum(r[k] == x for r in got) >= 3 for x in v)
    assert gold.sample(list(reversed(rows)), 20) == got
    with pytest.raises(ValueError, match="needed"):
        gold.sample(rows[:5], 20)


def test_gold_groups(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 9 else "c", i) for i in range(10)], "doc_id long, queue string, word_count long")
    got = {r["doc_id"]: (r["length_group"], r["support_group"]) for r in gold.support_groups(gold.length_groups(df)).collect()}
    assert [got[i][0] for i in (0, 2, 3, 6, 7, 9)] == ["short", "short", "medium", "medium", "long", "long"]
    assert (got[0][1], got[7][1], got[9][1]) == ("common", "lower_support", "lower_support")
    assert sorted(r["doc_id"] for r in gold.spaced(spark.range(0, 40).select(F.col("id").alias("doc_id"), F.lit("q").alias("queue"))).collect()) == [0, 13, 26, 39]
    one = gold.margins(spark.createDataFrame([("q", 1, 0.75)], "query_id string, rank int, score double")).first()
    assert one["margin"] == 0.75


# ---- drafts -------------------------------------------------------------------------------------------------------


def test_replies(spark):
    ok = {"draft": "See [TP-1]", "citations": ["TP-1"], "status": "drafted", "review": True}
    texts = [json.dumps(ok), None, "nope", "[]", '"text"', json.dumps({k: v for k, v in ok.items() if k != "draft"}), json.dumps({**ok, "reason": "why"})]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, reply string")
    errors = {r["id"]: r["p"]["error"] for r in df.select("id", gates.parse_reply(F.col("reply")).alias("p")).collect()}
    assert errors == {0: None, 1: "not_json", 2: "not_json", 3: "not_object", 4: "not_object", 5: "missing:draft", 6: None}
    ev = "array<struct<source_id:string,similarity:double>>"
    r = spark.createDataFrame([(i, 0.9, [("TP-1", 0.5)], t) for i, t in enumerate(texts)] + [(9, 0.1, [("TP-1", 0.5)], texts[0])], f"id long, confidence double, evidence {ev}, reply string")
    made = gates.provider_drafts(r)
    got = {x["id"]: (x["status"], x["reason"]) for x in made.collect()}
    assert got[0] == ("drafted", None) and got[1] == ("provider_error", "not_json") and got[6] == ("provider_error", "rule:reason_of_draft")
    assert got[9] == ("abstained", gates.REASONS["low_confidence"])
    assert all(not x["violations"] for x in gates.draft_violations(made).collect())


def test_reply_text(spark):
    bodies = ['{"output_text": "top", "output": []}', '{"output_text": " ", "output": [{"content": [{"text": "a"}, {"type": "x"}]}, {"type": "y"}, {"content": [{"text": "b"}]}]}', '{"output": []}', "x"]
    got = [r["t"] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(gates.reply_text(F.col("b")).alias("t")).collect()]
    assert got == ["top", "a\nb", None, None]


def test_prompts(spark):
    item = "array<struct<source_id:string,subject:string,body:string,answer:string,queue:string,priority:string,similarity:double>>"
    r = spark.createDataFrame([(1, "t " * 5000, "q", 0.5, [("TP-1", "s", "b" * 2000, "", "q", "low", 0.25)])], f"id long, text string, queue string, confidence double, evidence {item}")
    text = gates.prompts(r).first()["prompt"]
    assert "Confidence: 0.5000" in text and "Similarity: 0.2500" in text and text.count("[truncated]") == 2 and len(text) < gates.PROMPT_TEXT + gates.PROMPT_FIELD + 600


def test_request_errors(spark):
    rows = [("s", "b", 0, 0.5), ("s" * 1001, "b", 21, None), ("s", " ", -1, 1.5), ("s", "b" * 6001, None, float("nan"))]
    got = [(r["errors"], r["top_k"]) for r in gates.request_errors(spark.createDataFrame(rows, "subject string, body string, top_k int, confidence double")).collect()]
    assert got == [([], 5), (["subject", "top_k"], 21), (["body", "top_k", "confidence"], -1), (["body", "confidence"], 5)]


def test_review_records(spark):
    a = spark.createDataFrame([("a1", "text", "q", 0.5, ["TP-1", "TP-2"], " ", {"name": "x"})], "analysis_id string, ticket_text string, predicted_queue string, queue_confidence double, evidence_ids array<string>, draft string, provider map<string,string>").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    stored = review.records(a)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema) == review.RECORD
    d = review.decoded(stored).first()
    assert d["evidence_ids"] == ["TP-1", "TP-2"] and d["provider_fields"] == {"name": "x"} and d["draft"] is None and d["ticket_hash"] == hashlib.sha256(b"text").hexdigest()
    assert review.frame(stored).first()["n_evidence"] == 2
    assert review.by_state(stored, "pending", 5).count() == 1 and review.one(stored, "a1").count() == 1 and review.by_state(stored, "approved", 5).count() == 0
    for state, n in (("odd", 5), (None, 0)):
        with pytest.raises(ValueError):
            review.by_state(stored, state, n)


# ---- training -----------------------------------------------------------------------------------------------------


def texts(spark):
    rng = np.random.default_rng(3)
    own = {"vpn": "vpn tunnel remote", "mail": "mail inbox smtp", "print": "printer paper toner"}
    rows = [(i, k, " ".join([*rng.choice(own[k].split(), 3), *(f"w{x}" for x in rng.integers(0, 30, 6))])) for i, k in enumerate(list(own) * 30)]
    return spark.createDataFrame(rows, "doc_id long, queue string, classifier_text string").withColumn("n", F.lit(1))


def test_features(spark):
    df = spark.createDataFrame([(1, "A b-c a"), (2, "a b-c"), (3, "zzz"), (4, None)], "doc_id long, classifier_text string")
    fitted = ml.fit_terms(df)
    assert [(r["term"], r["df"], r["place"]) for r in fitted.orderBy("place").collect()] == [("a", 2, 0), ("a b-c", 2, 1), ("b-c", 2, 2)]
    got = {r["doc_id"]: r["features"] for r in ml.features(df, fitted).collect()}
    idf = np.log(5 / 3) + 1
    x = np.array([(1 + np.log(2)) * idf, idf, idf])
    assert np.allclose(got[1].toArray()[:3], x / np.linalg.norm(x)) and got[1].size == ml.MOST
    assert got[3].numNonzeros() == got[4].numNonzeros() == 0
    assert ml.fit_terms(df, most=2).count() == 2


def test_baselines(spark):
    df = texts(spark)
    x = ml.features(df, ml.fit_terms(df)).join(df.select("doc_id", "queue"), "doc_id").cache()
    encoder = classify.encode_labels(df.select(F.col("queue").alias("label")))
    train, test = x.filter("doc_id % 4 <> 0"), x.filter("doc_id % 4 = 0")
    right = lambda scores: ml.routes(scores, 2).agg(F.avg((F.col("truth") == F.col("predicted")).cast("double"))).first()[0]
    model = ml.baseline("tfidf_logistic_regression", 20).fit(ml._ready(train, "queue", encoder))
    scores = ml.probabilities(model, test, encoder, "queue")
    assert right(scores) > 0.9 and len(ml.routes(scores, 2).first()["routes"]) == 2
    losses = [r["loss"] for r in ml.history(model).orderBy("step").collect()]
    assert len(losses) > 1 and losses[-1] < losses[0]
    assert right(ml.dummy_scores(train, test, encoder, "queue")) < 0.5
    assert ml.baseline("dummy_most_frequent") is None
    with pytest.raises(ValueError, match="unknown"):
        ml.baseline("forest")


def test_calibrated(spark, tmp_path):
    df = texts(spark)
    x = ml.features(df, ml.fit_terms(df)).join(df.select("doc_id", "queue"), "doc_id").cache()
    model = ml.Calibrated.fit(x.filter("doc_id % 4 <> 0"), "queue", 3)
    test = x.filter("doc_id % 4 = 0")
    scores = model.scores(test).cache()
    total = scores.groupBy("vec_id").agg(F.sum("p").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] == pytest.approx(1) and r["n"] == 3 for r in total)
    assert ml.routes(scores).filter("truth <> predicted").count() <= 2
    model.save(str(tmp_path / "model"))
    again = {(r["vec_id"], r["label"]): r["p"] for r in ml.Calibrated.load(spark, str(tmp_path / "model")).scores(test).collect()}
    assert again == pytest.approx({(r["vec_id"], r["label"]): r["p"] for r in scores.collect()})


def test_first_words_of_long_texts(spark):
    """The same words as those of the whole text, wherever its start is cut."""
    texts = ["ab " * 100, "x" * 39 + " y z w v", "a " * 19 + "bcd e f", "- . " * 30 + "a b c d e", "a b c d", "\U0001f600 b c\u00c9 " * 20, "OΣ b c " + "Σ" * 60, " a  b\tc\n" * 9, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string")
    for length in (1, 2, 4):
        rows = df.select(ml.first_words("t", length).alias("a"), F.slice(ml._sequence("t"), 1, length).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows) and sum(len(r["b"]) == length for r in rows) >= 6


def test_sequences_stay_in_their_rows(spark):
    """Places are looked up without moving a word, other columns come along, and texts without words are padding."""
    df = spark.createDataFrame([(1, "train", "a b? B -- zz"), (2, "test", None), (3, None, " ... ")], "doc_id long, split string, classifier_text string")
    v = spark.createDataFrame([("a", 3), ("b", 2)], "word string, place int")
    got = ml.sequences(df, v, length=4, keep=("split",))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "train", [3, 2, 2, 1]), (2, "test", [0] * 4), (3, None, [0] * 4)]
    assert ml.sequences(df, v.limit(0), length=3).first()["ids"] == [1, 1, 1]


def test_sequences(spark):
    df = spark.createDataFrame([(1, "b, a! b"), (2, "A c"), (3, None)], "doc_id long, classifier_text string")
    v = ml.fit_vocabulary(df)
    assert [(r["word"], r["place"]) for r in v.orderBy("place").collect()] == [("a", 2), ("b", 3), ("c", 4)]
    got = {r["doc_id"]: r["ids"] for r in ml.sequences(df, v.filter("word <> 'c'"), length=4).collect()}
    assert got == {1: [3, 2, 3, 0], 2: [2, 1, 0, 0], 3: [0, 0, 0, 0]}


def test_labels_and_comparison(spark):
    e = classify.encode_labels(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string"))
    assert sorted((r["label"], r["index"]) for r in e.collect()) == [("a", 0), ("b", 1)]
    got = classify.to_index(spark.createDataFrame([(1, "b"), (2, "z")], "id long, q string"), "q", e)
    assert {r["id"]: r["index"] for r in got.collect()} == {1: 1, 2: None}
    assert {r["id"]: r["label"] for r in classify.to_label(got, "index", e).collect()} == {1: "b", 2: None}
    p = classify.normalized(spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", -1.0), (2, "b", float("nan"))], "vec_id long, label string, p double"))
    assert sorted((r["vec_id"], r["label"], r["p"]) for r in p.collect()) == [(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.0), (2, "b", 0.0)]
    m = spark.createDataFrame([("x", 0.5, 0.5, 0.5), ("y", 0.5, 0.6, 0.4)], "model string, macro_f1 double, weighted_f1 double, accuracy double")
    assert classify.select_model(m).first()["model"] == "y" and classify.deployment(m, "x", "y").first()["decision"] == "x"
    wide = classify.wide_confusion(spark.createDataFrame([("a", "b"), ("a", "b")], "truth string, predicted string"), ["a", "b"])
    assert sorted(map(tuple, wide.select("label", "a", "b").collect())) == [("a", 0, 2), ("b", 0, 0)]


# ---- service and jobs ---------------------------------------------------------------------------------------------


def test_service(spark):
    from deskmill.operators.service import Service

    df = texts(spark)
    fitted = ml.fit_terms(df)
    x = ml.features(df, fitted).join(df.select("doc_id", "queue"), "doc_id")
    index = search.LexicalIndex.build(df.select("doc_id", F.col("classifier_text").alias("text")))
    corpus = df.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("subject"), F.col("classifier_text").alias("body"), F.lit("fixed").alias("answer"), "queue", F.lit("low").alias("priority"))
    s = Service(ml.Calibrated.fit(x, "queue", 2), fitted, index, corpus)
    asked = spark.createDataFrame([(1, "vpn tunnel", "remote w1 w2"), (2, " ", None), (3, "toner", "x" * 7000), (4, "mail", "inbox smtp mail")], "doc_id long, subject string, body string")
    got = {r["doc_id"]: r for r in s.analyze(asked, 0).collect()}
    assert sorted(got) == [1, 4] and got[1]["predicted"] == "vpn" and got[4]["predicted"] == "mail"
    assert len(got[1]["evidence"]) == 5 and got[1]["evidence"][0]["subject"] == "" and got[1]["priority"] is None and "human_review_required" in got[1]["reasons"]
    assert s.health()["ready"] and s.model_info()["classifier"]["labels"] == ["mail", "print", "vpn"]
    s.corpus = corpus.limit(0)
    assert s.health() == {"status": "error", "ready": False, "errors": ["corpus is empty"]}


def test_jobs(spark, tmp_path):
    from deskmill import __main__ as jobs
    from deskmill.sources import tables

    rows = [dict.fromkeys(tables.TICKET_COLUMNS, "x") | {"subject": f"Subject {i}", "body": f"body {i} of a ticket about thing {i % 7}", "type": "Incident", "priority": "low", "language": "en" if i % 3 else "de", "queue": f"q{i % 2}"} for i in range(90)]
    spark.createDataFrame([tuple(r[c] for c in tables.TICKET_COLUMNS) for r in rows], tables.TICKET_SCHEMA).coalesce(1).write.option("header", True).csv(str(tmp_path / "raw"))
    at = lambda name: str(tmp_path / name)
    assert jobs.main(["acquire", "--source", at("raw"), "--out", at("english")]) == {"rows": 60}
    summary = jobs.main(["prepare", "--source", at("english"), "--out", at("data")])
    assert summary["row_count"] == 60 and sum(x["rows"] for x in summary["splits"].values()) == 60
    assert set(jobs.main(["leakage", "--prepared", at("data") + "/prepared", "--out", at("leakage")])) == {"train_vs_validation", "train_vs_test", "validation_vs_test"}
    rows = jobs.main(["index", "--prepared", at("data") + "/prepared", "--out", at("index")])["rows"]
    assert rows == summary["splits"]["train"]["rows"]
    assert len(jobs.main(["retrieve", "--index", at("index"), "--text", "ticket about thing 3", "--k", "2"])["found"]) == 2
    with pytest.raises(SystemExit):
        jobs.main(["unknown"])


def test_training(spark, tmp_path):
    from deskmill.operators import training

    split = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation").otherwise("train")
    df = texts(spark).select("doc_id", split.alias("split"), F.lit("s").alias("subject"), F.col("classifier_text").alias("body"), "classifier_text", "queue")
    made = training.run(df, "queue", 2)
    r = made.report
    assert r["selected_model"]["name"] != "dummy_most_frequent" and r["test_metrics"]["accuracy"] > 0.8
    assert set(r["validation_metrics"]) == set(ml.REGISTRY) and r["training_history"]["tfidf_logistic_regression"]
    assert 0 <= r["calibrated_validation"]["threshold"]["threshold"] <= 1 and r["test_metrics"]["at_threshold"]["coverage"] > 0
    training.save(made, str(tmp_path / "out"))
    assert reports.read(spark, str(tmp_path / "out/report"))["labels"] == ["mail", "print", "vpn"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out/confusion-table")).columns == ["label", "mail", "print", "vpn"]
    assert ml.Calibrated.load(spark, str(tmp_path / "out/model")).label == "queue"
    with pytest.raises(ValueError, match="no rows of test"):
        training.run(df.filter("split <> 'test'"))


def test_acquire(spark, tmp_path):
    from deskmill.operators import profile
    from deskmill.sources import tables

    row = dict.fromkeys(tables.TICKET_COLUMNS, "x") | {"type": "Incident", "priority": "low", "language": "en"}
    lines = [",".join(tables.TICKET_COLUMNS), ",".join(row.values()), ",".join((row | {"subject": "", "language": "de"}).values()), ",".join(row.values())]
    (tmp_path / "remote.csv").write_text("\n".join(lines) + "\n")
    path, calls = str(tmp_path / "local.csv"), []

    def get(url, to):
        calls.append(url)
        tables.download(url, to)

    url = (tmp_path / "remote.csv").as_uri()
    for overwrite, times in ((False, 1), (False, 1), (True, 2)):
        assert tables.acquire(spark, path, str(tmp_path / "out"), url=url, overwrite=overwrite, get=get).count() == 2 and len(calls) == times
    got = profile.contract_summary(tables.read_csv(spark, path))
    assert got["rows"] == 3 and got["language"] == {"de": 1, "en": 2} and got["repeated_rows"]["extra_rows"] == 1 and got["nulls"]["subject"] == 1
    assert "language: de=1, en=2" in profile.summary_text(got)
    with pytest.raises(ValueError, match="queue"):
        profile.require(tables.read_csv(spark, path), queues=("billing",))


def test_label_files(spark, tmp_path):
    from deskmill import __main__ as jobs
    from deskmill.sources import tables

    row = dict.fromkeys(gold.LABEL_COLUMNS, "x") | {"evaluation_split": "validation", "retrieval_score": "0.5"}
    rows = [tuple((row | {"query_id": q, "candidate_rank": str(k), "relevance_label": str(int(k == 1))}).values()) for q in "ab" for k in (1, 2, 3)]
    spark.createDataFrame(rows, list(gold.LABEL_COLUMNS)).coalesce(1).write.option("header", True).csv(str(tmp_path / "labels"))
    assert tables.read_labels(spark, str(tmp_path / "labels")).schema["candidate_rank"].dataType.simpleString() == "int"
    assert jobs.main(["score-labels", "--labels", str(tmp_path / "labels"), "--split", "validation", "--out", str(tmp_path / "report")])["mrr"] == 1.0
    with pytest.raises(ValueError, match="other_split"):
        jobs.main(["score-labels", "--labels", str(tmp_path / "labels"), "--split", "test", "--out", str(tmp_path / "report")])


def test_checksum(spark, tmp_path):
    from deskmill.sources import tables

    (tmp_path / "f").write_bytes(b"x" * 100_000)
    tables.check_sha256(spark, str(tmp_path / "f"), hashlib.sha256(b"x" * 100_000).hexdigest().upper())
    with pytest.raises(ValueError, match="sha256"):
        tables.check_sha256(spark, str(tmp_path / "f"), "0" * 64)


def test_four_digits_as_sql(spark):
    """Every score of six digits between 0 and 1 is shown as DuckDB rounds and shows it, ties included."""
    import duckdb

    step = 97  # ties end in 50: tenths of all are enough for them
    ids = sorted({*range(50, 1_000_001, 100), *range(0, 1_000_001, step)})
    got = spark.createDataFrame([(i,) for i in ids], "i int").select("i", gates.four(F.col("i") / 1e6).alias("s")).collect()
    want = dict(duckdb.sql("select i, printf('%.4f', round(i / 1000000.0::double, 4)) from range(1000001) t(i)").fetchall())
    assert [r for r in got if want[r["i"]] != r["s"]] == []
