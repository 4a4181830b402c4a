"""Search in cells: parts of the queries meet parts of the corpus in tasks, in bounded memory, and nothing passes the driver."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.operators import search


def test_common_terms_are_bounded(monkeypatch):
    """A thousand terms that all queries have: the matrix holds ``CELLS`` numbers at most, the rest goes through postings, with equal products."""
    monkeypatch.setattr(search, "CELLS", 1000)
    rng = np.random.default_rng(1)
    w = rng.normal(size=(40, 1000))
    lists = lambda m, kind: pa.array([list(x) for x in m], pa.list_(kind))
    h = np.tile(np.arange(1000) * 7919, (40, 1))
    block = search.Block.of(pa.table({"id": pa.array(range(40), pa.int64()), "h": lists(h, pa.int64()), "w": lists(w, pa.float64())}))
    assert 0 < block.matrix.size <= 1000
    x = rng.normal(size=(5, 1000))
    assert np.allclose(block.lexical(lists(h[:5], pa.int64()), lists(x, pa.float64())), x @ w.T)


def test_queries_stay_off_the_driver(spark, monkeypatch):
    """Dense, hybrid and extents of many small parts equal a plain computation, with ties, and no query row comes to the driver."""
    monkeypatch.setattr(search, "BLOCK_QUERIES", 13)
    monkeypatch.setattr(search, "CELLS", 60)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(60, 4)), 1)
    v[50:] = v[7]  # ties
    words = [sorted({f"w{x}" for x in rng.integers(0, 9, 3)}) for _ in range(60)]
    rows = spark.createDataFrame([(i, v[i].tolist(), words[i], [1.0] * len(words[i])) for i in range(60)], "id long, v array<double>, terms array<string>, w array<double>")
    asked = [i for i in range(60) if i % 3 == 0]
    dense = v @ v.T
    lexical = np.array([[float(len(set(a) & set(b))) for b in words] for a in words])
    scaled = lambda s, q: (s[q] - np.delete(s[q], q).min()) / np.ptp(np.delete(s[q], q))
    mixed = {q: 0.5 * scaled(lexical, q) + 0.5 * scaled(dense, q) for q in asked}
    best = lambda s, q: sorted((i for i in range(60) if i != q), key=lambda i: (-round(s[i], 9), i))[:6]

    def found(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["source_id"])
        return out

    queries = rows.filter(F.col("id") % 3 == 0)
    assert found(search.dense_top_k(rows, queries, 6)) == {q: best(dense[q], q) for q in asked}
    assert found(search.lexical_top_k(rows, queries, 6)) == {q: best(lexical[q], q) for q in asked}
    assert found(search.hybrid_top_k(rows, queries, 6)) == {q: best(mixed[q], q) for q in asked}
    e = {r["query_id"]: r for r in search.extents(rows, queries).collect()}
    assert sorted(e) == asked
    for q in asked:
        assert e[q]["n"] == 59
        for c, s in (("l", lexical), ("d", dense)):
            own = np.delete(s[q], q)
            assert np.allclose([e[q][f"low_{c}"], e[q][f"high_{c}"], e[q][f"sum_{c}"]], [own.min(), own.max(), own.sum()])


def test_vectors_by_parts(spark, monkeypatch):
    """Weights of texts in many small parts equal a plain computation; with rows that only are weighed, and few that come out; no join of all
    terms of all documents is in the plan."""
    monkeypatch.setattr(search, "PART_CHARACTERS", 60)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 12))) % 40 + 10) or None for _ in range(80)]
    rows = [(i, t, i % 4 != 1, i % 3 != 0) for i, t in enumerate(texts)]
    bag = [(t or "").split() for t in texts]
    bag = [b + [f"{x} {y}" for x, y in zip(b, b[1:])] for b in bag]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fit boolean, keep boolean")

    def want(fit, keep):
        df = {}
        for i in filter(fit, range(80)):
            for t in set(bag[i]):
                df[t] = df.get(t, 0) + 1
        n = sum(map(fit, range(80)))
        out = {}
        for i in filter(keep, range(80)):
            x = {t: (1 + np.log(bag[i].count(t))) * (np.log((1 + n) / (1 + df[t])) + 1) for t in set(bag[i]) if t in df}
            norm = np.sqrt(sum(y * y for y in x.values()))
            out[i] = {t: (df[t], round(y / norm, 9)) for t, y in x.items()}
        return out

    got = lambda d: {r["id"]: {t: (f, round(w, 9)) for t, f, w in zip(r["terms"], r["dfs"], r["w"])} for r in d.collect()}
    assert search.text_parts(docs, "text") > 20
    assert got(search.document_vectors(docs, names=True)) == want(lambda i: i % 4 != 1, lambda i: i % 3 != 0)
    every = search.document_vectors(docs.select("doc_id", "text"), names=True)
    assert got(every) == want(lambda i: True, lambda i: True)
    assert "SortMergeJoin" not in every._jdf.queryExecution().executedPlan().toString()
    few = {i: {t: x for t, x in v.items() if x[0] > 1} for i, v in want(lambda i: True, lambda i: True).items()}
    assert got(search.document_vectors(docs.select("doc_id", "text"), minimum=2, names=True)) == few


def test_offers_need_no_shuffle(spark):
    """What each text offers is told from its own row: no window over all terms of all texts."""
    from deskmill.operators import audit

    v = spark.createDataFrame([(1, "train", [5, 6, 7], [9, 2, 4], [0.6, 0.64, 0.48]), (2, "test", [8], [3], [1.0])], "doc_id long, split string, h array<long>, dfs array<long>, w array<double>")
    made = audit.offers(v, 0.9)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["doc_id"], r["term"], round(r["after"], 6), round(r["left"], 6)) for r in made.collect())
    assert got == [(1, 6, round(float(np.sqrt(0.36 + 0.2304)), 6), round(float(np.sqrt(0.36 + 0.2304)), 6)), (2, 8, 0.0, 0.0)]


def test_most_frequent_orders_ties_only(spark):
    """Every cut, also in the middle of ties, equals an ordered limit, and the frequent terms go through no ordered limit."""
    rows = [(f"t{i:02}", 2, t) for i, t in enumerate([9, 7, 7, 7, 3, 3, 3, 3, 2, 2])]
    found = spark.createDataFrame(rows, "term string, df long, total long")
    order = [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))]
    for most in (1, 2, 4, 6, 10, 50):
        assert sorted(r["term"] for r in search.most_frequent(found, most).collect()) == sorted(order[:most])


def test_audit_pairs_meet_in_cells(spark, monkeypatch):
    """Texts in many small parts: the pairs equal a plain computation, their vectors move once a part, and no join makes a row of every two texts that
    share a term."""
    from deskmill.operators import audit

    monkeypatch.setattr(audit, "PART_OFFERS", 40)
    monkeypatch.setattr(audit, "PRODUCTS", 30)
    monkeypatch.setattr(audit, "BLOCK_VALUES", 60)
    rng = np.random.default_rng(8)
    base = rng.random((13, 30)) * (rng.random((13, 30)) < 0.4) + 1e-3
    x = np.vstack([base + 0.12 * rng.random(base.shape) * (rng.random(base.shape) < 0.3) for _ in range(5)])
    x = np.where(x > 0.01, x, 0.0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    split = [("train", "test", "validation")[i % 3] for i in range(65)]
    df = (x > 0).sum(axis=0)
    rows = [(i, split[i], [int(t) * 7919 - 9 for t in np.flatnonzero(v)], [int(df[t]) for t in np.flatnonzero(v)], v[v > 0].tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "doc_id long, split string, h array<long>, dfs array<int>, w array<double>")
    pairs = audit.usual_candidates(audit.offers(v, 0.9), 0.9)
    assert "SortMergeJoin [a" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = pairs.collect()
    assert len(found) == len(set(found)) and all(r["a"] < r["b"] and split[r["a"]] != split[r["b"]] for r in found)
    want = {(i, j): float(x[i] @ x[j]) for i in range(65) for j in range(i + 1, 65) if split[i] != split[j] and x[i] @ x[j] >= 0.9}
    assert len(want) > 20 and set(want) <= {(r["a"], r["b"]) for r in found}
    few = spark.createDataFrame([(1, 4), (4, 50), (7, 8)], "a long, b long")
    kept = audit.in_pairs(v, few)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 7, 8, 50]
    got = {(r["a"], r["b"]): r["similarity"] for r in audit.similarities(v, pairs).collect()}
    assert set(got) == {(r["a"], r["b"]) for r in found} and np.allclose([got[k] for k in want], list(want.values()))


def test_terms_are_counted_in_as_many_tasks_as_parts(spark, monkeypatch):
    """Both sides of the count grow in number, not in size, with the texts; counts equal those of (doc_id, term) rows, repeated ids and nulls
    included."""
    monkeypatch.setattr(search, "PART_CHARACTERS", 200)
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i // 2 if i < 6 else i, " ".join(f"w{x}" for x in rng.integers(10, 30, int(rng.integers(0, 9)))) or None) for i in range(60)], "doc_id long, text string")
    parts = search.text_parts(docs, "text", search.FINER)
    assert parts > 2 * spark.sparkContext.defaultParallelism and parts > 3 * search.text_parts(docs, "text")
    counts = search.term_counts(docs)
    assert counts._jdf.queryExecution().executedPlan().toString().count(f", {parts})") >= 2
    plain = search.terms(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))


def test_scores_of_a_step_are_bounded():
    """Two thousand queries meet few enough rows at a time for a million scores, and all rows in the end."""
    block = search.Block.of(pa.table({"id": pa.array(range(2000), pa.int64()), "v": pa.array([[1.0, 2.0]] * 2000)}))
    rows = pa.table({"id": pa.array(range(3000), pa.int64()), "v": pa.array([[0.5, 0.5]] * 3000)})
    sizes = [(len(own), part.num_rows) for own, part in search._steps(block, rows)]
    assert sum(a for a, _ in sizes) == 3000 and all(a == b and a * 2000 <= 1_000_000 for a, b in sizes)


def test_chunks_keep_every_bit():
    """Rows come back from a packed chunk as they were: empty and null vectors, like weights, great and negative hashes."""
    rng = np.random.default_rng(2)
    h = [sorted(int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)) for n in (5, 0, 300, 7)] + [[-(1 << 63), 0, (1 << 63) - 1], None]
    w = [[float(x) for x in rng.choice([0.1, 0.1 + 2e-17, 1 / 3, -0.0, 5e-324], len(x))] for x in map(lambda x: x or [], h)]
    rows = pa.table({"id": pa.array(range(6), pa.int64()), "label": pa.array([1, None, 3, 4, 5, 6]), "h": pa.array(h, pa.list_(pa.int64())), "w": pa.array(w, pa.list_(pa.float64()))})
    back = search.unpack(*(pa.py_buffer(x) for x in search.pack(rows)))
    assert back.column("h").to_pylist() == [x or [] for x in h] and back.column("w").to_pylist() == w
    assert back.select(["id", "label"]).equals(rows.select(["id", "label"]))
    assert [t.num_rows for t in search._slices(iter([rows, rows.slice(1, 4)]), 4, 306)] == [3, 4, 1, 2]
    none = rows.slice(0, 0)
    assert search.unpack(*(pa.py_buffer(x) for x in search.pack(none))).num_rows == 0


def test_search_shuffles_neither_side_again(spark, monkeypatch):
    """Chunks of both sides meet in a product of partitions: the plan has no exchange of corpus or copied queries, and each query has one result a
    task, however many chunks the corpus has."""
    monkeypatch.setattr(search, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 3))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    queries = rows.filter(F.col("id") % 10 == 0)
    found = search.cells(rows, queries, lambda block, _: search.Best(block, 4, search._semantic, None), search._FOUND_SQL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan and plan.count("Exchange rangepartitioning") <= 1
    assert found.groupBy("query_id").count().filter("count > 4 * 3").count() == 0  # 40 chunks of the corpus, 3 ways
    want = {q: sorted((i for i in range(200) if i != q), key=lambda i: -(v @ v[q])[i])[:4] for q in range(0, 200, 10)}
    got = {}
    for r in search.dense_top_k(rows, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["source_id"])
    assert got == want


def test_term_counts_of_parts_move_packed(spark, monkeypatch):
    """Texts are shuffled once, and no row a term of a part is: document frequencies go in packed ranges. Repeated ids, empty texts, rows that only
    carry a column, and flags that one row of an id has."""
    monkeypatch.setattr(search, "PART_CHARACTERS", 50)
    texts = [(1, "ab cd ab", True, False, None), (1, "ef", True, False, None), (2, None, True, False, None), (3, "ab zz", True, False, None), (4, "zz qq zz", True, False, None)]
    carried = [(i, None, False, True, [float(i)]) for i in (1, 2, 4, 9)]
    docs = spark.createDataFrame(texts + carried, "doc_id long, text string, fit boolean, keep boolean, v array<double>").withColumn("odd", (F.col("text") == "ef") | (F.col("doc_id") == 9))
    chunks = search.document_chunks(docs, "test-chunks", minimum=1, carry=("v",), flags=("odd",))
    got = {r["id"]: r for r in chunks.rows().collect()}
    assert {i: (r["v"], r["odd"], len(r["h"])) for i, r in got.items()} == {1: ([1.0], True, 5), 2: ([2.0], False, 0), 4: ([4.0], False, 4), 9: ([9.0], True, 0)}
    idf = lambda df: np.log((1 + 5) / (1 + df)) + 1  # noqa: E731  five rows count
    raw = np.array([(1 + np.log(2)) * idf(2), *[idf(1)] * 4])
    assert np.allclose(sorted(got[1]["w"]), sorted(raw / np.sqrt(raw @ raw)))
    plan = search.document_vectors(docs.select("doc_id", "text", "fit"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan


def test_large_blocks_lose_no_pair(spark, monkeypatch):
    """A start that 40 texts have, dealt into ranges, and one that two have: every pair that difflib finds, each once; with many kinds of characters
    too, which share columns."""
    import difflib

    from deskmill.operators import audit

    monkeypatch.setattr(audit, "BLOCK_TEXTS", 6)
    rng = np.random.default_rng(9)
    start = "one two three four five six seven eight"
    bases = [[f"{chr(97 + int(x))}{int(y)}" for x, y in zip(rng.integers(0, 26, 30), rng.integers(0, 10, 30))] for _ in range(8)]
    texts = [f"{start} {' '.join([*b[:k], 'new', *b[k + 1 :]])}" for b in bases for k in (3, 9, 15, 21, 27)]
    texts += [f"another start {' '.join(bases[0])} {x}" for x in "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, classifier_text string")
    want = {}
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            if x < y and x.split()[:8] == y.split()[:8] and (r := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.92:
                want[i, j] = r
    found = audit.high_similarity_pairs(rows).collect()
    assert len(found) == len(want) > 40 and {(r["left_id"], r["right_id"]): r["ratio"] for r in found} == want
    wide = ["".join(map(chr, range(k, k + 6000))) for k in (300, 310, 9000)]
    assert list(audit._close(wide, None, 0.92)) == [(0, 1)] and list(audit._close(wide[:1], wide[1:], 0.92)) == [(0, 1)]


def test_like_texts_stand_in_one_part(spark, monkeypatch):
    """Partners in the audit get one group, two steps away too, and offers one label, so their vectors and terms move to one part; a group or label
    that is too large is dealt by ids, with the same similarities."""
    from deskmill.operators import audit

    pairs = spark.createDataFrame([(3, 5), (3, 9), (5, 9), (10, 12), (12, 14), (20, 21)], "a long, b long")
    assert {r["doc_id"]: r["group"] for r in audit.groups(pairs).collect()} == {3: 3, 5: 3, 9: 3, 10: 10, 12: 10, 14: 10, 20: 20, 21: 20}
    v = spark.createDataFrame([(i, ("train", "test")[i % 2], [7, 8, 100 + i // 10], [9, 9, 2], [0.5, 0.5, 0.5**0.5]) for i in range(40)], "doc_id long, split string, h array<long>, dfs array<int>, w array<double>")
    offered = audit.offers(v, 0.9)
    assert {(r["doc_id"] // 10, r["label"]) for r in offered.collect()} == {(k, 100 + k) for k in range(4)}
    monkeypatch.setattr(audit, "PART_OFFERS", 13)
    monkeypatch.setattr(audit, "BLOCK_VALUES", 9)
    found = {(r["a"], r["b"]) for r in audit.usual_candidates(offered, 0.9).collect()}
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if i // 10 == j // 10 and (i + j) % 2}
    assert want <= found
    near = spark.createDataFrame(sorted(want), "a long, b long")
    assert {(r["a"], r["b"]) for r in audit.similarities(v, near).filter("similarity > 0.999999").collect()} == want


def test_folds_shuffle_no_features(spark):
    """Labels stand beside the features and weights are broadcast, so a fold's training rows and their margins' sigmoids exchange no vector."""
    from deskmill.operators import classify, ml

    df = spark.createDataFrame([(i, "red apple tree" if i % 2 else "blue sea water", "ab"[i % 2], None if i == 3 else "train") for i in range(12)], "doc_id long, classifier_text string, queue string, split string")
    x = ml.features(df, ml.fit_terms(df), keep=("queue", "split"))
    assert {(r["doc_id"], r["queue"], r["split"]) for r in x.collect()} == {(r["doc_id"], r["queue"], r["split"]) for r in df.collect()}
    ready = ml._ready(x.filter("doc_id % 3 <> 0"), "queue", classify.encode_labels(df.select(F.col("queue").alias("label"))))
    left = ready._jdf.queryExecution().executedPlan().toString()
    assert ready.count() == 8 and "SortMergeJoin" not in left and left.count("BroadcastHashJoin") == 2
