"""N-gram join and run-length index against brute force."""

import re
from fractions import Fraction

import numpy as np
import pytest

from deskmill.llm import ngram_join, runindex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_components(rows, n, t):
    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    by = {}
    for d in ids:
        for g in sets[d]:
            by.setdefault(g, []).append(d)
    seen = {(a, b) for v in by.values() if len(v) < 400 for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in seen:
        o = len(sets[a] & sets[b])
        if o and t.denominator * o >= t.numerator * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies(rng, base, count, edits):
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(count):
        w = base.split()
        for p in rng.choice(len(w), int(rng.integers(0, edits + 1)), replace=False):
            w[p] = vocabulary[rng.integers(3000)]
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 2000, n))
    texts = [None, "", "  \n", "one", "One", "one two three", "ONE two three", "one two three four", "a b a b a b a b a b"]
    for _ in range(6):
        base = words(int(rng.integers(40, 200)))
        texts += near_copies(rng, base, 12, max(2, len(base.split()) // 25))
    common = words(30)
    texts += [f"{words(40)} {common} {words(30)}" for _ in range(40)] + [words(50) for _ in range(30)] + ["x " * 5000]
    texts += texts[20:26] * 3
    return [(i * 7, x) for i, x in enumerate(texts)]


@pytest.mark.parametrize(("n", "t"), [(4, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_join(spark, rows, n, t):
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows] + [(None, "one", None, None, None), (7 * 40, rows[40][1], "en", "again", 2)], SCHEMA).withColumnRenamed("source", "component_id")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df.repartition(3), n, t).collect()}
    assert got == brute_components(rows, n, t)


@pytest.mark.parametrize("sizes", [ngram_join.Sizes(400, 150, 3, 5, 8), ngram_join.Sizes(900, 100, 4, 7, 10**9), ngram_join.Sizes(part=10**9, hot=2)])
def test_join_divided(spark, rows, sizes):
    """Small blocks, ranges dealt in two steps and hot n-grams change no result, with repeated rows too."""
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows + rows[:60:3]], SCHEMA)
    t = Fraction(85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df.repartition(3), 4, t, sizes=sizes).collect()}
    assert got == brute_components(rows, 4, t)


def test_join_hot(spark):
    """A phrase in every document: no group of entries grows with the documents that share it."""
    rng = np.random.default_rng(12)
    count = 20_000
    words = rng.integers(0, 5000, (count, 12))
    rows = [(i, "one phrase for all " + " ".join(f"w{x}" for x in w)) for i, w in enumerate(words)]
    rows += [(count + i, rows[i][1]) for i in range(3)]
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows], SCHEMA).repartition(8)
    sizes = ngram_join.Sizes(flush=20_000, part=5000, wide=16, hot=2000)
    t = Fraction(85, 100)
    seen = ngram_join.shingle_sets(df, 4, sizes=sizes).cache()
    total = seen.filter("gram is null").agg({"n_shingles": "sum"}).first()[0]
    grams, often = ngram_join.hot_ngrams(seen, total, sizes)
    assert len(grams) == 1 and 0.9 * count < often[0] <= len(rows)
    ranges = ngram_join.Ranges.of(total, 8, sizes)
    assert ranges.inner > 1
    for hot, most in (((grams, often), 12_000), ((grams[:0], often[:0]), count)):
        largest = ngram_join.dealt(df, 4, ranges, hot, sizes=sizes).groupBy("part").agg({"n": "sum"}).agg({"sum(n)": "max"}).first()[0]
        assert largest < most if len(hot[0]) else largest >= most
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df, 4, t, sizes=sizes).collect()}
    assert got == {d: d - count if d >= count else d for d, _ in rows}


def test_join_long_text(spark):
    """A text of megabytes is one set, and links with its copy."""
    rng = np.random.default_rng(13)
    words = [f"t{x}" for x in rng.integers(0, 50_000, 400_000)]
    other = words[:1000] + ["new"] + words[1001:]
    rows = [(3, " ".join(words)), (1, " ".join(other)), (2, " ".join(words[:2000]))]
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, 4, Fraction(85, 100)).collect()}
    sets = {d: len(set(zip(*(x.split()[k:] for k in range(4))))) for d, x in rows}
    assert got == {3: (sets[3], 1), 1: (sets[1], 1), 2: (sets[2], 2)}


def test_join_shared_id(spark):
    """An id with several texts has the links of each; the fullest text gives the set size."""
    words = lambda a, n=60: " ".join(f"w{a}x{i}" for i in range(n))
    rows = [(5, words(1, 70)), (5, words(2)), (5, " "), (5, None), (2, words(1, 70)), (9, words(2)), (7, words(3)), (7, words(3)), (8, words(4)), (1, words(4) + " more")]
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows], SCHEMA)
    for part in (df, df.repartition(4), df.orderBy("text")):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(part, 5).collect()}
        assert got == {5: (66, 2), 2: (66, 2), 9: (56, 2), 7: (56, 7), 8: (56, 1), 1: (57, 1)}


def test_frequency_code():
    df = np.concatenate((np.arange(1, 20_000), 2 ** np.arange(15, 60)))
    code = ngram_join._frequency_code(df).astype(np.int64)
    assert (np.diff(code) >= 0).all() and (code[:4096] == df[:4096]).all() and code.max() < 1 << 15


def test_join_empty(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_repeats(rows, length):
    where = {}
    for k, (_, x) in enumerate(rows):
        b = (x or "").encode()
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((k, i))
    cover = [np.zeros(len((x or "").encode()), bool) for _, x in rows]
    for v in where.values():
        if len(v) > 1:
            for k, i in v:
                cover[k][i : i + length] = True
    return {d: bytes(np.frombuffer((x or "").encode(), np.uint8)[~c]) for (d, x), c in zip(rows, cover)}


def test_repeats(spark):
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdeé \n"), n))
    shared = [text(n) for n in (399, 400, 401, 700, 1500)]
    texts = [None, "", "a" * 399, "a" * 400, "b" * 401, "ab" * 400, "c" * 3000]
    for _ in range(4):
        texts += [text(50 + 17 * k) + s + text(90) for k, s in enumerate(shared)]
    whole = text(2500)
    texts += [whole] * 5 + [whole[:1200] + "!" + whole[1200:], whole[3:], text(1) + whole[:-9] + text(4), text(600) + whole[800:1201] + text(600)]
    texts += [shared[4] + shared[4], text(20) + shared[3] * 3, text(5000)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows] + [(None, whole, None, None, None)], SCHEMA).withColumnRenamed("source", "kept")
    got = {r["doc_id"]: bytes(r["kept"]) for r in runindex.remove_repeats(df.repartition(3)).collect()}
    assert got == brute_repeats(rows, 400)
    for hot in (0, 3000):  # every bucket is split, or those of a few contexts
        split = {r["doc_id"]: bytes(r["kept"]) for r in runindex.remove_repeats(df, hot_bytes=hot).collect()}
        assert split == got
    out = runindex.digest(runindex.remove_repeats(df)).filter("doc_id = 6").first()
    assert (out["n_bytes"], out["n_removed"], out["n_spans"]) == (3000, 3000, 1)


def test_repeats_hot_passage(spark):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    short, long = text(240), text(640)
    rows = [(k, text(int(rng.integers(300, 700))) + (long if k % 2 else short) + text(500)) for k in range(60)]
    rows += [(100 + k, rows[k][1][200:1100]) for k in range(6)] + [(200, long[5:-3]), (201, long * 3)]
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows], SCHEMA)
    for hot in (0, 20_000, 1 << 20):
        assert {r["doc_id"]: bytes(r["kept"]) for r in runindex.remove_repeats(df, hot_bytes=hot).collect()} == brute_repeats(rows, 400)


def test_repeats_shared_id(spark):
    """Two texts with one id: each is cut by its own spans only."""
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common = text(450)
    rows = [(1, text(3000) + common + text(50)), (1, text(4000)), (1, "short"), (2, text(700) + common), (2, text(900)), (3, None), (3, "")]
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows], SCHEMA)
    out = sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in runindex.remove_repeats(df).collect())
    kept = brute_repeats([(k, x) for k, (_, x) in enumerate(rows)], 400)
    assert out == sorted((d, len(x or ""), kept[k]) for k, (d, x) in enumerate(rows)) and len(kept[0]) < 3100


@pytest.mark.parametrize("length", [400, 204])
def test_repeats_near_copies(spark, length):
    """Near copies of one text, in buckets that the default does not split and in ones that it does: joins with marks make no more rows
    than contexts, however many copies there are."""
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh "), 1200))
    near = []
    for _ in range(120):
        x = list(base)
        for at in rng.choice(len(x), 3, replace=False):
            x[at] = "XYZ"[int(rng.integers(3))]
        near.append("".join(x))
    rows = list(enumerate([*near, *near[:10], base[100:900]]))
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows], SCHEMA)
    want = brute_repeats(rows, length)
    for hot in (0, 30_000, runindex.HOT_BYTES):
        assert {r["doc_id"]: bytes(r["kept"]) for r in runindex.remove_repeats(df, length, hot_bytes=hot).collect()} == want


def test_repeats_periodic(spark):
    """Texts that repeat a sign or a line all along, over what an index holds: whole runs go, in reasonable time."""
    line = "one line that is said again and again, always the same\n"
    rows = [(0, "x" * 1_500_000), (1, line * 30_000), (2, "before " + line * 40 + " after"), (3, line * 7), (4, line * 9 + "y" * 399)]
    df = spark.createDataFrame([(d, x, None, "s", 1) for d, x in rows], SCHEMA)
    got = {r["doc_id"]: bytes(r["kept"]) for r in runindex.remove_repeats(df).collect()}
    assert got == {0: b"", 1: b"", 2: b"before  after", 3: (line * 7).encode() if len(line) * 7 < 400 else b"", 4: b"y" * 399}


def test_repeats_empty(spark):
    assert runindex.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_run_index():
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (40, 1, 0, 33, 40)] + [b"ab" * 30]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    index = runindex.RunIndex(np.frombuffer(b"".join(parts), np.uint8), offs)
    ms = index.matching_statistics()
    every = [(k, i) for k, x in enumerate(parts) for i in range(len(x))]
    for k, i in every:
        best = 0
        for k2, i2 in every:
            if (k, i) != (k2, i2):
                a, b = parts[k][i:], parts[k2][i2:]
                m = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                best = max(best, m)
        assert ms[index.starts[k] + i] == best
    assert len(index.runs) < index.n
