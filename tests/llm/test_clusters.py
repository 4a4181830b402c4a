"""Centroid clustering and the source audit against plain recomputations."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from deskmill.llm import centroids, divergence

VECTORS = "vec_id long, embedding array<float>, distance string"
DOCS = "doc_id long, text string, lang string, source string, term string, n int"


def plain_lloyd(rows, k=16, rounds=3, size=64, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) and -centroids.LARGEST <= x * scale < centroids.LARGEST for x in v):
            kept.append((i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]))
    c = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, x)) for x in c] for _, v in kept]
        of = [d.index(min(d)) for d in far]
        if step < rounds:
            for j in range(len(c)):
                own = [v for (_, v), o in zip(kept, of) if o == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    per = defaultdict(int)
    for d, o in zip(far, of):
        per[o] += d[o]
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((i, o, d[o], per[o], sum(per.values()), name[o]) for (i, _), d, o in zip(kept, far, of))


def clustered(spark, rows, **kw):
    return Counter(map(tuple, centroids.cluster(spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS), **kw).collect()))


def test_clusters(spark):
    rng = np.random.default_rng(2)
    spread = rng.normal(size=(5, 64)) * 2
    rows = [(i, (spread[i % 5] + rng.normal(size=64)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(60)]  # a group of copies
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # a repeated id, with another vector too, and no id
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] * 64), (306, [float("inf")] + [0.0] * 63), (307, [3e9] + [0.0] * 63)]
    assert clustered(spark, rows) == plain_lloyd(rows)


def test_clusters_ties(spark):
    """Points on a grid lie between centroids; few values, so equal distances and equal centroids are many."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(0, 3, 4) / 2).tolist()) for i in range(120)]
    for k in (1, 2, 5, 40):
        assert clustered(spark, rows, k=k, size=4, scale=2) == plain_lloyd(rows, k=k, size=4, scale=2)
    assert clustered(spark, rows[:3], size=4, scale=2) == plain_lloyd(rows[:3], size=4, scale=2)
    assert not clustered(spark, [])
    assert not clustered(spark, [(None, [0.0] * 64)])


def test_exponion_measures_less():
    """Vectors near their centroid are left alone, and the ball holds few of many spread centroids."""
    rng = np.random.default_rng(6)
    c = np.array([[1000 * i, 0] for i in range(100)], np.int64)
    near = centroids.Neighbours(c)
    x = c[rng.integers(0, 100, 500)] + rng.integers(-600, 600, (500, 2))
    start = rng.integers(0, 100, 500)
    far = np.sqrt(centroids.squared(x, c[start]))
    best, first, second = centroids.search(x, start, far, near)
    exact = np.sqrt(((x[:, None, :] - c) ** 2).sum(2))
    assert (best == exact.argmin(1)).all() and np.allclose(first, exact.min(1)) and np.allclose(second, np.sort(exact, 1)[:, 1])
    again = near.inside(best, 2 * first + near.gap[best])
    assert again.max() <= 5
    same = centroids.assign(x, best, first, second, near, np.zeros(100))
    assert (same[0] == best).all()


def plain_audit(rows, least, top):
    text = defaultdict(list)
    for _, t, lang, source, *_ in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        text[lang or "", source or ""].append(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t))
    out = set()
    for lang in {k[0] for k in text}:
        own = {s: v for (x, s), v in text.items() if x == lang}
        df = Counter(w for docs in own.values() for d in docs for w in set(d))
        kept = [w for w, n in df.items() if n >= least]
        count = {s: Counter(w for d in docs for w in d) for s, docs in own.items()}
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        share, all_ = {s: p(c) for s, c in count.items()}, p(sum(count.values(), Counter()))
        for s in own:
            far = [(sum(abs(share[s][w] - share[o][w]) for w in kept), o) for o in own if o != s]
            above = [(share[s][w] - all_[w], w) for w in kept if count[s][w] and share[s][w] > all_[w]]
            for part, found, most in (("pair", far, None), ("term", above, top)):
                for k, (f, item) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode()))[:most]):
                    out.add((lang, s, part, item, f, k + 1))
    return out


@pytest.mark.parametrize("cells", [divergence.WIDTH, 2048])
def test_audit(spark, cells):
    """Equal to plain counting, whatever the sketch leaves out."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("é", "The", "ß_", "x-", "ÀB") for b in "abcdefgh"]
    rows = []
    for i in range(300):
        s = ("hot", "hot", "b", "c", "D")[i % 5]
        pick = rng.zipf(1.4, rng.integers(0, 30)) % len(words)
        rows.append((i, " ".join(words[(j + len(s)) % len(words)] for j in pick), "en" if i % 3 else "fr", s, "x", 1))
    rows += [rows[4]] * 20  # repeated rows
    rows += [(None, "The the THE", None, None, None, None), (400, None, "en", "silent", None, None), (401, "12 +", "de", "one", None, None), (402, "", "de", None, None, None), (403, "lone", "it", "only", None, None)]
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS), least=10, top=4, cells=cells).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 10, 4)


def test_audit_long_and_empty(spark):
    rng = np.random.default_rng(9)
    long = " ".join(f"w{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (1_500_000, 2)))
    rows = [(1, long, "en", "a", None, None), (2, "z" * 3_000_000, "en", "b", None, None), (3, "waa wab", "en", "b", None, None)]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS), least=2, top=3).collect()}
    assert got == plain_audit(rows, 2, 3)
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_never_underestimates(spark):
    rows = spark.createDataFrame([(i, f"common {'abcdefghij'[i % 10]} {'q' * (i + 1)}", "en", "s", None, None) for i in range(100)], DOCS)
    own = divergence.documents(rows)
    found = divergence.sketch(own, 10)
    kept = {r["term"] for r in divergence.counted(own, found).collect()}
    assert kept == {"common", *"abcdefghij"}  # of 100 rare terms none shares all cells with a frequent one here
