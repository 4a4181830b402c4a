"""Rules, classifiers, decontamination, revisits and chat on small cases."""

import re
import struct
from datetime import datetime

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deskmill.llm import chat, decontaminate, langid, quality, repetition, revisits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, x, None, "s", 1) for i, x in enumerate(texts)] + [(None, "lost", None, None, None)], SCHEMA).withColumnRenamed("source", "score").withColumnRenamed("n_chars", "kept")


def brute_rules(text, least=6):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    eight = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, g in enumerate(eight) if eight.count(g) > 1 for j in range(i, i + 8)}
    cover, longest = set(), 0
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                m = 0
                while max(i, j) + m < len(w) and w[i + m] == w[j + m]:
                    m += 1
                if m >= least:
                    cover |= set(range(i, i + m))
                    longest = max(longest, m)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(cover), longest


def test_rules(spark):
    rng = np.random.default_rng(3)
    words = lambda n, k=40: " ".join(f"é{x}" for x in rng.integers(0, k, n))
    part = words(12)
    texts = [None, "", " \n\t", "one", "a " * 60, f"{part}\n{words(30)}\n{part}\n \n \n{part} #*|", words(90, 4), words(50), "x\ny\nx\n x\nx", f"{part} {part} {part}", words(200, 2000)]
    got = {r["doc_id"]: r for r in repetition.quality_rules(frame(spark, texts)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, x in enumerate(texts):
        want = brute_rules(x)
        assert tuple(got[i][c] for c in repetition.COLUMNS) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert got[10]["kept"] and not got[4]["kept"] and not got[0]["kept"]
    assert repetition.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules_long(spark):
    """Texts of megabytes, over a chunk: one of distinct words, one of a single word, one that holds a long passage twice."""
    rng = np.random.default_rng(5)
    distinct = " ".join(f"w{x}" for x in rng.permutation(300_000))
    passage = " ".join(f"p{x}" for x in rng.permutation(5_000))
    texts = [distinct, "again " * 200_000, f"{passage} {distinct} {passage}", "z" * 3_000_000]
    got = {r["doc_id"]: r for r in repetition.quality_rules(frame(spark, texts)).collect()}
    assert [(got[i]["n_words"], got[i]["covered_words"], got[i]["longest_repeat"]) for i in range(4)] == [(300_000, 0, 0), (200_000, 200_000, 199_999), (310_000, 10_000, 5_000), (1, 0, 0)]
    assert got[0]["kept"] and not got[1]["kept"] and not got[2]["kept"]


def test_language(spark):
    rng = np.random.default_rng(1)
    sets = {"en": "the of and ing tion er".split(), "fr": "le la eau ment é que".split()}
    text = lambda k: " ".join("".join(rng.choice(sets[k], 2)) for _ in range(40))
    train = spark.createDataFrame([(k, text(k)) for k in ("en", "fr") for _ in range(20)] + [(None, "x"), ("en", None)], "lang string, text string")
    texts = [text("fr"), text("en"), None, "", "123 !? \n", "»« 。", text("en") * 300]
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, texts), train).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["fr", "en", "und", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2]["score"] == 0
    none = langid.identify(frame(spark, texts), train.limit(0)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def plain_grams(text):
    """Counts of the n-grams of 1 to 3 bytes of one text, runs of anything but letters made one space, at both ends too."""
    data = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode())
    out = {}
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            g = data[i : i + n]
            if g != b" ":
                out[g] = out.get(g, 0) + 1
    return out


def plain_ranks(counts, size):
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size])}


@pytest.mark.parametrize("size", [40, langid.SIZE])
def test_language_plain(spark, size):
    """Profiles and out-of-place distances recomputed in plain Python, rows that repeat and a very long text included."""
    rng = np.random.default_rng(7)
    sets = {"de": "der und ein ß ung ich über".split(), "en": "the of and ing tion er".split(), "fr": "le la eau ment é que".split()}
    text = lambda k, n: " ".join("".join(rng.choice(sets[k], 2)) for _ in range(n))
    training = [(k, text(k, int(rng.integers(5, 60)))) for k in sets for _ in range(8)] + [("en", None), ("fr", ""), (None, "xyz")]
    texts = [text(k, int(rng.integers(1, 30))) for k in sets for _ in range(6)] + ["a", "zzz 12", "É", "Mixed der the le", text("en", 60_000), None, "42"]
    learned = {}
    for k, t in training:
        if k:
            for g, n in plain_grams(t).items():
                learned.setdefault(k, {}).setdefault(g, 0)
                learned[k][g] += n
    profile = {k: plain_ranks(c, size) for k, c in learned.items()}
    rows = frame(spark, texts).unionByName(frame(spark, texts).filter("doc_id < 3")).repartition(3)
    got = langid.identify(rows, spark.createDataFrame(training, "lang string, text string"), size).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        own = plain_ranks(plain_grams(texts[r["doc_id"]]), size)
        if not own:
            assert (r["lang_pred"], r["score"], r["fit"]) == ("und", 0.0, 0.0)
            continue
        far = sorted((sum(abs(profile[k][g] - n) if g in profile[k] else size for g, n in own.items()) / (len(own) * size), k) for k in profile)
        assert r["lang_pred"] == far[0][1]
        assert r["score"] == pytest.approx(min(1, max(0, (far[1][0] - far[0][0]) / max(far[1][0], 1e-12)))) and r["fit"] == pytest.approx(1 - far[0][0])


def test_language_empty(spark):
    train = spark.createDataFrame([("en", "the")], "lang string, text string")
    assert langid.identify(frame(spark, []).filter("doc_id is not null"), train).count() == 0


def test_language_counts():
    """Counts too large to be packed rank as they are."""
    row, code, count = np.array([0, 0, 0]), np.array([5, 6, 7]), np.array([1 << 23, (1 << 23) + 1, 3])
    assert langid._ranked(row, code, count, 9)[1].tolist() == [6, 5, 7]


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(f"word{x}" for x in rng.integers(0, 900, 80)) + "."
    bad = lambda: " ".join(f"W{x}### !!" for x in rng.integers(0, 5, 60))
    texts = [good() if i % 3 else bad() for i in range(150)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, y int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(frame(spark, texts), labels, "doc_id % 4 <> 1", count=64).collect()}
    assert len(got) == 152 and all(0 <= x <= 1 for x in got.values())
    held = [i for i in range(150) if i >= 120 or i % 4 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    none = quality.classify(frame(spark, texts), labels.limit(0), "true", count=16).collect()
    assert len(none) == 152


def plain_statistics(text):
    """quality.NAMES of one text, word by word."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, size = max(len(words), 1), max(len(data), 1)
    share = lambda chars, of: sum(data.count(bytes([c])) for c in chars) / of
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    mean = sum(map(len, words)) / n
    upper, small, digit = range(65, 91), range(97, 123), range(48, 58)
    symbol, stop, comma, shout, bar = b"#*$%&<>@^~_=+\\/", b".?", b",;:", b"!", b"|"
    known = {*upper, *small, *digit, *symbol, *stop, *comma, *shout, *bar}
    lines = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in data.split(b"\n") if x]
    pairs = list(zip(lower, lower[1:]))
    part = [sum(1 for c in data if c >> 3 == k) / size for k in range(32)]
    return [min(x, 100.0) for x in (
        np.log1p(len(words)), mean, max(sum(len(w) ** 2 for w in words) / n - mean * mean, 0) ** 0.5, sum(len(w) > 20 for w in words) / n, share(upper, size), share(digit, size), share(symbol, size),
        share(stop, n), share(comma, n), share(shout, n), share(bar, n), share([c for c in range(33, 127) if c not in known], size), share(range(128, 256), size), len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1),
        len(set(lower)) / n, max(map(lower.count, lower), default=0) / n, 1 - len(set(pairs)) / max(len(pairs), 1), sum(65 <= w[0] <= 90 for w in words) / n, -sum(p * np.log(p) for p in part if p),
    )]


def plain_isotonic(weight, total):
    """The monotone fit by its min-max formula."""
    mean = lambda a, b: sum(total[a : b + 1]) / sum(weight[a : b + 1])
    n = len(weight)
    return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


QUALITY_TEXTS = [None, "", " \n", "One two, three! Four? | five", "A a a A\na a\n\nb ### <x> é ü 123", "x" * 90_000 + " end.", "w " * 30_000]


def test_quality_plain(spark):
    """Statistics, folds, normal equations, calibration and scores, each recomputed plainly."""
    rng = np.random.default_rng(4)
    texts = [" ".join((f"w{x}" if y else f"W{x}!") for x in rng.integers(0, 40, int(rng.integers(1, 40)))) for y in rng.integers(0, 2, 120)] + QUALITY_TEXTS
    y = {i: float("!" not in (texts[i] or "!")) if rng.random() < 0.9 else 1.0 for i in range(120)}
    y |= {3: 0.5}
    labels = spark.createDataFrame([(i, int(v)) for i, v in y.items() if i != 3] + [(3, 0), (3, 1), (4, None), (None, 1)], "doc_id long, y int")
    del y[4]
    y = {i: v for i, v in y.items() if i % 3 != 1}
    again = frame(spark, texts).unionByName(frame(spark, texts).filter("doc_id = 7")).repartition(3)
    rows = quality.classify(again, labels, "doc_id % 3 <> 1", count=24).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted([*range(len(texts)), 7])
    x = np.array([plain_statistics(t) for t in texts])
    got = {r["doc_id"]: r["x"] for r in quality.features(frame(spark, texts)).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], x, atol=1e-9)
    known = sorted([*y, 3] if 3 not in y else y)
    mean, spread = x[known].mean(axis=0), np.sqrt(np.maximum(x[known].var(axis=0), 1e-9))
    project = quality.Projection(mean, spread, 24, quality.SEED)
    z = np.clip((x - mean) / spread, -8, 8)
    p = np.column_stack((np.sqrt(2 / 24) * np.cos(z @ project.w + project.b), np.ones(len(x))))
    fold = {i: np.int64(np.uint64(xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest())) % quality.FOLDS for i in known}
    truth = np.array([y[i] for i in known])

    def fit(rows):
        a, b = p[[i for i in known if i in rows]], truth[[k for k, i in enumerate(known) if i in rows]]
        return np.linalg.solve(a.T @ a + 1e-3 * len(known) * np.eye(25) / 25 + 1e-9 * np.eye(25), a.T @ b)

    beta = fit(set(known))
    out = {k: fit({i for i in known if fold[i] != k}) for k in range(quality.FOLDS)}
    places = np.rint(np.clip((np.array([p[i] @ out[fold[i]] for i in known]) + 0.5) / 2, 0, 1) * (quality.BINS - 1))
    bins = sorted(set(places))
    curve = plain_isotonic([float((places == b).sum()) for b in bins], [float(truth[places == b].sum()) for b in bins])
    raw = p @ beta
    want = 0.999 * np.interp(np.clip((raw + 0.5) / 2, 0, 1) * (quality.BINS - 1), bins, curve) + 0.001 / (1 + np.exp(2 - 4 * raw))
    assert np.allclose([r["score"] for r in rows], [want[r["doc_id"]] for r in rows], atol=2e-5)


def test_quality_empty(spark):
    empty = frame(spark, []).filter("doc_id is not null")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, y int")
    assert quality.classify(empty, labels, "true", count=8).count() == 0


def test_isotonic():
    assert quality.isotonic(np.arange(4.0), np.ones(4), np.array([0.0, 1.0, 0.0, 1.0])).tolist() == [0.0, 0.5, 0.5, 1.0]


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_decontamination(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 60, n)]
    items = {k: words(int(rng.integers(15, 45))) for k in range(12)}
    texts = []
    for w in items.values():
        edited = [x for i, x in enumerate(w) if i % 11 != 4]
        edited[3] = "changed"
        texts += [" ".join([*words(20), *w, *words(20)]), ", ".join([*words(9), *edited]).upper(), " ".join(words(200))]
    texts += [None, "", "w1", texts[0] + " " + texts[0]]
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items.items()] + [(90, None, "x"), (91, "w1 w2", "x"), (None, "w1 w2 w3", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(frame(spark, texts), bench).collect()}
    want = {}
    for d, x in enumerate(texts):
        for k, w in items.items():
            s = smith_waterman(w, re.findall(r"[a-z0-9]+", (x or "").lower())) / (2 * len(w))
            if s >= 0.5:
                want[d, k] = s
    assert set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x]) for x in want)
    assert decontaminate.matches(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.matches(frame(spark, []).filter("doc_id is not null"), bench).count() == 0


def test_decontamination_repeats(spark):
    """Every text of a repeated item or document is searched, in texts of megabytes too."""
    rng = np.random.default_rng(9)
    words = lambda n, k: " ".join(f"{k}{x}" for x in rng.integers(0, 50_000, n))
    one, two = words(30, "a"), words(30, "b")
    bench = spark.createDataFrame([(1, one), (1, two), (1, one), (2, None)], "item_id long, text string")
    docs = frame(spark, [words(200_000, "c") + f" {two} " + words(100_000, "d"), one, "nothing of it", None])
    docs = docs.unionByName(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(2).cast("long")))
    got = sorted((r["doc_id"], r["item_id"], r["score"], r["start_word"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(0, 1, 1.0, 200_000), (1, 1, 1.0, 0), (2, 1, 1.0, 0)]


def test_decontamination_edits(spark):
    rng = np.random.default_rng(21)
    words = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 400]
    items = {k: words(int(rng.integers(15, 60))) for k in range(10)}
    texts = [" ".join(words(300)) for _ in range(10)]
    for w in items.values():
        texts += [" ".join([*words(30), *w, *words(30)])] * 2  # intact copies besides the edited ones
        for step in (3, 4, 5, 6):
            changed = [f"new{i}" if i % step == step - 1 else x for i, x in enumerate(w)]
            grown = [y for i, x in enumerate(w) for y in ([x, f"more{i}"] if i % step == 1 else [x])]
            texts += [" ".join([*words(40), *x, *words(40)]) for x in (changed, grown)]
        texts.append(" ".join(y for i, x in enumerate(w) for y in ([x, f"more{i}"] if i % 2 else [x])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(frame(spark, texts), bench).collect()}
    want = {(d, k): smith_waterman(w, x.split()) / (2 * len(w)) for d, x in enumerate(texts) for k, w in items.items()}
    want = {x: s for x, s in want.items() if s >= 0.5}
    assert len(want) >= 100 and set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x]) for x in want)


def test_decontamination_stretched(spark):
    """Alignments with as little left in one piece as their score allows: a word put between every two, every other word gone."""
    rng = np.random.default_rng(12)
    items = [[f"q{x}" for x in rng.permutation(200)[: int(rng.integers(3, 40))]] for _ in range(30)]
    other = lambda n: [f"z{x}" for x in rng.integers(0, 500, n)]
    texts = []
    for w in items:
        texts.append([y for x in w for y in (x, *other(1))][:-1])
        texts.append([x for k, x in enumerate(w) if k % 3])
        k = int(rng.integers(1, len(w)))
        texts.append([*w[:k], *other(len(w) // 2), *w[k:]])
        texts.append([x if rng.random() < 0.7 else f"z{x}" for x in w])
        texts.append([*other(30), *(x for x in w if rng.random() < 0.75), *other(5)])
    rows = [(i, " ".join(x), None, "s", 1) for i, x in enumerate(texts)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    want = {(i, j): smith_waterman(w, x) / (2 * len(w)) for i, x in enumerate(texts) for j, w in enumerate(items)}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.5}
    assert len(got) > 90 and sum(0.5 <= v < 0.55 for v in want.values()) > 25


def test_decontamination_pieces():
    """Hits are expanded in bounded pieces: every row once, an item's rows in a document together, also where one document has very many."""
    rng = np.random.default_rng(13)
    doc = np.sort(rng.integers(0, 12, 3000))
    doc[800:2500] = 5
    items = np.concatenate([np.arange(n) for n in rng.integers(1, 60, 80)])
    start = np.flatnonzero(items == 0)
    size = np.diff(np.append(start, len(items)))
    kind = rng.integers(0, 80, 3000)
    first, many = start[kind], size[kind]
    pieces = list(decontaminate.expanded(np.sort(doc), items, first, many, most=2000))
    assert sum(len(h) for h, _ in pieces) == many.sum() and max(len(h) for h, _ in pieces) < 5000
    rows = sorted((int(h), int(i)) for a, b in pieces for h, i in zip(a, b))
    assert rows == sorted((k, int(i)) for k in range(3000) for i in items[first[k] : first[k] + many[k]])
    where = {}
    for n, (a, b) in enumerate(pieces):
        for d, i in set(zip(np.sort(doc)[a].tolist(), b.tolist())):
            assert where.setdefault((d, i), n) == n
    assert list(decontaminate.expanded(doc[:0], items, first[:0], many[:0])) == []


def test_revisits_types(spark):
    """Only responses of status 200 are full; others keep an outcome of their own and are no base."""
    t = datetime(2024, 1, 1)
    rows = [(i, kind, "http://a.org/x", t.replace(hour=i), status, None, None, {}, "b") for i, (kind, status) in enumerate([("response", 404), ("response", None), ("request", 200), (None, 200), ("warcinfo", None), ("revisit", 304), ("response", 200), ("revisit", 304)])]
    records = spark.createDataFrame(rows, "record_id long, record_type string, url string, at timestamp, status int, etag string, last_modified string, headers map<string,string>, body string")
    got = {r["record_id"]: (r["outcome"], r["body"]) for r in revisits.resolve(records).collect()}
    assert got == {0: ("other_status", "b"), 1: ("other_status", "b"), 2: ("other_type", "b"), 3: ("other_type", "b"), 4: ("other_type", "b"), 5: ("no_base", None), 6: ("full", "b"), 7: ("unverified", None)}


def test_revisits(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    full = lambda i, url, s, tag, body, status=200, mod=None: (i, "response", url, t(s), status, tag, mod, {"ETag": tag or "", "Content-Type": "text/html", "Date": "old"}, body, "x")
    again = lambda i, url, s, tag, mod=None: (i, "revisit", url, t(s) if s is not None else None, 304, tag, mod, {"date": "new", "Content-Type": "no"}, None, "x")
    rows = [full(1, "http://www.A.com/p.html?utm_source=x", 1, '"1"', "one"), full(2, "https://a.com/p", 5, '"2"', "two"), full(3, "https://a.com/p", 6, '"3"', "bad", 404), again(4, "https://a.com/p/#f", 3, 'W/"1"'), again(5, "http://a.com:80/p", 9, '"2"'), again(6, "http://a.com/p", 9, '"9"'), again(7, "http://a.com/p", 1, None), again(8, None, 9, None), again(9, "http://a.com/p", None, None), full(10, "http://m.org", 1, None, "m", 200, "mon"), again(11, "http://m.org/", 2, '"z"', "tue"), again(12, "http://m.org/", 2, None, "mon"), full(13, "http://n.org", 1, None, "n"), again(14, "http://n.org", 2, '"z"'), again(15, "http://m.org", 3, '"z"')]
    schema = "record_id long, record_type string, url string, at timestamp, status int, etag string, last_modified string, headers map<string,string>, body string, base_id string"
    got = {r["record_id"]: r for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r["outcome"], r["base_id"], r["body"]) for k, r in got.items() if r["record_type"] == "revisit"} == {4: ("resolved", 1, "one"), 5: ("resolved", 2, "two"), 6: ("validator_mismatch", None, None), 7: ("no_base", None, None), 8: ("no_base", None, None), 9: ("no_base", None, None), 11: ("validator_mismatch", None, None), 12: ("resolved", 10, "m"), 14: ("unverified", None, None), 15: ("unverified", None, None)}
    assert got[4]["headers"] == {"ETag": '"1"', "Content-Type": "text/html", "date": "new"} and got[4]["status"] == 200


RECORD = "record_id long, record_type string, url string, at timestamp, status int, etag string, last_modified string, headers map<string,string>, body string, hot_key string"


def test_revisits_repeats(spark):
    """Rows that repeat a record give one row each; responses that share an id have one body."""
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    body = "x" * 3_000_000
    one = (1, "response", "http://a.com/", t(1), 200, '"1"', None, {"A": "b"}, body, "")
    two = (2, "revisit", "http://a.com", t(2), 304, '"1"', None, None, None, "")
    other = (2, "revisit", "http://a.com", t(2), 304, '"9"', None, None, None, "")
    less = (1, "response", "http://a.com/", t(1), 200, '"1"', None, {"A": "b"}, "a", "")
    out = revisits.resolve(spark.createDataFrame([one, one, less, two, two, other], RECORD)).collect()
    assert sorted((r["record_id"], r["outcome"], len(r["body"] or "")) for r in out) == [(1, "full", 1), (1, "full", len(body)), (1, "full", len(body)), (2, "resolved", len(body)), (2, "resolved", len(body)), (2, "validator_mismatch", 0)]
    assert revisits.resolve(spark.createDataFrame([], RECORD)).count() == 0


def test_revisits_hot_url(spark):
    """A URL that is cut into time ranges gives what a whole window gives, ties and gaps included."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(700):
        kind = "response" if rng.random() < 0.2 else "revisit"
        at = datetime.fromtimestamp(1_700_000_000 + int(rng.integers(0, 400)) * (1 if i % 2 else 9))
        rows.append((i, kind, f"http://{'hot' if i % 3 else 'cold%d' % (i % 5)}.org/", at, 200 if kind == "response" and i % 7 else 304, f'"{rng.integers(0, 3)}"', None, None, f"body {i}" if kind == "response" else None, "x"))
    df = spark.createDataFrame(rows, RECORD)
    got = [sorted(map(str, revisits.resolve(df, hot_rows=n).drop("headers").collect())) for n in (10**9, 100, 0)]
    assert got[0] == got[1] == got[2]
    want = {}
    for r in rows:
        if r[1] == "revisit":
            earlier = [(b[3], b[0], b[5]) for b in rows if b[1] == "response" and b[4] == 200 and b[2] == r[2] and b[3] < r[3]]
            base = max(earlier, default=None)
            want[r[0]] = base[1] if base and base[2] == r[5] else None
    assert {r["record_id"]: r["base_id"] for r in revisits.resolve(df, hot_rows=50).filter("record_type = 'revisit'").collect()} == want


def test_chat(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (2, 0, "user", "a", "x"), (3, 5, "user", "a", "x"), (3, 7, "assistant", "b", "x"), (3, 9, "user", None, "x"), (4, 0, "user", "a", "x"), (4, 1, "assistant", "c", "x"), (5, 0, "user", "a", "x"), (5, 1, "assistant", "c", "x"), (None, 0, "user", "z", "x"), (6, None, None, None, "x"), (6, None, None, None, "x")]
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")).collect()}
    assert sorted(got) == [3, 4, 6] and got[3][0] == 3 and got[6][0] == 1
    assert got[4][1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_long(spark):
    """A conversation of many turns and one with a turn of megabytes; ties of turns and exact repeats."""
    many = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(4000)]
    rows = [*many, *((2, *r[1:]) for r in many[:2500]), (3, 0, "user", "x" * 3_000_000), (4, 0, "user", "b"), (4, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    got = {r["conv_id"]: (r["n_turns"], len(r["chat"])) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [1, 3, 4] and got[1][0] == 4000 and got[3][1] > 3_000_000 and got[4][0] == 2
