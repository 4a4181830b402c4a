"""The pipeline's stages on planted cases, and run() end to end."""

import re
from fractions import Fraction

import pytest
from test_pairs import brute_components
from test_rules import plain_grams, plain_ranks, smith_waterman
from test_tokens import plain

from deskmill.llm import langid

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    import numpy as np

    rng = np.random.default_rng(11)
    syllables = {"en": "the of and ing tion er th wh ly".split(), "fr": "le la eau ment é que oi aux ç".split()}
    word = lambda k: "".join(rng.choice(syllables[k], int(rng.integers(1, 4))))
    text = lambda k, n: " ".join(word(k) for _ in range(n)) + "."
    item = text("en", 40)
    shared = text("fr", 200)
    rows = []
    add = lambda x, k="en": rows.append((len(rows), x, k, "s", len(x) if x else None))
    for i in range(40):
        add(text("en" if i % 2 else "fr", 120), "en" if i % 2 else "fr")
    first = rows[3][1]
    add(first)
    w = first.split()
    w[50] = "changed"
    add(" ".join(w))
    for k in range(3):
        add(text("fr", 90 + k) + " " + shared + " " + text("fr", 80), "fr")
    add(text("en", 60) + " " + item + " " + text("en", 30))
    edited = item.split()
    edited[7], edited[21] = "x", "y"
    add(text("en", 50) + " " + " ".join(edited).upper() + " " + text("en", 50))
    add(None)
    add("12 34 !!")
    add("")
    d = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, shared


def test_stages(spark, planted):
    d, rows, shared = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    n = len(rows)
    one = corpus_pipeline.language(spark, docs, d)
    assert one.columns == docs.columns and ids(one) == set(range(n - 3))
    two = corpus_pipeline.near_duplicates(spark, one, d)
    assert two.columns == docs.columns and ids(two) == set(range(n - 3)) - {40, 41}
    three = corpus_pipeline.repeated_passages(spark, two, d)
    assert three.schema == docs.schema
    got = {r["doc_id"]: r for r in three.collect()}
    assert set(got) == ids(two)
    for k in (42, 43, 44):
        assert shared[5:-5] not in got[k]["text"] and len(got[k]["text"]) < len(rows[k][1]) - 400 and got[k]["n_chars"] == len(got[k]["text"])
    assert all(got[k]["text"] == rows[k][1] for k in range(40))
    four = corpus_pipeline.decontaminated(spark, three, d)
    assert ids(four) == set(got) - {45, 46}
    five = corpus_pipeline.packed(spark, four, d)
    assert {r["doc_id"] for r in five.collect()} == ids(four)


def test_repeated_rows(spark, tmp_path):
    """A document whose row is repeated loses the repetition, not the document; of different texts of one id the fullest stays."""
    import numpy as np

    rng = np.random.default_rng(21)
    text = lambda n: " ".join(f"{chr(97 + x % 26)}{x}" for x in rng.integers(0, 10**6, n)) + "."
    a, b, c = text(400), text(300), text(200)
    rows = [(1, a, "en", "s", len(a)), (1, a, "en", "s", len(a)), (2, b, "en", "s", len(b)), (3, c, "en", "s", len(c)), (3, text(90), "en", "s", 2), (3, None, None, None, None), (4, a, "fr", "t", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]
    left = corpus_pipeline.repeated_passages(spark, kept, str(tmp_path))
    assert sorted(map(tuple, left.collect())) == [rows[0], rows[2], rows[3]]


def test_languages(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(9)
    words = {"en": "the of and to in that is it for was house winter reading thing other".split(), "fr": "le la les de et un une que dans maison hiver lecture chose autre était".split()}
    rows = [(i, " ".join(rng.choice(words[k], int(rng.integers(1, 60)))), k, "s", 1) for i, k in enumerate(["en", "fr"] * 30)]
    other = ["Это русский текст о погоде и о людях которые там живут", "日本語の文章はここにありますそれはとても長いです", "qzx vkj wqp zzxj kqw xvq jjw qkz", "OK 12", "Hi", "12 34 !!", None]
    rows += [(100 + i, x, None, "s", 1) for i, x in enumerate(other)]
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert got == {*range(60), 103, 104}


def test_short_passages(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    words = lambda n, k=2: [chr(97 + int(x) % 26) + "abcde"[int(x) % 5] * (k - 1) + str(int(x) // 26) for x in rng.integers(0, 26 * 90, n)]
    short, tiny, fifty = words(51), [f"{chr(97 + i % 26)}{i // 26}" for i in rng.permutation(51)], words(50)
    assert len(" ".join(tiny)) < 160 and len(" ".join(short)) < 260
    texts = [[*words(57), *short, *words(9)], [*words(879), *short], [*tiny, *words(70)], [*words(400), *tiny, *words(3)], [*words(80), *fifty, *words(80)], [*words(300), *fifty, *words(20)], words(51)]
    texts.append(texts[-1])
    rows = [(i, " ".join(w) + ".", "en", "s", 1) for i, w in enumerate(texts)]
    rows[1] = (1, rows[1][1].replace(" ".join(short), ", ".join(short).upper()), "en", "s", 1)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    assert got[4] == rows[4][1] and got[5] == rows[5][1]  # 50 words are not over 50
    for k, part in ((0, short), (1, short), (2, tiny), (3, tiny)):
        i = next(j for j in range(len(texts[k])) if texts[k][j : j + 51] == part)
        assert re.findall(r"\w+", got[k]) == texts[k][:i] + texts[k][i + 51 :]


def test_run(spark, planted):
    d, rows, _ = planted
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in pieces} == set(range(len(rows) - 3)) - {40, 41, 45, 46}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontamination", "packing"]


def plain_language(rows):
    learned = {}
    for _, text, lang, *_ in rows:
        if lang:
            for g, n in plain_grams(text).items():
                learned.setdefault(lang, {}).setdefault(g, 0)
                learned[lang][g] += n
    profile = {k: plain_ranks(c, langid.SIZE) for k, c in learned.items()}
    out = []
    for r in rows:
        own = plain_ranks(plain_grams(r[1]), langid.SIZE)
        letters = any(map(str.isalpha, r[1] or ""))
        if own and letters:
            fit = 1 - min(sum(abs(p[g] - n) if g in p else langid.SIZE for g, n in own.items()) for p in profile.values()) / (len(own) * langid.SIZE)
            if fit >= corpus_pipeline.LEAST_FIT or len(r[1]) < corpus_pipeline.SHORT_TEXT:
                out.append(r)
    return out


def plain_passages(rows):
    """Runs of 51 words, or of 400 bytes, that start anywhere else too are cut."""
    spans, where, strings = [], {}, {}
    for k, r in enumerate(rows):
        data = r[1].encode()
        spans.append([(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)])
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in data[a:b]) for a, b in spans[-1]]
        for i in range(len(words) - 50):
            where.setdefault(tuple(words[i : i + 51]), []).append((k, i))
        for i in range(len(data) - 399):
            strings.setdefault(data[i : i + 400], []).append((k, i))
    cover = [set() for _ in rows]
    for v in where.values():
        if len(v) > 1:
            for k, i in v:
                cover[k].update(range(spans[k][i][0], spans[k][i + 50][1]))
    for v in strings.values():
        if len(v) > 1:
            for k, i in v:
                cover[k].update(range(i, i + 400))
    out = []
    for r, c in zip(rows, cover):
        kept = bytes(b for i, b in enumerate(r[1].encode()) if i not in c)
        if re.search(rb"[0-9A-Za-z\x80-\xff]", kept) or not c:
            out.append((r[0], kept.decode("utf-8", "ignore"), *r[2:]))
    return out


def test_run_plain(spark, tmp_path):
    """run() against every stage recomputed plainly: ties, repeated rows, copies, passages, clashing columns, a long text."""
    import numpy as np

    rng = np.random.default_rng(31)
    syllables = {"en": "the of and ing tion er th wh ly".split(), "fr": "le la eau ment é que oi aux ç".split()}
    word = lambda k: "".join(rng.choice(syllables[k], int(rng.integers(1, 4))))
    text = lambda k, n: " ".join(word(k) for _ in range(n)) + "."
    items = [text("en", 30), text("fr", 45)]
    passages = [text("en", 51), text("fr", 70), text("en", 50), text("en", 160)]
    texts = [(text(k, int(rng.integers(1, 160))), k) for k in ("en", "fr") for _ in range(25)]
    texts += [(f"{text('en', 60)} {p} {text('en', 40)}", "en") for p in passages for _ in range(2)] + [(passages[3], None)]
    for x, k in texts[10:16]:
        w = x.split()
        for _ in range(3):
            w[int(rng.integers(len(w)))] = "changed"
            texts.append((" ".join(w), k))
    edited = items[0].split()
    edited[4], edited[17] = "x", "y"
    texts += [(f"{text('en', 30)} {items[0]}", "en"), (" ".join(edited).upper(), None), (f"{items[1]} {text('fr', 20)}", "fr"), (text("fr", 3000), "fr")]
    texts += [(None, "en"), ("", None), ("12 34 !!", None), ("Hi", None), ("ツ", None), ("Это русский текст о погоде и о людях которые там живут", None), texts[3], texts[3]]
    rows = [(i * 3, x, k, "s", len(x or "")) for i, (x, k) in enumerate(texts)]
    again = [*rows, rows[5], rows[60]]
    d = str(tmp_path)
    spark.createDataFrame([(*r, "clash", 7) for r in again], SCHEMA + ", keep_id string, bad_id int").repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(0, items[1]), (5, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    left = plain_language(again)
    least = brute_components([(r[0], r[1]) for r in left], 5, Fraction(4, 5))
    filled = lambda r: (len(re.sub(r"[ \x09-\x0D]+", "", r[1] or "")), r[1] or "")
    left = [max((x for x in left if x[0] == r[0]), key=filled) for r in left if least[r[0]][1] == r[0]]
    left = list(dict.fromkeys(left))  # one row an id
    left = plain_passages(left)
    score = lambda a, b: smith_waterman(a, b) / (2 * len(a))
    words = lambda x: re.findall(r"[0-9a-z\x80-\U0010ffff]+", x.lower())
    left = [r for r in left if all(score(words(i), words(r[1])) < 0.5 for i in items)]
    want = {}
    for r, ids in zip(left, plain("byte_bpe_50k.json", [r[1] for r in left], 0)):
        want.setdefault(r[0], []).append(ids)

    got = {}
    for r in corpus_pipeline.run(spark, d).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["sequence_id"], r["ids"]))
    assert set(got) == set(want)
    for k, pieces in got.items():
        assert [x for _, _, ids in sorted(pieces) for x in ids] == want[k][0]
    assert len(rows) - len(left) > 20 and len(left) > 30


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_guard():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"^\s*(try|except)\b", source, re.M)
