"""Memoised ids, packing and Huffman files against plain encoding."""

import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskmill.llm import huffman, packing
from deskmill.llm import kernels as K
from deskmill.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "\n\n", "Hello  world.\n\nIt's  the end!  ", "a b c", "tab\tand\rfeed\x0b\x0c end", "x " * 4000, "word " * 30, "z" * 5000, "naïve ÀÉ été 12345 don't <|endoftext|> ok", "　wide  space  x", "é" * 700 + ".", "日本語 の テキスト。 \x1c odd", "\U0001f600 \U0001f600\U0001f600  mixed \U0001f468‍\U0001f469", "one two three. " * 200, "İstanbul ΑΣ ς ﬁ", "  lead", "trail \n"]


def plain(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def chunked(name, texts):
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(x.encode()) for x in texts)])
    ids, size, row, _ = Encoder.of(P.path(name)).units(np.frombuffer(data, np.uint8), offs)
    count = np.bincount(row, size, len(texts)).astype(int)
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units(name):
    texts = [x or "" for x in TEXTS]
    want = [x[:-1] for x in plain(name, texts, 0)]
    assert chunked(name, texts) == want
    assert chunked(name, texts) == want  # from the memo


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list("aBé'1.,!? \n\t\x1c\xa0　́日🙂Σ")), max_size=40), min_size=1, max_size=6))
def test_units_any(name, texts):
    assert chunked(name, texts) == [x[:-1] for x in plain(name, texts, 0)]


def frame(spark, texts):
    return spark.createDataFrame([(i, x, None, "s", 1) for i, x in enumerate(texts)] + [(None, "lost", None, None, None)], SCHEMA).withColumnRenamed("source", "offset")


def test_packing(spark):
    rng = np.random.default_rng(1)
    texts = TEXTS + [" ".join(f"w{x}{'.' if x % 9 == 0 else ''}" for x in rng.integers(0, 500, n)) for n in rng.integers(1, 900, 60)]
    want = plain("byte_bpe_50k.json", texts, 0)
    got = packing.pack(frame(spark, texts).repartition(2), P.path("byte_bpe_50k.json"), with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        assert [x for r in pieces for x in r["ids"]] == want[d]
        assert all(r["doc_tokens"] == len(want[d]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in pieces)
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        n = sum(r["length"] for r in pieces)
        assert n <= 1024 and pieces[0]["padding"] == (0 if n & (n - 1) == 0 else 1024 - n)
        padding += pieces[0]["padding"]
    assert padding < 0.03 * sum(map(len, want))


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=40, deadline=None)
@given(gaps=st.lists(st.tuples(st.integers(1, 12), st.integers(0, 9)), min_size=1, max_size=14))
def test_best_cuts(gaps):
    place = np.cumsum([0, *(g for g, _ in gaps)]).tolist()
    penalty = [0, *(p for _, p in gaps)]
    size, powers = 16, (1, 2, 4, 8)

    def cost(n):
        return min([size - n, *[packing.SHORT] * (n in powers)])

    best = [0] + [10**9] * (len(place) - 1)
    for j in range(1, len(place)):
        for i in range(j):
            if place[j] - place[i] <= size:
                best[j] = min(best[j], best[i] + cost(place[j] - place[i]) + penalty[j])
    cuts, total = packing.best_cuts(place, penalty, size)
    assert total == best[-1]
    assert all(0 < b - a <= size for a, b in zip(cuts, cuts[1:]))
    assert sum(cost(b - a) + penalty[place.index(b)] for a, b in zip(cuts, cuts[1:])) == total


def brute_cost(place, penalty, size, powers):
    best = [0.0] * len(place)
    for j in range(1, len(place)):
        ways = []
        for i in range(j - 1, -1, -1):
            n = place[j] - place[i]
            if n > size:
                break
            ways.append(best[i] + (min(packing.SHORT, size - n) if n in powers else size - n))
        best[j] = min(ways) + penalty[j]
    return best[-1]


def test_best_cuts_full_size():
    """The real size with every power of two, on places a few ids apart."""
    rng = np.random.default_rng(12)
    for _ in range(6):
        place = [0, *np.cumsum(rng.integers(1, 40, 900)).tolist()]
        penalty = [0, *rng.choice([0, packing.SENTENCE, packing.WORD], 900).tolist()]
        assert packing.best_cuts(place, penalty, 1024)[1] == brute_cost(place, penalty, 1024, {1 << k for k in range(10)})


def test_cuts_in_parts():
    """Decided cuts are those of the whole stream, however it is fed."""
    rng = np.random.default_rng(13)
    place = np.cumsum(rng.integers(1, 30, 6000)).tolist()
    penalty = rng.choice([0, packing.SENTENCE, packing.WORD], 6000).tolist()
    want = packing.best_cuts([0, *place], [0, *penalty], 512)[0][1:]
    for step in (1, 7, 450):
        cuts, got = packing.Cuts(512), []
        for lo in range(0, 6000, step):
            cuts.feed(place[lo : lo + step], penalty[lo : lo + step])
            got += cuts.decided()
            assert len(cuts.place) < 6000 // 2
        assert got + cuts.rest() == want


def test_packing_chunks(spark):
    """Neither the size of chunks nor texts over a chunk change the result; a text of megabytes is packed whole."""
    rng = np.random.default_rng(14)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, n)) for n in (3, 40_000, 700, 1, 0, 200_000)] + ["q" * 300_000]
    df = frame(spark, texts).coalesce(1)
    got = [sorted(map(tuple, packing.pack(df, P.path("byte_bpe_50k.json"), chunk=c).collect())) for c in (1 << 12, 1 << 21)]
    assert got[0] == got[1]
    want = plain("byte_bpe_50k.json", texts, 0)
    total = {}
    for r in got[0]:
        total[r[0]] = total.get(r[0], 0) + r[2]
    assert total == {i: len(x) for i, x in enumerate(want)}


@settings(max_examples=60, deadline=None)
@given(counts=st.lists(st.integers(0, 10**6), min_size=1, max_size=40), limit=st.integers(6, 10))
def test_huffman_code(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and (used >= 1).all() and (used <= limit).all()
    assert (2.0**-used).sum() <= 1
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        best += x
        heapq.heappush(heap, x)
    cost = int((lengths * counts).sum())
    assert cost >= best
    if (huffman.code_lengths(counts, 20) <= limit).all() and best:
        assert cost == best


def test_huffman_bits():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.02, 20_000), 49_407).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=49_408))
    blocks = []
    for part in (ids[:7], ids[7:8], ids[:0], ids[8:]):
        bits, marks = huffman.encode(part, huffman.canonical(lengths), lengths)
        blocks.append((bits, marks, len(part)))
    got = huffman.decode(blocks, huffman.table(lengths))
    assert np.concatenate(got).tolist() == ids.tolist()
    lone = huffman.code_lengths(np.array([0, 5, 0]))
    assert huffman.decode([(*huffman.encode(np.array([1, 1], np.uint16), huffman.canonical(lone), lone), 2)], huffman.table(lone))[0].tolist() == [1, 1]


def test_huffman_files(spark, tmp_path):
    texts = [*TEXTS, " ".join(f"w{x}" for x in np.random.default_rng(3).integers(0, 20_000, 150_000))]  # the last is over one block and one chunk
    want = plain("word_bpe_49k.json", texts, 2)
    path = huffman.write_ids(frame(spark, texts).repartition(3), P.path("word_bpe_49k.json"), str(tmp_path / "ids"))
    got = {r["doc_id"]: r for r in huffman.digests(spark, path).collect()}
    ids = {r["doc_id"]: r["ids"] for r in huffman.read_ids(spark, path).collect()}
    start = 0
    for d, x in enumerate(want):
        assert ids[d] == x
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    starts = [r["start"] for r in spark.read.parquet(f"{path}/blocks").orderBy("start").collect()]
    assert len(starts) > 1 and starts == sorted(set(starts))


def test_huffman_new_session(spark, tmp_path):
    """A process of its own reads the files, with nothing but their path."""
    texts = ["one two three", None, "four é five"]
    path = huffman.write_ids(frame(spark, texts), P.path("word_bpe_49k.json"), str(tmp_path / "ids"))
    code = (
        "import sys; from pyspark.sql import SparkSession; from deskmill.llm import huffman\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.driver.host', '127.0.0.1').getOrCreate()\n"
        "print('IDS', sorted((r['doc_id'], r['ids']) for r in huffman.read_ids(spark, sys.argv[1]).collect()))"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code, path], cwd=root, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": root})
    line = next(x for x in done.stdout.splitlines() if x.startswith("IDS "))
    assert line == f"IDS {list(enumerate(plain('word_bpe_49k.json', texts, 2)))}"
    with pytest.raises(Exception, match="exist"):
        huffman.write_ids(frame(spark, texts), P.path("word_bpe_49k.json"), path)


def test_huffman_repeats(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (1, "b", "x"), (0, None, "x")], "doc_id long, text string, start string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in huffman.digests(spark, huffman.write_ids(df, P.path("word_bpe_49k.json"))).collect())
    assert got == [(0, 0, 1), (1, 1, 2), (3, 1, 2), (5, 1, 2)]


def test_huffman_empty(spark):
    path = huffman.write_ids(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json"))
    assert huffman.digests(spark, path).count() == 0
