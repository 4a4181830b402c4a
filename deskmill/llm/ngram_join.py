"""N-gram Jaccard join by vertical partitioning.

All word n-grams have one global order, rarest first (document frequency, then hash). A document's set is cut along
that order into fragments; the overlap of two documents is counted fragment by fragment and summed per pair.

1. ``shingle_sets`` gives each document its set size and a digest of its set. Equal sets are one class.
2. ``frequent`` deals compact blocks of (48-bit n-gram hash, document) by hash range, finds document frequencies and
   sends n-grams of two or more documents back to them. An n-gram of one document cannot overlap, so a document
   whose shared n-grams are fewer than ``t`` of its set has no partner and leaves here: most documents do.
   N-grams of very many documents (``hot_ngrams``) are known before: their entries go straight to their documents,
   so no task gathers the documents of one n-gram. Beyond ``Sizes.wide`` ranges, dealing takes two steps.
3. Candidates share an n-gram among the rarest ``n - ceil(t n) + 1`` of both sets (prefix filter). To find groups without
   all their pairs, each n-gram first offers only the pairs with its most common member of like size (the hub);
   then, exactly, every pair of members that no chain of verified links joins yet.
4. ``overlaps`` joins candidates with the fragments of both sides and sums partial overlaps per pair.

N-grams are 48-bit hashes beside 16 bits of frequency. Within one pair of sets of a and b n-grams two different ones are taken for equal
with a chance of a * b / 2**48 (under 4e-9 for texts of a thousand words), whatever the size of the corpus; a false partner elsewhere only
makes a candidate, which the pair's own count rejects.

Rows: null or wordless texts have the empty set, which links to nothing. Rows without id are left out. Rows that repeat an id are one
document: each of its texts has its links, the fullest one (most characters beside white space) gives the set size. Very long texts are read
whole; ties in order have no influence on which pairs link. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm import kernels as K
from deskmill.llm.graph import components
from deskmill.llm.store import cut, drop, partitions



class Sizes(NamedTuple):
    """Sizes of blocks and groups. They change how the work is divided, never its result."""

    flush: int = 3_000_000  # shingles in a block; 48 MB
    part: int = 2_000_000  # shingles of a hash range; ranges grow in number with the corpus, not in size
    wide: int = 4096  # ranges dealt in one step
    reducers: int = 32_768  # shuffle partitions at most; each takes its ranges one after another
    hot: int = 1 << 20  # documents from which on an n-gram is hot
    share: int = 19  # at most 2**share n-grams are hot, whatever the corpus


SIZES = Sizes()
SETS = "doc_id long, n_shingles long, d1 long, d2 long, gram long"
BLOCKS = "part long, ids binary, local binary, gaps binary, n long"
OCTAVE, SMALL = 512, 12  # frequencies to 2**SMALL order n-grams as they are, others by OCTAVE steps for each doubling


def _frequency_code(df: np.ndarray) -> np.ndarray:
    """Document frequency as 16 bits that never fall as it grows, up to 2**115; n-grams of one code are ordered by hash."""
    return np.where(df <= 1 << SMALL, df, (1 << SMALL) + OCTAVE * (np.log2(np.maximum(df, 1)) - SMALL)).astype(np.uint64)


def shingle_sets(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """doc_id, n_shingles, and a 128-bit digest of the set (d1, d2); gram is null. Rows without doc_id are counts instead: gram is in
    n_shingles rows of block d2 of partition d1, more than 2**-share of the block."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        task, block, size = TaskContext.get().partitionId(), 0, 0

        def common() -> pa.RecordBatch:
            h, df = np.unique(np.concatenate(held), return_counts=True)
            often = df >= max(2, size >> sizes.share)
            h, df = h[often].view(np.int64), df[often]
            held.clear()
            same = lambda x: pa.array(np.full(len(h), x))
            return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(df), same(task), same(block), pa.array(h)], ["doc_id", "n_shingles", "d1", "d2", "gram"])

        for ids, data, offs in K.documents(batches):
            row, h = K.shingles(data, offs, n)
            count = np.bincount(row, minlength=len(ids))
            sums = []
            for salt in (0x1234567 << 36, 0x1BCDE4 << 41):
                c = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(K.mix(h + np.uint64(salt)), out=c[1:])
                edges = np.concatenate(([0], np.cumsum(count)))
                sums.append(pa.array((c[edges[1:]] - c[edges[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count.astype(np.int64)), *sums, pa.nulls(len(ids), pa.int64())], ["doc_id", "n_shingles", "d1", "d2", "gram"])
            held.append(h)
            size += len(h)
            if size >= sizes.flush:
                yield common()
                block, size = block + 1, 0
        if held:
            yield common()

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sets, SETS)


def hot_ngrams(seen: DataFrame, total: int, sizes: Sizes = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (ascending) of at least max(hot, total / 2**share) documents by the counts in ``seen``, and these counts. They add up to no more
    than total unless rows are repeated; the limit of 2**share keeps the bound there too, and what it leaves out is counted like any
    other. A block leaves out what is rarer than 2**-share of it, so every n-gram of max(hot, total / 2**share) + total / 2**share
    documents is here."""
    often = seen.filter("gram is not null").groupBy("gram").agg(F.sum("n_shingles").alias("df")).filter(F.col("df") >= max(sizes.hot, total >> sizes.share))
    rows = sorted((r["gram"], r["df"]) for r in often.orderBy(F.desc("df"), "gram").limit(1 << sizes.share).collect())
    return np.array([g for g, _ in rows], np.uint64), np.array([c for _, c in rows], np.int64)


def apart(docs: DataFrame, sets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame] | None:
    """Where ids have several texts (different sets): (doc_id, text) with ids of their own, above all others, for every text but the
    fullest of an id; and (u, v) from each new id to the old one. None where every id has one set, as it should."""
    odd = cut(sets.distinct().groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("odd_id")), "odd-ids")
    if odd.isEmpty():
        return None
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    is_odd = F.col("doc_id") == F.col("odd_id")
    texts = rows.join(odd, is_odd, "left_semi").distinct()
    filled = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \x09-\x0D]+", ""))
    first = texts.groupBy("doc_id").agg(F.max(F.struct(filled.alias("n"), "text")).alias("m")).select("doc_id", F.col("m.text").alias("text"))
    more = texts.join(first.select(F.col("doc_id").alias("l_id"), F.col("text").alias("l_text")), (F.col("doc_id") == F.col("l_id")) & (F.col("text") == F.col("l_text")), "left_anti")
    top = rows.agg(F.max("doc_id")).first()[0]
    named = cut(more.select((F.lit(top + 1) + F.monotonically_increasing_id()).alias("new_id"), "doc_id", "text"), "texts-apart")
    every = rows.join(odd, is_odd, "left_anti").unionByName(first).unionByName(named.select(F.col("new_id").alias("doc_id"), "text"))
    return every, named.select(F.col("new_id").alias("u"), F.col("doc_id").alias("v"))


def _deal(h: np.ndarray, d: np.ndarray, width: int) -> Iterator[tuple]:
    """Rows of BLOCKS, one a range of ``width`` hashes, from entries sorted by n-gram."""
    p = h // np.uint64(width)
    at = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(h)]))
    for a, b in zip(at, at[1:]):
        gaps = np.diff(h[a:b], prepend=p[a] * np.uint64(width))
        used, local = np.unique(d[a:b], return_inverse=True)
        yield int(p[a]), zlib.compress(np.diff(used, prepend=0).tobytes(), 1), local.astype(np.uint16 if len(used) <= 65536 else np.uint32).tobytes(), gaps.astype(np.uint32 if gaps.max() < 2**32 else np.uint64).tobytes(), int(b - a)


def _entries(rows: Iterable[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram and document of every entry of rows that ``_deal`` made."""
    hs, ds = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for r in rows:
        m = r["n"]
        ids = np.cumsum(np.frombuffer(zlib.decompress(r["ids"]), np.int64))
        ds.append(ids[np.frombuffer(r["local"], np.uint16 if len(r["local"]) == 2 * m else np.uint32)])
        hs.append(np.cumsum(np.frombuffer(r["gaps"], np.uint32 if len(r["gaps"]) == 4 * m else np.uint64), dtype=np.uint64) + np.uint64(r["part"] * width))
    return np.concatenate(hs), np.concatenate(ds)


def _send(d: np.ndarray, g: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows (q, d, g), one a bucket of documents, documents and n-grams ascending."""
    q = np.mod(d, buckets)
    order = np.lexsort((g, d, q))
    d, g, q = d[order], g[order], q[order]
    at = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1, [len(q)])) if len(q) else [0]
    for a, b in zip(at, at[1:]):
        yield int(q[a]), np.diff(d[a:b], prepend=0).tobytes(), g[a:b].tobytes()


def _sent(rows: Iterable[dict]) -> tuple[np.ndarray, np.ndarray]:
    d, g = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in rows:
        d.append(np.cumsum(np.frombuffer(r["d"], np.int64)))
        g.append(np.frombuffer(r["g"], np.int64))
    return np.concatenate(d), np.concatenate(g)


def _batch(rows: Iterable[tuple], names: str) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


class Ranges(NamedTuple):
    """Hash ranges: ``outer`` in the first step, each of ``inner`` in the second."""

    outer: int
    inner: int

    @staticmethod
    def of(total: int, least: int, sizes: Sizes = SIZES) -> Ranges:
        parts = max(least, -(-total // sizes.part))
        return Ranges(parts, 1) if parts <= sizes.wide else Ranges(sizes.wide, -(-parts // sizes.wide))

    @property
    def parts(self) -> int:
        return self.outer * self.inner

    @property
    def step(self) -> int:
        return -(-(1 << 48) // self.parts)


def dealt(docs: DataFrame, n: int, ranges: Ranges, hot: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """BLOCKS: the entries (n-gram, document) of every text, a row's by hash range. Entries of hot n-grams have parts of their own, -1 and
    down by document (ids: documents, local: n-grams with their frequency), so a range holds none."""
    parts, outer, inner, step = ranges.parts, ranges.outer, ranges.inner, ranges.step
    grams, often = hot[0], _frequency_code(hot[1]) << np.uint64(48)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            d, h = (np.concatenate(x) for x in zip(*held))
            held.clear()
            straight = []
            if len(grams):
                at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
                known = grams[at] == h
                g = (often[at[known]] | h[known]).view(np.int64)
                straight = [(-1 - q, ids, toks, b"", len(toks) // 8) for q, ids, toks in _send(d[known], g, parts)]
                d, h = d[~known], h[~known]
            order = np.argsort(h)
            return _batch([*straight, *(_deal(h[order], d[order], step * inner) if len(h) else ())], BLOCKS)

        size = 0
        for ids, data, offs in K.documents(batches):
            row, h = K.shingles(data, offs, n)
            if len(h):
                held.append((ids[row], h))
                size += len(h)
            if size >= sizes.flush:
                yield flush()
                size = 0
        if held:
            yield flush()
        K.release()

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            h, d = _entries(held, step * inner)
            held.clear()
            order = np.argsort(h)
            return _batch(_deal(h[order], d[order], step), BLOCKS)

        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] < 0:
                    yield _batch([tuple(r.values())], BLOCKS)
                    continue
                held.append(r)
                size += r["n"]
                if size >= sizes.flush:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(blocks, BLOCKS)
    return out if inner == 1 else out.repartition(outer, "part").mapInArrow(finer, BLOCKS)


def frequent(docs: DataFrame, classes: DataFrame, n: int, t: Fraction, id_col: str = "doc_id", text_col: str = "text", total: int = 0, hot: tuple[np.ndarray, np.ndarray] | None = None, sizes: Sizes = SIZES) -> DataFrame:
    """rep, n, toks: for each class of ``classes`` (rep, n) that may have a partner, its shared n-grams in global order. ``total``: n-grams of
    all documents, from which the number of ranges follows. ``hot``: what ``hot_ngrams`` found."""
    ranges = Ranges.of(total, 2 * partitions(docs.sparkSession), sizes)
    parts, outer, step = ranges.parts, ranges.outer, ranges.step
    num, den = t.numerator, t.denominator
    sent = "q long, d binary, g binary"

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["part"] < 0:  # frequencies are known
            d, g = _sent({"d": r["ids"], "g": r["local"]} for r in rows)
            return pa.Table.from_batches([_batch(_send(d, g, outer), sent)])
        h, d = _entries(rows, step)
        order = np.argsort(h)
        h, d = h[order], d[order]
        again = np.zeros(len(h), bool)  # only n-grams seen twice need the second key
        again[1:] = h[1:] == h[:-1]
        again[:-1] |= again[1:]
        h, d = h[again], d[again]
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        _, inverse, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[inverse]
        keep = df >= 2
        g = ((_frequency_code(df[keep]) << np.uint64(48)) | h[keep]).view(np.int64)
        return pa.Table.from_batches([_batch(_send(d[keep], g, outer), sent)])

    def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                size += len(r["g"]) // 8
                if size >= sizes.flush:
                    yield _batch(_send(*_sent(held), parts), sent)
                    held, size = [], 0
        if held:
            yield _batch(_send(*_sent(held), parts), sent)

    def collect(key: tuple, shared: pa.Table, info: pa.Table) -> pa.Table:
        reps, size = info["rep"].to_numpy(), info["n"].to_numpy()
        order = np.argsort(reps)
        reps, size = reps[order], size[order]
        d, g = _sent(shared.to_pylist())
        at = np.searchsorted(reps, d)
        ok = at < len(reps)
        ok[ok] = reps[at[ok]] == d[ok]
        at, g = at[ok], g[ok]
        order = np.lexsort((g, at))
        at, g = at[order], g[order]
        new = np.ones(len(at), bool)  # repeated rows of a document bring a hot n-gram again
        new[1:] = (at[1:] != at[:-1]) | (g[1:] != g[:-1])
        at, g = at[new], g[new]
        c = np.bincount(at, minlength=len(reps))
        live = den * c >= num * size
        g = g[live[at]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(c[live]))).astype(np.int32)), pa.array(g))
        return pa.table({"rep": pa.array(reps[live]), "n": pa.array(size[live]), "toks": lists})

    reducers = min(parts, sizes.reducers)
    blocks = dealt(docs, n, ranges, hot or (np.empty(0, np.uint64), np.empty(0, np.int64)), id_col, text_col, sizes)
    shared = blocks.repartition(reducers, "part").groupBy("part").applyInArrow(count, sent)
    if ranges.inner > 1:
        shared = shared.repartition(outer, "q").mapInArrow(nearer, sent)
    info = classes.filter("n > 0").select("rep", "n", F.pmod("rep", F.lit(parts)).cast("long").alias("q"))
    return shared.repartition(reducers, "q").groupBy("q").cogroup(info.repartition(reducers, "q").groupBy("q")).applyInArrow(collect, "rep long, n long, toks array<long>")


def overlaps(pairs: DataFrame, fragments: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (x, y) with Jaccard similarity of t or more: partial overlaps by fragment, summed."""
    side = lambda a: fragments.select(F.col("rep").alias(a), F.col("n").alias(f"n{a}"), "frag", F.col("part").alias(f"p{a}"))
    both = pairs.join(side("x"), "x").join(side("y"), ["y", "frag"])
    total = both.groupBy("x", "y").agg(F.sum(F.size(F.array_intersect("px", "py"))).alias("o"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    return total.filter(t.denominator * F.col("o") >= t.numerator * (F.col("nx") + F.col("ny") - F.col("o"))).select("x", "y")


def fragment(sets: DataFrame, count: int = 8) -> DataFrame:
    """rep, n, frag, part: each set cut at ``count - 1`` pivots of the global order."""
    pivots = sets.select(F.explode("toks").alias("g")).agg(F.percentile_approx("g", [i / count for i in range(1, count)], 1000).alias("p")).first()["p"] or []
    edges = [None, *sorted(set(pivots)), None]
    between = lambda a, b: F.filter("toks", lambda g: (F.lit(True) if a is None else g >= a) & (F.lit(True) if b is None else g < b))
    cuts = F.array(*(F.struct(F.lit(i).alias("frag"), between(a, b).alias("part")) for i, (a, b) in enumerate(zip(edges, edges[1:]))))
    return sets.select("rep", "n", F.inline(cuts)).filter(F.size("part") > 0)


def links(sets: DataFrame, t: Fraction) -> DataFrame:
    """Links (x, y) between classes that give the same components as all links."""
    num, den = t.numerator, t.denominator
    fragments = cut(fragment(sets), "fragments")
    c = F.size("toks")
    head = (F.col("n") - F.ceil(F.lit(num) * F.col("n") / den) + 1 - (F.col("n") - c)).cast("int")
    # how common a set's n-grams are: the text that a group's copies were made from leads it
    common = (F.aggregate("toks", F.lit(0).cast("long"), lambda a, g: a + F.shiftright(g, 48)) + F.col("n") - c) / F.col("n")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")  # linked sizes are in the same or the next band
    entry = sets.select("rep", "n", c.alias("c"), common.alias("common"), band.alias("band"), F.slice("toks", 1, F.greatest(head, F.lit(0))).alias("head")).filter(F.size("head") > 0)
    entry = entry.select("rep", "n", "c", "common", "band", F.posexplode("head").alias("at", "g"))  # after the sums over whole sets, not once a row
    entry = cut(entry.select("rep", "n", "common", "band", "g", (F.col("n") - F.col("c") + F.col("at")).alias("at")), "prefixes")
    # sizes, and what both sets still hold from this n-gram on: if it is the first they share, no more can be shared
    near = (num * F.greatest("n", "hn") <= den * F.least("n", "hn")) & ((num + den) * F.least(F.col("n") - F.col("at"), F.col("hn") - F.col("hat")) >= num * (F.col("n") + F.col("hn")))
    hub = entry.groupBy("g", "band").agg(F.max(F.struct("common", (-F.col("rep")).alias("minus"), "rep", "n", "at")).alias("h"))
    hub = hub.select("g", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("h.rep").alias("hub"), F.col("h.n").alias("hn"), F.col("h.at").alias("hat"))
    pair = lambda a, b: (F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    first = cut(entry.join(hub, ["g", "band"]).filter((F.col("rep") != F.col("hub")) & near).select(*pair("rep", "hub")).distinct(), "hub-pairs")
    found = cut(overlaps(first, fragments, t), "hub-links")
    group = components(found.select(F.col("x").alias("u"), F.col("y").alias("v")))
    member = entry.join(group, entry["rep"] == group["id"], "left").select("rep", "n", "at", "g", F.coalesce("component", "rep").alias("k"))
    member = cut(member, "members")
    mixed = member.groupBy("g").agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a < b").select("g")
    left = member.join(mixed, "g", "left_semi")
    right = left.select("g", F.col("rep").alias("r"), F.col("n").alias("hn"), F.col("at").alias("hat"), F.col("k").alias("hk"))
    rest = left.join(right, "g").filter((F.col("k") < F.col("hk")) & near).select(*pair("rep", "r")).distinct()
    rest = rest.join(first, ["x", "y"], "left_anti")
    out = cut(found.unionAll(overlaps(rest, fragments, t)), "links")
    drop(fragments, entry, first, found, member)
    return out


def jaccard_components(docs: DataFrame, n: int = 5, t: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links of similarity t or more), class_id (least id of an equal set)."""
    seen = cut(shingle_sets(docs, n, id_col, text_col, sizes).distinct(), "sets")
    info = seen.filter("gram is null").drop("gram")
    known = apart(docs, info, id_col, text_col)
    if known is not None:
        docs, same_id = known
        id_col, text_col = "doc_id", "text"
        seen = cut(shingle_sets(docs, n, sizes=sizes).distinct(), "sets")
        info = seen.filter("gram is null").drop("gram")
    classes = cut(info.filter("n_shingles > 0").groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep")), "classes")
    total = info.agg(F.sum("n_shingles")).first()[0] or 0
    sets = cut(frequent(docs, classes, n, t, id_col, text_col, total, hot_ngrams(seen, total, sizes), sizes), "shared")
    edges = links(sets, t)
    drop(sets)
    pairs = edges.select(F.col("x").alias("u"), F.col("y").alias("v"))
    if known is not None:  # texts of one id are linked through it
        of = info.join(classes, (info["d1"] == classes["d1"]) & (info["d2"] == classes["d2"]) & (info["n_shingles"] == classes["n"])).select(F.col("doc_id").alias("of_id"), "rep")
        rep = lambda c: same_id.join(of.select(F.col("of_id").alias(c), F.col("rep").alias(f"rep_{c}")), c)
        pairs = pairs.unionByName(rep("u").join(rep("v"), ["u", "v"]).select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")))
    group = components(pairs)
    drop(edges)
    named = classes.join(group, classes["rep"] == group["id"], "left").select("d1", "d2", "n", "rep", F.coalesce("component", "rep").alias("component"))
    same = (info["d1"] == named["d1"]) & (info["d2"] == named["d2"]) & (info["n_shingles"] == named["n"])
    out = info.join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))
    if known is None:
        return out
    new = same_id.select(F.col("u").alias("new_id"))  # above every old id and linked with one, so never a component's least
    return out.join(new, out["doc_id"] == new["new_id"], "left_anti")
