"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the language.

1. ``sketch`` counts documents by (language, term) in a count-min sketch: each task fills one of its own, ranges of cells are merged by
   addition. A cell stops at ``least``, so what is kept of it is one bit. Collisions only add, so a term whose cells do not all reach
   ``least`` is in fewer documents.
2. ``counted`` reads the texts again, leaves such terms out before anything is shuffled, and counts the survivors exactly by
   (language, source, term): first in each chunk, then in each task, then over all.
3. ``audit`` keeps the terms that ``least`` documents of the language really have and joins sparse counts. A term that neither source of
   a pair has adds the same constant, so only terms that a source has are joined; sums over one source's terms come from a
   histogram of its shares.

A source or a term with a third of all rows is one partial sum a task. The sketch is ``DEPTH * WIDTH`` bits, whatever the corpus: with far more
distinct terms than cells it leaves fewer of them out, and results stay the same. Terms are told apart by 64-bit hashes within a chunk,
and by their text beyond. Shares are whole numbers, computed by long division without overflow.

Rows: null text, language and source read as ''. Every row is a document, rows that repeat an id or have none included. Very long texts
are read whole. Ties in value are ordered by the item's UTF-8 bytes. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm import kernels as K
from deskmill.llm.store import cut

WIDTH, DEPTH, RANGES = 1 << 22, 3, 256  # WIDTH a power of two, and a multiple of 8 * RANGES
CHUNK = 4 << 20
SCALE_STEPS = (1000, 1000, 1000)  # shares are parts of 10**9
RESULT = "lang string, source string, part string, item string, value long, rank int"
#: Bytes outside terms: ASCII but its letters.
STOP = np.zeros(256, bool)
STOP[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_SALT = np.random.default_rng(5).integers(1, 2**63, DEPTH, dtype=np.uint64)


def _hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")


def _cells(h: np.ndarray, depth: int, cells: int) -> np.ndarray:
    return (K.mix(h + _SALT[depth]) & np.uint64(cells - 1)).astype(np.int64)


class Terms:
    """The terms of a chunk of texts: bytes with A-Z lower-cased, and each occurrence's start, end, row and hash with its language."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, of: np.ndarray) -> None:
        self.data = K.LOWER[data]
        self.start, self.end, self.row = K.words(self.data, offs, STOP)
        self.hash = K.mix(K.span_hash(K.prefix(self.data), self.start, self.end) + of[self.row])

    def keep(self, which: np.ndarray) -> None:
        self.start, self.end, self.row, self.hash = self.start[which], self.end[which], self.row[which], self.hash[which]

    def text(self, at: np.ndarray) -> pa.Array:
        size = self.end[at] - self.start[at]
        edges = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(self.data[K.expand(self.start[at], size)]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Terms, np.ndarray, list[str], list[str]]]:
    """Terms, the group of each row, and the language and source of each group, of (lang, source, text) batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = [pc.dictionary_encode(batch.column(c)) for c in ("lang", "source")]
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in coded)
        names, sources = (x.dictionary.to_pylist() for x in coded)
        kinds, group = np.unique(lang * len(sources) + source, return_inverse=True)
        of = np.array([_hash(x) for x in names], np.uint64)[lang]
        data, offs = K.utf8(batch.column("text"))
        for lo, hi, d, o in K.chunks(data, offs, CHUNK):
            yield Terms(d, o, of[lo:hi]), group[lo:hi], [names[k // len(sources)] for k in kinds], [sources[k % len(sources)] for k in kinds]
    K.release()


def documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def sketch(docs: DataFrame, least: int, cells: int = WIDTH) -> np.ndarray:
    """By depth and cell, whether ``least`` documents or more of a language have terms of the cell."""
    step = DEPTH * cells // RANGES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DEPTH * cells, np.uint16)
        for terms, *_ in _chunks(batches):
            order = np.lexsort((terms.hash, terms.row))
            h, row = terms.hash[order], terms.row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            kinds, times = np.unique(h[new], return_counts=True)
            for k in range(DEPTH):
                cell = _cells(kinds, k, cells) + k * cells
                order = np.argsort(cell)
                cell = cell[order]
                head = np.flatnonzero(np.diff(cell, prepend=-1))
                more = np.add.reduceat(times[order], head) if len(head) else head
                total[cell[head]] = np.minimum(total[cell[head]] + more, least)
        yield _ranges(total)

    def _ranges(total: np.ndarray) -> pa.RecordBatch:
        used = [k for k in range(RANGES) if total[k * step : (k + 1) * step].any()]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(total[k * step : (k + 1) * step].tobytes(), 1) for k in used], pa.binary())], ["range", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # at most RANGES of step cells
        for batch in batches:
            for k, x in zip(batch.column("range").to_pylist(), batch.column("cells")):
                part = np.frombuffer(zlib.decompress(x.as_buffer()), np.uint16)
                held[k] = np.minimum(held[k] + part, least).astype(np.uint16) if k in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x >= least).tobytes() for x in held.values()], pa.binary())], ["range", "bits"])

    out = np.zeros(DEPTH * cells, bool)
    merged = docs.mapInArrow(fill, "range int, cells binary").repartition("range").mapInArrow(merge, "range int, bits binary")
    for r in merged.collect():  # DEPTH * WIDTH bits
        out[r["range"] * step : (r["range"] + 1) * step] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:step]
    return out.reshape(DEPTH, cells)


def counted(docs: DataFrame, possible: np.ndarray) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents) of terms that the sketch does not exclude."""
    packed = np.packbits(possible, axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed, axis=1).view(bool)
        for terms, group, langs, sources in _chunks(batches):
            keep = np.ones(len(terms.hash), bool)
            for k in range(DEPTH):
                keep[keep] = bits[k][_cells(terms.hash[keep], k, bits.shape[1])]
            terms.keep(keep)
            if not len(terms.hash):
                continue
            g = group[terms.row]
            order = np.lexsort((terms.hash, g))  # stable, so rows ascend within a term
            h, g, row = terms.hash[order], g[order], terms.row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            head = np.flatnonzero(new)
            again = np.ones(len(h), np.int64)
            again[1:] = new[1:] | (row[1:] != row[:-1])
            n = np.diff(np.append(head, len(h)))
            own = pa.array(g[head].astype(np.int32))
            named = [pa.DictionaryArray.from_arrays(own, pa.array(x, pa.string())).cast(pa.string()) for x in (langs, sources)]
            yield pa.RecordBatch.from_arrays([*named, terms.text(order[head]), pa.array(n), pa.array(np.add.reduceat(again, head))], ["lang", "source", "term", "n", "df"])

    rows = docs.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), by long division."""
    left, whole = count + F.lit(5).cast("long"), total + F.lit(5).cast("long") * terms
    out = F.lit(0).cast("long")
    for step in SCALE_STEPS:
        out, left = out * step + F.call_function("div", left * step, whole), (left * step) % whole
    return out + 1


def audit(docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cells: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank: the distance to every other source of the language (``pair``), and the ``top`` terms that a
    source has more of than its language (``term``)."""
    if not 0 < least < 1 << 15:
        raise ValueError("least must be positive and below 32,768")
    own = documents(docs, text_col, lang_col, source_col)
    counts = counted(own, sketch(own, least, cells))
    each = Window.partitionBy("lang", "term")  # a row per source
    counts = cut(counts.select("lang", "source", "term", "n", F.sum("n").over(each).alias("all"), F.sum("df").over(each).alias("df")).filter(F.col("df") >= least).drop("df"), "term-counts")
    langs = counts.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.select("lang", "source", *(zero(c) for c in ("total", "own", "terms", "lang_total")))
    none = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.nullif(F.col("terms"), F.lit(0)))).otherwise(0)
    groups = cut(groups.withColumn("none", none), "source-groups")

    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "none", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q"))
    shares = cut(shares, "term-shares")
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = above.withColumn("rank", rank).filter(F.col("rank") <= top)

    def side(df: DataFrame, s: str, keys: list[str], *cs: str) -> DataFrame:
        return df.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in cs))

    known = ("source", "none", "own")
    pairs = side(groups, "a", ["lang"], *known, "terms").join(side(groups, "b", ["lang"], *known), "lang").filter("source_a <> source_b")  # a result row each
    kinds = shares.groupBy("lang", F.col("source").alias("source_a"), "p").agg(F.count("*").alias("m"))
    alone = kinds.join(side(groups, "b", ["lang"], "source", "none"), "lang").filter("source_a <> source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("none_b"))).alias("alone"))
    own_terms = ("source", "none", "p")
    both = side(shares, "a", ["lang", "term"], *own_terms).join(side(shares, "b", ["lang", "term"], *own_terms), ["lang", "term"]).filter("source_a < source_b")
    less = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("none_b")) - F.abs(F.col("p_b") - F.col("none_a"))
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(less).alias("less"), F.count("*").alias("shared"))
    turned = lambda df, *cs: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), *cs)
    both = both.unionByName(turned(both, "less", "shared"))
    key = ["lang", "source_a", "source_b"]
    nil = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    apart = F.col("terms_a") - F.col("own_a") - F.col("own_b") + nil("shared")
    value = nil("alone") + nil("alone_back") + nil("less") + F.abs(F.col("none_a") - F.col("none_b")) * apart
    far = pairs.join(alone, key, "left").join(turned(alone, F.col("alone").alias("alone_back")), key, "left").join(both, key, "left")
    far = far.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value")).withColumn("rank", rank)
    return far.unionByName(above).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
