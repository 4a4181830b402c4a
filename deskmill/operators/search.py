"""Retrieval: TF-IDF vectors, lexical, dense and hybrid top-k, saved indexes.

Both sides of a search are stored as packed ``Chunks`` of bounded size, and every chunk of the queries meets every chunk of the corpus in a
product of partitions (``cells``): nothing is shuffled and nothing passes the driver. A task holds one chunk of the queries and keeps its k best
rows for each; a window picks k of k x tasks rows.

Lexical search can also go through ``Blocks``: documents that are alike stand in one block, and an inverted list says how heavy each term can be
in each block that has it, so a block whose documents cannot enter a query's top k is never read for it.

There is no query x corpus table. A task looks terms up in its own rows, so a stop word that every document has makes no hot key.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskmill.functions.text import classifier_text
from deskmill.sources.store import cut, partitions

PART_CHARACTERS = 8_000_000  # of texts whose terms a task counts at a time
BLOCK_VALUES = 4_000_000  # numbers of a part of queries or corpus: vector entries and term weights
BLOCK_QUERIES = 8192  # rows of a part
FINER = 4  # parts of that size whose terms are counted by name are cut into so many, as names take more room than hashes
CELLS = 4_000_000  # of a task's matrix of common terms, and postings followed at a time
SCORES = 1_000_000  # of a task at a time
BLOCK_ROWS = 256  # documents of a block of the lexical index
LEADS = 1000  # groups of documents with one leading term that get blocks of their own
FIRST = 2  # blocks that are scored before any can be left out
SLICE = 2048  # queries that meet a block of documents at a time
COMMON = 8  # terms of so many queries of a block are multiplied as a matrix
TOKEN = r"[\p{L}\p{N}_]{2,}"
FILTERS = ("queue", "priority", "label")


def metadata_filter(df: DataFrame, wanted: dict[str, str] | None) -> DataFrame:
    for k, v in (wanted or {}).items():
        if k not in FILTERS:
            raise ValueError(f"no metadata filter on {k}")
        df = df.filter(F.col(k) == F.lit(v))
    return df


def check_top_k(k: int) -> int:
    if k <= 0:
        raise ValueError("top_k must be positive")
    return k


def check_weight(w: float) -> float:
    if not 0.0 <= w <= 1.0:
        raise ValueError("the weight must be from 0 to 1")
    return w


# ---- vectors ------------------------------------------------------------------------------------------------------


def terms(docs: DataFrame, text: str = "text", bigrams: bool = True, token: str = TOKEN) -> DataFrame:
    """doc_id, term, tf of words of two or more letters, digits or underscores, and of pairs of neighbours.

    Texts are dealt by doc_id before they are cut up, so counting terms moves texts once and their terms never. A task counts the terms of about a
    ``FINER``-th of ``PART_CHARACTERS`` at a time.
    """
    words = _words(docs.select("doc_id", text).repartition(text_parts(docs, text, FINER), "doc_id"), text, token)
    bag = _bag() if bigrams else F.col("w")
    return words.select("doc_id", F.explode(bag).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, text: str = "text", bigrams: bool = True, token: str = TOKEN) -> DataFrame:
    """term, df, total: in how many documents it is, and how often in all. A part of the texts sends one row a term, and as many tasks as there are
    parts add these up, so neither side of the shuffle grows with the texts."""
    parts = text_parts(docs, text, FINER)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    words = _words(docs.select("doc_id", text, part.alias("part")).repartition(parts, "part"), text, token)
    each = words.select("part", "doc_id", F.explode(_bag() if bigrams else F.col("w")).alias("term")).groupBy("part", "doc_id", "term").agg(F.count("*").alias("tf"))
    held = each.groupBy("part", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("total"))
    return held.select("term", "n", "total").repartition(parts, "term").groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))


def text_parts(docs: DataFrame, text: str, finer: int = 1) -> int:
    """Parts of at most about ``PART_CHARACTERS`` of text, or a ``finer``-th of it; of few texts as many as tasks have a million characters each."""
    n = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    return max(1, -(-n * finer // PART_CHARACTERS), min(partitions(docs.sparkSession), -(-n // 1_000_000)))


def _words(docs: DataFrame, text: str, token: str) -> DataFrame:
    """docs with w, the words of each text in its place."""
    return docs.select(*(c for c in docs.columns if c != text), F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(token), F.lit(0)).alias("w"))


def _bag() -> Column:
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat("w", pairs)


def document_vectors(docs: DataFrame, text: str = "text", sublinear: bool = True, minimum: int = 1, names: bool = False, token: str = TOKEN) -> DataFrame:
    """id, h, dfs, w (and, with ``names``, terms) of every document: the unit-length vector of its words and pairs of words, each by a number
    that stands for its 64-bit hash in this call. docs: doc_id, the text and, if there are any, ``fit`` (only such rows count for document
    frequencies; terms that none of them has are left out) and ``keep`` (only such rows come out). Terms of fewer than ``minimum`` documents
    count for the length, but do not come out."""
    made, weigh = _weighed(docs, text, sublinear, minimum, names, token)
    return made(weigh, "id long, h array<long>, dfs array<long>, w array<double>" + ", terms array<string>" * names)


def document_chunks(docs: DataFrame, name: str, text: str = "text", minimum: int = 1, carry: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> Chunks:
    """The vectors of ``document_vectors``, stored as chunks of id, ``carry`` (columns of docs, from a row of the id that is kept), ``flags`` (boolean
    ones, true if they are in any row of the id), h and w. A row without text can bring what is carried, so no join is needed for it."""
    made, weigh = _weighed(docs, text, True, minimum, False, TOKEN, carry, flags)
    most, values = BLOCK_QUERIES, BLOCK_VALUES

    def packed(texts: pa.Table, told: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_chunk_rows(iter([weigh(texts, told).drop_columns(["dfs"])]), most, values), _CHUNK_KIND)

    more = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (*carry, *flags))
    return Chunks(_stored(made(packed, _CHUNK), name), f"id long, {more}h array<long>, w array<double>")


def _kinds(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a part's texts, the place of each row's id, its terms' hashes in order, and of each occurrence its hash's place."""
    ids, doc = np.unique(texts.column("doc_id").to_numpy(), return_inverse=True)
    kinds, code = np.unique(_numbers(texts.column("h"), np.int64), return_inverse=True)
    return ids, doc, kinds, code


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(_byte_planes(x).tobytes(), codec="zstd", asbytes=True)


def _spread(x: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return _plain(np.frombuffer(pa.decompress(x, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8), kind)


def _weighed(docs: DataFrame, text: str, sublinear: bool, minimum: int, names: bool, token: str, carry: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> tuple[Callable, Callable]:
    """What makes a table from (texts of a part, what the part is told), and the function that weighs them.

    Texts are dealt once into parts of bounded size. A part sends the hashes of its terms by ranges, in order, so that a hash takes about six
    bytes, with the number of its documents that have each; a range adds up those of all parts, and tells each, in the same order, how many
    documents have them and the place of each among the terms that come out, a byte or two. Range and place stand for the hash from then on.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)) if c in docs.columns else F.lit(True)
    rows, every = docs.agg(F.count_if(flag("fit")), F.count("*")).first()
    parts = max(text_parts(docs, text), -(-every // BLOCK_QUERIES))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    dealt = docs.select("doc_id", text, flag("fit").alias("fit"), flag("keep").alias("keep"), *carry, *(flag(c).alias(c) for c in flags), part.alias("part"))
    words = _words(dealt.repartition(parts, "part"), text, token).withColumn("b", _bag())
    shown = ["b"] if names else []
    own = words.select("part", "doc_id", "fit", "keep", *carry, *flags, F.transform("b", lambda t: F.xxhash64(t)).alias("h"), *shown)  # both sides read it, so texts move once

    def frequencies(texts: pa.Table, ids: np.ndarray, doc: np.ndarray, kinds: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whether each id counts, row and term of each pair, its first place and how often it is there."""
        fit = np.bincount(doc, texts.column("fit").to_numpy(), len(ids)) > 0
        row = np.repeat(doc, pc.list_value_length(texts.column("h")).to_numpy())
        pair, first, tf = np.unique(row * max(1, len(kinds)) + code, return_index=True, return_counts=True)
        return fit, pair // max(1, len(kinds)), pair % max(1, len(kinds)), first, tf

    def send(texts: pa.Table) -> pa.Table:
        ids, doc, kinds, code = _kinds(texts)
        fit, row, code, _, _ = frequencies(texts, ids, doc, kinds, code)
        n = np.bincount(code[fit[row]], minlength=len(kinds)).astype(np.uint32)
        place = ((kinds.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        ends = np.searchsorted(place, np.arange(parts + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(ends))
        pieces = [(kinds[ends[r] : ends[r + 1]], n[ends[r] : ends[r + 1]]) for r in some]
        at = texts.column("part")[0].as_py()
        return pa.table({"part": pa.array([at] * len(some), pa.int32()), "r": pa.array(some, pa.int32()), "m": pa.array([len(h) for h, _ in pieces], pa.int32()), "h": pa.array([_squeezed(np.diff(h, prepend=np.int64(0))) for h, _ in pieces], pa.binary()), "n": pa.array([_squeezed(x) for _, x in pieces], pa.binary())})

    def tell(sent: pa.Table) -> pa.Table:
        m = sent.column("m").to_numpy()
        h = np.concatenate([np.cumsum(_spread(x.as_py(), k, np.int64)) for x, k in zip(sent.column("h"), m)])
        n = np.concatenate([_spread(x.as_py(), k, np.uint32) for x, k in zip(sent.column("n"), m)])
        kinds, code = np.unique(h, return_inverse=True)
        df = np.bincount(code, n, len(kinds)).astype(np.uint32)
        out = df >= max(1, minimum)
        place = np.cumsum(out) - 1
        ends = np.cumsum(m)
        lists = [(df[code[e - k : e]], np.diff(place[code[e - k : e]], prepend=0)) for e, k in zip(ends, m)]
        return pa.table({"part_": sent.column("part"), "r": sent.column("r"), "m": sent.column("m"), "df": pa.array([_squeezed(d) for d, _ in lists], pa.binary()), "place": pa.array([_squeezed(p) for _, p in lists], pa.binary())})

    def weigh(texts: pa.Table, told: pa.Table) -> pa.Table:
        ids, doc, kinds, code = _kinds(texts)
        _, row, code, first, tf = frequencies(texts, ids, doc, kinds, code)
        keep, *flagged = (np.bincount(doc, texts.column(c).to_numpy(), len(ids)) > 0 for c in ("keep", *flags))
        many, name = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for x in told.sort_by("r").to_pylist():
            many.append(_spread(x["df"], x["m"], np.uint32))
            name.append(np.cumsum(_spread(x["place"], x["m"], np.int64)) + (x["r"] << 32))
        many, name = np.concatenate(many).astype(np.int64)[code], np.concatenate(name)
        raw = np.where(many > 0, ((1.0 + np.log(tf)) if sublinear else tf) * (np.log((1.0 + rows) / (1.0 + many)) + 1.0), 0.0)
        norm = np.sqrt(np.bincount(row, raw * raw, len(ids)))
        out = (many >= minimum) & (many > 0) & keep[row]
        size = np.bincount(row[out], minlength=len(ids))[keep]
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        lists = [pa.array(name[code[out]]), pa.array(many[out]), pa.array(raw[out] / norm[row[out]])]
        if names:
            lists.append(pc.list_flatten(texts.column("b")).combine_chunks().take(pa.array(first[out])))
        more = []
        if carry:
            order = np.argsort(~texts.column("keep").to_numpy(zero_copy_only=False), kind="stable")  # kept rows first
            at = pa.array(order[np.unique(doc[order], return_index=True)[1]][keep])
            more = [texts.column(c).combine_chunks().take(at) for c in carry]
        more += [pa.array(x[keep]) for x in flagged]
        return pa.table([pa.array(ids[keep]), *more, *(pa.ListArray.from_arrays(ends, x) for x in lists)], ["id", *carry, *flags, "h", "dfs", "w", *["terms"] * names])

    def made(of: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        sent = own.groupBy("part").applyInArrow(send, "part int, r int, m int, h binary, n binary")
        told = sent.repartition(parts, "r").groupBy("r").applyInArrow(tell, "part_ int, r int, m int, df binary, place binary")
        return own.groupBy("part").cogroup(told.repartition(parts, "part_").groupBy("part_")).applyInArrow(of, schema)

    return made, weigh


def idf(tf: DataFrame, rows: int, minimum: int = 1, most: int | None = None) -> DataFrame:
    """term, df, idf of terms in ``minimum`` documents or more; with ``most``, of so many of the most frequent ones (ties by term)."""
    return idf_of(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), rows, minimum, most)


def idf_of(counts: DataFrame, rows: int, minimum: int = 1, most: int | None = None) -> DataFrame:
    """As ``idf``, from term, df and total."""
    found = counts.filter(F.col("df") >= minimum)
    if most:
        found = most_frequent(cut(found, "term-counts"), most)
    return found.select("term", "df", (F.log((1.0 + rows) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def most_frequent(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of the greatest total, ties by term. The total of the last one comes from the number of terms of each total (few rows,
    as totals add up to the words of the texts); only terms that tie with it are ordered, so no task holds ``most`` rows of every other task."""
    totals = found.groupBy("total").agg(F.count("*").alias("n"))
    upto = totals.select("total", "n", F.sum("n").over(Window.orderBy(F.desc("total"))).alias("upto"))
    last = upto.filter(F.col("upto") >= most).orderBy(F.desc("total")).select("total", "n", "upto").first()
    if last is None:
        return found
    tied = found.filter(F.col("total") == last["total"]).orderBy("term").limit(most - (last["upto"] - last["n"]))
    return found.filter(F.col("total") > last["total"]).unionByName(tied)


def vectors(tf: DataFrame, fitted: DataFrame, sublinear: bool = True) -> DataFrame:
    """doc_id, terms, dfs, w: unit-length vectors, one row a document; terms outside the fitted ones go before the norm."""
    factor = (1.0 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    raw = tf.join(fitted, "term").select("doc_id", "term", "df", (factor * F.col("idf")).alias("raw"))
    one = raw.groupBy("doc_id").agg(F.collect_list(F.struct("term", "df", "raw")).alias("t"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    pick = lambda f: F.transform("t", f)
    return one.select("doc_id", pick(lambda x: x["term"]).alias("terms"), pick(lambda x: x["df"]).alias("dfs"), pick(lambda x: x["raw"] / F.col("norm")).alias("w"))


def weights(tf: DataFrame, fitted: DataFrame, sublinear: bool = True) -> DataFrame:
    """doc_id, term, df, w: one row a term."""
    zipped = F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"), F.col("w").alias("w"))
    return vectors(tf, fitted, sublinear).select("doc_id", F.inline(zipped))


# ---- blocks -------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """Some queries: their ids, vectors (dense) and terms (hashes, as postings by term number)."""

    ids: np.ndarray
    dense: np.ndarray | None = None
    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # hashes in order
    common: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # column of each term in ``matrix``, or -1
    matrix: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    first: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    many: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    query: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        """From id, and v or h and w. Terms of many queries go into a matrix of at most ``CELLS`` numbers, the most common ones first."""
        q = rows.num_rows
        made = cls(rows.column("id").to_numpy().astype(np.int64))
        if q and "v" in rows.column_names:
            made.dense = _numbers(rows.column("v")).reshape(q, -1)
        if q and "h" in rows.column_names:
            made.vocabulary, term = np.unique(_numbers(rows.column("h"), np.int64), return_inverse=True)
            query = np.repeat(np.arange(q), pc.list_value_length(rows.column("h")).to_numpy())
            weight = _numbers(rows.column("w"))
            order = np.argsort(term, kind="stable")
            made.query, made.weight = query[order], weight[order]
            made.many = np.bincount(term, minlength=len(made.vocabulary))
            made.first = np.cumsum(made.many) - made.many
            often = np.flatnonzero(made.many >= COMMON)
            often = often[np.argsort(-made.many[often], kind="stable")[: CELLS // q]]
            made.common = np.full(len(made.vocabulary), -1, np.int64)
            made.common[often] = np.arange(len(often))
            made.matrix = np.zeros((len(often), q))
            hit = made.common[term] >= 0
            made.matrix[made.common[term[hit]], query[hit]] = weight[hit]
        return made

    def lexical(self, h: pa.ListArray, w: pa.ListArray) -> np.ndarray:
        """Dot products of rows' term weights with every query; postings are followed at most about ``CELLS`` at a time."""
        n, q = len(h), len(self.ids)
        if not len(self.vocabulary):
            return np.zeros((n, q))
        own = _numbers(h, np.int64)
        term = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        known = self.vocabulary[term] == own
        row = np.repeat(np.arange(n), pc.list_value_length(h).to_numpy())[known]
        term, x = term[known], _numbers(w)[known]
        column = self.common[term]
        often = column >= 0
        wide = np.zeros((n, self.matrix.shape[0]))
        wide[row[often], column[often]] = x[often]
        out = wide @ self.matrix if self.matrix.shape[0] else np.zeros((n, q))
        row, term, x = row[~often], term[~often], x[~often]
        many = self.many[term]
        ends = np.cumsum(many)
        flat, lo = out.reshape(-1), 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
            m = many[lo:hi]
            at = np.repeat(self.first[term[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            cell = np.repeat(row[lo:hi] * q, m) + self.query[at]
            flat += np.bincount(cell, np.repeat(x[lo:hi], m) * self.weight[at], n * q)
            lo = hi
        return out

    def semantic(self, v: pa.ListArray) -> np.ndarray:
        return _numbers(v).reshape(len(v), -1) @ self.dense.T


def _numbers(lists: pa.ListArray | pa.ChunkedArray, kind: type = float) -> np.ndarray:
    """The values of all lists, end to end."""
    flat = pc.list_flatten(lists)
    return (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).to_numpy(zero_copy_only=False).astype(kind)


Score = Callable[[Block, pa.RecordBatch], np.ndarray]


def _lexical(block: Block, batch: pa.RecordBatch) -> np.ndarray:
    return block.lexical(batch.column("h"), batch.column("w"))


def _semantic(block: Block, batch: pa.RecordBatch) -> np.ndarray:
    return block.semantic(batch.column("v"))


def _steps(block: Block, rows: pa.Table) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Ids and rows, few enough for SCORES scores."""
    step = max(1, SCORES // max(1, len(block.ids), len(block.matrix)))
    for batch in rows.combine_chunks().to_batches() if len(block.ids) else ():
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part.column("id").to_numpy().astype(np.int64), part


def _own(own: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Cells of rows that are queries themselves."""
    both = np.flatnonzero(np.isin(own, block.ids))
    row, query = np.nonzero(own[both][:, None] == block.ids[None, :])
    return both[row], query


@dataclass
class Clock:
    """Time that tasks spend on scoring, which they add up themselves: no job runs for the clock's sake. A task that runs again counts again.

    Not an ``Observation``: once a session has had one, Spark 4.1 cannot send models of two classes with their training summary to tasks.
    """

    seen: list[Accumulator] = field(default_factory=list)

    def start(self, spark: SparkSession) -> Accumulator:
        """What the tasks of one scan add their milliseconds to."""
        self.seen.append(spark.sparkContext.accumulator(0.0))
        return self.seen[-1]

    def ms(self) -> float:
        """Milliseconds of all tasks, once the rows have been read."""
        return sum(a.value for a in self.seen)


_FOUND = pa.schema([("query_id", pa.int64()), ("source_id", pa.int64()), ("score", pa.float64())])
_FOUND_SQL = "query_id long, source_id long, score double"


class Best:
    """The k best rows for each query of a block, by score to nine digits and id. Rows below a query's k-th best so far are passed over unsorted."""

    def __init__(self, block: Block, k: int, score: Score, spent: Accumulator | None) -> None:
        self.block, self.k, self.score, self.spent = block, k, score, spent
        self.query, self.ids, self.top = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q = len(block.ids)
        self.least, self.last = np.full(q, -np.inf), np.full(q, np.iinfo(np.int64).max)  # score and id of the k-th best so far

    def add(self, rows: pa.Table) -> None:
        k, block, least, last = self.k, self.block, self.least, self.last
        query, ids, top = self.query, self.ids, self.top
        began = time.perf_counter()
        for own, part in _steps(block, rows):
            s = self.score(block, part)
            s[_own(own, block)] = -np.inf
            bar = least - 2e-9
            if len(own) > k and not np.isfinite(least).all():
                bar = np.maximum(bar, np.partition(s, len(own) - k, axis=0)[len(own) - k] - 2e-9)
            r, c = np.nonzero(s >= bar)
            x, i = np.round(s[r, c], 9), own[r]
            keep = np.isfinite(x) & ((x > least[c]) | ((x == least[c]) & (i < last[c])))
            query, ids, top = np.concatenate((query, c[keep])), np.concatenate((ids, i[keep])), np.concatenate((top, x[keep]))
            order = np.lexsort((ids, -top, query))
            query, ids, top = query[order], ids[order], top[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            query, ids, top, place = (a[place < k] for a in (query, ids, top, place))
            full = place == k - 1
            least[query[full]], last[query[full]] = top[full], ids[full]
        self.query, self.ids, self.top = query, ids, top
        if self.spent is not None:
            self.spent.add(1000 * (time.perf_counter() - began))

    def table(self) -> pa.Table:
        return pa.table([pa.array(self.block.ids[self.query]), pa.array(self.ids), pa.array(self.top)], schema=_FOUND)


def _best(block: Block, rows: pa.Table, k: int, score: Score, spent: Accumulator | None) -> pa.Table:
    found = Best(block, k, score, spent)
    found.add(rows)
    return found.table()


def top_k(scores: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """Ranked by score to nine digits, then source_id."""
    s = F.round(F.col("score") if score is None else score, 9)
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "source_id")
    return scores.withColumn("s", s).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "source_id", "rank", F.round("s", 6).alias("score"))


def _sides(df: DataFrame, *more: str) -> DataFrame:
    """id, v, h (hashes of terms) and w, of those that df has, and ``more``."""
    lexical = []
    if "h" in df.columns:
        lexical = [F.coalesce("h", F.array().cast("array<bigint>")).alias("h"), F.coalesce("w", F.array().cast("array<double>")).alias("w")]
    elif "terms" in df.columns:
        lexical = [F.coalesce(F.transform("terms", lambda t: F.xxhash64(t)), F.array().cast("array<bigint>")).alias("h"), F.coalesce("w", F.array().cast("array<double>")).alias("w")]
    return df.select("id", *["v"] * ("v" in df.columns), *lexical, *more)


def _byte_planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones: like bytes stand together, so they pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).reshape(-1)


def _plain(planes: np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def pack(rows: pa.Table) -> tuple[bytes, bytes]:
    """Two compressed tables. Vectors h, w of all rows go by term: each hash once, the rows that have it, and for each its weight's place among
    the distinct weights of the row, of which a text has few. What comes back by ``unpack`` is the same to the last bit, terms in order of h."""
    other = rows.select([c for c in rows.column_names if c not in ("h", "w")])
    if "h" not in rows.column_names:
        return _ipc(other), b""
    n = rows.num_rows
    size = pc.fill_null(pc.list_value_length(rows.column("h")), 0).to_numpy().astype(np.int64)
    row, h, w = np.repeat(np.arange(n), size), _numbers(rows.column("h"), np.int64), _numbers(rows.column("w"))
    order = np.argsort(h, kind="stable")
    kinds, many = np.unique(h[order], return_counts=True)
    numbers, code = np.unique(w.view(np.int64), return_inverse=True)
    pair, place = np.unique(row * max(1, len(numbers)) + code, return_inverse=True)
    own = np.bincount(pair // max(1, len(numbers)), minlength=n)
    place = place - np.repeat(np.cumsum(own) - own, size)
    narrow = lambda x: x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32)
    lists = {"kinds": np.diff(kinds, prepend=kinds[:1]), "first": kinds[:1], "many": many.astype(np.uint32), "row": narrow(row[order]), "place": narrow(place[order]), "weights": numbers[pair % max(1, len(numbers))], "own": own.astype(np.uint32)}
    made = {f"{k}:{x.dtype.str[1:]}": pa.array([_byte_planes(x).tobytes()], pa.large_binary()) for k, x in lists.items()}
    return _ipc(other), _ipc(pa.table(made))


def unpack(other: pa.Buffer, vectors: pa.Buffer) -> pa.Table:
    rows = pa.ipc.open_stream(other).read_all()
    if not len(vectors):
        return rows
    made, x = pa.ipc.open_stream(vectors).read_all(), {}
    for name in made.column_names:
        key, kind = name.split(":")
        x[key] = _plain(np.frombuffer(made.column(name)[0].as_buffer(), np.uint8), np.dtype(kind))
    kinds = np.cumsum(x["kinds"].astype(np.int64)) + (x["first"][0] if len(x["first"]) else 0)
    row, own = x["row"].astype(np.int64), x["own"].astype(np.int64)
    order = np.argsort(row, kind="stable")
    size = np.bincount(row, minlength=rows.num_rows)
    ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
    h = np.repeat(kinds, x["many"])[order]
    w = x["weights"].view(float)[(np.cumsum(own) - own)[row[order]] + x["place"][order]]
    for name, values in (("h", h), ("w", w)):
        rows = rows.append_column(name, pa.ListArray.from_arrays(ends, pa.array(values)))
    return rows


def _values(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Numbers of each row."""
    return sum((pc.fill_null(pc.list_value_length(rows.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("v", "h") if c in rows.schema.names), np.zeros(rows.num_rows, np.int64))


def _slices(tables: Iterator[pa.Table], most: int, values: int) -> Iterator[pa.Table]:
    """The rows anew in tables of at most ``most`` rows and about ``values`` numbers."""
    held, n, size = [], 0, 0
    for t in tables:
        ends, lo = np.cumsum(_values(t)), 0
        while lo < t.num_rows:
            fits = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + values - size, side="right"))
            hi = min(t.num_rows, lo + most - n, max(fits, lo + (not n)))
            if hi > lo:
                held.append(t.slice(lo, hi - lo))
                n, size = n + hi - lo, size + int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
            if hi < t.num_rows:
                yield pa.concat_tables(held)
                held, n, size = [], 0, 0
            lo = hi
    if n:
        yield pa.concat_tables(held)


_CHUNK = "n long, numbers long, other binary, vectors binary"
_CHUNK_KIND = pa.schema([("n", pa.int64()), ("numbers", pa.int64()), ("other", pa.binary()), ("vectors", pa.binary())])


def _chunk_rows(tables: Iterator[pa.Table], most: int, values: int) -> Iterator[pa.RecordBatch]:
    for t in _slices(tables, most, values):
        other, vectors = pack(t)
        yield pa.RecordBatch.from_arrays([pa.array([t.num_rows]), pa.array([int(_values(t).sum())]), pa.array([other]), pa.array([vectors])], ["n", "numbers", "other", "vectors"])


@dataclass
class Chunks:
    """Rows (id, v, h and w of those that there are, and more) as a stored table of a packed row for about ``BLOCK_VALUES`` numbers or
    ``BLOCK_QUERIES`` rows; ``schema`` is that of the rows."""

    frame: DataFrame
    schema: str

    @classmethod
    def of(cls, df: DataFrame, name: str) -> Chunks:
        """Each task packs its own rows, so nothing is shuffled."""
        most, values = BLOCK_QUERIES, BLOCK_VALUES

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _chunk_rows((pa.Table.from_batches([b]) for b in batches), most, values)

        last = [c for c in df.columns if c not in ("h", "w")] + [c for c in ("h", "w") if c in df.columns]  # as ``unpack`` has them
        df = df.select(*last)
        return cls(_stored(df.mapInArrow(scan, _CHUNK), name), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))

    def rows(self) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for other, vectors in zip(b.column("other"), b.column("vectors")):
                    yield from unpack(other.as_buffer(), vectors.as_buffer()).to_batches(max_chunksize=1024)

        return self.frame.select("other", "vectors").mapInArrow(scan, self.schema)

    def dealt(self, name: str) -> Chunks:
        """The same rows in as few chunks as they need, if there are more."""
        most, values = BLOCK_QUERIES, BLOCK_VALUES
        chunks, n, numbers = self.frame.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("numbers"), F.lit(0))).first()
        parts = max(1, -(-n // most), -(-numbers // values))
        if chunks <= parts:
            return self

        def merge(rows: pa.Table) -> pa.Table:
            tables = (unpack(a.as_buffer(), b.as_buffer()) for a, b in zip(rows.column("other"), rows.column("vectors")))
            return pa.Table.from_batches(_chunk_rows(tables, most, values), _CHUNK_KIND)

        return Chunks(_stored(self.frame.withColumn("part", F.pmod("key", F.lit(parts))).groupBy("part").applyInArrow(merge, _CHUNK), name), self.schema)


def _stored(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks with a key, in files of few rows, as a reader holds the rows of a file."""
    return cut(chunks.withColumn("key", F.monotonically_increasing_id()), name, compression="uncompressed", maxRecordsPerFile=4, **{"parquet.enable.dictionary": "false", "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})


def cells(corpus: DataFrame | Chunks, queries: DataFrame, begin: Callable[[Block, pa.Table], Best | Extents], schema: str) -> DataFrame:
    """Every chunk of the queries meets every chunk of the corpus: ``begin`` makes what adds the corpus' chunks (``add``) and says what it
    found (``table``) from the block of the queries and the query rows.

    Chunks are stored once and read again, by a product of partitions that shuffles nothing; a task has one chunk of the queries and streams
    many of the corpus. So disk grows with the tables, though the work is queries x corpus, and a query has one result a task.
    """
    docs = corpus if isinstance(corpus, Chunks) else Chunks.of(corpus, "corpus-chunks")
    asked = Chunks.of(queries, "query-chunks").dealt("query-chunks").frame
    q = max(1, asked.count())
    spark = asked.sparkSession
    ways = -(-max(partitions(spark), 2 * spark.sparkContext.defaultParallelism) // q)
    left = docs.frame.select("other", "vectors").coalesce(ways)
    right = asked.select(F.col("key").alias("q_key"), F.col("other").alias("q_other"), F.col("vectors").alias("q_vectors")).repartitionByRange(q, "q_key")  # one in each

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            for key, other, vectors, q_other, q_vectors in zip(b.column("q_key").to_pylist(), *(b.column(c) for c in ("other", "vectors", "q_other", "q_vectors"))):
                if key not in held:
                    wanted = unpack(q_other.as_buffer(), q_vectors.as_buffer())
                    held[key] = begin(Block.of(wanted), wanted)
                held[key].add(unpack(other.as_buffer(), vectors.as_buffer()))
        for found in held.values():
            yield from found.table().to_batches()

    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(meet, schema)


def _ranked(corpus: DataFrame | Chunks, queries: DataFrame, k: int, score: Callable[[Block, pa.Table], Score], clock: Clock | None) -> DataFrame:
    check_top_k(k)
    spent = clock.start(queries.sparkSession) if clock else None
    return top_k(cells(corpus, queries, lambda block, wanted: Best(block, k, score(block, wanted), spent), _FOUND_SQL), k)


# ---- lexical search by blocks -------------------------------------------------------------------------------------

def _hashed() -> Column:
    """(h, x) of each term: its hash and its weight."""
    return F.zip_with("terms", "w", lambda t, x: F.struct(F.xxhash64(t).alias("h"), x.alias("x")))



@dataclass
class Blocks:
    """``rows``: id, terms, w and the block of each document; ``bounds``: the 64-bit hash of a term (h), block and the greatest weight (top)
    of the term there. Terms that share a hash share a bound, which is one for both.

    A document's block is told by its leading term (the most common one it has, so languages and kinds of text part), the size of its
    vector (short vectors have heavy terms), and, where so many agree in both, a hash of its id: a block has about ``BLOCK_ROWS`` documents.
    """

    rows: DataFrame
    bounds: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, size: int = BLOCK_ROWS) -> Blocks:
        """From (id, terms, w) rows and, if there is one, their ``lead``; null vectors are empty."""
        lead = F.coalesce("lead", F.lit("")) if "lead" in rows.columns else F.lit("")
        band = F.floor(2 * F.log2(1.0 + F.size("terms"))).cast("long")
        text, number = F.array().cast("array<string>"), F.array().cast("array<double>")
        own = cut(rows.select("id", F.coalesce("terms", text).alias("terms"), F.coalesce("w", number).alias("w"), lead.alias("lead")).withColumn("band", band), "lexical-rows")
        counts = cut(own.groupBy("lead", "band").agg(F.count("*").alias("n")), "lexical-leads")
        parts = lambda n: F.ceil(n / F.lit(size))
        known = counts.filter(F.col("n") >= size / 4).orderBy(F.desc("n"), "lead", "band").limit(LEADS).select(F.col("lead").alias("k_lead"), F.col("band").alias("k_band"), parts(F.col("n")).alias("k_parts"))
        same = lambda: (F.col("lead") == F.col("k_lead")) & (F.col("band") == F.col("k_band"))
        pooled = counts.join(F.broadcast(known), same(), "left_anti").groupBy(F.col("band").alias("p_band")).agg(parts(F.sum("n")).alias("p_parts"))  # a row a band
        block = F.xxhash64(F.when(F.col("k_parts").isNotNull(), F.col("lead")), "band", F.pmod(F.xxhash64("id"), F.coalesce("k_parts", "p_parts")))
        named = own.join(F.broadcast(known), same(), "left").join(F.broadcast(pooled), F.col("band") == F.col("p_band"), "left")  # at most LEADS rows
        placed = named.select("id", "terms", "w", block.alias("block"))
        tops = placed.select("block", F.inline(_hashed())).groupBy("h", "block").agg(F.max("x").alias("top"))
        return cls(placed, cut(tops, "block-bounds"))

    def only(self, ids: DataFrame) -> Blocks:
        """The documents of ``ids`` (id); bounds stay right, if not as narrow."""
        return Blocks(self.rows.join(ids.select("id"), "id", "left_semi"), self.bounds)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.bounds.write.mode("overwrite").parquet(f"{path}/bounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Blocks:
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/bounds"))

    def reach(self, queries: DataFrame) -> DataFrame:
        """query_id, block, bound: what a document of the block can score at most, for blocks that share a term with the query."""
        asked = queries.select(F.col("id").alias("query_id"), F.inline(_hashed()))
        return asked.join(self.bounds, "h").groupBy("query_id", "block").agg(F.sum(F.col("x") * F.col("top")).alias("bound"))

    def score(self, pairs: DataFrame, queries: DataFrame, k: int, slices: int, clock: Clock | None = None) -> DataFrame:
        """query_id, source_id, score: the k best of each block for each query that ``pairs`` (query_id, block) names for it."""
        part = F.pmod(F.xxhash64("query_id"), F.lit(slices)).alias("slice")
        named = pairs.select("query_id", "block", part)
        asked = named.join(_sides(queries).withColumnRenamed("id", "query_id"), "query_id").select(F.col("block").alias("q_block"), F.col("slice").alias("q_slice"), F.col("query_id").alias("id"), "h", "w")
        corpus = _sides(self.rows, "block").join(named.select("block", "slice").distinct(), "block")

        spent = clock.start(corpus.sparkSession) if clock else None

        def best_of(docs: pa.Table, wanted: pa.Table) -> pa.Table:
            return _best(Block.of(wanted), docs, k, _lexical, spent)

        return corpus.groupBy("block", "slice").cogroup(asked.groupBy("q_block", "q_slice")).applyInArrow(best_of, _FOUND_SQL)


def lexical_top_k(corpus: DataFrame | Blocks | Chunks, queries: DataFrame, k: int, clock: Clock | None = None) -> DataFrame:
    """(id, terms or h, w) rows of both sides, or blocks or chunks of the corpus; rows that share no term score 0 and may fill k."""
    if isinstance(corpus, Blocks):
        return _by_bounds(corpus, queries, k, clock)
    asked = _sides(queries).select("id", "h", "w")
    return _ranked(corpus if isinstance(corpus, Chunks) else _sides(corpus).select("id", "h", "w"), asked, k, lambda *_: _lexical, clock)


def _by_bounds(index: Blocks, queries: DataFrame, k: int, clock: Clock | None = None) -> DataFrame:
    """The blocks that promise most to a query are scored first; its k-th best score there is what others have to reach. Blocks whose bound
    is below it hold none of the k best."""
    check_top_k(k)
    text, number = F.array().cast("array<string>"), F.array().cast("array<double>")
    asked = cut(queries.select("id", F.coalesce("terms", text).alias("terms"), F.coalesce("w", number).alias("w")), "queries")
    slices = max(1, -(-asked.count() // SLICE))
    reach = cut(index.reach(asked).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))), "block-reach")
    first = cut(index.score(reach.filter(F.col("place") <= FIRST), asked, k, slices, clock), "first-blocks")
    seen = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("n") == k).select("query_id", F.col("score").alias("least"))
    left = reach.filter(F.col("place") > FIRST).join(seen, "query_id", "left").filter(F.col("bound") + 1e-8 >= F.coalesce("least", F.lit(0.0)))
    rest = index.score(left, asked, k, slices, clock)
    low = index.rows.select("id").orderBy("id").limit(k + 1)  # of rows without a shared term those with the least ids, and one more for the query itself
    nothing = asked.select(F.col("id").alias("query_id")).crossJoin(F.broadcast(low.select(F.col("id").alias("source_id")))).filter("query_id <> source_id").withColumn("score", F.lit(0.0))  # k + 1 rows
    every = first.unionByName(rest).unionByName(nothing).groupBy("query_id", "source_id").agg(F.max("score").alias("score"))
    return top_k(every, k)


def dense_top_k(corpus: DataFrame | Chunks, queries: DataFrame, k: int, clock: Clock | None = None) -> DataFrame:
    """(id, v) rows of both sides, or chunks of the corpus; dot products in double."""
    return _ranked(corpus if isinstance(corpus, Chunks) else corpus.select("id", "v"), queries.select("id", "v"), k, lambda *_: _semantic, clock)


_EXTENTS = ["query_id", "n", "low_l", "low_d", "high_l", "high_d", "sum_l", "sum_d"]


class Extents:
    """Number of rows, and least, greatest and summed scores of each query of a block."""

    def __init__(self, block: Block) -> None:
        q = len(block.ids)
        self.block, self.n = block, np.zeros(q, np.int64)
        self.low, self.high, self.total = np.full((2, q), np.inf), np.full((2, q), -np.inf), np.zeros((2, q))

    def add(self, rows: pa.Table) -> None:
        for own, part in _steps(self.block, rows):
            same = _own(own, self.block)
            self.n += len(own)
            np.subtract.at(self.n, same[1], 1)
            for i, s in enumerate((_lexical(self.block, part), _semantic(self.block, part))):
                for value, kept, f in ((np.inf, self.low, np.minimum), (-np.inf, self.high, np.maximum)):
                    s[same] = value
                    kept[i] = f(kept[i], f.reduce(s, axis=0))
                s[same] = 0.0
                self.total[i] += s.sum(axis=0)

    def table(self) -> pa.Table:
        some = self.n > 0
        return pa.table([pa.array(x[some]) for x in (self.block.ids, self.n, *self.low, *self.high, *self.total)], _EXTENTS)


def extents(corpus: DataFrame | Chunks, queries: DataFrame) -> DataFrame:
    """query_id, n, and the least, greatest and summed lexical (l) and dense (d) scores of each query over the corpus; (id, v, terms, w) rows
    of both sides, or chunks of the corpus."""
    names = _EXTENTS
    found = cells(corpus if isinstance(corpus, Chunks) else _sides(corpus), _sides(queries), lambda block, _: Extents(block), "query_id long, n long, " + ", ".join(f"{x} double" for x in names[2:]))
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), *(F.min(x).alias(x) for x in names[2:4]), *(F.max(x).alias(x) for x in names[4:6]), *(F.sum(x).alias(x) for x in names[6:]))


def hybrid_top_k(corpus: DataFrame | Chunks, queries: DataFrame, k: int, weight: float = 0.5, clock: Clock | None = None) -> DataFrame:
    """(id, v, terms, w) rows of both sides, or chunks of the corpus; a first scan finds each query's extents over the whole corpus, which scale both scores to 0..1,
    a second its k best of the mixed scores."""
    check_weight(weight)
    corpus = corpus if isinstance(corpus, Chunks) else Chunks.of(_sides(corpus), "corpus-chunks")  # both scans read them
    span = lambda c: F.when(F.col(f"high_{c}") == F.col(f"low_{c}"), 1.0).otherwise(F.col(f"high_{c}") - F.col(f"low_{c}")).alias(f"span_{c}")
    scale = cut(extents(corpus, queries).select(F.col("query_id").alias("id"), "low_l", "low_d", span("l"), span("d")), "extents")
    asked = _sides(queries).join(scale, "id")

    def mixed(_: Block, wanted: pa.Table) -> Score:
        low_l, low_d, span_l, span_d = (wanted.column(c).to_numpy() for c in ("low_l", "low_d", "span_l", "span_d"))
        return lambda block, batch: (1 - weight) * ((_lexical(block, batch) - low_l) / span_l) + weight * ((_semantic(block, batch) - low_d) / span_d)

    return _ranked(corpus, asked, k, mixed, clock)


# ---- indexes ------------------------------------------------------------------------------------------------------

RESULT = "query_id long, source_id long, rank long, score double"


@dataclass
class LexicalIndex:
    """Fitted terms (term, df, idf), document vectors (id, terms, w) and the number of rows fitted on."""

    fitted: DataFrame
    rows: DataFrame
    count: int

    @classmethod
    def build(cls, docs: DataFrame, most: int | None = None) -> LexicalIndex:
        """From (doc_id, text) rows; documents without a term have empty vectors."""
        n = docs.count()
        fitted = idf_of(term_counts(docs), n, most=most)
        if most is None:
            rows = document_vectors(docs, names=True)
        else:
            own = vectors(terms(docs), fitted).select(F.col("doc_id").alias("id"), "terms", "dfs", "w")
            rows = docs.select(F.col("doc_id").alias("id")).join(own, "id", "left")
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        lead = F.array_max(F.zip_with("dfs", "terms", lambda d, t: F.struct(d.alias("df"), t.alias("term"))))["term"]
        return cls(fitted, rows.select("id", F.coalesce("terms", empty("string")).alias("terms"), F.coalesce("w", empty("double")).alias("w"), lead.alias("lead")), n)

    def transform(self, docs: DataFrame) -> DataFrame:
        """Vectors of other texts by the fitted terms."""
        return vectors(terms(docs), self.fitted).select(F.col("doc_id").alias("id"), "terms", "w")

    def save(self, path: str) -> None:
        self.fitted.write.mode("overwrite").parquet(f"{path}/fitted")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        write_config(self.rows.sparkSession, path, {"kind": "lexical", "count": self.count})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        config = read_config(spark, path, "lexical", ("fitted", "rows"))
        return cls(spark.read.parquet(f"{path}/fitted"), spark.read.parquet(f"{path}/rows"), config["count"])

    def retrieve(self, *, subject: str = "", body: str = "", query_text: str | None = None, k: int = 5, corpus: DataFrame | None = None, wanted: dict[str, str] | None = None, clock: Clock | None = None) -> DataFrame:
        """Ranked rows for one text; ``corpus`` (doc_id and metadata columns) with ``wanted`` narrows the rows before scoring. A blank
        query gives an empty result."""
        check_top_k(k)
        spark = self.rows.sparkSession
        text = F.lit(query_text) if query_text is not None else classifier_text(F.lit(subject), F.lit(body))
        query = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), text.alias("text"))
        rows = self.rows
        if corpus is not None:
            rows = rows.join(metadata_filter(corpus, wanted).select(F.col("doc_id").alias("id")), "id", "left_semi")
        elif wanted:
            raise ValueError("a metadata filter needs the corpus")
        if query.filter(F.trim("text") == "").count():
            return spark.createDataFrame([], RESULT)
        own = query.select(F.col("doc_id").alias("id")).join(self.transform(query), "id", "left")
        return lexical_top_k(rows, own, k, clock)


@dataclass
class DenseIndex:
    """Vectors (id, v) and how they were made."""

    rows: DataFrame
    config: dict

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        write_config(self.rows.sparkSession, path, {"kind": "dense", **self.config})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DenseIndex:
        config = read_config(spark, path, "dense", ("rows",))
        rows = spark.read.parquet(f"{path}/rows")
        wide = rows.filter(F.size("v") != config.get("dimensions", -1)).limit(1).count() if "dimensions" in config else 0
        if wide:
            raise ValueError(f"{path}: vectors do not have {config['dimensions']} numbers")
        return cls(rows, {k: v for k, v in config.items() if k != "kind"})


def write_config(spark: SparkSession, path: str, config: dict) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def read_config(spark: SparkSession, path: str, kind: str, parts: tuple[str, ...]) -> dict:
    """The saved configuration; an index of another kind, or one that lacks parts, is an error that names them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    has = lambda p: (x := jvm.org.apache.hadoop.fs.Path(f"{path}/{p}")).getFileSystem(conf).exists(x)
    if missing := [p for p in ("config", *parts) if not has(p)]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    config = json.loads(spark.read.text(f"{path}/config", wholetext=True).first()[0])
    if config.get("kind") != kind:
        raise ValueError(f"{path} holds a {config.get('kind')} index, not a {kind} one")
    return config


def encode(df: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 64, normalize: bool = True) -> DataFrame:
    """df with ``v``: vectors of texts by ``embed`` (a list of texts to a matrix), ``batch`` texts a call, of unit length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                m = np.asarray(embed([x or "" for x in part.column(text).to_pylist()]), np.float32)
                if m.ndim != 2 or len(m) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts gave vectors of shape {m.shape}")
                if normalize:
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = m / np.where(norm == 0, 1, norm)
                v = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, v], names=[*part.schema.names, "v"])

    return df.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", v array<float>")


# ---- metrics ------------------------------------------------------------------------------------------------------


def ranking_metrics(ranked: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hit rates at 1, 3, 5 and MRR from (query_id, rank, relevant) per ``by`` columns, which both sides have; queries without rows count
    as misses, and no queries at all give zeros (without ``by``)."""
    keys = [*by, "query_id"]
    first = ranked.groupBy(*keys).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.count("*").alias("got"))
    all_q = queries.select(*keys).join(first, keys, "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    hit = lambda k: zero(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)))
    mean = [zero(F.avg(F.coalesce("got", F.lit(0)).cast("double"))).alias("mean_retrieved")] * bool(by)
    return all_q.groupBy(*by).agg(F.count("*").alias("n_queries"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"), zero(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"), *mean)


def select_method(metrics: DataFrame) -> DataFrame:
    """The method of the best validation metrics: recall at 5, MRR, recall at 1, then the last name."""
    order = (F.desc("recall_5"), F.desc("mrr"), F.desc("recall_1"), F.desc("method"))
    return metrics.filter("split = 'validation'").orderBy(*order).limit(1).select("method", "recall_5", "mrr", "recall_1")


def gold_metrics(labels: DataFrame) -> DataFrame:
    """Per (query_id, rank, label): hit rates, MRR, mean nDCG@5 with the ideal order of the retrieved labels, label counts."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("label"), "rank"))
    gain = F.pow(F.lit(2.0), F.col("label")) - 1.0
    dcg = lambda r: F.sum(F.when(F.col(r) <= 5, gain / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    per = labels.withColumn("ideal", ideal).groupBy("query_id").agg(dcg("rank").alias("dcg"), dcg("ideal").alias("best"), F.min(F.when(F.col("label") > 0, F.col("rank"))).alias("first"), *(F.sum((F.col("label") == k).cast("long")).alias(f"label_{k}") for k in (0, 1, 2)))
    hit = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6)
    return per.agg(F.count("*").alias("n_queries"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0)), 6).alias("ndcg_5"), *(F.sum(f"label_{k}").alias(f"label_{k}") for k in (0, 1, 2)))


THRESHOLDS = sorted({round(0.05 * i, 2) for i in range(16)} | {0.39})


def evidence_thresholds(labels: DataFrame) -> DataFrame:
    """For each threshold over the first-ranked rows: queries allowed, rates, precision, strong rate, false allowed.

    Rows are counted once, by the number of thresholds that they reach; sums over those few counts give every threshold.
    """
    reached = sum((F.col("score") >= t).cast("int") for t in THRESHOLDS)
    counts = labels.filter("rank = 1").groupBy(reached.alias("reached")).agg(F.count("*").alias("c"), F.sum((F.col("label") > 0).cast("long")).alias("g"), F.sum((F.col("label") == 2).cast("long")).alias("s"))
    grid = labels.sparkSession.createDataFrame([(i, t) for i, t in enumerate(THRESHOLDS, 1)], "place int, threshold double")
    ok = F.col("reached") >= F.col("place")
    n = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    a = F.broadcast(grid).crossJoin(counts).groupBy("threshold").agg(F.sum("c").alias("n"), n("c").alias("allowed"), n("g").alias("right"), n("s").alias("strong"))
    return a.select("threshold", "allowed", F.round(F.col("allowed") / F.col("n"), 6).alias("allowed_rate"), F.round(F.when(F.col("allowed") > 0, F.col("right") / F.col("allowed")), 6).alias("precision"), F.round(F.coalesce(F.try_divide("strong", "allowed"), F.lit(0.0)), 6).alias("strong_rate"), (F.col("allowed") - F.col("right")).alias("false_allowed"))


def select_evidence(thresholds: DataFrame) -> DataFrame:
    """The lowest threshold with precision 1 and half of the queries allowed, or null."""
    return thresholds.filter("precision = 1.0 and allowed_rate >= 0.5").agg(F.min("threshold").alias("threshold"))
