"""Long repeated byte strings by a run-length suffix index.

Every string of ``length`` bytes contains a least k-byte window hash; equal strings have the same one. Maximal runs of starts
with the same least hash are *contexts*; a string starts in exactly one context, so equal strings meet in one bucket.

1. ``contexts``: one scan gives (bucket, context hash, id, first start, number of starts). Buckets with one context
   that cannot repeat within itself are dropped: that is nearly all text that occurs once.
2. Copies of a context are one row with a count. A context seen twice is repeated throughout, without reading bytes.
3. Only one copy of each context is fetched, where its bucket has others. Buckets of more than ``HOT_BYTES`` are split by
   longer shared cores until they are small or one string each. Whole buckets are gathered into blocks, and each block gets a ``RunIndex``: suffix array, Burrows-Wheeler transform stored by runs, and the suffix position and common
   prefix at both ends of each run. One pass along the text then streams matching statistics: within a run, a step along the
   text shortens the match by one, so only run ends are needed. Starts that match ``length`` bytes elsewhere are marked.
4. Marks, one row a context with its merged ranges, go back to all copies of their context, so a join with them never makes more rows
   than it is given; a last pass cuts the union of the marked bytes out of each text.

Rows: null texts are empty; rows without id are left out. Rows that share an id are different documents, for matching and for cutting: a
row is known by its id and a hash of its text. Texts shorter than ``length`` stay. Very long texts are read whole. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.llm import kernels as K
from deskmill.llm.store import cut, drop, partitions

GRAM = 50
BLOCK_BYTES = 1 << 20
HOT_BYTES = 1 << 20  # of distinct contexts in one bucket; larger buckets are split
SPLITS = (176, 16, 1)
WORD_BYTES = 4


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with samples at both ends of each run.

    ``heads``/``tails``: text positions of the first and last suffix of each run; ``head_lcp``/``tail_lcp``: their common
    prefixes with the suffix before and after in suffix order. Texts are separated by unique marks, so no match crosses them.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        m, n = len(offs) - 1, len(data) + len(offs) - 1
        self.starts = offs[:-1] + np.arange(m)
        text = np.empty(n, np.int64)
        mark = np.zeros(n, bool)
        mark[offs[1:] + np.arange(m)] = True
        text[~mark] = data.astype(np.int64) + m
        text[mark] = np.arange(m)
        sa, levels = self._sort(text, m + 256)
        before = text[sa - 1]
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        at = np.flatnonzero(head)
        self.n, self.runs = n, before[at]
        ends = np.concatenate((at[1:] - 1, [n - 1])) if n else at
        self.heads, self.tails = sa[at], sa[ends]
        self.head_lcp = self._lcp(levels, sa[np.maximum(at - 1, 0)], sa[at], n) * (at > 0)
        self.tail_lcp = self._lcp(levels, sa[ends], sa[np.minimum(ends + 1, n - 1)], n) * (ends < n - 1)

    @staticmethod
    def _sort(text: np.ndarray, top: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix array by prefix doubling of unresolved suffixes only; ranks by the first 1, 2, 4, ... symbols."""
        n = len(text)
        order = np.argsort(text, kind="stable")
        rank = np.empty(n, np.int64)
        new = np.ones(n, bool)
        new[1:] = text[order][1:] != text[order][:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = first
        levels, h = [rank.astype(np.int32)], 1
        while True:
            same = np.zeros(n, bool)
            same[1:] = ~new[1:]
            same[:-1] |= ~new[1:]
            slot = np.flatnonzero(same)  # suffix order positions still tied
            if not len(slot):
                return order, levels
            suffix = order[slot]
            nxt = suffix + h
            key = rank[suffix] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
            by = np.argsort(key)
            key = key[by]
            order[slot] = suffix[by]
            fresh = np.ones(len(slot), bool)
            fresh[1:] = key[1:] != key[:-1]
            new[slot] = fresh
            start = np.maximum.accumulate(np.where(fresh, slot, 0))
            rank[order[slot]] = start
            levels.append(rank.astype(np.int32))
            h *= 2

    @staticmethod
    def _lcp(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            ok = (a < n) & (b < n) & (a != b)
            ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
            step = ok * (1 << k)
            total += step
            a += step
            b += step
        return total

    def matching_statistics(self) -> np.ndarray:
        """For each position of the text, the longest match that starts there and elsewhere too, streamed from run ends."""
        out = np.zeros(self.n, np.int64)
        for at, length in ((self.heads, self.head_lcp), (self.tails, self.tail_lcp)):
            reach = np.full(self.n, -1, np.int64)
            reach[at] = at + length  # a match of reach - p at p, until the next sample
            last = np.maximum.accumulate(np.where(reach >= 0, np.arange(self.n), -1))
            found = np.where(last >= 0, reach[np.maximum(last, 0)] - np.arange(self.n), 0)
            np.maximum(out, found, out=out)
        return out


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """bucket, context, again, doc_id, text_key, start, starts of (doc_id, text_key, text) rows; again: the least hash occurs twice in it."""
    w = length - GRAM + 1

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                for lo, hi, d, o in K.chunks(*K.utf8(batch.column(2))):
                    yield ids[lo:hi], keys[lo:hi], d, o
        K.release()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, data, offs in chunks(batches):
            size = offs[1:] - offs[:-1]
            long = size >= length
            if not long.any():
                continue
            c = K.prefix(data)
            h = K.window_hash(c, GRAM)
            least = K.sliding(h, w, np.minimum, 2**64 - 1)
            start = K.expand(offs[:-1][long], size[long] - length + 1)
            own = least[start]
            new = np.ones(len(start), bool)
            new[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(new)
            lo = start[at]
            runs = np.diff(np.append(at, len(start)))
            bucket = own[at]
            # least hashes that occur twice in a context
            most = K.sliding(np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64))), w, np.maximum, 0)
            spot = np.flatnonzero(h == most)
            every, code = np.unique(np.concatenate((h[spot], bucket)), return_inverse=True)
            key = np.sort(code[: len(spot)] * len(data) + spot)
            mine = code[len(spot) :] * len(data)
            again = np.searchsorted(key, mine + lo + runs + w - 1) - np.searchsorted(key, mine + lo) > 1
            row = np.searchsorted(offs, lo, "right") - 1
            context = K.span_hash(c, lo, lo + runs + length - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(context.view(np.int64)), pa.array(again), pa.array(ids[row]), pa.array(keys[row]), pa.array((lo - offs[row]).astype(np.int32)), pa.array(runs.astype(np.int32))], ["bucket", "context", "again", "doc_id", "text_key", "start", "starts"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(scan, "bucket long, context long, again boolean, doc_id long, text_key int, start int, starts int")


def _fetch(source: DataFrame, keys: list[str], wanted: DataFrame, length: int) -> DataFrame:
    """bucket, context, starts, copies, anchor, hot, data of wanted rows; source: keys and ``data`` (binary). Rows whose bytes are not
    those of their context (an id that two texts share) are left out."""
    item = F.struct("bucket", "context", "start", "starts", "copies", "anchor", "hot")
    lists = wanted.groupBy(*(F.col(k).alias(f"w_{k}") for k in keys)).agg(F.collect_list(item).alias("want"))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.raw(batch.column(0))
            want = batch.column(1)
            each = want.flatten()
            row = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
            first = each.field(2).to_numpy().astype(np.int64)
            bytes_ = each.field(3).to_numpy().astype(np.int64) + length - 1
            fits = np.flatnonzero(first + bytes_ <= np.diff(offs)[row])
            each, start, bytes_ = each.take(pa.array(fits)), (offs[row] + first)[fits], bytes_[fits]
            edges = np.concatenate(([0], np.cumsum(bytes_)))
            lo = 0
            while lo < len(fits):
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + K.CHUNK_BYTES, "right")) - 1)
                blob = data[K.expand(start[lo:hi], bytes_[lo:hi])]
                at = edges[lo : hi + 1] - edges[lo]
                part = each.slice(lo, hi - lo)
                same = K.span_hash(K.prefix(blob), at[:-1], at[1:]).view(np.int64) == part.field(1).to_numpy()
                values = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(blob)])
                names = ["bucket", "context", "starts", "copies", "anchor", "hot"]
                out = pa.RecordBatch.from_arrays([*(part.field(x) for x in names), values], [*names, "data"])
                yield out if same.all() else out.filter(pa.array(same))
                lo = hi

    pairs = [F.col(k) == F.col(f"w_{k}") for k in keys]
    return source.join(lists, pairs).select("data", "want").mapInArrow(bytes_of, "bucket long, context long, starts int, copies long, anchor int, hot boolean, data binary")


def _pieces(rows: DataFrame, length: int, size: int) -> DataFrame:
    """Fetched contexts cut into runs of at most ``size`` starts: p_bucket, p_context, start and places (in that context) and a bucket,
    context, starts, copies, anchor of its own.

    Equal strings hold their bucket's window, at its first place, at the same distance. Runs are aligned by that distance, and the new bucket
    is the hash of what all strings of a run share, so equal strings of one bucket meet again, with fewer others the smaller the size. Equal
    runs of one context (a line that it repeats gives one for each time) are one row with all their places, the first of which is ``start``.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.raw(batch.column(5))
            for lo, hi, d, o in K.chunks(data, offs):
                bucket, context, starts, copies, anchor = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in range(5))
                c = K.prefix(d)
                item = np.repeat(np.arange(hi - lo), starts)
                pos = K.expand(o[:-1], starts)
                if (anchor < 0).any():  # still whole contexts: the first window of the bucket in each string
                    windows = starts.astype(np.int64) + length - GRAM
                    at = K.expand(o[:-1], windows)
                    match = K.window_hash(c, GRAM)[at] == np.repeat(bucket.view(np.uint64), windows)
                    ahead = np.minimum.accumulate(np.where(match, np.arange(len(at)), len(at) - 1)[::-1])[::-1]
                    window = at[ahead[K.expand(np.cumsum(windows) - windows, starts)]]
                else:
                    window = o[:-1][item] + anchor[item]
                step = (window - pos) // size
                new = np.ones(len(pos), bool)
                new[1:] = (item[1:] != item[:-1]) | (window[1:] != window[:-1]) | (step[1:] != step[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(pos)))
                own, s, w, k = item[at], pos[at], window[at], step[at]
                core = K.span_hash(c, w - k * size, w - np.minimum(k * size + size - 1, length - GRAM) + length)
                whole = K.span_hash(c, s, s + n + length - 1)
                fresh = K.mix(core + k.astype(np.uint64))
                order = np.lexsort((s, whole, fresh, own))
                own, s, n, fresh, whole, gap = (x[order] for x in (own, s, n, fresh, whole, w - s))
                first = np.ones(len(own), bool)
                first[1:] = (own[1:] != own[:-1]) | (fresh[1:] != fresh[:-1]) | (whole[1:] != whole[:-1])
                f = np.flatnonzero(first)
                many = np.diff(np.append(f, len(own)))
                places = (s - o[own]).astype(np.int32)
                named = {
                    "p_bucket": bucket[own[f]], "p_context": context[own[f]], "start": places[f], "places": pa.ListArray.from_arrays(np.append(f, len(own)).astype(np.int32), pa.array(places)), "bucket": fresh[f].view(np.int64),
                    "context": whole[f].view(np.int64), "starts": n[f].astype(np.int32), "copies": copies[own[f]] * many, "anchor": gap[f].astype(np.int32),
                }
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in named.values()], list(named))

    columns = rows.select("bucket", "context", "starts", "copies", "anchor", "data")
    return columns.mapInArrow(cut_up, "p_bucket long, p_context long, start int, places array<int>, bucket long, context long, starts int, copies long, anchor int")


RANGES = "array<struct<lo:int,hi:int>>"


def _index(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """bucket, context, ranges: the starts of each context whose strings occur in the bucket at another place, as (lo, hi) in order."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []

        def build() -> pa.RecordBatch | None:
            sizes = np.array([len(x[3]) for x in held])
            offs = np.concatenate(([0], np.cumsum(sizes)))
            index = RunIndex(np.frombuffer(b"".join(x[3] for x in held), np.uint8), offs)
            runs = np.array([x[2] for x in held])
            place = K.expand(index.starts, runs)
            hit = index.matching_statistics()[place] >= length
            text = np.repeat(np.arange(len(held)), runs)[hit]
            rel = (place - np.repeat(index.starts, runs))[hit]
            if not len(text):
                return None
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (rel[1:] != rel[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(text)) - 1
            own, many = np.unique(text[a], return_counts=True)
            each = pa.StructArray.from_arrays([pa.array(rel[a].astype(np.int32)), pa.array(rel[b].astype(np.int32))], ["lo", "hi"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), each)
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in own], pa.int64()), pa.array([held[i][1] for i in own], pa.int64()), lists], ["bucket", "context", "ranges"])

        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= BLOCK_BYTES and row[0] != last:
                    if (out := build()) is not None:
                        yield out
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row[3])
                last = row[0]
        if held and (out := build()) is not None:
            yield out
        held.clear()
        K.release()

    dealt = rows.select("bucket", "context", "starts", "data").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(marks, f"bucket long, context long, ranges {RANGES}")


def _joined(marks: DataFrame) -> DataFrame:
    """One row a context with its ranges in order, touching ones made one. A context has at most as many ranges as starts, whatever the
    number of texts that it occurs in."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = batch.column(2).flatten()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            lo, hi = (each.field(k).to_numpy().astype(np.int64) for k in range(2))
            order = np.lexsort((lo, row))
            row, lo, hi = row[order], lo[order], hi[order]
            step = int(hi.max(initial=0)) + 3  # rows lie apart, so a running maximum stays in its row
            reach = np.maximum.accumulate(hi + row * step)
            new = np.ones(len(row), bool)
            new[1:] = lo[1:] + row[1:] * step > reach[:-1] + 1
            first = np.flatnonzero(new)
            ends = reach[np.append(first[1:], len(row)) - 1] - row[first] * step
            made = pa.StructArray.from_arrays([pa.array(lo[first].astype(np.int32)), pa.array(ends.astype(np.int32))], ["lo", "hi"])
            at = np.searchsorted(row[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), made)], ["bucket", "context", "ranges"])

    every = marks.groupBy("bucket", "context").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return every.mapInArrow(merge, f"bucket long, context long, ranges {RANGES}")


def _marks(source: DataFrame, keys: list[str], live: DataFrame, length: int, sizes: tuple[int, ...], hot_bytes: int, made: list[DataFrame]) -> DataFrame:
    """bucket, context, ranges: those of the starts of each context of ``live`` whose strings occur elsewhere in its bucket.

    Buckets of up to ``hot_bytes`` get an index. Larger ones are split by ``_pieces`` and marked in the same way; at the last size, 1, a
    bucket is one string, and counts decide. ``made`` gets the tables that are needed until the result is written.
    """
    parts = partitions(source.sparkSession)
    whole = lambda n: F.array(F.struct(F.lit(0).alias("lo"), (n - 1).cast("int").alias("hi")))
    one = F.min(F.struct(*keys, "start", "starts", "anchor")).alias("one")
    kinds = live.groupBy("bucket", "context").agg(F.sum("copies").alias("copies"), F.max("again").alias("again"), one)
    kinds = cut(kinds.select("bucket", "context", "copies", "again", "one.*"), "context-kinds")
    size = F.sum(F.col("starts").cast("long") + length - 1)
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.col("again") & (F.col("copies") == 1)).alias("any"), F.min("copies").alias("fewest"), (size > hot_bytes).alias("hot"))
    mixed = cut(mixed.filter("(n > 1 and fewest = 1) or any").select("bucket", "hot"), "mixed-buckets")
    bytes_ = cut(_fetch(source, keys, kinds.join(mixed, "bucket"), length), "context-bytes")
    made += [kinds, mixed, bytes_]
    marks = _index(bytes_.filter("not hot"), length, parts)
    hot = bytes_.filter("hot")
    if sizes and not hot.isEmpty():
        pieces = cut(_pieces(hot, length, sizes[0]), "context-pieces")
        made.append(pieces)
        texts = hot.select(F.col("bucket").alias("p_bucket"), F.col("context").alias("p_context"), "data")
        if sizes[0] == 1:  # a bucket is one string: its copies decide
            twice = pieces.groupBy("bucket").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("bucket")
            back = pieces.join(twice, "bucket", "left_semi").withColumn("ranges", whole(F.lit(1)))
        else:
            below = _marks(texts, ["p_bucket", "p_context"], pieces.withColumn("again", F.lit(False)), length, sizes[1:], hot_bytes, made)
            back = pieces.select("p_bucket", "p_context", "places", "bucket", "context").join(below, ["bucket", "context"])
        moved = F.flatten(F.transform("places", lambda p: F.transform("ranges", lambda r: F.struct((p + r["lo"]).alias("lo"), (p + r["hi"]).alias("hi")))))
        back = back.select(F.col("p_bucket").alias("bucket"), F.col("p_context").alias("context"), moved.alias("ranges"))
        marks = marks.unionByName(_joined(back))
    repeated = kinds.filter("copies > 1").select("bucket", "context", whole(F.col("starts")).alias("ranges"))
    return marks.join(repeated, ["bucket", "context"], "left_anti").unionByName(repeated)


def text_key(text: str | Column = "text") -> Column:
    """Tells texts of one id apart."""
    return F.pmod(F.xxhash64(text), F.lit(2**31 - 1)).cast("int")


def repeated_spans(docs: DataFrame, length: int, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, text_key, ranges (first start, last start, context's start): what strings of ``length`` bytes with another occurrence cover,
    of (doc_id, text_key, text) rows; they may overlap.

    Bucket lists and marks are tables of their own, so that joins with them have nothing but a scan on that side: small ones are
    broadcast within Spark's size bound, and for others a hot bucket's rows can be split while the query runs.
    """
    found = cut(contexts(docs, length), "contexts")
    buckets = found.groupBy("bucket").agg(F.count("*").alias("rows"), F.max("again").alias("any")).filter("rows > 1 or any").select("bucket")
    buckets = cut(buckets, "buckets")
    live = cut(found.join(buckets, "bucket", "left_semi"), "live-contexts")
    drop(found)
    texts = docs.filter("text is not null").select("doc_id", "text_key", F.col("text").cast("binary").alias("data"))
    sizes = tuple(x for x in SPLITS if x < length - GRAM) if length - GRAM > 1 else (1,)
    made = [buckets]
    marks = cut(_marks(texts, ["doc_id", "text_key"], live.withColumns({"copies": F.lit(1), "anchor": F.lit(-1)}), length, sizes, hot_bytes, made), "marks")
    drop(*made)
    hit = live.select("bucket", "context", "doc_id", "text_key", "start").join(marks, ["bucket", "context"])
    spans = F.transform("ranges", lambda r: F.struct((F.col("start") + r["lo"]).alias("lo"), (F.col("start") + r["hi"] + length).alias("hi")))
    return hit.select("doc_id", "text_key", spans.alias("spans"))


def _cut_text(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in runs]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of lo, hi), kept (binary): each text without the bytes that repeated strings cover."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", text_key())
    spans = repeated_spans(rows, length, hot_bytes).groupBy(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key")).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out: list[tuple] = []
                for doc, text, own in zip(*(part.column(i).to_pylist() for i in range(3))):
                    data = (text or "").encode()
                    kept, runs = _cut_text(data, [(x["lo"], x["hi"]) for x in own or ()])
                    out.append((doc, len(data), len(data) - len(kept), [{"lo": a, "hi": b} for a, b in runs], kept))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), y) for x, y in zip(zip(*out), KINDS)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.join(spans, (F.col("doc_id") == F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left").select("doc_id", "text", "spans").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, kept binary")


def word_codes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text of such rows: ``WORD_BYTES`` ASCII signs of the hash of each word. Words are runs of letters and digits in
    lower case, so runs of equal words are equal strings however long the words are, and whatever stands between them."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            data, offs = K.utf8(batch.column(2))
            for lo, hi, d, o in K.chunks(data, offs):
                yield codes(ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), d, o)
        K.release()

    def codes(ids: pa.Array, keys: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        start, end, row = K.words(data, offs, K.NOT_WORD)
        h = K.span_hash(K.prefix(K.LOWER[data]), start, end)
        signs = (h[:, None] >> np.arange(0, 7 * WORD_BYTES, 7, dtype=np.uint64) & np.uint64(127)).astype(np.uint8)
        edges = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(ids))))) * WORD_BYTES
        text = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(signs.tobytes())])
        return pa.RecordBatch.from_arrays([ids, keys, text], ["doc_id", "text_key", "text"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(code, "doc_id long, text_key int, text string")


def _of_words(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of the words that spans of the text's word codes hold in full."""
    start, end, _ = K.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), K.NOT_WORD)
    whole = [(-(-lo // WORD_BYTES), hi // WORD_BYTES - 1) for lo, hi in spans]
    return [(int(start[a]), int(end[b])) for a, b in whole if b < len(end)]


def strip_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """docs, all columns, with the bytes that repeated strings cover cut from the text; with ``words``, runs of so many words that occur
    elsewhere are cut too, however short. Texts that lose everything go, with ``words`` those that lose every word; where a cut divides a
    character, its rest goes too. Rows without id are left out. The text is shuffled once."""
    rows = docs.filter(F.col(id_col).isNotNull())
    source = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", text_key())
    spans = repeated_spans(source, length).withColumn("of_words", F.lit(False))
    if words:
        codes = cut(word_codes(source), "word-codes")
        spans = spans.unionByName(repeated_spans(codes, words * WORD_BYTES).withColumn("of_words", F.lit(True)))
        drop(codes)
    marked = F.transform("spans", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.col("of_words").alias("of_words")))
    lists = spans.select("doc_id", "text_key", marked.alias("spans")).groupBy(F.col("doc_id").alias("_s_id"), F.col("text_key").alias("_s_key")).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("_spans"))
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, keep = [], []
                for text, own in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    if own:
                        data = text.encode()
                        cuts = [(x["lo"], x["hi"]) for x in own if not x["of_words"]]
                        if words:
                            cuts += _of_words(data, [(x["lo"], x["hi"]) for x in own if x["of_words"]])
                        kept, _ = _cut_text(data, cuts)
                        keep.append(not K.NOT_WORD[np.frombuffer(kept, np.uint8)].all() if words else bool(kept))
                        texts.append(kept.decode("utf-8", "ignore"))
                    else:
                        keep.append(True)
                        texts.append(text)
                arrays = [part.column(i) if i != at else pa.array(texts, part.schema.field(at).type) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names[:-1]).filter(pa.array(keep))

    own = (rows[id_col].cast("long") == lists["_s_id"]) & (text_key(rows[text_col].cast("string")) == lists["_s_key"])
    joined = rows.join(lists, own, "left").select(*(rows[c] for c in rows.columns), "_spans")
    return joined.mapInArrow(apply, docs.schema)


KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.binary())


def digest(kept: DataFrame) -> DataFrame:
    """The thin query's columns."""
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
