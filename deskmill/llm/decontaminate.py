"""Benchmark decontamination: rare n-grams as seeds, then Smith-Waterman alignment.

1. A seed is a gapped 2-gram: two words in order, next to each other or with one word between. Every one of the items is looked up in the
   corpus once, for its frequency there.
2. Between two words of an item that an alignment matches one after the other, ``a`` words of the item and ``b`` of the text may be left out, which
   costs max(a, b). So an alignment of ``score`` leaves two or more out at no more than half of what it may lose, and at least
   ceil(score / 2) - 1 of an item's words start a gapped 2-gram that the text has too: they survive. Of the ``m - 1`` words that can
   start one, an item offers the 2-grams of the rarest ones, so many that ``few`` of any surviving set are among them. Where none need
   survive (items of one or two words), its seeds are single words, of which an alignment holds ``need``.
3. A second scan finds texts with ``few`` seeds of an item within the longest span of such an alignment. Everything that an alignment
   with them can reach makes one window of the text.
4. A window whose words cannot reach the score in any order is left out; with the others the item is aligned word by word. All
   alignments of a chunk step together along anti-diagonals, where their cells are independent.

So no alignment of that share is lost: the result is that of aligning every item with every text.

Items come in blocks of at most ``BLOCK_WORDS`` words, so what is sent to the tasks is bounded; texts are never shuffled.
Words are lower-cased runs of letters and digits, so case and punctuation do not matter.

The corpus is read twice for each block of items; README has the cost.

Rows: null texts and items match nothing, and neither do items under ``n`` words. Rows without id are left out. A repeated document id or
item id has several texts, all are searched, and the best match counts. Ties in score take the first window. Very long texts are searched
whole. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm import kernels as K

BLOCK_WORDS = 500_000
HITS = 1_000_000  # (place in the text, item) rows that are expanded at a time
WINDOW_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of lower-cased bytes."""
    start, end, row = K.words(data, offs, K.NOT_WORD)
    return K.span_hash(K.prefix(data), start, end), row


def _of_item(word: np.ndarray, item: np.ndarray) -> np.ndarray:
    return K.mix(word + K.mix(item.astype(np.uint64)))


class Items:
    """A block of items: word hashes, and seeds as distinct (hash, item) sorted by hash. Until ``keep_rare`` all words are seeds."""

    def __init__(self, ids: list[int], texts: list[str], n: int, least: float) -> None:
        data, offs = K.utf8(pc.utf8_lower(pa.array(texts, pa.string())))
        self.word, self.row = _words(data, offs)
        self.ids = np.array(ids, np.int64)
        self.size = np.bincount(self.row, minlength=len(ids)).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        score = np.maximum(np.ceil(2 * self.size * least - 1e-9).astype(np.int64), 1)  # matches count 2, everything else costs 1
        need = (score + 1) // 2
        survive = (score + 1) // 2 - 1
        self.paired = survive > 0
        self.few = np.minimum(np.where(self.paired, survive, need), self.size // 8 + 1)
        self.span = 3 * self.size - score  # all words matched, and so many more between them that the score is just reached
        self.seeds = np.where(self.paired, self.size - 1 - survive, self.size - need) + self.few  # words that start them, or single words
        self.score, self.need = score, need
        key = np.sort(_of_item(self.word, self.row))
        at = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        self.kind, self.times = key[at], np.diff(np.append(at, len(key)))  # words of each item, and how often it has them
        long = (self.size >= n)[self.row]
        pair, at = pairs(self.word, self.row)
        ok = (long & self.paired[self.row])[at]
        single = np.flatnonzero(long & ~self.paired[self.row])
        self.gram, self.start = np.concatenate((pair[ok], self.word[single])), np.concatenate((at[ok], single))
        self._keep(self.gram, self.row[self.start])

    def _keep(self, word: np.ndarray, item: np.ndarray) -> None:
        order = np.lexsort((item, word))
        word, item = word[order], item[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (item[1:] != item[:-1])
        self.seed, self.item = word[new], item[new]

    def keep_rare(self, every: np.ndarray, times: np.ndarray) -> None:
        """Keep the n-grams of the ``seeds`` words of each item whose n-grams are rarest; ``times``: how often each of the sorted n-grams
        ``every`` occurs in the corpus."""
        if not len(self.gram):
            return
        often = np.bincount(self.start, times[np.searchsorted(every, self.gram)], len(self.word))
        word = np.unique(self.start)
        word = word[np.lexsort((word, often[word], self.row[word]))]
        item = self.row[word]
        rare = np.zeros(len(self.word), bool)
        rare[word[np.arange(len(item)) - np.searchsorted(item, item) < self.seeds[item]]] = True
        keep = rare[self.start]
        self._keep(self.gram[keep], self.row[self.start[keep]])


def pairs(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of two words of a row in order, with at most one between, and the place of the first, by place."""
    out, at = [], []
    for gap in (1, 2):
        ok = np.flatnonzero(row[gap:] == row[:-gap]) if len(row) > gap else np.empty(0, np.int64)
        out.append(K.mix(word[ok] * np.uint64(0x9E3779B97F4A7C15) + word[ok + gap]))
        at.append(ok)
    at_all = np.concatenate(at)
    order = np.argsort(at_all, kind="stable")
    return np.concatenate(out)[order], at_all[order]


def _hits(word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that occur in sorted ``seed``, and the first index there."""
    if not len(word) or not len(seed):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(seed, word)
    at[at == len(seed)] = 0
    hit = np.flatnonzero(seed[at] == word)
    return hit, at[hit]


def expanded(doc: np.ndarray, items: np.ndarray, first: np.ndarray, many: np.ndarray, most: int = HITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hit, item) for hit k of document doc[k] and each of items[first[k] : first[k] + many[k]], in pieces of whole documents of about
    ``most`` rows. A document with more is given for a share of the items at a time; one item's rows in one document stay together."""
    edges = np.concatenate(([0], np.cumsum(many)))
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)) if len(doc) else np.empty(0, np.int64)
    lo = 0
    while lo < len(doc):
        k = int(np.searchsorted(edges[ends], edges[lo] + most, "right")) - 1
        hi = int(ends[max(k, int(np.searchsorted(ends, lo, "right")))])
        shares = -(-int(edges[hi] - edges[lo]) // most)
        for share in range(shares):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            a = lo
            while a < hi:
                b = min(hi, max(a + 1, int(np.searchsorted(edges, edges[a] + most, "right")) - 1))
                item, hit = items[K.expand(first[a:b], many[a:b])], np.repeat(np.arange(a, b), many[a:b])
                mine = item % shares == share
                found.append((hit[mine], item[mine]))
                a = b
            yield np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        lo = hi


def reachable(items: Items, item: np.ndarray, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether word[lo:hi], put in any order, could reach its item's score. Two bounds: a span scores at most MATCH for each word
    that the item has and MISMATCH for each other; and a word matches at most as often as the item has it."""
    out = np.zeros(len(item), bool)
    edges = np.concatenate(([0], np.cumsum(hi - lo)))
    k = 0
    while k < len(item):
        top = max(k + 1, int(np.searchsorted(edges, edges[k] + WINDOW_WORDS, "right")) - 1)
        size = (hi - lo)[k:top]
        of = np.repeat(np.arange(top - k), size)
        key = _of_item(word[K.expand(lo[k:top], size)], item[k:top][of])
        at = np.searchsorted(items.kind, key)
        at[at == len(items.kind)] = 0
        has = items.kind[at] == key
        total = np.cumsum(np.where(has, MATCH, MISMATCH))
        before = total - np.where(has, MATCH, MISMATCH)
        drop = of * (4 * len(of) + 4)  # later windows lie below all earlier ones, so a running least stays within its window
        rise = total - drop - np.minimum.accumulate(before - drop)
        begin = edges[k:top] - edges[k]
        enough = np.maximum.reduceat(rise, begin) >= items.score[item[k:top]]
        kinds, count = np.unique(of[has] * len(items.kind) + at[has], return_counts=True)
        matched = np.bincount(kinds // len(items.kind), np.minimum(count, items.times[kinds % len(items.kind)]), top - k)
        out[k:top] = enough & (matched >= items.need[item[k:top]])
        k = top
    return out


def align(items: Items, item: np.ndarray, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with word[lo:hi]: score, and the first and last word of the text that it spans.

    Cells of one anti-diagonal depend on the two before only; every alignment steps at once, in groups of like size.
    """
    score, begin, end = (np.zeros(len(item), np.int64) for _ in range(3))
    m_all, w_all = items.size[item], hi - lo
    order = np.lexsort((w_all, m_all))
    k = 0
    while k < len(order):
        m_top = int(m_all[order[k]] * 5 // 4 + 8)
        group = order[k : k + max(16, 4_000_000 // (m_top * 16))]
        group = group[m_all[group] <= m_top]
        k += len(group)
        m, w = int(m_all[group].max()), int(w_all[group].max())
        rows = np.arange(m)
        a = np.where(rows < m_all[group][:, None], items.word[np.minimum(items.first[item[group]][:, None] + rows, len(items.word) - 1)], np.uint64(0))
        cols = np.arange(w)
        b = np.where(cols < w_all[group][:, None], word[np.minimum(lo[group][:, None] + cols, len(word) - 1)], np.uint64(1))
        shape = (len(group), m + 1)
        one, two = np.zeros(shape, np.int32), np.zeros(shape, np.int32)  # anti-diagonals d - 1 and d - 2, by item row
        from_one, from_two = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        best, best_from, best_to = (np.zeros(len(group), np.int64) for _ in range(3))
        padded = np.full((len(group), w + 2 * m), np.uint64(1))
        padded[:, m : m + w] = b
        for d in range(m + w - 1):  # cell (i, j) with i + j = d
            i = rows + 1
            col = d - rows
            inside = (col >= 0) & (col < w)
            same = (a == padded[:, m + col.clip(-m, w + m - 1)]) & inside
            diagonal = two[:, i - 1] + np.where(same, MATCH, MISMATCH)
            start = np.where(two[:, i - 1] > 0, from_two[:, i - 1], col)
            up, left = one[:, i - 1] + GAP, one[:, i] + GAP
            value = diagonal
            better = up > value
            value, start = np.where(better, up, value), np.where(better, from_one[:, i - 1], start)
            better = left > value
            value, start = np.where(better, left, value), np.where(better, from_one[:, i], start)
            value = np.where(inside & (value > 0), value, 0)
            two, from_two = one, from_one
            one, from_one = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
            one[:, 1:], from_one[:, 1:] = value, start
            top = value.argmax(axis=1)
            v = value[np.arange(len(group)), top]
            more = v > best
            best = np.where(more, v, best)
            best_from = np.where(more, start[np.arange(len(group)), top], best_from)
            best_to = np.where(more, d - top + 1, best_to)
        score[group], begin[group], end[group] = best, lo[group] + best_from, lo[group] + best_to
    return score, begin, end


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score (alignment score over that of a perfect copy, ``least`` or more), start_word, end_word (end excluded):
    each document's best alignment with each item."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    found = None
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"] or "")
        size += len(texts[-1]) // 2 + 1
        if size >= BLOCK_WORDS:
            block = _matches(rows, Items(ids, texts, n, least), least)
            found = block if found is None else found.unionByName(block)
            ids, texts, size = [], [], 0
    block = _matches(rows, Items(ids, texts, n, least), least)
    found = block if found is None else found.unionByName(block)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("s"), "start_word", "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word")


def _matches(rows: DataFrame, items: Items, least: float) -> DataFrame:
    every = np.unique(items.seed)
    singles = bool((~items.paired)[items.item].any())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(every), np.int64)
        for _, data, offs in K.documents(batches, lower=True):
            word, row = _words(data, offs)
            total += np.bincount(_hits(pairs(word, row)[0], every)[1], minlength=len(every))
            if singles:
                total += np.bincount(_hits(word, every)[1], minlength=len(every))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "times"])

    if len(every):  # at most 2 * BLOCK_WORDS rows
        times = np.zeros(len(every), np.int64)
        for r in rows.mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times")).collect():
            times[r["word"]] = r["times"]
        items.keep_rare(every, times)

    def windows(word: np.ndarray, row: np.ndarray, hit: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, item and words [lo, hi) of what alignments with ``few`` seeds can reach, from (place, item) hits of whole documents."""
        key = row[hit].astype(np.int64) * len(items.ids) + item
        order = np.lexsort((hit, key))
        key, item, hit = key[order], item[order], hit[order]
        last = np.arange(len(hit)) + items.few[item] - 1  # the hit that makes them enough
        start = np.flatnonzero(last < len(hit))
        start = start[(key[last[start]] == key[start]) & (hit[last[start]] - hit[start] < items.span[item[start]])]
        key, item, doc = key[start], item[start], row[hit[start]]
        lo = np.maximum(hit[last[start]] - items.span[item] + 1, np.searchsorted(row, doc))
        hi = np.minimum(hit[start] + items.span[item], np.searchsorted(row, doc, "right"))
        new = np.ones(len(lo), bool)  # windows of one item that start near each other are one
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] > lo[:-1] + items.size[item[1:]] // 4 + 4)
        head = np.flatnonzero(new)
        if len(head):
            hi = np.maximum.reduceat(hi, head)
        return doc[head], item[head], lo[head], hi

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, first, many = np.unique(items.seed, return_index=True, return_counts=True)
        for ids, data, offs in K.documents(batches, lower=True):
            word, row = _words(data, offs)
            gram, place = pairs(word, row)
            found, at = _hits(gram, seeds)
            hit = place[found]
            if singles:
                alone, more = _hits(word, seeds)
                order = np.argsort(np.concatenate((hit, alone)), kind="stable")
                hit, at = np.concatenate((hit, alone))[order], np.concatenate((at, more))[order]
            for part, item in expanded(row[hit], items.item, first[at], many[at]):
                doc, item, lo, hi = windows(word, row, hit[part], item)
                if not len(doc):
                    continue
                ok = reachable(items, item, word, lo, hi)
                doc, item, lo, hi = doc[ok], item[ok], lo[ok], hi[ok]
                score, begin, end = align(items, item, word, lo, hi)
                share = score / (MATCH * items.size[item])
                ok = share >= least
                base = np.searchsorted(row, doc[ok])
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[ok]]), pa.array(items.ids[item[ok]]), pa.array(share[ok]), pa.array(begin[ok] - base), pa.array(end[ok] - base)], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return rows.mapInArrow(scan, "doc_id long, item_id long, score double, start_word long, end_word long")
