"""Packing by order-preserving dynamic programming.

Documents keep their order in each partition and form one stream of ids. Sequences are cut from it at candidate cuts: document
ends (free), sentence ends, and word ends (dearer), of which every ``grid``-th id of a document offers one. With f(j) the least cost of
the ids before cut j,

    f(j) = penalty(j) + min(f(i) + padding(j - i))    over cuts i at most ``size`` ids before j,

and as padding is ``size - (p_j - p_i)``, the best i minimises f(i) + p_i over a sliding window: a monotone queue gives it in
constant time. A sequence whose length is a power of two has no padding; those transitions, of every power, are looked up beside the
queue. The recurrence runs through the whole partition: sequences are written as soon as every cut that can still be followed leads back
to them, so the result does not depend on how the stream is read. The rest of a partition becomes sequences of powers of two, or one
padded sequence, whichever costs less. No id is moved between partitions: there is no shuffle.

Rows: a null or empty text has only the end id. Rows without id are left out; repeated rows are packed each. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm import kernels as K
from deskmill.llm.tokens import Encoder

SENTENCE, WORD, HARD = 4, 12, 24  # penalties, in ids of padding
SHORT = 32  # what a sequence of a power of two below the full size costs, as it takes a place of its own
GRID = 8  # ids of a document of which one word end is a candidate; README has the padding at other values


class Cuts:
    """The recurrence over a stream of candidate cuts, from place 0 on; neighbouring cuts are at most ``size`` apart."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.powers = np.array([1 << k for k in range(size.bit_length()) if 1 << k < size], np.int64)
        self.place, self.cost, self.back = [0], [0], [0]  # of the cuts from the last decided one on
        self.queue: deque[int] = deque([0])

    def feed(self, places: list[int], penalties: list[int]) -> None:
        """More cuts, by place."""
        size, place, cost, back, queue = self.size, self.place, self.cost, self.back, self.queue
        n = len(place)
        if not places:
            return
        every = np.array(place + places, np.int64) - place[0]
        which = np.full(every[-1] + 1, -1, np.int32)  # the cut at a place
        which[every] = np.arange(len(every), dtype=np.int32)
        at = every[n:, None] - self.powers
        found = which[at.clip(0)]  # cuts a power of two before each cut
        found[at < 0] = -1
        short: list[int] = found[found >= 0].tolist()
        ends = np.cumsum((found >= 0).sum(axis=1)).tolist()
        keys = [c + p for c, p in zip(cost, place)]  # a cut's cost with its place
        done, m = 0, n
        for p, penalty, end in zip(places, penalties, ends):
            far = p - size
            while place[queue[0]] < far:
                queue.popleft()
            i = queue[0]
            best = keys[i] - far
            if done < end:
                for h in short[done:end]:
                    if cost[h] + SHORT < best:
                        best, i = cost[h] + SHORT, h
                done = end
            best += penalty
            key = best + p
            while queue and keys[queue[-1]] >= key:
                queue.pop()
            queue.append(m)
            m += 1
            place.append(p)
            cost.append(best)
            keys.append(key)
            back.append(i)

    def decided(self) -> list[int]:
        """Places that every cut which can still be followed leads back to, after those given before."""
        place, back = self.place, self.back
        first = len(place) - 1
        while first and place[first - 1] >= place[-1] - self.size:
            first -= 1
        heap = [-x for x in range(first, len(place))]  # walk back from the last until one cut is left
        heapq.heapify(heap)
        last = 0
        while heap:
            x = -heapq.heappop(heap)
            while heap and heap[0] == -x:
                heapq.heappop(heap)
            if not heap:
                last = x
                break
            heapq.heappush(heap, -back[x])
        found = self._path(last)
        if last:
            self.queue = deque(x - last for x in self.queue if x >= last)
            base = self.cost[last]
            self.place, self.cost, self.back = place[last:], [x - base for x in self.cost[last:]], [max(0, x - last) for x in back[last:]]
        return found

    def rest(self) -> list[int]:
        """The places of the best way to the last cut."""
        return self._path(len(self.place) - 1)

    def _path(self, k: int) -> list[int]:
        out = []
        while k:
            out.append(self.place[k])
            k = self.back[k]
        return out[::-1]


def best_cuts(place: list[int], penalty: list[int], size: int) -> tuple[list[int], int]:
    """The chosen places and their cost, from place[0] = 0 to place[-1]; neighbours are at most ``size`` apart."""
    cuts = Cuts(size)
    cuts.feed(place[1:], penalty[1:])
    return [0, *cuts.rest()], cuts.cost[-1]


def tail_lengths(rest: int, size: int) -> list[int]:
    """The last ids of a partition as one padded sequence or as powers of two."""
    bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return bits if rest == size or (len(bits) - 1) * HARD < size - rest else [rest]


def _candidates(unit_ids: np.ndarray, unit_row: np.ndarray, sentence: np.ndarray, doc_ids: np.ndarray, size: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut places of whole documents' ids and their penalties; doc_ids: ids of each document with its end id."""
    doc_end = np.cumsum(doc_ids)
    place = np.cumsum(unit_ids) + unit_row  # each row before has one end id
    block = (place - (doc_end - doc_ids)[unit_row]) // grid
    head = np.ones(len(place), bool)
    head[1:] = (block[1:] != block[:-1]) | (unit_row[1:] != unit_row[:-1])
    keep = head | sentence
    spots = np.concatenate((place[keep], doc_end))
    cost = np.concatenate((np.where(sentence[keep], SENTENCE, WORD), np.zeros(len(doc_end), np.int64)))
    order = np.lexsort((cost, spots))
    spots, cost = spots[order], cost[order]
    new = np.ones(len(spots), bool)
    new[1:] = spots[1:] != spots[:-1]
    spots, cost = spots[new], cost[new]
    gap = np.diff(spots, prepend=0)
    wide = np.flatnonzero(gap > size // 2)
    if len(wide):
        more = np.concatenate([np.arange(spots[k] - gap[k] + size // 2, spots[k], size // 2) for k in wide])
        spots, cost = np.concatenate((spots, more)), np.concatenate((cost, np.full(len(more), HARD)))
        order = np.argsort(spots, kind="stable")
        spots, cost = spots[order], cost[order]
    return spots, cost


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, grid: int = GRID, chunk: int = K.CHUNK_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (of its sequence), and ids if asked.
    ``chunk``: bytes of text that are read at a time; it does not change the result."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding", *["ids"] * with_ids]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.of(vocabulary)
        sequence = TaskContext.get().partitionId() << 32
        cuts = Cuts(size)
        base = at = 0  # ids before this chunk, and before the first piece that is held
        held: list[tuple[int, int, np.ndarray, int]] = []  # id, start, ids, ids of the document

        def rows(ends: list[int]) -> pa.RecordBatch:
            nonlocal sequence, at
            out: list[list] = [[] for _ in names]
            k, used = 0, 0
            for end in ends:
                length = left = end - at
                pad = 0 if length & (length - 1) == 0 else size - length
                while left:
                    doc, start, ids, total = held[k]
                    take = min(left, len(ids) - used)
                    part = ids[used : used + take]
                    row = [doc, start + used, take, zlib.crc32(part.astype("<u4").tobytes()), total, sequence, length - left, pad, *[part.tolist()] * with_ids]
                    for column, value in zip(out, row):
                        column.append(value)
                    left -= take
                    used += take
                    if used == len(ids):
                        k, used = k + 1, 0
                at = end
                sequence += 1
            held[:] = [(d, s + (used if m == 0 else 0), i[used if m == 0 else 0 :], t) for m, (d, s, i, t) in enumerate(held[k:])]
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, kinds)], names)

        for ids, data, offs in K.documents(batches, chunk):
            tokens, unit_ids, unit_row, unit_end = encoder.units(data, offs)
            count = np.bincount(unit_row, unit_ids, len(ids)).astype(np.int64)
            full = np.full(len(tokens) + len(ids), end_id, np.uint16)
            doc_ids = count + 1
            ends = np.cumsum(doc_ids)
            mask = np.ones(len(full), bool)
            mask[ends - 1] = False
            full[mask] = tokens
            final = data[unit_end - 1] if len(unit_end) else np.empty(0, np.uint8)
            sentence = np.isin(final, np.frombuffer(b".!?\n", np.uint8))
            follow = np.append(data, 0)[unit_end] if len(unit_end) else final
            sentence |= follow == 10
            spots, cost = _candidates(unit_ids, unit_row, sentence, doc_ids, size, grid)
            cuts.feed((spots + base).tolist(), cost.tolist())
            held += [(int(d), 0, full[b - m : b], int(m)) for d, b, m in zip(ids, ends.tolist(), doc_ids.tolist())]
            base += len(full)
            yield rows(cuts.decided())
        if held:
            *whole, end = cuts.rest()
            last = whole[-1] if whole else at
            yield rows([*whole, *(last + x for x in np.cumsum(tail_lengths(end - last, size)).tolist())])

    kinds = ", ".join(f"{x} long" for x in names[:8]) + ", ids array<int>" * with_ids
    got = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(scan, kinds)
