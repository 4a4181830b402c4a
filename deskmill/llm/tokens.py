"""Token ids of whole texts by the tokenizers library, with a memo of word units.

Both tokenizers cut a text where white space begins before any merging, so ids of a text are the ids of its units
(white space and the word after it; signs after a letter or digit are a unit of their own) in turn. A unit that a worker has seen comes from a bounded memo keyed by its 64-bit
hash, an open-addressing table in NumPy; new units are encoded once per chunk, many in one call. Texts with other white space than ASCII's (a run of both kinds is not cut the
same way) and units over 64 bytes are encoded as they are.
"""

from __future__ import annotations

import os

import numpy as np

from deskmill.llm import kernels as K

MEMO_UNITS = 1_200_000  # about 50 MB a worker
SLOT_BITS = 21
LONG_UNIT = 64
_ALNUM = ~K.NOT_WORD & (np.arange(256) < 128)
#: ASCII signs that never join a letter or digit before them; the apostrophe does ("'s").
_SIGN = K.NOT_WORD & (np.arange(256) > 32) & (np.arange(256) < 127)
_SIGN[39] = False
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: UTF-8 of Unicode's white space beyond ASCII, and the ASCII separators.
_ODD_SPACE = tuple(x.encode() for x in "\x1c\x1d\x1e\x1f\x85\xa0                　")


def odd_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space that ASCII does not have."""
    at = np.flatnonzero(_ODD_LEAD[data])
    if not len(at):
        return at
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    value = padded[at].astype(np.int64) << 16 | padded[at + 1].astype(np.int64) << 8 | padded[at + 2]
    hit = np.zeros(len(at), bool)
    for x in _ODD_SPACE:
        shift = 8 * (3 - len(x))
        hit |= value >> shift == int.from_bytes(x, "big")
    return at[hit]


class Encoder:
    """Ids and lengths of rows of a chunk. One for each worker process and vocabulary file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fold = self.plain(["QUIZ"]) == self.plain(["quiz"])  # the vocabulary lower-cases
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        self.size, self.used = 0, 0
        self.key = np.zeros(1 << SLOT_BITS, np.uint64)  # open addressing; 0 is free
        self.entry = np.zeros(1 << SLOT_BITS, np.int32)
        self.at, self.length = np.zeros(MEMO_UNITS, np.int32), np.zeros(MEMO_UNITS, np.uint16)
        self.pool = np.zeros(4 * MEMO_UNITS, np.uint16)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        left, step = np.arange(len(h)), 0
        while len(left):
            slot = ((h[left] + np.uint64(step)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            key = self.key[slot]
            hit = key == h[left]
            out[left[hit]] = self.entry[slot[hit]]
            left = left[~hit & (key != 0)]
            step += 1
        return out

    def _add(self, h: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """New, distinct hashes with their ids, one after another."""
        if self.size + len(h) > MEMO_UNITS or self.used + len(ids) > len(self.pool):
            self._clear()
        if len(h) > MEMO_UNITS or len(ids) > len(self.pool):
            return
        entry = self.size + np.arange(len(h), dtype=np.int32)
        self.at[entry], self.length[entry] = self.used + np.cumsum(length) - length, length
        self.pool[self.used : self.used + len(ids)] = ids
        self.size, self.used = self.size + len(h), self.used + len(ids)
        left, step = np.arange(len(h)), 0
        while len(left):
            slot = ((h[left] + np.uint64(step)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            mine = np.zeros(len(left), bool)
            mine[first] = True
            mine &= self.key[slot] == 0
            self.key[slot[mine]], self.entry[slot[mine]] = h[left[mine]], entry[left[mine]]
            left = left[~mine]
            step += 1

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of spans one after another, and their number in each. Spans that begin with white space and end with a word are
        joined and encoded together, as they stand in texts; a token's offset tells its span. The others are encoded alone."""
        raw = data.tobytes()
        join = np.zeros(len(start), bool)
        full = end > start
        join[full] = K.SPACE[data[start[full]]] & ~K.SPACE[data[end[full] - 1]]
        size = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # spans, and all their ids
        together = np.flatnonzero(join)
        for lo in range(0, len(together), 512):
            part = together[lo : lo + 512]
            texts = [raw[a:b].decode() for a, b in zip(start[part].tolist(), end[part].tolist())]
            encoding = self.tokenizer.encode("".join(texts), add_special_tokens=False)
            edges = np.cumsum([0, *map(len, texts)])
            offsets = encoding.offsets
            where = np.searchsorted(edges, np.fromiter((x[0] for x in offsets), np.int64, len(offsets)), "right") - 1
            size[part] = np.bincount(where, minlength=len(part))
            found.append((part, np.array(encoding.ids, np.uint16)))
        alone = np.flatnonzero(~join)
        if len(alone):
            ids = self.plain([raw[a:b].decode() for a, b in zip(start[alone].tolist(), end[alone].tolist())])
            size[alone] = np.fromiter(map(len, ids), np.int64, len(ids))
            found.append((alone, np.fromiter((t for x in ids for t in x), np.uint16, int(size[alone].sum()))))
        out = np.empty(int(size.sum()), np.uint16)
        begin = np.cumsum(size) - size
        for part, ids in found:
            out[K.expand(begin[part], size[part])] = ids
        return out, size

    def units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids (uint16), ids of each unit, row of each unit, and each unit's end in ``data``."""
        rows = len(offs) - 1
        _, end, row = K.words(data, offs)
        sign = np.flatnonzero(_ALNUM[data[:-1]] & _SIGN[data[1:]]) + 1
        sign = sign[~np.isin(sign, offs)] if len(sign) else sign
        if len(sign):
            end = np.sort(np.concatenate((end, sign)))
            row = np.searchsorted(offs, end - 1, "right") - 1
        # a unit ends with a word or before signs; white space after the last word is one more
        last = offs[1:].copy()
        has = np.zeros(rows, bool)
        has[row] = True
        final = np.full(rows, -1, np.int64)
        final[row] = end
        tail = np.flatnonzero((last > offs[:-1]) & (~has | (final < last)))
        odd = np.unique(np.searchsorted(offs, odd_space(data), "right") - 1)
        if len(odd):
            keep = ~np.isin(row, odd)
            end, row, tail = end[keep], row[keep], np.setdiff1d(tail, odd)
        ends = np.concatenate((end, last[tail], last[odd]))
        rows_of = np.concatenate((row, tail, odd))
        order = np.argsort(ends, kind="stable")
        end, row = ends[order], rows_of[order]
        start = np.empty(len(end), np.int64)
        if len(end):
            start[0] = offs[row[0]]
            start[1:] = np.where(row[1:] == row[:-1], end[:-1], offs[row[1:]])
        alone = np.isin(row, odd) | (end - start > LONG_UNIT)
        h = K.span_hash(K.prefix(K.LOWER[data] if self.fold else data), start, end) | np.uint64(1)
        entry = np.full(len(end), -1, np.int32)
        usual = np.flatnonzero(~alone)
        entry[usual] = self._find(h[usual])
        known = entry >= 0
        size, where = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        size[known], where[known] = self.length[entry[known]], self.at[entry[known]]
        ids = self.pool[K.expand(where[known], size[known])]
        miss = usual[entry[usual] < 0]
        kinds, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
        spot = np.concatenate((miss[first], np.flatnonzero(alone)))
        pool, count = self._encoded(data, start[spot], end[spot])
        at = np.cumsum(count) - count
        size[miss], where[miss] = count[back], at[back]
        size[alone], where[alone] = count[len(kinds) :], at[len(kinds) :]
        self._add(kinds, pool[: int(count[: len(kinds)].sum())], count[: len(kinds)])
        out = np.empty(int(size.sum()), np.uint16)
        begin = np.cumsum(size) - size
        out[K.expand(begin[known], size[known])] = ids
        out[K.expand(begin[~known], size[~known])] = pool[K.expand(where[~known], size[~known])]
        return out, size, row, end
