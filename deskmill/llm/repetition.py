"""Quality rules by suffix-array repetition.

Per chunk of documents one suffix array over *word ids* (documents end in unique marks). Neighbouring suffixes that share
``min_repeat`` words or more lie in a common-prefix interval, which stands for a maximal repeated substring; the spans of all
such intervals are united per document, and the covered fraction of words and the longest repeat are limited. Only documents
with a repeated ``min_repeat``-word window (found by hash) enter the suffix array.

Rows: null or wordless texts have all counts 0 and fail the base rule. Rows without id are left out; repeated rows give one
row each. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm import kernels as K

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def _windows_twice(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Starts of n-word windows whose words occur twice or more in the row."""
    g = K.sequence_hash(h, n)
    start = np.flatnonzero(row[: len(g)] == row[n - 1 :][: len(g)])
    key = K.mix(g[start] ^ (row[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    key = key[order]
    twice = np.zeros(len(key), bool)
    twice[1:] = key[1:] == key[:-1]
    twice[:-1] |= twice[1:].copy()
    return start[order[twice]]


def _covered(start: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Flags of the positions in any [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def suffix_repeats(symbols: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the longest prefix of its suffix that occurs again in the same row (0 under ``least``), from the
    suffix array's neighbours; and the suffix array. ``symbols``: word ids of whole rows, one after another."""
    n = len(symbols)
    _, base = np.unique(row, return_inverse=True)
    # Every row has its own alphabet: suffixes of other rows share no symbol, and rows end each other's matches.
    _, rank = np.unique(base.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    levels, h = [rank], 1
    order = np.argsort(rank, kind="stable")
    while True:
        nxt = np.arange(n) + h
        key = rank * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new[1:].all():
            break
        levels.append(rank)
        h *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n + 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        step = ok * (1 << k)
        lcp[1:n] += step
        a += step
        b += step
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(lcp[:-1], lcp[1:])
    longest[longest < least] = 0
    return longest, order


def statistics(docs: DataFrame, min_repeat: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of COLUMNS."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offs in K.documents(batches):
            n = len(ids)
            start, end, row = K.words(data, offs)
            c = K.prefix(data)
            h = K.span_hash(c, start, end)
            per = lambda at: np.bincount(at, minlength=n).astype(np.int64)
            before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            total = lambda flags: (lambda t: t[offs[1:]] - t[offs[:-1]])(np.concatenate(([0], np.cumsum(flags))))
            chars = np.bincount(row, before[end] - before[start], minlength=n).astype(np.int64)
            # lines with a word, as (row, bytes), equal to an earlier one
            stop = np.zeros(256, bool)
            stop[10] = True
            ls, le, lr = K.words(data, offs, stop)
            filled = np.searchsorted(start, le) > np.searchsorted(start, ls)
            lh = K.mix(K.span_hash(c, ls[filled], le[filled]) ^ (lr[filled].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            order = np.argsort(lh, kind="stable")
            later = np.zeros(len(lh), bool)
            later[order[1:]] = lh[order[1:]] == lh[order[:-1]]
            eight = _covered(_windows_twice(h, row, 8), 8, len(h))
            covered, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
            some = np.unique(row[_windows_twice(h, row, min_repeat)])
            if len(some):
                at = np.flatnonzero(np.isin(row, some))
                _, symbol = np.unique(h[at], return_inverse=True)
                reach, _ = suffix_repeats(symbol.astype(np.int64), row[at], min_repeat)
                hit = np.flatnonzero(reach)
                covered = per(row[at][_covered(hit, reach[hit], len(at))])
                np.maximum.at(longest, row[at][hit], reach[hit])
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, (per(row), chars, total(SYMBOL[data]).astype(np.int64), per(lr[filled][later]), per(row[eight]), covered, longest))], ["doc_id", *COLUMNS])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, " + ", ".join(f"{x} long" for x in COLUMNS))


def quality_rules(docs: DataFrame, min_repeat: int = 6, max_covered_percent: int = 25, max_longest: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed and kept: false if the base rule fails, or repeats of ``min_repeat`` words or more cover over
    ``max_covered_percent`` of the words, or the longest repeat has over ``max_longest`` words."""
    s = statistics(docs, min_repeat, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = (100 * F.col("covered_words") > max_covered_percent * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    return s.withColumns({"base_failed": failed, "kept": ~failed & ~over})
