"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the ranking of the ``size`` most frequent n-grams of 1 to 3 bytes of the lower-cased text, words padded with
a space. A document's profile is compared with each language's by the out-of-place distance: the sum of rank differences, and
``size`` for an n-gram that the language's profile lacks. The nearest language is predicted.

Rows: a text that is null or has no letter is ``und`` with score 0. Rows without id are left out; repeated rows give one row
each. Ties go to the first language by name, and n-grams of equal counts rank by length and bytes. Very long texts are profiled whole.
Without training rows all is ``und``; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm import kernels as K

SIZE = 300
_BITS = 26  # n-gram length and bytes


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram code and count, by row and code. Every run of bytes that are not letters is one space."""
    clean = np.where(K.NOT_WORD[data] | ((data >= 48) & (data <= 57)), np.uint8(32), data)
    row = np.repeat(np.arange(len(offs) - 1), offs[1:] - offs[:-1])
    gap = clean == 32
    keep = np.ones(len(clean), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (row[1:] == row[:-1]))
    b, row = clean[keep].astype(np.uint64), row[keep].astype(np.uint64)
    keys = []
    code = np.zeros(len(b), np.uint64)
    for n in (1, 2, 3):
        m = len(b) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | b[n - 1 :]
        ok = row[:m] == row[n - 1 :]
        if n == 1:
            ok &= b != 32
        keys.append((row[:m] << np.uint64(_BITS) | np.uint64(n << 24) | code[:m])[ok])
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    at = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(_BITS)).astype(np.int64), (key & np.uint64((1 << _BITS) - 1)).astype(np.int64), count


def _ranked(row: np.ndarray, code: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and rank of each row's ``size`` most frequent n-grams; ties by code."""
    if count.max(initial=0) < 1 << 22:  # all three fit one number
        key = np.sort(row.astype(np.uint64) << np.uint64(48) | (np.uint64((1 << 22) - 1) - count.astype(np.uint64)) << np.uint64(_BITS) | code.astype(np.uint64))
        row, code = (key >> np.uint64(48)).astype(np.int64), (key & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    else:
        order = np.lexsort((code, -count, row))
        row, code = row[order], code[order]
    new = np.diff(row, prepend=-1) != 0
    start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    rank = np.arange(len(row)) - start
    keep = rank < size
    return row[keep], code[keep], rank[keep]


def profiles(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """lang, gram, rank from (lang, text) rows: counts are summed per chunk, then over all."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = pc.dictionary_encode(batch.column(0))
            of, names = lang.indices.to_numpy(), lang.dictionary
            total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            data, offs = K.utf8(pc.utf8_lower(batch.column(1)))
            for lo, hi, d, o in K.chunks(data, offs, 1 << 20):
                row, code, count = _grams(d, o)
                key = of[lo:hi][row].astype(np.int64) << _BITS | code
                kinds, back = np.unique(key, return_inverse=True)
                sums = np.bincount(back, count, len(kinds)).astype(np.int64)
                total[lo] = (kinds, sums)
            if total:
                key = np.concatenate([x for x, _ in total.values()])
                kinds, back = np.unique(key, return_inverse=True)
                sums = np.bincount(back, np.concatenate([y for _, y in total.values()]), len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(kinds >> _BITS)), pa.array(kinds & ((1 << _BITS) - 1)), pa.array(sums)], ["lang", "gram", "count"])
        K.release()

    total = rows.mapInArrow(counts, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))
    return total.withColumn("place", first).filter(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("rank"))  # each task sends its first ones only


def identify(docs: DataFrame, training: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (lead of the nearest language over the next, 0 to 1), fit (1 less the nearest distance, 0 to 1).

    ``training``: (lang, text) rows. Of each language ``size`` n-grams come to the driver, nothing else.
    """
    learned: dict[str, dict[int, int]] = {}
    for r in profiles(training.filter("lang is not null"), size).collect():
        learned.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    names = sorted(learned)
    grams = np.array(sorted({g for x in learned.values() for g in x}), np.int64)
    place = np.full((len(grams) + 1, max(1, len(names))), -1, np.int64)  # the last line: in no profile
    for k, name in enumerate(names):
        at = np.searchsorted(grams, np.array(list(learned[name]), np.int64))
        place[at, k] = list(learned[name].values())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offs in K.documents(batches, 1 << 20, lower=True):
            n = len(ids)
            row, code, rank = _ranked(*_grams(data, offs), size)
            at = np.searchsorted(grams, code)
            at[at == len(grams)] = len(grams) - 1 if len(grams) else 0
            at = np.where(grams[at] == code, at, len(grams)) if len(grams) else at * 0
            known = np.bincount(row, minlength=n)
            far = np.empty((n, max(1, len(names))))
            for k in range(far.shape[1]):
                p = place[at, k]
                far[:, k] = np.bincount(row, np.where(p < 0, size, np.abs(p - rank)), n)
            far /= np.maximum(known * size, 1)[:, None]
            best = far.argmin(axis=1)
            near = np.sort(far, axis=1)
            lead = (near[:, 1] - near[:, 0]) / np.maximum(near[:, 1], 1e-12) if len(names) > 1 else 1 - near[:, 0]
            und = (known == 0) | (len(names) == 0)
            ascii_letters = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
            for k in np.flatnonzero(~und & (ascii_letters[offs[1:]] == ascii_letters[offs[:-1]])):  # signs beyond ASCII need not be letters
                und[k] = not any(map(str.isalpha, data[offs[k] : offs[k + 1]].tobytes().decode()))
            label = [None if u else names[b] for u, b in zip(und.tolist(), best.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pc.fill_null(pa.array(label, pa.string()), "und"), pa.array(np.where(und, 0.0, np.clip(lead, 0, 1))), pa.array(np.where(und, 0.0, 1 - near[:, 0]))], ["doc_id", "lang_pred", "score", "fit"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, fit double")
