"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. One scan turns each text into bounded statistics (``NAMES``).
2. Moments of the labelled training rows standardise them. cos(W z + b) with Gaussian W approximates a Gaussian kernel.
3. Each partition sums its normal equations; the sums are added in two steps and solved on the driver: size (d + 1)**2, whatever
   the number of rows. All labelled rows take part; nothing is sampled.
4. Every training row also gets a raw score of a fit without its fold (a hash of its id), from the difference of the folds' sums. These
   scores are counted in ``BINS`` bins and made monotone by pool-adjacent-violators, so the curve is not fitted on what the ridge has seen.

Labels are 0 or 1, so raw scores lie about 0 to 1; those under -0.5 and over 1.5 share the first and the last bin.

Rows: null texts score as empty ones. Rows without id are left out; rows that repeat an id are scored each. Labels repeated for an id are
averaged. Very long texts are read whole. Without a training row of either kind the score is the share of the other (0.5 without any).
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm import kernels as K
from deskmill.llm.store import cut, drop
from deskmill.operators.sums import summed

NAMES = ("log_words", "word_length", "word_spread", "long_words", "upper", "digits", "symbols", "stops", "commas", "shouts", "bars", "other", "non_ascii", "lines", "repeat_lines", "distinct_words", "top_word", "repeat_pairs", "first_upper", "entropy")
FEATURES, BINS, SEED, FOLDS = 256, 1000, 7, 3


def _class(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_UPPER, _LOWER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789")
_SYMBOL, _STOP, _COMMA, _SHOUT, _BAR = _class(b"#*$%&<>@^~_=+\\/"), _class(b".?"), _class(b",;:"), _class(b"!"), _class(b"|")
_OTHER = _class(bytes(range(33, 127))) & ~(_UPPER | _LOWER | _DIGIT | _SYMBOL | _STOP | _COMMA | _SHOUT | _BAR)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One line of NAMES for each row."""
    n = len(offs) - 1
    start, end, row = K.words(data, offs)
    size = np.maximum(offs[1:] - offs[:-1], 1).astype(float)
    count = np.bincount(row, minlength=n)
    words = np.maximum(count, 1).astype(float)
    c = K.prefix(K.LOWER[data])
    h = K.span_hash(c, start, end)
    length = (end - start).astype(float)
    mean = np.bincount(row, length, n) / words

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        t = np.concatenate(([0], np.cumsum(flags[data])))
        return (t[offs[1:]] - t[offs[:-1]]) / of

    def distinct(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each row, and the count of its most frequent one."""
        order = np.lexsort((key, of))
        k, r = key[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, r[at], np.diff(np.append(at, len(k))))
        return np.bincount(r[at], minlength=n), top

    kinds, top = distinct(h, row)
    pair = K.sequence_hash(h, 2)
    ok = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    pairs = np.bincount(row[:-1][ok], minlength=n) if len(row) > 1 else np.zeros(n, np.int64)
    pair_kinds, _ = distinct(pair[ok], row[:-1][ok]) if len(row) > 1 else (np.zeros(n), None)
    stop = np.zeros(256, bool)
    stop[10] = True
    ls, le, lr = K.words(data, offs, stop)
    lines = np.bincount(lr, minlength=n)
    line_kinds, _ = distinct(K.span_hash(c, ls, le), lr)
    byte_row = np.repeat(np.arange(n), offs[1:] - offs[:-1])
    table = np.bincount(byte_row * 32 + (data >> 3), minlength=32 * n).reshape(n, 32) / size[:, None]
    entropy = -(table * np.log(np.where(table > 0, table, 1))).sum(axis=1)
    out = [
        np.log1p(count), mean, np.sqrt(np.maximum(np.bincount(row, length * length, n) / words - mean * mean, 0)), np.bincount(row, length > 20, n) / words,
        share(_UPPER, size), share(_DIGIT, size), share(_SYMBOL, size), share(_STOP, words), share(_COMMA, words), share(_SHOUT, words), share(_BAR, words), share(_OTHER, size),
        share(np.arange(256) >= 128, size), lines / words, 1 - line_kinds / np.maximum(lines, 1), kinds / words, top / words, 1 - pair_kinds / np.maximum(pairs, 1),
        np.bincount(row, _UPPER[data[start]] if len(start) else None, n) / words, entropy,
    ]
    return np.minimum(np.stack(out, axis=1), 100.0)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, its statistics."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offs in K.documents(batches):
            x = statistics(data, offs)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, of_batch, width: int) -> np.ndarray:
    """Sum over all rows of a vector of ``width``."""

    def totals(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
        return {"v": total}

    return summed(rows, totals, {"v": (width,)})["v"]


class Projection:
    """Standardised statistics to cosines, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, count: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), count))
        self.b = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.concatenate((np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))), axis=1)


def isotonic(score: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of total / weight by ascending score (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w) for w, t, n in blocks]) if blocks else np.empty(0)


def classify(docs: DataFrame, labels: DataFrame, trains: str, count: int = FEATURES, ridge: float = 1e-3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1). ``labels``: (doc_id, y) rows; ``trains``: an SQL condition on doc_id for rows to learn from."""
    x = cut(features(docs, id_col, text_col), "statistics")
    y = labels.filter("doc_id is not null and y is not null").filter(trains).groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    known = cut(x.join(y, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")), "labelled")
    m = len(NAMES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        v = _matrix(batch.column(0))
        return np.concatenate(([len(v), batch.column(1).to_numpy().sum()], v.sum(axis=0), (v * v).sum(axis=0)))

    s = _summed(known, moments, 2 * m + 2)
    n = max(s[0], 1)
    base = s[1] / n if s[0] else 0.5
    mean = s[2 : m + 2] / n
    spread = np.sqrt(np.maximum(s[m + 2 :] / n - mean * mean, 1e-9))
    project = Projection(mean, spread, count, seed)
    d = count + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((FOLDS, d, d + 1))
        fold = batch.column(2).to_numpy()
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            p, y_ = project(_matrix(part.column(0))), part.column(1).to_numpy()
            for k in range(FOLDS):
                mine = fold[lo : lo + 2000] == k
                out[k, :, :d] += p[mine].T @ p[mine]
                out[k, :, d] += p[mine].T @ y_[mine]
        return out.reshape(-1)

    sums = _summed(known, normal, FOLDS * d * (d + 1)).reshape(FOLDS, d, d + 1)
    solve = lambda a: np.linalg.solve(a[:, :d] + ridge * n * np.eye(d) / d + 1e-9 * np.eye(d), a[:, d])
    whole = sums.sum(axis=0)
    beta, without = solve(whole), np.stack([solve(whole - a) for a in sums], axis=1)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = project(_matrix(batch.column(0))) @ without
                own = raw[np.arange(len(raw)), batch.column(2).to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(_bin(own)), batch.column(1)], ["bin", "y"])

    rows = known.mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count("*").alias("w"), F.sum("y").alias("t")).orderBy("bin").collect()  # at most BINS rows
    drop(known)
    at = np.array([r["bin"] for r in rows], float)
    value = isotonic(at, np.array([r["w"] for r in rows], float), np.array([r["t"] for r in rows], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = project(_matrix(batch.column(1))) @ beta
                # within a step of the isotonic curve the raw score still orders, by a thousandth at most
                p = np.interp(_place(raw), at, value) if len(at) else np.full(len(raw), base)
                p = 0.999 * p + 0.001 / (1 + np.exp(np.clip(2 - 4 * raw, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return x.mapInArrow(score, "doc_id long, score double")


def _place(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2, 0, 1) * (BINS - 1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.rint(_place(raw)).astype(np.int64)
