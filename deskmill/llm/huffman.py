"""Token ids as files of canonical, length-limited Huffman codes.

Ids are counted over the whole corpus; package-merge gives the best code lengths up to ``LIMIT`` bits, and the canonical rule
turns lengths into codes, so a codebook is only lengths. Files are Parquet (any Hadoop store, committed atomically), under one path:

* ``codebook``: one row with the code lengths, their limit, the ids between checkpoints, the end id and the vocabulary's name and size;
* ``blocks``: one row is one independent block with its first document, id counts, bit offsets at every checkpoint, and the bits.

The path is all that a reader needs. Decoding reads a ``limit``-bit window, looks up (id, length) in one table and steps; all checkpoints
of many blocks step together.

Rows: a null text has only the end id. Rows without id are left out; repeated ids are written each, in the order of their texts. A text
of any length is one document of one block. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm import kernels as K
from deskmill.llm.store import cut, drop, new_path, partitions
from deskmill.llm.tokens import Encoder

LIMIT = 20
CHECKPOINT = 256
BLOCK_IDS = 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur, 1 for a lone id."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    m = len(used)
    if m <= 1:
        out[used] = 1
        return out
    if m > 1 << limit:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    lists, merged = [], weight
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate((weight, packages))
        order = np.argsort(both, kind="stable")
        lists.append(order < m)  # which items are leaves
        merged = both[order]
    length = np.zeros(m, np.int64)
    take = 2 * m - 2
    for leaf in reversed(lists):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    length[:take] += 1
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of ids by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, order = 0, np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    at, sizes = 0, np.bincount(lengths, minlength=2)
    for bits in range(1, len(sizes)):
        code <<= 1
        k = int(sizes[bits])
        codes[order[at : at + k]] = np.arange(code, code + k)
        code += k
        at += k
    return codes


def table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """id << 5 | length by the next ``limit`` bits."""
    codes = canonical(lengths)
    out = np.zeros(1 << limit, np.int32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (limit - lengths[order].astype(np.int64))
    filled = np.repeat(order.astype(np.int32) << 5 | lengths[order].astype(np.int32), span)
    out[: len(filled)] = filled
    assert not len(order) or codes[order[0]] == 0
    return out


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = CHECKPOINT) -> tuple[bytes, np.ndarray]:
    """Bits (first bit highest) and the bit offset of every ``every``-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    words = np.zeros(int(end[-1] if len(end) else 0) // 64 + 2, np.uint64)
    word, bit = begin >> 6, begin & 63
    value = codes[ids].astype(np.uint64)
    room = 64 - bit - size
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(ids):
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8 if len(end) else 0], begin[::every].astype(np.int64)


def decode(blocks: list[tuple[bytes, np.ndarray, int]], lookup: np.ndarray, limit: int = LIMIT, every: int = CHECKPOINT) -> list[np.ndarray]:
    """Ids of (bits, checkpoints, count) blocks; every checkpoint is a lane, and all lanes step together."""
    raw, base, lane, left = bytearray(), [], [], []
    for bits, marks, count in blocks:
        base.append(len(raw))
        raw += bits + b"\0" * 8
        lane.append(marks + 8 * base[-1])
        left.append(np.minimum(every, count - np.arange(len(marks)) * every))
    data = np.frombuffer(bytes(raw), np.uint8).astype(np.int64)
    wide = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:] if len(data) > 3 else data
    at = np.concatenate(lane) if lane else np.empty(0, np.int64)
    count = np.concatenate(left) if left else np.empty(0, np.int64)
    out = np.zeros((every, len(at)), np.uint16)
    mask = (1 << limit) - 1
    for step in range(int(count.max(initial=0))):
        at = np.minimum(at, 8 * (len(wide) - 1))
        hit = lookup[(wide[at >> 3] >> (32 - limit - (at & 7))) & mask]
        out[step] = hit >> 5
        at = at + (hit & 31)
    flat = out.T
    result, k = [], 0
    for _, marks, n in blocks:
        result.append(flat[k : k + len(marks)].reshape(-1)[:n])
        k += len(marks)
    return result


def vocabulary_size(vocabulary: str) -> int:
    """One more than the greatest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values()) + 1


def write_ids(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the codebook and the blocks, in ascending id order, under ``path`` (a new one in the shared folder if None); the path.

    A block has its start (ids before it), its documents and their numbers of ids, checkpoints, bits.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "id-files")
    size = max(vocabulary_size(vocabulary), end_id + 1)
    if size > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, first = Encoder.of(vocabulary), TaskContext.get().partitionId(), 0
        for ids, data, offs in K.documents(batches, 1 << 20):
            tokens, unit_ids, unit_row, _ = encoder.units(data, offs)
            count = np.bincount(unit_row, unit_ids, len(ids)).astype(np.int64) + 1
            full = np.full(len(tokens) + len(ids), end_id, np.uint16)
            mask = np.ones(len(full), bool)
            mask[np.cumsum(count) - 1] = False
            full[mask] = tokens
            values = (part, first, ids.tobytes(), count.tobytes(), full.tobytes(), len(full))
            yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], ["part", "first", "docs", "counts", "ids", "n"])
            first += len(full)

    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    held = cut(ordered.mapInArrow(tokenize, "part int, first long, docs binary, counts binary, ids binary, n long"), "token-chunks")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "count"])

    counts = np.zeros(size, np.int64)  # at most one row per id of the vocabulary
    for r in held.select("ids").mapInArrow(tally, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toLocalIterator():
        counts[r["id"]] = r["count"]
    sums = {r["part"]: r["n"] for r in held.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row per range partition
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    lengths = code_lengths(counts)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in batches:
            for part, first, docs_, counts_, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                doc, count, ids = np.frombuffer(docs_, np.int64), np.frombuffer(counts_, np.int64), np.frombuffer(ids, np.uint16)
                ends = np.cumsum(count)
                a = 0
                while a < len(doc):  # whole documents, BLOCK_IDS ids or one longer document
                    lo = int(ends[a] - count[a])
                    b = max(a + 1, int(np.searchsorted(ends, lo + BLOCK_IDS, "right")))
                    hi = int(ends[b - 1])
                    bits, marks = encode(ids[lo:hi], codes, lengths)
                    values = (before[part] + first + lo, hi - lo, doc[a:b].tobytes(), count[a:b].tobytes(), marks.tobytes(), bits)
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in values], ["start", "n", "docs", "sizes", "checkpoints", "bits"])
                    a = b

    placed = held.select("part", "first", "docs", "counts", "ids")
    placed.mapInArrow(blocks, BLOCK).write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/blocks")
    book = [(bytearray(lengths.tobytes()), LIMIT, CHECKPOINT, end_id, os.path.basename(vocabulary), size, total)]
    spark.createDataFrame(book, BOOK).coalesce(1).write.parquet(f"{path}/codebook")
    drop(held)
    return path


BLOCK = "start long, n long, docs binary, sizes binary, checkpoints binary, bits binary"
BOOK = "lengths binary, `limit` int, checkpoint int, end_id int, vocabulary string, vocabulary_size int, ids long"


def codebook(spark: SparkSession, path: str) -> dict:
    """The codebook of files that ``write_ids`` wrote."""
    rows = spark.read.schema(BOOK).parquet(f"{path}/codebook").collect()
    if len(rows) != 1 or len(rows[0]["lengths"]) != rows[0]["vocabulary_size"]:
        raise ValueError(f"{path} holds no codebook")
    return rows[0].asDict() | {"lengths": np.frombuffer(rows[0]["lengths"], np.uint8)}


def _pieces(batches: Iterator[pa.RecordBatch], book: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document, ids before it, ids, and number of ids, of some blocks."""
    lookup = table(book["lengths"], book["limit"])
    for batch in batches:
        for lo in range(0, batch.num_rows, 16):
            start, n, docs, sizes, marks, bits = (batch.column(i).slice(lo, 16).to_pylist() for i in range(6))
            ids = decode([(b, np.frombuffer(m, np.int64), k) for b, m, k in zip(bits, marks, n)], lookup, book["limit"], book["checkpoint"])
            size = np.concatenate([np.frombuffer(x, np.int64) for x in sizes])
            first = np.concatenate([s + np.cumsum(y := np.frombuffer(x, np.int64)) - y for s, x in zip(start, sizes)])
            yield np.concatenate([np.frombuffer(x, np.int64) for x in docs]), first, np.concatenate(ids), size


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array) from the files."""
    book = codebook(spark, path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, start, ids, size in _pieces(batches, book):
            at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))], ["doc_id", "start", "ids"])

    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").mapInArrow(pieces, "doc_id long, start long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files."""
    book = codebook(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, start, ids, size in _pieces(batches, book):
            raw, end = memoryview(ids.astype("<u4").tobytes()), np.cumsum(size)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((end - size).tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
