"""Sums of long vectors over all rows of a table, in bounded memory everywhere.

Each task adds up its own rows. Its totals leave it in pieces of ``PIECE`` numbers, those of zeros left out; a piece is added up over all tasks
by one task that reads them as a stream. Nothing but the result, as long as the vectors, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1024
KIND = "name string, at int, numbers binary"


def _batch(pieces: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.string()), pa.array([i for _, i in pieces], pa.int32()), pa.array([x.tobytes() for x in pieces.values()], pa.binary())], ["name", "at", "numbers"])


def summed(rows: DataFrame, totals: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Vectors by name, of ``shapes``, summed over tasks; ``totals`` makes a task's own from its batches."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, x in totals(batches).items():
            flat = np.ascontiguousarray(x, "<f8").reshape(-1)
            cut_ = {(name, i): flat[i : i + PIECE] for i in range(0, len(flat), PIECE)}
            yield _batch({k: v for k, v in cut_.items() if v.any()})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for k, i, x in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist(), batch.column("numbers")):
                own = np.frombuffer(x.as_buffer(), "<f8")
                held[k, i] = held[k, i] + own if (k, i) in held else own
        yield _batch(held)

    out = {k: np.zeros(int(np.prod(s))) for k, s in shapes.items()}
    for r in rows.mapInArrow(first, KIND).repartition("name", "at").mapInArrow(again, KIND).collect():
        x = np.frombuffer(r["numbers"], "<f8")
        out[r["name"]][r["at"] : r["at"] + len(x)] = x
    return {k: x.reshape(shapes[k]) for k, x in out.items()}
