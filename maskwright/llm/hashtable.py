"""Fixed-size tables of hash counts, gathered from every row of a corpus.

A table has 2 ** bits cells whatever the corpus holds, so broadcasting it is bounded. Each map
task adds up its own cells and ships them in compressed slices; slices are summed by a
streaming reduce, so no task holds more than a few slices at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64


def pack_counts(counts: np.ndarray, slices: int = SLICES) -> Iterator[tuple[int, bytes]]:
    """(slice, payload) of every slice that isn't all zero; the first byte says the item size."""
    for k, part in enumerate(np.array_split(counts, slices)):
        top = int(part.max()) if len(part) else 0
        if top:
            kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64
            yield k, bytes([np.dtype(kind).itemsize]) + zlib.compress(part.astype(kind).tobytes(), 1)


def unpack_counts(payload: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(payload[1:]), f"<u{payload[0]}")


def sum_slices(rows: DataFrame, bits: int, partitions: int) -> np.ndarray:
    """Add the payloads of ``rows`` (slice int, payload binary) into one table of 2 ** bits
    saturating counters. What reaches the driver is that table and nothing else."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = unpack_counts(payload)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array(list(sums), pa.int32()), "payload": pa.array([next(pack_counts(v, 1))[1] for v in sums.values()], pa.binary())}
            )

    table = np.zeros(1 << bits, np.uint32)
    edges = np.cumsum([0, *(len(p) for p in np.array_split(table, SLICES))])
    summed = rows.select("slice", "payload").repartition(min(partitions, SLICES), "slice").mapInArrow(reduce, "slice int, payload binary")
    for k, payload in summed.collect():
        table[edges[k] : edges[k + 1]] = np.minimum(unpack_counts(bytes(payload)).astype(np.uint64), 0xFFFFFFFF)
    return table
