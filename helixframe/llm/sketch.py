"""Fixed-size summaries that tasks build and Spark merges: counts of hashes, and sets of keys.

Their size doesn't depend on the input, so the merged summary may reach the driver and be sent to all tasks. Neither decides
a result: counts only set an order or spread hot groups, and a set only passes too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table_rows, tidied

COUNT_BITS, KEY_BITS, PARTS = 20, 26, 64
_PART = pa.schema([("part", pa.int32()), ("content", pa.binary())])


def bucket(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - COUNT_BITS)


def _packed(part: int, values: np.ndarray) -> dict:
    return {"part": part, "content": pa.compress(values.tobytes(), "zstd", asbytes=True)}


class Counts:
    """How often hashes fall into each of 2**COUNT_BITS buckets, in one task."""

    def __init__(self):
        self.counts = np.zeros(1 << COUNT_BITS, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        self.counts += np.bincount(bucket(hashes), minlength=1 << COUNT_BITS).astype(np.uint32)

    def rows(self) -> list[dict]:
        return [_packed(p, c) for p, c in enumerate(self.counts.reshape(PARTS, -1)) if c.any()]


def levels(parts: DataFrame) -> np.ndarray:
    """For each bucket how far its count stands out, from tasks' rows (part, content): 0 for the usual, l for 16 * 2**(l - 1) above.

    The usual is the mean plus four times its square root, what chance alone puts into a bucket.
    """
    width = (1 << COUNT_BITS) // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part, raw in table_rows(batches, "part", "content"):
            c = np.frombuffer(pa.decompress(raw, 4 * width, "zstd"), np.uint32)
            sums[part] = sums[part] + c if part in sums else c.astype(np.uint64)
        for part, c in sums.items():
            yield pa.RecordBatch.from_pylist([_packed(part, np.minimum(c, 0xFFFFFFFF).astype(np.uint32))], schema=_PART)

    total = np.zeros((PARTS, width), np.float64)
    for r in parts.select("part", "content").repartition(PARTS, "part").mapInArrow(tidied(add), "part int, content binary").collect():  # PARTS rows, 4 MB in all
        total[r["part"]] = np.frombuffer(pa.decompress(bytes(r["content"]), 4 * width, "zstd"), np.uint32)
    usual = total.mean() + 4 * np.sqrt(total.mean())
    return np.minimum(np.frexp(np.maximum(0, total.ravel() - usual) // 16)[1], 15).astype(np.uint8)


def _places(nodes: np.ndarray) -> np.ndarray:
    return nodes.view(np.uint64) >> np.uint64(64 - KEY_BITS)


def key_filter(nodes: DataFrame) -> np.ndarray:
    """A bit for each value of the first KEY_BITS bits of the keys in column `node`: 8 MB whatever the input."""
    width = (1 << KEY_BITS) // 8 // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _places(batch.column(0).to_numpy())
            part = (at // np.uint64(8 * width)).astype(np.int64)
            for p in np.unique(part).tolist():
                inside = at[part == p] % np.uint64(8 * width)
                np.bitwise_or.at(parts.setdefault(p, np.zeros(width, np.uint8)), (inside >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (inside & np.uint64(7))).astype(np.uint8))
        for p, bits in parts.items():
            yield pa.RecordBatch.from_pylist([_packed(p, bits)], schema=_PART)

    out = np.zeros((PARTS, width), np.uint8)
    for r in nodes.select("node").repartition(PARTS, F.shiftrightunsigned("node", 58)).mapInArrow(tidied(run), "part int, content binary").collect():  # PARTS rows
        out[r["part"]] |= np.frombuffer(pa.decompress(bytes(r["content"]), width, "zstd"), np.uint8)
    return out.ravel()


def holds(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = _places(nodes)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
