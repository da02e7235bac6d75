"""Token ids in patched frame-of-reference blocks (operator 1).

Format. A dataset is a folder of Parquet rows, one per segment, each with a self-contained binary payload; Spark's committer
installs the files, so a lost executor leaves no half-written shard. Integers are little-endian. A payload holds

    magic "PFR1", n_ids u64, n_docs u32, block u32            header
    doc_id i64[n_docs], is_null u8[n_docs], n_tokens u32[n_docs]   documents, in order
    start u32[n_blocks], min u32[], width u8[], n_exc u8[]     index: where a block starts in the data, and how to read it
    data: per block ceil(block * width / 8) bytes of (id - min) mod 2**width, then positions u8[n_exc], high parts u32[n_exc]

The width of a block is that of the given percentile of its (id - min); ids that need more bits are its exceptions, whose
high part (id - min) >> width is in the list. The last block is filled up with its own minimum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import columns, running_start, table_rows, text_of, tidied
from .tokens import encoder

MAGIC = b"PFR1"
_HEADER = struct.Struct("<4sQII")
SEGMENTS = "shard int, segment int, first_id long, n_ids long, n_docs int, payload binary"
DOCUMENTS = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 32-bit values to rows of bytes, width bits a value, highest bit first."""
    m, n = values.shape
    bits = np.unpackbits(np.ascontiguousarray(values, dtype=">u4").view(np.uint8).reshape(m, n, 4), axis=2)
    return np.packbits(bits[:, :, 32 - width :].reshape(m, n * width), axis=1)


def _from_bits(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    m = packed.shape[0]
    bits = np.zeros((m, n, 32), dtype=np.uint8)
    bits[:, :, 32 - width :] = np.unpackbits(packed, axis=1)[:, : n * width].reshape(m, n, width)
    return np.packbits(bits, axis=2).reshape(m, n * 4).view(">u4").astype(np.uint32)


def pack_ids(ids: np.ndarray, block: int = 128, percentile: float = 0.9) -> tuple[bytes, bytes]:
    """The block index and the data for ids (unsigned 32-bit)."""
    n_blocks = -(-len(ids) // block)
    if not n_blocks:
        return b"", b""
    full = np.empty(n_blocks * block, dtype=np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n_blocks - 1) * block :].min()
    full = full.reshape(n_blocks, block)
    low = full.min(axis=1)
    over = full - low[:, None]
    k = max(0, int(np.ceil(percentile * block)) - 1)
    width = bit_length(np.partition(over, k, axis=1)[:, k])
    high = (over.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    exceptions = high != 0
    n_exc = exceptions.sum(axis=1)
    packed = (block * width.astype(np.int64) + 7) // 8
    sizes = packed + 5 * n_exc
    ends = np.cumsum(sizes)
    start = ends - sizes
    data = np.zeros(int(ends[-1]), dtype=np.uint8)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            data[start[at][:, None] + np.arange(packed[at[0]])] = _to_bits(over[at], int(w))
    rows, position = np.nonzero(exceptions)
    if len(rows):
        nth = np.arange(len(rows)) - (np.cumsum(n_exc) - n_exc)[rows]
        lists = start[rows] + packed[rows]
        data[lists + nth] = position
        data[(lists + n_exc[rows] + 4 * nth)[:, None] + np.arange(4)] = high[rows, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    index = start.astype("<u4").tobytes() + low.astype("<u4").tobytes() + width.tobytes() + n_exc.astype(np.uint8).tobytes()
    return index, data.tobytes()


class Segment:
    """A payload, read in place; ids(lo, hi) decodes only the blocks that it needs."""

    def __init__(self, payload: bytes):
        magic, self.n_ids, n_docs, self.block = _HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a PFR1 segment")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_id, self.is_null, self.n_tokens = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        n = -(-self.n_ids // self.block)
        self.start, self.low, self.width, self.n_exc = take("<u4", n), take("<u4", n), take("u1", n), take("u1", n)
        self.data = np.frombuffer(payload, dtype=np.uint8, offset=at)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n_ids if hi is None else min(hi, self.n_ids)
        if hi <= lo:
            return np.zeros(0, dtype=np.uint32)
        first, last = lo // self.block, -(-hi // self.block)
        start, width, n_exc = (x[first:last].astype(np.int64) for x in (self.start, self.width, self.n_exc))
        over = np.zeros((last - first, self.block), dtype=np.uint32)
        packed = (self.block * width + 7) // 8
        for w in np.unique(width):
            if w:
                at = np.flatnonzero(width == w)
                over[at] = _from_bits(self.data[start[at][:, None] + np.arange(packed[at[0]])], int(w), self.block)
        rows = np.repeat(np.arange(last - first), n_exc)
        if len(rows):
            nth = np.arange(len(rows)) - (np.cumsum(n_exc) - n_exc)[rows]
            lists = start[rows] + packed[rows]
            high = np.ascontiguousarray(self.data[(lists + n_exc[rows] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
            over[rows, self.data[lists + nth]] |= (high.astype(np.uint64) << width[rows].astype(np.uint64)).astype(np.uint32)
        return (over + self.low[first:last, None]).ravel()[lo - first * self.block : hi - first * self.block]


def segment(docs: list[tuple[int | None, bytes]], block: int = 128, percentile: float = 0.9) -> bytes:
    """The payload for documents (doc_id, ids as little-endian unsigned 32-bit integers)."""
    ids = np.frombuffer(b"".join(d for _, d in docs), dtype="<u4")
    index, data = pack_ids(ids, block, percentile)
    return b"".join(
        (
            _HEADER.pack(MAGIC, len(ids), len(docs), block),
            np.array([0 if i is None else i for i, _ in docs], dtype="<i8").tobytes(),
            np.array([i is None for i, _ in docs], dtype=np.uint8).tobytes(),
            np.array([len(d) // 4 for _, d in docs], dtype="<u4").tobytes(),
            index,
            data,
        )
    )


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block: int = 128, percentile: float = 0.9, segment_ids: int = 1 << 18) -> None:
    """Encode every whole text and write its ids, with end_id after each document, to path in ascending order of id_col.

    Rows are range-partitioned by (id, hash of the text) and sorted; each partition becomes a shard, written as segments of
    whole documents that close at segment_ids ids. Null ids come first; rows of equal id are ordered by the hash of their
    text, so equal rows lie side by side and each keeps its own ids. A null or empty text gives only end_id; an empty table
    gives an empty dataset. One text and its ids must fit in a worker's memory.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        held, n_held, first, n = [], 0, 0, 0

        def out() -> pa.RecordBatch:
            row = {"shard": shard, "segment": n, "first_id": first, "n_ids": n_held, "n_docs": len(held), "payload": segment(held, block, percentile)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("payload", pa.binary())]))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1))):
                held.append((doc_id, ids + end))
                n_held += len(ids) // 4 + 1
                if n_held >= segment_ids:
                    yield out()
                    first, n, held, n_held = first + n_held, n + 1, [], 0
        if held:
            yield out()

    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_of().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    rows.select("doc_id", "text").mapInArrow(tidied(write), SEGMENTS).write.option("compression", "none").parquet(path)


def read_token_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document of a dataset: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, and ids if asked for.

    ids_crc32 is the unsigned crc32 of the document's ids as little-endian unsigned 32-bit integers. Shards' first ids come
    from the counts that the segments carry, of which only the small columns are read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, first, payload in table_rows(batches, "shard", "first_id", "payload"):
            s = Segment(payload)
            ids, ends = s.ids().astype("<u4"), np.cumsum(s.n_tokens, dtype=np.int64)
            starts = ends - s.n_tokens
            raw = memoryview(ids.tobytes())
            parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
            out = {
                "shard": pa.array([shard] * len(ends), pa.int32()),
                "doc_id": pa.array(s.doc_id, pa.int64(), mask=s.is_null.astype(bool)),
                "local_start": pa.array(starts + first, pa.int64()),
                "n_tokens": pa.array(s.n_tokens.astype(np.int64)),
                "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    found = segments.select("shard", "first_id", "payload").mapInArrow(tidied(read), DOCUMENTS + ", ids array<int>" * with_ids)
    out = found.join(running_start(totals, "shard", "n", "shard_start"), "shard")
    return out.select("doc_id", (F.col("local_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard", *["ids"] * with_ids)
