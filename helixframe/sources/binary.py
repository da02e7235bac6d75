"""Binary sequence and range files: 2bit genomes and bigBed tables, from the bytes of whole files.

A file is a row with its bytes (`binaryFile`, up to 2 GB); the catalogue and index in its front tell which stretches of it a
query needs, and only those are unpacked. The formats are published (Kent and others, 2002 and 2010).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .records import bed_from_rows

#: Signatures of the formats.
TWO_BIT, BIG_BED, NAME_TREE, RANGE_TREE = 0x1A412743, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
_BASES = np.frombuffer(b"TCAG", np.uint8)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _order(data: bytes, signature: int) -> str:
    for order in "<>":
        if len(data) >= 4 and struct.unpack_from(f"{order}I", data)[0] == signature:
            return order
    raise ValueError("not a file of this format")


# 2bit


def two_bit_index(data: bytes) -> dict[str, int]:
    """Where each sequence's record begins."""
    o = _order(data, TWO_BIT)
    n, at, out = struct.unpack_from(f"{o}I", data, 8)[0], 16, {}
    for _ in range(n):
        size = data[at]
        out[data[at + 1 : at + 1 + size].decode()] = struct.unpack_from(f"{o}I", data, at + 1 + size)[0]
        at += 5 + size
    return out


def two_bit_size(data: bytes, at: int) -> int:
    return struct.unpack_from(f"{_order(data, TWO_BIT)}I", data, at)[0]


def two_bit_bases(data: bytes, at: int, start: int = 0, end: int | None = None) -> str:
    """Bases [start, end) of the record at `at`: only their bytes are unpacked; N blocks and lower-case blocks are put in."""
    o = _order(data, TWO_BIT)
    size = two_bit_size(data, at)
    start, end = max(0, start), size if end is None else min(size, end)
    blocks, at = [], at + 4
    for _ in range(2):
        n = struct.unpack_from(f"{o}I", data, at)[0]
        pairs = np.frombuffer(data, f"{o}u4", 2 * n, at + 4).astype(np.int64).reshape(2, n)
        blocks.append(pairs)
        at += 4 + 8 * n
    at += 4
    if start >= end:
        return ""
    packed = np.frombuffer(data, np.uint8, (end + 3) // 4 - start // 4, at + start // 4)
    codes = (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    bases = _BASES[codes.ravel()[start % 4 :][: end - start]].copy()
    for lower, (starts, sizes) in enumerate(blocks):
        first = int(np.searchsorted(starts + sizes, start, side="right"))
        for s, n in zip(starts[first:].tolist(), sizes[first:].tolist()):
            if s >= end:
                break
            part = slice(max(0, s - start), s + n - start)
            bases[part] = (bases[part] | 0x20) if lower else ord("N")
    return bases.tobytes().decode()


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).reshape(-1, 2)
    return edges[:, 0], edges[:, 1] - edges[:, 0]


def two_bit_bytes(sequences: Iterable[tuple[str, str]]) -> bytes:
    """A 2bit file of (name, bases): case is kept, everything but ACGT becomes N."""
    records, index = [], []
    for name, seq in sequences:
        raw = np.frombuffer(seq.encode("ascii"), np.uint8)
        upper = raw & 0xDF
        codes = np.select([upper == ord(b) for b in "TCAG"], [0, 1, 2, 3], 4).astype(np.uint8)
        parts = [struct.pack("<I", len(raw))]
        for starts, sizes in (_stretches(codes == 4), _stretches((raw & 0x20) != 0)):
            parts += [struct.pack("<I", len(starts)), starts.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()]
        four = np.append(np.where(codes == 4, 0, codes), np.zeros(-len(codes) % 4, np.uint8)).reshape(-1, 4)
        parts += [struct.pack("<I", 0), (four << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()]
        records.append(b"".join(parts))
        index.append(name.encode())
    at, out = 16 + sum(len(n) + 5 for n in index), [struct.pack("<4I", TWO_BIT, 0, len(index), 0)]
    for name, record in zip(index, records):
        out.append(bytes([len(name)]) + name + struct.pack("<I", at))
        at += len(record)
    return b"".join([*out, *records])


def two_bit_sizes(files: DataFrame) -> DataFrame:
    """name and size of every sequence of files (content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [(n, two_bit_size(data, at)) for n, at in two_bit_index(data).items()]
                yield pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in rows], pa.string()), "size": pa.array([s for _, s in rows], pa.int64())})

    return files.select("content").mapInArrow(run, "name string, size long")


def two_bit_chunks(files: DataFrame, size: int = 1 << 16) -> DataFrame:
    """All sequences as rows of `size` bases (name, nth, seq), as sequence_chunks() gives them; no sequence is held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for name, at in two_bit_index(data).items():
                    total = two_bit_size(data, at)
                    for nth in range(max(1, -(-total // size))):
                        yield pa.RecordBatch.from_pydict({"name": [name], "nth": pa.array([nth], pa.int64()), "seq": [two_bit_bases(data, at, nth * size, (nth + 1) * size)]})

    return files.select("content").mapInArrow(run, "name string, nth long, seq string")


def two_bit_ranges(files: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """name, start, end and seq of some ranges; those of unknown sequences give no row, ends are clamped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                index = two_bit_index(data)
                rows = [(n, a, b, two_bit_bases(data, index[n], a, b)) for n, a, b in ranges if n in index]
                if rows:
                    made = zip(("name", "start", "end", "seq"), zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in made})

    return files.select("content").mapInArrow(run, "name string, start long, end long, seq string")


# bigBed


def _names(data: bytes, o: str) -> list[tuple[str, int, int]]:
    """(name, id, size) of every sequence, from the catalogue's tree."""
    root = struct.unpack_from(f"{o}Q", data, 8)[0]
    magic, _, key, _, _, _ = struct.unpack_from(f"{o}4I2Q", data, root)
    if magic != NAME_TREE:
        raise ValueError("no catalogue of sequences")
    out, nodes = [], [root + 32]
    while nodes:
        at = nodes.pop()
        leaf, _, n = struct.unpack_from(f"{o}2BH", data, at)
        for k in range(n):
            item = at + 4 + k * (key + 8)
            if leaf:
                out.append((data[item : item + key].rstrip(b"\0").decode(), *struct.unpack_from(f"{o}2I", data, item + key)))
            else:
                nodes.append(struct.unpack_from(f"{o}Q", data, item + key)[0])
    return sorted(out)


def _blocks(data: bytes, o: str, want: tuple[int, int, int] | None) -> list[tuple[int, int]]:
    """(offset, size) of the data blocks that can hold ranges which overlap want (sequence id, start, end), or of all, in order."""
    root = struct.unpack_from(f"{o}Q", data, 24)[0]
    if struct.unpack_from(f"{o}I", data, root)[0] != RANGE_TREE:
        raise ValueError("no index of ranges")
    out, nodes = [], [root + 48]
    while nodes:
        at = nodes.pop()
        leaf, _, n = struct.unpack_from(f"{o}2BH", data, at)
        for k in range(n):
            item = at + 4 + k * (32 if leaf else 24)
            c0, s, c1, e = struct.unpack_from(f"{o}4I", data, item)
            if want is None or ((c0, s) < (want[0], want[2]) and (c1, e) > (want[0], want[1])):
                if leaf:
                    out.append(struct.unpack_from(f"{o}2Q", data, item + 16))
                else:
                    nodes.append(struct.unpack_from(f"{o}Q", data, item + 16)[0])
    return sorted(out)


def big_bed_entries(data: bytes, chrom: str | None = None, start: int | None = None, end: int | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(sequence, start, end, rest) of all entries, of a sequence, or of those that overlap [start, end); an unknown sequence has none."""
    o = _order(data, BIG_BED)
    names = _names(data, o)
    by_id, ids = {i: n for n, i, _ in names}, {n: (i, size) for n, i, size in names}
    if chrom is not None and chrom not in ids:
        return
    want = None if chrom is None else (ids[chrom][0], 0 if start is None else start, 1 << 32 if end is None else end)
    packed = struct.unpack_from(f"{o}I", data, 52)[0]
    for offset, size in _blocks(data, o, want):
        raw = data[offset : offset + size]
        raw = zlib.decompress(raw) if packed else raw
        at = 0
        while at < len(raw):
            c, s, e = struct.unpack_from(f"{o}3I", raw, at)
            stop = raw.index(b"\0", at + 12)
            if want is None or (c == want[0] and s < want[2] and e > want[1]):
                yield by_id[c], s, e, raw[at + 12 : stop].decode()
            at = stop + 1


def big_bed_bytes(entries: Iterable[tuple[str, int, int, str]], sizes: dict[str, int], fields: int = 3, per_block: int = 64) -> bytes:
    """A bigBed file of entries, which are sorted by (sequence, start), with one level of zoom-free index."""
    names = sorted(sizes)
    ids = {n: k for k, n in enumerate(names)}
    key = max((len(n.encode()) for n in names), default=1)
    catalogue = struct.pack("<4I2Q", NAME_TREE, max(1, len(names)), key, 8, len(names), 0) + struct.pack("<2BH", 1, 0, len(names))
    catalogue += b"".join(n.encode().ljust(key, b"\0") + struct.pack("<2I", ids[n], sizes[n]) for n in names)
    groups: list[list[tuple]] = []
    for e in entries:
        if not groups or groups[-1][0][0] != e[0] or len(groups[-1]) == per_block:
            groups.append([])
        groups[-1].append(e)
    at_data = 64 + len(catalogue)
    body, leaves, at, widest, n = [], [], at_data + 8, 0, 0
    for g in groups:
        raw = b"".join(struct.pack("<3I", ids[c], s, e) + rest.encode() + b"\0" for c, s, e, rest in g)
        packed = zlib.compress(raw)
        leaves.append((ids[g[0][0]], g[0][1], ids[g[0][0]], max(e for _, _, e, _ in g), at, len(packed)))
        body.append(packed)
        at, widest, n = at + len(packed), max(widest, len(raw)), n + len(g)
    bounds = (min(x[0] for x in leaves), leaves[0][1], leaves[-1][2], leaves[-1][3]) if leaves else (0, 0, 0, 0)
    index = struct.pack("<2IQ4IQ2I", RANGE_TREE, 256, n, *bounds, at, per_block, 0)
    parts = [leaves[k : k + 256] for k in range(0, len(leaves), 256)]
    if len(parts) > 1:  # a root over the leaves
        first = at + 48 + 4 + 24 * len(parts)
        index += struct.pack("<2BH", 0, 0, len(parts))
        for p in parts:
            index += struct.pack("<4IQ", p[0][0], p[0][1], p[-1][2], max(x[3] for x in p if x[2] == p[-1][2]), first)
            first += 4 + 32 * len(p)
    for p in parts or [[]]:
        index += struct.pack("<2BH", 1, 0, len(p)) + b"".join(struct.pack("<4I2Q", *x) for x in p)
    header = struct.pack("<I2H3Q2H2QIQ", BIG_BED, 4, 0, 64, at_data, at, fields, fields, 0, 0, max(1, widest), 0)
    return b"".join([header, catalogue, struct.pack("<Q", n), *body, index])


def big_bed_sizes(files: DataFrame) -> DataFrame:
    """name and size of the sequences of files (content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                names = _names(data, _order(data, BIG_BED))
                yield pa.RecordBatch.from_pydict({"name": pa.array([n for n, _, _ in names], pa.string()), "size": pa.array([s for _, _, s in names], pa.int64())})

    return files.select("content").mapInArrow(run, "name string, size long")


def big_bed(files: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, n_columns: int | None = None) -> DataFrame:
    """BED columns of the entries of files (content): all, those of a sequence, or those that overlap a range, by the file's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for c, s, e, rest in big_bed_entries(file.as_py(), chrom, start, end):
                    rows.append([c, str(s), str(e), *(rest.split("\t") if rest else [])])
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.list_(pa.string()))})
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.list_(pa.string()))})

    return bed_from_rows(files.select("content").mapInArrow(run, "row array<string>"), n_columns)


def packed(rows: DataFrame, pack, most: int | None = None) -> DataFrame:
    """content: one file, that pack() makes of all rows, in their order, as tuples; for tables that fit a task.

    With most, files of at most that many rows, each of a run of that order, none of no rows: a task holds one of them at a time.
    """
    order = rows.columns[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while most is not None and len(held) >= most:
                yield pa.RecordBatch.from_pydict({"content": pa.array([pack(held[:most])], pa.binary())})
                del held[:most]
        if held or most is None:
            yield pa.RecordBatch.from_pydict({"content": pa.array([pack(held)], pa.binary())})

    dealt = rows.repartition(1) if most is None else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, "content binary")
