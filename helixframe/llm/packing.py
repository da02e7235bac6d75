"""Packing documents into fixed windows by non-negative least squares (operator 2).

Lengths are cut to full windows and remainders. Combinations of at most `depth` remainders that fill a window exactly are
the columns of a sparse system whose right side is the corpus histogram of remainders; its non-negative least-squares
solution says how often to use each combination. Every task is due its share of each count, carries fractions on from round to
round, fills windows by what is due, and packs what is left over greedily, largest first, cutting a document where a window is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import columns, dropped, running_start, table_rows, text_of, tidied, written
from .tokens import encoder

TOKENS = "doc_id long, n_ids long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, local_sequence long, offset long"


def combinations(window: int, depth: int, present: np.ndarray) -> np.ndarray:
    """All multisets of 2 to depth (at most 3) present lengths whose sum is window, as rows padded with 0."""
    ok = np.zeros(window + 1, dtype=bool)
    ok[present] = True
    ok[0] = False
    rows = []
    a = np.arange(1, window // 2 + 1)
    a = a[ok[a] & ok[window - a]]
    rows.append(np.stack([a, window - a, np.zeros_like(a)], axis=1))
    if depth >= 3:
        for x in np.flatnonzero(ok[: window // 3 + 1]):
            b = np.arange(x, (window - x) // 2 + 1)
            b = b[ok[b] & ok[window - x - b]]
            rows.append(np.stack([np.full_like(b, x), b, window - x - b], axis=1))
    return np.concatenate(rows).astype(np.int64) if depth >= 2 else np.zeros((0, 3), np.int64)


def nnls(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the sum of x times the combinations near the histogram (accelerated projected gradient).

    Column k of the system has a 1 for each member of combination k; column 0 of the table (padding) is not a length.
    """
    if not len(combos):
        return np.zeros(0)
    scale = max(1.0, float(histogram.max()))
    h = histogram / scale
    h[0] = 0
    size = len(h)

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(combos[:, j], weights=x, minlength=size) for j in range(combos.shape[1]))
        y[0] = 0
        return y

    def back(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        y[0] = 0
        return y[combos].sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(12):  # power iteration: the largest eigenvalue bounds the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - back(forward(z) - h) / (1.05 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def repeat_counts(combos: np.ndarray, share: np.ndarray, available: np.ndarray) -> np.ndarray:
    """How often to use each combination: the shares rounded, and no more than the available lengths allow."""
    left = available.copy()
    counts = np.zeros(len(combos), dtype=np.int64)
    wanted = np.rint(share).astype(np.int64)
    for k in np.flatnonzero(wanted > 0):
        parts = [p for p in combos[k].tolist() if p]
        n = min(int(wanted[k]), min(int(left[p]) // parts.count(p) for p in parts))
        if n > 0:
            counts[k] = n
            for p in parts:
                left[p] -= n
    return counts


def greedy(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (row, start, length), largest first, into windows; a piece is cut where its window is full.

    What the last window would leave empty isn't padded: its content is cut into sequences whose lengths are powers of two.
    """
    out, open_, room = [], [], window
    for row, start, length in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while length:
            n = min(length, room)
            open_.append((row, start, n))
            start, length, room = start + n, length - n, room - n
            if not room:
                out.append(open_)
                open_, room = [], window
    fill = window - room
    while open_:
        part, room = [], 1 << (fill.bit_length() - 1)
        fill -= room
        while room:
            row, start, length = open_.pop(0)
            n = min(length, room)
            part.append((row, start, n))
            room -= n
            if n < length:
                open_.insert(0, (row, start + n, length - n))
        out.append(part)
    return out


class Packer:
    """Packs one task's documents, some thousands at a time; what a round leaves over stays for the next."""

    def __init__(self, window: int, combos: np.ndarray, counts: np.ndarray, total: float, round_docs: int = 8192, round_ids: int = 1 << 22, task: int = 0):
        self.window, self.combos, self.share, self.round_docs, self.round_ids = window, combos, counts / max(1.0, total), round_docs, round_ids
        self.due = np.random.default_rng(task).random(len(combos))  # a phase of its own, so that tasks together use a rare combination as often as is due
        self.n_rest, self.n_combined = 0, 0
        self.docs: dict[int, list] = {}  # row: [doc_id, ids, n_ids, open pieces]
        self.left: list[tuple[int, int, int]] = []
        self.n_new, self.n_ids, self.n_rows, self.sequence = 0, 0, 0, 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> bool:
        """Take a document; true if a round is full."""
        row, n = self.n_rows, len(ids)
        self.n_rows += 1
        self.docs[row] = [doc_id, ids, n, 1]
        for start in range(0, n - self.window + 1, self.window):
            self._place([(row, start, self.window)])
        rest = n % self.window
        if rest:
            self.left.append((row, n - rest, rest))
            self.n_rest += 1
        else:
            self._close(row)
        self.n_new += 1
        self.n_ids += n
        return self.n_new >= self.round_docs or self.n_ids >= self.round_ids

    def _close(self, row: int) -> None:
        self.docs[row][3] -= 1
        if not self.docs[row][3]:
            del self.docs[row]

    def _place(self, parts: list[tuple[int, int, int]]) -> None:
        offset = 0
        for row, start, length in parts:
            doc_id, ids, n, _ = self.docs[row]
            self.rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), n, self.sequence, offset))
            offset += length
        self.sequence += 1

    def round(self, last: bool = False) -> list[tuple]:
        """Fill windows by the combinations, then, at the end or if too much is left, greedily; the rows placed so far."""
        by_length: dict[int, list] = {}
        for piece in self.left:
            by_length.setdefault(piece[2], []).append(piece)
        have = np.zeros(self.window + 1, dtype=np.int64)
        for length, pieces in by_length.items():
            have[length] = len(pieces)
        self.due += self.share * self.n_rest
        counts = repeat_counts(self.combos, np.floor(self.due), have)
        self.due -= counts
        self.n_rest = 0
        for k in np.flatnonzero(counts).tolist():
            for _ in range(int(counts[k])):
                parts = [by_length[p].pop() for p in self.combos[k].tolist() if p]
                self.n_combined += len(parts)
                self._place(parts)
                for p in parts:
                    self._close(p[0])
        self.left = [p for pieces in by_length.values() for p in pieces]
        if last or len(self.left) > 4 * self.round_docs:
            for parts in greedy(self.left, self.window):
                self._place(parts)
            for p in self.left:
                self._close(p[0])
            self.left = []
        self.n_new = self.n_ids = 0
        rows, self.rows = self.rows, []
        return rows


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids and ids (little-endian, 16 bits wide if the vocabulary allows) of every whole text and its end_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        narrow = max(e.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            raw_ids, ids = e.many(batch.column(1)), batch.column(0)
            for k in range(0, len(raw_ids), 512):
                raw = [i + end for i in raw_ids[k : k + 512]]
                yield pa.RecordBatch.from_pydict({"doc_id": ids[k : k + 512], "n_ids": pa.array([len(r) // 4 for r in raw], pa.int64()), "ids": pa.array([np.frombuffer(r, "<u4").astype("<u2").tobytes() if narrow else r for r in raw], pa.binary())})

    return columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(tidied(encode), TOKENS)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    Every id of every row lies in exactly one piece. Sequences are full, but for at most log2(window) per task whose lengths
    are powers of two. Null and empty texts are documents of one id (end_id). Null or repeated doc_ids and equal rows are
    packed each by itself. An empty table gives no pieces. Only the histogram (window numbers) reaches the driver; ids are
    encoded once, written to the shared folder, and packed where they are read, without a shuffle.
    """
    import public_tokenizers  # noqa: F401  fails here rather than in tasks

    spark = docs.sparkSession
    tokens = written(encode_documents(docs, tokenizer, end_id, id_col, text_col), "tokens")
    histogram = np.zeros(window + 1)
    for r in tokens.groupBy((F.col("n_ids") % window).alias("rest")).count().collect():  # at most `window` rows
        histogram[r["rest"]] = r["count"]
    histogram[0] = 0
    combos = combinations(window, depth, np.flatnonzero(histogram))
    counts = nnls(combos, histogram.copy())
    used = np.argsort(-counts, kind="stable")
    used = used[counts[used] > 0]
    plan = spark.sparkContext.broadcast((combos[used].astype(np.int32), counts[used], float(histogram.sum())))  # some window ** 2 / 12 combinations

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(window, *plan.value, task=task)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc_id, start, length, crc, n, sequence, offset = zip(*rows)
            made = {"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n, pa.int64()), "task": pa.array([task] * len(rows), pa.int32()), "local_sequence": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            return pa.RecordBatch.from_pydict(made)

        for doc_id, n, raw in table_rows(batches, "doc_id", "n_ids", "ids"):
            if packer.add(doc_id, np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")) and (rows := packer.round()):
                yield out(rows)
        if rows := packer.round(last=True):
            yield out(rows)

    pieces = written(tokens.mapInArrow(tidied(pack), PIECES), "pieces")
    if not with_ids:
        dropped(spark, tokens)
    sequences = pieces.groupBy("task").agg((F.max("local_sequence") + 1).alias("n"))
    pieces = pieces.join(running_start(sequences, "task", "n", "first"), "task")
    out = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("local_sequence")).alias("sequence_id"), "offset")
    return _with_ids(spark, out, tokens) if with_ids else out


def _with_ids(spark, pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pieces with their ids (unsigned, as longs); needs distinct, non-null doc_ids."""
    wide = F.length("ids") == 4 * F.col("n_ids")
    step = F.when(wide, 4).otherwise(2).cast("long")
    raw = F.substring(F.col("ids"), (F.col("start") * F.col("step") + 1).cast("int"), (F.col("length") * F.col("step")).cast("int"))

    def value(k):
        at = (k * F.col("step")).cast("int")
        byte = lambda j: F.conv(F.hex(F.substring(F.col("raw"), at + 1 + j, F.lit(1))), 16, 10).cast("long")
        low = byte(0) + 256 * byte(1)
        return F.when(F.col("step") == 4, low + 65536 * byte(2) + 16777216 * byte(3)).otherwise(low)

    joined = pieces.join(tokens.select("doc_id", "ids", step.alias("step")), "doc_id").withColumn("raw", raw)
    return joined.withColumn("ids", F.transform(F.sequence(F.lit(0).cast("long"), F.col("length") - 1), value)).drop("raw", "step")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from pack_documents(with_ids=True): groups of at most `window` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
