"""Shards cut from a Hilbert-curve order of several metadata dimensions (operator 10).

Each dimension is quantised to 2**bits cells, a row's cells give its index on the Hilbert curve, rows are sorted by it, and
the order is cut into runs of equal row counts: near rows of the order are near in every dimension, so the files of a shard
have narrow ranges in all of them. Everything is Column arithmetic; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import running_start, tidied, written


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """The index on the Hilbert curve of a point with coordinates 0 <= cell < 2**bits, by Skilling's transposition.

    One Gray-code pass per bit, then the bits of the dimensions are interleaved. len(cells) * bits may be up to 62.
    """
    n = len(cells)
    point = F.array(*(c.cast("long") for c in cells))

    def step(p: Column, change: Callable[[list[Column]], list[Column] | Column]) -> Column:
        """change(coordinates) of p; the lambda's variable keeps p from being written out once per use."""

        def body(v: Column) -> Column:
            out = change([F.get(v, F.lit(i)) for i in range(n)])
            return F.array(*out) if isinstance(out, list) else out

        return F.get(F.transform(F.array(p), body), F.lit(0))

    for b in range(bits - 1, 0, -1):
        for i in range(n):
            point = step(point, partial(_undo, i=i, q=1 << b, low=(1 << b) - 1))
    for i in range(1, n):
        point = step(point, partial(_gray, i=i))

    def turned(x: list[Column]) -> list[Column]:
        t = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(x[-1].bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return [c.bitwiseXOR(t) for c in x]

    def woven(x: list[Column]) -> Column:
        return sum((F.shiftleft(F.shiftright(x[j], b).bitwiseAND(1), b * n + n - 1 - j) for b in range(bits) for j in range(n)), F.lit(0).cast("long"))

    return step(step(point, turned), woven)


def _gray(x: list[Column], i: int) -> list[Column]:
    return [c.bitwiseXOR(x[i - 1]) if j == i else c for j, c in enumerate(x)]


def _undo(x: list[Column], i: int, q: int, low: int) -> list[Column]:
    """Invert the low bits of axis 0 if axis i has bit q, else exchange them between the two."""
    has, out = x[i].bitwiseAND(q) != 0, list(x)
    t = F.when(has, F.lit(0)).otherwise(x[0].bitwiseXOR(x[i]).bitwiseAND(low))
    out[0] = x[0].bitwiseXOR(F.when(has, F.lit(low).cast("long")).otherwise(t))
    if i:
        out[i] = x[i].bitwiseXOR(t)
    return out


def log_cell(amount: Column, bits: int) -> Column:
    """Quantise a size on a logarithmic scale, two cells to a doubling; null counts as 0."""
    cell = F.floor(2 * F.log2(F.coalesce(amount, F.lit(0)).cast("double") + 1))
    return F.least(F.lit((1 << bits) - 1), cell).cast("long")


def _counted(ordered: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows of a sorted table with _task and _nth: their place in their partition, or what `weight` of the rows before sums to."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            size = np.ones(b.num_rows, np.int64) if weight is None else b.column(b.schema.get_field_index(weight)).to_numpy()
            upto = n + np.cumsum(size)
            extra = [pa.array([task] * b.num_rows, pa.int32()), pa.array(upto - size)]
            n = int(upto[-1]) if len(upto) else n
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "_task", "_nth"])

    schema = ", ".join(f"`{n}` {t}" for n, t in ordered.dtypes) + ", _task int, _nth long"
    return ordered.mapInArrow(tidied(number), schema)


def with_name_cell(rows: DataFrame, name: str, cell: str, bits: int) -> DataFrame:
    """rows with the cell of a category of any number of values: 2**bits ranges of names in their order, of equal row counts.

    A name's cell is the share of rows with smaller names, so near names share a cell, and a file's least and greatest name
    are near. Null is the smallest name. Names are counted before they are sorted; their table is broadcast only if small.
    """
    counts = rows.groupBy(F.col(f"`{name}`").alias("_name")).agg(F.count("*").alias("_n"))
    ordered = counts.repartitionByRange(F.col("_name").asc_nulls_first()).sortWithinPartitions(F.col("_name").asc_nulls_first())
    counted = written(_counted(ordered, "_n"), "names")
    total = counted.agg(F.sum("_n")).first()[0] or 1
    starts = running_start(counted.groupBy("_task").agg(F.sum("_n").alias("n")), "_task", "n", "_start")
    cells = written(counted.join(starts, "_task").select("_name", F.expr(f"((_start + _nth) * {1 << bits}L) DIV {total}L").alias(cell)), "cells")
    return rows.join(cells, F.col(f"`{name}`").eqNullSafe(F.col("_name"))).drop("_name")


def hilbert_order(rows: DataFrame, cells: Sequence[Column], bits: int, ties: Sequence[str], shards: int) -> DataFrame:
    """rows with hilbert (the index), shard (0 to shards - 1) and slot (gapless from 0 in a shard).

    Rows are range-partitioned and sorted by (hilbert, ties), numbered within their partition, and cut at equal counts, so
    shards differ by at most one row. Order the ties so that they tell rows apart: rows equal in all of them get adjacent
    slots in no defined order. One cell with a third of all rows is cut at its ties like any other range. Null ties
    sort first. An empty table gives no rows. Columns hilbert, shard and slot of rows are replaced.
    """
    rows = rows.drop("hilbert", "shard", "slot", "_task", "_nth")
    names = rows.columns
    ordered = rows.withColumn("hilbert", hilbert_index(cells, bits))
    keys = [F.col("hilbert").asc(), *(F.col(f"`{t}`").asc_nulls_first() for t in ties)]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)

    numbered = written(_counted(ordered), "hilbert")
    starts = running_start(numbered.groupBy("_task").agg(F.count("*").alias("n")), "_task", "n", "_start")
    total = numbered.count()
    rank = F.col("_start") + F.col("_nth")
    shard = F.expr(f"((_start + _nth) * {shards}L) DIV {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) DIV {shards}L")
    out = numbered.join(starts, "_task").withColumn("rank", rank).withColumn("shard", shard)
    out = out.withColumn("slot", F.col("rank") - first).withColumn("shard", F.col("shard").cast("int"))
    return out.select(*(F.col(f"`{n}`") for n in names), "hilbert", "shard", "slot")


def document_shards(docs: DataFrame, shards: int = 16, bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, hilbert, shard, slot of every document, by size, language and source.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty. Ties go by text_crc32, then doc_id, so copies lie
    side by side. Null languages and sources are categories of their own kind, before all others.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    rows = written(rows, "rows")
    rows = with_name_cell(with_name_cell(rows, "lang", "_lang_cell", bits), "source", "_source_cell", bits)
    out = hilbert_order(rows, [log_cell(F.col("size"), bits), F.col("_lang_cell"), F.col("_source_cell")], bits, ["text_crc32", "doc_id"], shards)
    return out.drop("_lang_cell", "_source_cell")


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, rows in curve order, so that the files' statistics prune in every dimension."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def oracle(shards: int = 16, bits: int = 5) -> str:
    """document_shards in DuckDB's SQL: a common table expression per step of the curve, and crc32 byte by byte."""
    cell = "CAST(((rank() OVER (ORDER BY {} NULLS FIRST) - 1) * " + str(1 << bits) + ") // count(*) OVER () AS BIGINT)"
    steps = [f"s0 AS (SELECT *, CAST(least({(1 << bits) - 1}, floor(2 * log2(CAST(size AS DOUBLE) + 1))) AS BIGINT) AS x0, {cell.format('lang')} AS x1, {cell.format('source')} AS x2 FROM d)"]

    def step(x0: str, x1: str, x2: str) -> None:
        n = len(steps)
        steps.append(f"s{n} AS (SELECT * EXCLUDE (x0, x1, x2), {x0} AS x0, {x1} AS x1, {x2} AS x2 FROM s{n - 1})")

    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        step(f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {p}) ELSE x0 END", "x1", "x2")
        for i in (1, 2):
            t = f"(xor(x0, x{i}) & {p})"
            moved = f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {t}) END"
            step(f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {t}) END", moved if i == 1 else "x1", moved if i == 2 else "x2")
    step("x0", "xor(x1, x0)", "x2")
    step("x0", "x1", "xor(x2, x1)")
    t = "CAST(0 AS BIGINT)"
    for b in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN x2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    step(f"xor(x0, {t})", f"xor(x1, {t})", f"xor(x2, {t})")
    woven = " + ".join(f"(((x{j} >> {b}) & 1) << {3 * b + 2 - j})" for b in range(bits) for j in range(3))
    last = f"s{len(steps) - 1}"
    crc = "xor(list_reduce(regexp_extract_all(hex(encode(coalesce(text, ''))), '..').list_transform(lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    table = "SELECT list(v ORDER BY k) AS l FROM (SELECT k, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS v FROM range(256) r(k))"
    return f"""WITH crc AS ({table}), d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc} AS text_crc32, lang, source FROM documents, crc),
{', '.join(steps)}, h AS (SELECT doc_id, size, text_crc32, {woven} AS hilbert FROM {last}),
r AS (SELECT *, row_number() OVER (ORDER BY hilbert, text_crc32, doc_id NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM h)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(k * {shards} // n AS INTEGER) AS shard, k - ((k * {shards} // n) * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, hilbert FROM r"""
