"""Sorted arrays of blocks struct<start,end>: one row is one annotation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..types import BLOCKS
from .util import ColumnOrName, bind, col, total


def block(start: ColumnOrName, end: ColumnOrName) -> Column:
    return F.struct(col(start).cast("bigint").alias("start"), col(end).cast("bigint").alias("end"))


def coverage(blocks: ColumnOrName) -> Column:
    """Bases in blocks."""
    return total(col(blocks), lambda b: b["end"] - b["start"])


def span(blocks: ColumnOrName) -> Column:
    """From the first start to the largest end, as a range; null if there are no blocks."""
    b = col(blocks)
    lo, hi = F.array_min(F.transform(b, lambda x: x["start"])), F.array_max(F.transform(b, lambda x: x["end"]))
    return F.when(F.size(b) > 0, block(lo, hi))


def pairs(blocks: ColumnOrName) -> Column:
    """Neighbouring blocks as struct<before,after>."""
    none = F.slice(F.transform(F.array(F.lit(1)), lambda i: F.struct(block(i, i).alias("before"), block(i, i).alias("after"))), 1, 0)
    return bind(col(blocks), lambda b: F.when(F.size(b) > 1, F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: F.struct(F.get(b, i - 1).alias("before"), F.get(b, i).alias("after")))).otherwise(none))


def gaps(blocks: ColumnOrName, least: int | None = None) -> Column:
    """Ranges between neighbouring blocks, of at least `least` bases if given."""
    out = F.transform(pairs(blocks), lambda p: block(p["before"]["end"], p["after"]["start"]))
    return out if least is None else F.filter(out, lambda g: g["end"] - g["start"] >= least)


def clip(blocks: ColumnOrName, start: ColumnOrName, end: ColumnOrName) -> Column:
    """The parts of blocks within a range; blocks outside are dropped."""
    start, end = col(start), col(end)
    return F.filter(F.transform(col(blocks), lambda b: block(F.greatest(b["start"], start), F.least(b["end"], end))), lambda b: b["start"] < b["end"])


def merge(blocks: ColumnOrName, adjacent: bool = True) -> Column:
    """Blocks in order, overlapping ones joined; with adjacent, touching ones too."""

    def add(done: Column, b: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (b["start"] <= last["end"]) if adjacent else (b["start"] < last["end"])
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(block(last["start"], F.greatest(last["end"], b["end"]))))
        return F.when((F.size(done) > 0) & joins, longer).otherwise(F.concat(done, F.array(block(b["start"], b["end"]))))

    return F.aggregate(F.sort_array(F.transform(col(blocks), lambda b: block(b["start"], b["end"]))), F.array().cast(BLOCKS), add)


def shift(blocks: ColumnOrName, by: ColumnOrName) -> Column:
    return F.transform(col(blocks), lambda b: block(b["start"] + col(by), b["end"] + col(by)))


def reverse(blocks: ColumnOrName, size: ColumnOrName) -> Column:
    """Blocks measured on the other strand, in order."""
    return F.reverse(F.transform(col(blocks), lambda b: block(col(size) - b["end"], col(size) - b["start"])))


def overlap_size(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The sum, over all pairs of blocks, of the bases that they share."""
    b = col(b)
    shared = lambda x, y: F.greatest(F.lit(0).cast("bigint"), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))
    return total(col(a), lambda x: total(b, lambda y: shared(x, y)))


def any_overlap(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.exists(col(a), lambda x: F.exists(col(b), lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])))


def all_contained(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Every block of b lies within a block of a."""
    return F.forall(col(b), lambda y: F.exists(col(a), lambda x: (y["start"] >= x["start"]) & (y["end"] <= x["end"])))


def containing(blocks: ColumnOrName, position: ColumnOrName) -> Column:
    """The first block that holds a position, or null."""
    p = col(position)
    return F.get(F.filter(col(blocks), lambda b: (b["start"] <= p) & (p < b["end"])), F.lit(0))


def from_lists(starts: ColumnOrName, sizes: ColumnOrName, offset: ColumnOrName | None = None) -> Column:
    """Blocks from parallel arrays of starts (less an offset) and sizes."""
    by = F.lit(0) if offset is None else col(offset)
    return F.zip_with(col(starts), col(sizes), lambda s, n: block(s + by, s + by + n))


def add(blocks: ColumnOrName, start: ColumnOrName, end: ColumnOrName, within: tuple[ColumnOrName, ColumnOrName] | None = None) -> Column:
    """Blocks with one more at the end; outside of the bounds, or in front of the last block, is an error."""
    b, start, end = col(blocks), col(start), col(end)
    ok = (start <= end) & F.coalesce(F.get(b, F.size(b) - 1)["end"] <= start, F.lit(True))
    if within:
        ok = ok & (start >= col(within[0])) & (end <= col(within[1]))
    return F.when(ok, F.array_append(b, block(start, end))).otherwise(F.raise_error("block is out of order or bounds"))
