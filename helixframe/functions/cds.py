"""The coding range of a sequence that alignments carry with them: on the other strand, on a part, and extended."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .util import ColumnOrName, col


def _range(start: Column, end: Column) -> Column:
    """A range, or null if it is empty or one of its bounds is null."""
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))


def reversed_range(start: ColumnOrName, end: ColumnOrName, size: ColumnOrName) -> Column:
    """The range on the other strand of a sequence of `size` bases."""
    return _range(col(size) - col(end), col(size) - col(start))


def part_range(cds_start: ColumnOrName, cds_end: ColumnOrName, start: ColumnOrName, end: ColumnOrName) -> Column:
    """What of the CDS lies in [start, end), or null."""
    return _range(F.greatest(col(cds_start), col(start)), F.least(col(cds_end), col(end)))


def extended_range(cds_start: ColumnOrName, cds_end: ColumnOrName, start: ColumnOrName, end: ColumnOrName, least: ColumnOrName, most: ColumnOrName) -> Column:
    """The CDS, or nothing if it is null, extended over [start, end), both clamped to the sequence's [least, most)."""
    lo, hi = F.greatest(col(least), F.least(F.coalesce(col(cds_start), col(start)), col(start))), F.least(col(most), F.greatest(F.coalesce(col(cds_end), col(end)), col(end)))
    return _range(lo, hi)
