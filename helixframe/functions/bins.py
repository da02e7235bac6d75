"""Hierarchical bins for ranges: five levels of 128 kb to 512 Mb, and an extended scheme of six levels to 4 Gb beyond."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .util import ColumnOrName, ascending, col

#: Fixed values of the published binning scheme: shift of the smallest bins, of each level above, and the levels' first bins.
FIRST_SHIFT, NEXT_SHIFT = 17, 3
BASIC_END = 512 * 1024 * 1024
BASIC_OFFSETS = (585, 73, 9, 1, 0)
EXTENDED_START = 4681
EXTENDED_OFFSETS = (4681, 585, 73, 9, 1, 0)


def _smallest(start: Column, end: Column, base: int, offsets: tuple[int, ...], none: Column) -> Column:
    out = None
    for level, offset in enumerate(offsets):
        shift = FIRST_SHIFT + NEXT_SHIFT * level
        first, last = F.shiftright(start, shift), F.shiftright(end - 1, shift)
        bin_ = first + (base + offset)
        out = F.when(first == last, bin_) if out is None else out.when(first == last, bin_)
    return out.otherwise(none)


def calc_bin(start: ColumnOrName, end: ColumnOrName, extended: bool = True) -> Column:
    """The smallest bin that holds the range; without the extended scheme, the basic one goes on beyond its end, and a range that no bin of it holds has none (null)."""
    start, end = col(start).cast("bigint"), col(end).cast("bigint")
    if not extended:
        return _smallest(start, end, 0, BASIC_OFFSETS, F.lit(None).cast("bigint"))
    wrong = F.raise_error("range can't be binned").cast("bigint")
    return F.when(end <= BASIC_END, _smallest(start, end, 0, BASIC_OFFSETS, wrong)).otherwise(_smallest(start, end, EXTENDED_START, EXTENDED_OFFSETS, wrong))


def _levels(start: Column, end: Column, base: int, offsets: tuple[int, ...]) -> Column:
    parts = []
    for level, offset in enumerate(offsets):
        shift = FIRST_SHIFT + NEXT_SHIFT * level
        parts.append(ascending(F.shiftright(start, shift) + (base + offset), F.shiftright(end - 1, shift) + (base + offset + 1)))
    return F.concat(*parts)


def overlapping_bins(start: ColumnOrName, end: ColumnOrName, extended: bool = True) -> Column:
    """Every bin that can hold a range which overlaps this one; none for an empty range. Without the extended scheme, the basic one goes on beyond its end."""
    start, end = col(start).cast("bigint"), col(end).cast("bigint")
    none = F.array().cast("array<bigint>")
    basic = F.concat(_levels(start, end, 0, BASIC_OFFSETS), F.array(F.lit(EXTENDED_START).cast("bigint")))
    both = _levels(start, F.lit(BASIC_END).cast("bigint"), 0, BASIC_OFFSETS)
    if not extended:
        return F.when(end <= start, none).otherwise(basic)
    beyond = F.concat(F.when(start < BASIC_END, both).otherwise(none), _levels(start, end, EXTENDED_START, EXTENDED_OFFSETS))
    return F.when(end <= start, none).when(end <= BASIC_END, basic).otherwise(beyond)


def overlap_spans(start: int, end: int, extended: bool = True) -> list[tuple[int, int]]:
    """Runs of bins, from and to, that can hold a range which overlaps [start, end); without the extended scheme, beside the rows without a bin."""
    if not extended:
        shifts = [FIRST_SHIFT + NEXT_SHIFT * level for level in range(len(BASIC_OFFSETS))]
        return [((start >> s) + offset, ((end - 1) >> s) + offset) for s, offset in zip(shifts, BASIC_OFFSETS)]
    schemes = [(0, BASIC_OFFSETS, start, min(end, BASIC_END))] if start < BASIC_END else []
    spans = []
    if end > BASIC_END:
        schemes.append((EXTENDED_START, EXTENDED_OFFSETS, start, end))
    else:
        spans.append((EXTENDED_START, EXTENDED_START))
    for base, offsets, lo, hi in schemes:
        for level, offset in enumerate(offsets):
            shift = FIRST_SHIFT + NEXT_SHIFT * level
            spans.append(((lo >> shift) + base + offset, ((hi - 1) >> shift) + base + offset))
    return spans


def overlap_predicate(bin_: ColumnOrName, seq: ColumnOrName, start: ColumnOrName, end: ColumnOrName, want_seq: str, want_start: int, want_end: int, extended: bool = True) -> Column:
    """Rows of a binned table that overlap a constant range; the bins prune row groups and partitions by their statistics."""
    in_bins = F.lit(False) if extended else col(bin_).isNull()
    for lo, hi in overlap_spans(want_start, want_end, extended):
        in_bins = in_bins | ((col(bin_) == lo) if lo == hi else col(bin_).between(lo, hi))
    return (col(seq) == want_seq) & (col(start) < want_end) & (col(end) > want_start) & in_bins


def overlap_condition(seq: str, start: str, end: str, want_seq: str, want_start: int, want_end: int, bin_: str | None = "bin") -> str:
    """The same as the text of a WHERE clause, for databases that keep binned tables; without bins if bin_ is None."""
    name = want_seq.replace("'", "''")
    parts = [f"{seq} = '{name}'", f"{start} < {int(want_end)}", f"{end} > {int(want_start)}"]
    if bin_ is not None:
        parts.append("(" + " OR ".join(f"{bin_} = {lo}" if lo == hi else f"{bin_} BETWEEN {lo} AND {hi}" for lo, hi in overlap_spans(want_start, want_end)) + ")")
    return " AND ".join(parts)
