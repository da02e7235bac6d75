"""Interval tables: overlap joins, islands, flattening, gaps, ranges of sequences.

Overlap joins hash on (sequence, cell) instead of comparing all pairs. Cells are as wide as the ranges are long, by one
aggregate over both sides: a range of the left is in the cell of its start, one of the right in all cells from which a left
range can reach it, so a pair meets exactly once and a cell holds little else than hits. Long ranges have wider cells of
their own. Cells also spread a long sequence over many tasks; the equi-join is one that adaptive execution may broadcast or
split where skewed. Stored tables are searched by the published bins (`with_bin`, `range_select`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bins import calc_bin, overlap_predicate
from ..functions.coords import ranges_overlap
from ..functions.util import ascending


def with_bin(df: DataFrame, start: str = "start", end: str = "end", name: str = "bin") -> DataFrame:
    """df with the bin of each range, as a table to be searched is stored."""
    return df.withColumn(name, calc_bin(start, end))


def check_strands(df: DataFrame, strand: str = "strand") -> DataFrame:
    """One row, `homogeneous`: whether all rows have a strand or none has."""
    return df.agg((F.count(strand).isin(0) | (F.count(strand) == F.count("*"))).alias("homogeneous"))


#: A range of the right spans some 2 ** SPREAD cells at most; a longer one belongs to the next level, whose cells are as much wider.
SPREAD = 6


def cell_levels(lengths: DataFrame) -> list[int]:
    """Shifts of the cells of each level, from one aggregate over a column `length`: the first holds nine ranges of ten."""
    found = lengths.where("length > 0").agg(F.percentile_approx("length", 0.9, 1000).alias("usual"), F.max("length").alias("longest")).first()
    shifts = [max(4, ((found["usual"] or 1) - 1).bit_length())]
    while found["longest"] and found["longest"] > 1 << shifts[-1]:
        shifts.append(shifts[-1] + SPREAD)
    return shifts


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chrom",), start: str = "start", end: str = "end", how: str = "inner", suffix: str = "_r", right_start: str | None = None, right_end: str | None = None, shifts: Sequence[int] | None = None
) -> DataFrame:
    """Rows of left with rows of right whose ranges overlap on equal keys (add the strand to the keys for stranded search).

    how is inner, left, left_semi or left_anti. Columns of right get the suffix. Empty ranges match nothing; rows with a null
    key or bound match nothing. Both sides are read once more for the lengths of their ranges, unless shifts are given (the
    width of cells of each level, as a power of two; the last at least as long as the longest range of left) or left is a stream,
    whose cells are those of the published bins.
    """
    right_start, right_end = right_start or start, right_end or end
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    if shifts is None:
        if left.isStreaming or right.isStreaming:
            shifts = [17, 23, 29, 32]
        else:
            shifts = cell_levels(left.select((F.col(end) - F.col(start)).alias("length")).unionAll(right.select((F.col(right_end) - F.col(right_start)).alias("length"))))
    named = right.select(*(F.col(c).alias(c + suffix) for c in right.columns))
    same = [F.col(k) == F.col(k + suffix) for k in keys]
    hit = reduce(and_, same, ranges_overlap(start, end, right_start + suffix, right_end + suffix) & (F.col(end) > F.col(start)))
    names = [*left.columns, *named.columns]
    if how == "inner":
        # a pair meets in the cells of the wider of both levels; rows name their own level and each that the other side may have
        asked = left.withColumn("__mine", _level(F.col(end) - F.col(start), shifts)).withColumn("__other", _all_levels("__mine", shifts))
        asked = asked.withColumn("__level", F.greatest("__mine", "__other")).withColumn("__cell", _cell(F.col(start).cast("long"), shifts))
        stored = _stored(named, right_start + suffix, right_end + suffix, shifts)
        meet = (F.col("__mine") == F.col("__asked_r")) & (F.col("__other") == F.col("__own")) & (F.col("__cell") == F.col("__cell_r"))
        return asked.join(stored, meet & hit).select(*(F.col(f"`{c}`") for c in names))
    if how == "left" and len(shifts) > 1:
        pairs = overlap_join(left, right, keys, start, end, "inner", suffix, right_start, right_end, shifts)
        return pairs.unionByName(overlap_join(left, right, keys, start, end, "left_anti", suffix, right_start, right_end, shifts), allowMissingColumns=True)
    # a range of left is in one cell of a level, so that it meets each match once and no pair has to be made
    rest, found = left, None
    for k, shift in enumerate(shifts):
        own = _level(F.col(end) - F.col(start), shifts)
        asked = rest.withColumn("__cell", F.when(own <= k, F.shiftright(F.col(start).cast("long"), shift)))
        stored = _stored(named, right_start + suffix, right_end + suffix, shifts, k)
        on = (F.col("__cell") == F.col("__cell_r")) & hit & (F.greatest(own, F.col("__own")) == k)
        if how == "left":
            return asked.join(stored, on, "left").select(*(F.col(f"`{c}`") for c in names))
        if how == "left_semi":
            some = asked.join(stored, on, "left_semi").drop("__cell")
            found = some if found is None else found.unionAll(some)
        if how == "left_anti" or k < len(shifts) - 1:
            rest = asked.join(stored, on, "left_anti").drop("__cell")
    return found if how == "left_semi" else rest


def _level(length: Column, shifts: Sequence[int], spread: int = 0) -> Column:
    """The first level whose cells hold the length, or 2 ** spread cells of which do; null for null."""
    out = F.when(length.isNull(), None)
    for k, s in enumerate(shifts[:-1]):
        out = out.when(length <= 1 << (s + spread), k)
    return out.otherwise(len(shifts) - 1)


def _all_levels(own: str, shifts: Sequence[int]) -> Column:
    return F.explode(F.when(F.col(own).isNotNull(), F.sequence(F.lit(0), F.lit(len(shifts) - 1))))


def _cell(at: Column, shifts: Sequence[int], level: str = "__level") -> Column:
    out = F.shiftright(at, shifts[0])
    for k, s in enumerate(shifts[1:], 1):
        out = F.when(F.col(level) == k, F.shiftright(at, s)).otherwise(out)
    return out


def _stored(rows: DataFrame, start: str, end: str, shifts: Sequence[int], level: int | None = None) -> DataFrame:
    """rows in every cell (__cell_r, of a level, or of each level __asked_r of a left range) where a left range that overlaps them can start."""
    lo, hi = F.col(start).cast("long"), F.col(end).cast("long")
    out = rows.withColumn("__own", _level(hi - lo, shifts, SPREAD))
    if level is None:
        out = out.withColumn("__asked_r", _all_levels("__own", shifts)).withColumn("__level_r", F.greatest("__own", "__asked_r"))
        first = _cell(lo + 1, shifts, "__level_r") - 1  # a left range is no longer than a cell
        last = _cell(hi - 1, shifts, "__level_r") + 1
    else:
        out = out.where(F.col("__own") <= level)
        first, last = F.shiftright(lo + 1, shifts[level]) - 1, F.shiftright(hi - 1, shifts[level]) + 1
    return out.withColumn("__cell_r", F.explode(F.when(hi > lo, ascending(first, last))))


def range_select(df: DataFrame, seq: str, start: int | None, end: int | None, strand: str | Sequence[str] | None = None, where: Column | None = None, seq_col: str = "chrom", start_col: str = "start", end_col: str = "end", strand_col: str = "strand", bin_col: str | None = None) -> DataFrame:
    """Rows that overlap a constant range; without a start the whole sequence; strand is one, several or any."""
    if start is None:
        out = df.where(F.col(seq_col) == seq)
    elif bin_col:
        out = df.where(overlap_predicate(bin_col, seq_col, start_col, end_col, seq, start, end))
    else:
        out = df.where((F.col(seq_col) == seq) & (F.col(start_col) < end) & (F.col(end_col) > start))
    if strand is not None:
        out = out.where(F.col(strand_col).isin([strand] if isinstance(strand, str) else list(strand)))
    return out if where is None else out.where(where)


#: Sorted passes along a sequence go region by region, of 2 ** REGION bases, so that no task has a whole sequence.
REGION = 20


def _with_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the other columns of a table of one row for each value of keys, of which any may be null."""
    named = groups.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))
    return df.join(named, same).drop(*(f"__key_{k}" for k in keys))


def with_islands(df: DataFrame, keys: Sequence[str] = ("chrom",), start: str = "start", end: str = "end", adjacent: bool = False, name: str = "island") -> DataFrame:
    """df with the number of each row's island within its keys: rows that overlap, directly or through others, are together.

    With adjacent, touching ranges join as well. An island starts where no earlier range reaches. Each region of a sequence
    is sorted by itself; how far earlier regions reach, and how many islands they open, are sums over a row per region.
    """
    group = [*keys, "__region"]
    rows = df.withColumn("__region", F.shiftright(F.col(start).cast("long"), REGION))
    order = Window.partitionBy(*group).orderBy(start, F.col(end).desc())
    earlier = Window.partitionBy(*keys).orderBy("__region").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*group).agg(F.max(end).alias("__end")).withColumn("__carry", F.max("__end").over(earlier)).drop("__end")
    reached = _with_groups(rows.withColumn("__local", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))), carried, group)
    reached = reached.withColumn("__reach", F.greatest("__local", "__carry"))
    apart = (F.col(start) > F.col("__reach")) if adjacent else (F.col(start) >= F.col("__reach"))
    flagged = reached.withColumn("__new", (F.col("__reach").isNull() | apart).cast("long")).drop("__local", "__carry", "__reach")
    opened = flagged.groupBy(*group).agg(F.sum("__new").alias("__opened"))
    opened = opened.withColumn("__before", F.coalesce(F.sum("__opened").over(earlier), F.lit(0))).drop("__opened")
    flags_first = Window.partitionBy(*group).orderBy(start, F.col(end).desc(), F.col("__new").desc())  # of equal ranges one is flagged
    out = _with_groups(flagged.withColumn("__nth", F.sum("__new").over(flags_first.rowsBetween(Window.unboundedPreceding, 0))), opened, group)
    return out.withColumn(name, F.col("__before") + F.col("__nth")).drop("__region", "__new", "__nth", "__before")


def merge_islands(df: DataFrame, keys: Sequence[str] = ("chrom",), start: str = "start", end: str = "end", adjacent: bool = False, **aggregates: Column) -> DataFrame:
    """One row per island: keys, start, end and the given aggregates, which must not depend on the rows' order."""
    islands = with_islands(df, keys, start, end, adjacent, "__island")
    out = islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), *(a.alias(n) for n, a in aggregates.items()))
    return out.drop("__island")


def flatten(df: DataFrame, stranded: bool = True, prefix: str = "", chrom: str = "chrom", start: str = "start", end: str = "end", strand: str = "strand") -> DataFrame:
    """Groups of overlapping annotations as one each: chrom, start, end, name (prefix and number in genome order), strand, n_merged."""
    keys = [chrom, strand] if stranded else [chrom]
    merged = merge_islands(df, keys, start, end, False, n_merged=F.count("*"), **({} if stranded else {strand: F.lit("+")}))
    return number_in_order(merged, chrom, [start, end, strand], "__n").withColumn("name", F.concat(F.lit(prefix), F.col("__n"))).select(chrom, start, end, "name", strand, "n_merged")


def number_in_order(df: DataFrame, group: str, order: Sequence[str], name: str, first: int = 1) -> DataFrame:
    """df with row numbers in the order of (group, *order), nulls of named columns last: numbers within each group, plus the rows of smaller groups.

    No task sorts more than one group; the counts, a row per group, are all that is summed in one place.
    """
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*(F.asc_nulls_last(c) if isinstance(c, str) else c for c in order)))
    counts = df.groupBy(group).agg(F.count("*").alias("__count"))
    before = Window.orderBy(F.asc_nulls_last(group)).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("__group"), F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
    numbered = df.withColumn("__nth", nth).join(starts, F.col(group).eqNullSafe(F.col("__group")))
    return numbered.withColumn(name, F.col("__before") + F.col("__nth") + (first - 1)).drop("__nth", "__before", "__group")


def sequence_ranges(df: DataFrame, keys: Sequence[str] = ("chrom",), start: str = "start", end: str = "end") -> DataFrame:
    """The first start and last end of each sequence (and strand, if among the keys)."""
    return df.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end))


def sequence_ids(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    return df.select(chrom).distinct()


def gaps_between(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Uncovered ranges between the islands of each key."""
    islands = merge_islands(df, keys, start, end, adjacent=True)
    order = Window.partitionBy(*keys).orderBy(start)
    return islands.withColumn("__from", F.lag(end).over(order)).where("__from IS NOT NULL").select(*keys, F.col("__from").alias(start), F.col(start).alias(end))


def remove_entry(df: DataFrame, **values) -> DataFrame:
    """df without one of the rows that equal the given values; an absent entry changes nothing."""
    matches = F.lit(True)
    for c, v in values.items():
        matches = matches & F.col(c).eqNullSafe(F.lit(v))
    nth = Window.partitionBy("__hit").orderBy(*df.columns)
    hit = df.where(matches).withColumn("__hit", F.lit(1)).withColumn("__nth", F.row_number().over(nth)).where("__nth > 1").select(*df.columns)
    return df.where(~matches).unionByName(hit)
