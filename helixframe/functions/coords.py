"""Coordinates: half-open ranges on named sequences, with an optional strand and sequence size.

A coordinate is the struct types.COORDS. `strand` says on which strand its numbers are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .util import ColumnOrName, col, required


def coords(name: ColumnOrName, start: ColumnOrName, end: ColumnOrName, strand: ColumnOrName | None = None, size: ColumnOrName | None = None, check: bool = False) -> Column:
    """A coordinate struct; with check, a range that is out of order or out of its sequence is an error."""
    start, end = col(start).cast("bigint"), col(end).cast("bigint")
    strand = F.lit(None).cast("string") if strand is None else col(strand)
    size = F.lit(None).cast("bigint") if size is None else col(size).cast("bigint")
    out = F.struct(col(name).alias("name"), start.alias("start"), end.alias("end"), strand.alias("strand"), size.alias("size"))
    if not check:
        return out
    ok = (start <= end) & (start >= 0) & F.coalesce(end <= size, F.lit(True)) & F.coalesce(strand.isin("+", "-"), F.lit(True))
    return required(ok, out, F.concat(F.lit("invalid range: "), col(name), F.lit(":"), start, F.lit("-"), end))


def parse_coords(text: ColumnOrName, one_based: bool = False, strand: ColumnOrName | None = None, size: ColumnOrName | None = None) -> Column:
    """`name:start-end`, with thousands separators or without, or `name` alone, which is the whole sequence if size is given."""
    text = col(text)
    ranged = text.rlike(r"^[^:]+:[0-9,]+-[0-9,]+$")
    number = lambda k: F.replace(F.regexp_extract(text, r"^[^:]+:([0-9,]+)-([0-9,]+)$", k), F.lit(","), F.lit("")).try_cast("bigint")
    whole = F.lit(None).cast("bigint") if size is None else col(size).cast("bigint")
    start = F.when(ranged, number(1) - int(one_based)).when(whole.isNotNull(), F.lit(0))
    end = F.when(ranged, number(2)).otherwise(whole)
    bad = text.contains(":") & ~ranged
    name = F.when(bad, F.raise_error(F.concat(F.lit("invalid coordinates: "), text)).cast("string")).otherwise(F.substring_index(text, ":", 1))
    return coords(name, start, end, strand, size)


def format_coords(c: Column, one_based: bool = False, commas: bool = False) -> Column:
    """`name:start-end`, or the name alone for a coordinate without a range."""
    number = (lambda n: F.format_number(n, 0)) if commas else (lambda n: n.cast("string"))
    text = F.concat(c["name"], F.lit(":"), number(c["start"] + int(one_based)), F.lit("-"), number(c["end"]))
    return F.when(c["start"].isNull(), c["name"]).otherwise(text)


def length(c: Column) -> Column:
    return c["end"] - c["start"]


def ranges_overlap(start: ColumnOrName, end: ColumnOrName, other_start: ColumnOrName, other_end: ColumnOrName) -> Column:
    """Half-open overlap: ranges that touch don't."""
    return (col(start) < col(other_end)) & (col(end) > col(other_start))


def overlap_size(start: ColumnOrName, end: ColumnOrName, other_start: ColumnOrName, other_end: ColumnOrName) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(col(end), col(other_end)) - F.greatest(col(start), col(other_start)))


def reverse_strand(strand: ColumnOrName) -> Column:
    """The other strand; null for null, an error for anything but + and -."""
    s = col(strand)
    return F.when(s.isNull(), F.lit(None).cast("string")).when(s == "+", "-").when(s == "-", "+").otherwise(F.raise_error(F.concat(F.lit("invalid strand: "), s)))


def reverse_start(end: ColumnOrName, size: ColumnOrName) -> Column:
    return col(size) - col(end)


def reverse_end(start: ColumnOrName, size: ColumnOrName) -> Column:
    return col(size) - col(start)


def reverse(c: Column) -> Column:
    """The same bases measured on the other strand; needs the sequence size. A null strand stays null."""
    out = coords(c["name"], c["size"] - c["end"], c["size"] - c["start"], reverse_strand(c["strand"]), c["size"])
    return required(c["size"].isNotNull(), out, "reversing needs the sequence size")


def abs_start(c: Column) -> Column:
    """Start on the forward strand; a null strand is treated as -."""
    return F.when(c["strand"] == "+", c["start"]).otherwise(c["size"] - c["end"])


def abs_end(c: Column) -> Column:
    return F.when(c["strand"] == "+", c["end"]).otherwise(c["size"] - c["start"])


def absolute(c: Column) -> Column:
    """On the forward strand; a null strand is left alone."""
    return F.when(c["strand"] == "-", reverse(c)).otherwise(c)


def overlaps(a: Column, b: Column) -> Column:
    """Overlap on the same sequence. A null strand is +; opposite strands compare after reversing one by its size."""
    same = F.coalesce(a["strand"], F.lit("+")) == F.coalesce(b["strand"], F.lit("+"))
    turned = required(b["size"].isNotNull(), ranges_overlap(a["start"], a["end"], b["size"] - b["end"], b["size"] - b["start"]), "opposite strands need the sequence size")
    return (a["name"] == b["name"]) & F.when(same, ranges_overlap(a["start"], a["end"], b["start"], b["end"])).otherwise(turned)


def overlaps_strand(a: Column, b: Column) -> Column:
    """Overlap with equal strands, null being a strand of its own."""
    return (a["name"] == b["name"]) & a["strand"].eqNullSafe(b["strand"]) & ranges_overlap(a["start"], a["end"], b["start"], b["end"])


def contains(a: Column, b: Column) -> Column:
    """b lies within a; strands are ignored."""
    return (a["name"] == b["name"]) & (b["start"] >= a["start"]) & (b["end"] <= a["end"])


def equal_location(a: Column, b: Column) -> Column:
    return a["name"].eqNullSafe(b["name"]) & a["start"].eqNullSafe(b["start"]) & a["end"].eqNullSafe(b["end"]) & a["strand"].eqNullSafe(b["strand"])


def equal_absolute_location(a: Column, b: Column) -> Column:
    """The same bases, whichever strands they are measured on."""
    turned = (a["start"] == b["size"] - b["end"]) & (a["end"] == b["size"] - b["start"])
    same = (a["start"] == b["start"]) & (a["end"] == b["end"])
    return (a["name"] == b["name"]) & F.when(a["strand"].eqNullSafe(b["strand"]), same).otherwise(F.coalesce(turned, F.lit(False)))


def intersect(a: Column, b: Column) -> Column:
    """The common range; null on different sequences, of zero length if they don't overlap."""
    start = F.greatest(a["start"], b["start"])
    return F.when(a["name"] == b["name"], coords(a["name"], start, F.greatest(start, F.least(a["end"], b["end"])), a["strand"], a["size"]))


def subrange(c: Column, start: ColumnOrName, end: ColumnOrName, strand: ColumnOrName | None = None) -> Column:
    """A part of c given on c's own strand, or on another, in which case it is reversed first; outside of c is an error."""
    start, end = col(start), col(end)
    if strand is not None:
        other = ~col(strand).eqNullSafe(c["strand"])
        start, end = F.when(other, c["size"] - end).otherwise(start), F.when(other, c["size"] - start).otherwise(end)
    return required((start >= c["start"]) & (end <= c["end"]) & (start <= end), c.withField("start", start).withField("end", end), "range isn't within the coordinate")


def adjust(c: Column, **fields: ColumnOrName) -> Column:
    """A copy with fields replaced."""
    for name, value in fields.items():
        c = c.withField(name, col(value))
    return c


def sort_key(c: Column) -> list[Column]:
    """Order by name, start, end and strand, null strands first."""
    return [c["name"].asc(), c["start"].asc(), c["end"].asc(), c["strand"].asc_nulls_first()]


# reading frames


def phase_to_frame(phase: ColumnOrName) -> Column:
    """GFF phase to frame: 0, 1, 2 to 0, 2, 1; `.` and null to null."""
    p = col(phase).cast("string")
    return F.when(p == "0", 0).when(p == "1", 2).when(p == "2", 1).when(p.isNull() | (p == "."), F.lit(None).cast("int")).otherwise(F.raise_error(F.concat(F.lit("invalid phase: "), p)))


def frame_to_phase(frame: ColumnOrName) -> Column:
    f = col(frame)
    return F.when(f == 0, 0).when(f == 1, 2).when(f == 2, 1)


def frame_add(frame: ColumnOrName, amount: ColumnOrName) -> Column:
    """The frame `amount` bases on (or back, if negative)."""
    return F.pmod(col(frame) + col(amount), F.lit(3)).cast("int")


def valid_frame(frame: ColumnOrName) -> Column:
    """0 to 2 as it is, negative values and null to null, more than 2 an error."""
    f = col(frame)
    return F.when(f < 0, F.lit(None).cast("int")).when(f <= 2, f.cast("int")).when(f.isNull(), F.lit(None).cast("int")).otherwise(F.raise_error("frame must be 0, 1 or 2"))
