"""Gene models: one row is a transcript with exons array<struct<start,end,frame>> in order, and a CDS range."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import blocks as B
from ..functions.coords import ranges_overlap
from ..functions.util import ColumnOrName, bind, col
from ..types import BLOCKS
from .intervals import merge_islands


def _range_or_null(start: Column, end: Column) -> Column:
    return F.when(start < end, B.block(start, end))


def exons_from_lists(starts: ColumnOrName, ends: ColumnOrName, frames: ColumnOrName | None = None) -> Column:
    """Exons from parallel arrays; without frames they are null."""
    starts, ends = col(starts), col(ends)
    frames = F.transform(starts, lambda s: F.lit(None).cast("int")) if frames is None else col(frames)
    zipped = F.arrays_zip(starts.alias("s"), ends.alias("e"), frames.alias("f"))
    return F.transform(zipped, lambda z: F.struct(z["s"].cast("bigint").alias("start"), z["e"].cast("bigint").alias("end"), z["f"].cast("int").alias("frame")))


def cds_range(cds_start: ColumnOrName, cds_end: ColumnOrName) -> Column:
    """The CDS, or null if there is none."""
    return _range_or_null(col(cds_start), col(cds_end))


def exon_cds(exon: Column, cds_start: ColumnOrName, cds_end: ColumnOrName) -> Column:
    """The coding part of an exon, or null."""
    return _range_or_null(F.greatest(exon["start"], col(cds_start)), F.least(exon["end"], col(cds_end)))


def cds_blocks(exons: ColumnOrName = "exons", cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    return B.clip(exons, cds_start, cds_end)


def has_cds(exons: ColumnOrName = "exons", cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    return F.size(cds_blocks(exons, cds_start, cds_end)) > 0


def exon_length(exons: ColumnOrName = "exons") -> Column:
    return B.coverage(exons)


def cds_length(exons: ColumnOrName = "exons", cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    return B.coverage(cds_blocks(exons, cds_start, cds_end))


def cds_exon_count(exons: ColumnOrName = "exons", cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    """Exons from the first to the last that holds CDS."""
    return F.size(cds_blocks(exons, cds_start, cds_end))


def exon_features(exon: Column, strand: ColumnOrName, cds_start: ColumnOrName, cds_end: ColumnOrName) -> Column:
    """struct<utr5,cds,utr3> of ranges, each null if the exon has none; which UTR is which goes by the strand.

    An exon of a gene without CDS whose cds_start = cds_end lies at or behind it is all before or all after the CDS.
    """
    cds_start, cds_end, forward = col(cds_start), col(cds_end), col(strand) == "+"
    head = _range_or_null(exon["start"], F.least(exon["end"], cds_start))
    rest = F.greatest(exon["start"], F.least(exon["end"], cds_start))
    cds = _range_or_null(rest, F.least(exon["end"], cds_end))
    tail = _range_or_null(F.greatest(rest, F.least(exon["end"], cds_end)), exon["end"])
    return F.struct(F.when(forward, head).otherwise(tail).alias("utr5"), cds.alias("cds"), F.when(forward, tail).otherwise(head).alias("utr3"))


def features(exons: ColumnOrName = "exons", strand: ColumnOrName = "strand", cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    return F.transform(col(exons), lambda e: exon_features(e, strand, cds_start, cds_end))


def transcription_order(exons: ColumnOrName = "exons", strand: ColumnOrName = "strand") -> Column:
    return F.when(col(strand) == "-", F.reverse(col(exons))).otherwise(col(exons))


def assign_frames(exons: ColumnOrName = "exons", strand: ColumnOrName = "strand", cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    """Exons with frames: the coding bases before each, in the order of transcription, modulo 3; -1 without CDS."""
    cds_start, cds_end = col(cds_start), col(cds_end)
    coding = lambda e: F.greatest(F.lit(0).cast("bigint"), F.least(e["end"], cds_end) - F.greatest(e["start"], cds_start))

    def framed(ordered: Column) -> Column:
        def before(i: Column) -> Column:
            return F.aggregate(F.slice(ordered, F.lit(1), i), F.lit(0).cast("bigint"), lambda acc, e: acc + coding(e))

        return F.transform(ordered, lambda e, i: e.withField("frame", F.when(coding(e) > 0, F.pmod(before(i), F.lit(3))).otherwise(F.lit(-1)).cast("int")))

    done = bind(transcription_order(exons, strand), framed)
    return F.when(col(strand) == "-", F.reverse(done)).otherwise(done)


def overlaps(start: ColumnOrName, end: ColumnOrName, tx_start: ColumnOrName = "tx_start", tx_end: ColumnOrName = "tx_end") -> Column:
    return ranges_overlap(start, end, tx_start, tx_end)


def in_cds(position: ColumnOrName, cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    return (col(cds_start) <= col(position)) & (col(position) < col(cds_end))


def overlaps_cds(start: ColumnOrName, end: ColumnOrName, cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    return ranges_overlap(start, end, cds_start, cds_end)


def containing_exon(position: ColumnOrName, exons: ColumnOrName = "exons") -> Column:
    return B.containing(exons, position)


def reversed_gene(exons: ColumnOrName, chrom_size: ColumnOrName) -> Column:
    """Exons measured on the other strand, in order; frames stay with their exons."""
    size = col(chrom_size)
    return F.reverse(F.transform(col(exons), lambda e: F.struct((size - e["end"]).alias("start"), (size - e["start"]).alias("end"), e["frame"].alias("frame"))))


_GENE = ("chrom", "strand", "cds_start", "cds_end", "exons")


def _side(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in _GENE}


def exon_overlap(a: str = "a_", b: str = "b_") -> Column:
    """Exon bases that two genes (columns with the prefixes a and b) share on one sequence and strand."""
    x, y = _side(a), _side(b)
    return F.when((x["chrom"] == y["chrom"]) & (x["strand"] == y["strand"]), B.overlap_size(x["exons"], y["exons"])).otherwise(F.lit(0).cast("bigint"))


def cds_overlap(a: str = "a_", b: str = "b_") -> Column:
    x, y = _side(a), _side(b)
    shared = B.overlap_size(cds_blocks(x["exons"], x["cds_start"], x["cds_end"]), cds_blocks(y["exons"], y["cds_start"], y["cds_end"]))
    return F.when((x["chrom"] == y["chrom"]) & (x["strand"] == y["strand"]), shared).otherwise(F.lit(0).cast("bigint"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(part == 0, F.lit(0.0)).otherwise(part / whole)


def similarity(a: str = "a_", b: str = "b_") -> Column:
    """Twice the shared exon bases by both genes' exon bases; 0 without overlap."""
    return _ratio(2 * exon_overlap(a, b), exon_length(f"{a}exons") + exon_length(f"{b}exons"))


def cds_similarity(a: str = "a_", b: str = "b_") -> Column:
    x, y = _side(a), _side(b)
    return _ratio(2 * cds_overlap(a, b), cds_length(x["exons"], x["cds_start"], x["cds_end"]) + cds_length(y["exons"], y["cds_start"], y["cds_end"]))


def cds_cover(a: str = "a_", b: str = "b_") -> Column:
    """The share of a's CDS that b's covers."""
    x = _side(a)
    return _ratio(cds_overlap(a, b), cds_length(x["exons"], x["cds_start"], x["cds_end"]))


def same_cds(a: str = "a_", b: str = "b_", frames: bool = True) -> Column:
    """Equal sequence, strand, CDS bounds and coding blocks, and equal frames where both genes have them."""
    x, y = _side(a), _side(b)
    coding = lambda g: F.filter(F.transform(g["exons"], lambda e: F.struct(F.greatest(e["start"], g["cds_start"]).alias("start"), F.least(e["end"], g["cds_end"]).alias("end"), e["frame"].alias("frame"))), lambda e: e["start"] < e["end"])
    plain = lambda blocks: F.transform(blocks, lambda e: B.block(e["start"], e["end"]))
    have = lambda blocks: F.forall(blocks, lambda e: e["frame"].isNotNull())
    cx, cy = coding(x), coding(y)
    ok = (x["chrom"] == y["chrom"]) & (x["strand"] == y["strand"]) & (x["cds_start"] == y["cds_start"]) & (x["cds_end"] == y["cds_end"]) & (plain(cx) == plain(cy))
    if frames:
        ok = ok & (~have(cx) | ~have(cy) | (F.transform(cx, lambda e: e["frame"]) == F.transform(cy, lambda e: e["frame"])))
    return ok


def select_genes(genes: DataFrame, min_exons: int | None = None, max_exons: int | None = None, min_cds_exons: int | None = None, max_cds_exons: int | None = None, names: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Genes that meet all given criteria; names is a list or a table whose first column lists them."""
    out = genes
    for count, least, most in ((F.size("exons"), min_exons, max_exons), (cds_exon_count(), min_cds_exons, max_cds_exons)):
        out = out if least is None else out.where(count >= least)
        out = out if most is None else out.where(count <= most)
    if isinstance(names, DataFrame):
        return out.join(names.select(F.col(names.columns[0]).alias("name")), "name", "left_semi")
    return out if names is None else out.where(F.col("name").isin(list(names)))


def check_unique(df: DataFrame, key: str = "name") -> DataFrame:
    """Keys that occur more than once, with their counts: empty if a unique index could be built."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def introns(df: DataFrame, least: int = 30, shape: str = "intron_blk", unique: bool = False, unique_name: bool = False) -> DataFrame:
    """An annotation per intron of BED rows (chrom, chrom_start, chrom_end, name, strand, blocks, order of which by chrom_start, name).

    shape: intron_blk is one block, base_bounds the bases beside the intron, exon_bounds its two exons. Introns shorter than
    `least` are left out. unique keeps the first of equal (chrom, start, end, strand), by name and number; unique_name adds
    the intron's number among the qualifying ones, from 0.
    """
    qualifying = F.filter(B.pairs("blocks"), lambda p: p["after"]["start"] - p["before"]["end"] >= least)
    out = df.select("chrom", "name", "strand", F.posexplode(qualifying).alias("nth", "pair"))
    before, after = F.col("pair.before"), F.col("pair.after")
    shapes = {
        "intron_blk": F.array(B.block(before["end"], after["start"])),
        "base_bounds": F.array(B.block(before["end"] - 1, before["end"]), B.block(after["start"], after["start"] + 1)),
        "exon_bounds": F.array(before, after),
    }
    out = out.select("chrom", before["end"].alias("chrom_start"), after["start"].alias("chrom_end"), "name", "strand", shapes[shape].alias("blocks"), "nth")
    if unique:
        keys = ["chrom", "chrom_start", "chrom_end", "strand"]
        first = out.groupBy(*keys).agg(F.min(F.struct("name", "nth", "blocks")).alias("f"))
        out = first.select("chrom", "chrom_start", "chrom_end", F.col("f.name").alias("name"), "strand", F.col("f.blocks").alias("blocks"), F.col("f.nth").alias("nth"))
    if unique_name:
        out = out.withColumn("name", F.concat("name", F.lit("_"), "nth"))
    return out.drop("nth")


def cds_annotations(df: DataFrame) -> DataFrame:
    """BED rows clipped to their thick range; rows without one are dropped, and bounds follow the blocks."""
    out = df.withColumn("blocks", B.clip("blocks", "thick_start", "thick_end")).where(F.size("blocks") > 0)
    return out.withColumn("chrom_start", F.get("blocks", F.lit(0))["start"]).withColumn("chrom_end", F.element_at("blocks", -1)["end"])


def with_merged_blocks(groups: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """groups (a row per key) with the blocks of all rows of df of a key, overlapping or touching ones joined in a sorted pass before any are gathered."""
    parts = df.select(*keys, F.explode("blocks").alias("__b")).select(*keys, F.col("__b.start").alias("__start"), F.col("__b.end").alias("__end"))
    islands = merge_islands(parts, keys, "__start", "__end", adjacent=True)
    joined = islands.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("__start").alias("start"), F.col("__end").alias("end")))).alias("blocks"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))
    out = groups.join(joined.withColumnsRenamed({k: f"__key_{k}" for k in keys}), same, "left")
    return out.withColumn("blocks", F.coalesce("blocks", F.array().cast(BLOCKS))).drop(*(f"__key_{k}" for k in keys))


def merge_annotations(df: DataFrame, keys: Sequence[str], stranded: bool = True) -> DataFrame:
    """One annotation per key: blocks of all rows, overlapping or touching ones joined, thick range over all that have one.

    Rows of one key on several sequences (or strands, if stranded) are an error; without a thick range it is empty at the end.
    """
    thick = F.col("thick_start") < F.col("thick_end")
    out = df.groupBy(*keys).agg(
        F.min("chrom").alias("chrom"), F.max("chrom").alias("__chrom"), F.min("strand").alias("strand"), F.max("strand").alias("__strand"),
        F.min(F.when(thick, F.col("thick_start"))).alias("thick_start"), F.max(F.when(thick, F.col("thick_end"))).alias("thick_end"),
    )
    ok = (F.col("chrom") == F.col("__chrom")) & (F.col("strand").eqNullSafe(F.col("__strand")) if stranded else F.lit(True))
    out = with_merged_blocks(out, df, keys)
    out = out.withColumn("blocks", F.when(ok, F.col("blocks")).otherwise(F.raise_error("rows of one key are on several sequences or strands")))
    out = out.withColumn("chrom_start", F.get("blocks", F.lit(0))["start"]).withColumn("chrom_end", F.element_at("blocks", -1)["end"])
    out = out.withColumn("thick_start", F.coalesce("thick_start", "chrom_end")).withColumn("thick_end", F.coalesce("thick_end", "chrom_end"))
    strand = F.col("strand") if stranded else F.when(F.col("strand").eqNullSafe(F.col("__strand")), F.col("strand")).otherwise(F.lit("+"))
    return out.select(*keys, "chrom", "chrom_start", "chrom_end", strand.alias("strand"), "thick_start", "thick_end", "blocks")


def exon_numbers(exons: ColumnOrName, cds_start: ColumnOrName = "cds_start", cds_end: ColumnOrName = "cds_end") -> Column:
    """For each exon its number among the exons from the first to the last with CDS, or null."""
    cds_start, cds_end = col(cds_start), col(cds_end)

    def numbered(e: Column) -> Column:
        holds = F.transform(e, lambda x: (x["start"] < cds_end) & (x["end"] > cds_start) & (cds_start < cds_end))
        first = F.array_position(holds, True)
        last = F.size(e) - F.array_position(F.reverse(holds), True) + 1
        return F.transform(e, lambda x, i: F.when((first > 0) & (i + 1 >= first) & (i + 1 <= last), (i + 1 - first).cast("int")))

    return bind(col(exons), numbered)


