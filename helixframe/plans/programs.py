"""Whole programs: files in, files out. Each is a scan, operators and a sink; run them with `python -m helixframe.plans.programs NAME ARGS...`."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.strings import to_ascii
from ..operators import annotation, genes, intervals, sets, stats
from ..sources import genbank, records, sinks, text


def _lines(df: DataFrame, line, path: str, order: Sequence[str] = ()) -> None:
    sinks.write_lines((df.orderBy(*order) if order else df).select(line.alias("value")), path)


def bed_flatten(spark: SparkSession, src: str, dst: str, stranded: bool = True, prefix: str = "") -> None:
    """Overlapping BED rows as one each; rows with blocks keep the union of their blocks."""
    beds = records.bed(spark, src)
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    islands = intervals.with_islands(beds, keys, "chrom_start", "chrom_end")
    merged = islands.groupBy(*keys, "island").agg(F.min("chrom_start").alias("chrom_start"), F.max("chrom_end").alias("chrom_end"))
    merged = genes.with_merged_blocks(merged, islands, [*keys, "island"]).withColumn("strand", F.col("strand") if stranded else F.lit("+"))
    named = intervals.number_in_order(merged, "chrom", ["chrom_start", "chrom_end", "strand"], "n").withColumn("name", F.concat(F.lit(prefix), "n"))
    out = named.select("*", F.lit(0).alias("score"), F.col("chrom_end").alias("thick_start"), F.col("chrom_end").alias("thick_end"), F.lit("0").alias("item_rgb"))
    _lines(out, sinks.bed_line(), dst, ("chrom", "chrom_start", "chrom_end", "strand"))


def bed_to_cds(spark: SparkSession, src: str, dst: str) -> None:
    """The coding part of BED12 rows; rows without one go."""
    _lines(genes.cds_annotations(records.bed(spark, src)), sinks.bed_line_extra(), dst)


def bed_to_introns(spark: SparkSession, src: str, dst: str, least: int = 30, shape: str = "intron_blk", unique: bool = False, unique_name: bool = False) -> None:
    out = genes.introns(records.bed(spark, src), least, shape, unique, unique_name)
    out = out.select("*", F.lit(0).alias("score"), F.col("chrom_end").alias("thick_start"), F.col("chrom_end").alias("thick_end"), F.lit("0").alias("item_rgb"))
    _lines(out, sinks.bed_line(), dst)


def gene_pred_select(spark: SparkSession, src: str, dst: str, **criteria) -> None:
    _lines(genes.select_genes(records.gene_pred(spark, src), **criteria), sinks.gene_pred_line(extended=True), dst)


def _cluster_rows(spark: SparkSession, src: str) -> DataFrame:
    return records.cluster_genes(spark, src).withColumnsRenamed({"txStart": "tx_start", "txEnd": "tx_end"})


def cluster_select(spark: SparkSession, src: str, dst: str, bed: bool = False, **criteria) -> None:
    rows = stats.cluster_select(_cluster_rows(spark, src), **criteria)
    if bed:
        out = stats.cluster_bed(rows)
        _lines(out, sinks.tab_line(*(F.col(c) for c in out.columns)), dst, ("chrom", "chrom_start"))
    else:
        sinks.write_tsv(rows, dst)


def cluster_stats(spark: SparkSession, src: str, dst: str, total: bool = False, omit_zero: bool = False, categories: str | None = None, totals: str | None = None, gene_subsets: str | None = None) -> None:
    rows = _cluster_rows(spark, src)
    cats = text.tab_rows(spark, categories).select(F.get("row", F.lit(0)).cast("bigint").alias("cluster"), F.get("row", F.lit(1)).alias("category")) if categories else None
    sinks.write_tsv(stats.cluster_stats(rows, cats, omit_zero, total).orderBy("nth").drop("nth").coalesce(1), dst)
    if totals:
        sinks.write_tsv(stats.cluster_set_totals(rows, cats), totals)
    if gene_subsets:
        sinks.write_tsv(stats.cluster_gene_subsets(rows, cats), gene_subsets)


def gene_check_stats(spark: SparkSession, src: str, dst: str) -> None:
    out = stats.check_stats(records.gene_check(spark, src)).orderBy("nth")
    sinks.write_tsv(out.select(F.col("category").alias("probCat"), F.col("genes").alias("gene"), "rate", F.col("problems").alias("numProbs")).coalesce(1), dst)


def splice_check(spark: SparkSession, genome: str, src: str, stats_dst: str | None = None, nonstandard_dst: str | None = None, chunk: int = 1 << 16) -> None:
    """Splice-junction categories of BED12 introns, and a coloured BED of those that aren't standard."""
    chunks = text.sequence_chunks(text.fasta(spark, genome), chunk)
    introns = stats.splice_introns(records.bed(spark, src), chunks, chunk)
    if stats_dst:
        sinks.write_tsv(stats.splice_stats(introns).orderBy("nth").drop("nth").coalesce(1), stats_dst)
    if nonstandard_dst:
        #: Colours of rare, U12 and problematic introns.
        color = F.when(F.col("category") == "RARE", "255,140,0").when(F.col("category") == "U12", "143,188,143").otherwise("139,0,0")
        out = introns.where("category != 'STD'")
        line = sinks.tab_line(F.col("chrom"), F.col("start"), F.col("end"), F.concat("category", F.lit("_"), "junction"), F.lit(0), F.col("strand"), F.col("end"), F.col("end"), color)
        _lines(out, line, nonstandard_dst, ("chrom", "start", "end"))


def agp_to_psl(spark: SparkSession, src: str, dst: str, component_sizes: str | None = None, id_map: str | None = None, skip_unmapped: bool = False) -> None:
    pair = lambda path, a, b, kind: text.tab_rows(spark, path, comments=True, blank=True).select(F.get("row", F.lit(0)).alias(a), F.get("row", F.lit(1)).cast(kind).alias(b))
    sizes = pair(component_sizes, "name", "size", "bigint") if component_sizes else None
    names = pair(id_map, "accession", "local_id", "string") if id_map else None
    _lines(annotation.agp_to_psl(records.agp(spark, src), sizes, names, skip_unmapped), sinks.psl_line(), dst)


def assembly_convert(spark: SparkSession, src: str, output: str, dst: str, from_id: str, to_id: str | None = None, include: str | None = None) -> int:
    """Write an assembly's conversion; the number of sequences that were left out for want of a name."""
    report = records.assembly_report(spark, src)
    out = annotation.assembly_convert(report, output, from_id, to_id, include)
    _lines(out, sinks.psl_line() if output == "psl" else sinks.tab_line(*(F.col(c) for c in out.columns)), dst)
    return annotation.skipped(report, output, from_id, to_id, include).first()["n_skipped"]


def assembly_to_tsv(spark: SparkSession, src: str, dst: str, keys: Sequence[str] = (), first_word: Sequence[str] = (), rest: bool = False) -> None:
    sinks.write_tsv(annotation.report_with_metadata(records.assembly_report(spark, src), records.assembly_metadata(spark, src), keys, first_word, rest), dst)


def tsv_to_xlsx(spark: SparkSession, dst: str, *sources: str) -> None:
    """TSV files as sheets of a workbook, named by their files; needs openpyxl."""
    sinks.write_xlsx({src.rstrip("/").rpartition("/")[2].rpartition(".")[0] or src: text.read_tsv(spark, src) for src in sources}, dst)


def xlsx_to_tsv(spark: SparkSession, src: str, dst: str, sheet: str | int = 0, header_row: int = 1) -> None:
    """A sheet of a workbook as TSV; needs openpyxl."""
    sinks.write_tsv(text.xlsx_rows(spark, src, sheet, header_row), dst)


def csv_to_tsv(spark: SparkSession, src: str, dst: str) -> None:
    sinks.write_tsv(text.read_csv(spark, src), dst)


def embl_to_fasta(spark: SparkSession, src: str, dst: str, by_name: bool = False, width: int = 60) -> None:
    _lines(text.embl_headers(text.embl(spark, src), by_name), sinks.fasta_record(F.col("name"), F.col("seq"), width), dst)


def fasta_select(spark: SparkSession, src: str, dst: str, ids: str | None = None) -> None:
    """FASTA records whose id, up to the first |, is listed; of each id the first record in the file."""
    rows = text.fasta(spark, src).withColumn("id", F.substring_index("name", "|", 1)).withColumn("nth", F.monotonically_increasing_id())
    if ids:
        wanted = text.lines(spark, ids, comments=False, blank=False).select(F.trim("value").alias("id"))
        rows = sets.select_by_id(rows, wanted, "id")
    out = sets.first_by_id(rows, "id", ["nth"])
    _lines(out, sinks.fasta_record(F.col("id"), F.col("seq")), dst, ("nth",))


def genbank_to_gene_pred(spark: SparkSession, src: str, dst: str, sources: Sequence[str] | None = None, types: Sequence[str] = ("protein", "rna", "immunoglobulin", "other"), active: Sequence[str] = ("live", "pseudo"), refseq_only: bool = False) -> None:
    out = genbank.selected(genbank.genbank_genes(spark, src), types, active, refseq_only)
    out = out.where(F.col("source").isin(*sources)) if sources else out
    exons = F.transform("exons", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit(None).cast("int").alias("frame")))
    out = out.withColumn("exons", exons).withColumn("exons", genes.assign_frames()).withColumns({"score": F.lit(0), "name2": F.col("gene"), "cds_start_stat": F.lit("unk"), "cds_end_stat": F.lit("unk")})
    _lines(out, sinks.gene_pred_line(extended=True), dst)


def json_structure(spark: SparkSession, src: str, dst: str) -> None:
    rows = spark.read.text(src, wholetext=True)
    out = stats.json_key_paths(rows, "value")
    _lines(out, F.concat_ws("\t", "path", "types"), dst, ("path",))


def psl_load(spark: SparkSession, src: str, table: str) -> None:
    sinks.save_binned(records.psl(spark, src), table, "t_name", "t_start", "t_end")


def tsv_select(spark: SparkSession, src: str, column: str, ids: str, id_column: str, dst: str) -> None:
    sinks.write_tsv(sets.select_by_id(text.read_tsv(spark, src), text.read_tsv(spark, ids), column, id_column), dst)


def utf8_to_ascii(spark: SparkSession, src: str, dst: str) -> None:
    _lines(text.lines(spark, src), to_ascii("value"), dst)


def venn_counts(spark: SparkSession, src: str, names: Sequence[str], dst: str, count: str = "Counts") -> None:
    """Subset counts of a 0/1 membership table."""
    types = {n: "int" for n in names} | {count: "bigint"}
    out = sets.matrix_counts(text.read_tsv(spark, src, types), names, count)
    sinks.write_tsv(out.select(sets.format_subset("subset").alias("subset"), "count"), dst)


def sra_jobs(spark: SparkSession, run_info: str, done: DataFrame, command: str, dst: str) -> None:
    """A line per run whose output isn't there yet: the command with {run} replaced."""
    runs = records.sra_run_info(spark, run_info).select(F.explode("Run").alias("run"))
    todo = annotation.missing_products(runs, done, "run")
    _lines(todo, F.replace(F.lit(command), F.lit("{run}"), F.col("run")), dst, ("run",))


PROGRAMS: dict[str, Callable] = {f.__name__: f for f in (bed_flatten, bed_to_cds, bed_to_introns, gene_pred_select, cluster_select, cluster_stats, gene_check_stats, splice_check, agp_to_psl, assembly_convert, assembly_to_tsv, csv_to_tsv, embl_to_fasta, fasta_select, genbank_to_gene_pred, json_structure, psl_load, tsv_select, tsv_to_xlsx, utf8_to_ascii, xlsx_to_tsv)}


def main(args: list[str]) -> None:
    """NAME and its positional arguments; key=value arguments are options (numbers, true and false are converted)."""
    if not args or args[0] not in PROGRAMS:
        sys.exit(f"programs: {', '.join(PROGRAMS)}")
    value = lambda v: {"true": True, "false": False}.get(v, int(v) if v.isdigit() else v)
    options = {k: value(v) for k, _, v in (a.partition("=") for a in args[1:] if "=" in a)}
    PROGRAMS[args[0]](SparkSession.builder.appName(args[0]).getOrCreate(), *(a for a in args[1:] if "=" not in a), **options)


if __name__ == "__main__":
    main(sys.argv[1:])
