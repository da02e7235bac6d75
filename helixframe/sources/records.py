"""Record formats on top of tab rows: BED, genePred, PSL, GFF3, AGP, assembly reports, taxonomy, SAM, gene checks, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import blocks as B
from ..functions.codecs import parse_attributes, parse_boolean, split_list
from ..functions.coords import phase_to_frame
from ..functions.strings import parse_cigar, percent_decode
from ..functions.util import required
from ..operators.alignments import from_cigar, psl_block
from ..operators.genes import exons_from_lists
from ..types import BLOCKS, PSL_BLOCKS
from .text import lines, read_tsv, tab_rows


def _at(k: int) -> Column:
    return F.get("row", F.lit(k))


def bed_from_rows(rows: DataFrame, n_columns: int | None = None, fix_scores: bool = False) -> DataFrame:
    """BED columns from arrays of strings: n_columns standard ones (all up to 12 if not given), the others in extra_cols.

    Scores like 12.7 lose their fraction; with fix_scores, scores that aren't numbers or are negative become 0. Without blocks
    the annotation is one block, without a thick range it is empty at the end.
    """
    n = F.least(F.size("row"), F.lit(n_columns or 12))
    n = F.when(n < 12, F.least(n, F.lit(9))).otherwise(n) if n_columns is None else n
    have = lambda k: n > k
    start, end = _at(1).cast("bigint"), _at(2).cast("bigint")
    number = _at(4).try_cast("double") if fix_scores else _at(4).cast("double")
    score = F.greatest(F.lit(0), F.coalesce(number, F.lit(0.0)).cast("int")) if fix_scores else number.cast("int")
    listed = B.from_lists(split_list(_at(11), "bigint"), split_list(_at(10), "bigint"), start)
    return rows.select(
        required(n >= 3, _at(0), "a BED row has three columns or more").alias("chrom"), start.alias("chrom_start"), end.alias("chrom_end"), F.when(have(3), _at(3)).alias("name"), F.when(have(4), score).alias("score"),
        F.when(have(5), _at(5)).alias("strand"), F.when(have(7), _at(6).cast("bigint")).otherwise(end).alias("thick_start"), F.when(have(7), _at(7).cast("bigint")).otherwise(end).alias("thick_end"),
        F.when(have(8), _at(8)).alias("item_rgb"), F.when(have(11), listed).otherwise(F.array(B.block(start, end))).cast(BLOCKS).alias("blocks"), F.slice("row", n + 1, F.greatest(F.size("row") - n, F.lit(0))).alias("extra_cols"),
        *[c for c in rows.columns if c != "row"],
    )


def bed(spark: SparkSession, path: str, n_columns: int | None = None, fix_scores: bool = False, numbered: bool = False) -> DataFrame:
    rows = tab_rows(spark, path, comments=True, blank=True, numbered=numbered).where(~F.get("row", F.lit(0)).rlike(r"^(track|browser)\b"))
    return bed_from_rows(rows, n_columns, fix_scores)


def gene_pred_from_rows(rows: DataFrame) -> DataFrame:
    """genePred columns from arrays of 10 to 15 strings: the extended ones are null where they are absent."""
    have = lambda k: F.size("row") > k
    frames = F.when(have(14), split_list(_at(14), "int")).otherwise(F.transform(split_list(_at(8), "bigint"), lambda s: F.lit(None).cast("int")))
    return rows.select(
        required(have(9), _at(0), "a genePred row has ten columns or more").alias("name"), _at(1).alias("chrom"), _at(2).alias("strand"), *(_at(k).cast("bigint").alias(n) for k, n in ((3, "tx_start"), (4, "tx_end"), (5, "cds_start"), (6, "cds_end"))),
        exons_from_lists(split_list(_at(8), "bigint"), split_list(_at(9), "bigint"), frames).alias("exons"), F.when(have(10), _at(10).cast("int")).alias("score"), F.when(have(11), _at(11)).alias("name2"),
        F.when(have(12), _at(12)).alias("cds_start_stat"), F.when(have(13), _at(13)).alias("cds_end_stat"), have(14).alias("has_frames"),
        *[c for c in rows.columns if c != "row"],
    )


def gene_pred(spark: SparkSession, path: str) -> DataFrame:
    return gene_pred_from_rows(tab_rows(spark, path, comments=True, blank=True))


#: Columns of genePred and PSL tables in annotation databases.
GENEPRED_TABLE = ("name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exonCount", "exonStarts", "exonEnds", "score", "name2", "cdsStartStat", "cdsEndStat", "exonFrames")
PSL_TABLE = ("matches", "misMatches", "repMatches", "nCount", "qNumInsert", "qBaseInsert", "tNumInsert", "tBaseInsert", "strand", "qName", "qSize", "qStart", "qEnd", "tName", "tSize", "tStart", "tEnd", "blockCount", "blockSizes", "qStarts", "tStarts")


def _table_rows(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named columns that a database table has, up to the first that it lacks, as an array of texts; a bin column and others are left out."""
    have = {c.lower(): c for c in rows.columns}
    found = [have[n.lower()] for n in names if n.lower() in have]
    return rows.select(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in found)).alias("row"))


def gene_pred_from_table(rows: DataFrame) -> DataFrame:
    """genePred columns from a database's table, of ten columns or all (`text.jdbc` reads it, with a range condition of functions.bins)."""
    return gene_pred_from_rows(_table_rows(rows, GENEPRED_TABLE))


def psl_from_table(rows: DataFrame) -> DataFrame:
    return psl_from_rows(_table_rows(rows, PSL_TABLE))


def gene_pred_from_big(beds: DataFrame) -> DataFrame:
    """genePred columns from bigGenePred rows (BED12 with extra columns: name2, CDS start and end status, frames, ...)."""
    extra = lambda k: F.get("extra_cols", F.lit(k))
    starts, ends = F.transform("blocks", lambda b: b["start"]), F.transform("blocks", lambda b: b["end"])
    return beds.select(
        "name", "chrom", "strand", F.col("chrom_start").alias("tx_start"), F.col("chrom_end").alias("tx_end"), F.col("thick_start").alias("cds_start"), F.col("thick_end").alias("cds_end"),
        exons_from_lists(starts, ends, split_list(extra(3), "int")).alias("exons"), "score", extra(0).alias("name2"), extra(1).alias("cds_start_stat"), extra(2).alias("cds_end_stat"), F.lit(True).alias("has_frames"),
    )


_PSL_NUMBERS = ("match", "mis_match", "rep_match", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert")


def psl_from_rows(rows: DataFrame) -> DataFrame:
    """PSL columns from arrays of 21 strings, or 23 with block sequences. A bin column in front (22 or 24) is dropped."""
    rows = rows.withColumn("row", F.when(F.size("row").isin(22, 24), F.slice("row", F.lit(2), F.size("row"))).otherwise(F.col("row")))
    sizes, qs, ts = (split_list(_at(k), "bigint") for k in (18, 19, 20))
    have_seqs = F.size("row") > 22
    null_seqs = F.transform(sizes, lambda s: F.lit(None).cast("string"))
    zipped = F.arrays_zip(sizes.alias("n"), qs.alias("q"), ts.alias("t"), F.when(have_seqs, split_list(_at(21))).otherwise(null_seqs).alias("qseq"), F.when(have_seqs, split_list(_at(22))).otherwise(null_seqs).alias("tseq"))
    blocks = F.transform(zipped, lambda z: psl_block(z["q"], z["t"], z["n"], z["qseq"], z["tseq"]))
    return rows.select(
        *(required(F.size("row") >= 21, _at(k), "a PSL row has 21 columns").cast("bigint").alias(n) if k == 0 else _at(k).cast("bigint").alias(n) for k, n in enumerate(_PSL_NUMBERS)), _at(8).alias("strand"), _at(9).alias("q_name"),
        *(_at(k).cast("bigint").alias(n) for k, n in ((10, "q_size"), (11, "q_start"), (12, "q_end"))), _at(13).alias("t_name"), *(_at(k).cast("bigint").alias(n) for k, n in ((14, "t_size"), (15, "t_start"), (16, "t_end"))),
        blocks.cast(PSL_BLOCKS).alias("blocks"), *[c for c in rows.columns if c != "row"],
    )


def psl(spark: SparkSession, path: str) -> DataFrame:
    """PSL or PSLx; the header of five lines that some files have is skipped."""
    rows = tab_rows(spark, path, comments=True, blank=True).where(F.get("row", F.lit(0)).rlike("^[0-9]+$"))
    return psl_from_rows(rows)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """PSL rows of a SAM text's mapped alignments; target sizes come from its @SQ lines."""
    text = lines(spark, path, blank=False)
    sizes = text.where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("t"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("bigint").alias("size"))
    rows = text.where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("row")).where(_at(2) != "*").where(_at(5) != "*")
    rows = rows.select(_at(0).alias("q"), F.when(_at(1).cast("int").bitwiseAND(16) != 0, "-").otherwise("+").alias("s"), _at(2).alias("t"), (_at(3).cast("bigint") - 1).alias("p"), parse_cigar(_at(5)).alias("cigar"))
    return rows.join(sizes, "t", "left").select(*from_cigar("q", "s", "t", "size", "p", F.col("cigar")))


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 features: seqname, source, type, start and end (0-based, half-open), score, strand, frame, attributes, id, parents.

    `.` becomes null; a file that doesn't begin with the version line is an error; FASTA sections and comments are skipped.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0]["value"].startswith("##gff-version"):
        raise ValueError(f"not a GFF3 file: {path}")
    rows = lines(spark, path, comments=False, blank=False).where(F.col("value").contains("\t")).select(F.split("value", "\t").alias("row"))
    text = lambda k: F.nullif(percent_decode(_at(k)), F.lit("."))
    out = rows.select(
        required(F.size("row") == 9, percent_decode(_at(0)), "a GFF3 row has nine columns").alias("seqname"), text(1).alias("source"), percent_decode(_at(2)).alias("type"), (_at(3).cast("bigint") - 1).alias("start"), _at(4).cast("bigint").alias("end"),
        F.nullif(_at(5), F.lit(".")).cast("double").alias("score"), F.nullif(_at(6), F.lit(".")).alias("strand"), phase_to_frame(_at(7)).alias("frame"), parse_attributes(_at(8)).alias("attributes"),
    )
    return out.withColumn("id", F.get(F.try_element_at("attributes", F.lit("ID")), F.lit(0))).withColumn("parents", F.coalesce(F.try_element_at("attributes", F.lit("Parent")), F.array().cast("array<string>")))


def agp(spark: SparkSession, path: str) -> DataFrame:
    """AGP rows: object, object_start, object_end, part, component_type, kind (block or gap), and the fields of either, 0-based."""
    rows = tab_rows(spark, path, comments=True, blank=True)
    gap = _at(4).isin("N", "U")
    of_block = lambda c: F.when(~gap, c)
    of_gap = lambda c: F.when(gap, c)
    return rows.select(
        _at(0).alias("object"), (_at(1).cast("bigint") - 1).alias("object_start"), _at(2).cast("bigint").alias("object_end"), _at(3).cast("int").alias("part"), _at(4).alias("component_type"), F.when(gap, "gap").otherwise("block").alias("kind"),
        of_block(_at(5)).alias("component"), of_block(_at(6).try_cast("bigint") - 1).alias("component_start"), of_block(_at(7).try_cast("bigint")).alias("component_end"), of_block(F.when(_at(8) == "-", "-").otherwise("+")).alias("strand"),
        of_gap(_at(5).try_cast("bigint")).alias("gap_length"), of_gap(_at(6)).alias("gap_type"), of_gap(_at(7) == "yes").alias("linkage"), of_gap(_at(8)).alias("linkage_evidence"),
    )


#: The columns of an assembly report.
ASSEMBLY_COLUMNS = ("sequence_name", "sequence_role", "assigned_molecule", "assigned_molecule_type", "genbank_accn", "relationship", "refseq_accn", "assembly_unit", "sequence_length", "ucsc_name")


def assembly_report(spark: SparkSession, path: str) -> DataFrame:
    """The sequence table of an assembly report, `na` as null."""
    rows = lines(spark, path, comments=False, blank=False).select(F.split("value", "\t").alias("row"))
    return rows.select(*(F.nullif(_at(k), F.lit("na")).cast("bigint" if n == "sequence_length" else "string").alias(n) for k, n in enumerate(ASSEMBLY_COLUMNS)))


def assembly_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key, value and nth (the order) of the report's `# key: value` lines; keys in lower case with _ for blanks, the last value of a key."""
    rows = lines(spark, path, blank=False, numbered=True)
    part = lambda k: F.trim(F.regexp_extract("value", r"^#\s+([^:]+):\s*(.*)$", k))
    pairs = rows.where(F.col("value").rlike(r"^#\s+[^:]+:")).select(F.replace(F.lower(part(1)), F.lit(" "), F.lit("_")).alias("key"), part(2).alias("text"), "line_no")
    return pairs.groupBy("key").agg(F.max_by("text", "line_no").alias("value"), F.min("line_no").alias("nth"))


def taxonomy_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A `\\t|\\t`-separated taxonomy table; columns names its first fields, ids are longs, flags booleans."""
    rows = lines(spark, path, blank=False).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("row"))
    kind = lambda n: "bigint" if n.endswith("_id") else "boolean" if n.endswith("_flag") else "string"
    return rows.select(*((_at(k).cast("int").cast("boolean") if kind(n) == "boolean" else _at(k).cast(kind(n))).alias(n) for k, n in enumerate(columns)))


def gene_check(spark: SparkSession, path: str) -> DataFrame:
    """Gene checks with ok/err, ok/no and ok/nmd columns as booleans, counters as longs, causes as an array."""
    flag = lambda kind: lambda c: parse_boolean(c, kind)
    numbers = ("orfStop", "cdsGap", "cdsMult3Gap", "utrGap", "cdsUnknownSplice", "utrUnknownSplice", "cdsNonCanonSplice", "utrNonCanonSplice", "numExons", "numCds", "numUtr5", "numUtr3", "numCdsIntrons", "numUtrIntrons")
    types = {"checkId": "int", "chrStart": "bigint", "chrEnd": "bigint", "stat": flag("stat"), "start": flag("start_stop"), "stop": flag("start_stop"), "nmd": flag("nmd"), "causes": lambda c: split_list(c), **dict.fromkeys(numbers, "bigint")}
    return read_tsv(spark, path, types)


def with_details(checks: DataFrame, details: DataFrame) -> DataFrame:
    """Checks with their details (all columns of the details table) as an array."""
    listed = details.groupBy("checkId").agg(F.array_sort(F.collect_list(F.struct(*[c for c in details.columns if c != "checkId"]))).alias("details"))
    return checks.join(listed, "checkId", "left")


def cluster_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene clusters: y/n columns as booleans, conflicts as arrays."""
    yes_no = lambda c: parse_boolean(c, "yes_no")
    types = {"cluster": "bigint", "txStart": "bigint", "txEnd": "bigint", "rnaLength": "int", "cdsLength": "int", "hasExonConflicts": yes_no, "hasCdsConflicts": yes_no, "exonConflicts": lambda c: split_list(c), "cdsConflicts": lambda c: split_list(c)}
    return read_tsv(spark, path, types)


def psl_stats(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The kind of a statistics table (align, query or overall, by its columns) and its rows, counts as longs, others as doubles."""
    out = read_tsv(spark, path)
    kind = "overall" if "queryCnt" in out.columns else "query" if "alnCnt" in out.columns else "align"
    numeric = [c for c in out.columns if c not in ("qName", "tName", "strand", "minQName", "maxQName")]
    return kind, out.select(*(F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in out.columns))


def cds_table(spark: SparkSession, path: str) -> DataFrame:
    """id and CDS range of `id<TAB>start..end` lines, which count from 1."""
    rows = tab_rows(spark, path, comments=True, blank=True)
    part = lambda k: F.regexp_extract(_at(1), r"^([0-9]+)\.\.([0-9]+)$", k).cast("bigint")
    return rows.select(_at(0).alias("id"), (part(1) - 1).alias("cds_start"), part(2).alias("cds_end"))


def load_psl(spark: SparkSession, path: str, cds_path: str | None = None) -> DataFrame:
    """Alignments with their query's CDS, null if it has none."""
    out = psl(spark, path)
    null = F.lit(None).cast("bigint")
    if cds_path is None:
        return out.withColumns({"cds_start": null, "cds_end": null})
    return out.join(cds_table(spark, cds_path).withColumnRenamed("id", "q_name"), "q_name", "left").select(*out.columns, "cds_start", "cds_end")


def sra_run_info(spark: SparkSession, path: str) -> DataFrame:
    """An SRA run table, CSV or TSV by extension; Run becomes an array."""
    out = read_tsv(spark, path, separator="," if path.endswith(".csv") else "\t")
    return out.withColumn("Run", F.split("Run", ", *")) if "Run" in out.columns else out


def overlap_select_stats(spark: SparkSession, path: str) -> DataFrame:
    """Overlap statistics of pairs (inId, selectId): ratios as doubles, base counts as longs."""
    out = read_tsv(spark, path)
    kind = lambda c: "string" if c in ("inId", "selectId") else "bigint" if c.endswith("Bases") else "double"
    return out.select(*(F.col(c).cast(kind(c)).alias(c) for c in out.columns))


def values_file(spark: SparkSession, path: str, kind: str = "bigint", value_column: int = 0, count_column: int | None = None) -> DataFrame:
    """value (and count) of a headerless tab file, as histograms take them."""
    rows = tab_rows(spark, path, comments=True, blank=True)
    counts = [] if count_column is None else [_at(count_column).cast("bigint").alias("count")]
    return rows.select(_at(value_column).cast(kind).alias("value"), *counts)
