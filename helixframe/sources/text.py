"""Text scans: lines, headerless tab files, TSV and CSV with a header. Compressed files (.gz, .bz2) are read by extension."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bins import overlap_condition

_UNSUPPORTED = (".bgz", ".Z")


def _check_path(path: str) -> None:
    if path.endswith(_UNSUPPORTED):
        raise ValueError(f"{path}: Spark has no codec for this extension; recompress to .gz or .bz2")


def lines(spark: SparkSession, path: str, comments: bool = True, blank: bool = True, numbered: bool = False) -> DataFrame:
    """A row per line (value), without # lines unless comments, without empty ones unless blank. A last line needs no newline.

    numbered adds file and line_no, the order within a file; a file is then read by one task.
    """
    _check_path(path)
    if numbered:
        whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
        out = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n|\r")).alias("line_no", "value"))
    else:
        out = spark.read.text(path)
    out = out if comments else out.where(~F.col("value").startswith("#"))
    return out if blank else out.where(F.trim("value") != "")


def tab_rows(spark: SparkSession, path: str, comments: bool = False, blank: bool = False, numbered: bool = False) -> DataFrame:
    """Headerless tab file: `row`, an array of strings. comments drops # lines, blank drops empty ones. Nothing is quoted."""
    out = lines(spark, path, comments=not comments, blank=not blank, numbered=numbered)
    return out.withColumn("row", F.split("value", "\t", -1)).drop("value")


def header_of(spark: SparkSession, path: str, separator: str = "\t", quote: str | None = '"') -> list[str]:
    """Column names of the first line; a # and blanks in front are dropped. No line gives no names."""
    reader = spark.read.option("sep", separator).option("header", False).option("quote", quote or "").option("escape", quote or "").option("inferSchema", False)
    first = reader.csv(path).limit(1).collect()
    names = [v if v is not None else "" for v in first[0]] if first else []
    return [names[0].lstrip("#").lstrip(), *names[1:]] if names else []


def read_tsv(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str | Callable[[Column], Column]] | None = None,
    default_type: str = "string",
    columns: Sequence[str] | None = None,
    rename: Callable[[str], str] | None = None,
    separator: str = "\t",
    quote: str | None = '"',
    ignore_extra: bool = False,
    allow_empty: bool = False,
    encoding: str = "UTF-8",
) -> DataFrame:
    """A table with a header line (or, given columns, without one), typed by column.

    types maps columns to Spark types or Column functions; values that don't convert, rows of another width (longer ones
    unless ignore_extra) and names given twice are errors. Empty strings stay empty strings; `types` decides on nulls.
    An empty file is an error unless allow_empty, which gives a table without columns.
    """
    _check_path(path)
    names = list(columns) if columns else header_of(spark, path, separator, quote)
    if not names:
        if allow_empty:
            return spark.createDataFrame([], "")
        raise ValueError(f"empty file: {path}")
    names = [rename(n) if rename else n for n in names]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"duplicate columns in {path}: {sorted(twice)}")
    width = len(names)
    schema = ", ".join(f"`_c{k}` string" for k in range(width)) + ", `_bad` string"
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").option("columnPruning", False).option("sep", separator).option("encoding", encoding)
    reader = reader.option("quote", quote or "").option("escape", quote or "").option("multiLine", bool(quote)).option("header", not columns)
    raw = reader.option("enforceSchema", True).csv(path)
    # the reader marks rows of another width as malformed; of those, longer ones may be wanted
    wrong = F.col("_bad").isNotNull()
    if ignore_extra:
        wrong = wrong & (F.size(F.split("_bad", f"\\Q{separator}\\E", -1)) < width)
    first = F.when(wrong, F.raise_error(F.concat(F.lit(f"{path}: row doesn't have {width} columns: "), F.coalesce("_c0", F.lit("")))).cast("string")).otherwise(F.coalesce("_c0", F.lit("")))
    out = []
    for k, n in enumerate(names):
        value = F.coalesce(f"_c{k}", F.lit("")) if k else first
        kind = (types or {}).get(n, default_type)
        out.append((kind(value) if callable(kind) else value.cast(kind)).alias(n))
    return raw.select(*out)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_tsv(spark, path, separator=",", **options)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description and seq of each record, which begins at a > at a line's start; line ends within a sequence are dropped."""
    records = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", r"\A\s*>", "")).where(F.trim("value") != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return records.select(F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("description"), seq.alias("seq"))


def sequence_chunks(sequences: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Sequences (name, seq) cut into rows of `size` bases: name, nth, seq."""
    n = F.greatest(F.ceil(F.length("seq") / size), F.lit(1)).cast("int")
    nth = F.explode(F.sequence(F.lit(0), n - 1))
    return sequences.select("name", "seq", nth.alias("nth")).select("name", F.col("nth").cast("bigint").alias("nth"), F.substring(F.col("seq"), F.col("nth") * size + 1, F.lit(size)).alias("seq"))


def sequence_lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("name", F.length("seq").alias("size"))


def subsequence(seq: Column, start: Column, end: Column | None = None) -> Column:
    """The bases [start, end), to the sequence's end without an end."""
    end = F.length(seq) if end is None else end
    return F.substring(seq, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def embl(spark: SparkSession, path: str) -> DataFrame:
    """id, accession, version, nm, description and seq of EMBL flat-file records, which end in //."""
    records = spark.read.text(path, lineSep="//\n").where(F.trim("value") != "")
    version = F.regexp_extract("value", r"(?m)^ID\s+[^;\n]*;\s*SV\s+([0-9]+)", 1)
    accession = F.regexp_extract("value", r"(?m)^ID\s+([^\s;]+)", 1)
    nm = F.nullif(F.regexp_extract("value", r"(?m)^NM\s+(\S+)", 1), F.lit(""))
    description = F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^DE\s+(.*)$"), F.lit(1)), " ")
    seq = F.regexp_replace(F.regexp_extract("value", r"(?s)\nSQ[^\n]*\n(.*)$", 1), r"[\s0-9]", "")
    return records.select(accession.alias("accession"), F.nullif(version, F.lit("")).alias("version"), nm.alias("nm"), description.alias("description"), seq.alias("seq"))


def embl_headers(records: DataFrame, by_name: bool = False) -> DataFrame:
    """name and seq for FASTA: accession.version, or NM id (records without one go), then the description."""
    if by_name:
        records = records.where("nm IS NOT NULL")
    name = F.col("nm") if by_name else F.concat_ws(".", "accession", "version")
    return records.select(F.concat_ws(" ", name, F.nullif("description", F.lit(""))).alias("name"), "seq")


def config(path: str) -> dict[str, str]:
    """A key=value configuration file, read on the driver."""
    out = {}
    with open(path) as f:
        for line in f:
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                key, _, value = line.partition("=")
                out[key.strip()] = value.strip()
    return out


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    """path and MD5 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def xlsx_rows(spark: SparkSession, path: str, sheet: str | int = 0, header_row: int = 1) -> DataFrame:
    """A workbook sheet as strings, trailing blank rows and columns trimmed; read on the driver, needs openpyxl."""
    import openpyxl

    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    rows = [["" if c is None else str(c) for c in r] for r in (book[sheet] if isinstance(sheet, str) else book.worksheets[sheet]).iter_rows(values_only=True)][header_row - 1 :]
    while rows and not any(rows[-1]):
        rows.pop()
    width = max((k + 1 for k, c in enumerate(rows[0]) if c), default=0) if rows else 0
    return spark.createDataFrame([(r + [""] * width)[:width] for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0][:width]))


def jdbc_range(spark: SparkSession, url: str, table: str, seq: str, start: int | None = None, end: int | None = None, columns: Sequence[str] = ("chrom", "chromStart", "chromEnd"), bin_: str | None = "bin", user: str | None = None, password: str | None = None) -> DataFrame:
    """Rows of a database's table on a sequence, or that overlap a range of it; the database selects them by its bins."""
    name = seq.replace("'", "''")
    where = f"{columns[0]} = '{name}'" if start is None else overlap_condition(*columns, seq, start, end, bin_)
    return jdbc(spark, url, f"SELECT * FROM {table} WHERE {where}", user, password)


def jdbc(spark: SparkSession, url: str, table_or_query: str, user: str | None = None, password: str | None = None) -> DataFrame:
    """A database table or query; filters on it are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table_or_query if " " not in table_or_query.strip() else f"({table_or_query}) t")
    return (reader.option("user", user).option("password", password) if user else reader).load()
