"""Catalog tables with the lookups that annotation databases offer: by name, by range, by row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.bins import calc_bin
from ..functions.bins import overlap_predicate
from ..operators.annotation import required_rows
from ..operators.intervals import number_in_order


class RangeTable:
    """A table of ranges (sequence, start, end), with a name column, a bin and an explicit row id.

    Rows are written in order of (sequence, bin, start), so that the statistics of files and row groups do what an index on
    (sequence, bin) does; ids count rows in that order. Lookups return lazy DataFrames. With extended, bins beyond 512 Mb are
    those of the extended scheme.
    """

    def __init__(self, spark: SparkSession, table: str, seq: str = "chrom", start: str = "start", end: str = "end", name: str = "name", strand: str | None = "strand", extended: bool = True):
        self.spark, self.table, self.seq, self.start, self.end, self.name, self.strand, self.extended = spark, table, seq, start, end, name, strand, extended

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def load(self, rows: DataFrame, mode: str = "overwrite") -> None:
        """Write rows, replacing the table, or appending to it (row ids go on after the last)."""
        first = self.oid_range()[1] if mode == "append" and self.exists() else 0
        binned = rows.withColumn("bin", calc_bin(self.start, self.end, self.extended))
        order = [F.col("bin").asc_nulls_last(), self.start, self.end, self.name]
        out = number_in_order(binned, self.seq, order, "oid", first=first)
        out.repartitionByRange(self.seq, "bin", self.start).sortWithinPartitions(self.seq, "bin", self.start).write.mode(mode).saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def by_name(self, *names: str) -> DataFrame:
        return self.rows().where(F.col(self.name).isin(list(names)))

    def required(self, names: DataFrame) -> DataFrame:
        """Rows for a table of names; a name without a row is an error when the result is read."""
        return required_rows(self.rows(), names.select(F.col(names.columns[0]).alias(self.name)), self.name)

    def names(self) -> DataFrame:
        return self.rows().select(self.name).distinct()

    def overlapping(self, seq: str, start: int | None = None, end: int | None = None, strand: str | Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
        """Rows that overlap a range, or are on a sequence; of some strands and with a further condition if given."""
        out = self.rows().where((F.col(self.seq) == seq) if start is None else overlap_predicate("bin", self.seq, self.start, self.end, seq, start, end, self.extended))
        if strand is not None:
            out = out.where(F.col(self.strand).isin([strand] if isinstance(strand, str) else list(strand)))
        return out if where is None else out.where(where)

    def by_oid(self, first: int, last: int) -> DataFrame:
        """Rows with ids from first up to, not including, last."""
        return self.rows().where((F.col("oid") >= first) & (F.col("oid") < last))

    def oid_range(self) -> tuple[int, int]:
        """The first id and the one after the last; (0, 0) for an empty table."""
        r = self.rows().agg(F.min("oid").alias("a"), F.max("oid").alias("b")).first()
        return (0, 0) if r["a"] is None else (r["a"], r["b"] + 1)


def tables_like(spark: SparkSession, pattern: str, database: str | None = None) -> list[str]:
    """Names of tables that match a pattern (* and |)."""
    return [t.name for t in spark.catalog.listTables(database, pattern)]


def run(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A query with named parameters (:name), which are values and can't change its text."""
    return spark.sql(sql, args=args)


def numeric_order(df: DataFrame, column: str, reverse: bool = False) -> list[Column]:
    """How to sort a text column: as numbers if all its values that aren't blank are numbers, else as text."""
    value = F.replace(F.trim(F.col(column)), F.lit(","), F.lit("")).try_cast("double")
    all_numbers = df.agg(F.bool_and(F.coalesce(F.trim(F.col(column)), F.lit("")).isin("") | value.isNotNull()).alias("n")).first()["n"]
    key = value if all_numbers else F.col(column)
    return [key.desc() if reverse else key.asc()]
