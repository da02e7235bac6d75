"""Set membership: power sets, exclusive and inclusive Venn counts, membership matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.util import ColumnOrName, bind, col


def power_set(elements: ColumnOrName) -> Column:
    """All non-empty subsets of an array's distinct elements, by size, then by members."""

    def subsets(e: Column) -> Column:
        bits = F.pow(F.lit(2), F.size(e)).cast("bigint") - 1
        one = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(bits, F.lit(1))), lambda b: F.filter(e, lambda x, i: F.call_function("getbit", b, i) == 1))
        ordered = F.sort_array(F.transform(one, lambda s: F.struct(F.size(s).alias("n"), s.alias("s"))))
        return F.filter(F.transform(ordered, lambda x: x["s"]), lambda s: F.size(s) > 0)

    return bind(F.array_sort(F.array_distinct(col(elements))), subsets)


def set_names(df: DataFrame, set_col: str = "set_name") -> DataFrame:
    """One row: the sorted names of all sets. There must be few (2**n subsets are listed)."""
    return df.agg(F.array_sort(F.collect_set(set_col)).alias("names"))


def subsets(df: DataFrame, set_col: str = "set_name") -> DataFrame:
    """All non-empty subsets of the set names: nth in order, subset."""
    return set_names(df, set_col).select(F.posexplode(power_set("names")).alias("nth", "subset"))


def membership(df: DataFrame, item_col: str = "item", set_col: str = "set_name") -> DataFrame:
    """Each item with the sorted names of the sets that hold it."""
    return df.groupBy(item_col).agg(F.array_sort(F.collect_set(set_col)).alias("subset"))


def venn(df: DataFrame, item_col: str = "item", set_col: str = "set_name", inclusive: bool = False, exclude_empty: bool = False) -> DataFrame:
    """Items per subset of the set names: those in exactly these sets, or, if inclusive, in these and perhaps others.

    Every subset is listed, in order (nth), with 0 where there are none, unless exclude_empty.
    """
    counts = membership(df, item_col, set_col).groupBy("subset").agg(F.count("*").alias("n"))
    if inclusive:  # at most one row per subset that occurs is expanded
        counts = counts.select(F.explode(power_set("subset")).alias("subset"), "n").groupBy("subset").agg(F.sum("n").alias("n"))
    if exclude_empty:
        return subsets(df, set_col).join(counts, "subset").select("nth", "subset", F.col("n").alias("count"))
    return subsets(df, set_col).join(counts, "subset", "left").select("nth", "subset", F.coalesce("n", F.lit(0).cast("bigint")).alias("count"))


def venn_items(df: DataFrame, item_col: str = "item", set_col: str = "set_name", inclusive: bool = False) -> DataFrame:
    """The items of each subset, one row each."""
    out = membership(df, item_col, set_col)
    return out.select(F.explode(power_set("subset")).alias("subset"), item_col) if inclusive else out.select("subset", item_col)


def venn_totals(df: DataFrame, item_col: str = "item") -> DataFrame:
    return df.agg(F.countDistinct(item_col).alias("n_items"))


def membership_matrix(df: DataFrame, names: Sequence[str], item_col: str = "item", set_col: str = "set_name", count_col: str = "count") -> DataFrame:
    """A row per subset that occurs, with a column of 0 or 1 per set name, and its items counted."""
    members = membership(df, item_col, set_col)
    flags = [F.array_contains("subset", n).cast("int").alias(n) for n in names]
    return members.groupBy(*flags).agg(F.count("*").alias(count_col))


def matrix_counts(matrix: DataFrame, names: Sequence[str], count_col: str = "count") -> DataFrame:
    """Subsets and counts from a membership matrix of 0/1 columns; rows in no set go."""
    subset = F.filter(F.array(*(F.when(F.col(n) == 1, F.lit(n)) for n in sorted(names))), lambda x: x.isNotNull())
    return matrix.select(subset.alias("subset"), F.col(count_col).alias("__n")).where(F.size("subset") > 0).groupBy("subset").agg(F.sum("__n").alias("count"))


def format_subset(subset: ColumnOrName, separator: str = " ") -> Column:
    return F.array_join(F.array_sort(col(subset)), separator)


def subset_rank(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """The place of each non-empty subset of names in the order of power_set."""
    return spark.createDataFrame([(list(names),)], "names array<string>").select(F.posexplode(power_set("names")).alias("nth", "subset"))


def select_by_id(df: DataFrame, ids: DataFrame, column: str, id_column: str | None = None) -> DataFrame:
    """Rows of df whose value is among the ids."""
    return df.join(ids.select(F.col(id_column or column).alias(column)), column, "left_semi")


def missing_ids(ids: DataFrame, df: DataFrame, column: str, id_column: str | None = None) -> DataFrame:
    """Ids that no row of df has."""
    return ids.select(F.col(id_column or column).alias(column)).distinct().join(df, column, "left_anti")


def first_by_id(df: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """The first row of each id in the given order: a partial minimum, not a sort of each group."""
    rest = [c for c in df.columns if c not in order]
    out = df.groupBy(id_column).agg(F.min(F.struct(*order, *[c for c in rest if c != id_column])).alias("__first"))
    return out.select(*(F.col(id_column) if c == id_column else F.col(f"__first.{c}") for c in df.columns))


def lookup(df: DataFrame, table: DataFrame, column: str, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the value of the table's row whose first matching key, in priority order, equals the column; null if none.

    The table is turned to one row per name with its best key, so it is joined once.
    """
    ranked = None
    for k, key in enumerate(keys):
        part = table.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("__name"), F.lit(k).alias("__rank"), F.col(value).alias("__value"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy("__name").agg(F.min(F.struct("__rank", "__value")).alias("__best"))
    return df.join(best, F.col(column).cast("string") == F.col("__name"), "left").withColumn(name, F.col("__best.__value")).drop("__name", "__best")
