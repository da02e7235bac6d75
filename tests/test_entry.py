"""The driver contract, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_queries_match_their_oracles(spark):
    """Rows as multisets of texts, floats rounded; the driver compares all of them on a larger table."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    show = lambda v: None if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    queries = __spark_entry__.queries()
    for name, sql in __spark_entry__.oracle_sql().items():
        df, found = queries[name](spark, DATA), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(found.columns), name
        order = [found.columns.index(c) for c in columns]
        got = sorted(tuple(str(show(r[c])) for c in columns) for r in df.collect())
        want = sorted(tuple(str(show(r[k])) for k in order) for r in found.fetchall())
        assert got == want, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

def equals_oracle(spark, folder, name):
    """Whether a query on a folder of line items gives the rows of its SQL."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    df, found = __spark_entry__.queries()[name](spark, folder), con.sql(__spark_entry__.oracle_sql()[name])
    columns = found.columns
    return sorted(map(str, df.select(*columns).rdd.map(tuple).collect())) == sorted(map(str, found.fetchall()))


def shifted(spark, tmp_path, by):
    """The folder of a copy of the smallest line items, with part keys greater by so much."""
    spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + by).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_coords_text_beyond_the_size(spark, tmp_path):
    assert equals_oracle(spark, shifted(spark, tmp_path, 150_000), "coords_text")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_big_bed_ranges_beyond_the_size(spark, tmp_path):
    assert equals_oracle(spark, shifted(spark, tmp_path, 150_000), "big_bed_ranges")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_cds_ranges_beyond_the_size(spark, tmp_path):
    assert equals_oracle(spark, shifted(spark, tmp_path, 150_000), "cds_ranges")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_calc_bin_beyond_512_mb(spark, tmp_path):
    assert equals_oracle(spark, shifted(spark, tmp_path, 536_800), "calc_bin")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_overlapping_bins_beyond_512_mb(spark, tmp_path):
    assert equals_oracle(spark, shifted(spark, tmp_path, 536_800), "overlapping_bins")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_range_table_rows_beyond_512_mb(spark, tmp_path):
    assert equals_oracle(spark, shifted(spark, tmp_path, 536_800), "range_table_rows")


def test_range_table_without_extended_bins(spark):
    """Lookups find ranges on both sides of 512 Mb, and one that no bin of the basic scheme holds."""
    from helixframe.sources.tables import RangeTable

    edge = 1 << 29
    rows = [("c", k, k + 10, "+", f"r{k}") for k in (5, edge - 10, edge - 5, edge, edge + 9, 2 * edge + 7)]
    table = RangeTable(spark, "ranges_basic", extended=False)
    table.load(spark.createDataFrame(rows, "chrom string, start long, end long, strand string, name string"))
    for a, b in ((0, 6), (edge - 3, edge + 2), (edge + 8, edge + 10), (0, 3 * edge)):
        assert {r["name"] for r in table.overlapping("c", a, b).collect()} == {r[4] for r in rows if r[1] < b and r[2] > a}
    table.drop()
