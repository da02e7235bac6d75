"""Annotation-like views of the star-schema tables, in Spark and as common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import blocks as B
from ..operators import alignments as A
from .registry import Tables

#: Every interval of the view `intervals` lies on a sequence of this size.
SIZE = 100_000_000


def intervals(t: Tables) -> DataFrame:
    """An interval per line item: chrom, start, end, strand, name and the keys."""
    return t.lineitem.selectExpr(
        "concat('chr', l_suppkey % 22 + 1) AS chrom", "l_partkey * 1000 + l_linenumber * 100 AS start", "l_partkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS bigint) * 50 AS end",
        "IF(l_linestatus = 'O', '+', '-') AS strand", "concat_ws('.', l_orderkey, l_linenumber, l_partkey) AS name", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
    )


INTERVALS = """iv AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey * 1000 + l_linenumber * 100 AS st, l_partkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) * 50 AS en,
  CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand, l_orderkey || '.' || l_linenumber || '.' || l_partkey AS name, * FROM lineitem)"""


_NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount)"


def exon_rows(t: Tables) -> DataFrame:
    """A block per line item of an order, disjoint and in the order of lines (nth)."""
    rows = t.lineitem.selectExpr("*", f"CAST({_NTH} AS bigint) AS nth")
    return rows.selectExpr("l_orderkey", "nth", "nth * 1000 + l_partkey % 500 AS start", "nth * 1000 + l_partkey % 500 + CAST(l_quantity AS bigint) * 5 AS end")


EXONS = f"""li AS (SELECT *, {_NTH} AS nth FROM lineitem), ex AS (SELECT l_orderkey, nth, nth * 1000 + l_partkey % 500 AS st, nth * 1000 + l_partkey % 500 + CAST(l_quantity AS BIGINT) * 5 AS en FROM li),
tx AS (SELECT l_orderkey, 'chr' || (l_orderkey % 22 + 1) AS chrom, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, min(st) AS tx_start, max(en) AS tx_end, count(*) AS n,
  min(st) + 200 AS cds_start, greatest(min(st) + 200, max(en) - 300) AS cds_end FROM ex GROUP BY l_orderkey)"""


def genes(t: Tables) -> DataFrame:
    """A gene per order: its lines are the exons, the CDS leaves out 200 bases at the start and 300 at the end."""
    g = exon_rows(t).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("start"), F.col("end"), F.lit(None).cast("int").alias("frame")))).alias("exons"))
    g = g.select(
        F.col("l_orderkey").cast("string").alias("name"), "l_orderkey", F.concat(F.lit("chr"), F.col("l_orderkey") % 22 + 1).alias("chrom"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.get("exons", F.lit(0))["start"].alias("tx_start"), F.element_at("exons", -1)["end"].alias("tx_end"), "exons",
    )
    return g.withColumn("cds_start", F.col("tx_start") + 200).withColumn("cds_end", F.greatest("cds_start", F.col("tx_end") - 300))


def beds(t: Tables) -> DataFrame:
    """The genes as BED rows, the CDS being the thick range."""
    return genes(t).select("chrom", F.col("tx_start").alias("chrom_start"), F.col("tx_end").alias("chrom_end"), "name", F.lit(0).alias("score"), "strand", F.col("cds_start").alias("thick_start"), F.col("cds_end").alias("thick_end"), F.lit("0").alias("item_rgb"), F.transform("exons", lambda e: B.block(e["start"], e["end"])).alias("blocks"), "l_orderkey")


Q_SIZE, T_SIZE = 40_000, 100_000


def alignments(t: Tables) -> DataFrame:
    """An alignment per order: its lines are the blocks, with gaps on both sides; strands go by the order's number."""
    rows = t.lineitem.selectExpr("*", f"CAST({_NTH} AS bigint) AS nth").selectExpr("l_orderkey", "nth * 400 + l_suppkey % 20 AS q", "nth * 1000 + l_partkey % 500 AS t", "CAST(l_quantity AS bigint) * 5 AS n")
    a = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("q", "t", "n"))).alias("b"))
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("+-"), F.lit("--")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    a = a.select(
        "l_orderkey", strand.alias("strand"), F.concat(F.lit("q"), F.col("l_orderkey")).alias("q_name"), F.lit(Q_SIZE).cast("bigint").alias("q_size"), F.concat(F.lit("chr"), F.col("l_orderkey") % 22 + 1).alias("t_name"), F.lit(T_SIZE).cast("bigint").alias("t_size"),
        F.transform("b", lambda x: A.psl_block(x["q"], x["t"], x["n"])).alias("blocks"),
    )
    return A.with_counts(A.with_bounds(a)).withColumns({"mis_match": F.col("l_orderkey") % 7, "rep_match": F.col("l_orderkey") % 5})


ALIGNMENTS = f"""ll AS (SELECT *, {_NTH} AS nth FROM lineitem), bl AS (SELECT l_orderkey, nth, nth * 400 + l_suppkey % 20 AS q, nth * 1000 + l_partkey % 500 AS t, CAST(l_quantity AS BIGINT) * 5 AS n FROM ll),
bp AS (SELECT *, lag(q + n) OVER w AS pq, lag(t + n) OVER w AS pt, lead(q) OVER w AS nq, lead(t) OVER w AS nt FROM bl WINDOW w AS (PARTITION BY l_orderkey ORDER BY q)),
al AS (SELECT l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '+-' ELSE '--' END AS strand, 'q' || l_orderkey AS q_name, 'chr' || (l_orderkey % 22 + 1) AS t_name,
  CAST(sum(n) AS BIGINT) AS "match", l_orderkey % 7 AS mis_match, l_orderkey % 5 AS rep_match, count(*) AS n_blocks, min(q) AS q0, max(q + n) AS q1, min(t) AS t0, max(t + n) AS t1,
  count(*) FILTER (q > pq) AS q_num_insert, CAST(coalesce(sum(q - pq) FILTER (q > pq), 0) AS BIGINT) AS q_base_insert, count(*) FILTER (t > pt) AS t_num_insert, CAST(coalesce(sum(t - pt) FILTER (t > pt), 0) AS BIGINT) AS t_base_insert,
  CASE WHEN l_orderkey % 4 IN (1, 3) THEN '-' ELSE '+' END AS qs, CASE WHEN l_orderkey % 4 IN (2, 3) THEN '-' ELSE '+' END AS ts FROM bp GROUP BY l_orderkey),
ps AS (SELECT *, CASE WHEN qs = '-' THEN {Q_SIZE} - q1 ELSE q0 END AS q_start, CASE WHEN qs = '-' THEN {Q_SIZE} - q0 ELSE q1 END AS q_end,
  CASE WHEN ts = '-' THEN {T_SIZE} - t1 ELSE t0 END AS t_start, CASE WHEN ts = '-' THEN {T_SIZE} - t0 ELSE t1 END AS t_end FROM al)"""
