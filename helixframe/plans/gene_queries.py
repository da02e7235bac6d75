"""Queries on gene models and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import blocks as B, strings as S
from ..operators import alignments as A, genes as G, intervals as I
from .registry import Tables, query
from .views import ALIGNMENTS, EXONS, Q_SIZE, T_SIZE, alignments, genes

_E = f"WITH {EXONS}, e AS (SELECT ex.*, chrom, strand, tx_start, tx_end, cds_start, cds_end, greatest(0, least(en, cds_end) - greatest(st, cds_start)) AS c FROM ex JOIN tx USING (l_orderkey)) "
_NAME = "CAST(l_orderkey AS VARCHAR) AS name"


@query(_E + f"""SELECT {_NAME}, st AS exon_start, CASE WHEN strand = '+' THEN h ELSE t END AS utr5, c AS cds, CASE WHEN strand = '+' THEN t ELSE h END AS utr3
FROM (SELECT *, greatest(0, least(en, cds_start) - st) AS h, en - st - greatest(0, least(en, cds_start) - st) - c AS t FROM e)""")
def exon_features(t: Tables) -> DataFrame:
    """Bases of each exon in the 5' UTR, the CDS and the 3' UTR."""
    rows = genes(t).select("name", F.explode(F.arrays_zip("exons", G.features().alias("f"))).alias("x"))
    size = lambda r: F.coalesce(r["end"] - r["start"], F.lit(0).cast("bigint"))
    return rows.select("name", F.col("x.exons.start").alias("exon_start"), *(size(F.col(f"x.f.{k}")).alias(k) for k in ("utr5", "cds", "utr3")))


@query(_E + f"SELECT {_NAME}, st AS \"start\", CAST(CASE WHEN c = 0 THEN -1 ELSE coalesce(sum(c) OVER (PARTITION BY l_orderkey ORDER BY CASE strand WHEN '+' THEN st ELSE -st END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3 END AS INTEGER) AS frame FROM e")
def exon_frames(t: Tables) -> DataFrame:
    return genes(t).select("name", F.explode(G.assign_frames()).alias("e")).select("name", "e.start", "e.frame")


@query(_E + f"SELECT {_NAME}, CAST(sum(en - st) AS BIGINT) AS exon_bases, CAST(sum(c) AS BIGINT) AS cds_bases, count(*) FILTER (c > 0) AS cds_exons, sum(c) > 0 AS has_cds, max(en) - min(st) AS span FROM e GROUP BY l_orderkey")
def gene_lengths(t: Tables) -> DataFrame:
    return genes(t).select("name", G.exon_length().alias("exon_bases"), G.cds_length().alias("cds_bases"), G.cds_exon_count().cast("bigint").alias("cds_exons"), G.has_cds().alias("has_cds"), (F.col("tx_end") - F.col("tx_start")).alias("span"))


@query(_E + f", f AS (SELECT l_orderkey, min(nth) FILTER (c > 0) AS a, max(nth) FILTER (c > 0) AS b FROM e GROUP BY 1) SELECT {_NAME}, st AS \"start\", CAST(CASE WHEN nth BETWEEN a AND b THEN nth - a END AS INTEGER) AS cds_number, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE strand WHEN '+' THEN st ELSE -st END) AS INTEGER) AS transcribed FROM e JOIN f USING (l_orderkey)")
def exon_numbers(t: Tables) -> DataFrame:
    g = genes(t).withColumn("n", G.exon_numbers("exons"))
    n = F.size("exons")
    out = g.select("name", "strand", n.alias("size"), F.posexplode(F.arrays_zip("exons", "n")).alias("i", "x"))
    return out.select("name", F.col("x.exons.start").alias("start"), F.col("x.n").alias("cds_number"), F.when(F.col("strand") == "+", F.col("i") + 1).otherwise(F.col("size") - F.col("i")).alias("transcribed"))


def _gene_pairs(t: Tables) -> DataFrame:
    g = genes(t)
    a = g.select(*(F.col(c).alias("a_" + c) for c in g.columns))
    b = g.select(*(F.col(c).alias("b_" + c) for c in g.columns))
    return a.join(b, (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a_l_orderkey") + 22 * 5 == F.col("b_l_orderkey")))


_GP = _E + f""", l AS (SELECT l_orderkey, CAST(sum(en - st) AS BIGINT) AS ex, CAST(sum(c) AS BIGINT) AS cds, any_value(strand) AS strand FROM e GROUP BY 1),
p AS (SELECT a.l_orderkey AS k, b.l_orderkey AS k2, a.ex AS ex1, b.ex AS ex2, a.cds AS c1, b.cds AS c2, a.strand = b.strand AS same FROM l a JOIN l b ON a.l_orderkey + 110 = b.l_orderkey),
o AS (SELECT p.k, CAST(coalesce(sum(greatest(0, least(x.en, y.en) - greatest(x.st, y.st))), 0) AS BIGINT) AS ov, CAST(coalesce(sum(greatest(0, least(x.en, y.en, x.cds_end, y.cds_end) - greatest(x.st, y.st, x.cds_start, y.cds_start))), 0) AS BIGINT) AS cov
  FROM p JOIN e x ON x.l_orderkey = p.k JOIN e y ON y.l_orderkey = p.k2 AND same GROUP BY p.k),
r AS (SELECT CAST(p.k AS VARCHAR) AS name, ex1, ex2, c1, c2, CASE WHEN same THEN ov ELSE 0 END AS ov, CASE WHEN same THEN cov ELSE 0 END AS cov FROM p LEFT JOIN o USING (k)) """


@query(_GP + "SELECT name, ov AS exon_overlap, CASE WHEN ov = 0 THEN 0.0::DOUBLE ELSE 2 * ov::DOUBLE / (ex1 + ex2) END AS similarity FROM r")
def gene_similarity(t: Tables) -> DataFrame:
    return _gene_pairs(t).select(F.col("a_name").alias("name"), G.exon_overlap().alias("exon_overlap"), G.similarity().alias("similarity"))


@query(_GP + "SELECT name, cov AS cds_overlap, CASE WHEN cov = 0 THEN 0.0::DOUBLE ELSE 2 * cov::DOUBLE / (c1 + c2) END AS cds_similarity, CASE WHEN cov = 0 THEN 0.0::DOUBLE ELSE cov::DOUBLE / c1 END AS cds_cover FROM r")
def cds_cover(t: Tables) -> DataFrame:
    return _gene_pairs(t).select(F.col("a_name").alias("name"), G.cds_overlap().alias("cds_overlap"), G.cds_similarity().alias("cds_similarity"), G.cds_cover().alias("cds_cover"))


@query(f"WITH {EXONS}, k AS (SELECT l_orderkey, min(chrom) AS chrom, min(strand) AS strand, string_agg(greatest(st, cds_start) || '-' || least(en, cds_end), ',' ORDER BY st) FILTER (greatest(st, cds_start) < least(en, cds_end)) AS c, min(cds_start) AS s, max(cds_end) AS e FROM ex JOIN tx USING (l_orderkey) GROUP BY 1), p AS (SELECT a.l_orderkey AS k, a.c IS NOT DISTINCT FROM b.c AND a.s = b.s AND a.e = b.e AND a.strand = b.strand AS same FROM k a JOIN k b ON a.l_orderkey + 110 = b.l_orderkey) SELECT CAST(k AS VARCHAR) AS name, same AS same_cds FROM p")
def same_cds(t: Tables) -> DataFrame:
    return _gene_pairs(t).select(F.col("a_name").alias("name"), G.same_cds().alias("same_cds"))


@query(_E + f"SELECT {_NAME}, count(*) FILTER (st <= tx_start + 1500 AND tx_start + 1500 < en) > 0 AS in_exon, any_value(cds_start <= tx_start + 1500 AND tx_start + 1500 < cds_end) AS in_cds, any_value(tx_start < 3000 AND tx_end > 2000) AS overlaps, any_value(2000 < cds_end AND 3000 > cds_start) AS overlaps_cds FROM e GROUP BY l_orderkey")
def gene_predicates(t: Tables) -> DataFrame:
    at = F.col("tx_start") + 1500
    return genes(t).select("name", G.containing_exon(at).isNotNull().alias("in_exon"), G.in_cds(at).alias("in_cds"), G.overlaps(F.lit(2000), F.lit(3000)).alias("overlaps"), G.overlaps_cds(F.lit(2000), F.lit(3000)).alias("overlaps_cds"))


@query(_E + f"SELECT {_NAME}, 100000 - en AS \"start\", 100000 - st AS \"end\" FROM e")
def gene_reverse(t: Tables) -> DataFrame:
    return genes(t).select("name", F.explode(G.reversed_gene("exons", F.lit(100_000))).alias("e")).select("name", "e.start", "e.end")


@query(_E + f", c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (c > 0) AS nc FROM e GROUP BY 1) SELECT {_NAME}, n FROM c WHERE n >= 2 AND n <= 5 AND nc >= 2 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def select_genes(t: Tables) -> DataFrame:
    ids = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string"))
    return G.select_genes(genes(t), min_exons=2, max_exons=5, min_cds_exons=2, names=ids).select("name", F.size("exons").cast("bigint").alias("n"))


@query("SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def check_unique(t: Tables) -> DataFrame:
    return G.check_unique(t.lineitem.select(F.col("l_suppkey").alias("key")), "key")


# alignments

_A = f"WITH {ALIGNMENTS} "
_SIZE = "(\"match\" + mis_match + rep_match)"


@query(_A + f"SELECT q_name, \"match\", q_start, q_end, t_start, t_end, q_num_insert, q_base_insert, t_num_insert, t_base_insert FROM ps")
def psl_bounds_counts(t: Tables) -> DataFrame:
    return alignments(t).select("q_name", "match", "q_start", "q_end", "t_start", "t_end", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert")


@query(_A + f"SELECT q_name, (\"match\" + rep_match)::DOUBLE / {_SIZE} AS identity, {_SIZE}::DOUBLE / {Q_SIZE} AS q_cover, {_SIZE}::DOUBLE / {T_SIZE} AS t_cover, {_SIZE}::DOUBLE / (q_end - q_start) AS q_density, {_SIZE}::DOUBLE / (t_end - t_start) AS t_density FROM ps")
def psl_identity_cover(t: Tables) -> DataFrame:
    return alignments(t).select("q_name", A.identity().alias("identity"), A.q_cover().alias("q_cover"), A.t_cover().alias("t_cover"), A.q_density().alias("q_density"), A.t_density().alias("t_density"))


@query(_A + f"SELECT ps.q_name, CASE qs WHEN '+' THEN '-' ELSE '+' END || CASE ts WHEN '+' THEN '-' ELSE '+' END AS strand, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC) - 1 AS INTEGER) AS nth, {Q_SIZE} - q - n AS q, {T_SIZE} - t - n AS t, n FROM bl JOIN ps USING (l_orderkey)")
def psl_reverse_complement(t: Tables) -> DataFrame:
    return A.reverse_complemented(alignments(t)).select("q_name", "strand", F.posexplode("blocks").alias("nth", "b")).select("q_name", "strand", "nth", F.col("b.q_start").alias("q"), F.col("b.t_start").alias("t"), F.col("b.size").alias("n"))


@query(_A + f"""SELECT t_name AS q_name, ps.q_name AS t_name, CASE strand WHEN '+' THEN '+' WHEN '-' THEN '-' WHEN '+-' THEN '-+' ELSE '--' END AS strand, t_start AS q_start, q_start AS t_start, t_num_insert AS q_num_insert,
CASE strand WHEN '-' THEN {T_SIZE} - t - n ELSE t END AS q, CASE strand WHEN '-' THEN {Q_SIZE} - q - n ELSE q END AS t, n FROM bl JOIN ps USING (l_orderkey)""")
def psl_swap(t: Tables) -> DataFrame:
    s = A.swap_sides(alignments(t).drop("l_orderkey"), keep_implicit=True)
    return s.select("q_name", "t_name", "strand", "q_start", "t_start", "q_num_insert", F.explode("blocks").alias("b")).select("q_name", "t_name", "strand", "q_start", "t_start", "q_num_insert", F.col("b.q_start").alias("q"), F.col("b.t_start").alias("t"), F.col("b.size").alias("n"))


@query(_A + f"SELECT t_name AS chrom, t_start AS chrom_start, t_end AS chrom_end, ps.q_name AS name, CASE WHEN qs = ts THEN '+' ELSE '-' END AS strand, CASE ts WHEN '-' THEN {T_SIZE} - t - n ELSE t END AS \"start\", CASE ts WHEN '-' THEN {T_SIZE} - t ELSE t + n END AS \"end\" FROM bl JOIN ps USING (l_orderkey)")
def psl_to_bed(t: Tables) -> DataFrame:
    return A.to_bed(alignments(t)).select("chrom", "chrom_start", "chrom_end", "name", "strand", F.explode("blocks").alias("b")).select("chrom", "chrom_start", "chrom_end", "name", "strand", "b.start", "b.end")


@query(_A + "SELECT q_name, t_start < 2500 AND t_end > 1500 AND t_name = 'chr5' AS t_overlap, (SELECT count(*) FROM bl WHERE bl.l_orderkey = ps.l_orderkey AND t < 2500 AND t + n > 2300) > 0 AS block_overlap, false AS is_protein FROM ps")
def psl_predicates(t: Tables) -> DataFrame:
    return alignments(t).select("q_name", A.t_overlap(F.lit("chr5"), F.lit(1500), F.lit(2500)).alias("t_overlap"), A.t_block_overlap(F.lit(2300), F.lit(2500)).alias("block_overlap"), A.is_protein().alias("is_protein"))


def _projection(side: str) -> str:
    """The pieces of a range on one side, straight from the rows of blocks and of the gaps between them."""
    o = "q" if side == "t" else "t"
    size = T_SIZE if side == "t" else Q_SIZE
    strand = "ts" if side == "t" else "qs"
    lo, hi = ("2100", "4200") if side == "t" else ("850", "1700")
    return f"""WITH {ALIGNMENTS}, r AS (SELECT l_orderkey, q_name, CASE WHEN {strand} = '+' THEN {lo} ELSE {size} - {hi} END AS lo, CASE WHEN {strand} = '+' THEN {hi} ELSE {size} - {lo} END AS hi, {side}0 AS first, {side}1 AS last FROM ps),
x AS (SELECT r.*, {side} AS a, {side} + n AS e, {o} AS o, p{side} AS pe, p{o} AS po, n FROM bp JOIN r USING (l_orderkey)),
y AS (SELECT q_name, 'aligned' AS kind, greatest(lo, a) AS s, least(hi, e) AS e, o + greatest(lo, a) - a AS os, o + least(hi, e) - a AS oe, NULL::BIGINT AS prev, NULL::BIGINT AS nxt FROM x WHERE greatest(lo, a) < least(hi, e)
UNION ALL SELECT q_name, '{side}_insert', greatest(lo, pe), least(hi, a), NULL, NULL, po, o FROM x WHERE greatest(lo, pe) < least(hi, a)
UNION ALL SELECT q_name, '{side}_insert', lo, a, NULL, NULL, NULL, o FROM x WHERE a = first AND lo < a
UNION ALL SELECT q_name, '{side}_insert', greatest(lo, e), hi, NULL, NULL, o + n, NULL FROM x WHERE e = last AND hi > e)
SELECT q_name, kind, s AS "start", e AS "end", os AS other_start, oe AS other_end, prev AS other_prev, nxt AS other_next FROM y"""


def _pieces(t: Tables, side: str, lo: int, hi: int) -> DataFrame:
    other = "q" if side == "t" else "t"
    rows = alignments(t).select("q_name", F.explode(A.project(side, F.lit(lo), F.lit(hi))).alias("p"))
    p = lambda n: F.col(f"p.{n}")
    return rows.select("q_name", p("kind").alias("kind"), p(f"{side}_start").alias("start"), p(f"{side}_end").alias("end"), p(f"{other}_start").alias("other_start"), p(f"{other}_end").alias("other_end"), p(f"prev_{other}_end").alias("other_prev"), p(f"next_{other}_start").alias("other_next"))


@query(_projection("t"))
def t2q_projection(t: Tables) -> DataFrame:
    return _pieces(t, "t", 2100, 4200)


@query(_projection("q"))
def q2t_projection(t: Tables) -> DataFrame:
    return _pieces(t, "q", 850, 1700)


@query(f"WITH {ALIGNMENTS}, r AS (SELECT l_orderkey, q_name, CASE WHEN ts = '+' THEN 2100 ELSE {T_SIZE} - 4200 END AS lo, CASE WHEN ts = '+' THEN 4200 ELSE {T_SIZE} - 2100 END AS hi FROM ps), x AS (SELECT q_name, greatest(lo, t) AS s, least(hi, t + n) AS e FROM bl JOIN r USING (l_orderkey) WHERE greatest(lo, t) < least(hi, t + n)) SELECT q_name, CAST(sum(e - s) AS BIGINT) AS \"match\", count(*) AS n_blocks FROM x GROUP BY q_name")
def t2q_alignment(t: Tables) -> DataFrame:
    return A.projected_alignment(alignments(t), "t", F.lit(2100), F.lit(4200)).select("q_name", "match", F.size("blocks").cast("bigint").alias("n_blocks"))


@query(f"WITH {ALIGNMENTS} SELECT 'q' || l_orderkey AS q_name, 'aligned' AS kind, q AS q_start, q + n AS q_end, t AS t_start, t + n AS t_end FROM bp UNION ALL SELECT 'q' || l_orderkey, 'q_insert', pq, q, NULL, NULL FROM bp WHERE q > pq UNION ALL SELECT 'q' || l_orderkey, 't_insert', NULL, NULL, pt, t FROM bp WHERE t > pt")
def alignment_blocks(t: Tables) -> DataFrame:
    return alignments(t).select("q_name", F.explode(A.alignment_blocks("blocks", unaligned=True)).alias("p")).select("q_name", "p.*")


@query(f"WITH {ALIGNMENTS}, x AS (SELECT l_orderkey, t + greatest(900, q) - q AS s, t + least(1700, q + n) - q AS e FROM bl WHERE greatest(900, q) < least(1700, q + n)) SELECT 'q' || l_orderkey AS q_name, min(s) AS cds_start, max(e) AS cds_end FROM x GROUP BY l_orderkey")
def project_cds(t: Tables) -> DataFrame:
    return alignments(t).select("q_name", A.project_cds(F.lit(900), F.lit(1700)).alias("c")).where("c IS NOT NULL").select("q_name", F.col("c.start").alias("cds_start"), F.col("c.end").alias("cds_end"))


@query(f"WITH {ALIGNMENTS}, k AS (SELECT *, CAST(sum(CASE WHEN q > pq THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY q) AS BIGINT) AS j FROM bp) SELECT 'q' || l_orderkey AS q_name, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS aligned, CAST(coalesce(sum(greatest(0, q - pq)), 0) AS BIGINT) AS inserted, CAST(coalesce(sum(greatest(0, t - pt)), 0) AS BIGINT) AS deleted, 1000 + max(t + n) - min(t) AS t_end, max(q + n) - min(q) AS q_size FROM k GROUP BY l_orderkey")
def cigar_alignment(t: Tables) -> DataFrame:
    """Alignments written as CIGARs, parsed, and rebuilt."""
    a = alignments(t)
    gap = lambda p, s: p["after"][f"{s}_start"] - p["before"][f"{s}_start"] - p["before"]["size"]
    run = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    first = F.get("blocks", F.lit(0))["size"]
    text = F.concat(run(first, "M"), F.array_join(F.transform(A.neighbours(), lambda p: F.concat(run(gap(p, "q"), "I"), run(gap(p, "t"), "D"), run(p["after"]["size"], "M"))), " "))
    c = a.select("q_name", text.alias("text")).withColumn("cigar", S.parse_cigar("text"))
    made = c.select("cigar", *A.from_cigar("q_name", F.lit("+"), F.lit("chr1"), F.lit(T_SIZE), F.lit(1000), F.col("cigar")))
    same = S.format_cigar(S.parse_cigar(S.format_cigar("cigar", ones=True)), ones=True) == S.format_cigar("cigar", ones=True)
    return made.where(same).select("q_name", F.size("blocks").cast("bigint").alias("n_blocks"), S.cigar_length("cigar", "aligned").alias("aligned"), F.col("q_base_insert").alias("inserted"), F.col("t_base_insert").alias("deleted"), "t_end", "q_size")


@query(f"WITH {ALIGNMENTS} SELECT count(*) AS n, count(*) AS n_same FROM ps")
def same_alignment(t: Tables) -> DataFrame:
    a = alignments(t)
    twice = A.reverse_complemented(A.reverse_complemented(a))
    x = a.withColumn("strand", F.concat(A.q_strand(), A.t_strand())).select(*(F.col(c).alias("a_" + c) for c in a.columns))
    y = twice.select(*(F.col(c).alias("b_" + c) for c in a.columns))
    return x.join(y, F.col("a_q_name") == F.col("b_q_name")).agg(F.count("*").alias("n"), F.count_if(A.same_alignment()).alias("n_same"))


@query(f"""WITH {ALIGNMENTS}, pl AS (SELECT l_orderkey, t_name, ts, q_name FROM ps), s AS (SELECT bl.l_orderkey, min(t + greatest(900, q) - q) AS a, max(t + least(1700, q + n) - q) AS b FROM bl WHERE greatest(900, q) < least(1700, q + n) GROUP BY 1),
sp AS (SELECT s.*, pl.* EXCLUDE (l_orderkey) FROM s JOIN pl USING (l_orderkey) WHERE l_orderkey % 50 = 0), d AS (SELECT l_orderkey, min(t) AS lo, max(t + n) AS hi FROM bl GROUP BY 1),
pr AS (SELECT sp.q_name AS source_name, pl.q_name AS dest_name, a, b, d.l_orderkey AS k FROM sp JOIN pl ON sp.t_name = pl.t_name AND sp.ts = pl.ts AND pl.l_orderkey % 7 = 0 JOIN d ON d.l_orderkey = pl.l_orderkey AND d.lo < b AND d.hi > a)
SELECT source_name, dest_name, a AS t_cds_start, b AS t_cds_end, min(q + greatest(a, t) - t) FILTER (greatest(a, t) < least(b, t + n)) AS cds_start, max(q + least(b, t + n) - t) FILTER (greatest(a, t) < least(b, t + n)) AS cds_end FROM pr JOIN bl ON bl.l_orderkey = k GROUP BY ALL""")
def map_cds(t: Tables) -> DataFrame:
    a = alignments(t)
    source = a.where("l_orderkey % 50 = 0").withColumns({"cds_start": F.lit(900), "cds_end": F.lit(1700)})
    return A.map_cds(source, a.where("l_orderkey % 7 = 0"))
