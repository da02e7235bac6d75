"""Queries on functions of coordinates, blocks, alignments, colours and feature trees."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import blocks as B, coords as C, mathx as M
from ..operators import alignments as A, annotation as AN, genes as G
from ..sources import text
from .registry import Tables, query
from .views import ALIGNMENTS, EXONS, INTERVALS, Q_SIZE, SIZE, T_SIZE, alignments, beds, genes, intervals


@query(f"WITH {INTERVALS} SELECT name, chrom || ':' || (st + 1) || '-' || en AS text, chrom || ':' || st || '-' || (en + 5) AS moved, en - st AS length, chrom || ':' || format('{{:,}}', st) || '-' || format('{{:,}}', en) AS commas, true AS same FROM iv")
def coords_text(t: Tables) -> DataFrame:
    """Coordinates as texts, counted from one or zero, with commas, changed, and read again."""
    size = F.greatest(F.lit(SIZE), "end")  # larger tables have ranges beyond SIZE
    c = intervals(t).select("name", C.coords("chrom", "start", "end", "strand", size, check=True).alias("c"))
    one, commas = C.format_coords(F.col("c"), one_based=True), C.format_coords(F.col("c"), commas=True)
    again = C.parse_coords(one, one_based=True, strand=F.col("c.strand"), size=F.col("c.size"))
    same = (again == F.col("c")) & (C.parse_coords(commas).start == F.col("c.start"))
    return c.select("name", one.alias("text"), C.format_coords(C.adjust(F.col("c"), end=F.col("c.end") + 5)).alias("moved"), C.length(F.col("c")).alias("length"), commas.alias("commas"), same.alias("same"))


@query(f"WITH {INTERVALS} SELECT name, chrom, row_number() OVER (PARTITION BY chrom ORDER BY st, en, strand, name) AS place FROM iv")
def coords_order(t: Tables) -> DataFrame:
    """Places in the order of coordinates."""
    c = intervals(t).select("name", "chrom", C.coords("chrom", "start", "end", "strand").alias("c"))
    return c.select("name", "chrom", F.row_number().over(Window.partitionBy("chrom").orderBy(*C.sort_key(F.col("c")), "name")).cast("bigint").alias("place"))


@query(f"WITH {EXONS} SELECT l_orderkey, CAST(sum(en - st) AS BIGINT) AS bases, min(st) AS \"start\", max(en) AS \"end\", 100000 - max(en) AS reversed_start, 100000 - min(st) AS reversed_end, bool_or(st <= 1100 AND 1100 < en) AS holds, max(en) + 20 AS added_end FROM ex GROUP BY l_orderkey")
def block_functions(t: Tables) -> DataFrame:
    """Bases, span, the other strand, the block at a position, and one more block."""
    span, back = B.span("blocks"), B.span(B.reverse("blocks", F.lit(100_000)))
    more = B.add("blocks", F.col("chrom_end") + 10, F.col("chrom_end") + 20, within=(F.lit(0), F.lit(100_000)))
    return beds(t).select("l_orderkey", B.coverage("blocks").alias("bases"), span.start.alias("start"), span.end.alias("end"), back.start.alias("reversed_start"), back.end.alias("reversed_end"), B.containing("blocks", F.lit(1100)).isNotNull().alias("holds"), F.element_at(more, -1)["end"].alias("added_end"))


@query(f"WITH {EXONS}, p AS (SELECT a.l_orderkey AS k, CAST(sum(greatest(0, least(a.en, b.en + 40) - greatest(a.st, b.st + 40))) AS BIGINT) AS shared FROM ex a JOIN ex b USING (l_orderkey) GROUP BY 1) SELECT k AS l_orderkey, shared, shared > 0 AS any_overlap, true AS contained FROM p")
def block_overlaps(t: Tables) -> DataFrame:
    """A gene's blocks against the same, moved by 40 bases, and against their inner parts."""
    moved = F.transform("blocks", lambda b: B.block(b["start"] + 40, b["end"] + 40))
    inner = F.transform("blocks", lambda b: B.block(b["start"] + 1, b["end"] - 1))
    return beds(t).select("l_orderkey", B.overlap_size("blocks", moved).alias("shared"), B.any_overlap("blocks", moved).alias("any_overlap"), B.all_contained("blocks", inner).alias("contained"))


@query(f'WITH {ALIGNMENTS} SELECT q_name, q_end - q_start AS q_span, t_end - t_start AS t_span, ("match" + mis_match + rep_match)::DOUBLE / {Q_SIZE} AS q_cover, ("match" + mis_match + rep_match)::DOUBLE / {T_SIZE} AS t_cover, ("match" + mis_match + rep_match)::DOUBLE / (q_end - q_start) AS q_density, ("match" + mis_match + rep_match)::DOUBLE / (t_end - t_start) AS t_density FROM ps')
def psl_spans(t: Tables) -> DataFrame:
    """Spans of alignments, and how much of them and of the sequences is aligned."""
    return alignments(t).select("q_name", A.q_span().alias("q_span"), A.t_span().alias("t_span"), A.q_cover().alias("q_cover"), A.t_cover().alias("t_cover"), A.q_density().alias("q_density"), A.t_density().alias("t_density"))


@query(f"WITH {ALIGNMENTS} SELECT q_name, CASE qs WHEN '-' THEN {Q_SIZE} - q - n ELSE q END AS q_start, CASE qs WHEN '-' THEN {Q_SIZE} - q ELSE q + n END AS q_end, CASE ts WHEN '-' THEN {T_SIZE} - t - n ELSE t END AS t_start, CASE ts WHEN '-' THEN {T_SIZE} - t ELSE t + n END AS t_end FROM bl JOIN ps USING (l_orderkey)")
def psl_forward_ranges(t: Tables) -> DataFrame:
    """Every block on the forward strands of both sequences."""
    return alignments(t).select("q_name", F.inline(A.forward_ranges()))


@query(f"WITH {EXONS} SELECT CAST(l_orderkey AS VARCHAR) AS name, string_agg(st, ',' ORDER BY CASE strand WHEN '-' THEN -st ELSE st END) AS starts FROM ex JOIN tx USING (l_orderkey) GROUP BY l_orderkey")
def transcription_order(t: Tables) -> DataFrame:
    """Exons in the order in which they are transcribed."""
    return genes(t).select("name", F.array_join(F.transform(G.transcription_order(), lambda e: e["start"].cast("string")), ",").alias("starts"))


@query(f"WITH {EXONS} SELECT 't' || l_orderkey AS root, 't' || l_orderkey AS node, 0 AS depth, tx_start AS \"start\" FROM tx WHERE l_orderkey % 7 = 0 UNION ALL SELECT 't' || l_orderkey, 'e' || l_orderkey || '.' || nth, 1, st FROM ex WHERE l_orderkey % 7 = 0")
def feature_tree(t: Tables) -> DataFrame:
    """Transcripts and their exons, in depth-first order."""
    g = beds(t).where("l_orderkey % 7 = 0")
    none = F.array().cast("array<string>")
    top = g.select(F.concat(F.lit("t"), "l_orderkey").alias("id"), none.alias("parents"), F.col("chrom").alias("seqname"), F.col("chrom_start").alias("start"), F.col("chrom_end").alias("end"), F.lit("transcript").alias("type"))
    exons = g.select("l_orderkey", "chrom", F.posexplode("blocks").alias("i", "b"))
    exons = exons.select(F.concat(F.lit("e"), "l_orderkey", F.lit("."), F.col("i") + 1).alias("id"), F.array(F.concat(F.lit("t"), "l_orderkey")).alias("parents"), F.col("chrom").alias("seqname"), F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.lit("exon").alias("type"))
    return AN.feature_tree(top.unionAll(exons)).select("root", "node", F.col("depth").cast("int").alias("depth"), "start")


@query("SELECT p_partkey, '9,' || (p_partkey * 11 % 256) || ',' || (p_partkey * 13 % 256) AS r, (p_partkey * 7 % 256) || ',9,' || (p_partkey * 13 % 256) AS g, (p_partkey * 7 % 256) || ',' || (p_partkey * 11 % 256) || ',9' AS b, 0.5::DOUBLE AS alpha, (255 - p_partkey * 7 % 256) || ',' || (255 - p_partkey * 11 % 256) || ',' || (255 - p_partkey * 13 % 256) AS complement FROM part")
def color_channels(t: Tables) -> DataFrame:
    """Colours with one channel replaced, and their complements."""
    part = lambda n: F.col("p_partkey") * n % 256
    c = t.part.select("p_partkey", M.rgb8(part(7), part(11), part(13)).alias("c"))
    with_ = lambda ch: M.format_rgb8(M.with_channel(F.col("c"), ch, F.lit(9 / 255)))
    return c.select("p_partkey", with_("r").alias("r"), with_("g").alias("g"), with_("b").alias("b"), M.with_channel(F.col("c"), "a", F.lit(0.5))["a"].alias("alpha"), M.format_rgb8(M.complementary(F.col("c"))).alias("complement"))


@query("SELECT p_partkey, CAST(p_partkey % 3 AS INTEGER) AS frame, CAST((3 - p_partkey % 3) % 3 AS INTEGER) AS phase, CAST((p_partkey + p_size) % 3 AS INTEGER) AS later FROM part")
def frame_functions(t: Tables) -> DataFrame:
    """Frames and phases."""
    phase = ((3 - F.col("p_partkey") % 3) % 3).cast("string")
    rows = t.part.select("p_partkey", C.valid_frame(C.phase_to_frame(phase)).alias("frame"), "p_size")
    return rows.select("p_partkey", "frame", C.frame_to_phase("frame").alias("phase"), C.frame_add("frame", "p_size").alias("later"))


@query("SELECT * FROM (VALUES ('db.host', 'localhost'), ('db.user', 'reader=1'), ('empty', '')) v(key, value)")
def config_file(t: Tables) -> DataFrame:
    """A configuration of keys and values."""
    with tempfile.NamedTemporaryFile("w", suffix=".conf") as f:
        f.write("# settings\n\ndb.host=localhost\n db.user = reader=1\nempty=\nno value\n")
        f.flush()
        found = text.config(f.name)
    return t.spark.createDataFrame(list(found.items()), "key string, value string")
