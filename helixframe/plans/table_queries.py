"""Queries on sets, statistics, codecs, texts, colours, graphs and assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import codecs as K, mathx as M, strings as S
from ..operators import annotation as AN, sets, stats, vocabulary as V
from .registry import Tables, query
from .views import EXONS, INTERVALS, beds, intervals

# sets

_M = "WITH m AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1), n AS (SELECT array_to_string(s, ' ') AS subset, count(*) AS n, any_value(s) AS s FROM m GROUP BY 1), p(nth, subset) AS (VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'A N'), (4, 'A R'), (5, 'N R'), (6, 'A N R')) "


def _flags(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_returnflag").alias("set_name"), F.col("l_orderkey").alias("item"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("subset", sets.format_subset("subset"))


@query(_M + "SELECT nth, subset, coalesce(n.n, 0) AS count FROM p LEFT JOIN n USING (subset)")
def venn_exclusive(t: Tables) -> DataFrame:
    return _named(sets.venn(_flags(t)))


@query(_M + "SELECT nth, p.subset, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS count FROM p LEFT JOIN n ON list_has_all(n.s, string_split(p.subset, ' ')) GROUP BY ALL")
def venn_inclusive(t: Tables) -> DataFrame:
    return _named(sets.venn(_flags(t), inclusive=True))


@query(_M + "SELECT CAST(contains(subset, 'A') AS INTEGER) AS A, CAST(contains(subset, 'N') AS INTEGER) AS N, CAST(contains(subset, 'R') AS INTEGER) AS R, n AS count FROM n")
def venn_matrix(t: Tables) -> DataFrame:
    return sets.membership_matrix(_flags(t), ["A", "N", "R"])


@query(_M + "SELECT subset, n AS count FROM n")
def venn_from_matrix(t: Tables) -> DataFrame:
    return _named(sets.matrix_counts(sets.membership_matrix(_flags(t), ["A", "N", "R"]), ["A", "N", "R"]))


@query(_M + "SELECT array_to_string(s, ' ') AS subset, l_orderkey AS item FROM m")
def venn_items(t: Tables) -> DataFrame:
    return _named(sets.venn_items(_flags(t)))


@query("SELECT count(DISTINCT l_orderkey) AS n_items FROM lineitem")
def venn_totals(t: Tables) -> DataFrame:
    return sets.venn_totals(_flags(t))


@query("SELECT nth, subset FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'A N'), (4, 'A R'), (5, 'N R'), (6, 'A N R')) p(nth, subset)")
def power_set(t: Tables) -> DataFrame:
    return _named(sets.subsets(_flags(t)))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def select_by_id(t: Tables) -> DataFrame:
    return sets.select_by_id(t.lineitem.select("l_orderkey", "l_partkey"), t.part.where("p_size < 10"), "l_partkey", "p_partkey")


@query("SELECT p_partkey AS l_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 5)")
def missing_ids(t: Tables) -> DataFrame:
    return sets.missing_ids(t.part, t.lineitem.where("l_returnflag = 'R' AND l_quantity < 5"), "l_partkey", "p_partkey")


@query("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_by_id(t: Tables) -> DataFrame:
    return sets.first_by_id(t.documents.select("source", "doc_id", "lang"), "source", ["doc_id"])


@query("""WITH k AS (SELECT name, min_by(v, r * 1000000 + v) AS v FROM (SELECT CAST(p_size AS VARCHAR) AS name, 0 AS r, p_partkey AS v FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, p_partkey FROM part UNION ALL SELECT p_brand, 2, p_partkey FROM part) GROUP BY 1)
SELECT o_orderkey, k.v AS part FROM orders LEFT JOIN k ON name = CAST(o_orderkey % 300 AS VARCHAR)""")
def name_priority_lookup(t: Tables) -> DataFrame:
    return sets.lookup(t.orders.select("o_orderkey", (F.col("o_orderkey") % 300).alias("k")), t.part, "k", ["p_size", "p_partkey", "p_brand"], "p_partkey", "part").drop("k")


# statistics


def _histogram(value: str, table: str, weight: str, n: int) -> str:
    return f"""WITH v AS (SELECT CAST({value} AS DOUBLE) AS v, {weight} AS w FROM {table}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v), s AS (SELECT lo, (hi - lo + (hi - lo) / {n - 1}) / {n} AS width FROM e), f AS (SELECT width, lo - width / 2 AS floor FROM s),
c AS (SELECT CAST(least({n - 1}, greatest(0, floor((v - floor) / width))) AS INTEGER) AS bin, CAST(sum(w) AS BIGINT) AS n FROM v, f GROUP BY 1), t AS (SELECT sum(w) AS t FROM v)
SELECT CAST(b AS INTEGER) AS bin, floor + b * width AS start, floor + (b + 0.5) * width AS center, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE / t AS frequency FROM f, t, range({n}) r(b) LEFT JOIN c ON c.bin = b"""


@query(_histogram("l_quantity", "lineitem", "1", 10))
def histogram_scalar(t: Tables) -> DataFrame:
    return stats.histogram(t.lineitem, "l_quantity")


@query(_histogram("p_retailprice", "part", "p_size", 7))
def histogram_counted(t: Tables) -> DataFrame:
    return stats.histogram(t.part, "p_retailprice", 7, count="p_size")


@query("SELECT min(p_retailprice) AS min, max(p_retailprice) AS max, sum(p_retailprice * p_size) AS sum FROM part")
def number_summary(t: Tables) -> DataFrame:
    return stats.number_summary(t.part, "p_retailprice", "p_size")


def _clusters(t: Tables) -> DataFrame:
    iv = intervals(t)
    return iv.select(F.col("l_orderkey").alias("cluster"), F.col("l_returnflag").alias("table"), F.col("name").alias("gene"), F.lit("chr1").alias("chrom"), F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), F.lit("+").alias("strand"))


_CL = f"WITH {INTERVALS}, cl AS (SELECT l_orderkey AS cluster, l_returnflag AS tab, name AS gene, st, en FROM iv), s AS (SELECT cluster, string_agg(DISTINCT tab, ' ' ORDER BY tab) AS s, count(*) AS n FROM cl GROUP BY 1) "
_ORDER = "(VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'A N'), (4, 'A R'), (5, 'N R'), (6, 'A N R')) p(nth, subset)"


@query(_CL + f", c AS (SELECT s AS subset, count(*) AS loci, CAST(sum(n) AS BIGINT) AS trans FROM s GROUP BY 1), t AS (SELECT sum(loci) AS l, sum(trans) AS x FROM c), o AS (SELECT nth, subset, coalesce(loci, 0) AS loci, coalesce(trans, 0) AS trans FROM {_ORDER} LEFT JOIN c USING (subset) UNION ALL SELECT 1073741824, 'TOTAL', CAST(sum(loci) AS BIGINT), CAST(sum(trans) AS BIGINT) FROM c) SELECT nth, subset, loci, trans, format('{{:.3f}}', loci::DOUBLE / l + 1e-12) AS fracLoci, format('{{:.3f}}', trans::DOUBLE / x + 1e-12) AS fracTrans FROM o, t")
def cluster_stats(t: Tables) -> DataFrame:
    return stats.cluster_stats(_clusters(t), total=True)


@query(_CL + "SELECT tab AS \"set\", count(DISTINCT cluster) AS loci, count(*) AS transcripts FROM cl GROUP BY 1")
def cluster_set_totals(t: Tables) -> DataFrame:
    return stats.cluster_set_totals(_clusters(t))


@query(_CL + "SELECT CASE WHEN cluster % 3 = 0 THEN 'big+' ELSE '' END || tab AS \"set\", count(DISTINCT cluster) AS loci, count(*) AS transcripts FROM cl GROUP BY 1")
def cluster_category_totals(t: Tables) -> DataFrame:
    return stats.cluster_set_totals(_clusters(t), _all_categories(t))


def _all_categories(t: Tables) -> DataFrame:
    return t.lineitem.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("cluster"), F.lit("big").alias("category")).distinct()


@query(_CL + "SELECT gene, cluster, s AS subset FROM cl JOIN s USING (cluster)")
def cluster_gene_subsets(t: Tables) -> DataFrame:
    return stats.cluster_gene_subsets(_clusters(t))


@query(_CL + "SELECT cluster, gene FROM cl JOIN s USING (cluster) WHERE (contains(s, 'A') OR contains(s, 'R')) AND NOT contains(s, 'N') AND tab <> 'N'")
def cluster_select_any(t: Tables) -> DataFrame:
    return stats.cluster_select(_clusters(t), any_of=[["A"], ["R"]], none_of=[["N"]], tables=["A", "R"]).select("cluster", "gene")


@query(_CL + "SELECT cluster, gene FROM cl JOIN s USING (cluster) WHERE s IN ('A R', 'N')")
def cluster_select_only(t: Tables) -> DataFrame:
    return stats.cluster_select(_clusters(t), only=[["R", "A"], ["N"]]).select("cluster", "gene")


@query(_CL + "SELECT cluster, gene FROM cl JOIN s USING (cluster) WHERE s NOT IN ('A R', 'N')")
def cluster_select_not(t: Tables) -> DataFrame:
    return stats.cluster_select(_clusters(t), not_only=[["R", "A"], ["N"]]).select("cluster", "gene")


@query(_CL + "SELECT 'chr1' AS chrom, min(st) AS chrom_start, max(en) AS chrom_end, CAST(cluster AS VARCHAR) AS name, 0 AS score, '+' AS strand FROM cl GROUP BY cluster")
def cluster_bed(t: Tables) -> DataFrame:
    return stats.cluster_bed(_clusters(t))


_CHECK = ("l_returnflag = 'N'", "l_linestatus = 'O'", "l_tax < 0.05", "cast(l_quantity AS bigint) % 4", "l_partkey % 5", "l_partkey % 3", "l_suppkey % 4", "l_suppkey % 3", "l_linenumber % 3", "l_linenumber % 2", "l_orderkey % 2")
_FRAME = "CASE l_partkey % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'noCDS' ELSE 'ok' END"
_COUNTERS = ("orfStop", "cdsGap", "cdsMult3Gap", "utrGap", "cdsUnknownSplice", "utrUnknownSplice", "cdsNonCanonSplice", "utrNonCanonSplice")


def _check_sql() -> str:
    src = "SELECT " + ", ".join(f"{e} AS {n}" for e, n in zip(_CHECK, ("stat", "\"start\"", "stop", *_COUNTERS))) + f", {_FRAME} AS frame FROM lineitem"
    gene = {"ok": "stat", "any": "NOT stat", "start": "NOT \"start\"", "stop": "NOT stop", "frameBad": "frame = 'bad'", "frameMismatch": "frame = 'mismatch'", "noCDS": "frame = 'noCDS'"}
    rows = ["SELECT 0 AS nth, 'total' AS category, count(*) AS genes, '1.0' AS rate, count(*) AS problems FROM c"]
    for k, name in enumerate(stats.CHECK_CATEGORIES):
        n = "cdsGap - cdsMult3Gap" if name == "cdsGap" else name if name in _COUNTERS else f"CAST({gene[name]} AS BIGINT)"
        rows.append(f"SELECT {k + 1}, '{name}', count(*) FILTER (({n}) > 0), format('{{:.3f}}', (count(*) FILTER (({n}) > 0))::DOUBLE / count(*) + 1e-12), CAST(coalesce(sum({n}) FILTER (({n}) > 0), 0) AS BIGINT) FROM c")
    return f"WITH c AS ({src}) " + " UNION ALL ".join(rows)


@query(_check_sql())
def check_stats(t: Tables) -> DataFrame:
    names = ("stat", "start", "stop", *_COUNTERS)
    checks = t.lineitem.select(*(F.expr(e if k < 3 else f"CAST({e} AS bigint)").alias(n) for k, (e, n) in enumerate(zip(_CHECK, names))), F.expr(_FRAME).alias("frame"))
    return stats.check_stats(checks)


# a genome made by a rule: base i of a sequence is ACGT[(i * i / 7 + i) % 4]
_BASE = "substr('ACGT', CAST((({0}) * ({0}) // 7 + ({0})) % 4 AS INTEGER) + 1, 1)"


@query(f"""WITH {EXONS}, i AS (SELECT *, lag(en) OVER (PARTITION BY l_orderkey ORDER BY st) AS p FROM ex), d AS (SELECT DISTINCT chrom, i.p AS a, i.st AS b, strand FROM i JOIN tx USING (l_orderkey) WHERE i.p IS NOT NULL AND st < 20000),
j AS (SELECT *, {_BASE.format('a')} || {_BASE.format('a + 1')} || '/' || {_BASE.format('b - 2')} || {_BASE.format('b - 1')} AS f FROM d), k AS (SELECT *, reverse(translate(f, 'ACGT', 'TGCA')) AS r FROM j), s AS (SELECT *, CASE strand WHEN '-' THEN r ELSE f END AS x, CASE strand WHEN '-' THEN f ELSE r END AS y FROM k),
c AS (SELECT CASE WHEN b - a < 30 THEN 'GAP' WHEN x = 'GT/AG' THEN 'STD' WHEN x = 'GC/AG' THEN 'RARE' WHEN x = 'AT/AC' THEN 'U12' WHEN x = 'CT/AC' THEN 'STD_RC' WHEN y = 'GT/AG' THEN 'STD' WHEN y = 'GC/AG' THEN 'RARE' WHEN y = 'AT/AC' THEN 'U12' WHEN y = 'CT/AC' THEN 'STD_RC' ELSE 'UNKNOWN' END AS category FROM s)
SELECT nth, category, (SELECT count(*) FROM c WHERE c.category = o.category) AS num_introns FROM (VALUES (0, 'STD'), (1, 'RARE'), (2, 'U12'), (3, 'STD_RC'), (4, 'GAP'), (5, 'UNKNOWN')) o(nth, category)""")
def splice_stats(t: Tables) -> DataFrame:
    """Splice junctions of the genes' introns against sequence chunks of 1000 bases."""
    at = "(nth * 1000 + i)"
    seq = F.expr(f"array_join(transform(sequence(0L, 999L), i -> substr('ACGT', CAST((({at} * {at}) DIV 7 + {at}) % 4 AS int) + 1, 1)), '')")
    chunks = t.spark.range(20).select(F.col("id").alias("nth")).withColumn("seq", seq).crossJoin(t.spark.range(1, 23).select(F.concat(F.lit("chr"), "id").alias("name")))
    return stats.splice_stats(stats.splice_introns(beds(t).withColumn("blocks", F.filter("blocks", lambda b: b["start"] < 20_000)), chunks, 1000))


# codecs and texts


@query("SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) || ',' AS text, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def comma_array_codec(t: Tables) -> DataFrame:
    lists = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("items"))
    text = lists.select("l_orderkey", K.join_list("items").alias("text"))
    back = K.split_list("text", "bigint")
    return text.select("l_orderkey", K.join_list(back).alias("text"), F.aggregate(back, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS flag, CASE WHEN l_returnflag = 'R' THEN 'ok' ELSE 'err' END AS text, CAST(CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS INTEGER) AS place FROM lineitem")
def boolean_enum_codec(t: Tables) -> DataFrame:
    text = t.lineitem.select("l_orderkey", "l_linenumber", K.format_boolean(F.col("l_returnflag") == "R", "stat").alias("text"), "l_linestatus")
    return text.select("l_orderkey", "l_linenumber", K.parse_boolean("text", "stat").alias("flag"), "text", K.enum_ordinal("l_linestatus", ["F", "O"]).alias("place"))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def attribute_codec(t: Tables) -> DataFrame:
    attributes = F.create_map(F.lit("Name"), F.array("p_name"), F.lit("a;b=c"), F.array("p_brand", F.lit("x,y &z")))
    text = t.part.select("p_partkey", K.format_attributes(attributes).alias("text"))
    parsed = text.withColumn("m", K.parse_attributes("text"))
    return parsed.where(F.element_at(F.element_at("m", F.lit("a;b=c")), 2) == "x,y &z").select("p_partkey", K.attribute("m", "Name").alias("p_name"), F.get(K.required_attribute("m", "a;b=c"), F.lit(0)).alias("p_brand"))


@query("SELECT doc_id, reverse(translate(text, 'ATCGURYKMBDHVatcgurykmbdhv', 'TAGCAYRMKVHDBtagcayrmkvhdb')) AS rc FROM documents")
def reverse_complement(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.reverse_complement("text").alias("rc"))


@query(r"SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages".replace('\\"', '"'))
def tag_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.strip_tags("html").alias("text"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS ident, p_partkey || 'x' AS base, contains(p_name, ' ') AS spaced, replace(p_name, ' ', '_') AS setting FROM part")
def text_functions(t: Tables) -> DataFrame:
    name = F.concat("p_partkey", F.lit("x-"), F.col("p_size"), F.lit(".1"))
    return t.part.select("p_partkey", S.to_identifier("p_name").alias("ident"), S.drop_unique_suffix(name).alias("base"), S.has_spaces("p_name").alias("spaced"), S.quote_setting("p_name").alias("setting"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 0.0::DOUBLE ELSE pow(10.0::DOUBLE, ceil(log10(o_totalprice))) END AS magnitude, CASE WHEN o_orderkey % 7 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 5)::DOUBLE / (o_orderkey % 7) END AS freq FROM orders")
def math_functions(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", M.order_of_magnitude("o_totalprice").alias("magnitude"), M.frequency(F.col("o_orderkey") % 5, F.col("o_orderkey") % 7).alias("freq"))


@query("WITH c AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 11 % 256 AS g, p_partkey * 13 % 256 AS b FROM part) SELECT p_partkey, r || ',' || g || ',' || b AS rgb, '#' || lower(lpad(hex(r), 2, '0')) || lower(lpad(hex(g), 2, '0')) || lower(lpad(hex(b), 2, '0')) AS html, CAST(r * 65536 + g * 256 + b AS BIGINT) AS packed, greatest(r, g, b) / 255.0::DOUBLE AS v, sqrt(pow(r / 255.0::DOUBLE - 1, 2) + pow(g / 255.0::DOUBLE, 2) + pow(b / 255.0::DOUBLE, 2)) AS red_distance, true AS same FROM c")
def color_functions(t: Tables) -> DataFrame:
    part = lambda n: F.col("p_partkey") * n % 256
    c = t.part.select("p_partkey", M.rgb8(part(7), part(11), part(13)).alias("c")).withColumn("hsv", M.to_hsv(F.col("c")))
    back = M.from_hsv(F.col("hsv.h"), F.col("hsv.s"), F.col("hsv.v"))
    same = (M.pack_rgb8(back) == M.pack_rgb8(F.col("c"))) & (M.pack_rgb8(M.parse_html_color(M.format_html_color(F.col("c")))) == M.pack_rgb8(F.col("c"))) & (M.pack_rgb8(M.parse_rgb8(M.format_rgb8(F.col("c")))) == M.pack_rgb8(F.col("c")))
    return c.select("p_partkey", M.format_rgb8(F.col("c")).alias("rgb"), M.format_html_color(F.col("c")).alias("html"), M.pack_rgb8(F.col("c")).cast("bigint").alias("packed"), F.col("hsv.v").alias("v"), M.color_distance(F.col("c"), M.rgb(1.0, 0.0, 0.0)).alias("red_distance"), same.alias("same"))


@query("WITH c AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 11 % 256 AS g, p_partkey * 13 % 256 AS b FROM part), d AS (SELECT p_partkey, n, k, pow(r - x, 2) + pow(g - y, 2) + pow(b - z, 2) AS d FROM c, (VALUES (0, 'red', 255, 0, 0), (1, 'green', 0, 128, 0), (2, 'blue', 0, 0, 255), (3, 'white', 255, 255, 255), (4, 'black', 0, 0, 0)) v(k, n, x, y, z)) SELECT p_partkey, arg_min(n, d * 10 + k) AS nearest FROM d GROUP BY 1")
def nearest_color(t: Tables) -> DataFrame:
    rows = [(0, "red", 255, 0, 0), (1, "green", 0, 128, 0), (2, "blue", 0, 0, 255), (3, "white", 255, 255, 255), (4, "black", 0, 0, 0)]
    table = t.spark.createDataFrame(rows, "nth int, name string, r int, g int, b int").select("nth", "name", M.rgb8(F.col("r"), F.col("g"), F.col("b")).alias("color"))
    part = lambda n: F.col("p_partkey") * n % 256
    return stats.nearest_color(t.part.select("p_partkey", M.rgb8(part(7), part(11), part(13)).alias("c")), "c", table).drop("c")


# graphs, assemblies, vocabularies


@query("WITH RECURSIVE w AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey <= 3 UNION ALL SELECT w.root, p.p_partkey, w.depth + 1 FROM w JOIN part p ON p.p_partkey > 3 AND p.p_partkey // 4 = w.node) SELECT CAST(root AS VARCHAR) AS root, CAST(node AS VARCHAR) AS node, depth FROM w")
def recursive_parent(t: Tables) -> DataFrame:
    edges = t.part.where("p_partkey > 3").select(F.col("p_partkey").alias("child_id"), F.floor(F.col("p_partkey") / 4).cast("bigint").alias("parent_id"))
    return AN.walk(edges, t.part.where("p_partkey <= 3").select(F.col("p_partkey").alias("node"))).select("root", "node", "depth")


@query("SELECT DISTINCT CAST(c_nationkey + 20 AS VARCHAR) AS parent_id FROM customer WHERE c_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def missing_parents(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.array().cast("array<string>").alias("parents"))
    kids = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.array((F.col("c_nationkey") + 20).cast("string")).alias("parents"))
    return AN.missing_parents(nodes.unionByName(kids))


def _report(t: Tables) -> DataFrame:
    role = F.element_at(F.array(*(F.lit(r) for r in ("assembled-molecule", "unlocalized-scaffold", "unplaced-scaffold", "alt-scaffold"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select(F.concat(F.lit("s"), "p_partkey").alias("sequence_name"), role.alias("sequence_role"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("GL"), "p_partkey")).alias("genbank_accn"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("NC"), "p_partkey")).alias("refseq_accn"), F.concat(F.lit("chr"), "p_partkey").alias("ucsc_name"), (F.col("p_size") * 1000).cast("bigint").alias("sequence_length"))


_R = "WITH r AS (SELECT 's' || p_partkey AS sequence_name, ['assembled-molecule', 'unlocalized-scaffold', 'unplaced-scaffold', 'alt-scaffold'][p_partkey % 4 + 1] AS role, CASE WHEN p_partkey % 5 <> 0 THEN 'GL' || p_partkey END AS gb, CASE WHEN p_partkey % 3 <> 0 THEN 'NC' || p_partkey END AS rs, 'chr' || p_partkey AS ucsc, CAST(p_size * 1000 AS BIGINT) AS n FROM part) "


@query(_R + "SELECT 0 AS \"offset\", gb AS from_id, n AS from_size, rs AS to_id, n AS to_size FROM r WHERE gb IS NOT NULL AND rs IS NOT NULL AND role <> 'alt-scaffold'")
def assembly_lift(t: Tables) -> DataFrame:
    return AN.assembly_convert(_report(t), "lift", "genbank_accn", "refseq_accn", "main_assembly")


@query(_R + ", g AS (SELECT *, CASE role WHEN 'assembled-molecule' THEN ucsc ELSE gb END AS gc FROM r) SELECT gc AS from_id, rs AS to_id FROM g WHERE gc IS NOT NULL")
def assembly_idmap(t: Tables) -> DataFrame:
    return AN.assembly_convert(_report(t), "idmap", "gencode", "refseq_accn")


@query(_R + "SELECT ucsc AS name, n AS size FROM r WHERE role = 'assembled-molecule'")
def assembly_sizes(t: Tables) -> DataFrame:
    return AN.assembly_convert(_report(t), "sizes", "ucsc_name", include="main_chroms")


@query(_R + "SELECT count(*) AS n_skipped FROM r WHERE gb IS NULL OR rs IS NULL")
def assembly_skipped(t: Tables) -> DataFrame:
    return AN.skipped(_report(t), "psl", "genbank_accn", "refseq_accn")


@query(_R + "SELECT gb AS q_name, rs AS t_name, n AS q_size, n AS \"match\" FROM r WHERE gb IS NOT NULL AND rs IS NOT NULL")
def assembly_psl(t: Tables) -> DataFrame:
    return AN.assembly_convert(_report(t), "psl", "genbank_accn", "refseq_accn").select("q_name", "t_name", "q_size", "match")


@query(f"WITH {EXONS}, b AS (SELECT 'chr' || l_orderkey AS object, 'c' || l_orderkey || '.' || nth AS comp, st, en, CASE WHEN nth % 2 = 0 THEN '-' ELSE '+' END AS strand FROM ex) SELECT comp AS q_name, en - st + 10 AS q_size, object AS t_name, max(en) OVER (PARTITION BY object) AS t_size, st AS t_start, en AS t_end, strand, CASE strand WHEN '-' THEN 0 ELSE 10 END AS q_block FROM b")
def agp_to_psl(t: Tables) -> DataFrame:
    """Every exon is a component: its bases 10 to the end, by turns on either strand."""
    rows = beds(t).select(F.concat(F.lit("chr"), "l_orderkey").alias("object"), F.posexplode("blocks").alias("i", "b"), "l_orderkey")
    n = F.col("b.end") - F.col("b.start")
    agp = rows.select("object", F.col("b.start").alias("object_start"), F.col("b.end").alias("object_end"), F.lit("block").alias("kind"), F.concat(F.lit("c"), "l_orderkey", F.lit("."), F.col("i") + 1).alias("component"), F.lit(10).cast("bigint").alias("component_start"), (n + 10).alias("component_end"), F.when(F.col("i") % 2 == 1, "-").otherwise("+").alias("strand"))
    out = AN.agp_to_psl(agp)
    return out.select("q_name", "q_size", "t_name", "t_size", "t_start", "t_end", "strand", F.get("blocks", F.lit(0))["q_start"].cast("int").alias("q_block"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' AND l_returnflag = 'A' THEN 'pseudo' WHEN l_linestatus = 'O' THEN 'coding' ELSE 'other' END AS function FROM lineitem")
def transcript_function(t: Tables) -> DataFrame:
    gene = F.when(F.col("l_returnflag") == "A", "unitary_pseudogene").otherwise("lncRNA")
    transcript = F.when(F.col("l_linestatus") == "O", "protein_coding").otherwise("retained_intron")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", V.transcript_function(gene, transcript).alias("function"))


@query("WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderstatus, tags FROM orders LEFT JOIN s ON o_orderkey = l_orderkey")
def side_tables(t: Tables) -> DataFrame:
    side = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("tag"))
    out = AN.with_attributes(t.orders.select("o_orderkey"), t.orders.select("o_orderkey", "o_orderstatus"), side, key="o_orderkey")
    return out.select("o_orderkey", "o_orderstatus", F.array_join("tag", ",").alias("tags"))


@query("SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS size FROM part WHERE p_partkey <= 20")
def required_rows(t: Tables) -> DataFrame:
    table = t.part.select("p_partkey", (F.col("p_size") * 10).cast("bigint").alias("size"))
    return AN.required_rows(table, t.part.where("p_partkey <= 20"), "p_partkey")


@query("SELECT 'out/' || p_partkey AS path FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 = 0")
def missing_products(t: Tables) -> DataFrame:
    expected = t.part.where("p_partkey % 5 = 0").select(F.concat(F.lit("out/"), "p_partkey").alias("path"))
    return AN.missing_products(expected, t.part.where("p_partkey % 7 = 0").select(F.concat(F.lit("out/"), "p_partkey").alias("path")))


@query("SELECT k AS path, string_agg(DISTINCT CASE WHEN json_type(props, '$.' || k) IN ('UBIGINT', 'BIGINT') THEN 'bigint' WHEN json_type(props, '$.' || k) = 'VARCHAR' THEN 'string' WHEN json_type(props, '$.' || k) = 'DOUBLE' THEN 'decimal' ELSE lower(json_type(props, '$.' || k)) END, ',') AS types FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def json_key_paths(t: Tables) -> DataFrame:
    return stats.json_key_paths(t.events, "props")
