"""Grouped summaries: histograms, gene checks, clusters, splice junctions, nearest colours."""

from __future__ import annotations

import uuid

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import blocks as B
from ..functions.mathx import color_distance, rate
from ..functions.strings import reverse_complement
from ..functions.util import ColumnOrName, col
from . import sets


def histogram(df: DataFrame, value: str, n_bins: int = 10, count: str | None = None, lo: float | None = None, hi: float | None = None, clamp: bool = False) -> DataFrame:
    """An equal-width histogram: bin, start, center, n (items, or the sum of count), frequency.

    Bins are centred on the extremes: with e = (max - min) / (n_bins - 1), the width is (max - min + e) / n_bins and the first
    bin starts half a width below min. lo and hi replace the extremes; values outside are dropped, or put into the outer
    bins with clamp. One bin holds everything. Every bin is listed; nulls and NaN are left out.
    """
    weight = F.lit(1) if count is None else F.col(count)
    rows = df.select(F.col(value).cast("double").alias("v"), weight.cast("bigint").alias("w")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.select(*(F.col(n) if x is None else F.lit(float(x)).alias(n) for n, x in (("lo", lo), ("hi", hi))))
    spread = F.col("hi") - F.col("lo")
    width = F.when(spread == 0, F.lit(1.0)).otherwise(spread if n_bins == 1 else (spread + spread / (n_bins - 1)) / n_bins)
    scale = ends.select("lo", "hi", width.alias("width")).withColumn("floor", F.col("lo") if n_bins == 1 else F.col("lo") - F.col("width") / 2)
    placed = rows.crossJoin(scale)  # one row
    placed = placed.withColumns({"v": F.greatest("lo", F.least("hi", "v"))}) if clamp else placed.where("v BETWEEN lo AND hi")
    at = F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("floor")) / F.col("width"))))
    counted = placed.groupBy(at.cast("int").alias("bin")).agg(F.sum("w").alias("n"), F.count("*").alias("items"))
    all_bins = scale.where("lo IS NOT NULL").select("floor", "width", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    total = placed.agg(F.sum("w").alias("total"))
    out = all_bins.join(counted, "bin", "left").crossJoin(total)
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return out.select("bin", (F.col("floor") + F.col("bin") * F.col("width")).alias("start"), (F.col("floor") + (F.col("bin") + 0.5) * F.col("width")).alias("center"), n.alias("n"), (n / F.col("total")).alias("frequency"))


def number_summary(df: DataFrame, value: str, count: str | None = None) -> DataFrame:
    """min, max and (weighted) sum."""
    v = F.col(value)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v if count is None else v * F.col(count)).alias("sum"))


#: Problem categories of a gene check, in their order.
CHECK_CATEGORIES = ("ok", "any", "start", "stop", "orfStop", "cdsGap", "cdsMult3Gap", "utrGap", "cdsUnknownSplice", "utrUnknownSplice", "cdsNonCanonSplice", "utrNonCanonSplice", "frameBad", "frameMismatch", "noCDS")


def check_problems() -> dict[str, Column]:
    """How many problems of each category a gene-check row has (columns as sources.gene_check reads them)."""
    one = lambda c: c.cast("bigint")
    counted = {c: F.col(c) for c in CHECK_CATEGORIES[4:12]}
    counted["cdsGap"] = F.col("cdsGap") - F.col("cdsMult3Gap")
    return {
        "ok": one(F.col("stat")), "any": one(~F.col("stat")), "start": one(~F.col("start")), "stop": one(~F.col("stop")),
        **{c: F.greatest(F.lit(0), n).cast("bigint") for c, n in counted.items()},
        "frameBad": one(F.col("frame") == "bad"), "frameMismatch": one(F.col("frame") == "mismatch"), "noCDS": one(F.col("frame") == "noCDS"),
    }


def category_stats(df: DataFrame, problems: dict[str, Column], total_name: str = "total") -> DataFrame:
    """nth, category, genes with a problem, their rate, and problems: one pass of conditional sums, then one row per category."""
    sums = [F.count("*").alias("__total")]
    for k, (_, n) in enumerate(problems.items()):
        sums += [F.count_if(n > 0).alias(f"g{k}"), F.coalesce(F.sum(F.greatest(F.lit(0).cast("bigint"), n)), F.lit(0).cast("bigint")).alias(f"p{k}")]
    rows = [F.struct(F.lit(0).alias("nth"), F.lit(total_name).alias("category"), F.col("__total").alias("genes"), F.lit("1.0").alias("rate"), F.col("__total").alias("problems"))]
    for k, name in enumerate(problems):
        rows.append(F.struct(F.lit(k + 1).alias("nth"), F.lit(name).alias("category"), F.col(f"g{k}").alias("genes"), rate(f"g{k}", "__total").alias("rate"), F.col(f"p{k}").alias("problems")))
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def check_stats(checks: DataFrame) -> DataFrame:
    """Problem statistics of gene checks."""
    return category_stats(checks, check_problems())


def clusters(df: DataFrame, cluster: str = "cluster", table: str = "table", chrom: str = "chrom", start: str = "tx_start", end: str = "tx_end", strand: str = "strand") -> DataFrame:
    """Each cluster's bounds, sorted tables and number of genes."""
    return df.groupBy(cluster).agg(F.min(chrom).alias(chrom), F.min(start).alias(start), F.max(end).alias(end), F.min(strand).alias(strand), F.array_sort(F.collect_set(table)).alias("tables"), F.count("*").alias("n_genes"))


def cluster_select(df: DataFrame, any_of: Sequence[Sequence[str]] = (), none_of: Sequence[Sequence[str]] = (), only: Sequence[Sequence[str]] = (), not_only: Sequence[Sequence[str]] = (), genes: Sequence[str] = (), tables: Sequence[str] = (), cluster: str = "cluster", table: str = "table", gene: str = "gene") -> DataFrame:
    """Rows of the clusters that meet all criteria given, only of `tables` if given.

    any_of / none_of: the cluster's tables meet one / none of these sets. only / not_only: they equal one / none of them.
    genes: one of these is in the cluster.
    """
    made = [F.array_sort(F.collect_set(table)).alias("__tables")] + [F.max(F.col(gene).isin(list(genes))).alias("__has")] * bool(genes)
    ok = F.lit(True)
    literal = lambda names: F.array(*(F.lit(n) for n in sorted(set(names))))
    either = lambda conditions: reduce(or_, conditions, F.lit(False))
    if any_of:
        ok = ok & either([F.arrays_overlap("__tables", literal(s)) for s in any_of])
    if none_of:
        ok = ok & ~either([F.arrays_overlap("__tables", literal(s)) for s in none_of])
    if only:
        ok = ok & either([F.col("__tables") == literal(s) for s in only])
    if not_only:
        ok = ok & ~either([F.col("__tables") == literal(s) for s in not_only])
    if genes:
        ok = ok & F.col("__has")
    chosen = df.groupBy(cluster).agg(*made).where(ok).select(cluster)
    out = df.join(chosen, cluster, "left_semi")
    return out.where(F.col(table).isin(list(tables))) if tables else out


def cluster_bed(df: DataFrame, cluster: str = "cluster", **names: str) -> DataFrame:
    """One BED6 row per cluster, named by its number."""
    c = clusters(df, cluster, **names)
    chrom, start, end, strand = (names.get(k, d) for k, d in (("chrom", "chrom"), ("start", "tx_start"), ("end", "tx_end"), ("strand", "strand")))
    return c.select(F.col(chrom).alias("chrom"), F.col(start).alias("chrom_start"), F.col(end).alias("chrom_end"), F.col(cluster).cast("string").alias("name"), F.lit(0).alias("score"), F.col(strand).alias("strand"))


def with_category(df: DataFrame, categories: DataFrame | None, cluster: str = "cluster", table: str = "table") -> DataFrame:
    """df with `set_name`: the table, with the cluster's category and + in front if it has one (categories: cluster, category)."""
    if categories is None:
        return df.withColumn("set_name", F.col(table))
    return df.join(categories.select(cluster, "category"), cluster, "left").withColumn("set_name", F.concat(F.coalesce(F.concat("category", F.lit("+")), F.lit("")), F.col(table))).drop("category")


def cluster_stats(df: DataFrame, categories: DataFrame | None = None, omit_zero: bool = False, total: bool = False, cluster: str = "cluster", table: str = "table") -> DataFrame:
    """Loci and transcripts per exact subset of tables, with fractions: nth, subset, loci, trans, fracLoci, fracTrans."""
    rows = with_category(df, categories, cluster, table)
    per_cluster = rows.groupBy(cluster).agg(F.array_sort(F.collect_set("set_name")).alias("subset"), F.count("*").alias("n"))
    counted = per_cluster.groupBy("subset").agg(F.count("*").alias("loci"), F.sum("n").alias("trans"))
    zero = F.lit(0).cast("bigint")
    out = sets.subsets(rows, "set_name").join(counted, "subset", "inner" if omit_zero else "left").select("nth", sets.format_subset("subset").alias("subset"), F.coalesce("loci", zero).alias("loci"), F.coalesce("trans", zero).alias("trans"))
    if total:
        out = out.unionByName(out.agg(F.sum("loci").alias("loci"), F.sum("trans").alias("trans")).select(F.lit(1 << 30).alias("nth"), F.lit("TOTAL").alias("subset"), "loci", "trans"))
    sums = counted.agg(F.sum("loci").alias("__loci"), F.sum("trans").alias("__trans"))
    return out.crossJoin(sums).select("nth", "subset", "loci", "trans", rate("loci", "__loci").alias("fracLoci"), rate("trans", "__trans").alias("fracTrans"))


def cluster_set_totals(df: DataFrame, categories: DataFrame | None = None, cluster: str = "cluster", table: str = "table") -> DataFrame:
    """Per set: in how many loci it is, and its transcripts."""
    rows = with_category(df, categories, cluster, table)
    per = rows.groupBy("set_name", cluster).agg(F.count("*").alias("n"))
    return per.groupBy(F.col("set_name").alias("set")).agg(F.count("*").alias("loci"), F.sum("n").alias("transcripts"))


def cluster_gene_subsets(df: DataFrame, categories: DataFrame | None = None, cluster: str = "cluster", table: str = "table", gene: str = "gene") -> DataFrame:
    rows = with_category(df, categories, cluster, table)
    subset = rows.groupBy(cluster).agg(sets.format_subset(F.collect_set("set_name")).alias("subset"))
    return rows.join(subset, cluster).select(gene, cluster, "subset")


#: Splice categories in order, and the junctions they stand for.
SPLICE_CATEGORIES = ("STD", "RARE", "U12", "STD_RC", "GAP", "UNKNOWN")
SPLICE_JUNCTIONS = {"GT/AG": "STD", "GC/AG": "RARE", "AT/AC": "U12", "CT/AC": "STD_RC"}


def junction(first: ColumnOrName, last: ColumnOrName, strand: ColumnOrName) -> Column:
    """`GT/AG` and the like from an intron's first and last two bases on the forward strand."""
    text = F.concat(F.upper(col(first)), F.lit("/"), F.upper(col(last)))
    return F.when(col(strand) == "-", reverse_complement(text)).otherwise(text)


def classify_junction(junction_: ColumnOrName, size: ColumnOrName, least: int = 30) -> Column:
    """GAP for introns below `least`, the junction's category, or that of its reverse complement, else UNKNOWN."""
    table = F.create_map(*(F.lit(x) for pair in SPLICE_JUNCTIONS.items() for x in pair))
    j = col(junction_)
    return F.when(col(size) < least, "GAP").otherwise(F.coalesce(F.try_element_at(table, j), F.try_element_at(table, reverse_complement(j)), F.lit("UNKNOWN")))


def splice_introns(beds: DataFrame, chunks: DataFrame, chunk_size: int) -> DataFrame:
    """Distinct introns (chrom, start, end, strand) of BED rows with their junction and category.

    chunks (name, nth, seq) has sequences cut at chunk_size; the two bases at either end are looked up in their chunk, or each
    in its own where a cut lies between them.
    """
    found = beds.select("chrom", "strand", F.explode(B.gaps("blocks")).alias("g")).select("chrom", F.col("g.start").alias("start"), F.col("g.end").alias("end"), "strand").distinct()
    one = lambda k, p, n: F.struct(F.lit(k).alias("k"), p.alias("p"), F.lit(n).alias("n"))
    two = lambda k, p: F.when(p % chunk_size == chunk_size - 1, F.array(one(k, p, 1), one(k + 1, p + 1, 1))).otherwise(F.array(one(k, p, 2)))
    wanted = found.withColumn("at", F.explode(F.concat(two(0, F.col("start")), two(2, F.col("end") - 2))))
    base = F.substring(F.col("seq"), (F.col("at.p") % chunk_size + 1).cast("int"), F.col("at.n"))
    asked = wanted.withColumn("nth", F.floor(F.col("at.p") / chunk_size).cast("bigint"))
    hit = asked.join(chunks.withColumnRenamed("name", "chrom"), ["chrom", "nth"])
    seq = hit.groupBy("chrom", "start", "end", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("at.k").alias("k"), base.alias("b")))), lambda x: x["b"]), "").alias("s"))
    j = junction(F.substring("s", 1, 2), F.substring("s", 3, 2), "strand")
    return seq.select("chrom", "start", "end", "strand", j.alias("junction")).withColumn("category", classify_junction("junction", F.col("end") - F.col("start")))


def splice_stats(introns: DataFrame) -> DataFrame:
    """Introns per category, in order, 0 where there are none."""
    spark = introns.sparkSession
    order = spark.createDataFrame([(k, c) for k, c in enumerate(SPLICE_CATEGORIES)], "nth int, category string")
    return order.join(introns.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("nth", "category", F.coalesce("n", F.lit(0).cast("bigint")).alias("num_introns"))


def nearest_color(df: DataFrame, color: str, table: DataFrame, name: str = "nearest") -> DataFrame:
    """df with the name of the nearest colour of a table (nth, name, color) of 1,000 at most; the first of equally near ones."""
    rows = [r.asDict(recursive=True) for r in table.orderBy("nth").limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("more than 1,000 colours")
    near = [F.struct(color_distance(F.col(color), F.struct(*(F.lit(r["color"][c]).cast("double").alias(c) for c in "rgba"))).alias("d"), F.lit(k).alias("k"), F.lit(r["name"]).alias("n")) for k, r in enumerate(rows)]
    return df.withColumn(name, F.least(*near)["n"] if len(near) > 1 else near[0]["n"])


def json_key_paths(df: DataFrame, column: str, most_depth: int = 16) -> DataFrame:
    """Distinct key paths of JSON texts with their leaf types, `[]` for arrays, types of a path sorted and comma-joined.

    Levels are opened one at a time with variant functions, distinct paths only being kept; most_depth bounds the loop, and a
    document that is deeper is an error rather than cut off. Texts that aren't JSON, and nulls, have no paths.
    """
    view = f"__json_level_{uuid.uuid4().hex}"
    level = df.select(F.try_parse_json(F.col(column)).alias("v")).where("v IS NOT NULL").select(F.lit("").alias("path"), "v")
    found = None
    for _ in range(most_depth + 1):
        kind = F.schema_of_variant("v")
        typed = level.withColumn("kind", F.regexp_extract(kind, "^([A-Z]+)", 1))
        leaves = typed.where("kind NOT IN ('OBJECT', 'ARRAY')").select("path", F.lower("kind").alias("kind")).distinct()
        found = leaves if found is None else found.unionAll(leaves)
        typed.where("kind IN ('OBJECT', 'ARRAY')").createOrReplaceTempView(view)
        level = df.sparkSession.sql(f"SELECT CASE WHEN l.kind = 'ARRAY' THEN concat(l.path, '[]') WHEN l.path = '' THEN e.key ELSE concat(l.path, '.', e.key) END AS path, e.value AS v FROM {view} l, LATERAL variant_explode(l.v) AS e")
        if level.isEmpty():
            break
    else:
        raise ValueError(f"JSON is deeper than {most_depth} levels")
    return found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"))
