"""Feature graphs, assemblies, taxonomies and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.util import ColumnOrName, col
from ..sources.scratch import scratch_path
from .alignments import psl_block

# feature graphs (GFF3): features with id and parents; several rows of one id are parts of one feature


def parent_links(features: DataFrame) -> DataFrame:
    """(child_id, parent_id) of all features that name a parent, one row per pair."""
    return features.select(F.col("id").alias("child_id"), F.explode("parents").alias("parent_id")).distinct()


def missing_parents(features: DataFrame) -> DataFrame:
    """Parent ids that no feature has: must be empty for a sound file."""
    return parent_links(features).join(features.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("parent_id").distinct()


_LINKS, _WALKED = "child_id string, parent_id string", "root string, node string, depth int, path string"


def walk(edges: DataFrame, roots: DataFrame, most_depth: int = 64) -> DataFrame:
    """Every (root, node, depth, path) below the roots (column node) along edges (child_id, parent_id), path by path.

    A level is one join with the edges, written to the shared folder; nodes with several parents are reached once per path.
    Cycles are an error beyond most_depth levels.
    """
    spark, out, links = edges.sparkSession, scratch_path(edges.sparkSession, "levels"), scratch_path(edges.sparkSession, "edges")
    edges.select(F.col("child_id").cast("string").alias("child_id"), F.col("parent_id").cast("string").alias("parent_id")).write.parquet(links)
    node = F.col("node").cast("string")
    level, depth = roots.select(node.alias("root"), node.alias("node"), F.lit(0).alias("depth"), node.alias("path")), 0
    while True:
        level.write.parquet(f"{out}/level={depth}")
        last = spark.read.schema(_WALKED).parquet(f"{out}/level={depth}")
        if last.isEmpty():
            return spark.read.schema(_WALKED).parquet(*(f"{out}/level={k}" for k in range(depth + 1)))
        if depth == most_depth:
            raise ValueError(f"more than {most_depth} levels: a cycle")
        depth += 1
        level = last.alias("w").join(spark.read.schema(_LINKS).parquet(links), F.col("parent_id") == F.col("w.node"))
        level = level.select("w.root", F.col("child_id").alias("node"), F.lit(depth).alias("depth"), F.concat("w.path", F.lit("/"), "child_id").alias("path"))


def feature_tree(features: DataFrame) -> DataFrame:
    """Features in the order of a depth-first writing: root, depth, path, and the feature; once per parent.

    Roots are features without a parent. Sort by path_key: sequence, start, longest first, type at every level.
    """
    key = lambda: F.concat_ws("\x01", "seqname", F.lpad(F.col("start").cast("string"), 12, "0"), F.lpad((F.lit(10**11) - F.col("end")).cast("string"), 12, "0"), "type", "id")
    keyed = features.withColumn("key", key())
    tree = walk(parent_links(features), features.where(F.size("parents") == 0).select(F.col("id").alias("node")).distinct())
    steps = tree.select("root", "depth", "path", "node", F.posexplode(F.split("path", "/")).alias("nth", "step"))
    first = keyed.groupBy(F.col("id").alias("step")).agg(F.min("key").alias("key"))
    ordered = steps.join(first, "step").groupBy("root", "depth", "path", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "key"))), lambda s: s["key"]), "\x02").alias("path_key"))
    return ordered.join(keyed.drop("key").withColumnRenamed("id", "node"), "node")


# assemblies

#: Sequence roles of the two output filters.
ROLES = {"main_chroms": ("assembled-molecule",), "main_assembly": ("assembled-molecule", "unlocalized-scaffold", "unplaced-scaffold")}


def sequence_id(kind: str) -> Column:
    """An assembly row's name of a kind: a column, or `gencode` (UCSC name of chromosomes, GenBank accession of others),
    or `sequence_name_genbank` (sequence name of chromosomes, GenBank accession of others)."""
    chromosome = F.col("sequence_role") == "assembled-molecule"
    if kind == "gencode":
        return F.when(chromosome, F.col("ucsc_name")).otherwise(F.col("genbank_accn"))
    if kind == "sequence_name_genbank":
        return F.when(chromosome, F.col("sequence_name")).otherwise(F.col("genbank_accn"))
    return F.col(kind)


def with_role(report: DataFrame, include: str | None = None) -> DataFrame:
    return report if include is None else report.where(F.col("sequence_role").isin(*ROLES[include]))


def assembly_convert(report: DataFrame, output: str, from_id: str, to_id: str | None = None, include: str | None = None) -> DataFrame:
    """lift (offset, from, size, to, size), psl, sizes (name, size) or idmap (from, to) of an assembly's sequences.

    Rows without the names that the output needs are left out: both for lift and psl, the first for the others.
    """
    rows = with_role(report, include).select(sequence_id(from_id).alias("from_id"), (sequence_id(to_id) if to_id else F.lit(None).cast("string")).alias("to_id"), F.col("sequence_length").alias("size"))
    both, first = rows.where("from_id IS NOT NULL AND to_id IS NOT NULL"), rows.where("from_id IS NOT NULL")
    if output == "lift":
        return both.select(F.lit(0).alias("offset"), "from_id", F.col("size").alias("from_size"), "to_id", F.col("size").alias("to_size"))
    if output == "sizes":
        return first.select(F.col("from_id").alias("name"), "size")
    if output == "idmap":
        return first.select("from_id", "to_id")
    if output == "psl":
        return whole_alignments(both, "from_id", "size", "to_id", "size")
    raise ValueError(f"output: {output}")


def skipped(report: DataFrame, output: str, from_id: str, to_id: str | None = None, include: str | None = None) -> DataFrame:
    """How many rows assembly_convert leaves out for want of a name."""
    need = sequence_id(from_id).isNotNull() & (sequence_id(to_id).isNotNull() if output in ("lift", "psl") else F.lit(True))
    return with_role(report, include).agg(F.count_if(~need).alias("n_skipped"))


def whole_alignments(df: DataFrame, q_name: str, q_size: str, t_name: str, t_size: str) -> DataFrame:
    """Alignments of whole sequences that are equal but for their names."""
    zero, size = F.lit(0).cast("bigint"), F.col(q_size).cast("bigint")
    return df.select(
        size.alias("match"), *(zero.alias(n) for n in ("mis_match", "rep_match", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert")), F.lit("+").alias("strand"),
        F.col(q_name).alias("q_name"), size.alias("q_size"), zero.alias("q_start"), size.alias("q_end"), F.col(t_name).alias("t_name"), F.col(t_size).cast("bigint").alias("t_size"), zero.alias("t_start"), F.col(t_size).cast("bigint").alias("t_end"),
        F.array(psl_block(zero, zero, size)).alias("blocks"),
    )


def report_with_metadata(report: DataFrame, metadata: DataFrame, keys: Sequence[str], first_word: Sequence[str] = (), rest: bool = False) -> DataFrame:
    """Sequence rows with metadata values as columns: of keys whole, of others their first word, and with rest all that are left, in the report's order.

    A key that is missing is an error. The metadata are some lines of one report, and are read on the driver.
    """
    values = {r["key"]: r["value"] for r in metadata.orderBy("nth").collect()}
    missing = [k for k in (*keys, *first_word) if k not in values]
    if missing:
        raise ValueError(f"metadata not found: {missing}")
    more = [k for k in values if k not in (*keys, *first_word)] if rest else []
    named = {**{k: values[k] for k in keys}, **{k: (values[k].split() or [""])[0] for k in first_word}, **{k: values[k] for k in more}}
    return report.select("*", *(F.lit(v).alias(k) for k, v in named.items()))


def agp_to_psl(agp: DataFrame, component_sizes: DataFrame | None = None, id_map: DataFrame | None = None, skip_unmapped: bool = False) -> DataFrame:
    """Alignments of components (query) to objects (target) of AGP blocks.

    Object sizes are their last block's end; component sizes come from a table (name, size), else from the largest end used.
    id_map (local_id, accession) renames components. A component without a name or size is an error, or left out with
    skip_unmapped.
    """
    blocks = agp.where("kind = 'block'")
    if id_map is not None:
        named = blocks.join(id_map.select(F.col("local_id").alias("component"), F.col("accession").alias("q_name")), "component", "left")
    else:
        named = blocks.withColumn("q_name", F.col("component"))
    objects = blocks.groupBy("object").agg(F.max("object_end").alias("t_size"))
    sizes = component_sizes.select(F.col("name").alias("q_name"), F.col("size").cast("bigint").alias("q_size")) if component_sizes is not None else named.groupBy("q_name").agg(F.max("component_end").alias("q_size"))
    joined = named.join(objects, "object").join(sizes, "q_name", "left")
    known = F.col("q_name").isNotNull() & F.col("q_size").isNotNull()
    joined = joined.where(known) if skip_unmapped else joined.withColumn("q_name", F.when(known, F.col("q_name")).otherwise(F.raise_error(F.concat(F.lit("unmapped component: "), "component")).cast("string")))
    zero, n = F.lit(0).cast("bigint"), F.col("object_end") - F.col("object_start")
    q_block = F.when(F.col("strand") == "-", F.col("q_size") - F.col("component_end")).otherwise(F.col("component_start"))
    return joined.select(
        n.alias("match"), *(zero.alias(c) for c in ("mis_match", "rep_match", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert")), "strand", "q_name", "q_size", F.col("component_start").alias("q_start"), F.col("component_end").alias("q_end"),
        F.col("object").alias("t_name"), "t_size", F.col("object_start").alias("t_start"), F.col("object_end").alias("t_end"), F.array(psl_block(q_block, "object_start", n)).alias("blocks"),
    )


def with_attributes(transcripts: DataFrame, attributes: DataFrame, *side: DataFrame, key: str = "transcriptId") -> DataFrame:
    """Transcripts with their attributes, and with arrays of the values of side tables (key, value...)."""
    out = transcripts.join(attributes, key, "left")
    for s in side:
        rest = [c for c in s.columns if c != key]
        out = out.join(s.groupBy(key).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in rest)), key, "left")
    return out


def required_rows(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of df for the wanted keys; a key without a row is an error when the result is read."""
    out = wanted.select(key).distinct().join(df.withColumn("__found", F.lit(True)), key, "left")
    return out.withColumn(key, F.when(F.col("__found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} not found: "), F.col(key).cast("string"))).cast(dict(df.dtypes)[key]))).drop("__found")


def missing_products(expected: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Expected outputs that don't exist yet."""
    return expected.where(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti")
