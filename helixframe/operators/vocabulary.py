"""Vocabularies of gene annotation, biotypes and tags with their categories, and named colours."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.util import ColumnOrName, col

#: Biotypes by the function that tracks are coloured by.
FUNCTIONS: dict[str, tuple[str, ...]] = {
    "coding": ("IG_C_gene", "IG_D_gene", "IG_J_gene", "IG_LV_gene", "IG_V_gene", "TR_C_gene", "TR_D_gene", "TR_J_gene", "TR_V_gene", "nonsense_mediated_decay", "non_stop_decay", "polymorphic_pseudogene", "protein_coding", "protein_coding_CDS_not_defined", "protein_coding_LoF"),
    "nonCoding": (
        "3prime_overlapping_ncRNA", "Mt_rRNA", "Mt_tRNA", "antisense", "antisense_RNA", "bidirectional_promoter_lncRNA", "lincRNA", "lncRNA", "macro_lncRNA", "miRNA", "misc_RNA", "non_coding", "processed_transcript",
        "rRNA", "ribozyme", "sRNA", "scRNA", "scaRNA", "sense_intronic", "sense_overlapping", "snRNA", "snoRNA", "vaultRNA", "vault_RNA",
    ),
    "pseudo": (
        "IG_C_pseudogene", "IG_D_pseudogene", "IG_J_pseudogene", "IG_V_pseudogene", "IG_pseudogene", "Mt_tRNA_pseudogene", "TR_J_pseudogene", "TR_V_pseudogene", "processed_pseudogene", "pseudogene", "rRNA_pseudogene",
        "transcribed_processed_pseudogene", "transcribed_unitary_pseudogene", "transcribed_unprocessed_pseudogene", "translated_processed_pseudogene", "translated_unprocessed_pseudogene", "unitary_pseudogene", "unprocessed_pseudogene",
    ),
    "other": ("TEC", "ambiguous_orf", "artifact", "artifactual_duplication", "disrupted_domain", "retained_intron"),
}
#: Biotypes by the gene category of release statistics.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "protein_coding": ("protein_coding",),
    "lncRNA": ("3prime_overlapping_ncRNA", "TEC", "antisense", "antisense_RNA", "bidirectional_promoter_lncRNA", "lincRNA", "lncRNA", "macro_lncRNA", "non_coding", "processed_transcript", "sense_intronic", "sense_overlapping"),
    "smallRNA": ("Mt_rRNA", "Mt_tRNA", "miRNA", "misc_RNA", "rRNA", "ribozyme", "sRNA", "scaRNA", "snRNA", "snoRNA", "vaultRNA"),
    "pseudoGene": FUNCTIONS["pseudo"],
    "immunoSegment": ("IG_C_gene", "IG_D_gene", "IG_J_gene", "IG_LV_gene", "IG_V_gene", "TR_C_gene", "TR_D_gene", "TR_J_gene", "TR_V_gene"),
}
#: Further sets of biotypes.
SETS: dict[str, tuple[str, ...]] = {
    "transcript_only": ("nonsense_mediated_decay", "non_stop_decay", "retained_intron"),
    "long_non_coding": ("lincRNA", "lncRNA"),
    "small_non_coding": ("Mt_rRNA", "Mt_tRNA", "miRNA", "misc_RNA", "rRNA", "ribozyme", "sRNA", "scRNA", "scaRNA", "snRNA", "snoRNA", "vaultRNA", "vault_RNA"),
    "external_non_coding": ("Mt_rRNA", "Mt_tRNA", "miRNA", "misc_RNA", "rRNA", "snRNA", "snoRNA"),
    "transcribed_pseudo": ("transcribed_processed_pseudogene", "transcribed_unitary_pseudogene", "transcribed_unprocessed_pseudogene"),
    "t_receptor": ("TR_C_gene", "TR_D_gene", "TR_J_gene", "TR_V_gene"),
    "immunoglobulin": ("IG_C_gene", "IG_D_gene", "IG_J_gene", "IG_V_gene"),
}
#: Transcript tags.
TAGS = (
    "2way_pseudo_cons", "3_nested_supported_extension", "3_standard_supported_extension", "454_RNA_Seq_supported", "5_nested_supported_extension", "5_standard_supported_extension", "CAGE_supported_TSS", "CCDS", "Ensembl_canonical",
    "MANE_Plus_Clinical", "MANE_Select", "NAGNAG_splice_site", "NMD_exception", "NMD_likely_if_extended", "PAR", "RNA_Seq_supported_only", "RNA_Seq_supported_partial", "RP_supported_TIS", "TAGENE", "alternative_3_UTR", "alternative_5_UTR",
    "appris_alternative_1", "appris_alternative_2", "appris_candidate", "appris_candidate_ccds", "appris_candidate_highest_score", "appris_candidate_longest", "appris_candidate_longest_ccds", "appris_candidate_longest_seq",
    "appris_principal", "appris_principal_1", "appris_principal_2", "appris_principal_3", "appris_principal_4", "appris_principal_5", "artifactual_duplication", "basic", "bicistronic", "cds_end_NF", "cds_start_NF", "dotter_confirmed",
    "downstream_ATG", "exp_conf", "fragmented_locus", "inferred_exon_combination", "inferred_transcript_model", "low_sequence_quality", "mRNA_end_NF", "mRNA_start_NF", "ncRNA_host", "nested_454_RNA_Seq_supported", "non_ATG_start",
    "non_canonical_TEC", "non_canonical_U12", "non_canonical_conserved", "non_canonical_genome_sequence_error", "non_canonical_other", "non_canonical_polymorphism", "non_submitted_evidence", "not_best_in_genome_evidence",
    "not_organism_supported", "orphan", "overlapping_locus", "overlapping_uORF", "overlaps_pseudogene", "pseudo_consens", "readthrough_transcript", "reference_genome_error", "retained_intron_CDS", "retained_intron_final",
    "retained_intron_first", "retrogene", "seleno", "semi_processed", "sequence_error", "stop_codon_readthrough", "upstream_ATG", "upstream_uORF",
)
#: Tags of models that aren't full, in their CDS or their mRNA.
NOT_FULL_CDS, NOT_FULL_MRNA = ("cds_end_NF", "cds_start_NF"), ("mRNA_end_NF", "mRNA_start_NF")
#: The named colours of SVG and CSS.
COLORS: dict[str, int] = {
    "aliceblue": 0xF0F8FF, "antiquewhite": 0xFAEBD7, "aqua": 0x00FFFF, "aquamarine": 0x7FFFD4, "azure": 0xF0FFFF, "beige": 0xF5F5DC, "bisque": 0xFFE4C4, "black": 0x000000, "blanchedalmond": 0xFFEBCD, "blue": 0x0000FF,
    "blueviolet": 0x8A2BE2, "brown": 0xA52A2A, "burlywood": 0xDEB887, "cadetblue": 0x5F9EA0, "chartreuse": 0x7FFF00, "chocolate": 0xD2691E, "coral": 0xFF7F50, "cornflowerblue": 0x6495ED, "cornsilk": 0xFFF8DC, "crimson": 0xDC143C,
    "cyan": 0x00FFFF, "darkblue": 0x00008B, "darkcyan": 0x008B8B, "darkgoldenrod": 0xB8860B, "darkgray": 0xA9A9A9, "darkgreen": 0x006400, "darkgrey": 0xA9A9A9, "darkkhaki": 0xBDB76B, "darkmagenta": 0x8B008B, "darkolivegreen": 0x556B2F,
    "darkorange": 0xFF8C00, "darkorchid": 0x9932CC, "darkred": 0x8B0000, "darksalmon": 0xE9967A, "darkseagreen": 0x8FBC8F, "darkslateblue": 0x483D8B, "darkslategray": 0x2F4F4F, "darkslategrey": 0x2F4F4F, "darkturquoise": 0x00CED1,
    "darkviolet": 0x9400D3, "deeppink": 0xFF1493, "deepskyblue": 0x00BFFF, "dimgray": 0x696969, "dimgrey": 0x696969, "dodgerblue": 0x1E90FF, "firebrick": 0xB22222, "floralwhite": 0xFFFAF0, "forestgreen": 0x228B22, "fuchsia": 0xFF00FF,
    "gainsboro": 0xDCDCDC, "ghostwhite": 0xF8F8FF, "gold": 0xFFD700, "goldenrod": 0xDAA520, "gray": 0x808080, "green": 0x008000, "greenyellow": 0xADFF2F, "grey": 0x808080, "honeydew": 0xF0FFF0, "hotpink": 0xFF69B4, "indianred": 0xCD5C5C,
    "indigo": 0x4B0082, "ivory": 0xFFFFF0, "khaki": 0xF0E68C, "lavender": 0xE6E6FA, "lavenderblush": 0xFFF0F5, "lawngreen": 0x7CFC00, "lemonchiffon": 0xFFFACD, "lightblue": 0xADD8E6, "lightcoral": 0xF08080, "lightcyan": 0xE0FFFF,
    "lightgoldenrodyellow": 0xFAFAD2, "lightgray": 0xD3D3D3, "lightgreen": 0x90EE90, "lightgrey": 0xD3D3D3, "lightpink": 0xFFB6C1, "lightsalmon": 0xFFA07A, "lightseagreen": 0x20B2AA, "lightskyblue": 0x87CEFA, "lightslategray": 0x778899,
    "lightslategrey": 0x778899, "lightsteelblue": 0xB0C4DE, "lightyellow": 0xFFFFE0, "lime": 0x00FF00, "limegreen": 0x32CD32, "linen": 0xFAF0E6, "magenta": 0xFF00FF, "maroon": 0x800000, "mediumaquamarine": 0x66CDAA, "mediumblue": 0x0000CD,
    "mediumorchid": 0xBA55D3, "mediumpurple": 0x9370DB, "mediumseagreen": 0x3CB371, "mediumslateblue": 0x7B68EE, "mediumspringgreen": 0x00FA9A, "mediumturquoise": 0x48D1CC, "mediumvioletred": 0xC71585, "midnightblue": 0x191970,
    "mintcream": 0xF5FFFA, "mistyrose": 0xFFE4E1, "moccasin": 0xFFE4B5, "navajowhite": 0xFFDEAD, "navy": 0x000080, "oldlace": 0xFDF5E6, "olive": 0x808000, "olivedrab": 0x6B8E23, "orange": 0xFFA500, "orangered": 0xFF4500, "orchid": 0xDA70D6,
    "palegoldenrod": 0xEEE8AA, "palegreen": 0x98FB98, "paleturquoise": 0xAFEEEE, "palevioletred": 0xDB7093, "papayawhip": 0xFFEFD5, "peachpuff": 0xFFDAB9, "peru": 0xCD853F, "pink": 0xFFC0CB, "plum": 0xDDA0DD, "powderblue": 0xB0E0E6,
    "purple": 0x800080, "red": 0xFF0000, "rosybrown": 0xBC8F8F, "royalblue": 0x4169E1, "saddlebrown": 0x8B4513, "salmon": 0xFA8072, "sandybrown": 0xF4A460, "seagreen": 0x2E8B57, "seashell": 0xFFF5EE, "sienna": 0xA0522D, "silver": 0xC0C0C0,
    "skyblue": 0x87CEEB, "slateblue": 0x6A5ACD, "slategray": 0x708090, "slategrey": 0x708090, "snow": 0xFFFAFA, "springgreen": 0x00FF7F, "steelblue": 0x4682B4, "tan": 0xD2B48C, "teal": 0x008080, "thistle": 0xD8BFD8, "tomato": 0xFF6347,
    "turquoise": 0x40E0D0, "violet": 0xEE82EE, "wheat": 0xF5DEB3, "white": 0xFFFFFF, "whitesmoke": 0xF5F5F5, "yellow": 0xFFFF00, "yellowgreen": 0x9ACD32,
}


def _lookup(value: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable((m, g) for g, members in groups.items() for m in members)))
    return F.try_element_at(table, value)


def biotype_function(biotype: ColumnOrName) -> Column:
    """coding, nonCoding, pseudo or other; null for null, an error for an unknown biotype."""
    b = col(biotype)
    found = _lookup(b, FUNCTIONS)
    return F.when(found.isNotNull() | b.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown biotype: "), b)).cast("string"))


def transcript_function(gene_biotype: ColumnOrName, transcript_biotype: ColumnOrName) -> Column:
    """That of the transcript's biotype, but pseudo in a pseudogene."""
    return F.when(biotype_function(gene_biotype) == "pseudo", "pseudo").otherwise(biotype_function(transcript_biotype))


def gene_category(biotype: ColumnOrName) -> Column:
    """The category of release statistics; null for biotypes that are in none."""
    return _lookup(col(biotype), CATEGORIES)


def biotype_is(biotype: ColumnOrName, kind: str) -> Column:
    """Whether a biotype is in one of SETS."""
    return col(biotype).isin(*SETS[kind])


def is_known_tag(tag: ColumnOrName) -> Column:
    return col(tag).isin(*TAGS)


def has_full_cds(tags: ColumnOrName) -> Column:
    return ~_any_of(tags, NOT_FULL_CDS)


def has_full_mrna(tags: ColumnOrName) -> Column:
    return ~_any_of(tags, NOT_FULL_MRNA)


def is_full(tags: ColumnOrName) -> Column:
    return ~_any_of(tags, NOT_FULL_CDS + NOT_FULL_MRNA)


def _any_of(tags: ColumnOrName, some: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.coalesce(col(tags), F.array().cast("array<string>")), F.array(*(F.lit(t) for t in some)))


def color_table(spark: SparkSession) -> DataFrame:
    """nth, name and packed RGB of the named colours, in order of name."""
    return spark.createDataFrame([(k, n, v) for k, (n, v) in enumerate(COLORS.items())], "nth int, name string, packed int")


def color_by_name(name: ColumnOrName) -> Column:
    """The packed RGB of a colour name in any case; an unknown name is an error."""
    n = F.lower(col(name))
    found = F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(COLORS.items()))), n)
    return F.when(found.isNotNull() | n.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown colour: "), n)).cast("int"))
