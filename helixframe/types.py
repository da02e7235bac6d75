"""Schemas of the records that sources yield and operators exchange. Positions are 0-based and half-open."""

from __future__ import annotations

COORDS = "struct<name:string,start:bigint,end:bigint,strand:string,size:bigint>"
RANGE = "struct<start:bigint,end:bigint>"
BLOCKS = f"array<{RANGE}>"
EXONS = "array<struct<start:bigint,end:bigint,frame:int>>"
PSL_BLOCKS = "array<struct<q_start:bigint,t_start:bigint,size:bigint,q_seq:string,t_seq:string>>"
CIGAR = "array<struct<op:string,count:int>>"
MAPPED = "struct<kind:string,prev_q_end:bigint,q_start:bigint,q_end:bigint,next_q_start:bigint,q_strand:string,prev_t_end:bigint,t_start:bigint,t_end:bigint,next_t_start:bigint,t_strand:string>"

BED_COLUMNS = ("chrom", "chrom_start", "chrom_end", "name", "score", "strand", "thick_start", "thick_end", "item_rgb", "blocks", "extra_cols")
GENEPRED_COLUMNS = ("name", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "exons", "score", "name2", "cds_start_stat", "cds_end_stat", "has_frames")
PSL_COLUMNS = (
    "match", "mis_match", "rep_match", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert", "strand",
    "q_name", "q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end", "blocks",
)
