"""Schemas of records, by name."""

from __future__ import annotations

FASTQ = "file string, ordinal bigint, id string, seq string, qual string, description string"
FASTA = "file string, ordinal bigint, seq_id string, seq string"
ALIGNMENT = "file string, ordinal bigint, qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, tags map<string,string>, tag_types map<string,string>"
HEADER = "file string, line_no bigint, line string"
BED6 = "chrom string, start bigint, end bigint, name string, length double, strand string"
BEDPE = "chrom1 string, start1 bigint, end1 bigint, chrom2 string, start2 bigint, end2 bigint, name string, score string, strand1 string, strand2 string"
BED12 = "chrom string, tx_start bigint, tx_end bigint, tid string, score string, strand string, cds bigint, cde bigint, rgb string, exon_count int, block_sizes string, block_starts string"
GTF = "chrom string, src_name string, feature_type string, start bigint, end bigint, score string, strand string, phase string, info string"
REFFLAT = "gene string, tid string, chrom string, strand string, tx_start bigint, tx_end bigint, cds bigint, cde bigint, exon_count int, starts string, ends string"
DEPTH = "chrom string, pos bigint, value bigint"
SIZES = "chrom string, size bigint"
# The columns of an Infernal hit table.
INFERNAL = ("target_name", "target_accession", "query_name", "query_accession", "mdl", "mdl_from", "mdl_to", "seq_from", "seq_to", "strand", "trunc", "pass", "gc", "bias", "score", "e_value", "inc", "description")
