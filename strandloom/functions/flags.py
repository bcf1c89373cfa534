"""SAM flags, tags and reference names as Column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import cigar as C

# Bits of the SAM flag.
PAIRED, UNMAPPED, REVERSE, READ1, READ2, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 4, 16, 64, 128, 256, 1024, 2048
# Flags of concordant mates, and those a cluster of tagged reads accepts.
CONCORDANT = (99, 147, 83, 163)
CLUSTERED = (77, 141, 99, 147, 83, 163, 1123, 1171, 1107, 1187)
REGULAR = tuple(p + c for c in [*map(str, range(1, 23)), "X", "Y"] for p in ("", "chr"))


def has(flag: Column, bits: int) -> Column:
    """Whether any of ``bits`` is set."""
    return flag.bitwiseAND(bits) != 0


def concordant_pair(flag1: Column, flag2: Column) -> Column:
    """Whether two flags are those of a concordant pair, read 1 first."""
    return ((flag1 == 83) & (flag2 == 163)) | ((flag1 == 99) & (flag2 == 147))


def concordant(flag: Column) -> Column:
    """Whether a flag is one of a concordant pair's."""
    return flag.isin(*CONCORDANT)


def clustered(flag: Column) -> Column:
    """Whether a flag may enter a family of tagged reads: paired ends mapped in order or not at all, duplicates included."""
    return flag.isin(*CLUSTERED)


def same_fragment(name1: Column, name2: Column, ref1: Column, ref2: Column, flag1: Column, flag2: Column, strict_strand: bool = False) -> Column:
    """Whether two alignments are the two ends of one fragment; with ``strict_strand`` they must also face each other."""
    ends = (has(flag1, READ1) & has(flag2, READ2)) | (has(flag1, READ2) & has(flag2, READ1))
    out = (name1 == name2) & (ref1 == ref2) & ends
    return out & (has(flag1, REVERSE) != has(flag2, REVERSE)) if strict_strand else out


def primary_pair(flag1: Column, flag2: Column) -> Column:
    """Whether neither alignment is secondary."""
    return ~has(flag1, SECONDARY) & ~has(flag2, SECONDARY)


def spliced_pair(cigar1: Column, cigar2: Column) -> Column:
    """Whether either CIGAR skips part of the reference (N)."""
    return F.contains(cigar1, F.lit("N")) | F.contains(cigar2, F.lit("N"))


def unique_pair(rule: str, mapq1: Column, mapq2: Column, hits1: Column | None = None, hits2: Column | None = None) -> Column:
    """``bowtie2``: both mapping qualities 255; ``hisat2``: both NH tags 1."""
    if rule == "bowtie2":
        return (mapq1 == 255) & (mapq2 == 255)
    if rule == "hisat2":
        return (hits1 == 1) & (hits2 == 1)
    raise ValueError("rule must be bowtie2 or hisat2")


def lightly_clipped(cigar1: Column, cigar2: Column, below: int = 20) -> Column:
    """Whether no soft clip of either read reaches ``below`` bases."""
    return (C.longest_clip(cigar1) < below) & (C.longest_clip(cigar2) < below)


def clip_passes(cigar: Column, flag: Column, share: float) -> Column:
    """Whether an aligned read has less than ``share`` of its bases soft-clipped."""
    return (C.clipped(cigar) < C.query_length(cigar) * F.lit(share)) & ~has(flag, UNMAPPED)


def strand(flag: Column, direction: str = "fr") -> Column:
    """``+`` or ``-`` of the fragment a read is of: ``fr`` (read 1 sense), ``rf`` (read 2 sense) or ``U`` (the read's own strand)."""
    forward = ~has(flag, REVERSE)
    if direction == "U":
        plus = forward
    elif direction in ("fr", "rf"):
        first = has(flag, READ1) if direction == "fr" else has(flag, READ2)
        plus = first == forward
    else:
        raise ValueError("direction must be fr, rf or U")
    return F.when(plus, "+").when(~plus, "-")


def fixed_pair_flags(flag1: Column) -> tuple[Column, Column]:
    """Flags of a chosen pair by the strand of read 1: 83 and 163, or 99 and 147."""
    reverse = has(flag1, REVERSE)
    return F.when(reverse, 83).otherwise(99), F.when(reverse, 163).otherwise(147)


def fixed_single_flag(flag: Column) -> Column:
    """The flag of a chosen single alignment: its strand alone."""
    return F.when(has(flag, REVERSE), 16).otherwise(0)


def ribosomal_or_mitochondrial(chrom: Column) -> Column:
    """Reference names of ribosomal records and mitochondria."""
    return chrom.rlike("^gi|^chrM|^MT")


def regular_chrom(chrom: Column) -> Column:
    """Names 1 to 22, X and Y, with or without chr."""
    return chrom.isin(*REGULAR)
