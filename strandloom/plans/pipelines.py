"""Whole pipelines: one plan from the scan to the rows that are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import families, multimap, pairs, pileup, trim, umi


def bam_to_bed(alignments: DataFrame, **options: object) -> DataFrame:
    """Fragments of the concordant pairs of an alignment frame.

    Mates are those that follow each other in their file; a frame without
    ``ordinal`` has no order and pairs each name's alignments in every combination.
    """
    together = pairs.mates_in_order(alignments) if "ordinal" in alignments.columns else pairs.mates(alignments)
    return pairs.fragments(together, **options)


def dedup_bed(bed: DataFrame, *, threshold: int = 1, method: str = "directional", delimiter: str = "_", place: int = 0, cigar: bool = False) -> DataFrame:
    """Molecules of BED rows whose name holds the UMI: ``chrom start end strand umi n_members`` and, if asked, ``cigar``."""
    keys = ["chrom", "start", "end", "strand", *(["cigar"] if cigar else [])]
    tagged = bed.withColumn("umi__", umi.umi_of_name(F.col("name"), delimiter, place))
    return umi.deduplicated(tagged, keys, "umi__", threshold=threshold, method=method)


def saturation_bed(bed: DataFrame, *, nt: int = 6, prefix: str = "frag") -> DataFrame:
    """BED rows of the molecules behind deduplicated ones, by the saturation of UMIs of ``nt`` bases."""
    tagged = bed.withColumn("umi__", umi.umi_of_name(F.col("name"), "_", 0))
    rows = umi.expanded_molecules(umi.saturation(tagged, ["chrom", "start", "end", "strand"], "umi__", nt), prefix)
    return rows.select("chrom", "start", "end", "name", "score", "strand")


def reduce_multi(alignments: DataFrame, genes: DataFrame | None = None, order: str = "ordinal") -> DataFrame:
    """One pair of each read name as two alignment rows, with the flags of a plain pair."""
    best = multimap.best_pairs(pairs.mates_in_order(alignments, order), genes)
    columns = [c for c in alignments.columns if c not in ("qname",)]
    return pairs.unpair(best, columns).select(*alignments.columns)


def base_counts(alignments: DataFrame, reference: DataFrame, **options: object) -> DataFrame:
    """The pileup with the reference's base: ``chrom pos ref`` and the eight counts."""
    return pileup.reference_bases(reference, pileup.pileup(alignments, **options)).select("chrom", "pos", "ref", *[F.col(f"`{c}`") for c in pileup.COLUMNS])


def strand_fasta(piled: DataFrame, regions: DataFrame | None = None, complement: bool = False) -> DataFrame:
    """Consensus of both strands of regions (of whole chromosomes without any) as FASTA rows ``seq_id seq``."""
    rows = piled.withColumn("region", F.col("chrom"))
    if regions is not None:
        # Places meet regions on (chrom, tile) and the bounds; a region takes its own rows.
        tile = 1 << 14
        spread = regions.select(F.col("chrom").alias("rc"), F.col("start").alias("rs"), F.col("end").alias("re"), F.explode(F.expr(f"sequence(start div {tile}, (end - 1) div {tile})")).alias("rt"))
        rows = piled.join(spread, (F.col("chrom") == F.col("rc")) & (F.expr(f"pos div {tile}") == F.col("rt")) & (F.col("pos") >= F.col("rs")) & (F.col("pos") < F.col("re")))
        rows = rows.withColumn("region", F.format_string("%s:%d-%d", "chrom", "rs", "re"))
    side = lambda s: pileup.strand_sequence(rows.drop("chrom").withColumnRenamed("region", "chrom"), s, complement).select(F.concat("chrom", F.lit(f"({s})")).alias("seq_id"), "seq")
    return side("+").unionByName(side("-"))


def fastq_pairs(reads1: DataFrame, reads2: DataFrame) -> DataFrame:
    """Two FASTQ frames side by side as ``id1 seq1 qual1 id2 seq2 qual2``."""
    return flat_pairs(pairs.zipped_pairs(reads1, reads2))


def flat_pairs(both: DataFrame) -> DataFrame:
    """Structs ``r1 r2`` as columns of read 1 and read 2."""
    return both.select(*[F.col(f"r{k}.{c}").alias(f"{c}{k}") for k in (1, 2) for c in ("id", "seq", "qual")])


def clip_fastq(reads1: DataFrame, reads2: DataFrame, **options: object) -> DataFrame:
    """Clipped pairs named ``UMI_name``."""
    out = trim.clip_pairs(fastq_pairs(reads1, reads2), **options)
    return out.withColumn("name", F.concat_ws("_", "umi", "name"))


def correct_fastq(reads1: DataFrame, reads2: DataFrame, **options: object) -> DataFrame:
    """Voted pairs of barcode families, named ``clusterN_BARCODE_n_members`` by the barcode's order."""
    called = families.corrected_pairs(fastq_pairs(reads1, reads2), **options)
    numbered = umi.numbered_clusters(called, "barcode")
    return numbered.withColumn("name", F.concat(F.lit("cluster"), F.col("cluster_no").cast("string"), F.lit("_"), "barcode", F.lit("_"), F.col("members").cast("string"), F.lit("_members")))


def failed_pairs(reads1: DataFrame, reads2: DataFrame, **rules: object) -> DataFrame:
    """Pairs whose barcode is refused: name, then sequence and qualities of both reads."""
    rows = families.barcoded_pairs(fastq_pairs(reads1, reads2), **rules).where(~F.col("accepted"))
    return rows.select("id1", "seq1", "qual1", "seq2", "qual2")


def demultiplex(alignments: DataFrame, tag: str = "RX", mode: str = "prob", order: str | None = None) -> DataFrame:
    """Consensus reads of tagged families as FASTQ rows."""
    return families.family_reads(families.tagged_families(alignments, tag, mode, order))
