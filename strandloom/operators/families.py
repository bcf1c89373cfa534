"""Families of reads under one tag or barcode, and their consensus reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import flags as G
from strandloom.functions.seq import fix_strand
from strandloom.operators.consensus import consensus_reads, paired_consensus
from strandloom.operators.umi import read1_barcode_accepts, read2_barcode_accepts, tag_runs

_SUB = ["family", "chrom1", "chrom2", "pos1", "pos2", "reverse1", "reverse2"]


def tagged_families(alignments: DataFrame, tag: str = "RX", mode: str = "prob", order: str | None = None, mismatches: int = 1) -> DataFrame:
    """Consensus pairs of families of one tag and one place: ``tag members chrom1 pos1 reverse1 seq1 qual1 chrom2 ...``.

    Reads are those whose flags may enter a family. Without ``order`` reads of
    exactly one tag are a family; with it, runs in that order of each file of
    tags within ``mismatches`` of the run's first, named by that first tag. Families split
    by both mates' place and strand. ``mode`` is prob or vote (at 0.8).
    Consensus reads stand as the sequencer read them.
    """
    rows = alignments.where(G.clustered(F.col("flag"))).withColumn("tag__", F.col("tags")[tag]).where(F.col("tag__").isNotNull())
    if order:
        file = ["file"] if "file" in rows.columns else []
        rows = tag_runs(rows, order, "tag__", file, mismatches)
        first = rows.groupBy(*file, "run").agg(F.min_by("tag__", order).alias("family_tag"))
        rows = rows.join(first, [*file, "run"]).withColumn("family", F.concat_ws(":", *file, F.col("run").cast("string"), F.col("family_tag"))).drop("run")
    else:
        rows = rows.withColumns({"family_tag": F.col("tag__"), "family": F.col("tag__")})
    one = rows.where(G.has(F.col("flag"), G.READ1)).select("qname", "family", "family_tag", F.col("rname").alias("chrom1"), F.col("pos").alias("pos1"), G.has(F.col("flag"), G.REVERSE).alias("reverse1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    two = rows.where(G.has(F.col("flag"), G.READ2)).select(F.col("qname").alias("q2"), F.col("family").alias("f2"), F.col("rname").alias("chrom2"), F.col("pos").alias("pos2"), G.has(F.col("flag"), G.REVERSE).alias("reverse2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    pairs = one.join(two, (F.col("qname") == F.col("q2")) & (F.col("family") == F.col("f2"))).drop("q2", "f2")
    tags = pairs.groupBy("family").agg(F.first("family_tag").alias("tag"))
    called = paired_consensus(pairs, _SUB, mode=mode, threshold=0.8).join(tags, "family")
    for k in (1, 2):
        seq, qual = fix_strand(F.col(f"seq{k}"), F.col(f"qual{k}"), F.col(f"reverse{k}"))
        called = called.withColumn(f"qual{k}", qual).withColumn(f"seq{k}", seq)
    return called.drop("family")


def family_reads(families: DataFrame) -> DataFrame:
    """FASTQ records of :func:`tagged_families`: ``id seq qual``, two a family, named ``TAG_n_member/1`` and ``/2``."""
    side = lambda k: F.struct(F.concat(F.col("tag"), F.lit("_"), F.col("members").cast("string"), F.lit(f"_member/{k}")).alias("id"), F.col(f"seq{k}").alias("seq"), F.col(f"qual{k}").alias("qual"))
    return families.select(F.explode(F.array(side(1), side(2))).alias("x")).select("x.*")


def barcoded_pairs(pairs: DataFrame, *, read: int = 1, umi_bases: int = 6, constant: str = "", mismatches: int = 1, least_qual: float = 20) -> DataFrame:
    """Pairs (``id1 seq1 qual1 seq2 qual2``) with ``barcode`` cut off the read it is on, and ``accepted``.

    The rules of read 1 and read 2 differ; rows that fail keep their reads
    whole, so that they can be set apart.
    """
    me = F.col(f"seq{read}"), F.col(f"qual{read}")
    barcode, barcode_qual = F.substring(me[0], 1, umi_bases), F.substring(me[1], 1, umi_bases)
    fixed = F.substring(me[0], umi_bases + 1, len(constant))
    usable = umi_bases + len(constant)
    rest = [F.substring(c, usable + 1, F.length(c)) for c in me]
    if read == 1:
        ok = read1_barcode_accepts(barcode, barcode_qual, fixed, constant, least_qual, mismatches, rest[1], F.col("qual2"))
    else:
        ok = read2_barcode_accepts(barcode, barcode_qual, fixed, constant, least_qual, mismatches)
    ok = F.coalesce(ok & (F.length(me[0]) > usable), F.lit(False))
    cut = {f"{n}{read}": F.when(ok, r).otherwise(c) for n, r, c in zip(("seq", "qual"), rest, me)}
    return pairs.select(*[c for c in pairs.columns if c not in cut], *[v.alias(k) for k, v in cut.items()], barcode.alias("barcode"), ok.alias("accepted"))


def corrected_pairs(pairs: DataFrame, *, least: int = 1, threshold: float = 0.8, **rules: object) -> DataFrame:
    """One voted pair for every accepted barcode of ``least`` or more pairs: ``barcode members seq1 qual1 seq2 qual2``."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    kept = barcoded_pairs(pairs, **rules).where("accepted")
    return paired_consensus(kept, ["barcode"], mode="vote", threshold=threshold, least=least)


def single_consensus(reads: DataFrame, keys: list[str], **options: object) -> DataFrame:
    """Consensus of unpaired reads by ``keys``."""
    return consensus_reads(reads, keys, **options)
