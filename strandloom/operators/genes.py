"""Gene models: transcripts with exons, introns and the way between transcript and genome.

A transcript row has ``chrom tid strand tx_start tx_end cds cde`` and arrays
``exon_starts exon_ends`` in genomic order, all half-open from 0. What a
transcript needs is in its own row, so exon tables, blocks and positions are
array expressions; windows appear only in the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exons_of(transcripts: DataFrame) -> DataFrame:
    """Transcripts with ``exons``: an array of (exon_num, start, end, tx_start, tx_end) in the transcript's order."""
    genomic = F.zip_with("exon_starts", "exon_ends", lambda s, e: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end")))
    ordered = F.when(F.col("strand") == "-", F.reverse(genomic)).otherwise(genomic)
    kind = "struct<at:bigint,out:array<struct<exon_num:int,start:bigint,end:bigint,tx_start:bigint,tx_end:bigint>>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().alias("out")).cast(kind)

    def walk(acc: Column, x: Column) -> Column:
        size = x["end"] - x["start"]
        one = F.struct((F.size(acc["out"]) + 1).alias("exon_num"), x["start"].alias("start"), x["end"].alias("end"), acc["at"].alias("tx_start"), (acc["at"] + size).alias("tx_end"))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

    return transcripts.withColumn("exons", F.aggregate(ordered, zero, walk)["out"])


def exon_table(transcripts: DataFrame) -> DataFrame:
    """One row an exon: its place, and what of the coding sequence it holds.

    ``contain_cds`` and ``contain_cde`` (start and end of coding, bounds
    inclusive), ``after_cds`` and ``after_cde`` (how often passed, this exon
    included) and ``coding_bases``. On ``-`` the coding ends swap.
    """
    minus = F.col("strand") == "-"
    rows = exons_of(transcripts).select("chrom", "tid", "strand", F.when(minus, F.col("cde")).otherwise(F.col("cds")).alias("cds"), F.when(minus, F.col("cds")).otherwise(F.col("cde")).alias("cde"), "exons", F.explode("exons").alias("x"))
    rows = rows.select("chrom", "tid", "strand", "cds", "cde", "exons", "x.*")
    inside = lambda place: lambda e: (e["start"] <= F.col(place)) & (F.col(place) <= e["end"])
    passed = lambda place: F.size(F.filter("exons", lambda e: (e["exon_num"] <= F.col("exon_num")) & inside(place)(e)))
    holds = lambda place: (F.col("start") <= F.col(place)) & (F.col(place) <= F.col("end"))
    rows = rows.withColumns({"length": F.col("end") - F.col("start"), "contain_cds": holds("cds"), "contain_cde": holds("cde"), "after_cds": passed("cds"), "after_cde": passed("cde")})
    plus = F.col("strand") != "-"
    head = F.when(F.col("contain_cds"), F.when(plus, F.col("cds") - F.col("start")).otherwise(F.col("end") - F.col("cds"))).otherwise(0)
    tail = F.when(F.col("contain_cde"), F.when(plus, F.col("end") - F.col("cde")).otherwise(F.col("cde") - F.col("start"))).otherwise(0)
    coding = F.when(F.col("after_cds") > 0, F.col("length") - head - tail).otherwise(0)
    return rows.withColumn("coding_bases", coding).drop("exons", "cds", "cde")


def coding_exons(exons: DataFrame) -> DataFrame:
    """:func:`exon_table` with ``is_coding`` (holds an end of coding, or lies between them) and ``whole_coding`` (holds both)."""
    between = (F.col("after_cds") > 0) & (F.col("after_cde") == 0)
    return exons.withColumns({"is_coding": F.col("contain_cds") | F.col("contain_cde") | between, "whole_coding": F.col("contain_cds") & F.col("contain_cde")})


def five_utr_length(strand: Column, tx_start: Column, tx_end: Column, cds: Column, cde: Column, correct: bool = False) -> Column:
    """Transcript places before coding starts, introns included.

    By custom it is negative on ``+`` (start less coding start); ``correct``
    turns that around.
    """
    plus = cds - tx_start if correct else tx_start - cds
    return F.when(strand == "-", tx_end - cde).otherwise(plus)


def transcripts_of(transcripts: DataFrame, gene: str) -> DataFrame:
    """The transcripts of one gene; raises if there is none."""
    found = transcripts.where(F.col("gene") == gene)
    if found.isEmpty():
        raise KeyError(gene)
    return found


def first_coding_exon(transcripts: DataFrame) -> DataFrame:
    """The first exon of each transcript that holds the start of coding."""
    found = exon_table(transcripts).where("contain_cds")
    return found.groupBy("tid").agg(F.min(F.struct("exon_num", "start", "end")).alias("x")).select("tid", "x.*")


def introns(transcripts: DataFrame, start_offset: int = 1) -> DataFrame:
    """What lies between neighbouring exons, numbered in the transcript's order: ``chrom, start, end, tid, intron_num, strand``.

    ``start_offset`` is added to the start: 1 by custom of this table, 0 for
    half-open places from 0.
    """
    pairs = exons_of(transcripts).select("chrom", "tid", "strand", "exons", F.explode(F.when(F.size("exons") > 1, F.sequence(F.lit(1), F.size("exons") - 1))).alias("intron_num"))
    one, two = F.get("exons", F.col("intron_num") - 1), F.get("exons", F.col("intron_num"))
    low = F.when(F.col("strand") == "-", two["end"]).otherwise(one["end"])
    high = F.when(F.col("strand") == "-", one["start"]).otherwise(two["start"])
    return pairs.select("chrom", (low + start_offset).alias("start"), high.alias("end"), "tid", "intron_num", "strand")


def transcript_length(exons: Column) -> Column:
    """The transcript's length from its exon array."""
    return F.coalesce(F.array_max(F.transform(exons, lambda e: e["tx_end"])), F.lit(0).cast("bigint"))


def genomic_position(exons: Column, strand: Column, place: Column, correct: bool = False) -> Column:
    """The genomic place of a transcript place (bounds inclusive, the earlier exon at a boundary); null outside.

    By custom the offset within the exon is taken off its start on both
    strands; ``correct`` counts forward on ``+`` and back from the end on ``-``.
    """
    exon = F.get(F.filter(exons, lambda e: (e["tx_start"] <= place) & (place <= e["tx_end"])), F.lit(0))
    offset = place - exon["tx_start"]
    if not correct:
        return exon["start"] - offset
    return F.when(strand == "-", exon["end"] - offset).otherwise(exon["start"] + offset)


def blocks(exons: Column, strand: Column, start: Column, end: Column) -> Column:
    """The genomic stretches (start, end) of a transcript interval, in the transcript's order; empty ones are left out."""
    shared = F.filter(exons, lambda e: F.greatest(start, e["tx_start"]) < F.least(end, e["tx_end"]))

    def stretch(e: Column) -> Column:
        low, high = F.greatest(start, e["tx_start"]) - e["tx_start"], F.least(end, e["tx_end"]) - e["tx_start"]
        minus = strand == "-"
        return F.struct(F.when(minus, e["end"] - high).otherwise(e["start"] + low).alias("start"), F.when(minus, e["end"] - low).otherwise(e["start"] + high).alias("end"))

    return F.transform(shared, stretch)


def coding_only(transcripts: DataFrame) -> DataFrame:
    """Transcripts with a coding sequence."""
    return transcripts.where(F.col("cds") != F.col("cde"))


def gene_transcripts(gtf: DataFrame) -> DataFrame:
    """Records of each transcript and feature type as arrays; records without a transcript are left out.

    ``gtf`` has ``chrom start end strand feature_type`` and ``attributes`` (a map).
    """
    rows = gtf.withColumn("transcript_id", F.col("attributes")["transcript_id"]).where(F.col("transcript_id").isNotNull() & (F.col("feature_type") != "gene"))
    return rows.groupBy("transcript_id", "feature_type").agg(F.array_sort(F.collect_list(F.struct("start", "end", "chrom", "strand"))).alias("records"))


def database_transcripts(tx: DataFrame, tx2exon: DataFrame, exon: DataFrame, gene: DataFrame, coding: bool = False) -> DataFrame:
    """Transcript rows from the four tables of an annotation database, exons in genomic order.

    ``tx(tx_id tx_biotype tx_seq_start tx_seq_end tx_cds_seq_start
    tx_cds_seq_end gene_id)``, ``tx2exon(tx_id exon_id exon_idx)``,
    ``exon(exon_id exon_seq_start exon_seq_end)``, ``gene(gene_id gene_name
    seq_name seq_strand)``. Transcripts without a coding sequence keep null
    ends; ``coding`` leaves only protein-coding ones.
    """
    keys = ["seq_name", "tx_id", "gene_name", "seq_strand", "tx_biotype", "tx_seq_start", "tx_seq_end", "tx_cds_seq_start", "tx_cds_seq_end"]
    rows = tx.join(tx2exon, "tx_id").join(exon, "exon_id").join(gene, "gene_id")
    if coding:
        rows = rows.where(F.col("tx_biotype") == "protein_coding")
    spans = F.array_sort(F.collect_list(F.struct(F.col("exon_seq_start").alias("s"), F.col("exon_seq_end").alias("e"))))
    out = rows.groupBy(*keys).agg(spans.alias("x"))
    strand = F.when(F.col("seq_strand").cast("string").isin("1", "+"), "+").otherwise("-")
    return out.select(
        F.col("seq_name").alias("chrom"), F.col("tx_id").alias("tid"), F.col("gene_name").alias("gene"), strand.alias("strand"), F.col("tx_seq_start").alias("tx_start"), F.col("tx_seq_end").alias("tx_end"),
        F.col("tx_cds_seq_start").alias("cds"), F.col("tx_cds_seq_end").alias("cde"), F.size("x").alias("exon_count"), F.transform("x", lambda p: p["s"]).alias("exon_starts"), F.transform("x", lambda p: p["e"]).alias("exon_ends"),
    )
