"""The command line: ``python -m strandloom.cli COMMAND ...``, one plan a command.

Inputs are files, patterns or folders that every executor can read; outputs are
folders of parts. ``--master`` names the cluster (by default this machine).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import pairs, pileup, trim, umi
from strandloom.plans import pipelines
from strandloom.session import ship_package
from strandloom.sources import bigwig, sequences, sinks, tables


def _is_bam(path: str) -> bool:
    return path.rstrip("*/").endswith(".bam")


def _alignments(spark: SparkSession, path: str) -> DataFrame:
    return sequences.read_bam(spark, path) if _is_bam(path) else tables.read_sam(spark, path)


def _write_buckets(spark: SparkSession, df: DataFrame, a: argparse.Namespace, columns: list[str], buckets: list[str]) -> None:
    if a.format == "parquet":
        sinks.write_split(df, a.output)
        return
    if "flag1" in df.columns:
        df = pairs.unpair(df, [c for c in columns if c != "qname"], ["bucket"])
    sinks.write_split_alignments(df.select(*columns, "bucket"), a.output, _header(spark, a.input), buckets, bam=a.format == "bam")


def _header(spark: SparkSession, path: str) -> list[str]:
    """The header lines of SAM text or BAM files, a few for each reference."""
    if _is_bam(path):
        return sequences.bam_header(path)
    return [r.line for r in tables.read_sam_header(spark, path).orderBy("file", "line_no").select("line").collect()]


def _flat(df: DataFrame, names: list[str]) -> DataFrame:
    return pairs.unpair(df, [c for c in names if c != "qname"]).select(*names)


def bam2bed(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.min_size >= a.max_size:
        raise SystemExit("--min_size must be below --max_size")
    out = pipelines.bam_to_bed(_alignments(spark, a.input), min_size=a.min_size, max_size=a.max_size, only_primary=a.primary, tag=a.tag, add_cigar=a.add_cigar, prefix=a.prefix)
    sinks.write_tsv(out, a.output)


def dedup(spark: SparkSession, a: argparse.Namespace) -> None:
    bed = tables.read_bed(spark, a.input, "cigar string" if a.cigar else "")
    out = pipelines.dedup_bed(bed, threshold=a.threshold, delimiter=a.delimiter, place=a.fragment, method=a.method, cigar=a.cigar)
    sinks.write_tsv(sinks.dedup_bed(out), a.output)


def calc_umi(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_tsv(pipelines.saturation_bed(tables.read_bed(spark, a.input), nt=a.umi, prefix=a.prefix), a.output)


def bedpe2bed(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_tsv(pairs.bedpe_fragments(tables.read_bedpe(spark, a.input), min_size=a.min_size, max_size=a.max_size), a.output)


def demux(spark: SparkSession, a: argparse.Namespace) -> None:
    mode = "vote" if a.conserved else "prob"
    sinks.write_fastq(pipelines.demultiplex(_alignments(spark, a.input), a.tag, mode, "ordinal" if a.runs else None), a.output)


def bam_tag(spark: SparkSession, a: argparse.Namespace) -> None:
    out = umi.tag_with_umi(_alignments(spark, a.input), a.tag, a.delimiter, a.fragment)
    sinks.write_sam(out, a.output, _header(spark, a.input))


def filter_umi(spark: SparkSession, a: argparse.Namespace) -> None:
    found = F.col("tags")[a.tag] if a.tag else umi.umi_of_name(F.col("qname"), "_", 0)
    sinks.write_sam(umi.without_runs(_alignments(spark, a.input), found, a.consecutive_bases), a.output, _header(spark, a.input))


def clip_fq(spark: SparkSession, a: argparse.Namespace) -> None:
    umi_bases = len(a.barcode) - len(a.barcode.lstrip("X"))
    one, two = (sequences.read_fastq(spark, p) for p in (a.fastq1, a.fastq2))
    out = pipelines.clip_fastq(one, two, umi_bases=umi_bases, constant=a.barcode[umi_bases:], mismatches=a.mismatch, least_qual=a.cutoff, read=a.read, min_length=a.min_length)
    sinks.write_interleaved(out, a.output, compression="gzip" if a.gzip else None)


def correct_fq(spark: SparkSession, a: argparse.Namespace) -> None:
    one, two = (sequences.read_fastq(spark, p) for p in (a.fastq1, a.fastq2))
    rules = {"read": int(a.read[-1]), "umi_bases": a.umi, "constant": a.constant, "mismatches": a.mismatch, "least_qual": a.cutoff}
    out = pipelines.correct_fastq(one, two, least=a.min_members, threshold=a.fraction, **rules)
    if a.failed:
        sinks.write_tsv(pipelines.failed_pairs(one, two, **rules), a.failed)
    for k in (1, 2):
        rows = out.select(F.concat("name", F.lit(f"/{k}")).alias("id"), F.col(f"seq{k}").alias("seq"), F.col(f"qual{k}").alias("qual"))
        sinks.write_fastq(rows, f"{a.output}/R{k}", compression="gzip")


def deinterleave(spark: SparkSession, a: argparse.Namespace) -> None:
    one, two = pairs.deinterleaved(pairs.interleaved_pairs(sequences.read_fastq(spark, a.input)), a.min_length)
    sinks.write_fastq(one, a.output1)
    sinks.write_fastq(two, a.output2)


def cov2bw(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = pileup.bedgraph(tables.read_depth(spark, a.input))
    if a.sizes:
        bigwig.write_bigwig(runs, tables.read_sizes(spark, a.sizes), a.output, a.prefix)
    else:
        runs.write.mode("overwrite").partitionBy("chrom").option("sep", "\t").csv(a.output)


def filter_soft_clip(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _alignments(spark, a.input)
    if a.pe:
        out = _flat(pairs.filter_clipped_pairs(pairs.mates_in_order(rows, "ordinal"), a.single_end, a.both_end, a.inverse), rows.columns)
    else:
        out = pairs.filter_clipped_single(rows, a.single_end, a.inverse)
    sinks.write_sam(out, a.output, _header(spark, a.input), order=("ordinal",))


def merge_pe(spark: SparkSession, a: argparse.Namespace) -> None:
    both = pipelines.flat_pairs(pairs.interleaved_pairs(sequences.read_fastq(spark, a.input)))
    out = trim.merge_pairs(both, min_overlap=a.min_overlap, max_error=a.error, mode="vote" if a.conserved else "prob", report_all=a.all, highlight=a.highlight)
    sinks.write_fastq(out.withColumnRenamed("name", "id"), a.output)


def filter_multi(spark: SparkSession, a: argparse.Namespace) -> None:
    from strandloom.operators.multimap import best_single

    rows = _alignments(spark, a.input)
    genes = tables.read_regions(spark, a.genes) if a.genes else None
    out = best_single(rows, "ordinal") if a.single else pipelines.reduce_multi(rows, genes)
    sinks.write_sam(out, a.output, _header(spark, a.input))


def splice_bam(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _alignments(spark, a.input)
    _write_buckets(spark, pairs.route_spliced(pairs.mates_in_order(rows)), a, rows.columns, ["split", "fragment"])


def split_bam(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _alignments(spark, a.input)
    out = pairs.route_unique_single(rows, a.program) if a.single else pairs.route_unique(pairs.mates_in_order(rows, "ordinal"), a.program)
    _write_buckets(spark, out, a, rows.columns, ["unique", "multi"])


def pileup_command(spark: SparkSession, a: argparse.Namespace) -> None:
    options = {"min_qual": a.qual, "crop": a.crop, "min_cov": a.cov, "no_indel": a.no_indel, "direction": a.direction}
    piled = pipelines.base_counts(_alignments(spark, a.input), sequences.read_fasta(spark, a.fasta, tile=pileup.TILE).withColumn("seq_id", F.split("seq_id", r"\s")[0]), **options)
    sinks.write_tsv(piled.orderBy("chrom", "pos"), a.output, header=True)
    if a.bed and a.consensus:
        sinks.write_fasta(pipelines.strand_fasta(piled, tables.read_regions(spark, a.bed)), a.consensus)


def parser() -> argparse.ArgumentParser:
    """All commands with their arguments."""
    top = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    top.add_argument("--master", default="local[*]")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, *arguments: tuple, help: str = "") -> None:  # noqa: A002
        sub = commands.add_parser(name, help=help)
        sub.set_defaults(run=run)
        for flags, options in arguments:
            sub.add_argument(*flags, **options)

    arg = lambda *flags, **options: (flags, options)
    io = (arg("-i", "--input", required=True), arg("-o", "--output", required=True))
    sizes = (arg("-m", "--min_size", type=int, default=0), arg("-M", "--max_size", type=int, default=1_000_000))
    fastqs = (arg("-1", "--fastq1", required=True), arg("-2", "--fastq2", required=True), arg("-o", "--output", required=True), arg("-r", "--read", choices=["read1", "read2"], default="read1"), arg("-c", "--cutoff", type=float, default=20), arg("-a", "--mismatch", type=int, default=1))
    yes = {"action": "store_true"}
    add("bam2bed", bam2bed, *io, *sizes, arg("-t", "--tag"), arg("-p", "--primary", **yes), arg("-c", "--add_cigar", **yes), arg("--prefix", default=""), help="fragments of paired alignments")
    add("demux", demux, *io, arg("-t", "--tag", default="RX"), arg("-c", "--conserved", **yes), arg("--runs", **yes), help="consensus reads of tagged families")
    add("bamTag", bam_tag, *io, arg("-t", "--tag", default="RX"), arg("-d", "--delimiter", default="_"), arg("-f", "--fragment", type=int, default=0), help="the UMI from the name to a tag")
    add("bedpe2bed", bedpe2bed, *io, *sizes, help="fragments of BEDPE rows")
    add("clipFQ", clip_fq, *fastqs, arg("-b", "--barcode", default="XXXXXX"), arg("-l", "--min_length", type=int, default=12), arg("--gzip", **yes), help="UMIs and adapters off read pairs")
    add("dedup", dedup, *io, arg("-t", "--threshold", type=int, default=1), arg("-d", "--delimiter", default="_"), arg("-f", "--fragment", type=int, default=0), arg("--method", choices=["directional", "adjacency", "exact"], default="directional"), arg("--cigar", **yes), help="molecules of BED fragments")
    add("deinterleave", deinterleave, arg("-i", "--input", required=True), arg("-1", "--output1", required=True), arg("-2", "--output2", required=True), arg("-l", "--min_length", type=int, default=0), help="interleaved pairs into two files")
    add("cov2bw", cov2bw, *io, arg("-g", "--sizes"), arg("--prefix", default="depth"), help="depth into a bigWig file for each chromosome of --sizes, without it into bedGraph runs")
    add("correctFQ", correct_fq, *fastqs, arg("-u", "--umi", type=int, default=6), arg("-x", "--constant", default=""), arg("-n", "--min_members", type=int, default=1), arg("-f", "--fraction", type=float, default=0.8), arg("--failed"), help="consensus pairs of barcode families")
    add("filterSoftClip", filter_soft_clip, *io, arg("--pe", **yes), arg("-s", "--single_end", type=float, default=0.2), arg("-b", "--both_end", type=float, default=0.5), arg("-v", "--inverse", **yes), help="alignments with little soft clipping")
    add("filterUMI", filter_umi, *io, arg("-n", "--consecutive_bases", type=int, default=3), arg("-t", "--tag"), help="alignments without runs in their UMI")
    add("mergepe", merge_pe, *io, arg("-m", "--min_overlap", type=int, default=15), arg("-e", "--error", type=float, default=0.1), arg("-a", "--all", **yes), arg("--highlight", **yes), arg("-c", "--conserved", **yes), help="overlapping mates into one read")
    add("calcUMI", calc_umi, *io, arg("-u", "--umi", type=int, default=6), arg("-p", "--prefix", default="frag"), help="molecules behind saturated UMIs")
    add("filterMulti", filter_multi, *io, arg("-g", "--genes"), arg("--single", **yes), help="one alignment of multi-mapped reads")
    form = arg("--format", choices=["sam", "bam", "parquet"], default="parquet")
    add("spliceBam", splice_bam, *io, form, help="spliced pairs apart from others")
    add("splitBam", split_bam, *io, arg("-p", "--program", choices=["bowtie2", "hisat2"], default="bowtie2"), arg("--single", **yes), form, help="unique pairs apart from multi-mapped ones")
    add("pileup", pileup_command, *io, arg("-f", "--fasta", required=True), arg("-q", "--qual", type=int, default=30), arg("-c", "--crop", type=int, default=0), arg("--cov", type=int, default=0), arg("--no_indel", **yes), arg("-d", "--direction", choices=["fr", "rf", "U"], default="fr"), arg("-b", "--bed"), arg("--consensus"), help="stranded base counts")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    arguments = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName(f"strandloom {arguments.command}").master(arguments.master)
        spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    arguments.run(spark, arguments)


if __name__ == "__main__":
    main()
