"""Mates into pairs and fragments.

Alignments are frames with SAM's columns (``qname flag rname pos mapq cigar
rnext pnext tlen seq qual tags``, ``pos`` 0-based). Mates meet in one equi-join
on the read name, never by their order in a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.functions import flags as G
from strandloom.operators.ordered import places_within


def _side(df: DataFrame, bit: int, suffix: str) -> DataFrame:
    return df.where(G.has(F.col("flag"), bit)).select(*[F.col(c).alias("qname" if c == "qname" else f"{c}{suffix}") for c in df.columns])


def mates(df: DataFrame) -> DataFrame:
    """One row a pair: ``qname`` and every other column twice, of read 1 with suffix 1 and of read 2 with suffix 2.

    Names are compared up to their first slash. A name with several
    alignments of a read gives every combination of them, as many rows as it
    has candidate pairs; reads without a mate give none.
    """
    named = df.withColumn("qname", F.split("qname", "/")[0])
    return _side(named, G.READ1, "1").join(_side(named, G.READ2, "2"), "qname")


def mates_in_order(df: DataFrame, order: str = "ordinal") -> DataFrame:
    """Like :func:`mates`, with the k-th alignment of read 1 beside the k-th of read 2 of the same file by ``order``: no combinations.

    Frames without a ``file`` are one file. A name may hold any share of the
    rows; a read's alignment without a counterpart gives none.
    """
    named = df.withColumn("qname", F.split("qname", "/")[0]).withColumn("first__", G.has(F.col("flag"), G.READ1))
    named = named if "file" in df.columns else named.withColumn("file", F.lit(""))
    placed = places_within(named, ["file", "qname", "first__"], [order], "nth__")
    one, two = (_side(placed.drop("first__"), bit, k) for bit, k in ((G.READ1, "1"), (G.READ2, "2")))
    pairs = one.join(two.withColumnRenamed("qname", "name__"), (F.col("qname") == F.col("name__")) & (F.col("file1") == F.col("file2")) & (F.col("nth__1") == F.col("nth__2")))
    return pairs.drop("name__", "nth__1", "nth__2", *([] if "file" in df.columns else ["file1", "file2"]))


def fragments(pairs: DataFrame, *, min_size: int = 0, max_size: int = 1_000_000, only_primary: bool = False, tag: str | None = None, add_cigar: bool = False, prefix: str = "", strict_strand: bool = False) -> DataFrame:
    """BED fragments of concordant pairs: ``chrom start end name length strand`` and, if asked, ``tag`` and ``cigar``.

    A fragment reaches from the first to the last aligned base of either mate
    and takes its strand from read 1. Discordant pairs, and those of a length
    outside ``min_size`` to ``max_size``, give no row. Tags of both mates must
    agree as texts; numbers may differ and the larger counts.
    """
    ends = [(C.aligned_start(F.col(f"cigar{k}"), F.col(f"pos{k}")), C.aligned_end(F.col(f"cigar{k}"), F.col(f"pos{k}"))) for k in (1, 2)]
    good = G.same_fragment(F.col("qname"), F.col("qname"), F.col("rname1"), F.col("rname2"), F.col("flag1"), F.col("flag2"), strict_strand)
    if only_primary:
        good = good & G.primary_pair(F.col("flag1"), F.col("flag2"))
    out = pairs.where(good).withColumns({"start": F.least(ends[0][0], ends[1][0]), "end": F.greatest(ends[0][1], ends[1][1])})
    length = F.col("end") - F.col("start")
    columns = [F.col("rname1").alias("chrom"), "start", "end", F.concat(F.lit(prefix), "qname").alias("name"), length.alias("length"), F.when(G.has(F.col("flag1"), G.REVERSE), "-").otherwise("+").alias("strand")]
    if tag:
        columns.append(_agreed(F.col("tags1")[tag], F.col("tags2")[tag]).alias("tag"))
    if add_cigar:
        columns.append(F.concat_ws(":", "cigar1", "cigar2").alias("cigar"))
    return out.where(length.between(min_size, max_size)).select(*columns)


def single_fragments(df: DataFrame, *, min_size: int = 0, max_size: int = 1_000_000, tag: str | None = None, add_cigar: bool = False, prefix: str = "") -> DataFrame:
    """BED fragments of alignments taken one by one: ``chrom start end name length strand`` and, if asked, ``tag`` and ``cigar``.

    A fragment is the stretch of the reference that the alignment spans, on its
    own strand. Unmapped reads and lengths outside ``min_size`` to ``max_size``
    give no row. A prefix and a colon come before the name.
    """
    start, end = F.col("pos"), F.col("pos") + C.reference_length(F.col("cigar"))
    rows = df.where(~G.has(F.col("flag"), G.UNMAPPED) & (end - start).between(min_size, max_size))
    columns = [F.col("rname").alias("chrom"), start.alias("start"), end.alias("end"), F.concat(F.lit(f"{prefix}:" if prefix else ""), "qname").alias("name"), (end - start).alias("length"), F.when(G.has(F.col("flag"), G.REVERSE), "-").otherwise("+").alias("strand")]
    if tag:
        columns.append(F.col("tags")[tag].alias("tag"))
    if add_cigar:
        columns.append("cigar")
    return rows.select(*columns)


def _agreed(one: Column, two: Column) -> Column:
    a, b = one.try_cast("double"), two.try_cast("double")
    larger = F.when(a >= b, one).otherwise(two)
    return F.when(a.isNotNull() & b.isNotNull(), larger).when(one.eqNullSafe(two), one).otherwise(F.raise_error(F.lit("the tags of two mates differ")).cast("string"))


def bedpe_fragments(bedpe: DataFrame, *, min_size: int = 0, max_size: int = 1_000_000) -> DataFrame:
    """BED6 of BEDPE rows whose ends face each other on one reference, strictly between the sizes; named by column 7, strand of the first end."""
    start, end = F.least("start1", "start2"), F.greatest("end1", "end2")
    out = bedpe.where((F.col("strand1") != F.col("strand2")) & (F.col("chrom1") == F.col("chrom2")))
    out = out.select(F.col("chrom1").alias("chrom"), start.alias("start"), end.alias("end"), "name", (end - start).alias("length"), F.col("strand1").alias("strand"))
    return out.where((F.col("length") > min_size) & (F.col("length") < max_size))


def with_mate_tags(pairs: DataFrame) -> DataFrame:
    """Concordant pairs with the mate's CIGAR and mapping quality as tags MC and MQ on both reads; other pairs go."""
    add = lambda mine, mate: F.map_concat(F.map_filter(F.coalesce(F.col(f"tags{mine}"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("MC", "MQ")), F.create_map(F.lit("MC"), F.col(f"cigar{mate}"), F.lit("MQ"), F.col(f"mapq{mate}").cast("string")))
    return pairs.where(G.concordant_pair(F.col("flag1"), F.col("flag2"))).withColumns({"tags1": add(1, 2), "tags2": add(2, 1)})


def unpair(pairs: DataFrame, columns: list[str], kept: Sequence[str] = ()) -> DataFrame:
    """The mates of each pair as rows again, read 1 first under ``mate`` 1 and 2; columns of the pair may be ``kept``."""
    side = lambda k: F.struct(F.lit(k).alias("mate"), *[F.col(f"{c}{k}").alias(c) for c in columns])
    return pairs.select("qname", *kept, F.explode(F.array(side(1), side(2))).alias("x")).select("qname", *kept, "x.*")


def route_unique(pairs: DataFrame, rule: str = "bowtie2") -> DataFrame:
    """Aligned, lightly clipped pairs with ``bucket``: unique or multi by the aligner's rule."""
    mapped = ~G.has(F.col("flag1"), G.UNMAPPED) & ~G.has(F.col("flag2"), G.UNMAPPED)
    hits = [F.col(f"tags{k}")["NH"].try_cast("int") if "tags1" in pairs.columns else F.lit(None).cast("int") for k in (1, 2)]
    unique = G.unique_pair(rule, F.col("mapq1"), F.col("mapq2"), *hits)
    return pairs.where(mapped & G.lightly_clipped(F.col("cigar1"), F.col("cigar2"))).withColumn("bucket", F.when(unique, "unique").otherwise("multi"))


def route_unique_single(df: DataFrame, rule: str = "bowtie2") -> DataFrame:
    """Aligned single reads with ``bucket``: unique or multi; clips don't matter."""
    hits = F.col("tags")["NH"].try_cast("int") if "tags" in df.columns else F.lit(None).cast("int")
    unique = G.unique_pair(rule, F.col("mapq"), F.col("mapq"), hits, hits)
    return df.where(~G.has(F.col("flag"), G.UNMAPPED)).withColumn("bucket", F.when(unique, "unique").otherwise("multi"))


def route_spliced(pairs: DataFrame) -> DataFrame:
    """Concordant pairs with ``bucket``: split where either mate skips reference, else fragment."""
    return pairs.where(G.concordant_pair(F.col("flag1"), F.col("flag2"))).withColumn("bucket", F.when(G.spliced_pair(F.col("cigar1"), F.col("cigar2")), "split").otherwise("fragment"))


def filter_clipped_single(df: DataFrame, share: float = 0.1, inverse: bool = False) -> DataFrame:
    """Aligned reads with less than ``share`` of their bases soft-clipped; ``inverse`` keeps the clipped reads that don't pass instead."""
    clipped = F.contains("cigar", F.lit("S"))
    passes = G.clip_passes(F.col("cigar"), F.col("flag"), share)
    return df.where(~G.has(F.col("flag"), G.UNMAPPED) & (clipped & ~passes if inverse else ~clipped | passes))


def filter_clipped_pairs(pairs: DataFrame, share: float = 0.1, both_share: float = 0.05, inverse: bool = False) -> DataFrame:
    """Concordant pairs of which each read and both together are clipped little.

    Together means less than ``both_share`` of the template, or of either read
    where the template length is 0. ``inverse`` keeps the clipped pairs that
    don't pass instead.
    """
    c1, c2 = F.col("cigar1"), F.col("cigar2")
    s1, s2 = F.contains(c1, F.lit("S")), F.contains(c2, F.lit("S"))
    both = C.clipped(c1) + C.clipped(c2)
    template = F.abs("tlen1")
    pair_ok = F.when(template > 0, both < template * both_share).otherwise((both < C.query_length(c1) * both_share) & (both < C.query_length(c2) * both_share))
    reads_ok = (~s1 | G.clip_passes(c1, F.col("flag1"), share)) & (~s2 | G.clip_passes(c2, F.col("flag2"), share))
    passes = reads_ok & pair_ok
    chosen = (s1 | s2) & ~passes if inverse else ~(s1 | s2) | passes
    return pairs.where(G.concordant_pair(F.col("flag1"), F.col("flag2")) & chosen)


def interleaved_pairs(reads: DataFrame) -> DataFrame:
    """Records of interleaved FASTQ (``file ordinal id seq qual description``) as ``file, pair, r1, r2``; raises where two mates' names differ."""
    both = reads.groupBy("file", F.expr("ordinal div 2").alias("pair")).agg(
        *[F.max(F.when(F.col("ordinal") % 2 == k, F.struct("id", "seq", "qual", "description"))).alias(f"r{k + 1}") for k in (0, 1)]
    )
    same = F.split("r1.id", "/")[0] == F.split("r2.id", "/")[0]
    checked = F.when(same, F.col("r2")).otherwise(F.raise_error(F.lit("two interleaved mates have different names")).cast(both.schema["r2"].dataType))
    return both.withColumn("r2", checked)


def zipped_pairs(reads1: DataFrame, reads2: DataFrame) -> DataFrame:
    """Records of two sides side by side: ``file, pair, r1, r2``, the k-th of the i-th file of each, files in the order of their paths.

    ``file`` is that of read 1. What one file has beyond its counterpart, and
    files without one, are left out.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        # One row a file: bounded by the listing of the reader.
        files = df.select("file").distinct().withColumn("lane", F.row_number().over(Window.orderBy("file")))
        return df.join(F.broadcast(files), "file").select("lane", F.col("ordinal").alias("pair"), F.col("file").alias(f"file_{name}"), F.struct("id", "seq", "qual", "description").alias(name))

    return side(reads1, "r1").join(side(reads2, "r2"), ["lane", "pair"]).select(F.col("file_r1").alias("file"), "pair", "r1", "r2")


def deinterleaved(pairs: DataFrame, min_length: int = 0) -> tuple[DataFrame, DataFrame]:
    """Reads 1 and reads 2 of the pairs of which both are at least ``min_length`` long."""
    kept = pairs.where((F.length("r1.seq") >= min_length) & (F.length("r2.seq") >= min_length))
    return tuple(kept.select("file", "pair", f"{r}.*") for r in ("r1", "r2"))
