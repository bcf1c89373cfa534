"""One alignment of each multi-mapped read.

Candidates rank within their read by a total order, so the choice is the same
in every run; where the order used elsewhere would draw lots, the smallest hash
of the place decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.functions import flags as G
from strandloom.operators.intervals import overlapping_rows


def best_pairs(pairs: DataFrame, genes: DataFrame | None = None, score: Column | None = None) -> DataFrame:
    """The chosen pair of every read name (``mates`` columns), flags set to 99/147 or 83/163.

    Candidates are pairs of mates on one reference with the same template
    length. Best score first (the sum of both AS tags unless given), then
    ribosomal or mitochondrial, then overlapping a gene (``chrom start end``),
    then the shortest template, then a regular chromosome.
    """
    score = score if score is not None else F.col("tags1")["AS"].try_cast("int") + F.col("tags2")["AS"].try_cast("int")
    rows = pairs.where((F.col("rname1") == F.col("rname2")) & (F.abs("tlen1") == F.abs("tlen2"))).withColumns({"score__": score, "ribo__": G.ribosomal_or_mitochondrial(F.col("rname1"))})
    # Only candidates tied for the best score go on to be looked up among the genes.
    first = Window.partitionBy("qname").orderBy(F.col("score__").desc_nulls_last(), F.col("ribo__").desc())
    rows = rows.withColumn("tie__", F.rank().over(first)).where(F.col("tie__") == 1).drop("tie__")
    if genes is None:
        rows = rows.withColumn("gene__", F.lit(False))
    else:
        start = F.least("pos1", "pos2")
        end = F.greatest(F.col("pos1") + C.reference_length(F.col("cigar1")), F.col("pos2") + C.reference_length(F.col("cigar2")))
        rows = rows.withColumns({"chrom": F.col("rname1"), "start": start.cast("long"), "end": end.cast("long")})
        on_gene = overlapping_rows(rows.select("qname", "chrom", "start", "end"), genes, ["chrom"]).distinct().withColumn("gene__", F.lit(True))
        rows = rows.join(on_gene, ["qname", "chrom", "start", "end"], "left").withColumn("gene__", F.coalesce("gene__", F.lit(False))).drop("chrom", "start", "end")
    lot = F.xxhash64("rname1", "pos1", "pos2", "flag1", "flag2")
    order = Window.partitionBy("qname").orderBy(F.col("gene__").desc(), F.abs("tlen1"), G.regular_chrom(F.col("rname1")).desc(), lot, "rname1", "pos1", "pos2")
    best = rows.withColumn("place__", F.row_number().over(order)).where(F.col("place__") == 1).drop("place__", "score__", "ribo__", "gene__")
    one, two = G.fixed_pair_flags(F.col("flag1"))
    return best.withColumn("flag2", two).withColumn("flag1", one)


def best_single(df: DataFrame, order: str) -> DataFrame:
    """The chosen alignment of every single read, flag reduced to its strand.

    The only one of the least matched bases; else the only ribosomal or
    mitochondrial one; else the first on a regular chromosome; else the first,
    by ``order``. Candidates are kept in aggregates that combine before their
    shuffle, so a name may have any number of alignments.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    rows = df.select("qname", F.col(order).alias("at"), C.mapped_length(F.col("cigar")).alias("size"), G.ribosomal_or_mitochondrial(F.col("rname")).alias("ribo"), G.regular_chrom(F.col("rname")).alias("plain"), whole.alias("row"))
    first = lambda c: F.min_by("row", F.when(c, F.col("at")))
    sized = rows.groupBy("qname", "size").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), first(F.lit(True)).alias("any"), F.count_if("ribo").alias("n_ribo"), F.min(F.when(F.col("ribo"), F.col("at"))).alias("at_ribo"), first(F.col("ribo")).alias("ribo"), F.min(F.when(F.col("plain"), F.col("at"))).alias("at_plain"), first(F.col("plain")).alias("plain"))
    named = sized.groupBy("qname").agg(F.min_by(F.struct("n", "any"), "size").alias("least"), F.sum("n_ribo").alias("n_ribo"), F.min_by("ribo", "at_ribo").alias("ribo"), F.min("at_plain").alias("at_plain"), F.min_by("plain", "at_plain").alias("plain"), F.min_by("any", "at").alias("any"))
    chosen = F.when(F.col("least.n") == 1, F.col("least.any")).when(F.col("n_ribo") == 1, F.col("ribo")).when(F.col("at_plain").isNotNull(), F.col("plain")).otherwise(F.col("any"))
    out = named.select(chosen.alias("row")).select("row.*")
    return out.withColumn("flag", G.fixed_single_flag(F.col("flag")))
