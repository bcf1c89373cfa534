"""Consensus of families of reads, by position in long form.

A family explodes to (family, position, base, quality) and aggregates back;
counts and sums combine before the shuffle, so a family of any size leaves a
task as at most a few rows a position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.prob import MAX_PROB, error_prob, prob_char


def bases_by_position(reads: DataFrame, keys: Sequence[str], seq: str = "seq", qual: str = "qual") -> DataFrame:
    """``keys..., pos, base, n, qual_sum, hit, miss``: what each base of a family adds up to at each position (from 0).

    ``hit`` is the summed log chance of the base given it is right, ``miss``
    given another is. Families of several reads are cut to their shortest.
    Reads without sequence or qualities, or with them of different lengths,
    are left out.
    """
    good = reads.where(F.col(seq).isNotNull() & F.col(qual).isNotNull() & (F.length(seq) == F.length(qual)) & (F.length(seq) > 0))
    rows = good.select(*keys, F.col(seq).alias("s"), F.col(qual).alias("q"), F.posexplode(F.split(seq, "")).alias("pos", "base"))
    phred = F.ascii(F.substring("q", F.col("pos") + 1, F.lit(1))) - 33
    rows = rows.select(*keys, F.length("s").alias("len"), "pos", "base", phred.alias("phred"))
    p = error_prob(F.col("phred"))
    sums = rows.groupBy(*keys, "pos", "base").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("phred").alias("qual_sum"),
        F.sum(F.ln(F.greatest(1 - p, F.lit(1e-300)))).alias("hit"),
        F.sum(F.ln(p / 3)).alias("miss"),
        F.min("len").alias("shortest"),
    )
    shortest = F.min("shortest").over(Window.partitionBy(*keys))
    return sums.withColumn("cut", shortest).where(F.col("pos") < F.col("cut")).drop("cut", "shortest")


def called_bases(counted: DataFrame, keys: Sequence[str], mode: str = "prob", threshold: float = 0.8) -> DataFrame:
    """The base called at each position of :func:`bases_by_position`, with its probability: ``keys..., pos, base, prob``.

    ``vote``: the commonest base, the first in the alphabet among equals; N
    with probability 0 where its share is below ``threshold``, else by the sum
    of its qualities. ``prob``: the base of the highest posterior among those
    seen.
    """
    at = Window.partitionBy(*keys, "pos")
    if mode == "vote":
        ranked = counted.withColumns({"depth": F.sum("n").over(at), "place": F.row_number().over(at.orderBy(F.col("n").desc(), "base"))}).where(F.col("place") == 1)
        sure = F.col("n") / F.col("depth") >= threshold
        prob = F.least(F.lit(MAX_PROB), 1 - F.pow(F.lit(10.0), -F.col("qual_sum") / 10))
        return ranked.select(*keys, "pos", F.when(sure, F.col("base")).otherwise("N").alias("base"), F.when(sure, prob).otherwise(0.0).alias("prob"))
    if mode != "prob":
        raise ValueError("mode must be vote or prob")
    log = F.col("hit") + F.sum("miss").over(at) - F.col("miss")
    scored = counted.withColumns({"log": log, "seen": F.count(F.lit(1)).over(at)})
    top = scored.withColumns({"most": F.max("log").over(at), "place": F.row_number().over(at.orderBy(F.round("log", 9).desc(), "base"))})
    total = top.withColumn("rest", F.sum(F.exp(F.col("log") - F.col("most"))).over(at)).where(F.col("place") == 1)
    prob = F.when(F.col("seen") == 1, F.lit(MAX_PROB)).otherwise(F.exp(F.col("log") - F.col("most")) / F.col("rest"))
    return total.select(*keys, "pos", "base", prob.alias("prob"))


def consensus_reads(reads: DataFrame, keys: Sequence[str], *, mode: str = "prob", threshold: float = 0.8, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """One read a family: ``keys..., members, seq, qual``; a family of one keeps its read as it is."""
    called = called_bases(bases_by_position(reads, keys, seq, qual), keys, mode, threshold)
    # A read's positions are bounded by its length, so are these arrays.
    lines = called.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "base", prob_char(F.col("prob")).alias("char")))).alias("line"))
    joined = lines.select(*keys, F.array_join(F.transform("line", lambda x: x["base"]), "").alias("seq"), F.array_join(F.transform("line", lambda x: x["char"]), "").alias("qual"))
    good = reads.where(F.col(seq).isNotNull() & F.col(qual).isNotNull() & (F.length(seq) == F.length(qual)) & (F.length(seq) > 0))
    sizes = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.col(seq).alias("s"), F.col(qual).alias("q"))).alias("only"))
    renamed = sizes.select(*[F.col(k).alias(f"{k}__n") for k in keys], "members", "only")
    out = joined.join(renamed, [F.col(k).eqNullSafe(F.col(f"{k}__n")) for k in keys])
    one = F.col("members") == 1
    return out.select(*keys, "members", F.when(one, F.col("only.s")).otherwise(F.col("seq")).alias("seq"), F.when(one, F.col("only.q")).otherwise(F.col("qual")).alias("qual"))


def paired_consensus(pairs: DataFrame, keys: Sequence[str], *, mode: str = "vote", threshold: float = 0.8, least: int = 1) -> DataFrame:
    """Consensus of both reads of families of ``least`` or more pairs (``seq1 qual1 seq2 qual2``): ``keys..., members`` and the four."""
    side = lambda k: consensus_reads(pairs, keys, mode=mode, threshold=threshold, seq=f"seq{k}", qual=f"qual{k}").select(*[F.col(c).alias(f"{c}__{k}") for c in keys], F.col("members").alias(f"members{k}"), F.col("seq").alias(f"seq{k}"), F.col("qual").alias(f"qual{k}"))
    same = [F.col(f"{c}__1").eqNullSafe(F.col(f"{c}__2")) for c in keys]
    out = side(1).join(side(2), same).where(F.col("members1") >= least)
    return out.select(*[F.col(f"{c}__1").alias(c) for c in keys], F.col("members1").alias("members"), "seq1", "qual1", "seq2", "qual2")


def coverage_call(a: Column, c: Column, g: Column, t: Column, ties: str = "sum") -> Column:
    """The base of most coverage at a place. Ties: ``sum`` decodes the sum of the tied bases' indices (A 0, C 1, G 2, T 3; above 3: N), ``N`` gives N."""
    top = F.greatest(a, c, g, t)
    index = sum((F.when(x == top, i).otherwise(0) for i, x in enumerate((a, c, g, t))), start=F.lit(0))
    tied = sum((F.when(x == top, 1).otherwise(0) for x in (a, c, g, t)), start=F.lit(0))
    letter = F.when(index == 0, "A").when(index == 1, "C").when(index == 2, "G").when(index == 3, "T").otherwise("N")
    return F.when((tied > 1) & F.lit(ties == "N"), "N").otherwise(letter)
