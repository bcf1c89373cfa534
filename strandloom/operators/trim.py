"""Clipping UMIs off read pairs and merging overlapping mates.

Pairs are rows with ``id1 seq1 qual1 id2 seq2 qual2``. Alignments run as Arrow
functions over whole batches; everything around them stays in expressions, and
rows that can't pass are filtered before any alignment is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.align import locate
from strandloom.functions.prob import error_prob, prob_char, quals
from strandloom.functions.prob import MAX_PROB
from strandloom.functions.seq import letters, reverse_complement
from strandloom.operators.umi import clip_accepts

# Adapters behind the UMI when it is on read 1 or on read 2.
ADAPTERS = {"read1": "GATCGTCGGACTGTAGAACTCTGAACGTGTAGA", "read2": "AAGATCGGAAGAGCACACGTCTGAACTCCAGTCAC"}


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def clip_pairs(pairs: DataFrame, *, umi_bases: int = 6, constant: str = "", mismatches: int = 1, least_qual: float = 20, read: str = "read1", min_length: int = 12) -> DataFrame:
    """Pairs with a sure UMI, clipped: ``name umi`` and both sequences and qualities.

    The UMI is the first bases of the read named, a ``constant`` part may
    follow. The other read loses what lies behind its copy of UMI and adapter,
    then both lose what hangs over the other's end; pairs with a read shorter
    than ``min_length`` go. Pairs with a null are left out.
    """
    mine, other = ("1", "2") if read == "read1" else ("2", "1")
    usable = umi_bases + len(constant)
    rows = pairs.dropna(subset=[f"{c}{k}" for c in ("seq", "qual") for k in "12"])
    s, q = F.col(f"seq{mine}"), F.col(f"qual{mine}")
    umi = F.substring(s, 1, umi_bases)
    sure = clip_accepts(umi, F.substring(q, 1, umi_bases), F.substring(s, umi_bases + 1, len(constant)), constant, least_qual, mismatches)
    rows = rows.where(sure & (F.length(s) >= umi_bases)).select(
        F.split(f"id{mine}", " ")[0].alias("name"), umi.alias("umi"), F.substring(s, usable + 1, F.length(s)).alias("us"), F.substring(q, usable + 1, F.length(q)).alias("uq"), F.col(f"seq{other}").alias("os"), F.col(f"qual{other}").alias("oq"),
    )
    rows = rows.withColumn("hit", locate(F.col("os"), F.concat(reverse_complement(F.col("umi")), F.lit(ADAPTERS[read])), 0.15))
    cut = F.when((F.col("hit.query_start") == 0) & (F.col("hit.matches") > umi_bases), F.col("hit.ref_start")).otherwise(F.length("os"))
    rows = rows.withColumn("cut", cut).withColumns({"os": F.substring("os", F.lit(1), F.col("cut")), "oq": F.substring("oq", F.lit(1), F.col("cut"))})
    rows = rows.withColumn("back", reverse_complement(F.col("os"))).withColumn("meet", locate(F.col("us"), F.col("back"), 0.1))
    inside = (F.col("meet.matches") >= 15) & (F.col("meet.ref_start") == 0) & (F.col("meet.query_end") == F.length("back"))
    keep_u = F.when(inside, F.col("meet.ref_end")).otherwise(F.length("us"))
    keep_o = F.when(inside, F.col("meet.query_end") - F.col("meet.query_start")).otherwise(F.length("os"))
    rows = rows.withColumns({"ku": keep_u, "ko": keep_o}).where(F.least("ku", "ko") >= min_length)
    clipped = {f"seq{mine}": F.substring("us", F.lit(1), F.col("ku")), f"qual{mine}": F.substring("uq", F.lit(1), F.col("ku")), f"seq{other}": F.substring("os", F.lit(1), F.col("ko")), f"qual{other}": F.substring("oq", F.lit(1), F.col("ko"))}
    return rows.select("name", "umi", *[clipped[c].alias(c) for c in ("seq1", "qual1", "seq2", "qual2")])


def _two_read_call(seq1: Column, qual1: Column, seq2: Column, qual2: Column, mode: str, threshold: float) -> tuple[Column, Column]:
    """Consensus of two texts of one length, in the row: the column forms of the family rules for two members."""
    pairs = F.zip_with(F.zip_with(letters(seq1), quals(qual1), lambda b, q: F.struct(b.alias("b"), q.alias("q"))), F.zip_with(letters(seq2), quals(qual2), lambda b, q: F.struct(b.alias("b"), q.alias("q"))), lambda x, y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")))

    def call(p: Column) -> Column:
        x, y = p["x"], p["y"]
        same = x["b"] == y["b"]
        if mode == "vote":
            prob = F.when(same, F.least(F.lit(MAX_PROB), 1 - F.pow(F.lit(10.0), -(x["q"] + y["q"]) / 10))).otherwise(F.lit(0.0) if threshold > 0.5 else 1 - error_prob(x["q"]))
            base = F.when(same | F.lit(threshold <= 0.5), x["b"]).otherwise("N")
            return F.struct(base.alias("b"), prob_char(prob).alias("q"))
        lik = lambda hit, miss: F.ln(F.greatest(1 - error_prob(hit["q"]), F.lit(1e-300))) + F.ln(error_prob(miss["q"]) / 3)
        one, two = lik(x, y), lik(y, x)
        first = F.round(one, 9) >= F.round(two, 9)
        prob = 1 / (1 + F.exp(-F.abs(one - two)))
        return F.struct(F.when(same | first, x["b"]).otherwise(y["b"]).alias("b"), prob_char(F.when(same, F.lit(MAX_PROB)).otherwise(prob)).alias("q"))

    called = F.transform(pairs, call)
    return F.array_join(F.transform(called, lambda c: c["b"]), ""), F.array_join(F.transform(called, lambda c: c["q"]), "")


def merge_pairs(pairs: DataFrame, *, min_overlap: int = 15, max_error: float = 0.1, mode: str = "prob", threshold: float = 0.8, report_all: bool = False, highlight: bool = False) -> DataFrame:
    """One read of each pair whose mates overlap without a gap: ``name seq qual``.

    The overlap is the mates' consensus; ``report_all`` adds what either mate
    has beyond it, and ``highlight`` colours what lies beyond the fragment's
    ends and keeps only pairs that have such.
    """
    rows = pairs.dropna(subset=["seq1", "qual1", "seq2", "qual2"]).withColumns({"back": reverse_complement(F.col("seq2")), "kcab": F.reverse("qual2")})
    rows = rows.withColumn("m", locate(F.col("seq1"), F.col("back"), max_error))
    rs, re, qs, qe = (F.col(f"m.{c}") for c in ("ref_start", "ref_end", "query_start", "query_end"))
    rows = rows.where((F.col("m.matches") >= min_overlap) & (re - rs == qe - qs))
    seq, qual = _two_read_call(_part(F.col("seq1"), rs, re), _part(F.col("qual1"), rs, re), _part(F.col("back"), qs, qe), _part(F.col("kcab"), qs, qe), mode, threshold)
    name = F.split("id1", "/")[0].alias("name")
    if not report_all:
        return rows.select(name, seq.alias("seq"), qual.alias("qual"))
    n1, n2 = F.length("seq1"), F.length("back")
    empty = F.lit("")
    left_own, right_own = qs != 0, re != n1
    pick = lambda one, two: (F.when(qs != 0, _part(F.col(two), F.lit(0), qs)).when(rs != 0, _part(F.col(one), F.lit(0), rs)).otherwise(empty), F.when(re != n1, _part(F.col(one), re, n1)).when(qe != n2, _part(F.col(two), qe, n2)).otherwise(empty))
    (ls, rs_), (lq, rq) = pick("seq1", "back"), pick("qual1", "kcab")
    if highlight:
        from strandloom.functions.seq import highlight as coloured

        rows = rows.where(left_own | right_own)
        ls, rs_ = F.when(left_own, coloured(ls)).otherwise(ls), F.when(right_own, coloured(rs_)).otherwise(rs_)
    return rows.select(name, F.concat(ls, seq, rs_).alias("seq"), F.concat(lq, qual, rq).alias("qual"))
