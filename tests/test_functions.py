"""Sequence, CIGAR, flag, quality and alignment functions."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.functions import flags as G
from strandloom.functions import prob as P
from strandloom.functions import seq as S
from strandloom.functions.align import locate, locate_many


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over text columns a, b, c."""

    def run(column, *texts):
        names = ["a", "b", "c"][: len(texts)]
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names)) if texts else spark.range(1)
        return df.select(column.alias("x")).first().x

    return run


def test_complements(one):
    assert one(S.reverse_complement(F.col("a")), "ACTGNacRY") == "DBgtNCAGT"
    assert one(S.complement(F.col("a")), "AC-GT*") == "TG-CA*"
    assert one(S.complement(F.col("a")), None) is None


def test_distances_and_kmers(one):
    assert one(S.hamming(F.col("a"), F.col("b")), "ACGT", "AGGA") == 2
    assert one(S.hamming(F.col("a"), F.col("b")), "", "") == 0
    with pytest.raises(PySparkException):
        one(S.hamming(F.col("a"), F.col("b")), "ACG", "AC")
    assert one(S.levenshtein(F.col("a"), F.col("b")), "ACGT", "AGT") == 1
    assert one(S.kmers(F.col("a"), 3), "ACTGA") == ["ACT", "CTG", "TGA"]
    assert one(S.kmers(F.col("a"), 6), "ACTGA") == []
    assert [(x.start, x.end) for x in one(S.slices(F.lit(7), 3))] == [(0, 3), (3, 5), (5, 7)]
    assert one(S.subseq(F.col("a"), 1, 3), "ACGT") == "CG"
    with pytest.raises(PySparkException):
        one(S.subseq(F.col("a"), 1, 9), "ACGT")


def test_iupac(one):
    assert one(S.degenerate_codes(F.col("a")), "ACTGYN") == ["N", "Y"]
    assert one(S.iupac_expansions(F.col("a")), "ACTGN") == ["ACTGA", "ACTGC", "ACTGG", "ACTGT"]
    assert len(one(S.iupac_expansions(F.col("a")), "NN")) == 4
    assert len(one(S.iupac_expansions(F.col("a"), independent=True), "NN")) == 16
    assert one(S.iupac_expansions(F.col("a")), "RY") == ["AC", "AT", "GC", "GT"]
    assert one(S.prefix_matches(F.col("a"), F.col("b"), wildcards=True), "ANGT", "ACRA") == 3
    assert one(S.prefix_matches(F.col("a"), F.col("b")), "ACGT", "ACCTTT") == 3


def test_one_hot(one):
    m = S.one_hot(F.col("a"), "ACGT")
    assert one(m, "CA") == [[0.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    assert one(S.one_hot_decode(m, "ACGT"), "AAACTTTG") == "AAACTTTG"
    with pytest.raises(PySparkException):
        one(m, "ACGX")


def test_natural_order(spark):
    names = ["A10", "A1", "A20", "A2", "B", "A002", "A1b"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n")), "n").collect()]
    assert got == ["A1", "A1b", "A002", "A2", "A10", "A20", "B"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from("MIDNSHP=X")), min_size=1, max_size=8))
def test_cigars_equal_plain_python(spark, ops):
    text = "".join(f"{n}{o}" for n, o in ops)
    q, r, want = 0, 100, []
    for n, o in ops:
        if o in "M=X":
            want.append((q, r, n))
        q += n * (o in "MIS=X")
        r += n * (o in "MDN=X")
    c = F.lit(text)
    row = spark.range(1).select(C.aligned_blocks(c, F.lit(100)).alias("b"), C.reference_length(c).alias("r"), C.query_length(c).alias("q"), C.expand(c).alias("e"), C.clipped(c).alias("s"), C.longest_clip(c).alias("l")).first()
    assert [tuple(b) for b in row.b] == want
    assert (row.r, row.q) == (r - 100, q)
    assert row.e == "".join(o * n for n, o in ops if o in "MIS")
    clips = [n for n, o in ops if o == "S"]
    assert (row.s, row.l) == (sum(clips), max(clips, default=1))


def test_cigar_values(one):
    assert one(C.expand(F.col("a")), "3S5M1I3M") == "SSSMMMMMIMMM"
    assert one(C.without_insertions(F.col("a"), F.col("b")), "ACGTAC", "MMIMMM") == "ACTAC"
    assert one(C.aligned_end(F.col("a"), F.lit(10)), "2S3M2D4M5S") == 19


def test_flags(one):
    lit = F.lit
    assert one(G.concordant_pair(lit(99), lit(147))) and not one(G.concordant_pair(lit(147), lit(99)))
    assert [one(G.strand(lit(f), "fr")) for f in (99, 147, 83, 163)] == ["+", "+", "-", "-"]
    assert [one(G.strand(lit(f), "rf")) for f in (99, 147, 83, 163)] == ["-", "-", "+", "+"]
    assert one(G.regular_chrom(lit("chrX"))) and not one(G.regular_chrom(lit("chrM")))
    assert one(G.ribosomal_or_mitochondrial(lit("MT-TF")))
    assert one(G.clustered(lit(1123))) and not one(G.concordant(lit(1123)))


def test_qualities(one):
    assert one(P.prob_char(F.lit(P.MAX_PROB))) == "I"
    assert one(P.prob_char(F.lit(0.0))) == "!"
    assert one(P.prob_char(F.lit(0.8))) == "'"
    assert one(P.quals(F.col("a")), "!+I") == [0, 10, 40]
    assert one(P.mean_qual(F.col("a")), "!I") == 20
    assert one(P.saturation_corrected(F.lit(52), 3)) == 107
    assert one(P.saturation_corrected(F.lit(64), 3)) == 266
    want = sum(math.comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(6))
    assert one(P.binom_cdf(F.lit(5), F.lit(20), F.lit(0.3))) == pytest.approx(want)
    assert one(P.binom_cdf(F.lit(20), F.lit(20), F.lit(0.3))) == 1 and one(P.binom_cdf(F.lit(-1), F.lit(20), F.lit(0.3))) == 0


def plain_locate(ref, query, rate, min_overlap=1):
    """The alignment in plain cells: (cost, matches, origin) by ref row and query column."""
    m, n = len(ref), len(query)
    column = [(0, 0, -i) for i in range(m + 1)]
    best = None
    for j in range(1, n + 1):
        new = [(0, 0, j)]
        for i in range(1, m + 1):
            if ref[i - 1] == query[j - 1]:
                c, h, o = column[i - 1]
                new.append((c, h + 1, o))
            else:
                options = [(column[i - 1][0] + 1, 0, column[i - 1]), (new[i - 1][0] + 1, 1, new[i - 1]), (column[i][0] + 1, 2, column[i])]
                cost, _, source = min(options, key=lambda x: x[:2])
                new.append((cost, source[1], source[2]))
        column = new
        c, h, o = column[m]
        if c <= int(rate * m):
            best = better(best, c, h, o, m, j, rate, min_overlap)
    for i in range(m + 1):
        c, h, o = column[i]
        best = better(best, c, h, o, i, n, rate, min_overlap)
    if best is None:
        return None
    c, h, o, re, qe = best
    return (max(-o, 0), re, max(o, 0), qe, h, c)


def better(best, c, h, o, re, qe, rate, min_overlap):
    length = re + min(o, 0)
    if length >= min_overlap and c <= length * rate and (h > (best[1] if best else 0) or best and h == best[1] and c < best[0]):
        return (c, h, o, re, qe)
    return best


def test_locate_equals_plain_cells():
    rng = random.Random(1)
    refs, queries = [], []
    for _ in range(600):
        ref = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 30)))
        query = ref[rng.randrange(len(ref)) :] + "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 12)))
        query = "".join(c if rng.random() > 0.05 else rng.choice("ACGT") for c in query)
        refs.append(ref)
        queries.append(query)
    for rate in (0.1, 0.2):
        assert locate_many(refs, queries, rate) == [plain_locate(r, q, rate) for r, q in zip(refs, queries)]


def test_locate_column(spark):
    df = spark.createDataFrame([("ACGT", "TTTT"), ("A" * 20 + "CCGG", "CCGGT" * 3), (None, "A"), ("", "A"), ("ACNT", "ACGT")], "r string, q string")
    rows = df.select(locate(F.col("r"), F.col("q"), 0.1).alias("x"), locate(F.col("r"), F.col("q"), 0.1, wildcards=True).alias("w")).collect()
    assert tuple(rows[0].x) == (3, 4, 0, 1, 1, 0)
    assert tuple(rows[1].x) == (20, 24, 0, 4, 4, 0)
    assert rows[2].x is None and rows[3].x is None
    assert tuple(rows[4].w) == (0, 4, 0, 4, 4, 0)
