"""Qualities, probabilities and saturation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The highest probability stated of a call, and the bounds of a quality character.
MAX_PROB = 0.99999999999
LOW_CHAR, HIGH_CHAR = 33, 73
_EDGE = 1e-9


def quals(qual: Column) -> Column:
    """Phred values of a quality string (Phred+33)."""
    return F.when(F.length(qual) > 0, F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)).when(qual.isNotNull(), F.array().cast("array<int>"))


def mean_qual(qual: Column) -> Column:
    """Mean Phred value; null of an empty string."""
    values = quals(qual)
    return F.aggregate(values, F.lit(0), lambda a, q: a + q) / F.nullif(F.size(values), F.lit(0))


def error_prob(phred: Column) -> Column:
    """The error probability a Phred value stands for."""
    return F.pow(F.lit(10.0), -phred / 10)


def phred_of(correct: Column) -> Column:
    """The Phred value of a probability of being correct."""
    return -10 * F.log10(1 - correct)


def bounded(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def phred_char(phred: Column) -> Column:
    """A quality character, within bounds; the fraction is cut off."""
    return F.chr(F.floor(bounded(phred + 33, float(LOW_CHAR), float(HIGH_CHAR)) + _EDGE).cast("int"))


def prob_char(correct: Column) -> Column:
    """The quality character of a probability of being correct."""
    return phred_char(phred_of(bounded(correct, 0.0, MAX_PROB)))


def saturation_corrected(seen: Column, nt: int) -> Column:
    """Molecules behind ``seen`` distinct UMIs of ``nt`` bases, by the Poisson occupancy of the 4^nt UMIs; never fewer than seen."""
    all_ = float(4**nt)
    share = F.least(seen.cast("double"), F.lit(all_ - 1)) / F.lit(all_)
    return F.greatest(seen.cast("long"), F.round(-F.lit(all_) * F.ln(1 - share)).cast("long"))


def binom_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of a binomial, by the recurrence of log terms; 1 for p = 0, and for k >= n.

    Terms are added within one row; for large ``k`` the row's work is linear in k.
    """
    start = F.struct((n * F.log1p(-p)).cast("double").alias("term"), F.exp(n * F.log1p(-p)).cast("double").alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.ln((n - i + 1) / i) + F.ln(p) - F.log1p(-p)
        return F.struct(term.cast("double").alias("term"), (acc["sum"] + F.exp(term)).cast("double").alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    body = F.least(F.aggregate(terms, start, step)["sum"], F.lit(1.0))
    return F.when(k < 0, 0.0).when((k >= n) | (p <= 0), 1.0).when(p >= 1, 0.0).otherwise(body)
