"""One surviving record for each duplicate group, field by field, and the truth of disputed values.

:func:`best_fields` applies stated orders: for each field the records that will
do, and what makes one better. It is one aggregation of maxima over structs,
combined before its only shuffle, so a group of any size costs a task a few
rows; copies of a record change no maximum.

:func:`infer_truth` is for values without a stated order: a latent two-sided
quality model. Every source has a sensitivity (it asserts what is true) and a
specificity (it withholds what is false); expectation-maximisation infers both
with the probability of each value, and several values of an entity may be
true. It never forms values x sources within an entity: sources that cover an
entity without asserting a value enter through one sum an entity.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import drop_settled, settle

#: What stands for a missing value, in lower case.
MISSING = ("", "na", "n/a", "none", "unknown", "-", "\N{EN DASH}", "\N{EM DASH}")


def missing(value: Column) -> Column:
    """Whether a text is null, blank or one of ``MISSING`` in any case."""
    return value.isNull() | F.lower(F.regexp_replace(value, r"\A\s+|\s+\z", "")).isin(*MISSING)


def phred_sum(qual: Column) -> Column:
    """The sum of the Phred values of a quality string (Phred+33)."""
    return F.aggregate(F.split(qual, ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c)) - F.length(qual).cast("long") * 33


@dataclass(frozen=True)
class FieldRule:
    """``fits``: whether a record can supply the field; ``better``: what to prefer, largest first; ``takes``: columns it supplies."""

    fits: Column
    better: Sequence[Column] = field(default_factory=tuple)
    takes: Sequence[str] = field(default_factory=tuple)


def _choices(df: DataFrame, keys: Sequence[str], record: str, rules: Mapping[str, FieldRule], least: int) -> DataFrame:
    """A row a group of ``least`` or more records: keys, and per rule a struct of the chosen record and what it supplies."""
    picks = []
    for name, rule in rules.items():
        order = [c.alias(f"o{i}") for i, c in enumerate(rule.better)]
        # ~x falls as x rises, without overflow: the smallest record wins a tie.
        supplied = [F.col(c).alias(f"t{i}") for i, c in enumerate(rule.takes)]
        picks.append(F.max(F.when(rule.fits, F.struct(*order, F.bitwise_not(F.col(record)).alias("tie"), *supplied))).alias(f"pick__{name}"))
    several = [F.min(record).alias("low__"), F.max(record).alias("high__")]
    grouped = df.groupBy(*keys).agg(*several, *picks)
    return grouped if least < 2 else grouped.where(F.col("low__") != F.col("high__"))


def best_fields(df: DataFrame, keys: Sequence[str], record: str, rules: Mapping[str, FieldRule], *, least: int = 2) -> DataFrame:
    """``keys..., field_name, record``: the record that supplies each field of each group of ``least`` (1 or 2) or more records.

    ``record`` is a unique whole number; rows of one record are copies of it.
    Equals are decided by the smallest record. Nulls in ``better`` lose to any
    value. Groups with a null key are left out. A field for which no record
    will do gives no row.
    """
    full = df.dropna(subset=[*keys, record])
    found = _choices(full, keys, record, rules, least)
    each = F.array(*[F.struct(F.lit(n).alias("field_name"), F.bitwise_not(F.col(f"pick__{n}.tie")).alias(record)) for n in rules])
    out = found.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
    return out.where(F.col(record).isNotNull())


def built_records(df: DataFrame, keys: Sequence[str], record: str, rules: Mapping[str, FieldRule], *, least: int = 1) -> DataFrame:
    """One built record a group: ``keys..., first_<record>`` (its smallest record) and every supplied column, each from its best record."""
    full = df.dropna(subset=[*keys, record])
    found = _choices(full, keys, record, rules, least)
    columns = [F.col(f"pick__{n}.t{i}").alias(c) for n, r in rules.items() for i, c in enumerate(r.takes)]
    return found.select(*keys, F.col("low__").alias(f"first_{record}"), *columns)


def infer_truth(df: DataFrame, entity: Sequence[str], source: str, value: str, *, tolerance: float = 0.01, most_rounds: int = 1000, prior: float = 0.5, keep: float = 0.5) -> DataFrame:
    """``entity..., value, n_sources, p_true, kept, em_rounds, em_change``: how likely each asserted value is true, and whether it stays.

    A claim is a distinct (entity, source, value); rows with a null in any of
    them claim nothing. Sources start alike; counts behind sensitivity and
    specificity are smoothed by a few pseudo-claims. An entity keeps every
    value of ``p_true`` at least ``keep``, and always its likeliest (ties by
    value). EM rounds are run until none changes any ``p_true`` by more than
    ``tolerance``; ``em_rounds`` and ``em_change`` say how many that took and
    what the last one changed. More than ``most_rounds`` raise.
    """
    names = [f"e{i}" for i in range(len(entity))]
    cols = [df[c].alias(n) for c, n in zip(entity, names)]
    claims = df.select(*cols, df[source].cast("string").alias("src"), df[value].alias("val")).dropna()
    claims = settle(claims.distinct(), "claims")
    covers = settle(claims.select(*names, "src").distinct(), "covers")
    votes = claims.groupBy(*names, "val").agg(F.count(F.lit(1)).alias("n"))
    sources = covers.groupBy(*names).agg(F.count(F.lit(1)).alias("m"))
    facts = settle(votes.join(sources, names).select(*names, "val", "n", F.least(F.lit(0.95), (F.col("n") + 0.5) / (F.col("m") + 1)).alias("p")), "facts")
    change, rounds = math.inf, 0
    while change > tolerance:
        if rounds == most_rounds:
            raise RuntimeError(f"{rounds} rounds have left a change of {change}")
        # Of each source: truth and falsehood it asserted, and all truth and falsehood of the entities it covers.
        asserted = claims.join(facts.select(*names, "val", "p"), [*names, "val"]).groupBy("src").agg(F.sum("p").alias("ta"), F.sum(1 - F.col("p")).alias("fa"))
        mass = facts.groupBy(*names).agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"))
        covered = covers.join(mass, names).groupBy("src").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
        quality = settle(
            covered.join(asserted, "src").select(
                "src",
                ((F.col("ta") + 2) / (F.col("t") + 4)).alias("sens"),
                ((F.col("f") - F.col("fa") + 4) / (F.col("f") + 5)).alias("spec"),
            ),
            "quality",
        )
        silent = F.ln((1 - F.col("sens")) / F.col("spec"))
        spoke = F.ln(F.col("sens") / (1 - F.col("spec"))) - silent
        # The looked-up side has one row a source; adaptive execution broadcasts it if measured small and splits hot sources otherwise.
        base = covers.join(quality.select("src", silent.alias("w")), "src").groupBy(*names).agg(F.sum("w").alias("base"))
        told = claims.join(quality.select("src", spoke.alias("w")), "src").groupBy(*names, "val").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
        odds = F.lit(prior / (1 - prior)) * F.exp(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("base") + F.col("w"))))
        last = facts.select(*names, "val", F.col("p").alias("last"))
        found = told.join(base, names).join(last, [*names, "val"])
        after = settle(found.select(*names, "val", "n", (odds / (1 + odds)).alias("p"), "last"), "facts")
        change, rounds = after.agg(F.max(F.abs(F.col("p") - F.col("last")))).first()[0] or 0.0, rounds + 1
        drop_settled(facts, quality)
        facts = after.drop("last")
        facts._settled_at = after._settled_at
    drop_settled(claims, covers)
    best = facts.groupBy(*names).agg(F.max_by("val", F.struct("p", "val")).alias("best"))
    out = facts.join(best, names)
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(entity, names)], F.col("val").alias(value), F.col("n").alias("n_sources"), F.col("p").alias("p_true"), ((F.col("p") >= keep) | (F.col("val") == F.col("best"))).alias("kept"),
        F.lit(rounds).alias("em_rounds"), F.lit(float(change)).alias("em_change"),
    )
