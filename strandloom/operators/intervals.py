"""Interval overlap as an equi-join on bins.

Both sides explode over the bins they touch and meet on (keys, bin); the exact
overlap is checked on the joined rows, and a pair that shares several bins is
kept only in the first of them, so nothing needs to be made distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of this many places: wide enough that fragments touch one or two, narrow enough to spread a chromosome.
BIN = 1 << 14


def _binned(df: DataFrame, keys: Sequence[str], start: str, end: str, side: str, width: int) -> DataFrame:
    valid = df.where(F.col(start).isNotNull() & (F.col(start) < F.col(end)))
    first, last = F.floor(F.col(start) / F.lit(width)).cast("long"), F.floor((F.col(end) - 1) / F.lit(width)).cast("long")
    return valid.select(F.struct(*df.columns).alias(side), *[F.col(k).alias(f"{side}_{i}") for i, k in enumerate(keys)], F.col(start).alias(f"{side}_s"), F.col(end).alias(f"{side}_e"), first.alias(f"{side}_b"), F.explode(F.sequence(first, last)).alias(f"{side}_bin"))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"), width: int = BIN) -> DataFrame:
    """Every pair of rows with equal ``keys`` and overlapping half-open spans, as structs ``l`` and ``r``.

    Empty, reversed and null spans overlap nothing; null keys match nothing.
    """
    a, b = _binned(left, keys, *left_span, "l", width), _binned(right, keys, *right_span, "r", width)
    same = [F.col(f"l_{i}") == F.col(f"r_{i}") for i in range(len(keys))]
    joined = a.join(b, [*same, F.col("l_bin") == F.col("r_bin"), F.col("l_s") < F.col("r_e"), F.col("r_s") < F.col("l_e"), F.col("l_bin") == F.greatest("l_b", "r_b")])
    return joined.select("l", "r")


def overlapping_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"), width: int = BIN) -> DataFrame:
    """The rows of ``left`` that overlap any row of ``right``, as often as they stand there.

    The spans of ``right`` are merged first, so that however many rows pile up
    on one place, a bin holds disjoint spans only.
    """
    from strandloom.operators.periods import covered_periods

    merged = covered_periods(right, list(keys), *right_span)
    a = _binned(left.withColumn("row__", F.monotonically_increasing_id()), keys, *left_span, "l", width)
    b = _binned(merged, keys, "seg_start", "seg_end", "r", width)
    same = [F.col(f"l_{i}") == F.col(f"r_{i}") for i in range(len(keys))]
    hits = a.join(b, [*same, F.col("l_bin") == F.col("r_bin"), F.col("l_s") < F.col("r_e"), F.col("r_s") < F.col("l_e")], "left_semi")
    return hits.select("l.*").dropDuplicates(["row__"]).drop("row__")
