"""Covered periods and gaps of intervals.

Plan: three shuffles, each smaller than the one before.

1. ``max(end)`` for each distinct start within a tile of the axis, combined
   before the shuffle. However many rows one key holds, a tile keeps at most
   ``tile`` rows of it.
2. ``session_window`` over each tile, every row with its own duration.
3. ``session_window`` over each key, on the tiles' periods only: disjoint
   periods of one axis number at most half its length, whatever the row count.

Touching periods are then joined with ``lag`` and gaps read off with ``lead``
on the partitioning of step 3, without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions become microseconds; a duration is hours (int) and seconds, so an axis may reach this far.
AXIS_END = 7_000_000_000_000_000_000
_HOUR = 3_600_000_000


def _duration(length: Column) -> Column:
    hours = F.floor(length / F.lit(_HOUR)).cast("int")
    rest = length - hours.cast("long") * _HOUR
    return F.make_interval(hours=hours, secs=(rest.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def _sessions(df: DataFrame, by: list[str]) -> DataFrame:
    window = F.session_window(F.timestamp_micros("s"), _duration(F.col("e") - F.col("s")))
    return df.groupBy(*by, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.unix_micros("w.start").alias("s"), F.unix_micros("w.end").alias("e"))


def _positional(df: DataFrame, keys: Sequence[str], start: str, end: str, tile: int) -> tuple[DataFrame, list[str]]:
    """Valid rows as k0.. s e: no other column of the input can clash."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[df[k].alias(n) for k, n in zip(keys, names)], df[start].cast("long").alias("s"), df[end].cast("long").alias("e"))
    rows = rows.where((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= AXIS_END))
    return rows.withColumn("tile", F.floor(F.col("s") / F.lit(tile))), names


def covered_periods(df: DataFrame, keys: Sequence[str], start: str = "start_pos", end: str = "end_pos", *, tile: int = 1 << 17) -> DataFrame:
    """Continuous periods covered by half-open intervals, as ``keys..., seg_start, seg_end``.

    Overlapping, nested and touching intervals are one period. Rows with a null
    coordinate, a negative start, an end not after its start or an end beyond
    ``AXIS_END`` cover nothing. Null keys form a group of their own. Repeated
    rows change nothing; an empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    if {"seg_start", "seg_end", "seg_kind", "seg_next"} & set(keys):
        raise ValueError("a key must not be named seg_start, seg_end, seg_kind or seg_next")
    rows, names = _positional(df, keys, start, end, tile)
    longest = rows.groupBy(*names, "tile", "s").agg(F.max("e").alias("e"))
    merged = _sessions(_sessions(longest, [*names, "tile"]).drop("tile"), names)
    order = Window.partitionBy(*names).orderBy("s")
    # Tells touching periods apart on no assumption about how the session merge treats equal bounds.
    island = F.sum((F.col("s") > F.coalesce(F.lag("e").over(order), F.lit(-1))).cast("long")).over(order)
    joined = merged.withColumn("island", island).groupBy(*names, "island").agg(F.min("s").alias("seg_start"), F.max("e").alias("seg_end"))
    return joined.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "seg_start", "seg_end")


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str = "start_pos", end: str = "end_pos", *, tile: int = 1 << 17) -> DataFrame:
    """:func:`covered_periods` with the gaps between them: ``keys..., seg_kind, seg_start, seg_end``.

    ``seg_kind`` is ``covered`` or ``gap``. A gap reaches from the end of one
    period to the start of the next of the same keys; nothing before the first
    or after the last period is a gap.
    """
    order = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("seg_start")
    periods = covered_periods(df, keys, start, end, tile=tile).withColumn("seg_next", F.lead("seg_start").over(order))
    both = F.array(
        F.struct(F.lit("covered").alias("seg_kind"), F.col("seg_start").alias("a"), F.col("seg_end").alias("b")),
        F.struct(F.lit("gap").alias("seg_kind"), F.col("seg_end").alias("a"), F.col("seg_next").alias("b")),
    )
    out = periods.select(*[F.col(k) for k in keys], F.explode(both).alias("seg"))
    return out.where(F.col("seg.b").isNotNull()).select(*keys, "seg.seg_kind", F.col("seg.a").alias("seg_start"), F.col("seg.b").alias("seg_end"))
