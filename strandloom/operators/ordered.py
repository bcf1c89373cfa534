"""Numbers that depend on the order of rows, without a task that holds a whole group.

Rows are range-partitioned by group and order, and each partition is worked
through on its own. What crosses a partition's bounds is one row a partition: a
broadcast of as many rows as there are partitions puts the pieces together. A
group may therefore hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import settle


def _ranged(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return settle(df.repartitionByRange(*by).withColumn("part__", F.spark_partition_id()), "ranged")


def places_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with a row number from 0 within ``keys`` by a total ``order``; null keys are a group of their own."""
    ranged = _ranged(df, [*keys, *order])
    inside = Window.partitionBy("part__", *keys).orderBy(*order)
    bounds = ranged.groupBy("part__").agg(F.min(F.struct(*keys)).alias("low__"), F.max(F.struct(*keys)).alias("high__"))
    # Only a partition's first group can have begun in an earlier one; of it, earlier partitions hold their last group.
    tails = ranged.join(F.broadcast(bounds), "part__").where(F.struct(*keys).eqNullSafe(F.col("high__"))).groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    ends = bounds.join(tails, "part__")
    earlier = ends.select(F.col("part__").alias("p__"), F.col("high__").alias("h__"), "n__")
    before = ends.select("part__", "low__").join(F.broadcast(earlier), (F.col("p__") < F.col("part__")) & F.col("h__").eqNullSafe(F.col("low__")))
    before = before.groupBy(F.col("part__").alias("p__"), "low__").agg(F.sum("n__").alias("before__"))
    rows = ranged.withColumn("place__", F.row_number().over(inside) - 1)
    rows = rows.join(F.broadcast(before), (F.col("part__") == F.col("p__")) & F.struct(*keys).eqNullSafe(F.col("low__")), "left")
    return rows.withColumn(name, F.col("place__") + F.coalesce("before__", F.lit(0))).drop("part__", "p__", "low__", "place__", "before__")


def run_numbers(df: DataFrame, order: Sequence[str], compared: Sequence[str], starts: Callable[[dict[str, Column], dict[str, Column]], Column], name: str) -> DataFrame:
    """``df`` with the number of its run, from 0 by a total ``order`` over all rows.

    ``starts`` gets the ``compared`` columns of a row and those of the row
    before it and says whether the row starts a run; the first row does, and so
    does one for which it says null.
    """
    ranged = _ranged(df, order)
    inside = Window.partitionBy("part__").orderBy(*order)
    mine = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(compared)])
    last = ranged.groupBy("part__").agg(F.max_by(mine, F.struct(*order)).alias("end__"))
    carried = last.select("part__", F.lag("end__").over(Window.orderBy("part__")).alias("carried__"))
    rows = ranged.withColumn("before__", F.lag(mine).over(inside)).join(F.broadcast(carried), "part__")
    rows = rows.withColumn("before__", F.coalesce("before__", "carried__"))
    new = starts({c: F.col(c) for c in compared}, {c: F.col("before__")[f"c{i}"] for i, c in enumerate(compared)})
    rows = settle(rows.withColumn("new__", F.when(F.col("before__").isNull() | F.coalesce(new, F.lit(True)), 1).otherwise(0)).drop("before__", "carried__"), "runs")
    sums = rows.groupBy("part__").agg(F.sum("new__").alias("n__"))
    offsets = sums.select("part__", (F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1).alias("offset__"))
    numbered = rows.withColumn("here__", F.sum("new__").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(offsets), "part__")
    return numbered.withColumn(name, F.col("here__") + F.col("offset__")).drop("part__", "new__", "here__", "offset__")
