"""Top N items within every group, by descending score bands.

1. Quantiles of the score over all rows give the bounds of the bands.
2. Copies collapse to one row of (group, score, item), combined before the
   shuffle, and the rows are written range-partitioned by band.
3. From the top band down: the rows of groups that higher bands have filled are
   anti-joined away first, and only what is left is ranked, so a group's items
   below the band in which it fills are read once and never ranked. Groups
   without their N after a band go on to the next.
4. The items that the bands kept, at most N a group and band, get their place.

The ranking of a band is first per (group, salt), with Spark's group limit
cutting each task's output to N rows a group and salt before the shuffle, then
per group: of a group with millions of items at most ``salts * n`` rows meet in
its last task. The anti-join's looked-up side has one row a group, so a hot
group skews only the other side, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import drop_settled, settle


def _best(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("s").desc(), F.col("i"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def _band(rows: DataFrame, shares: Sequence[float]) -> tuple[Column, int]:
    """The number of a score's band, 0 the highest, and how many bands there are."""
    cuts = rows.agg(F.percentile_approx("s", [1.0 - x for x in sorted(shares)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    number = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("s") >= cut, k).otherwise(number)
    return number, len(cuts) + 1


def top_per_group(df: DataFrame, group: str, score: str, item: str, n: int, *, shares: Sequence[float] = (1 / 64, 1 / 8), salts: int = 16) -> DataFrame:
    """``group, item, score, pick_no`` of the ``n`` highest scores of every group, ``pick_no`` from 1.

    Equal scores are placed by smaller item. Rows with a null group, score or
    item are no candidates; rows equal in all three are copies of one. Groups
    with fewer items keep all. Output columns carry the input's names; other
    columns are not read. ``shares`` are the parts of all rows above each band
    cut; they change the work, never the result.
    """
    if "pick_no" in (group, score, item):
        raise ValueError("a column must not be named pick_no")
    rows = df.select(df[group].alias("g"), df[score].alias("s"), df[item].alias("i")).dropna()
    band, bands = _band(rows, shares)
    spread = settle(rows.distinct().withColumn("band", band), "bands", parts="band")
    held: list[DataFrame] = []
    for k in range(bands):
        left = spread.where(F.col("band") == k).drop("band")
        if held:
            filled = reduce(DataFrame.unionByName, held).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)
            left = left.join(filled.select("g"), "g", "left_anti")
        salted = left.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)))
        held.append(settle(_best(_best(salted, ["g", "salt"], n).drop("salt"), ["g"], n), "band"))
    order = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i"))
    ranked = reduce(DataFrame.unionByName, held).withColumn("pick_no", F.row_number().over(order)).where(F.col("pick_no") <= n)
    out = settle(ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "pick_no"), "top")
    drop_settled(spread, *held)
    return out
