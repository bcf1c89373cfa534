"""Statistics: multiple testing, normalisation, correlation, regression, resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.umi import number_rows
from strandloom.session import settle


def adjusted_p(df: DataFrame, p: str, out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg: ``df`` with ``out``; null and NaN count as 1, ties share a value.

    Distinct values sort in range partitions. Ranks come from the partitions'
    counts and the running minimum from their minima, one row a partition, so
    no task sorts everything.
    """
    value = F.coalesce(F.nanvl(F.col(p).cast("double"), F.lit(1.0)), F.lit(1.0))
    counts = df.groupBy(value.alias("p__")).agg(F.count(F.lit(1)).alias("n__"))
    ranged = settle(counts.repartitionByRange("p__").withColumn("part__", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part__").agg(F.sum("n__").alias("m__"))
    one_row_each = Window.orderBy("part__")
    total = sizes.agg(F.sum("m__")).first()[0] or 0
    before = sizes.select("part__", F.coalesce(F.sum("m__").over(one_row_each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    inside = Window.partitionBy("part__").orderBy("p__")
    ranked = ranged.join(F.broadcast(before), "part__").withColumn("rank__", F.col("before__") + F.sum("n__").over(inside))
    ranked = ranked.withColumn("q__", F.col("p__") * F.lit(float(total)) / F.col("rank__"))
    ranked = settle(ranked, "ranked")
    lows = ranked.groupBy("part__").agg(F.min("q__").alias("low__"))
    after = lows.select("part__", F.min("low__").over(one_row_each.rowsBetween(1, Window.unboundedFollowing)).alias("after__"))
    back = Window.partitionBy("part__").orderBy(F.col("p__").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = ranked.join(F.broadcast(after), "part__").select("p__", F.least(F.lit(1.0), F.min("q__").over(back), F.coalesce("after__", F.lit(1.0))).alias(out))
    return df.withColumn("p__", value).join(done, "p__").drop("p__")


def size_factors(counts: DataFrame, gene: str, sample: str, count: str) -> DataFrame:
    """``sample, size_factor``: the median over genes of each count against the gene's geometric mean.

    Genes with a zero, a null or no count in some sample have no geometric mean
    and are left out. Sample medians are exact; they hold one value a gene.
    """
    samples = counts.select(sample).distinct().count()
    gene_means = counts.groupBy(gene).agg(F.avg(F.ln(count)).alias("mean__"), F.count(F.when(F.col(count) > 0, 1)).alias("n__")).where(F.col("n__") == samples)
    ratios = counts.join(gene_means, gene).withColumn("ratio__", F.ln(count) - F.col("mean__"))
    return ratios.groupBy(sample).agg(F.exp(F.percentile("ratio__", 0.5)).alias("size_factor"))


def normalized_counts(counts: DataFrame, gene: str, sample: str, count: str) -> DataFrame:
    """``counts`` with ``normalized``: each count over its sample's size factor. Size factors have one row a sample."""
    return counts.join(size_factors(counts, gene, sample, count), sample).withColumn("normalized", F.col(count) / F.col("size_factor")).drop("size_factor")


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """``a, b, r`` of all pairs of columns, from one aggregation; ``spearman`` correlates average ranks."""
    if method == "spearman":
        ranked = df.select(*columns)
        for c in columns:
            ranked = _with_average_rank(ranked, c)
        df = ranked
    elif method != "pearson":
        raise ValueError("method must be pearson or spearman")
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(each).alias("x")).select("x.*")


def _with_average_rank(df: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its average rank; values are counted first and numbered without one big sort."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v__")).agg(F.count(F.lit(1)).alias("c__"))
    ranged = settle(counts.repartitionByRange("v__").withColumn("part__", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part__").agg(F.sum("c__").alias("m__"))
    before = sizes.select("part__", F.coalesce(F.sum("m__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b__"))
    up_to = F.sum("c__").over(Window.partitionBy("part__").orderBy("v__"))
    ranks = ranged.join(F.broadcast(before), "part__").select("v__", (F.col("b__") + up_to - (F.col("c__") - 1) / 2).alias("r__"))
    return df.join(ranks, F.col(column) == F.col("v__"), "left").drop("v__", column).withColumnRenamed("r__", column)


def least_squares(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``feature, beta`` of the linear model without intercept: one pass sums the normal equations, the driver solves them.

    Rows with a null are left out. The sums are as many as pairs of features.
    """
    a, b, _, _ = _normal_sums(df, features, target)
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    return df.sparkSession.createDataFrame([(f, float(x)) for f, x in zip(features, beta)], "feature string, beta double")


def _normal_sums(df: DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums of products of the features with each other and with the target, of the target's squares, and the number of rows without a null."""
    cols = [*features, target]
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    k = len(features)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    whole = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        whole[i, j] = whole[j, i] = sums[f"s{i}_{j}"] or 0.0
    return whole[:k, :k], whole[:k, k], float(whole[k, k]), sums.n


def gradient_descent(df: DataFrame, features: Sequence[str], target: str, *, rate: float = 0.1, rounds: int = 1000, limit: float = 0.0, patience: int = 5) -> DataFrame:
    """``round, cost, betas``: a linear model without intercept, step by step from 0, with its error after each step.

    ``cost`` is the root of the mean squared residual. Steps go ``rate`` times
    down the mean gradient; they end after ``rounds``, or once ``patience`` of
    them in a row have changed the cost by less than ``limit``. The rows are
    read once: error and gradient follow from the sums of the normal equations,
    as many as pairs of columns, so that rounds cost nothing. Rows with a null
    are left out; without a row there is no step.
    """
    a, b, c, n = _normal_sums(df, features, target)
    beta, last, still, history = np.zeros(len(features)), np.inf, 0, []
    for k in range(1, rounds + 1 if n else 1):
        beta = beta - rate * (a @ beta - b) / n
        cost = float(np.sqrt(max(0.0, beta @ a @ beta - 2 * b @ beta + c) / n))
        history.append((k, cost, [float(x) for x in beta]))
        still = still + 1 if abs(last - cost) < limit else 0
        last = cost
        if still >= patience:
            break
    return df.sparkSession.createDataFrame(history, "round int, cost double, betas array<double>")


def bootstrap_places(spark, size: int, group_size: int, rounds: int, seed: int = 0) -> DataFrame:  # noqa: ANN001
    """``round, nth, place``: ``rounds`` draws with replacement of ``group_size`` places below ``size``, by hash, the same in every run."""
    if group_size > size:
        raise ValueError("a group can't be larger than the rows")
    draws = spark.range(rounds * group_size).select(F.expr(f"id div {group_size}").alias("round"), (F.col("id") % group_size).alias("nth"))
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("round").cast("string"), F.col("nth").cast("string")))
    return draws.withColumn("place", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size))


def bootstrap_means(df: DataFrame, value: str, order: Sequence[str], group_size: int, rounds: int, seed: int = 0) -> DataFrame:
    """``round, mean`` of resampled values; rows are numbered by a total ``order`` without a global window."""
    rows = number_rows(df.select(*dict.fromkeys([*order, value])).where(F.col(value).isNotNull()), list(order), "place")
    size = rows.count()
    drawn = bootstrap_places(df.sparkSession, size, group_size, rounds, seed)
    return drawn.join(rows, "place").groupBy("round").agg(F.avg(value).alias("mean"))


def modes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys..., mode``: the commonest value, the largest among equals."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n__"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n__", value)).alias("m__")).select(*keys, F.col(f"m__.{value}").alias("mode"))


def membership_counts(df: DataFrame, ident: str, member: str, names: Sequence[str], count: str = "n") -> DataFrame:
    """How many ids belong to each combination of ``names``: a 0/1 column a name and ``count``."""
    held = df.groupBy(ident).agg(*[F.max((F.col(member) == m).cast("int")).alias(f"f{i}__") for i, m in enumerate(names)])
    counted = held.groupBy(*[f"f{i}__" for i in range(len(names))]).agg(F.count(F.lit(1)).alias(count))
    return counted.select(*[F.col(f"f{i}__").alias(m) for i, m in enumerate(names)], count)


def color_codes(df: DataFrame, category: str, order: str, colors: Sequence[str]) -> DataFrame:
    """``category, color``: categories in the order they first appear, one colour each; raises where colours run out.

    Their number is bounded by the colours, which is checked before they meet
    in one window.
    """
    first = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.min(order).alias("o__"))
    if first.limit(len(colors) + 1).count() > len(colors):
        raise ValueError("there are more categories than colours")
    place = F.row_number().over(Window.orderBy("o__", category))
    return first.select(category, F.element_at(F.array(*[F.lit(c) for c in colors]), place).alias("color"))


def unseen_categories(df: DataFrame, codes: DataFrame, category: str) -> DataFrame:
    """Categories of ``df`` that have no code."""
    return df.select(category).distinct().join(codes, category, "left_anti")


# Named colour lists.
PALETTES = {
    "douglas": ("#B98476", "#6297B6", "#BF7F8E", "#8E955A", "#6F94B9", "#579F79", "#3C9F9D", "#EDAEB5", "#B0BDEA", "#D8BA90", "#7BCBD5", "#87CDA9", "#B1C68D", "#E7C039"),
    "maximum": ("#f58231", "#e6194b", "#3cb44b", "#ffe119", "#4363d8", "#911eb4", "#03A8FB", "#F8BF6C", "#CAF5CB", "#fabebe", "#008080", "#e6beff", "#9a6324", "#fffac8", "#800000", "#aaffc3", "#808000", "#ffd8b1", "#000075", "#808080", "#ffffff", "#000000"),
    "simpsons": ("#FED439", "#709AE1", "#8A9197", "#D2AF81", "#FD7446", "#D5E4A2", "#197EC0", "#F05C3B", "#46732E", "#71D0F5", "#370335", "#075149", "#C80813", "#91331F", "#1A9993", "#FD8CC1"),
    "okabeito": ("#E69F00", "#56B4E9", "#009E73", "#F0E442", "#0072B2", "#D55E00", "#CC79A7", "#999999"),
}
