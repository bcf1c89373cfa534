"""Structured Streaming forms of the stateless and counting operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from strandloom.functions.prob import saturation_corrected
from strandloom.sources.tables import SAM_HEADER, sam_columns


def sam_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Alignments of SAM files as they arrive in a folder."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return lines.where((F.length("value") > 0) & ~F.col("value").rlike(SAM_HEADER)).select(*sam_columns(F.col("value")))


def umi_counts_stream(fragments: DataFrame, keys: Sequence[str], umi: str, time: str, lateness: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Rows of each UMI at each place by window of event time; rows later than ``lateness`` are dropped by the watermark."""
    timed = fragments.withWatermark(time, lateness)
    return timed.groupBy(F.window(time, window).alias("during"), *keys, F.col(umi).alias("umi")).agg(F.count(F.lit(1)).alias("n"))


def saturation_stream(fragments: DataFrame, keys: Sequence[str], umi: str, nt: int, time: str, lateness: str = "1 hour", window: str = "1 hour", exact: bool = False) -> DataFrame:
    """Molecules behind the distinct UMIs of each place and window.

    The count of distinct UMIs is approximate (within 2 %), so that state does
    not hold every UMI seen. ``exact`` counts them all: state then has a row for
    each UMI of the windows still open, and a window comes out once when it
    closes (append mode).
    """
    if exact:
        each = umi_counts_stream(fragments, keys, umi, time, lateness, window).where(F.col("umi").isNotNull())
        seen = each.groupBy(F.window(F.window_time("during"), window).alias("during"), *keys).agg(F.count(F.lit(1)).alias("n_umi"))
    else:
        timed = fragments.withWatermark(time, lateness)
        seen = timed.groupBy(F.window(time, window).alias("during"), *keys).agg(F.approx_count_distinct(umi, 0.02).alias("n_umi"))
    return seen.withColumn("n_molecules", saturation_corrected(F.col("n_umi"), nt))


def tag_runs_stream(reads: DataFrame, source: str, order: str, tag: str, mismatches: int = 1) -> DataFrame:
    """Runs of near tags across micro-batches: ``source, order, tag, run``, with the run's first tag as the state of each source.

    Rows of a source are taken in ``order`` within each micro-batch; batches
    must arrive in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}
    output = f"`{source}` {kinds[source]}, `{order}` {kinds[order]}, `{tag}` string, run long"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, run = state.get if state.exists else (None, -1)
        rows = pd.concat(list(frames)).sort_values(order)
        runs = []
        for t in rows[tag]:
            if not (t is not None and first is not None and len(t) == len(first) and sum(x != y for x, y in zip(t, first)) <= mismatches):
                first, run = t, run + 1
            runs.append(run)
        state.update((first, run))
        yield rows[[source, order, tag]].assign(run=runs)

    state = StructType().add("first", "string").add("run", "long")
    return reads.select(source, order, tag).groupBy(source).applyInPandasWithState(fold, output, state, "append", GroupStateTimeout.NoTimeout)
