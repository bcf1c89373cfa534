"""Texts into containers of fixed capacity: best fit under conflicts, in shards of bounded size.

Texts spread by hash over shards of a few thousand containers; one sum over the
corpus sets how many. A shard is packed by best-fit decreasing: bins sit in an
array by residual room, a bitmap over residuals finds the successor of a size
in one step, and the search goes on to the next residual until a bin is
compatible. Each residual, duplicate cluster and source carries a bitmap of its
bins, so one operation looks at all bins of a residual.

What conflicts: two copies of a text, and two texts of one lot of a source. A
cluster or source with more items than its shard needs bins can't be kept apart
altogether, so its items, by falling size, form lots of as many as there are
bins needed, and each lot conflicts in itself: every bin gets one of a lot, so
bins mix sources as evenly as they can and only surplus copies share bins.
Among compatible bins of equal room one without the source is taken.

Only a shard's last bins are left open, a handful of ``bins_per_shard``. Once a
shard has a hundredth more bins than its items need, an item without a
compatible bin takes the tightest bin without a copy of it, and if there is
none the tightest bin: room goes before conflicts, so a hot text costs none.
:func:`conflicts` counts what gave way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import settle

#: What an item counts at least when shards are cut, so that a shard of tiny items is bounded too.
LEAST_WEIGHT = 8


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int) -> list[int]:
    """The bin of each item. ``clusters``: a number, -1 for none; ``sources``: a number."""
    needed = max(1, -(-sum(sizes) // capacity))
    enough = needed + max(1, needed // 100)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    by_room = [0] * (capacity + 1)  # bitmaps of bins, as are the next four
    by_block = [0] * ((capacity >> 6) + 1)  # of 64 residuals together, so that the search can leap
    with_cluster: dict[int, int] = {}
    with_lot: dict[tuple[int, int], int] = {}
    with_source: dict[int, int] = {}
    of_source: dict[int, int] = {}
    open_rooms = n_bins = 0
    place = [-1] * len(sizes)
    for i in order:
        size = sizes[i]
        cluster, source = clusters[i], sources[i]
        nth = of_source.get(source, 0)
        of_source[source] = nth + 1
        lot = source, nth // needed
        copies = with_cluster.get(cluster, 0) if cluster >= 0 else 0
        mixed, known = with_lot.get(lot, 0), with_source.get(source, 0)
        room, fit = -1, 0
        for clash in (copies | mixed, copies, 0) if n_bins >= enough or n_bins and not size else (copies | mixed,):
            free = ((1 << n_bins) - 1) & ~clash
            for block in range(size >> 6, len(by_block)):
                if not by_block[block] & free:
                    continue
                rooms = open_rooms >> max(size, block << 6) << max(size, block << 6) & (1 << (block + 1 << 6)) - 1
                while rooms:
                    room = (rooms & -rooms).bit_length() - 1
                    if fit := by_room[room] & free:
                        break
                    rooms &= rooms - 1
                if fit:
                    break
            if fit:
                break
        if fit:
            b = (fit & ~known or fit).bit_length() - 1
            by_room[room] ^= 1 << b
            by_block[room >> 6] ^= 1 << b
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = n_bins, capacity
            n_bins += 1
        if cluster >= 0:
            with_cluster[cluster] = copies | 1 << b
        with_lot[lot] = mixed | 1 << b
        with_source[source] = known | 1 << b
        by_room[room - size] |= 1 << b
        by_block[room - size >> 6] |= 1 << b
        open_rooms |= 1 << (room - size)
        place[i] = b
    return place


def _bits(clusters: np.ndarray, sizes: np.ndarray, capacity: int) -> list[int]:
    """Numbers of the clusters with several items; of one with more items than bins are needed, each ``needed`` get a number of their own."""
    needed = max(1, -(-int(sizes.sum()) // capacity))
    _, code, count = np.unique(clusters, return_inverse=True, return_counts=True)
    out, bit, turn = [-1] * len(code), {}, {}
    for i, c in enumerate(code.tolist()):
        if count[c] > 1 and sizes[i]:
            turn[c] = turn.get(c, -1) + 1
            out[i] = bit.setdefault((c, turn[c] // needed), len(bit))
    return out


def _packer(capacity: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending"), ("part", "ascending")])
        sizes = table.column("size").to_numpy().astype(np.int64)
        clusters = table.column("cluster").to_numpy()
        sources = np.unique(table.column("source").to_numpy(), return_inverse=True)[1]
        place = best_fit(sizes.tolist(), _bits(clusters, sizes, capacity), sources.tolist(), capacity)
        shard = table.column("shard").to_numpy().astype(np.int64)
        bins = pa.array(shard * width + np.asarray(place, np.int64), pa.int64())
        return pa.table({"item": table.column("item"), "part": table.column("part"), "size": table.column("size"), "bin": bins})

    return run


def pack(items: DataFrame, item: str, size: str, cluster: Column, source: Column, *, capacity: int = 2048, bins_per_shard: int = 2048) -> DataFrame:
    """``item, part, size, bin_id``: every item in one bin, no bin above ``capacity``.

    Only an item larger than ``capacity`` is split, into parts of ``capacity``
    and a rest; ``part`` counts from 0, and is 0 for all others. A null size
    counts as 0; items of size 0 get a bin like all others and take no room. A
    negative size is an error. Rows of one item are one item of its largest
    size. ``cluster`` and ``source`` are expressions over the input; a null
    cluster conflicts with nothing. ``bin_id`` is the same in every run over
    the same rows. Other columns are not read.
    """
    sized = items.select(items[item].alias("item"), F.coalesce(items[size].cast("long"), F.lit(0)).alias("size"), F.coalesce(F.xxhash64(cluster), F.lit(0)).alias("cluster"), cluster.isNull().alias("alone"), F.xxhash64(source).alias("source"))
    sized = sized.withColumn("size", F.when(F.col("size") >= 0, F.col("size")).otherwise(F.raise_error(F.lit("an item has a negative size")).cast("long")))
    sized = sized.groupBy("item").agg(F.max(F.struct("size", "cluster", "alone", "source")).alias("x")).select("item", "x.*")
    sized = sized.withColumn("cluster", F.when(F.col("alone"), F.xxhash64("item")).otherwise(F.col("cluster"))).drop("alone")
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / F.lit(capacity))).cast("int")
    parts = sized.withColumn("last", last).select("item", "size", "last", "cluster", "source", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    parts = parts.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part").cast("long") * capacity)).drop("last")
    parts = settle(parts, "items")
    weight = parts.agg(F.sum(F.greatest("size", F.lit(LEAST_WEIGHT)))).first()[0] or 0
    shards = max(1, -(-int(weight) // (capacity * bins_per_shard)))
    spread = parts.withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(shards)))
    kind = parts.schema["item"].dataType.simpleString()
    packed = spread.groupBy("shard").applyInArrow(_packer(capacity, 1 << 32), f"item {kind}, part int, size long, bin long")
    return packed.select(F.col("item").alias(item), "part", F.col("size").alias(size), F.col("bin").alias("bin_id"))


def conflicts(packed: DataFrame, items: DataFrame, item: str, cluster: Column, source: Column) -> DataFrame:
    """One row on a result of :func:`pack`: ``bins, fill_tokens, copies_together, source_repeats, least_repeats``.

    ``copies_together`` are items of a bin beyond the first of their cluster,
    ``source_repeats`` those beyond the first of their source, and
    ``least_repeats`` what the latter must be where sources have more items
    than there are bins. Bins and items without size count for nothing.
    """
    marks = items.select(items[item].alias("item"), F.xxhash64(cluster).alias("c"), cluster.isNull().alias("alone"), F.xxhash64(source).alias("s")).dropDuplicates(["item"])
    size = next(c for c in packed.columns if c not in (item, "part", "bin_id"))
    rows = packed.where(F.col(size) > 0).select(F.col(item).alias("item"), F.col(size).alias("n"), "bin_id").join(marks, "item")
    whole = rows.agg(F.countDistinct("bin_id").alias("bins"), F.sum("n").alias("fill_tokens"))
    together = rows.where(~F.col("alone")).groupBy("bin_id", "c").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("copies_together"))
    repeats = rows.groupBy("bin_id", "s").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("source_repeats"))
    held = rows.groupBy("s").agg(F.count(F.lit(1)).alias("k")).crossJoin(whole.select("bins")).agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("k") - F.col("bins"))), F.lit(0)).alias("least_repeats"))
    return whole.crossJoin(together).crossJoin(repeats).crossJoin(held)
