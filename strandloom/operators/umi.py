"""UMIs: tags and filters, counting, clustering and saturation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.prob import mean_qual, quals, saturation_corrected
from strandloom.functions.seq import hamming, has_run, slices
from strandloom.operators.ordered import run_numbers
from strandloom.session import drop_settled, settle


def umi_of_name(name: Column, delimiter: str = "_", place: int = 0) -> Column:
    """A piece of a read name; ``place`` counts from 0, or from the end if negative. Null where there is no such piece."""
    pieces = F.split(name, f"\\Q{delimiter}\\E")
    at = F.lit(place) if place >= 0 else F.size(pieces) + place
    return F.get(pieces, at)


def name_without_umi(name: Column, umi: Column, delimiter: str = "_") -> Column:
    """A read name without its UMI, wherever the UMI and the delimiter stand together."""
    cut = F.replace(name, F.concat(umi, F.lit(delimiter)), F.lit(""))
    return F.replace(cut, F.concat(F.lit(delimiter), umi), F.lit(""))


def tag_with_umi(df: DataFrame, tag: str = "RX", delimiter: str = "_", place: int = 0) -> DataFrame:
    """Alignments whose UMI moved from ``qname`` to a tag."""
    umi = umi_of_name(F.col("qname"), delimiter, place)
    kept = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: k != tag)
    return df.withColumns({"tags": F.map_concat(kept, F.create_map(F.lit(tag), umi)), "qname": name_without_umi(F.col("qname"), umi, delimiter)})


def without_runs(df: DataFrame, umi: Column, longest: int = 3) -> DataFrame:
    """Rows whose UMI repeats no base more than ``longest`` times; null UMIs go."""
    return df.where(~has_run(umi, longest + 1))


def clip_accepts(umi: Column, umi_qual: Column, constant: Column, expected: str, least_qual: float, mismatches: int) -> Column:
    """Whether a read to be clipped has a sure UMI: no N, mean quality high enough, constant part close to what is expected."""
    near = hamming(constant, F.lit(expected), strict=False) <= mismatches if expected else F.lit(True)
    return ~F.contains(umi, F.lit("N")) & (mean_qual(umi_qual) >= least_qual) & F.coalesce(near, F.lit(False))


def read1_barcode_accepts(barcode: Column, barcode_qual: Column, constant: Column, expected: str, least_qual: float, mismatches: int, qual1: Column, qual2: Column) -> Column:
    """The rule for barcodes on read 1: no N, every barcode quality high enough, constant part close, all qualities 20 or more."""
    low = lambda q: F.array_min(quals(q))
    near = hamming(constant, F.lit(expected), strict=False) <= mismatches if expected else F.lit(True)
    return ~F.contains(barcode, F.lit("N")) & (low(barcode_qual) >= least_qual) & F.coalesce(near, F.lit(False)) & (low(qual1) >= 20) & (low(qual2) >= 20)


def read2_barcode_accepts(barcode: Column, barcode_qual: Column, constant: Column, expected: str, least_qual: float, mismatches: int) -> Column:
    """The rule for barcodes on read 2: no N, the whole part of the mean quality above the cut, constant part close."""
    near = hamming(constant, F.lit(expected), strict=False) <= mismatches if expected else F.lit(True)
    return ~F.contains(barcode, F.lit("N")) & (F.floor(mean_qual(barcode_qual)) > least_qual) & F.coalesce(near, F.lit(False))


def umi_counts(fragments: DataFrame, keys: Sequence[str], umi: str) -> DataFrame:
    """Rows of each UMI at each place: ``keys..., umi, n``, wherever in the file the rows stand."""
    return fragments.groupBy(*keys, F.col(umi).alias("umi")).agg(F.count(F.lit(1)).alias("n"))


def near_pairs(counts: DataFrame, keys: Sequence[str], threshold: int = 1) -> DataFrame:
    """Pairs of different UMIs of one group and one length within ``threshold`` mismatches: ``keys..., a, na, b, nb``, a before b.

    Two UMIs that close share one of ``threshold + 1`` slices, so candidates
    come from an equi-join on (group, length, slice) and not from all pairs of
    a group. The rest is checked on the joined rows.
    """
    parts = threshold + 1
    cut = F.transform(slices(F.length("umi"), parts), lambda s: F.substring("umi", s["start"] + 1, s["end"] - s["start"]))
    each = counts.where(F.col("umi").isNotNull()).select(*keys, "umi", "n", F.length("umi").alias("len"), F.posexplode(cut).alias("nth", "part"))
    left = each.select(*keys, "len", "nth", "part", F.col("umi").alias("a"), F.col("n").alias("na"))
    right = each.select(*[F.col(k).alias(f"{k}__r") for k in keys], F.col("len").alias("len__r"), F.col("nth").alias("nth__r"), F.col("part").alias("part__r"), F.col("umi").alias("b"), F.col("n").alias("nb"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    joined = left.join(right, [*same, F.col("len") == F.col("len__r"), F.col("nth") == F.col("nth__r"), F.col("part") == F.col("part__r"), F.col("a") < F.col("b")])
    near = joined.where(_mismatches(F.col("a"), F.col("b")) <= threshold)
    return near.select(*keys, "a", "na", "b", "nb").distinct()


def _mismatches(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def _spread(labels: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels (keys..., umi, n, label) after every node has taken the least label that reaches it over ``edges`` src -> dst.

    A round takes the best label of all sources and then that label's own
    label: what reaches a node's label reaches the node, so chains shrink by
    powers and rounds grow as the logarithm of the longest.
    """
    now = settle(labels, "labels")
    while True:
        offers = _lookup(now, keys)
        offered = edges.join(offers, [*[F.col(k).eqNullSafe(F.col(f"{k}__s")) for k in keys], edges["src"] == offers["name__s"]]).groupBy(*keys, "dst").agg(F.min("label__s").alias("offer"))
        offered = offered.select(*[F.col(k).alias(f"{k}__o") for k in keys], "dst", "offer")
        match = [F.col(k).eqNullSafe(F.col(f"{k}__o")) for k in keys]
        better = F.col("offer").isNotNull() & (F.col("offer") < F.col("label"))
        step = now.drop("moved").join(offered, [*match, F.col("umi") == F.col("dst")], "left")
        step = settle(step.select(*keys, "umi", "n", F.when(better, F.col("offer")).otherwise(F.col("label")).alias("label"), F.coalesce(better, F.lit(False)).alias("moved")), "labels")
        drop_settled(now)
        if step.where("moved").isEmpty():
            return step.drop("moved")
        above = _lookup(step, keys)
        jumped = step.join(above, [*[F.col(k).eqNullSafe(F.col(f"{k}__s")) for k in keys], F.col("label.u") == F.col("name__s")])
        now = settle(jumped.select(*keys, "umi", "n", F.least("label", "label__s").alias("label"), "moved"), "labels")
        drop_settled(step)


def _merged(labels: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels (keys..., umi, n, label) after every node has taken the least label of its component over ``edges``, which stand in both directions.

    In a round every edge offers the label of its source to the node that its
    target is labelled with, so that whole trees are hooked at once; then each
    node takes its label's own label. Rounds grow as the logarithm of the longest
    chain.
    """
    now = settle(labels, "labels")
    while True:
        same = [F.col(k).eqNullSafe(F.col(f"{k}__s")) for k in keys]
        sources = edges.join(_lookup(now, keys), [*same, F.col("src") == F.col("name__s")]).groupBy(*keys, "dst").agg(F.min("label__s").alias("offer"))
        offers = sources.join(_lookup(now, keys), [*same, F.col("dst") == F.col("name__s")]).where(F.col("offer") < F.col("label__s"))
        offers = offers.groupBy(*keys, F.col("label__s.u").alias("root")).agg(F.min("offer").alias("offer"))
        offers = settle(offers.select(*[F.col(k).alias(f"{k}__o") for k in keys], "root", "offer"), "offers")
        if offers.isEmpty():
            drop_settled(offers)
            return now
        match = [F.col(k).eqNullSafe(F.col(f"{k}__o")) for k in keys]
        hooked = now.join(offers, [*match, F.col("umi") == F.col("root")], "left")
        hooked = settle(hooked.select(*keys, "umi", "n", F.least("label", "offer").alias("label")), "labels")
        jumped = hooked.join(_lookup(hooked, keys), [*same, F.col("label.u") == F.col("name__s")])
        before, now = now, settle(jumped.select(*keys, "umi", "n", F.least("label", "label__s").alias("label")), "labels")
        drop_settled(before, offers, hooked)


def _lookup(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labels.select(*[F.col(k).alias(f"{k}__s") for k in keys], F.col("umi").alias("name__s"), F.col("label").alias("label__s"))


def _ranked(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.where(F.col("umi").isNotNull()).select(*keys, "umi", "n", F.struct((-F.col("n")).alias("m"), F.col("umi").alias("u")).alias("label"))


def directional_clusters(counts: DataFrame, keys: Sequence[str], threshold: int = 1) -> DataFrame:
    """Every UMI with the cluster it belongs to: ``keys..., umi, n, cluster``.

    A UMI absorbs another within ``threshold`` mismatches if it has at least
    twice its rows less one. A cluster is named by its most frequent UMI, the
    first in the alphabet among equals, and a UMI joins the best-ranked one
    that reaches it over such steps. ``threshold`` 0 leaves every UMI alone.
    """
    ranked = _ranked(counts, keys)
    if threshold:
        pairs = near_pairs(counts, keys, threshold)
        down = pairs.where(F.col("na") >= 2 * F.col("nb") - 1).select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"))
        up = pairs.where(F.col("nb") >= 2 * F.col("na") - 1).select(*keys, F.col("b").alias("src"), F.col("a").alias("dst"))
        ranked = _spread(ranked, settle(down.unionByName(up), "edges"), keys)
    return ranked.select(*keys, "umi", "n", F.col("label.u").alias("cluster"))


def _one_edit_pairs(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates ``keys..., a, b`` for one edit: texts that are the same once each has lost one base or none.

    Every text one edit away shares such a form. A form holds at most the texts
    that it gains a base to, its length times the letters in use, however alike
    a group's texts are: that bounds the texts gathered and paired under it.
    """
    lost = F.transform(F.sequence(F.lit(0), F.length("umi") - 1), lambda i: F.concat(F.substring("umi", F.lit(1), i), F.substring("umi", i + 2, F.length("umi"))))
    forms = F.array_distinct(F.concat(F.array("umi"), F.when(F.length("umi") > 0, lost).otherwise(F.array())))
    held = nodes.select(*keys, "umi", F.explode(forms).alias("form")).groupBy(*keys, "form").agg(F.array_sort(F.collect_set("umi")).alias("near"))
    pairs = F.flatten(F.transform("near", lambda a, i: F.transform(F.slice("near", i + 2, F.size("near")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return held.where(F.size("near") > 1).select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def _slice_pairs(nodes: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """Candidates ``keys..., a, b`` for ``threshold`` edits: texts of which one has a stretch that stands within ``threshold`` places in the other."""
    parts = threshold + 1
    cut = F.transform(slices(F.length("umi"), parts), lambda s, i: F.struct(i.alias("nth"), F.substring("umi", s["start"] + 1, s["end"] - s["start"]).alias("part")))
    left = nodes.select(*keys, F.col("umi").alias("a"), F.length("umi").alias("len"), F.explode(cut).alias("x")).select(*keys, "a", "len", "x.nth", "x.part")
    lengths = F.filter(F.transform(F.sequence(F.lit(-threshold), F.lit(threshold)), lambda d: F.length("umi") + d), lambda n: n >= 1)
    shifted = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(slices(n, parts), lambda s, i: F.transform(F.sequence(F.lit(-threshold), F.lit(threshold)), lambda d: F.struct(n.alias("len"), i.alias("nth"), F.when(s["start"] + d >= 0, F.substring("umi", s["start"] + d + 1, s["end"] - s["start"])).alias("part")))))))
    right = nodes.select(*[F.col(k).alias(f"{k}__r") for k in keys], F.col("umi").alias("b"), F.explode(F.array_distinct(shifted)).alias("y")).select(*[f"{k}__r" for k in keys], "b", "y.len", "y.nth", "y.part").where(F.col("part").isNotNull())
    right = right.withColumnsRenamed({c: f"{c}__r" for c in ("len", "nth", "part")})
    same = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    joined = left.join(right, [*same, *[F.col(c) == F.col(f"{c}__r") for c in ("len", "nth", "part")], F.col("a") != F.col("b")])
    return joined.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def adjacency_clusters(counts: DataFrame, keys: Sequence[str], threshold: int = 1) -> DataFrame:
    """Every UMI with its cluster, where any two UMIs within ``threshold`` edits are linked: ``keys..., umi, n, cluster``.

    Candidates come from an equi-join within the group: for one edit on the
    forms that a UMI takes when it loses a base, for more on stretches that both
    must share. Clusters are named like directional ones.
    """
    ranked = _ranked(counts, keys)
    if not threshold:
        return ranked.select(*keys, "umi", "n", F.col("label.u").alias("cluster"))
    nodes = counts.where(F.col("umi").isNotNull())
    candidates = _one_edit_pairs(nodes, keys) if threshold == 1 else _slice_pairs(nodes, keys, threshold)
    linked = candidates.distinct().where(F.levenshtein("a", "b", threshold) >= 0)
    both = linked.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select(*keys, "e.*")
    return _merged(ranked, settle(both, "edges"), keys).select(*keys, "umi", "n", F.col("label.u").alias("cluster"))


def deduplicated(fragments: DataFrame, keys: Sequence[str], umi: str, *, threshold: int = 1, method: str = "directional") -> DataFrame:
    """Molecules of each place: ``keys..., umi, n_members``; ``method`` is directional, adjacency or exact."""
    counts = umi_counts(fragments, keys, umi).where(F.col("umi").isNotNull())
    if method == "exact" or not threshold:
        return counts.select(*keys, "umi", F.col("n").alias("n_members"))
    cluster = {"directional": directional_clusters, "adjacency": adjacency_clusters}[method]
    return cluster(settle(counts, "counts"), keys, threshold).groupBy(*keys, F.col("cluster").alias("umi")).agg(F.sum("n").alias("n_members"))


def saturation(fragments: DataFrame, keys: Sequence[str], umi: str, nt: int) -> DataFrame:
    """Distinct UMIs of each place and the molecules behind them: ``keys..., n_umi, n_molecules``."""
    seen = fragments.groupBy(*keys).agg(F.countDistinct(umi).alias("n_umi"))
    return seen.withColumn("n_molecules", saturation_corrected(F.col("n_umi"), nt))


def expanded_molecules(corrected: DataFrame, prefix: str = "frag") -> DataFrame:
    """One BED row for each molecule of :func:`saturation`, named ``prefix:UMI_seen_number``."""
    one = F.explode(F.when(F.col("n_molecules") >= 1, F.sequence(F.lit(1).cast("long"), F.col("n_molecules"))))
    rows = corrected.withColumn("nth", one)
    return rows.withColumn("name", F.format_string(f"{prefix}:UMI_%d_%d", F.col("n_umi"), F.col("nth"))).withColumn("score", F.lit(0)).drop("nth", "n_molecules", "n_umi")


def family_sizes(families: DataFrame, size: str) -> DataFrame:
    """How many families have each size: ``size, n_families``."""
    return families.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n_families"))


def tag_runs(df: DataFrame, order: str, tag: str, within: Sequence[str] = (), mismatches: int = 1) -> DataFrame:
    """Reads with ``run``: rows in ``order`` join the run of the row before while their tag is near the run's first tag.

    ``run`` counts from 0 within ``within`` (a file, say). A null tag, or one of
    another length, starts a run of its own.

    What a row does depends on the run's first tag, but not everywhere. A row
    more than ``2 * mismatches`` from the row before it can't be near the tag
    that row is near, so it starts a run whatever came before; rows of one tag
    in a row do alike. So rows first fall into stretches between such certain
    starts and, inside, into repeats of one tag; only the repeats' tags, one row
    each, are folded, stretch by stretch, as an Arrow stream.
    """
    import pyarrow as pa

    keys = list(within)
    near = lambda a, b, most: (F.length(a) == F.length(b)) & (_mismatches(a, b) <= most)
    same = lambda now, last: F.lit(True) if not keys else reduce(lambda x, y: x & y, [now[k].eqNullSafe(last[k]) for k in keys])
    columns = [*keys, tag]
    repeats = run_numbers(df, [*keys, order], columns, lambda now, last: ~(same(now, last) & (now[tag] == last[tag])), "repeat__")
    heads = repeats.groupBy("repeat__").agg(*[F.first(c).alias(c) for c in columns])
    stretches = run_numbers(heads, ["repeat__"], columns, lambda now, last: ~(same(now, last) & near(now[tag], last[tag], 2 * mismatches)), "stretch__")
    spread = stretches.select("repeat__", "stretch__", tag).repartition("stretch__").sortWithinPartitions("stretch__", "repeat__")

    def fold(batches):  # noqa: ANN001, ANN202
        now, first = None, None
        for batch in batches:
            new = []
            for stretch, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                joins = stretch == now and t is not None and first is not None and len(t) == len(first) and sum(x != y for x, y in zip(t, first)) <= mismatches
                if not joins:
                    now, first = stretch, t
                new.append(not joins)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.bool_())], ["folded__", "new__"])

    folded = spread.mapInArrow(fold, "folded__ long, new__ boolean")
    starts = heads.select("repeat__", *keys).join(folded, F.col("repeat__") == F.col("folded__")).drop("folded__")
    runs = run_numbers(starts, ["repeat__"], ["new__", *keys], lambda now, last: now["new__"] | ~same(now, last), "run__")
    lowest = runs.groupBy(*keys).agg(F.min("run__").alias("lowest__"))
    lowest = lowest.select(*[F.col(k).alias(f"{k}__l") for k in keys], "lowest__")
    runs = runs.join(lowest, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__l")) for k in keys], F.lit(True)))
    numbers = runs.select("repeat__", (F.col("run__") - F.col("lowest__")).alias("run"))
    return repeats.join(numbers, "repeat__").drop("repeat__")


def exact_tag_families(df: DataFrame, tag: str) -> DataFrame:
    """Reads with the size of their family of equal tags as ``family_size``; a hot tag's count combines before its shuffle."""
    sizes = df.groupBy(F.col(tag).alias("tag__")).agg(F.count(F.lit(1)).alias("family_size"))
    return df.join(sizes, F.col(tag).eqNullSafe(F.col("tag__")), "left").drop("tag__")


def numbered_clusters(families: DataFrame, barcode: str) -> DataFrame:
    """Families with ``cluster_no`` from 0 in the barcode's order, the same in every run.

    Numbers come from range partitions and the counts of those before, not
    from one window over everything.
    """
    return number_rows(families, [barcode], "cluster_no")


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with a row number from 0 over a total ``order``.

    Rows are range-partitioned and numbered inside each partition; only the
    partitions' counts, one row each, are summed up in one place.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("part__").orderBy(*order)
    sizes = ranged.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    before = sizes.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    rows = ranged.withColumn("place__", F.row_number().over(inside)).join(F.broadcast(before), "part__")
    return rows.withColumn(name, F.col("before__") + F.col("place__") - 1).drop("part__", "before__", "place__")
