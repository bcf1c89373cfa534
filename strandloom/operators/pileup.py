"""Stranded base counts along the reference.

Alignments explode to their aligned bases and aggregate by place in one
shuffle; counts combine before it, so depth costs no memory anywhere. Regions
are a filter on the result and need no tiling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.functions import flags as G
from strandloom.operators.ordered import run_numbers

BASES = ("A", "C", "G", "T")
COLUMNS = tuple(f"{b}{s}" for s in "+-" for b in BASES)


def overlapping(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Alignments that overlap a region; the conditions on ``rname`` and ``pos`` reach the scan, of an indexed BAM file too."""
    return df.where((F.col("rname") == chrom) & (F.col("pos") < end) & (F.col("pos") + C.reference_length(F.col("cigar")) > start))


def aligned_bases(df: DataFrame, *, min_qual: int = 30, crop: int = 0, no_indel: bool = False, direction: str = "fr", exact: bool = False) -> DataFrame:
    """``chrom, pos, strand, base`` of every counted base.

    Unmapped, duplicate and supplementary alignments don't count. ``crop``
    leaves out that many bases at both ends (the bound at the end inclusive),
    ``no_indel`` alignments with an insertion or deletion. Unless ``exact``,
    the first base of a read and place 0 of the reference don't count.
    """
    bits = G.UNMAPPED | G.DUPLICATE | G.SUPPLEMENTARY
    rows = df.where(~G.has(F.col("flag"), bits) & F.col("seq").isNotNull() & F.col("qual").isNotNull())
    if no_indel:
        rows = rows.where(~F.col("cigar").rlike("[ID]"))
    rows = rows.select(F.col("rname").alias("chrom"), G.strand(F.col("flag"), direction).alias("strand"), "seq", "qual", F.explode(C.aligned_blocks(F.col("cigar"), F.col("pos"))).alias("block"))
    rows = rows.where(F.col("strand").isNotNull()).select("chrom", "strand", "seq", "qual", F.col("block.q").alias("q0"), F.col("block.r").alias("r0"), F.explode(F.sequence(F.lit(0), F.col("block.n") - 1)).alias("k"))
    at = F.col("q0") + F.col("k")
    rows = rows.select("chrom", (F.col("r0") + F.col("k")).alias("pos"), "strand", F.substring("seq", at + 1, F.lit(1)).alias("base"), (F.ascii(F.substring("qual", at + 1, F.lit(1))) - 33).alias("phred"), at.alias("at"), (F.length("seq") - crop).alias("stop"))
    kept = rows.where((F.col("phred") >= min_qual) & (F.col("at") >= crop) & (F.col("at") <= F.col("stop")))
    if not exact:
        kept = kept.where((F.col("at") > 0) & (F.col("pos") > 0))
    return kept.select("chrom", "pos", "strand", "base")


def pileup(df: DataFrame, *, min_cov: int = 0, **options: object) -> DataFrame:
    """``chrom, pos, A+ C+ G+ T+ A- C- G- T-`` where either strand is covered by more than ``min_cov`` bases."""
    bases = aligned_bases(df, **options)
    counts = [F.count(F.when((F.col("base") == c[0]) & (F.col("strand") == c[1]), 1)).alias(c) for c in COLUMNS]
    out = bases.groupBy("chrom", "pos").agg(*counts)
    plus, minus = (sum((F.col(f"`{b}{s}`") for b in BASES[1:]), start=F.col(f"`A{s}`")) for s in "+-")
    return out.where((plus > min_cov) | (minus > min_cov))


def coverage(piled: DataFrame) -> DataFrame:
    """``chrom, pos, plus, minus``: covered bases by strand."""
    plus, minus = (sum((F.col(f"`{b}{s}`") for b in BASES[1:]), start=F.col(f"`A{s}`")) for s in "+-")
    return piled.select("chrom", "pos", plus.alias("plus"), minus.alias("minus"))


#: Bases of a tile of the reference.
TILE = 4096


def reference_tiles(fasta: DataFrame) -> DataFrame:
    """``chrom, tile, part`` of references ``seq_id, seq``, or ``seq_id, tile, seq`` where the source has cut them already."""
    if "tile" in fasta.columns:
        return fasta.select(F.col("seq_id").alias("chrom"), "tile", F.col("seq").alias("part"))

    def cut(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            for chrom, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = seq.as_py() or ""
                for first in range(0, len(text), TILE * 1024):
                    parts = [text[a : a + TILE] for a in range(first, min(len(text), first + TILE * 1024), TILE)]
                    tiles = range(first // TILE, first // TILE + len(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(parts), pa.string()), pa.array(tiles, pa.int64()), pa.array(parts, pa.string())], ["chrom", "tile", "part"])

    return fasta.select("seq_id", "seq").mapInArrow(cut, "chrom string, tile long, part string")


def reference_bases(fasta: DataFrame, piled: DataFrame) -> DataFrame:
    """``piled`` with ``ref``, the reference's base at each place.

    The reference goes to the places by an equi-join on (chrom, tile): tiles
    keep a chromosome from travelling whole to every row.
    """
    placed = piled.withColumn("tile", F.expr(f"pos div {TILE}"))
    base = F.substring("part", (F.col("pos") - F.col("tile") * TILE + 1).cast("int"), F.lit(1))
    return placed.join(reference_tiles(fasta), ["chrom", "tile"]).withColumn("ref", F.upper(base)).where(F.col("ref") != "").drop("tile", "part")


def strand_sequence(piled: DataFrame, strand: str = "+", complement: bool = False) -> DataFrame:
    """``chrom, seq``: the commonest base of every covered place in order (the first in the alphabet among equals).

    Uncovered places are skipped. On ``-`` the sequence is read backwards and,
    with ``complement``, complemented. Places become strings tile by tile; only
    tiles, a chromosome's length over 4,096, meet in a row.
    """
    from strandloom.functions.seq import complement as complemented

    best = F.array_sort(F.array(*[F.struct((-F.col(f"`{b}{strand}`")).alias("n"), F.lit(b).alias("b")) for b in BASES]))[0]
    rows = piled.select("chrom", F.expr(f"pos div {TILE}").alias("tile"), "pos", best.alias("x")).where(F.col("x.n") < 0)
    joined = lambda at, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x["t"]), "")
    tiles = rows.groupBy("chrom", "tile").agg(joined("pos", F.col("x.b").alias("t")).alias("part"))
    out = tiles.groupBy("chrom").agg(joined("tile", F.col("part").alias("t")).alias("seq"))
    if strand == "-":
        out = out.withColumn("seq", F.reverse(complemented(F.col("seq")) if complement else F.col("seq")))
    return out


def region_tiles(lengths: DataFrame, name: str, length: str, step: int) -> DataFrame:
    """``name, start, end``: each length cut into tiles of ``step``, the last one shorter. A length of 0 has none."""
    tiled = lengths.where(F.col(length) > 0).select(name, F.col(length).alias("len__"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1, F.lit(step).cast("long"))).alias("start"))
    return tiled.select(name, "start", F.least(F.col("start") + step, F.col("len__").cast("long")).alias("end"))


def depth_track(depth: DataFrame, sizes: DataFrame) -> DataFrame:
    """A value for every place of every sized chromosome, 0 where ``depth`` (``chrom pos value``, pos from 1) has none: ``chrom, pos, value``, pos from 0."""
    tiles = region_tiles(sizes, "chrom", "size", TILE).repartition("chrom", "start")
    places = tiles.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    given = depth.select(F.col("chrom"), (F.col("pos") - 1).cast("long").alias("pos"), "value")
    return places.join(given, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("value", F.lit(0)).alias("value"))


def bedgraph(depth: DataFrame) -> DataFrame:
    """``chrom, start, end, value``: runs of adjacent places of one value, in place of a dense track."""
    rows = depth.select("chrom", (F.col("pos") - 1).cast("long").alias("pos"), "value")
    new = lambda now, last: (now["chrom"] != last["chrom"]) | (now["pos"] != last["pos"] + 1) | (now["value"] != last["value"])
    runs = run_numbers(rows, ["chrom", "pos"], ["chrom", "pos", "value"], new, "run")
    return runs.groupBy("chrom", "run", "value").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).select("chrom", "start", "end", "value")
