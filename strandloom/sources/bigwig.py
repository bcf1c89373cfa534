"""bigWig files, one a chromosome: a data source that writes runs of values and reads them back.

A task takes whole chromosomes sorted by start and streams them: sections of
items go to the file as they fill, and only the index's entries, one for each
thousand items, are held until the end.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandloom.sources.files import expanded, local_path

SCHEMA = "chrom string, size bigint, start bigint, end bigint, value double"
# Fixed values of the format: magic numbers of the file, the chromosome tree and the index, its version, and the type of sections of runs.
_FILE, _TREE, _INDEX, _VERSION, _RUNS = 0x888FFC26, 0x78CA8C91, 0x2468ACE0, 4, 1
_HEAD, _SUMMARY, _SECTION = "<IHHQQQHHQQIQ", "<Qdddd", "<IIIIIBBH"
_ITEM = np.dtype([("start", "<u4"), ("end", "<u4"), ("value", "<f4")])
_SLOT, _BLOCK = 1024, 256


class _File:
    """One chromosome's file while it is written."""

    def __init__(self, path: str, chrom: str, size: int):
        self.handle, self.chrom, self.size = open(path, "wb"), chrom, size
        name = chrom.encode()
        self.tree = struct.calcsize(_HEAD) + struct.calcsize(_SUMMARY)
        self.data = self.tree + 32 + 4 + len(name) + 8
        self.handle.write(b"\0" * self.tree + struct.pack("<IIIIQQ", _TREE, 1, len(name), 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + name + struct.pack("<II", 0, size) + struct.pack("<Q", 0))
        self.held = np.empty(0, _ITEM)
        self.entries: list[tuple[int, int, int, int]] = []
        self.covered, self.low, self.high, self.total, self.squares, self.longest = 0, np.inf, -np.inf, 0.0, 0.0, 0

    def add(self, items: np.ndarray) -> None:
        width, values = (items["end"] - items["start"]).astype(float), items["value"].astype(float)
        if len(items):
            self.covered += int(width.sum())
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
            self.total, self.squares = self.total + float(width @ values), self.squares + float(width @ values**2)
        self.held = np.concatenate([self.held, items])
        while len(self.held) >= _SLOT:
            self._section(self.held[:_SLOT])
            self.held = self.held[_SLOT:]

    def _section(self, items: np.ndarray) -> None:
        first, last = int(items["start"][0]), int(items["end"][-1])
        raw = struct.pack(_SECTION, 0, first, last, 0, 0, _RUNS, 0, len(items)) + items.tobytes()
        packed, self.longest = zlib.compress(raw), max(self.longest, len(raw))
        self.entries.append((first, last, self.handle.tell(), len(packed)))
        self.handle.write(packed)

    def close(self) -> None:
        if len(self.held):
            self._section(self.held)
        at = self.handle.tell()
        self.handle.write(struct.pack("<IIQIIIIQII", _INDEX, _BLOCK, len(self.entries), 0, self.entries[0][0] if self.entries else 0, 0, self.entries[-1][1] if self.entries else 0, at, _SLOT, 0))
        self._nodes()
        self.handle.seek(self.data)
        self.handle.write(struct.pack("<Q", len(self.entries)))
        self.handle.seek(0)
        self.handle.write(struct.pack(_HEAD, _FILE, _VERSION, 0, self.tree, self.data, at, 0, 0, 0, struct.calcsize(_HEAD), self.longest, 0))
        some = self.covered > 0
        self.handle.write(struct.pack(_SUMMARY, self.covered, self.low if some else 0.0, self.high if some else 0.0, self.total, self.squares))
        self.handle.close()

    def _nodes(self) -> None:
        """The index's nodes, the root first: each level's nodes stand together, so a node's place follows from its number."""
        groups = lambda rows: [rows[a : a + _BLOCK] for a in range(0, len(rows), _BLOCK)] or [[]]
        levels = [groups(self.entries)]
        while len(levels[0]) > 1:
            levels.insert(0, groups([(node[0][0], max(e[1] for e in node)) for node in levels[0]]))
        at = self.handle.tell()
        for depth, level in enumerate(levels):
            leaf = depth == len(levels) - 1
            at += sum(4 + len(node) * (32 if leaf else 24) for node in level)
            child = at  # the next level begins here, and its nodes are all full but the last
            for node in level:
                self.handle.write(struct.pack("<BBH", leaf, 0, len(node)))
                for e in node:
                    if leaf:
                        self.handle.write(struct.pack("<IIIIQQ", 0, e[0], 0, e[1], e[2], e[3]))
                    else:
                        self.handle.write(struct.pack("<IIIIQ", 0, e[0], 0, e[1], child))
                        child += 4 + _BLOCK * (32 if depth == len(levels) - 2 else 24)


def parse_bigwig(path: str) -> Iterator[tuple[str, int, np.ndarray]]:
    """Chromosome, its size and the items of each section of a file of runs."""
    with open(path, "rb") as handle:
        magic, _, _, tree, _, index, _, _, _, _, _, _ = struct.unpack(_HEAD, handle.read(struct.calcsize(_HEAD)))
        if magic != _FILE:
            raise ValueError(f"{path} is no bigWig file")
        names = dict(_chromosomes(handle, tree))
        for offset, size in _leaves(handle, index + 48):
            handle.seek(offset)
            raw = zlib.decompress(handle.read(size))
            chrom, *_, kind, _, n = struct.unpack_from(_SECTION, raw)
            if kind != _RUNS:
                raise ValueError(f"{path} has sections that are not of runs")
            yield *names[chrom], np.frombuffer(raw, _ITEM, n, struct.calcsize(_SECTION))


def _chromosomes(handle: BinaryIO, tree: int) -> Iterator[tuple[int, tuple[str, int]]]:
    handle.seek(tree)
    key = struct.unpack("<IIIIQQ", handle.read(32))[2]
    todo = [tree + 32]
    while todo:
        handle.seek(todo.pop())
        leaf, _, n = struct.unpack("<BBH", handle.read(4))
        for _ in range(n):
            name = handle.read(key).rstrip(b"\0").decode()
            if leaf:
                number, size = struct.unpack("<II", handle.read(8))
                yield number, (name, size)
            else:
                todo.append(struct.unpack("<Q", handle.read(8))[0])


def _leaves(handle: BinaryIO, node: int) -> Iterator[tuple[int, int]]:
    handle.seek(node)
    leaf, _, n = struct.unpack("<BBH", handle.read(4))
    data = handle.read(n * (32 if leaf else 24))
    for k in range(n):
        if leaf:
            yield struct.unpack_from("<QQ", data, 32 * k + 16)
        else:
            yield from _leaves(handle, struct.unpack_from("<Q", data, 24 * k + 16)[0])


class BigWigSource(DataSource):
    """``spark.read.format("bigwig").load(path)`` and ``df.write.format("bigwig").save(folder)`` of ``chrom size start end value``."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):  # noqa: ANN001, ANN201
        return _Writer(self.options)


class _Part(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in expanded(self.options["path"])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for chrom, size, items in parse_bigwig(partition.value):
            columns = [pa.array([chrom] * len(items)), pa.array([size] * len(items), pa.int64()), *[pa.array(items[c].astype(np.int64)) for c in ("start", "end")], pa.array(items["value"].astype(float))]
            yield pa.RecordBatch.from_arrays(columns, ["chrom", "size", "start", "end", "value"])


class _Writer(DataSourceArrowWriter):
    """A file for each chromosome of a task, named ``PREFIX.CHROM.bigWig``; its rows must come together and by start."""

    def __init__(self, options: dict):
        self.folder, self.prefix = local_path(options["path"]), options.get("prefix", "depth")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        attempt, now, done = TaskContext.get().taskAttemptId(), None, []
        for batch in iterator:
            chroms = batch.column(0).to_pylist()
            items = np.empty(len(chroms), _ITEM)
            for c, k in (("start", 2), ("end", 3), ("value", 4)):
                items[c] = batch.column(k).to_numpy(zero_copy_only=False)
            bounds = [0, *[i for i in range(1, len(chroms)) if chroms[i] != chroms[i - 1]], len(chroms)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if now is None or now.chrom != chroms[a]:
                    if now:
                        now.close()
                    path = os.path.join(self.folder, f"{self.prefix}.{chroms[a]}.bigWig")
                    done.append((f"{path}.{attempt}", path))
                    now = _File(done[-1][0], chroms[a], batch.column(1)[a].as_py())
                now.add(items[a:b])
        if now:
            now.close()
        for made, path in done:
            os.replace(made, path)
        return WriterCommitMessage()


def write_bigwig(runs: DataFrame, sizes: DataFrame, folder: str, prefix: str = "depth") -> None:
    """Runs of values (``chrom start end value``) of the chromosomes in ``sizes`` (``chrom size``), a file each.

    Places without a run have the value 0, as have whole chromosomes without one.
    """
    runs.sparkSession.dataSource.register(BigWigSource)
    known = sizes.select("chrom", F.col("size").cast("bigint").alias("size")).where(F.col("size") > 0)
    given = runs.join(known, "chrom").select("chrom", "size", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("value").cast("double").alias("value"))
    order = ["chrom", "start"]
    rows = _with_gaps(given, known).repartition("chrom").sortWithinPartitions(*order)
    rows.select("chrom", "size", "start", "end", "value").write.format("bigwig").option("prefix", prefix).mode("append").save(folder)


def _with_gaps(given: DataFrame, known: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    # A chromosome's runs are one task's at last in any case: its file is.
    order = Window.partitionBy("chrom").orderBy("start")
    last = known.select("chrom", "size", F.col("size").alias("start"), F.col("size").alias("end"), F.lit(None).cast("double").alias("value"))
    before = F.coalesce(F.lag("end").over(order), F.lit(0))
    rows = given.unionByName(last).withColumn("gap", before)
    gaps = rows.where(F.col("gap") < F.col("start")).select("chrom", "size", F.col("gap").alias("start"), F.col("start").alias("end"), F.lit(0.0).alias("value"))
    return rows.where(F.col("value").isNotNull()).drop("gap").unionByName(gaps)


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    """The runs of bigWig files: ``chrom, size, start, end, value``."""
    spark.dataSource.register(BigWigSource)
    return spark.read.format("bigwig").load(path)
