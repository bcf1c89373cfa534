"""FASTQ, FASTA and BAM as Python data sources that hand Spark Arrow batches.

A file is one partition. A large plain FASTQ of four-line records may be split
by bytes (``split_bytes``); :func:`read_fastq` counts the records of each
stretch first, so ordinals are the same as those of a whole file.
"""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from strandloom import schemas
from strandloom.sources.files import expanded, lines, local_path

_BATCH = 20_000
_NTH = 40


@dataclass
class _Stretch(InputPartition):
    path: str
    start: int = 0
    end: int = -1


def parse_fastq(rows: Iterator[bytes]) -> Iterator[tuple[str, str, str | None, str]]:
    """``id, seq, qual, description`` of FASTQ or FASTA records of any number of lines.

    Qualities are null for FASTA. A record cut short raises.
    """
    line = next(rows, None)
    while line is not None:
        text = line.rstrip(b"\r\n")
        if not text:
            line = next(rows, None)
            continue
        mark = text[:1]
        if mark not in (b"@", b">"):
            raise ValueError(f"a record starts with {text[:20]!r}")
        description = text[1:].decode()
        seq: list[bytes] = []
        line = next(rows, None)
        while line is not None and line[:1] not in (b"+", b"@", b">"):
            seq.append(line.strip())
            line = next(rows, None)
        bases = b"".join(seq).decode()
        name = description.split(" ", 1)[0]
        if mark == b">" or line is None or line[:1] != b"+":
            if mark == b"@":
                raise ValueError(f"record {name} has no qualities")
            yield name, bases, None, description
            continue
        qual, size = [], 0
        line = next(rows, None)
        while line is not None and size < len(bases):
            part = line.rstrip(b"\r\n")
            qual.append(part)
            size += len(part)
            line = next(rows, None)
        if not bases and line is not None and not line.strip():
            line = next(rows, None)
        if size != len(bases):
            raise ValueError(f"record {name} has {len(bases)} bases and {size} qualities")
        yield name, bases, b"".join(qual).decode(), description


def parse_fasta(rows: Iterator[bytes]) -> Iterator[tuple[str, str]]:
    """``seq_id, seq``: the whole header is the id; lines of a sequence join. An empty file has no record."""
    name, parts = None, []
    for line in rows:
        if line.startswith(b">"):
            if name is not None:
                yield name, b"".join(parts).decode()
            name, parts = line[1:].strip().decode(), []
        elif name is not None:
            parts.append(line.strip())
    if name is not None:
        yield name, b"".join(parts).decode()


def parse_fasta_tiles(rows: Iterator[bytes], tile: int) -> Iterator[tuple[int, str, str]]:
    """``number, seq_id, piece`` of pieces of ``tile`` bases, holding one piece at a time; an empty sequence has none."""
    name, held, number = None, b"", 0
    for line in rows:
        if line.startswith(b">"):
            if held:
                yield number, name, held.decode()
            name, held, number = line[1:].strip().decode(), b"", 0
        elif name is not None:
            held += line.strip()
            while len(held) >= tile:
                yield number, name, held[:tile].decode()
                held, number = held[tile:], number + 1
    if held:
        yield number, name, held.decode()


def _batches(path: str, records: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of records that begin with their ordinal."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held))
        text = [pa.array(c, pa.string()) for c in columns[1:]]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(columns[0], pa.int64()), *text], ["file", "ordinal", *names])

    for record in records:
        held.append(record)
        if len(held) >= _BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _numbered(records: Iterator[tuple]) -> Iterator[tuple]:
    return ((n, *r) for n, r in enumerate(records))


class _FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Stretch(p) for p in expanded(self.options["path"])]


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``; option ``split_bytes`` splits plain four-line files.

    With it, ``ordinal`` is the number of the stretch above ``_NTH`` bits, and
    the record's number within the stretch below: rising, but not counted.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return schemas.FASTQ

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _FastqReader(self.options)


class _FastqReader(_FileReader):
    def partitions(self) -> list[InputPartition]:
        size = int(self.options.get("split_bytes", 0))
        out: list[InputPartition] = []
        for path in expanded(self.options["path"]):
            if not size or path == "-" or os.path.splitext(path)[1] in (".gz", ".bgz", ".bz2", ".xz"):
                out.append(_Stretch(path))
            else:
                total = os.path.getsize(path)
                out += [_Stretch(path, a, min(a + size, total)) for a in range(0, total, size)]
        return out

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        names = ["id", "seq", "qual", "description"]
        if partition.end < 0:
            yield from _batches(partition.path, _numbered(parse_fastq(iter(lines(partition.path)))), names)
        else:
            first = partition.start // int(self.options["split_bytes"]) << _NTH
            yield from _batches(partition.path, ((first + n, *r) for n, r in enumerate(_split_records(partition))), names)


def _first_record(part: _Stretch) -> int:
    """The place of the first four-line record that begins inside a stretch of bytes or after it."""
    if not part.start:
        return 0
    with open(part.path, "rb") as handle:
        handle.seek(part.start - 1)
        at = part.start - 1 + len(handle.readline())
        handle.seek(at)
        window = [handle.readline() for _ in range(8)]
    # A header starts with @ and has + two lines on; a quality line that starts with @ has a header there.
    skip = next((i for i in range(4) if window[i][:1] == b"@" and window[i + 2][:1] == b"+" and len(window[i + 1]) == len(window[i + 3])), 4)
    return at + sum(map(len, window[:skip]))


def _split_records(part: _Stretch) -> Iterator[tuple[str, str, str, str]]:
    """Four-line records that begin inside a stretch of bytes."""
    at = _first_record(part)
    with open(part.path, "rb") as handle:
        handle.seek(at)
        while at < part.end:
            four = [handle.readline() for _ in range(4)]
            if not four[0].strip():
                return
            head, seq, plus, qual = (x.rstrip(b"\r\n").decode() for x in four)
            if head[:1] != "@" or plus[:1] != "+" or len(seq) != len(qual):
                raise ValueError(f"no four-line record at byte {at} of {part.path}")
            yield head[1:].split(" ", 1)[0], seq, qual, head[1:]
            at += sum(map(len, four))


def _count_records(part: _Stretch) -> int:
    """How many records begin inside a stretch, from its line ends alone."""
    at, ends = _first_record(part), 0
    if at >= part.end:
        return 0
    with open(part.path, "rb") as handle:
        handle.seek(at)
        left = part.end - 1 - at
        while left > 0 and (data := handle.read(min(left, 1 << 22))):
            ends += data.count(b"\n")
            left -= len(data)
    return (ends + 4) // 4


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)``; with option ``tile`` in pieces of so many bases, ``ordinal`` the number of the piece in its sequence."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return schemas.FASTA

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _FastaReader(self.options)


class _FastaReader(_FileReader):
    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        rows, tile = iter(lines(partition.path)), int(self.options.get("tile", 0))
        records = parse_fasta_tiles(rows, tile) if tile else _numbered(parse_fasta(rows))
        yield from _batches(partition.path, records, ["seq_id", "seq"])


# Fixed values of the BAM format.
_SEQ16, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NUMBER = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_LAST_BIN, _AXIS = 37449, 1 << 29
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _tags(data: bytes) -> dict[str, tuple[str, str]]:
    """By tag its value as text and its type letter as SAM has it: every whole number is i."""
    out, i = {}, 0
    while i < len(data):
        tag, kind, i = data[i : i + 2].decode(), chr(data[i + 2]), i + 3
        if kind == "A":
            out[tag], i = (chr(data[i]), kind), i + 1
        elif kind in "ZH":
            end = data.index(b"\0", i)
            out[tag], i = (data[i:end].decode(), kind), end + 1
        elif kind == "B":
            sub, n = _NUMBER[chr(data[i])], struct.unpack_from("<i", data, i + 1)[0]
            values = struct.unpack_from(f"<{n}{sub}", data, i + 5)
            out[tag], i = (",".join([chr(data[i]), *map(_written, values)]), kind), i + 5 + n * struct.calcsize(sub)
        else:
            sub = _NUMBER[kind]
            out[tag], i = (_written(struct.unpack_from(f"<{sub}", data, i)[0]), "f" if kind == "f" else "i"), i + struct.calcsize(sub)
    return out


def _written(number: float) -> str:
    """A number as text; one of 32 bits with as few digits as bring it back."""
    if isinstance(number, int):
        return str(number)
    return next(text for n in range(1, 18) if struct.pack("<f", float(text := f"{number:.{n}g}")) == struct.pack("<f", number) or n == 17)


class _Bgzf:
    """Bytes of a blocked gzip file from a virtual place: the block's offset above 16 bits, the place within it below."""

    def __init__(self, handle: BinaryIO, place: int = 0):
        self.handle = handle
        self._load(place >> 16)
        self.at = place & 0xFFFF

    def _load(self, offset: int) -> None:
        self.block, self.data, self.at, self.next = offset, b"", 0, offset
        self.handle.seek(offset)
        head = self.handle.read(12)
        if len(head) == 12:
            extra, i, size = self.handle.read(struct.unpack_from("<H", head, 10)[0]), 0, 0
            while i < len(extra):
                n = struct.unpack_from("<H", extra, i + 2)[0]
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1 if extra[i : i + 2] == b"BC" else size
                i += 4 + n
            if not size:
                raise ValueError("no blocked gzip file")
            self.data, self.next = zlib.decompress(self.handle.read(size - 20 - len(extra)), -15), offset + size

    def tell(self) -> int:
        while self.at >= len(self.data) and self.next > self.block:
            self._load(self.next)
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            self.tell()
            part = self.data[self.at : self.at + n]
            if not part:
                break
            parts.append(part)
            self.at += len(part)
            n -= len(part)
        return b"".join(parts)


def _references(source: BinaryIO | _Bgzf, path: str) -> list[str]:
    """The names of a BAM file's references; the first alignment comes next."""
    if source.read(4) != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    source.read(struct.unpack("<i", source.read(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", source.read(4))[0]):
        refs.append(source.read(struct.unpack("<i", source.read(4))[0])[:-1].decode())
        source.read(4)
    return refs


def _alignment(data: bytes, refs: list[str]) -> tuple:
    """A row of the alignment schema without file and ordinal."""
    name = lambda k: refs[k] if k >= 0 else "*"
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, rnext, pnext, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + l_name
    qname = data[32 : at - 1].decode()
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    seq = data[at : at + (l_seq + 1) // 2].hex().translate(_BASES)[:l_seq]
    at += (l_seq + 1) // 2
    quals = data[at : at + l_seq]
    qual = None if not l_seq or quals[0] == 255 else quals.translate(_PLUS33).decode()
    cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*"
    tags = _tags(data[at + l_seq :])
    return qname, flag, name(ref), pos, mapq, cigar, name(rnext), pnext, tlen, seq or None, qual, {k: v for k, (v, _) in tags.items()}, {k: t for k, (_, t) in tags.items()}


_BASES = str.maketrans({f"{k:x}": c for k, c in enumerate(_SEQ16)})
_PLUS33 = bytes((q + 33) & 255 for q in range(256))


def parse_bam(path: str) -> Iterator[tuple]:
    """The alignments of a BAM file as rows of the alignment schema without file and ordinal."""
    with gzip.open(path, "rb") as handle:
        refs = _references(handle, path)
        while len(size := handle.read(4)) == 4:
            yield _alignment(handle.read(struct.unpack("<i", size)[0]), refs)


def _stretch_of_bam(part: _Stretch) -> Iterator[tuple]:
    """Alignments that begin between two virtual places, each after its own."""
    with open(part.path, "rb") as handle:
        refs = _references(_Bgzf(handle), part.path)
        source = _Bgzf(handle, part.start)
        while (at := source.tell()) < part.end and len(size := source.read(4)) == 4:
            yield at, *_alignment(source.read(struct.unpack("<i", size)[0]), refs)


@dataclass
class BamIndex:
    """By reference number: chunks of each bin, and the first place of each window of 16,384 bases."""

    bins: list[dict[int, list[tuple[int, int]]]]
    windows: list[list[int]]

    @classmethod
    def load(cls, path: str) -> BamIndex:
        with open(path, "rb") as handle:
            data = handle.read()
        if data[:4] != b"BAI\1":
            raise ValueError(f"{path} is no BAM index")
        at, bins, windows = 8, [], []
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            mine, n = {}, struct.unpack_from("<i", data, at)[0]
            at += 4
            for _ in range(n):
                number, m = struct.unpack_from("<Ii", data, at)
                places = struct.unpack_from(f"<{2 * m}Q", data, at + 8)
                at += 8 + 16 * m
                if number <= _LAST_BIN:  # bins above hold statistics
                    mine[number] = list(zip(places[::2], places[1::2]))
            n = struct.unpack_from("<i", data, at)[0]
            windows.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
            at += 4 + 8 * n
            bins.append(mine)
        return cls(bins, windows)

    def save(self, path: str) -> None:
        out = bytearray(b"BAI\1" + struct.pack("<i", len(self.bins)))
        for mine, first in zip(self.bins, self.windows):
            out += struct.pack("<i", len(mine))
            for number, chunks in sorted(mine.items()):
                out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
            out += struct.pack(f"<i{len(first)}Q", len(first), *first)
        with open(path, "wb") as handle:
            handle.write(out)

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """The stretches of the file that hold every alignment over a region, merged where they meet."""
        first = self.windows[ref]
        least = first[start >> 14] if start >> 14 < len(first) else 0
        last = min(end, _AXIS) - 1
        near = {0} | {k for shift, base in zip((26, 23, 20, 17, 14), (1, 9, 73, 585, 4681)) for k in range(base + (start >> shift), base + (last >> shift) + 1)} if last - start < 1 << 24 else set(self.bins[ref])
        found = sorted((max(a, least), b) for k, c in self.bins[ref].items() if k in near for a, b in c if b > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out


def index_bam(path: str) -> str:
    """Write the index of a BAM file sorted by place beside it; its path."""
    with open(path, "rb") as handle:
        source = _Bgzf(handle)
        refs = _references(source, path)
        index = BamIndex([{} for _ in refs], [[] for _ in refs])
        at = source.tell()
        while len(size := source.read(4)) == 4:
            data = source.read(struct.unpack("<i", size)[0])
            ref, pos, l_name, _, number, n_ops = struct.unpack_from("<iiBBHH", data)
            end = pos + (sum(o >> 4 for o in struct.unpack_from(f"<{n_ops}I", data, 32 + l_name) if _OPS[o & 15] in "MDN=X") or 1)
            after = source.tell()
            if ref >= 0:
                chunks = index.bins[ref].setdefault(number, [])
                if chunks and chunks[-1][1] == at:
                    chunks[-1] = chunks[-1][0], after
                else:
                    chunks.append((at, after))
                first = index.windows[ref]
                first += [at] * (((end - 1) >> 14) + 1 - len(first))
            at = after
    index.save(f"{path}.bai")
    return f"{path}.bai"


_ALIGNED = pa.schema(
    [("file", pa.string()), ("ordinal", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("tag_types", pa.map_(pa.string(), pa.string()))]
)


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``, and ``df.write.format("bam")`` with option ``header`` (SAM header text) and ``index``.

    A file with an index beside it (``.bai``) is read in stretches of
    ``split_bytes``, and of a ``region`` (``chrom:start-end``, half-open from 0)
    only the stretches that the index names; conditions on ``rname`` and
    ``pos`` do the same. ``ordinal`` is then an alignment's virtual place in
    the file: rising, but not counted. Files without an index are a partition
    each and are filtered while they are read.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schemas.ALIGNMENT

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _BamReader(self.options)

    def writer(self, schema, overwrite: bool):  # noqa: ANN001, ANN201
        return _BamWriter(self.options, overwrite)


class _BamReader(_FileReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.chrom, self.start, self.end = None, 0, _AXIS
        if region := options.get("region"):
            self.chrom, _, span = region.rpartition(":") if ":" in region else (region, "", "")
            if span:
                self.start, self.end = (int(x.replace(",", "")) for x in span.split("-"))
        self.bounds = self.chrom, self.start, self.end

    def pushFilters(self, filters):  # noqa: ANN001, ANN201, N802
        """A reference's name and bounds of ``pos`` narrow what is read of an indexed file; Spark checks all filters again."""
        for f in filters:
            match f:
                case EqualTo(("rname",), str(value)):
                    self.chrom = value if self.chrom in (None, value) else ""
                case LessThan(("pos",), int(value)):
                    self.end = min(self.end, value)
                case LessThanOrEqual(("pos",), int(value)):
                    self.end = min(self.end, value + 1)
                case GreaterThan(("pos",), int(value)) | GreaterThanOrEqual(("pos",), int(value)):
                    self.start = max(self.start, value)
        return filters

    def partitions(self) -> list[InputPartition]:
        size, out = int(self.options.get("split_bytes", 0)), []
        for path in (p for p in expanded(self.options["path"]) if not p.endswith(".bai")):
            index = next((p for p in (f"{path}.bai", f"{os.path.splitext(path)[0]}.bai") if os.path.exists(p)), None)
            if index is None or not (size or self.chrom is not None):
                out.append(_Stretch(path))
                continue
            known = BamIndex.load(index)
            with open(path, "rb") as handle:
                source = _Bgzf(handle)
                refs, first = _references(source, path), source.tell()
            if self.chrom is None:
                spans = [(first, os.path.getsize(path) << 16)]
            elif self.chrom in refs and self.start < self.end:
                spans = known.chunks(refs.index(self.chrom), self.start, self.end)
            else:
                spans = []
            places = sorted({a for mine in known.bins for c in mine.values() for a, _ in c} | {w for mine in known.windows for w in mine})
            for a, b in spans:
                for place in places[bisect_right(places, a) : bisect_left(places, b)] if size else ():
                    if (place >> 16) - (a >> 16) >= size:
                        out.append(_Stretch(path, a, place))
                        a = place
                out.append(_Stretch(path, a, b))
        return out or [_Stretch("")]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        records = enumerate(parse_bam(partition.path)) if partition.end < 0 else ((r[0], r[1:]) for r in _stretch_of_bam(partition))
        chrom, start, end = self.bounds
        held: list[tuple] = []
        for n, r in records:
            if chrom is not None and (r[2] != chrom or r[3] >= end or r[3] + _span(r[5]) <= start):
                continue
            held.append((partition.path, n, *r[:-2], list(r[-2].items()), list(r[-1].items())))
            if len(held) >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ALIGNED)], schema=_ALIGNED)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ALIGNED)], schema=_ALIGNED)


def _span(cigar: str) -> int:
    """Bases of the reference under a CIGAR, 1 at least."""
    return sum(int(n) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar) if o in "MDN=X") or 1


def _bgzf(data: bytes) -> bytes:
    out = bytearray()
    for a in range(0, len(data), 65_280):
        part = data[a : a + 65_280]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return bytes(out)


def _bin(start: int, end: int) -> int:
    """The bin of the smallest tile of the format's tree that holds a span."""
    end -= 1
    for level, shift in enumerate((14, 17, 20, 23, 26)):
        if start >> shift == end >> shift:
            return ((1 << (15 - 3 * level)) - 1) // 7 + (start >> shift)
    return 0


def _tag_bytes(tags: dict[str, str], types: dict[str, str]) -> bytes:
    """Tags in the format's bytes by their types; without one, i for whole numbers, else Z."""
    out = b""
    for tag, value in tags.items():
        kind = types.get(tag) or ("i" if re.fullmatch(r"-?[0-9]{1,9}", value) else "Z")
        if kind == "i" and not -(1 << 31) <= int(value) < 1 << 31:
            kind = "I" if 0 <= int(value) < 1 << 32 else "Z"
        out += tag.encode() + kind.encode()
        if kind == "B":
            sub, *numbers = value.split(",")
            out += sub.encode() + struct.pack(f"<i{len(numbers)}{_NUMBER[sub]}", len(numbers), *map(float if sub == "f" else int, numbers))
        elif kind in "iI":
            out += struct.pack(f"<{kind}", int(value))
        elif kind == "f":
            out += struct.pack("<f", float(value))
        else:
            out += value.encode() + b"\0" * (kind != "A")
    return out


def bam_record(row: dict, refs: dict[str, int]) -> bytes:
    """One alignment in the format's bytes."""
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq, qual = row["seq"] or "", row["qual"]
    codes = [_SEQ16.index(c) if c in _SEQ16 else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    quals = bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq)
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    name = row["qname"].encode() + b"\0"
    mate = row["rname"] if row["rnext"] == "=" else row["rnext"]
    head = struct.pack("<iiBBHHHiiii", refs.get(row["rname"], -1), row["pos"], len(name), row["mapq"] or 0, _bin(max(row["pos"], 0), max(row["pos"], 0) + span), len(ops), row["flag"], len(seq), refs.get(mate, -1), row["pnext"] if row["pnext"] is not None else -1, row["tlen"] or 0)
    data = head + name + b"".join(struct.pack("<I", n << 4 | _OPS.index(o)) for n, o in ops) + packed + quals + _tag_bytes(dict(row["tags"] or {}), dict(row["tag_types"] or {}))
    return struct.pack("<i", len(data)) + data


class _BamWriter(DataSourceWriter):
    """Every task writes a complete BAM file of its rows, with the header, into the folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.index = local_path(options["path"]), options.get("header", ""), options.get("index") == "true"
        if overwrite and os.path.isdir(self.path):
            for old in os.listdir(self.path):
                if old.endswith(".bam"):
                    os.remove(os.path.join(self.path, old))

    def write(self, rows):  # noqa: ANN001, ANN201
        from pyspark import TaskContext

        refs = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in self.header.splitlines() if line.startswith("@SQ")]
        number = {r["SN"]: k for k, r in enumerate(refs)}
        text = self.header.encode()
        out = bytearray(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)))
        for r in refs:
            name = r["SN"].encode() + b"\0"
            out += struct.pack("<i", len(name)) + name + struct.pack("<i", int(r["LN"]))
        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        target = os.path.join(self.path, f"part-{task.partitionId():05d}.bam")
        with open(f"{target}.{task.taskAttemptId()}", "wb") as handle:
            for row in rows:
                out += bam_record(row.asDict(), number)
                if len(out) > 1 << 22:
                    handle.write(_bgzf(bytes(out)))
                    out.clear()
            handle.write(_bgzf(bytes(out)) + _EOF)
        os.replace(f"{target}.{task.taskAttemptId()}", target)
        if self.index:
            index_bam(target)
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    """Make the formats fastq, fasta and bam known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastqSource, FastaSource, BamSource):
        spark.dataSource.register(source)


def read_fastq(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """FASTQ or FASTA records; ``ordinal`` counts from 0 in each file, split or not."""
    register(spark)
    rows = spark.read.format("fastq").options(**options).load(path)
    size = int(options.get("split_bytes") or 0)
    stretches = [p for p in _FastqReader({"path": path, "split_bytes": size}).partitions() if p.start > 0] if size else []
    if not stretches:
        return rows
    # One row a stretch, counted in parallel; each stretch but a file's first follows those before it.
    listed = spark.createDataFrame([(p.path, p.start - size) for p in stretches], "file string, start long").repartition(len(stretches))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts = [_count_records(_Stretch(f, a, a + size)) for f, a in zip(files, starts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a // size + 1 for a in starts], pa.int64()), pa.array(counts, pa.int64())], ["f__", "stretch__", "n__"])

    counted = listed.mapInArrow(count, "f__ string, stretch__ long, n__ long")
    before = counted.select("f__", "stretch__", F.sum("n__").over(Window.partitionBy("f__").orderBy("stretch__")).alias("before__"))
    stretch = F.shiftright("ordinal", _NTH)
    joined = rows.join(F.broadcast(before), (F.col("file") == F.col("f__")) & (stretch == F.col("stretch__")), "left")
    return joined.withColumn("ordinal", F.col("ordinal") - F.shiftleft(stretch, _NTH) + F.coalesce("before__", F.lit(0))).select(*rows.columns)


def read_fasta(spark: SparkSession, path: str, tile: int = 0) -> DataFrame:
    """Sequences of FASTA files, or with ``tile`` their pieces of so many bases: ``file, seq_id, tile, seq``, never a whole sequence in a cell."""
    register(spark)
    rows = spark.read.format("fasta").options(**({"tile": tile} if tile else {})).load(path)
    return rows.withColumnRenamed("ordinal", "tile") if tile else rows


def index_fasta(path: str) -> str:
    """Write the index (``.fai``: name, bases, place, bases and bytes a line) of a plain FASTA file beside it; its path."""
    rows, at = [], 0
    with open(path, "rb") as handle:
        for line in handle:
            at += len(line)
            text = line.rstrip(b"\r\n")
            if line.startswith(b">"):
                rows.append([(text[1:].split() or [b""])[0].decode(), 0, at, 0, 0])
            elif rows:
                rows[-1][1] += len(text)
                rows[-1][3:] = [rows[-1][3] or len(text), rows[-1][4] or len(line)]
    with open(f"{path}.fai", "w") as out:
        out.writelines("\t".join(map(str, r)) + "\n" for r in rows)
    return f"{path}.fai"


def fetch_bases(path: str, regions: list[tuple[str, int, int]]) -> list[str | None]:
    """The bases of half-open regions of an indexed FASTA file, cut at a sequence's end; None for an unknown sequence."""
    known = {}
    with open(f"{path}.fai") as index:
        for line in index:
            name, *numbers = line.rstrip("\n").split("\t")
            known[name] = tuple(map(int, numbers))
    out: list[str | None] = []
    with open(path, "rb") as handle:
        for name, start, end in regions:
            if name not in known:
                out.append(None)
                continue
            size, first, bases, width = known[name]
            start, end = max(0, start), min(end, size)
            if start >= end:
                out.append("")
                continue
            at = lambda k: first + k // bases * width + k % bases  # noqa: B023, E731
            handle.seek(at(start))
            out.append(handle.read(at(end - 1) + 1 - at(start)).translate(None, b"\r\n").decode())
    return out


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """Index every BAM (sorted by place) or plain FASTA file of a path, a task each; ``file, index`` of them. Nothing is done before the rows are asked for."""
    files = [f for f in expanded(path) if not f.endswith((".bai", ".fai"))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(index_bam if f.endswith(".bam") else index_fasta)(f) for f in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["file", "index"])

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInArrow(build, "file string, index string")


def region_bases(regions: DataFrame, path: str = "") -> DataFrame:
    """``chrom, start, end, seq`` of regions, looked up in an indexed FASTA file that every executor can reach: ``path``, or the one a row's ``file`` names. Null where it hasn't the sequence."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            found: list[str | None] = [None] * len(rows)
            for name in {r[0] for r in rows}:
                mine = [i for i, r in enumerate(rows) if r[0] == name]
                for i, seq in zip(mine, fetch_bases(name, [rows[i][1:] for i in mine])):
                    found[i] = seq
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], ["chrom", "start", "end", "seq"])

    file = F.col("file") if "file" in regions.columns else F.lit(path)
    rows = regions.select(file.alias("file"), "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna()
    return rows.mapInArrow(look_up, "chrom string, start long, end long, seq string")


def read_bam(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Alignments of BAM files; see :class:`BamSource` for the options."""
    register(spark)
    return spark.read.format("bam").options(**options).load(path)


def bam_header(path: str) -> list[str]:
    """The header lines of BAM files, each line once, in the order of the files; a few lines a reference."""
    lines: dict[str, None] = {}
    for name in expanded(path):
        with gzip.open(name, "rb") as handle:
            if handle.read(4) != b"BAM\1":
                raise ValueError(f"{name} is no BAM file")
            text = handle.read(struct.unpack("<i", handle.read(4))[0]).rstrip(b"\0").decode()
        lines |= dict.fromkeys(line for line in text.splitlines() if line)
    return list(lines)
