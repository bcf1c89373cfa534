"""The whole corpus in token ids of a public tokenizer, reusing what texts share.

1. A rolling hash over the characters cuts every text into chunks at places
   that depend on nearby content only, so copies and quotations share chunks.
   A task works through its texts in lots of bounded size; a lot keeps each of
   its chunks once and, for every text, the numbers of its chunks.
2. The lots' chunks meet by hash, and each distinct chunk is encoded once.
   Inside it, a place between a letter and a blank or punctuation mark is a
   boundary of the tokenizer's words whatever surrounds the chunk; what lies
   between the first and the last such place is encoded for good, the two ends
   are kept as text. What comes of it goes back to the lots that have the chunk.
3. A lot puts its texts together again. Each join is repaired by encoding the
   ends that meet there, and goes on through chunks that have no certain
   boundary, until both sides agree with an encoding of the whole text.

The texts themselves are read once and never shuffled; a chunk travels once a
lot, there and back, however often its texts repeat it, so a template in a
third of all texts is a row a lot. A lot is all that a task holds at a time.
Nothing reaches the driver.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.session import settle

#: Width of the rolling hash in characters, and the bits that must be zero at a cut (chunks of 128 characters on average).
WINDOW, CUT_BITS = 16, 7
#: Characters of a lot, the texts that a task puts together at a time.
LOT_CHARS = 8_000_000
_LOT = ["lot", "doc", "whole", "refs", "at", "chunk", "piece"]
# After a letter, none of these can continue the tokenizer's word, nor can what precedes change that.
_AFTER = frozenset(" \n\t.,;:!?\"'()[]{}<>/-0123456789。、！？")


def tokenizer_folder() -> str:
    """Where the public vocabulary files are installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or spec.origin is None:
        raise RuntimeError("pass the folder of the vocabulary files")
    return str(Path(spec.origin).parent)


def load_tokenizer(path: str):
    """A function from a text to its ids, special tokens' strings taken as ordinary text."""
    return _loaded(path)[0]


@functools.lru_cache(maxsize=4)
def _loaded(path: str):
    """That function, and the narrowest type that holds every id."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The published splitting pattern of byte-level BPE vocabularies of this kind: a fixed value.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        made = tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return made.encode_ordinary, "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return lambda text: plain.encode(text, add_special_tokens=False).ids, "<u2" if plain.get_vocab_size() <= 1 << 16 else "<u4"


def _cuts(texts: list[str]) -> list[np.ndarray]:
    """For each text the ends of its chunks, the last being its length."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return [np.array([n]) for n in sizes]
    mixed = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    rolled, factor = np.zeros_like(mixed), 1
    for k in range(min(WINDOW, len(mixed))):
        rolled[k:] += mixed[: len(mixed) - k] * np.uint32(factor)
        factor = factor * 0x01000193 % (1 << 32)
    rolled *= np.uint32(2246822519)
    ends = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, base = [], 0
    for n in sizes:
        # The first window of a text would also see the text before it, so none ends there.
        lo, hi = np.searchsorted(ends, (base + WINDOW, base + n))
        out.append(np.append(ends[lo:hi] - base, n))
        base += n
    return out


def _lots(kind: pa.DataType, lot_chars: int):
    """Texts to rows of a lot: of a text ``doc, whole, refs`` (a hash of the text, the numbers of its chunks), of a chunk ``at, chunk, piece``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth, size = TaskContext.get().partitionId(), 0, 0
        docs, whole, refs, known = [], [], [], {}

        def flush() -> Iterator[pa.RecordBatch]:
            lot = task << 32 | nth
            hashes = [xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")) for p in known]
            n, m = len(whole), len(known)
            ids = pa.concat_arrays([x.cast(kind) for x in docs]) if docs else pa.nulls(0, kind)
            yield pa.RecordBatch.from_arrays([pa.array([lot] * n, pa.int64()), ids, pa.array(whole, pa.binary()), pa.array(refs, pa.list_(pa.int32())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string())], _LOT)
            yield pa.RecordBatch.from_arrays([pa.array([lot] * m, pa.int64()), pa.nulls(m, kind), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(pa.int32())), pa.array(range(m), pa.int32()), pa.array(hashes, pa.binary()), pa.array(known, pa.string())], _LOT)

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                docs.append(part.column(0))
                for text, ends in zip(texts, _cuts(texts)):
                    a, mine = 0, []
                    for b in ends.tolist() if text else ():
                        mine.append(known.setdefault(text[a:b], len(known)))
                        a = b
                    whole.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                    refs.append(mine)
                size += sum(map(len, texts))
                if size >= lot_chars:
                    yield from flush()
                    nth, size = nth + 1, 0
                    docs, whole, refs, known = [], [], [], {}
        if whole:
            yield from flush()

    return run


def _certain(text: str) -> tuple[int, int]:
    """The first and the last place in ``text`` that is a word boundary in any surroundings; (-1, -1) without one."""
    first = last = -1
    for i in range(1, len(text)):
        if text[i] in _AFTER and text[i - 1].isalpha():
            first = i
            break
    if first >= 0:
        for i in range(len(text) - 1, first - 1, -1):
            if text[i] in _AFTER and text[i - 1].isalpha():
                last = i
                break
    return first, last


def _bytes_of(parts: list[list[int] | None], width: str) -> pa.Array:
    """Lists of ids as an array of bytes, null where there is no list."""
    sizes = np.fromiter((0 if p is None else len(p) for p in parts), np.int64, len(parts))
    flat = np.fromiter((i for p in parts if p for i in p), width, int(sizes.sum()))
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(sizes * flat.itemsize, out=offsets[1:])
    full = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
    return pc.if_else(pa.array([p is not None for p in parts]), full, pa.scalar(None, pa.binary()))


def _encode_chunks(path: str):
    """Chunks in the order of their hash, each encoded when it first comes: ``lot, at, head, core, tail``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = _loaded(path)
        now, made = None, ("", None, "")
        for batch in batches:
            out = []
            for key, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key != now:
                    first, last = _certain(text)
                    now, made = key, (text, None, "") if first < 0 else (text[:first], encode(text[first:last]), text[last:])
                out.append(made)
            head, core, tail = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(head, pa.string()), _bytes_of(list(core), width), pa.array(tail, pa.string())], ["lot", "at", "head", "core", "tail"])

    return run


def _join_up(path: str, kind: pa.DataType):
    """The texts of a lot from its encoded chunks."""

    def run(chunks: pa.Table, texts: pa.Table) -> pa.Table:
        encode, width = _loaded(path)
        order = np.argsort(chunks.column("at").to_numpy())
        head, tail = (np.asarray(chunks.column(c).to_pylist(), object)[order].tolist() for c in ("head", "tail"))
        cores = [None if c is None else np.frombuffer(c, width) for c in (x.as_buffer() if x.is_valid else None for x in chunks.column("core").take(pa.array(order)))]
        ends: dict[str, np.ndarray] = {}

        def ids_of(text: str) -> np.ndarray:
            if text not in ends:
                ends[text] = np.asarray(encode(text), width)
            return ends[text]

        flat, sizes = [], []
        for refs in texts.column("refs").to_pylist():
            open_, n = "", len(flat)
            for r in refs:
                open_ += head[r]
                if cores[r] is not None:
                    flat += (ids_of(open_), cores[r])
                    open_ = tail[r]
            if open_:
                flat.append(ids_of(open_))
            sizes.append(sum(map(len, flat[n:])))
        ids = np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.table({"doc": texts.column("doc").cast(kind), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))})

    return run


def encode_corpus(df: DataFrame, doc: str = "doc_id", text: str = "text", *, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, lot_chars: int = LOT_CHARS) -> DataFrame:
    """``doc, ids``: the token ids of every text, without special tokens, as an encoding of the whole text gives them.

    Null and empty texts have no tokens: their ``ids`` are an empty list.
    ``vocabulary`` is a byte-level BPE file in ``folder`` (by default where the
    public vocabularies are installed), of tiktoken or tokenizers format; the
    certain boundaries hold for its splitting pattern. Rows equal in ``doc``
    and ``text`` are one; other columns are not read. ``lot_chars`` bounds what
    a task holds; it changes the work, never the result.
    """
    path = str(Path(folder or tokenizer_folder()) / vocabulary)
    rows = df.select(df[doc].alias("doc"), df[text].cast("string").alias("text"))
    kind = rows.schema["doc"].dataType
    arrow = to_arrow_type(kind)
    lots = settle(rows.mapInArrow(_lots(arrow, lot_chars), f"lot long, doc {kind.simpleString()}, whole binary, refs array<int>, at int, chunk binary, piece string"), "lots")
    chunks = lots.where(F.col("chunk").isNotNull()).select("lot", "at", "chunk", "piece").repartition("chunk").sortWithinPartitions("chunk")
    encoded = chunks.mapInArrow(_encode_chunks(path), "lot long, at int, head string, core binary, tail string")
    texts = lots.where(F.col("whole").isNotNull()).select("lot", "doc", "whole", "refs").dropDuplicates(["doc", "whole"])
    joined = encoded.groupBy("lot").cogroup(texts.select("lot", "doc", "refs").groupBy("lot")).applyInArrow(_join_up(path, arrow), f"doc {kind.simpleString()}, ids array<int>")
    return joined.withColumnRenamed("doc", doc)


def count_tokens(df: DataFrame, doc: str = "doc_id", text: str = "text", **options: str) -> DataFrame:
    """``doc, n_tokens`` of every text; 0 for null and empty ones."""
    return encode_corpus(df, doc, text, **options).select(doc, F.size("ids").alias("n_tokens"))
