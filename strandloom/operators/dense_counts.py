"""Results per key when a handful of keys hold most rows: dense accumulator arrays.

1. Copies of a record collapse by record id, and rows to distinct (key, member)
   pairs with their counts; both combine before their shuffle and hash on a
   column that no hot key concentrates.
2. Every input split encodes its keys as dense codes and scatter-adds its rows
   into arrays over those codes: a key leaves a split once, however hot it is.
3. Keys hash into blocks. A block encodes its keys again and adds the splits'
   pieces into one dense array; it holds distinct keys / ``blocks`` slots and
   gets each key at most once a split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import partitions

_SCHEMA = "key string, n_rows long, n_members long"


def _scatter(keys: pa.Array | pa.ChunkedArray, rows: np.ndarray, members: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    coded = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    total, distinct = np.zeros(len(coded.dictionary), np.int64), np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, codes, rows)
    np.add.at(distinct, codes, members)
    return coded.dictionary, total, distinct


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _split_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dense arrays of one split, folded whenever the pieces outgrow the distinct keys."""
    held: pa.Table | None = None
    pending: list[pa.RecordBatch] = []
    waiting = 0

    def fold() -> pa.Table:
        table = pa.Table.from_batches(pending)
        if held is not None:
            table = pa.concat_tables([held, table])
        keys, n, m = _scatter(table.column(0).cast(pa.string()), _ints(table.column(1)), _ints(table.column(2)))
        return pa.table({"key": keys, "n_rows": n, "n_members": m})

    for batch in batches:
        pending.append(batch.cast(pa.schema([("key", pa.string()), ("n_rows", pa.int64()), ("n_members", pa.int64())])))
        waiting += batch.num_rows
        if waiting > max(200_000, held.num_rows if held else 0):
            held, pending, waiting = fold(), [], 0
    if pending:
        held = fold()
    if held is not None:
        yield from held.to_batches(max_chunksize=50_000)


def _block_arrays(table: pa.Table) -> pa.Table:
    keys, n, m = _scatter(table.column("key").cast(pa.string()), _ints(table.column("n_rows")), _ints(table.column("n_members")))
    return pa.table({"key": keys, "n_rows": pa.array(n), "n_members": pa.array(m)})


def counts_per_key(df: DataFrame, record: str, key: str, member: str, *, blocks: int | None = None) -> DataFrame:
    """``key, n_rows, n_members``: records and distinct non-null members of every non-null key.

    Rows of one ``record`` are copies and count once; a null ``record`` is a
    record of its own for each distinct key and member. Null keys are left out
    (normalise or filter the key beforehand); null members count as rows only.
    ``blocks`` is the number of accumulator blocks, four per shuffle partition
    unless given.
    """
    blocks = blocks or 4 * partitions(df.sparkSession)
    rows = df.select(df[record].alias("r"), df[key].cast("string").alias("key"), df[member].alias("m")).where(F.col("key").isNotNull())
    once = rows.groupBy("r", "key", "m").agg(F.lit(1).alias("one"))
    pairs = once.groupBy("key", "m").agg(F.count(F.lit(1)).alias("n_rows"))
    split = pairs.select("key", "n_rows", F.col("m").isNotNull().cast("long").alias("n_members"))
    pieces = split.mapInArrow(_split_arrays, _SCHEMA)
    by_block = pieces.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    return by_block.groupBy("block").applyInArrow(_block_arrays, _SCHEMA)
