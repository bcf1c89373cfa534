"""CIGAR strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = r"([0-9]+)([MIDNSHP=X])"


def numbers(cigar: Column) -> Column:
    """The lengths of the operations in order."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(_RUN), F.lit(1)), lambda n: n.cast("int"))


def operations(cigar: Column) -> Column:
    """The letters of the operations in order."""
    return F.regexp_extract_all(cigar, F.lit(_RUN), F.lit(2))


def runs(cigar: Column) -> Column:
    """The operations as an array of (op, n)."""
    return F.zip_with(operations(cigar), numbers(cigar), lambda op, n: F.struct(op.alias("op"), n.alias("n")))


def total(cigar: Column, ops: str) -> Column:
    """Summed length of the operations among ``ops``; 0 without any, null for a null CIGAR."""
    lengths = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n.cast("int"))


def reference_length(cigar: Column) -> Column:
    """Places of the reference that an alignment spans."""
    return total(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    """Bases of the read that an alignment accounts for, soft-clipped ones included."""
    return total(cigar, "MIS=X")


def mapped_length(cigar: Column) -> Column:
    """Bases in match operations (M)."""
    return total(cigar, "M")


def clipped(cigar: Column) -> Column:
    """Soft-clipped bases in all."""
    return total(cigar, "S")


def longest_clip(cigar: Column) -> Column:
    """The longest soft clip; 1 where there is none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)S"), F.lit(1)), lambda n: n.cast("int"))), F.lit(1))


def expand(cigar: Column) -> Column:
    """One letter for each base of the read: the M, I and S operations written out."""
    read = F.filter(runs(cigar), lambda r: r["op"].isin("M", "I", "S"))
    return F.array_join(F.transform(read, lambda r: F.repeat(r["op"], r["n"])), "")


def without_insertions(text: Column, expanded: Column) -> Column:
    """A read's sequence or qualities without the places whose expanded operation is I."""
    pairs = F.zip_with(F.split(text, ""), F.split(expanded, ""), lambda c, o: F.struct(c.alias("c"), o.alias("o")))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["o"] != "I"), lambda p: p["c"]), "")


def aligned_blocks(cigar: Column, pos: Column) -> Column:
    """The ungapped stretches of an alignment as an array of (q, r, n): start in the read, on the reference, length.

    One fold over the operations: matches emit a stretch and advance both,
    insertions and soft clips the read, deletions and skips the reference.
    """
    kind = "struct<q:int,r:bigint,blocks:array<struct<q:int,r:bigint,n:int>>>"
    start = F.struct(F.lit(0).alias("q"), pos.cast("bigint").alias("r"), F.array().cast("array<struct<q:int,r:bigint,n:int>>").alias("blocks")).cast(kind)

    def step(acc: Column, run: Column) -> Column:
        match, query, ref = run["op"].isin("M", "=", "X"), run["op"].isin("I", "S"), run["op"].isin("D", "N")
        block = F.array(F.struct(acc["q"].alias("q"), acc["r"].alias("r"), run["n"].alias("n")))
        return F.struct(
            (acc["q"] + F.when(match | query, run["n"]).otherwise(0)).alias("q"),
            (acc["r"] + F.when(match | ref, run["n"]).otherwise(0)).cast("bigint").alias("r"),
            F.when(match, F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"),
        ).cast(kind)

    return F.aggregate(runs(cigar), start, step)["blocks"]


def aligned_start(cigar: Column, pos: Column) -> Column:
    """The first aligned place on the reference (0-based), null without one."""
    return F.array_min(F.transform(aligned_blocks(cigar, pos), lambda b: b["r"]))


def aligned_end(cigar: Column, pos: Column) -> Column:
    """The place after the last aligned one, null without one."""
    return F.array_max(F.transform(aligned_blocks(cigar, pos), lambda b: b["r"] + b["n"]))
