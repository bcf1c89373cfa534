"""Lines that can't be read as what they claim to be, set apart with the reason; the others loaded.

Every line explodes into cells (row, column, value). A table of rules joins by
kind and column, each cell is judged by its rules, and the failures of a row
aggregate to the first reason that holds. Failures are few and combine before
the shuffle; valid rows are what an anti-join with them leaves. The rule table
is a constant of this module (under 30 rows), the only thing that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.unpack import ATTRIBUTE_NOTATIONS, QUOTED

REASONS = ("columns", "quoting", "values")
#: (kind, column, check): columns count from 1; 0 is the number of fields, -1 every field, 100 and up are composed of several.
RULES = (
    ("gtf", 0, "nine"), ("gtf", -1, "closed"), ("gtf", 4, "whole"), ("gtf", 5, "whole"), ("gtf", 100, "from_one"),
    ("gtf", 7, "strand_or_dot"), ("gtf", 8, "phase"), ("gtf", 9, "gene_id"),
    ("bed12", 0, "twelve"), ("bed12", -1, "closed"), ("bed12", 2, "whole"), ("bed12", 3, "whole"), ("bed12", 100, "ascending"),
    ("bed12", 6, "strand"), ("bed12", 10, "whole"), ("bed12", 101, "blocks"),
)
_REASON_OF = {"nine": 0, "twelve": 0, "closed": 1}
_WHOLE = r"\A[0-9]+\z"
_CLOSED = r'''"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+\''''


def _number(value: Column) -> Column:
    return F.when(value.rlike(_WHOLE), value).try_cast("decimal(38,0)")


def _items(value: Column) -> Column:
    bare = F.regexp_replace(value, r'''\A(["'])(.*)\1\z''', "$2")
    return F.split(F.regexp_replace(bare, r",\z", ""), ",", -1)


def _gene_id(value: Column) -> Column:
    pieces = ATTRIBUTE_NOTATIONS[0].pieces(value)
    good = rf'''(?s)\A\s*gene_id(?:\s*=\s*|\s+(?=["']))(?!""\s*\z|''\s*\z)(?:{QUOTED}|[^"'\s].*?)\s*\z'''
    return F.exists(pieces, lambda p: p.rlike(good))


def _blocks(value: Column) -> Column:
    part = F.split(value, "\t", -1)
    count, sizes, starts = _number(F.get(part, F.lit(0))), _items(F.get(part, F.lit(1))), _items(F.get(part, F.lit(2)))
    numbers = F.transform(starts, _number)
    sorted_ = F.aggregate(numbers, F.struct(F.lit(-1).cast("decimal(38,0)").alias("last"), F.lit(True).alias("ok")), lambda a, x: F.struct(F.coalesce(x, a["last"]).alias("last"), (a["ok"] & x.isNotNull() & (x > a["last"])).alias("ok")))["ok"]
    return (count >= 1) & (F.size(sizes) == count) & (F.size(starts) == count) & F.forall(sizes, lambda s: F.coalesce(_number(s) > 0, F.lit(False))) & F.coalesce(sorted_, F.lit(False))


def _judge(check: Column, value: Column) -> Column:
    """Whether ``value`` holds to ``check``; null where it can't be told, which counts as a failure."""
    part = F.split(value, "\t", -1)
    first, second = _number(F.get(part, F.lit(0))), _number(F.get(part, F.lit(1)))
    return (
        F.when(check == "nine", value == "9")
        .when(check == "twelve", value == "12")
        .when(check == "closed", ~F.regexp_replace(value, rf"(?s){_CLOSED}", "").rlike("[\"']"))
        .when(check == "whole", value.rlike(_WHOLE))
        .when(check == "from_one", (first >= 1) & (first <= second))
        .when(check == "ascending", (first >= 0) & (first < second))
        .when(check == "strand_or_dot", value.isin("+", "-", "."))
        .when(check == "strand", value.isin("+", "-"))
        .when(check == "phase", value.isin("0", "1", "2", "."))
        .when(check == "gene_id", _gene_id(value))
        .when(check == "blocks", _blocks(value))
    )


def _lines(df: DataFrame, line: str, kind: str, raw: str) -> DataFrame:
    """Each line once, as id, kind and cells; blank lines, comments and null texts are gone."""
    rows = df.select(df[line].alias("id"), df[kind].alias("kind"), df[raw].alias("raw"))
    rows = rows.where(F.col("raw").isNotNull() & ~F.col("raw").rlike(r"\A\s*\z") & ~F.col("raw").startswith("#"))
    return rows.dropDuplicates(["id"]).select("id", "kind", F.split(F.rtrim("raw", F.lit("\r")), "\t", -1).alias("cells"))


def _cell(col: int, *parts: int) -> Column:
    return F.struct(F.lit(col).alias("col"), F.concat_ws("\t", *[F.coalesce(F.get("cells", F.lit(p - 1)), F.lit("")) for p in parts]).alias("value"))


def faulty_lines(df: DataFrame, line: str = "line_id", kind: str = "line_kind", raw: str = "raw_line") -> DataFrame:
    """``line, reason`` of each line that can't be read as its kind, with the first reason that holds of ``REASONS``.

    Lines of one id are copies and judged once. Blank lines, those that begin
    with ``#`` and null texts are neither valid nor faulty; so are lines of a
    null or unknown kind, which claim nothing. A carriage return at the end is
    no fault. Whole numbers are digits alone, up to 38 of them.
    """
    rows = _lines(df, line, kind, raw).where(F.col("kind").isin("gtf", "bed12"))
    own = F.transform("cells", lambda v, i: F.struct((i + 1).cast("int").alias("col"), v.alias("value")))
    every = F.transform("cells", lambda v: F.struct(F.lit(-1).alias("col"), v.alias("value")))
    number = F.array(F.struct(F.lit(0).alias("col"), F.size("cells").cast("string").alias("value")))
    composed = F.when(F.col("kind") == "gtf", F.array(_cell(100, 4, 5))).otherwise(F.array(_cell(100, 2, 3), _cell(101, 10, 11, 12)))
    cells = rows.select("id", "kind", F.explode(F.concat(own, every, number, composed)).alias("cell")).select("id", "kind", "cell.col", "cell.value")
    rules = df.sparkSession.createDataFrame([(k, c, check, _REASON_OF.get(check, 2)) for k, c, check in RULES], "kind string, col int, check string, rank int")
    judged = cells.join(F.broadcast(rules), ["kind", "col"]).where(~F.coalesce(_judge(F.col("check"), F.col("value")), F.lit(False)))
    first = judged.groupBy("id").agg(F.min("rank").alias("rank"))
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("rank") + 1)
    return first.select(F.col("id").alias(line), reason.alias("reason"))


def _valid(df: DataFrame, line: str, kind: str, raw: str, which: str) -> DataFrame:
    faults = faulty_lines(df, line, kind, raw).select(F.col(line).alias("bad"))
    rows = _lines(df, line, kind, raw).where(F.col("kind") == which)
    return rows.join(faults, F.col("id") == F.col("bad"), "left_anti")


def valid_gtf(df: DataFrame, line: str = "line_id", kind: str = "line_kind", raw: str = "raw_line") -> DataFrame:
    """The GTF lines without a fault, typed: coordinates as numbers, ``.`` in score, strand and phase as null.

    Types are tried, not forced: a later condition on them may run before the
    faulty lines are gone.
    """
    at = lambda i: F.get("cells", F.lit(i - 1))
    dot = lambda i: F.nullif(at(i), F.lit("."))
    return _valid(df, line, kind, raw, "gtf").select(
        F.col("id").alias(line), at(1).alias("chrom"), at(2).alias("src_name"), at(3).alias("feature_type"), at(4).try_cast("decimal(38,0)").alias("start_pos"), at(5).try_cast("decimal(38,0)").alias("end_pos"),
        dot(6).try_cast("double").alias("score"), dot(7).alias("strand"), dot(8).try_cast("int").alias("phase"), at(9).alias("info"),
    )


def valid_bed12(df: DataFrame, line: str = "line_id", kind: str = "line_kind", raw: str = "raw_line") -> DataFrame:
    """The BED12 lines without a fault, with block sizes and starts as arrays."""
    at = lambda i: F.get("cells", F.lit(i - 1))
    numbers = lambda i: F.transform(_items(at(i)), lambda x: x.try_cast("decimal(38,0)"))
    return _valid(df, line, kind, raw, "bed12").select(
        F.col("id").alias(line), at(1).alias("chrom"), at(2).try_cast("decimal(38,0)").alias("tx_start"), at(3).try_cast("decimal(38,0)").alias("tx_end"), F.regexp_replace(at(4), r'''\A(["'])(.*)\1\z''', "$2").alias("tid"),
        at(6).alias("strand"), at(10).try_cast("int").alias("exon_count"), numbers(11).alias("block_sizes"), numbers(12).alias("block_starts"),
    )
