"""Text tables: SAM, BED, BEDPE, BED12, GTF, refFlat, depth, Infernal and Picard files.

All are read by Spark's own splittable text and CSV readers with a stated
schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import schemas
from strandloom.operators.unpack import QUOTED

SAM_HEADER = r"^@[A-Z]{2}\t"


def sam_columns(value: Column) -> list[Column]:
    """The alignment columns of a SAM line; places count from 0, ``*`` stays in names, is null in sequence and qualities.

    ``tags`` holds the values of the optional fields and ``tag_types`` their type letters, both by tag.
    """
    # A header line is no row; it is masked here too, as a condition on a column may run before the one that drops it.
    line = F.when(~value.rlike(SAM_HEADER), value)
    at = lambda i: F.get(F.split(line, "\t"), F.lit(i))
    optional = F.slice(F.split(line, "\t"), F.lit(12), F.greatest(F.size(F.split(line, "\t")), F.lit(0)))
    tags = F.transform(optional, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")))
    types = F.transform(optional, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 4, 1).alias("value")))
    return [
        at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), (at(3).cast("bigint") - 1).alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("rnext"), (at(7).cast("bigint") - 1).alias("pnext"), at(8).cast("bigint").alias("tlen"),
        F.nullif(at(9), F.lit("*")).alias("seq"), F.nullif(at(10), F.lit("*")).alias("qual"), F.map_from_entries(tags).alias("tags"), F.map_from_entries(types).alias("tag_types"),
    ]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The alignments of SAM text; ``ordinal`` rises with the place in the input, without being a count."""
    rows = spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").rlike(SAM_HEADER))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"), *sam_columns(F.col("value")))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """The header lines: ``file, line_no, line``."""
    rows = spark.read.text(path).where(F.col("value").rlike(SAM_HEADER))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("comment", "#").option("mode", "FAILFAST").csv(path)


def read_bed(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """BED6, with further columns of the DDL in ``extra`` (``tag string, cigar string``)."""
    return _tsv(spark, path, schemas.BED6 + (f", {extra}" if extra else ""))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns of a BED file."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").rlike(r"^(#|\s*$)")).select(parts[0].alias("chrom"), parts[1].cast("bigint").alias("start"), parts[2].cast("bigint").alias("end"))


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schemas.BEDPE)


def _numbers(packed: Column) -> Column:
    return F.transform(F.filter(F.split(packed, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("bigint"))


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of BED12 lines, exons as absolute places in genomic order."""
    rows = _tsv(spark, path, schemas.BED12)
    starts = F.transform(_numbers(F.col("block_starts")), lambda s: s + F.col("tx_start"))
    ends = F.zip_with(starts, _numbers(F.col("block_sizes")), lambda s, n: s + n)
    return rows.select("chrom", "tid", "strand", "tx_start", "tx_end", "cds", "cde", "exon_count", starts.alias("exon_starts"), ends.alias("exon_ends"))


def attribute_map(info: Column) -> Column:
    """GTF attributes as a map: whole values in or out of quotes; of a repeated key the last counts."""
    pieces = F.regexp_extract_all(info, F.lit(rf"\s*([\w.\-]+)(?:\s*=\s*|\s+)({QUOTED}|[^;]+)"), F.lit(0))
    pair = lambda p: F.struct(F.regexp_extract(p, r"^\s*([\w.\-]+)", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(p, r"^\s*[\w.\-]+(\s*=\s*|\s+)", "")), "^[\"']|[\"']$", "").alias("value"))
    pairs = F.transform(pieces, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF records with ``attributes`` as a map; places stay as in the file, from 1 and inclusive."""
    return _tsv(spark, path, schemas.GTF).withColumn("attributes", attribute_map(F.col("info")))


def transcripts_in(gtf: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records that overlap a half-open region from 0."""
    return gtf.where((F.col("chrom") == chrom) & (F.col("start") - 1 < end) & (F.col("end") > start))


def read_refflat(spark: SparkSession, path: str, coding_only: bool = True) -> DataFrame:
    """Transcripts of a refFlat table, exon places as arrays."""
    rows = _tsv(spark, path, schemas.REFFLAT).withColumns({"exon_starts": _numbers(F.col("starts")), "exon_ends": _numbers(F.col("ends"))}).drop("starts", "ends")
    return rows.where(F.col("cds") != F.col("cde")) if coding_only else rows


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """Depth by place: ``chrom, pos`` (from 1) ``, value``."""
    return _tsv(spark, path, schemas.DEPTH)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Chromosome sizes."""
    return _tsv(spark, path, schemas.SIZES)


def infernal_columns(value: Column) -> list[Column]:
    """The named columns of a hit line; the description keeps its blanks."""
    parts = F.split(F.trim(value), r"\s+", len(schemas.INFERNAL))
    return [F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(schemas.INFERNAL)]


def read_infernal(spark: SparkSession, path: str) -> DataFrame:
    """Hits of an Infernal ``--tblout`` table, all columns as text."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^(#|\s*$)")).select(*infernal_columns(F.col("value")))


def picard_label(name: Column) -> Column:
    """``PCT_UTR_BASES`` as ``Utr bases``."""
    text = F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("PCT "), F.lit(""))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def melted_metrics(wide: DataFrame, sample: str, regex: str) -> DataFrame:
    """Percent metrics whose names match: ``samplename, variable, var_count``."""
    chosen = [c for c in wide.columns if c != sample]
    long = wide.select(F.col(sample).alias("samplename"), *[F.col(c).cast("double").alias(c) for c in chosen]).unpivot("samplename", chosen, "variable", "var_count")
    return long.where(F.col("variable").rlike(regex) & F.contains("variable", F.lit("PCT"))).withColumn("variable", picard_label(F.col("variable")))


def read_picard_rna(spark: SparkSession, path: str, attr: str = "strand") -> DataFrame:
    """Picard RNA metrics of many files: ``strand`` or ``base`` percentages melted, or the ``cov`` table.

    A metrics file is a page of text; each is one row and parsed as a whole.
    """
    if attr not in ("strand", "cov", "base"):
        raise ValueError("attr must be strand, cov or base")
    skip, rows = (10, None) if attr == "cov" else (6, 1)
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("samplename"), F.split("value", "\r?\n").alias("l"))
    pages = pages.select("samplename", F.slice("l", F.lit(skip + 1), F.size("l")).alias("l"))
    body = F.slice("l", F.lit(2), F.lit(rows) if rows else F.size("l"))
    lines = pages.select("samplename", F.split(F.get("l", F.lit(0)), "\t").alias("names"), F.posexplode(F.filter(body, lambda x: x != "")).alias("row", "line"))
    cells = lines.select("samplename", "row", F.explode(F.arrays_zip("names", F.split("line", "\t").alias("cells"))).alias("x")).select("samplename", "row", F.col("x.names").alias("variable"), F.col("x.cells").try_cast("double").alias("var_count"))
    if attr == "cov":
        return cells
    regex = "UTR|CODI|INTRO|INTER" if attr == "base" else "STRAND"
    return cells.where(F.col("variable").rlike(regex) & F.contains("variable", F.lit("PCT"))).select("samplename", picard_label(F.col("variable")).alias("variable"), "var_count")


def read_annotation_database(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    """The tables tx, tx2exon, exon and gene of an annotation database over JDBC."""
    return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in ("tx", "tx2exon", "exon", "gene")}
