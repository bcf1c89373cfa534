"""Writers. Each writes a folder of parts in parallel; ``single`` gathers sorted rows into one part where a tool needs it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import drop_settled, settle


def fastq_text(name: Column, seq: Column, qual: Column, description: Column | None = None) -> Column:
    """A record in four lines. A description is the whole header, so the name is not written twice."""
    head = F.coalesce(F.nullif(F.ltrim(description, F.lit("@")), F.lit("")), name) if description is not None else name
    return F.concat(F.lit("@"), head, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def _write(df: DataFrame, path: str, single: bool, order: Sequence[str], compression: str | None) -> None:
    out = df.repartition(1).sortWithinPartitions(*order) if single else df
    writer = out.select("value").write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_fastq(df: DataFrame, path: str, *, single: bool = False, order: Sequence[str] = ("id",), compression: str | None = None) -> None:
    """Records ``id seq qual`` and, if there, ``description``."""
    text = fastq_text(F.col("id"), F.col("seq"), F.col("qual"), F.col("description") if "description" in df.columns else None)
    _write(df.withColumn("value", text), path, single, order, compression)


def write_interleaved(pairs: DataFrame, path: str, *, name: str = "name", single: bool = False, compression: str | None = None) -> None:
    """Mates one after the other in one record of eight lines, so that no writer parts them."""
    two = [fastq_text(F.col(name), F.col(f"seq{k}"), F.col(f"qual{k}")) for k in (1, 2)]
    _write(pairs.withColumn("value", F.concat_ws("\n", *two)), path, single, [name], compression)


def write_fasta(df: DataFrame, path: str, *, name: str = "seq_id", single: bool = False) -> None:
    _write(df.withColumn("value", F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col("seq"))), path, single, [name], None)


def sam_text(columns: Sequence[str] = ()) -> Column:
    """A SAM line of an alignment row; places from 1.

    Tags have the type that ``tag_types`` (where it is among ``columns``) gives
    them; others are i for whole numbers, else Z.
    """
    guessed = lambda t: F.when(t["value"].rlike("^-?[0-9]{1,9}$"), F.lit("i")).otherwise(F.lit("Z"))
    kind = (lambda t: F.coalesce(F.col("tag_types")[t["key"]], guessed(t))) if "tag_types" in columns else guessed
    tags = F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit(":"), kind(t), F.lit(":"), t["value"]))
    text = lambda c, missing: F.coalesce(F.col(c).cast("string"), F.lit(missing))
    plain = [text("qname", "*"), text("flag", "0"), text("rname", "*"), (F.coalesce("pos", F.lit(-1)) + 1).cast("string"), text("mapq", "255"), text("cigar", "*"), F.when((F.col("rnext") == F.col("rname")) & (F.col("rnext") != "*"), "=").otherwise(F.coalesce("rnext", F.lit("*"))), (F.coalesce("pnext", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*"))]
    return F.concat_ws("\t", *plain, F.filter(tags, lambda t: t.isNotNull()))


def write_sam(df: DataFrame, path: str, header: Sequence[str] = (), *, order: Sequence[str] = ("rname", "pos"), single: bool = False) -> None:
    """SAM text in parts sorted by ``order``; the first begins with the header, so that the parts one after the other are the file."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, i, line) for i, line in enumerate(header)], "part__ int, nth__ long, value string")
    body = df.withColumn("value", sam_text(df.columns)).select(F.lit(1).alias("part__"), *[F.col(c).alias(f"o{i}__") for i, c in enumerate(order)], "value")
    for i in range(len(order)):
        head = head.withColumn(f"o{i}__", F.lit(None).cast(body.schema[f"o{i}__"].dataType))
    both = head.unionByName(body.withColumn("nth__", F.lit(0).cast("long")))
    by = ["part__", "nth__", *[f"o{i}__" for i in range(len(order))]]
    if not single:
        both = both.repartitionByRange(*by).sortWithinPartitions(*by)
    _write(both, path, single, by, None)


def write_bam(df: DataFrame, path: str, header: str, *, index: bool = False) -> None:
    """BAM files, one a task, each complete with the header and, if asked, an index beside it."""
    from strandloom import schemas
    from strandloom.sources.sequences import register

    register(df.sparkSession)
    names = [c.split(" ")[0] for c in schemas.ALIGNMENT.split(", ")]
    have = df
    for c, kind in (x.split(" ", 1) for x in schemas.ALIGNMENT.split(", ")):
        if c not in df.columns:
            have = have.withColumn(c, F.lit(None).cast(kind))
    have.select(*names).write.format("bam").option("header", header).option("index", str(index).lower()).mode("append").save(path)


def write_tsv(df: DataFrame, path: str, *, header: bool = False, single: bool = False, order: Sequence[str] = (), compression: str | None = None) -> None:
    """Tab-separated rows."""
    out = df.repartition(1).sortWithinPartitions(*order) if single and order else df.coalesce(1) if single else df
    writer = out.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "")
    (writer.option("compression", compression) if compression else writer).csv(path)


def dedup_bed(molecules: DataFrame) -> DataFrame:
    """BED6 of deduplicated molecules (``chrom start end strand umi n_members``), named ``UMI_n_members``; a ``cigar`` joins the name."""
    name = F.concat(F.col("umi"), F.lit("_"), F.col("n_members").cast("string"), F.lit("_members"))
    if "cigar" in molecules.columns:
        name = F.concat_ws("_", name, "cigar")
    return molecules.select("chrom", "start", "end", name.alias("name"), (F.col("end") - F.col("start")).alias("length"), "strand")


def write_split(df: DataFrame, path: str, bucket: str = "bucket") -> None:
    """One scan into a folder of Parquet for each bucket."""
    df.write.mode("overwrite").partitionBy(bucket).parquet(path)


def write_split_alignments(df: DataFrame, path: str, header: Sequence[str], buckets: Sequence[str], *, bam: bool = False, bucket: str = "bucket", order: Sequence[str] = ("ordinal",)) -> None:
    """SAM, or with ``bam`` BAM, in a folder ``bucket=NAME`` for each of ``buckets``; rows are computed once. An empty bucket has no folder."""
    rows = settle(df, "split", parts=bucket)
    for name in buckets:
        part = rows.where(F.col(bucket) == name).drop(bucket)
        if part.isEmpty():
            continue
        if bam:
            write_bam(part, f"{path}/{bucket}={name}", "\n".join(header) + "\n")
        else:
            write_sam(part, f"{path}/{bucket}={name}", header, order=order)
    drop_settled(rows)
