"""Driver queries of the data-processing operators of the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.dense_counts import counts_per_key
from strandloom.operators.periods import periods_and_gaps
from strandloom.operators.rejects import faulty_lines, valid_bed12, valid_gtf
from strandloom.operators.unpack import attribute_values, list_values
from strandloom.queries.problem_sql import P3, P7, P7_BED, P7_GTF


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clean_barcode(barcode: Column) -> Column:
    """Upper case without surrounding white space; null where it is null or holds an N."""
    tidy = F.upper(F.regexp_replace(barcode, r"\A\s+|\s+\z", ""))
    return F.when(~F.contains(tidy, F.lit("N")), tidy)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fragments").where(F.col("chrom").isNotNull() & F.col("strand").isin("+", "-"))
    return periods_and_gaps(rows, ["lib_id", "chrom", "strand"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    gtf = table(spark, sf, "gtf_records").select("rec_id", "src_name", "info").dropDuplicates(["rec_id"])
    bed = table(spark, sf, "bed12_records").select("rec_id", "chrom", "exon_starts", "exon_ends").dropDuplicates(["rec_id"])
    out = attribute_values(gtf, ["rec_id"], "info", "src_name").withColumn("rec_tab", F.lit("gtf_records"))
    for field in ("exon_starts", "exon_ends"):
        out = out.unionByName(list_values(bed, ["rec_id"], field, "chrom").withColumn("rec_tab", F.lit("bed12_records")))
    return out.select("rec_tab", "rec_id", "attr_key", "idx", "attr_val")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fastq_reads").select("rec_id", clean_barcode(F.col("barcode")).alias("barcode"), "group_id")
    return counts_per_key(rows, "rec_id", "barcode", "group_id").select(F.col("key").alias("barcode"), F.col("n_rows").alias("n_reads"), F.col("n_members").alias("n_groups"))


def p5_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Barcodes and distinct UMIs of each fragment group, one of which holds a tenth of the rows."""
    rows = table(spark, sf, "barcode_sets").select("bc_id", "group_id", F.upper("umi").alias("umi"))
    out = counts_per_key(rows, "bc_id", "group_id", "umi")
    return out.select(F.col("key").cast("long").alias("group_id"), F.col("n_rows").alias("n_barcodes"), F.col("n_members").alias("n_umis"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return faulty_lines(table(spark, sf, "annot_lines"))


def p7_valid_gtf(spark: SparkSession, sf: str) -> DataFrame:
    rows = valid_gtf(table(spark, sf, "annot_lines"))
    return rows.withColumns({c: F.col(c).cast("long") for c in ("start_pos", "end_pos")})


def p7_valid_bed12(spark: SparkSession, sf: str) -> DataFrame:
    rows = valid_bed12(table(spark, sf, "annot_lines"))
    total = F.aggregate("block_sizes", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    return rows.select("line_id", "chrom", F.col("tx_start").cast("long").alias("tx_start"), F.col("tx_end").cast("long").alias("tx_end"), "tid", "strand", "exon_count", total.cast("long").alias("exon_bases"))


_TIDY = r"upper(regexp_replace(barcode, '^\s+|\s+$', '', 'g'))"
SQL = {
    "p2_found": """
with r as (select distinct lib_id, chrom, strand, start_pos s, end_pos e from fragments
           where chrom is not null and strand in ('+','-') and start_pos >= 0 and start_pos < end_pos),
m as (select *, max(e) over (partition by lib_id, chrom, strand order by s, e rows between unbounded preceding and 1 preceding) before from r),
i as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by lib_id, chrom, strand order by s, e) island from m),
p as (select lib_id, chrom, strand, island, min(s) a, max(e) b from i group by all),
g as (select *, lead(a) over (partition by lib_id, chrom, strand order by a) nxt from p)
select lib_id, chrom, strand, 'covered' seg_kind, a seg_start, b seg_end from g
union all select lib_id, chrom, strand, 'gap', b, nxt from g where nxt is not null""",
    "p3_found": P3,
    "p7_found": P7,
    "p7_valid_gtf": P7_GTF,
    "p7_valid_bed12": P7_BED,
    "p5_found": f"""
with r as (select distinct rec_id, {_TIDY} barcode, group_id from fastq_reads)
select barcode, count(*) n_reads, count(distinct group_id) n_groups from r
where barcode is not null and not contains(barcode, 'N') group by 1""",
    "p5_group_sizes": """
with r as (select distinct bc_id, group_id, upper(umi) umi from barcode_sets where group_id is not null)
select group_id, count(*) n_barcodes, count(distinct umi) n_umis from r group by 1""",
}

QUERIES = {f.__name__: f for f in (p2_found, p3_found, p5_found, p5_group_sizes, p7_found, p7_valid_gtf, p7_valid_bed12)}
