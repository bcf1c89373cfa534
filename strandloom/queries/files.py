"""Driver queries that go through files: tables are written in a format, read back and compared, with their SQL.

Files stand in a scratch folder that all executors share. Every query writes
and reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import pairs, pileup
from strandloom.queries.core_problems import table
from strandloom.queries.sequencing import _MATES, _TX, ALL_SQL, F_SQL, R_SQL, alignments, frags, reads, sequences, transcripts
from strandloom.session import scratch_folder, settle
from strandloom.sources import sequences as readers
from strandloom.sources import bigwig, sinks, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    """Register a query under its function's name."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).select(F.col("rec_id").cast("string").alias("id"), "seq", "qual", F.concat(F.col("rec_id").cast("string"), F.lit(" of "), "barcode").alias("description"))


@query(f"with {R_SQL} select rec_id::varchar id, seq, qual, rec_id || ' of ' || barcode description from r")
def file_fastq(spark: SparkSession, sf: str) -> DataFrame:
    """Reads through gzipped FASTQ."""
    folder = scratch_folder(spark, "fastq")
    sinks.write_fastq(_records(spark, sf), folder, compression="gzip")
    return readers.read_fastq(spark, folder).select("id", "seq", "qual", "description")


@query(f"with {R_SQL} select rec_id::varchar id, true same from r")
def file_fastq_split(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of plain FASTQ split by bytes beside those of whole files, by file and ordinal."""
    folder = scratch_folder(spark, "fastq")
    sinks.write_fastq(_records(spark, sf), folder)
    whole = readers.read_fastq(spark, folder).select("file", "ordinal", "id", "seq", "qual")
    split = readers.read_fastq(spark, folder, split_bytes=1 << 16).select("file", "ordinal", F.col("id").alias("i"), F.col("seq").alias("s"), F.col("qual").alias("q"))
    same = (F.col("id") == F.col("i")) & (F.col("seq") == F.col("s")) & (F.col("qual") == F.col("q"))
    return whole.join(split, ["file", "ordinal"]).select("id", same.alias("same"))


@query(f"with {R_SQL} select rec_id::varchar id1, rec_id::varchar id2, length(seq)::int n1, length(seq)::int + rec_id % 3 n2 from r")
def file_two_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Reads 1 and reads 2 in several files a side, split by bytes; reads 2 are longer by up to two bases, so offsets differ."""
    longer = F.substring(F.lit("GG"), F.lit(1), (F.col("rec_id") % 3).cast("int"))
    rows = settle(reads(spark, sf).select("rec_id", "seq", "qual", F.concat(S.reverse_complement(F.col("seq")), longer).alias("seq2")), "lanes")
    sides = []
    for seq, qual in (("seq", F.col("qual")), ("seq2", F.rpad(F.reverse("qual"), F.length("seq2"), F.lit("I")))):
        folder = scratch_folder(spark, "lanes")
        side = rows.select("rec_id", F.col("rec_id").cast("string").alias("id"), F.col(seq).alias("seq"), qual.alias("qual"))
        sinks.write_fastq(side.repartition(4, F.col("rec_id") % 4).sortWithinPartitions("rec_id"), folder)
        sides.append(readers.read_fastq(spark, folder, split_bytes=1 << 16))
    both = pairs.zipped_pairs(*sides)
    return both.select(F.col("r1.id").alias("id1"), F.col("r2.id").alias("id2"), F.length("r1.seq").alias("n1"), F.length("r2.seq").cast("long").alias("n2"))


@query(f"with {R_SQL} select rec_id::varchar id, seq seq1, reverse(translate(seq, 'ACGTN', 'TGCAN')) seq2 from r where length(seq) >= 30")
def file_interleaved(spark: SparkSession, sf: str) -> DataFrame:
    """Interleaved FASTQ, taken apart with a least length and put side by side again."""
    folder = scratch_folder(spark, "interleaved")
    rows = reads(spark, sf).select(F.col("rec_id").cast("string").alias("name"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"), S.reverse_complement(F.col("seq")).alias("seq2"), F.reverse("qual").alias("qual2"))
    sinks.write_interleaved(rows, folder)
    one, two = pairs.deinterleaved(pairs.interleaved_pairs(readers.read_fastq(spark, folder)), 30)
    return one.select("file", "pair", "id", F.col("seq").alias("seq1")).join(two.select("file", "pair", F.col("seq").alias("seq2")), ["file", "pair"]).select("id", "seq1", "seq2")


@query(f"with {ALL_SQL} select rec_id::varchar chrom, i::bigint pos, substr(seq, i + 1, 1) as ref from (select rec_id, seq, unnest(range(0, length(seq), 7)) i from r) where seq <> ''")
def file_fasta_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh base of FASTA sequences, looked up by place in pieces of them."""
    rows = settle(sequences(spark, sf, 1).select(F.col("rec_id").cast("string").alias("seq_id"), "seq"), "references")
    folder = scratch_folder(spark, "fasta")
    sinks.write_fasta(rows, folder)
    at = rows.select(F.col("seq_id").alias("chrom"), F.explode(F.sequence(F.lit(0).cast("long"), (F.length("seq") - 1).cast("long"), F.lit(7).cast("long"))).alias("pos"))
    return pileup.reference_bases(readers.read_fasta(spark, folder, tile=pileup.TILE), at)


def _written_alignments(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Alignments with all columns of the format and tags of three types, and a header."""
    rows = alignments(spark, sf)
    tags = F.create_map(F.lit("RX"), F.coalesce(F.col("tags")["RX"], F.lit("N")), F.lit("MD"), F.lit("10"), F.lit("XF"), F.lit("1.5"), F.lit("NH"), F.col("tags")["NH"])
    types = F.create_map(*[F.lit(x) for pair in {"RX": "Z", "MD": "Z", "XF": "f", "NH": "i"}.items() for x in pair])
    rows = rows.withColumns({"tags": tags, "tag_types": types, "mapq": F.coalesce("mapq", F.lit(255)), "tlen": F.coalesce(F.col("tlen"), F.lit(0)).cast("long"), "pnext": F.col("pos"), "rnext": F.col("rname"), "seq": F.lit(None).cast("string"), "qual": F.lit(None).cast("string")})
    # A line a chromosome: as many as the genome has.
    sizes = frags(spark, sf).groupBy("chrom").agg(F.max("end").alias("n")).orderBy("chrom").collect()
    return settle(rows, "alignments"), ["@HD\tVN:1.6", *[f"@SQ\tSN:{r.chrom}\tLN:{r.n + 10_000}" for r in sizes]]


def _shown(rows: DataFrame) -> DataFrame:
    at = lambda c, t: F.col(c)[t]
    typed = F.concat_ws(" ", *[F.concat_ws(":", F.lit(t), at("tag_types", t), at("tags", t)) for t in ("RX", "MD", "XF", "NH")])
    return rows.select("qname", "flag", "rname", F.col("pos").cast("long").alias("pos"), "mapq", "cigar", "tlen", typed.alias("typed"))


_SHOWN = f"""{_MATES}, w as (select frag_id::varchar qname, f1 flag, chrom rname, s1::bigint pos, coalesce(mapq, 255) mapq, c1 cigar, coalesce(t1, 0)::bigint tlen, tag, a.mapq m from a
union all select frag_id::varchar, f2, chrom, s2::bigint, coalesce(mapq, 255), c2, coalesce(-t1, 0)::bigint, tag, a.mapq from a),
v as (select qname, flag, rname, pos, mapq, cigar, tlen, 'RX:Z:' || coalesce(tag, 'N') || ' MD:Z:10 XF:f:1.5 NH:i:' || case when m >= 42 then '1' else '3' end typed from w)"""


@query(f"with {_SHOWN} select * from v")
def file_sam(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments through SAM text, with the types of their tags."""
    rows, header = _written_alignments(spark, sf)
    folder = scratch_folder(spark, "sam")
    sinks.write_sam(rows, folder, header)
    return _shown(tables.read_sam(spark, folder))


@query(f"with {_SHOWN} select * from v")
def file_bam(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments through BAM, read in stretches between places of the index, with the types of their tags."""
    rows, header = _written_alignments(spark, sf)
    folder = scratch_folder(spark, "bam")
    sinks.write_bam(rows.repartitionByRange("rname", "pos").sortWithinPartitions("rname", "pos"), folder, "\n".join(header) + "\n", index=True)
    return _shown(readers.read_bam(spark, f"{folder}/*.bam", split_bytes=1 << 16))


@query(f"""with {_MATES}, w as (select frag_id::varchar qname, f1 flag, chrom, s1 p, s1 + list_sum([x::bigint for x in regexp_extract_all(c1, '([0-9]+)[MDN]', 1)]) e from a
union all select frag_id::varchar, f2, chrom, s2, s2 + list_sum([x::bigint for x in regexp_extract_all(c2, '([0-9]+)[MDN]', 1)]) from a)
select qname, flag, p::bigint pos from w where chrom = 'chr1' and p < 60000000 and e > 1000000""")
def file_bam_region(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments over a region of indexed BAM files: the reader looks up where they stand."""
    rows, header = _written_alignments(spark, sf)
    folder = scratch_folder(spark, "bam")
    sinks.write_bam(rows.repartitionByRange("rname", "pos").sortWithinPartitions("rname", "pos"), folder, "\n".join(header) + "\n", index=True)
    found = pileup.overlapping(readers.read_bam(spark, f"{folder}/*.bam", region="chr1:1000000-60000000"), "chr1", 1_000_000, 60_000_000)
    return found.select("qname", "flag", "pos")


@query(f"with {_MATES} select frag_id::varchar qname, f1 flag, case when contains(c1, 'N') or contains(c2, 'N') then 'split' else 'fragment' end bucket from a where f1 & 256 = 0 union all select frag_id::varchar, f2, case when contains(c1, 'N') or contains(c2, 'N') then 'split' else 'fragment' end from a where f1 & 256 = 0")
def file_split_bam(spark: SparkSession, sf: str) -> DataFrame:
    """Spliced pairs and others as BAM files of their own."""
    rows, header = _written_alignments(spark, sf)
    routed = pairs.unpair(pairs.route_spliced(pairs.mates(rows)), [c for c in rows.columns if c != "qname"], ["bucket"]).drop("mate")
    folder = scratch_folder(spark, "buckets")
    sinks.write_split_alignments(routed, folder, header, ["split", "fragment"], bam=True)
    back = readers.read_bam(spark, f"{folder}/bucket=*/*.bam")
    return back.select("qname", "flag", F.regexp_extract("file", "bucket=([a-z]+)", 1).alias("bucket"))


@query(f"""with {F_SQL} select chrom, "start", "end", frag_id::varchar as name, ("end" - "start")::double as length, strand, tag from f where tag is not null""")
def file_bed(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments through BED with a further column."""
    rows = frags(spark, sf).where(F.col("tag").isNotNull()).select("chrom", "start", "end", F.col("frag_id").cast("string"), F.col("end") - F.col("start"), "strand", "tag")
    folder = scratch_folder(spark, "bed")
    sinks.write_tsv(rows, folder)
    return tables.read_bed(spark, folder, "tag string")


@query("""with g as (select distinct on (rec_id) * from gtf_records where chrom is not null and start_pos is not null and end_pos is not null)
select rec_id, chrom, start_pos as "start", end_pos as "end", 'g ' || rec_id gene_id, 'a; "b"' note from g where chrom = 'chr1' and start_pos - 1 < 100000000 and end_pos > 0""")
def file_gtf(spark: SparkSession, sf: str) -> DataFrame:
    """GTF records of a region, with quoted attributes of which one repeats."""
    rows = table(spark, sf, "gtf_records").dropDuplicates(["rec_id"]).where(F.col("chrom").isNotNull() & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())
    info = F.format_string('gene_id "g %d"; note "first"; rec=%d; note "a; \\"b\\""', "rec_id", "rec_id")
    rows = rows.select("chrom", F.lit("s"), F.lit("exon"), "start_pos", "end_pos", F.lit("."), F.lit("+"), F.lit("."), info)
    folder = scratch_folder(spark, "gtf")
    sinks.write_tsv(rows, folder)
    at = lambda k: F.col("attributes")[k]
    found = tables.transcripts_in(tables.read_gtf(spark, folder), "chr1", 0, 100_000_000)
    return found.select(at("rec").cast("long").alias("rec_id"), "chrom", "start", "end", at("gene_id").alias("gene_id"), F.replace(at("note"), F.lit("\\"), F.lit("")).alias("note"))


@query(f"with {_TX} select tid, strand, cds, cde, exon_count, list_sum([x::bigint for x in a])::bigint starts, list_sum([x::bigint for x in b])::bigint ends from tx where cds <> cde")
def file_refflat(spark: SparkSession, sf: str) -> DataFrame:
    """Coding transcripts through a refFlat table."""
    rows = transcripts(spark, sf)
    packed = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    folder = scratch_folder(spark, "refflat")
    sinks.write_tsv(rows.select(F.lit("gene"), "tid", F.coalesce("chrom", F.lit("?")), "strand", F.coalesce("tx_start", F.lit(0)), F.coalesce("tx_end", F.lit(0)), "cds", "cde", "exon_count", packed("exon_starts"), packed("exon_ends")), folder)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return tables.read_refflat(spark, folder).select("tid", "strand", "cds", "cde", "exon_count", total("exon_starts").alias("starts"), total("exon_ends").alias("ends"))


@query(f"""with {F_SQL}, d as (select chrom, "start" + 1 pos, count(*) n from f group by all) select chrom, pos - 1 as "start", n as "value" from d""")
def file_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments that begin at each place, through a depth table into runs cut to single places."""
    folder = scratch_folder(spark, "depth")
    sinks.write_tsv(frags(spark, sf).groupBy("chrom", (F.col("start") + 1).alias("pos")).agg(F.count(F.lit(1)).alias("n")), folder)
    runs = pileup.bedgraph(tables.read_depth(spark, folder))
    return runs.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("start"), "value")


@query(f"""with {F_SQL}, d as (select chrom, "start", count(*)::double n from f group by all), z as (select chrom, max("end") size from f group by 1)
select chrom, "start", n as "value", size from d join z using (chrom)""")
def file_bigwig(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments that begin at each place, through bigWig files that cover every chromosome; the zeros between are left out here."""
    rows = frags(spark, sf)
    depth = rows.groupBy("chrom", (F.col("start") + 1).alias("pos")).agg(F.count(F.lit(1)).alias("value"))
    folder = scratch_folder(spark, "bigwig")
    bigwig.write_bigwig(pileup.bedgraph(depth), rows.groupBy("chrom").agg(F.max("end").alias("size")), folder)
    back = bigwig.read_bigwig(spark, f"{folder}/*.bigWig").where("value > 0")
    return back.select("chrom", "size", F.explode(F.sequence("start", F.col("end") - 1)).alias("start"), "value")


@query(f"""with {F_SQL}, b as (select *, case when frag_id % 7 = 0 then strand when strand = '+' then '-' else '+' end o from f)
select chrom, "start", "end", frag_id::varchar as name, "end" - "start" as length, strand from b where strand <> o and "end" - "start" > 100 and "end" - "start" < 1000""")
def file_bedpe(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of ends through BEDPE into fragments."""
    other = F.when(F.col("frag_id") % 7 == 0, F.col("strand")).when(F.col("strand") == "+", "-").otherwise("+")
    mid = F.expr("start + (end - start) div 2")
    rows = frags(spark, sf).select(F.col("chrom"), F.col("start"), mid.alias("m"), F.col("chrom").alias("c2"), mid.alias("m2"), F.col("end"), F.col("frag_id").cast("string"), F.lit("0").alias("score"), F.col("strand"), other.alias("o"))
    folder = scratch_folder(spark, "bedpe")
    sinks.write_tsv(rows, folder)
    return pairs.bedpe_fragments(tables.read_bedpe(spark, folder), min_size=100, max_size=1000)


@query(f"with {_TX} select tid, strand, exon_count, list_sum([x::bigint for x in a])::bigint starts, list_sum([x::bigint for x in b])::bigint ends from tx where tx_start is not null and tx_end is not null and chrom is not null")
def file_bed12(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts through BED12, blocks relative to their start, and back to places."""
    rows = transcripts(spark, sf).where(F.col("tx_start").isNotNull() & F.col("tx_end").isNotNull() & F.col("chrom").isNotNull())
    packed = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    sizes = F.zip_with("exon_starts", "exon_ends", lambda a, b: b - a)
    begins = F.transform("exon_starts", lambda a: a - F.col("tx_start"))
    folder = scratch_folder(spark, "bed12")
    sinks.write_tsv(rows.select("chrom", "tx_start", "tx_end", "tid", F.lit("0").alias("score"), "strand", "cds", "cde", F.lit("0").alias("rgb"), "exon_count", packed(sizes), packed(begins)), folder)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return tables.read_bed12(spark, folder).select("tid", "strand", "exon_count", total("exon_starts").alias("starts"), total("exon_ends").alias("ends"))


@query("""with l as (select lib_id, count(*) n from (select distinct frag_id, lib_id from fragments where lib_id is not null) group by 1),
m as (select lib_id, unnest(['Utr bases', 'R1 transcript strand reads', 'Coding bases']) variable, unnest([n / 7.0, 0.5, n / 11.0]) v from l)
select lib_id, variable, round(v, 6) var_count from m where variable <> 'R1 transcript strand reads'""")
def file_picard(spark: SparkSession, sf: str) -> DataFrame:
    """A page of metrics for each library, read as one table."""
    counts = table(spark, sf, "fragments").select("frag_id", "lib_id").where(F.col("lib_id").isNotNull()).distinct().groupBy("lib_id").agg(F.count(F.lit(1)).alias("n"))
    head = "\n".join(["#"] * 6 + ["PCT_UTR_BASES\tPCT_R1_TRANSCRIPT_STRAND_READS\tPCT_CODING_BASES", ""])
    text = F.concat(F.lit(head), F.concat_ws("\t", (F.col("n") / 7).cast("string"), F.lit("0.5"), (F.col("n") / 11).cast("string")))
    folder = scratch_folder(spark, "picard")
    counts.select("lib_id", text.alias("value")).repartition("lib_id").write.partitionBy("lib_id").text(folder)
    found = tables.read_picard_rna(spark, f"{folder}/lib_id=*/*.txt", "base")
    return found.select(F.regexp_extract("samplename", "lib_id=([0-9]+)", 1).cast("long").alias("lib_id"), "variable", F.round("var_count", 6).alias("var_count"))


@query("""with g as (select distinct chrom, start_pos - 1 a, end_pos b from gtf_records where feature_type = 'gene' and chrom is not null and start_pos <= end_pos)
select chrom, a as "start", b as "end" from g""")
def file_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Genes' places through a list of regions with comments."""
    rows = table(spark, sf, "gtf_records").where((F.col("feature_type") == "gene") & F.col("chrom").isNotNull() & (F.col("start_pos") <= F.col("end_pos")))
    lines = rows.select(F.concat_ws("\t", "chrom", F.col("start_pos") - 1, "end_pos").alias("value")).distinct()
    folder = scratch_folder(spark, "regions")
    lines.unionByName(spark.createDataFrame([("# chrom start end",), ("",)], "value string")).write.text(folder)
    return tables.read_regions(spark, folder)


@query(f"with {ALL_SQL} select rec_id, substr(seq, 6, 9) piece from r where seq <> ''")
def file_fasta_region(spark: SparkSession, sf: str) -> DataFrame:
    """Bases 5 to 14 of every sequence, looked up by place in indexed FASTA files."""
    folder = scratch_folder(spark, "fasta")
    sinks.write_fasta(sequences(spark, sf, 1).select(F.col("rec_id").cast("string").alias("seq_id"), "seq"), folder)
    readers.index_files(spark, f"{folder}/part-*").count()
    names = readers.read_fasta(spark, folder).select("file", F.col("seq_id").alias("chrom"), F.lit(5).alias("start"), F.lit(14).alias("end"))
    return readers.region_bases(names).select(F.col("chrom").cast("long").alias("rec_id"), F.col("seq").alias("piece"))
