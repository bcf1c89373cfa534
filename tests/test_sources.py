"""Readers, writers and the command line on files written here."""

import gzip
import lzma
import random
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.sources import sequences, sinks, tables
from strandloom.sources.files import expanded, open_binary, open_output


def fastq(records):
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)


def lines_of(folder):
    return sorted(line for p in Path(folder).rglob("part-*") if not p.name.endswith(".crc") for line in (gzip.open(p, "rt") if p.suffix == ".gz" else p.open()).read().splitlines())


def test_fastq_forms(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 one two\nAC\nGT\n+r1\nII\n@I\n@r2\n\n+\n\n>f x\nAC\nG\n")
    got = [tuple(r) for r in sequences.read_fastq(spark, str(tmp_path / "a.fq")).select("ordinal", "id", "seq", "qual", "description").orderBy("ordinal").collect()]
    assert got == [(0, "r1", "ACGT", "II@I", "r1 one two"), (1, "r2", "", "", "r2"), (2, "f", "ACG", None, "f x")]
    (tmp_path / "b.fq").write_text("@r1\nACGT\n+\nII\n")
    with pytest.raises(PySparkException):
        sequences.read_fastq(spark, str(tmp_path / "b.fq")).collect()
    (tmp_path / "e.fq").write_text("")
    assert sequences.read_fastq(spark, str(tmp_path / "e.fq")).count() == 0


def test_fastq_splits_and_compression(spark, tmp_path):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 60) for _ in range(700)]
    records = [(f"r{i} d", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+I#", k=n))) for i, n in enumerate(sizes)]
    text = fastq(records)
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "a.fq.gz", "wt") as h:
        h.write(text)
    with lzma.open(tmp_path / "a.fq.xz", "wt") as h:
        h.write(text)
    want = [(n.split(" ")[0], s, q) for n, s, q in records]
    for name in ("a.fq", "a.fq.gz", "a.fq.xz"):
        got = sequences.read_fastq(spark, str(tmp_path / name)).orderBy("ordinal").collect()
        assert [(r.id, r.seq, r.qual) for r in got] == want
    for size in (97, 1000, 10**6):
        df = sequences.read_fastq(spark, str(tmp_path / "a.fq"), split_bytes=size)
        got = df.orderBy("ordinal").collect()
        assert [(r.id, r.seq, r.qual) for r in got] == want
    assert df.rdd.getNumPartitions() == 1 and sequences.read_fastq(spark, str(tmp_path / "a.fq"), split_bytes=1000).rdd.getNumPartitions() > 10


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nAC\nGT\n>two\n\n")
    assert [tuple(r)[1:] for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()] == [(0, "one x", "ACGT"), (1, "two", "")]
    (tmp_path / "e.fa").write_text("")
    assert sequences.read_fasta(spark, str(tmp_path / "e.fa")).count() == 0


SAM = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:1000", "@SQ\tSN:chr2\tLN:50", "r1\t99\tchr1\t11\t60\t5M1I4M\t=\t31\t30\tACGTACGTAC\tIIIIIIIIII\tAS:i:-3\tRX:Z:ACG:T", "r1\t147\tchr1\t31\t60\t10M\t=\t11\t-30\tACGTACGTAN\tIIIIIIIII#\tAS:i:0", "u\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]


def test_sam_and_bam_round_trips(spark, tmp_path):
    (tmp_path / "a.sam").write_text("\n".join(SAM) + "\n")
    rows = tables.read_sam(spark, str(tmp_path / "a.sam")).drop("file")
    first = rows.where("qname = 'r1' and flag = 99").first()
    assert (first.pos, first.rnext, first.pnext, first.tags) == (10, "chr1", 30, {"AS": "-3", "RX": "ACG:T"})
    assert rows.where("qname = 'u'").first().seq is None
    header = [r.line for r in tables.read_sam_header(spark, str(tmp_path / "a.sam")).orderBy("line_no").collect()]
    assert header == SAM[:3]
    sinks.write_sam(rows, str(tmp_path / "out"), header, order=("ordinal",))
    assert [line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()] == SAM
    sinks.write_bam(rows, str(tmp_path / "bam"), "\n".join(header) + "\n")
    back = sequences.read_bam(spark, str(tmp_path / "bam" / "*.bam"))
    columns = [c for c in rows.columns if c not in ("ordinal", "tags")]
    assert sorted(map(tuple, back.select(*columns).collect()), key=str) == sorted(map(tuple, rows.select(*columns).collect()), key=str)
    assert back.where("flag = 99").first().tags == first.tags


def test_tables(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    bed12 = tables.read_bed12(spark, write("a.bed", "chr1\t100\t400\tt\t0\t-\t120\t390\t0\t2\t50,100,\t0,200,\n")).first()
    assert (bed12.exon_starts, bed12.exon_ends) == ([100, 300], [150, 400])
    gtf = tables.read_gtf(spark, write("a.gtf", '#c\nchr1\ts\texon\t10\t20\t.\t+\t.\tgene_id "G 1"; n=2; tag "a"; tag "b; c"\n'))
    assert gtf.first().attributes == {"gene_id": "G 1", "n": "2", "tag": "b; c"}
    assert tables.transcripts_in(gtf, "chr1", 0, 9).count() == 0 and tables.transcripts_in(gtf, "chr1", 19, 30).count() == 1
    flat = write("r.txt", "G\tt1\tchr1\t+\t0\t9\t1\t5\t2\t0,5,\t3,9,\nG\tt2\tchr1\t+\t0\t9\t9\t9\t1\t0,\t9,\n")
    assert [r.tid for r in tables.read_refflat(spark, flat).collect()] == ["t1"]
    assert tables.read_refflat(spark, flat, coding_only=False).where("tid = 't1'").first().exon_ends == [3, 9]
    hits = tables.read_infernal(spark, write("h.tbl", "# x\nA - B RF1 cm 1 9 2 8 + no 1 0.5 0.0 33.1 1e-9 !  a long description\n")).first()
    assert (hits.target_name, hits.strand, hits.description) == ("A", "+", "a long description")
    metrics = write("m.RNA_Metrics", "\n".join(["#"] * 6 + ["PCT_UTR_BASES\tPCT_CODING_BASES\tPCT_R1_STRAND_READS\tOTHER", "0.25\t0.5\t1\t9", "", "## HIST", "pos\tcov", "0\t1.5", "1\t2.5"]) + "\n")
    assert {(r.variable, r.var_count) for r in tables.read_picard_rna(spark, metrics, "base").collect()} == {("Utr bases", 0.25), ("Coding bases", 0.5)}
    assert {r.variable for r in tables.read_picard_rna(spark, metrics, "strand").collect()} == {"R1 strand reads"}
    assert sorted((r.row, r.variable, r.var_count) for r in tables.read_picard_rna(spark, metrics, "cov").collect()) == [(0, "cov", 1.5), (0, "pos", 0.0), (1, "cov", 2.5), (1, "pos", 1.0)]
    with pytest.raises(ValueError):
        tables.read_picard_rna(spark, metrics, "x")
    bad = write("bad.bed", "chr1\tx\t9\tn\t1\t+\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        tables.read_bed(spark, bad).collect()


def test_opening_files(tmp_path):
    for name in ("a", "a.gz", "a.bz2", "a.xz"):
        with open_output(str(tmp_path / name)) as h:
            h.write(b"text\n")
        with open_binary(str(tmp_path / name)) as h:
            assert h.read() == b"text\n"
    assert len(expanded(str(tmp_path / "a*"))) == 4 and len(expanded(str(tmp_path))) == 4
    with pytest.raises(FileNotFoundError):
        expanded(str(tmp_path / "none*"))


def run(spark, *args):
    cli.main(list(map(str, args)), spark)


def test_command_line_from_alignments_to_molecules(spark, tmp_path):
    sam = SAM[:3]
    for i, (umi, pos) in enumerate([("AAA", 11), ("AAA", 11), ("AAC", 11), ("GGG", 11), ("AAA", 100)]):
        sam += [f"{umi}_r{i}\t99\tchr1\t{pos}\t60\t10M\t=\t{pos + 20}\t30\tACGTACGTAC\tIIIIIIIIII", f"{umi}_r{i}\t147\tchr1\t{pos + 20}\t60\t8M2S\t=\t{pos}\t-30\tACGTACGTAC\tIIIIIIIIII"]
    (tmp_path / "a.sam").write_text("\n".join(sam) + "\n")
    run(spark, "bam2bed", "-i", tmp_path / "a.sam", "-o", tmp_path / "bed", "-M", 100)
    assert lines_of(tmp_path / "bed")[0] == "chr1\t10\t38\tAAA_r0\t28\t+"
    run(spark, "dedup", "-i", tmp_path / "bed", "-o", tmp_path / "dedup")
    assert lines_of(tmp_path / "dedup") == ["chr1\t10\t38\tAAA_3_members\t28\t+", "chr1\t10\t38\tGGG_1_members\t28\t+", "chr1\t99\t127\tAAA_1_members\t28\t+"]
    run(spark, "calcUMI", "-i", tmp_path / "dedup", "-o", tmp_path / "calc", "-u", 1)
    assert len(lines_of(tmp_path / "calc")) == 4
    run(spark, "bamTag", "-i", tmp_path / "a.sam", "-o", tmp_path / "tagged")
    assert any(x.startswith("r0\t99") and x.endswith("RX:Z:AAA") for x in lines_of(tmp_path / "tagged"))
    run(spark, "filterUMI", "-i", tmp_path / "a.sam", "-o", tmp_path / "umis", "-n", 2)
    assert {x.split("_")[0] for x in lines_of(tmp_path / "umis") if x[0] != "@"} == {"AAC"}
    run(spark, "filterSoftClip", "-i", tmp_path / "a.sam", "-o", tmp_path / "clip", "--pe", "-s", 0)
    assert [x for x in lines_of(tmp_path / "clip") if x[0] != "@"] == []
    run(spark, "filterSoftClip", "-i", tmp_path / "a.sam", "-o", tmp_path / "clip1", "-s", 0.1)
    assert len([x for x in lines_of(tmp_path / "clip1") if x[0] != "@"]) == 5
    for command, extra in (("spliceBam", []), ("splitBam", []), ("splitBam", ["--single"])):
        run(spark, command, "-i", tmp_path / "a.sam", "-o", tmp_path / "split", *extra)
    assert {p.name for p in (tmp_path / "split").glob("bucket=*")} == {"bucket=multi"}
    tagged = [x + f"\tRX:Z:{x[:3]}\tAS:i:0" if x[0] != "@" else x for x in sam]
    (tmp_path / "t.sam").write_text("\n".join(tagged) + "\n")
    run(spark, "demux", "-i", tmp_path / "t.sam", "-o", tmp_path / "demux", "-c")
    assert sum(x.startswith("@AAA_2_member/") for x in lines_of(tmp_path / "demux")) == 2
    run(spark, "filterMulti", "-i", tmp_path / "t.sam", "-o", tmp_path / "multi")
    assert len([x for x in lines_of(tmp_path / "multi") if x[0] != "@"]) == 10
    (tmp_path / "ref.fa").write_text(">chr1 x\n" + "ACGTACGTAC" * 20 + "\n")
    run(spark, "pileup", "-i", tmp_path / "a.sam", "-f", tmp_path / "ref.fa", "-o", tmp_path / "pile", "-q", 20)
    body = [x.split("\t") for x in lines_of(tmp_path / "pile")]
    assert ["chr1", "11", "C", "0", "4", "0", "0", "0", "0", "0", "0"] in body and body[-1][:3] == ["chrom", "pos", "ref"]
    (tmp_path / "r.bed").write_text("chr1\t10\t20\n")
    run(spark, "pileup", "-i", tmp_path / "a.sam", "-f", tmp_path / "ref.fa", "-o", tmp_path / "pile", "-b", tmp_path / "r.bed", "--consensus", tmp_path / "cons")
    assert ">chr1:10-20(+)" in lines_of(tmp_path / "cons")
    with pytest.raises(SystemExit):
        run(spark, "bam2bed", "-i", tmp_path / "a.sam", "-o", tmp_path / "x", "-m", 9, "-M", 9)


def test_command_line_on_reads(spark, tmp_path):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    insert = "CTTAGCACGTACGGATCGATTACAGATCCAG"
    records = [(f"r{i}", "ACGTCA" + insert, rc(insert)) for i in range(3)]
    (tmp_path / "1.fq").write_text(fastq((n, a, "I" * len(a)) for n, a, _ in records))
    (tmp_path / "2.fq").write_text(fastq((n, b, "I" * len(b)) for n, _, b in records))
    (tmp_path / "i.fq").write_text("".join(fastq([(n + "/1", a, "I" * len(a)), (n + "/2", b, "I" * len(b))]) for n, a, b in records))
    run(spark, "clipFQ", "-1", tmp_path / "1.fq", "-2", tmp_path / "2.fq", "-o", tmp_path / "clip", "-b", "XXXXXX")
    assert lines_of(tmp_path / "clip").count(insert) == 3 and "@ACGTCA_r0" in lines_of(tmp_path / "clip")
    run(spark, "correctFQ", "-1", tmp_path / "1.fq", "-2", tmp_path / "2.fq", "-o", tmp_path / "corr", "-n", 2, "--failed", tmp_path / "failed")
    assert lines_of(tmp_path / "failed") == []
    assert "@cluster0_ACGTCA_3_members/1" in lines_of(tmp_path / "corr" / "R1") and insert in lines_of(tmp_path / "corr" / "R1")
    run(spark, "deinterleave", "-i", tmp_path / "i.fq", "-1", tmp_path / "d1", "-2", tmp_path / "d2")
    assert len(lines_of(tmp_path / "d1")) == 12
    run(spark, "mergepe", "-i", tmp_path / "i.fq", "-o", tmp_path / "merge", "--all")
    assert lines_of(tmp_path / "merge").count("ACGTCA" + insert) == 3
    (tmp_path / "p.bedpe").write_text("c\t0\t9\tc\t20\t30\tn1\t0\t+\t-\nc\t0\t9\tc\t20\t30\tn2\t0\t+\t+\n")
    run(spark, "bedpe2bed", "-i", tmp_path / "p.bedpe", "-o", tmp_path / "pe")
    assert lines_of(tmp_path / "pe") == ["c\t0\t30\tn1\t30\t+"]
    (tmp_path / "d.txt").write_text("c\t1\t5\nc\t2\t5\nc\t3\t0\n")
    run(spark, "cov2bw", "-i", tmp_path / "d.txt", "-o", tmp_path / "bw")
    assert lines_of(tmp_path / "bw" / "chrom=c") == ["0\t2\t5", "2\t3\t0"]


def test_every_command_is_offered():
    names = next(a for a in cli.parser()._actions if a.dest == "command").choices
    assert set(names) == set("bam2bed demux bamTag bedpe2bed clipFQ dedup deinterleave cov2bw correctFQ filterSoftClip filterUMI mergepe calcUMI filterMulti spliceBam splitBam pileup".split())


def test_fastq_text_writes_the_name_once(spark):
    df = spark.createDataFrame([("r1", "AC", "II", "r1 d"), ("r2", "AC", "II", None), ("r3", "AC", "II", "@r3 e")], "id string, seq string, qual string, description string")
    got = [r.x for r in df.select(sinks.fastq_text(F.col("id"), F.col("seq"), F.col("qual"), F.col("description")).alias("x")).collect()]
    assert got == ["@r1 d\nAC\n+\nII", "@r2\nAC\n+\nII", "@r3 e\nAC\n+\nII"]
