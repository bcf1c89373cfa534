"""Streams drained over files that arrive in a folder."""

from strandloom.streaming import streams


def drained(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in df.sparkSession.sql(f"select * from {name}").collect()]


def test_alignments_arrive(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr\t0\tc\t5\t60\t3M\t*\t0\t0\tACG\tIII\tRX:Z:A\n")
    (tmp_path / "b.sam").write_text("s\t16\tc\t9\t60\t3M\t*\t0\t0\tACG\tIII\n")
    rows = drained(streams.sam_stream(spark, str(tmp_path)).select("qname", "pos"), "sam_rows", "append")
    assert sorted(rows) == [("r", 4), ("s", 8)]


def test_counts_and_saturation(spark, tmp_path):
    spark.createDataFrame([("c", "A", "2024-01-01 00:05:00"), ("c", "A", "2024-01-01 00:10:00"), ("c", "G", "2024-01-01 00:20:00"), ("c", "A", "2024-01-01 05:00:00")], "chrom string, umi string, t string").selectExpr("chrom", "umi", "cast(t as timestamp) t").write.mode("overwrite").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("chrom string, umi string, t timestamp").parquet(str(tmp_path / "in"))
    got = drained(streams.umi_counts_stream(read(), ["chrom"], "umi", "t"), "umi_counts", "complete")
    assert sorted(r[-1] for r in got) == [1, 1, 2]
    got = drained(streams.saturation_stream(read(), ["chrom"], "umi", 1, "t"), "umi_sat", "complete")
    assert sorted(r[-2:] for r in got) == [(1, 1), (2, 3)]


def test_runs_go_on_across_batches(spark, tmp_path):
    rows = [("f", 0, "AAAA"), ("f", 1, "AAAC"), ("f", 2, "GGGG"), ("f", 3, "GGGT"), ("g", 0, "AAAA")]
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "file string, n int, tag string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            pass
    stream = spark.readStream.schema("file string, n int, tag string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(streams.tag_runs_stream(stream, "file", "n", "tag"), "tag_runs", "append")
    assert sorted((f, n, run) for f, n, _, run in got) == [("f", 0, 0), ("f", 1, 0), ("f", 2, 1), ("f", 3, 1), ("g", 0, 0)]


def test_exact_saturation_of_closed_windows(spark, tmp_path):
    rows = [("c", "A", "00:05"), ("c", "A", "00:10"), ("c", "G", "00:20"), ("d", None, "00:30"), ("c", "A", "05:00")]
    spark.createDataFrame([(c, u, f"2024-01-01 {t}:00") for c, u, t in rows], "chrom string, umi string, t string").selectExpr("chrom", "umi", "cast(t as timestamp) t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chrom string, umi string, t timestamp").parquet(str(tmp_path / "in"))
    got = drained(streams.saturation_stream(stream, ["chrom"], "umi", 1, "t", exact=True), "umi_exact", "append")
    assert [r[-3:] for r in got] == [("c", 2, 3)]
