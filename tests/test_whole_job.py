"""Queries that do the whole job, on small tables made to show a cut."""

from datetime import datetime
from itertools import product

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.operators import kmers
from strandloom.queries import sequencing

AT = datetime(2024, 1, 1)


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def fragments(spark, folder, rows):
    """Rows are (frag_id, lib_id, chrom, start, end, strand, tag)."""
    schema = "frag_id long, lib_id long, chrom string, start_pos long, end_pos long, read_name string, fragment_size long, strand string, tag string, cigar string, mapq int, run_at timestamp, loaded_at timestamp"
    return put(spark, folder, "fragments", [(i, lib, c, a, b, None, b - a, s, t, None, 1, AT, AT) for i, lib, c, a, b, s, t in rows], schema)


def test_saturation_counts_whole_tags_at_whole_places(spark, tmp_path):
    tags = ["ACGTACG" + "".join(x) for x in product("ACGT", repeat=3)] + ["T" * 10, "C" * 10]
    sf = fragments(spark, tmp_path, [(i, 1 + i % 2, "chr1", 10, 90, "+", t) for i, t in enumerate(tags)] + [(500, 1, "chr1", 11, 90, "+", tags[0]), (501, 1, "chr1", 11, 90, "+", None)])
    got = {r.start: (r.n_umi, r.n_molecules) for r in sequencing.QUERIES["umi_saturation_places"](spark, sf).collect()}
    assert got == {10: (66, 66), 11: (1, 1)}
    assert sequencing.QUERIES["poisson_expand_places"](spark, sf).groupBy("start").agg(F.count("name").alias("n")).orderBy("start").collect() == [(10, 66), (11, 1)]


def barcode_sets(spark, folder, rows):
    """Rows are (bc_id, group_id, umi, n_members)."""
    schema = "bc_id long, group_id long, chrom string, start_pos long, end_pos long, strand string, cigar string, umi string, n_members long, unique_barcode string, loaded_at timestamp"
    return put(spark, folder, "barcode_sets", [(i, g, "chr1", 1, 9, "+", "8M", u, n, None, AT) for i, g, u, n in rows], schema)


def test_umis_with_an_unread_base_stay_in_clusters_and_pairs(spark, tmp_path):
    rows = [(1, 7, "ACGTACGT", 9), (2, 7, "ACGNACGT", 2), (3, 7, "NNGTTTTT", None), (4, None, "CCCCCCCC", 3), (5, 7, None, 4)]
    sf = barcode_sets(spark, tmp_path, [*rows, rows[0]])
    want = {(7, "ACGTACGT", 11), (7, "NNGTTTTT", 1), (None, "CCCCCCCC", 3)}
    for name in ("umi_dedup_directional_all", "umi_dedup_adjacency_all"):
        assert {tuple(r) for r in sequencing.QUERIES[name](spark, sf).select("group_id", "umi", "n_members").collect()} == want
    pairs = sequencing.QUERIES["umi_blocked_pairs_all"](spark, sf).collect()
    assert [(r.a, r.b) for r in pairs] == [("ACGNACGT", "ACGTACGT")]


def fastq_reads(spark, folder, rows):
    """Rows are (rec_id, seq, qual, barcode)."""
    schema = "rec_id long, read_id string, description string, seq string, qual string, barcode string, group_id long, instrument string, run_at timestamp, loaded_at timestamp"
    return put(spark, folder, "fastq_reads", [(i, None, None, s, q, b, 1, None, AT, AT) for i, s, q, b in rows], schema)


def test_reads_without_barcode_or_qualities_count_in_sequence_queries(spark, tmp_path):
    rows = [(1, "ACGTN", None, None), (2, "acg", "I", "ACNN"), (3, None, None, "ACGT"), (4, "TTTT", "IIII", "ACGT")]
    sf = fastq_reads(spark, tmp_path, [*rows, rows[0]])
    q = sequencing.QUERIES
    assert {r.kmer: (r.n, r.n_reads) for r in q["kmer_bag_all"](spark, sf).collect()}["ACG"] == (2, 2)
    assert {r.rec_id: r.rc for r in q["revcomp_all"](spark, sf).collect()} == {1: "NACGT", 2: "CGT", 4: "AAAA"}
    assert {r.rec_id: r.decoded for r in q["onehot_all"](spark, sf).collect()} == {1: "ACGTN", 2: "ACG", 4: "TTTT"}
    assert {r.pos: (r.base, round(r.share, 3)) for r in q["msa_consensus_all"](spark, sf).collect()}[0] == ("A", 0.667)
    assert {r.key for r in q["gapped_kmer_all"](spark, sf).collect()} >= {"ACG", "CGT", "TTT"}


def test_pair_matrix_above_5000_sequences(spark):
    msa = spark.range(5001).select(F.col("id").alias("seq_id"), F.lpad(F.col("id").cast("string"), 5, "0").alias("seq"))
    near = kmers.pair_matrix(msa).where("seq_a >= 4998 and seq_b = 5000")
    assert {(r.seq_a, r.distance) for r in near.collect()} == {(4998, 4), (4999, 4), (5000, 0)}


def test_an_unread_base_beyond_the_eighth_is_expanded(spark, tmp_path):
    a, b = "ACGTACGTACNT", "ACGTACGTTTNA"
    sf = barcode_sets(spark, tmp_path, [(1, 1, a, 1), (2, 1, b, 1), (3, 1, "ACGT", 1)])
    got = {(r.seq, r.expanded) for r in sequencing.QUERIES["iupac_expand_whole"](spark, sf).collect()}
    assert got == {(u, u.replace("N", x)) for u in (a, b) for x in "ACGT"}


def test_the_adapter_is_located_with_the_whole_barcode(spark, tmp_path):
    from strandloom.operators.trim import ADAPTERS

    seq = "GATTACAGATTACCA" + "TTGACCGTACGA" + ADAPTERS["read1"]
    sf = fastq_reads(spark, tmp_path, [(1, seq, "I" * len(seq), "TCGTACGGTCAA")])
    (hit,) = sequencing.QUERIES["locate_adapter"](spark, sf).collect()
    assert (hit.ref_start, hit.ref_end, hit.query_start, hit.errors) == (15, len(seq), 0, 0)


def test_gapped_kmers_of_six_bases(spark, tmp_path):
    sf = fastq_reads(spark, tmp_path, [(1, "ACGTAC", None, None), (2, "ACGTAC", None, None), (3, "ACG", None, None)])
    got = {r.key: r.n for r in sequencing.QUERIES["gapped_kmer_six"](spark, sf).collect()}
    assert got["ACGTAC"] == got["ACGTTT"] == 2 and "TTTTTT" not in got


def test_size_factors_of_libraries_over_genes(spark, tmp_path):
    gtf = "rec_id long, chrom string, src_name string, feature_type string, start_pos long, end_pos long, score string, strand string, phase string, info string, loaded_at timestamp"
    put(spark, tmp_path, "gtf_records", [(i, "chr1", "", "gene", a, a + 99, ".", "+", ".", "", AT) for i, a in ((1, 101), (2, 501))], gtf)
    places = [(1, 120), (1, 520), *[(5, 120)] * 4, *[(5, 520)] * 4, (5, 900)]
    sf = fragments(spark, tmp_path, [(i, lib, "chr1", a, a + 20, "+", "A") for i, (lib, a) in enumerate(places)])
    assert {r.sample: r.size_factor for r in sequencing.QUERIES["size_factors_genes"](spark, sf).collect()} == {1: 0.5, 5: 2.0}
    assert {(r.gene, r.sample, r.n) for r in sequencing.QUERIES["normalized_counts_genes"](spark, sf).collect()} == {("chr1:100-200", 1, 1), ("chr1:100-200", 5, 4), ("chr1:500-600", 1, 1), ("chr1:500-600", 5, 4)}


def test_pairs_are_compared_as_longs_whatever_their_letters(spark):
    for length, letters in ((20, "ACGTN"), (64, "AC"), (65, "acgtACGT"), (130, "ACGTéЖ😀-"), (400, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")):
        rows = [(i, "".join(letters[(i * i + j * (i + 1) + j // 3) % len(letters)] for j in range(length))) for i in range(7)] + [(7, None), (None, letters[0] * length)]
        df = spark.createDataFrame(rows, "seq_id long, seq string")
        got = kmers.pair_distances(df.where("seq_id % 2 = 1"), df, blocks=3).collect()
        want = [(a, b, None if s is None or t is None else sum(x != y for x, y in zip(s, t))) for a, s in rows if a and a % 2 for b, t in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    for seq in ("", "A", None):
        one = spark.createDataFrame([(1, seq)], "seq_id long, seq string")
        assert [tuple(r) for r in kmers.pair_matrix(one).collect()] == [(1, 1, None if seq is None else 0)]
    none = spark.createDataFrame([], "seq_id long, seq string")
    assert kmers.pair_matrix(none).collect() == []
    with pytest.raises(PySparkException):
        kmers.pair_matrix(spark.createDataFrame([(1, "AC"), (2, "ACG")], "seq_id long, seq string")).collect()


def test_pairs_in_several_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(kmers, "LIST_ROWS", 4)
    monkeypatch.setattr(kmers, "BLOCK_ROWS", 10)
    monkeypatch.setattr(kmers, "TASK_PAIRS", 100)
    df = spark.range(103).select(F.col("id").alias("seq_id"), F.lpad(F.col("id").cast("string"), 3, "0").alias("seq"))
    got = kmers.pair_distances(df.where("seq_id < 61"), df, blocks=2).collect()
    assert sorted(map(tuple, got)) == [(a, b, sum(x != y for x, y in zip(f"{a:03}", f"{b:03}"))) for a in range(61) for b in range(103)]


def test_pair_distances_do_not_split_texts_for_each_pair(spark, tmp_path):
    rows = [(i, 1, "ACGTNACGTNACGTNACGT" + "ACGT"[i % 4], 1) for i in range(1, 101)]
    df = sequencing.QUERIES["umi_pairwise_hamming"](spark, barcode_sets(spark, tmp_path, rows))
    top = df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "bit_count" in top and "split(" not in top and "zip_with" not in top
    assert df.where("distance > 1").count() == 0 and df.count() == 200
