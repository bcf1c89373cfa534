"""Numbers across partitions, mates and lanes by file, tag types, indexed BAM, and the other forms of round 2."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.functions.align import locate_batch
from strandloom.operators import kmers, multimap, pairs, pileup, umi
from strandloom.operators.ordered import places_within, run_numbers
from strandloom.plans import pipelines
from strandloom.sources import sequences, sinks, tables


@pytest.fixture()
def many_parts(spark):
    """Small tables in many partitions, which adaptive execution would merge."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_places_within_groups_that_span_partitions(many_parts):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice([None, "a", "b", "z"]), i, 0) for i in range(800)]
    df = many_parts.createDataFrame(rows, "k string, i int, nth__ int")
    got = {r.i: r.n for r in places_within(df, ["k"], ["i"], "n").collect()}
    seen, want = {}, {}
    for k, i, _ in rows:
        want[i] = seen[k] = seen.get(k, -1) + 1
    assert got == want
    assert places_within(df.limit(0), ["k"], ["i"], "n").count() == 0


def test_runs_across_partitions(many_parts):
    values = [v for v, n in ((1, 300), (2, 1), (1, 2), (5, 200), (None, 3), (5, 90)) for _ in range(n)]
    df = many_parts.createDataFrame(list(enumerate(values)), "i int, v int")
    got = [r.run for r in run_numbers(df, ["i"], ["v"], lambda now, last: now["v"] != last["v"], "run").orderBy("i").collect()]
    want, run, last = [], -1, object()
    for v in values:
        run += last is object or v is None or last is None or v != last
        want.append(run)
        last = v
    assert got == want


def plain_runs(tags, mismatches):
    out, first, run = [], None, -1
    for t in tags:
        if not (t is not None and first is not None and len(t) == len(first) and sum(x != y for x, y in zip(t, first)) <= mismatches):
            first, run = t, run + 1
        out.append(run)
    return out


@pytest.mark.parametrize("mismatches", [0, 1, 2])
def test_tag_runs_equal_a_fold(many_parts, mismatches):
    rng = random.Random(mismatches)
    bases = ["AAAA", "AAAC", "AACC", "ACCC", "GGGG", "AAA", None, "AAAA", "AAAA"]
    files = {f: [rng.choice(bases) for _ in range(n)] for f, n in (("x", 250), ("y", 3), ("z", 120))}
    rows = [(f, i, t) for f, tags in files.items() for i, t in enumerate(tags)]
    got = {(r.f, r.i): r.run for r in umi.tag_runs(many_parts.createDataFrame(rows, "f string, i int, t string"), "i", "t", ["f"], mismatches).collect()}
    assert got == {(f, i): r for f, tags in files.items() for i, r in enumerate(plain_runs(tags, mismatches))}


def aligned(spark, rows):
    """Rows are (file, ordinal, name, flag, start, cigar)."""
    out = spark.createDataFrame(rows, "file string, ordinal long, qname string, flag int, pos long, cigar string")
    return out.withColumns({"rname": F.lit("c"), "mapq": F.lit(1), "tags": F.lit(None).cast("map<string,string>")})


def test_fragments_of_names_with_several_pairs_and_of_several_files(spark):
    rows = [(f, 4 * k + i, "n", flag, at + d, "60M") for f, at0 in (("1.bam", 100), ("2.bam", 900)) for k, at in ((0, at0), (1, at0 + 5000)) for i, (flag, d) in enumerate(((99, 0), (147, 40)))]
    got = sorted((r.start, r.end) for r in pipelines.bam_to_bed(aligned(spark, rows)).collect())
    assert got == [(100, 200), (900, 1000), (5100, 5200), (5900, 6000)]


def test_single_fragments(spark):
    rows = [("f", 0, "a", 16, 5, "3S4M2N1M"), ("f", 1, "b", 4, -1, "*"), ("f", 2, "c", 0, 7, "900M")]
    got = [tuple(r) for r in pairs.single_fragments(aligned(spark, rows), max_size=100, add_cigar=True, prefix="p").collect()]
    assert got == [("c", 5, 12, "p:a", 7, "-", "3S4M2N1M")]


def test_lanes_go_together_by_rank_and_ordinal(spark, tmp_path):
    for lane, n in (("L1", 3), ("L2", 4)):
        for side, extra in (("R1", 0), ("R2", 3)):
            (tmp_path / f"{lane}_{side}.fq").write_text("".join(f"@{lane}r{i}\n{'ACGT' * (i + 1)}{'G' * extra * i}\n+\n{'IIII' * (i + 1)}{'@' * extra * i}\n" for i in range(n)))
    for size in (0, 40, 60):
        one, two = (sequences.read_fastq(spark, str(tmp_path / f"*_{s}.fq"), **({"split_bytes": size} if size else {})) for s in ("R1", "R2"))
        got = {(r.file.rsplit("/", 1)[1], r.pair, r.r1.id, r.r2.id) for r in pairs.zipped_pairs(one, two).collect()}
        assert got == {(f"{lane}_R1.fq", i, f"{lane}r{i}", f"{lane}r{i}") for lane, n in (("L1", 3), ("L2", 4)) for i in range(n)}


TYPED = ["@HD\tVN:1.6", "@SQ\tSN:c\tLN:1000", "r\t0\tc\t11\t60\t4M\t*\t0\t0\tACGT\tIIII\tMD:Z:10\tXF:f:1.5\tXA:A:q\tXB:B:c,1,-2\tXH:H:1AE3\tNM:i:1\tXI:i:3000000000"]


def test_tags_keep_their_types(spark, tmp_path):
    (tmp_path / "a.sam").write_text("\n".join(TYPED) + "\n")
    rows = tables.read_sam(spark, str(tmp_path / "a.sam"))
    sinks.write_bam(rows, str(tmp_path / "bam"), "\n".join(TYPED[:2]) + "\n")
    bam = str(tmp_path / "bam" / "*.bam")
    assert sequences.bam_header(bam) == TYPED[:2]
    for name, path in (("a", str(tmp_path / "a.sam")), ("b", bam)):
        cli.main(["filterSoftClip", "-i", path, "-o", str(tmp_path / name)], spark)
        lines = [x for p in (tmp_path / name).glob("part-*") for x in p.read_text().splitlines()]
        assert lines[:2] == TYPED[:2]
        head, tags = lines[2].split("\t")[:11], lines[2].split("\t")[11:]
        assert head == TYPED[2].split("\t")[:11] and sorted(tags) == sorted(TYPED[2].split("\t")[11:])


def test_split_commands_write_alignments(spark, tmp_path):
    lines = TYPED[:2] + [f"{n}\t{flag}\tc\t{at}\t60\t{cigar}\t=\t1\t0\t*\t*" for n, cigar in (("a", "4M9N4M"), ("b", "8M")) for flag, at in ((99, 11), (147, 31))]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    for form, read in (("sam", tables.read_sam), ("bam", sequences.read_bam)):
        cli.main(["spliceBam", "-i", str(tmp_path / "a.sam"), "-o", str(tmp_path / form), "--format", form], spark)
        for bucket, name in (("split", "a"), ("fragment", "b")):
            rows = read(spark, str(tmp_path / form / f"bucket={bucket}")).collect()
            assert sorted((r.qname, r.flag) for r in rows) == [(name, 99), (name, 147)]


def test_indexed_bam_is_read_in_stretches_and_by_region(spark, tmp_path):
    rng = random.Random(3)
    places = sorted(rng.randrange(3_000_000) for _ in range(20_000))
    header = "@SQ\tSN:c\tLN:4000000\n@SQ\tSN:d\tLN:100\n"
    rows = spark.createDataFrame([(f"r{i}", 0, "c", p, 60, f"{10 + i % 50}M" if i % 90 else "5M70000N5M", "A" * 40) for i, p in enumerate(places)] + [("u", 4, "*", -1, 0, "*", "A")], "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string").coalesce(1).sortWithinPartitions("rname", "pos")
    sinks.write_bam(rows, str(tmp_path / "bam"), header)
    path = next(str(p) for p in (tmp_path / "bam").glob("*.bam"))
    whole = {r.qname for r in sequences.read_bam(spark, path, split_bytes=4096).collect()}
    assert sequences.read_bam(spark, path, split_bytes=4096).rdd.getNumPartitions() == 1 and len(whole) == 20_001
    sequences.index_bam(path)
    split = sequences.read_bam(spark, str(tmp_path / "bam"), split_bytes=4096)
    assert split.rdd.getNumPartitions() > 4 and sorted(r.qname for r in split.collect()) == sorted(whole)
    ranks = [r.pos for r in split.where("rname = 'c'").orderBy("ordinal").collect()]
    assert ranks == sorted(ranks)
    for start, end in ((0, 1000), (500_000, 600_000), (2_999_000, 4_000_000), (70_001, 70_002)):
        want = {f"r{i}" for i, p in enumerate(places) if p < end and p + (10 + i % 50 if i % 90 else 70_010) > start}
        for df in (sequences.read_bam(spark, path, region=f"c:{start}-{end}"), pileup.overlapping(sequences.read_bam(spark, path), "c", start, end)):
            assert {r.qname for r in df.collect()} == want
    assert sequences.read_bam(spark, path, region="d").count() == 0 and sequences.read_bam(spark, path, region="none:0-9").count() == 0


def test_pieces_of_a_reference(spark, tmp_path):
    text = "".join(random.Random(4).choices("ACGT", k=10_000))
    (tmp_path / "r.fa").write_text(">c x\n" + "\n".join(text[a : a + 70] for a in range(0, 10_000, 70)) + "\n>e\n\n>d\nAC\n")
    got = {(r.seq_id, r.tile): r.seq for r in sequences.read_fasta(spark, str(tmp_path / "r.fa"), tile=4096).collect()}
    assert got == {("c x", k): text[a : a + 4096] for k, a in enumerate(range(0, 10_000, 4096))} | {("d", 0): "AC"}
    places = spark.createDataFrame([("c", p) for p in (0, 4095, 4096, 9999, 10_000)], "chrom string, pos long")
    for fasta in (sequences.read_fasta(spark, str(tmp_path / "r.fa"), tile=pileup.TILE), sequences.read_fasta(spark, str(tmp_path / "r.fa"))):
        named = fasta.withColumn("seq_id", F.split("seq_id", " ")[0])
        assert {r.pos: r.ref for r in pileup.reference_bases(named, places).collect()} == {p: text[p] for p in (0, 4095, 4096, 9999)}


def test_best_single_of_a_name_with_many_alignments(spark):
    rows = [("f", i, "n", 0, i, "20M") for i in range(3000)] + [("f", 5000, "n", 16, 1, "9M")] + [("f", 6000 + i, "m", 0, i, "20M") for i in range(5)]
    got = {r.qname: (r.ordinal, r.flag) for r in multimap.best_single(aligned(spark, rows), "ordinal").collect()}
    assert got == {"n": (5000, 16), "m": (6000, 0)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_generated_gapped_kmers(spark):
    df = spark.createDataFrame([("x", "ACGTA"), ("y", "NACCA")], "i string, seq string")
    for k, m in ((3, 1), (4, 2)):
        keys = ["".join(p) for p in product("ACGT", repeat=k)]
        got = {(r.i, r.key): r.n for r in kmers.generated_gapped_kmers(df, "i", "seq", k, m).collect()}
        want = {(i, key): n for i, s in (("x", "ACGTA"), ("y", "NACCA")) for key in keys if (n := sum(edits(s[a : a + k], key) <= m for a in range(len(s) - k + 1)))}
        assert got == want
    assert kmers.generated_gapped_kmers(df, "i", "seq", 5, 1).where("key = 'ACGTA'").first().n == 1


def some_overlap(ref, query, max_error, free):
    """Whether any alignment keeps to the error rate with its ends free only where named: all stretches, tried one by one."""
    for rs in range(len(ref) + 1) if "ref_start" in free else (0,):
        for qs in range(len(query) + 1) if "query_start" in free else (0,):
            if rs and qs:
                continue
            for re in range(rs, len(ref) + 1) if "ref_end" in free else (len(ref),):
                for qe in range(qs, len(query) + 1) if "query_end" in free else (len(query),):
                    if re < len(ref) and qe < len(query) or re == rs:
                        continue
                    cost = edits(ref[rs:re], query[qs:qe])
                    if cost <= (re - rs) * max_error:
                        return True
    return False


@pytest.mark.parametrize("free", [("query_end",), ("query_start", "query_end"), ("ref_start", "query_end"), ("ref_start", "ref_end", "query_start", "query_end"), ()])
def test_free_ends(free):
    rng = random.Random(len(free))
    cases = [("".join(rng.choices("ACG", k=rng.randrange(1, 6))), "".join(rng.choices("ACG", k=rng.randrange(1, 7)))) for _ in range(150)]
    for (ref, query), hit in zip(cases, locate_batch(*map(list, zip(*cases)), 0.3, free=free)):
        if hit is None:
            continue
        rs, re, qs, qe, matches, errors = hit
        assert errors >= edits(ref[rs:re], query[qs:qe])
        assert errors <= (re - rs) * 0.3 and some_overlap(ref, query, 0.3, free)
        assert (rs == 0 or "ref_start" in free) and (qs == 0 or "query_start" in free)
        assert (re == len(ref) or "ref_end" in free) and (qe == len(query) or "query_end" in free)
    assert locate_batch(["ACG"], ["TTACGTT"], 0, free=("query_end",)) == [None]
    with pytest.raises(ValueError):
        locate_batch(["A"], ["A"], 0, free=("end",))


def test_bases_of_regions_of_an_indexed_file(spark, tmp_path):
    text = "".join(random.Random(5).choices("ACGT", k=333))
    (tmp_path / "r.fa").write_text(">c about\n" + "\n".join(text[a : a + 50] for a in range(0, 333, 50)) + "\n>e\n>d\nACGT\n")
    assert sequences.index_files(spark, str(tmp_path / "r.fa")).first()["index"].endswith("r.fa.fai")
    regions = [("c", 0, 3), ("c", 49, 51), ("c", 120, 333), ("c", 330, 900), ("c", 400, 500), ("d", 1, 3), ("e", 0, 5), ("x", 0, 1)]
    got = [(r.chrom, r.start, r.end, r.seq) for r in sequences.region_bases(spark.createDataFrame(regions, "chrom string, start int, end int"), str(tmp_path / "r.fa")).collect()]
    want = {"c": text, "d": "ACGT", "e": "", "x": None}
    assert sorted(got) == sorted((c, a, b, want[c][a:b] if want[c] is not None else None) for c, a, b in regions)


def test_gradient_descent_comes_to_least_squares(spark):
    from strandloom.operators import stats

    df = spark.createDataFrame([(float(i % 7), float(i % 5) - 2, 2.0 * (i % 7) - 3.0 * (i % 5 - 2)) for i in range(200)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    steps = stats.gradient_descent(df, ["a", "b"], "y", rate=0.05, rounds=2000, limit=1e-9).orderBy("round").collect()
    assert [round(x, 4) for x in steps[-1].betas] == [2.0, -3.0] and steps[-1].cost < 1e-4 and len(steps) < 2000
    assert all(a.cost > b.cost - 1e-5 for a, b in zip(steps, steps[1:]))  # the cost is a difference of sums
    assert stats.gradient_descent(df.limit(0), ["a"], "y").count() == 0
