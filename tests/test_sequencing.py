"""Pairs, UMIs, consensus, pileup, genes, features and statistics on small fixtures."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.operators import consensus, families, genes, intervals, kmers, multimap, pairs, pileup, stats, trim, umi
from strandloom.plans import pipelines

ALN = "ordinal long, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"


def aln(spark, rows):
    """Rows of (qname, flag, rname, pos, cigar, tlen, seq, tags) with the rest filled in."""
    out = [(k, q, f, r, p, 60, c, r, p, t, s, "I" * len(s), g) for k, (q, f, r, p, c, t, s, g) in enumerate(rows)]
    return spark.createDataFrame(out, ALN)


def test_fragments(spark):
    rows = [
        ("a", 99, "chr1", 10, "5M", 30, "ACGTA", {"RX": "2"}), ("a", 147, "chr1", 30, "2S5M3D5M", -30, "ACGTACGTACGT", {"RX": "11"}),
        ("b/1", 83, "chr1", 40, "5M", -20, "ACGTA", {"RX": "x"}), ("b/2", 163, "chr1", 25, "5M", 20, "ACGTA", {"RX": "x"}),
        ("c", 99, "chr1", 10, "5M", 30, "ACGTA", {}), ("c", 147, "chr2", 30, "5M", 30, "ACGTA", {}),
        ("d", 99 + 256, "chr1", 1, "5M", 9, "ACGTA", {}), ("d", 147, "chr1", 5, "5M", -9, "ACGTA", {}), ("lone", 99, "chr1", 1, "5M", 9, "ACGTA", {}),
    ]
    both = pairs.mates(aln(spark, rows))
    got = {tuple(r) for r in pairs.fragments(both, tag="RX", add_cigar=True, only_primary=True).collect()}
    assert got == {("chr1", 10, 43, "a", 33, "+", "11", "5M:2S5M3D5M"), ("chr1", 25, 45, "b", 20, "-", "x", "5M:5M")}
    assert {r.name for r in pairs.fragments(both).collect()} == {"a", "b", "d"}
    assert {r.name for r in pairs.fragments(both, min_size=21).collect()} == {"a"}
    bad = aln(spark, [("a", 99, "c", 1, "5M", 9, "ACGTA", {"RX": "x"}), ("a", 147, "c", 3, "5M", 9, "ACGTA", {"RX": "y"})])
    with pytest.raises(PySparkException):
        pairs.fragments(pairs.mates(bad), tag="RX").collect()


def test_interleaved(spark):
    df = spark.createDataFrame([("f", 0, "r1/1", "ACGT", "IIII", "r1/1"), ("f", 1, "r1/2", "AC", "II", "r1/2"), ("f", 2, "r2/1", "ACG", "III", "r2"), ("f", 3, "r2/2", "ACG", "III", "r2")], "file string, ordinal long, id string, seq string, qual string, description string")
    one, two = pairs.deinterleaved(pairs.interleaved_pairs(df), 3)
    assert [r.id for r in one.collect()] == ["r2/1"] and [r.id for r in two.collect()] == ["r2/2"]
    with pytest.raises(PySparkException):
        pairs.interleaved_pairs(df.withColumn("id", F.concat(F.col("ordinal").cast("string"), F.lit("/1")))).collect()


def counts_frame(spark, counts, group=1):
    return spark.createDataFrame([(group, u, n) for u, n in counts.items()], "g int, umi string, n long")


def clusters(rows):
    out = Counter()
    for r in rows:
        out[r.cluster] += r.n
    return dict(out)


def test_directional_values(spark):
    got = umi.directional_clusters(counts_frame(spark, {"ACTGA": 10, "ACTGG": 2, "ACTCC": 1, "ACCCC": 17}), ["g"]).collect()
    assert clusters(got) == {"ACCCC": 18, "ACTGA": 12}
    frags = spark.createDataFrame([("c", u) for u in ["ACG", "GGG", "GGG", "ACT", "ACT", "ACT"]], "chrom string, umi string")
    assert umi.deduplicated(frags, ["chrom"], "umi").count() == 2
    exact = umi.deduplicated(frags, ["chrom"], "umi", threshold=0).collect()
    assert len(exact) == 3 and sum(r.n_members for r in exact) == 6


def plain_directional(counts):
    rank = sorted(counts, key=lambda u: (-counts[u], u))
    found, out = {}, Counter()
    for top in rank:
        if top in found:
            continue
        queue = [top]
        seen = {top}
        while queue:
            a = queue.pop()
            for b in counts:
                if b not in seen and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 and counts[a] >= 2 * counts[b] - 1:
                    seen.add(b)
                    queue.append(b)
        for u in seen:
            found.setdefault(u, top)
    for u, top in found.items():
        out[top] += counts[u]
    return dict(out)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("ACG") for _ in range(rng.choice([3, 4]))): rng.choice([1, 1, 1, 2, 3, 5, 9, 17]) for _ in range(45)}
    df = counts_frame(spark, counts).unionByName(counts_frame(spark, {"AAA": 2, "AAC": 1}, None))
    got = umi.directional_clusters(df, ["g"]).collect()
    assert clusters([r for r in got if r.g == 1]) == plain_directional(counts)
    assert clusters([r for r in got if r.g is None]) == {"AAA": 3}
    linked = umi.adjacency_clusters(counts_frame(spark, counts), ["g"]).collect()
    parent = {u: u for u in counts}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in combinations(counts, 2):
        if edits(a, b) <= 1:
            parent[root(a)] = root(b)
    want = defaultdict(set)
    for u in counts:
        want[root(u)].add(u)
    got_sets = defaultdict(set)
    for r in linked:
        got_sets[r.cluster].add(r.umi)
    assert sorted(map(sorted, got_sets.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v, key=lambda u: (-counts[u], u)) for k, v in got_sets.items())


def test_near_pairs_find_every_pair(spark):
    rng = random.Random(9)
    counts = {"".join(rng.choice("ACGT") for _ in range(6)): 1 for _ in range(120)}
    got = {(r.a, r.b) for r in umi.near_pairs(counts_frame(spark, counts), ["g"], 2).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(counts), 2) if sum(x != y for x, y in zip(a, b)) <= 2}


def test_tags_and_runs(spark):
    df = spark.createDataFrame([("AAC_x_AAC_1", None), ("GGG_y", {"RX": "old"})], "qname string, tags map<string,string>")
    got = [(r.qname, r.tags["RX"]) for r in umi.tag_with_umi(df).collect()]
    assert got == [("x_1", "AAC"), ("y", "GGG")]
    assert [r.u for r in df.select(umi.umi_of_name(F.col("qname"), "_", -1).alias("u")).collect()] == ["1", "y"]
    assert [r.qname[:3] for r in umi.without_runs(df, F.substring("qname", 1, 3), 2).collect()] == ["AAC"]
    tags = ["AAAA", "AAAC", "AACC", "AACC", None, "AACC", "GGGG", "GGGT", "CC"]
    runs = spark.createDataFrame([(i, "f", t) for i, t in enumerate(tags)], "k int, f string, t string")
    got = [r.run for r in umi.tag_runs(runs, "k", "t", ["f"]).orderBy("k").collect()]
    assert got == [0, 0, 1, 1, 2, 3, 4, 4, 5]
    assert [r.run for r in umi.tag_runs(runs.drop("f"), "k", "t").orderBy("k").collect()] == got


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(k,) for k in random.Random(1).sample(range(10**6), 500)], "k long")
    rows = umi.number_rows(df, ["k"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(500)) and [r.k for r in rows] == sorted(r.k for r in rows)


def plain_vote(seqs, quals):
    if len(seqs) == 1:
        return seqs[0], quals[0]
    out, line = "", ""
    for pos in range(min(map(len, seqs))):
        column = Counter(s[pos] for s in seqs)
        base, n = min(column.items(), key=lambda x: (-x[1], x[0]))
        p = 0.0
        if n / len(seqs) >= 0.8:
            p = min(0.99999999999, 1 - 10 ** (-sum(ord(q[pos]) - 33 for s, q in zip(seqs, quals) if s[pos] == base) / 10))
        else:
            base = "N"
        out += base
        line += chr(int(min(max(-10 * math.log10(1 - p) + 33, 33), 73) + 1e-9))
    return out, line


def test_consensus(spark):
    rng = random.Random(3)
    fams = {f: [("".join(rng.choice("ACGT") if rng.random() < 0.1 else "ACGTACGTAC"[i] for i in range(rng.choice([8, 10])))) for _ in range(rng.choice([1, 2, 5, 9]))] for f in range(20)}
    rows = [(f, s, "".join(rng.choice("#+5I") for _ in s)) for f, ss in fams.items() for s in ss]
    df = spark.createDataFrame(rows + [(99, None, "I"), (99, "AC", "I"), (98, "", "")], "f int, seq string, qual string")
    got = {r.f: (r.members, r.seq, r.qual) for r in consensus.consensus_reads(df, ["f"], mode="vote").collect()}
    want = {f: (len(ss), *plain_vote(ss, [q for g, _, q in rows if g == f])) for f, ss in fams.items()}
    assert got == want
    column = [("C", ")"), ("C", ")"), ("A", ")"), ("A", "A"), ("A", "-"), ("A", "-"), ("A", "A"), ("G", ")"), ("T", "A")]
    counted = consensus.bases_by_position(spark.createDataFrame([(1, b, q) for b, q in column], "f int, seq string, qual string"), ["f"])
    log = {r.base: r.hit for r in counted.collect()}
    misses = {r.base: r.miss for r in counted.collect()}
    total = {b: log[b] + sum(misses.values()) - misses[b] for b in log}
    assert {b: round(v, 3) for b, v in total.items()} == {"A": -17.593, "C": -39.351, "G": -42.119, "T": -36.421}
    assert consensus.called_bases(counted, ["f"]).first().base == "A"


def test_coverage_ties(spark):
    rows = [(5, 1, 1, 1), (2, 2, 0, 0), (3, 0, 3, 0), (1, 0, 0, 1), (0, 4, 0, 4), (1, 1, 1, 0), (0, 0, 2, 2), (1, 0, 1, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a int, c int, g int, t int")
    cols = [F.col(x) for x in "acgt"]
    assert [r.x for r in df.select("i", consensus.coverage_call(*cols).alias("x")).orderBy("i").collect()] == list("ACGTNTNN")
    assert [r.x for r in df.select("i", consensus.coverage_call(*cols, ties="N").alias("x")).orderBy("i").collect()] == list("ANNNNNNN")


def test_pileup(spark):
    rows = [("a", 0, "c", 0, "3M", 0, "ACG", {}), ("b", 16, "c", 0, "1M1I2M", 0, "ATCG", {}), ("d", 0, "c", 1, "1S2M2D1M", 0, "TCGT", {}), ("u", 4, "c", 1, "3M", 0, "ACG", {}), ("x", 1024, "c", 1, "3M", 0, "ACG", {})]
    df = aln(spark, rows)
    got = {(r.chrom, r.pos): tuple(r[c] for c in pileup.COLUMNS) for r in pileup.pileup(df, direction="U").collect()}
    assert got == {("c", 1): (0, 2, 0, 0, 0, 1, 0, 0), ("c", 2): (0, 0, 2, 0, 0, 0, 1, 0), ("c", 5): (0, 0, 0, 1, 0, 0, 0, 0)}
    exact = {r.pos for r in pileup.pileup(df, direction="U", exact=True).collect()}
    assert exact == {0, 1, 2, 5}
    assert {r.pos for r in pileup.pileup(df, direction="U", min_cov=1).collect()} == {1, 2}
    assert {r.pos for r in pileup.pileup(df, direction="U", no_indel=True).collect()} == {1, 2}
    fasta = spark.createDataFrame([("c", "ACGTAC" * 2000)], "seq_id string, seq string")
    placed = spark.createDataFrame([("c", p) for p in (0, 5, 4095, 4096, 11999)], "chrom string, pos long")
    assert {r.pos: r.ref for r in pileup.reference_bases(fasta, placed).collect()} == {p: ("ACGTAC" * 2000)[p] for p in (0, 5, 4095, 4096, 11999)}
    tiles = pileup.region_tiles(spark.createDataFrame([("c", 100), ("z", 0)], "chrom string, n long"), "chrom", "n", 51)
    assert sorted(tuple(r) for r in tiles.collect()) == [("c", 0, 51), ("c", 51, 100)]
    depth = spark.createDataFrame([("c", 2, 5), ("c", 3, 5), ("c", 5, 5), ("c", 6, 1)], "chrom string, pos long, value long")
    assert sorted(tuple(r) for r in pileup.bedgraph(depth).collect()) == [("c", 1, 3, 5), ("c", 4, 5, 5), ("c", 5, 6, 1)]
    track = pileup.depth_track(depth, spark.createDataFrame([("c", 4)], "chrom string, size long"))
    assert sorted(tuple(r) for r in track.collect()) == [("c", 0, 0), ("c", 1, 5), ("c", 2, 5), ("c", 3, 0)]
    piled = pileup.pileup(df, direction="U")
    assert pileup.strand_sequence(piled, "+").first().seq == "CGT" and pileup.strand_sequence(piled, "-", complement=True).first().seq == "CG"
    regions = spark.createDataFrame([("c", 1, 3)], "chrom string, start long, end long")
    assert {tuple(r) for r in pipelines.strand_fasta(piled, regions).collect()} == {("c:1-3(+)", "CG"), ("c:1-3(-)", "GC")}


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    span = lambda i, w: (i, rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(0, w))
    left, right = [span(i, 40) for i in range(150)], [span(i, 90) for i in range(60)]
    a, b = (spark.createDataFrame(x + x[:3], "id int, chrom string, start long, end long") for x in (left, right))
    left, right = left + left[:3], right + right[:3]
    hit = lambda x, y: x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3]) and x[2] < x[3] and y[2] < y[3]
    for width in (16, 1 << 14):
        got = Counter((r.l.id, r.r.id) for r in intervals.overlaps(a, b, ["chrom"], width=width).collect())
        assert got == Counter((x[0], y[0]) for x in left for y in right if hit(x, y))
        assert Counter(r.id for r in intervals.overlapping_rows(a, b, ["chrom"], width=width).collect()) == Counter(x[0] for x in left if any(hit(x, y) for y in right))


def test_multimapped(spark):
    rows = [("r", 99, c, p, "10M", t, "ACGTACGTAC", {"AS": s}) for c, p, t, s in [("chr1", 10, 50, "-3"), ("gi|x", 20, 90, "-3"), ("chr2", 30, 40, "-9")]]
    rows += [("r", 147, c, p, "10M", -t, "ACGTACGTAC", {"AS": s}) for c, p, t, s in [("chr1", 50, 50, "-3"), ("gi|x", 100, 90, "-3"), ("chr2", 60, 40, "-9")]]
    rows += [("g", f, c, p, "10M", t, "ACGTACGTAC", {"AS": "0"}) for f, c, p, t in [(83, "chr5", 90, -50), (163, "chr5", 50, 50), (83, "chr6", 900, -80), (163, "chr6", 830, 80)]]
    df = aln(spark, rows)
    got = {(r.qname, r.rname, r.flag) for r in pipelines.reduce_multi(df).collect()}
    assert got == {("r", "gi|x", 99), ("r", "gi|x", 147), ("g", "chr5", 83), ("g", "chr5", 163)}
    on = spark.createDataFrame([("chr6", 840, 850)], "chrom string, start long, end long")
    assert {r.rname for r in pipelines.reduce_multi(df, on).collect()} == {"gi|x", "chr6"}
    single = aln(spark, [("a", 16, "chrM", 1, "9M", 0, "A", {}), ("a", 0, "chr1", 1, "5M4S", 0, "A", {}), ("b", 0, "chrUn", 1, "9M", 0, "A", {}), ("b", 16, "chr2", 1, "9M", 0, "A", {}), ("c", 0, "chr1", 1, "9M", 0, "A", {}), ("c", 0, "chrM", 1, "9M", 0, "A", {})])
    assert {(r.qname, r.rname, r.flag) for r in multimap.best_single(single, "ordinal").collect()} == {("a", "chr1", 0), ("b", "chr2", 16), ("c", "chrM", 0)}


def transcript(spark, strand="+"):
    return spark.createDataFrame([("c", "t", strand, 100, 400, 130, 350, [100, 200, 300], [150, 260, 400])], "chrom string, tid string, strand string, tx_start long, tx_end long, cds long, cde long, exon_starts array<long>, exon_ends array<long>")


def test_transcripts(spark):
    rows = sorted(genes.exon_table(transcript(spark)).collect(), key=lambda r: r.exon_num)
    assert [(r.tx_start, r.tx_end, r.coding_bases, r.contain_cds, r.contain_cde) for r in rows] == [(0, 50, 20, True, False), (50, 110, 60, False, False), (110, 210, 50, False, True)]
    minus = sorted(genes.exon_table(transcript(spark, "-")).collect(), key=lambda r: r.exon_num)
    assert [(r.start, r.tx_start, r.coding_bases) for r in minus] == [(300, 0, 50), (200, 100, 60), (100, 160, 20)]
    assert genes.first_coding_exon(transcript(spark, "-")).first().start == 300
    coded = genes.coding_exons(genes.exon_table(transcript(spark))).orderBy("exon_num").collect()
    assert [(r.is_coding, r.whole_coding) for r in coded] == [(True, False), (True, False), (True, False)]
    utr = lambda right: genes.five_utr_length(*[F.col(c) for c in ("strand", "tx_start", "tx_end", "cds", "cde")], correct=right)
    assert transcript(spark).select(utr(False), utr(True)).first()[:] == (-30, 30) and transcript(spark, "-").select(utr(False)).first()[0] == 50
    named = transcript(spark).withColumn("gene", F.lit("G"))
    assert genes.transcripts_of(named, "G").count() == 1
    with pytest.raises(KeyError):
        genes.transcripts_of(named, "H")
    assert sorted(tuple(r)[1:3] for r in genes.introns(transcript(spark)).collect()) == [(151, 200), (261, 300)]
    assert [r.intron_num for r in genes.introns(transcript(spark, "-")).orderBy("start").collect()] == [2, 1]
    t = genes.exons_of(transcript(spark, "-"))
    assert t.select(genes.genomic_position(F.col("exons"), F.col("strand"), F.lit(30), True)).first()[0] == 370
    assert t.select(genes.genomic_position(F.col("exons"), F.col("strand"), F.lit(30))).first()[0] == 270
    for strand in "+-":
        t = genes.exons_of(transcript(spark, strand))
        for a, b in [(0, 210), (10, 60), (49, 51), (50, 110), (120, 121)]:
            got = t.select(genes.blocks(F.col("exons"), F.col("strand"), F.lit(a), F.lit(b)).alias("x")).first().x
            assert sum(x.end - x.start for x in got) == b - a
            place = [p for s, e in ([(100, 150), (200, 260), (300, 400)]) for p in range(s, e)]
            place = place if strand == "+" else place[::-1]
            assert sorted(p for x in got for p in range(x.start, x.end)) == sorted(place[a:b])
    db = genes.database_transcripts(
        spark.createDataFrame([("t", "protein_coding", 1, 9, None, None, "g")], "tx_id string, tx_biotype string, tx_seq_start int, tx_seq_end int, tx_cds_seq_start int, tx_cds_seq_end int, gene_id string"),
        spark.createDataFrame([("t", "e2", 1), ("t", "e1", 2)], "tx_id string, exon_id string, exon_idx int"),
        spark.createDataFrame([("e1", 1, 3), ("e2", 5, 9)], "exon_id string, exon_seq_start int, exon_seq_end int"),
        spark.createDataFrame([("g", "G", "c", -1)], "gene_id string, gene_name string, seq_name string, seq_strand int"),
    ).first()
    assert (db.strand, db.exon_count, db.exon_starts, db.cds) == ("-", 2, [1, 5], None)


def test_features(spark):
    df = spark.createDataFrame([(1, "ACTGACT"), (2, "AAAA")], "i int, seq string")
    bag = {r.kmer: r.n for r in kmers.kmer_bag(df.where("i = 1"), "i", "seq", 1, 4).collect()}
    assert len(bag) == 16 and bag["ACT"] == 2
    with pytest.raises(PySparkException):
        kmers.kmer_bag(df, "i", "seq", 1, 5).collect()
    gapped = {(r.i, r.key): r.n for r in kmers.gapped_kmers(df, "i", "seq", 2, 1).collect()}
    assert gapped[(2, "AA")] == 3 and gapped[(2, "CA")] == 3 and (2, "CC") not in gapped
    full = {(r.i, r.key): r.n for r in kmers.gapped_kmers(df, "i", "seq", 2, 1, zeros=True).collect()}
    assert len(full) == 32 and full[(2, "CC")] == 0 and {k: v for k, v in full.items() if v} == gapped
    with pytest.raises(ValueError):
        kmers.gapped_kmers(df, "i", "seq", 9, 1)
    msa = spark.createDataFrame([("x", "AC-"), ("y", "AG-"), ("z", "TGT")], "seq_id string, seq string")
    assert [(r.base, round(r.share, 2)) for r in kmers.alignment_consensus(msa, rna=True).orderBy("pos").collect()] == [("A", 0.67), ("G", 0.67), ("-", 0.67)]
    assert {(r.seq_a, r.seq_b): r.distance for r in kmers.pair_matrix(msa).collect()}[("x", "z")] == 3
    with pytest.raises(ValueError):
        kmers.pair_matrix(msa, most=2)


def test_adjusted_p(spark):
    rng = np.random.default_rng(1)
    ps = [*rng.random(200).tolist(), 0.01, 0.01, 0.5, None, float("nan")]
    v = np.array([1.0 if p is None or p != p else p for p in ps])
    order = np.argsort(-v, kind="stable")
    rank = np.array([(v <= x).sum() for x in v])
    want = np.empty(len(v))
    want[order] = np.minimum(1, np.minimum.accumulate((v * len(v) / rank)[order]))
    got = {r.i: r.p_adj for r in stats.adjusted_p(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p").collect()}
    assert np.allclose([got[i] for i in range(len(ps))], want)
    assert stats.adjusted_p(spark.createDataFrame([], "i int, p double"), "p").count() == 0


def test_statistics(spark):
    counts = spark.createDataFrame([(g, s, n) for g, row in {"g1": (10, 20), "g2": (5, 10), "g3": (0, 7), "g4": (8, 16)}.items() for s, n in zip("ab", row)], "gene string, sample string, n long")
    factors = {r.sample: r.size_factor for r in stats.size_factors(counts, "gene", "sample", "n").collect()}
    assert factors["a"] == pytest.approx(2**-0.5) and factors["b"] == pytest.approx(2**0.5)
    x = np.random.default_rng(2).normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), float(2 * a - 3 * b)) for a, b in x], "a double, b double, y double")
    beta = {r.feature: r.beta for r in stats.least_squares(df, ["a", "b"], "y").collect()}
    assert beta["a"] == pytest.approx(2) and beta["b"] == pytest.approx(-3)
    r = {(r.a, r.b): r.r for r in stats.correlations(df, ["a", "y"]).collect()}
    assert r[("a", "y")] == pytest.approx(np.corrcoef(x[:, 0], 2 * x[:, 0] - 3 * x[:, 1])[0, 1])
    means = stats.bootstrap_means(df.withColumn("k", F.col("a")), "y", ["k", "b"], 50, 10)
    assert means.count() == 10 and sorted(map(tuple, means.collect())) == sorted(map(tuple, means.collect()))
    with pytest.raises(ValueError):
        stats.bootstrap_places(spark, 3, 4, 1)
    cats = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0)], "c string, o int")
    assert {r.c: r.color for r in stats.color_codes(cats, "c", "o", ["red", "blue"]).collect()} == {"b": "red", "a": "blue"}
    with pytest.raises(ValueError):
        stats.color_codes(cats, "c", "o", ["red"])
    codes = stats.color_codes(cats.where("c = 'a'"), "c", "o", ["red"])
    assert [r.c for r in stats.unseen_categories(cats.where("c is not null"), codes, "c").collect()] == ["b"]


R1 = "CTTAGCACGTACGGATCGATTACAGATCCAGTACGGATCATTGACCGATT"


def test_merge_and_clip(spark):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    frag = R1 + "GGCATTACGTCAAGTC"
    df = spark.createDataFrame([("x/1", frag[:50], "I" * 50, "x/2", rc(frag[16:]), "I" * 50), ("y/1", "A" * 30, "I" * 30, "y/2", "C" * 30, "I" * 30), ("z/1", None, None, "z/2", "A", "I")], "id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string")
    assert [tuple(r)[:2] for r in trim.merge_pairs(df).collect()] == [("x", frag[16:50])]
    assert [tuple(r)[:2] for r in trim.merge_pairs(df, report_all=True).collect()] == [("x", frag)]
    assert trim.merge_pairs(df, report_all=True, highlight=True).count() == 0
    u, insert = "ACGTCA", R1[:30]
    one, two = u + insert, rc(insert) + rc(u) + trim.ADAPTERS["read1"][:12]
    reads = spark.createDataFrame([("r1 x", one, "I" * len(one), "r1 y", two, "I" * len(two)), ("r2", "ANGTCA" + insert, "I" * 36, "r2", two, "I" * len(two)), ("r3", one, "#" * len(one), "r3", two, "I" * len(two))], df.schema)
    assert [tuple(r) for r in trim.clip_pairs(reads, umi_bases=6).collect()] == [("r1", u, insert, "I" * 30, rc(insert), "I" * 30)]


def test_families(spark):
    rows = []
    for k, (tag, base) in enumerate([("AA", "ACGT"), ("AA", "ACGT"), ("AA", "ACGA"), ("CC", "TTTT")]):
        rows += [(f"q{k}", 99, "c", 10, "4M", 20, base, {"RX": tag}), (f"q{k}", 147, "c", 26, "4M", -20, base, {"RX": tag})]
    out = families.family_reads(families.tagged_families(aln(spark, rows), mode="vote")).collect()
    assert {(r.id, r.seq) for r in out} == {("AA_3_member/1", "ACGN"), ("AA_3_member/2", "NCGT"), ("CC_1_member/1", "TTTT"), ("CC_1_member/2", "AAAA")}
    runs = families.family_reads(families.tagged_families(aln(spark, rows), mode="vote", order="ordinal")).collect()
    assert {r.id for r in runs} == {r.id for r in out}
    pairs_ = spark.createDataFrame([(f"i{k}", "AAGGTT" + s, "I" * 10, "ACGT", "IIII") for k, s in enumerate(["ACGT", "ACGT", "ACGT", "ACGT", "ACGA"])] + [("n", "ANGGTTACGT", "I" * 10, "ACGT", "IIII")], "id1 string, seq1 string, qual1 string, seq2 string, qual2 string")
    got = families.corrected_pairs(pairs_, least=2).collect()
    assert [(r.barcode, r.members, r.seq1, r.seq2) for r in got] == [("AAGGTT", 5, "ACGT", "ACGT")]
    assert families.barcoded_pairs(pairs_).where("not accepted").count() == 1
