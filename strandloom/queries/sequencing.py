"""Driver queries of the sequencing operators over the sequencing tables, with their SQL.

Fragments stand for pairs of alignments (their CIGAR holds both mates'), and
reads lie at the place of their fragment group. Every query reads its whole
tables; copies of a row count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar as C
from strandloom.functions import flags as G
from strandloom.functions import prob as P
from strandloom.functions import seq as S
from strandloom.functions.align import locate
from strandloom.operators import consensus, families, genes, intervals, kmers, multimap, pairs, pileup, stats, trim, umi
from strandloom.operators.unpack import list_values
from strandloom.queries.core_problems import clean_barcode, table
from strandloom.queries.problem_sql import places
from strandloom.sources.tables import infernal_columns, melted_metrics

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- fragments


def frags(spark: SparkSession, sf: str) -> DataFrame:
    """Each valid fragment once."""
    rows = table(spark, sf, "fragments").drop("loaded_at").dropDuplicates(["frag_id"])
    good = F.col("chrom").isNotNull() & F.col("strand").isin("+", "-") & (F.col("start_pos") >= 0) & (F.col("start_pos") < F.col("end_pos"))
    return rows.where(good).withColumnsRenamed({"start_pos": "start", "end_pos": "end"})


F_SQL = """f as (select distinct on (frag_id) frag_id, lib_id, chrom, start_pos as "start", end_pos as "end", read_name, fragment_size, strand, tag, cigar, mapq, run_at from fragments
  where chrom is not null and strand in ('+','-') and start_pos >= 0 and start_pos < end_pos)"""

_SAT_PLACES = f"""with {F_SQL}, s as (select chrom, "start", "end", strand, count(distinct tag) n_umi from f where tag is not null group by all),
m as (select *, greatest(n_umi, cast(round(-1048576.0 * ln(1 - least(n_umi, 1048575) / 1048576.0)) as bigint)) n_molecules from s)"""


def _saturated_places(spark: SparkSession, sf: str) -> DataFrame:
    return umi.saturation(frags(spark, sf).where(F.col("tag").isNotNull()), ["chrom", "start", "end", "strand"], "tag", 10)


@query(_SAT_PLACES + " select * from m")
def umi_saturation_places(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tags at the places of a BED file."""
    return _saturated_places(spark, sf)


@query(_SAT_PLACES + """ select chrom, "start", "end", strand, 'frag:UMI_' || n_umi || '_' || i as name, 0 as score from (select *, unnest(range(1, n_molecules + 1)) i from m)""")
def poisson_expand_places(spark: SparkSession, sf: str) -> DataFrame:
    return umi.expanded_molecules(_saturated_places(spark, sf))


@query(f'with {F_SQL} select chrom, "start", "end", strand, tag umi, count(*) n_members from f where tag is not null group by all')
def umi_dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return umi.deduplicated(frags(spark, sf), ["chrom", "start", "end", "strand"], "tag", method="exact")


@query(f"with {F_SQL} select frag_id, tag from f where tag is not null and not regexp_matches(tag, 'A{{4}}|C{{4}}|G{{4}}|T{{4}}')")
def filter_umi_runs(spark: SparkSession, sf: str) -> DataFrame:
    return umi.without_runs(frags(spark, sf), F.col("tag"), 3).select("frag_id", "tag")


@query(
    """with r as (select distinct frag_id, read_name, split_part(read_name, '_', 1) u from fragments where read_name is not null)
select frag_id, u as rx, replace(replace(read_name, u || '_', ''), '_' || u, '') qname from r"""
)
def umi_tag(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fragments").select("frag_id", F.col("read_name").alias("qname")).dropDuplicates(["frag_id"]).where(F.col("qname").isNotNull())
    tagged = umi.tag_with_umi(rows.withColumn("tags", F.lit(None).cast("map<string,string>")), "RX", "_", 0)
    return tagged.select("frag_id", F.col("tags")["RX"].alias("rx"), "qname")


def _mate_cigar(k: int) -> Column:
    return F.split("cigar", ":")[k]


def _n(expr: str, ops: str) -> str:
    return f"coalesce(list_sum([x::bigint for x in regexp_extract_all({expr}, '([0-9]+)[{ops}]', 1)]), 0)::bigint"


_MATES = f"""{F_SQL}, p as (select *, split_part(cigar, ':', 1) c1, split_part(cigar, ':', 2) c2 from f where regexp_matches(cigar, '^([0-9]+[MIDNS])+:([0-9]+[MIDNS])+$')),
a as (select *, case when strand = '+' then 99 else 83 end + case when frag_id % 31 = 0 then 256 else 0 end f1, case when strand = '+' then 147 else 163 end f2,
  "start" as s1, "end" - {_n("c2", "MDN")} as s2, fragment_size * case when strand = '+' then 1 else -1 end t1 from p)"""


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Two alignments of each fragment: the first from its start, the second up to its end; every 31st is secondary."""
    rows = frags(spark, sf).where(F.col("cigar").rlike("^([0-9]+[MIDNS])+:([0-9]+[MIDNS])+$"))
    plus = F.col("strand") == "+"
    second = F.when(F.col("frag_id") % 31 == 0, 256).otherwise(0)
    size = F.when(plus, F.col("fragment_size")).otherwise(-F.col("fragment_size"))
    tags = lambda hits: F.create_map(F.lit("AS"), F.col("mapq").cast("string"), F.lit("RX"), F.col("tag"), F.lit("NH"), hits)
    hits = F.when(F.col("mapq") >= 42, "1").otherwise("3")
    one = F.struct((F.when(plus, 99).otherwise(83) + second).alias("flag"), F.col("start").alias("pos"), _mate_cigar(0).alias("cigar"), size.alias("tlen"), tags(hits).alias("tags"))
    two = F.struct(F.when(plus, 147).otherwise(163).alias("flag"), (F.col("end") - C.reference_length(_mate_cigar(1))).alias("pos"), _mate_cigar(1).alias("cigar"), (-size).alias("tlen"), tags(hits).alias("tags"))
    return rows.select(F.col("frag_id").cast("string").alias("qname"), F.col("chrom").alias("rname"), "mapq", F.explode(F.array(one, two)).alias("x")).select("qname", "rname", "mapq", "x.*")


@query(
    f"""with {_MATES}, m as (select *, s1 + {_n("c1", "MDN")} e1, s2 + {_n("c2", "MDN")} e2 from a where f1 & 256 = 0)
select chrom, least(s1, s2) as "start", greatest(e1, e2) as "end", frag_id::varchar as name, greatest(e1, e2) - least(s1, s2) length, strand, tag, c1 || ':' || c2 as cigar from m
where greatest(e1, e2) - least(s1, s2) between 20 and 5000"""
)
def pair_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.fragments(pairs.mates(alignments(spark, sf)), min_size=20, max_size=5000, only_primary=True, tag="RX", add_cigar=True)


@query(
    f"""with {_MATES}, m as (select *, s1 + {_n("c1", "MDN")} e1, s2 + {_n("c2", "MDN")} e2 from a)
select lib_id, chrom, least(s1, s2) as "start", greatest(e1, e2) as "end", regexp_extract(read_name, '^[^/\\s]*') as name, greatest(e1, e2) - least(s1, s2) length, strand from m where read_name is not null and lib_id is not null"""
)
def bam_to_bed_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of files, one a library, in which a name has many alignments: each read 1 goes with the read 2 that follows it."""
    names = table(spark, sf, "fragments").select(F.col("frag_id").cast("string").alias("qname"), "lib_id", F.regexp_extract("read_name", r"(?s)\A([^/\s]*)", 1).alias("read")).dropDuplicates(["qname"]).dropna()
    rows = alignments(spark, sf).join(names, "qname").withColumn("ordinal", F.col("qname").cast("long") * 2 + G.has(F.col("flag"), G.READ2).cast("int"))
    rows = rows.withColumn("qname", F.col("read")).withColumn("file", F.col("lib_id").cast("string")).drop("read", "lib_id")
    together = pairs.mates_in_order(rows).withColumn("rname1", F.concat_ws("@", "rname1", "file1")).withColumn("rname2", F.concat_ws("@", "rname2", "file2"))
    found = pairs.fragments(together)
    return found.select(F.split("chrom", "@")[1].cast("long").alias("lib_id"), F.split("chrom", "@")[0].alias("chrom"), "start", "end", "name", "length", "strand")


@query(
    f"""with {_MATES}, u as (select frag_id, f1 flag, chrom, s1 p, c1 c, strand from a union all select frag_id, f2, chrom, s2, c2, case when strand = '+' then '-' else '+' end from a)
select chrom, p::bigint as "start", (p + {_n("c", "MDN")})::bigint as "end", 'x:' || frag_id as name, {_n("c", "MDN")} length, strand, c cigar from u where {_n("c", "MDN")} between 1 and 500"""
)
def single_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Each alignment as a fragment of its own."""
    found = pairs.single_fragments(alignments(spark, sf), min_size=1, max_size=500, add_cigar=True, prefix="x")
    return found.withColumns({c: F.col(c).cast("long") for c in ("start", "end", "length")})


@query(
    f"""with {F_SQL}, o as (select frag_id, lib_id, tag, row_number() over (partition by lib_id order by tag, frag_id) k from f where tag is not null and lib_id is not null),
l as (select lib_id, list(frag_id order by k) ids, list({{'first': tag, 'run': 0::bigint, 'runs': [0::bigint]}} order by k) rows from o group by 1),
d as (select lib_id, ids, list_reduce(rows, lambda a, x: case when length(a.first) = length(x.first) and hamming(a.first, x.first) <= 1
  then {{'first': a.first, 'run': a.run, 'runs': list_append(a.runs, a.run)}} else {{'first': x.first, 'run': a.run + 1, 'runs': list_append(a.runs, a.run + 1)}} end).runs runs from l)
select unnest(ids) frag_id, unnest(runs) run from d"""
)
def tag_runs_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of near tags among the tags of each library in order."""
    rows = frags(spark, sf).where(F.col("tag").isNotNull() & F.col("lib_id").isNotNull()).select("frag_id", "lib_id", "tag", F.struct("tag", "frag_id").alias("at"))
    return umi.tag_runs(rows, "at", "tag", ["lib_id"]).select("frag_id", "run")


@query(
    f"""with {F_SQL}, b as (select *, case when frag_id % 7 = 0 then strand when strand = '+' then '-' else '+' end o from f)
select chrom, "start", "end", frag_id::varchar as name, "end" - "start" as length, strand from b where strand <> o and "end" - "start" > 100 and "end" - "start" < 1000"""
)
def bedpe_to_bed(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("frag_id") % 7 == 0, F.col("strand")).when(F.col("strand") == "+", "-").otherwise("+")
    mid = F.expr("start + (end - start) div 2")
    rows = frags(spark, sf).select(F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), mid.alias("end1"), F.col("chrom").alias("chrom2"), mid.alias("start2"), F.col("end").alias("end2"), F.col("frag_id").cast("string").alias("name"), F.lit("0").alias("score"), F.col("strand").alias("strand1"), other.alias("strand2"))
    return pairs.bedpe_fragments(rows, min_size=100, max_size=1000)


@query(f"with {_MATES} select frag_id::varchar qname, 1 as mate, c2 mc, mapq::varchar mq from a where f1 & 256 = 0 union all select frag_id::varchar, 2, c1, mapq::varchar from a where f1 & 256 = 0")
def mate_info(spark: SparkSession, sf: str) -> DataFrame:
    tagged = pairs.with_mate_tags(pairs.mates(alignments(spark, sf)))
    return pairs.unpair(tagged, ["tags"]).select("qname", "mate", F.col("tags")["MC"].alias("mc"), F.col("tags")["MQ"].alias("mq"))


_LONGEST = "coalesce(list_max([x::int for x in regexp_extract_all({0}, '([0-9]+)S', 1)]), 1)"


@query(f"with {_MATES} select case when mapq = 255 then 'unique' else 'multi' end bucket, count(*) n from a where {_LONGEST.format('c1')} < 20 and {_LONGEST.format('c2')} < 20 group by 1")
def split_unique_multi(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.route_unique(pairs.mates(alignments(spark, sf))).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_MATES} select frag_id::varchar qname, case when mapq >= 42 then 'unique' else 'multi' end bucket from a where {_LONGEST.format('c1')} < 20 and {_LONGEST.format('c2')} < 20 and mapq is not null")
def split_unique_hits(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.route_unique(pairs.mates(alignments(spark, sf)).where(F.col("mapq1").isNotNull()), "hisat2").select("qname", "bucket")


@query(f"with {_MATES} select frag_id::varchar qname, case when contains(c1, 'N') or contains(c2, 'N') then 'split' else 'fragment' end bucket from a where f1 & 256 = 0")
def split_spliced(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.route_spliced(pairs.mates(alignments(spark, sf))).select("qname", "bucket")


@query(f"with {_MATES}, u as (select frag_id::varchar qname, f1 flag, c1 c from a union all select frag_id::varchar, f2, c2 from a) select qname, flag from u where not contains(c, 'S') or {_n('c', 'S')} < {_n('c', 'MIS')} * 0.1")
def softclip_single(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.filter_clipped_single(alignments(spark, sf), 0.1).select("qname", "flag")


_BOTH = f"({_n('c1', 'S')} + {_n('c2', 'S')})"
_PASS = f"""({_n("c1", "S")} < {_n("c1", "MIS")} * 0.2 or not contains(c1, 'S')) and ({_n("c2", "S")} < {_n("c2", "MIS")} * 0.2 or not contains(c2, 'S'))
and case when abs(t1) > 0 then {_BOTH} < abs(t1) * 0.1 else {_BOTH} < {_n("c1", "MIS")} * 0.1 and {_BOTH} < {_n("c2", "MIS")} * 0.1 end"""


@query(f"with {_MATES} select frag_id::varchar qname from a where f1 & 256 = 0 and (not contains(c1, 'S') and not contains(c2, 'S') or ({_PASS}))")
def softclip_pair(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.filter_clipped_pairs(pairs.mates(alignments(spark, sf)), 0.2, 0.1).select("qname")


@query(f"with {_MATES} select frag_id::varchar qname from a where f1 & 256 = 0 and (contains(c1, 'S') or contains(c2, 'S')) and not ({_PASS})")
def softclip_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.filter_clipped_pairs(pairs.mates(alignments(spark, sf)), 0.2, 0.1, inverse=True).select("qname")


@query(
    f"""with {_MATES}, x as (select frag_id, c1, [repeat(right(x, 1), left(x, length(x) - 1)::int) for x in regexp_extract_all(c1, '([0-9]+[MIS])', 1)] l from a)
select frag_id, array_to_string(l, '') letters, replace(array_to_string(l, ''), 'I', '') uninserted, {_n("c1", "MDN")} ref_len, {_n("c1", "M")} mapped from x"""
)
def cigar_expand(spark: SparkSession, sf: str) -> DataFrame:
    rows = alignments(spark, sf).where(G.has(F.col("flag"), G.READ1)).withColumn("letters", C.expand(F.col("cigar")))
    return rows.select(F.col("qname").cast("long").alias("frag_id"), "letters", C.without_insertions(F.col("letters"), F.col("letters")).alias("uninserted"), C.reference_length(F.col("cigar")).cast("long").alias("ref_len"), C.mapped_length(F.col("cigar")).cast("long").alias("mapped"))


@query(f"with {_MATES}, u as (select f1 flag from a union all select f2 from a) select flag, case when (flag & 64 > 0) = (flag & 16 = 0) then '+' else '-' end fr, case when (flag & 128 > 0) = (flag & 16 = 0) then '+' else '-' end rf, case when flag & 16 = 0 then '+' else '-' end own, count(*) n from u group by all")
def strand_call(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("flag")
    return alignments(spark, sf).groupBy("flag", G.strand(flag, "fr").alias("fr"), G.strand(flag, "rf").alias("rf"), G.strand(flag, "U").alias("own")).agg(F.count(F.lit(1)).alias("n"))


_READ = "regexp_extract(read_name, '^[^/\\s]*')"


@query(
    f"""with {_MATES}, g as (select distinct chrom, start_pos - 1 gs, end_pos ge from gtf_records where feature_type = 'gene' and chrom is not null and start_pos <= end_pos),
v as (select *, {_READ} qname, exists (select 1 from g where g.chrom = a.chrom and gs < greatest(s1 + {_n("c1", "MDN")}, s2 + {_n("c2", "MDN")}) and ge > least(s1, s2)) on_gene from a where read_name is not null),
k as (select *, row_number() over (partition by qname order by mapq desc nulls last, regexp_matches(chrom, '^gi|^chrM|^MT') desc, on_gene desc, abs(t1), regexp_matches(chrom, '^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y)$') desc) k,
  rank() over (partition by qname order by mapq desc nulls last, regexp_matches(chrom, '^gi|^chrM|^MT') desc, on_gene desc, abs(t1), regexp_matches(chrom, '^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y)$') desc) r from v where t1 is not null)
select qname, mapq, abs(t1) size, on_gene from k where k = 1"""
)
def best_alignment_pair(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "fragments").select("frag_id", F.regexp_extract("read_name", r"(?s)\A([^/\s]*)", 1).alias("read")).dropDuplicates(["frag_id"]).where(F.col("read").isNotNull())
    paired = pairs.mates(alignments(spark, sf).drop("tags")).withColumn("frag_id", F.col("qname").cast("long")).drop("qname")
    rows = paired.join(names, "frag_id").withColumnRenamed("read", "qname").where(F.col("tlen1").isNotNull())
    gene = _genes(spark, sf)
    best = multimap.best_pairs(rows, gene, score=F.col("mapq1"))
    start, end = F.least("pos1", "pos2"), F.greatest(F.col("pos1") + C.reference_length(F.col("cigar1")), F.col("pos2") + C.reference_length(F.col("cigar2")))
    spans = best.select("qname", "mapq1", F.abs("tlen1").alias("size"), F.col("rname1").alias("chrom"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    hit = intervals.overlapping_rows(spans.select("qname", "chrom", "start", "end"), gene, ["chrom"]).select("qname").withColumn("on_gene", F.lit(True))
    return spans.join(hit, "qname", "left").select("qname", F.col("mapq1").alias("mapq"), "size", F.coalesce("on_gene", F.lit(False)).alias("on_gene"))


@query(
    f"""with {_MATES}, v as (select *, {_READ} qname, {_n("c1", "M")} m, regexp_matches(chrom, '^gi|^chrM|^MT') ribo, regexp_matches(chrom, '^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y)$') plain from a where read_name is not null),
w as (select *, m = min(m) over (partition by qname) l from v),
c as (select *, sum(l::int) over (partition by qname) nl, sum(ribo::int) over (partition by qname) nr, sum(plain::int) over (partition by qname) np from w),
k as (select *, row_number() over (partition by qname order by (case when nl = 1 then l when nr = 1 then ribo when np > 0 then plain else true end) desc, frag_id) k from c)
select qname, frag_id, case when strand = '+' then 0 else 16 end flag from k where k = 1"""
)
def best_alignment_single(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "fragments").select("frag_id", F.regexp_extract("read_name", r"(?s)\A([^/\s]*)", 1).alias("read")).dropDuplicates(["frag_id"]).where(F.col("read").isNotNull())
    rows = alignments(spark, sf).where(G.has(F.col("flag"), G.READ1)).withColumn("frag_id", F.col("qname").cast("long")).drop("qname").join(names, "frag_id").withColumnRenamed("read", "qname")
    return multimap.best_single(rows, "frag_id").select("qname", "frag_id", "flag")


def _genes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "gtf_records").where(F.col("feature_type") == "gene")
    return rows.select("chrom", (F.col("start_pos") - 1).alias("start"), F.col("end_pos").alias("end")).where(F.col("chrom").isNotNull() & (F.col("start") < F.col("end"))).distinct()


_GENES = "g as (select distinct chrom, start_pos - 1 gs, end_pos ge from gtf_records where feature_type = 'gene' and chrom is not null and start_pos <= end_pos)"


@query(f'with {F_SQL}, {_GENES} select frag_id from f where exists (select 1 from g where g.chrom = f.chrom and gs < f."end" and ge > f."start")')
def gene_overlap_semi(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.overlapping_rows(frags(spark, sf).select("frag_id", "chrom", "start", "end"), _genes(spark, sf), ["chrom"]).select("frag_id")


@query(f'with {F_SQL}, {_GENES} select frag_id, gs gene_start, ge gene_end, least(ge, f."end") - greatest(gs, f."start") shared from f join g on g.chrom = f.chrom and gs < f."end" and ge > f."start"')
def gene_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.overlaps(frags(spark, sf).select("frag_id", "chrom", "start", "end"), _genes(spark, sf), ["chrom"])
    shared = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    return found.select("l.frag_id", F.col("r.start").alias("gene_start"), F.col("r.end").alias("gene_end"), shared.alias("shared"))


@query(f"""with {F_SQL}, l as (select chrom, max("end") n from f group by 1) select chrom, i * 1000000 as "start", least((i + 1) * 1000000, n) as "end" from (select *, unnest(range(0, (n + 999999) // 1000000)) i from l)""")
def region_tiles(spark: SparkSession, sf: str) -> DataFrame:
    sizes = frags(spark, sf).groupBy("chrom").agg(F.max("end").alias("size"))
    return pileup.region_tiles(sizes, "chrom", "size", 1_000_000)


# ---------------------------------------------------------------- UMI graphs


def _all_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "barcode_sets").select("bc_id", "group_id", F.upper("umi").alias("umi"), F.coalesce("n_members", F.lit(1)).alias("k")).dropDuplicates(["bc_id"])
    return rows.where(F.col("umi").isNotNull()).groupBy("group_id", "umi").agg(F.sum("k").alias("n"))


_ALL_COUNTS = """b as (select distinct bc_id, group_id, upper(umi) umi, coalesce(n_members, 1) k from barcode_sets where umi is not null),
c as (select group_id, umi, sum(k)::bigint n, length(umi) len from b group by group_id, umi),
k as (select *, row_number() over (partition by group_id order by n desc, umi) rk from c)"""
_REACHED = """r(group_id, rk, top) as (select group_id, rk, rk from k union select e.group_id, e.d, r.top from r join e on e.group_id is not distinct from r.group_id and e.s = r.rk where r.top < e.d),
t as (select group_id, rk, min(top) top from r group by 1, 2)
select t.group_id, u.umi, sum(k.n)::bigint n_members from t join k on k.group_id is not distinct from t.group_id and k.rk = t.rk join k u on u.group_id is not distinct from t.group_id and u.rk = t.top group by 1, 2"""


@query(f"with {_ALL_COUNTS} select x.group_id, x.umi a, x.n na, y.umi b, y.n nb from c x join c y on x.group_id is not distinct from y.group_id and x.len = y.len and x.umi < y.umi and hamming(x.umi, y.umi) <= 2")
def umi_blocked_pairs_all(spark: SparkSession, sf: str) -> DataFrame:
    return umi.near_pairs(_all_group_counts(spark, sf), ["group_id"], 2)


@query(
    f"""with recursive {_ALL_COUNTS}, e as (select x.group_id, x.rk s, y.rk d from k x join k y on x.group_id is not distinct from y.group_id and x.len = y.len and x.umi <> y.umi and hamming(x.umi, y.umi) <= 1 and x.n >= 2 * y.n - 1),
{_REACHED}"""
)
def umi_dedup_directional_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every UMI of the table, those with an unread base too: members add up to the input."""
    found = umi.directional_clusters(_all_group_counts(spark, sf), ["group_id"])
    return found.groupBy("group_id", F.col("cluster").alias("umi")).agg(F.sum("n").alias("n_members"))


@query(
    f"""with recursive {_ALL_COUNTS}, e as (select x.group_id, x.rk s, y.rk d from k x join k y on x.group_id is not distinct from y.group_id and abs(x.len - y.len) <= 1 and x.umi <> y.umi and levenshtein(x.umi, y.umi) <= 1),
{_REACHED}"""
)
def umi_dedup_adjacency_all(spark: SparkSession, sf: str) -> DataFrame:
    found = umi.adjacency_clusters(_all_group_counts(spark, sf), ["group_id"])
    return found.groupBy("group_id", F.col("cluster").alias("umi")).agg(F.sum("n").alias("n_members"))


# ---------------------------------------------------------------- reads


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Each record once, of those with a barcode and qualities that fit."""
    rows = table(spark, sf, "fastq_reads").select("rec_id", "read_id", "seq", "qual", clean_barcode(F.col("barcode")).alias("barcode"), "group_id").dropDuplicates(["rec_id"])
    return rows.withColumn("seq", F.upper("seq")).where(F.col("barcode").isNotNull() & (F.length("seq") == F.length("qual")) & (F.length("seq") > 20))


R_SQL = r"""rr as (select distinct on (rec_id) rec_id, read_id, upper(seq) seq, qual, upper(regexp_replace(barcode, '^\s+|\s+$', '', 'g')) barcode, group_id from fastq_reads),
r as (select * from rr where barcode is not null and not contains(barcode, 'N') and length(seq) = length(qual) and length(seq) > 20)"""

def sequences(spark: SparkSession, sf: str, least: int = 0) -> DataFrame:
    """Every record with a sequence of ``least`` bases or more, once, whatever its barcode and qualities."""
    rows = table(spark, sf, "fastq_reads").select("rec_id", F.upper("seq").alias("seq"))
    return rows.where(F.col("seq").isNotNull() & (F.length("seq") >= least)).dropDuplicates(["rec_id"])


ALL_SQL = "r as (select distinct on (rec_id) rec_id, upper(seq) seq from fastq_reads where seq is not null)"

_BASES = f"""with {R_SQL}, fam as (select group_id, barcode, min(length(seq)) cut from r where group_id is not null group by 1, 2),
x as (select r.group_id, r.barcode, i - 1 pos, substr(seq, i, 1) base, ascii(substr(qual, i, 1)) - 33 q from (select *, unnest(range(1, length(seq) + 1)) i from r) r join fam on fam.group_id = r.group_id and fam.barcode = r.barcode where i <= cut),
s as (select group_id, barcode, pos, base, count(*) n, sum(q) qs, sum(ln(greatest(1 - pow(10.0, -q / 10.0), 1e-300))) hit, sum(ln(pow(10.0, -q / 10.0) / 3)) miss from x group by all)"""


def _family_reads(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).where(F.col("group_id").isNotNull())


@query(
    _BASES
    + """, v as (select *, sum(n) over w depth, row_number() over (partition by group_id, barcode, pos order by n desc, base) k from s window w as (partition by group_id, barcode, pos))
select group_id, barcode, pos::int pos, case when n / depth >= 0.8 then base else 'N' end base, round(case when n / depth >= 0.8 then least(0.99999999999, 1 - pow(10.0, -qs / 10.0)) else 0 end, 6) prob from v where k = 1"""
)
def consensus_vote(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["group_id", "barcode"]
    return consensus.called_bases(consensus.bases_by_position(_family_reads(spark, sf), keys), keys, "vote", 0.8).withColumn("prob", F.round("prob", 6))


@query(
    _BASES
    + """, v as (select *, hit + sum(miss) over w - miss lg, count(*) over w seen from s window w as (partition by group_id, barcode, pos)),
m as (select *, max(lg) over w top, row_number() over (partition by group_id, barcode, pos order by round(lg, 9) desc, base) k from v window w as (partition by group_id, barcode, pos)),
t as (select *, sum(exp(lg - top)) over (partition by group_id, barcode, pos) rest from m)
select group_id, barcode, pos::int pos, base, round(case when seen = 1 then 0.99999999999 else exp(lg - top) / rest end, 6) prob from t where k = 1"""
)
def consensus_posterior(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["group_id", "barcode"]
    return consensus.called_bases(consensus.bases_by_position(_family_reads(spark, sf), keys), keys, "prob").withColumn("prob", F.round("prob", 6))


@query(
    _BASES
    + """, v as (select *, sum(n) over (partition by group_id, barcode, pos) depth, row_number() over (partition by group_id, barcode, pos order by n desc, base) k from s),
c as (select group_id, barcode, string_agg(case when n / depth >= 0.8 then base else 'N' end, '' order by pos) seq,
  string_agg(chr(cast(floor(least(greatest(-10 * log10(1 - case when n / depth >= 0.8 then least(0.99999999999, 1 - pow(10.0, -qs / 10.0)) else 0 end) + 33, 33), 73) + 1e-9) as int)), '' order by pos) qual from v where k = 1 group by 1, 2),
o as (select group_id, barcode, count(*) members, min({'s': seq, 'q': qual}) one from r where group_id is not null group by 1, 2)
select group_id, barcode, members, case when members = 1 then one.s else seq end seq, case when members = 1 then one.q else qual end qual from c join o using (group_id, barcode)"""
)
def family_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.consensus_reads(_family_reads(spark, sf), ["group_id", "barcode"], mode="vote")


@query(f"with {R_SQL}, f as (select barcode, count(*) size from r group by 1) select size, count(*) n_families from f group by 1")
def family_size_hist(spark: SparkSession, sf: str) -> DataFrame:
    return umi.family_sizes(reads(spark, sf).groupBy("barcode").agg(F.count(F.lit(1)).alias("members")), "members")


@query(f"with {R_SQL}, b as (select distinct barcode from r) select barcode, row_number() over (order by barcode) - 1 cluster_no from b")
def numbered_families(spark: SparkSession, sf: str) -> DataFrame:
    return umi.numbered_clusters(reads(spark, sf).select("barcode").distinct(), "barcode")


_RC = "reverse(translate({0}, 'ACGTN', 'TGCAN'))"


def _read_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of which read 2 is read 1 backwards, for the pair operators."""
    return reads(spark, sf).select("rec_id", "group_id", F.col("read_id").alias("id1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"), F.col("read_id").alias("id2"), S.reverse_complement(F.col("seq")).alias("seq2"), F.reverse("qual").alias("qual2"))


_Q = "[ascii(c) - 33 for c in string_split({0}, '')]"


@query(
    f"""with {R_SQL}, b as (select rec_id, substr(seq, 1, 6) barcode, substr(qual, 1, 6) bq, substr(seq, 7) rest, substr(qual, 7) restq, seq, qual from r)
select rec_id, barcode, not contains(barcode, 'N') and floor(list_avg({_Q.format("bq")})) > 20 accepted,
  case when not contains(barcode, 'N') and floor(list_avg({_Q.format("bq")})) > 20 then substr({_RC.format("seq")}, 7) else {_RC.format("seq")} end seq2 from
  (select rec_id, substr({_RC.format("seq")}, 1, 6) barcode, substr(reverse(qual), 1, 6) bq, seq from r)"""
)
def barcode_on_read2(spark: SparkSession, sf: str) -> DataFrame:
    return families.barcoded_pairs(_read_pairs(spark, sf), read=2).select("rec_id", "barcode", "accepted", "seq2")


@query(
    f"""with {R_SQL}, b as (select rec_id, substr(seq, 1, 6) barcode, {_Q.format("substr(qual, 1, 6)")} bq, {_Q.format("qual")} aq from r)
select rec_id, barcode, not contains(barcode, 'N') and list_min(bq) >= 20 and list_min(list_slice(aq, 7, 10000)) >= 20 and list_min(aq) >= 20 accepted from b"""
)
def barcode_on_read1(spark: SparkSession, sf: str) -> DataFrame:
    return families.barcoded_pairs(_read_pairs(spark, sf), read=1).select("rec_id", "barcode", "accepted")


def _voted(name: str, rows: str, keys: str, seq: str, qual: str) -> str:
    """CTEs that end in ``name``: keys, members, seq and qual of each family's vote at 0.8; a family of one keeps its read."""
    return f"""{name}_r as (select {keys}, {seq} s, {qual} q from {rows} where length({seq}) > 0),
{name}_f as (select {keys}, count(*) members, min(length(s)) cut, min({{'s': s, 'q': q}}) one from {name}_r group by all),
{name}_x as (select {keys}, i - 1 pos, substr(s, i, 1) base, ascii(substr(q, i, 1)) - 33 q from (select *, unnest(range(1, length(s) + 1)) i from {name}_r) join {name}_f using ({keys}) where i <= cut),
{name}_s as (select {keys}, pos, base, count(*) n, sum(q) qs from {name}_x group by all),
{name}_v as (select *, sum(n) over (partition by {keys}, pos) depth, row_number() over (partition by {keys}, pos order by n desc, base) k from {name}_s),
{name}_c as (select {keys}, string_agg(case when n / depth >= 0.8 then base else 'N' end, '' order by pos) seq,
  string_agg(chr(cast(floor(least(greatest(-10 * log10(1 - case when n / depth >= 0.8 then least(0.99999999999, 1 - pow(10.0, -qs / 10.0)) else 0 end) + 33, 33), 73) + 1e-9) as int)), '' order by pos) qual from {name}_v where k = 1 group by {keys}),
{name} as (select {keys}, members, case when members = 1 then one.s else seq end seq, case when members = 1 then one.q else qual end qual from {name}_c join {name}_f using ({keys}))"""


@query(
    f"""with {R_SQL}, a as (select seq seq1, qual qual1, {_RC.format("seq")} back, reverse(qual) kcab from r where length(seq) > 6),
b as (select substr(back, 1, 6) barcode, seq1, qual1, substr(back, 7) seq2, substr(kcab, 7) qual2 from a where not contains(substr(back, 1, 6), 'N') and floor(list_avg({_Q.format("substr(kcab, 1, 6)")})) > 20),
{_voted("one", "b", "barcode", "seq1", "qual1")}, {_voted("two", "b", "barcode", "seq2", "qual2")}
select barcode, one.members, one.seq seq1, one.qual qual1, two.seq seq2, two.qual qual2 from one join two using (barcode) where one.members >= 2"""
)
def corrected_read_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return families.corrected_pairs(_read_pairs(spark, sf), read=2, least=2)


def placed_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads as single alignments at their group's place, with a clip, an insertion or a deletion by record."""
    place = table(spark, sf, "barcode_sets").where(F.col("chrom").isNotNull() & (F.col("start_pos") >= 0) & F.col("strand").isin("+", "-")).groupBy("group_id").agg(F.min(F.struct("chrom", "start_pos", "strand")).alias("p"))
    rows = reads(spark, sf).join(place, "group_id")
    n = F.length("seq")
    shape = F.pmod(F.col("rec_id"), F.lit(5))
    cigar = F.when(shape == 0, F.concat(F.lit("5S"), (n - 5).cast("string"), F.lit("M"))).when(shape == 1, F.concat(F.lit("10M2I"), (n - 12).cast("string"), F.lit("M"))).when(shape == 2, F.concat(F.lit("10M3D"), (n - 10).cast("string"), F.lit("M"))).otherwise(F.concat(n.cast("string"), F.lit("M")))
    return rows.select(F.col("rec_id").cast("string").alias("qname"), F.when(F.col("p.strand") == "+", 0).otherwise(16).alias("flag"), F.col("p.chrom").alias("rname"), F.col("p.start_pos").alias("pos"), cigar.alias("cigar"), "seq", "qual", "barcode")


_PLACED = f"""{R_SQL}, pl as (select group_id, min({{'c': chrom, 's': start_pos, 't': strand}}) p from barcode_sets where chrom is not null and start_pos >= 0 and strand in ('+','-') group by 1),
al as (select r.*, p.c chrom, p.s s0, p.t strand from r join pl using (group_id)),
xx as (select chrom, s0, strand, rec_id % 5 sh, i - 1 q0, substr(seq, i, 1) base, ascii(substr(qual, i, 1)) - 33 phred, length(seq) len from (select *, unnest(range(1, length(seq) + 1)) i from al)),
bp as (select chrom, strand, base, phred, q0, len, s0 + case when sh = 0 then q0 - 5 when sh = 1 and q0 >= 12 then q0 - 2 when sh = 2 and q0 >= 10 then q0 + 3 else q0 end pos from xx
  where not (sh = 0 and q0 < 5) and not (sh = 1 and q0 in (10, 11)))"""
_COUNT = ", ".join(f"count(*) filter (base = '{c[0]}' and strand = '{c[1]}') as \"{c}\"" for c in pileup.COLUMNS)
_PILE = f"pu as (select chrom, pos, {_COUNT} from bp where phred >= 20 and q0 >= 2 and q0 <= len - 2 and q0 > 0 and pos > 0 group by 1, 2)"
_PLUS, _MINUS = (" + ".join(f'"{b}{s}"' for b in pileup.BASES) for s in "+-")


def _piled(spark: SparkSession, sf: str, **options: object) -> DataFrame:
    return pileup.pileup(placed_reads(spark, sf), min_qual=20, crop=2, direction="U", **options)


@query(f"with {_PLACED}, {_PILE} select * from pu where {_PLUS} > 0 or {_MINUS} > 0")
def pileup_bases(spark: SparkSession, sf: str) -> DataFrame:
    return _piled(spark, sf)


@query(f"with {_PLACED}, {_PILE} select * from pu where {_PLUS} > 10 or {_MINUS} > 10")
def pileup_min_cov(spark: SparkSession, sf: str) -> DataFrame:
    return _piled(spark, sf, min_cov=10)


@query(f"with {_PLACED}, {_PILE} select chrom, pos, {_PLUS} plus, {_MINUS} minus from pu where {_PLUS} > 0 or {_MINUS} > 0")
def coverage_by_strand(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.coverage(_piled(spark, sf))


_SUMS = ", ".join(f'"{b}+" + "{b}-" as {b.lower()}' for b in pileup.BASES)


@query(
    f"""with {_PLACED}, {_PILE}, s as (select chrom, pos, {_SUMS} from pu where {_PLUS} > 0 or {_MINUS} > 0), t as (select *, greatest(a, c, g, t) m from s),
i as (select *, case when c = m then 1 else 0 end + case when g = m then 2 else 0 end + case when t = m then 3 else 0 end k from t)
select chrom, pos, case k when 0 then 'A' when 1 then 'C' when 2 then 'G' when 3 then 'T' else 'N' end base from i"""
)
def consensus_coverage_ties(spark: SparkSession, sf: str) -> DataFrame:
    total = [F.col(f"`{b}+`") + F.col(f"`{b}-`") for b in pileup.BASES]
    return _piled(spark, sf).select("chrom", "pos", consensus.coverage_call(*total).alias("base"))


@query(
    f"""with {_PLACED}, {_PILE}, l as (select chrom, pos, x.b base from (select chrom, pos, unnest([{{'n': "A+", 'b': 'A'}}, {{'n': "C+", 'b': 'C'}}, {{'n': "G+", 'b': 'G'}}, {{'n': "T+", 'b': 'T'}}]) x from pu) where x.n > 0
  qualify row_number() over (partition by chrom, pos order by x.n desc, x.b) = 1) select chrom, string_agg(base, '' order by pos) seq from l group by 1"""
)
def strand_fasta(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.strand_sequence(_piled(spark, sf), "+")


@query(
    f"""with {_PLACED}, {_PILE}, d as (select chrom, pos, {_PLUS} + {_MINUS} v from pu where {_PLUS} > 0 or {_MINUS} > 0),
n as (select *, case when pos = lag(pos) over w + 1 and v = lag(v) over w then 0 else 1 end new from d window w as (partition by chrom order by pos)),
k as (select *, sum(new) over (partition by chrom order by pos) run from n) select chrom, min(pos) as "start", max(pos) + 1 as "end", v as "value" from k group by chrom, run, v"""
)
def depth_bedgraph(spark: SparkSession, sf: str) -> DataFrame:
    depth = pileup.coverage(_piled(spark, sf)).select("chrom", (F.col("pos") + 1).alias("pos"), (F.col("plus") + F.col("minus")).alias("value"))
    return pileup.bedgraph(depth)


@query(
    f"""with {_PLACED}, {_voted("fam", "al", "barcode, chrom, s0, strand", "seq", "qual")},
u as (select barcode || '_' || members || '_member/' id, strand = '-' turned, seq, qual from fam)
select id || '1' id, case when turned then {_RC.format("seq")} else seq end seq, case when turned then reverse(qual) else qual end qual from u
union all select id || '2', case when turned then seq else {_RC.format("seq")} end, case when turned then qual else reverse(qual) end from u"""
)
def demux_exact_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Consensus pairs of alignments of one tag: a placed read and its mate."""
    one = placed_reads(spark, sf).withColumn("tags", F.create_map(F.lit("RX"), F.col("barcode")))
    plus = F.col("flag") == 0
    first, second = one.withColumn("flag", F.when(plus, 99).otherwise(83)), one.withColumn("flag", F.when(plus, 147).otherwise(163))
    return families.family_reads(families.tagged_families(first.unionByName(second), "RX", "vote"))


@query(f"with {ALL_SQL} select rec_id, i::int pos, substr(seq, i + 1, 1) base from (select *, unnest(range(0, length(seq))) i from r) where regexp_matches(rec_id::varchar, '^[1-4].*7$')")
def msa_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of aligned sequences whose ids match an expression."""
    chosen = kmers.with_ids(sequences(spark, sf).select(F.col("rec_id").alias("seq_id"), "seq"), "^[1-4].*7$")
    return kmers.alignment_columns(chosen.where(F.length("seq") > 0)).select(F.col("seq_id").alias("rec_id"), "pos", "base")


@query("""with b as (select distinct on (bc_id) bc_id, upper(umi) s from barcode_sets where length(umi) = 20)
select x.bc_id seq_a, y.bc_id seq_b, hamming(x.s, y.s)::int distance from b x, b y where x.bc_id % 50 = 0""")
def umi_pairwise_hamming(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th UMI of 20 bases with all of them."""
    rows = table(spark, sf, "barcode_sets").where(F.length("umi") == 20).groupBy(F.col("bc_id").alias("seq_id")).agg(F.upper(F.min("umi")).alias("seq"))
    return kmers.pair_distances(rows.where(F.col("seq_id") % 50 == 0), rows)


@query(f"with {ALL_SQL}, x as (select i - 1 pos, substr(seq, i, 1) base from (select seq, unnest(range(1, length(seq) + 1)) i from r)), c as (select pos, base, count(*) n from x group by 1, 2) select pos::int pos, base, round(n / sum(n) over (partition by pos), 9) as share from c qualify row_number() over (partition by pos order by n desc, base) = 1")
def msa_consensus_all(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.alignment_consensus(sequences(spark, sf).select(F.col("rec_id").alias("seq_id"), "seq")).withColumn("share", F.round("share", 9))


@query(f"with {ALL_SQL}, x as (select rec_id, unnest(list_concat([substr(seq, i, 2) for i in range(1, length(seq))], [substr(seq, i, 3) for i in range(1, length(seq) - 1)])) kmer from r where length(seq) >= 3) select kmer, count(*) n, count(distinct rec_id) n_reads from x group by 1")
def kmer_bag_all(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.kmer_bag(sequences(spark, sf, 3), "rec_id", "seq", 2, 3).groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_reads"))


@query(
    f"""with {ALL_SQL}, x as (select substr(seq, i, 3) kmer, count(*) c from (select seq, unnest(range(1, length(seq) - 1)) i from r) group by 1),
d as (select a.b || b.b || c.b as "key" from (select unnest(['A','C','G','T']) b) a, (select unnest(['A','C','G','T']) b) b, (select unnest(['A','C','G','T']) b) c)
select "key", sum(c)::bigint n from x join d on levenshtein(kmer, "key") <= 1 group by 1"""
)
def gapped_kmer_all(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.gapped_kmers(sequences(spark, sf, 3), "rec_id", "seq", 3, 1).groupBy("key").agg(F.sum("n").alias("n"))


@query(
    f"""with recursive {ALL_SQL}, x as (select substr(seq, i, 6) kmer, count(*) c from (select seq, unnest(range(1, length(seq) - 4)) i from r) group by 1),
d("key") as (select '' union all select "key" || b from d, (select unnest(['A','C','G','T']) b) e where length("key") < 6)
select "key", sum(c)::bigint n from x join d on length("key") = 6 and levenshtein(kmer, "key") <= 2 group by 1"""
)
def gapped_kmer_six(spark: SparkSession, sf: str) -> DataFrame:
    """The usual k = 6 and m = 2; k-mers of all reads are counted together before they meet the keys."""
    return kmers.gapped_kmers(sequences(spark, sf, 6).withColumn("all", F.lit(0)), "all", "seq", 6, 2).select("key", "n")


@query(f"with {ALL_SQL} select rec_id, {_RC.format('seq')} rc, translate(seq, 'ACGTN', 'TGCAN') comp from r")
def revcomp_all(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("rec_id", S.reverse_complement(F.col("seq")).alias("rc"), S.complement(F.col("seq")).alias("comp"))


@query(
    f"""with {ALL_SQL}, h as (select rec_id, seq, unnest(range(1, length(seq) + 1)) i from r)
select rec_id, string_agg(case substr(seq, i, 1) when 'A' then '10000' when 'C' then '01000' when 'G' then '00100' when 'N' then '00010' else '00001' end, '' order by i) bits, any_value(seq) decoded from h group by 1"""
)
def onehot_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequences(spark, sf, 1).withColumn("m", S.one_hot(F.col("seq")))
    bits = F.array_join(F.transform("m", lambda row: F.array_join(F.transform(row, lambda x: x.cast("int").cast("string")), "")), "")
    return rows.select("rec_id", bits.alias("bits"), S.one_hot_decode(F.col("m")).alias("decoded"))


@query(
    """with c as (select distinct upper(umi) s from barcode_sets where regexp_full_match(upper(umi), '[ACGTN]+') and contains(upper(umi), 'N'))
select s as seq, replace(s, 'N', x) as expanded, 'N' as codes from c, (select unnest(['A','C','G','T']) x) e"""
)
def iupac_expand_whole(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "barcode_sets").select(F.upper("umi").alias("seq")).where(F.col("seq").rlike("^[ACGTN]+$") & F.contains("seq", F.lit("N"))).distinct()
    return rows.select("seq", F.explode(S.iupac_expansions(F.col("seq"))).alias("expanded"), F.array_join(S.degenerate_codes(F.col("seq")), "").alias("codes"))


@query("""with l as (select distinct on (link_id) link_id, bc_id_a, bc_id_b from umi_links), b as (select distinct on (bc_id) bc_id, upper(umi) s from barcode_sets where umi is not null)
select link_id, case when length(x.s) = length(y.s) then hamming(x.s, y.s)::int end ham, levenshtein(x.s, y.s)::int lev, substr(x.s, 3, 5) part, starts_with(x.s, 'A') starts_a
from l join b x on x.bc_id = bc_id_a join b y on y.bc_id = bc_id_b""")
def distances_linked(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of the whole UMIs of compared barcodes."""
    umis = table(spark, sf, "barcode_sets").where(F.col("umi").isNotNull()).dropDuplicates(["bc_id"]).select("bc_id", F.upper("umi").alias("s"))
    side = lambda k: umis.select(F.col("bc_id").alias(f"bc_id_{k}"), F.col("s").alias(k))
    rows = table(spark, sf, "umi_links").dropDuplicates(["link_id"]).join(side("a"), "bc_id_a").join(side("b"), "bc_id_b")
    a, b = F.col("a"), F.col("b")
    return rows.select("link_id", F.when(F.length(a) == F.length(b), S.hamming(a, b)).alias("ham"), S.levenshtein(a, b).alias("lev"), S.subseq(a, 2, 7).alias("part"), F.startswith(a, F.lit("A")).alias("starts_a"))


@query(f"with {R_SQL} select rec_id, list_sum([case when substr(seq, i, 1) = substr(barcode, i, 1) then 1 else 0 end for i in range(1, least(length(seq), length(barcode)) + 1)])::int matches from r where length(barcode) > 0")
def prefix_matches(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).where(F.length("barcode") > 0).select("rec_id", S.prefix_matches(F.col("seq"), F.col("barcode")).alias("matches"))


@query(None)
def locate_adapter(spark: SparkSession, sf: str) -> DataFrame:
    hit = locate(F.col("seq"), F.concat(S.reverse_complement(F.col("barcode")), F.lit(trim.ADAPTERS["read1"])), 0.15)
    return reads(spark, sf).select("rec_id", hit.alias("hit")).where(F.col("hit").isNotNull()).select("rec_id", "hit.*")


@query(None)
def trim_umi_reads(spark: SparkSession, sf: str) -> DataFrame:
    return trim.clip_pairs(_read_pairs(spark, sf), umi_bases=6, least_qual=20)


_LEFT, _RIGHT = (trim.ADAPTERS[k] for k in ("read1", "read2"))
_CLEAN = "regexp_full_match(barcode, '[ACGT]{6,}') and regexp_full_match(seq, '[ACGT]+') and length(seq) >= 24"


def _clean_reads(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).where(F.col("barcode").rlike("^[ACGT]{6,}$") & F.col("seq").rlike("^[ACGT]+$") & (F.length("seq") >= 24)).withColumn("umi", F.substring("barcode", 1, 6))


@query(f"with {R_SQL} select rec_id::varchar as name, substr(barcode, 1, 6) umi, seq seq1, qual qual1, {_RC.format('seq')} seq2, reverse(qual) qual2 from r where {_CLEAN}")
def trim_read_through(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that read through their insert into UMI and adapters, some with a miscalled base in the adapter or with read 1 going on too."""
    n, kind = F.length("seq"), F.pmod("rec_id", F.lit(3))
    adapter = F.when(kind == 0, _LEFT[:14]).when(kind == 1, _LEFT).otherwise(_LEFT[:9] + "N" + _LEFT[10:24])
    beyond1, beyond2 = F.when(kind == 2, _RIGHT[:20]).otherwise(""), F.concat(S.reverse_complement(F.col("umi")), adapter)
    good = lambda text: F.repeat(F.lit("I"), F.length(text))
    rows = _clean_reads(spark, sf).withColumns({"beyond1": beyond1, "beyond2": beyond2, "back": S.reverse_complement(F.col("seq"))})
    name = F.col("rec_id").cast("string")
    rows = rows.select(name.alias("id1"), F.concat("umi", "seq", "beyond1").alias("seq1"), F.concat(F.lit("IIIIII"), "qual", good(F.col("beyond1"))).alias("qual1"), name.alias("id2"), F.concat("back", "beyond2").alias("seq2"), F.concat(F.reverse("qual"), good(F.col("beyond2"))).alias("qual2"))
    return trim.clip_pairs(rows, umi_bases=6, least_qual=20)


_OVER = f"""{R_SQL}, w as (select rec_id, seq, qual, length(seq) n, (length(seq) * 7) // 10 a, rec_id % 3 = 0 flawed from r where regexp_full_match(seq, '[ACGT]+') and length(seq) >= 44),
o as (select *, substr(seq, n - a + 1, 2 * a - n) mid, substr(qual, n - a + 1, 2 * a - n) mq from w),
c as (select *, [case when flawed and i = 6 then 0 else least(0.99999999999, 1 - pow(10.0, -2 * (ascii(substr(mq, i, 1)) - 33) / 10.0)) end for i in range(1, length(mid) + 1)] p from o)"""


@query(
    f"""with {_OVER} select rec_id::varchar as name, case when flawed then substr(mid, 1, 5) || 'N' || substr(mid, 7) else mid end seq,
array_to_string([chr(cast(floor(least(greatest(-10 * log10(1 - x) + 33, 33), 73) + 1e-9) as int)) for x in p], '') qual from c"""
)
def merge_partial_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of which each has seven tenths of a fragment; in every third the mates differ in one base of the overlap."""
    n = F.length("seq")
    rows = reads(spark, sf).where(F.col("seq").rlike("^[ACGT]+$") & (n >= 44)).withColumn("a", F.expr("(length(seq) * 7) div 10").cast("int"))
    back = F.substring("seq", n - F.col("a") + 1, F.col("a"))
    other = F.translate(F.substring(back, 6, 1), "ACGT", "CGTA")
    back = F.when(F.col("rec_id") % 3 == 0, F.concat(F.substring(back, 1, 5), other, F.substring(back, F.lit(7), F.col("a")))).otherwise(back)
    name = F.col("rec_id").cast("string")
    rows = rows.select(name.alias("id1"), F.substring("seq", F.lit(1), F.col("a")).alias("seq1"), F.substring("qual", F.lit(1), F.col("a")).alias("qual1"), name.alias("id2"), S.reverse_complement(back).alias("seq2"), F.reverse(F.substring("qual", n - F.col("a") + 1, F.col("a"))).alias("qual2"))
    return trim.merge_pairs(rows, mode="vote")


@query(f"with {R_SQL} select rec_id, 0 ref_start, 9 ref_end, 0 query_start, 9 query_end, 9 matches, 0 errors from r where regexp_full_match(seq, '[ACGT]+')")
def locate_anchored(spark: SparkSession, sf: str) -> DataFrame:
    """A read's first nine bases in the read, with neither start free: an alignment of prefixes."""
    rows = reads(spark, sf).where(F.col("seq").rlike("^[ACGT]+$"))
    hit = locate(F.substring("seq", 1, 9), F.col("seq"), 0.1, free=("query_end",))
    return rows.select("rec_id", hit.alias("hit")).select("rec_id", "hit.*")


@query(f"with {R_SQL} select rec_id, seq mid from r where regexp_full_match(seq, '[ACGT]+')")
def locate_whole_reference(spark: SparkSession, sf: str) -> DataFrame:
    """A read between two adapters, found with its own ends fixed and those of the longer text free."""
    rows = reads(spark, sf).where(F.col("seq").rlike("^[ACGT]+$")).withColumn("long", F.concat(F.lit(_LEFT), "seq", F.lit(_RIGHT)))
    hit = locate(F.col("seq"), F.col("long"), 0.05, free=("query_start", "query_end"))
    rows = rows.select("rec_id", "long", hit.alias("hit")).where((F.col("hit.errors") == 0) & (F.col("hit.ref_start") == 0))
    return rows.select("rec_id", F.substring("long", F.col("hit.query_start") + 1, F.col("hit.query_end") - F.col("hit.query_start")).alias("mid"))


@query(
    f"""with {ALL_SQL}, x as (select substr(seq, i, 7) kmer, count(*) c from (select seq, unnest(range(1, length(seq) - 5)) i from r) group by 1),
e as (select kmer, c, unnest([kmer] || flatten([[substr(kmer, 1, i - 1) || b || substr(kmer, i + 1) for b in ['A','C','G','T']] for i in range(1, 8)])) k1 from x),
d as (select distinct kmer, c, k1 from e where regexp_full_match(k1, '[ACGT]+'))
select k1 as "key", sum(c)::bigint n from d group by 1"""
)
def gapped_kmer_seven(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of seven bases within one edit, generated: between texts of one length, one edit is one base."""
    return kmers.generated_gapped_kmers(sequences(spark, sf, 7).withColumn("all", F.lit(0)), "all", "seq", 7, 1).select("key", "n")


@query(None)
def merge_read_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return trim.merge_pairs(_read_pairs(spark, sf))


# ---------------------------------------------------------------- genes


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts whose exon lists are whole and fit each other, exons in genomic order."""
    rows = table(spark, sf, "bed12_records").select("rec_id", "chrom", "tid", "strand", "tx_start", "tx_end", "cds", "cde", "exon_count", "exon_starts", "exon_ends").dropDuplicates(["rec_id"])
    each = list_values(rows, ["rec_id"], "exon_starts", "chrom").unionByName(list_values(rows, ["rec_id"], "exon_ends", "chrom"))
    # One record's places only, at most as many as its field can hold.
    side = lambda f: F.array_sort(F.collect_list(F.when(F.col("attr_key") == f, F.struct("idx", F.col("attr_val").try_cast("long").alias("v")))))
    lists = each.groupBy("rec_id").agg(side("exon_starts").alias("a"), side("exon_ends").alias("b"))
    whole = F.size(F.filter("a", lambda x: x["idx"] > F.size("a"))) + F.size(F.filter("b", lambda x: x["idx"] > F.size("b")))
    good = lists.where((F.size("a") == F.size("b")) & (whole == 0)).select("rec_id", F.transform("a", lambda x: x["v"]).alias("exon_starts"), F.transform("b", lambda x: x["v"]).alias("exon_ends"))
    return rows.drop("exon_starts", "exon_ends").join(good, "rec_id").where((F.size("exon_starts") == F.col("exon_count")) & F.col("strand").isin("+", "-") & F.col("cds").isNotNull() & F.col("cde").isNotNull()).withColumn("tid", F.concat_ws("#", "tid", F.col("rec_id").cast("string")))


_TX = f"""d as (select distinct on (rec_id) rec_id, chrom, concat_ws('#', tid, rec_id::varchar) tid, strand, tx_start, tx_end, cds, cde, exon_count, {places("exon_starts")} a, {places("exon_ends")} b from bed12_records),
tx as (select * from d where len(a) = len(b) and len(a) = exon_count and not list_contains(a, '') and not list_contains(b, '') and strand in ('+','-') and cds is not null and cde is not null),
ex0 as (select tx.*, i, a[i]::bigint s, b[i]::bigint e, case when strand = '-' then exon_count - i + 1 else i end num, case when strand = '-' then cde else cds end cds2, case when strand = '-' then cds else cde end cde2 from (select *, unnest(range(1, exon_count + 1)) i from tx) tx),
ex as (select *, e - s len, sum(e - s) over (partition by tid order by num) te, cds2 between s and e has_s, cde2 between s and e has_e from ex0)"""


@query(
    f"""with {_TX}, z as (select *, sum(has_s::int) over (partition by tid order by num) after_s, sum(has_e::int) over (partition by tid order by num) after_e from ex)
select chrom, tid, strand, num::int exon_num, s as "start", e as "end", (te - len)::bigint tx_start, te::bigint tx_end, len length, has_s contain_cds, has_e contain_cde, after_s::int after_cds, after_e::int after_cde,
case when after_s > 0 then len - case when has_s then (case when strand = '+' then cds2 - s else e - cds2 end) else 0 end - case when has_e then (case when strand = '+' then e - cde2 else cde2 - s end) else 0 end else 0 end coding_bases from z"""
)
def exon_table(spark: SparkSession, sf: str) -> DataFrame:
    return genes.exon_table(transcripts(spark, sf))


@query(f"""with {_TX}, z as (select *, sum(has_s::int) over (partition by tid order by num) a1, sum(has_e::int) over (partition by tid order by num) a2 from ex where cds <> cde)
select tid, num::int exon_num, has_s or has_e or (a1 > 0 and a2 = 0) is_coding, has_s and has_e whole_coding from z""")
def coding_exons(spark: SparkSession, sf: str) -> DataFrame:
    """What the exons of coding transcripts hold of the coding sequence."""
    found = genes.coding_exons(genes.exon_table(genes.coding_only(transcripts(spark, sf))))
    return found.select("tid", "exon_num", "is_coding", "whole_coding")


@query(f'with {_TX} select tid, num::int exon_num, s as "start", e as "end" from ex where has_s qualify row_number() over (partition by tid order by num) = 1')
def first_coding_exon(spark: SparkSession, sf: str) -> DataFrame:
    return genes.first_coding_exon(transcripts(spark, sf))


@query(f"""with {_TX} select chrom, b[i]::bigint + 1 as "start", a[i + 1]::bigint as "end", tid, (case when strand = '-' then exon_count - i else i end)::int intron_num, strand from (select *, unnest(range(1, exon_count)) i from tx)""")
def introns(spark: SparkSession, sf: str) -> DataFrame:
    return genes.introns(transcripts(spark, sf))


_PLACES = [0.0, 0.25, 0.5, 1.0]


@query(
    f"""with {_TX}, l as (select tid, max(te) total from ex group by 1), p as (select tid, unnest([0, (total * 0.25)::decimal(38,0)::bigint, 0, 0]) x, total from l), q as (select tid, unnest([0, total // 4, total // 2, total])::bigint place from l)
select q.tid, place, s - (place - (te - len))::bigint compat, (case when strand = '-' then e - (place - (te - len)) else s + (place - (te - len)) end)::bigint exact from q join ex on ex.tid = q.tid and place between te - len and te qualify row_number() over (partition by q.tid, place order by num) = 1"""
)
def genomic_position(spark: SparkSession, sf: str) -> DataFrame:
    rows = genes.exons_of(transcripts(spark, sf)).withColumn("total", genes.transcript_length(F.col("exons")))
    places = F.array(F.lit(0).cast("long"), F.expr("total div 4"), F.expr("total div 2"), F.col("total"))
    rows = rows.select("tid", "strand", "exons", F.explode(F.array_distinct(places)).alias("place"))
    at = lambda right: genes.genomic_position(F.col("exons"), F.col("strand"), F.col("place"), right)
    return rows.select("tid", "place", at(False).alias("compat"), at(True).alias("exact"))


@query(
    f"""with {_TX}, l as (select tid, max(te) total from ex group by 1), q as (select tid, total // 5 lo, total - total // 5 hi from l where total >= 5)
select ex.tid, num::int exon_num, (case when strand = '-' then e - (least(hi, te) - (te - len)) else s + (greatest(lo, te - len) - (te - len)) end)::bigint as "start",
(case when strand = '-' then e - (greatest(lo, te - len) - (te - len)) else s + (least(hi, te) - (te - len)) end)::bigint as "end" from ex join q on q.tid = ex.tid where greatest(lo, te - len) < least(hi, te)"""
)
def tx_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = genes.exons_of(transcripts(spark, sf)).withColumn("total", genes.transcript_length(F.col("exons"))).where(F.col("total") >= 5)
    lo, hi = F.expr("total div 5"), F.expr("total - total div 5")
    first = F.filter("exons", lambda e: F.greatest(lo, e["tx_start"]) < F.least(hi, e["tx_end"]))
    found = rows.select("tid", F.get(first, F.lit(0))["exon_num"].alias("n0"), F.posexplode(genes.blocks(F.col("exons"), F.col("strand"), lo, hi)).alias("k", "b"))
    return found.select("tid", (F.col("n0") + F.col("k")).alias("exon_num"), "b.start", "b.end")


@query(
    f"""with {_TX} select chrom, tid, split_part(tid, '.', 1) gene, strand, tx_start, tx_end, case when cds <> cde then cds end cds, case when cds <> cde then cde end cde, exon_count,
array_to_string(list_sort([x::bigint for x in a]), ',') starts from tx"""
)
def ensdb_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    rows = transcripts(spark, sf)
    coded = F.col("cds") != F.col("cde")
    tx = rows.select(F.col("tid").alias("tx_id"), F.when(coded, "protein_coding").otherwise("other").alias("tx_biotype"), F.col("tx_start").alias("tx_seq_start"), F.col("tx_end").alias("tx_seq_end"), F.when(coded, F.col("cds")).alias("tx_cds_seq_start"), F.when(coded, F.col("cde")).alias("tx_cds_seq_end"), F.col("tid").alias("gene_id"))
    gene = rows.select(F.col("tid").alias("gene_id"), F.split("tid", r"\.")[0].alias("gene_name"), F.coalesce("chrom", F.lit("")).alias("seq_name"), F.when(F.col("strand") == "+", 1).otherwise(-1).alias("seq_strand"))
    each = rows.select("tid", F.posexplode(F.arrays_zip("exon_starts", "exon_ends")).alias("i", "x"))
    ident = F.concat_ws(":", "tid", F.col("i").cast("string"))
    tx2exon, exon = each.select(F.col("tid").alias("tx_id"), ident.alias("exon_id"), "i"), each.select(ident.alias("exon_id"), F.col("x.exon_starts").alias("exon_seq_start"), F.col("x.exon_ends").alias("exon_seq_end"))
    out = genes.database_transcripts(tx, tx2exon.withColumnRenamed("i", "exon_idx"), exon, gene)
    return out.select(F.nullif("chrom", F.lit("")).alias("chrom"), "tid", "gene", "strand", "tx_start", "tx_end", "cds", "cde", "exon_count", F.array_join(F.transform("exon_starts", lambda x: x.cast("string")), ",").alias("starts"))


# ---------------------------------------------------------------- statistics


def _p_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 97 != 0, F.pmod(F.abs("value"), F.lit(1.0))).alias("p"))


@query(
    """with p as (select event_id, case when event_id % 97 <> 0 then abs("value") % 1.0 end p from events), q as (select *, coalesce(p, 1) v, count(*) over () n, rank() over (order by coalesce(p, 1)) + count(*) over (partition by coalesce(p, 1)) - 1 rk from p)
select event_id, p, round(least(1, min(v * n / rk) over (order by v desc range between unbounded preceding and current row)), 9) p_adj from q"""
)
def bh_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return stats.adjusted_p(_p_values(spark, sf), "p").select("event_id", "p", F.round("p_adj", 9).alias("p_adj"))


@query(
    """with k as (select event_id, event_id % 12 k, 10 + event_id % 30 n, 0.05 + (event_id % 17) / 20.0 p from events),
t as (select *, unnest(range(0, k + 1)) i from k)
select event_id, round(least(1, sum(case when i > n then 0 else exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) end)), 6) cdf from t group by event_id"""
)
def binom_cdf(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.round(P.binom_cdf(i % 12, 10 + i % 30, 0.05 + (i % 17) / 20.0), 6).alias("cdf"))


def _gene_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of each library on each gene's place."""
    rows = frags(spark, sf).where(F.col("lib_id").isNotNull()).select("lib_id", "chrom", "start", "end")
    found = intervals.overlaps(rows, _genes(spark, sf), ["chrom"])
    gene = F.format_string("%s:%d-%d", F.col("l.chrom"), F.col("r.start"), F.col("r.end"))
    return found.groupBy(gene.alias("gene"), F.col("l.lib_id").alias("sample")).agg(F.count(F.lit(1)).alias("n"))


_GENE_MATRIX = f"""with {F_SQL}, {_GENES}, m as (select f.chrom || ':' || gs || '-' || ge gene, lib_id sample, count(*) n from f join g on g.chrom = f.chrom and gs < f."end" and ge > f."start" where lib_id is not null group by 1, 2),
h as (select gene, avg(ln(n)) mu from m group by 1 having count(*) = (select count(distinct sample) from m)),
z as (select sample, exp(quantile_cont(ln(n) - mu, 0.5)) sf from m join h using (gene) group by 1)"""


@query(_GENE_MATRIX + " select sample, round(sf, 6) size_factor from z")
def size_factors_genes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.size_factors(_gene_matrix(spark, sf), "gene", "sample", "n").withColumn("size_factor", F.round("size_factor", 6))


@query(_GENE_MATRIX + " select gene, sample, n, round(n / sf, 6) normalized from m join z using (sample)")
def normalized_counts_genes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.normalized_counts(_gene_matrix(spark, sf), "gene", "sample", "n").withColumn("normalized", F.round("normalized", 6))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r from lineitem" for a in _NUMBERS for b in _NUMBERS))
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.correlations(table(spark, sf, "lineitem"), _NUMBERS).withColumn("r", F.round("r", 6))


_RANKED = "(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 {c}" for c in _NUMBERS) + " from lineitem)"


@query(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r from {_RANKED}" for a in _NUMBERS for b in _NUMBERS))
def spearman_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.correlations(table(spark, sf, "lineitem"), _NUMBERS, "spearman").withColumn("r", F.round("r", 6))


@query(
    """with s as (select sum(l_quantity * l_quantity) aa, sum(l_quantity * l_discount) ab, sum(l_discount * l_discount) bb, sum(l_quantity * l_extendedprice) ay, sum(l_discount * l_extendedprice) bq from lineitem)
select 'l_quantity' feature, round((bb * ay - ab * bq) / (aa * bb - ab * ab), 4) beta from s union all select 'l_discount', round((aa * bq - ab * ay) / (aa * bb - ab * ab), 4) from s"""
)
def least_squares(spark: SparkSession, sf: str) -> DataFrame:
    return stats.least_squares(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice").withColumn("beta", F.round("beta", 4))


@query(
    """with e as (select "value" v, row_number() over (order by event_id) - 1 place from events where "value" is not null),
d as (select i // 500 as "round", i % 500 nth from (select unnest(range(0, 10000)) i)),
p as (select "round", ('0x' || substr(md5(concat_ws(':', '0', "round", nth)), 1, 15))::bigint % (select count(*) from e) place from d)
select "round", round(avg(v), 6) as mean from p join e using (place) group by 1"""
)
def bootstrap_means(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bootstrap_means(table(spark, sf, "events"), "value", ["event_id"], 500, 20).withColumn("mean", F.round("mean", 6))


@query("with c as (select group_id, upper(umi) u, count(*) n from (select distinct bc_id, group_id, umi from barcode_sets) where umi is not null and group_id is not null group by 1, 2) select group_id, u as mode from c qualify row_number() over (partition by group_id order by n desc, u desc) = 1")
def group_modes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "barcode_sets").select("bc_id", "group_id", F.upper("umi").alias("u")).dropDuplicates(["bc_id"])
    return stats.modes(rows.where(F.col("u").isNotNull() & F.col("group_id").isNotNull()), ["group_id"], "u")


@query("with r as (select item_name, regexp_extract(item_name, '^([^0-9]*)', 1) h, coalesce(nullif(regexp_extract(item_name, '([0-9]+)', 1), ''), '0')::int n from items) select item_name, row_number() over (order by h, n, item_name) natural_rank from r")
def natural_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    return umi.number_rows(table(spark, sf, "items").select("item_name", S.natural_key(F.col("item_name")).alias("k")), ["k", "item_name"], "place").select("item_name", (F.col("place") + 1).alias("natural_rank"))


_COLORS = stats.PALETTES["okabeito"]


@query(f"with f as (select category, min(item_id) o from items where category is not null group by 1), k as (select category, row_number() over (order by o, category) k from f) select category, list_extract({list(_COLORS)!r}, k::int) color from k")
def color_encode(spark: SparkSession, sf: str) -> DataFrame:
    return stats.color_codes(table(spark, sf, "items"), "category", "item_id", _COLORS)


@query("with u as (select l_orderkey, max((l_returnflag = 'A')::int) f_a, max((l_returnflag = 'N')::int) f_n, max((l_returnflag = 'R')::int) f_r from lineitem group by 1) select f_a \"A\", f_n \"N\", f_r \"R\", count(*) n_orders from u group by all")
def upset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.membership_counts(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"], "n_orders")


@query(
    """with s as (select o_orderstatus samplename, sum((o_orderpriority like '1%')::int) / count(*) a, sum((o_orderpriority like '2%')::int) / count(*) b from orders group by 1)
select samplename, 'Utr bases' as "variable", round(a, 9) var_count from s union all select samplename, 'Coding bases', round(b, 9) from s"""
)
def picard_melt(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda p: F.avg(F.col("o_orderpriority").startswith(p).cast("double"))
    wide = table(spark, sf, "orders").groupBy("o_orderstatus").agg(share("1").alias("PCT_UTR_BASES"), share("2").alias("PCT_CODING_BASES"), share("3").alias("PCT_OTHER"), share("4").alias("UTR_TOTAL"))
    return melted_metrics(wide, "o_orderstatus", "UTR|CODI").withColumn("var_count", F.round("var_count", 9))


@query("select line_id, c[1] target_name, c[3] query_name, array_to_string(list_slice(c, 18, 100000), ' ') description from (select distinct line_id, string_split_regex(trim(replace(replace(raw_line, '\t', ' '), '\r', ' ')), '\\s+') c from annot_lines where length(trim(replace(replace(raw_line, '\t', ' '), '\r', ' '))) > 0 and not starts_with(raw_line, '#'))")
def tbl_split(spark: SparkSession, sf: str) -> DataFrame:
    """Lines split as a table of 18 columns, the last of which keeps its blanks."""
    rows = table(spark, sf, "annot_lines").dropDuplicates(["line_id"]).where(~F.col("raw_line").rlike(r"^(#|\s*$)"))
    tidy = F.trim(F.regexp_replace("raw_line", r"\s+", " "))
    return rows.select("line_id", *infernal_columns(tidy)).select("line_id", "target_name", "query_name", F.coalesce("description", F.lit("")).alias("description"))


@query(f"with {_MATES}, u as (select frag_id::varchar qname, f1 flag, mapq from a union all select frag_id::varchar, f2, mapq from a) select qname, flag, case when mapq >= 42 then 'unique' else 'multi' end bucket from u where mapq is not null")
def split_unique_single(spark: SparkSession, sf: str) -> DataFrame:
    """Single reads apart by the number of their hits."""
    return pairs.route_unique_single(alignments(spark, sf).where(F.col("mapq").isNotNull()), "hisat2").select("qname", "flag", "bucket")


@query(f"with {_MATES}, u as (select frag_id::varchar qname, f1 flag from a union all select frag_id::varchar, f2 from a) select qname, flag from u where flag in (99, 147, 83, 163)")
def concordant_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads whose flag is one of a concordant pair's."""
    return alignments(spark, sf).where(G.concordant(F.col("flag"))).select("qname", "flag")


@query(
    f"""with {_PLACED}, {_PILE}, {_GENES}, q as (select chrom || ':' || gs || '-' || ge region, p.* exclude (chrom) from pu p join g using (chrom) where pos >= gs and pos < ge),
l as (select region, pos, s, x.b, x.n from (select region, pos, unnest(['+', '-']) s, unnest([[{", ".join("{'n': " + chr(34) + b + "+" + chr(34) + ", 'b': '" + b + "'}" for b in pileup.BASES)}], [{", ".join("{'n': " + chr(34) + b + "-" + chr(34) + ", 'b': '" + b + "'}" for b in pileup.BASES)}]]) xs from q) t, unnest(xs) u(x) where x.n > 0),
c as (select region, pos, s, b from l qualify row_number() over (partition by region, pos, s order by n desc, b) = 1)
select region || '(' || s || ')' seq_id, case when s = '+' then string_agg(b, '' order by pos) else reverse(string_agg(b, '' order by pos)) end seq from c group by region, s"""
)
def strand_fasta_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The consensus of both strands over every gene."""
    from strandloom.plans.pipelines import strand_fasta as by_regions

    return by_regions(_piled(spark, sf), _genes(spark, sf))


@query(f"with {_TX} select tid, strand, exon_count from tx where split_part(tid, '#', 1) = (select max(split_part(tid, '#', 1)) from tx)")
def gene_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The transcripts of one gene, the last by name."""
    rows = transcripts(spark, sf).withColumn("gene", F.split("tid", "#")[0])
    return genes.transcripts_of(rows, rows.agg(F.max("gene")).first()[0]).select("tid", "strand", "exon_count")


@query("select distinct lang from documents where lang is not null and lang not in (select lang from documents where lang is not null group by 1 order by count(*) desc, lang limit 2)")
def categories_without_code(spark: SparkSession, sf: str) -> DataFrame:
    """Languages beyond the two commonest, which alone have a colour."""
    rows = table(spark, sf, "documents").where(F.col("lang").isNotNull())
    top = rows.groupBy("lang").agg((-F.count(F.lit(1))).alias("n")).orderBy("n", "lang").limit(2)
    return stats.unseen_categories(rows, stats.color_codes(top, "lang", "n", stats.PALETTES["okabeito"]), "lang")


@query("select event_id, greatest(least(\"value\", 50.0), 10.0) bounded, '<' || event_id || '>' marked from events where \"value\" is not null")
def bounded_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values within bounds, and ids between marks."""
    rows = table(spark, sf, "events").where(F.col("value").isNotNull())
    return rows.select("event_id", P.bounded(F.col("value"), 10.0, 50.0).alias("bounded"), S.highlight(F.col("event_id").cast("string"), "<", ">").alias("marked"))


@query(
    """with recursive x as (select (l_quantity / 50.0)::double a, l_discount::double b, (l_extendedprice / 100000.0)::double y from lineitem),
s as (select count(*)::double n, sum(a * a) aa, sum(a * b) ab, sum(b * b) bb, sum(a * y) ay, sum(b * y) "by", sum(y * y) yy from x),
r(k, p, q) as (select 0, 0.0::double, 0.0::double union all select k + 1, p - 0.5 * (aa * p + ab * q - ay) / n, q - 0.5 * (ab * p + bb * q - "by") / n from r, s where k < 30)
select k as "round", round(sqrt((aa * p * p + 2 * ab * p * q + bb * q * q - 2 * ay * p - 2 * "by" * q + yy) / n), 6) as cost, round(p, 6) beta_a, round(q, 6) beta_b from r, s where k > 0"""
)
def regression_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A regression step by step, with its error."""
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("a"), F.col("l_discount").alias("b"), (F.col("l_extendedprice") / 100_000).alias("y"))
    out = stats.gradient_descent(rows, ["a", "b"], "y", rate=0.5, rounds=30)
    return out.select("round", F.round("cost", 6).alias("cost"), *[F.round(F.col("betas")[i], 6).alias(f"beta_{c}") for i, c in enumerate("ab")])
