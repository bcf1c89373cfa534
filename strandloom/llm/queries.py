"""Driver queries of this subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.groups import group_matches
from strandloom.llm.packing import pack
from strandloom.llm.reading import reading_bands
from strandloom.llm.survivors import FieldRule, best_fields, built_records, infer_truth, missing, phred_sum
from strandloom.llm.tokens import count_tokens, encode_corpus
from strandloom.llm.topn import top_per_group
from strandloom.queries.core_problems import clean_barcode, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "umi_links").where(F.col("dist") <= 1)
    links = links.where(F.col("bc_id_a") != F.col("bc_id_b"))
    return group_matches(links, "bc_id_a", "bc_id_b").select(F.col("id").alias("bc_id"), F.col("root").alias("group_root"))


def p1_molecules(spark: SparkSession, sf: str) -> DataFrame:
    """Molecules of the known barcodes: their size, members and the UMI with most members, smallest id first among equals."""
    codes = table(spark, sf, "barcode_sets").select("bc_id", "n_members", F.upper("umi").alias("umi")).dropDuplicates(["bc_id"])
    found = p1_found(spark, sf)
    rows = codes.join(found, "bc_id", "left").withColumn("molecule", F.coalesce("group_root", "bc_id"))
    best = F.max(F.struct(F.coalesce("n_members", F.lit(0)).alias("n"), F.bitwise_not("bc_id").alias("tie"), "umi"))
    return rows.groupBy("molecule").agg(F.count(F.lit(1)).alias("n_barcodes"), F.sum(F.coalesce("n_members", F.lit(0))).alias("n_members"), best.alias("best")).select("molecule", "n_barcodes", "n_members", F.col("best.umi").alias("umi"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    read = F.regexp_extract("read_name", r"(?s)\A([^/\s]*)", 1)
    rows = table(spark, sf, "fragments").select("frag_id", read.alias("read"), "fragment_size").where(F.col("read").isNotNull())
    return top_per_group(rows, "read", "fragment_size", "frag_id", 3).select("frag_id", "pick_no")


def _family_rules() -> dict[str, FieldRule]:
    whole = F.col("seq").isNotNull() & F.col("qual").isNotNull() & (F.length("seq") == F.length("qual"))
    called = F.length("seq") - F.length(F.regexp_replace(F.upper("seq"), "[^N]", ""))
    return {
        "seq": FieldRule(whole, [called, phred_sum(F.col("qual"))], ["seq", "qual"]),
        "description": FieldRule(~missing(F.col("description")), [F.col("run_at")], ["description"]),
        "instrument": FieldRule(~missing(F.col("instrument")), [F.col("run_at")], ["instrument"]),
    }


def _families(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fastq_reads").withColumn("barcode", clean_barcode(F.col("barcode")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return best_fields(_families(spark, sf), ["group_id", "barcode"], "rec_id", _family_rules())


def p6_built(spark: SparkSession, sf: str) -> DataFrame:
    """One record built for every family, of one read or more."""
    return built_records(_families(spark, sf), ["group_id", "barcode"], "rec_id", _family_rules())


def p6_true_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The sequences of each family that the instruments' inferred quality makes true."""
    rows = _families(spark, sf).withColumn("instrument", F.when(~missing(F.col("instrument")), F.upper(F.trim("instrument"))))
    out = infer_truth(rows.withColumn("seq", F.upper("seq")), ["group_id", "barcode"], "instrument", "seq")
    return out.drop("em_change").withColumn("p_true", F.round("p_true", 6))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"))


def p9_bins(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # The text stays where it is: a hash of it says which documents are copies.
    marks = docs.select("doc_id", F.when(_plain() != "", F.xxhash64(_plain())).alias("copy"), F.coalesce("source", F.lit("")).alias("source"))
    return pack(count_tokens(docs).join(marks, "doc_id"), "doc_id", "n_tokens", F.col("copy"), F.col("source"))


def _plain() -> Column:
    """A text but for case and white space, the same for copies of it."""
    return F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading_bands(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of each band by source."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return p10_found(spark, sf).join(docs, "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("n_texts"))


_TIDY = r"upper(regexp_replace(barcode, '^\s+|\s+$', '', 'g'))"
_MISSING = "({0} is null or lower(trim({0}, ' \t\r\n')) in ('', 'na', 'n/a', 'none', 'unknown', '-', '\N{EN DASH}', '\N{EM DASH}'))"
_FAMILIES = f"""
with r as (select distinct on (rec_id) *, {_TIDY} bc from fastq_reads),
f as (select * exclude (barcode), bc barcode from r where group_id is not null and bc is not null and not contains(bc, 'N')),
g as (select group_id, barcode from f group by all having count(*) > 1),
m as (select f.* from f join g using (group_id, barcode)),
q as (select *, length(seq) - length(regexp_replace(upper(seq), '[^N]', '', 'g')) called,
      list_sum([ascii(c) - 33 for c in string_split(qual, '')]) phred from m where seq is not null and qual is not null and length(seq) = length(qual))"""

_LINKED = """
with recursive e as (select bc_id_a a, bc_id_b b from umi_links where dist <= 1 and bc_id_a <> bc_id_b
  union select bc_id_b, bc_id_a from umi_links where dist <= 1 and bc_id_a <> bc_id_b),
reach(id, root) as (select a, a from e union select e.b, r.root from reach r join e on e.a = r.id where r.root < e.b),
g as (select id bc_id, min(root) group_root from reach group by 1)"""
_BUILT = f"""
with r as (select distinct on (rec_id) *, {_TIDY} bc from fastq_reads),
f as (select * exclude (barcode), bc barcode from r where group_id is not null and bc is not null and not contains(bc, 'N')),
q as (select *, length(seq) - length(regexp_replace(upper(seq), '[^N]', '', 'g')) called,
  coalesce(list_sum([ascii(c) - 33 for c in string_split(qual, '')]), 0) phred from f where seq is not null and qual is not null and length(seq) = length(qual)),
s as (select group_id, barcode, seq, qual from q qualify row_number() over (partition by group_id, barcode order by called desc, phred desc, rec_id) = 1),
d as (select group_id, barcode, description from f where not {_MISSING.format("description")} qualify row_number() over (partition by group_id, barcode order by run_at desc nulls last, rec_id) = 1),
i as (select group_id, barcode, instrument from f where not {_MISSING.format("instrument")} qualify row_number() over (partition by group_id, barcode order by run_at desc nulls last, rec_id) = 1),
k as (select group_id, barcode, min(rec_id) first_rec_id from f group by 1, 2)
select group_id, barcode, first_rec_id, seq, qual, description, instrument from k left join s using (group_id, barcode) left join d using (group_id, barcode) left join i using (group_id, barcode)"""



def _em_sql(rounds: int, tolerance: float) -> str:
    """The EM rounds of p6_true_reads one after the other; once one has changed nothing by more than ``tolerance``, the rest keep what it found."""
    steps = [
        f"""
with r as (select distinct on (rec_id) *, {_TIDY} bc from fastq_reads),
claims as materialized (select distinct group_id, bc barcode, upper(trim(instrument)) src, upper(seq) val from r where group_id is not null and bc is not null and not contains(bc, 'N')
  and not {_MISSING.format("instrument")} and seq is not null),
covers as materialized (select distinct group_id, barcode, src from claims),
p0 as materialized (select group_id, barcode, val, n, least(0.95, (n + 0.5) / (m + 1))::double p, false done, 0 k from (select group_id, barcode, val, count(*) n from claims group by all)
  join (select group_id, barcode, count(*) m from covers group by all) using (group_id, barcode))"""
    ]
    for k in range(rounds):
        steps.append(f"""
m{k} as (select group_id, barcode, sum(p) t, sum(1 - p) f from p{k} group by all),
a{k} as (select src, sum(p) ta, sum(1 - p) fa from claims join p{k} using (group_id, barcode, val) group by 1),
c{k} as (select src, sum(t) t, sum(f) f from covers join m{k} using (group_id, barcode) group by 1),
q{k} as materialized (select src, (ta + 2) / (t + 4) sens, (f - fa + 4) / (f + 5) spec from c{k} join a{k} using (src)),
w{k} as materialized (select src, ln((1 - sens) / spec) silent, ln(sens / (1 - spec)) - ln((1 - sens) / spec) spoke from q{k}),
b{k} as (select group_id, barcode, sum(silent) base from covers join w{k} using (src) group by all),
s{k} as (select group_id, barcode, val, sum(spoke) w from claims join w{k} using (src) group by all),
o{k} as (select group_id, barcode, val, exp(greatest(-40, least(40, base + w))) o from s{k} join b{k} using (group_id, barcode)),
n{k} as materialized (select p.group_id, p.barcode, p.val, n, p old, done, k, o / (1 + o) fresh from p{k} p join o{k} o on p.group_id = o.group_id and p.barcode = o.barcode and p.val = o.val),
p{k + 1} as materialized (select group_id, barcode, val, n, case when done then old else fresh end p, done or (select max(abs(fresh - old)) from n{k}) <= {tolerance} done, case when done then k else k + 1 end k from n{k})""")
    return ",".join(steps) + f"""
select group_id, barcode, val seq, n n_sources, round(p, 6) p_true, p >= 0.5 or row_number() over (partition by group_id, barcode order by p desc, val desc) = 1 kept, k::int em_rounds from p{rounds}"""


SQL = {
    "p6_true_reads": _em_sql(24, 0.01),
    "p6_built": _BUILT,
    "p1_found": _LINKED + " select bc_id, group_root from g",
    "p1_molecules": _LINKED
    + """, b as (select distinct on (bc_id) bc_id, n_members, upper(umi) umi from barcode_sets),
m as (select coalesce(group_root, bc_id) molecule, bc_id, coalesce(n_members, 0) n, umi from b left join g using (bc_id))
select molecule, count(*) n_barcodes, sum(n)::bigint n_members, list(umi order by n desc, bc_id)[1] umi from m group by 1""",
    "p4_found": r"""
with r as (select distinct frag_id, fragment_size, regexp_extract(read_name, '^[^/\s]*') as nm from fragments
  where read_name is not null and fragment_size is not null),
k as (select frag_id, row_number() over (partition by nm order by fragment_size desc, frag_id) pick_no from r)
select frag_id, pick_no::int pick_no from k where pick_no <= 3""",
    "p6_found": _FAMILIES
    + f"""
select group_id, barcode, 'seq' field_name, rec_id from (select *, row_number() over (partition by group_id, barcode order by called desc, phred desc, rec_id) k from q) where k = 1
union all select group_id, barcode, 'description', rec_id from (select *, row_number() over (partition by group_id, barcode order by run_at desc nulls last, rec_id) k from m where not {_MISSING.format("description")}) where k = 1
union all select group_id, barcode, 'instrument', rec_id from (select *, row_number() over (partition by group_id, barcode order by run_at desc nulls last, rec_id) k from m where not {_MISSING.format("instrument")}) where k = 1""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_molecules, p4_found, p6_found, p6_built, p6_true_reads, p8_ids, p8_counts, p9_bins, p10_found, p10_profile)}
