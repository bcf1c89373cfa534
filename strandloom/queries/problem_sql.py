"""SQL of the unpacking and reject queries, written for DuckDB's own regular expressions."""

QUOTED = r"""(?:"[^"\\]*(?:(?:\\.|"")[^"\\]*)*"|''[^''\\]*(?:(?:\\.|'''')[^''\\]*)*'')"""
KEY = r"[A-Za-z_][A-Za-z0-9_.\-]*"


def attributes(field: str) -> str:
    """The pieces of an attribute field, by its first assignment."""
    return (
        rf"case when regexp_matches({field}, '^\s*{KEY}\s*:') then regexp_extract_all({field}, '\s*{KEY}\s*:\s*{QUOTED}\s*|[^|]+')"
        rf" else regexp_extract_all({field}, '\s*{KEY}(?:\s*=\s*|\s+){QUOTED}\s*|[^;]+') end"
    )


def bare(field: str) -> str:
    return f"trim(translate({field}, chr(34) || chr(39), ''), ' \t\r\n')"


def places(field: str) -> str:
    """The places of a packed list."""
    return rf"string_split_regex(regexp_replace({bare(field)}, '\s*[,;|:]\s*$', ''), '\s*[,;|:]\s*|\s+')"


def list_rows(field: str) -> str:
    return rf"""select rec_id, '{field}' attr_key, unnest(range(1, len(l) + 1))::int idx, unnest(l) attr_val
from (select rec_id, {places(field)} l from b where {field} is not null and not regexp_full_match({bare(field)}, '\.?'))"""


P3 = rf"""
with g as (select distinct on (rec_id) rec_id, info from gtf_records where info is not null and not regexp_full_match(info, '\s*\.?\s*')),
b as (select distinct on (rec_id) rec_id, exon_starts, exon_ends from bed12_records),
l as (select rec_id, [x for x in {attributes("info")} if not regexp_full_match(x, '\s*')] l from g),
p as (select rec_id, unnest(range(1, len(l) + 1))::int idx, unnest(l) piece from l),
v as (select rec_id, idx, regexp_extract(piece, '^\s*({KEY})', 1) attr_key,
  regexp_replace(regexp_replace(piece, '^\s*{KEY}(?:\s*[=:]\s*|\s+)?', ''), '^\s+|\s+$', '', 'g') v from p)
select 'gtf_records' rec_tab, rec_id, attr_key, idx,
  case when v like '"%"' then regexp_replace(v[2:-2], '\\"|""', '"', 'g')
       when v like '''%''' then regexp_replace(v[2:-2], '\\''|''''', '''', 'g') else v end attr_val from v
union all select 'bed12_records', rec_id, attr_key, idx, attr_val from ({list_rows("exon_starts")} union all {list_rows("exon_ends")}) where attr_val <> ''"""


def _torn(cell: str) -> str:
    return rf"""regexp_matches(regexp_replace({cell}, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''', '', 'g'), '["'']')"""


def _whole(cell: str) -> str:
    return f"regexp_full_match({cell}, '[0-9]+')"


def _number(cell: str) -> str:
    return f"try_cast({cell} as hugeint)"


def _items(cell: str) -> str:
    return rf"""string_split(regexp_replace(case when regexp_full_match({cell}, '"[^"]*"|''[^'']*''') then {cell}[2:-2] else {cell} end, ',$', ''), ',')"""


_GENE = rf"""[x for x in {attributes("f[9]")}
  if regexp_full_match(x, '\s*gene_id(?:\s*=\s*|\s+)(?:{QUOTED})\s*|\s*gene_id\s*=\s*[^"''\s].*') and not regexp_full_match(x, '\s*gene_id(?:\s*=\s*|\s+)(?:""|'''')\s*')]"""
_GTF_OK = f"""{_whole("f[4]")} and {_whole("f[5]")} and coalesce({_number("f[4]")} >= 1 and {_number("f[4]")} <= {_number("f[5]")}, false)
  and f[7] in ('+', '-', '.') and f[8] in ('0', '1', '2', '.') and len({_GENE}) > 0"""
_BED_OK = f"""{_whole("f[2]")} and {_whole("f[3]")} and coalesce({_number("f[2]")} < {_number("f[3]")}, false) and f[6] in ('+', '-')
  and {_whole("f[10]")} and coalesce({_number("f[10]")}, 0) >= 1 and len(sizes) = coalesce({_number("f[10]")}, -1) and len(starts) = coalesce({_number("f[10]")}, -1)
  and len([x for x in sizes if not {_whole("x")} or coalesce({_number("x")}, 0) <= 0]) = 0 and len([x for x in starts if not {_whole("x")}]) = 0
  and len([i for i in range(1, len(starts)) if not coalesce({_number("starts[i]")} < {_number("starts[i + 1]")}, false)]) = 0"""

P7_CELLS = rf"""
with l as (select distinct on (line_id) line_id, line_kind, rtrim(raw_line, chr(13)) raw from annot_lines
  where raw_line is not null and not regexp_full_match(raw_line, '\s*') and not starts_with(raw_line, '#') and line_kind in ('gtf', 'bed12')),
c as (select line_id, line_kind, string_split(raw, chr(9)) f from l),
n as (select *, len(f) = case when line_kind = 'gtf' then 9 else 12 end cols, len([x for x in f if {_torn("x")}]) > 0 torn from c)"""

P7 = rf"""{P7_CELLS},
g as (select line_id, case when not cols then 'columns' when torn then 'quoting' when not ({_GTF_OK}) then 'values' end reason from n where line_kind = 'gtf'),
s as (select *, {_items("f[11]")} sizes, {_items("f[12]")} starts from n where line_kind = 'bed12'),
b as (select line_id, case when not cols then 'columns' when torn then 'quoting' when not ({_BED_OK}) then 'values' end reason from s)
select line_id, reason from g where reason is not null union all select line_id, reason from b where reason is not null"""


P7_GTF = rf"""{P7_CELLS}
select line_id, f[1] chrom, f[2] src_name, f[3] feature_type, f[4]::bigint start_pos, f[5]::bigint end_pos, try_cast(nullif(f[6], '.') as double) score,
  nullif(f[7], '.') strand, try_cast(nullif(f[8], '.') as int) phase, f[9] info from n where line_kind = 'gtf' and cols and not torn and {_GTF_OK}"""

P7_BED = rf"""{P7_CELLS},
s as (select *, {_items("f[11]")} sizes, {_items("f[12]")} starts from n where line_kind = 'bed12')
select line_id, f[1] chrom, f[2]::bigint tx_start, f[3]::bigint tx_end, case when f[4] like '"%"' or f[4] like '''%''' then f[4][2:-2] else f[4] end tid,
  f[6] strand, f[10]::int exon_count, list_sum([x::bigint for x in sizes])::bigint exon_bases from s where cols and not torn and {_BED_OK}"""
