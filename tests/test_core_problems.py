"""Periods, unpacking, counts of hot keys and rejects, against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.operators.dense_counts import counts_per_key
from strandloom.operators.periods import covered_periods, periods_and_gaps
from strandloom.operators.rejects import faulty_lines, valid_bed12, valid_gtf
from strandloom.operators.unpack import attribute_values, list_values
from strandloom.queries import core_problems


def plain_periods(rows):
    out = set()
    by = defaultdict(list)
    for k, s, e in rows:
        if s is not None and e is not None and 0 <= s < e:
            by[k].append((s, e))
    for k, spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for s, e in spans[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                out.add((k, "gap", merged[-1][1], s))
                merged.append([s, e])
        out |= {(k, "covered", s, e) for s, e in merged}
    return out


@pytest.mark.parametrize("tile", [4, 64, 1 << 17])
def test_periods_equal_plain_python(spark, tile):
    rng = random.Random(tile)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(-3, 300), s + rng.randrange(-2, 12)) for _ in range(400)]
    rows += [("hot", 5, 900), ("hot", 5, 6), ("hot", 5, 900), ("a", None, 4), ("a", 4, None), (None, None, None)]
    df = spark.createDataFrame([(k, s, e, "x") for k, s, e in rows], "k string, start_pos long, end_pos long, tile string")
    got = [tuple(r) for r in periods_and_gaps(df, ["k"], tile=tile).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_periods(rows)


def test_periods_far_positions_empty_table_and_names(spark):
    far = 6_000_000_000_000_000_000
    df = spark.createDataFrame([(1, far, far + 10), (1, 0, far), (1, 8_000_000_000_000_000_000, 8_000_000_000_000_000_001)], "s long, start_pos long, end_pos long")
    assert [tuple(r) for r in covered_periods(df, ["s"]).collect()] == [(1, 0, far + 10)]
    assert periods_and_gaps(df.limit(0), ["s"]).count() == 0
    with pytest.raises(ValueError):
        covered_periods(df.withColumnRenamed("s", "seg_end"), ["seg_end"])


def plain_attributes(field):
    """A hand-written scanner, sharing no pattern with the operator."""
    if field is None or field.strip() in ("", "."):
        return []
    pipe = re.match(r"\s*[\w.-]+\s*:", field) is not None
    mark = "|" if pipe else ";"
    out, i = [], 0
    while i < len(field):
        while i < len(field) and (field[i].isspace() or field[i] == mark):
            i += 1
        if i >= len(field):
            break
        k = i
        while i < len(field) and (field[i].isalnum() or field[i] in "_.-"):
            i += 1
        key = field[k:i]
        while i < len(field) and (field[i].isspace() or field[i] in "=:") and field[i] != mark:
            i += 1
        if i < len(field) and field[i] in "\"'":
            q, i, value = field[i], i + 1, ""
            while i < len(field):
                if field[i] == "\\" and field[i + 1 : i + 2] == q or field[i] == q and field[i + 1 : i + 2] == q:
                    value, i = value + q, i + 2
                elif field[i] == q:
                    i += 1
                    break
                else:
                    value, i = value + field[i], i + 1
            while i < len(field) and field[i] != mark:
                i += 1
        else:
            v = i
            while i < len(field) and field[i] != mark:
                i += 1
            value = field[v:i].strip()
        out.append((key, len(out) + 1, value))
    return out


def plain_list(field):
    if field is None:
        return []
    field = field.replace('"', "").replace("'", "").strip()
    if field in ("", "."):
        return []
    places, now, i = [], "", 0
    for part in re.findall(r"\d+|[,;|:]|\s+", field):
        if part.isdigit():
            places.append(part)
        elif part.isspace():
            places.append(" ")
        else:
            places.append(part)
    # blanks beside a mark are padding, other blanks delimit
    tokens = [p for k, p in enumerate(places) if not (p == " " and (k and places[k - 1] in ",;|:" or k + 1 < len(places) and places[k + 1] in ",;|:"))]
    out, idx, i = [], 1, 0
    for p in tokens:
        if p.isdigit():
            out.append((idx, p))
        else:
            idx += 1
    return out


def test_unpacking_equals_a_plain_scanner_on_the_whole_tables(spark, sf):
    got = defaultdict(set)
    for r in core_problems.p3_found(spark, sf).collect():
        got[r.rec_tab].add((r.rec_id, r.attr_key, r.idx, r.attr_val))
    gtf = {(r.rec_id, k, i, v) for r in spark.read.parquet(f"{sf}/gtf_records.parquet").collect() for k, i, v in plain_attributes(r.info)}
    assert got["gtf_records"] == gtf
    bed = {(r.rec_id, f, i, v) for r in spark.read.parquet(f"{sf}/bed12_records.parquet").collect() for f in ("exon_starts", "exon_ends") for i, v in plain_list(r[f])}
    assert got["bed12_records"] == bed


def test_unpacking_of_odd_fields(spark):
    fields = {1: r'''note "a; b | \"c\"", x'''[:19], 2: 'a "x""y";; b=; c', 3: "k: v w | n: 'it''s; |' |", 4: None, 5: " . ", 6: "", 7: "tag z; tag z;", 8: "x " + "y" * 20000}
    df = spark.createDataFrame([(k, v, "s", 0) for k, v in fields.items()], "id int, info string, src string, notation int")
    got = defaultdict(list)
    for r in attribute_values(df, ["id"], "info", "src").orderBy("id", "idx").collect():
        got[r.id].append((r.attr_key, r.attr_val))
    assert got[2] == [("a", 'x"y'), ("b", ""), ("c", "")]
    assert got[3] == [("k", "v w"), ("n", "it's; |")]
    assert got[7] == [("tag", "z"), ("tag", "z")]
    assert got[8] == [("x", "y" * 20000)]
    assert not {4, 5, 6} & set(got)
    lists = {1: '"1,2,,4,"', 2: "7  8 9", 3: "1 , 2;3|4 5", 4: "'3';'4'", 5: ".", 6: None, 7: "5:6:", 8: ",".join(map(str, range(5000)))}
    df = spark.createDataFrame(list(lists.items()), "id int, l string").withColumn("src", F.lit(None).cast("string"))
    got = defaultdict(list)
    for r in list_values(df, ["id"], "l", "src").orderBy("id", "idx").collect():
        got[r.id].append((r.idx, r.attr_val))
    assert got[1] == [(1, "1"), (2, "2"), (4, "4")]
    assert got[2] == [(1, "7"), (2, "8"), (3, "9")]
    assert [v for _, v in got[3]] == ["1", "2", "3", "4", "5"]
    assert [v for _, v in got[4]] == ["3", "4"]
    assert got[7] == [(1, "5"), (2, "6")] and len(got[8]) == 5000
    assert list_values(df.limit(0), ["id"], "l", "src").count() == 0


def test_counts_per_key_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"k{rng.randrange(50)}", rng.choice([None, 1, 2, 3])) for i in range(3000)]
    rows += rows[:500] + [(None, "hot", 9), (None, None, 9), (9999, "", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "r long, b string, g long, n_rows int")
    want = defaultdict(lambda: [set(), set()])
    for r, b, g in rows:
        if b is not None:
            want[b][0].add(r)
            want[b][1] |= {g} - {None}
    got = {r.key: (r.n_rows, r.n_members) for r in counts_per_key(df, "r", "b", "g", blocks=3).collect()}
    assert got == {k: (len(a), len(m)) for k, (a, m) in want.items()}
    assert counts_per_key(df.limit(0), "r", "b", "g").count() == 0


def closed(cell):
    i = 0
    while i < len(cell):
        if cell[i] in "\"'":
            q, i = cell[i], i + 1
            while True:
                if i >= len(cell):
                    return False
                if cell[i] == "\\":
                    i += 2
                elif cell[i] == q:
                    break
                else:
                    i += 1
        i += 1
    return True


def plain_reason(kind, line):
    if line is None or not line.strip() or line.startswith("#"):
        return None
    f = line.rstrip("\r").split("\t")
    if len(f) != (9 if kind == "gtf" else 12):
        return "columns"
    if not all(map(closed, f)):
        return "quoting"
    whole = lambda s: s.isascii() and s.isdigit()
    if kind == "gtf":
        ok = whole(f[3]) and whole(f[4]) and 1 <= int(f[3]) <= int(f[4]) and f[6] in ("+", "-", ".") and f[7] in ("0", "1", "2", ".")
        ok = ok and any(k == "gene_id" and v for k, _, v in plain_attributes(f[8]))
        return None if ok else "values"
    listed = lambda s: (s[1:-1] if s[:1] in ("'", '"') and s[-1:] == s[:1] else s).removesuffix(",").split(",")
    ok = whole(f[1]) and whole(f[2]) and int(f[1]) < int(f[2]) and f[5] in ("+", "-") and whole(f[9]) and int(f[9]) >= 1
    if ok:
        sizes, starts = listed(f[10]), listed(f[11])
        ok = len(sizes) == len(starts) == int(f[9]) and all(map(whole, sizes + starts)) and all(int(s) > 0 for s in sizes)
        ok = ok and all(int(a) < int(b) for a, b in zip(starts, starts[1:]))
    return None if ok else "values"


def test_rejects_equal_plain_python_on_the_whole_table(spark, sf):
    lines = spark.read.parquet(f"{sf}/annot_lines.parquet")
    rows = lines.collect()
    want = {r.line_id: reason for r in rows if (reason := plain_reason(r.line_kind, r.raw_line))}
    got = {r.line_id: r.reason for r in faulty_lines(lines).collect()}
    assert got == want
    read = {r.line_id for r in rows if r.raw_line is not None and r.raw_line.strip() and not r.raw_line.startswith("#")}
    loaded = [r.line_id for r in valid_gtf(lines).collect()] + [r.line_id for r in valid_bed12(lines).collect()]
    assert sorted(loaded) == sorted(read - set(want))


def test_rejects_of_odd_lines(spark):
    good = 'c\ts\texon\t1\t9\t.\t+\t.\tgene_id "G"'
    cases = {
        1: ("gtf", good, None), 2: ("gtf", good + "\r", None), 3: ("gtf", good.replace("\t9\t", "\t0\t"), "values"), 4: ("gtf", "", None), 5: ("gtf", None, None), 6: (None, "x", None),
        7: ("gtf", good.replace('"G"', '""'), "values"), 8: ("gtf", good.replace('"G"', '"a""b\\""'), None), 9: ("gtf", good + "; note 5' end", "quoting"), 10: ("gtf", "x" * 50000, "columns"),
        11: ("bed12", 'c\t0\t5\tt\t0\t+\t0\t0\t0\t2\t"1,2,"\t\'0,3\'', None), 12: ("bed12", "c\t0\t5\tt\t0\t+\t0\t0\t0\t2\t1,2\t3,3", "values"), 13: ("bed12", "c\t0\t5\tt\t0\t.\t0\t0\t0\t1\t1\t0", "values"),
        14: ("gtf", good.replace("gene_id", 'note "gene_id \\"x\\""; id'), "values"), 15: ("gtf", good.replace('gene_id "G"', "gene_id=G"), None), 16: ("bed12", "#c", None), 17: ("gtf", good.replace('"G"', '"' + "g" * 60000 + '"'), None),
    }
    df = spark.createDataFrame([(i, k, t, "c") for i, (k, t, _) in cases.items()], "line_id int, line_kind string, raw_line string, cells string")
    got = {r.line_id: r.reason for r in faulty_lines(df.unionByName(df)).collect()}
    assert got == {i: w for i, (_, _, w) in cases.items() if w}
    assert faulty_lines(df.limit(0)).count() == 0 and valid_gtf(df.limit(0)).count() == 0
