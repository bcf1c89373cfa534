"""Sequence functions as Column expressions, all of them inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases and codes with what stands for their complements. The pairs of the ambiguity codes are
# those of the tables this engine's results must equal, not the set complements.
COMPLEMENT_FROM = "ACTGNactgnRYSWKMDHVryswkmdhv"
COMPLEMENT_TO = "TGACNtgacnBDHKMWSRYbdhkmwsry"
# The bases that each IUPAC code stands for.
IUPAC = {"R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACTG"}


def complement(seq: Column) -> Column:
    """Each base by its complement, ambiguity codes by their fixed partners, in its case; other characters stay."""
    return F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column) -> Column:
    """The complement read backwards."""
    return F.reverse(complement(seq))


def fix_strand(seq: Column, qual: Column, is_reverse: Column) -> tuple[Column, Column]:
    """Sequence and qualities as the sequencer read them: turned around where the alignment is reverse."""
    return F.when(is_reverse, reverse_complement(seq)).otherwise(seq), F.when(is_reverse, F.reverse(qual)).otherwise(qual)


def letters(text: Column) -> Column:
    """The characters of a text as an array; empty for an empty text."""
    return F.when(F.length(text) > 0, F.split(text, "")).when(text.isNotNull(), F.array().cast("array<string>"))


def hamming(a: Column, b: Column, strict: bool = True) -> Column:
    """Differing places of two texts of one length; another length raises, or is null unless ``strict``."""
    other = F.raise_error(F.lit("hamming distance of texts of different lengths")).cast("int") if strict else F.lit(None).cast("int")
    differing = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x != y), lambda d: d))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(F.length(a) != F.length(b), other).otherwise(differing)


def bit_planes(text: Column, alphabet: str, length: int) -> list[Column]:
    """A text of at most ``length`` letters as longs: each holds one bit of the numbers that 64 of its letters have in ``alphabet``.

    A letter that isn't in the alphabet raises.
    """
    at = lambda c: F.instr(F.lit(alphabet), c)
    number = F.transform(letters(text), lambda c: F.when(at(c) > 0, at(c)).otherwise(F.raise_error(F.lit("a letter that is not in the alphabet")).cast("int")))
    bit = lambda p: lambda bits, n: F.shiftleft(bits, 1).bitwiseOR(F.shiftright(n, p).bitwiseAND(F.lit(1)).cast("long"))
    return [F.aggregate(F.slice(number, first, 64), F.lit(0).cast("long"), bit(p)) for first in range(1, length + 1, 64) for p in range(len(alphabet).bit_length())]


def differing_planes(a: list[Column], b: list[Column], planes: int) -> Column:
    """Places where two texts of one length differ, from their :func:`bit_planes`, ``planes`` for each 64 letters."""
    words = [reduce(Column.bitwiseOR, [x.bitwiseXOR(y) for x, y in zip(a[i : i + planes], b[i : i + planes])]) for i in range(0, len(a), planes or 1)]
    return reduce(Column.__add__, [F.bit_count(w) for w in words], F.lit(0))


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance with unit costs."""
    return F.levenshtein(a, b)


def kmers(seq: Column, k: int) -> Column:
    """All windows of ``k`` bases in order; empty where the sequence is shorter."""
    last = F.length(seq) - F.lit(k - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(seq, i, F.lit(k)))).when(seq.isNotNull(), F.array().cast("array<string>"))


def subseq(text: Column, start: int, end: int) -> Column:
    """Characters ``start`` to ``end`` (0-based, half-open); raises where the text is shorter or the range is not one."""
    if not 0 <= start <= end:
        raise ValueError("the range must hold 0 <= start <= end")
    return F.when(F.length(text) >= end, F.substring(text, start + 1, end - start)).when(text.isNotNull(), F.raise_error(F.lit(f"a text is shorter than {end}")).cast("string"))


def slices(length: Column, parts: int) -> Column:
    """``parts`` near-equal stretches of a length as an array of (start, end), the longer ones first."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    one = lambda i: F.struct((i * base + F.least(i, longer)).alias("start"), ((i + 1) * base + F.least(i + 1, longer)).alias("end"))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), one)


def degenerate_codes(seq: Column) -> Column:
    """The IUPAC codes that stand for several bases in a sequence, each once, in alphabetical order."""
    return F.array_sort(F.array_intersect(letters(seq), F.array(*[F.lit(c) for c in IUPAC])))


def iupac_expansions(seq: Column, independent: bool = False) -> Column:
    """Every sequence a degenerate one can stand for, sorted.

    As usual in this field, one code stands for the same base wherever it
    occurs; ``independent`` lets every place choose for itself. The array grows
    with the number of codes (places) as a power; it is one row's own.
    """
    if independent:
        bases = F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.split(F.lit(v), ""))])
        options = F.transform(letters(seq), lambda c: F.coalesce(bases[c], F.array(c)))
        grown = F.aggregate(options, F.array(F.lit("")), lambda acc, opts: F.flatten(F.transform(acc, lambda head: F.transform(opts, lambda o: F.concat(head, o)))))
        return F.array_sort(grown)
    table = F.array(*[F.struct(F.lit(k).alias("code"), F.split(F.lit(v), "").alias("bases")) for k, v in IUPAC.items()])
    used = F.filter(table, lambda t: F.contains(seq, t["code"]))
    grown = F.aggregate(used, F.array(seq), lambda acc, t: F.flatten(F.transform(acc, lambda text: F.transform(t["bases"], lambda base: F.replace(text, t["code"], base)))))
    return F.when(seq.isNotNull(), F.array_sort(grown))


def one_hot(seq: Column, alphabet: str = "ACGNT") -> Column:
    """A row of 0 and 1 per base over the sorted alphabet; raises on a base outside it."""
    columns = sorted(set(alphabet))
    row = lambda c: F.array(*[F.when(c == a, 1.0).otherwise(0.0) for a in columns])
    outside = F.size(F.array_except(letters(seq), F.array(*[F.lit(a) for a in columns]))) > 0
    return F.when(outside, F.raise_error(F.lit("a base is not in the alphabet")).cast("array<array<double>>")).otherwise(F.transform(letters(seq), row))


def one_hot_decode(matrix: Column, alphabet: str = "ACGNT") -> Column:
    """The sequence of a one-hot matrix over the sorted alphabet."""
    columns = F.array(*[F.lit(a) for a in sorted(set(alphabet))])
    return F.array_join(F.transform(matrix, lambda row: F.get(columns, (F.array_position(row, F.lit(1.0)) - 1).cast("int"))), "")


def has_run(seq: Column, length: int) -> Column:
    """Whether one base of A, C, G or T repeats ``length`` times or more without a break."""
    return seq.rlike("|".join(f"{b}{{{length}}}" for b in "ACGT"))


def prefix_matches(reference: Column, query: Column, wildcards: bool = False) -> Column:
    """Matching places of two texts laid together at their starts, over the shorter length.

    With ``wildcards`` IUPAC codes on either side match any base they share.
    """
    shared = F.least(F.length(reference), F.length(query))
    pairs = F.zip_with(F.slice(letters(reference), F.lit(1), shared), F.slice(letters(query), F.lit(1), shared), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    if wildcards:
        bases = F.create_map(*[x for k, v in {**{b: b for b in "ACGT"}, **IUPAC}.items() for x in (F.lit(k), F.split(F.lit(v), ""))])
        same = lambda p: (p["a"] == p["b"]) | F.coalesce(F.arrays_overlap(bases[p["a"]], bases[p["b"]]), F.lit(False))
    else:
        same = lambda p: p["a"] == p["b"]
    return F.size(F.filter(pairs, same))


def natural_key(text: Column) -> Column:
    """A text that sorts as people order names with numbers in them: A2 before A10.

    Digit runs compare as numbers whatever their length: each is written with
    its significant digits behind their count.
    """
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(r)).cast("string"), 10, "0"), bare(r))).otherwise(r)), "")


def highlight(text: Column, on: str = "\x1b[31m", off: str = "\x1b[0m") -> Column:
    """A text between terminal colour codes."""
    return F.concat(F.lit(on), text, F.lit(off))
