"""Several values packed in one field: notation inference, quote-aware splitting, one row per value.

Every source (a column of the table) gets its notations ranked over all of its
fields: a notation scores by how regular its pieces are (an attribute is a key
with an assignment, a list item a number) and by how consistent the number of
pieces is. The notation of the highest score is the source's, and all of its
fields are split by it, unless the source mixes notations: unless, that is,
some field of it has more regular pieces in another. In a source that does, a
field takes the notation in which most of its own pieces are regular, and the
score of the source decides between equals.

1. Pieces and regular pieces of each field in each notation are counted, by
   regular expressions inside the JVM, and written beside the field.
2. The counts are aggregated by source. The table of ranks has one row a
   source; it joins by the source without a broadcast hint, so Spark broadcasts
   it only if its measured size allows.
3. Each field is split once, in its notation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import settle

KEY = r"[A-Za-z_][\w.\-]*"
QUOTED = r'''(?:"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+')'''


@dataclass(frozen=True)
class Notation:
    """How a field is written: ``pieces`` splits it, ``count`` and ``regular`` count its pieces and those of them that are well-formed."""

    name: str
    pieces: Callable[[Column], Column]
    count: Callable[[Column], Column]
    regular: Callable[[Column], Column]


def _attribute_notation(name: str, mark: str, assign: str) -> Notation:
    quoted = rf"{KEY}{assign}{QUOTED}\s*+(?={mark}|\z)"
    piece = rf"(?s)\s*+(?:{quoted}|[^{mark}\s][^{mark}]*+)"
    good = rf"(?s)(?:\A|{mark})\s*+(?:{quoted}|{KEY}(?:{assign}(?![\"'\s])[^{mark}]*+)?\s*+(?={mark}|\z))"
    return Notation(name, lambda f: F.regexp_extract_all(f, F.lit(piece), F.lit(0)), lambda f: F.regexp_count(f, F.lit(piece)), lambda f: F.regexp_count(f, F.lit(good)))


#: How attributes are written: the mark between attributes, and what stands between key and value.
ATTRIBUTE_NOTATIONS = (
    _attribute_notation("semicolon", ";", r"(?:\s*+=\s*+|\s++)"),
    _attribute_notation("pipe", r"\|", r"\s*+:\s*+"),
)
_ASSIGN = r"(?:\s*+[=:]\s*+|\s++)"


def _list_notation(name: str, mark: str) -> Notation:
    ends = lambda f: f.rlike(rf"{mark}\z").cast("int")
    first = lambda f: f.rlike(rf"\A(?:[+-]?\d+)?+(?={mark}|\z)").cast("int")
    return Notation(
        name,
        lambda f: F.split(F.regexp_replace(f, rf"{mark}\z", ""), mark, -1),
        lambda f: F.regexp_count(f, F.lit(mark)) + 1 - ends(f),
        lambda f: first(f) + F.regexp_count(f, F.lit(rf"{mark}(?:[+-]?\d+)?+(?={mark}|\z)")) - ends(f),
    )


#: How lists are written: the delimiter, tried in this order between equals.
LIST_NOTATIONS = tuple(
    _list_notation(name, f"(?>{mark})")
    for name, mark in (
        ("comma", r"\s*+,\s*+"),
        ("semicolon", r"\s*+;\s*+"),
        ("pipe", r"\s*+\|\s*+"),
        ("colon", r"\s*+:\s*+"),
        ("blank", r"\s++"),
        ("mixed", r"\s*+[,;|:]\s*+|\s++"),
    )
)
#: What blanks are, to be trimmed.
_BLANKS = " \t\n\x0b\f\r"


def _blank(field: Column) -> Column:
    return field.isNull() | field.rlike(r"\A\s*\.?\s*\z")


def rank_notations(fields: DataFrame, source: str, names: Sequence[str]) -> DataFrame:
    """One row a source from each field's ``share_<notation>`` and ``n_<notation>``: ``score_<notation>``, and ``beaten_<notation>``.

    The score is mean regularity times piece-count consistency, ``1 / (1 +
    cv)`` with the coefficient of variation of the piece count over the
    source's fields. A notation is beaten where another has a larger share of
    regular pieces in some field. All fields count.
    """
    aggs = []
    most = F.greatest(*[F.col(f"share_{n}") for n in names])
    for name in names:
        n = F.col(f"n_{name}").cast("double")
        spread = F.coalesce(F.stddev_pop(n) / F.nullif(F.avg(n), F.lit(0.0)), F.lit(0.0))
        aggs += [(F.avg(f"share_{name}") / (F.lit(1.0) + spread)).alias(f"score_{name}"), F.bool_or(F.col(f"share_{name}") < most).alias(f"beaten_{name}")]
    return fields.groupBy(source).agg(*aggs)


def _choice(names: Sequence[str]) -> Column:
    """The source's notation of the highest score; in a source where that one is beaten, the field's of the highest share. Order of ``names`` decides between equals."""
    options = [F.struct(F.col(f"score_{n}").alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("name"), (~F.col(f"beaten_{n}")).alias("alone")) for i, n in enumerate(names)]
    own = [F.struct(F.col(f"share_{n}").alias("own"), F.col(f"score_{n}").alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, n in enumerate(names)]
    best = F.greatest(*options)
    return F.when(best["alone"], best["name"]).otherwise(F.greatest(*own)["name"])


def _with_notation(rows: DataFrame, notations: Sequence[Notation]) -> DataFrame:
    """``rows`` (src, field, ...) with the pieces of each field as ``parts``."""
    names = [n.name for n in notations]
    counted = rows.withColumns({f"n_{n.name}": n.count(F.col("field")) for n in notations} | {f"good_{n.name}": n.regular(F.col("field")) for n in notations})
    counted = settle(counted, "fields")
    shares = counted.withColumns({f"share_{n}": F.coalesce(F.col(f"good_{n}") / F.nullif(F.col(f"n_{n}"), F.lit(0)), F.lit(0.0)) for n in names})
    ranks = rank_notations(shares, "src", names).withColumnRenamed("src", "rank_src")
    joined = shares.join(ranks, F.col("src").eqNullSafe(F.col("rank_src")), "left")
    split = lambda chosen: reduce(lambda rest, n: F.when(chosen == n.name, n.pieces(F.col("field"))).otherwise(rest), reversed(notations[:-1]), notations[-1].pieces(F.col("field")))
    # Bound to a variable, so that the choice is made once a field and not once a notation.
    return joined.withColumn("parts", F.transform(F.array(_choice(names)), split)[0])


def _unquote(value: Column) -> Column:
    """Without the quotes around it, and with quotes inside unescaped."""
    inner, out = F.substring(value, F.lit(2), F.length(value) - 2), value
    for mark in "\"'":
        plain = F.when(F.contains(inner, F.lit(mark)), F.regexp_replace(inner, rf"\\{mark}|{mark}{mark}", mark)).otherwise(inner)
        out = F.when(F.startswith(value, F.lit(mark)) & F.endswith(value, F.lit(mark)) & (F.length(value) > 1), plain).otherwise(out)
    return out


def _strip(value: Column) -> Column:
    return F.trim(value, F.lit(_BLANKS))


def _plain_ids(ids: Sequence[str]) -> list[str]:
    if {"attr_key", "idx", "attr_val"} & set(ids):
        raise ValueError("an id must not be named attr_key, idx or attr_val")
    return [f"i{k}" for k in range(len(ids))]


def attribute_values(df: DataFrame, ids: Sequence[str], field: str, source: str) -> DataFrame:
    """One row per attribute of ``field``: ``ids..., attr_key, idx, attr_val``.

    ``idx`` counts from 1 over the attributes in their order, repeated keys
    included; nothing between two separators is not counted. Quotes around a
    value go, escaped or doubled quotes inside become plain; a key without a
    value gives the empty string. Null, blank and lone-dot fields give no row.
    A null source ranks with the other null sources. Rows may repeat; each is
    split. Columns other than those named are not read.
    """
    names = _plain_ids(ids)
    rows = df.select(*[df[c].alias(n) for c, n in zip(ids, names)], df[source].cast("string").alias("src"), df[field].cast("string").alias("field"))
    rows = rows.where(~_blank(F.col("field")))
    split = _with_notation(rows, ATTRIBUTE_NOTATIONS).select(*names, F.posexplode("parts").alias("pos", "piece"))
    head = F.regexp_extract("piece", rf"(?s)\A\s*+{KEY}(?:{_ASSIGN})?", 0)
    split = split.withColumn("head", head)
    key = F.trim(F.col("head"), F.lit(_BLANKS + "=:"))
    split = split.withColumn("value", _strip(F.substring("piece", F.length("head") + 1, F.length("piece"))))
    return split.select(*[F.col(n).alias(c) for c, n in zip(ids, names)], key.alias("attr_key"), (F.col("pos") + 1).cast("int").alias("idx"), _unquote(F.col("value")).alias("attr_val"))


def list_values(df: DataFrame, ids: Sequence[str], field: str, source: str) -> DataFrame:
    """One row per filled place of the list in ``field``: ``ids..., attr_key, idx, attr_val``; ``attr_key`` is the field's name.

    ``idx`` is the place, from 1. A place left empty is counted and gives no
    row; a delimiter at the list's end opens none. Quotes around the list or
    around an item go. Null, blank and lone-dot fields give no row.
    """
    names = _plain_ids(ids)
    rows = df.select(*[df[c].alias(n) for c, n in zip(ids, names)], df[source].cast("string").alias("src"), df[field].cast("string").alias("field"))
    bare = _strip(F.translate(F.col("field"), "\"'", ""))
    rows = rows.withColumn("field", bare).where(~_blank(F.col("field")))
    split = _with_notation(rows, LIST_NOTATIONS).select(*names, F.posexplode("parts").alias("pos", "piece"))
    value = _strip(F.col("piece"))
    out = split.select(*[F.col(n).alias(c) for c, n in zip(ids, names)], F.lit(field).alias("attr_key"), (F.col("pos") + 1).cast("int").alias("idx"), value.alias("attr_val"))
    return out.where(F.col("attr_val") != "")
