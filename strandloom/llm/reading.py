"""How demanding each text is to read, on raters' bands, in all languages alike.

A familiar-word formula: shares of words outside lists of the corpus's most
frequent words (by document frequency over all documents), average sentence
length, and, because the share of unfamiliar words alone can't tell bands of
different languages apart, how familiar the listed words are to each band: the
document frequency of a word in texts of a band, over all marked texts. The
weights are those of a softmax regression on a bounded sample of marked texts;
a marked text's own words don't count for its band while weights are fitted.

The corpus is read in two passes of Arrow batches. The first counts documents
by word (each task adds up its words before the shuffle) and keeps the marked
texts, in one written table; the second judges. The driver and the workers hold
the list only, ``listed`` words at most.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.session import drop_settled, settle

BANDS = 4
#: Lists of the most frequent words, by size, outside which a word counts as unfamiliar.
TIERS = (50, 200, 800, 2000)
#: Added to a word's count in each band.
SMOOTHING = 0.3
_TAG, _LINK, _WORD = re.compile(r"<[^<>]*>"), re.compile(r"https?://\S+"), re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?。]+\s|\n+|<br\s*/?>")
_BROKEN = re.compile("[ÃÂâ][\u0080-¿‐-›€Œ-ƒ]")


def plain_words(text: str) -> list[str]:
    """The words of a text in lower case, without markup, links and numbers, with doubly encoded letters put right."""
    if _BROKEN.search(text):
        text = text.encode("cp1252", "ignore").decode("utf-8", "ignore")
    text = html.unescape(_TAG.sub(" ", text))
    return _WORD.findall(_LINK.sub(" ", text).replace("’", "'").lower())


def sentence_length(text: str) -> float:
    """Average words a sentence, of sentences of two words or more; 0 without any."""
    sizes = [n for s in _SENTENCE.split(text) if (n := len(s.split())) > 1]
    return sum(sizes) / len(sizes) if sizes else 0.0


_COUNTS = ["word", "n", *[f"b{k}" for k in range(1, BANDS + 1)]]


def _first_pass(least_words: int, kind: pa.DataType):
    """``word, n, b1..b4``: documents with the word, in all and marked with each band; the empty word counts documents. Besides, ``doc, text, band`` of marked texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = defaultdict(lambda: [0] * (BANDS + 1))

        def flush() -> pa.RecordBatch:
            n = len(held)
            counts = np.array(list(held.values()), np.int64).reshape(-1, BANDS + 1)
            out = [pa.array(held.keys(), pa.string()), *[pa.array(counts[:, k]) for k in range(BANDS + 1)], pa.nulls(n, kind), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, [*_COUNTS, "doc", "text", "band"])

        for batch in batches:
            marked = []
            for i, (text, band) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if len(text.split()) < least_words:
                    continue
                if band is not None:
                    marked.append(i)
                for word in {"", *plain_words(text)}:
                    counts = held[word]
                    counts[0] += 1
                    if band is not None:
                        counts[band] += 1
            if marked:
                some = batch.take(pa.array(marked))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(marked), pa.string()), *[pa.nulls(len(marked), pa.int64())] * (BANDS + 1), some.column(0).cast(kind), some.column(1).cast(pa.string()), some.column(2).cast(pa.int32())], [*_COUNTS, "doc", "text", "band"])
            if len(held) > 200_000:
                yield flush()
        if held:
            yield flush()

    return run


class Formula:
    """From texts to the terms of the formula, given the listed words and their counts by band."""

    def __init__(self, words: list[str], counts: np.ndarray, totals: np.ndarray, by_band: bool = True):
        self.rank = {w: i for i, w in enumerate(words)}
        self.counts, self.totals, self.by_band = counts.reshape(-1, BANDS), totals, by_band
        self.share = self._shares(self.counts, totals)

    @staticmethod
    def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        share = np.log((counts + SMOOTHING) / (totals + SMOOTHING * BANDS))
        return share - share.mean(axis=-1, keepdims=True)

    def terms(self, texts: list[str], bands: list[int] | None = None) -> np.ndarray:
        """A row a text. With ``bands``, each text is left out of the counts of its own."""
        n, miss = len(texts), len(self.rank)
        ranks, sizes, letters, sentences = [], np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for i, text in enumerate(texts):
            words = plain_words(text)
            ranks += [self.rank.get(w, miss) for w in words]
            sizes[i], letters[i], sentences[i] = len(words), sum(map(len, words)), sentence_length(text)
        flat, owner, some = np.array(ranks, np.int64), np.repeat(np.arange(n), sizes), np.maximum(sizes, 1)
        outside = [np.where(sizes > 0, np.bincount(owner, flat >= t, n) / some, 1.0) for t in TIERS]
        columns = [np.ones(n), np.log1p(sentences), letters / (5 * some), *outside]
        if self.by_band:
            listed = flat < miss
            flat, owner = flat[listed], owner[listed]
            if bands is None:
                share = self.share[flat]
            else:
                own = np.eye(BANDS)[np.asarray(bands, np.int64)[owner] - 1]
                share = self._shares(self.counts[flat] - own, self.totals - own)
            known = np.maximum(np.bincount(owner, minlength=n), 1)
            columns += [np.bincount(owner, share[:, k], n) / known for k in range(BANDS)]
        return np.stack(columns, axis=1)


def _softmax_fit(x: np.ndarray, y: np.ndarray, steps: int = 600, decay: float = 1e-3) -> np.ndarray:
    """Weights on raw features, by full-batch gradient steps on standardised ones."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], spread[0] = 0.0, 1.0
    z, w, target = (x - mean) / spread, np.zeros((x.shape[1], BANDS)), np.eye(BANDS)[y - 1]
    for _ in range(steps):
        p = np.exp(z @ w - (z @ w).max(axis=1, keepdims=True))
        w -= z.T @ (p / p.sum(axis=1, keepdims=True) - target) / len(y) + decay * w
    w[:, [k for k in range(BANDS) if k + 1 not in y]] = 0.0
    w[0, [k for k in range(BANDS) if k + 1 not in y]] = -1e9
    w /= spread[:, None]
    w[0] -= mean[1:] @ w[1:]
    return w


def _marks(labels: DataFrame, doc: str, band: str) -> DataFrame:
    """The band that most raters of a document gave; documents without one are left out."""
    votes = labels.select(labels[doc].alias("doc"), labels[band].cast("int").alias("band")).where(F.col("doc").isNotNull() & F.col("band").between(1, BANDS)).groupBy("doc", "band").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("doc").agg(F.max(F.struct("n", "band")).alias("top"), F.max(F.struct(F.col("n"), -F.col("band"))).alias("low"))
    return best.where(F.col("top.band") == -F.col("low.col2")).select("doc", F.col("top.band").alias("band"))


def reading_bands(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", band: str = "band", *, least_words: int = 15, listed: int = 20_000, sample: int = 20_000, by_band: bool = True) -> DataFrame:
    """``doc, band``: the band (1 easiest to 4) of every text of ``least_words`` or more words, separated by white space.

    Bands outside 1 to 4 and null marks count for nothing; documents whose
    raters are evenly split train nothing. ``listed`` bounds the word list and
    ``sample`` the marked documents that weights are fitted on (those of
    smallest hash); frequencies, also those in marked texts, are over all
    documents. Without ``by_band`` the formula has unfamiliar words, sentence
    and word length only. Without a marked text every band is null. Null texts
    give no row; rows of one document each get theirs, and one of them trains.
    Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc].alias("doc"), docs[text].cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("doc").isNotNull())
    kind = rows.schema["doc"].dataType
    marked = rows.join(_marks(labels, doc, band), "doc", "left").select("doc", "text", "band")
    seen = settle(marked.mapInArrow(_first_pass(least_words, to_arrow_type(kind)), f"word string, {', '.join(f'{c} long' for c in _COUNTS[1:])}, doc {kind.simpleString()}, text string, band int"), "words")
    counted = seen.where(F.col("word").isNotNull()).groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS[1:]])
    words = counted.orderBy(F.col("n").desc(), "word").limit(listed + 1).collect()
    counts = np.array([[r[c] for c in _COUNTS[2:]] for r in words], float).reshape(-1, BANDS)
    totals = counts[[r.word == "" for r in words]].sum(axis=0)
    chosen = [i for i, r in enumerate(words) if r.word][:listed]
    shared = spark.sparkContext.broadcast(Formula([words[i].word for i in chosen], counts[chosen], totals, by_band))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1).to_pylist()
            terms = shared.value.terms(batch.column(0).to_pylist(), bands).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.float64())), pa.array(bands, pa.int32())], ["x", "y"])

    marks = seen.where(F.col("text").isNotNull()).groupBy("doc").agg(F.min("text").alias("text"), F.min("band").alias("band"))
    picked = marks.select("doc").orderBy(F.xxhash64("doc"), "doc").limit(sample)
    sampled = marks.join(F.broadcast(picked), "doc", "left_semi").select("text", "band").mapInArrow(features, "x array<double>, y int").collect()
    drop_settled(seen)
    weights = _softmax_fit(np.array([r.x for r in sampled]), np.array([r.y for r in sampled])) if sampled else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = part.column(1).to_pylist()
                kept = [i for i, t in enumerate(texts) if len(t.split()) >= least_words]
                if weights is None:
                    bands = pa.nulls(len(kept), pa.int32())
                else:
                    bands = pa.array((shared.value.terms([texts[i] for i in kept]) @ weights).argmax(axis=1) + 1, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), bands], ["doc", "band"])

    return rows.mapInArrow(judge, f"doc {kind.simpleString()}, band int").withColumnRenamed("doc", doc)
