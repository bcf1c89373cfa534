"""What the training-data operators do with hot groups, many lots and conflicts, and how far a plainer rule would get."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import queries
from strandloom.llm.packing import best_fit, conflicts
from strandloom.llm.reading import reading_bands
from strandloom.llm.survivors import best_fields, infer_truth
from strandloom.llm.tokens import encode_corpus, load_tokenizer, tokenizer_folder
from strandloom.llm.topn import top_per_group


def test_a_million_copies_of_one_item_are_one_candidate(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.when(F.col("id") < 999_990, 50).otherwise(F.col("id") % 10).alias("s"), F.when(F.col("id") < 999_990, 7).otherwise(F.col("id")).alias("i"))
    got = [tuple(r) for r in top_per_group(rows, "g", "s", "i", 3).orderBy("pick_no").collect()]
    assert got == [("hot", 7, 50, 1), ("hot", 999_999, 9, 2), ("hot", 999_998, 8, 3)]


@pytest.mark.parametrize("lot_chars", [1, 5_000])
def test_ids_do_not_depend_on_lots(spark, lot_chars):
    rng = random.Random(6)
    parts = ["".join(rng.choice("abcdefgh ijkl, mno. ") for _ in range(400)) for _ in range(12)]
    texts = ["".join(rng.sample(parts, 3)) for _ in range(120)] + [parts[0]] * 40 + ["", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    encode = load_tokenizer(f"{tokenizer_folder()}/byte_bpe_50k.tiktoken")
    got = {r.doc_id: r.ids for r in encode_corpus(df.unionByName(df.where("doc_id % 3 = 0")), lot_chars=lot_chars).collect()}
    assert got == {i: encode(t) if t else [] for i, t in enumerate(texts)}


def test_lots_of_a_source_spread_over_all_bins():
    sizes, sources = [10] * 40 + [30] * 20, [0] * 40 + [1] * 20
    place = best_fit(sizes, [-1] * 60, sources, 100)
    of = defaultdict(lambda: [0, 0])
    for b, s in zip(place, sources):
        of[b][s] += 1
    assert len(of) == 10 and all(n == [4, 2] for n in of.values())


def test_conflicts_of_the_corpus_bins(spark):
    """Fill and conflicts of both kinds on whole tables: see the README's figures."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.nullif(queries._plain(), F.lit("")).alias("copy"), F.coalesce("source", F.lit("")).alias("source"))
    row = conflicts(queries.p9_bins(spark, sf), docs, "doc_id", F.col("copy"), F.col("source")).first()
    assert row.fill_tokens / (2048 * row.bins) >= 0.97
    assert row.copies_together <= 0.001 * 10_000
    assert row.source_repeats <= 1.05 * row.least_repeats


def held_out(spark, **options):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_labels"))
    marks = defaultdict(list)
    for r in labels.collect():
        if r.band:
            marks[r.doc_id].append(r.band)
    held = {d: b[0] for d, b in marks.items() if d % 2 and len(b) > 1 and len(set(b)) == 1}
    got = {r.doc_id: r.band for r in reading_bands(docs, labels.where(~F.col("doc_id").isin(*held)), **options).collect()}
    return np.mean([got[d] == b for d, b in held.items() if d in got])


def test_familiarity_by_band_adds_to_the_named_terms(spark):
    plain = held_out(spark, by_band=False)
    assert 0.93 < plain < 0.97
    assert held_out(spark) > max(0.98, plain)


def test_the_quality_model_does_not_give_the_stated_order(spark):
    """Why p6_found takes the stated order: the model's likeliest sequence is another in many families."""
    rows = queries._families(spark, "/root/testdata/sf0.01").dropDuplicates(["rec_id"])
    stated = best_fields(rows, ["group_id", "barcode"], "rec_id", queries._family_rules()).where("field_name = 'seq'")
    stated = stated.join(rows.select("rec_id", F.upper("seq").alias("stated")), "rec_id").select("group_id", "barcode", "stated")
    source = rows.withColumn("instrument", F.upper(F.trim("instrument"))).withColumn("seq", F.upper("seq"))
    model = infer_truth(source, ["group_id", "barcode"], "instrument", "seq")
    assert model.select("em_rounds", "em_change").distinct().count() == 1 and model.first().em_change <= 0.01
    likely = model.groupBy("group_id", "barcode").agg(F.max_by("seq", F.struct("p_true", "seq")).alias("likely"))
    share = stated.join(likely, ["group_id", "barcode"]).agg(F.avg((F.col("stated") == F.col("likely")).cast("int"))).first()[0]
    assert 0.4 < share < 0.9


def test_too_few_rounds_raise(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "x")], "e int, s string, v string")
    with pytest.raises(RuntimeError):
        infer_truth(df, ["e"], "s", "v", tolerance=0.0, most_rounds=1)
