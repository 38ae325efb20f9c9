"""Pipeline stages on blank, repeated, empty and all-null rows, and in crowded buckets."""

import random

import corpus_pipeline
from test_nearcopies import changed, plain_kept, text

from ledgerline.llm import mixing, nearcopies
from ledgerline.llm.common import document_key

ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_blank_documents_of_a_source_at_its_cap_come_no_more_than_twice(spark):
    rows = [(k, "", "en", "b", 0) for k in range(40)] + [(100 + k, "a b c", "en", "b", 0) for k in range(3)] + [(200 + k, "w " * 500, "en", "a", 0) for k in range(20)]
    docs = spark.createDataFrame(rows, ROWS)
    got = mixing.mix(docs).collect()
    assert all(r.copies == 2 for r in got if r.source == "b") and len(got) == len(rows)
    counts = mixing.mix_rows(docs).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in counts) == 2


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = [(1, "a b c d e f g", "en", s, n) for s, n in (("x", 3), ("y", 1), ("x", 2), (None, 9))] * 2 + [(2, "a b c d e f g", "en", "x", 0)]
    kept = {tuple(nearcopies.drop_near_copies(spark.createDataFrame(order, ROWS).repartition(k)).first()) for k, order in ((1, rows), (3, rows[::-1]))}
    assert len(kept) == 1 and kept.pop()[0] == 1


def test_crowded_bucket_takes_hubs_of_hubs(spark):
    rng = random.Random(5)
    first, other = text(rng, 120), text(rng, 120)
    rows = [(k, " ".join(changed(rng, first, rng.sample(range(120), rng.randrange(3))))) for k in range(60)]
    rows += [(100 + k, " ".join(changed(rng, other, rng.sample(range(120), rng.randrange(3))))) for k in range(25)] + [(200, " ".join(text(rng, 50)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (3, 1024):
        got = nearcopies.near_copies(df.select(document_key(df).alias("doc_id"), "text"), max_bucket=most).collect()
        assert {r.doc_id.doc_id for r in got if r.doc_id == r.component_id} == plain_kept(rows)


def test_run_on_empty_and_null_tables(spark, tmp_path):
    for k, rows in enumerate(([], [(None, None, None, None, None)] * 3, [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "only text here", None, None, 0)])):
        sf = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, ROWS).write.parquet(f"{sf}/documents.parquet")
        got = corpus_pipeline.run(spark, sf)
        assert got.columns == ["doc_id", "ids", "n_ids", "round_trip"] and {r.doc_id for r in got.collect()} == ({3} if k == 2 else set())
