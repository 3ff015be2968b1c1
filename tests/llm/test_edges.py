"""Every operator on empty tables, nulls, repeated rows, long texts and columns with the names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

from regtext.llm import brown, decontaminate, exact_dedup, license_templates, ngram_join, quality, stages, surrogates, url_trees
from regtext.llm import sentencepiece_viterbi as sv

CLASHES = ["id", "row", "row_key", "text_key", "_text_key", "rejected", "rejected_digest", "leaky", "leaky_digest", "_leaky", "_digest", "key", "sha", "n", "values", "entry", "keep_id", "label", "score", "h", "c", "class", "_metadata", "_metadata_", "batch"]
ROWS = [(1, "the same text of some words"), (1, "the same text of some words"), (None, "the same text of some words"), (None, None), (2, ""), (2, None), (3, "x" * 200_000), (4, "a," * 20_000), (5, "MIT License, a@b.org, Mr. Karl Ott"), (5, "another text under this id"), (6, "word " * 30_000)]


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, quality int").withColumn("rejected", F.lit(1))


def items(spark):
    return spark.createDataFrame([(1, "another text under this id"), (2, None), (2, "")], "item_id long, text string").withColumn("leaky", F.lit(1))


KEEPING = {
    "op2": lambda s, d: license_templates.scan_licenses(d),
    "op3": lambda s, d: brown.score_texts(d),
    "op4": lambda s, d: quality.score_quality(d, labels(s)),
    "op6": lambda s, d: surrogates.replace_entities(d, "k"),
    "op7": lambda s, d: ngram_join.near_duplicates(d),
    "op8": lambda s, d: exact_dedup.exact_duplicates(d),
    "op9": lambda s, d: decontaminate.find_leaks(d, items(s)),
    "op10": lambda s, d: sv.decode(sv.encode(d, sv.Pieces.load()), sv.Pieces.load()),
}


@pytest.mark.parametrize("name", KEEPING)
def test_a_row_for_every_row(spark, name):
    assert len(KEEPING[name](spark, docs(spark, ROWS)).collect()) == len(ROWS)
    assert KEEPING[name](spark, docs(spark, [])).collect() == []


def test_urls_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("suffix", "fit", "ruled", "blocked", "key", "share")})
    rows = [(None, None), (1, ""), (1, ""), (2, "http://" + "a." * 10_000 + "com/x"), (3, "x")]
    assert len(url_trees.filter_urls(frame(rows)).collect()) == len(rows) and url_trees.filter_urls(frame([])).collect() == []


DROPPING = {
    "op4": (lambda s, d: quality.drop_low_quality(d, labels(s)), None),
    "op8": (lambda s, d: exact_dedup.drop_duplicates(d), 7),
    "op7": (lambda s, d: ngram_join.drop_near_duplicates(d), 9),
    "op9": (lambda s, d: decontaminate.drop_leaks(d, items(s)), 10),
}


@pytest.mark.parametrize("name", DROPPING)
def test_filters_keep_columns_and_decide_by_row(spark, name):
    apply, left = DROPPING[name]
    kept = apply(spark, docs(spark, ROWS))
    assert kept.columns == ["doc_id", "text", *CLASHES]
    assert left is None or kept.count() == left
    assert apply(spark, docs(spark, [])).collect() == []


def test_filters_know_stored_rows_by_their_place(spark, tmp_path):
    docs(spark, ROWS).write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    for name in ("op8", "op7"):
        apply, left = DROPPING[name]
        kept = apply(spark, stored)
        assert kept.columns == stored.columns and kept.count() == left


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for rows, where in ((table, "some"), (table.where("false"), "none")):
        rows.write.parquet(f"{tmp_path}/{where}/documents.parquet")
        items(spark).write.parquet(f"{tmp_path}/{where}/benchmark.parquet")
        labels(spark).write.parquet(f"{tmp_path}/{where}/labels.parquet")
        got = spark.read.parquet(f"{tmp_path}/{where}/documents.parquet")
        for name, stage in stages.STAGES[:-1]:
            out = stage(spark, got, f"{tmp_path}/{where}")
            assert out.columns == table.columns, name
        done = stages.run(spark, f"{tmp_path}/{where}").collect()
        assert all(r.round_trip for r in done) and (len(done) > 0) == (where == "some")
