"""The filter stages of the pipeline on rows whose ids are null or repeated."""

import random

import corpus_pipeline
from regtext.llm import decontaminate, exact_dedup, ngram_join, quality


def _rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)


def _tags(df):
    return sorted(r.tag for r in df.collect())


def test_rejected_rows_leave_rows_of_the_same_id(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "of", "river", "stone", "and", "Light."]) for _ in range(60)) for _ in range(160)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW$$$", "***"]) for _ in range(60)) for _ in range(160)]
    rows = [(i, t, "learn") for i, t in enumerate(good[:150] + bad[:150])]
    rows += [(None, t, f"good {i}") for i, t in enumerate(good[150:])] + [(None, t, f"bad {i}") for i, t in enumerate(bad[150:])]
    rows += [(900, good[0], "good same"), (900, bad[0], "bad same")]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)], "doc_id long, quality int")
    kept = quality.drop_low_quality(_rows(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "tag"]
    assert _tags(kept.where("tag <> 'learn'")) == sorted([*(f"good {i}" for i in range(10)), "good same"])


def test_leaks_leave_rows_of_the_same_id(spark):
    items = spark.createDataFrame([(1, "short test item")], "item_id long, text string")
    rows = [(None, "a short test item", "bad"), (None, "clean", "null"), (None, None, "empty"), (7, "short test item", "bad"), (7, "clean", "same"), (8, "clean", "a"), (8, "clean", "b")]
    assert _tags(decontaminate.drop_leaks(_rows(spark, rows), items)) == ["a", "b", "empty", "null", "same"]


def test_one_row_of_equal_texts_stays(spark):
    rows = [(None, "x y", "null"), (None, "xy", "short"), (None, "x y", "null"), (5, "p q", "five"), (5, "p q", "five"), (5, "r", "other"), (None, "p q", "late"), (4, "pq", "less"), (None, "z", "z")]
    kept = exact_dedup.drop_duplicates(_rows(spark, rows))
    assert kept.columns == ["doc_id", "text", "tag"] and _tags(kept) == ["five", "null", "other", "z"]


def test_one_row_of_linked_texts_stays(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:59], f"v{k}"])
    rows = [(3, near(0), "three"), (None, near(0), "copy"), (None, near(1), "near"), (None, "else one two three four five six", "alone")]
    rows += [(9, near(2), "late"), (3, near(0), "three"), (3, "quite another text with words of its own", "same id")]
    rows += [(None, " ".join(f"u{i}" for i in range(40)), "null pair"), (None, " ".join(f"u{i}" for i in range(40)), "null pair"), (None, None, "empty"), (None, "", "empty")]
    kept = ngram_join.drop_near_duplicates(_rows(spark, rows))
    assert kept.columns == ["doc_id", "text", "tag"]
    assert _tags(kept) == ["alone", "empty", "empty", "null pair", "same id", "three"]


def test_pipeline_keeps_one_row_of_each(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts[:6])] + [(None, t) for t in texts[6:]]
    rows += rows[:2] + rows[6:8] + [(3, f"{texts[8]}  "), (50, f"{texts[9]} more"), (None, f"short test item {texts[0]} {texts[1]}"), (4, f"short test item {texts[2]} {texts[3]}")]
    _rows(spark, [(*r, "") for r in rows]).drop("tag").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "short test item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # the rows with an id stay for their copies without one; the leaks go alone
    assert sorted(x for x in got if x is not None) == [0, 1, 2, 3, 3, 4, 5, 50] and got.count(None) == 4
