"""Candidates of the Jaccard join by parts of sets, and rows that a join may leave where they are."""

import random

import numpy as np
from pyspark.sql import functions as F

from regtext.llm import ngram_join, support


def test_sets_that_share_single_grams_are_no_candidates(spark, monkeypatch):
    rng, moved, pairs = random.Random(11), [], ngram_join._pairs
    common = [rng.choice("abcdefghij") for _ in range(4000)]
    texts = [" ".join(common[a : a + 60] + [f"w{k}x{i}" for i in range(140)]) for k, a in enumerate(rng.choices(range(3900), k=400))]
    texts += [x.replace(f"w{k}x70", "other") for k, x in enumerate(texts[:20])]
    monkeypatch.setattr(ngram_join, "_pairs", lambda members, *a: moved.append(members.count()) or pairs(members, *a))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=3, percent=90).collect()}
    assert got == {k: k - 400 if k >= 400 else k for k in range(420)}
    assert 40 <= moved[0] < 60


def test_similar_sets_have_a_part_in_common():
    rng = np.random.default_rng(3)
    for percent in (85, 90, 97):
        bounds, similar = ngram_join.Bounds(percent), 0
        for _ in range(2000):
            n = int(np.exp(rng.uniform(1, 6)))
            pool = np.unique(ngram_join._mix(rng.integers(0, 1 << 63, 2 * n + 9).astype(np.uint64)))
            gone = rng.integers(0, n // 5 + 2)
            a, b = pool[rng.permutation(len(pool))[:n]], pool[rng.permutation(len(pool))[:n]]
            a = np.sort(a)
            b = np.unique(np.concatenate([np.delete(a, rng.permutation(n)[:gone]), b[: rng.integers(0, gone + 1)]]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= percent * (len(a) + len(b) - same) and not np.array_equal(a, b):
                similar += 1
                assert len(np.intersect1d(bounds.parts(a), bounds.parts(b)))
        assert similar > 100


def test_rows_that_a_join_needs_are_let_through(spark):
    rows = spark.range(20_000).select(F.struct((F.col("id") % 3 == 0).alias("x"), F.col("id").cast("string").alias("y")).alias("id"), F.lit("t").alias("text")).unionByName(spark.sql("select cast(null as struct<x: boolean, y: string>) as id, 't' as text"))
    wanted = rows.where("id.y like '%7'").select("id")
    found = support.marked(rows, wanted, "id")
    assert found.columns == rows.columns and found.join(wanted, "id").count() == 2000 and found.count() < 2100
