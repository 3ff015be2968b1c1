"""Cases that a quadratic or unbounded step would not finish or would get wrong."""

import random
import time

from pyspark.sql import functions as F

from regtext.functions import text as t
from regtext.operators import lexical, parse, retrieve
from regtext.sources import knowledge


def test_notes_of_a_text_with_very_many_mentions(spark):
    text = "".join(f"Pasal {k} isi nomor {k} dari naskah \n" for k in range(12_000))
    began = time.time()
    got = spark.createDataFrame([(text,)], "text string").select(parse.split_notes(F.col("text")).alias("p")).first()["p"]
    assert [(p.pasal, p.text) for p in got] == [(str(k), f"isi nomor {k} dari naskah") for k in range(12_000)]
    assert time.time() - began < 30


def _points(spark):
    rng = random.Random(3)
    rows = []
    for k in range(1500):
        v = [float(rng.randint(-3, 3)) for _ in range(6)] if k % 3 else [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]  # many copies, so many ties
        v = {1: None, 2: [0.0] * 6, 3: [1.0, None] + [1.0] * 4, 4: [1.0, 2.0], 5: [float("nan")] + [1.0] * 5, 6: []}.get(k % 97, v)
        rows.append((k, f"s{k % 2}", k % 5, k % 3 if k % 7 else None, f"content {k}", v))
    return spark.createDataFrame(rows, "chunk_id long, section string, pasal int, ayat int, content string, embedding array<float>")


def test_best_pairs_lose_nothing_that_tiers_need(spark):
    points = _points(spark).repartition(3)
    asked = points.where("chunk_id % 31 < 2").select(F.col("chunk_id").alias("query_id"), "embedding", F.expr("case when chunk_id % 4 < 2 then section end").alias("section"), F.expr("case when chunk_id % 3 = 0 then 9 when chunk_id % 3 = 1 then pasal end").alias("pasal"), F.expr("case when chunk_id % 2 = 0 then ayat end").alias("ayat"))
    columns = ["query_id", "chunk_id", "tier", "rank", "raw", "pasal_not_found"]
    for unit in (False, True):
        pairs = retrieve.scored(asked, points, unit, 0.15)
        best = retrieve.best_pairs(asked, points, 7, unit, 0.15)
        assert best.columns == pairs.columns and dict(best.dtypes) == dict(pairs.dtypes)
        rows = lambda df: sorted(map(str, retrieve.tiered(df, 7).select(*columns).collect()))
        assert rows(best) == rows(pairs)
        assert 0 < best.count() < pairs.count() / 2
    assert sorted(map(str, retrieve.tiered(retrieve.best_pairs(asked, points, 7, broadcast_bytes=2000), 7).select(*columns).collect())) == sorted(map(str, retrieve.tiered(retrieve.scored(asked, points), 7).select(*columns).collect()))


def test_titles_without_white_space_of_any_kind(spark):
    texts = ["Pasal 1\n\tIsi pendek\u00a0", "Pasal 1\n\u3000(2) satu\u2028dua ", "Pasal 1\n" + "x" * 79 + "\t"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(parse.article_title(F.col("t"), F.lit("1"))).collect()]
    assert got == ["Pasal 1 - Isi pendek", "Pasal 1 - satu\u2028dua", "Pasal 1 - " + "x" * 60]


def test_hashed_texts_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice(["Ä-b", "c", "d", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 60))), k % 4) for k in range(300)] + [(300, None, 3), (301, "...", 3)]
    rows = spark.createDataFrame(texts, "k long, text string, level int")
    counts, vectors = (lambda: lexical.hashed_counts(rows, ["k"])), (lambda: lexical.hashed_embeddings(rows, ["k"], level_col="level"))
    plan = counts()._jdf.queryExecution().executedPlan().toString() + vectors()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    listed = lambda: ({(r.k, r.bucket): round(r.weight, 9) for r in counts().collect()}, {r.k: r.embedding and [round(x, 5) for x in r.embedding] for r in vectors().collect()})
    here = listed()
    monkeypatch.setattr(lexical, "HEAD", 3)
    assert here == listed() and here[1][300] is None and here[1][301] is None and here[1][0] is None


def test_staged_cleaning_is_that_of_columns(spark):
    rng = random.Random(7)
    parts = ["a1b", "12", "|", "a|b", "....", "..", ",,", ";;", "■", "Ā", "ɐ", "字", " ", "\n", "x-\ny", "P a s a l", "Halaman 3\n", "ﬁ", "\u00ad", "é"]
    rows = spark.createDataFrame([(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(400)] + [(400, None)], "k int, x string").repartition(4)
    for fixed in (False, True):
        got = {r.k: r.clean for r in t.cleaned_pages(rows, "x", fixed).collect()}
        assert got == {r.k: r.c for r in rows.select("k", t.clean_page(F.col("x"), fixed).alias("c")).collect()}
    assert {r.k: r.r for r in t.repaired(rows, "x").collect()} == {r.k: r.r for r in rows.select("k", t.repair(F.col("x")).alias("r")).collect()} | {400: t.repaired(rows.where("k = 400"), "x").first().r}


def test_pages_of_files_of_all_kinds(spark):
    files = spark.createDataFrame([("a", bytearray(b"1\n2")), ("b", bytearray(b"")), ("c", bytearray(b"\xff")), ("d", None)], "path string, content binary").coalesce(1)
    got = [tuple(r) for r in knowledge.extract_pages(files, lambda c: c.decode().split("\n") if c else []).collect()]
    assert got[:3] == [("a", 1, "1", None), ("a", 2, "2", None), ("b", None, None, "no pages")]
    assert [r[:3] for r in got[3:]] == [("c", None, None), ("d", None, None)] and got[3][3].startswith("UnicodeDecodeError") and got[4][3].startswith("TypeError")


def test_chapter_titles_need_the_first_two_lines_only(spark):
    first = lambda x: spark.createDataFrame([(x,)], "x string").select(parse.first_lines(F.col("x"))).first()[0]
    assert first("\n \nBAB I\n\u00a0\n Umum \nrest\n" + "z" * 1000) == "\n \nBAB I\n\u00a0\n Umum \n"
    assert first("BAB I Pasal 2") == "BAB I Pasal 2" and first("") == "" and first(" \n") in ("", " \n")


def test_terms_of_long_texts_without_stops(spark):
    texts = ["Ab " * 20_000 + "; Hak cipta adalah x. Izin\tUsaha  adalah y, Z adalah", "adalah Naskah 5 Surat Kuasa adalah adalah", "A adalah"]
    began = time.time()
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    got = {r.k: r.tags for r in rows.select("k", t.keywords(F.col("x"), t.article_type(F.col("x"))).alias("tags")).collect()}
    assert got == {0: ["definisi", "hak", "hak cipta", "izin\tusaha"], 1: ["definisi", "surat kuasa adalah"], 2: ["definisi"]}
    assert time.time() - began < 20


def test_only_rare_words_are_looked_up(spark, monkeypatch):
    rng = random.Random(9)
    texts = [(None if k == 7 else k, " ".join([rng.choice("abcdefgh") for _ in range(200)] + [f"r{k // 2}", f"s{k}"]) if k % 50 else None) for k in range(300)]
    rows = spark.createDataFrame(texts, "k long, text string")
    counts, vectors = (lambda: lexical.hashed_counts(rows, ["k"])), (lambda: lexical.hashed_embeddings(rows, ["k"]))
    listed = lambda: ({(r.k, r.bucket): round(r.weight, 9) for r in counts().collect()}, {r.k: r.embedding and [round(x, 5) for x in r.embedding] for r in vectors().collect()})
    here = listed()
    monkeypatch.setattr(lexical, "HEAD", 20)
    assert here == listed() and len(here[1]) == 300 and here[1][0] is None
    plans = [x()._jdf.queryExecution().optimizedPlan().toString() for x in (counts, vectors)]
    assert all("Generate explode" not in x for x in plans)
