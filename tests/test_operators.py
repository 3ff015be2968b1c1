"""Hand-made cases for the operators (FIXTURES.md, part C) and a sample of queries against their SQL."""

import os

import pytest
from pyspark.sql import functions as F

from regtext.functions import questions as q
from regtext.functions import text as t
from regtext.operators import context, evaluate, lines, parse

SF = "/root/testdata/sf0.001"


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_hyphens(spark):
    for raw, text in (("pem-\nbangunan", "pembangunan"), ("undang-\nundang", "undang-undang")):
        assert tuple(one(spark, raw, *t.join_hyphens(F.col("x")))) == (text, 1)


def test_hyphens_against_regular_expressions(spark):
    import random
    import re

    rng = random.Random(1)
    texts = ["12-\n13", "UU-\nKPK", "Undang-\nundang", "ab-\ncd-\nef", "ab-\nc-\nd", "pem-\n\nbangunan", "pem-\n Bangunan", "a" * 50_000 + "-\nb"]
    texts += ["".join(rng.choice(["ab", "c", "-\n", "D", "1", " ", "ab-\nab"]) for _ in range(40)) for _ in range(200)]

    def mended(text):
        text, n = re.subn(r"\b([A-Za-z]{2,})-\n(\1)\b", r"\1-\2", text, flags=re.I)
        text, m = re.subn(r"([A-Za-z]{2,})-\n([a-z])", r"\1\2", text)
        return text, n + m

    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: (r.y, r.n) for r in df.select("i", t.join_hyphens(F.col("x"))[0].alias("y"), t.join_hyphens(F.col("x"))[1].alias("n")).collect()}
    assert all(got[i] == mended(x) for i, x in enumerate(texts))


def test_running_titles(spark):
    # twice at the top and once at the bottom is no header; three times at the bottom is a footer, also in a short page's first lines
    pages = {1: ["Name", "a.", "b.", "c.", "Foot"], 2: ["Name", "a.", "b.", "c.", "Foot"], 3: ["x.", "y.", "z.", "Name", "Foot"], 4: ["Foot"]}
    df = spark.createDataFrame([(1, p, k, line) for p, ls in pages.items() for k, line in enumerate(ls)], "doc_id int, page int, pos int, line string")
    kept = [(r.page, r.line) for r in lines.drop_running_titles(df).orderBy("page", "pos").collect()]
    assert kept == [(p, line) for p, ls in pages.items() for line in ls if line != "Foot"]
    flat = spark.createDataFrame([(1, k, x) for k, x in enumerate(["a.", "", "a. ", "", "\ta.", "", "b"])], "doc_id int, pos int, line string")
    assert [r.line for r in lines.drop_frequent_lines(flat).orderBy("pos").collect()] == ["", "", "", "b"]


def test_zones_see_an_opening_without_a_colon(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, " Menimbang"), (1, 2, "MEMUTUSKAN :"), (1, 3, "y")], "doc_id int, pos int, line string")
    r = lines.zones(df).first()
    assert (r.considering, r.body, r.notes, r.n) == (1, 2, None, 4)


def test_letters_and_spoken_questions(spark):
    assert one(spark, "Pasal 5 huruf (f)", q.point_letter(F.col("x")))[0] == "f"
    u = one(spark, "hm... apa isi pasal 5?", q.understand(F.col("x")).alias("u")).u
    assert (u.repaired_text, u.pasal, u.is_passthrough) == ("apa isi pasal 5?", 5, True)
    u = one(spark, "\tPasal 3 ,  wajib \r", q.understand(F.col("x")).alias("u")).u
    assert (u.repaired_text, u.is_passthrough) == ("Pasal 3 ,  wajib", False)
    assert one(spark, " \t\r", q.understand(F.col("x")).alias("u")).u.search_query == ""
    r = one(spark, "Pasal 3 wajib", q.mend(F.col("x"), F.lit("Pasal 3 wajib sekali")), q.mend(F.col("x"), F.lit("wajib")), q.mend(F.col("x"), F.lit(None).cast("string")))
    assert tuple(r) == ("Pasal 3 wajib sekali", "Pasal 3 wajib", "Pasal 3 wajib")


def test_notes_on_citations(spark):
    rows = spark.createDataFrame([(5, 2, None, None), (5, 2, 6, None), (5, 2, 5, 3), (5, 2, 5, 2), (5, None, 5, 3), (None, 2, 5, 2)], "a int, b int, c int, d int")
    got = [r[0] for r in rows.select(context.validation_note(*map(F.col, "abcd"))).collect()]
    assert [g == "-" for g in got] == [True, False, False, True, True, True] and "Pasal 6" in got[1] and "(3)" in got[2]


def test_times_to_come_are_recent(spark):
    rows = spark.createDataFrame([(-3,), (0,), (1,), (6,), (7,), (None,)], "n int").withColumn("at", F.expr("date_sub(date'2024-03-10', n)"))
    assert [r[0] for r in rows.select(evaluate.time_bucket(F.col("at"), F.lit("2024-03-10").cast("date"))).collect()] == ["Previous 7 Days", "Today", "Yesterday", "Previous 7 Days", "Older", "Older"]


def test_whole_text_parser_against_regular_expressions(spark):
    import re

    text = "Mengingat Pasal 20 MEMUTUSKAN : BAB II\nUMUM\nPasal 1 (1) isi a) satu,\n b. dua dua (2) lain Pasal 2a tanpa ayat. PENJELASAN ATAS Pasal 3 x"
    a = parse.whole_text(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [(r.pasal, r.bab, r.text) for r in a.orderBy("seq").collect()] == [("1", "II", "(1) isi a) satu,\n b. dua dua (2) lain"), ("2a", "II", "tanpa ayat."), ("3", "II", "x")]
    p = parse.numbered_parts(a).orderBy("seq", "place").collect()
    letters = lambda s: [(m[1], re.sub(r"\s+", " ", m[2]).strip()) for m in re.finditer(r'(?:^|[\s,\"]+)([a-z])[\.\)]\s+(.*?)(?=(?:[\s,\"]+)[a-z][\.\)]|$)', s, re.S)]
    assert [(r.pasal, r.ayat, r.text) for r in p] == [("1", "1", "(1) isi a) satu,\n b. dua dua"), ("1", "2", "(2) lain"), ("2a", "1", "tanpa ayat."), ("3", "1", "x")]
    assert [[tuple(x) for x in r.points] for r in p] == [letters(r.text) for r in p]


def test_usage_over_slices_is_that_of_one_window(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice([0, 3, 59, 60, 86_399, 86_400, 86_401, 200_000, 900_000]) + rng.randint(0, 2), rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "request_id int, model string, s int, tokens int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: r for r in evaluate.windowed_usage(df).collect()}
    for i, m, s, _ in rows:
        near = lambda w: [x for x in rows if x[1] == m and s - w < x[2] <= s]  # noqa: E731, B023
        before = [x[2] for x in rows if x[1] == m and (x[2], x[0]) < (s, i)]
        r = got[i]
        assert (r.tokens_minute, r.requests_minute, r.tokens_day, r.requests_day) == (sum(x[3] for x in near(60)), len(near(60)), sum(x[3] for x in near(86_400)), len(near(86_400)))
        assert r.gap_seconds == (s - max(before) if before else None)


def test_admissions_wait_for_the_window(spark, tmp_path):
    from regtext.streaming import windows

    rows = [(1, "m", 0.0, 4), (2, "m", 10.0, 4), (3, "m", 20.0, 4), (4, "m", 200.0, 99), (5, "n", 5.0, 1), (6, "m", 201.0, 1)]
    spark.createDataFrame(rows, "request_id int, model string, s double, tokens long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("request_id int, model string, s double, tokens long, ts timestamp").parquet(f"{tmp_path}/in")
    got = {r.request_id: (r.admitted, r.waited) for r in windows.run_to_table(windows.admissions(stream, tokens=10, number=5, gap=1.5), None, "t").collect()}
    # the third waits for the first to leave; the fourth is larger than a window and gets an empty one; the last waits for that to leave
    assert got == {1: (0.0, 0.0), 2: (10.0, 0.0), 3: (60.0, 40.0), 4: (200.0, 0.0), 5: (5.0, 0.0), 6: (260.0, 59.0)}


def test_bases_are_stored_and_deleted(spark, tmp_path):
    from regtext.sources import knowledge

    path = f"file://{tmp_path}/points"
    chunks = spark.createDataFrame([("a", "parent", 1, "p", "text", ""), ("a", "child", 1, "c", "text two", "t"), ("b", "child", 2, "c", "", None)], "kb string, role string, doc_id int, chunk_id string, content string, title string")
    done = {r.kb: (r.parents, r.children, r.skipped, r.status) for r in knowledge.store_chunks(chunks, path, lambda texts: [[len(x), 1.0] for x in texts]).collect()}
    assert done == {"a": (1, 1, 0, "success"), "b": (0, 1, 0, "success")}
    stored = spark.read.parquet(path)
    assert stored.where("title = ''").count() == 0 and abs(stored.where("role = 'parent'").first().embedding[0] - 4 / 17**0.5) < 1e-6
    assert {(r.kb, r.status) for r in knowledge.monitor(stored, spark.createDataFrame([("a",), ("b",), ("c",)], "kb string")).collect()} == {("a", "active"), ("b", "partial_error"), ("c", "not_found")}
    assert knowledge.delete_base(spark, path, "b") == {"parent": "not_found", "child": "deleted"} and spark.read.parquet(path).where("kb = 'b'").count() == 0
    assert knowledge.ensure_base(spark, f"file://{tmp_path}/new", "kb string, role string, chunk_id string").count() == 0
    assert knowledge.ensure_base(spark, path, "kb string, role string, chunk_id string").count() == 2


def test_golden_sheets(spark, tmp_path):
    from regtext.sources import knowledge

    (tmp_path / "g.csv").write_bytes('\ufeffquestion,ground_truth,reference_context\n"a\nb",,"c ""q"""\n'.encode())
    r = knowledge.read_golden_csv(spark, f"file://{tmp_path}/g.csv").first()
    assert tuple(r) == ("a\nb", "", 'c "q"')
    (tmp_path / "bad.csv").write_text("question\nx\n")
    with pytest.raises(ValueError, match="ground_truth"):
        knowledge.read_golden_csv(spark, f"file://{tmp_path}/bad.csv")
    rows = spark.createDataFrame([(float(k * 7 % 101), "q") for k in range(101)], "k double, question string")
    assert [r.row_number for r in knowledge.numbered(rows, "k", 2).orderBy("k").collect()] == list(range(2, 103))
    files = knowledge.read_files(spark, f"file://{tmp_path}")
    assert files.count() == 0


def test_chunks_of_all_sections_have_distinct_ids(spark):
    from regtext.operators import chunk

    text = "Menimbang :\na. bahwa x\nMengingat : y\nPasal 1\n(1) Isi:\na. satu\n(2) Lain\nPasal 2\nTanpa ayat"
    head, body = text.split("\nPasal 1")[0], "Pasal 1" + text.split("\nPasal 1")[1]
    frame = lambda x: lines.explode_lines(spark.createDataFrame([(1, x)], "doc_id int, text string"))
    a = parse.articles(frame(body))
    notes = spark.createDataFrame([(1, "Umum. Pasal 1 Cukup jelas. Pasal 2 Lihat.")], "doc_id int, text string").withColumn("parts", parse.split_notes(F.col("text")))
    all_of = chunk.united(parse.preamble(frame(head)), a, parse.paragraphs(a), notes)
    ids = [r.chunk_id for r in all_of.orderBy("section_place", "chunk_id").collect()]
    assert ids == ["child_konsiderans_menimbang_a", "parent_konsiderans", "child_pasal_1_ayat_1", "child_pasal_1_ayat_1_huruf_a", "child_pasal_1_ayat_2", "child_pasal_2_tunggal", "parent_pasal_1", "parent_pasal_2", "child_penjelasan_pasal_1_isi", "child_penjelasan_pasal_2_isi", "parent_penjelasan_pasal_1", "parent_penjelasan_pasal_2"]
    assert chunk.filtered(all_of, chunk.BODY, "parent", 1).first().chunk_id == "parent_pasal_1" and [r.section for r in chunk.section_names(all_of).collect()] == ["Batang Tubuh", "Konsiderans", "Penjelasan"]
    pieces = [r.text for r in chunk.split_long(spark.createDataFrame([("a b c d e",)], "text string"), 3, 1).orderBy("piece").collect()]
    assert pieces == ["a b c", "c d e"]


def test_spaced(spark):
    for raw, text, n in (("P a s a l 5", "Pasal 5", 1), ("a b", "a b", 0), ("u n d a n g - u n d a n g", "undang - undang", 2)):
        assert tuple(one(spark, raw, *t.close_spaced(F.col("x")))) == (text, n)


def test_page_numbers(spark):
    assert one(spark, "- 1 -\n 12 \nHalaman 5\npage 6\nPasal 7", t.drop_page_numbers(F.col("x")))[0] == "Pasal 7"


@pytest.mark.parametrize("fixed,raw,want,n", [(False, "Setiap orang\nwajib patuh.\nPasal 2\n(1) isi a,\nlanjutan", "Setiap orang wajib patuh.\nPasal 2\n(1) isi a, lanjutan", 2), (False, "Pasal 3\nSetiap orang wajib.", "Pasal 3 Setiap orang wajib.", 1), (True, "Pasal 3\nSetiap orang wajib.", "Pasal 3\nSetiap orang wajib.", 0)])
def test_wrapped(spark, fixed, raw, want, n):
    r = one(spark, raw, t.join_wrapped(F.col("x"), fixed).alias("r")).r
    assert (r.text, r.n) == (want, n)
    got = lines.join_wrapped_lines(lines.explode_lines(spark.createDataFrame([(1, raw)], "doc_id long, text string")), fixed).orderBy("pos").collect()
    assert "\n".join(r.line for r in got) == want


def test_repair_counts(spark):
    r = one(spark, "P a s a l 5 pem-\nbangunan a1b,, x", t.repair(F.col("x")).alias("r")).r
    assert (r.hyphens, r.spaced, r.noise, r.was_repaired) == (1, 1, 2, True) and r.text == "Pasal 5 pembangunan alb, x"


def test_article(spark):
    text = "Pasal 3\n(1) Warga wajib:\na. satu\ndua\nb. tiga\n(2) Lain"
    a = parse.articles(lines.explode_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    p = parse.paragraphs(a).orderBy("ayat_number").collect()
    assert [(r.ayat_number, [(x.huruf, x.text) for x in r.points]) for r in p] == [(1, [("a", "satu dua"), ("b", "tiga")]), (2, [])]
    assert a.select(parse.article_title(F.col("text"), F.col("pasal_number"))).first()[0] == "Pasal 3 - Warga wajib:"


def test_preamble(spark):
    text = "Menimbang :\na. bahwa x\nlanjut\nb. bahwa y\nMengingat :\nPasal 20"
    r = parse.preamble(lines.explode_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert [(x.huruf, x.text) for x in r.menimbang] == [("a", "bahwa x lanjut"), ("b", "bahwa y")] and r.mengingat == "Pasal 20"


def test_references(spark):
    r = one(spark, "Pasal 5, 8, dan 10", q.article_numbers(F.col("x")), q.understand(F.col("x")).alias("u"))
    assert r[0] == [5, 8, 10] and r.u.pasal is None
    u = one(spark, "ps. 7 ayat (2) huruf B", q.understand(F.col("x")).alias("u")).u
    assert (u.pasal, u.ayat, u.huruf) == (7, 2, "b")
    u = one(spark, "mungkin salah pasal 3", q.understand(F.col("x")).alias("u")).u
    assert (u.pasal, u.ayat) == (None, None)


def test_packing(spark):
    def kept(*sizes):
        rows = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate(sizes)], "query_id long, rank int, text string")
        return [r.rank for r in context.packed(rows).orderBy("rank").collect()]

    assert kept(700, 400, 300) == [0, 1] and kept(1500, 10) == [0]


def test_quota(spark):
    rows = spark.createDataFrame([(1, "m", "2024-01-01 00:00:00", 1), (2, "m", "2024-01-01 00:00:59", 2), (3, "m", "2024-01-01 00:01:00", 3)], "request_id long, model string, ts string, tokens int").withColumn("ts", F.to_timestamp("ts"))
    assert [r.tokens_minute for r in evaluate.windowed_usage(rows).orderBy("request_id").collect()] == [1, 3, 5]


def test_metrics(spark):
    r = spark.range(1).select(evaluate.precision_at(F.array(F.lit(1), F.lit(0), F.lit(1))), evaluate.share_true(F.array().cast("array<int>"))).first()
    assert abs(r[0] - (1 + 2 / 3) / 2) < 1e-9 and r[1] is None


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    for name in ("vec_hybrid_boost", "ctx_pack", "eval_report", "law_articles", "line_join_wrapped", "rel_grouping_sets"):
        df = e.queries()[name](spark, SF)
        got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
        rel = con.sql(e.oracle_sql()[name])
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert got == sorted(repr([row[i] for i in order]) for row in rel.fetchall()), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
