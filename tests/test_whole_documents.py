"""Queries read all of a document."""

from regtext.plans import text_queries


def test_konsiderans_reads_all_lines(spark, tmp_path):
    lines = [f"line {k}" for k in range(30)]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in text_queries.law_konsiderans(spark, str(tmp_path)).collect()}
    marked = ["Menimbang :", "a. line 1", "line 2", "b. line 3", "Mengingat :", *lines[5:]]
    assert set(got) == {1, 2} and got[1].points == 2 and got[1].view_chars == len("\n".join(marked[5:])) and got[1].chars >= got[1].view_chars
