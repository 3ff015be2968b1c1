"""The source of pages: ranges of any size give the same pages as splitting whole files."""

import random

from regtext.sources.pages import index_pages, read_pages


def test_ranges_of_any_size_give_the_pages_of_whole_files(spark, tmp_path):
    rng = random.Random(5)
    files = {f"f{k}.txt": "".join(rng.choice(["\f", "a", "é", "\n", "bcd"]) for _ in range(rng.randint(1, 90))) for k in range(12)}
    files |= {"empty.txt": "", "feeds.txt": "\f\f", "long.txt": "x" * 3_000_000 + "\f" + "end", "name with space.txt": "one\ftwo\f"}
    (tmp_path / "in").mkdir()
    for name, text in files.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    want = {(n, k, p) for n, t in files.items() for k, p in enumerate((t[:-1] if t.endswith("\f") else t).split("\f"), 1) if t}
    for size in (1, 7, 1 << 20):
        paths = [str(tmp_path / "in")] if size > 1 else [str(tmp_path / "in" / n) for n in files if n != "long.txt"]
        index = index_pages(spark, paths, str(tmp_path / f"index{size}"), size if size != 7 else 40_007)
        got = read_pages(spark, str(tmp_path / f"index{size}")).collect()
        expected = {w for w in want if size > 1 or w[0] != "long.txt"}
        assert sorted((r.path.rsplit("/", 1)[1], r.page, r.text) for r in got if r.issue is None) == sorted(expected), size
        assert [(r.path.rsplit("/", 1)[1], r.issue) for r in got if r.issue] == [("empty.txt", "no pages")]
    assert index.where("path like '%long%'").count() == 3


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    (tmp_path / "broken.txt").write_bytes(b"good\f\xff\xfe\falso good\f")
    (tmp_path / "gone.txt").write_bytes(b"a\fb")
    index_pages(spark, [str(tmp_path / "broken.txt"), str(tmp_path / "gone.txt"), str(tmp_path / "missing.txt")], str(tmp_path / "index"))
    (tmp_path / "gone.txt").unlink()
    got = {(r.path.rsplit("/", 1)[1], r.page): (r.text, (r.issue or "").split(":")[0]) for r in read_pages(spark, str(tmp_path / "index")).collect()}
    assert got == {("broken.txt", 1): ("good", ""), ("broken.txt", 2): (None, "UnicodeDecodeError"), ("broken.txt", 3): ("also good", ""), ("gone.txt", 1): (None, "FileNotFoundError"), ("missing.txt", None): (None, "no such path")}


def test_filters_on_pages_leave_out_ranges(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"".join(b"page %d\f" % k for k in range(1, 1001)))
    index_pages(spark, [str(tmp_path / "in.txt")], str(tmp_path / "index"), 500)
    ranges = read_pages(spark, str(tmp_path / "index")).rdd.getNumPartitions()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = read_pages(spark, str(tmp_path / "index")).where("page > 500 and page <= 520 and text like 'page 5%'")
        assert [(r.page, r.text) for r in some.orderBy("page").collect()] == [(k, f"page {k}") for k in range(501, 521)]
        assert some.rdd.getNumPartitions() <= 2 < 10 < ranges
        assert read_pages(spark, str(tmp_path / "index")).where("page = 7").collect()[0].text == "page 7"
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert read_pages(spark, str(tmp_path / "index")).where("page = 7").count() == 1
