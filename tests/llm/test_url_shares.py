"""The shares of blocked urls are counted over all judged urls, and the trees see each url once."""

from regtext.llm import url_trees


def test_shares_cover_all_urls_and_copies_do_not_fill_the_sample(spark):
    rows = [(f"http://a{k}.good/x/{k}", False) for k in range(300)] + [(f"http://a{k}.bad/y/{k}", True) for k in range(300)]
    hot = "http://hot.good/x/1"
    judged = spark.createDataFrame(rows + [(hot, False)] * 2000, "url string, blocked boolean").repartition(3)
    pages = spark.createDataFrame([(0, "http://n.bad/y/new"), (1, "http://n.good/x/new"), (2, None), (3, "http://n.other/z")], "page_id long, url string")
    keyed = url_trees.with_keys(judged.distinct())
    shares, prior = url_trees.shares_of(keyed)
    got = {r.key: r.share for r in shares.collect()}
    assert abs(prior - 300 / 601) < 1e-12 and set(got) == {"good", "good/x", "bad", "bad/y"}
    assert abs(got["bad/y"] - (300 + 5 * prior) / 305) < 1e-12 and abs(got["good"] - 5 * prior / 306) < 1e-12
    out = {r.page_id: r for r in url_trees.filter_urls(pages, labelled=judged, sample=200).collect()}
    assert len(out) == 4 and out[0].block_probability > 0.5 and out[0].verdict == "block" and out[1].verdict == "allow"
    # a sample that the copies of any one url would fill has urls of both kinds
    first = judged.groupBy("url").count().selectExpr("url", "xxhash64(url) as h").orderBy("h").first().url
    copies = judged.unionByName(judged.where(f"url = '{first}'").limit(1).selectExpr("explode(array_repeat(url, 5000)) as url", "blocked"))
    out = {r.page_id: r.verdict for r in url_trees.filter_urls(pages, labelled=copies, sample=200).collect()}
    assert out[0] == "block" and out[1] == "allow"


def test_joined_shares_are_those_of_the_keys(spark):
    rows = [(f"http://h.com/d{k % 700}/{k}", k % 3 == 0) for k in range(5000)] + [(None, None), ("", None)]
    frame = url_trees.with_keys(spark.createDataFrame(rows, "url string, blocked boolean"))
    shares, prior = url_trees.shares_of(frame.where("blocked is not null"))
    want = {r.key: r.share for r in shares.collect()}
    got = url_trees.with_shares(frame, shares, prior).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.suffix_share, r.folder_share) == (want.get(r.suffix, prior), want.get(r.folder, prior))


def test_no_label_is_in_its_own_features_and_held_out_urls_are_judged(spark):
    # every key has six urls with labels at random: with their own labels in the shares, the trees would seem to know them
    import random

    import numpy as np

    rng = random.Random(3)
    noise = url_trees.with_keys(spark.createDataFrame([(f"http://h.s{k // 6}/d/{k}", rng.random() < 0.5) for k in range(3000)], "url string, blocked boolean"))
    shares, prior = url_trees.shares_of(noise)
    rows = url_trees.with_shares(noise, shares, prior, learning=True).collect()
    own = url_trees.with_shares(noise, shares, prior).collect()
    link = lambda rows: np.corrcoef([r.blocked for r in rows], [r.suffix_share for r in rows])[0, 1]
    assert link(own) > 0.25 and link(rows) < 0.1
    # labels that follow path depth and suffix: judged right where they were held out
    urls = [(f"http://h{k % 97}.{rng.choice(['aa', 'bb'])}/" + "/".join(rng.choice("xyz") * 3 for _ in range(rng.randint(1, 8))) + f"/{k}") for k in range(4000)]
    frame = spark.createDataFrame([(u, u.count("/") > 7 or ".bb/" in u and u.count("/") > 5) for u in urls], "url string, blocked boolean")
    parts = frame.withColumn("held", url_trees.fold_of(frame.url) == 0)
    got = url_trees.filter_urls(parts.where("held").selectExpr("url", "blocked as page_id"), rules=[], labelled=parts.where("not held")).collect()
    assert np.mean([(r.verdict == "block") == r.page_id for r in got]) > 0.95


def test_a_suffix_without_judged_urls_is_left_to_lexical_features(spark):
    # nine of ten judged urls are blocked, half of them full of digits; the others look like those that are not, but for the suffix
    rows = [(f"http://site{k}.bad/" + (f"{'7' * (30 + k % 9)}/{k}" if k % 2 else "news/item"), True) for k in range(900)] + [(f"http://site{k}.good/news/item", False) for k in range(0, 900, 9)]
    judged = spark.createDataFrame(rows, "url string, blocked boolean")
    asked = {0: "http://site77.other/news/item", 1: "http://site78.other/" + "7" * 35 + "/12", 2: "http://site79.bad/never/seen", 3: "http://site80.good/never/seen"}
    out = {r.page_id: r.verdict for r in url_trees.filter_urls(spark.createDataFrame(list(asked.items()), "page_id long, url string"), rules=[], labelled=judged).collect()}
    assert out == {0: "allow", 1: "block", 2: "block", 3: "allow"}


def test_suffixes():
    of = {"a.b.com": "com", "x.co.uk": "co.uk", "co.uk": "uk", "news.de": "de", "www.news.de": "de", "h.org:8080": "org", "u@h.net": "net", "10.0.0.1": "ip", "[::1]": "ip", "": "", "h.com.": "com"}
    assert {h: url_trees.suffix_of(h) for h in of} == of
