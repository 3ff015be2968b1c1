"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regtext.llm import brown, decontaminate, exact_dedup, license_templates, ngram_join, quality, surrogates, url_trees, warc
from regtext.llm import sentencepiece_viterbi as sv
from regtext.llm.components import components
from regtext.llm.support import LOWER, shared_dir

ODD = ["", None, " \n", "the", "the the", "x" * 50_000, "a b c " * 3000, "Ünï 𝔘 ▁ text", "the"]


def frame(spark, texts, extra=True):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # names that the operators use themselves
    return df.withColumns({"id": F.lit("x"), "sha": F.lit(1), "key": F.lit(2), "row": F.lit(3), "values": F.lit(None)}) if extra else df


def test_exact_dedup(spark):
    texts = ["a b", "ab", "a  b\n", "c", None, "", " ", "c"] * 3 + ODD
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(frame(spark, texts), collapse_bytes=100).collect()}
    groups: dict = {}
    for i, x in enumerate(texts):
        groups.setdefault((x or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r")), []).append(i)
    for members in groups.values():
        keep = min(members, key=lambda i: (-len(texts[i] or ""), i))
        for i in members:
            assert got[i] == (keep, len(members), i == keep)
    # many levels: spilled to folders first, then tables that are full after one content
    again = exact_dedup.exact_duplicates(frame(spark, texts), bucket_bytes=20_000, collapse_bytes=100, fanout=3)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again.collect()} == got
    assert exact_dedup.exact_duplicates(frame(spark, []).where("false")).count() == 0


def _components(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().translate(LOWER).split()
        k = min(n, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("seed,n,percent,block,hot,flush", [(1, 3, 90, 10**6, 64, 1_500_000), (2, 5, 80, 700, 64, 300), (3, 3, 80, 300, 2, 500)])
def test_ngram_join(spark, seed, n, percent, block, hot, flush):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = [rng.choice(words) for _ in range(40)]
    texts = list(ODD)
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 8, 20, 90]))] + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 20)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, texts).repartition(3), n=n, percent=percent, block_grams=block, hot=hot, flush=flush).collect()}
    assert got == _components(texts, n, percent)


def test_block_links_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    bounds = ngram_join.Bounds(80)
    for trial in range(30):
        sets = []
        for _ in range(rng.integers(2, 25)):
            base = rng.choice(60 + 4000 * (trial % 2), rng.integers(1, 40), replace=False)
            for _ in range(rng.integers(1, 4)):
                kept = base[rng.random(len(base)) > 0.1 * (trial % 3)]
                sets.append(np.unique(np.append(kept, rng.integers(0, 60, rng.integers(0, 3)))).astype(np.uint64) if len(kept) else base.astype(np.uint64))
        sets = [np.unique(x) for x in sets]

        def roots(links, n):
            up = list(range(n))

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in links:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
            return [root(i) for i in range(n)]

        def linked(x, y):
            o = len(np.intersect1d(x, y))
            return 100 * o >= 80 * (len(x) + len(y) - o)

        n = len(sets)
        want = roots([(i, j) for i in range(n) for j in range(i) if linked(sets[i], sets[j])], n)
        assert roots(ngram_join.block_links(sets, sets, bounds, True), n) == want
        half = n // 2
        got = roots([(i, half + j) for i, j in ngram_join.block_links(sets[:half], sets[half:], bounds, False)], n) if half else want
        across = roots([(i, j) for i in range(half) for j in range(half, n) if linked(sets[i], sets[j])], n)
        assert got == across if half else True


def test_a_block_of_unlinked_sets_is_no_scan_of_all_pairs():
    import time

    rng = np.random.default_rng(1)
    bounds = ngram_join.Bounds(80)
    took = []
    for n in (2000, 8000):
        sets = [np.unique(rng.integers(0, 10**7, 40)).astype(np.uint64) for _ in range(n)]
        began = time.perf_counter()
        assert ngram_join.block_links(sets, sets, bounds, True) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]  # four times the sets; all pairs would be sixteen times the work


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (7, 7), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99, 200: 200}


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Zero, ONE two; {item} x", "short test item!", "short test", None, "", "one two three four five six seven eight nine"]
    items = spark.createDataFrame([(1, item), (2, "Short Test ITEM"), (3, None), (4, "..."), (2, "Short Test ITEM")], "item_id long, text string")
    repeated = frame(spark, texts).unionByName(frame(spark, texts).where("doc_id < 2")).withColumn("doc_id", F.expr("nullif(doc_id, 4)"))
    for docs in (frame(spark, texts), repeated):
        one, many = (sorted(map(repr, decontaminate.find_leaks(docs, items, pattern_bytes=size).collect())) for size in (1 << 20, 40))
        assert one == many and len(one) == docs.count()
    for size in (1 << 20, 40):  # one automaton, and several
        got = {r.doc_id: (r.n_words, [(x.first_word, x.last_word) for x in r.runs], r["items"]) for r in decontaminate.find_leaks(frame(spark, texts), items, pattern_bytes=size).collect()}
        assert got[0] == (15, [(3, 13)], ["1"]) and got[1] == (3, [(0, 2)], ["2"]) and got[2] == (2, [], []) and got[3] == got[4] == (0, [], []) and got[5] == (9, [], [])
    run = decontaminate.find_leaks(frame(spark, texts), items).where("doc_id = 0").first().runs[0]
    assert texts[0][run.start : run.end] == item
    assert decontaminate.find_leaks(frame(spark, texts), items.where("false")).where("size(runs) > 0").count() == 0


def test_warc(spark):
    big, other = "<p>" + "ä" * 700, "<p>" + "b" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3", other), (4, "u", None), (5, "u", "x"), (6, "u", "x"), (7, "a\r\nb", big)]
    path = shared_dir(spark, "warc-test")
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "id": F.lit("x"), "digest": F.lit(None).cast("string"), "n": F.lit(2)})
    warc.write_archives(warc.resolve_revisits(frame), path, file_bytes=500)
    assert spark.read.format("binaryFile").load(path).where("path like '%part-%'").count() > 2
    got = {int(r.page): r for r in warc.resolved_records(warc.read_archives(spark, path)).collect()}
    assert {p: (r.warc_type, r.refers_to_page) for p, r in got.items()} == {1: ("revisit", "7"), 2: ("revisit", "7"), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    for p, _, html in pages:
        data = (html or "").encode()
        assert (got[p].payload_bytes, got[p].payload_digest, got[p].intact) == (len(data), hashlib.sha1(data).hexdigest(), True)


def test_warc_repeated_ids_nulls_and_damage(spark, tmp_path):
    a, b = "<p>" + "a" * 2000, "<p>" + "b" * 2000
    pages = [(1, "u", a), (1, "u", b), (2, "u", a), (2, "u", a), (None, "u", b), (None, None, None), (0, "u", "z" * 300_000)]
    path = shared_dir(spark, "warc-test")
    warc.write_archives(warc.resolve_revisits(spark.createDataFrame(pages, "page_id long, url string, html string")), path)
    got = warc.resolved_records(warc.read_archives(spark, path)).collect()
    assert len(got) == len(pages) and all(r.intact for r in got)
    assert sorted((r.page or "", r.warc_type, r.refers_to_page or "", r.payload_bytes) for r in got) == sorted([("1", "revisit", "2", 2003), ("1", "response", "", 2003), ("2", "response", "", 2003), ("2", "response", "", 2003), ("", "revisit", "1", 2003), ("", "response", "", 0), ("0", "response", "", 300_000)])
    ids = [(r.record_id, r.page, r.payload_digest) for r in got]
    assert len({i for i, *_ in ids}) == len(set(ids))  # one id for whole repeated rows only
    none = shared_dir(spark, "warc-none")
    warc.write_archives(warc.resolve_revisits(spark.createDataFrame([], "page_id long, url string, html string")), none)
    assert warc.resolved_records(warc.read_archives(spark, none)).count() == 0
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"pay").hexdigest().encode() + b"\r\n"
    (tmp_path / "part-0.warc").write_bytes(b"junk\r\n" + head + b"Content-Length: 8\r\n\r\nH\r\n\r\npay\r\n\r\n" + b"WARC/1.1\r\nno length\r\n\r\n" + head + b"Content-Length: 99\r\n\r\nH\r\n\r\npay")
    read = [(r.warc_type, r.intact) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()]
    assert sorted(read) == [("damaged", False), ("damaged", False), ("response", False), ("response", True)]


def test_hot_keys_are_joined_by_broadcast(spark):
    left = spark.createDataFrame([(k, "hot") for k in range(600)] + [(600, "rare"), (601, None), (602, "none")], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("rare", 2)], "k string, v int")
    from regtext.llm.support import join_hot

    got = {r.i: r.v for r in join_hot(left, right, "k").collect()}
    assert got == {**dict.fromkeys(range(600), 1), 600: 2, 601: None, 602: None}


def test_pieces_of_unspaced_text(spark):
    p = sv.Pieces.load()
    texts = ["a," * 10**5, ",".join(f"field{k}" for k in range(20_000)), "function(a,b){return a.b.c.d(e,f)!=g%h}" * 2000, "a.b" * 5000]
    rows = {r.id: r for r in sv.decode(sv.encode(frame(spark, texts), p), p).collect()}
    e = sv.Encoder(p)
    for i, t in enumerate(texts):
        assert rows[i].decoded == t
        assert rows[i].ids[:50] == e.encode(t[:1000]).tolist()[:50]


def test_pieces_are_decoded_where_they_are_made(spark):
    from regtext.llm.stages import sentencepiece_encoding

    p, docs = sv.Pieces.load(), frame(spark, [*ODD, "Hello  world", "ΑΒγ 漢字 🎉"])
    assert sorted(sv.encode(docs, p, decoded=True).collect()) == sorted(sv.decode(sv.encode(docs, p), p).collect())
    plan = sentencepiece_encoding(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each more is a worker with a vocabulary of its own


def test_pieces(spark):
    p = sv.Pieces.load()
    texts = [*ODD, "Hello  world", " lead and trail ", "line\n\nbreak\n", "tab\tsign!! 100%,", "ΑΒγ Жук 漢字 🎉"]
    rows = {r.id: r for r in sv.decode(sv.encode(frame(spark, texts), p), p).collect()}
    e = sv.Encoder(p)
    for i, t in enumerate(texts):
        assert rows[i].decoded == (t or "") or "▁" in t
        if t and len(t) < 200:  # whole text as one cut has the same score
            whole = e.viterbi("▁" + t.replace(" ", "▁"))
            score = lambda ids: sum(p.scores[k] if k not in p.bytes_at.values() else 0 for k in ids)
            assert score(rows[i].ids) == score(whole)


def test_viterbi_is_best():
    p = sv.Pieces(["<unk>", "▁a", "b", "ab", "▁ab", "c", "bc", "a", "▁"], [0, -1, -2, -2.5, -4, -1, -1.5, -2, -3], 0, {}, set())
    score = dict(zip(p.texts, p.scores, strict=True))

    def best(s):
        table = [0.0] + [-np.inf] * len(s)
        for j in range(1, len(s) + 1):
            table[j] = max([table[i] + score[s[i:j]] for i in range(j) if s[i:j] in score] + ([table[j - 1] - 14] if s[j - 1] not in score else []))
        return table[-1]

    rng = random.Random(1)
    for _ in range(200):
        s = "▁" + "".join(rng.choice("abcz") for _ in range(rng.randint(1, 9)))
        ids = sv.Encoder(p).viterbi(s)
        assert abs(sum(p.scores[i] if i else -14 for i in ids) - best(s)) < 1e-9


def _plain(template: str) -> str:
    """A template with its original wording and all optional regions."""
    import re

    text = re.sub(r'<<var;[^<>]*?original="([^"]*)"[^<>]*>>', r"\1", template)
    return re.sub(r"<<(?:beginOptional|endOptional)[^<>]*>>", " ", text)


def test_licenses(spark):
    full = {label: _plain(t) for label, t in reversed(license_templates.TEMPLATES) if len(t) > 400}
    texts = ["x Released under the MIT License. y", "Licensed under the Apache License, Version 2.0.", "cc by nc cc by nc", None, "", "word " * 40_000 + full["mit"] + " word" * 40_000, full["bsd-3-clause"].replace("the copyright holder", "the Big Company and all of its friends"), full["bsd-3-clause"].replace("specific prior", "prior"), full["bsd-2-clause"], full["isc"], full["0bsd"], full["zlib"], full["apache-2"], full["mit"].replace("sublicense", "sell"), full["unlicense"]]
    got = {r.doc_id: (r.n_words, sorted({x.label for x in r.places}), sum(x.kind == "base" for x in r.places)) for r in license_templates.scan_licenses(frame(spark, texts)).collect()}
    assert got[0] == (7, ["mit"], 1) and got[1][1:] == (["apache-2"], 1) and got[2] == (6, ["cc-by-nc"], 2) and got[3] == got[4] == (0, [], 0)
    assert [got[i][1] for i in range(5, 15)] == [["mit"], ["bsd-3-clause"], [], ["bsd-2-clause"], ["isc"], ["0bsd"], ["zlib"], ["apache-2"], [], ["unlicense"]]
    assert license_templates.scan_licenses(frame(spark, []).where("false")).count() == 0


def test_template_markup_against_regular_expressions():
    import re

    word = lambda m: rf"(?: \w+){{{m[0]},{m[1]}}}"
    cases = [
        ('a b <<var;name="x";original="q";match=".{0,4}">> c', rf" a b{word((0, 3))} c"),
        ('a b <<var;name="x";original="q";match=".+">> c <<beginOptional;name="o">>d <<var;max=1>> a<<endOptional>>', rf" a b{word((1, 100))} c(?: d{word((0, 1))} a)?"),
        ('a <<var;name="x";original="q";match="b|c d">> a', r" a(?: b| c d) a"),
        ("a <<beginOptional>>b<<beginOptional>>c<<endOptional>><<endOptional>> d a", r" a(?: b(?: c)?)? d a"),
    ]
    rng = random.Random(2)
    for markup, pattern in cases:
        t = license_templates.Template("x", markup)
        for _ in range(400):
            words = [rng.choice("aabcd") for _ in range(rng.randint(0, 14))]
            ends = [j for j in range(1, len(words) + 1) if re.fullmatch(pattern, "".join(f" {w}" for w in words[:j]))]
            assert t.accept(words, 0) == (max(ends) if ends else None), (markup, words)
    for bad in ('a <<var;name="x";match="[0-9]+">> b', "a <<beginOptional>> b", "a <<other>> b", 'a <<var;size="3">> b', "<<var;max=3>>"):
        with pytest.raises(ValueError):
            license_templates.Template("x", bad)


def _duck(sf):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


def test_base_columns_against_sql(spark):
    from regtext.llm import queries as q

    sf = "/root/testdata/sf0.001"
    con = _duck(sf)
    phrases = "UNION ALL ".join(f"SELECT '{p}' AS p, '{label}' AS label, {len(p.split())} AS k " for p, label in license_templates.PHRASES.items())
    want = con.sql(f"""WITH d AS (SELECT doc_id, {q._WORDS} AS w FROM documents), ph AS ({phrases}),
        places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + k], ' ') = p)) AS i FROM d, ph)
        SELECT d.doc_id, len(w) AS n, count(i), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN places USING (doc_id) GROUP BY d.doc_id, w""").fetchall()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in q.op2_license_templates(spark, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[2] for r in got) > 0
    want = con.sql(r"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(v, rh, rp)),
        f AS (SELECT page_id, rh || rp AS rule, v FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) = 1)
        SELECT page_id, host, path, rule, v FROM h LEFT JOIN f USING (page_id)""").fetchall()
    got = {r.page_id: r for r in q.op5_url_trees(spark, sf).collect()}
    assert len(got) == len(want)
    for page, host, path, rule, verdict in want:
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and (rule is None) == (r.block_probability is not None)


def test_urls(spark):
    rng = random.Random(3)
    urls = [f"https://h{rng.randint(0, 50)}.{rng.choice(['example.com', 'example.net', 'x.org'])}/{rng.choice(['en', 'fr', 'es', 'de'])}/{k}?p={k}" for k in range(300)] + [None, "no scheme", "http://Example.COM", "http://WWW.example.com/en/x#y", "", "a://b?://c/d"]
    got = url_trees.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(0))).collect()
    by = {r.page_id: r for r in got}
    assert (by[302].host, by[302].path, by[302].rule) == ("example.com", "", None) and by[303].rule == "www.example.com/en/" and by[300].host == "" and len(got) == len(urls)
    for r in got:
        if r.rule:
            assert r.verdict == ("allow" if r.rule in ("com/", "www.example.com/en/") else "block")


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((url_trees.Trees().fit(x[:1500], y[:1500]).probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_quality(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "of", "river", "stone", "and", "Light."]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW$$$", "***"]) for _ in range(60)) for _ in range(150)]
    docs = frame(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 300 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id < 150) for r in held]) > 0.97
    assert {r.score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}


def test_word_vectors_against_brute_force(spark):
    import xxhash

    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ODD
    total: dict = {}
    h = lambda w: xxhash.xxh3_64_intdigest(w.lower())
    index = lambda w: quality.index_vectors(np.array([h(w)], np.uint64))[0].astype(int)
    for t in texts:
        w = (t or "").encode().split()
        for i, x in enumerate(w):
            n, s = total.get(h(x), (0, 0))
            total[h(x)] = (n + 1, s + sum((index(w[j]) for j in (i - 1, i + 1) if 0 <= j < len(w)), np.zeros(quality.DIM, int)))
    got = quality.word_vectors(frame(spark, texts).repartition(3))
    place = {int(x): k for k, x in enumerate(got.hashes)}
    assert {x for x, (n, _) in total.items() if n >= quality.LEAST} <= set(place) and not {x for x, (n, _) in total.items() if n < quality.LEAST} & set(place)
    for x, (n, s) in total.items():
        if n >= quality.LEAST:
            rooted = np.sign(s) * np.sqrt(np.abs(s))
            assert np.abs(got.vectors[place[x]] - np.round(127 * rooted / max(1e-9, np.linalg.norm(rooted)))).max() <= 1


def test_sums_leave_a_task_without_copies_of_all_of_them():
    import tracemalloc

    words = [f"w{k}" for k in range(120_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words).encode()])], ["text"])
    tracemalloc.start()
    rows, peak = sum(b.num_rows for b in quality._neighbours([batch])), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 120_000 and peak < 100e6  # 70 MB, of which the sums are 22; with copies of all of them 135

    h = np.tile(np.arange(7, dtype=np.uint64), 9000)
    n, total = np.ones(63_000, np.int64), np.tile(np.arange(quality.DIM, dtype=np.int32), (63_000, 1))
    got = [quality._sums(b) for b in quality._sum_rows(h, n, total)]
    assert sum(c[0].size for c in got) <= 14  # a hash goes on at most where _ROWS end
    for k in range(7):
        assert sum(c[1][c[0] == k].sum() for c in got) == 9000
        assert (sum(c[2][c[0] == k].sum(0) for c in got) == 9000 * np.arange(quality.DIM)).all()


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_words_that_go_on_in_the_next_batch(step):
    rng = np.random.default_rng(step)
    h = np.sort(rng.integers(-4, 4, 60) * (1 << 61)).view(np.uint64)
    n, total = rng.integers(1, 4, 60), rng.integers(-300, 300, (60, quality.DIM)) // rng.choice([1, 50, 1000], (60, 1))
    rows = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array([b"".join(next(quality._sum_rows(h[i : i + 1], n[i : i + 1], total[i : i + 1])).column(2).to_pylist()) for i in range(60)], pa.binary())], ["h", "n", "sum"])
    got = {k: (c, v) for b in quality._vectors(rows.slice(a, step) for a in range(0, 60, step)) for k, c, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)}
    want = {}
    for k in set(h.view(np.int64).tolist()):
        at = h.view(np.int64) == k
        rooted = np.sign(total[at].sum(0)) * np.sqrt(np.abs(total[at].sum(0)))
        if n[at].sum() >= quality.LEAST:
            want[k] = (n[at].sum(), np.round(rooted / np.linalg.norm(rooted) * 127).astype(np.int8).tobytes())
    assert got == want


def test_scratch_of_two_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from regtext.llm.support import materialise, scratch

    both = Barrier(2)

    def run(k):
        with scratch(spark):
            stored = materialise(spark.range(k), "numbers")
            both.wait(60)
            if k == 2:  # the other's table goes while this one is in use
                both.wait(60)
                return stored.count()
        both.wait(60)
        return k

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, (1, 2))) == [1, 2]


def test_temperature_calibrates():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    network = quality.Network().fit(x[:3000], y[:3000])
    p = network.score(x[3000:])
    loss = lambda q: -np.mean(np.where(y[3000:] > 0, np.log(q), np.log(1 - q)))
    logit = np.log(p / (1 - p)) * network.temperature
    assert loss(p) <= loss(1 / (1 + np.exp(-logit))) + 0.01 and abs(p.mean() - y[3000:].mean()) < 0.05


def test_no_label_of_a_held_out_document_is_learned(spark):
    rng = random.Random(3)
    docs = frame(spark, [" ".join(rng.choice(["a", "b", "C!", "dd"]) for _ in range(30)) for _ in range(120)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.score_quality(docs, labels).orderBy("doc_id").collect() == quality.score_quality(docs, turned).orderBy("doc_id").collect()


def test_brown(spark):
    rng = random.Random(4)
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    texts = [" ".join(rng.choice(a if k % 2 else b) for k in range(40)) for _ in range(300)] + ODD
    got = {r.doc_id: r for r in brown.score_texts(frame(spark, texts)).collect()}
    counts: dict = {}
    tokens = lambda t: [*(t or "").encode().translate(LOWER).split(), b"\n"]
    for i, t in enumerate(texts):
        if not got[i].held_out:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        w = tokens(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert abs(got[i].base_score - sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6
    held = [r for i, r in got.items() if r.held_out and i < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # classes help
    # whatever travels with the tasks, the scores are the same
    for head in (0, 12):
        for r in brown.score_texts(frame(spark, texts), head_words=head).collect():
            assert (r.n_known, r.n_tokens) == (got[r.doc_id].n_known, got[r.doc_id].n_tokens) and abs(r.score - got[r.doc_id].score) < 1e-6 and abs(r.base_score - got[r.doc_id].base_score) < 1e-6


def test_brown_probabilities_sum_to_one(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 30)]) for _ in range(20)) for _ in range(60)] + ["once only", "x y z"]
    model, rest, _, n = brown.learn(frame(spark, texts), head_words=8)
    assert np.allclose((10**model.transition).sum(1), 1)
    head = model.head
    mass = np.bincount(head.classes, 10 ** model.of_words()[1], brown.N)
    for r in rest.collect():
        mass[r["class"]] += 10 ** (np.log10(r.c + 0.5) - model.divisor[r["class"]])
    mass[brown.RARE] += 10 ** (np.log10(0.5) - model.divisor[brown.RARE])  # all unknown words
    used = np.bincount(head.classes, minlength=brown.N) + np.bincount([r["class"] for r in rest.collect()], minlength=brown.N)
    assert np.allclose(mass[used > 0], 1) and len(head.hashes) + rest.count() == n


def test_brown_assigns_words_by_their_neighbours(spark):
    rng = random.Random(8)
    # many words of two kinds that follow different markers: more words than are exchanged
    texts = [" ".join(f"{m} {k}{rng.randint(0, 900)}" for m, k in [("the", "n"), ("to", "v")] for _ in range(20)) for _ in range(400)]
    model, rest, *_ = brown.learn(frame(spark, texts))
    head = model.head
    classes = {k: np.bincount([head.classes[head.place(brown.word_hash(f"{k}{i}".encode()))] for i in range(901) if head.place(brown.word_hash(f"{k}{i}".encode())) >= 0], minlength=brown.N) for k in "nv"}
    # few classes hold words of both kinds
    assert np.minimum(classes["n"], classes["v"]).sum() < 0.1 * (classes["n"].sum() + classes["v"].sum())


def test_exchange_finds_classes():
    m = np.zeros((10, 10))
    m[:4, 8] = m[4:8, 9] = 50
    m[8:, :8] = 7
    label = brown.exchange(m, 8, classes=2)
    assert len(set(label[:4])) == len(set(label[4:8])) == 1 and label[0] != label[7]


def test_surrogates(spark):
    texts = ["Mail a.b1@x.org or A.B1@x.org, +1 (017) 555-7713 and +1-017-555-7713. Mrs. Anna Smith, 1.2.3.4, 4111111111111111", None, "", "nothing 12 here", "again a.b1@x.org", "Dr Иванов"]
    got = {r.doc_id: r for r in surrogates.replace_entities(frame(spark, texts), "k").collect()}
    assert len(got) == len(texts) and got[1].text is None and got[2].text == "" and got[3].text == texts[3] and got[0].n_entities == 7
    for gone in ("a.b1@x.org", "555-7713", "Anna Smith", "1.2.3.4", "4111111111111111"):
        assert gone not in got[0].text
    mail = got[4].text.split()[1]
    assert got[0].text.count(mail) == 2 and mail.endswith(".org")
    card = got[0].text.rsplit(" ", 1)[1]
    digits = [int(c) for c in card][::-1]
    assert len(card) == 16 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert surrogates.replace_entities(frame(spark, texts), "other").where("doc_id = 4").first().text != got[4].text


def test_widest_places_are_those_of_all_pairs():
    rng = random.Random(8)
    for _ in range(400):
        places = [(rng.choice("abc"), i := rng.randrange(12), i + rng.randrange(8)) for _ in range(rng.randrange(12))]
        want = [p for p in places if not any(q[0] != p[0] and q[1] <= p[1] and p[2] <= q[2] and q[2] - q[1] > p[2] - p[1] for q in places)]
        assert license_templates._widest(places) == want
    many = [("abc"[k % 3], 5 * k, 5 * k + 3) for k in range(200_000)]
    assert license_templates._widest(many) == many


def _script(c):
    import unicodedata

    return unicodedata.name(c, "?").split(" ")[0].replace("CJK", "HAN")


def test_surrogates_keep_their_script(spark):
    import unicodedata

    upper = lambda letters: [c for c in letters if c.upper() != c and len(c.upper()) == 1]
    greek = [chr(c) for c in range(0x386, 0x3CF) if unicodedata.category(chr(c)) in ("Lu", "Ll")]
    cyrillic = [chr(c) for c in range(0x400, 0x460) if unicodedata.category(chr(c)) in ("Lu", "Ll")]
    uncased = [chr(c) for a, b in ((0x5D0, 0x5EB), (0x4E00, 0x4E40), (0xE01, 0xE2F)) for c in range(a, b) if unicodedata.category(chr(c)) == "Lo"]
    # every letter behind a capital of its script, in a name and in a mail address
    texts = [f"Dr {upper(group)[0].upper()}{c}{c.lower()}" for group in (greek, cyrillic) for c in group] + [f"{c}{c}@x.jp" for c in greek + cyrillic + uncased]
    texts += ["Dr Κωνσταντίνος", "Herr Фёдор Ёлкин", "山田太郎@example.jp", "Frau Μαρία Παππά", "Mme Éléonore Çelik"]
    got = {r.doc_id: r.text for r in surrogates.replace_entities(frame(spark, texts), "k").collect()}
    for i, t in enumerate(texts):
        # a mail address's host is new, and names may be longer after a collision
        own, new = (t.partition("@")[0], got[i].partition("@")[0]) if "@" in t else (t.partition(" ")[2], got[i].partition(" ")[2])
        assert {_script(c) for c in own if c.isalpha()} == {_script(c) for c in new if c.isalpha()}, (t, got[i])
        assert own != new and ("@" in t or own[0].isupper() == new[0].isupper()), (t, got[i])  # mail addresses are lower case
    assert got[len(texts) - 2].split()[1] in surrogates.FOREIGN["Greek"]["f"] and got[len(texts) - 4].split()[1] in surrogates.FOREIGN["Cyrillic"]["m"]


def test_a_person_is_one_whatever_its_title(spark):
    texts = ["Mrs. Anna Smith met Dr Anna Smith and Prof. Anna Smith. Then Anna Smith, not Anna Smithson, spoke.", "Mr. Karl Ott. Then Karl Ott spoke. Karl Ott-Heim too.", "Mr Lee and Mrs Lee and Dr Lee", "Dr Anna Smith again"]
    got = {r.doc_id: r.text for r in surrogates.replace_entities(frame(spark, texts), "k").collect()}
    name = got[0].removeprefix("Mrs. ").split(" met ")[0]
    assert name.split()[0] in surrogates.NAMES["f"] and got[0] == f"Mrs. {name} met Dr {name} and Prof. {name}. Then {name}, not Anna Smithson, spoke."
    assert got[3] == f"Dr {name} again"
    other = got[1].removeprefix("Mr. ").split(".")[0]
    assert other.split()[0] in surrogates.NAMES["m"] and got[1] == f"Mr. {other}. Then {other} spoke. Karl Ott-Heim too."
    assert len({got[2].split()[k] for k in (1, 4, 7)}) == 3


def test_addresses_stay_addresses(spark):
    rows = [(f"{a}.{b}.{c}.{d}",) for a in range(1, 9) for b in range(6) for c in range(6) for d in range(6)]
    entities = spark.createDataFrame(rows, "entity string").withColumn("kind", F.lit("address"))
    for turn in (0, 3, 9):
        drawn = [r.core for r in surrogates.draw(entities.withColumn("turn", F.lit(turn)), "k").collect()]
        assert all(len(p := x.split(".")) == 4 and all(0 < int(o) < 256 for o in p) for x in drawn)


def test_every_replacement_has_the_format_of_its_entity(spark):
    """A whole table: the same kinds of entities at the same places, with the same shape, and everything between them as it was."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.text for r in surrogates.replace_entities(docs, "k").collect()}
    shape = lambda x: regex.sub(r"\d", "0", x)
    n = 0
    for i, t in docs.collect():
        old, new = regex.findall(surrogates.ENTITY, t or ""), regex.findall(surrogates.ENTITY, got[i] or "")
        assert len(old) == len(new), (old, new)
        for a, b in zip(old, new, strict=True):
            n += 1
            assert a != b and ("@" in a) == ("@" in b) and {_script(c) for c in a.partition("@")[0] if c.isalpha()} <= {_script(c) for c in b if c.isalpha()} | {"LATIN"}
            if a[0] == "+" or (a[0].isdigit() and "." not in a and "@" not in a):
                assert shape(a) == shape(b)[: len(shape(a))]
    assert n > 50


def test_collisions_are_drawn_again(spark):
    # a dense format (one-letter mail names) and an address space with room
    letters = [("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"] + [("person", f"f:{a}{b}") for a in "aeiou" for b in "bcdfghjkl"]
    entities = spark.createDataFrame([("address", f"1.2.3.{i}") for i in range(250)] + letters, "kind string, entity string")
    rows = surrogates.cores(entities, "k").collect()
    assert len({(r.kind, r.core) for r in rows}) == len(rows) == 250 + len(letters) and not {r.core for r in rows} & {r.entity for r in rows}


def test_surrogates_against_brute_force(spark):
    import regex

    rng = random.Random(11)
    some = ["a@b.co", "A@B.co", "c.d+e@mail.example.net", "+49 30 1234 5678", "+49-30-1234-5678", "10.0.0.1", "255.1.2.3", "4111 1111 1111 1111", "Mr. Karl Ott", "Frau Eva Öz", "Prof Κωνσταντίνος", "Dr. Иван Петров", "Señora O'Neil"]
    filler = ["word", "12", "x@", "@y", "1.2.3", "+1", "Mr", ",", "Ж", "𝔘", "1.2.3.4.5"]
    texts = [" ".join(rng.choice(some if rng.random() < 0.4 else filler) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    texts += [None, "", "z@" + "a." * 100_000 + "org", " ".join(f"u{k}@h.org" for k in range(5000)), "x" * 200_000 + "@", "a.b-c " * 30_000] + texts[:5]
    got = {r.doc_id: r for r in surrogates.replace_entities(frame(spark, texts).withColumns({"at": F.lit(1), "put": F.lit(2), "kinds": F.lit(3)}), "k").collect()}
    assert len(got) == len(texts)
    known: dict = {}
    for i, t in enumerate(texts):
        found = regex.findall(surrogates.ENTITY, t or "")
        assert got[i].n_entities == len(found)
        if not found:
            assert got[i].text == t
            continue
        # the stretches between the entities stand where they stood
        rest, pieces = got[i].text, regex.split(surrogates.ENTITY, t)
        # but for names of two words or more without their title, which go as well
        names = {x.partition(" ")[2] for x in found if regex.fullmatch(surrogates.PERSON, x) and x.count(" ") > 1}
        assert not any(n in rest for n in names)
        assert any(n in pieces[0] for n in names) or rest.startswith(pieces[0])
        assert any(n in pieces[-1] for n in names) or rest.endswith(pieces[-1])
        if len(set(pieces[1:-1])) <= 1 and pieces[1:-1] and len(found) > 1 and pieces[0] == pieces[-1] == "":
            parts = rest.split(pieces[1])
            if len(parts) == len(found):
                for value, put in zip(found, parts, strict=True):
                    assert known.setdefault(value.lower(), put) == put
    assert len(known) > 4000 and len(set(known.values())) == len(known)  # one for each, and different ones
