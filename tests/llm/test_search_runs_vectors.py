"""Ranked search, periodic runs and near-duplicate vectors against brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regtext.llm import impact_index, periodic_runs, queries, sign_hash

CLASHES = ["id", "query", "n", "terms", "counts", "runs", "vec", "node", "keys", "least", "size", "v", "rank", "score"]


def with_clashes(df):
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES) if c not in df.columns})


# ranked search


def best_documents(docs, items, k=10):
    terms = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c in counted:
            s = 0
            for t in set(terms(text)) & set(c):
                m = 10 + (90 * sum(c.values()) * n_docs) // total
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)}
    return out


@pytest.mark.parametrize("seed,postings,query_bytes", [(1, 10**6, 10**6), (2, 40, 10**6), (3, 200, 60)])
def test_ranked_search(spark, seed, postings, query_bytes):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["ñandú", "x_y", "a-b", "ÄÖ"]
    text = lambda n: " ".join(words[min(63, int(rng.expovariate(0.1)))] for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 100]))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[3][1]), (2000, None), (2001, ""), (7, docs[7][1])]
    items = [(f"q{i}", text(rng.choice([1, 3, 20]))) for i in range(25)] + [("none", None), ("empty", "  ")]
    frame = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    asked = with_clashes(spark.createDataFrame([*items, items[0], (None, "W1")], "item_id string, text string"))
    got = impact_index.ranked_search(frame, asked, postings=postings, query_bytes=query_bytes)
    rows = [tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == best_documents(docs, items)


def test_search_stops_early_and_stays_exact():
    """Postings in levels: a clear winner ends the search before the frequent terms are read."""
    rng = np.random.default_rng(1)
    entries = [(100, np.unique(rng.integers(0, 40, 25)), None) for _ in range(500)]
    entries = [(n, t, rng.integers(1, 4, len(t))) for n, t, _ in entries]
    index = impact_index.Index(entries, [[k] for k in range(500)], 500, 50_000)
    weights = {t: int(w) for t, w in enumerate(rng.integers(1, 5000, 40))}
    exact = sorted(((index.score(k, weights), k) for k in range(500)), reverse=True)
    found = sorted(index.best(weights, 10), reverse=True)
    assert found[:10] == exact[:10] and len(found) <= 40
    assert index.best(weights, 10, exact[0][0] + 1) == []


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert impact_index.ranked_search(docs, items).collect() == []
    assert impact_index.ranked_search(items.select(F.col("item_id").alias("doc_id"), "text"), items.limit(0)).collect() == []
    assert impact_index.ranked_search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


# periodic runs


def all_runs(words, least):
    out = set()
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            n = j + p - i
            if n >= max(least, 2 * p) and all(any(words[k] != words[k + q] for k in range(i, i + n - q)) for q in range(1, p)):
                out.add((i, n, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs(least):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 6, 25, 90])
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, n)
                words = words[:a] + (words[a : a + p] * n)[: n - a]
            texts.append(words)
        assert [[tuple(r) for r in x.tolist()] for x in periodic_runs.find_runs(texts, least)] == [all_runs(w, least) for w in texts]


def test_periodic_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.choice([1, 15, 40, 200])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "a b c " * 30), (5, "x " * 5000), (5, "x " * 5000), (1003, "é ü " * 40 + "𝔘 b")]
    with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = all_runs(w, 12)
        gone = {k for a, m, p in runs for k in range(a + p, a + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        want[i, len(runs), *best, milli, hashlib.sha256("".join(f"{a},{m},{p}\n" for a, m, p in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert sum(c for (i, n, *_), c in want.items() if n and i is not None and i < 300) > 10
    assert Counter(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()) == want
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# near-duplicate vectors


def linked(rows, cosine):
    units = []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(1)
        ok = i is not None and np.isfinite(x).all() and x.any()
        units.append(x / np.abs(x).max() / np.sqrt(((x / np.abs(x).max()) ** 2).sum()) if ok else None)
    n = len(rows)
    edges = [(a, b) for a in range(n) for b in range(a) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine]
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for a, b in edges:
        links[a] += 1
        links[b] += 1
        up[root(a)] = root(b)
    least: dict = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return Counter((rows[k][0], links[k], c := least.get(root(k)), True if c is None else c == rows[k][0]) for k in range(n))


@pytest.mark.parametrize("seed,block,kind", [(1, 2048, "float"), (2, 7, "double"), (3, 3, "float")])
def test_vectors(spark, seed, block, kind):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 16))
    rows = [(k, c.tolist()) for k, c in enumerate(centres)]
    rows += [(100 + k, (centres[k % 5] + rng.standard_normal(16) * 0.12).tolist()) for k in range(80)]
    rows += [(300 + k, centres[0].tolist()) for k in range(30)] + [(7, centres[9].tolist())]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [None, *[1.0] * 15]), (904, [float("nan")] * 16), (None, centres[0].tolist()), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] + [1.0] * 15)]
    rows += [(908, (centres[3] * 1e-30).tolist()), (910, [1e-3, -0.0]), (911, [1e-3, 0.0])]
    rows += [(909, (centres[3] * 1e300).tolist())] if kind == "double" else []
    df = with_clashes(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).repartition(3)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sign_hash.near_duplicate_vectors(df, recall=1 - 1e-9, block=block)
    assert Counter(tuple(r) for r in got.collect()) == linked(exact, 0.9)
    assert sign_hash.near_duplicate_vectors(df.where("false")).collect() == []


def test_recall_at_the_threshold():
    """Of pairs right at the threshold the share that meets in some table is what was asked for."""
    rng = np.random.default_rng(5)
    bits, tables = sign_hash.plan(50_000, 0.9, 0.95)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 32))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.9 * x + math.sqrt(1 - 0.81) * y
    p = sign_hash.planes(32, bits * tables, 7)
    same = ((x @ p > 0) == (near @ p > 0)).reshape(4000, tables, bits).all(2).any(1)
    assert 0.9 < same.mean() < 0.99
