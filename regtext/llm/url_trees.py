"""URL filter: rules first, and gradient-boosted trees on lexical features for what no rule judges.

Rules are matched with Spark functions. The trees learn from urls that a rule has judged (or from given
labels). The share of blocked urls of each suffix, and of each suffix with first directory, is counted over all
of them, repeated ones once, and joined to the urls as features; a directory without judged urls has its suffix's share. An url whose
suffix no rule has judged is left to trees of its own, fitted without shares, so that no other suffix's labels stand in for it.
Both kinds of labels weigh the same in a fit: what is blocked most does not become the verdict where nothing is known. A sample of at most SAMPLE distinct urls, the first
in order of a hash, goes to the driver, which fits histogram trees with numpy; scoring runs in the tasks. An url that
the trees are fitted on takes its shares from the other FOLDS of urls, so that no share holds its own label.

Defined results: block_probability is one of equally many urls of both kinds, and more than one half is ``block``; urls that a rule judges have no probability; a null url or one without ``://`` has empty host and path and fits no rule; without labelled
urls of both kinds the verdict for the rest is the only kind seen, or ``allow``; repeated rows get equal
verdicts; an empty table gives an empty result; extra columns are kept out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.support import map_batches, materialise

# Verdict, host and path of each rule.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Labelled urls that the trees are fitted on, at most.
SAMPLE = 20_000
#: A key with more than one row in HOT takes its share from a broadcast; there are fewer than HOT of them.
HOT = 256
#: Distinct judged urls that a key needs for a share of its own, and the weight of the prior in it.
SEEN = 5
#: Parts of the judged urls; the shares for urls of one are counted over the others.
FOLDS = 5
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 32, 0.3, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct of the longest fitting rule and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _parts(url: str) -> tuple[str, str, str]:
    rest = url.partition("://")[2]
    head, _, query = rest.partition("#")[0].partition("?")
    host, slash, path = head.partition("/")
    return host.lower(), slash + path, query


def suffix_of(host: str) -> str:
    """The last label without a port; two labels where the last is a country's and one of three letters at most stands before it (co.uk); ``ip`` for numbers."""
    labels = host.rpartition("@")[2].partition(":")[0].rstrip(".").split(".")
    if labels[-1].isdigit() or "[" in host:
        return "ip"
    return ".".join(labels[-2:]) if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else labels[-1]


def keys_of(url: str) -> tuple[str, str]:
    """What statistics are kept of: the host's suffix, and suffix and first directory together."""
    host, path, _ = _parts(url)
    suffix = suffix_of(host)
    return suffix, f"{suffix}/{path.strip('/').partition('/')[0]}"


def lexical(url: str) -> list[float]:
    host, path, query = _parts(url)
    digits = sum(c.isdigit() for c in url)
    return [len(url), len(host), len(path), path.count("/"), digits / max(1, len(url)), _entropy(url), _entropy(host), query.count("=") + query.count("&"), len(query), host.count("."), url.count("-"), float("#" in url), float(url.startswith("https")), float("." in path.rpartition("/")[2])]


class Trees:
    """Logistic gradient boosting over binned features; a tree is a list of (feature, edge, left, right) or leaf values."""

    def __init__(self, bias: float = 0.0) -> None:
        self.bias, self.trees = bias, []

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        score = np.full(len(y), self.bias)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self._grow(tree, binned, edges, weight * (y - q), weight * q * (1 - q), np.arange(len(y)), depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, tree: list, binned, edges, grad, hess, rows, depth: int) -> int:
        at = len(tree)
        g, h = grad[rows].sum(), hess[rows].sum()
        tree.append((-1, 0.0, RATE * g / (h + 1.0), 0))
        best = (1e-6, None)
        if depth and len(rows) >= 2 * LEAST:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[f][rows]
                n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
                if gain[k := int(gain.argmax())] > best[0]:
                    best = (gain[k], (f, k))
        if best[1]:
            f, k = best[1]
            left = binned[f][rows] <= k
            a = self._grow(tree, binned, edges, grad, hess, rows[left], depth - 1)
            b = self._grow(tree, binned, edges, grad, hess, rows[~left], depth - 1)
            tree[at] = (f, float(edges[f][k]), a, b)
        return at

    @staticmethod
    def _apply(tree: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, edge, a, b = tree[at]
            if f < 0:
                out[rows] = a
            else:
                left = x[rows, f] <= edge
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for t in self.trees:
            score += self._apply(t, x)
        return 1 / (1 + np.exp(-np.clip(score, -60, 60)))


class Judge:
    """Trees for urls whose suffix has a share, and trees on lexical features alone for all others."""

    def __init__(self, shared: Trees, lone: Trees) -> None:
        self.shared, self.lone = shared, lone

    @staticmethod
    def features(url: str, suffix_share: float | None, folder_share: float | None) -> list[float]:
        """Lexical features; behind them both shares, if the suffix has one."""
        known = [] if suffix_share is None else [suffix_share, suffix_share if folder_share is None else folder_share]
        return lexical(url) + known

    def probability(self, rows: list[tuple[str, float | None, float | None]]) -> np.ndarray:
        out = np.zeros(len(rows))
        for trees, known in ((self.shared, True), (self.lone, False)):
            at = [i for i, r in enumerate(rows) if (r[1] is not None) == known]
            if at:
                out[at] = trees.probability(np.array([self.features(*rows[i]) for i in at]))
        return out


def _trees(x: list[list[float]], blocked: list[bool]) -> Trees:
    y = np.array(blocked, float)
    if not 0 < y.sum() < len(y):
        return Trees(20.0 if len(y) and y[0] else -20.0)
    return Trees().fit(np.array(x), y)


def learn(rows: list[tuple[str, float | None, float | None]], blocked: list[bool]) -> Judge:
    """Trees for the probability of block, from urls with their shares."""
    lone = _trees([lexical(r[0]) for r in rows], blocked)
    known = [i for i, r in enumerate(rows) if r[1] is not None]
    return Judge(_trees([Judge.features(*rows[i]) for i in known], [blocked[i] for i in known]) if known else lone, lone)


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [keys_of(u or "") for u in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())], [*b.schema.names, "suffix", "folder"])


def with_keys(rows: DataFrame) -> DataFrame:
    """rows, whose first column is the url, with the two keys of each."""
    return map_batches(rows, _keyed, T.StructType([*rows.schema, T.StructField("suffix", T.StringType()), T.StructField("folder", T.StringType())]))


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(FOLDS)).cast("int")


def shares_of(judged: DataFrame) -> tuple[DataFrame, float]:
    """key, smoothed share of blocked among the distinct judged urls, and the shares without each fold (null below SEEN urls), for each key with SEEN of them; and the share of all."""
    total = judged.agg(F.avg(F.col("blocked").cast("double"))).first()[0]
    prior = float(total) if total is not None else 0.0
    share = lambda bad, seen: F.when(seen >= SEEN, (bad + SEEN * prior) / (seen + SEEN))
    rows = judged.select("blocked", fold_of(F.col("url")).alias("fold"), F.explode(F.array("suffix", "folder")).alias("key"))
    outside = [F.struct(F.count_if(F.col("fold") != k).alias("seen"), F.count_if(F.col("blocked") & (F.col("fold") != k)).alias("bad")) for k in range(FOLDS)]
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("seen"), F.count_if("blocked").alias("bad"), F.array(*outside).alias("outside")).where(F.col("seen") >= SEEN)
    return counts.select("key", share(F.col("bad"), F.col("seen")).alias("share"), F.transform("outside", lambda o: share(o["bad"], o["seen"])).alias("folds")), prior


def with_shares(rows: DataFrame, shares: DataFrame, prior: float | None, learning: bool = False) -> DataFrame:
    """rows (stored, with their keys) with the shares of both keys; without one the prior (which may be null). learning: shares that the fold of the url had no part in."""
    least = rows.count() / HOT
    out = rows
    for key in ("suffix", "folder"):
        named = shares.select(F.col("key").alias(key), F.col("share").alias(f"{key}_share"), F.col("folds").alias(f"{key}_folds"))
        many = rows.groupBy(key).count().where(F.col("count") > least).select(key)
        hot = rows.sparkSession.createDataFrame(many.join(named, key, "left").collect(), named.schema)
        near = out.join(F.broadcast(hot), key)
        far = out.join(F.broadcast(hot.select(key)), key, "left_anti").join(named, key, "left")
        out = near.unionByName(far)
        if learning:
            out = out.withColumn(f"{key}_share", F.get(f"{key}_folds", fold_of(F.col("url"))))
        out = out.drop(f"{key}_folds")
        if prior is not None:
            out = out.fillna(prior, [f"{key}_share"])
    return out


def _judge(judge: Judge):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, x, y = (b.column(k).to_pylist() for k in ("url", "suffix_share", "folder_share"))
            open_ones = [i for i, ruled in enumerate(b.column("ruled").to_pylist()) if ruled is None]
            p: list[float | None] = [None] * len(urls)
            for i, q in zip(open_ones, judge.probability([(urls[i] or "", x[i], y[i]) for i in open_ones]).tolist(), strict=True):
                p[i] = q
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "block_probability"])

    return run


def fitted(judged: DataFrame, shares: DataFrame, sample: int = SAMPLE) -> Judge:
    """Trees fitted on a sample of judged urls (stored, distinct, with their keys)."""
    taken = materialise(judged.orderBy(F.xxhash64("url"), "url", "blocked").limit(sample), "sample")
    learned = with_shares(taken, shares, None, learning=True).select("url", "blocked", "suffix_share", "folder_share").collect()
    learned.sort(key=lambda r: (r[0], r[1]))
    return learn([(r[0], r[2], r[3]) for r in learned], [r[1] for r in learned])


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """id, host, path, rule, verdict and block_probability of every url. labelled: url, blocked (boolean); by default the urls a rule judges."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(id_col).alias("id")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("url", "id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    rows = materialise(with_keys(rows), "urls")
    source = labelled.select("url", "blocked") if labelled is not None else rows.where("ruled is not null").select("url", (F.col("ruled") == "block").alias("blocked"))
    judged = materialise(with_keys(source.where("url is not null and blocked is not null").distinct()), "judged")
    shares = materialise(shares_of(judged)[0], "shares")
    judge = fitted(judged, shares, sample)
    rows = with_shares(rows, shares, None)
    judged = map_batches(rows, _judge(judge), T.StructType([*rows.schema, T.StructField("block_probability", T.DoubleType())]))
    verdict = F.coalesce("ruled", F.when(F.col("block_probability") > 0.5, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_probability")
