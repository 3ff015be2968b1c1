"""Jaccard join of n-gram sets with a prefix tree.

1. Every text becomes a set of 64-bit n-gram hashes. Texts with equal sets form a class, which goes on as one
   set; a map task that meets a set again sends nothing for it.
2. Candidates at PARTS_FROM percent and above: a set is cut into parts by ranges of the hash space, one more than grams by
   which similar sets of its band of sizes can differ, so two that are similar have a part in common, gram by gram.
   Hashes of parts are what is exchanged. By chance sets share single grams, and the more of them the larger the
   corpus is; they seldom share a part of six, so what follows grows with the near copies only.
   Below that, parts would be too small. There the global order is: rare grams first. The document frequency is counted
   for grams in a fixed share of the hash
   space, which always holds a set's prefix (its first n - ceil(needed overlap) + 1 grams: two sets that are
   similar enough share a gram of both prefixes); grams beyond that share come later, in order of their hash.
   Postings are exchanged as packed arrays. A gram (or part) that is frequent within one map task's block sends a mark
   instead of its postings and comes last in the order, so no hot gram is collected anywhere.
3. Sets of similar size that share a part, or a gram of their prefixes, are candidates: star edges from the least set of
   each, then connected components. Most sets have only parts or prefix grams of their own and end here.
   Only texts that a bitmap of the candidates' ids lets through move.
4. The sets of a candidate component are stored in a trie (split into blocks of bounded size). All sets that meet in a
   block stand in one order, rare grams of the block first and ties by hash. A set enters the trie where a gram of its prefix
   stands in a stored prefix and goes down sharing the overlap of common beginnings; subtrees end by the
   remaining-length bound and where all is linked already.
5. A component of more than two blocks is joined block by block with itself and block 0. What its largest group has
   not taken in then meets the sets with which it shares a part or a gram of both prefixes, in blocks again, those with equal
   lists of sets once; so a component that hangs together by chance is not joined block by block.
6. Links between classes give the final components; every document takes that of its class.

Defined results: null and empty texts have an empty set and are linked with nothing; a text with fewer words
than n is one gram; repeated rows are copies of each other; an empty table gives an empty result; extra
columns are ignored; ties cannot occur, as a component's id is its smallest document id; rows
without an id are linked with rows of equal sets only. Ids should be unique: of rows that share one, those with
another set are read and left out again where the sets are compared.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.components import components
from regtext.llm.support import LOWER, join_hot, map_batches, marked, materialise, partitions, remove, shared_dir, text_bytes, with_row_key

#: Postings of a gram within one flush of a map task from which the gram counts as hot.
HOT = 64
#: Grams after which a map task flushes its postings.
FLUSH = 1_500_000
#: Grams in the trie of one block.
BLOCK_GRAMS = 1_000_000
#: Frequency class of hot grams: behind all others of the counted share; those beyond the share come after them.
LAST = 1 << 40
#: Percent of similarity from which sets are searched by their parts.
PARTS_FROM = 85
#: Largest over smallest size of a band, as a power of 1 / t: narrow bands send more sets twice, wide ones make small parts.
BAND = 3
#: Grams of a part that may be left out, and the share of parts that are there to make up for it.
SMALL, SPARE = 1, 0.04


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_set(text: bytes, n: int, words: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words."""
    h = np.array([words[w] for w in text.translate(LOWER).split()], np.uint64)
    if not len(h):
        return h
    size = min(n, len(h))
    grams = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        grams = _mix(grams + h[k : len(h) - size + 1 + k] + np.uint64(k + 1))
    return np.unique(grams)


class Bounds:
    """What a similarity of at least t (a fraction) asks for."""

    def __init__(self, percent: int) -> None:
        self.t = Fraction(percent, 100)
        # the share of the hash space that is counted: somewhat more than a prefix
        self.share = min(1.0, float(1 - self.t) * 1.25 + 0.01)
        self.by_parts = percent >= PARTS_FROM
        self.edge = np.uint64((1 << 32) - 1 if self.by_parts else min((1 << 32) - 1, int(self.share * 2**32))) << np.uint64(32)
        self.firsts = [1]  # the smallest size of each band

    def prefix(self, size: int) -> int:
        return size - ceil(self.t * size) + 1

    def overlap(self, a: int, b: int) -> int:
        """|A & B| >= t * |A | B| with whole numbers."""
        return ceil(self.t * (a + b) / (1 + self.t))

    def sent(self, grams: np.ndarray) -> np.ndarray:
        """The hashes of a set that take part in the search: of its parts, or all grams in the counted share, and the prefix at least."""
        if self.by_parts:
            return self.parts(grams)
        return grams[: max(int(np.searchsorted(grams, self.edge)), self.prefix(len(grams)))] if len(grams) else grams


    def band(self, size: int) -> int:
        while self.firsts[-1] <= size:
            self.firsts.append(max(self.firsts[-1] + 1, ceil(self.firsts[-1] / self.t**BAND)))
        return bisect_right(self.firsts, size) - 1

    def differ(self, band: int) -> int:
        """The most grams that are in one of two similar sets only, where the smaller one is in this band."""
        most = self.firsts[band + 1] - 1
        return floor((most + floor(most / self.t)) * (1 - self.t) / (1 + self.t))

    def parts(self, grams: np.ndarray) -> np.ndarray:
        """Hashes of a set's parts, in its band and in those of smaller sets that may be similar.

        Of d + 1 + s parts, similar sets have 1 + s alike, where they differ by d grams at most. So a set may leave out its
        parts of SMALL grams or less, if there are no more than s: one of those alike is larger then, and the other set has it too.
        """
        size, out = len(grams), []
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(grams))])
        for band in range(self.band(ceil(self.t * size)), self.band(size) + 1) if size else ():
            differ = self.differ(band)
            if not differ:  # similar sets are equal, and these are one class
                continue
            spare = int(SPARE * (differ + 1) + 0.5)
            number = differ + 1 + spare
            counts = np.bincount(((grams >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int64), minlength=number)
            ends = np.cumsum(counts)
            held = _mix(sums[ends] - sums[ends - counts] + np.uint64(band + 1))
            held = _mix(held + np.arange(number, dtype=np.uint64))
            small = counts <= SMALL
            out.append(held[~small] if small.sum() <= spare else held)
        return np.concatenate([np.zeros(0, np.uint64), *out])


def set_key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)) - (1 << 63)


def _sets(n: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, words, seen = Bounds(percent), WordHash(), set()
        for b in batches:
            keys, sizes, sent = [], [], []
            for text in b.column(1).to_pylist():
                grams = gram_set(text, n, words)
                key = set_key(grams) if len(grams) else None
                keys.append(key)
                sizes.append(len(grams))
                new = key is not None and key not in seen
                sent.append(bounds.sent(grams).tobytes() if new else None)
                if new:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sent, pa.binary())], ["id", "key", "n", "sent"])

    return run


_PACKED = "bucket int, kind int, grams binary, keys binary"


def _packed(bucket: int, kind: int, grams: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([grams.tobytes()], pa.binary()), pa.array([keys.tobytes()], pa.binary())], ["bucket", "kind", "grams", "keys"])


def _postings(buckets: int, edge: np.uint64, hot_at: int, flush_at: int):
    """Packed postings by range of the gram's hash; kind 0: postings, 1: marks of hot grams, 2: postings of hot grams (any bucket)."""

    def flush(grams: list[np.ndarray], keys: list[np.ndarray], turn: int) -> Iterator[pa.RecordBatch]:
        g, k = np.concatenate(grams), np.concatenate(keys)
        order = np.argsort(g, kind="stable")
        g, k = g[order], k[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        count = np.diff(np.concatenate([first, [len(g)]]))
        hot = np.repeat(count >= hot_at, count)
        bucket = np.minimum((g >> np.uint64(32)) * np.uint64(buckets) // ((edge >> np.uint64(32)) + np.uint64(1)), np.uint64(buckets - 1)).astype(np.int64)
        cold_g, cold_k, cold_b = g[~hot], k[~hot], bucket[~hot]
        cuts = np.searchsorted(cold_b, np.arange(buckets + 1))
        for i in range(buckets):
            if cuts[i + 1] > cuts[i]:
                yield _packed(i, 0, cold_g[cuts[i] : cuts[i + 1]], cold_k[cuts[i] : cuts[i + 1]])
        if hot.any():
            marks, where = g[first[count >= hot_at]], bucket[first[count >= hot_at]]
            for i in np.unique(where):
                yield _packed(int(i), 1, marks[where == i], np.zeros(0, np.int64))
            hot_g, hot_k = g[hot], k[hot]
            for j, a in enumerate(range(0, len(hot_g), 20_000)):
                yield _packed((turn + j) % buckets, 2, hot_g[a : a + 20_000], hot_k[a : a + 20_000])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, keys, held, turn = [], [], 0, TaskContext.get().partitionId() * 7
        for b in batches:
            for key, sent in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = np.frombuffer(sent, np.uint64)
                grams.append(g)
                keys.append(np.full(len(g), key, np.int64))
                held += len(g)
            if held >= flush_at:
                yield from flush(grams, keys, turn)
                grams, keys, held, turn = [], [], 0, turn + 1
        if held:
            yield from flush(grams, keys, turn)

    return run


_SHARED = "key long, gram long, df long"


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: postings of grams that several sets have, with their frequency; hot ones have the frequency LAST."""
    grams, keys, marks = [], [], []

    def rows(g: np.ndarray, k: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(g), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 50_000]), pa.array(g[a : a + 50_000].view(np.int64)), pa.array(df[a : a + 50_000])], ["key", "gram", "df"])

    for b in batches:
        for kind, g, k in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
            g, k = np.frombuffer(g, np.uint64), np.frombuffer(k, np.int64)
            if kind == 2:
                yield from rows(g, k, np.full(len(g), LAST, np.int64))
            elif kind == 1:
                marks.append(g)
            else:
                grams.append(g)
                keys.append(k)
    if not grams:
        return
    g, k = np.concatenate(grams), np.concatenate(keys)
    grams, keys = [], []
    order = np.lexsort((k, g))
    g, k = g[order], k[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])  # a set that two map tasks have sent
    g, k = g[new], k[new]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    count = np.diff(np.concatenate([first, [len(g)]]))
    df = np.repeat(count, count).astype(np.int64)
    if marks:
        df[np.isin(g, np.concatenate(marks))] = LAST
    shared = df > 1
    yield from rows(g[shared], k[shared], df[shared])


def _candidates(classes: DataFrame, bounds: Bounds, buckets: int, hot: int, flush: int) -> tuple[DataFrame, DataFrame]:
    """Star edges (a, b) between nodes whose sets share a part or a gram of their prefixes, and these (gram, band, key, node).

    By parts, a node is a set, and parts of different bands differ. By prefixes, a node is a set in one band of sizes: similar
    sets are in the same band or in neighbouring ones, so each set stands in its own band and in the one below, and sets of
    different sizes don't meet.
    """
    packed = map_batches(classes.select("key", "sent"), _postings(buckets, bounds.edge, hot, flush), _PACKED)
    shared = map_batches(packed.repartitionById(buckets, F.col("bucket")), _shared, _SHARED)
    if bounds.by_parts:
        kept = shared.select("key", F.lit(0).alias("band"), "gram", F.col("key").alias("node")).distinct()
    else:
        kept = _prefixes(classes, shared, bounds)
    kept = materialise(kept, "prefixes")
    hubs = kept.groupBy("gram", "band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    return kept.join(hubs, ["gram", "band"]).where("a <> node").select("a", F.col("node").alias("b")), kept


def _prefixes(classes: DataFrame, shared: DataFrame, bounds: Bounds) -> DataFrame:
    """key, band, gram, node: the grams of prefixes that several sets have."""
    # of a set's grams that are sent, those that no other set has come first
    sizes = classes.select("key", "n", (F.octet_length("sent") / 8).cast("long").alias("sent"))
    t = float(bounds.t)
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9)) + 1
    inside = F.when(F.shiftrightunsigned("gram", 32) < F.lit(int(bounds.edge >> np.uint64(32))), F.col("df")).otherwise(F.lit(LAST + 1))
    lists = shared.groupBy("key").agg(F.collect_set(F.struct(inside.alias("df"), "gram")).alias("grams"))
    left = (prefix - (F.col("sent") - F.size("grams"))).cast("int")
    kept = lists.join(sizes, "key").withColumn("left", left).where("left > 0")
    width = -np.log(t) + 1e-6
    band = F.floor(F.log(F.col("n")) / F.lit(float(width))).cast("int")
    kept = kept.select("key", band.alias("band"), F.explode(F.slice(F.array_sort("grams"), F.lit(1), F.col("left"))).alias("g"))
    kept = kept.select("key", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("g.gram").alias("gram"))
    return kept.withColumn("node", F.xxhash64("key", "band"))


class Trie:
    """The sets of a block in their order, with common beginnings stored once and chains stored as arrays.

    Nodes stand in order of their depth; node i covers the leaves low[i] to high[i] of the sorted sets.
    """

    def __init__(self, sets: list[np.ndarray], bounds: Bounds) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        s = [sets[i] for i in self.order]
        self.sizes = np.array([len(x) for x in s])
        # (first leaf, last leaf + 1, depth so far) of what is still to cut, level by level
        self.levels: list[dict[str, np.ndarray]] = []
        todo = [(0, len(s), 0, -1)]
        while todo:
            labels, low, high, start, parent, nxt = [], [], [], [], [], []
            for a, b, depth, up in todo:
                i = a
                while i < b:
                    if len(s[i]) == depth:  # a set that ends here
                        j, end = i + 1, depth
                        while j < b and len(s[j]) == depth:
                            j += 1
                    else:
                        j, token = i + 1, s[i][depth]
                        while j < b and len(s[j]) > depth and s[j][depth] == token:
                            j += 1
                        # the sets are sorted, so what the first and the last of them share, all share
                        x, y = s[i][depth:], s[j - 1][depth:]
                        m = min(len(x), len(y))
                        same = x[:m] == y[:m]
                        end = depth + (m if same.all() else int(same.argmin()))
                        # a chain is cut behind the prefix, where most searches end
                        cut = bounds.prefix(len(s[i]))
                        end = cut if depth < cut < end else end
                    if len(s[i]) > depth and (j - i > 1 or end < len(s[i])):
                        nxt.append((i, j, end, len(labels)))
                    labels.append(s[i][depth:end])
                    low.append(i)
                    high.append(j)
                    start.append(depth)
                    parent.append(up)
                    i = j
            at = np.cumsum([0, *map(len, labels)])
            self.levels.append({"tokens": np.concatenate([*labels, np.zeros(0, np.int64)]).astype(np.int64), "at": at, "low": np.array(low), "high": np.array(high), "end": np.array(start) + np.diff(at), "parent": np.array(parent), "min": np.array([self.sizes[a:b].min() for a, b in zip(low, high, strict=True)]), "max": np.array([self.sizes[a:b].max() for a, b in zip(low, high, strict=True)])})
            todo = nxt
        # where the grams of stored prefixes stand: gram and node of the first level, in order
        heads = [x[: bounds.prefix(len(x))] for x in s]
        root = np.repeat(np.searchsorted(self.levels[0]["high"], np.arange(len(s)), "right"), [len(x) for x in heads])
        pairs = np.unique(np.stack([np.concatenate(heads), root]), axis=1)
        self.entry_token, self.entry_node = pairs[0], pairs[1]

    def search(self, query: np.ndarray, member: np.ndarray, bounds: Bounds, label: np.ndarray, own: int) -> Iterator[int]:
        """Leaves (places in order) whose sets are similar to query. member: a flag for each token, set for query's; label: of each place, kept up to date by the caller; subtrees all of whose leaves have the label of the place own are left out."""
        t, size = float(bounds.t), len(query)
        head = query[: bounds.prefix(size)]
        _, at = _ranges(np.searchsorted(self.entry_token, head, "left"), np.searchsorted(self.entry_token, head, "right"))
        nodes = np.unique(self.entry_node[at])
        before = np.zeros(len(nodes), np.int64)
        for depth, level in enumerate(self.levels):
            if depth:  # the children of a node stand together
                of, nodes = _ranges(np.searchsorted(level["parent"], nodes, "left"), np.searchsorted(level["parent"], nodes, "right"))
                before = overlap[of]
            fits = (level["max"][nodes] >= t * size - 1e-9) & (level["min"][nodes] <= size / t + 1e-9)
            nodes, before = nodes[fits], before[fits]
            fresh = _any_other(level["low"][nodes], level["high"][nodes], label, int(label[own]))
            nodes, before = nodes[fresh], before[fresh]
            if not len(nodes):
                return
            a, b = level["at"][nodes], level["at"][nodes + 1]
            which, take = _ranges(a, b)
            overlap = before + np.bincount(which, member[level["tokens"][take]], len(nodes)).astype(np.int64)
            last = np.where(b > a, level["tokens"][np.maximum(b - 1, 0)] if len(level["tokens"]) else 0, -1)
            rest = np.where(b > a, size - np.searchsorted(query, last, "right"), size)
            end, least, most = level["end"][nodes], level["min"][nodes], level["max"][nodes]
            # what a set below can still share, against the least that any of them needs
            good = overlap + np.minimum(most - end, rest) >= t * (size + least) / (1 + t) - 1e-9
            low, high = level["low"][nodes], level["high"][nodes]
            for i in np.flatnonzero(good & (end == least)):  # sets that end in this node
                if overlap[i] >= bounds.overlap(size, int(least[i])):
                    yield from (int(j) for j in range(low[i], high[i]) if self.sizes[j] == end[i])
            good &= most > end
            nodes, overlap = nodes[good], overlap[good]


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each a up to its b, and which of them each belongs to."""
    sizes = b - a
    which = np.repeat(np.arange(len(a)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(a, sizes)


def _any_other(low: np.ndarray, high: np.ndarray, label: np.ndarray, own: int) -> np.ndarray:
    """Whether some leaf of each range has another label than own."""
    out = label[low] != own
    for k in np.flatnonzero(~out & (high - low > 1)):
        out[k] = (label[low[k] : high[k]] != own).any()
    return out


class Groups:
    """Union-find by size, with the label of every place at hand."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: list[list[int]] = [[i] for i in range(n)]

    def join(self, x: int, y: int) -> bool:
        x, y = int(self.label[x]), int(self.label[y])
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []
        return True


def block_links(queries: list[np.ndarray], stored: list[np.ndarray], bounds: Bounds, same: bool) -> list[tuple[int, int]]:
    """Links (query, stored) that join all that is linked among the two lists, leaving out those between sets already joined. same: both lists are one."""
    tokens, flat = np.unique(np.concatenate([*stored, *([] if same else queries)]), return_inverse=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((np.arange(len(tokens)), np.bincount(flat, minlength=len(tokens))))] = np.arange(len(tokens))
    cuts = np.cumsum([len(x) for x in [*stored, *([] if same else queries)]])[:-1]
    local = [np.sort(rank[x]) for x in np.split(flat, cuts)]
    trie = Trie(local[: len(stored)], bounds)
    groups = Groups(len(local))  # stored sets at their leaf, then the queries
    leaf_of = np.empty(len(stored), np.int64)
    leaf_of[trie.order] = np.arange(len(stored))
    member, out = np.zeros(len(tokens), np.int64), []
    for i in range(len(queries)):
        query, place = (local[i], int(leaf_of[i])) if same else (local[len(stored) + i], len(stored) + i)
        member[query] = 1
        for leaf in trie.search(query, member, bounds, groups.label, place):
            if groups.join(place, leaf):
                out.append((i, trie.order[leaf]))
        member[query] = 0
    return out


def _verify(n: int, percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bounds, words = Bounds(percent), WordHash()
        frame = frame.drop_duplicates(["key", "side"])
        sets = [gram_set(bytes(t), n, words) for t in frame["text"]]
        good = np.array([len(x) > 0 and set_key(x) == k for x, k in zip(sets, frame["key"], strict=True)], bool)
        keys, side = frame["key"].to_numpy(), frame["side"].to_numpy()
        left, right = [i for i in np.flatnonzero(good & (side != 1))], [i for i in np.flatnonzero(good & (side != 0))]
        if not left or not right:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        same = bool((side == 2).all())
        links = block_links([sets[i] for i in left], [sets[i] for i in right], bounds, same)
        return pd.DataFrame({"a": [int(keys[left[i]]) for i, _ in links], "b": [int(keys[right[j]]) for _, j in links]}, dtype="int64")

    return run


def _pairs(members: DataFrame, pairs: Column, n: int, percent: int) -> DataFrame:
    """Links within tasks: members has cluster, block, blocks, key, text; pairs: an array of (first, second, side)."""
    rows = members.withColumn("p", F.explode(pairs)).select("cluster", F.col("p.first").alias("first"), F.col("p.second").alias("second"), F.col("p.side").alias("side"), "key", "text")
    return rows.groupBy("cluster", "first", "second").applyInPandas(_verify(n, percent), "a long, b long")


def _pair(first: Column, second: Column, side: Column | int) -> Column:
    return F.struct(first.cast("int").alias("first"), second.cast("int").alias("second"), (F.lit(side) if isinstance(side, int) else side).cast("int").alias("side"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block_grams: int = BLOCK_GRAMS, hot: int = HOT, flush: int = FLUSH) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_key (equal for equal sets), component_id."""
    spark = docs.sparkSession
    bounds = Bounds(percent)
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    whole, path = T.StructType([T.StructField("id", kind), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sent", T.BinaryType())]), shared_dir(spark, "sent")
    map_batches(rows, _sets(n, percent), whole).write.parquet(path)
    sent = spark.read.schema(whole).parquet(path)
    grams = sent.agg(F.sum(F.octet_length("sent"))).first()[0] or 0
    edges, prefixes = _candidates(sent.where("sent is not null"), bounds, max(partitions(spark), ceil(grams / (32 << 20))), hot, flush)
    nodes = prefixes.select("node", "key").distinct()
    candidates = components(edges).withColumnRenamed("root", "cluster").join(nodes, "node").select("cluster", "key").distinct()
    # what the search was made from goes, before texts move
    sets = materialise(sent.drop("sent"), "sets")
    remove(spark, path)
    # one document stands for each class; clusters above the size of a block are cut into several
    stands = sets.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    picked = materialise(candidates.join(stands, "key"), "candidates")
    picked = _blocked(picked, block_grams)
    members = materialise(marked(rows, picked, "id").join(picked.drop("n"), "id"), "members")
    # first round: every block with itself and with block 0
    zero, block = F.lit(0), F.col("block")
    own = F.array(_pair(block, block, 2))
    with_zero = F.transform(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda j: _pair(zero, j, 0))
    first = F.when(F.col("blocks") == 1, own).when(block == 0, F.concat(own, with_zero)).otherwise(F.concat(own, F.array(_pair(zero, block, 1))))
    links = materialise(_pairs(members, first, n, percent), "links")
    if not members.where("blocks > 2").isEmpty():
        links = materialise(links.unionByName(_second_round(members, links, prefixes, stands, n, percent, block_grams)), "links")
    joined = components(links).select(F.col("node").alias("key"), F.col("root"))
    classes = stands.select("key", "id").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    inside = materialise(classes.join(joined.select("key"), "key", "left_semi").select("key", "root"), "joined")
    merged = join_hot(inside, least, "root").select("key", "component_id")
    alone = classes.join(joined.select("key"), "key", "left_anti").select("key", F.col("id").alias("component_id"))
    return sets.join(merged.unionByName(alone), "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.coalesce("component_id", "id").alias("component_id"))


def _blocked(picked: DataFrame, block_grams: int) -> DataFrame:
    """picked (stored; cluster, key, n) with the number of blocks of its cluster and its own."""
    blocks = picked.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block_grams)).cast("int").alias("blocks"))
    return join_hot(picked, blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))


def _second_round(members: DataFrame, links: DataFrame, prefixes: DataFrame, stands: DataFrame, n: int, percent: int, block_grams: int) -> DataFrame:
    """Clusters of many blocks: the members outside their cluster's largest group, against all sets that share a gram of both prefixes with them.

    Two groups that are not joined yet can only be linked through a member of the smaller ones.
    """
    many = members.where("blocks > 2").select("cluster", "key").distinct()
    label = materialise(many.join(components(links).select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "labels")
    main = label.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    outside = join_hot(label, main, "cluster").where("root <> main").select("key").distinct()
    asked = prefixes.join(outside, "key", "left_semi").select("gram", "band").distinct()
    lists = prefixes.join(asked, ["gram", "band"], "left_semi").select("gram", "band", "key")
    alike = lists.groupBy("gram", "band").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("size > 1")
    once = alike.groupBy("size", "x", "y").agg(F.min(F.struct("gram", "band")).alias("g")).select("g.*")
    met = lists.join(once, ["gram", "band"], "left_semi").select(F.xxhash64("gram", "band").alias("cluster"), "key").distinct()
    met = _blocked(materialise(met.join(stands.select("key", "n"), "key"), "met"), block_grams)
    met = materialise(met.join(members.select("key", "text").distinct(), "key"), "met-texts")
    asking = met.join(outside, "key", "left_semi")
    queries = asking.withColumn("second", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.col("block").alias("first"), "second", F.lit(0).alias("side"), "key", "text")
    stored = met.join(asking.select("cluster", F.col("block").alias("first")).distinct(), "cluster").select("cluster", "first", F.col("block").alias("second"), F.lit(1).alias("side"), "key", "text")
    return queries.unionByName(stored).groupBy("cluster", "first", "second").applyInPandas(_verify(n, percent), "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, row_col: str | None = None) -> DataFrame:
    """One row of each group of linked documents, that with the smallest id (null ids come last), with all its columns. row_col: a stored key of the rows, if they have one."""
    rows, row = (docs, row_col) if row_col else with_row_key(docs)
    order, text = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")), F.col(text_col)
    found = near_duplicates(rows.select(order.alias("id"), text.alias("text")), "id", "text", n, percent)
    bad = found.where("id.row <> component_id.row").select(F.col("id.row").alias(row))
    return rows.join(bad, row, "left_anti").select(*docs.columns)
