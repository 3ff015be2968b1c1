"""Periodic runs in sequences of words, by the runs theorem.

A run is a stretch of words with smallest period q that is at least max(least, 2 q) words long and cannot be
extended. Every run has a Lyndon root under one of two opposite orders of the words, and that root is the longest Lyndon word
that starts at its place. So for each place and order the longest Lyndon word comes from the next smaller value of the inverse
suffix array, and is extended both ways as far as its period holds: two longest common extensions, each a range minimum
over an LCP array (of the words, and of the words backwards) by a sparse table.

The texts of one slice of rows share one suffix array: each stretch of words ends with a separator of its own, less than all
words. Only words inside a repeated window of least - least // 2 words of their own text come in: a run of at least `least` words
has all its words in such windows, so nothing is lost, and most prose is passed over in one sort.

One pass over the texts; no row moves between tasks. Memory is linear in a slice (or in one text, where that is longer).

Defined results: null and empty texts have no words and no runs; ids may be null or repeated, a row out for each row in; extra
columns are kept out; any length of text is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.support import map_batches, text_bytes

#: Words that a run has at least.
LEAST = 12

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of an array of integers, and its inverse, by doubling of the compared prefixes."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if rank[order[-1]] == n - 1:
            return order, rank
        h *= 2


def lcp_array(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[k]: common prefix of the suffixes of ranks k - 1 and k; s[-1] occurs once."""
    text, before, n = s.tolist(), np.concatenate([[-1], order[:-1]])[rank].tolist(), len(s)
    at, h = [0] * n, 0
    for i in range(n):  # the next suffix shares all but one of the words that this one shares
        j = before[i]
        if j < 0:
            h = 0
            continue
        while text[i + h] == text[j + h]:
            h += 1
        at[i] = h
        if h:
            h -= 1
    out = np.empty(n, np.int64)
    out[rank] = at
    return out


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of values[first .. last]. A sparse table whose rows are used and dropped in turn, so that memory stays linear."""
    out = np.empty(len(first), np.int64)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    by_level = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[by_level], np.arange(level.max() + 2 if len(level) else 1))
    row = values
    for k in range(len(ends) - 1):
        now = by_level[ends[k] : ends[k + 1]]
        out[now] = np.minimum(row[first[now]], row[last[now] - (1 << k) + 1])
        row = np.minimum(row[: -(1 << k)], row[1 << k :]) if len(row) > 1 << k else row
    return out


def _common(rank: np.ndarray, lcp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common prefixes of the suffixes at i and j (i <> j)."""
    a, b = rank[i], rank[j]
    return range_minima(lcp, np.minimum(a, b) + 1, np.maximum(a, b))


def next_smaller(values: list[int]) -> np.ndarray:
    """For each place the next one to the right with a smaller value; the length where there is none."""
    n = len(values)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        v, j = values[i], i + 1
        while j < n and values[j] >= v:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(s: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs (start, end, period) of an array of non-negative integers in which stretches lie one after the other, each up to its place in ends.

    Runs do not reach over these places.
    """
    separators = len(ends)
    joined = np.insert(s + separators, ends, np.arange(separators))
    stop = ends + np.arange(separators)  # places of the separators
    n = len(joined)
    order, rank = suffix_array(joined)
    lcp = lcp_array(joined, order, rank)
    # backwards, with a separator before each stretch, so that it stands behind it again
    mirror = np.concatenate([joined[:-1][::-1], joined[-1:]])
    back_order, back_rank = suffix_array(mirror)
    back = lcp_array(mirror, back_order, back_rank)
    own_stop = stop[np.searchsorted(stop, np.arange(n))]
    found = []
    for values in (rank, n - 1 - rank):
        root_end = next_smaller(values.tolist())
        i = np.flatnonzero((root_end <= own_stop) & (np.arange(n) < own_stop))
        j = root_end[i]
        right = np.zeros(len(i), np.int64)
        inside = j < own_stop[i]
        right[inside] = _common(rank, lcp, i[inside], j[inside])
        # word i - 1 is at n - 2 - (i - 1) in the mirror; what stands before the first stretch is its end
        left = np.zeros(len(i), np.int64)
        inside = i > 0
        left[inside] = _common(back_rank, back, n - 1 - i[inside], n - 1 - j[inside])
        a, b, q = i - left, j + right, j - i
        good = b - a >= np.maximum(least, 2 * q)
        found.append(np.stack([a[good], b[good], q[good]], 1))
    runs = np.unique(np.concatenate(found), axis=0)
    before = np.searchsorted(stop, runs[:, 0])
    runs[:, 0] -= before
    runs[:, 1] -= before
    return runs


def _repeating(ids: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window of so many words that occurs more than once in its text. By hashes: some more may be marked, never fewer."""
    n = len(ids)
    marked = np.zeros(n + 1, np.int32)
    if n >= window:
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h = text[: n - window + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(window):
            h = h * np.uint64(0x165667B19E3779F9) + mixed[k : n - window + 1 + k]
            h ^= h >> np.uint64(31)
        starts = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
        h = h[starts]
        by_hash = np.argsort(h)
        same = h[by_hash][1:] == h[by_hash][:-1]
        again = np.zeros(len(starts), bool)
        again[by_hash[1:][same]] = True
        again[by_hash[:-1][same]] = True
        at = starts[again]
        np.add.at(marked, at, 1)
        np.add.at(marked, at + window, -1)
    return np.cumsum(marked[:n]) > 0


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs (start, length, period) of each text, by start and period."""
    number = count()
    seen: dict[bytes, int] = {}
    flat = [w for words in texts for w in words]
    ids = np.fromiter((k if (k := seen.get(w)) is not None else seen.setdefault(w, next(number)) for w in flat), np.int64, len(flat))
    del flat, seen
    ends = np.cumsum([len(x) for x in texts])
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    keep = _repeating(ids, ends, least - least // 2)
    # stretches of marked words within one text
    cut = np.zeros(len(ids) + 1, bool)
    cut[0] = True
    cut[ends] = True
    edge = np.concatenate([[False], keep]) != np.concatenate([keep, [False]])
    bounds = np.flatnonzero(edge | cut)
    first, last = bounds[:-1], bounds[1:]
    good = keep[first] & (last - first >= least) if len(first) else np.zeros(0, bool)
    first, last = first[good], last[good]
    if not len(first):
        return out
    sizes = last - first
    places = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    runs = runs_of(ids[places], np.cumsum(sizes), least)
    if not len(runs):
        return out
    start, length = places[runs[:, 0]], runs[:, 1] - runs[:, 0]
    owner = np.searchsorted(ends, start, side="right")
    rows = np.stack([start - np.concatenate([[0], ends])[owner], length, runs[:, 2]], 1)
    by_text = np.lexsort((rows[:, 2], rows[:, 0], owner))
    rows, owner = rows[by_text], owner[by_text]
    where = np.flatnonzero(np.diff(owner, prepend=-1))
    for k, part in zip(owner[where], np.split(rows, where[1:]), strict=True):
        out[k] = part
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run contains behind its first period."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of docs: id, n_words, runs (start, length, period; by start, then period), collapsed (the text without what repeats, words joined by blanks)."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.split() for t in b.column(1).to_pylist()]
            found = find_runs(texts, least)
            flat = [r for runs in found for r in runs.tolist()]
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_ARROW_RUN)))
            short = [b" ".join(collapsed(w, r)).decode("utf-8", "replace") for w, r in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in texts], pa.int64()), runs, pa.array(short, pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    out = map_batches(rows, scan, schema)
    return out.withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose tails repeat in one row of ten: with h the crc32 of the id and g = h div 10, words from g mod n on repeat the first p of them."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    head, body = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(body, times)), F.lit(1), (n - a).cast("int"))
    planted = F.array_join(F.concat(head, tail), " ")
    return docs.withColumn(text_col, F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), planted).otherwise(F.col(text_col)))
