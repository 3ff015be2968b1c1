"""Ranked lexical search, score at a time over postings in order of their impact.

The queries are a stated set; of every document only their terms count. A first pass turns each text into its number of terms and the
number of times it holds each term of a query; the corpus's figures (documents, terms, documents of a term) are sums over all
documents. Then each task builds indexes over its own documents: the postings of a term in descending impact, those of equal
impact as one segment, documents with equal terms as one entry. A query takes the segments of its terms in
descending contribution (weight times impact), level by level, and adds them up. It stops when the bounds of what remains prove that
no entry but a few can be among its first k: no other has as much as the k-th has now, with all that it could still get. Their scores are then
completed from the entries themselves. What a task has found bounds its next index. The best k of every task are ranked once more.

Nothing but the stated queries is sent out: their terms are bounded by QUERY_BYTES, and more queries make more
passes. An index has at most POSTINGS postings (or one document), so memory doesn't grow with a task. The first k of all tasks are k rows for each
query and task.

Defined results: null and empty texts have no terms; queries without terms return nothing; equal scores are ordered by id, null ids
last; repeated rows of documents are documents of their own; repeated rows of a query count once, and several texts of one query id are one
text; a query whose id is null is left out. Extra columns are kept out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from regtext.llm import packed
from regtext.llm.support import FOLD, map_batches, materialise, text_bytes

#: Bytes of query texts whose terms are looked for in one pass over the documents.
QUERY_BYTES = 4 << 20
#: Postings of one index.
POSTINGS = 1_000_000
#: A level goes down to this share of the one before it.
LEVEL = 0.7
# Fixed values of the score: its scale, and how much a document's length counts, of 100.
SCALE, LENGTH = 1_000_000_000, 90


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(documents: int, holding: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, terms: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of a term that occurs tf times in a document of so many terms."""
    m = 100 - LENGTH + (LENGTH * terms * documents) // max(1, total)
    return (SCALE * tf) // (1000 * tf + 8 * m)


class Index:
    """Postings of some documents in order of their impact.

    Entries (documents with equal terms) have a length, terms and counts; ids: the first k ids of each, in order.
    """

    def __init__(self, entries: list[tuple[int, np.ndarray, np.ndarray]], ids: list[list], documents: int, total: int):
        self.ids = ids
        self.lists = [(t, c) for _, t, c in entries]
        sizes = np.array([len(t) for _, t, _ in entries], np.int64)
        self.entry = np.repeat(np.arange(len(entries)), sizes)
        terms = np.concatenate([t for _, t, _ in entries] or [np.zeros(0, np.int64)]).astype(np.int64)
        tf = np.concatenate([c for _, _, c in entries] or [np.zeros(0, np.int64)]).astype(np.int64)
        length = np.repeat(np.array([n for n, _, _ in entries], np.int64), sizes)
        self.own = impacts(tf, length, documents, total)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((-self.own, terms))
        self.term, self.impact, self.entry = terms[order], self.own[order], self.entry[order]
        self.known, first = np.unique(self.term, return_index=True)
        self.spans = dict(zip(self.known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(self.term)], strict=True), strict=True))
        self.falling = -self.impact

    def score(self, entry: int, weights: dict[int, int]) -> int:
        """The whole score of one entry."""
        terms = self.lists[entry][0].tolist()
        own = self.own[self.starts[entry] : self.starts[entry + 1]].tolist()
        return sum(weights[t] * x for t, x in zip(terms, own, strict=True) if t in weights)

    def best(self, weights: dict[int, int], k: int, least: int = 0) -> list[tuple[int, int]]:
        """(score, entry) of all entries that can be among the first k and have a score of at least `least` (and above 0)."""
        lists = [[*self.spans[t], w] for t, w in weights.items() if w > 0 and t in self.spans]
        if not lists:
            return []
        tops = [w * int(self.impact[a]) for a, _, w in lists]
        if sum(tops) < least:
            return []
        got = np.zeros(len(self.ids), np.int64)
        level = max(tops)
        while True:
            level = int(level * LEVEL)
            rest = 0
            for x in lists:
                a, b, w = x
                if a == b:
                    continue
                # whole segments: all postings of an impact whose contribution reaches the level
                end = a + int(np.searchsorted(self.falling[a:b], -(-(-level // w)), side="right"))
                got[self.entry[a:end]] += w * self.impact[a:end]
                x[0] = end
                if end < b:
                    rest += w * int(self.impact[end])
            kth = int(np.partition(got, -k)[-k]) if len(got) > k else 0
            bar = max(kth, least, 1)
            if rest < bar or rest == 0:
                left = np.flatnonzero(got + rest >= bar)
                if len(left) <= 4 * k or rest == 0:
                    break
        return [(s, e) for e in left.tolist() if (s := self.score(e, weights)) >= max(least, 1)]


def _counter(vocabulary: dict[bytes, int]):
    """Documents as id, number of terms, and the terms of queries with their counts (arrays of int32 as bytes, by term)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, terms, counts = [], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                own = sorted(found)
                size.append(len(words))
                terms.append(np.array(own, "<i4").tobytes())
                counts.append(np.array([found[t] for t in own], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["id", "n", "terms", "counts"])

    return run


def _holders(size: int, block: int):
    """Each task's number of documents that hold a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = np.zeros(size, np.int64), 0
        for b in batches:
            every = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4")
            total += np.bincount(every, minlength=size)
            salt = salt * 31 + len(every)
        yield from packed.blocks_of(total, block, salt)

    return run


def _searcher(queries: list[tuple[int, list[int]]], weights: list[int], k: int, documents: int, total: int, postings: int, kind: pa.DataType):
    asked = [(number, {t: weights[t] for t in terms}) for number, terms in queries]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {number: [] for number, _ in asked}
        order = lambda i: (i is None, i if i is not None else 0)

        def search(entries: dict[tuple, list]) -> None:
            ids = [sorted(x, key=order)[:k] for x in entries.values()]
            index = Index([(n, np.frombuffer(t, "<i4"), np.frombuffer(c, "<i4")) for n, t, c in entries], ids, documents, total)
            for number, own in asked:
                now = best[number]
                least = -now[-1][0] if len(now) == k else 1
                if found := index.best(own, k, least):
                    best[number] = sorted([*now, *((-s, *order(i), i) for s, e in found for i in ids[e])], key=lambda x: x[:3])[:k]

        held: dict[tuple, list] = {}
        size = 0
        for b in batches:
            for i, n, t, c in zip(*(b.column(x).to_pylist() for x in range(4)), strict=True):
                if not t:
                    continue
                if (n, t, c) not in held:
                    size += len(t) // 4
                own = held.setdefault((n, t, c), [])
                own.append(i)
                if len(own) >= 4 * k:
                    own[:] = sorted(own, key=order)[:k]
                if size >= postings:
                    search(held)
                    held, size = {}, 0
        if held:
            search(held)
        out = [(number, x[3], -x[0]) for number, rows in best.items() for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], kind), pa.array([r[2] for r in out], pa.int64())], ["query", "id", "score"])

    return run


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 10, query_bytes: int = QUERY_BYTES, postings: int = POSTINGS) -> DataFrame:
    """query id, rank (from 1), document id and score: the k best documents of each query with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    own = rows.schema["id"]
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_text).cast("string").alias("text")).where("query is not null and text is not null")
    asked = asked.groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))
    kind = asked.schema["query"].dataType
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    results = []
    for block in range(blocks):
        part = [(r["query"], terms_of(r["text"].encode())) for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()]
        vocabulary: dict[bytes, int] = {}
        numbered = [(n, [vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms)]) for n, (_, terms) in enumerate(part)]
        numbered = [x for x in numbered if x[1]]
        if not numbered:
            continue
        counted = materialise(map_batches(rows, _counter(vocabulary), T.StructType([own, *(T.StructField(c, t) for c, t in (("n", T.LongType()), ("terms", T.BinaryType()), ("counts", T.BinaryType())))])), "terms")
        documents, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        chunk = 1 << 16
        holding = packed.summed(map_batches(counted.select("terms"), _holders(len(vocabulary), chunk), packed.SCHEMA), (len(vocabulary),), chunk)
        weights = [weight(documents, int(h)) for h in holding]
        found = map_batches(counted, _searcher(numbered, weights, k, documents, total, postings, to_arrow_type(own.dataType)), T.StructType([T.StructField("query", T.LongType()), own, T.StructField("score", T.LongType())]))
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        ranked = materialise(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
        names = spark.createDataFrame([(n, part[n][0]) for n, _ in numbered], T.StructType([T.StructField("query", T.LongType()), T.StructField("name", kind)]))
        results.append(ranked.join(F.broadcast(names), "query").select(F.col("name").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
    if results:
        return reduce(DataFrame.unionByName, results)
    return spark.createDataFrame([], T.StructType([T.StructField(query_id, kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, own.dataType), T.StructField("score", T.LongType())]))
