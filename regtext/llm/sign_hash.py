"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Equal vectors are collapsed first, so copies are one class with a size. A class goes into one bucket of each table: the signs
of its products with the table's hyperplanes. Inside a bucket all cosines are worked out in double precision; a pair that
also shares the bucket of an earlier table is left to that one, so each link counts once and no list of pairs is ever
stored: a bucket gives the number of links of each member and a star for each group that its links join. The stars go
through distributed connected components.

Bits and tables follow from the number of classes and from the recall asked for: a table of b bits joins a pair at the
threshold with probability (1 - acos(threshold) / pi) ** b, closer pairs more often. A bucket of more than BLOCK classes is cut into
blocks, and each pair of blocks is compared in a place of its own, so no task holds more than two; no bucket is capped. The tables are dealt in
rounds of ROUND, which bounds the rows that are on disk at once.

What grows with the data: vectors are moved ROUND times in each round; counts and stars are linear in the members of buckets.
Links inside a very dense group (many different vectors, all alike) are counted pair by pair, as their number asks.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and vectors of other lengths, link
with nothing, nor do rows whose id is null (their component is null); such rows are kept. Repeated ids are rows of their own.
Extra columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.components import components
from regtext.llm.support import join_hot, map_batches, materialise, partitions

#: Share of the pairs right at the threshold that some table brings together.
RECALL = 0.999
#: Classes of a bucket that are compared in one place; a pair of blocks is the most that a task holds.
BLOCK = 2048
#: Classes that a bucket has on average.
FILL = 16
#: Tables whose rows are dealt out at once.
ROUND = 8
#: Pairs of small buckets that are compared at once.
PAIRS = 1 << 17


def plan(classes: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table, and tables."""
    bits = min(60, max(4, ceil(log2(max(2, classes) / FILL))))
    met = (1 - acos(cosine) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - met))) if met < 1 else 1


def _packer(kind: str):
    """Vectors as bytes of floats of this kind, null for those that link with nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(kind)
            known = column.is_valid().to_pylist()
            out = []
            for k in range(b.num_rows):
                v = values[offsets[k] : offsets[k + 1]]
                out.append((v + v.dtype.type(0)).tobytes() if known[k] and len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    return run


def _units(vecs: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length 1, in doubles."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _hasher(bits: int, tables: int, seed: int, kind: str, key: str):
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            vecs, keys = b.column(2).to_pylist(), [b""] * b.num_rows
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vecs):
                by_size.setdefault(len(v), []).append(k)
            for size, rows in by_size.items():
                if size not in known:
                    known[size] = planes(size // np.dtype(kind).itemsize, bits * tables, seed)
                units = _units([vecs[k] for k in rows], kind)
                buckets = np.stack([(units @ known[size][:, t * bits : (t + 1) * bits] > 0) @ weights for t in range(tables)], 1)
                for k, row in zip(rows, buckets, strict=True):
                    keys[k] = row.astype(key).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.binary())], ["node", "size", "vec", "keys"])

    return run


def _stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Least member and member of every group that the links a[k] - b[k] (places in nodes) join."""
    least = nodes.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        if (least == before).all():
            return [(r, x) for r, x in zip(least.tolist(), nodes.tolist(), strict=True) if r != x]


class _Group:
    """Members of one bucket, or of two blocks of one: a table's number, nodes, sizes, sides (0, 1; 2: both), units and keys."""

    def __init__(self, table: int, rows: list[tuple], kind: str, key: str):
        self.table = table
        self.nodes = np.array([r[0] for r in rows], np.int64)
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.units = _units([r[2] for r in rows], kind)
        self.keys = np.frombuffer(b"".join(r[3] for r in rows), key).reshape(len(rows), -1)[:, : table + 1]
        self.side = np.array([r[4] for r in rows], np.int8)

    def links(self, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked pairs that no earlier table has brought together."""
        left, right = np.flatnonzero(self.side != 1), np.flatnonzero(self.side != 0)
        one = bool((self.side == 2).all())
        a, b = [], []
        step = max(1, PAIRS // max(1, len(right)))
        for k in range(0, len(left), step):
            rows = left[k : k + step]
            x, y = np.nonzero(self.units[rows] @ self.units[right].T >= cosine)
            x, y = rows[x], right[y]
            if one:
                x, y = x[x < y], y[x < y]
            # rows of keys are compared for links only; few at a time
            for s in range(0, len(x), PAIRS):
                p, q = x[s : s + PAIRS], y[s : s + PAIRS]
                new = ~(self.keys[p, : self.table] == self.keys[q, : self.table]).any(axis=1) if self.table else np.ones(len(p), bool)
                a.append(p[new])
                b.append(q[new])
        return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])


def _compare(cosine: float, kind: str, key: str):
    """node, links (sizes of the classes it is linked to) and other (a node of its group) of each bucket; rows come in order of their bucket."""

    def batch(rows: list[tuple[int, int, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["node", "links", "other"])

    def compared(table: int, rows: list[tuple]) -> list[tuple[int, int, int | None]]:
        out: list[tuple[int, int, int | None]] = []
        by_size: dict[int, list[tuple]] = {}
        for r in rows:
            by_size.setdefault(len(r[2]), []).append(r)
        for same in by_size.values():
            if len(same) < 2:
                continue
            group = _Group(table, same, kind, key)
            a, b = group.links(cosine)
            if len(a):
                count = np.zeros(len(same), np.int64)
                np.add.at(count, a, group.sizes[b])
                np.add.at(count, b, group.sizes[a])
                out += [(int(group.nodes[k]), int(count[k]), None) for k in np.flatnonzero(count)]
                out += [(x, 0, r) for r, x in _stars(group.nodes, a, b)]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(9)]
            for table, bucket, first, second, *row in zip(*columns, strict=True):
                if (table, bucket, first, second) != now:
                    if len(rows) > 1:
                        out += compared(now[0], rows)
                    now, rows = (table, bucket, first, second), []
                rows.append(tuple(row))
            if out:
                yield batch(out)
                out = []
        if len(rows) > 1:
            out = compared(now[0], rows)
        yield batch(out)

    return run


def _round(hashed: DataFrame, first: int, tables: int, cosine: float, block: int, kind: str, key: str) -> DataFrame:
    """What _compare gives for the tables first, first + 1, .."""
    entries = hashed.withColumn("t", F.explode(F.array(*(F.lit(t) for t in range(first, first + tables)))))
    width = np.dtype(key).itemsize
    bucket = F.substring("keys", F.col("t") * width + 1, F.lit(width))
    entries = entries.select("t", bucket.alias("bucket"), "node", "size", "vec", "keys")
    large = entries.groupBy("t", "bucket").count().where(F.col("count") > block).select("t", "bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = materialise(large, "large")  # stored, so its size is known to the join: few buckets are broadcast, many are not
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    known = entries.withColumn("blocks", F.lit(1)) if large.isEmpty() else entries.join(large, ["t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = known.withColumn("own", own)
    pair = lambda a, b, side: F.struct(a.alias("first"), b.alias("second"), side.cast("tinyint").alias("side"))
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: pair(F.least("own", k), F.greatest("own", k), F.when(k == F.col("own"), 2).when(F.col("own") < k, 0).otherwise(1)))
    placed = blocked.withColumn("p", F.explode(places)).select("t", "bucket", "p.first", "p.second", "node", "size", "vec", "keys", "p.side")
    dealt = placed.repartition("t", "bucket", "first", "second").sortWithinPartitions("t", "bucket", "first", "second")
    return map_batches(dealt, _compare(cosine, kind, key), "node long, links long, other long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = RECALL, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per row of vectors: id, n_links (other rows linked directly), component_id (least id reachable by links), kept."""
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType())
    kind, column = ("<f4", F.col(vector_col)) if single else ("<f8", F.col(vector_col).cast("array<double>"))
    rows = vectors.select(F.col(id_col).alias("id"), column.alias("v"))
    schema = T.StructType([rows.schema["id"], T.StructField("vec", T.BinaryType())])
    packed = materialise(map_batches(rows, _packer(kind), schema).select("id", F.when(F.col("id").isNotNull(), F.col("vec")).alias("vec")), "vectors")
    classes = packed.where("vec is not null").groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(classes.count(), cosine, recall)
    key, parts = "<i4" if bits < 32 else "<i8", partitions(vectors.sparkSession)
    hashed = map_batches(classes.select("node", "size", "vec").repartition(parts), _hasher(bits, tables, seed, kind, key), "node long, size long, vec binary, keys binary")
    hashed = materialise(hashed, "hashed")
    rounds = [materialise(_round(hashed, t, min(ROUND, tables - t), cosine, block, kind, key), "links") for t in range(0, tables, ROUND)]
    found = reduce(DataFrame.unionByName, rounds)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("other").alias("a"), F.col("node").alias("b")))
    rooted = materialise(classes.select("node", "vec", "least", "size").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = join_hot(rooted, lowest, "root").join(counts, "node", "left")
    known = known.select("vec", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = join_hot(packed, known, "vec")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
