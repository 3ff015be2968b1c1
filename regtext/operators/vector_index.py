"""Inverted lists of vectors: a search that reads some of the points instead of all.

Centres come from Spark's k-means over a sample of a bounded size; every point is assigned to its nearest centre and stored in that centre's
list, cut into parts of at most about PART points. A query reads the lists of its nearest centres and scores
their points exactly, by cosine in double precision. The number of lists grows with the square root of the points, and how many are
read follows from a recall: `tuned` measures on a sample of queries how far down their order of lists the exact neighbours lie.

Points without a usable vector (null, empty, zero, not finite or of another length) are stored in list -1 that no query reads, as no
cosine is defined for them; queries without one find nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.operators import retrieve

#: Points that the centres are fitted on (all, if there are fewer).
SAMPLE = 50_000
#: Centres at most: they are kept in every task.
MAX_LISTS = 16_384
#: Points of a part of a list that are scored in one place.
PART = 20_000
#: Vectors that meet all centres at a time.
ROWS = 1000
NOWHERE = -1


@dataclass(frozen=True)
class Index:
    """Stored points (list, part, the points' own columns), the centres as unit rows, and the parts of each list."""

    points: DataFrame
    centres: np.ndarray
    parts: tuple[int, ...]


def _matrix(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as unit rows in doubles, and which of them are usable; the others are rows of zeros."""
    out, good = np.zeros((len(vectors), dim)), np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v is None or len(v) != dim:
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            out[k], good[k] = x / np.sqrt(x @ x), True
    return out, good


def fit(points: DataFrame, keys: Sequence[str] = ("kb", "chunk_id"), vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centres as unit rows. Without usable points there are none."""
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = points.where(F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    dims = usable.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return np.zeros((0, 0))
    usable = usable.where(F.size(v) == dims["dim"])
    number = lists or min(MAX_LISTS, ceil(sqrt(dims["count"])))
    share = min(1.0, sample / dims["count"])
    taken = usable.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(array_to_vector(v).alias("features"))
    model = KMeans(k=max(2, number), seed=seed, maxIter=10, distanceMeasure="cosine").fit(taken)
    centres = np.array([c for c in model.clusterCenters()])
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def build(points: DataFrame, path: str, keys: Sequence[str] = ("kb", "chunk_id"), vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Index:
    """Assign every point to its list and store them below path, ordered by list, so that a search reads its own row groups."""
    centres = fit(points, keys, vector_col, lists, sample, seed)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(centres):
            return pd.Series([NOWHERE] * len(vectors))
        out = np.full(len(vectors), NOWHERE, np.int32)
        for a in range(0, len(vectors), ROWS):
            units, good = _matrix(vectors.iloc[a : a + ROWS], centres.shape[1])
            out[a : a + ROWS] = np.where(good, (units @ centres.T).argmax(axis=1), NOWHERE)
        return pd.Series(out)

    spark = points.sparkSession
    points.withColumn("list", nearest(F.col(vector_col))).write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = {r["list"]: r["count"] for r in assigned.groupBy("list").count().collect()}
    parts = tuple(max(1, ceil(sizes.get(k, 0) / PART)) for k in range(len(centres)))
    per_list = F.coalesce(F.get(F.array(*(F.lit(p) for p in parts)), F.greatest("list", F.lit(0))), F.lit(1)) if parts else F.lit(1)
    placed = assigned.withColumn("part", F.pmod(F.xxhash64(*keys), per_list).cast("int"))
    placed.repartitionByRange("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/points")
    rows = [(k, parts[k], c.tolist()) for k, c in enumerate(centres)]
    spark.createDataFrame(rows, "list int, parts int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    return Index(spark.read.parquet(f"{path}/points"), np.array([r["centre"] for r in rows]), tuple(r["parts"] for r in rows))


def list_order(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """queries (query_id, embedding) with the lists they read, the nearest first (empty for those without a usable vector)."""
    centres = index.centres

    @F.pandas_udf("array<int>")
    def order(vectors: pd.Series) -> pd.Series:
        if not len(centres):
            return pd.Series([[] for _ in vectors])
        out: list[np.ndarray] = []
        for a in range(0, len(vectors), ROWS):
            units, good = _matrix(vectors.iloc[a : a + ROWS], centres.shape[1])
            near = np.argsort(-(units @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            out.extend(row if ok else near[0, :0] for row, ok in zip(near, good, strict=True))
        return pd.Series(out, dtype=object)

    return queries.withColumn("lists", order(F.col("embedding")))


def _asked(queries: DataFrame, index: Index, probes: int, vector_col: str) -> DataFrame:
    """queries once for each part of the lists that they read (list, part)."""
    parts = F.create_map(*(F.lit(x) for n, p in enumerate(index.parts) if p > 1 for x in (n, p))) if any(p > 1 for p in index.parts) else None
    asked = list_order(queries.withColumn("embedding", F.col(vector_col)), index, probes).withColumn("list", F.explode("lists"))
    number = F.coalesce(F.try_element_at(parts, F.col("list")), F.lit(1)) if parts is not None else F.lit(1)
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0), number - 1))).select(*queries.columns, "list", "part")


def scored(queries: DataFrame, index: Index, probes: int, threshold: float = -1.0, k: int | None = None, keys: Sequence[str] = ("kb", "chunk_id"), vector_col: str = "embedding") -> DataFrame:
    """query_id, keys, list and raw (cosine) of the points in the queries' lists that reach the threshold; with k, at least the best k of each query and part.

    Each part of a list meets the queries that read it in one place, as two matrices.
    """
    dim = index.centres.shape[1] if len(index.centres) else 0
    asked = _asked(queries.select("query_id", F.col("embedding").alias("asked")), index, probes, "asked")
    stored = index.points.where(F.col("list") >= 0).select(*keys, F.col(vector_col).alias("vector"), "list", "part")

    def score(key: tuple, points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        have, fine = _matrix(points["vector"], dim)
        a, ok = _matrix(wanted["asked"], dim)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.flatnonzero(ok):
            raw = have @ a[n]
            at = np.flatnonzero(fine & (raw >= threshold))
            if k is not None and len(at) > k:
                least = np.partition(raw[at], -k)[-k]
                at = at[raw[at] >= least]
            found.append((np.full(len(at), n), at, raw[at]))
        rows, at, raw = (np.concatenate([f[x] for f in found] or [np.zeros(0, np.int64 if x < 2 else np.float64)]) for x in range(3))
        out = {"query_id": wanted["query_id"].to_numpy()[rows]} | {c: points[c].to_numpy()[at] for c in keys} | {"list": key[0], "raw": raw}
        return pd.DataFrame(out, index=range(len(at)))

    schema = T.StructType([asked.schema["query_id"], *(stored.schema[c] for c in keys), T.StructField("list", T.IntegerType()), T.StructField("raw", T.DoubleType())])
    return stored.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInPandas(score, schema)


def nearest(queries: DataFrame, index: Index, k: int, probes: int, threshold: float = -1.0, keys: Sequence[str] = ("kb", "chunk_id"), vector_col: str = "embedding") -> DataFrame:
    """The k nearest points of each query within its lists, by rank; equal cosines in the order of their keys."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), *keys))
    return scored(queries, index, probes, threshold, k, keys, vector_col).withColumn("rank", rank).where(F.col("rank") <= k)


def tuned(queries: DataFrame, index: Index, k: int, recall: float = 0.95, keys: Sequence[str] = ("kb", "chunk_id"), vector_col: str = "embedding") -> int:
    """Lists to read for this recall at k: a sample of queries reads all lists, and what their exact neighbours need is counted."""
    if not len(index.centres):
        return 1
    exact = nearest(queries, index, k, len(index.centres), keys=keys, vector_col=vector_col)
    order = list_order(queries.select("query_id", "embedding"), index, len(index.centres)).select("query_id", "lists")
    depth = exact.join(order, "query_id").select(F.array_position("lists", F.col("list")).alias("depth")).groupBy("depth").count().orderBy("depth").collect()
    total, seen = sum(r["count"] for r in depth), 0
    for r in depth:
        seen += r["count"]
        if seen >= recall * total:
            return int(r["depth"])
    return 1


def candidate_pairs(queries: DataFrame, index: Index, probes: int, threshold: float, keys: Sequence[str] = ("kb", "chunk_id"), fetch: int | None = None) -> DataFrame:
    """What retrieve.scored gives (points' columns, q_ columns of the filters, raw), from the lists that the queries read.

    With fetch it is what retrieve.best_pairs gives: of each part only the best so many of each query and tier, all that tiered() looks at.
    """
    if fetch is not None:
        return _best_pairs(queries, index, probes, threshold, fetch)
    hits = scored(queries, index, probes, threshold, keys=keys).drop("list")
    lean = index.points.drop("content", "embedding", "list", "part")
    filters = queries.select("query_id", *(F.col(c).alias(f"q_{c}") for c in retrieve.FILTERS))
    return hits.join(lean, list(keys)).join(filters, "query_id")


def _best_pairs(queries: DataFrame, index: Index, probes: int, threshold: float, fetch: int) -> DataFrame:
    asked = _asked(queries.select("query_id", *(F.col(c).alias(f"q_{c}") for c in ("embedding", *retrieve.FILTERS))), index, probes, "q_embedding")
    stored = index.points.where(F.col("list") >= 0).drop("content")
    kept = [*stored.drop("embedding", "list", "part").schema, *asked.drop("q_embedding", "list", "part").schema, T.StructField("raw", T.DoubleType())]
    names = [f.name for f in kept]

    def best(points: pa.Table, wanted: pa.Table) -> pa.Table:
        points, wanted = points.drop_columns(["list", "part"]).combine_chunks(), wanted.drop_columns(["list", "part"]).combine_chunks()
        found = retrieve.best_of(wanted, retrieve.TIERS, fetch, False, threshold, "chunk_id")(points.to_batches()) if len(points) and len(wanted) else ()
        empty = pa.table({**{c: points[c].slice(0, 0) for c in points.column_names}, **{c: wanted[c].slice(0, 0) for c in wanted.column_names}, "raw": pa.array([], pa.float64())})
        return pa.concat_tables([empty.select(names), *(pa.Table.from_batches([b]).select(names) for b in found)])

    return stored.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(best, T.StructType([T.StructField(f.name, f.dataType) for f in kept]))
