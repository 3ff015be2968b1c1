"""Batched vector retrieval: filters, tiers, thresholds, boosts, reranking, parents.

points: kb, role, chunk_id, parent_id, section, pasal, ayat, pasal_rujukan, content, embedding.
queries: query_id, embedding, section, pasal, ayat (null: no filter).
Many queries are one job: a stated set of them against all points, in blocks of BROADCAST_BYTES. Candidates are ids and filter
columns only; each task keeps the best of every query and tier before anything is exchanged (best_pairs), and contents
are joined to the few that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.functions.text import strip

# Limits and weights of the search.
THRESHOLD, RATIO, RETRY, LIMIT = 0.15, 0.7, 0.3, 5
ARTICLE_BOOST, PARAGRAPH_BOOST = 0.5, 0.3
#: Bytes of queries that one broadcast may hold.
BROADCAST_BYTES = 64 << 20
#: Queries and points that meet as one matrix in a task.
ROWS, COLUMNS = 64, 4096
# The filters of the tiers, each with the columns of points that may pass it.
FILTERS = {"section": ("section",), "pasal": ("pasal", "pasal_number"), "ayat": ("ayat", "ayat_number")}
TIERS = (("section", "pasal", "ayat"), ("section", "pasal"), ())
# Names of sections that filter nothing.
ALL_SECTIONS = ("semua", "all", "")


def pool_sizes(limit: int = LIMIT, rerank: bool = False) -> tuple[int, int]:
    """Candidates kept for ranking, and candidates fetched."""
    pool = max(4 * limit, 8) if rerank else limit
    return pool, max(3 * pool, 10)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up, as all engines round alike."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def embedded(rows: DataFrame, embedder, text_col: str = "text", unit: bool = True, batch: int = 32) -> DataFrame:
    """rows with an embedding column by a seam: embedder maps a list of texts to a list of vectors."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(texts), batch):
            for v in embedder([t or "" for t in texts[a : a + batch]]):
                size = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([float(x) / size for x in v] if unit else [float(x) for x in v])
        return pd.Series(out)

    return rows.withColumn("embedding", embed(text_col))


def with_filters(queries: DataFrame) -> DataFrame:
    """queries (section_type, pasal_type, ayat_type as text) with section, pasal and ayat: the first whole number of a text; section names that mean all filter nothing."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")
    section = F.when(~F.lower(strip("section_type")).isin(*ALL_SECTIONS), F.col("section_type"))
    return queries.withColumns({"section": section, "pasal": number("pasal_type"), "ayat": number("ayat_type")}).drop("section_type", "pasal_type", "ayat_type")


def _blocks(queries: DataFrame, broadcast_bytes: int) -> list[DataFrame]:
    """queries with filters and vector as q_ columns, in blocks of about so many bytes."""
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("embedding", *FILTERS)), "query_id")
    size = q.agg(F.sum(F.size("q_embedding") * 16 + 100)).first()[0] or 0
    blocks = max(1, -(-size // broadcast_bytes))
    return [q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)]


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors by length. Null and vectors that hold null are none."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = pc.fill_null(pc.list_value_length(flat), -1).to_numpy(zero_copy_only=False)
    values, parents = pc.list_flatten(flat), pc.list_parent_indices(flat).to_numpy(zero_copy_only=False)
    if values.null_count:
        sizes = sizes.copy()
        sizes[parents[pc.is_null(values).to_numpy(zero_copy_only=False)]] = -1
    numbers, of_row = values.to_numpy(zero_copy_only=False).astype(np.float64), sizes[parents]
    return {int(n): (np.flatnonzero(sizes == n), numbers[of_row == n].reshape(-1, n) if n else np.zeros((int((sizes == 0).sum()), 0))) for n in np.unique(sizes) if n >= 0}


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows, each summed in the order of its components as dot() does, so equal vectors have equal sums."""
    out, part, across = np.zeros((len(a), len(b))), np.empty((len(a), len(b))), np.ascontiguousarray(b.T)
    for d in range(a.shape[1]):
        np.multiply(a[:, d, None], across[d], out=part)
        out += part
    return out


def _sizes(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * a[:, d]
    return np.sqrt(out)


def best_of(asked: pa.Table, tiers: Sequence[Sequence[str]], fetch: int, unit: bool, threshold: float, order: str):
    """A function over batches of points: rows of points and queries with raw, at least the best so many of each query and tier."""
    wanted = _vectors(asked["q_embedding"])
    own = {c: pc.unique(asked[f"q_{c}"]).drop_null() for c in FILTERS}
    codes = {c: pc.fill_null(pc.index_in(asked[f"q_{c}"], value_set=own[c]), -1).to_numpy() for c in FILTERS}
    queries = asked.drop_columns(["q_embedding"])
    # each query's tiers by the filters it has; those that come to the same are one
    rules = [list(dict.fromkeys(tuple(c for c in tier if codes[c][n] >= 0) for tier in tiers)) for n in range(len(asked))]
    bars = [[-np.inf] * len(r) for r in rules]

    def same(column: pa.ChunkedArray, c: str) -> np.ndarray:
        if pa.types.is_null(own[c].type) or not len(own[c]):
            return np.full(len(column), -2)
        kind = pa.int64() if pa.types.is_integer(own[c].type) else own[c].type
        return pc.fill_null(pc.index_in(column.cast(kind), value_set=own[c].cast(kind)), -2).to_numpy()

    def chosen(raw: np.ndarray, n: int, have: dict[str, list[np.ndarray]], at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Places in a row of scores that a query keeps."""
        key = np.where(np.isnan(raw), np.inf, raw)  # as Spark orders them
        fits, kept = key >= threshold, []
        for k, rule in enumerate(rules[n]):
            good = fits & (key >= bars[n][k])
            for c in rule:
                passed = np.zeros(len(at), bool)
                for column in have[c]:
                    passed |= column[at] == codes[c][n]
                good &= passed
            found = np.flatnonzero(good)
            if len(found) >= fetch:
                bars[n][k] = np.partition(key[found], -fetch)[-fetch]
                found = found[key[found] >= bars[n][k]]
                if len(found) > fetch:  # ties go by the points' order
                    found = found[np.lexsort((place[at[found]], -key[found], ~np.isnan(raw[found])))[:fetch]]
            kept.append(found)
        return np.unique(np.concatenate(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = pa.Table.from_batches([batch])
            have = {c: [same(points[name], c) for name in names if name in points.column_names] for c, names in FILTERS.items()}
            place = np.empty(len(points), np.int64)
            place[pc.sort_indices(points[order]).to_numpy()] = np.arange(len(points))
            lean, vectors = points.drop_columns(["embedding"]), _vectors(points["embedding"])
            for n in vectors.keys() & wanted.keys():
                (rows, b), (ids, a) = vectors[n], wanted[n]
                for x in range(0, len(b), COLUMNS):
                    at, part = rows[x : x + COLUMNS], b[x : x + COLUMNS]
                    for y in range(0, len(a), ROWS):
                        raw = _sums(a[y : y + ROWS], part)
                        if not unit:
                            size = _sizes(part) * _sizes(a[y : y + ROWS])[:, None]
                            with np.errstate(divide="ignore", invalid="ignore"):
                                raw = np.where(size == 0, -np.inf, raw / size)  # no cosine: no pair
                        some = [(k, chosen(raw[k - y], ids[k], have, at, place)) for k in range(y, min(y + ROWS, len(a)))]
                        left, right = np.concatenate([at[f] for _, f in some]), np.repeat(ids[y : y + ROWS], [len(f) for _, f in some])
                        if len(left):
                            out = lean.take(pa.array(left)).combine_chunks()
                            of_query = queries.take(pa.array(right)).combine_chunks()
                            for name in of_query.column_names:
                                out = out.append_column(name, of_query[name])
                            yield from out.append_column("raw", pa.array(np.concatenate([raw[k - y][f] for k, f in some]))).to_batches()

    return run


def best_pairs(queries: DataFrame, points: DataFrame, fetch: int, unit: bool = False, threshold: float = THRESHOLD, tiers: Sequence[Sequence[str]] = TIERS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of scored(), among them the first so many of each query and tier (by raw, then chunk_id): all that tiered() looks at.

    Points stay where they are. A task scores each batch of them against a block of queries as matrices and keeps of a tier what reaches
    the best that it has seen so far, so hardly more rows leave a task than are fetched.
    """
    lean = points.drop("content")
    out = None
    for part in _blocks(queries, broadcast_bytes):
        kept = T.StructType([*lean.drop("embedding").schema, *part.drop("q_embedding").schema, T.StructField("raw", T.DoubleType())])
        hits = lean.mapInArrow(best_of(part.toArrow(), tiers, fetch, unit, threshold, "chunk_id"), T.StructType([T.StructField(f.name, f.dataType) for f in kept]))
        out = hits if out is None else out.unionByName(hits)
    return out


def scored(queries: DataFrame, points: DataFrame, unit: bool = False, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every pair of query and point at or above the threshold, without contents. A stated set of queries against all points."""
    measure = dot if unit else cosine
    lean = points.drop("content")
    out = None
    for part in _blocks(queries, broadcast_bytes):
        hits = lean.join(F.broadcast(part)).withColumn("raw", measure(F.col("embedding"), F.col("q_embedding"))).where(F.col("raw") >= threshold).drop("embedding", "q_embedding")
        out = hits if out is None else out.unionByName(hits)
    return out


def _passes(asked: str, *have: str) -> Column:
    out = F.col(asked).isNull()
    for c in have:
        out = out | F.coalesce(F.col(c) == F.col(asked), F.lit(False))
    return out


def tiered(pairs: DataFrame, fetch: int) -> DataFrame:
    """The first tier that counts for each query: A with all filters, B without the paragraph, C without filters.

    C is taken when an article or paragraph was asked for and the tier so far is empty or weak. Spark keeps the first
    of each query and tier in every task, so the windows see few rows.
    """
    section, pasal, ayat = _passes("q_section", "section"), _passes("q_pasal", "pasal", "pasal_number"), _passes("q_ayat", "ayat", "ayat_number")
    for c in ("pasal_number", "ayat_number"):  # older tables name their columns so
        if c not in pairs.columns:
            pairs = pairs.withColumn(c, F.lit(None).cast("int"))
    both = F.col("q_pasal").isNotNull() & F.col("q_ayat").isNotNull()
    asked = F.col("q_pasal").isNotNull() | F.col("q_ayat").isNotNull()
    tiers = F.array_compact(F.array(F.when(section & pasal & ayat, "A"), F.when(both & section & pasal, "B"), F.when(asked, "C")))
    rank = F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(F.desc("raw"), "chunk_id"))
    t = pairs.withColumn("tier", F.explode(tiers)).withColumn("rank", rank).where(F.col("rank") <= fetch)
    w = Window.partitionBy("query_id")
    t = t.withColumns({f"max_{k}": F.max(F.when(F.col("tier") == k.upper(), F.col("raw"))).over(w) for k in "ab"})
    best = F.coalesce("max_a", "max_b")
    chosen = F.when(asked & (best.isNull() | (best < RETRY)), "C").when(F.col("max_a").isNotNull(), "A").otherwise("B")
    return t.where(F.col("tier") == chosen).drop("max_a", "max_b").withColumn("pasal_not_found", F.col("tier") == "C")


def effective(points: DataFrame) -> DataFrame:
    """With the article and paragraph that a point stands for, whatever column has them."""
    have = lambda *names: F.coalesce(*(F.col(c) for c in names if c in points.columns))
    return points.withColumns({"eff_pasal": have("pasal", "pasal_rujukan", "pasal_number"), "eff_ayat": have("ayat", "ayat_number")})


def cut_relative(hits: DataFrame, pool: int, ratio: float = RATIO) -> DataFrame:
    """Scores of at least ratio times the best, and exact matches whatever their score; then the first so many."""
    w = Window.partitionBy("query_id")
    exact = F.coalesce((F.col("eff_pasal") == F.col("q_pasal")) & (F.col("q_ayat").isNull() | (F.col("eff_ayat") == F.col("q_ayat"))), F.lit(False))
    kept = effective(hits).withColumn("exact", exact).withColumn("top", F.max("raw").over(w)).where((F.col("raw") >= F.col("top") * ratio) | F.col("exact"))
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("raw"), "chunk_id"))).where(F.col("rank") <= pool).drop("top")


def boosted(hits: DataFrame) -> DataFrame:
    """Rounded score, raised for the asked article and paragraph, at most 1; ranked again, stable."""
    base = rounded(F.col("raw"))
    pasal = F.coalesce(F.col("eff_pasal") == F.col("q_pasal"), F.lit(False))
    ayat = pasal & F.coalesce(F.col("eff_ayat") == F.col("q_ayat"), F.lit(False))
    one = F.when(pasal, F.least(rounded(base + ARTICLE_BOOST), F.lit(1.0))).otherwise(base)
    two = F.when(ayat, F.least(rounded(one + PARAGRAPH_BOOST), F.lit(1.0))).otherwise(one)
    out = hits.withColumns({"exact_pasal": pasal, "exact_ayat": ayat, "score": two})
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def reranked(hits: DataFrame, logit: Column, limit: int) -> DataFrame:
    """Ordered by exactness and the scorer's probability; the first so many."""
    out = hits.withColumn("rerank_score", rounded(1 / (1 + F.exp(-logit))))
    w = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("rerank_score"), "rank")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def with_parents(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Each hit with its parent's content and article; of parents with one id the first counts."""
    w = Window.partitionBy("kb", "chunk_id").orderBy("content")
    parents = points.where("role = 'parent'").withColumn("n", F.row_number().over(w)).where("n = 1")
    parents = parents.select("kb", F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"), F.col("pasal").alias("parent_pasal"), F.col("pasal_rujukan").alias("parent_rujukan"))
    return hits.join(parents, ["kb", "parent_id"], "left")


def rerank_text(content: Column, parent_content: Column, least: int = 30) -> Column:
    """What a scorer reads: the parent's content where it is long enough, else the hit's."""
    return F.when(F.length(strip(parent_content)) > least, parent_content).otherwise(F.coalesce(content, F.lit("")))


def shaped(hits: DataFrame) -> DataFrame:
    """query_id, rank, score, flags, and structs child and parent; a missing parent has empty content."""
    child = F.struct("chunk_id", "section", F.coalesce("content", F.lit("")).alias("content"), F.col("eff_pasal").alias("pasal"), F.col("eff_ayat").alias("ayat"), "parent_id", "pasal_rujukan")
    parent = F.struct(F.when(F.col("parent_content").isNotNull(), F.col("parent_id")).alias("chunk_id"), F.coalesce("parent_content", F.lit("")).alias("content"), F.col("parent_pasal").alias("pasal"), F.col("parent_rujukan").alias("pasal_rujukan"))
    return hits.select("query_id", "rank", "score", "exact_pasal", "exact_ayat", "pasal_not_found", child.alias("child"), parent.alias("parent"))


def search(queries: DataFrame, points: DataFrame, limit: int = LIMIT, unit: bool = False, logit: Column | None = None, threshold: float = THRESHOLD, pairs: DataFrame | None = None) -> DataFrame:
    """The whole search over child points: tiers, relative cut, boosts, optional reranking, contents and parents.

    pairs: candidates that an index has found (vector_index.candidate_pairs), instead of all pairs.
    """
    pool, fetch = pool_sizes(limit, logit is not None)
    found = pairs if pairs is not None else best_pairs(queries, points.where("role = 'child'"), fetch, unit, threshold)
    hits = boosted(cut_relative(tiered(found, fetch), pool))
    contents = points.where("role = 'child'").select("kb", "chunk_id", "content")
    hits = with_parents(hits.join(contents, ["kb", "chunk_id"]), points)
    return reranked(hits, logit, limit) if logit is not None else hits.where(F.col("rank") <= limit)
