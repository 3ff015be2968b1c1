"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

1. One pass over all texts sums, for every word and every shape of words (capitals, signs, digits), the index vectors of
   the words beside it. An index vector has a few +1 and -1, at places that the word's hash gives, so no table of
   them is needed. Sums are pre-aggregated in the map tasks and added up by word behind an exchange and a sort, so
   what a task holds does not grow with the vocabulary.
2. The roots of the sums, at unit length, are the vectors. Those of the most frequent words (at most HEAD, all with LEAST
   occurrences) travel with the tasks; any other word is worth the index vectors beside it in its own text, which
   is what its vector is a sum of. A second pass pools each document and adds length, repetition and variety.
3. The network is fitted on the driver, on at most SAMPLE labelled documents (the first in order of a hash);
   a fifth of them is kept back to fit the temperature that calibrates the probabilities.
4. All documents are scored where their features lie.

Labels, language, source and id are never inputs of a score. Defined results: null and empty texts get a
score as well (that of an empty pool); rows of labels with a null id or label are ignored, of repeated ones
the largest label counts, and of labelled rows that repeat an id the one whose features come first; without labels
of both kinds every score is the share of label 1 (0.5 without any); repeated rows get equal scores; extra columns
are kept out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.support import LOWER, fresh, map_batches, materialise, partitions, text_bytes, with_text_key

#: Dimensions, and entries of an index vector that are not 0.
DIM, ENTRIES = 32, 4
#: Words and shapes whose vectors travel with the tasks, at most, and occurrences that a vector needs.
HEAD, LEAST = 200_000, 5
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH, STEP, DECAY = 24, 40, 256, 0.01, 1e-4
#: Words that a task knows at a time, words of a text that are pooled at a time, and rows of sums that are added up and packed at a time.
_CACHE, _STRETCH, _ROWS = 300_000, 50_000, 20_000
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class Words(dict):
    """word -> its number in this task, with arrays of the hashes of words and shapes and of index vectors."""

    def __init__(self) -> None:
        self.new_words: list[int] = []
        self.new_shapes: list[int] = []
        self.known_shapes: dict[bytes, int] = {}
        self.words, self.shapes = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.index = np.zeros((0, DIM), np.int8)

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.new_words.append(xxhash.xxh3_64_intdigest(word.translate(LOWER)))
        signs = word.translate(_SHAPE)
        if (shape := self.known_shapes.get(signs)) is None:
            self.known_shapes[signs] = shape = xxhash.xxh3_64_intdigest(_RUNS.sub(rb"\1\1", signs)[-6:], seed=1)
        self.new_shapes.append(shape)
        return k

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """The words of each text, and the arrays brought up to date."""
        out = [np.array([self[w] for w in t.split()], np.int64) for t in texts]
        if self.new_words:
            h = np.array(self.new_words, np.uint64)
            self.words = np.concatenate([self.words, h])
            self.shapes = np.concatenate([self.shapes, np.array(self.new_shapes, np.uint64)])
            self.index = np.concatenate([self.index, index_vectors(h)])
            self.new_words, self.new_shapes = [], []
        return out


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """ENTRIES of +1 or -1 for each hash; the places of one hash are in different parts of the vector."""
    out, rows, part = np.zeros((len(hashes), DIM), np.int8), np.arange(len(hashes)), DIM // ENTRIES
    for k in range(ENTRIES):
        bits = hashes >> np.uint64(12 * k)
        out[rows, k * part + (bits % np.uint64(part)).astype(np.int64)] = np.where(bits >> np.uint64(8) & np.uint64(1), 1, -1)
    return out


def _added(h: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with equal hashes added up."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return (h[first], np.add.reduceat(n[order], first), np.add.reduceat(total[order], first, dtype=np.int64)) if len(h) else (h, n, total)


def _sum_rows(h: np.ndarray, n: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows added up by hash, with the sums in the smallest numbers that hold them: half a byte each for rare words. A hash at the end of _ROWS goes on in the next."""
    order = np.argsort(h, kind="stable")
    for a in range(0, len(order), _ROWS):
        at = order[a : a + _ROWS]
        hashes, counts, sums = _added(h[at], n[at], total[at])
        most = np.abs(sums).max(1, initial=0)
        for kind, low, high in ((None, -1, 7), (np.int8, 7, 127), (np.int16, 127, 32767), (np.int64, 32767, np.inf)):
            part = np.flatnonzero((most > low) & (most <= high))
            if len(part):
                data = sums[part].astype(kind) if kind else _halves(sums[part])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[part].view(np.int64)), pa.array(counts[part]), pa.array([r.tobytes() for r in data], pa.binary())], ["h", "n", "sum"])


def _halves(total: np.ndarray) -> np.ndarray:
    half = (total + 8).astype(np.uint8)
    return half[:, ::2] | half[:, 1::2] << 4


def _whole(halves: np.ndarray) -> np.ndarray:
    out = np.empty((len(halves), DIM), np.int64)
    out[:, ::2], out[:, 1::2] = halves & 15, halves >> 4
    return out - 8


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emptied() -> Iterator[pa.RecordBatch]:
        # what stands beside a shape is what stands beside its words
        for hashes in (words.words, words.shapes):
            yield from _sum_rows(hashes, n[: len(words)], total[: len(words)])

    words, n, total = Words(), np.zeros(0, np.int64), np.zeros((0, DIM), np.int32)
    for b in batches:
        texts = words.numbers(b.column(0).to_pylist())
        if len(words) > len(n):
            n.resize(len(words) + 50_000, refcheck=False)  # with zeros, and without a second copy
            total.resize((len(words) + 50_000, DIM), refcheck=False)
        flat = np.concatenate([*texts, np.zeros(0, np.int64)])
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for a in range(0, len(flat), _STRETCH):
            here = np.arange(a, min(len(flat), a + _STRETCH))
            near = np.zeros((len(here), DIM), np.int8)
            for step in (-1, 1):
                at = np.flatnonzero((here + step >= 0) & (here + step < len(flat)))
                at = at[text[here[at] + step] == text[here[at]]]
                near[at] += words.index[flat[here[at] + step]]
            order = np.argsort(flat[here], kind="stable")
            word = flat[here][order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            n[word[first]] += np.diff(np.append(first, len(word)))
            total[word[first]] += np.add.reduceat(near[order], first, dtype=np.int32)
        if len(words) > _CACHE:
            yield from emptied()
            words, n, total = Words(), np.zeros(0, np.int64), np.zeros((0, DIM), np.int32)
    yield from emptied()


def _sums(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, occurrences and sums of the rows of _sum_rows."""
    data = b.column(2).to_pylist()
    size, total = np.array([len(d) for d in data]), np.zeros((len(data), DIM), np.int64)
    for kind, width in ((np.uint8, DIM // 2), (np.int8, DIM), (np.int16, 2 * DIM), (np.int64, 8 * DIM)):
        at = np.flatnonzero(size == width)
        part = np.frombuffer(b"".join([data[i] for i in at]), kind).reshape(len(at), width // np.dtype(kind).itemsize)
        total[at] = _whole(part) if width == DIM // 2 else part
    return b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), total


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, in order of the hashes: words with LEAST occurrences, and their vectors in bytes. Held are a batch and the word that may go on in the next."""

    def vectors(hashes: np.ndarray, counts: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        often = counts >= LEAST
        hashes, counts, total = hashes[often], counts[often], total[often]
        rooted = np.sign(total) * np.sqrt(np.abs(total))  # else the most frequent neighbours drown the others
        norm = np.sqrt((rooted**2).sum(1, keepdims=True))
        data = np.round(rooted / np.where(norm > 0, norm, 1) * 127).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts), pa.array([v.tobytes() for v in data], pa.binary())], ["h", "n", "vector"])

    held = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, DIM), np.int64)
    for b in batches:
        if b.num_rows:
            rows = _sums(b)
            last = rows[0][-1]
            rows = _added(*(np.concatenate(c) for c in zip(held, rows, strict=True)))
            done = rows[0] != last
            yield vectors(*(c[done] for c in rows))
            held = tuple(c[~done] for c in rows)
    yield vectors(*held)


class Vectors:
    """Sorted hashes and the vectors of the most frequent words and shapes."""

    def __init__(self, hashes: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.vectors = hashes[order], vectors[order]

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        at = np.searchsorted(self.hashes, hashes)
        found = at < len(self.hashes)
        found[found] = self.hashes[at[found]] == hashes[found]
        return np.where(found, at, -1)


def word_vectors(docs: DataFrame, text_col: str = "text", head: int = HEAD) -> Vectors:
    """Vectors learned from every text, of at most so many words: all above a count."""
    parts = map_batches(docs.select(text_bytes(text_col).alias("text")), _neighbours, "h long, n long, sum binary")
    table = materialise(map_batches(parts.repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h"), _vectors, "h long, n long, vector binary"), "vectors")
    band = F.floor(F.log2("n") * 8).cast("int")
    least, taken = 1 << 30, 0
    for k, n in sorted(map(tuple, table.groupBy(band).count().collect()), reverse=True):
        if taken + n > head:
            break
        least, taken = k, taken + n
    rows = table.where(band >= least).select("h", "vector").toArrow()
    vectors = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.int8).reshape(-1, DIM)
    return Vectors(rows.column(0).to_numpy().astype(np.int64).view(np.uint64), vectors)


WIDTH = 2 * DIM + 4


def pool(word: np.ndarray, n_bytes: int, words: Words, own: np.ndarray, shape: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of words and shapes, then log length, share of repeated words, variety, and log mean word length. own, shape: rows of vectors for the words of a task."""
    out = np.zeros(WIDTH, np.float32)
    if n := len(word):
        for a in range(0, n, _STRETCH):
            at = np.arange(a, min(n, a + _STRETCH))
            w, s = own[word[at]], shape[word[at]]
            out[:DIM] += vectors[w[w >= 0]].sum(0)
            out[DIM : 2 * DIM] += vectors[s[s >= 0]].sum(0)
            if len(rare := at[w < 0]):
                near = np.zeros((len(rare), DIM), np.float32)
                near[rare > 0] += words.index[word[rare[rare > 0] - 1]]
                near[rare < n - 1] += words.index[word[rare[rare < n - 1] + 1]]
                norm = np.sqrt((near**2).sum(1, keepdims=True))
                out[:DIM] += (near / np.where(norm > 0, norm, 1)).sum(0)
        out[: 2 * DIM] /= n
        out[2 * DIM :] = np.log1p(n), (word[1:] == word[:-1]).sum() / n, len(np.unique(word)) / n**0.7, np.log1p(n_bytes / n)
    return out


def _pooled(known: Vectors):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = Words(), known.vectors.astype(np.float32)
        vectors /= 127
        own = shape = np.zeros(0, np.int64)
        for b in batches:
            texts = b.column(1).to_pylist()
            numbers = words.numbers(texts)
            own = np.concatenate([own, known.rows(words.words[len(own) :])])
            shape = np.concatenate([shape, known.rows(words.shapes[len(shape) :])])
            rows = [pool(w, len(t), words, own, shape, vectors) for w, t in zip(numbers, texts, strict=True)]
            flat = pa.array(np.concatenate([*rows, np.zeros(0, np.float32)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), flat), *b.columns[2:]], ["id", "features", *b.schema.names[2:]])
            if len(words) > _CACHE:
                words, own, shape = Words(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    return run


class Network:
    """Standardised inputs, one hidden layer of tanh, one output; the logit is divided by a temperature."""

    def __init__(self) -> None:
        self.constant: float | None = 0.5
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
        if len(y) < 20 or not 0 < y.sum() < len(y):
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.constant = None
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        held = np.arange(len(y)) % 5 == 4
        a, b = z[~held], y[~held]
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(b))
            for k in range(0, len(b), BATCH):
                i = order[k : k + BATCH]
                h = np.tanh(a[i] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - b[i]) / len(i)
                back = np.outer(e, p[2]) * (1 - h * h)
                t += 1
                for j, g in enumerate((a[i].T @ back + DECAY * p[0], back.sum(0), h.T @ e + DECAY * p[2], e.sum(keepdims=True))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] = p[j] - STEP * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        logit, truth = self._logit(x[held]), y[held]
        losses = {s: np.logaddexp(0, np.where(truth > 0, -logit, logit) / s).mean() for s in np.geomspace(0.5, 8, 33)}
        self.temperature = float(min(losses, key=losses.get))
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -60, 60)))


def _scored(network: Network):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.score(x)), *b.columns[2:]], ["id", "score", *b.schema.names[2:]])

    return run


def held_out(id_column: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, row_col: str | None = None) -> DataFrame:
    """id, held_out, score and predicted of every row of docs, and its row_col if one is named."""
    vectors = word_vectors(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    rest = rows.schema.fields[2:]
    kind = rows.schema["id"].dataType
    features = materialise(map_batches(rows, _pooled(vectors), T.StructType([T.StructField("id", kind), T.StructField("features", T.ArrayType(T.FloatType())), *rest])), "features")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("label").isin(0, 1))
    order = F.xxhash64(F.col("id").cast("string"))
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    chosen = marks.join(features.select("id"), "id", "left_semi").orderBy(order, "id").limit(sample)
    once = features.select("id", "features").join(chosen, "id").groupBy("id", "label").agg(F.min("features").alias("features"))
    taken = once.withColumn("o", order).orderBy("o", "id").select("features", "label").toPandas()
    x = np.array(taken["features"].tolist(), np.float64).reshape(len(taken), WIDTH)
    network = Network().fit(x, taken["label"].to_numpy(float))
    scored = map_batches(features, _scored(network), T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType()), *rest]))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *([F.col("row").alias(row_col)] if row_col else []))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    rows, key = with_text_key(docs, text_col)
    rejected, digest = fresh(rows.columns, "rejected"), fresh(rows.columns, "rejected_digest")
    bad = score_quality(rows, labels, id_col, text_col, row_col=key).where("predicted = 0").select(F.col(id_col).alias(rejected), F.col(key).alias(digest)).distinct()
    return rows.join(bad, F.col(id_col).eqNullSafe(F.col(rejected)) & (F.col(key) == F.col(digest)), "left_anti").drop(key)
