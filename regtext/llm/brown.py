"""Brown class-based bigrams.

1. Words of the training texts are counted (pre-aggregated in the map tasks). The vocabulary stays a table.
2. The TOP most frequent words are clustered by exchange: each word in turn moves to the class that raises the
   likelihood of the class bigrams most, by the counts of all neighbouring words in one matrix of bounded size.
3. Every other word that was seen LEAST times then goes to the class that raises the likelihood most, by the classes
   of all its neighbours, which are added up by word in an exchange; so the classes cover a vocabulary that grows with
   the corpus. Rarer words, whose neighbours say too little, have a class of their own, which stands for unknown words as well.
4. P(w | v) = P(class(w) | class(v)) * P(w | class(w)); transitions are counted over all training texts and
   interpolated with the class's share, emissions add one half to each count.
5. Each text is stored as the classes of its words, a byte for each, by those of the most frequent words, which are sent to
   the tasks (at most HEAD); those of all other words come by a join, each once for a text. Transitions are counted, and texts
   scored, from these bytes. The result does not depend on HEAD.

Words are known by a 62-bit hash. Defined results: null and empty texts have the end token only; without
training texts every count is 0; repeated rows are scored one by one (and counted each time); a null id
belongs to the training rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.packed import SCHEMA, blocks_of, summed
from regtext.llm.support import LOWER, map_batches, materialise, partitions, text_bytes

#: Words that are exchanged with each other, classes for them, rounds of exchange.
TOP, CLASSES, ROUNDS = 1024, 48, 6
#: Occurrences that a word needs for one of these classes.
LEAST = 2
#: Words whose counts and classes are sent to the tasks, at most: 17 bytes each.
HEAD = 4_000_000
#: Rows of the matrix after the exchanged words: the end, and all others.
END_ROW, OTHER_ROW, ROWS = TOP, TOP + 1, TOP + 2
#: Classes after the exchanged ones: the end, and rare words (and unknown ones).
END_CLASS, RARE, N = CLASSES, CLASSES + 1, CLASSES + 2
#: Weight of a class's share in its transitions.
PRIOR = 8.0
#: The code of a word whose class is not known in the task; no class has this number.
OUTSIDE, _PARTED = 255, b"\xff"
#: What a text is stored as between the passes: sizes, sums, a byte for each word, and its words outside the head with their neighbours.
CODED = ["n_tokens", "known", "base", "emitted", "codes", "tail", "times", "pairs"]
_FLUSH, _CACHE, _BLOCK = 300_000, 300_000, 1 << 16
_WORDS62 = (1 << 62) - 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & _WORDS62


#: No word holds a line break.
END = word_hash(b"\n")


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["h", "c"])

    found: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            found.update(text.translate(LOWER).split())
            found[b"\n"] += 1
        if len(found) > _FLUSH:
            yield flush()
            found = Counter()
    if found:
        yield flush()


class Rows(dict):
    """word -> its row of the matrix; emptied when it is full."""

    def __init__(self, top: dict[int, int]) -> None:
        self.top = top

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = got = self.top.get(word_hash(word), OTHER_ROW)
        return got


def _bigrams(top: dict[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(ROWS * ROWS, np.int64), Rows(top)
        for b in batches:
            codes = []
            for text in b.column(0).to_pylist():
                r = np.array([END_ROW, *(rows[w] for w in text.translate(LOWER).split()), END_ROW], np.int64)
                codes.append(r[:-1] * ROWS + r[1:])
            if codes:
                total += np.bincount(np.concatenate(codes), minlength=ROWS * ROWS)
        yield from blocks_of(total, _BLOCK, TaskContext.get().partitionId())

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(matrix: np.ndarray, words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for every row: the first so many rows are words to cluster, every other row is a class of its own."""
    m = matrix.astype(float)
    n_rows = len(m)
    label = np.concatenate([np.arange(words) % classes, classes + np.arange(n_rows - words)]).astype(int)
    n = classes + n_rows - words
    onto = np.zeros((n_rows, n))
    onto[np.arange(n_rows), label] = 1
    right, left = m @ onto, m.T @ onto  # of each row: followers and predecessors by class
    big = onto.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            old, own = label[w], m[w, w]
            r, lf = right[w].copy(), left[w].copy()
            r[old] -= own
            lf[old] -= own
            big[old] -= r
            big[:, old] -= lf
            big[old, old] -= own
            rows, cols = big[:classes], big[:, :classes].T
            diag = big[np.arange(classes), np.arange(classes)]
            gain = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(cols + lf) - _xlogx(cols)).sum(1)
            gain -= _xlogx(diag + r[:classes]) + _xlogx(diag + lf[:classes]) - 2 * _xlogx(diag)
            gain += _xlogx(diag + r[:classes] + lf[:classes] + own) - _xlogx(diag)
            out, into = rows.sum(1), cols.sum(1)
            gain -= _xlogx(out + r.sum() + own) - _xlogx(out) + _xlogx(into + lf.sum() + own) - _xlogx(into)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            big[new] += r
            big[:, new] += lf
            big[new, new] += own
            if new != old:
                moved += 1
                label[w] = new
                right[:, old] -= m[:, w]
                right[:, new] += m[:, w]
                left[:, old] -= m[w]
                left[:, new] += m[w]
        if not moved:
            break
    return label


class Head:
    """The most frequent words: sorted hashes, their counts and classes. whole: no other word has a class but RARE."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, whole: bool) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts, self.classes, self.whole = hashes[order], counts[order], classes[order].astype(np.int8), whole

    def place(self, h: int) -> int:
        i = int(np.searchsorted(self.hashes, h))
        return i if i < len(self.hashes) and self.hashes[i] == h else -1


class Contexts(dict):
    """word -> the class of its row; for words without a row a number behind the classes, and its hash. head: all words that get a class, if it is whole; else any word may."""

    def __init__(self, top: dict[int, int], label: np.ndarray, head: Head) -> None:
        self.top, self.label, self.head = top, label, head
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        if h in self.top:
            self[word] = got = int(self.label[self.top[h]])
        elif self.head.whole and self.head.place(h) < 0:
            self[word] = got = RARE
        else:
            self[word] = got = N + len(self.hashes)
            self.hashes.append(h)
        return got


def _contexts(top: dict[int, int], label: np.ndarray, head: Head):
    """For each word without a row: how often each class stands before it, and (N further) behind it. In the order of codes, counts up to 255."""

    def emptied(known: Contexts, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
        if not len(keys):
            return
        # a count above 255 stands in several entries
        times = -(-counts // 255)
        keys, left = np.repeat(keys, times), np.repeat(counts, times)
        left = np.minimum(255, left - 255 * (np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)))
        word, code, n = keys // (2 * N), (keys % (2 * N)).astype(np.uint8), left.astype(np.uint8)
        cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        hashes, both = np.array(known.hashes, np.int64)[word[cuts]], np.stack([code, n], 1)
        for a in range(0, len(cuts), 20_000):
            ends = np.append(cuts, len(word))[a : a + 20_001]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[a : a + 20_000]), pa.array([both[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["h", "codes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, held = Contexts(top, label, head), [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                w = np.array([END_CLASS, *(known[x] for x in text.translate(LOWER).split()), END_CLASS], np.int64)
                at = np.flatnonzero(w >= N)
                c = np.minimum(w, RARE)
                parts += [(w[at] - N) * (2 * N) + c[at - 1], (w[at] - N) * (2 * N) + N + c[at + 1]]
                held += 2 * len(at)
            if held > 4_000_000 or len(known) > 2 * _CACHE:
                yield from emptied(known, parts)
                known, parts, held = Contexts(top, label, head), [], 0
        yield from emptied(known, parts)

    return run


def _assign(big: np.ndarray, least: int):
    """Reduce side, words in order: the class that raises the likelihood most, for each word seen so often."""
    rows, cols = big[:CLASSES].T, big[:, :CLASSES]
    around = np.concatenate([cols, rows])  # of a code before or behind a word: the counts with each class
    out, into = big[:CLASSES].sum(1), big[:, :CLASSES].sum(0)
    small = np.stack([_xlogx(around + n) - _xlogx(around) for n in range(1, 9)])

    def best(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of occurrences and class of the words 0, 1, .. whose entries are given in order."""
        keys, which = np.unique(word * (2 * N) + code, return_inverse=True)
        n = np.bincount(which, n, len(keys)).astype(np.int64)
        word, code = keys // (2 * N), keys % (2 * N)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        seen = np.add.reduceat(n, first) // 2
        classes = np.empty(len(first), np.int64)
        ends = np.append(first, len(word))
        for a in range(0, len(first), 2000):
            x, y = ends[a], ends[min(len(first), a + 2000)]
            part, m = slice(x, y), n[x:y, None]
            gain = np.where(m <= 8, small[np.minimum(n[part], 8) - 1, code[part]], 0.0)
            if (more := np.flatnonzero(n[part] > 8)).size:
                base = around[code[part][more]]
                gain[more] = _xlogx(base + m[more]) - _xlogx(base)
            total = np.add.reduceat(gain, first[a : a + 2000] - x)
            s = seen[a : a + 2000, None]
            total -= _xlogx(out + s) - _xlogx(out) + _xlogx(into + s) - _xlogx(into)
            classes[a : a + 2000] = total.argmax(1)
        return seen, classes

    def rows_of(hashes: list[int], codes: list[bytes]) -> pa.RecordBatch:
        new = np.concatenate([[True], np.diff(np.array(hashes, np.int64)) != 0])
        sizes = np.array([len(c) // 2 for c in codes])
        flat = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 2).astype(np.int64)
        seen, classes = best(np.repeat(np.cumsum(new) - 1, sizes), flat[:, 0], flat[:, 1])
        kept = seen >= least
        return pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.int64)[new][kept]), pa.array(classes[kept].astype(np.int32))], ["h", "class"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        codes: list[bytes] = []
        for b in batches:
            hashes += b.column(0).to_pylist()
            codes += b.column(1).to_pylist()
            cut = len(hashes)
            while cut and hashes[cut - 1] == hashes[-1]:  # the last word may go on in the next batch
                cut -= 1
            if cut:
                yield rows_of(hashes[:cut], codes[:cut])
                hashes, codes = hashes[cut:], codes[cut:]
            elif len(codes) > 10_000:
                codes, hashes = [_folded(codes)], hashes[:1]
        if hashes:
            yield rows_of(hashes, codes)

    return run


def _folded(codes: list[bytes]) -> bytes:
    """Entries of one word as one value: what is counted together stands together."""
    flat = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, 2).astype(np.int64)
    counts = np.bincount(flat[:, 0], flat[:, 1], 2 * N).astype(np.int64)
    times = -(-counts // 255)
    code = np.repeat(np.arange(2 * N), times)
    left = np.minimum(255, np.repeat(counts, times) - 255 * (np.arange(len(code)) - np.repeat(np.cumsum(times) - times, times)))
    return np.stack([code, left], 1).astype(np.uint8).tobytes()


class Places(dict):
    """word -> its place in the head, or -1 - hash; emptied when it is full."""

    def __init__(self, head: Head) -> None:
        self.head = head

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = word_hash(word)
        place = self.head.place(h)
        self[word] = got = place if place >= 0 else -1 - h
        return got


def _codes(places: np.ndarray, head: Head) -> np.ndarray:
    """Classes of a text's words between two ends; -1 - hash where the class is not known here."""
    out = np.full(len(places) + 2, END_CLASS)
    rest = np.full(len(places), RARE) if head.whole else places
    out[1:-1] = np.where(places >= 0, head.classes[np.maximum(places, 0)].astype(np.int64), rest) if len(head.hashes) else rest
    return out


def _transitions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring classes in coded texts. Texts are parted by OUTSIDE, so no pair spans two of them."""
    total = np.zeros((256, 256), np.int64)
    for b in batches:
        c = np.frombuffer(_PARTED.join(b.column(0).to_pylist()), np.uint8).astype(np.int64)
        total += np.bincount(c[:-1] * 256 + c[1:], minlength=1 << 16).reshape(256, 256)
    a, b = np.nonzero(total[:N, :N])
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["a", "b", "n"])


def _outside_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbours of which one at least is a word outside the head."""
    for b in batches:
        pairs, n = np.unique(b.column(0).flatten().to_numpy().reshape(-1, 2), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["a", "b", "n"])


class ClassModel:
    """Log10 probabilities: emissions of the head's words and divisors of the classes; once observed, transitions between classes."""

    def __init__(self, head: Head, tokens: np.ndarray, words: np.ndarray) -> None:
        self.head, self.transition = head, np.zeros((N, N))
        more = np.zeros(N)
        more[RARE] = 1  # a share for all unknown words
        self.divisor = np.log10(tokens + 0.5 * np.maximum(1, words + more))

    def observe(self, big: np.ndarray) -> None:
        share = (big.sum(0) + 0.5) / (big.sum() + 0.5 * N)
        self.transition = np.log10((big + PRIOR * share) / (big.sum(1, keepdims=True) + PRIOR))

    def of_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of the head: the base's term and the emission."""
        base = np.log10(self.head.counts + 0.5)
        return base, base - self.divisor[self.head.classes]


def _code(model: ClassModel):
    """Texts as one byte for the class of each word between two ends, with what does not depend on transitions."""
    head = model.head
    end = head.place(END)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, (of_base, emission) = Places(head), model.of_words()
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            tails, times, pairs = [], [], []
            for text in b.column(2).to_pylist():
                p = np.array([places[w] for w in text.translate(LOWER).split()], np.int64)
                c = _codes(p, head)
                inside, far = p[p >= 0], c < 0
                tail, n = np.unique(-1 - p[p < 0], return_counts=True)
                out[0].append(len(p) + 1)
                out[1].append(len(inside) + (end >= 0))
                out[2].append(float(of_base[inside].sum() + (of_base[end] if end >= 0 else np.log10(0.5))))
                out[3].append(float(emission[inside].sum()))
                out[4].append(np.where(far, OUTSIDE, c).astype(np.uint8).tobytes())
                tails.append(tail)
                times.append(n)
                one = far[:-1] | far[1:]
                pairs.append(np.stack([c[:-1][one], c[1:][one]], 1).reshape(-1))
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, lists(tails), lists(times), lists(pairs)], ["row", "id", *CODED])

    return run


def _score(transition: np.ndarray):
    """row and the sum of a text's transitions between classes known in its code."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((256, 256))
        table[:N, :N] = transition
        for b in batches:
            codes = b.column("codes").to_pylist()
            c = np.frombuffer(_PARTED.join(codes), np.uint8)
            starts = np.cumsum([0, *(len(x) + 1 for x in codes[:-1])])
            within = np.add.reduceat(table[c[:-1], c[1:]], starts) if codes else np.zeros(0)
            yield b.drop_columns(["codes"]).append_column("within", pa.array(within, pa.float64()))

    return run


def _rest_score(transition: np.ndarray):
    """The transitions of a text that have a word outside the head: row, and their sum."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for pairs, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                of = {-1 - f["h"]: f["class"] for f in found}
                c = np.array([of[x] if x < 0 else x for x in pairs], np.int64)
                sums.append(float(transition[c[::2], c[1::2]].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.float64())], ["row", "between"])

    return run


def _dense(rows: list, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(shape)
    for *at, n in rows:
        out[tuple(at)] = n
    return out


def learn_classes(docs: DataFrame, text_col: str = "text", head_words: int = HEAD, least: int = LEAST) -> tuple[ClassModel, DataFrame, int, int]:
    """A model without transitions, the words outside its head (h, c, class), and the numbers of training tokens and of distinct ones."""
    spark = docs.sparkSession
    texts = docs.select(text_bytes(text_col).alias("text"))
    vocabulary = materialise(map_batches(texts, _count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")
    tokens, words = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    often = (F.col("c") >= least) & (F.col("h") != END)
    chosen = [r["h"] for r in vocabulary.where(often).orderBy(F.desc("c"), "h").limit(TOP).collect()]
    step = F.floor(F.log2("c") * 8).cast("int")
    bands = sorted(map(tuple, vocabulary.where(often).groupBy(step).count().collect()), reverse=True)
    lowest, taken = 1 << 30, 0
    for band, n in bands:
        if taken + n > head_words:
            break
        lowest, taken = band, taken + n
    inside = (often & (step >= lowest)) | (F.col("h") == END)

    def head_of(table: DataFrame) -> Head:
        rows = table.where(inside).toArrow()
        column = lambda name: rows.column(name).to_numpy().astype(np.int64)
        return Head(column("h"), column("c"), column("class"), taken == sum(n for _, n in bands))

    top = {END: END_ROW, **{h: i for i, h in enumerate(chosen)}}
    matrix = summed(map_batches(texts, _bigrams(top), SCHEMA), (ROWS, ROWS), _BLOCK)
    label = exchange(matrix, TOP)
    onto = np.zeros((ROWS, N))
    onto[np.arange(ROWS), label] = 1
    head = head_of(vocabulary.withColumn("class", F.lit(RARE)))
    around = map_batches(texts, _contexts(top, label, head), "h long, codes binary").repartition(partitions(spark), "h").sortWithinPartitions("h")
    assigned = map_batches(around, _assign(onto.T @ matrix @ onto, least), "h long, class int")
    named = spark.createDataFrame([(END, END_CLASS), *((h, int(label[i])) for i, h in enumerate(chosen))], "h long, class int")
    classed = vocabulary.join(assigned.unionByName(named), "h", "left").withColumn("class", F.coalesce("class", F.lit(RARE)))
    classed = materialise(classed.select("h", "c", "class"), "classes")
    sizes = classed.groupBy("class").agg(F.sum("c"), F.count(F.lit(1))).collect()
    head, rest = head_of(classed), classed.where(~inside)
    return ClassModel(head, _dense([(r[0], r[1]) for r in sizes], (N,)), _dense([(r[0], r[2]) for r in sizes], (N,))), rest, int(tokens), int(words)


def coded_texts(docs: DataFrame, id_col: str, text_col: str, model: ClassModel) -> DataFrame:
    """A stored table: every text with a number of its own (row), its id, and what CODED names."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    kinds = dict(zip(CODED, [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BinaryType(), *[T.ArrayType(T.LongType())] * 3], strict=True))
    return materialise(map_batches(rows, _code(model), T.StructType([*rows.schema.fields[:2], *(T.StructField(k, t) for k, t in kinds.items())])), "coded")


def observe(coded: DataFrame, model: ClassModel, rest: DataFrame) -> None:
    """Gives the model its transitions, counted over coded training texts."""
    pairs = map_batches(coded.select("codes"), _transitions, "a long, b long, n long")
    if not model.head.whole:
        far = map_batches(coded.where(F.size("pairs") > 0).select("pairs"), _outside_pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        for side in ("a", "b"):  # classes of words outside the head; no word here is unknown
            far = far.join(rest.select((-1 - F.col("h")).alias(side), "class"), side, "left").withColumn(side, F.coalesce("class", side)).drop("class")
        pairs = pairs.unionByName(far)
    model.observe(_dense([(r["a"], r["b"], r["n"]) for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()], (N, N)))


def learn(docs: DataFrame, text_col: str = "text", head_words: int = HEAD, least: int = LEAST) -> tuple[ClassModel, DataFrame, int, int]:
    """The whole model of all texts, and what learn_classes gives beside it."""
    model, *others = learn_classes(docs, text_col, head_words, least)
    observe(coded_texts(docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", model), model, others[0])
    return model, *others


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    model, rest, tokens, words = learn_classes(docs.where(~held_out(F.col(id_col))), text_col, head_words)
    coded = coded_texts(docs, id_col, text_col, model)
    observe(coded.where(~held_out(F.col("id"))), model, rest)
    once = coded.select("row", F.explode(F.arrays_zip(F.col("tail").alias("h"), F.col("times").alias("n"))).alias("t")).select("row", "t.h", "t.n")
    found = once.join(rest, "h", "left").withColumns({"c": F.coalesce("c", F.lit(0)), "class": F.coalesce("class", F.lit(RARE))})
    divisor = F.element_at(F.array(*(F.lit(float(d)) for d in model.divisor)), F.col("class") + 1)
    per_word = F.log10(F.col("c") + 0.5)
    sums = [F.sum(F.col("n") * per_word).alias("rare"), F.sum(F.col("n") * (per_word - divisor)).alias("emitted"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("rare_known")]
    if model.head.whole:
        rare = found.groupBy("row").agg(*sums).withColumn("between", F.lit(0.0))
    else:
        rare = materialise(found.groupBy("row").agg(*sums, F.collect_list(F.struct("h", "class")).alias("found")), "rest")
        between = map_batches(coded.where(F.size("pairs") > 0).select("row", "pairs").join(rare.select("row", "found"), "row"), _rest_score(model.transition), "row long, between double")
        rare = rare.drop("found").join(between, "row")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    train = float(np.log10(tokens + 0.5 * (words + 1)))
    taken = coded.select("row", "id", "n_tokens", "known", "base", "emitted", "codes")
    scored = map_batches(taken, _score(model.transition), T.StructType([*(f for f in taken.schema if f.name != "codes"), T.StructField("within", T.DoubleType())]))
    return scored.withColumnRenamed("emitted", "of_head").join(rare, "row", "left").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare") - F.col("n_tokens") * F.lit(train)).alias("base_score"), (F.col("of_head") + F.col("within") + zero("emitted") + zero("between")).alias("score"),
    )
