"""Exact deduplication by Grace hashing.

1. Each map task collapses copies in a bounded open-addressing table that compares complete contents: an entry is a
   content with the number of its rows and the best of them, and every row names its entry. Both are written once.
2. Entries are partitioned by a hash of their content. What would need more than FANOUT tables is written as FANOUT
   folders (the spill files of the Grace partitioning), and each folder is partitioned again by the next hash.
   What is left runs through one table for each bucket. A table that is full takes copies of what it holds only; the
   other entries are spilled and partitioned again, so every level holds at least as much as its tables do.
3. Each entry gets the group that its table has put it in, and each row that of its entry. A group with a third of
   all rows is one entry for each map task, and its rows are joined by entry, never by group.

Tables in the shared folder and shuffle files are all that is kept, so a lost executor costs a recomputation of its tasks.

Defined results: a null text counts as empty; texts are equal when identical without the characters
[\\x20\\x09-\\x0D]; of equal texts the row with most code points, then the smallest id stays (null ids come
last); rows that repeat an id with the same text share its decision, unless they have a key of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.support import SPACE, map_batches, materialise, partitions, shared_dir, text_bytes, with_row_key

#: Bytes of distinct content that one bucket's table may hold.
BUCKET_BYTES = 64 << 20
#: Bytes that a map task's collapsing table holds before it is emptied into the exchange.
COLLAPSE_BYTES = 32 << 20
#: Buckets of an exchange, and folders that a bucket is spilled to.
FANOUT = 4096
#: Bytes that an entry has beside its content.
OVERHEAD = 200


class OpenTable:
    """Open addressing with linear probing; entries are equal only if their complete contents are."""

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = [-1] * 1024
        self.keys: list[tuple[int, bytes]] = []
        self.best: list[tuple] = []
        self.count: list[int] = []
        self.bytes = 0

    def add(self, content: bytes, rank: tuple, n: int, limit: float = float("inf")) -> int:
        """The place of a content, or -1 where it is new and the table is full."""
        h = hash(content)
        i = h & self.mask
        while (j := self.slots[i]) >= 0:
            k, c = self.keys[j]
            if k == h and c == content:
                self.count[j] += n
                if rank < self.best[j]:
                    self.best[j] = rank
                return j
            i = (i + 1) & self.mask
        if self.keys and self.bytes > limit:
            return -1
        self.slots[i] = j = len(self.keys)
        self.keys.append((h, content))
        self.best.append(rank)
        self.count.append(n)
        self.bytes += len(content) + OVERHEAD
        if 2 * len(self.keys) > self.mask:
            self._grow()
        return j

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for j, (h, _) in enumerate(self.keys):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = j


def _rank(points: int, key, row) -> tuple:
    return (-points, key is None, key, row)


_BEST = ("best_points", "best_id", "best_row")


def _collapse(limit: int, kinds: dict[str, pa.DataType]):
    """Map side: a row for every document, which names its entry, and one with the content for every entry."""
    schema = pa.schema([("entry", pa.int64()), ("id", kinds["id"]), ("row", kinds["row"]), ("content", pa.binary()), ("bytes", pa.int64()), ("n", pa.int64()), ("best_points", pa.int64()), ("best_id", kinds["id"]), ("best_row", kinds["row"])])

    def batch(**columns: list) -> pa.RecordBatch:
        n = len(columns["entry"])
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    def emptied(table: OpenTable, first: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(table.keys), 500):
            best = table.best[a : a + 500]
            yield batch(entry=list(range(first + a, first + a + len(best))), content=[c for _, c in table.keys[a : a + 500]], bytes=[len(c) + OVERHEAD for _, c in table.keys[a : a + 500]], n=table.count[a : a + 500], best_points=[-r[0] for r in best], best_id=[r[2] for r in best], best_row=[r[3] for r in best])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = OpenTable(), TaskContext.get().partitionId() << 40
        for b in batches:
            ids, rows, entries = b.column(0).to_pylist(), b.column(2).to_pylist(), []
            for key, text, row in zip(ids, b.column(1).to_pylist(), rows, strict=True):
                entries.append(first + table.add(text.translate(None, SPACE), _rank(len(str(text, "utf-8", "replace")), key, row), 1))
            yield batch(entry=entries, id=ids, row=rows)
            if table.bytes > limit:
                yield from emptied(table, first)
                table, first = OpenTable(), first + len(table.keys)
        yield from emptied(table, first)

    return run


def _bucket(limit: int, kinds: dict[str, pa.DataType]):
    """Reduce side: a whole bucket against one table. Entries with their group; those that the full table did not take, with their content."""
    schema = pa.schema([("entry", pa.int64()), ("content", pa.binary()), ("bytes", pa.int64()), ("n", pa.int64()), ("best_points", pa.int64()), ("best_id", kinds["id"]), ("best_row", kinds["row"]), ("sha", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, entries, places = OpenTable(), [], []
        for b in batches:
            spilled = []
            for k, (entry, c, n, points, key, row) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)), strict=True)):
                if (place := table.add(c, _rank(points, key, row), n, limit)) < 0:
                    spilled.append(k)
                else:
                    entries.append(entry)
                    places.append(place)
            if spilled:
                part = b.take(pa.array(spilled))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(len(spilled), pa.string())], schema=schema)
        shas = [hashlib.sha256(c).hexdigest() for _, c in table.keys]
        for a in range(0, len(entries), 2000):
            at = places[a : a + 2000]
            best = [table.best[j] for j in at]
            yield pa.RecordBatch.from_arrays([pa.array(entries[a : a + 2000], pa.int64()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64()), pa.array([table.count[j] for j in at], pa.int64()), pa.array([-r[0] for r in best], pa.int64()), pa.array([r[2] for r in best], kinds["id"]), pa.array([r[3] for r in best], kinds["row"]), pa.array([shas[j] for j in at])], schema=schema)

    return run


def _grace(entries: DataFrame, size: int, level: int, schema: T.StructType, kinds: dict, bucket_bytes: int, fanout: int, splits: bool = True) -> list[DataFrame]:
    """Stored tables of all entries with their groups. Only sizes of buckets come to the driver."""
    digit = lambda n: F.pmod(F.xxhash64("content", F.lit(level)), F.lit(n)).cast("int")
    spark = entries.sparkSession
    wanted = -(-2 * size // bucket_bytes)
    if wanted > fanout and splits:
        path = shared_dir(spark, f"spill-{level}")
        entries.withColumn("bucket", digit(fanout)).repartition(fanout, "bucket").write.partitionBy("bucket").parquet(path)
        written = spark.read.parquet(path)
        out = []
        for r in written.groupBy("bucket").agg(F.sum("bytes").alias("size")).collect():
            out += _grace(written.where(F.col("bucket") == r["bucket"]).select(*entries.columns), r["size"], level + 1, schema, kinds, bucket_bytes, fanout, splits=r["size"] < size)  # copies of one content don't part
        return out
    n = min(fanout, max(wanted, partitions(spark)))
    done = materialise(map_batches(entries.repartitionById(n, digit(n)), _bucket(bucket_bytes, kinds), schema), f"groups-{level}")
    rest = done.where("sha is null").select(*entries.columns)
    left = rest.agg(F.sum("bytes")).first()[0]
    return [done.where("sha is not null"), *(_grace(rest, left, level + 1, schema, kinds, bucket_bytes, fanout) if left else [])]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, collapse_bytes: int = COLLAPSE_BYTES, fanout: int = FANOUT, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, and row_col if one is named, which then is the last tie-break."""
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"), (F.col(row_col) if row_col else F.lit(0).cast("long")).alias("row"))
    id_type, row_type = rows.schema["id"].dataType, rows.schema["row"].dataType
    kinds = {"id": _arrow(id_type), "row": _arrow(row_type)}
    field = lambda name, kind: T.StructField(name, kind)
    best = [field(n, k) for n, k in zip(_BEST, (T.LongType(), id_type, row_type), strict=True)]
    entry, content, size_of, n = field("entry", T.LongType()), field("content", T.BinaryType()), field("bytes", T.LongType()), field("n", T.LongType())
    spill = materialise(map_batches(rows, _collapse(collapse_bytes, kinds), T.StructType([entry, field("id", id_type), field("row", row_type), content, size_of, n, *best])), "entries")
    entries = spill.where("n is not null").select("entry", "content", "bytes", "n", *_BEST)
    size = entries.agg(F.sum("bytes")).first()[0] or 0
    groups = None
    for part in _grace(entries, size, 0, T.StructType([entry, content, size_of, n, *best, field("sha", T.StringType())]), kinds, bucket_bytes, fanout):
        part = part.select("entry", F.col("n").alias("group_size"), F.col("best_id").alias("keep_id"), "best_row", F.col("sha").alias("text_sha256"))
        groups = part if groups is None else groups.unionByName(part)
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & F.col("row").eqNullSafe(F.col("best_row"))
    return spill.where("n is null").select("entry", "id", "row").join(groups, "entry").select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256", *([F.col("row").alias(row_col)] if row_col else []))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row of each group of equal texts, with all its columns; of whole repeated rows one stays. row_col: a stored key of the rows, if they have one."""
    rows, row = (docs, row_col) if row_col else with_row_key(docs)
    kept = exact_duplicates(rows, id_col, text_col, row_col=row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
