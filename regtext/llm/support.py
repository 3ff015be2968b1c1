"""Small helpers that the operators of this subpackage share.

Shared files: intermediate tables and archives go below the folder that the cluster names in
``spark.checkpoint.dir``; only where that setting is missing in a local session is a temporary folder used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word and normalisation contracts: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and leaves every other byte (so UTF-8 stays intact).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte that is neither a letter nor a digit becomes a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bytes and rows that a function of map_batches gets at once: Spark bounds a batch by
#: spark.sql.execution.arrow.maxBytesPerBatch, and what is worked out beside it is bounded by these.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 2000
#: A key with more than one row in HOT is hot, so there are fewer than HOT of them.
HOT = 256
#: Bits of the map that tells which rows a join may need.
MARKS = 1 << 24

#: The tables written inside a scratch(), of this thread alone; none are noted outside.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster, intermediate tables need a shared folder")
        base = _local_base(spark)
    path = f"{base.rstrip('/')}/regtext-{uuid.uuid4().hex[:12]}-{name}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return path


_LOCAL: dict[str, str] = {}


def _local_base(spark: SparkSession) -> str:
    """For local sessions without spark.checkpoint.dir: tests and single machines."""
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-regtext-")
    return _LOCAL[app]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables that were written inside when it ends; results have to be written by then."""
    written: list[str] = []
    outer = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(outer)
        for path in written:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: the lineage ends here, and losing an executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its own for each row, and its name: ids may be null or repeated.

    Rows that come straight from files are known by file and place; others are written once to fix their keys.
    """
    row = fresh(docs.columns, "row_key")
    stored = docs if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" else materialise(docs, "rows")
    place = stored.metadataColumn("_metadata")  # the files' own, also where a column of the table has its name
    key = F.concat_ws("-", F.hex(F.xxhash64(place["file_path"])), place["row_index"].cast("string"))
    return stored.withColumn(row, key), row


def with_text_key(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """docs with a digest of each text, and its name: what is said of a text holds for all rows of this id and digest."""
    key = fresh(docs.columns, "text_key")
    return docs.withColumn(key, F.sha2(text_bytes(text_col), 256)), key


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, min(SLICE_ROWS, b.num_rows * SLICE_BYTES // max(1, b.nbytes)))
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


def map_batches(df: DataFrame, func: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow over slices of a bounded number of rows and bytes (or of one row)."""
    return df.mapInArrow(lambda batches: func(_slices(batches)), schema)


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left (a stored table) left-joined to right, which has one row for a key. Hot keys of left take theirs from a broadcast of fewer than HOT rows, and rows without a key from nowhere."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = [r[0] for r in counts.where(F.col("count") > left.count() / HOT).select(key).collect()]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = left.where(F.col(key).isNotNull() & ~is_hot).join(right, key, "left")
    none = left.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key))
    out = out.unionByName(none)
    return out.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left")) if hot else out


def marked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows with a key, but for most of those whose key wanted has not: a bitmap of fixed size is broadcast, so these need not move for a join."""
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(MARKS))
    slot, bit = fresh(rows.columns, "slot"), fresh(rows.columns, "bits")
    bits = wanted.select(place(key).alias("p")).groupBy(F.shiftright("p", 6).alias(slot)).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias(bit))
    found = rows.where(F.col(key).isNotNull()).withColumn(slot, F.shiftright(place(key), 6)).join(F.broadcast(bits), slot)
    return found.where(F.getbit(bit, (place(key) % 64).cast("int")) == 1).drop(slot, bit)


def text_bytes(column: str | Column) -> Column:
    """A text column as UTF-8 bytes; null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], name: str) -> str:
    """A column name that clashes with none of the given ones."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name
