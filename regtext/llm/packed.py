"""Sums of fixed-size arrays over a whole corpus.

Each map task keeps one array of bounded size and sends it as blocks; the blocks are summed in two exchanges
(first within groups of tasks, then over the groups), so no task reads more than a share of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regtext.llm.support import map_batches

SCHEMA = "block int, salt int, data binary"
#: Groups of tasks in the first exchange: a million tasks are added in two steps of a thousand each.
GROUPS = 1024


def blocks_of(array: np.ndarray, size: int, salt: int) -> Iterator[pa.RecordBatch]:
    """An int64 array as compressed blocks of so many numbers; blocks of zeros are left out."""
    flat = array.reshape(-1)
    for k in range(0, len(flat), size):
        if (part := flat[k : k + size]).any():
            yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([salt % GROUPS], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())], ["block", "salt", "data"])


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for block, salt, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            part = np.frombuffer(zlib.decompress(data), "<i8")
            if (block, salt) in total:
                total[block, salt] += part
            else:
                total[block, salt] = part.copy()
    for (block, salt), part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "salt", "data"])


def summed(parts: DataFrame, shape: tuple[int, ...], size: int) -> np.ndarray:
    """The sum of all tasks' arrays, on the driver; its size is that of one array."""
    once = map_batches(parts.repartition("block", "salt"), _add, SCHEMA)
    twice = map_batches(once.withColumn("salt", F.lit(0)).repartition("block"), _add, SCHEMA)
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in twice.collect():
        part = np.frombuffer(zlib.decompress(bytes(r["data"])), "<i8")
        out[r["block"] * size : r["block"] * size + len(part)] += part
    return out.reshape(shape)
