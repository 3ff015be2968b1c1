"""Files of many pages, each ended by a form feed, as a data source: page ranges are read by several tasks.

``index_pages`` cuts files into ranges of bytes and counts the pages that begin in each (a page begins at the first byte of a
file and behind every form feed but the last byte's). ``read_pages`` reads them by this index: a partition is one range, which a
filter on page numbers can leave out. The driver holds one entry of the index for each range it reads, as it does for splits of files.

Defined results: a missing path, a file that cannot be read and a page that is not UTF-8 are rows with an issue; a file without
pages is one with ``no pages``; an empty page between two form feeds has empty text; a page belongs to the range it begins in, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

#: Bytes of a file that a task reads the pages of.
RANGE_BYTES = 64 << 20
#: Bytes that are read at once.
_BLOCK = 1 << 20
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or ":" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _begins(path: str, start: int, end: int) -> int:
    """How many pages begin in bytes start to end of a file; its last byte begins none behind it."""
    system, name = _located(path)
    with system.open_input_file(name) as file:
        at, found = max(0, start - 1), int(start == 0 and end > 0)
        file.seek(at)
        while at < end - 1 and (block := file.read(min(_BLOCK, end - 1 - at))):
            found += block.count(b"\f")
            at += len(block)
    return found


def _tried(count):
    """Adds what count gives for a row, and the issue of a file that cannot be read (which a row may have before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, issues = [], []
            for r in b.to_pylist():
                issue, n = r.get("issue"), 0
                try:
                    n = 0 if issue else count(r)
                except OSError as error:
                    issue = f"{type(error).__name__}: {error}"
                found.append(n)
                issues.append(issue)
            kept = [k for k in b.schema.names if k != "issue"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(found, pa.int64()), pa.array(issues, pa.string())], [*kept, "n", "issue"])

    return run


def _size(row: dict) -> int:
    system, name = _located(row["path"])
    return system.get_file_info(name).size or 0


def index_pages(spark: SparkSession, paths: list[str], index: str, range_bytes: int = RANGE_BYTES, pattern: str = "*") -> DataFrame:
    """Writes path, start, end, pages, issue and first_page of each range of the files of paths to the table index, and reads it."""
    missing, names = [], set()
    for path in paths:
        try:  # the files' names as Spark lists them; sizes and counts are found in the tasks
            names |= {unquote(n) for n in spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).inputFiles()}
        except AnalysisException:
            missing.append((path, 0, 0, 0, "no such path"))
    files = spark.createDataFrame([(n,) for n in sorted(names)], "path string").repartition("path")
    sized = files.mapInArrow(_tried(_size), "path string, n long, issue string")
    size = F.lit(range_bytes).cast("long")
    cut = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), size)).alias("start"))
    cut = cut.select("path", "start", F.least(F.col("start") + size, F.col("n")).alias("end"), "issue").repartition("path", "start")
    counted = cut.mapInArrow(_tried(lambda r: _begins(r["path"], r["start"], r["end"])), "path string, start long, end long, n long, issue string").withColumnRenamed("n", "pages")
    counted = counted.unionByName(spark.createDataFrame(missing, counted.schema))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of one file
    counted.withColumn("first_page", F.coalesce(F.sum("pages").over(before), F.lit(0)) + 1).write.mode("overwrite").parquet(index)
    return spark.read.parquet(index)


class PageRange(ds.InputPartition):
    def __init__(self, path: str, start: int, end: int, first_page: int, issue: str | None) -> None:
        self.path, self.start, self.end, self.first_page, self.issue = path, start, end, first_page, issue


class PageReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.index, self.low, self.high, self.issues = options["index"], 1, None, True

    def partitions(self) -> list[PageRange]:
        system, name = _located(self.index)
        rows = pads.dataset(name, filesystem=system, format="parquet")
        begun = (pads.field("pages") > 0) & (pads.field("first_page") + pads.field("pages") > self.low)
        if self.high is not None:
            begun &= pads.field("first_page") <= self.high
        # what has no page: a whole file without any, or a range that could not be read
        silent = pads.field("issue").is_valid() | ((pads.field("start") == 0) & (pads.field("pages") == 0))
        found = rows.to_table(filter=(begun | silent) if self.issues else begun).to_pylist()
        return [PageRange(r["path"], r["start"], r["end"], r["first_page"], r["issue"] or (None if r["pages"] else "no pages")) for r in found]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if partition.issue:
            yield partition.path, None, None, partition.issue
            return
        page = partition.first_page
        try:
            for raw in _pages_of(partition):
                if page >= self.low and (self.high is None or page <= self.high):
                    try:
                        yield partition.path, page, raw.decode("utf-8"), None
                    except UnicodeDecodeError as error:
                        yield partition.path, page, None, f"UnicodeDecodeError: {error.reason}"
                page += 1
                if self.high is not None and page > self.high:
                    return
        except OSError as error:
            yield partition.path, page, None, f"{type(error).__name__}: {error}"


def _pages_of(part: PageRange) -> Iterator[bytes]:
    """Bytes of the pages that begin in a range, without their form feeds."""
    system, name = _located(part.path)
    with system.open_input_file(name) as file:
        at = max(0, part.start - 1)
        file.seek(at)
        inside, begin, held = part.start == 0, 0, []  # inside: a page has begun here
        while block := file.read(_BLOCK):
            left = 0
            while (cut := block.find(b"\f", left)) >= 0:
                if inside:
                    yield b"".join([*held, block[left:cut]])
                held, left, begin, inside = [], cut + 1, at + cut + 1, True
                if begin >= part.end:
                    return
            if inside:
                held.append(block[left:])
            at += len(block)
        if inside and begin < at:
            yield b"".join(held)


class PushingPageReader(PageReader):
    """Takes bounds on page numbers from the filters of a query; rows with an issue and no page never meet them."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            at = getattr(f, "attribute", None) == ("page",)
            value = getattr(f, "value", None)
            if at and isinstance(f, ds.EqualTo | ds.GreaterThan | ds.GreaterThanOrEqual | ds.LessThan | ds.LessThanOrEqual) and value is not None:
                self.issues = False
                if isinstance(f, ds.EqualTo | ds.GreaterThan | ds.GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, ds.GreaterThan))
                if isinstance(f, ds.EqualTo | ds.LessThan | ds.LessThanOrEqual):
                    high = value - isinstance(f, ds.LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f


class PageSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "form_feed_pages"

    def schema(self) -> str:
        return "path string, page long, text string, issue string"

    def reader(self, schema) -> PageReader:
        return (PushingPageReader if self.options.get("pushdown") == "true" else PageReader)(self.options)


def read_pages(spark: SparkSession, index: str) -> DataFrame:
    """path, page (from 1), text and issue of all pages of an index. Filters on page reach the source where the session lets Python sources have them."""
    spark.dataSource.register(PageSource)
    return spark.read.format(PageSource.name()).option("index", index).option("pushdown", spark.conf.get(_PUSHDOWN, "false")).load()
