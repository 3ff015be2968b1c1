"""Sources and sinks: golden-set CSV, binary files, knowledge bases as partitioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.functions.text import strip, token_count
from regtext.operators.retrieve import embedded
from regtext.sources.tables import fresh, stored

REQUIRED = ["question", "ground_truth", "reference_context"]
#: Bytes that an audio file may have.
AUDIO_BYTES = 5 << 20
#: Bytes of files whose pages are held at once.
SLICE_BYTES = 4 << 20
#: Partitions that the points of a base and role are dealt into.
BUCKETS = 16


def read_golden_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty cells as empty text."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).na.fill("")
    if missing := sorted(set(REQUIRED) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numbered(rows: DataFrame, order: str, first: int = 1, parts: int = 200) -> DataFrame:
    """rows with row_number in the order of a numeric column. Numbers are counted within ranges of it and moved by what stands before each range."""
    cuts = rows.select(F.percentile_approx(order, F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(10_000)).alias("c")).first()["c"] or []
    bounds = sorted(set(cuts))
    part = F.lit(0)
    for k, c in enumerate(bounds):
        part = F.when(F.col(order) > F.lit(c), k + 1).otherwise(part)
    own = fresh(rows.columns, "part")
    cut = rows.withColumn(own, part)
    counts, before, total = {r[0]: r[1] for r in cut.groupBy(own).count().collect()}, [], first - 1
    for k in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(k, 0)
    offset = F.element_at(F.array(*(F.lit(n).cast("long") for n in before)), F.col(own) + 1)
    return cut.withColumn("row_number", F.row_number().over(Window.partitionBy(own).orderBy(order)) + offset).drop(own)


def validate_rows(rows: DataFrame, bases: DataFrame, order: str) -> DataFrame:
    """Every row with its number in the sheet (the header is row 1) and the reason for its rejection, or null."""
    name = fresh(rows.columns, "known_base")
    known = bases.select(F.lower("kb").alias(name)).distinct()
    joined = numbered(rows, order, 2).join(known, F.lower(strip("knowledge_base")) == F.col(name), "left")
    reason = F.lit(None).cast("string")
    reason = F.when((strip("knowledge_base") != "") & F.col(name).isNull(), "unknown knowledge base").otherwise(reason)
    for c in reversed(REQUIRED):
        reason = F.when(F.coalesce(strip(c), F.lit("")) == "", f"{c} is empty").otherwise(reason)
    return joined.withColumn("reason", reason).drop(name)


def write_csv_template(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([("Apa isi Pasal 1?", "…", "…", "umum", "")], f"{', '.join(f'{c} string' for c in REQUIRED)}, category string, knowledge_base string").coalesce(1).write.csv(path, header=True)


def read_files(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page (from 1), text, issue of files (path, content) by a seam: extractor gives the pages' texts of one file.

    A file that fails or has no page becomes a row with an issue, never a failed job.
    """

    def read(path: str, content: bytes | None) -> list[tuple]:
        try:
            return [(path, k, text, None) for k, text in enumerate(extractor(bytes(content)), 1)] or [(path, None, None, "no pages")]
        except Exception as error:  # whatever a file does to its reader is its own issue
            return [(path, None, None, f"{type(error).__name__}: {error}")]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows, size = [], 0
            for n in range(batch.num_rows):  # one file at a time, and few pages of the files before it
                content = batch["content"][n].as_py()
                rows += read(batch["path"][n].as_py(), content)
                size += len(content or b"") + 100
                if size >= SLICE_BYTES or n == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "page", "text", "issue"])
                    rows, size = [], 0

    return files.select("path", "content").mapInArrow(pages, "path string, page int, text string, issue string")


def file_status(pages: DataFrame) -> DataFrame:
    """path, status (success or failed), pages, words, chars and issues of every file."""
    words = F.sum(token_count(F.col("text")))
    out = pages.groupBy("path").agg(F.count("page").alias("pages"), F.coalesce(words, F.lit(0)).alias("words"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.array_sort(F.collect_list("issue")).alias("issues"))
    return out.withColumn("status", F.when(F.size("issues") > 0, "failed").otherwise("success"))


def plain_text(pages: DataFrame) -> DataFrame:
    """The pages of each file as one text."""
    parts = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", "text"))))
    return pages.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x.text), "\n").alias("text"))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= AUDIO_BYTES)


def transcribed(files: DataFrame, transcriber: Callable[[bytes], str]) -> DataFrame:
    """path, text and issue of audio files by a seam; a file that fails has an issue."""
    return extract_pages(files, lambda content: [transcriber(content)]).drop("page")


def base_name(name: Column) -> Column:
    return F.replace(F.lower(strip(name)), F.lit(" "), F.lit("_"))


def point_id(*parts: Column) -> Column:
    """The same chunk has the same id whenever it is written."""
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def flat_payload(chunks: DataFrame) -> DataFrame:
    """Chunks as flat rows in which empty text is null."""
    return chunks.select(*(F.nullif(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in chunks.schema))


def ensure_base(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The points below path; an empty table, if there are none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("kb", "role").parquet(path)
        return spark.read.schema(schema).parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points below path; names of bases stay text, whatever they look like."""
    schema = spark.read.option("mergeSchema", "true").parquet(path).schema  # columns may have come with a later write
    text = [T.StructField(f.name, T.StringType()) if f.name in ("kb", "role") else f for f in schema]
    return spark.read.schema(T.StructType(text)).parquet(path)


def merge_points(points: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Upsert points (kb, role, point_id, ..) into the table below path and return what was written, one row for each point.

    A point with the id of a stored one takes its place; all others stay. Points are dealt by a hash of their id into a fixed number of
    partitions of each base and role, and only those with a new point are written again. What they will hold is stored aside first
    and moved into place by the overwrite's commit, so a write that fails leaves the table as it was. Of points with one id in one write the
    one with the greatest content stays. Columns that the table lacks are added, those that the points lack are null.
    """
    spark, place = points.sparkSession, ["kb", "role", "bucket"]
    first = F.row_number().over(Window.partitionBy("kb", "role", "point_id").orderBy(F.desc_nulls_last("content"), F.xxhash64("embedding")))
    turn = fresh(points.columns, "turn")
    once = points.withColumn(turn, first).where(F.col(turn) == 1).drop(turn)
    new = stored(once.withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int")), "new-points")
    try:
        old = read_points(spark, path)
    except AnalysisException:
        old = None
    merged = new
    if old is not None:
        touched = new.select(*place).distinct()
        kept = old.join(touched, place, "left_semi").join(new.select("kb", "role", "point_id"), ["kb", "role", "point_id"], "left_anti")
        merged = stored(kept.unionByName(new, allowMissingColumns=True), "merged-points")
    merged.hint("rebalance", *place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(path)
    return new.drop("bucket")


def write_points(chunks: DataFrame, path: str) -> DataFrame:
    """Upsert chunks with an embedding of their own (others are left out), and return what was written."""
    kept = flat_payload(chunks).where("embedding is not null").withColumn("point_id", point_id(F.col("kb"), F.col("doc_id").cast("string"), F.col("chunk_id").cast("string")))
    return merge_points(kept, path)


def store_chunks(chunks: DataFrame, path: str, embedder: Callable | None = None) -> DataFrame:
    """Write chunks (kb, role, doc_id, chunk_id, content, ..) with embeddings, by a seam or of their own, and return what became of each base.

    kb, parents, children (points that this write has put or replaced), skipped (rows without an embedding), status: success, or partial_error where
    any was skipped. What was stored before under other ids stays.
    """
    rows = stored(embedded(chunks, embedder, "content") if embedder is not None else chunks, "chunks")
    written = write_points(rows, path)
    done = written.groupBy("kb").agg(F.count_if(F.col("role") == "parent").alias("parents"), F.count_if(F.col("role") == "child").alias("children"))
    asked = rows.groupBy("kb").agg(F.count_if(F.col("embedding").isNull()).alias("skipped"))
    out = asked.join(done, "kb", "left").na.fill(0, ["parents", "children"])
    return out.select("kb", "parents", "children", "skipped", F.when(F.col("skipped") > 0, "partial_error").otherwise("success").alias("status"))


def delete_base(spark: SparkSession, path: str, kb: str) -> dict[str, str]:
    """Remove both partitions of a base; what became of each role: deleted or not_found."""
    out = {}
    for role in ("parent", "child"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kb={kb}/role={role}")
        gone = where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        out[role] = "deleted" if gone else "not_found"
    return out


def detailed(points: DataFrame) -> DataFrame:
    """One row for each base and role: its name and number of points."""
    return points.groupBy("kb", "role").agg(F.count(F.lit(1)).alias("points")).select(F.concat_ws("_", "kb", "role").alias("name"), "kb", "role", "points")


def base_info(points: DataFrame) -> DataFrame:
    """kb, and section and title of its first parent."""
    first = F.min(F.when(F.col("role") == "parent", F.struct("chunk_id", "section", "title")))
    return points.groupBy("kb").agg(first.alias("p")).select("kb", F.col("p.chunk_id").alias("first_parent"), "p.section", "p.title")


def stats(points: DataFrame) -> DataFrame:
    return points.groupBy("kb").agg(F.count_if(F.col("role") == "parent").alias("parents"), F.count_if(F.col("role") == "child").alias("children"))


def list_bases(points: DataFrame) -> DataFrame:
    return points.select("kb").distinct().orderBy("kb")


def monitor(points: DataFrame, asked: DataFrame | None = None, rows: int = 5) -> DataFrame:
    """Counts, status and first chunk ids of both roles: of all bases, or of those asked for (kb), also where there is none."""
    first = preview(points, rows).groupBy("kb").agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("chunk_id")))).alias(f"{r}_preview") for r in ("parent", "child")))
    out = stats(points).join(first, "kb")
    if asked is not None:
        out = asked.select("kb").join(out, "kb", "left")
    parents, children = F.coalesce("parents", F.lit(0)), F.coalesce("children", F.lit(0))
    status = F.when((parents > 0) & (children > 0), "active").when(parents + children > 0, "partial_error").otherwise("not_found")
    return out.select("kb", status.alias("status"), parents.cast("long").alias("parents"), children.cast("long").alias("children"), "parent_preview", "child_preview")


def preview(points: DataFrame, n: int = 3) -> DataFrame:
    """The first so many points of each base and role."""
    return points.withColumn("n", F.row_number().over(Window.partitionBy("kb", "role").orderBy("chunk_id"))).where(F.col("n") <= n).drop("n")


def resolve(asked: DataFrame, bases: DataFrame) -> DataFrame:
    """asked, kb: the base of exactly that name, else one that differs in case only, else null."""
    b = bases.select("kb")
    pairs = asked.join(b, F.lower("asked") == F.lower("kb"), "left")
    w = Window.partitionBy("asked").orderBy((F.col("asked") == F.col("kb")).desc(), "kb")
    return pairs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def jdbc_url(loose: Column) -> Column:
    """A JDBC address of a connection address such as postgresql+driver://user:secret@host:port/base; user and secret are left out, a missing port is 5432."""
    pattern = r"^([a-z]+)(?:\+[a-z0-9]+)?://(?:.*@)?([^/:@]+)(?::(\d+))?/([^?]+)"
    part = lambda i: F.regexp_extract(loose, pattern, i)
    kind = F.replace(part(1), F.lit("postgres"), F.lit("postgresql"))
    kind = F.when(part(1) == "postgresql", "postgresql").otherwise(kind)
    return F.when(part(2) != "", F.concat(F.lit("jdbc:"), kind, F.lit("://"), part(2), F.lit(":"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("5432")), F.lit("/"), part(4)))
