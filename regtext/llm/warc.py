"""WARC archives with revisit resolution.

Writing: payload headers (digest, length, id) are grouped by digest to find the original of each payload
that occurs more than once; the pages are joined to these originals by digest and written as ``response``
or ``revisit`` records with fresh headers. A hot digest is pre-aggregated in the grouping, and Spark splits
its partition in the join, which is the one exchange that moves payloads. Records are packed up to FILE_BYTES, and
Spark's text writer makes a gzip file of each pack: any store that Spark reaches will do.

Reading: each file goes to one task, which cuts it into records by Content-Length and takes the digest of each
payload again; revisits are then joined to the responses they refer to.

Defined results: a null payload is empty; payloads below ``min_bytes`` are always responses; of equal
payloads the record with the largest id is the response, so repeated rows of that id are all responses; a
null id cannot be referred to and comes before all others; a null url leaves WARC-Target-URI out; an empty
table gives an archive without records; other columns are ignored. A record's id is made of page id, payload digest and
date, so only whole repeated rows share one. Bytes of an archive that are no record come as a row of the type
``damaged``; records whose payload or length is not as their headers say are not intact.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.support import join_hot, map_batches

MIN_BYTES = 1000
#: Bytes of records in a file (a larger record has one of its own): a reader holds a whole file in memory.
FILE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_END_BYTES = _END.encode()

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()), T.StructField("refers_to_id", T.StringType()), T.StructField("page", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("intact", T.BooleanType()), T.StructField("payload", T.BinaryType()),
])


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """id, url, payload, payload_digest, payload_bytes, record_type and refers_to (the id of the response) of every page."""
    payload = F.coalesce(F.col(payload_col), F.lit("").cast(pages.schema[payload_col].dataType)).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    headers = rows.where(F.col("payload_bytes") >= min_bytes).select("id", F.col("payload_digest").alias("digest"))
    originals = headers.groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original is not null").drop("n")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original")) & (F.col("payload_bytes") >= min_bytes)
    return rows.join(originals, F.col("payload_digest") == F.col("digest"), "left").select(
        "id", "url", "payload", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to")
    )


def _record_id(id_column: Column, date: str) -> Column:
    return _uuid(id_column, F.col("payload_digest"), F.lit(date))


def _packs(file_bytes: int):
    """Records of a task, one after the other, as values of about so many bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for record in b.column(0).to_pylist():
                if held and size + len(record) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_END_BYTES.join(held)], pa.binary())], ["value"])
                    held, size = [], 0
                held.append(record)
                size += len(record) + 4
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_END_BYTES.join(held)], pa.binary())], ["value"])

    return run


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write what resolve_revisits returns as WARC/1.1 files below path."""
    kept = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"").cast("binary"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("id"), date)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Page-ID", F.col("id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), _record_id(F.col("refers_to"), date))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.octet_length("kept")).cast("string"),
        F.lit(_END),
    )
    records = resolved.withColumns({"kept": kept, "http": http}).select(F.concat(head.cast("binary"), F.col("http").cast("binary"), F.col("kept")).alias("value"))
    packs = map_batches(records, _packs(file_bytes), "value binary").select(F.col("value").cast("string"))
    # a quick compression level: the archives of this operator are read back once
    packs.write.option("lineSep", _END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def cut(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, compressed or not; bytes that are no record come without headers."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        begin = data.find(b"WARC/", at)
        if begin < 0:
            begin = len(data)
        if data[at:begin].strip(b"\r\n"):
            yield {}, data[at:begin]
        if begin == len(data):
            return
        stop = data.find(_END_BYTES, begin)
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in str(data[begin : max(stop, 0)], "utf-8", "replace").split("\r\n")[1:]))
        if stop < 0 or not head.get("content-length", "").isdigit():  # not a header: go on behind it
            stop = len(data) if stop < 0 else stop
            yield {}, data[begin:stop]
            at = stop
            continue
        n = int(head["content-length"])
        yield head, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n


_READ = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("refers_to_id", pa.string()), ("page", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])


def _parsed(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    _, _, payload = block.partition(_END_BYTES)
    named, response = head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("warc-type") == "response"
    real = hashlib.sha1(payload).hexdigest() if response else named
    whole = real == named and len(block) == int(head.get("content-length", -1))
    return head.get("warc-record-id"), head.get("warc-type", "damaged"), head.get("warc-refers-to"), head.get("warc-page-id"), head.get("warc-target-uri"), head.get("warc-date"), real, len(payload) if response else None, whole, payload if response and with_payload else None


def _parser(with_payload: bool):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in cut(content.as_py() or b""):
                    rows.append(_parsed(head, block, with_payload))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below path, as they stand in the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_batches(files, _parser(with_payload), RECORD)


def resolved_records(records: DataFrame) -> DataFrame:
    """Every record of a stored table with the page and length of the response it refers to; responses refer to nothing."""
    responses = records.where("warc_type = 'response' and page is not null").select(F.col("record_id").alias("refers_to_id"), F.col("page").alias("refers_to_page"), F.col("payload_bytes").alias("to_bytes"))
    # records of one id are whole repeated rows
    joined = join_hot(records.drop("payload"), responses.dropDuplicates(["refers_to_id"]), "refers_to_id")
    return joined.select("record_id", "page", "url", "warc_type", "payload_digest", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), "refers_to_page", "intact")
