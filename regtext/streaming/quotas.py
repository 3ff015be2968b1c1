"""Daily quotas over a stream of requests, with state that expires; and events that come late."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from regtext.sources.tables import scratch_dir

#: Milliseconds of a day's window.
DAY_MS = 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DailyQuota(StatefulProcessor):
    """Admits a model's requests while its last 24 hours have room for one more request and for its tokens.

    State is a list of the admitted requests' times and tokens. Rejected ones leave no trace, so the list is never longer than the
    number of requests that a day may have. A timer a day behind the last admitted request clears the list of a model that has gone
    quiet; entries older than a day go whenever the model is seen.
    """

    def __init__(self, tokens: int, number: int):
        self.tokens, self.number = tokens, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", T.StructType([T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at", "request_id"])
        kept = [(int(x[0]), int(x[1])) for x in self.window.get()] if self.window.exists() else []
        out = []
        for request, at, size in zip(asked["request_id"], asked["at"].astype("int64"), asked["tokens"].astype("int64"), strict=True):
            kept = [x for x in kept if x[0] > at - DAY_MS]
            used = sum(x[1] for x in kept if x[0] <= at)
            reason = "requests" if len(kept) + 1 > self.number else "tokens" if sum(x[1] for x in kept) + size > self.tokens else ""
            if not reason:
                kept.append((at, size))
            out.append((request, key[0], reason == "", reason, used))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.window.put([Row(*x) for x in kept])
            self.handle.registerTimer(max(x[0] for x in kept) + DAY_MS)
        else:
            self.window.clear()
        yield pd.DataFrame(out, columns=["request_id", "model", "admitted", "reason", "used_tokens"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def daily_quota(requests: DataFrame, tokens: int, number: int, late: str = "1 hour") -> DataFrame:
    """A stream of requests (request_id, model, ts, tokens) with what became of each: admitted, reason (requests or tokens: the limit it would exceed) and used_tokens (of the last 24 hours before it).

    Requests of one batch are taken in the order of their times. A restart from the checkpoint goes on with the same windows.
    """
    kinds = {f.name: f.dataType for f in requests.schema}
    schema = T.StructType([T.StructField("request_id", kinds["request_id"]), T.StructField("model", kinds["model"]), T.StructField("admitted", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("used_tokens", T.LongType())])
    rows = requests.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("model").transformWithStateInPandas(DailyQuota(tokens, number), schema, "append", "eventtime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that such operators need, for the queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run(stream: DataFrame, path: str) -> None:
    """What there is now, appended to path/rows from the checkpoint path/checkpoint; each batch is written once, whatever fails."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    with state_store(stream.sparkSession):
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def split_late(spark: SparkSession, folder: str, schema: T.StructType, key: str = "event_id", late: str = "1 hour", files_at_once: int = 1) -> DataFrame:
    """Every row of the files in a folder, read as a stream in the order they came, with what became of it: on_time, repeated or late.

    A row is late, if it came behind the watermark and no row with its key was on time; repeated, if another row with its key was taken. The
    watermark of a batch of files is the one that the batch before it ran with: the latest time of all batches before that one, less `late`. The stream appends the rows it takes to one table and all rows, as they came, to another; so late rows are kept
    and can be worked on, instead of vanishing in the stateful operator.
    """
    path = scratch_dir(spark, "late")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    came = source.withColumn("arrival", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index"))
    taken = source.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    for stream, name in ((came, "came"), (taken, "taken")):
        stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows, good = spark.read.schema(came.schema).parquet(f"{path}/came"), spark.read.schema(schema).parquet(f"{path}/taken").select(F.col(key).alias("taken_key"), F.col("ts").alias("taken_ts"))
    both = rows.join(good, F.col(key) == F.col("taken_key"), "left")
    firsts = rows.join(good, (F.col(key) == F.col("taken_key")) & (F.col("ts") == F.col("taken_ts"))).groupBy(key).agg(F.min("arrival").alias("first_arrival"))
    both = both.join(firsts, key, "left")
    status = F.when(F.col("taken_key").isNull(), "late").when(F.col("arrival") == F.col("first_arrival"), "on_time").otherwise("repeated")
    return both.withColumn("status", status).drop("taken_key", "taken_ts", "arrival", "first_arrival")
