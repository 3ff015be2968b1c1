"""Event-time windows as streams: tumbling counts and sessions with a watermark, and quota admission with state per model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regtext.sources.tables import fresh, scratch_dir


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream; its times carry no zone, and a watermark needs one."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("value").cast("long")).alias("tokens"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "user_id", "n")


def run_to_table(stream: DataFrame, keys: list[str] | None, name: str) -> DataFrame:
    """All that is there now, through the stream, as Parquet in the shared folder: each batch writes its rows, and of those that a later batch has updated (by keys) the last counts."""
    spark, path = stream.sparkSession, scratch_dir(stream.sparkSession, name)

    own = fresh(stream.columns, "from_batch")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn(own, F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    mode = "append" if keys is None else "update"
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    if keys is None:
        return rows.drop(own)
    turn = fresh(rows.columns, "turn")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(own)))
    return rows.withColumn(turn, last).where(F.col(turn) == 1).drop(turn, own)


def run_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return run_to_table(tumbling(event_stream(spark, folder)), ["start", "event_type"], "tumbling")


def run_sessions(spark: SparkSession, folder: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of all users: those that the watermark has closed come from the stream, which closes the rest with an event far ahead."""
    events = event_stream(spark, folder).select("ts", "user_id")
    schema = "ts timestamp, user_id " + dict(events.dtypes)["user_id"]
    ahead = scratch_dir(spark, "ahead")
    last = spark.read.parquet(f"{folder}/events.parquet").agg(F.max("ts").cast("timestamp").alias("ts")).select((F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(None).cast(dict(events.dtypes)["user_id"]).alias("user_id"))
    last.union(last.select(F.col("ts") + F.expr("interval 30 days"), "user_id")).write.parquet(f"{ahead}/a")
    closing = spark.readStream.schema(schema).parquet(f"{ahead}/a*")
    return run_to_table(sessions(events.unionByName(closing), gap), None, "sessions").where("user_id is not null")


#: Seconds of a quota window, and least seconds between two requests of a model.
WINDOW_SECONDS, GAP_SECONDS = 60.0, 1.2


def admissions(requests: DataFrame, tokens: int = 4500, number: int = 25, gap: float = GAP_SECONDS) -> DataFrame:
    """A stream of requests (request_id, model, ts, tokens) with the second at which each is admitted and its wait.

    A request waits until the window of the last minute has room for its tokens and for one more request, and for the gap to the last
    one. What a model has in its window is kept as state, so it outlives a restart and holds a minute's admissions only;
    requests that alone are larger than the window are admitted to an empty one.
    """

    def admit(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        ids, at, waits = [], [], []
        for request, ts, size in zip(rows["request_id"], rows["ts"], rows["tokens"], strict=True):
            asked = ts.timestamp()
            now = max(asked, times[-1] + gap) if times else asked
            while times:
                while times and times[0] <= now - WINDOW_SECONDS:
                    times.pop(0)
                    sizes.pop(0)
                if not times or (sum(sizes) + size <= tokens and len(times) < number):
                    break
                now = times[0] + WINDOW_SECONDS
            times.append(now)
            sizes.append(int(size))
            ids.append(request)
            at.append(now)
            waits.append(now - asked)
        state.update((times, sizes))
        yield pd.DataFrame({"request_id": ids, "model": key[0], "admitted": at, "waited": waits})

    kinds = dict(requests.dtypes)
    out = f"request_id {kinds['request_id']}, model {kinds['model']}, admitted double, waited double"
    return requests.groupBy("model").applyInPandasWithState(admit, out, "times array<double>, sizes array<long>", "append", "NoTimeout")
