"""Event-time windows and sessions, over tables and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windloom.session import shared_folder, stream_source

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def windows(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` of tumbling windows; on a stream events later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    got = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_windows_stream(spark: SparkSession, path: str, width: str, late: str = "1 day") -> DataFrame:
    """Run :func:`windows` as a stream over the Parquet file until all of it is read.

    Each batch writes the windows that changed to the shared folder, so nothing is gathered on the
    driver and a batch that runs again overwrites its own part; the last batch of a window counts.
    """
    folder, name = stream_source(spark, path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    target = shared_folder(spark)

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/windows/batch={number}")

    writer = windows(stream, width, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{target}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{target}/windows").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("w"))
    return last.select("start", "event_type", "w.n", "w.total")


def largest_so_far(events: DataFrame, value: str = "value") -> DataFrame:
    """``event_id, user_id, progress``: the largest value that each user had up to each event.

    The largest of each hour is carried forward over a user's hours, and events are ranked within their
    hour only, so no task gets all events of a user.
    """
    hourly = events.withColumn("hour", F.date_trunc("hour", "ts"))
    tops = hourly.groupBy("user_id", "hour").agg(F.max(value).alias("top"))
    before = F.max("top").over(Window.partitionBy("user_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col("user_id").alias("_u"), F.col("hour").alias("_h"), before.alias("before"))
    within = F.max(value).over(Window.partitionBy("user_id", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = hourly.withColumn("own", within).join(tops, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("hour").eqNullSafe(F.col("_h")))
    return rows.select("event_id", "user_id", F.greatest("own", "before").alias("progress"))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """``user_id, start, end, n``: events of a user with no longer pause than the gap."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))
    marked = events.withColumn("new", F.coalesce((pause > gap_seconds).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("session")
