"""Incremental ingest as a stream: pages whose content is new are appended, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_pages(batch: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Pages of a batch by content, the first delivery of each that ``seen`` doesn't hold."""
    hashed = batch.filter("text is not null").withColumn("sha256", F.sha2("text", 256))
    if seen is not None:
        hashed = hashed.join(seen.select("sha256").distinct(), "sha256", "left_anti")
    keep = hashed.groupBy("sha256").agg(F.min_by(F.struct(*batch.columns), F.struct("loaded_at", "page_id")).alias("p"))
    return keep.select("sha256", *[F.col(f"p.{c}").alias(c) for c in batch.columns])


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, names: str = "*") -> None:
    """Read new files under ``source`` and append pages of new content to ``target``, then stop.

    A batch that is run again after a failure overwrites its own part, so content is appended once.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        seen = spark.read.parquet(target).filter(F.col("batch") != number) if there else None
        new_pages(batch, seen).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
