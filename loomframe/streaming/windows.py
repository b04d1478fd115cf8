"""Event-time windows over a stream of files: an extension, with the batch result as its check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than the watermark are dropped by the engine."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def windowed_once(spark: SparkSession, path: str) -> DataFrame:
    """All files at the path as one finished stream (available-now trigger); its output is a table in the shared folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if _is_file(spark, path) else path)
    out = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    run = windowed(stream).writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/table")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/table")


def _is_file(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file system, whatever the scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
