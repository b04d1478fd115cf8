"""A Spark session with the settings that the operators assume."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomframe", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting, Arrow for vectorised Python.  ``conf`` overrides anything."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the cluster's ``spark.checkpoint.dir``; only a local session may have one of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomframe-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: what reads it later costs no recomputation when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def timezone(spark: SparkSession, name: str | None = None) -> str:
    """The zone in which times are read and shown; a name sets it first."""
    if name is not None:
        if name not in timezones(spark):
            raise ValueError(f"unknown time zone {name}")
        spark.conf.set("spark.sql.session.timeZone", name)
    return spark.conf.get("spark.sql.session.timeZone")


def timezones(spark: SparkSession) -> list[str]:
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def delete_folder(spark: SparkSession, path: str, within: str) -> bool:
    """Deletes a folder of any Hadoop file system, if it lies under ``within``; whether it was there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, root = hadoop(path), hadoop(within)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    inner, outer = (files.makeQualified(p).toUri().normalize().toString().rstrip("/") for p in (target, root))
    if not inner.startswith(f"{outer}/"):
        raise ValueError(f"{path} is not under {within}")
    return files.delete(target, True)
