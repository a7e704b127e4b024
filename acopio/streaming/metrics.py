"""The runtime-metrics stream: samples, running counters and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_samples(spark: SparkSession, path: str, schema: str = SAMPLE, files: int = 8, names: str = "*") -> DataFrame:
    """ST1: samples as they land in a folder, in files that match ``names``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(path)


def rates(samples: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """ST1, ST2, AG19: requests, errors and peak of each window; state ends with the watermark."""
    timed = samples.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy(F.window("at", every)).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("peak"))
    return found.select(F.col("window.start").alias("start"), "requests", "errors", "peak")


def counters(samples: DataFrame) -> DataFrame:
    """ST2: monotonic counters by kind (complete output mode: few keys)."""
    return samples.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.greatest("value", F.lit(0.0)).cast("decimal(18,6)")).alias("total"))


def readable(samples: DataFrame) -> DataFrame:
    """ST1: a sample that failed (no value, or none that can be) is skipped, and the stream goes on."""
    return samples.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0))


def latest(samples: DataFrame, by: str) -> DataFrame:
    """ST1: of what has come since a slow reader looked, the newest sample alone."""
    return samples.groupBy(by).agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select(by, "x.event_id", "x.value")


def heartbeats(samples: DataFrame, by: str, every: int = 15) -> DataFrame:
    """ST1: beats between the samples of a source, one for every ``every`` seconds in which none came."""
    from pyspark.sql import Window

    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    gap = seconds(F.col("ts")) - seconds(F.lag("ts").over(Window.partitionBy(by).orderBy("ts", "event_id")))
    return samples.select(by, F.coalesce(F.floor(gap / every), F.lit(0)).alias("beats")).groupBy(by).agg(F.sum("beats").alias("beats"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Everything there is, then stop; the result is an in-memory table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
