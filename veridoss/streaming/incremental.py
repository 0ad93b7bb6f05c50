"""Incremental entity summaries: new files are folded in as they come, with a watermark for dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def summaries(stream: DataFrame, entity: str, date: str, value: str, late: str = "30 days", window: str = "30 days") -> DataFrame:
    """Per entity and window of event time: rows, and sum and mean of a value; later rows than ``late`` are dropped."""
    return stream.withWatermark(date, late).groupBy(F.window(date, window), F.col(entity)).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), entity, "n", "total", "mean")


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append finished windows as Parquet, and stop."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
